import os

import pytest

import __spark_entry__ as entry
import check_sql

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="sample tables not present")


@pytest.fixture(scope="module")
def sql():
    return check_sql.connect(SF_DIR)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert {r["value"] for r in rows} <= {"rules", "none"} and len(rows) == 2


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, sql, name):
    assert check_sql.compare(spark, sql, SF_DIR, name) == ""


@pytest.mark.parametrize("name", ["topics_kmeans", "reduce_pca", "embed_tfidf"])
def test_query_without_sql_gives_rows(spark, name):
    assert entry.queries()[name](spark, SF_DIR).count() > 0


def test_ingest_files_gives_no_task_a_whole_file(spark, monkeypatch):
    from casemill.plans import registry_more

    sf_dir, paths = "/root/testdata/sf0.001", []
    before = sorted(r["case_id"] for r in registry_more.ingest_files(spark, sf_dir).collect())
    write = registry_more.writers.write_csv
    monkeypatch.setattr(registry_more, "PART_BYTES", 4 << 10, raising=False)
    monkeypatch.setattr(registry_more.writers, "write_csv", lambda df, path: paths.append(path) or write(df, path))
    assert sorted(r["case_id"] for r in registry_more.ingest_files(spark, sf_dir).collect()) == before
    assert all(spark.read.text(p).select("_metadata.file_path").distinct().count() > 1 for p in paths)
