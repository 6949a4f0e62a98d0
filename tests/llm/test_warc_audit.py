from collections import Counter

from pyspark.sql import functions as F

from casemill.llm import warc_audit as W
from casemill.session import stored

SCHEMA = "page_id long, url string, html string, file string, offset int"


def archive(spark, n=300):
    rows = [(i, f"http://x/{i}", "é" * (i % 50 * 40), "f", 1) for i in range(n)]
    rows += [(None, "u", f"body {i}", "f", 1) for i in range(20)] + [(7, None, None, "f", 1), (8, "same", "same", "f", 1), (8, "same", "same", "f", 1)]
    return stored(W.manifest(spark.createDataFrame(rows, SCHEMA)))


def test_offsets_follow_each_other(spark):
    for rows in archive(spark).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "copies"))).alias("r")).collect():
        at = 0
        for r in rows["r"]:
            assert r["offset"] == at
            at += r["length"] * r["copies"]


def test_sound_replicas_have_one_root(spark):
    a = archive(spark)
    levels = W.tree([a, a.repartition(7)], W._file_digits([a]))
    assert levels[0].count() == 2 and levels[0].select("digest").distinct().count() == 1
    assert W.audit(a, a).count() == 0


def test_damage_is_located(spark):
    a = archive(spark)
    changed = F.col("id") % 37 == 5
    replica = a.filter("id IS NULL OR id % 41 != 3").withColumn("digest", F.when(changed, F.sha2("digest", 256)).otherwise(F.col("digest")))
    extra = a.limit(1).selectExpr("'new' AS file", "CAST(99 AS BIGINT) AS offset", "length", "id", "digest", "copies")
    found = Counter((r["file"], r["offset"], r["id"], r["state"]) for r in W.audit(a, replica.unionByName(extra)).collect())
    rows = a.collect()
    wanted = [(r["file"], r["offset"], r["id"], "missing") for r in rows if r["id"] is not None and r["id"] % 41 == 3]
    wanted += [(r["file"], r["offset"], r["id"], "changed") for r in rows if r["id"] is not None and r["id"] % 37 == 5 and r["id"] % 41 != 3]
    assert Counter(x for x in found.elements() if x[3] != "extra") == Counter(wanted)
    assert [x[:2] for x in found if x[3] == "extra"] == [("new", 99)]


def test_only_branches_that_differ_are_descended(spark):
    a = archive(spark)
    one = a.orderBy("file", "offset").limit(1).collect()[0]
    same = (F.col("file") == one["file"]) & (F.col("offset") == one["offset"])
    replica = a.withColumn("digest", F.when(same, F.lit("0")).otherwise(F.col("digest")))
    found = W.audit(a, replica).collect()
    assert [(r["file"], r["offset"], r["state"]) for r in found] == [(one["file"], one["offset"], "changed")]


def test_copies_and_lost_copies(spark):
    a = archive(spark)
    twice = a.filter("copies = 2").collect()
    assert [r["id"] for r in twice] == [8]
    assert [r["id"] for r in W.audit(a, a.withColumn("copies", F.lit(1).cast("long"))).collect()] == [8]


def test_empty_archives(spark):
    a = archive(spark, 5)
    assert W.audit(a.limit(0), a.limit(0)).count() == 0
    assert W.audit(a, a.limit(0)).filter("state = 'missing'").count() == a.count()
    assert W.audit(a.limit(0), a).filter("state = 'extra'").count() == a.count()
