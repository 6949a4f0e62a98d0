import math
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from casemill.llm import mixture

SCHEMA = "doc_id long, text string, source string, size string, hash string"


def goals(sizes):
    """Targets by sharing again and again what passes three times a source's size."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, target, open_ = float(sum(sizes.values())), dict.fromkeys(names, 0.0), set(names)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] >= 3 * sizes[s]}
        if not full:
            return target | share
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def table(spark):
    rows = [(i, "w " * (i % 17), f"s{i % 5}", None, "h") for i in range(400)]
    rows += [(1000 + i, "w " * 30, "hot", None, "h") for i in range(300)]
    rows += [(None, "a b c", None, None, None), (2000, None, "s1", None, None), (2001, "", "void", None, None)]
    rows += [(2002, "x y", "tiny", None, None)] * 3
    return spark.createDataFrame(rows, SCHEMA), rows


def test_targets_and_budgets(spark):
    df, rows = table(spark)
    found = mixture.plan(df).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[2]] += len((r[1] or "").split())
    wanted = goals(dict(sizes))
    assert Counter(r["size"] for r in found) == Counter(len((r[1] or "").split()) for r in rows)
    source = {r[0]: r[2] for r in rows}
    taken = defaultdict(int)
    for r in found:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and math.isclose(r["target"], wanted[s], rel_tol=1e-9)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert taken == {s: math.floor(wanted[s]) for s in sizes}


def test_reruns_and_row_order_do_not_matter(spark):
    df, _ = table(spark)
    one = sorted(mixture.plan(df).collect(), key=str)
    two = sorted(mixture.plan(df.repartition(5, F.rand(1))).collect(), key=str)
    assert one == two


def test_mixed_documents_come_as_often_as_taken(spark):
    df, _ = table(spark)
    mixed = mixture.mix(df)
    assert mixed.columns == df.columns
    words = {r["source"]: r["n"] for r in mixed.groupBy("source").agg(F.sum(mixture.size_of(F.col("text"))).alias("n")).collect()}
    target = {r["source"]: r["target"] for r in mixture.plan(df).join(df.select("doc_id", "source"), "doc_id").collect()}
    for s, n in words.items():
        assert s is None or abs(n - target[s]) <= 15.5


def test_empty_table_and_no_words(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixture.plan(empty).count() == 0 and mixture.mix(empty).count() == 0
    none = spark.createDataFrame([(1, None, "s", None, None), (2, "", None, None, None)], SCHEMA)
    assert [r["taken"] for r in mixture.plan(none).collect()] == [0, 0] and mixture.mix(none).count() == 0


def test_no_python_on_the_way(spark):
    df, _ = table(spark)
    physical = mixture.plan(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in physical and "Arrow" not in physical
