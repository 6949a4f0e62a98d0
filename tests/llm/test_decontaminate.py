import hashlib
import random
import re

from casemill.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items, size=13):
    windows = {}
    for i, text in items:
        w = words(text)
        k = min(size, len(w))
        for a in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[a : a + k]), set()).add(i)
    out = []
    for d, text in docs:
        w, found = words(text), set()
        hit = [False] * len(w)
        for k in {len(x) for x in windows}:
            for a in range(len(w) - k + 1):
                if tuple(w[a : a + k]) in windows:
                    found |= windows[tuple(w[a : a + k])]
                    hit[a : a + k] = [True] * k
        out.append((d, len(w), sum(hit), sorted(map(str, found)), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    return sorted(out, key=str)


def tables(spark):
    rng = random.Random(3)
    pool = ["the", "of", "and", "été", "x1", "zwei", "Ωmega", "tok", "lamp", "NINE"]
    say = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    items = [(i, say(rng.choice([3, 13, 14, 30]))) for i in range(12)] + [(50, None), (51, ""), (52, "--"), (53, "rare word"), (54, "rare word")]
    docs = [(i, say(rng.randint(0, 200))) for i in range(40)]
    docs += [(100 + i, f"{say(20)}, {items[i][1].upper()}! {say(rng.choice([5, 900]))}") for i in range(12)]
    docs += [(None, "a Rare   WORD here"), (200, None), (200, ""), (201, items[2][1]), (201, items[2][1]), (202, "rare\nword " * 3000)]
    return docs, items, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_equals_brute_force_in_one_block_and_in_many(spark):
    docs, items, d, b = tables(spark)
    for block in (D.BLOCK_WORDS, 20):
        found = D.find(d, b, block_words=block).collect()
        assert sorted(((r["key"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in found), key=str) == brute(docs, items)


def test_clean_rows_stay_with_their_columns(spark):
    docs, items, d, b = tables(spark)
    d = d.selectExpr("*", "'x' AS key", "1 AS n_hit")
    kept = D.drop_contaminated(d, b)
    assert kept.columns == d.columns
    wanted = [r for r in brute(docs, items) if not r[4]]
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((r[0] for r in wanted), key=str)


def test_matches_tell_place_and_kind(spark):
    b = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    d = spark.createDataFrame([(7, "so alpha, beta gamma delta. alpha then beta then gamma then delta")], "doc_id long, text string")
    q = D.query_block(b, 0, 1)
    rows = D.matches(D.build_index(d, q.vocabulary), q, slop=3).collect()
    assert {(r["kind"], r["key"], r["item_id"]) for r in rows} == {("exact", 7, 1), ("near", 7, 1)}
    assert [r["start"] for r in rows if r["kind"] == "exact"] == [1]
    assert len([r for r in rows if r["kind"] == "near"]) == 2


def test_matches_of_items_with_text_ids(spark):
    b = spark.createDataFrame([("one", "alpha beta gamma"), (None, "gamma delta")], "item_id string, text string")
    d = spark.createDataFrame([(7, "alpha beta gamma delta")], "doc_id long, text string")
    q = D.query_block(b, 0, 1)
    rows = D.matches(D.build_index(d, q.vocabulary), q).collect()
    assert {(r["item_id"], r["start"]) for r in rows} == {("one", 0), (None, 2)}


def test_near_matches_equal_brute_force(spark):
    item, slop = ["alpha", "beta", "gamma", "delta", "eps"], 2
    rng = random.Random(5)
    texts = [[rng.choice([*item, "so"]) for _ in range(rng.randint(1, 30))] for _ in range(200)]
    # No eps near; and beta nearest in the document before, with another in reach.
    texts += [["alpha", "beta", "gamma", "delta", *["so"] * 9], ["so", "beta"], ["alpha", "so", "so", "beta", "gamma", "delta", "eps"]]
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    q = D.query_block(spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"), 0, 1)
    found = [(r["key"], r["start"]) for r in D.matches(D.build_index(d, q.vocabulary), q, slop=slop).collect() if r["kind"] == "near"]
    count = {w: sum(t.count(w) for t in texts) for w in item}
    rare = min(range(5), key=lambda j: count[item[j]])
    assert list(count.values()).count(min(count.values())) == 1
    assert sorted(found) == sorted(
        (i, at) for i, t in enumerate(texts) for at, w in enumerate(t) if w == item[rare]
        and all(item[j] in t[max(0, at + j - rare - slop) : max(0, at + j - rare + slop + 1)] for j in range(5))
    )


def test_digest_of_items(spark):
    found = spark.createDataFrame([(["1", "10", "2"],), ([],)], "items array<string>").select(D.items_digest().alias("h")).collect()
    assert [r["h"] for r in found] == [hashlib.sha256(x).hexdigest() for x in (b"1,10,2", b"")]


def test_empty_tables(spark):
    _, _, d, b = tables(spark)
    assert D.find(d.limit(0), b).count() == 0
    rows = D.find(d, b.limit(0)).collect()
    assert len(rows) == d.count() and not any(r["contaminated"] for r in rows)
