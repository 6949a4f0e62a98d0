import random
import re

import pytest
from pyspark.sql import functions as F

from casemill.operators import phrases as P
from casemill.operators import redact


def plain(words, pairs):
    """First occurrence of every phrase, by trying each at each place."""
    found = []
    for p, (phrase, _) in enumerate(pairs):
        own = phrase.split(" ")
        for i in range(len(words) - len(own) + 1):
            if words[i : i + len(own)] == own:
                found.append((i, len(own), p))
                break
    return sorted(found, key=lambda x: (x[0], -x[1]))


def made(seed, n=60, vocabulary="abcd"):
    rng = random.Random(seed)
    phrases = {" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 5))) for _ in range(n)}
    return [(p, rng.choice(["ORG", "GPE"])) for p in sorted(phrases)], rng


@pytest.mark.parametrize("seed", range(12))
def test_automaton_equals_trying_every_phrase(seed):
    pairs, rng = made(seed, n=rng_size(seed), vocabulary="abc" if seed % 2 else "abcdefgh")
    m = P.Matcher(P.automaton(pairs))
    for _ in range(60):
        words = [rng.choice("abcdefghx") if seed % 3 else rng.choice("abx") for _ in range(rng.randint(0, 40))]
        assert m.first(words) == plain(words, pairs)


def rng_size(seed):
    return [1, 3, 20, 100, 300][seed % 5]


def test_links_lead_to_the_longest_other_ending():
    m = P.Matcher(P.automaton([("a b c d", "X"), ("b c", "X"), ("c", "X"), ("b c e", "X")]))
    assert m.first("a b c e".split()) == [(1, 3, 3), (1, 2, 1), (2, 1, 2)]
    assert m.first("a b c d".split()) == [(0, 4, 0), (1, 2, 1), (2, 1, 2)]
    assert P.Matcher(P.automaton([])).first(["a"]) == []


def frames(spark, pairs, rng):
    rows = [(i, " ".join(rng.choice(["a", "b", "c", "d", "x", "a,", "(b)"]) for _ in range(rng.randint(0, 30)))) for i in range(80)]
    rows += [(90, None), (91, ""), (92, "a b " * 20_000), (None, "a b c")]
    df = spark.createDataFrame([(*r, "k", "w") for r in rows], "case_id long, subject string, key string, words string")
    return rows, df, spark.createDataFrame([*pairs, ("", "ORG"), (None, "ORG"), ("a b", None), ("a", "ZZZ")], "phrase string, label string")


@pytest.mark.parametrize("most", [P.MOST_PHRASES, 9])
def test_entities_in_one_list_and_in_many(spark, most):
    pairs, rng = made(21)
    pairs = [p for p in pairs if p[0] != "a"] + [("a", "GPE")]
    rows, df, table = frames(spark, pairs, rng)
    got = P.entities(df, table, "subject", most_phrases=most).collect()
    label = dict(pairs)
    for case, text in rows:
        own = sorted((r for r in got if r["case_id"] == case), key=lambda r: r["pos"])
        wanted = plain(re.findall(r"\w+", text or ""), pairs)
        assert [(r["ent_text"], r["label"]) for r in own] == [(pairs[p][0], label[pairs[p][0]]) for _, _, p in wanted]


def test_tagger_masks_like_the_table_without_a_shuffle(spark):
    pairs, rng = made(22)
    _, df, table = frames(spark, pairs, rng)
    df = df.filter("case_id IS NOT NULL")
    tagged = df.withColumn("m", redact.mask_entities(F.col("subject"), redact.phrase_tagger(table)(F.col("subject"))))
    joined = redact.mask_from_table(df, redact.gazetteer_entities(df, table, "subject"), "subject", "m")
    assert {r["case_id"]: r["m"] for r in tagged.collect()} == {r["case_id"]: r["m"] for r in joined.collect()}
    physical = tagged._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in physical and "Generate" not in physical


def test_longest_leaves_longer_phrases_out(spark):
    df = spark.createDataFrame([(1, "a b c")], "case_id long, subject string")
    table = spark.createDataFrame([("a b c", "ORG"), ("b c", "ORG")], "phrase string, label string")
    assert [r["ent_text"] for r in P.entities(df, table, "subject", longest=2).collect()] == ["b c"]


def test_a_list_that_does_not_fit_is_refused_by_the_tagger(spark, monkeypatch):
    monkeypatch.setattr(P, "MOST_PHRASES", 1)
    table = spark.createDataFrame([("a", "ORG"), ("b", "ORG")], "phrase string, label string")
    with pytest.raises(ValueError, match="use entities"):
        P.tagger(spark, table)


def test_a_batch_holds_texts_and_no_arrays_of_words(spark):
    docs = spark.createDataFrame([("a", "the red  fox, the\tred fox"), ("b", " .,"), ("c", None)], "case_id string, text string")
    phrases = spark.createDataFrame([("red fox", "X")], "phrase string, label string")
    tag = P.tagger(spark, phrases)
    tagged = docs.select("case_id", tag(F.col("text")).alias("e"))
    found = {r["case_id"]: r["e"] and [tuple(e) for e in r["e"]] for r in tagged.collect()}
    assert found == {"a": [("red fox", "X")], "b": [], "c": None}
    for made in (tagged, P.entities(docs, phrases, "text")):
        assert "array_join" in made._jdf.queryExecution().optimizedPlan().toString()
