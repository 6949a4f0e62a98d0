import re
from collections import Counter

from pyspark.sql import functions as F

from casemill.llm import quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_words int"
ROWS = [
    (None, "a b c a b c a b c", "en", "s", 1),
    (1, "", "en", "s", 1),
    (2, None, None, None, 1),
    (3, "x" * 300, "en", None, 1),
    (4, " \n\n a b\t\x0b ", "en", "s", 1),
    (5, "a b c d " * 4000, "en", "s", 1),
    (6, "q w e r\nq w e r\n \n\nq w e", "de", "s", 1),
    (7, "été # ** ünï x <b>\n" + " ".join(f"w{i}" for i in range(60)), "de", "t", 1),
    (7, "été # ** ünï x <b>\n" + " ".join(f"w{i}" for i in range(60)), "de", "t", 1),
]


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    seen = Counter(tuple(words[i : i + 3]) for i in range(n - 2))
    again = {j for i in range(n - 2) if seen[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    signs = len(re.findall(r"[#*$%&|<>]", text))
    failed = n < 50 or 100 * len(again) > 50 * n
    return n, sum(map(len, words)), signs, len(lines) - len(set(lines)), len(again), failed


def test_counts_equal_brute_force(spark):
    found = quality_rules.assess(spark.createDataFrame(ROWS, SCHEMA)).collect()
    assert Counter(tuple(r)[:-1] for r in found) == Counter((r[0], *counts(r[1])) for r in ROWS)
    assert not any(r["kept"] and r["base_failed"] for r in found)


def test_outliers_of_their_group_go_and_the_rest_stays(spark):
    plain = [(i, " ".join(f"w{i}x{j}" for j in range(80)), "en", "s", 0) for i in range(150)]
    signs = [(1000 + i, " ".join(f"w{i}x{j}***" for j in range(80)), "en", "s", 0) for i in range(20)]
    loud = [(2000 + i, " ".join(f"W{i}X{j}LOUD" for j in range(80)), "en", "s", 0) for i in range(20)]
    small = [(3000 + i, " ".join(f"w{i}y{j}" for j in range(80)), None, "tiny", 0) for i in range(3)]
    df = spark.createDataFrame(plain + signs + loud + small, SCHEMA)
    kept = {r["doc_id"] for r in quality_rules.assess(df).filter("kept").collect()}
    assert kept == {r[0] for r in plain + small}
    rows = quality_rules.keep(df)
    assert rows.columns == df.columns and {r["doc_id"] for r in rows.collect()} == kept


def test_cut_offs_follow_the_group(spark):
    code = [(i, " ".join(f"w{i}x{j}" + ("##" if j % 5 == 0 else "") for j in range(80)), "en", "code", 0) for i in range(150)]
    odd = [(1000, code[0][1].replace("w0", "v"), "en", "news", 0)]
    news = [(2000 + i, " ".join(f"w{i}x{j}" for j in range(80)), "en", "news", 0) for i in range(150)]
    kept = {r["doc_id"] for r in quality_rules.assess(spark.createDataFrame(code + odd + news, SCHEMA)).filter("kept").collect()}
    assert 5 in kept and 1000 not in kept


def test_a_source_full_of_spam_cannot_lift_its_own_limit(spark):
    news = [(i, " ".join(f"w{i}x{j}" for j in range(80)), "en", "news", 0) for i in range(400)]
    hot = [(1000 + i, " ".join(f"w{i}x{j}" + "***" * (i % 3 == 0) for j in range(80)), "en", "hot", 0) for i in range(150)]
    kept = {r["doc_id"] for r in quality_rules.assess(spark.createDataFrame(news + hot, SCHEMA)).filter("kept").collect()}
    assert kept == {r[0] for r in news} | {1000 + i for i in range(150) if i % 3}


def test_each_share_rejects_what_lies_far_out_and_limits_follow_the_data(spark):
    """Two languages of other habits; every kind of outlier goes, nothing else does."""
    rows, odd = [], {}
    for n, (lang, size, capital) in enumerate((("aa", 90, 9), ("bb", 300, 2))):
        for i in range(150):
            words = [f"{'W' if j % capital == 0 else 'w'}{i}x{j}" for j in range(size)]
            lines = [" ".join(words[j : j + 10]) for j in range(0, size, 10)]
            rows.append((1000 * n + i, "\n".join(lines), lang, f"s{i % 2}", 0))
        fresh = [f"w{lang}y{j}" for j in range(size)]
        # Lines of two words repeat without repeating a window of three.
        twos = [f"{a} {b}" for a, b in zip(fresh[::2], fresh[1::2])]
        doubled = "\n".join(t for t in twos[: size // 6] for _ in range(2))
        rest = " ".join(fresh[size // 3 :])
        odd |= {
            9000 + 10 * n: (" ".join(w + "#$" for w in fresh), lang), 9001 + 10 * n: (" ".join(fresh).upper(), lang),
            9002 + 10 * n: (" ".join(fresh[: size // 4]) + " " + " ".join(fresh), lang),
            9003 + 10 * n: ("\n".join(f"{w}\n{w}\n{w}" for w in fresh[::3]) + "\n" + rest, lang),
        }
    rows += [(k, t, lang, "s0", 0) for k, (t, lang) in odd.items()]
    df = spark.createDataFrame(rows, SCHEMA)
    measured = quality_rules.measured(df)
    kept = {r["doc_id"] for r in quality_rules.assess(df).filter("kept").collect()}
    assert {r[0] for r in rows} - kept == set(odd)
    cuts = quality_rules.cut_offs(quality_rules.sketches(measured)).collect()
    for kind in ("signs", "lines", "repeats", "capitals"):
        limit = {r["_q_lang"]: r[f"_q_max_{kind}"] for r in cuts}
        assert limit["=aa"] != limit["=bb"] or kind == "signs", kind


def test_columns_of_any_name_stay(spark):
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in ROWS], SCHEMA + ", key string, _q_key string, _Q_words string")
    out = quality_rules.keep(df)
    assert out.columns == df.columns and {tuple(r) for r in out.collect()} <= {tuple(r) for r in df.collect()}


def test_empty_table_and_plan(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert quality_rules.assess(empty).count() == 0 and quality_rules.keep(empty).count() == 0
    df = spark.createDataFrame(ROWS, SCHEMA).withColumn("lang", F.col("lang"))
    physical = quality_rules.measured(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in physical and "Arrow" not in physical and "Exchange" not in physical
