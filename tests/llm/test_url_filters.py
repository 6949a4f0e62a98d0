from collections import Counter

from casemill.llm import url_filters as U

RULES = [
    U.site("net/", "block"), U.site("example.net/en/", "allow"), U.site("example.com/de/", "block"),
    U.site("org/fr/", "allow"), U.word("casino"), U.Rule("digits", "block", r".*/\d{6,}$", ()),
]
CASES = [
    ("http://a.example.net/en/1?x#y", "a.example.net", "/en/1", "example.net/en/", "allow"),
    ("http://A.Example.NET/fr/1", "a.example.net", "/fr/1", "net/", "block"),
    ("http://badexample.net/en/1", "badexample.net", "/en/1", "net/", "block"),
    ("http://x.net", "x.net", "", None, "allow"),
    ("http://x.net#top", "x.net", "", None, "allow"),
    ("http://example.com/de", "example.com", "/de", None, "allow"),
    ("http://example.com/de/a", "example.com", "/de/a", "example.com/de/", "block"),
    ("http://example.com/DE/a", "example.com", "/DE/a", None, "allow"),
    ("https://a.org/fr/casino", "a.org", "/fr/casino", "org/fr/", "allow"),
    ("https://a.org/casino-x", "a.org", "/casino-x", None, "block"),
    ("https://a.org/casinos", "a.org", "/casinos", None, "allow"),
    ("https://a.org/1234567", "a.org", "/1234567", None, "block"),
    ("net/en", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("a://b://c.net/x", "b:", "//c.net/x", None, "allow"),
    ("http://" + "x" * 5000 + ".net/", "x" * 5000 + ".net", "/", "net/", "block"),
]


def pages(spark):
    rows = [(i, c[0], "h", "clash") for i, c in enumerate(CASES)] + [(None, CASES[0][0], "h", "clash"), (0, CASES[0][0], "h", "clash")]
    return spark.createDataFrame(rows, "page_id long, url string, host string, rule string")


def test_verdicts(spark):
    found = Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in U.judge(pages(spark), RULES).collect())
    assert found == Counter([*((i, *c[1:]) for i, c in enumerate(CASES)), (None, *CASES[0][1:]), (0, *CASES[0][1:])])


def test_only_rules_of_a_present_token_run(spark):
    runs = {r["page_id"]: r["n_run"] for r in U.judge(pages(spark), RULES[:5]).collect()}
    assert runs[13] == 0 and runs[9] == 1 and runs[0] <= 2


def test_rules_are_entered_under_their_rarest_token(spark):
    counts = U.token_counts(pages(spark), {"net", "example", "en", "de", "com", "none"})
    assert counts["none"] == 0 and counts["net"] > counts["de"]
    by_token, always = U.index(RULES, counts)
    assert by_token["net"] == [0] and always == [5] and 1 not in by_token.get("net", [])


def test_prefix_without_a_closing_sign_binds_no_token():
    assert U.site("a.b/en", "block").tokens == ("a", "b") and U.site("a.b/en/", "block").tokens == ("a", "b", "en")


def test_empty_table(spark):
    assert U.judge(pages(spark).limit(0), RULES).count() == 0
