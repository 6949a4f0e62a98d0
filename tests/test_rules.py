import re

import pytest
from pyspark.sql import functions as F

from casemill.operators import rules as R
from casemill.sources import readers

RULES = [
    R.Rule("A1", r"phone link|mirror app", "LINK", "Phone link", 0.92, rule_order=0),
    R.Rule("A2", r"(stick.*chart.*refresh|chart.*refresh.*stick)", "CHART.STICK", "Chart by stick", 0.9, rule_order=1),
    R.Rule("A3", r"locator.*(wrong|astray)", "LOCATOR", "Locator", 0.88, rule_order=2),
    R.Rule("A4", r"(shortwave|sw).*unpair", "SW.DROP", "Shortwave drops", 0.86, rule_order=3),
    R.Rule("A5", r"(shortwave|sw).*pair", "SW.PAIR", "Shortwave pairing", 0.85, rule_order=4),
    R.Rule("A6", r"frozen", "OFF", "Disabled", 1.0, enabled=False, rule_order=5),
    R.Rule("A7", r"(open", "BAD", "Invalid", 1.0, rule_order=6),
    R.Rule("A8", r"ECU", "ECU", "Control unit", 0.7, case_sensitive=True, rule_order=7),
    R.Rule("A9", r"refresh", "REFRESH", "Refresh", 0.6, rule_order=8),
    R.Rule("A10", r"ac|heater", "CLIMATE", "Climate", 0.5, rule_order=9),
    R.Rule("A11", r"café\b", "CAFE", "Cafe", 0.4, rule_order=10),
    R.Rule("A12", r"(?P<unit>kelvin) scale", "KELVIN", "Kelvin", 0.3, rule_order=11),
]

TICKETS = [
    ("1", "Phone LINK broken", "screen goes dark"),
    ("2", "Locator", "it is wrong"),
    ("3", "sw keeps", "Unpairing all day"),
    ("4", "STICK", "chart refresh fails"),
    ("5", "frozen", "nothing"),
    ("6", "ecu", "small letters"),
    ("7", "ECU", "big letters"),
    ("8", "locator points", "far\naway and wrong"),
    ("9", "practical", "advice"),
    ("10", "CAFÉ", "closed"),
    ("11", "KELVIN scale", "off"),
    ("12", None, None),
]

EXPECTED = {
    "1": "A1", "2": "A3", "3": "A4", "4": "A2", "5": None, "6": None, "7": "A8", "8": None,
    "9": "A10", "10": "A11", "11": "A12", "12": None,
}


@pytest.fixture(scope="module")
def tickets(spark):
    return spark.createDataFrame(TICKETS, "case_id string, subject string, description string")


def python_verdict(rules, text):
    for r in rules:
        try:
            compiled = re.compile(r.pattern, 0 if r.case_sensitive else re.IGNORECASE)
        except re.error:
            continue
        if r.enabled and compiled.search(text):
            return r.rule_id
    return None


@pytest.mark.parametrize("as_data", [False, True])
def test_first_rule_wins(tickets, as_data):
    out = R.apply_rules(tickets, RULES, as_data=as_data)
    found = {r["case_id"]: r["rule_id"] for r in out.collect()}
    assert found == EXPECTED
    for case_id, subject, description in TICKETS:
        assert found[case_id] == python_verdict(RULES, f"{subject or ''} {description or ''}")


def test_verdict_fields(tickets):
    row = R.apply_rules(tickets, RULES).filter("case_id = '3'").head()
    assert (row["rule_code"], row["rule_name"], row["rule_confidence"]) == ("SW.DROP", "Shortwave drops", 0.86)


def test_raw_columns_are_searched_beside_masked_ones(spark):
    df = spark.createDataFrame([("[EMAIL]", "heater@x.org")], "subject_redacted string, subject string")
    assert R.apply_rules(df, RULES).head()["rule_id"] == "A10"
    assert R.apply_rules(df, RULES, columns=["subject_redacted"]).head()["rule_id"] is None


def test_no_text_column_is_an_error(spark):
    with pytest.raises(ValueError):
        R.apply_rules(spark.range(1), RULES)


def test_all_matches_lists_shadowed_rules(tickets):
    hits = R.all_matches(tickets, RULES)
    by_case = {}
    for r in hits.orderBy("rule_order").collect():
        by_case.setdefault(r["case_id"], []).append(r["rule_id"])
    assert by_case["4"] == ["A2", "A9"]
    assert by_case["3"] == ["A4", "A5"]
    assert "5" not in by_case
    first = {r["case_id"]: r["rule_id"] for r in hits.groupBy("case_id").agg(F.min_by("rule_id", "rule_order").alias("rule_id")).collect()}
    assert first == {k: v for k, v in EXPECTED.items() if v}


def test_hit_rates_and_verdict_rate(tickets):
    rates = {r["rule_id"]: (r["hits"], r["rate"]) for r in R.hit_rates(tickets, RULES).collect()}
    assert rates["A9"] == (1, 1 / 12)
    assert "A6" not in rates and "A7" not in rates
    row = R.verdict_rate(R.apply_rules(tickets, RULES)).head()
    assert (row["total"], row["matched"], row["rate"]) == (12, 8, 66.7)


def test_rule_stats(spark):
    row = R.rule_stats(spark, RULES).head()
    assert (row["total_rules"], row["enabled_rules"], row["valid_patterns"]) == (12, 11, 11)


def test_no_rules(tickets):
    assert {r["rule_id"] for r in R.apply_rules(tickets, []).collect()} == {None}
    assert {r["rule_id"] for r in R.apply_rules(tickets, [], as_data=True).collect()} == {None}
    assert R.all_matches(tickets, []).count() == 0


def test_many_rules_agree_in_both_forms(spark):
    many = [R.Rule(f"M{i}", f"word{i}\\b", f"C{i}", f"N{i}", i / 1000, rule_order=i) for i in range(250)]
    df = spark.range(300).select(
        F.col("id").cast("string").alias("case_id"), F.concat(F.lit("a word"), F.col("id")).alias("subject")
    )
    chain = {r["case_id"]: r["rule_id"] for r in R.apply_rules(df, many, as_data=False).collect()}
    data = {r["case_id"]: r["rule_id"] for r in R.apply_rules(df, many, as_data=True).collect()}
    assert chain == data
    assert chain["249"] == "M249" and chain["250"] is None


def test_patterns_run_once_and_nothing_is_shuffled(spark, tickets):
    out = R.apply_rules(tickets, RULES).filter("rule_code is not null and rule_confidence > 0.6")
    physical = out._jdf.queryExecution().executedPlan().toString()
    assert physical.count("phone link") == 1
    assert "Exchange" not in physical and "Python" not in physical and "Join" not in physical


def test_rules_file_defaults(spark, tmp_path):
    path = tmp_path / "rules.csv"
    path.write_text(
        "rule_id,enabled,pattern,case_sensitive,assign_code,assign_name,confidence,notes\n"
        'R1,true,"(a|b), c",false,X,"Name, with comma",0.9,n\n'
        "R2,,plain,,Y,Why,,\n"
        "R3,false,off,TRUE,Z,Zed,0.5,\n"
    )
    first, second, third = readers.read_rules(spark, str(path))
    assert (first.pattern, first.assign_name, first.confidence, first.rule_order) == ("(a|b), c", "Name, with comma", 0.9, 0)
    assert (second.enabled, second.case_sensitive, second.confidence, second.rule_order) == (True, False, 0.0, 1)
    assert (third.enabled, third.case_sensitive) == (False, True)
    assert readers.read_rules(spark, str(tmp_path / "absent.csv")) == []
    assert readers.rules_from_frame(R.rules_frame(spark, [first, second, third])) == [first, second, third]


@pytest.mark.parametrize(
    ("pattern", "text", "hit"),
    [
        (r"(?P<a_b>x.)-(?P=a_b)$", "say xy-xy", True),
        (r"(?P<a_b>x.)-(?P=a_b)$", "say xy-xz", False),
        (r"[[]urgent", "now [urgent]", True),
        (r"[a&&b]z", "&z", True),
        (r"[]]end", "x]end", True),
        (r"[^]a]end", "aend", False),
        (r"last\Z", "at last", True),
        (r"last\Z", "at last\n", False),
        (r"\[x", "a [x", True),
    ],
)
def test_python_syntax_that_java_spells_otherwise(spark, pattern, text, hit):
    df = spark.createDataFrame([("1", text)], "case_id string, subject string")
    held = [R.Rule("R", pattern, "C", "N", 1.0)]
    assert bool(re.search(pattern, text)) == hit
    assert (R.apply_rules(df, held).head()["rule_id"] == "R") == hit


def test_a_pattern_java_refuses_is_skipped(spark):
    df = spark.createDataFrame([("1", "abc")], "case_id string, subject string")
    held = [R.Rule("A", r"(x)?(?(1)y|a)", "A", "A", 1.0), R.Rule("B", "b", "B", "B", 1.0, rule_order=1)]
    assert R.apply_rules(df, held).head()["rule_id"] == "B"
    assert R.rule_stats(spark, held).head()["valid_patterns"] == 1


@pytest.mark.parametrize("as_data", [False, True])
def test_a_pattern_is_not_run_on_texts_without_its_literals(spark, as_data):
    # Without that, the pattern tries some 2**40 ways to cut the first text.
    rules = [R.Rule("E", r"(x+x+)+y stop|(x+x+)+z halt", "E", "E"), R.Rule("S", "x STOP", "S", "S", case_sensitive=True, rule_order=1)]
    df = spark.createDataFrame([("1", "x" * 40), ("2", "xxY Stop"), ("3", "x STOP"), ("4", "XXZ HALT")], "case_id string, subject string")
    out = R.apply_rules(df, rules, as_data=as_data)
    assert {r["case_id"]: r["rule_id"] for r in out.collect()} == {"1": None, "2": "E", "3": "S", "4": "E"}


@pytest.mark.parametrize("as_data", [False, True])
def test_letters_that_fold_to_ascii_are_found(spark, as_data):
    rules = [R.Rule("F", "kiss", "F", "F"), R.Rule("U", "straße", "U", "U", rule_order=1), R.Rule("X", "Kiss", "X", "X", case_sensitive=True, rule_order=2)]
    texts = ["KISS", "kıſs", "KİSS", "STRASSE", "STRAßE", "kis"]
    df = spark.createDataFrame([(t, t) for t in texts], "case_id string, subject string")
    found = {r["case_id"]: r["rule_id"] for r in R.apply_rules(df, rules, as_data=as_data).collect()}
    assert found == {"KISS": "F", "kıſs": "F", "KİSS": "F", "STRASSE": None, "STRAßE": "U", "kis": None}
    assert R.all_matches(df, rules).count() == 4
    assert {r["rule_id"]: r["hits"] for r in R.hit_rates(df, rules).collect()} == {"F": 3, "U": 1, "X": 0}
