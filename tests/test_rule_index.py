import random
import re

import pytest

from casemill.operators import rule_index as I
from casemill.operators import rules as R
from casemill.plans import adapters as A


def needs(pattern, exact=True):
    found = I.required(R.Rule("r", pattern, "c", "n", case_sensitive=exact))
    return None if found is None else {tuple(sorted(x)) for x in found}


@pytest.mark.parametrize(
    ("pattern", "wanted"),
    [
        ("engine", {("engine",)}), ("engine.*stall", {("engine", "stall")}), ("(cat|dog) food", {(" food", "cat"), (" food", "dog")}),
        ("brakes?", {("brake",)}), ("a(bcd)e", {("abcde",)}), ("(?:ab)+cd", {("ab", "cd")}), ("(?:ab)*cd", {("cd",)}),
        (r"\bstop\b", {("stop",)}), ("[A-Z]{8,}", None), (".*", None), ("cat|", None), ("x|long", None), (r"(ab)\1", {("ab",)}),
        ("(?P<n>ab)cd(?P=n)", {("abcd",)}), ("ab(?=cd)ef", {("abef",)}), ("(?i)abc", None), ("(?i:abc)de", {("de",)}),
        ("licen[sc]e|all rights", {("licen",), ("all rights",)}), ("", None), ("(a|b)(c|d)xy", {("xy",)}),
    ],
)
def test_required_literals(pattern, wanted):
    assert needs(pattern) == wanted


def test_literals_without_case_stop_outside_ascii():
    assert needs("Straße", exact=False) == {("stra",)}
    assert needs("éaument", exact=False) == {("aument",)} and needs("éaument") == {("éaument",)}


ATOMS = ["cat", "dog", "s", "K", "i", "ab", "ét", ".", ".*", "[ab]", r"\d", "(cat|do)", "(?:x|yz)?", "(ab)+", r"\b", "x{2,3}", "(?=c)", "z*", "|"]


@pytest.mark.parametrize("seed", range(6))
def test_first_match_equals_trying_every_rule(seed):
    """Random patterns over texts that hold odd cases: the Kelvin sign, long s, dotless and dotted i."""
    rng = random.Random(seed)
    made = []
    while len(made) < 150:
        pattern = "".join(rng.choice(ATOMS) for _ in range(rng.randint(1, 5)))
        try:
            re.compile(pattern)
        except re.error:
            continue
        if len(made) > 5 and re.search(pattern, ""):
            continue
        made.append(R.Rule(f"r{len(made)}", pattern, "c", "n", case_sensitive=rng.random() < 0.5, rule_order=len(made)))
    made = made[6:] + made[:6]
    index = I.Index([(r.pattern, r.case_sensitive) for r in made], [I.required(r) for r in made])
    tried = 0
    for _ in range(300):
        text = "".join(rng.choice(["c", "a", "t", "CAT", "do", "g", "ab", "x", "z", "K", "ſ", "ı", "İ", "ÉT", "7", " "]) for _ in range(rng.randint(0, 9)))
        wanted = next((i for i, r in enumerate(made) if re.search(r.pattern, text, 0 if r.case_sensitive else re.IGNORECASE)), None)
        found, n = index.first(text)
        assert found == wanted, (text, wanted and made[wanted])
        tried += n
    assert tried < 300 * len(made) / 2


def test_verdicts_equal_the_chain(spark):
    rows = [(i, t) for i, t in enumerate(["an IDIOT", "Licensed under the apache", None, "", "SHOUTING out", "thble and tion", 'token = "' + "a" * 40 + '"'])]
    df = spark.createDataFrame([(str(i), t, "x") for i, t in rows], "case_id string, subject string, rule_code string")
    chained = R.apply_rules(df, A.SAMPLE_RULES, as_data=False)
    indexed = I.apply_indexed(df, A.SAMPLE_RULES)
    assert indexed.columns == chained.columns
    assert sorted(map(str, indexed.collect())) == sorted(map(str, chained.collect()))
    counted = I.apply_indexed(df, A.SAMPLE_RULES, tried="tried").collect()
    assert all(r["tried"] <= 5 for r in counted)


def test_long_rule_sets_go_through_the_index(spark):
    many = [R.Rule(f"r{i}", f"word{i}x", f"c{i}", "n", rule_order=i) for i in range(1200)]
    df = spark.createDataFrame([("1", "a WORD77x here, word12x"), ("2", "none")], "case_id string, subject string")
    out = R.apply_rules(df, many)
    assert {r["case_id"]: r["rule_id"] for r in out.collect()} == {"1": "r12", "2": None}
    assert "ArrowEvalPython" in out._jdf.queryExecution().executedPlan().toString()


def test_no_rules(spark):
    df = spark.createDataFrame([("1", "text")], "case_id string, subject string")
    assert I.apply_indexed(df, []).head()["rule_id"] is None
