"""Ordered regex rules: first match, all matches, statistics.

A rule set is read on the driver once, because every pattern has to be checked
there. The two matching forms below read the tickets in place: no shuffle, no join.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill import schema
from casemill.functions import text

log = logging.getLogger(__name__)

# The columns searched, in order, when present.
SEARCHED_COLUMNS = ("subject_redacted", "subject", "description_redacted", "description")

VERDICT_TYPE = "struct<rule_code:string,rule_name:string,rule_confidence:double,rule_id:string>"
VERDICT_FIELDS = ("rule_code", "rule_name", "rule_confidence", "rule_id")

# One CASE per this many rules. A longer CASE costs more to plan than it saves.
CHAIN_LENGTH = 100

# A pattern that requires more literals than this is tried without a look for them.
MOST_LITERALS = 24


@dataclass(frozen=True)
class Rule:
    rule_id: str
    pattern: str
    assign_code: str
    assign_name: str
    confidence: float = 0.0
    enabled: bool = True
    case_sensitive: bool = False
    notes: str = ""
    rule_order: int = 0


def _java_class(pattern: str, start: int) -> tuple[str, int]:
    """The character class that opens at ``start``, and where it ends.

    In a Java class a bracket opens a nested class and ``&&`` intersects; here both
    are characters. A closing bracket at the front is one as well.
    """
    at, out = start + 1, "["
    if pattern[at : at + 1] == "^":
        at, out = at + 1, out + "^"
    first = True
    while at < len(pattern) and (first or pattern[at] != "]"):
        if pattern[at] == "\\":
            out, at = out + pattern[at : at + 2], at + 2
        else:
            out, at = out + ("\\" if pattern[at] in "[]&" else "") + pattern[at], at + 1
        first = False
    return out + "]", at + 1


def _java_syntax(pattern: str) -> str:
    """A Python pattern in Java's spelling.

    Named groups and references to them, the end of the text, and characters that mean
    more inside a Java class are written differently. Java's group names have neither
    underscores nor a digit in front, so groups are renamed by position.
    """
    names: dict[str, str] = {}
    out, at = "", 0
    while at < len(pattern):
        two = pattern[at : at + 2]
        named = re.match(r"\(\?P<(\w+)>", pattern[at:])
        again = re.match(r"\(\?P=(\w+)\)", pattern[at:])
        if two == "\\Z":
            out, at = out + "\\z", at + 2
        elif two[:1] == "\\":
            out, at = out + two, at + 2
        elif two[:1] == "[":
            inside, at = _java_class(pattern, at)
            out += inside
        elif named:
            out += f"(?<{names.setdefault(named[1], f'g{len(names)}')}>"
            at += named.end()
        elif again:
            out, at = out + f"\\k<{names.get(again[1], again[1])}>", at + again.end()
        else:
            out, at = out + pattern[at], at + 1
    return out


def java_pattern(rule: Rule) -> str:
    """The rule's pattern with Python's meaning of ``.``, ``\\w``, letter case and syntax."""
    flags = "(?dU)" if rule.case_sensitive else "(?diU)"
    return flags + _java_syntax(rule.pattern)


def is_valid(spark: SparkSession, rule: Rule, java: Any = None) -> bool:
    """``java`` is Java's class of patterns, for callers with many rules: looking it up is slow."""
    try:
        re.compile(rule.pattern)
        (java or spark._jvm.java.util.regex.Pattern).compile(java_pattern(rule))
    except (re.error, Py4JJavaError, PySparkException) as error:
        log.warning("Rule %s has an invalid pattern: %s", rule.rule_id, str(error).split("\n")[0])
        return False
    return True


def active(spark: SparkSession, rules: Iterable[Rule]) -> list[Rule]:
    """Enabled rules with a usable pattern, in rule order."""
    ordered, java = sorted(rules, key=lambda r: r.rule_order), spark._jvm.java.util.regex.Pattern
    return [r for r in ordered if r.enabled and is_valid(spark, r, java)]


def searched_text(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    names = SEARCHED_COLUMNS if columns is None else columns
    present = [c for c in names if c in df.columns]
    if not present:
        raise ValueError(f"No text column among {list(names)}")
    return text.join_text(" ", present)


def _with_searched(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Add the text that rules search, and that text for literals whose letter case does not count.

    Both are projections of their own, so that the rules share one copy. ``rule_index.fold``
    in columns: the letters outside ASCII that match an ASCII one are folded with it.
    """
    plain = F.replace(F.col("_searched"), F.lit("İ"), F.lit("i"))
    folded = F.replace(F.replace(F.lower(plain), F.lit("ı"), F.lit("i")), F.lit("ſ"), F.lit("s"))
    return df.withColumn("_searched", searched_text(df, columns)).withColumn("_folded", folded)


def _literals(rule: Rule) -> list[list[str]] | None:
    """Alternatives of words of which a match holds all; None where a look for them does not pay.

    Of each literal that a match holds, its longest word; the pattern itself is in the plan once.
    """
    from casemill.operators import rule_index

    needs = rule_index.required(rule)
    if needs is None or sum(map(len, needs)) > MOST_LITERALS:
        return None
    words = [sorted({max(x.split(), key=len) for x in every if x.split()}, key=lambda w: (-len(w), w)) for every in needs]
    return words if all(words) else None


def _hit(rule: Rule) -> Column:
    """Whether the rule's pattern is found; the pattern runs only where its literals are there."""
    hit, needs = F.col("_searched").rlike(java_pattern(rule)), _literals(rule)
    if needs is None:
        return hit
    inside = F.col("_searched" if rule.case_sensitive else "_folded")
    held = [reduce(and_, [F.contains(inside, F.lit(x)) for x in alternative]) for alternative in needs]
    return reduce(or_, held) & hit


def _verdict(rule: Rule) -> Column:
    return F.struct(
        F.lit(rule.assign_code).alias("rule_code"),
        F.lit(rule.assign_name).alias("rule_name"),
        F.lit(float(rule.confidence)).alias("rule_confidence"),
        F.lit(rule.rule_id).alias("rule_id"),
    )


def _chain(rules: Sequence[Rule]) -> Column:
    """The first matching rule as one flat CASE, which stops at its first hit."""
    no_verdict = F.lit(None).cast(VERDICT_TYPE)
    chains = []
    for start in range(0, len(rules), CHAIN_LENGTH):
        head, *tail = rules[start : start + CHAIN_LENGTH]
        case = F.when(_hit(head), _verdict(head))
        for rule in tail:
            case = case.when(_hit(rule), _verdict(rule))
        chains.append(case)
    return F.coalesce(*chains, no_verdict)


def _rule_array(rules: Sequence[Rule]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(java_pattern(r)).alias("pattern"),
                F.lit(r.rule_order).alias("rule_order"),
                F.lit(r.case_sensitive).alias("exact"),
                _literal_array(_literals(r)).alias("needs"),
                _verdict(r).alias("verdict"),
            )
            for r in rules
        ]
    )


def _literal_array(needs: list[list[str]] | None) -> Column:
    found = F.lit(None) if needs is None else F.array(*[F.array(*map(F.lit, x)) for x in needs])
    return found.cast("array<array<string>>")


def _scan(rules: Sequence[Rule]) -> Column:
    """The first matching rule by walking the rules as data."""
    if not rules:
        return F.lit(None).cast(VERDICT_TYPE)
    subject, folded = F.col("_searched"), F.col("_folded")

    def possible(r: Column) -> Column:
        def held(literal: Column) -> Column:
            return F.when(r["exact"], F.contains(subject, literal)).otherwise(F.contains(folded, literal))

        return r["needs"].isNull() | F.exists(r["needs"], lambda every: F.forall(every, held))

    return F.aggregate(
        _rule_array(rules),
        F.lit(None).cast(VERDICT_TYPE),
        lambda found, r: F.when(found.isNotNull(), found).when(
            possible(r) & F.regexp_like(subject, r["pattern"]), r["verdict"]
        ),
    )


def apply_rules(
    df: DataFrame,
    rules: Iterable[Rule],
    columns: Sequence[str] | None = None,
    as_data: bool | None = None,
) -> DataFrame:
    """Add the four verdict columns of the first matching rule, null without one.

    All forms give the same rows. The chain compiles each pattern once per task;
    ``as_data`` walks the rules as data. Unless one is chosen, very many rules are tried
    behind their literals (``rule_index``).
    """
    held = list(rules)
    if as_data is None and len(held) > 10 * CHAIN_LENGTH:
        from casemill.operators import rule_index

        return rule_index.apply_indexed(df, held, columns)
    usable = active(df.sparkSession, held)
    verdict = _scan(usable) if as_data else _chain(usable)
    kept = [F.col(f"`{c}`") for c in df.columns if c not in VERDICT_FIELDS]
    # Expanding the verdict keeps later filters on it from running the patterns again:
    # a filter moves through a projection, but not below the row it is read from.
    return _with_searched(df, columns).select(*kept, F.inline_outer(F.array(verdict)))


def all_matches(
    df: DataFrame,
    rules: Iterable[Rule],
    columns: Sequence[str] | None = None,
    key: str = "case_id",
) -> DataFrame:
    """One row (key, rule_order and verdict) for every rule that matches a ticket."""
    usable = active(df.sparkSession, rules)
    hits = F.array(
        *[
            F.when(
                _hit(r),
                F.struct(F.lit(r.rule_order).alias("rule_order"), *[_verdict(r)[f].alias(f) for f in VERDICT_FIELDS]),
            )
            for r in usable
        ]
    )
    if not usable:
        hits = F.array().cast("array<struct<rule_order:int," + VERDICT_TYPE[len("struct<") :] + ">")
    return (
        _with_searched(df, columns)
        .select(key, F.explode(F.array_compact(hits)).alias("hit"))
        .select(key, "hit.*")
    )


def hit_rates(df: DataFrame, rules: Iterable[Rule], columns: Sequence[str] | None = None) -> DataFrame:
    """Matches of every active rule by itself, with its share of all tickets."""
    usable = active(df.sparkSession, rules)
    counted = _with_searched(df, columns).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(_hit(r)).alias(f"_r{i}") for i, r in enumerate(usable)],
    )
    pairs = F.array(
        *[
            F.struct(F.lit(r.rule_id).alias("rule_id"), F.col(f"_r{i}").alias("hits"))
            for i, r in enumerate(usable)
        ]
    )
    rate = F.when(F.col("total") > 0, F.col("hits") / F.col("total")).otherwise(F.lit(0.0))
    return counted.select("total", F.inline(pairs)).select("rule_id", "hits", rate.alias("rate"))


def verdict_rate(labelled: DataFrame) -> DataFrame:
    """Tickets in all, tickets some rule labelled, and the share in percent."""
    return labelled.agg(
        F.count(F.lit(1)).alias("total"), F.count("rule_code").alias("matched")
    ).withColumn(
        "rate",
        F.when(F.col("total") > 0, F.round(F.col("matched") * 100.0 / F.col("total"), 1)).otherwise(
            F.lit(0.0)
        ),
    )


def rules_frame(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    names = [f.name for f in schema.RULE_SCHEMA.fields]
    return spark.createDataFrame(
        [tuple(getattr(r, n) for n in names) for r in rules], schema.RULE_SCHEMA
    )


def rule_stats(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    """Rules in all, enabled, and with a usable pattern."""
    held = list(rules)
    frame = rules_frame(spark, held)
    valid_ids = [r.rule_order for r in held if is_valid(spark, r)]
    return frame.agg(
        F.count(F.lit(1)).alias("total_rules"),
        F.count_if(F.col("enabled")).alias("enabled_rules"),
        F.count_if(F.col("rule_order").isin(valid_ids) if valid_ids else F.lit(False)).alias("valid_patterns"),
    )
