"""First-match rules for long rule sets: a text tries only rules whose literals it holds.

From each parsed pattern come its required literals: strings of which every match holds
all (a conjunction), for each of the pattern's alternatives by itself. One automaton over
the characters of a text finds all literals of all rules at once; rules one of whose
conjunctions is complete, and rules that require nothing, are then tried in rule order
until the first matches. So the work per text follows the rules it resembles, not the
number of rules, and it needs no shuffle and no join. How many rules were tried comes
back beside the verdict.

Leaving a literal out is always safe, and it is done where a pattern does not pin the
characters down: in optional parts, classes, references, and, where letter case does not
count, at characters outside ASCII, whose case has exceptions. The two ASCII letters with
such exceptions (i and s) are folded together with them.

The rule list is read on the driver, as every pattern is checked there; what goes to the
tasks is as long as the list. A null text is searched as an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from re import _constants as K
from re import _parser as parser

import ahocorasick
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.operators import rules as R

# A literal shorter than this says too little; more alternatives than this are not kept apart.
SHORTEST = 2
MOST_ALTERNATIVES = 64

#: Alternatives, each a set of literals that a match holds; an empty set requires nothing.
Needs = list[frozenset[str]]

_NOTHING: Needs = [frozenset()]
_ONCE = (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT)


def fold(text: str) -> str:
    """``text`` so that what matches whatever the case reads the same."""
    return text.replace("İ", "i").lower().replace("ı", "i").replace("ſ", "s")


def _both(a: Needs, b: Needs) -> Needs:
    """What a match needs of two parts in a row."""
    if len(a) * len(b) > MOST_ALTERNATIVES:
        # One part alone is enough; the one whose weakest alternative says more is kept.
        return max(a, b, key=lambda n: min(sum(map(len, x)) for x in n))
    return list({x | y for x in a for y in b})


class _Reader:
    def __init__(self, ignore_case: bool):
        self.ignore_case = ignore_case

    def plain(self, code: int) -> bool:
        return not self.ignore_case or code < 128

    def needs(self, items: Iterable) -> Needs:
        found, run = _NOTHING, ""

        def closed() -> Needs:
            text = fold(run) if self.ignore_case else run
            return _both(found, [frozenset([text])]) if len(text) >= SHORTEST else found

        for op, value in items:
            if op is K.LITERAL and self.plain(value):
                run += chr(value)
                continue
            if op is K.AT or op in (K.ASSERT, K.ASSERT_NOT):
                continue  # takes no characters, so what stands around it stays together
            if op is K.SUBPATTERN and not value[1] and not value[2] and self._literal(value[3]):
                run += "".join(chr(c) for _, c in value[3])
                continue
            found, run = closed(), ""
            if op is K.SUBPATTERN:
                found = _both(found, self.needs(value[3]) if not value[1] and not value[2] else _NOTHING)
            elif op is K.ATOMIC_GROUP:
                found = _both(found, self.needs(value))
            elif op is K.BRANCH:
                every = [n for part in value[1] for n in self.needs(part)]
                found = _both(found, list(set(every)) if len(every) <= MOST_ALTERNATIVES else _NOTHING)
            elif op in _ONCE and value[0] > 0:
                found = _both(found, self.needs(value[2]))
        return closed()

    def _literal(self, items: Iterable) -> bool:
        return all(op is K.LITERAL and self.plain(c) for op, c in items)


def required(rule: R.Rule) -> Needs | None:
    """The alternatives of literals that a match of the rule holds; None if some match needs none."""
    parsed = parser.parse(rule.pattern, 0 if rule.case_sensitive else re.IGNORECASE)
    if rule.case_sensitive and parsed.state.flags & re.IGNORECASE or parsed.state.flags & re.VERBOSE:
        return None
    found = _Reader(not rule.case_sensitive).needs(parsed)
    if any(not x for x in found):
        return None
    # A set that holds another one's literals adds nothing.
    return sorted((x for x in found if not any(y < x for y in found)), key=sorted)


# --- in the tasks ------------------------------------------------------------------------


class Index:
    """Rules behind their literals, ready to be tried."""

    def __init__(self, rules: Sequence[tuple[str, bool]], needs: Sequence[Needs | None]):
        self.patterns = [re.compile(p, 0 if exact else re.IGNORECASE) for p, exact in rules]
        self.always = [i for i, n in enumerate(needs) if n is None]
        self.finders, self.entries = {}, {}
        for exact in (False, True):
            entries: dict[str, list[tuple[int, frozenset[str]]]] = {}
            finder = ahocorasick.Automaton()
            for i, own in enumerate(needs):
                if own is None or rules[i][1] != exact:
                    continue
                for literals in own:
                    for literal in literals:
                        finder.add_word(literal, literal)
                    # The longest literal leads to the rule, the others are looked up.
                    entries.setdefault(max(literals, key=lambda x: (len(x), x)), []).append((i, literals))
            if len(finder):
                finder.make_automaton()
                self.finders[exact], self.entries[exact] = finder, entries

    def candidates(self, text: str) -> list[int]:
        """Numbers of the rules to try, in order."""
        found = set(self.always)
        for exact, finder in self.finders.items():
            there = {literal for _, literal in finder.iter(text if exact else fold(text))}
            entries = self.entries[exact]
            for literal in there:
                found.update(i for i, literals in entries.get(literal, ()) if literals <= there)
        return sorted(found)

    def first(self, text: str) -> tuple[int | None, int]:
        """The first rule that matches, and how many were tried."""
        tried = 0
        for i in self.candidates(text):
            tried += 1
            if self.patterns[i].search(text):
                return i, tried
        return None, tried


def _index(held: Broadcast) -> Index:
    """The worker's index; it stays with the broadcast value between tasks."""
    if "index" not in held.value:
        held.value["index"] = Index(held.value["rules"], held.value["needs"])
    return held.value["index"]


def apply_indexed(
    df: DataFrame, rules: Iterable[R.Rule], columns: Sequence[str] | None = None, tried: str | None = None
) -> DataFrame:
    """Add the four verdict columns of the first matching rule, null without one.

    ``tried`` names a column for the number of rules tried.
    """
    spark = df.sparkSession
    usable = R.active(spark, rules)
    held = spark.sparkContext.broadcast({
        "rules": [(r.pattern, r.case_sensitive) for r in usable], "needs": [required(r) for r in usable],
        "verdicts": [(r.assign_code, r.assign_name, float(r.confidence), r.rule_id) for r in usable],
    })
    none = (None,) * len(R.VERDICT_FIELDS)

    @F.pandas_udf(R.VERDICT_TYPE[:-1] + ",tried:int>")
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        index, verdicts = _index(held), held.value["verdicts"]
        for texts in batches:
            found = [index.first(t or "") for t in texts]
            rows = [(*(none if i is None else verdicts[i]), n) for i, n in found]
            yield pd.DataFrame(rows, columns=[*R.VERDICT_FIELDS, "tried"])

    kept = [F.col(f"`{c}`") for c in df.columns if c not in R.VERDICT_FIELDS]
    counted: list[Column] = [] if tried is None else [F.col("_found.tried").alias(tried)]
    found = df.withColumn("_found", search(R.searched_text(df, columns)))
    # Expanded as in apply_rules, so that later filters do not search again.
    verdict = F.struct(*[F.col(f"_found.{f}").alias(f) for f in R.VERDICT_FIELDS])
    return found.select(*kept, *counted, F.inline(F.array(verdict)))
