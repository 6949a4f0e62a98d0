"""URL rules that run only where their rarest literal token occurs.

A rule is a regular expression over host and path, with the tokens (runs of letters and
digits, bounded on both sides) that every match must contain. How often the tokens of
rules occur in the URLs at hand is counted over the whole table; each rule is entered in
an index under its rarest one. A URL's tokens fetch its candidate rules, and only their
expressions run. Rules without a token are candidates for every URL.

Rules with a site (host and path prefix) come first, the longest fitting one decides;
then patterns in the order given; then ``default``. The rule list and its index are
parameters of the job, not of the data; there is no shuffle but that of the token counts.

A null URL or one without ``://`` has an empty host and path and fits no site. Null ids
and repeated rows are judged row by row; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"[A-Za-z0-9]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


class Rule(NamedTuple):
    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    #: Longest site first; 0 for patterns.
    weight: int = 0


def site(text: str, verdict: str) -> Rule:
    """A rule for a host, its subdomains and paths with a prefix, written like ``a.net/en/``."""
    host, slash, rest = text.partition("/")
    path = slash + rest
    # The last token of a prefix may go on in a URL unless a sign closes it.
    whole = _TOKEN.findall(path if not path or not path[-1].isalnum() else re.sub(r"[A-Za-z0-9]+$", "", path))
    pattern = rf"(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}"
    return Rule(text, verdict, pattern, (*_TOKEN.findall(host), *whole), len(text))


def word(token: str, verdict: str = "block") -> Rule:
    """A rule for a token anywhere in host or path."""
    return Rule(token, verdict, rf".*(?<![A-Za-z0-9]){re.escape(token)}(?![A-Za-z0-9])", (token,))


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL."""
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = re.match(r"[^?#]*", url[at + 3 :]).group()
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


def token_counts(pages: DataFrame, wanted: Iterable[str], url_col: str = "url") -> dict[str, int]:
    """In how many URLs each of the wanted tokens occurs; one row per wanted token at most."""
    wanted = frozenset(wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = dict.fromkeys(wanted, 0)
        for batch in batches:
            for url in batch.column("u").to_pylist():
                for token in wanted.intersection(_TOKEN.findall("".join(parts(url)))):
                    found[token] += 1
        yield pa.RecordBatch.from_pydict({"token": pa.array(list(found), pa.string()), "n": pa.array(found.values(), pa.int64())})

    rows = pages.select(F.col(url_col).cast("string").alias("u")).mapInArrow(count, "token string, n long")
    return {r["token"]: r["n"] for r in rows.groupBy("token").agg(F.sum("n").alias("n")).collect()}


def index(rules: Iterable[Rule], counts: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """Rarest token -> numbers of its rules; and the rules that have no token."""
    by_token: dict[str, list[int]] = {}
    always = []
    for i, rule in enumerate(rules):
        if rule.tokens:
            rarest = min(rule.tokens, key=lambda t: (counts.get(t, 0), t))
            by_token.setdefault(rarest, []).append(i)
        else:
            always.append(i)
    return by_token, always


def judge(
    pages: DataFrame, rules: Iterable[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """id, host, path, rule (the site that decides), verdict, pattern (the pattern that
    decides), n_run (expressions run) of every row."""
    rules = list(rules)
    by_token, always = index(rules, token_counts(pages, {t for r in rules for t in r.tokens}, url_col))
    source = pages.select(F.col(id_col).alias("k"), F.col(url_col).cast("string").alias("u"))
    kind = source.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits = [re.compile(r.pattern, re.DOTALL).match for r in rules]
        for batch in batches:
            out: list[tuple] = []
            for url in batch.column("u").to_pylist():
                host, path = parts(url)
                subject = host + path
                tried = set(always).union(*(by_token.get(t, ()) for t in set(_TOKEN.findall(subject))))
                hits = [i for i in tried if fits[i](subject)]
                best = min(hits, key=lambda i: (-rules[i].weight, i), default=None)
                site_, pattern = (None, None) if best is None else (
                    (rules[best].name, None) if rules[best].weight else (None, rules[best].name)
                )
                out.append((host, path, site_, default if best is None else rules[best].verdict, pattern, len(tried)))
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column("k"), *(pa.array(c, pa.string()) for c in columns[:5]), pa.array(columns[5], pa.int64())],
                names=["k", "host", "path", "rule", "verdict", "pattern", "n_run"],
            )

    shape = f"k {kind}, host string, path string, rule string, verdict string, pattern string, n_run long"
    return source.mapInArrow(run, shape).withColumnRenamed("k", id_col)
