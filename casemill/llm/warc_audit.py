"""Merkle fixity audit of archive replicas.

An archive is a table of records: file, offset, length, digest (SHA-256 of the record's
bytes) and copies. Its tree has, from below,

- the records,
- ranges of 2**16 bytes of offsets of one file, then of 2**20, 2**24 and 2**28 bytes,
- files,
- groups of files by leading digits of their name's MD5, sixteen to a group, to one root.

A node's digest is the SHA-256 of its children's names and digests in order. Records keep
the offsets of the manifest, so a lost record leaves the other nodes where they are.
Replicas are compared at the root; on every level below only children of nodes that
differ are looked at, so an audit of sound replicas reads one row of each.

All of it is built-in functions. A node has a bounded number of children: 16, or the
records that begin within 2**16 bytes. Equal rows of a table are one record with a
number of copies, so a hot row is one leaf.

Null bodies are empty; records with a null id go to files of their own, dealt by
content. An empty archive has no root; against another one every record is missing or
extra. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casemill.session import stored

RANGE_BITS = (16, 20, 24, 28)
#: Ids that share a file name before its 256-way split by content.
FILE_IDS = 65_536


def record(id_col: str, url_col: str, body_col: str) -> Column:
    """The WARC record of a page, as text."""
    body = F.coalesce(F.col(body_col), F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(F.col(id_col).cast("string"), F.lit("none")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(F.col(url_col), F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def manifest(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Records of ``pages`` in files: file, offset, length, id, digest, copies.

    A file holds the ids of one range whose content hash begins with the same two
    digits, ordered by id and digest; only digests are sorted, never bodies.
    """
    whole = record(id_col, url_col, body_col)
    key = F.md5(whole)
    name = F.coalesce(
        F.concat(F.floor(F.col(id_col) / FILE_IDS).cast("string"), F.lit("-"), F.substring(key, 1, 2)),
        F.concat(F.lit("none-"), F.substring(key, 1, 4)),
    )
    rows = pages.select(
        name.alias("file"), F.col(id_col).alias("id"), F.sha2(whole, 256).alias("digest"),
        F.octet_length(whole).cast("long").alias("length"),
    )
    leaves = rows.groupBy("file", "id", "digest", "length").agg(F.count("*").alias("copies"))
    order = Window.partitionBy("file").orderBy("id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("length") * F.col("copies")).over(order), F.lit(0))
    return leaves.select("file", before.alias("offset"), "length", "id", "digest", "copies")


def _digest(node: Column, digest: Column) -> Column:
    children = F.array_sort(F.collect_list(F.struct(node.alias("node"), digest.alias("digest"))))
    return F.sha2(F.array_join(F.transform(children, lambda c: F.concat(c["node"], F.lit(":"), c["digest"])), "\n"), 256)


def _file_digits(archives: list[DataFrame]) -> int:
    """Digits of the lowest groups, so that about sixteen files share one."""
    n = max([a.select("file").distinct().count() for a in archives] or [0])
    digits = 0
    while 16 ** (digits + 1) < n:
        digits += 1
    return digits


def tree(archives: list[DataFrame], digits: int) -> list[DataFrame]:
    """Node tables from the root down to the records: side (number of the archive), node, parent, digest."""
    cut = lambda bits: F.concat("file", F.lit(f"/{bits}/"), F.lpad(F.shiftright("offset", bits).cast("string"), 16, "0"))
    leaf = F.sha2(F.concat_ws(" ", "digest", "length", "copies"), 256)
    sides = [
        a.select(
            F.lit(i).alias("side"), _record_node().alias("node"), cut(RANGE_BITS[0]).alias("parent"),
            leaf.alias("digest"), "file", F.shiftright("offset", RANGE_BITS[0]).alias("at"),
        )
        for i, a in enumerate(archives)
    ]
    here = sides[0]
    for side in sides[1:]:
        here = here.unionByName(side)
    node = _digest(F.col("node"), F.col("digest")).alias("digest")
    levels = [stored(here, "nodes")]
    for low, high in zip(RANGE_BITS, (*RANGE_BITS[1:], None), strict=True):
        now = levels[-1].groupBy("side", F.col("parent").alias("node"), "file", "at").agg(node)
        if high is None:
            up, at = F.concat(F.lit("file/"), "file"), F.lit(0).cast("long")
        else:
            at = F.shiftright("at", high - low)
            up = F.concat("file", F.lit(f"/{high}/"), F.lpad(at.cast("string"), 16, "0"))
        levels.append(stored(now.withColumn("parent", up).withColumn("at", at), "nodes"))
    group = F.concat(F.lit("group/"), F.substring(F.md5("file"), 1, digits))
    files = levels[-1].groupBy("side", F.col("parent").alias("node"), "file").agg(node)
    levels.append(stored(files.select("side", "node", group.alias("parent"), "digest"), "nodes"))
    for d in range(digits, -1, -1):
        up = F.expr("substring(node, 1, length(node) - 1)") if d else F.lit("")
        now = levels[-1].groupBy("side", F.col("parent").alias("node")).agg(node)
        levels.append(stored(now.withColumn("parent", up), "nodes"))
    return levels[::-1]


def _record_node() -> Column:
    return F.concat("file", F.lit("/0/"), F.lpad(F.col("offset").cast("string"), 16, "0"))


def differing(levels: list[DataFrame]) -> DataFrame:
    """node and state (changed, missing, extra) of the records in which side 1 differs from side 0."""
    suspects = None
    for nodes in levels:
        if suspects is not None:
            nodes = nodes.join(suspects, nodes["parent"] == suspects["bad"], "left_semi")
        side = lambda i: F.max(F.when(F.col("side") == i, F.col("digest"))).alias(f"d{i}")
        both = nodes.groupBy("node").agg(side(0), side(1))
        state = F.when(F.col("d1").isNull(), "missing").when(F.col("d0").isNull(), "extra").otherwise("changed")
        bad = stored(both.filter(~F.col("d0").eqNullSafe(F.col("d1"))).select("node", state.alias("state")), "bad")
        suspects = bad.select(F.col("node").alias("bad"))
    return bad


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """file, offset, length, id and state of every record in which the replica differs.

    Both are tables like ``manifest``'s; length and id come from the side that has the
    record, the primary first.
    """
    bad = differing(tree([primary, replica], _file_digits([primary, replica])))
    here, there = (a.select(_record_node().alias("node"), "file", "offset", "length", "id") for a in (primary, replica))
    known = bad.filter("state != 'extra'").join(here, "node").unionByName(bad.filter("state = 'extra'").join(there, "node"))
    return known.select("file", "offset", "length", "id", "state")
