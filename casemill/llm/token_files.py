"""Documents as token ids in binary blocks, each document compressed for itself.

``write`` makes a folder with

- ``dictionary``: one row, the zstandard dictionary, its SHA-256 and the type of the ids
  (``<u2``, or ``<u4`` for vocabularies beyond 65,536),
- ``blocks``: rows of about ``BLOCK_BYTES`` bytes, in ascending order of document id:
  part and block number, smallest and largest key, keys, ids per document, offsets
  (where each document's frame begins in the payload, and the payload's end), payload
  (the frames one after the other) and the dictionary's SHA-256,
- ``parts``: the number of ids before each part.

A document is one zstandard frame over its little-endian id array, made with the shared
dictionary, so a short document is read by finding its block through the keys, cutting
its frame out by the offset index and decompressing that alone. Spark's writer commits
the files, so lost tasks leave nothing behind.

The dictionary is trained on ``SAMPLE`` documents with the smallest hashes, at most
``SAMPLE_BYTES`` bytes of each; it decides sizes only, never what is read back. Texts
are range-partitioned by id and encoded after that, so one hot id is the only thing that
a part cannot divide, and then only if its texts are equal, too.

Null texts are empty documents (the end id alone); rows with a null id come first; rows
that share an id are kept each, ordered by the hash of their text. Extra columns are not
read. An empty table gives empty files and no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casemill.llm import subwords
from casemill.session import plan_bytes

BLOCK_BYTES = 1_000_000
PART_BYTES, MOST_PARTS = 64 << 20, 1 << 22
DICTIONARY_BYTES = 64 * 1024
SAMPLE = 1_000
SAMPLE_BYTES = 8_192
LEVEL = 3

_BLOCKS = (
    "part int, block int, low long, high long, keys array<long>, n_ids array<int>, "
    "offsets array<int>, payload binary, dictionary string"
)


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).cast("long").alias("k"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")
    )


def train_dictionary(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> bytes:
    """A dictionary for the id arrays of ``docs``; empty when there is too little to learn from."""
    held = subwords.ship(docs.sparkSession, tokenizer)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = subwords.encoder(held)
        for batch in batches:
            found = [e.encode(t.as_py())[:SAMPLE_BYTES] for t in batch.column("t")]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["ids"])

    few = _source(docs, id_col, text_col).orderBy(F.xxhash64("k", F.lit(42)), "k", F.xxhash64("t")).limit(SAMPLE)
    samples = [r["ids"] for r in few.select("t").mapInArrow(encode, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def write(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = 2, id_col: str = "doc_id",
    text_col: str = "text", block_bytes: int = BLOCK_BYTES,
) -> None:
    spark = docs.sparkSession
    learned = train_dictionary(docs, tokenizer, id_col, text_col)
    digest = hashlib.sha256(learned).hexdigest()
    held = subwords.ship(spark, tokenizer)
    ids = "<u2" if subwords.encoder(held).dtype.itemsize == 2 else "<u4"
    spark.createDataFrame(
        [(digest, learned, ids)], "dictionary string, content binary, ids string"
    ).write.parquet(f"{folder}/dictionary")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        e = subwords.encoder(held)
        tail = b"" if end_id is None else np.array([end_id], e.dtype).tobytes()
        shared = zstandard.ZstdCompressionDict(learned) if learned else None
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared)
        part, block, size = TaskContext.get().partitionId(), 0, 0
        keys, counts, frames = [], [], []

        def made() -> pa.RecordBatch:
            ends = np.concatenate(([0], np.cumsum([len(f) for f in frames])))
            there = [k for k in keys if k is not None]
            return pa.RecordBatch.from_pylist(
                [{
                    "part": part, "block": block, "low": min(there, default=None), "high": max(there, default=None),
                    "keys": keys, "n_ids": counts, "offsets": ends.tolist(), "payload": b"".join(frames),
                    "dictionary": digest,
                }],
                schema=_BLOCK_SCHEMA,
            )

        for batch in batches:
            for k, t in zip(batch.column("k").to_pylist(), batch.column("t"), strict=True):
                ids = e.encode(t.as_py()) + tail
                frame = press.compress(ids)
                if frames and size + len(frame) > block_bytes:
                    yield made()
                    keys, counts, frames, size, block = [], [], [], 0, block + 1
                keys.append(k)
                counts.append(len(ids) // e.dtype.itemsize)
                frames.append(frame)
                size += len(frame)
        if frames:
            yield made()

    # A part is about PART_BYTES of the input as it is stored, where Spark knows that.
    known = plan_bytes(docs)
    known = known if known < MOST_PARTS * PART_BYTES else 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), known // PART_BYTES)
    ordered = (
        _source(docs, id_col, text_col)
        .withColumn("h", F.xxhash64("t"))
        .repartitionByRange(parts, "k", "h")
        .sortWithinPartitions("k", "h")
        .select("k", "t")
    )
    blocks = ordered.mapInArrow(pack, _BLOCKS)
    blocks.write.option("compression", "none").parquet(f"{folder}/blocks")
    counts = F.aggregate("n_ids", F.lit(0).cast("long"), lambda s, x: s + x)
    sums = spark.read.schema(_BLOCKS).parquet(f"{folder}/blocks").groupBy("part").agg(F.sum(counts).alias("n"))
    # One row per part of the folder, so this window is as short as the list of its files.
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sums.select("part", F.coalesce(before, F.lit(0)).alias("before")).write.parquet(f"{folder}/parts")


_BLOCK_SCHEMA = pa.schema([
    ("part", pa.int32()), ("block", pa.int32()), ("low", pa.int64()), ("high", pa.int64()),
    ("keys", pa.list_(pa.int64())), ("n_ids", pa.list_(pa.int32())), ("offsets", pa.list_(pa.int32())),
    ("payload", pa.binary()), ("dictionary", pa.string()),
])


def _dictionary(spark: SparkSession, folder: str) -> tuple[str, bytes, str]:
    row = spark.read.parquet(f"{folder}/dictionary").first()
    content = bytes(row["content"])
    if hashlib.sha256(content).hexdigest() != row["dictionary"]:
        raise ValueError(f"the dictionary of {folder} is not the one its blocks name")
    return row["dictionary"], content, row["ids"]


def _placed(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks with the number of ids before each of them."""
    blocks = spark.read.schema(_BLOCKS).parquet(f"{folder}/blocks")
    sums = blocks.select(
        "part", "block", F.aggregate("n_ids", F.lit(0).cast("long"), lambda s, x: s + x).alias("n")
    )
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = (
        sums.withColumn("inside", F.coalesce(inside, F.lit(0)))
        .join(spark.read.parquet(f"{folder}/parts"), "part")
        .select("part", "block", (F.col("before") + F.col("inside")).alias("start"))
    )
    return blocks.join(starts, ["part", "block"])


def read(spark: SparkSession, folder: str, keys: DataFrame | None = None) -> DataFrame:
    """The documents as written: key, start, n_tokens, ids (array of int).

    With ``keys`` (one column, key) only the blocks that may hold them are opened and
    only their frames are decompressed; give a short list.
    """
    return _decoded(spark, folder, keys, "ids array<int>", pa.list_(pa.int32()), lambda ids: ids.tolist())


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    """The documents as written: key, start, n_tokens, ids_crc32 (over 32-bit ids)."""
    return _decoded(
        spark, folder, None, "ids_crc32 long", pa.int64(), lambda ids: zlib.crc32(ids.astype("<u4").tobytes())
    )


def _decoded(spark, folder, keys, column, kind, value) -> DataFrame:
    digest, content, ids_type = _dictionary(spark, folder)
    wanted = None if keys is None else {r[0] for r in keys.collect()}
    blocks = _placed(spark, folder)
    if wanted is not None:
        inside = F.exists(
            F.array(*[F.lit(k).cast("long") for k in sorted(wanted)]),
            lambda k: (k >= F.col("low")) & (k <= F.col("high")),
        )
        blocks = blocks.filter(inside)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = zstandard.ZstdCompressionDict(content) if content else None
        expand = zstandard.ZstdDecompressor(dict_data=shared)
        for batch in batches:
            for row in batch.to_pylist():
                if row["dictionary"] != digest:
                    raise ValueError("a block was made with another dictionary")
                begin = np.concatenate(([0], np.cumsum(row["n_ids"], dtype=np.int64)))[:-1] + row["start"]
                offsets, payload, out = row["offsets"], memoryview(row["payload"]), []
                for i, k in enumerate(row["keys"]):
                    if wanted is None or k in wanted:
                        ids = np.frombuffer(expand.decompress(payload[offsets[i] : offsets[i + 1]]), ids_type)
                        out.append((k, int(begin[i]), len(ids), value(ids)))
                if out:
                    cols = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], kind)],
                        names=["key", "start", "n_tokens", column.split()[0]],
                    )

    return blocks.select("keys", "n_ids", "offsets", "payload", "dictionary", "start").mapInArrow(
        unpack, f"key long, start long, n_tokens long, {column}"
    )
