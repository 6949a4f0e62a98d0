import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from casemill.llm import mixture
from casemill.session import scratch_path

@pytest.fixture(scope="module")
def tokenizer():
    return public_tokenizers.path("byte_bpe_50k.json")



def rows():
    rng = random.Random(4)
    say = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    passage = say(40)
    out = [(i, say(rng.randint(60, 150)), "en", f"s{i % 3}") for i in range(90)]
    out += [(200 + i, out[0][1], "en", "s1") for i in range(6)]
    out += [(300 + i, f"{say(30)} {passage} {say(30)}", "de", "s2") for i in range(5)]
    out += [(400, "short", "en", "s0"), (401, None, None, None), (402, "", "en", "s0"), (403, "a b c " * 60, "en", "s0")]
    out += [(1, out[1][1], "en", "s1"), (None, say(80), "en", None)]
    return out, passage


@pytest.fixture(scope="module")
def folder(spark):
    docs, passage = rows()
    path = scratch_path(spark, "tables")
    frame = spark.createDataFrame([(*r, len(r[1] or ""), "more") for r in docs], "doc_id long, text string, lang string, source string, n_chars long, hash string")
    for name in ("_doc", "doc", "_mix", "_digest", "digest", "_q_key", "KEY", "_times", "times", "_salt", "Salt", "size"):
        frame = frame.withColumn(name, F.concat(F.lit(f"{name} "), F.coalesce("text", F.lit("-"))))
    frame.repartition(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_and_result(spark, folder, tokenizer):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, left = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns, name
        path = scratch_path(spark, name)
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        for extra in columns[6:]:
            assert not docs.filter(F.col(extra) != F.concat(F.lit(f"{extra} "), F.coalesce("text", F.lit("-")))).count(), (name, extra)
        left.append(sorted((r["doc_id"] for r in docs.collect()), key=str))
    every, _ = rows()
    good = [r for r in every if r[1] and len(r[1].split()) >= 50 and r[0] != 403]
    assert left[0] == sorted((r[0] for r in good), key=str)
    single = {(r[0], r[1]): r for r in good if r[0] is None or not 200 <= r[0] < 300}
    assert left[1] == sorted((r[0] for r in single.values()), key=str)
    assert left[2] == [k for k in left[1] if k is None or not 300 <= k < 400]
    t = Tokenizer.from_file(tokenizer)
    wanted = Counter()
    for r in docs.collect():
        ids = [*t.encode(r["text"], add_special_tokens=False).ids, 2]
        wanted[r["doc_id"], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    found = corpus_pipeline.run(spark, folder)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found.collect()) == wanted


def test_empty_tables(spark, folder):
    path = scratch_path(spark, "tables")
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{path}/{name}.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0


def test_mixture_follows_targets_in_the_pipeline(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert mixture.mix(docs).columns == docs.columns
