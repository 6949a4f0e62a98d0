import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from casemill.llm import subwords, token_files
from casemill.session import scratch_path

TEXTS = [
    "", " ", "a  b", "a b ", " a b", "x\n y", "it's we'll 'tis", "<|endoftext|> hi", "a <|endoftext|> b<|endoftext|>\n<|endoftext|><|endof", "x  <|endoftext|>\ty", "a\xa0 b", "a\u2003b c",
    "ñandú über 12ab 3.4% $5", "tab\t x", "日本 語 é́ x", "a\x1c b", "a \x85b", "º ª µ x²", "don't! !!a !a_b _x",
    "a.\nB c.\n\nD", "\na", "a\n", "x\n\ty z", "a\r\nb c", "1a2b c3\n4 ٣٤ 5½", "a\n'b c'd\n's", "word " * 2000, "z" * 9000,
]

@pytest.fixture(scope="module")
def tokenizer():
    return public_tokenizers.path("byte_bpe_50k.json")



@pytest.fixture(scope="module")
def plain(tokenizer):
    t = Tokenizer.from_file(tokenizer)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_word_by_word_equals_whole_texts(tokenizer, plain):
    with open(tokenizer, encoding="utf-8") as f:
        e = subwords.Encoder(f.read())
    for _ in range(2):
        for text in TEXTS:
            assert np.frombuffer(e.encode(text), e.dtype).tolist() == plain(text), text
    words = ["it's", "a\u2003b", "x"]
    assert e.encode_words(words) == e.encode(" ".join(words)) and e.encode_words([]) == b""


def test_round_trip(spark, tokenizer, plain):
    rows = [(i * 3 % 29, t) for i, t in enumerate(TEXTS)] + [(None, "none"), (7, "again"), (7, "again"), (40, None)]
    docs = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, text string, payload string, start long")
    folder = scratch_path(spark, "tokens")
    token_files.write(docs, folder, tokenizer, block_bytes=400)
    found = token_files.read(spark, folder).collect()
    wanted = Counter((k, tuple([*plain(t), 2])) for k, t in rows)
    assert Counter((r["key"], tuple(r["ids"])) for r in found) == wanted
    ordered = sorted(found, key=lambda r: r["start"])
    assert [r["key"] for r in ordered] == sorted((r[0] for r in rows), key=lambda k: (k is not None, k))
    at = 0
    for r in ordered:
        assert (r["start"], r["n_tokens"]) == (at, len(r["ids"]))
        at += r["n_tokens"]
    sums = Counter((r["key"], r["ids_crc32"]) for r in token_files.checksums(spark, folder).collect())
    assert sums == Counter((k, zlib.crc32(np.array(ids, "<u4").tobytes())) for k, ids in wanted.elements())
    some = token_files.read(spark, folder, keys=spark.createDataFrame([(7,), (999,)], "key long")).collect()
    assert Counter(tuple(r["ids"]) for r in some) == Counter(i for (k, i), n in wanted.items() for _ in range(n) if k == 7)


def test_documents_are_frames_of_a_shared_dictionary(spark, tokenizer):
    docs = spark.createDataFrame([(i, f"the same few words again and again number {i % 50}") for i in range(600)], "doc_id long, text string")
    folder = scratch_path(spark, "tokens")
    token_files.write(docs, folder, tokenizer)
    row = spark.read.parquet(f"{folder}/blocks").first()
    held = spark.read.parquet(f"{folder}/dictionary").first()
    assert row["dictionary"] == held["dictionary"] and len(held["content"]) > 0
    assert len(row["offsets"]) == len(row["keys"]) + 1 and row["offsets"][-1] == len(row["payload"])
    spark.createDataFrame([("0" * 64, b"other", "<u2")], "dictionary string, content binary, ids string").write.mode("overwrite").parquet(f"{folder}/dictionary")
    with pytest.raises(ValueError):
        token_files.read(spark, folder)


def test_ids_of_a_wide_vocabulary_keep_their_width(spark, tokenizer, tmp_path):
    """A vocabulary beyond 65,536 is written and read with four bytes an id."""
    wide = Tokenizer.from_file(tokenizer)
    wide.add_tokens([f"<<{i}>>" for i in range(20_000)])
    path = str(tmp_path / "wide.json")
    wide.save(path)
    rows = [(1, "a <<19999>> b"), (2, "plain words"), (3, None)]
    folder = scratch_path(spark, "tokens")
    token_files.write(spark.createDataFrame(rows, "doc_id long, text string"), folder, path)
    found = {r["key"]: list(r["ids"]) for r in token_files.read(spark, folder).collect()}
    assert found == {k: [*wide.encode(t or "", add_special_tokens=False).ids, 2] for k, t in rows}
    assert max(found[1]) > 65_536


def test_empty_table(spark, tokenizer):
    folder = scratch_path(spark, "tokens")
    token_files.write(spark.createDataFrame([], "doc_id long, text string"), folder, tokenizer)
    assert token_files.read(spark, folder).count() == 0 and token_files.checksums(spark, folder).count() == 0
