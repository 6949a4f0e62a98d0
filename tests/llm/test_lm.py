import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from casemill.llm import attention as A
from casemill.llm import lm, subwords
from casemill.llm import texts as X

WORD = re.compile(r"[^\x20\x09-\x0D]+")

@pytest.fixture(scope="module")
def tokenizer():
    return public_tokenizers.path("byte_bpe_50k.json")



def test_unigram_equals_brute_force(spark, tokenizer):
    texts = [f"The w{i % 7} and\tthe É{i % 3} w{i}" for i in range(60)] + ["", None, "a  b ", "x" * 3000, "the the THE"]
    rows = [*enumerate(texts), (3, texts[3]), (None, "the end")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_tokens int").repartition(3)
    found = lm.scores(docs, tokenizer, ~lm.held_out("doc_id")).collect()
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 7 == 2
    tokens = lambda t: [*WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or "")), None]
    c = Counter(w for k, t in rows if not held(k) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    wanted = Counter(
        (k, held(k), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n,
         round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 6))
        for k, t in rows
    )
    assert Counter(
        (r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found
    ) == wanted
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in found)


def test_empty_table(spark, tokenizer):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lm.scores(docs, tokenizer, ~lm.held_out("doc_id")).count() == 0


@pytest.fixture(scope="module")
def small():
    rng = np.random.default_rng(0)
    # Every text follows one cycle, so the next id follows from the last.
    texts = [np.arange(s, s + rng.integers(1, 70)) % 40 for s in rng.integers(0, 40, 200)]
    counts = np.bincount(np.concatenate(texts), minlength=41)
    counts[40] = len(texts)
    return texts, A.vocabulary(counts)


def test_probabilities_sum_to_one(small):
    texts, vocab = small
    tables = A.joined(A.start(np.random.default_rng(1).integers(0, 9, A.BUCKETS * A.CLASSES)), vocab.kinds)
    begin = [5, 6, 7]
    logits = A._forward(*tables, vocab.bucket[np.array([[vocab.end, *begin] + [vocab.end] * (A.WIDTH - 4)])])[3][0, 3]
    p_class = np.exp(logits - logits.max())
    p_class /= p_class.sum()
    assert sum(p_class[vocab.kind[i]] * 10 ** vocab.share[i] for i in range(41)) == pytest.approx(1, rel=1e-5)


def test_windows_score_every_token_once(small):
    texts, vocab = small
    tables = A.joined(A.start(), vocab.kinds)
    found = A.score(texts, tables, vocab)
    for text, s in zip(texts[:40], found, strict=False):
        row = np.concatenate(([vocab.end], text, [vocab.end]))
        total, done = 0.0, 0
        while done < len(row) - 1:
            begin = max(0, done - A.OVERLAP) if done else 0
            ids = np.full(A.WIDTH, vocab.end)
            ids[: len(row) - 1 - begin][: A.WIDTH] = row[begin : begin + A.WIDTH][: len(row) - 1 - begin]
            logits = A._forward(*tables, vocab.bucket[ids[None]])[3][0].astype(float)
            for i in range(done - begin, min(A.WIDTH, len(row) - 1 - begin)):
                goal = row[begin + i + 1]
                total += (logits[i, vocab.kind[goal]] - np.log(np.exp(logits[i]).sum())) / np.log(10) + vocab.share[goal]
                done += 1
        assert s == pytest.approx(total, rel=1e-4)


def test_attention_is_causal(small):
    _, vocab = small
    tables = A.joined(A.start())
    ids = np.arange(A.WIDTH) % 40
    other = ids.copy()
    other[8:] = 3
    a, b = (A._forward(*tables, vocab.bucket[x[None]])[3][0] for x in (ids, other))
    assert np.allclose(a[:8], b[:8], atol=1e-6) and not np.allclose(a[8:], b[8:])


def test_training_lowers_the_loss(small):
    texts, vocab = small
    windows = [np.concatenate([lm._windows(t.astype(np.int32), 40, 2, i) for i, t in enumerate(texts)])] * 60
    before = A.score(texts, A.joined(A.start(), vocab.kinds), vocab).sum()
    after = A.score(texts, A.joined(A.unflat(A.flat(A.train(A.start(), iter(windows), vocab))), vocab.kinds), vocab).sum()
    assert after > 0.6 * before


def test_classes_of_a_large_vocabulary():
    vocab = A.vocabulary(np.ones(5000, np.int64))
    assert vocab.kinds == A.CLASSES == 128


def test_every_id_is_a_target_once_a_round():
    for n in (0, 1, 15, 16, 17, 500):
        ids = np.arange(n, dtype=np.int32)
        for which in (0, 1):
            found = lm._windows(ids, 9999, which, n)
            targets = found[:, 1:][found[:, 1:] >= 0]
            assert sorted(targets.tolist()) == [*range(n), 9999]
            assert all(b == a + 1 for row in found for a, b in zip(row, row[1:], strict=False) if 0 <= a < 9999 and 0 <= b < 9999)
    assert not np.array_equal(lm._windows(ids, 9999, 0, 500), lm._windows(ids, 9999, 1, 500))


def test_first_step_goes_down_the_slope(small):
    texts, vocab = small
    ids = np.concatenate([lm._windows(t.astype(np.int32), 40, 0, i) for i, t in enumerate(texts)])
    begin = A.start(np.random.default_rng(2).integers(0, 9, A.BUCKETS * A.CLASSES))
    moved = A.train(begin, iter([ids]), vocab, 0.01)
    safe, there = np.where(ids >= 0, ids, 40), ids[:, 1:] >= 0

    def loss(params):
        logits = A._forward(*A.joined(params, vocab.kinds), vocab.bucket[safe[:, :-1]])[3].astype(float)
        gain = np.take_along_axis(logits, vocab.kind[safe[:, 1:]][..., None], -1)[..., 0] - np.log(np.exp(logits).sum(-1))
        return -gain[there].mean()

    for name in begin:
        steps = (moved[name] - begin[name]).astype(float)
        rng = np.random.default_rng(3)
        some = rng.permutation(np.flatnonzero(np.abs(steps) > 1e-3))[:6]
        assert len(some)
        for at in some:
            sides = []
            for side in (0.05, -0.05):
                other = {k: v.copy() for k, v in begin.items()}
                other[name].flat[at] += side
                sides.append(loss(other))
            slope = sides[0] - sides[1]
            assert slope * steps.flat[at] < 1e-7, name


def test_a_batch_moves_only_the_rows_it_holds(small):
    _, vocab = small
    one, two = (np.tile(np.arange(17, dtype=np.int32) % 3 + k, (4, 1)) for k in (0, 20))
    before = A.train(A.start(), iter([one]), vocab)
    after = A.train(A.start(), iter([one, two]), vocab)
    held = vocab.bucket[np.unique(one)]
    for name in "qkv":
        assert np.array_equal(before[name][held], after[name][held])
        assert not np.array_equal(before[name], after[name])


def test_rows_of_a_key_are_summed():
    rng = np.random.default_rng(0)
    for columns in (16, 56):
        for key in (np.zeros(5, int), np.arange(7), np.sort(rng.integers(0, 40, 900))):
            values = rng.integers(-9, 9, (len(key), columns)).astype(np.float32)
            found, sums = A._summed(key, values)
            assert found.tolist() == sorted(set(key.tolist())) and sums.dtype == np.float32
            assert np.array_equal(sums, [values[key == k].sum(0) for k in found])


def test_rows_share_the_ids_of_their_words(tokenizer):
    with open(tokenizer, encoding="utf-8") as f:
        e, plain = (subwords.Encoder(x) for x in [f.read()] * 2)
    rows = [
        ["the", "the", "where", "the"], [], ["the"], ["a\u00a0", "the"], ["<|endoftext|>", "x"], ["don't", "\u2003x", "é'ñ&&"],
        ["x<|endoftext|>y"] * 3, [], ["a\u00a0b", "日本", "'s", "##"], ["where"],
    ]
    known = sorted({w for row in rows for w in row})
    asked = []
    e.word = lambda lead, word, f=e.word: asked.append((lead, word)) or f(lead, word)
    place = np.array([known.index(w) for row in rows for w in row])
    for encoder in (e, plain):
        encoder.by_word = encoder is e
        found = encoder.encode_rows(known, place, np.array([len(row) for row in rows]))
        assert [np.frombuffer(b, e.dtype).tolist() for b in found] == [
            plain.tokenizer.encode(" ".join(row), add_special_tokens=False).ids for row in rows
        ]
    assert len(asked) == len(set(asked))
    assert e.encode_rows([], np.zeros(0, np.int64), np.zeros(2, np.int64)) == [b"", b""]
    assert e.encode_rows([], np.zeros(0, np.int64), np.zeros(0, np.int64)) == []


def test_words_stand_where_they_are_said_to():
    import pyarrow as pa

    texts = pa.array(["x", " The  é\tend ", None, "", "日本 a"]).slice(1)
    w, data = X.words(texts), X.raw(texts)[0].tobytes()
    assert [data[a : a + n].decode() for a, n in zip(w.start, w.size, strict=True)] == ["The", "é", "end", "日本", "a"]


def test_weights_travel_as_four_bytes_and_answers_without_a_join(spark, tokenizer):
    weights = A.flat(A.start())
    assert sum(len(b) for b in lm._slices(weights, 3).column("numbers").to_pylist()) == 4 * len(weights)
    docs = spark.createDataFrame([(1, "a b"), (2, "b c")], "doc_id long, text string")
    texts, chunks, _, _ = lm.prepare(docs, ~lm.held_out("doc_id"), tokenizer)
    plan = lm.unigram(texts, chunks)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
