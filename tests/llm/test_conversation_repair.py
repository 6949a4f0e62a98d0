import hashlib
import random
from functools import cache
from itertools import product

import numpy as np
from pyspark.sql import functions as F

from casemill.llm import conversation_repair as C

SCHEMA = "conv_id long, turn long, role string, text string, here boolean, part string, place string, known int"
WHITE = " \t\n\x0b\x0c\r"


def frame(spark, rows):
    return spark.createDataFrame([(*r, *([True] if len(r) == 4 else []), "p", "q", 1) for r in rows], SCHEMA)


def faults(rows):
    seen, found = set(), []
    for _, role, text in rows:
        last = text.rstrip(WHITE)
        found.append("blank" if not last else "dup" if (role, text) in seen else "" if last[-1] in ".!?" else "cut")
        seen.add((role, text))
    return found


def cheapest(rows):
    """Cost, audit and turns, by the least of all sequences of edits."""
    fault = faults(rows)

    @cache
    def best(i, state, inserted):
        found = [(0, "", ())] if i == len(rows) and state in "za" else []
        after = {"z": "u", "s": "u", "a": "u", "u": "a"}[state]
        name = {"u": "user", "a": "assistant"}[after]
        if inserted < 3:
            c, a, t = best(i, after, inserted + 1)
            found.append((c + 3, "I" + a, ((name, ""), *t)))
        if i < len(rows):
            _, role, text = rows[i]
            c, a, t = best(i + 1, state, 0)
            found.append((c + 4, "D" + a, t))
            if fault[i] in ("", "cut"):
                more = 3 * (fault[i] == "cut")
                if role[:1] and (role[:1] == after or (role[:1], state) == ("s", "z")):
                    c, a, t = best(i + 1, role[:1], 0)
                    found.append((c + more, "K" + a, ((role, text), *t)))
                c, a, t = best(i + 1, after, 0)
                found.append((c + more + 3, "R" + a, ((name, text), *t)))
        return min(found, default=(10**9, "", ()))

    return best(0, "z", 0)


def plain(rows):
    out, turns_of = {}, {}
    for conv, turn, role, text, *here in rows:
        turns_of.setdefault(conv, [])
        if not here or here[0]:
            turns_of[conv].append((turn, " " if role is None else role, " " if text is None else text))
    for conv, own in turns_of.items():
        own = sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        fault, first = faults(own), [r[1][:1] for r in own]
        turns = [r[0] for r in own if r[0] is not None]
        cost, audit, lines = cheapest(tuple(own))
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, fault.count("blank"), fault.count("dup"),
            fault.count("cut"), sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:])), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest(), lines,
        )
    return out


def made(seed, convs=60, longest=12):
    rng, rows = random.Random(seed), []
    texts = ["Yes.", "No!", "why", "Why?", "", " \n", "Done.\t ", "é.", "ok", "A longer text, cut", None]
    for conv in range(convs):
        for i in range(rng.randrange(longest + 1)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "User", "", "agent", None])
            turn = rng.choice([i, i, i, i + 3, None])
            rows.append((conv, turn, role, rng.choice(texts), rng.random() > 0.1))
    return rows


def found(spark, rows, **more):
    df = C.repair(frame(spark, rows), present=F.col("here"), **more)
    assert df.columns == [
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256",
    ]
    got = [tuple(r) for r in df.collect()]
    assert len({r[0] for r in got}) == len(got)
    return {r[0]: r[1:] for r in got}


def test_equals_the_least_of_all_edits(spark):
    rows = made(1)
    assert found(spark, rows) == {k: v[:-1] for k, v in plain(rows).items()}


def test_long_conversations_are_cut_into_parts(spark):
    rows = made(2, convs=12, longest=40) + [(None, i % 7, ["user", "assistant"][i % 3 // 2], f"{i % 9}.") for i in range(70)]
    expected = plain(rows)
    for size in ({"long_rows": 2, "part_rows": 3}, {"long_rows": 0, "part_rows": 1}, {"long_bytes": 40, "part_rows": 64}):
        assert found(spark, rows, **size) == {k: v[:-1] for k, v in expected.items()}
        turns = C.repaired(frame(spark, rows), present=F.col("here"), **size).collect()
        for conv, row in expected.items():
            own = sorted((r for r in turns if r["conv_id"] == conv), key=lambda r: r["place"])
            assert [(r["role"], r["text"]) for r in own] == list(row[-1])


def test_a_conversation_of_many_turns_in_one_task(spark):
    rng = random.Random(3)
    rows = [(7, i, rng.choice(["user", "assistant"]), f"{rng.randrange(900)}" + rng.choice([".", ""])) for i in range(1500)]
    expected = found(spark, rows, long_rows=100, part_rows=170)
    assert found(spark, rows) == expected and len(expected[7][6]) >= 1500


def test_every_short_string_of_edits():
    """Costs and audits against all strings of up to seven edits, tried one by one."""
    cases = [c for n in range(4) for c in product(["s.", "u.", "a.", "u", "x."], repeat=n)]
    for case in cases:
        rows = [(i, {"s": "system", "u": "user", "a": "assistant", "x": "x"}[c[0]], f"{i}{c[1:]}") for i, c in enumerate(case)]
        best = None
        for length in range(len(rows), len(rows) + 4):
            for edits in product("DIKR", repeat=length):
                cost = _applied(rows, edits)
                if cost is not None and (best is None or (cost, "".join(edits)) < best):
                    best = (cost, "".join(edits))
        talk = C._Talk((0,))
        for turn, role, text in rows:
            talk.add(turn, role, text, False, text[-1] != ".", None, None)
        cost, [(audit, _)] = C._solve([talk])
        assert (int(cost[0]), audit) == best, case


def _applied(rows, edits):
    """The cost of the edits, if they give legal roles; a retyped or new turn is what comes next."""
    i, state, cost = 0, "", 0
    for e in edits:
        after = "a" if state == "u" else "u"
        if e == "I":
            state, cost = after, cost + 3
            continue
        if i == len(rows):
            return None
        role, cut = rows[i][1][0], rows[i][2][-1] != "."
        i += 1
        if e == "D":
            cost += 4
        elif e == "R":
            state, cost = after, cost + 3 + 3 * cut
        elif role == after or (role, state) == ("s", ""):
            state, cost = role, cost + 3 * cut
        else:
            return None
    return cost if i == len(rows) and state in ("", "a") else None


def test_rounds_of_doubling_follow_the_longest_path():
    sizes = [0, 1, 2, 9, 33]
    rows = C.Rows(
        np.concatenate(([0], np.cumsum(sizes))).astype(np.int64), np.array([2] * sum(sizes)), np.zeros(sum(sizes), np.int64)
    )
    last = np.ones(5, bool)
    cost = C.costs(rows, np.repeat(C._OPEN, 5, 0), last)
    paths = C.least_paths(rows, cost, last, np.zeros(5, np.int64))
    assert np.bincount(paths.whose, minlength=5).tolist()[0] == 0
    assert (np.diff(paths.whose) >= 0).all() and set(paths.exits) <= {0, 3}


def test_no_rows_long_texts_and_dropped_turns(spark):
    assert found(spark, []) == {}
    assert found(spark, [(1, 0, "user", "x", False), (1, None, None, None, False)]) == {
        1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    }
    rows = [(1, 0, "user", "word " * 400_000 + "."), (1, 1, "assistant", "word " * 400_000 + " ")]
    assert found(spark, rows) == {k: v[:-1] for k, v in plain(rows).items()}
