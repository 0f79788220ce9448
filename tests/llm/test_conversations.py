"""Repair of conversations against every sequence of edits, one turn after the other in plain Python."""

import hashlib
import random
import re
import zlib

import pytest

from tallyloom.llm import conversations

COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
NEXT = {"0": {"s": "S", "u": "U"}, "S": {"u": "U"}, "U": {"a": "A"}, "A": {"u": "U"}}
NAMES = {"u": "user", "a": "assistant"}
SCHEMA = "conv_id long, turn long, role string, text string"


def damaged(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            yield from [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def inserted(best):
    """States with up to three turns inserted."""
    best = dict(best)
    for _ in range(3):
        for state, (cost, audit, made) in list(best.items()):
            for letter, name in NAMES.items():
                if letter in NEXT[state]:
                    way = (cost + 5, audit + "I", made + (name + ":",))
                    if NEXT[state][letter] not in best or way[:2] < best[NEXT[state][letter]][:2]:
                        best[NEXT[state][letter]] = way
    return best


def plain(ids, rows):
    """What the contract says of each conversation."""
    order = {c: [] for c in ids}
    for conv, *turn in rows:
        order[conv].append(tuple(turn))
    found = {}
    for conv, turns in order.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.sha256(t[2].encode()).digest()))
        known = [t[0] for t in turns if t[0] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        seen, faults = set(), []
        for _, role, text in turns:
            bare = text.strip(" \t\n\r\v\f")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        best = {"0": (0, "", ())}
        for (_, role, text), fault in zip(turns, faults, strict=True):
            ways = []
            for state, (cost, audit, made) in inserted(best).items():
                ways.append((state, (cost + 2, audit + "D", made)))
                if fault in ("blank", "duplicate"):
                    continue
                more = 5 if fault == "truncated" else 0
                if role[:1] in NEXT[state]:
                    ways.append((NEXT[state][role[:1]], (cost + more, audit + "K", made + (f"{role}:{text}",))))
                ways += [(NEXT[state][k], (cost + 1 + more, audit + "R", made + (f"{name}:{text}",))) for k, name in NAMES.items() if k in NEXT[state]]
            best = {}
            for state, way in ways:
                if state not in best or way[:2] < best[state][:2]:
                    best[state] = way
        cost, audit, made = min((way for state, way in inserted(best).items() if state in "0A"), key=lambda w: w[:2])
        counts = [faults.count(k) for k in ("blank", "duplicate", "truncated")]
        found[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())
    return found


def random_rows(seed):
    """Short and long conversations, with nulls, ties, repeats, odd roles and blanks."""
    rng, rows = random.Random(seed), []
    for conv in [None, *range(60)]:
        for turn in range(rng.choice((1, 3, 8, 8, 30, 150 if conv is None or conv % 20 == 0 else 5))):
            role = rng.choice(("user", "assistant", "user" if turn % 2 else "assistant", "system", "", "tool", None))
            text = rng.choice(("Yes.", "No!", f"Turn {turn}.", f"cut {turn}", " \n", "", None, "é😀? ", "x\ty"))
            row = (conv, rng.choice((turn, turn, turn, turn // 2, None, turn + 3)), role, text)
            rows += [row] * rng.choice((1, 1, 1, 2, 5))
    return rows


@pytest.mark.parametrize("run", [conversations.RUN, 3])
def test_whole(spark, monkeypatch, run):
    """Also with runs of three turns, so that long conversations take several rounds."""
    monkeypatch.setattr(conversations, "RUN", run)
    rows = random_rows(run)
    given = spark.createDataFrame([(*r, "k") for r in rows], SCHEMA + ", conv string").repartition(5)
    got = conversations.repaired_digests(conversations.damage(given), given.select(conversations.F.col("conv_id").alias("conv")))
    want = plain({r[0] for r in rows}, damaged(rows))
    assert {r["conv"]: tuple(r[c] for c in COLUMNS) for r in got.collect()} == want


def test_turns(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi?"), (1, 2, "user", "Hello?"), (1, 3, "assistant", "Hi."), (1, 4, "user", "Bye.")]
    turns = spark.createDataFrame(rows, "conv long, turn long, role string, text string")
    audit = conversations.audited(turns).first()
    assert (audit["cost"], audit["illegal"], audit["audit"]) == (3, 1, "KKRRR")
    got = [tuple(r) for r in conversations.repaired_turns(turns).orderBy("place").collect()]
    assert got == [(1, 0, "K", "system", "Be kind."), (1, 1, "K", "user", "Hi?"), (1, 2, "R", "assistant", "Hello?"), (1, 3, "R", "user", "Hi."), (1, 4, "R", "assistant", "Bye.")]


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert conversations.repaired_digests(conversations.damage(none)).count() == 0
    one = spark.createDataFrame([("a",), (None,)], "conv string")
    got = conversations.repaired_digests(conversations.damage(spark.createDataFrame([], "conv_id string, turn long, role string, text string")), one).collect()
    assert {r["conv"] for r in got} == {"a", None}
    assert {tuple(r[c] for c in COLUMNS) for r in got} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_a_very_long_conversation(spark):
    """Three rounds of runs, and no task of them that gets more than its batches."""
    n = 5000
    rows = spark.range(n).selectExpr("7 as conv", "id as turn", "if(id % 3 = 0, 'user', 'assistant') as role", "concat('Turn ', id, '.') as text")
    got = conversations.repaired_digests(rows).first()
    want = plain({7}, [(7, k, "user" if k % 3 == 0 else "assistant", f"Turn {k}.") for k in range(n)])[7]
    assert tuple(got[c] for c in COLUMNS) == want
