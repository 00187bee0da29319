"""The repair of conversations against all edit sequences tried out, and against a plain search by (cost, audit) on longer ones."""

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import types as T

from conftest import SF
from rareflow.llm import conversations, queries

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
BLANKS = " \t\n\x0b\x0c\r"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        end = text.rstrip(BLANKS)
        out.append("b" if not end else "d" if (role, text) in seen else "t" if end[-1] not in ".!?" else " ")
        seen.add((role, text))
    return out


def best(rows):
    """(cost, audit, repaired rows): Dijkstra over (rows read, roles' state), ordered by (cost, audit)."""
    bad = faults(rows)
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, i, state, out = heapq.heappop(queue)
        if i == len(rows) and state in ("", "a"):
            return cost, audit, out
        if (i, state) in done:
            continue
        done.add((i, state))
        to = "a" if state == "u" else "u"
        full = {"u": "user", "a": "assistant"}[to]
        heapq.heappush(queue, (cost + 5, audit + "I", i, to, (*out, (full, ""))))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(queue, (cost + 2, audit + "D", i + 1, state, out))
            if bad[i] not in "bd":
                more = 5 * (bad[i] == "t")
                heapq.heappush(queue, (cost + 1 + more, audit + "R", i + 1, to, (*out, (full, text))))
                if role[:1] == to or (role[:1] == "s" and state == ""):
                    heapq.heappush(queue, (cost + more, audit + "K", i + 1, role[0], (*out, (role, text))))
    raise AssertionError


def every(rows):
    """The least (cost, audit) of all edit sequences with up to two inserts at each place."""
    bad, found = faults(rows), []
    for kinds in itertools.product(*["D" if f in "bd" else "DKR" for f in bad]):
        for many in itertools.product(range(3), repeat=len(rows) + 1):
            audit = "".join("I" * n + k for n, k in zip(many, (*kinds, ""), strict=True))
            roles, row = "", 0
            for letter in audit:
                if letter == "I":
                    roles += "?"
                    continue
                roles += {"D": "", "R": "?", "K": (rows[row][0] or " ")[:1]}[letter]
                row += 1
            first = "s" if roles[:1] == "s" else ""
            rest = roles[len(first):]
            if (first and not rest) or len(rest) % 2 or any(c not in ("?", "ua"[i % 2]) for i, c in enumerate(rest)):
                continue
            found.append((sum({"K": 0, "R": 1, "D": 2}[k] + 5 * (f == "t" and k != "D") for k, f in zip(kinds, bad, strict=True)) + 5 * sum(many), audit))
    return min(found)


def plain(rows_of):
    out = []
    for conv, rows in rows_of.items():
        rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).digest()))
        turns = [t for t, _, _ in rows if t is not None]
        pairs = [(r, t) for _, r, t in rows]
        bad = faults(pairs)
        cost, audit, repaired = best(pairs)
        initials = [r[:1] for r, _ in pairs]
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(bad.count(f) for f in "bdt"),
                    sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit,
                    hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()))
    return sorted(out, key=str)


def damaged(rows):
    out = defaultdict(list)
    text = lambda v: " " if v is None else str(v)
    for conv, turn, role, said in rows:
        out[conv]
        role, said = text(role), text(said)
        kind = zlib.crc32(f"{text(conv)}:{text(turn)}".encode()) % 20
        if kind:
            said = "" if kind == 1 else re.sub("[.!?]", "", said) if kind == 2 else said
            out[conv] += [(turn, "user" if kind == 4 else role, said)] * (2 if kind == 3 else 1)
    return out


def test_query_on_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op12_conversation_repair(spark, SF)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(damaged(rows))


def some(seed, many, longest):
    r = random.Random(seed)
    roles, texts = ["system", "user", "assistant", "assistant", "user", "tool", "", "sys", "User", " "], ["Yes.", "no", "", " \t", "Why?", "a.", "b!", "  x. \n", "日", "c.", "d.", "e!"]
    return [(c, i if r.random() < .9 else r.choice([None, 3, 50 + i]), r.choice(roles), r.choice(texts) + (str(i) + "." if r.random() < .5 else "")) for c in range(many) for i in range(r.randint(1, longest))]


def test_weights_find_the_least_of_all_edits():
    for conv, rows in itertools.groupby(some(1, 150, 4), key=lambda r: r[0]):
        rows = [(role, text) for _, _, role, text in rows]
        initials = "".join(r[0] if r[:1] in ("s", "u", "a") else "x" for r, _ in rows)
        weights = conversations.block(initials, "".join(faults(rows)))
        assert min(w for w in (weights[conversations.NOTHING], weights[conversations.ASSISTANT]) if w) == every(rows) == best(rows)[:2], conv


@pytest.mark.parametrize("block_bits,fan_bits", [(9, 6), (1, 1), (2, 3)])
def test_odd_and_long_conversations_in_blocks(spark, block_bits, fan_bits):
    rows = some(2, 60, 30) + [(1000, i, r, t) for i, (_, _, r, t) in enumerate(some(3, 1, 1) * 20 + some(4, 40, 40))]
    rows += [(None, None, None, None), (None, 4, "user", "Hm."), (None, 5, "assistant", None), (2000, None, "system", "Only.")] + [(3000, 1, "user", "Same.")] * 5
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as at", "'x' as fault", "2 as block", "'q' as audit", "7 as cost")
    got = conversations.repair(frame, block_bits=block_bits, fan_bits=fan_bits).collect()
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, role if role is not None else " ", text if text is not None else " "))
    assert sorted(map(tuple, got), key=str) == plain(by)


def test_damage_and_the_repaired_turns(spark):
    rows = some(5, 80, 6)
    frame = spark.createDataFrame(rows, SCHEMA)
    turns = conversations.repair(frame, conversations.damage(frame), turns_out=True).collect()
    by = defaultdict(list)
    for r in sorted(turns, key=lambda r: (r.conv_id, r.place)):
        by[r.conv_id].append((r.edit, r.role, r.text))
    want = damaged(rows)
    digests = {r.conv_id: r for r in conversations.repair(frame, conversations.damage(frame)).collect()}
    assert set(digests) == set(want) and sorted(map(tuple, digests.values()), key=str) == plain(want)
    for conv, r in digests.items():
        assert re.fullmatch("(s?(ua)+)?", "".join(role[0] for _, role, _ in by[conv]))
        assert "".join(e for e, _, _ in by[conv]) == r.audit.replace("D", "")
        assert hashlib.sha256("\n".join(f"{role}:{text}" for _, role, text in by[conv]).encode()).hexdigest() == r.repaired_sha256


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert conversations.repair(empty).count() == 0 and conversations.repair(empty, turns_out=True).count() == 0
    gone = conversations.repair(spark.createDataFrame([(7, 1, "user", "x")], SCHEMA), empty).collect()
    assert [tuple(r) for r in gone] == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
