"""Repair of conversations' structure at the least cost: integer weights on a graph of edits.

Every row is kept, given another role, or deleted, and rows may be inserted, so that the roles read as an optional system turn followed
by user and assistant in turns. The edits of a conversation are a path through a graph whose nodes are (rows read, state); the states are: nothing
yet, system, user, assistant. An edge's weight is one integer: the high digits are its cost, the low digits hold the letters of the audit, each at
its position, in a fixed width that ends in zeros. Least cost, and among equal costs the audit that is first in ASCII order, is then plainly the
least integer: the graph is walked from its end, and an edge in front shifts the letters behind it by a digit.

A conversation may be of any length. Rows are ordered over all tasks, then taken in blocks of at most ``2 ** BLOCK_BITS``; a block's
result is the least weight from each state to each state, and neighbouring blocks join by the minimum over the state between them. (Of two edits of the
same rows at one cost, neither audit begins with the other, so what is least in each block is least in the whole.) Blocks are joined in rounds of
``2 ** FAN_BITS``, so no task gathers a conversation's rows. Only the digest of the repaired text, which is sequential by its nature, passes
a conversation's rows through one task, in order and a batch at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rareflow.llm.common import crc, in_small_batches, kept

BLOCK_BITS, FAN_BITS = 9, 6
#: States, and the digits of the audit's letters, ascending as their ASCII codes; 0 is the padding.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
LETTERS = {"D": 1, "I": 2, "K": 3, "R": 4}
COST = {"K": 0, "R": 1, "D": 2, "I": 5}
#: What keeping a truncated row costs besides.
TRUNCATED = 5
NO_BLANKS = "[^\\x20\\x09-\\x0D]"
_BLANKS = "' \\t\\n\\u000b\\f\\r'"
_TO_DIGITS, _TO_LETTERS = str.maketrans({k: str(v) for k, v in LETTERS.items()}), str.maketrans({str(v): k for k, v in LETTERS.items()})


def damage(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) damaged by the CRC-32 of ``conv_id:turn`` modulo 20 (nulls: one space): 0 drops a row, 1 empties its text,
    2 removes its ``.!?``, 3 repeats it, 4 makes it the user's."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), part("role").alias("role"), part("text").alias("text"),
                                (crc(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20).alias("_kind"))
    kind, text = F.col("_kind"), F.col("text")
    rows = rows.where(kind != 0).withColumns({
        "text": F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text), "role": F.when(kind == 4, "user").otherwise(F.col("role")),
        "_copy": F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))})
    return rows.select("conv_id", "turn", "role", "text")


def placed(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as a table with ``at``, a number that ascends by conversation and turn (nulls first); rows of one turn are ordered by role
    and text. Null role and text are one space. ``initial`` and ``fault``: b for blank, t for truncated, else one space."""
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    end = F.expr(f"rtrim({_BLANKS}, text)")
    fault = F.when(end == "", "b").when(~F.right(end, F.lit(1)).isin(".", "!", "?"), "t").otherwise(" ")
    rows = rows.withColumns({"key": F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)),
                             "initial": F.when(F.left("role", F.lit(1)).isin("s", "u", "a"), F.left("role", F.lit(1))).otherwise("x"), "fault": fault})
    dealt = rows.repartitionByRange("conv_id", "turn", "role", "key").sortWithinPartitions("conv_id", "turn", "role", "key")
    return kept(dealt.withColumn("at", F.monotonically_increasing_id()), "turns")


def with_duplicates(turns: DataFrame) -> DataFrame:
    """(conv_id, at, initial, fault): a row that isn't blank has fault d if its role and text came before in its conversation."""
    slim = turns.select("conv_id", "at", "initial", "fault", "key")
    again = slim.groupBy(F.col("conv_id").alias("_conv"), F.col("key").alias("_key")).agg(F.min("at").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    joined = slim.join(again, (F.col("key") == F.col("_key")) & F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    fault = F.when((F.col("fault") != "b") & (F.col("at") > F.col("_first")), "d").otherwise(F.col("fault"))
    return joined.select("conv_id", "at", "initial", fault.alias("fault"))


def edges(initial: str, fault: str, state: int) -> Iterator[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits of one row in a state."""
    yield "D", COST["D"], state
    if fault not in "bd":
        more = TRUNCATED if fault == "t" else 0
        if {"s": state == NOTHING, "u": state != USER, "a": state == USER}.get(initial):
            yield "K", COST["K"] + more, {"s": SYSTEM, "u": USER, "a": ASSISTANT}[initial]
        yield "R", COST["R"] + more, ASSISTANT if state == USER else USER


@lru_cache(1 << 14)
def block(initials: str, faults: str) -> tuple[tuple[int, str] | None, ...]:
    """(cost, audit) of the least edits from each state to each state (16, by state before and then after), None where there are none."""
    width = 3 * len(initials) + 3  # two inserts at most before each row and at the end
    low = 3 * width
    mask, top = (1 << low) - 1, low - 3

    def front(letter: str, cost: int, rest: int | None) -> int | None:
        """The weight of an edge and the path behind it."""
        return None if rest is None else ((rest >> low) + cost) << low | LETTERS[letter] << top | (rest & mask) >> 3

    def least(*weights: int | None) -> int | None:
        return min((w for w in weights if w is not None), default=None)

    def inserted(plain: list[int | None]) -> list[int | None]:
        user = least(plain[USER], front("I", COST["I"], plain[ASSISTANT]))
        assistant = least(plain[ASSISTANT], front("I", COST["I"], plain[USER]))
        return [*(least(plain[s], front("I", COST["I"], user)) for s in (NOTHING, SYSTEM)), user, assistant]

    found: list[list[int | None]] = []
    for target in range(4):
        values = inserted([0 if s == target else None for s in range(4)])
        for initial, fault in zip(reversed(initials), reversed(faults), strict=True):
            values = inserted([least(*(front(letter, cost, values[to]) for letter, cost, to in edges(initial, fault, s))) for s in range(4)])
        found.append(values)
    return tuple(None if w is None else (w >> low, format(w & mask, "o").zfill(width).rstrip("0").translate(_TO_LETTERS)) for s in range(4) for w in [found[t][s] for t in range(4)])


def joined(left: tuple, right: tuple) -> tuple[tuple[int, str] | None, ...]:
    """The least edits of two neighbouring blocks, by the least weight over the state between them."""
    out = []
    for s in range(4):
        for t in range(4):
            ways = [(left[4 * s + m], right[4 * m + t]) for m in range(4)]
            ways = [(a[0] + b[0], a[1] + b[1]) for a, b in ways if a and b]
            width = max((len(audit) for _, audit in ways), default=0)
            out.append(min(ways, default=None, key=lambda w: int(f"{w[0]:o}" + w[1].translate(_TO_DIGITS).ljust(width, "0"), 8)))
    return tuple(out)


_BLOCK = "conv_id long, block long, first string, last string, illegal long, blank long, duplicate long, truncated long, costs array<long>, audits array<string>"
_LEGAL = ("su", "ua", "au")


def _as_row(conv, number, first, last, counts, weights) -> dict:
    return {"conv_id": conv, "block": number, "first": first, "last": last, "illegal": counts[0], "blank": counts[1], "duplicate": counts[2], "truncated": counts[3],
            "costs": [w and w[0] for w in weights], "audits": [w and w[1] for w in weights]}


_ARROW = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("first", pa.string()), ("last", pa.string()), *[(c, pa.int64()) for c in ("illegal", "blank", "duplicate", "truncated")],
                    ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))])


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            initials, faults = "".join(row["initials"]), "".join(row["faults"])
            counts = [sum(initials[i:i + 2] not in _LEGAL for i in range(len(initials) - 1)), *(faults.count(f) for f in "bdt")]
            out.append(_as_row(row["conv_id"], row["block"], initials[0], initials[-1], counts, block(initials, faults)))
        yield pa.RecordBatch.from_pylist(out, schema=_ARROW)


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            items = [(r["first"], r["last"], [r[c] for c in ("illegal", "blank", "duplicate", "truncated")],
                      tuple(None if c is None else (c, a) for c, a in zip(r["costs"], r["audits"], strict=True))) for r in row["rows"]]
            while len(items) > 1:
                items = [_pair(*items[i:i + 2]) if i + 1 < len(items) else items[i] for i in range(0, len(items), 2)]
            out.append(_as_row(row["conv_id"], row["block"], *items[0]))
        yield pa.RecordBatch.from_pylist(out, schema=_ARROW)


def _pair(a: tuple, b: tuple) -> tuple:
    counts = [x + y for x, y in zip(a[2], b[2], strict=True)]
    counts[0] += a[1] + b[0] not in _LEGAL
    return a[0], b[1], counts, joined(a[3], b[3])


def solved(rows: DataFrame, block_bits: int = BLOCK_BITS, fan_bits: int = FAN_BITS) -> DataFrame:
    """(conv_id, illegal, blank, duplicate, truncated, cost, audit) of each conversation, given ``with_duplicates``."""
    in_small_batches(rows)
    grouped = rows.groupBy("conv_id", F.shiftright("at", block_bits).alias("block")).agg(F.sort_array(F.collect_list(F.struct("at", "initial", "fault"))).alias("r"))
    blocks = kept(grouped.select("conv_id", "block", F.col("r.initial").alias("initials"), F.col("r.fault").alias("faults")).mapInArrow(_solve, _BLOCK), "blocks")

    def joins(above: Column) -> DataFrame:
        grouped = blocks.groupBy("conv_id", above.alias("above")).agg(F.sort_array(F.collect_list(F.struct("block", *[c for c in blocks.columns if c not in ("conv_id", "block")]))).alias("rows"))
        return grouped.select("conv_id", F.col("above").alias("block"), "rows").mapInArrow(_join, _BLOCK)

    while (blocks.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0) > 1 << fan_bits:
        blocks = kept(joins(F.shiftright("block", fan_bits)), "blocks")
    whole = joins(F.lit(0).cast("long"))
    ends = [F.struct(F.col("costs")[t].alias("cost"), F.col("audits")[t].alias("audit")) for t in (NOTHING, ASSISTANT)]
    best = F.array_min(F.filter(F.array(*ends), lambda e: e["cost"].isNotNull()))
    return whole.withColumn("best", best).select("conv_id", "illegal", "blank", "duplicate", "truncated", "best.cost", "best.audit")


class _Repair:
    """The repaired rows of one conversation, as its rows come in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, NOTHING

    def _next_role(self) -> str:
        self.state = ASSISTANT if self.state == USER else USER
        return "assistant" if self.state == ASSISTANT else "user"

    def inserts(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at:self.at + 1] == "I":
            self.at += 1
            yield "I", self._next_role(), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(letter, role, text) of the rows that come out as one comes in."""
        yield from self.inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
            yield letter, role, text
        elif letter == "R":
            yield letter, self._next_role(), text


_NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _stream(turns: DataFrame, summary: DataFrame) -> DataFrame:
    """Each conversation's summary followed by its rows, in order, in one partition."""
    head = summary.select("conv_id", F.lit(-1).cast("long").alias("at"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "audit", *_NUMBERS)
    body = turns.select("conv_id", "at", "role", "text", F.lit(None).cast("string").alias("audit"), *[F.lit(None).cast("long").alias(c) for c in _NUMBERS])
    return in_small_batches(head.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "at"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def done() -> dict:
        add(repair.inserts())
        return {**{c: head[c] for c in ("conv_id", *_NUMBERS, "audit")}, "repaired_sha256": sha.hexdigest()}

    def add(rows: Iterator[tuple[str, str, str]]) -> None:
        nonlocal some
        for _, role, text in rows:
            sha.update((("\n" if some else "") + role + ":" + text).encode())
            some = True

    head = None
    form = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in _NUMBERS], ("audit", pa.string()), ("repaired_sha256", pa.string())])
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["at"] < 0:
                if head:
                    out.append(done())
                head, repair, sha, some = row, _Repair(row["audit"]), hashlib.sha256(), False
            else:
                add(repair.row(row["role"], row["text"]))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=form)
    if head:
        yield pa.RecordBatch.from_pylist([done()], schema=form)


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    form = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def add(conv, rows: Iterator[tuple[str, str, str]]) -> None:
        nonlocal place
        for edit, role, text in rows:
            out.append({"conv_id": conv, "place": place, "edit": edit, "role": role, "text": text})
            place += 1

    head, place = None, 0
    for batch in batches:
        out: list[dict] = []
        for row in batch.to_pylist():
            if row["at"] < 0:
                if head:
                    add(head["conv_id"], repair.inserts())
                head, repair, place = row, _Repair(row["audit"]), 0
            else:
                add(row["conv_id"], repair.row(row["role"], row["text"]))
        yield pa.RecordBatch.from_pylist(out, schema=form)
    if head:
        out = []
        add(head["conv_id"], repair.inserts())
        yield pa.RecordBatch.from_pylist(out, schema=form)


def _summary(conversations: DataFrame, turns: DataFrame, block_bits: int, fan_bits: int) -> DataFrame:
    gaps = turns.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    found = solved(with_duplicates(turns), block_bits, fan_bits)
    everyone = conversations.select(F.col("conv_id").cast("long").alias("conv_id"))
    parts = everyone.unionByName(gaps, allowMissingColumns=True).unionByName(found, allowMissingColumns=True)
    out = parts.groupBy("conv_id").agg(*[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in _NUMBERS], F.coalesce(F.max("audit"), F.lit("")).alias("audit"))
    return kept(out, "conversations")


def repair(conversations: DataFrame, rows: DataFrame | None = None, block_bits: int = BLOCK_BITS, fan_bits: int = FAN_BITS, turns_out: bool = False) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation; with ``turns_out`` the repaired
    rows (conv_id, place from 0, edit, role, text) instead. ``rows`` are the turns to repair, if they aren't those of ``conversations``.

    Turns go in order, null turns first; turns with equal numbers are ordered by role and text. A null role or text is one space, so such a text is
    blank and such a role must change. Rows without a conversation's number are one conversation. A conversation without rows has zeros, an
    empty audit and the digest of an empty text, and no repaired rows; an empty table gives none. Other columns are not read.
    """
    turns = placed(conversations if rows is None else rows)
    summary = _summary(conversations, turns, block_bits, fan_bits)
    if turns_out:
        return _stream(turns, summary).mapInArrow(_turns, "conv_id long, place long, edit string, role string, text string")
    return _stream(turns, summary).mapInArrow(_digests, "conv_id long, " + ", ".join(f"{c} long" for c in _NUMBERS) + ", audit string, repaired_sha256 string")
