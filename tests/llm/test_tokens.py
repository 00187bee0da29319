"""Token counts, the unit encoder, records and packing against the libraries on whole texts."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from llm_fixtures import empty, odd  # noqa: F401
from rareflow.llm import packing, records, token_counts
from rareflow.llm.checksums import crc32c, masked
from rareflow.llm.tokens import UnitEncoder

BPE, SP = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_units_give_the_librarys_ids(library):
    r = random.Random(1)
    parts = ["a", "bc", " ", "  ", "\n", "\t", "é", " ", "　", "日", "!", "<|endoftext|>", "'s", "12", " ", "\x85", "\x1c", "\x00", "😀", "'ll", "\r", "word "]
    texts = [""] + ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    e = UnitEncoder(BPE)
    for _ in range(2):  # the second time from what is kept
        ids, at = e.encode([t.encode() for t in texts])
        assert all(library(t) == ids[a:b].tolist() for t, a, b in zip(texts, at[:-1], at[1:], strict=True))


def test_units_beyond_what_is_kept(library, monkeypatch):
    monkeypatch.setattr("rareflow.llm.tokens.MOST_UNITS", 3)
    e = UnitEncoder(BPE)
    for text in ("one two three four five six", "six five two seven"):
        assert e.encode([text.encode()])[0].tolist() == library(text)


@pytest.mark.parametrize("chunk,overlap", [(40, 4), (200, 16)])
def test_spliced_counts_are_the_models(chunk, overlap):
    c = token_counts.PieceCounter(SP, chunk, overlap)
    r = random.Random(2)
    parts = ["a", "th", "e ", " ", "  ", "\n", "é", "日", "tion", "0", "😀", "ing ", "x" * 9, " " * 5]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(30, 500))) for _ in range(150)]
    texts += [" " * 900, "".join(r.choice("abcde") for _ in range(900)), "▁" * 300 + " a ▁", "é" * 700]
    assert [c.count(t) for t in texts] == [len(c.model.encode(t)) for t in texts]


def test_counts_of_odd_rows(odd, empty):
    got = token_counts.count_tokens(odd, SP, limit=100, chunk=64, overlap=8).collect()
    model = token_counts.PieceCounter(SP).model
    want = Counter((r.doc_id, len((r.text or "").encode()), len(model.encode(r.text or "")), len(model.encode(r.text or "")) > 100) for r in odd.collect())
    assert Counter(map(tuple, got)) == want
    assert token_counts.count_tokens(empty, SP).count() == 0


def test_checksums():
    assert crc32c([b"123456789", b"\0" * 32, b"\xff" * 32]).tolist() == [0xE3069283, 0x8A9136AA, 0x62A8AB43]  # published values
    long = [bytes(random.Random(i).randbytes(n)) for i, n in enumerate((4, 255, 256, 257, 5000))]

    def plain(data):
        c = 0xFFFFFFFF
        for b in data:
            c ^= b
            for _ in range(8):
                c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
        return c ^ 0xFFFFFFFF

    assert crc32c(long).tolist() == [plain(x) for x in long]
    assert int(masked(np.array([0], np.uint32))[0]) == 0xA282EAD8


def test_records_round_trip(odd, empty, library, tmp_path):
    folder, index = records.write_records(odd, BPE, 2, f"file://{tmp_path}/r")
    rows = [r for r in records.read_records(index.orderBy(F.rand(3)), folder).collect()]
    want = sorted(((r.doc_id is not None, r.doc_id or 0), [*library(r.text), 2]) for r in odd.collect())
    rows.sort(key=lambda r: r.start)
    assert [(r.doc_id is not None, r.doc_id or 0) for r in rows] == [k for k, _ in want]
    assert Counter(map(str, [(r.doc_id, list(r.token_ids)) for r in rows])) == Counter(map(str, [(k[1] if k[0] else None, ids) for k, ids in want]))
    at = 0
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.token_ids) and r.ids_crc32 == zlib.crc32(np.array(r.token_ids, "<u4").tobytes())
        at += r.n_tokens
    bytes_ = sum(r.length for r in index.collect())
    small = records.dealt_by_bytes(index, 1 << 12)
    assert small.rdd.getNumPartitions() == -(-bytes_ // (1 << 12)) > 4 and records.dealt_by_bytes(index).rdd.getNumPartitions() == 1
    key = lambda r: r.start
    assert sorted(records.read_records(small, folder).collect(), key=key) == sorted(rows, key=key)
    nothing = records.write_records(empty, BPE, 2, f"file://{tmp_path}/e")[1]
    assert nothing.count() == 0 and records.dealt_by_bytes(nothing).count() == 0


def test_damaged_records_are_refused():
    whole = records.frame([records.payload(7, np.array([1, 2, 3], np.uint32)), records.payload(None, np.array([70000], np.uint32))])
    assert [(i, x.tolist()) for i, x in map(records.parse, records.unframe(whole))] == [(7, [1, 2, 3]), (None, [70000])]
    for k in (0, 9, 14, len(whole[0]) - 1):
        broken = bytearray(whole[0])
        broken[k] ^= 1
        with pytest.raises(records.DamagedRecord):
            records.unframe([bytes(broken)])


def best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, r in enumerate(rooms) if r >= n]
        if fit:
            i = min(fit, key=lambda i: rooms[i])
            rooms[i] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_best_fit(seed):
    r = random.Random(seed)
    capacity = r.choice([7, 30, 64])
    lengths = [min(capacity, int(r.expovariate(3 / capacity)) + 1) for _ in range(r.randint(0, 300))]
    moves = packing.plan(dict(Counter(lengths)), capacity)
    fill, ranks = {}, Counter()
    for n, a, b, first, offset in moves:
        for k in range(a, b + 1):
            ranks[n, k] += 1
            fill.setdefault(first + k - a, []).append((offset, n))
    assert ranks == Counter((n, k) for n, many in Counter(lengths).items() for k in range(many))
    for places in fill.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= capacity
    assert len(fill) == best_fit(lengths, capacity)
    with pytest.raises(ValueError):
        packing.plan({capacity + 1: 1}, capacity)


def test_packing_of_odd_rows(odd, empty, library):
    rows = packing.pack(odd, BPE, 2, capacity=64).collect()
    want = Counter()
    for r in odd.collect():
        ids = np.array([*library(r.text), 2], "<u4")
        cuts = [0, *range(len(ids) % 64 or 64, len(ids) + 1, 64)]
        want.update((r.doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 64
    assert len(by) == best_fit([r.length for r in rows], 64)
    assert packing.pack(empty, BPE, 2).count() == 0
