"""The mix against a plain simulation: the one-block law over whole mixes whose sources end at different times, and the places of rows."""

import random
import time
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from rareflow.llm import mixing


def fluid(weights, blocks):
    """Shares after each whole slot of a schedule in which sources with blocks left share by weight."""
    share, left, out = [Fraction(0)] * len(blocks), set(range(len(blocks))), [[Fraction(0)] * len(blocks)]
    for _ in range(sum(blocks)):
        room = Fraction(1)
        while room:
            whole = sum(weights[i] for i in left)
            step = min([room, *((blocks[i] - share[i]) * whole / weights[i] for i in left)])
            for i in list(left):
                share[i] += step * weights[i] / whole
                if share[i] == blocks[i]:
                    left.remove(i)
            room -= step
            if not left:
                break
        out.append(list(share))
    return out


def deviation(weights, blocks):
    names = {f"{i:04d}": i for i in range(len(blocks))}
    slots = {}
    for s, first, last, slot, *_ in mixing.stretches({n: weights[i] for n, i in names.items()}, {n: blocks[i] for n, i in names.items()}, 1):
        assert first == last and slot not in slots
        slots[slot] = (names[s], first)
    assert sorted(slots) == list(range(sum(blocks)))
    sent, most = [0] * len(blocks), Fraction(0)
    for slot, share in enumerate(fluid(weights, blocks)):
        most = max([most, *(abs(a - b) for a, b in zip(sent, share, strict=True))])
        if slot < len(slots):
            source, block = slots[slot]
            assert block == sent[source]  # a source's blocks come in order
            sent[source] += 1
    return most


@pytest.mark.parametrize("seed", range(30))
def test_random_sources_stay_within_one_block(seed):
    r = random.Random(seed)
    n = r.randint(1, 12)
    assert deviation([r.randint(1, r.choice([1, 3, 50])) for _ in range(n)], [r.randint(1, r.choice([2, 15, 60])) for _ in range(n)]) < 1


def test_many_sources_that_end_at_different_times():
    r = random.Random(1)
    assert deviation([1] * 52, [100, 100, *[1] * 50]) < 1
    assert deviation([1] * 200, [r.randint(1, 20) for _ in range(200)]) < 1
    assert deviation([1 + i % 7 for i in range(200)], [1 + i % 13 for i in range(200)]) < 1
    assert deviation([17, 14, 10, 6], [300, 200, 100, 37]) < 1


def test_the_driver_plays_weights_and_blocks_not_slots():
    r = random.Random(2)
    counts = Counter((1 + r.randint(0, 3), r.randint(1, 1500)) for _ in range(100_000))
    begin, many, slots = time.monotonic(), 0, 0
    for _, _, _, n, slot in mixing.runs(counts):
        assert slot == slots
        many, slots = many + 1, slots + n
    assert slots == sum(b * n for (_, b), n in counts.items()) and many < 4 * 4 * 1500 and time.monotonic() - begin < 20


def test_rows_take_the_simulated_places(spark):
    r = random.Random(3)
    rows = {f"s{i}": r.randint(1, 40) for i in range(25)}
    weights = {s: r.randint(1, 5) for s in rows}
    docs = spark.createDataFrame([(s, i) for s, n in rows.items() for i in range(n)], "source string, id long")
    got = mixing.mix(docs, weights, block_rows=3).collect()
    assert sorted(x.position for x in got) == list(range(sum(rows.values())))
    want, start = {}, 0
    for s, block, _, slot, *_ in mixing.stretches({f"={s}": w for s, w in weights.items()}, {f"={s}": n for s, n in rows.items()}, 3):
        size = min(3, rows[s[1:]] - 3 * block)
        want[s[1:], block] = (slot, list(range(start, start + size)))
        start += size
    found = defaultdict(list)
    for x in got:
        assert x.slot == want[x.source, x.block][0]
        found[x.source, x.block].append(x.position)
    assert {k: sorted(v) for k, v in found.items()} == {k: v for k, (_, v) in want.items()}
