"""Mixing sources to target weights by Pfair scheduling: earliest deadline first over blocks of rows.

Ideally, sources with blocks left share each slot by their weights, and a source leaves when its share of all slots so far covers its
blocks. In that ideal each source has its k-th block served in an interval of time, and that interval, widened to whole slots, is the block's
window: it is released with the slot in which the interval begins and due by the end of that in which it ends. Taking in each slot the released
block with the earliest deadline meets every deadline, since the ideal itself fits the windows; so after any number of slots, however many sources
have ended by then, each source is less than one block from its ideal share.

With V the service that a unit of weight has got, the time is t(V) = sum of min(weight * V, blocks) over the sources, and block k of a source of
weight w (from 0) is served from t(k / w) to t((k + 1) / w), exact as fractions. Sources of one weight have the same windows, so all k-th blocks of a
weight are one entry in the driver's queue, taken in runs of slots: the driver plays (weight, block) pairs, not slots, and holds a count
for each pair of a weight and a number of blocks. The runs go to Parquet in parts and meet the sources' blocks in an equi-join.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rareflow.llm.common import kept
from rareflow.llm.manifest import numbered
from rareflow.llm.packing import ranked
from rareflow.operators.ordered import prefix_sum
from rareflow.session import work_path

#: Rows of a block, and the sum of weights up to which slots are long integers.
BLOCK_ROWS, MOST_WEIGHT = 64, (1 << 62) - 1
#: Runs that the driver writes at once, and blocks of a source that one row makes.
SLOTS_AT_ONCE, REPEATS = 1 << 20, 1 << 12


def runs(sources: dict[tuple[int, int], int]) -> Iterator[tuple[int, int, int, int, int]]:
    """(weight, block, first place, places, first slot): slots in a row for the blocks of that number of the sources of a weight, given how many sources
    there are of each (weight, blocks). Places count a weight's sources from 0, those with more blocks first."""
    ending = sorted(sources, key=lambda e: Fraction(e[1], e[0]))  # in the order in which they leave
    done, alive = [0], [sum(w * n for (w, _), n in sources.items())]
    for w, blocks in ending:
        done.append(done[-1] + blocks * sources[w, blocks])
        alive.append(alive[-1] - w * sources[w, blocks])
    lengths: dict[int, list[int]] = defaultdict(list)
    many: dict[int, list[int]] = {}
    for w, blocks in sorted(sources):
        lengths[w].append(blocks)
    for w, of in lengths.items():
        many[w] = [0] * (len(of) + 1)  # sources with at least so many blocks
        for i in range(len(of) - 1, -1, -1):
            many[w][i] = many[w][i + 1] + sources[w, of[i]]

    def window(w: int, k: int) -> tuple[int, int]:
        """First slot of the release, and the slot before which block k is due."""
        found = []
        for served in (k, k + 1):
            j = bisect_right(ending, 0, key=lambda e: e[1] * w - served * e[0])
            found.append((done[j] * w + alive[j] * served, w))
        return found[0][0] // w, -(-found[1][0] // w)

    waiting: list[tuple[int, int, int, int]] = []  # release, weight, block, deadline
    for w in lengths:
        heapq.heappush(waiting, (window(w, 0)[0], w, 0, window(w, 0)[1]))
    ready: list[tuple[int, int, int, int]] = []  # deadline, weight, block, next place
    slot = 0
    while waiting or ready:
        while waiting and waiting[0][0] <= slot:
            _, w, k, due = heapq.heappop(waiting)
            heapq.heappush(ready, (due, w, k, 0))
            if k + 1 < lengths[w][-1]:
                release, due = window(w, k + 1)
                heapq.heappush(waiting, (release, w, k + 1, due))
        due, w, k, place = heapq.heappop(ready)
        left = many[w][bisect_right(lengths[w], k)] - place
        take = min(left, waiting[0][0] - slot) if waiting else left
        yield w, k, place, take, slot
        slot += take
        if take < left:
            heapq.heappush(ready, (due, w, k, place + take))


def stretches(weights: dict[str, int], rows: dict[str, int], block_rows: int) -> Iterator[tuple]:
    """The schedule of a small mix block by block: (source, block, block, slot, 1, [0], rows missing in the blocks before)."""
    blocks = {s: -(-n // block_rows) for s, n in rows.items() if n}
    sources: dict[tuple[int, int], int] = defaultdict(int)
    places: dict[int, list[str]] = defaultdict(list)
    for s in sorted(blocks, key=lambda s: (-blocks[s], s)):
        sources[weights[s], blocks[s]] += 1
        places[weights[s]].append(s)
    missing = 0
    for w, k, first, many, slot in runs(sources):
        for i in range(many):
            s = places[w][first + i]
            yield s, k, k, slot + i, 1, [0], missing
            missing += max(0, (k + 1) * block_rows - rows[s])


def order(weights: list[int]) -> list[list[int]]:
    """The slots that each source gets, ascending, of one period in which each has as many blocks as its weight."""
    out: list[list[int]] = [[] for _ in weights]
    names = {f"{i:09d}": i for i in range(len(weights))}
    for s, _, _, slot, *_ in stretches({n: weights[i] for n, i in names.items()}, {n: weights[i] for n, i in names.items()}, 1):
        out[names[s]].append(slot)
    return out


def schedule(sources: DataFrame, block_rows: int) -> DataFrame:
    """(_source, block, slot, weight, start) of every block, given (_source, weight, rows): ``start`` counts the rows of all blocks before."""
    spark = sources.sparkSession
    sources = sources.withColumn("blocks", F.expr(f"(rows + {block_rows - 1}) div {block_rows}")).withColumn("_fewest", -F.col("blocks"))
    sources = kept(numbered(sources, ["weight"], "_fewest", "_source").select("_source", "weight", "rows", "blocks", F.col("rank").alias("place")), "sources")
    counts = {(r["weight"], r["blocks"]): r["n"] for r in sources.groupBy("weight", "blocks").agg(F.count("*").alias("n")).collect()}
    path, names = work_path(spark, "slots"), ["_weight", "_block", "_first", "_many", "_slot"]
    form = pa.schema([(c, pa.int64()) for c in names])

    def write(part: list[tuple]) -> None:
        columns = list(zip(*part, strict=True)) if part else [[]] * len(names)
        spark.createDataFrame(pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=form)).write.mode("append").parquet(path)

    part: list[tuple] = []
    for run in runs(counts):
        part.append(run)
        if len(part) == SLOTS_AT_ONCE:
            write(part)
            part = []
    write(part)
    blocks = sources.withColumn("_part", F.explode(F.expr(f"sequence(0L, (blocks - 1) div {REPEATS})"))).repartition("_source", "_part")
    blocks = blocks.withColumn("block", F.explode(F.expr(f"sequence(_part * {REPEATS}, least(blocks - 1, _part * {REPEATS} + {REPEATS - 1}))")))
    played = spark.read.parquet(path)
    placed = blocks.join(played, (F.col("weight") == F.col("_weight")) & (F.col("block") == F.col("_block")) & F.expr("place >= _first and place < _first + _many"))
    placed = placed.selectExpr("_source", "block", "_slot + place - _first as slot", "weight", f"least({block_rows}, rows - block * {block_rows}) as _size")
    return prefix_sum(placed, "slot", {"_upto": "_size"}, descending=False).selectExpr("_source", "block", "slot", "weight", "_upto - _size as start")


def named(source: Column) -> Column:
    """A source's name in a schedule; a null source is one of its own."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def tempered(sizes: DataFrame, power: float, total: int) -> DataFrame:
    """(_source, rows, weight): whole weights of about ``total`` in sum, each source's row count to a power: under 1, small sources come more often.
    Powers are summed as whole numbers, so the weights don't depend on how the sum is split among tasks."""
    sizes = sizes.withColumn("_share", (F.pow("rows", F.lit(power)) * (1 << 20)).cast("decimal(38,0)"))
    whole = sizes.agg(F.sum("_share")).first()[0]
    weight = F.greatest(F.lit(1), F.round(F.lit(total) * F.col("_share").cast("double") / F.lit(float(whole or 1)))).cast("long")
    return sizes.select("_source", "rows", weight.alias("weight"))


def mix(docs: DataFrame, weights: dict[str | None, int] | None = None, power: float = 0.5, total: int = 1000, block_rows: int = BLOCK_ROWS,
        seed: int = 0, source_col: str = "source") -> DataFrame:
    """``docs`` and weight, block, slot, position (longs; columns with these names give way). Every row gets a place:
    ``position`` is gapless from 0, ``block`` counts the blocks of a source, ``slot`` those of the mix.

    ``weights`` are target shares as whole numbers; a source that they don't name has weight 1. Without them they are tempered
    row counts. Within a source, rows come in the order of a seeded hash of the whole row; repeated rows stand next to each other
    and get a place each. A null source is a source. An empty table gives no rows. There may be any number of sources; the driver
    holds a count for each weight and number of blocks that occurs. A sum of weights above MOST_WEIGHT, for which slots are no long integers, is an error.
    """
    docs = docs.drop("weight", "block", "slot", "position")
    spark = docs.sparkSession
    rows = docs.withColumns({"_source": named(docs[source_col]), "_mix": F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c, kind in docs.dtypes if not kind.startswith("map")])})
    sizes = kept(rows.groupBy("_source").agg(F.count("*").alias("rows")), "source-sizes")
    if weights is None:
        target = tempered(sizes, power, total)
    else:
        given = {"" if s is None else f"={s}": int(w) for s, w in weights.items()}
        if any(w < 1 for w in given.values()):
            raise ValueError("weights must be whole numbers from 1")
        if any(w > MOST_WEIGHT for w in given.values()):
            raise ValueError(f"a weight is more than {MOST_WEIGHT}")
        named_weights = spark.createDataFrame(list(given.items()), "_source string, _given long")
        target = sizes.join(named_weights, "_source", "left").select("_source", "rows", F.coalesce("_given", F.lit(1)).cast("long").alias("weight"))
    sums = target.agg(F.sum("rows").alias("rows"), F.sum(F.col("weight").cast("decimal(38,0)")).alias("weight")).first()
    if (sums["weight"] or 0) > MOST_WEIGHT:
        raise ValueError(f"the weights add up to more than {MOST_WEIGHT}")
    rows = ranked(rows, sums["rows"] or 0, "_source", ["_mix"]).withColumn("block", F.expr(f"rank div {block_rows}"))
    rows = rows.join(schedule(target, block_rows), ["_source", "block"]).withColumn("position", F.expr(f"start + rank % {block_rows}"))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], "weight", "block", "slot", "position")
