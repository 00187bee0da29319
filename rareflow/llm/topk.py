"""Exact top-k by inner product: branch and bound over a ball tree for each shard of the vectors.

A shard is a bounded number of rows with a ball tree over them: a node has a centre and a radius, so no vector in it has an
inner product with q above q.centre + |q| radius. A query goes down only into nodes whose bound reaches its current k-th
score, and visits the leaves that remain in the order of their bounds. Components are whole numbers, floor(scale * x), and
scores are exact.

Rows that lie close together share a shard: the upper part of the tree, cut on a bounded sample, tells each row its cell;
small neighbouring cells share a shard, and a cell with too many rows is dealt over several. The queries of a shard are a block. Before any shard is sent, the
balls of the shards and their leaves alone (a centre and a radius each) are held against the blocks' k-th scores, and a shard
goes to a block only if the bound of a leaf reaches the k-th score of one of the block's queries. Blocks first search their own shard, then the shards that
promise most; then the bounds are held against the better k-th scores, and what still reaches them is searched. A task takes a
block through several shards one after the other and keeps its k-th scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rareflow.llm.common import kept
from rareflow.llm.grouped import arrays, groups, lists

SHARD_ROWS, LEAF_ROWS, SHARDS_TOGETHER = 8192, 256, 8
#: Bounds of what the driver and every task hold: numbers in the sample that cuts the cells, sampled rows for each
#: cell, cells for each shard, cells.
SAMPLE_NUMBERS, SAMPLE_ROWS_A_CELL, CELLS_A_SHARD, MOST_CELLS = 1 << 20, 8, 8, 2048
#: Queries and balls that are held against each other at a time when the shards to send are chosen.
QUERIES_AT_ONCE, BALLS_AT_ONCE = 1 << 15, 1024


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if top < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T  # 64-bit whole numbers


def fitted(a: np.ndarray, width: int) -> np.ndarray:
    """Rows filled up with zeros to ``width``."""
    return a if a.shape[1] == width else np.pad(a, ((0, 0), (0, width - a.shape[1])))


def halves(x: np.ndarray, rounds: int = 6) -> tuple[np.ndarray, float]:
    """A direction, and the place along it, that part the rows into two: two-means from two far rows, so that a cut goes between
    clusters where there are some. A ball that spans a cluster and a few strays bounds nothing."""
    one = x[((x - x.mean(axis=0)) ** 2).sum(axis=1).argmax()]
    other = x[((x - one) ** 2).sum(axis=1).argmax()]
    for _ in range(rounds):
        direction, middle = other - one, (other - one) @ (one + other) / 2
        above = x @ direction >= middle
        if above.all() or not above.any():
            break
        one, other = x[~above].mean(axis=0), x[above].mean(axis=0)
    return direction, middle


def upper_bounds(queries: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """For each query and ball, what no inner product of the query with a vector in the ball exceeds."""
    norm = np.sqrt((queries ** 2).sum(axis=1))[:, None]
    reach = np.sqrt((centres ** 2).sum(axis=1)) + radii
    return queries @ centres.T + norm * radii + 1e-9 * (1 + norm * reach)  # the last is more than rounding takes away


class Cells:
    """The upper part of a ball tree, cut on a sample: ``of`` gives each row the number of its cell."""

    def __init__(self, sample: np.ndarray, cells: int):
        x = sample.astype(np.float64)
        self.width, self.cuts, self.cells = x.shape[1], [], 0  # cuts: direction, middle, and what is below and above: a cut or a cell
        todo = [(np.arange(len(x)), cells, None)]
        while todo:
            rows, parts, place = todo.pop()
            cut = self._cut(x[rows]) if parts > 1 and len(rows) > 1 else None
            if place is not None:
                self.cuts[place[0]][2 + place[1]] = ("cut", len(self.cuts)) if cut else ("cell", self.cells)
            if not cut:
                self.cells += 1
                continue
            direction, middle = cut
            self.cuts.append([direction, middle, None, None])
            above = x[rows] @ direction >= middle
            below = min(max(1, round(parts * float((~above).mean()))), parts - 1)
            todo += [(rows[~above], below, (len(self.cuts) - 1, 0)), (rows[above], parts - below, (len(self.cuts) - 1, 1))]

    @staticmethod
    def _cut(x: np.ndarray) -> tuple[np.ndarray, float] | None:
        direction, middle = halves(x)
        along = x @ direction
        if along.max() == along.min():
            return None
        return direction, middle if along.min() < middle <= along.max() else along.max()

    def of(self, rows: np.ndarray) -> np.ndarray:
        x = fitted(rows[:, :self.width], self.width).astype(np.float64)
        out, todo = np.zeros(len(x), np.int64), [("cut" if self.cuts else "cell", 0, np.arange(len(x)))]
        while todo:
            kind, number, at = todo.pop()
            if kind == "cell":
                out[at] = number
            elif len(at):
                direction, middle, *sides = self.cuts[number]
                above = x[at] @ direction >= middle
                todo += [(*sides[0], at[~above]), (*sides[1], at[above])]
        return out


class BallTree:
    """Nodes of a ball tree (parents first): centre, radius, the rows from ``begin`` to ``end``, parent (-1: none). Rows stand in
    the order of the leaves."""

    def __init__(self, centres: np.ndarray, radii: np.ndarray, begin: np.ndarray, end: np.ndarray, parent: np.ndarray):
        self.centres, self.radii, self.begin, self.end, self.parent = centres, radii, begin, end, parent
        self.leaves = np.setdiff1d(np.arange(len(parent)), parent)

    @classmethod
    def of(cls, rows: np.ndarray, leaf_rows: int = LEAF_ROWS) -> tuple[BallTree, np.ndarray]:
        """The tree of ``rows``, parted in two until they fit a leaf, and their order; a leaf has an eighth of ``leaf_rows`` at least."""
        x = rows.astype(np.float64)
        order, nodes, todo = np.arange(len(x)), [], [(0, len(x), -1)]
        while todo:
            a, b, parent = todo.pop()
            own = x[order[a:b]]
            centre = own.mean(axis=0)
            nodes.append((centre, np.sqrt(((own - centre) ** 2).sum(axis=1)).max(), a, b, parent))
            if b - a > leaf_rows:
                direction, middle = halves(own)
                along, fewest = own @ direction, max(1, leaf_rows // 8)
                order[a:b] = order[a:b][np.argsort(along, kind="stable")]
                cut = a + min(max(int((along < middle).sum()), fewest), b - a - fewest)
                todo += [(a, cut, len(nodes) - 1), (cut, b, len(nodes) - 1)]
        return cls(*(np.array(column) for column in zip(*nodes, strict=True))), order

    def leaf_bounds(self, queries: np.ndarray, least: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
        """Ranges of the leaves, and an upper bound for each query and leaf (minus infinity below a node that is ruled out)."""
        width = max(queries.shape[1], self.centres.shape[1])
        bound = upper_bounds(fitted(queries, width), fitted(self.centres, width), self.radii)
        live = bound >= least[:, None]
        for i, p in enumerate(self.parent.tolist()):
            if p >= 0:
                live[:, i] &= live[:, p]
        return [(int(self.begin[i]), int(self.end[i])) for i in self.leaves], np.where(live, bound, -np.inf)[:, self.leaves]


class Best:
    """The k best (score, id) of each query: highest scores, ties to smaller ids."""

    def __init__(self, n: int, k: int, least: np.ndarray):
        self.k, self.least = k, least.astype(np.float64).copy()
        self.query, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.n = n

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(query):
            return
        query, score, ids = (np.concatenate(p) for p in ((self.query, query), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        begin = np.searchsorted(query, np.arange(self.n))
        rank = np.arange(len(query)) - begin[query]
        keep = rank < self.k
        last = rank == self.k - 1
        self.least[query[last]] = np.maximum(self.least[query[last]], score[last])
        self.query, self.score, self.id = query[keep], score[keep], ids[keep]


def search(tree: BallTree, rows: np.ndarray, ids: np.ndarray, places: np.ndarray, queries: np.ndarray, own_places: np.ndarray, best: Best) -> None:
    """Take all queries through one shard. ``places`` tell rows apart, so that a query doesn't find itself."""
    if not len(rows) or not len(queries):
        return
    width = max(rows.shape[1], queries.shape[1])
    rows, queries = fitted(rows, width), fitted(queries, width)
    ranges, bound = tree.leaf_bounds(queries.astype(np.float64), best.least)
    visits = np.argsort(-bound, axis=1, kind="stable")
    for turn in range(len(ranges)):
        leaf = visits[:, turn]
        going = bound[np.arange(len(queries)), leaf] >= best.least
        going &= np.isfinite(bound[np.arange(len(queries)), leaf])
        if not going.any():
            break
        found = []
        for k in np.unique(leaf[going]):
            q = np.flatnonzero(going & (leaf == k))
            a, b = ranges[k]
            score = products(queries[q], rows[a:b])
            i, j = np.nonzero((score >= best.least[q][:, None]) & (own_places[q][:, None] != places[None, a:b]))
            found.append((q[i], score[i, j], ids[a:b][j]))
        best.add(*(np.concatenate(x) for x in zip(*found, strict=True)))


def whole_numbers(vectors: DataFrame, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the rows that take part: floor(scale * x) of each component."""
    v = vectors[vector_col].cast("array<double>")
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(ok).withColumn("v", F.transform("v", lambda x: F.floor(x * scale)))


def _matrix(column: pa.ChunkedArray | pa.Array, kind: type = np.int64) -> np.ndarray:
    rows = arrays(column)
    out = np.zeros((len(rows), max(map(len, rows), default=0)), kind)
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def cells_of(rows: DataFrame, count: int, shard_rows: int) -> DataFrame:
    """``rows`` with ``cell``. The sample is uniform (the rows with the least hashes) and holds at most ``SAMPLE_NUMBERS`` numbers."""
    shards = -(-count // shard_rows)
    if shards <= 1:
        return rows.withColumn("cell", F.lit(0).cast("long"))
    width = max(1, rows.agg(F.max(F.size("v"))).first()[0])
    wanted = min(max(SAMPLE_NUMBERS // width, 2), SAMPLE_ROWS_A_CELL * MOST_CELLS)
    sample = _matrix(rows.select("v").orderBy(F.xxhash64(F.lit("sample"), "vec_id", "v")).limit(wanted).toArrow().column("v"))
    cells = Cells(sample[:, :SAMPLE_NUMBERS], min(CELLS_A_SHARD * shards, max(1, len(sample) // SAMPLE_ROWS_A_CELL), MOST_CELLS))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.append_column("cell", pa.array(cells.of(_matrix(batch.column("v")))))

    return rows.mapInArrow(assign, "vec_id long, v array<long>, copies long, cell long")


def packed_shards(vectors: DataFrame, every: int, k: int, shard_rows: int, leaf_rows: int) -> DataFrame:
    """A row for each shard: its ids and vectors in the order of its ball tree, the nodes of the tree, its queries.

    Equal rows (id and vector) are one row with a number of copies. A query finds k of them at most, so k + 1 are searched;
    their own results are all the same, so one of them asks.
    """
    rows = kept(vectors.groupBy("vec_id", "v").agg(F.count("*").alias("copies")), "vectors")
    total = rows.agg(F.sum(F.least("copies", F.lit(k + 1)))).first()[0] or 0
    rows = kept(cells_of(rows, total, shard_rows), "cells")
    # a row for each cell, at most MOST_CELLS. Cells lie side by side in the order of the tree, and every ``shard_rows`` rows
    # along that line are a shard: small cells share one, a large cell is dealt over several
    sizes = rows.groupBy("cell").agg(F.sum(F.least("copies", F.lit(k + 1))).alias("size"))
    sizes = sizes.withColumn("before", F.coalesce(F.sum("size").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.least("copies", F.lit(k + 1).cast("long"))))
    dealt = rows.join(F.broadcast(sizes), "cell").select("*", copy.alias("copy")).withColumn(
        "shard", F.floor((F.col("before") + F.pmod(F.xxhash64("vec_id", "v", "copy"), F.col("size"))) / shard_rows))
    asks = F.when((F.col("copy") == 1) & (F.col("vec_id") % every == 0), F.col("copies")).otherwise(F.lit(0).cast("long"))
    dealt = dealt.select("shard", "vec_id", "v", asks.alias("asks"), "copy").repartition("shard").sortWithinPartitions("shard", "vec_id", F.xxhash64("v"), "v", "copy")

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (shard,), table in groups(batches, ["shard"]):
            matrix, ids, asks = _matrix(table.column("v")), table.column("vec_id").to_numpy(), table.column("asks").to_numpy()
            tree, order = BallTree.of(matrix, leaf_rows)
            matrix, ids, asks = matrix[order], ids[order], asks[order]
            asking = np.flatnonzero(asks)
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard]), lists([ids], pa.int64()), pa.array([matrix.shape[1]], pa.int32()), lists([matrix.ravel()], pa.int64()),
                 lists([asking], pa.int64()), lists([ids[asking]], pa.int64()), lists([asks[asking]], pa.int64()), lists([matrix[asking].ravel()], pa.int64()),
                 lists([tree.centres.ravel()], pa.float64()), lists([tree.radii], pa.float64()), *(lists([x], pa.int64()) for x in (tree.begin, tree.end, tree.parent)),
                 lists([np.concatenate([tree.centres[:1], tree.centres[tree.leaves]]).ravel()], pa.float64()), lists([tree.radii[[0, *tree.leaves]]], pa.float64())],
                names=["shard", "ids", "width", "flat", "q_rows", "q_ids", "q_copies", "q_flat", *TREE, "balls", "ball_radii"])

    return kept(dealt.mapInArrow(assemble, "shard long, ids array<long>, width int, flat array<long>, q_rows array<long>, q_ids array<long>, "
                                 "q_copies array<long>, q_flat array<long>, centres array<double>, radii array<double>, begins array<long>, ends array<long>, parents array<long>, "
                                 "balls array<double>, ball_radii array<double>"), "shards")


TREE = ["centres", "radii", "begins", "ends", "parents"]
FOUND = "block long, place long, query_id long, copies long, vec_id long, score long"


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("place").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _standing(blocks: DataFrame, best: DataFrame, k: int) -> DataFrame:
    """``blocks`` (of ``packed_shards``, those with queries) with the k-th scores of the queries that have k."""
    reached = best.groupBy("block", "place").agg(F.count("*").alias("n"), F.min("score").alias("score")).where(F.col("n") >= k)
    reached = reached.groupBy("block").agg(F.collect_list(F.struct("place", "score")).alias("r"))  # the queries of a shard
    return blocks.join(reached.select("block", F.col("r.place").alias("places"), F.col("r.score").alias("scores")), "block", "left")


def _least(places: np.ndarray, table: pa.Table | pa.RecordBatch, i: int) -> np.ndarray:
    reached = dict(zip(table.column("places")[i].as_py() or [], table.column("scores")[i].as_py() or [], strict=True))
    return np.array([reached.get(p, -np.inf) for p in places.tolist()], np.float64)


def _tree(batch: pa.RecordBatch, i: int) -> BallTree:
    centres, radii, begin, end, parent = (arrays(batch.column(c).slice(i, 1))[0] for c in TREE)
    return BallTree(centres.reshape(len(radii), len(centres) // len(radii)), radii, begin, end, parent)


def _places(shard: int, rows: np.ndarray) -> np.ndarray:
    return (shard << 32) + rows


def _found(block: int, places: np.ndarray, ids: np.ndarray, copies: np.ndarray, best: Best) -> pa.RecordBatch:
    q = best.query
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(q), block, np.int64)), *(pa.array(x) for x in (places[q], ids[q], copies[q], best.id, best.score))],
                                      names=[f.split()[0] for f in FOUND.split(", ")])


def most_reached(queries: np.ndarray, least: np.ndarray, balls: list[np.ndarray], radii: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of shards with their balls (first that of all rows, then those of the leaves), those that reach the least score of some
    query: which, for how many queries, and the highest bound."""
    width = max(queries.shape[1], *(b.shape[1] for b in balls))
    queries = fitted(queries, width)

    def bounds(chosen: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return upper_bounds(queries, np.concatenate([fitted(b, width) for b, _ in chosen]), np.concatenate([r for _, r in chosen]))

    whole = np.flatnonzero((bounds([(b[:1], r[:1]) for b, r in zip(balls, radii, strict=True)]) >= least[:, None]).any(axis=0))
    if not len(whole):
        return whole, whole, np.zeros(0)
    leaves = bounds([(balls[i][1:], radii[i][1:]) for i in whole])
    bound = np.maximum.reduceat(leaves, np.cumsum([0, *(len(radii[i]) - 1 for i in whole[:-1])]), axis=1)
    n = (bound >= least[:, None]).sum(axis=0)
    return whole[n > 0], n[n > 0], bound.max(axis=0)[n > 0]


def reaching(standing: DataFrame, balls: DataFrame, shards: int, blocks_together: int) -> DataFrame:
    """(block, shard, queries, bound): the shards with a leaf whose ball reaches the k-th score of some query of the block, other than
    its own; for how many queries, and the highest bound. A task holds the queries of ``blocks_together`` blocks, and the balls pass by."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, kinds, shard = (batch.column(c).to_numpy() for c in ("group", "kind", "shard"))
            edges = [0, *(np.flatnonzero((np.diff(keys) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if keys[a] != group:
                    group, held = keys[a], []
                if kinds[a] == 0:
                    for i in range(a, b):
                        places = _places(int(shard[i]), arrays(batch.column("q_rows").slice(i, 1))[0])
                        flat = arrays(batch.column("flat").slice(i, 1))[0]
                        queries = flat.reshape(len(places), len(flat) // len(places))
                        held.append((int(shard[i]), queries, _least(places, batch, i)))
                    continue
                centres, radii = (arrays(batch.column(c).slice(a, b - a)) for c in ("flat", "radii"))
                centres = [c.reshape(len(r), len(c) // len(r)) for c, r in zip(centres, radii, strict=True)]
                together = max(1, BALLS_AT_ONCE // max(map(len, radii)))
                for c in range(0, b - a, together):
                    for block, queries, least in held:
                        which, n, bound = most_reached(queries, least, centres[c:c + together], radii[c:c + together])
                        there = shard[a + c + which]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(there), block, np.int64)), pa.array(there), pa.array(n.astype(np.int64)), pa.array(bound)],
                                                         names=["block", "shard", "queries", "bound"])

    none, numbers = F.lit(None).cast("array<long>"), "array<double>"
    asking = standing.select((F.col("block") / blocks_together).cast("long").alias("group"), F.lit(0).alias("kind"), F.col("block").alias("shard"), "q_rows",
                             F.col("q_flat").cast(numbers).alias("flat"), none.cast(numbers).alias("radii"), "places", "scores")
    every_group = F.explode(F.sequence(F.lit(0).cast("long"), F.lit((shards - 1) // blocks_together).cast("long")))
    passing = balls.select(every_group.alias("group"), F.lit(1).alias("kind"), "shard", none.alias("q_rows"), F.col("balls").alias("flat"), F.col("ball_radii").alias("radii"), none.alias("places"), none.alias("scores"))
    meet = asking.unionByName(passing).repartition("group").sortWithinPartitions("group", "kind", "shard")
    return meet.mapInArrow(choose, "block long, shard long, queries long, bound double").where("block <> shard")


def top_k(vectors: DataFrame, every: int = 20, k: int = 20, scale: float = 64, shard_rows: int = SHARD_ROWS, leaf_rows: int = LEAF_ROWS,
          together: int = SHARDS_TOGETHER, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every``, the ``k`` other rows with the highest inner
    products, ties to smaller ids (all rows, if they are fewer).

    Rows with a null id or vector, or with null or non-finite components, take no part. Shorter vectors count as if filled up with
    zeros. Ids may repeat: each such row is a query and a candidate of its own, and repeated queries share a ranking per id
    and row. Components times ``scale`` must stay within 2^31 for scores to fit 64 bits. An empty table gives no rows.
    """
    packed = packed_shards(whole_numbers(vectors, scale, id_col, vector_col), every, k, shard_rows, leaf_rows)

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, shard in enumerate(batch.column("shard").to_pylist()):
                ids, flat, rows, copies = (arrays(batch.column(c).slice(i, 1))[0] for c in ("ids", "flat", "q_rows", "q_copies"))
                matrix, best = flat.reshape(len(ids), len(flat) // len(ids)), Best(len(rows), k, np.full(len(rows), -np.inf))
                places = _places(shard, np.arange(len(ids)))
                search(_tree(batch, i), matrix, ids, places, matrix[rows], places[rows], best)
                yield _found(shard, places[rows], ids[rows], copies, best)

    def abroad(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            for i in range(batch.num_rows):
                shard, kind = batch.column("shard")[i].as_py(), batch.column("kind")[i].as_py()
                ids, flat, rows, copies = (arrays(batch.column(c).slice(i, 1))[0] for c in ("ids", "flat", "q_rows", "q_copies"))
                matrix = flat.reshape(len(ids), batch.column("width")[i].as_py())
                if kind == 0:  # the queries of a block, and where they stand
                    if best is not None:
                        yield _found(*at, best)
                    at, queries = (shard, _places(shard, rows), ids, copies), matrix
                    best = Best(len(ids), k, _least(at[1], batch, i))
                else:
                    search(_tree(batch, i), matrix, ids, _places(shard, np.arange(len(ids))), queries, at[1], best)
        if best is not None:
            yield _found(*at, best)

    best = kept(_best(packed.select("shard", "ids", "flat", "q_rows", "q_copies", *TREE).where(F.size("q_rows") > 0).mapInArrow(at_home, FOUND), k).drop("rank"), "home")
    size = packed.agg(F.count("*").alias("n"), F.max("shard").alias("last"), F.max(F.size("q_rows")).alias("most")).first()
    if size["n"] > 1 and size["most"]:
        blocks = packed.where(F.size("q_rows") > 0).select(F.col("shard").alias("block"), "width", "q_rows", "q_ids", "q_copies", "q_flat")
        balls, none = packed.select("shard", "balls", "ball_radii"), F.lit(None).cast("array<long>")
        done = None
        for promising in (True, False):
            standing = _standing(blocks, best, k)
            pairs = reaching(standing, balls, size["last"] + 1, max(1, QUERIES_AT_ONCE // size["most"]))
            if done is not None:
                pairs = pairs.join(done.select("block", "shard"), ["block", "shard"], "left_anti")
            order = F.row_number().over(Window.partitionBy("block").orderBy(F.desc("queries"), F.desc("bound"), "shard")) - 1
            pairs = pairs.withColumn("order", order).withColumn("turn", (F.col("order") / together).cast("int"))
            pairs = kept(pairs.where("turn = 0") if promising else pairs, "pairs")
            asking = pairs.select("block", "turn").distinct().join(standing, "block").select(
                "block", "turn", F.lit(0).alias("kind"), F.lit(-1).alias("order"), F.col("block").alias("shard"), F.col("q_ids").alias("ids"), "width", F.col("q_flat").alias("flat"),
                "q_rows", "q_copies", "places", "scores", *[none.cast(packed.schema[c].dataType).alias(c) for c in TREE])
            asked = pairs.join(packed.select("shard", "ids", "width", "flat", *TREE), "shard").select(
                "block", "turn", F.lit(1).alias("kind"), "order", "shard", "ids", "width", "flat", *[none.alias(c) for c in ("q_rows", "q_copies", "places", "scores")], *TREE)
            meet = asking.unionByName(asked).repartition("block", "turn").sortWithinPartitions("block", "turn", "kind", "order")
            best = kept(_best(best.unionByName(meet.mapInArrow(abroad, FOUND)), k).drop("rank"), "best")
            done = pairs
    ranked = _best(best, k).withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return ranked.select("query_id", "rank", "vec_id", "score")
