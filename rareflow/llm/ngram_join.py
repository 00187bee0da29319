"""Near-duplicate groups by the Jaccard similarity of word n-gram sets: a T-occurrence join with DivideSkip.

Two sets of sizes a and b are similar enough only if they share T of their n-grams. The join never looks at
n-grams that a single document has, and asks for each document which others occur often enough in the inverted lists
of its n-grams:

1. Sets are made batch by batch, and n-grams are dealt to buckets as packed arrays to be counted. N-grams met
   twice go back to their documents; a document of which too few n-grams are shared can have no partner.
2. Equal sets become one representative. Its n-grams are ordered by rarity; a partner must share one of the first
   few (all but T - 1). Documents that share such a rare n-gram meet in blocks of bounded size around a central
   document, which every block of its group holds.
3. In a block, each document asks the others: the short inverted lists of its n-grams are merged with a heap, which
   counts how often each candidate occurs; the long ones are probed by binary search for the candidates that can still
   reach the threshold. Found links join classes; a document stops asking a class that it has joined.
4. Rare n-grams that are still shared across classes send their documents, in bounded portions, to the other blocks that hold
   them, where they ask in the same way. So every pair of similar representatives is either compared or already joined.
5. Components of all links are the groups.

An n-gram travels as 48 bits of its fingerprint and the number of its bucket, of which there are eight for each shuffle partition. Among n distinct
n-grams of a corpus, n^2 / (2^49 * buckets) pairs are confused by chance (with 1,600 buckets: 28 of the five billion n-grams of 30 GB).
Such a pair adds one to the overlap of two documents that have one of them each, so it only matters where they are exactly one
n-gram short of the limit. Equal sets are told by 128-bit digests of all their 64-bit fingerprints.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from itertools import groupby
from math import log2

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rareflow.llm.common import kept, partitions, parts, texts
from rareflow.llm.components import components
from rareflow.llm.grouped import arrays, groups, lists
from rareflow.llm.shingles import shingle_sets

#: Weight of a list's logarithm in DivideSkip's choice of the long lists.
MU = 0.0085
#: N-grams of the documents in a block, on average at most, and of a portion of those that ask.
BLOCK_GRAMS = 1 << 16
#: Bytes of text whose sets are made at once, and documents at most (they are numbered with 16 bits).
BATCH_BYTES, BATCH_DOCS = 8 << 20, 1 << 16
_LOW = np.uint64((1 << 48) - 1)


def least_shared(n: int, similarity: tuple[int, int]) -> int:
    """T: n-grams that a set of ``n`` shares with any similar set, at least."""
    num, den = similarity
    return -(-num * n // den)


class BlockIndex:
    """Inverted lists of the sets in a block."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        flat = np.concatenate([np.zeros(0, np.int64), *sets])
        doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(flat, kind="stable")
        self.grams, first = np.unique(flat[order], return_index=True)
        self.docs, self.sizes = doc[order], sizes
        self.begin, self.end = first, np.append(first[1:], len(flat))

    def search(self, grams: np.ndarray, size: int, similarity: tuple[int, int], asked: np.ndarray) -> Iterator[tuple[int, int]]:
        """(document, overlap) of each document in ``asked`` (a mask that the caller may narrow meanwhile) that is similar
        to the set, of which ``grams`` are the members that others can share."""
        num, den = similarity
        at = np.minimum(np.searchsorted(self.grams, grams), max(len(self.grams) - 1, 0))
        at = at[self.grams[at] == grams] if len(self.grams) else at[:0]
        length = self.end[at] - self.begin[at]
        at = at[np.argsort(length, kind="stable")]
        need = least_shared(size, similarity)
        if len(at) < need:
            return
        longest = self.end[at[-1]] - self.begin[at[-1]]
        skipped = min(need - 1, int(need / (MU * log2(longest + 1) + 1)))
        spans = [(int(self.begin[i]), int(self.end[i])) for i in at]
        short, long = spans[:len(spans) - skipped], spans[len(spans) - skipped:]
        found, count = [], []
        for doc, same in groupby(heapq.merge(*[self.docs[a:b].tolist() for a, b in short])):
            n = sum(1 for _ in same)
            if n >= need - skipped:
                found.append(doc)
                count.append(n)
        found, count = np.array(found, np.int64), np.array(count, np.int64)
        enough = -(-num * (size + self.sizes[found]) // (num + den))
        order = np.argsort(-count, kind="stable")
        found, count, enough = found[order], count[order], enough[order]
        for a in [0, *range(1, len(found), 64)]:  # the best first: often it settles the rest
            b = 1 if a == 0 else a + 64
            live = np.flatnonzero(asked[found[a:b]]) + a
            have = count[live]
            for k, (lo, hi) in enumerate(long):
                ok = have + (len(long) - k) >= enough[live]
                if not ok.all():
                    live, have = live[ok], have[ok]
                if not len(live):
                    break
                docs = self.docs[lo:hi]
                place = np.minimum(np.searchsorted(docs, found[live]), hi - lo - 1)
                have = have + (docs[place] == found[live])
            ok = have >= enough[live]
            yield from zip(found[live[ok]].tolist(), have[ok].tolist(), strict=True)


class Classes:
    """Union-find over 0..n-1 that knows each node's class as an array."""

    def __init__(self, label: np.ndarray):
        self.of = np.unique(label, return_inverse=True)[1]

    def join(self, a: int, b: int) -> None:
        x, y = self.of[a], self.of[b]
        if x != y:
            self.of[self.of == max(x, y)] = min(x, y)


def shared_sets(docs: DataFrame, size: int, similarity: tuple[int, int]) -> DataFrame:
    """(row, doc_id, n, print, grams): ``grams`` is null unless so many of a document's n-grams occur in other documents
    that it can have a partner; then it has those, the rarest first."""
    spark = docs.sparkSession
    buckets = np.uint64(8 * partitions(spark))
    schema = "bucket long, batch long, kind int, ids array<long>, sizes array<int>, prints array<binary>, docs binary, grams binary"

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 20
        for batch in batches:
            for part, items in parts(batch, size=BATCH_BYTES):
                for a in range(0, len(items), BATCH_DOCS):
                    b = min(len(items), a + BATCH_DOCS)
                    sets = shingle_sets(items[a:b], size)
                    number += 1
                    prints = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                    flat = np.concatenate(sets)
                    doc = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(s) for s in sets])
                    bucket = ((flat >> np.uint64(32)) * buckets) >> np.uint64(32)
                    order = np.argsort(bucket.astype(np.uint16 if buckets <= 1 << 16 else np.uint64), kind="stable")
                    low, doc = flat[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6], doc[order]
                    names, first = np.unique(bucket[order], return_index=True)
                    last = [*first[1:].tolist(), len(flat)][:len(names)]
                    none = [None] * len(names)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(prints[0][0]) % int(buckets), *names.tolist()], pa.int64()), pa.array([number] * (len(names) + 1), pa.int64()),
                         pa.array([0] + [1] * len(names), pa.int32()),
                         pa.array([part.column("doc_id").slice(a, b - a).to_pylist(), *none], pa.list_(pa.int64())),
                         pa.array([[len(s) for s in sets], *none], pa.list_(pa.int32())), pa.array([prints, *none], pa.list_(pa.binary())),
                         pa.array([None, *[doc[i:j].tobytes() for i, j in zip(first.tolist(), last, strict=True)]], pa.binary()),
                         pa.array([None, *[low[i:j].tobytes() for i, j in zip(first.tolist(), last, strict=True)]], pa.binary())],
                        names=["bucket", "batch", "kind", "ids", "sizes", "prints", "docs", "grams"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket,), rows in groups(batches, ["bucket"]):
            kind = rows.column("kind").to_numpy()
            if (kind == 0).any():
                yield from rows.filter(pa.array(kind == 0)).append_column("often", pa.nulls((kind == 0).sum(), pa.binary())).to_batches()
            rows = rows.filter(pa.array(kind == 1))
            if not rows.num_rows:
                continue
            blobs = rows.column("grams").to_pylist()
            wide = np.zeros((sum(map(len, blobs)) // 6, 8), np.uint8)
            wide[:, :6] = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 6)
            grams = wide.view("<u8").ravel().astype(np.uint64)
            _, back, times = np.unique(grams, return_inverse=True, return_counts=True)
            often = np.minimum(times, 0xFFFF).astype(np.uint16)[back]
            grams |= np.uint64(bucket) << np.uint64(48)
            at, out = 0, []
            for batch, docs_, blob in zip(rows.column("batch").to_pylist(), rows.column("docs").to_pylist(), blobs, strict=True):
                n = len(blob) // 6
                k = np.flatnonzero(often[at:at + n] > 1)
                if len(k):
                    out.append((batch, np.frombuffer(docs_, np.uint16)[k].tobytes(), grams[at:at + n][k].tobytes(), often[at:at + n][k].tobytes()))
                at += n
            none = pa.nulls(len(out))
            yield pa.RecordBatch.from_arrays(
                [pa.array([bucket] * len(out), pa.int64()), pa.array([x[0] for x in out], pa.int64()), pa.array([1] * len(out), pa.int32()),
                 none.cast(pa.list_(pa.int64())), none.cast(pa.list_(pa.int32())), none.cast(pa.list_(pa.binary())),
                 *[pa.array([x[i] for x in out], pa.binary()) for i in (1, 2, 3)]],
                names=["bucket", "batch", "kind", "ids", "sizes", "prints", "docs", "grams", "often"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (batch,), rows in groups(batches, ["batch"]):
            kind = rows.column("kind").to_numpy()
            about = rows.filter(pa.array(kind == 0))
            rows = rows.filter(pa.array(kind == 1))
            doc, grams, often = (np.frombuffer(b"".join(rows.column(c).to_pylist()), k) for c, k in (("docs", np.uint16), ("grams", np.uint64), ("often", np.uint16)))
            order = np.lexsort((grams, often, doc))
            doc, grams = doc[order], grams[order]
            ids, sizes = about.column("ids")[0].values, about.column("sizes")[0].values.to_numpy()
            edge = np.searchsorted(doc, np.arange(len(ids) + 1))
            fits = np.array([n > 0 and b - a >= least_shared(n, similarity) for n, a, b in zip(sizes.tolist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True)], bool)
            own = [grams[a:b].view(np.int64) if f else grams[:0].view(np.int64) for f, a, b in zip(fits, edge[:-1], edge[1:], strict=True)]
            column = lists(own, pa.int64())
            column = pa.ListArray.from_arrays(column.offsets, column.values, mask=pa.array(~fits))
            yield pa.RecordBatch.from_arrays(
                [pa.array((batch << 16) + np.arange(len(ids))), ids, pa.array(sizes.astype(np.int64)), about.column("prints")[0].values, column],
                names=["row", "doc_id", "n", "print", "grams"])

    dealt = docs.mapInArrow(scatter, schema).repartition("bucket").sortWithinPartitions("bucket")
    counted = dealt.mapInArrow(count, schema + ", often binary").repartition("batch").sortWithinPartitions("batch")
    return counted.mapInArrow(gather, "row long, doc_id long, n long, print binary, grams array<long>")


def _within(batches: Iterator[pa.RecordBatch], similarity: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """(row, class) of each block's own rows; the central row's class carries its name."""
    for (key, _), rows in groups(batches, ["key", "sub"]):
        row, sizes, sets = rows.column("row").to_numpy(), rows.column("n").to_numpy(), arrays(rows.column("grams"))
        index, classes = BlockIndex(sets, sizes), Classes(np.arange(len(row)))
        for i in range(len(row)):
            asked = classes.of != classes.of[i]
            asked[i:] = False
            for j, _ in index.search(sets[i], int(sizes[i]), similarity, asked):
                classes.join(i, j)
                asked &= classes.of != classes.of[i]
        least = {}
        for c, r in zip(classes.of.tolist(), row.tolist(), strict=True):
            least[c] = key if key in (r, least.get(c)) else min(r, least.get(c, r))
        home = rows.column("home").to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array(row[home]), pa.array(np.array([least[c] for c in classes.of[home].tolist()], np.int64))], names=["row", "class"])


def _across(batches: Iterator[pa.RecordBatch], similarity: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) between the rows that ask and a block's own rows, unless they are of one class already."""
    for _, rows in groups(batches, ["key", "sub", "portion"]):
        row, sizes, sets = rows.column("row").to_numpy(), rows.column("n").to_numpy(), arrays(rows.column("grams"))
        home = rows.column("home").to_numpy(zero_copy_only=False)
        own = np.flatnonzero(home)
        index, classes = BlockIndex([sets[i] for i in own], sizes[own]), Classes(rows.column("class").to_numpy())
        links = []
        for i in np.flatnonzero(~home):
            asked = classes.of[own] != classes.of[i]
            if asked.any():
                for j, _ in index.search(sets[i], int(sizes[i]), similarity, asked):
                    if asked[j]:
                        links.append((row[i], row[own[j]]))
                        classes.join(i, own[j])
                        asked &= classes.of[own] != classes.of[i]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])


def similar_groups(docs: DataFrame, size: int = 5, similarity: tuple[int, int] = (80, 100), block_grams: int = BLOCK_GRAMS,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; ``component_id`` is the smallest id of its group.

    Rows link when the Jaccard similarity of their n-gram sets is ``similarity`` (a fraction: numerator, denominator) or
    more; rows with equal sets always do. A text with fewer words than ``size`` has its word sequence as one n-gram; a null,
    empty or wordless text has none, links with nothing and is a group of its own, as is a row with a null id and no partner.
    Ids may repeat; rows are told apart by their place. An empty table gives no rows. No pair is dropped: every limit here
    only cuts work into portions.
    """
    num, den = similarity
    if not 0 < num <= den:
        raise ValueError("the similarity must be above 0 and at most 1")
    sets = kept(shared_sets(texts(docs, id_col, text_col), size, similarity), "sets")
    likely = sets.where("grams is not null")
    reps = likely.groupBy("print").agg(F.min("row").alias("row"))
    reps = kept(likely.select("row", "n", "grams").join(reps.select("row"), "row"), "representatives")
    need = F.ceil(F.col("n") * num / den)
    rare = F.expr("slice(grams, 1, cast(greatest(size(grams) - need + 1, 0) as int))")
    posted = reps.withColumn("need", need).select("row", ((F.col("n") - F.size("grams")) / F.col("n")).alias("novel"), F.size("grams").alias("m"), F.explode(rare).alias("gram"))
    shared = posted.groupBy("gram").agg(F.count("*").alias("many"), F.min(F.struct("novel", "row")).alias("centre")).where("many > 1")
    posted = kept(posted.join(shared.select("gram", "centre"), "gram"), "postings")

    keyed = posted.groupBy("row").agg(F.min("centre")["row"].alias("key"), F.first("m").alias("m"))
    subs = keyed.groupBy("key").agg(F.ceil(F.sum("m") / block_grams).cast("int").alias("subs"))
    home = keyed.join(subs, "key").select("row", "key", F.pmod(F.xxhash64("row"), F.col("subs")).cast("int").alias("sub"))
    home = kept(home, "blocks")
    centres = subs.select(F.col("key").alias("row"), "key", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"))
    guests = centres.join(home, ["row", "key", "sub"], "left_anti").withColumn("home", F.lit(False))
    members = home.withColumn("home", F.lit(True)).unionByName(guests).join(reps, "row")
    members = members.repartition("key", "sub").sortWithinPartitions("key", "sub", "row")
    classes = kept(members.mapInArrow(lambda b: _within(b, similarity), "row long, class long"), "classes")

    placed = posted.select("gram", "row", "m").join(home, "row").join(classes, "row")
    split = placed.groupBy("gram").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi").select("gram")
    placed = kept(placed.join(split, "gram"), "split")
    held = placed.groupBy("gram", "key", "sub").agg(F.min("class").alias("lo"), F.max("class").alias("hi"))
    held = held.select("gram", F.col("key").alias("to_key"), F.col("sub").alias("to_sub"), "lo", "hi")
    asks = placed.join(held, "gram").where("struct(key, sub) < struct(to_key, to_sub) and not (lo = hi and lo = class)")
    asks = kept(asks.groupBy("row", "to_key", "to_sub").agg(F.first("m").alias("m"), F.first("class").alias("class")), "asks")
    portions = asks.groupBy("to_key", "to_sub").agg(F.ceil(F.sum("m") / block_grams).cast("int").alias("portions"))
    askers = asks.join(portions, ["to_key", "to_sub"]).select(
        "row", F.col("to_key").alias("key"), F.col("to_sub").alias("sub"), F.pmod(F.xxhash64("row"), F.col("portions")).cast("int").alias("portion"), "class", F.lit(False).alias("home"))
    hosts = home.join(portions.select(F.col("to_key").alias("key"), F.col("to_sub").alias("sub"), "portions"), ["key", "sub"]).join(classes, "row").select(
        "row", "key", "sub", F.explode(F.sequence(F.lit(0), F.col("portions") - 1)).alias("portion"), "class", F.lit(True).alias("home"))
    meet = askers.unionByName(hosts).join(reps, "row").repartition("key", "sub", "portion").sortWithinPartitions("key", "sub", "portion", "row")
    links = meet.mapInArrow(lambda b: _across(b, similarity), "a long, b long")

    found = components(classes.select(F.col("row").alias("a"), F.col("class").alias("b")).unionByName(links))
    named = likely.groupBy("print").agg(F.min("row").alias("node"), F.min("doc_id").alias("least"))
    named = named.join(found, "node", "left").select("print", F.coalesce("component", "node").alias("component"), "least")
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(ids, "component").select("print", "component_id")
    grouped = likely.select("doc_id", "n", "print").join(named, "print")
    alone = sets.where("grams is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return grouped.select("doc_id", "n", "component_id").unionByName(alone).withColumnRenamed("n", "n_shingles")
