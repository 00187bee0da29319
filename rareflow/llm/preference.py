"""A quality classifier learnt from preferences: Bradley-Terry scores by logistic loss on feature differences.

Each document with label 1 is preferred to documents with label 0. With scores w.x, the chance that a preference holds is
1 / (1 + exp(-(w.x1 - w.x0))), so w is fitted to differences of features and needs no intercept. The threshold is a quantile
of the training scores: the share of label 0 lies below it. A score is shown as a number from 0 to 1 that is CUT at the threshold.
Every labelled document takes part: they are dealt into blocks with both labels, whose preferences tasks sum up, step by step.
Features come from the text alone: lengths, shares of character classes, repetition, and hashed word frequencies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rareflow.llm.common import in_small_batches, kept, parts, pieces, texts
from rareflow.llm.grouped import arrays, groups, lists
from rareflow.llm.shingles import BLOCK, mix, word_prints
from rareflow.operators.ordered import global_row_number, prefix_sum

#: Labelled rows of a block, within which preferences are formed, and preferences for each row of the more frequent label.
BLOCK_ROWS, PAIRS_EACH = 1024, 4
#: What a score at the threshold is shown as.
CUT = 0.7
HASHED = 64
# Classes of bytes. Bytes in none are class 0.
_CLASSES = ["", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", ".,;:?'\"()-", "!", "#*$%&<>~^_=+@/\\", "|", "\n", " \t\r\x0b\x0c"]
_CLASS_OF = np.zeros(256, np.int64)
for _k, _chars in enumerate(_CLASSES):
    _CLASS_OF[list(_chars.encode())] = _k
_CLASS_OF[128:] = len(_CLASSES)
_KINDS = len(_CLASSES) + 1
_LENGTHS = (1, 5, 10, 20, 40, 100, 400)
N_FEATURES = 10 + _KINDS + len(_LENGTHS) + HASHED


def _repeats(doc: np.ndarray, prints: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct fingerprints of each document, and how often the commonest occurs."""
    key = np.sort(mix(prints + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(0xFFFFFFFFFF) | doc.astype(np.uint64) << np.uint64(40))
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))[:len(key)]
    owner, times = (key[first] >> np.uint64(40)).astype(np.int64), np.diff(np.append(first, len(key)))
    most = np.zeros(n)
    np.maximum.at(most, owner, times)
    return np.bincount(owner, minlength=n), most


def _block(items: list[bytes]) -> np.ndarray:
    n = len(items)
    data = b" ".join(items) + b" "
    size = np.array([len(x) for x in items])
    begin = np.cumsum(size + 1) - size - 1
    raw_bytes = np.frombuffer(data, np.uint8)
    owner = np.repeat(np.arange(n), size + 1)
    kinds = np.bincount(owner * _KINDS + _CLASS_OF[raw_bytes], minlength=n * _KINDS).reshape(n, _KINDS).astype(float)
    kinds[:, 9] -= 1  # the blank put after each text
    start, end, word = word_prints(data)
    doc = np.searchsorted(begin, start, "right") - 1
    words = np.bincount(doc, minlength=n)
    per = 1 / np.maximum(words, 1)
    share = lambda mask: np.bincount(doc[mask], minlength=n) * per
    length = end - start
    distinct, commonest = _repeats(doc, word, n)
    same = np.flatnonzero((word[1:] == word[:-1]) & (doc[1:] == doc[:-1])) + 1
    grams = (word[:-2] * np.uint64(3) + mix(word[1:-1]) * np.uint64(5) + mix(mix(word[2:])) * np.uint64(7)) if len(word) > 2 else word[:0]
    whole = doc[:-2] == doc[2:] if len(word) > 2 else np.zeros(0, bool)
    distinct3, _ = _repeats(doc[:len(grams)][whole], grams[whole], n)
    last = _CLASS_OF[raw_bytes[end - 1]] if len(end) else np.zeros(0, np.int64)
    head = _CLASS_OF[raw_bytes[start]] if len(start) else np.zeros(0, np.int64)
    hashed = np.bincount(doc * HASHED + (word % np.uint64(HASHED)).astype(np.int64), minlength=n * HASHED).reshape(n, HASHED) * per[:, None]
    columns = [np.log1p(words), np.log1p(size * per), distinct * per, commonest * per, np.bincount(doc[same], minlength=n) * per,
               distinct3 / np.maximum(words - 2, 1), share(length <= 3), share(length > 14), share((last >= 4) & (last <= 7)), share(head == 1)]
    return np.column_stack([*columns, np.sqrt(kinds / np.maximum(size, 1)[:, None]), words[:, None] < np.array(_LENGTHS), np.sqrt(hashed)])


def features(items: list[bytes]) -> np.ndarray:
    """A row of N_FEATURES numbers for each text."""
    with np.errstate(over="ignore"):
        return np.concatenate([np.zeros((0, N_FEATURES)), *[_block(items[a:b]) for a, b in pieces(items, BLOCK)]])


@dataclass(frozen=True)
class Ranker:
    """Weights of standardised features, and the score at the threshold."""

    centre: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    threshold: float

    def score(self, x: np.ndarray) -> np.ndarray:
        s = ((x - self.centre) / self.scale) @ self.weight - self.threshold + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(s, -700, 700)))


def _preferences(z: np.ndarray, label: np.ndarray, pairs_each: int) -> np.ndarray:
    """Differences of rows with label 1 and 0: ``pairs_each`` for each row of the more frequent label."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    k = np.arange(pairs_each * max(len(good), len(bad)))
    turn = k // min(len(good), len(bad))  # shifts the pairing from round to round
    return z[good[(k + turn * (len(good) < len(bad))) % len(good)]] - z[bad[(k + turn * (len(good) >= len(bad))) % len(bad)]]


def _terms(diff: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Of some preferences: their number, and the sums of their losses, gradients and Hessians, in a row."""
    margin = diff @ w
    p = 1 / (1 + np.exp(np.clip(margin, -700, 700)))
    hessian = (diff * (p * (1 - p))[:, None]).T @ diff
    return np.concatenate([[len(diff), np.logaddexp(0, -margin).sum()], -(diff * p[:, None]).sum(axis=0), hessian.ravel()])


def _newton(terms: Callable[[np.ndarray], np.ndarray], width: int, ridge: float) -> np.ndarray:
    """The weights of the least mean loss plus ``ridge``; ``terms`` sums ``_terms`` over all preferences."""
    def measured(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        n, loss, rest = (t := terms(w))[0], t[1], t[2:]
        return loss / n + ridge / 2 * w @ w, rest[:width] / n + ridge * w, rest[width:].reshape(width, width) / n + ridge * np.eye(width)

    w = np.zeros(width)
    now, gradient, hessian = measured(w)
    for _ in range(50):
        step, rate = np.linalg.solve(hessian, gradient), 1.0
        found = measured(w - step)
        while rate > 1e-6 and found[0] > now:
            rate /= 2
            found = measured(w - rate * step)
        w = w - rate * step
        now, gradient, hessian = found
        if np.abs(rate * step).max() < 1e-6:
            break
    return w


def _indifferent(width: int) -> Ranker:
    """Without both labels there is no preference: all weights are 0, and every text scores CUT."""
    return Ranker(np.zeros(width), np.ones(width), np.zeros(width), 0.0)


def _some(scale: np.ndarray) -> np.ndarray:
    return np.where(scale > 1e-9, scale, 1.0)


def fit(x: np.ndarray, label: np.ndarray, pairs_each: int = PAIRS_EACH, ridge: float = 1e-3) -> Ranker:
    """Minimise the mean logistic loss of preferences plus ``ridge`` by Newton's method, for rows held as one block; ``learn`` does
    it for the blocks of a table."""
    if not (label == 1).any() or not (label == 0).any():
        return _indifferent(x.shape[1])
    centre, scale = x.mean(axis=0), _some(x.std(axis=0))
    z = (x - centre) / scale
    diff = _preferences(z, label, pairs_each)
    w = _newton(lambda w: _terms(diff, w), x.shape[1], ridge)
    return Ranker(centre, scale, w, float(np.quantile(z @ w, (label == 0).sum() / ((label == 0).sum() + (label == 1).sum()))))


def held_out(doc_id: Column) -> Column:
    """Rows that take no part in learning."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _blocks(rows: DataFrame, counts: dict[int, int], block: int) -> DataFrame:
    """Rows (doc_id, label, x) as one row per block of about ``block`` of them: (label, own, x), x row after row. In hash order of the ids, each block
    gets its share of both labels; where a label has fewer rows than there are blocks, each row serves several, and is ``own`` in the first."""
    many = -(-sum(counts.values()) // block)
    tagged = global_row_number(rows.withColumn("_rf_print", F.xxhash64("x")), ["doc_id", "_rf_print"], partition_by=["label"], rows=sum(counts.values()))
    n = F.when(F.col("label") == 1, F.lit(counts[1])).otherwise(F.lit(counts[0]))
    tagged = tagged.withColumns({"n": n, "at": F.col("row_number") - 1, "many": F.lit(many)})
    first, last = "(at * many + n - 1) div n", "((at + 1) * many + n - 1) div n - 1"
    dealt = tagged.select("doc_id", "label", "x", F.posexplode(F.expr(f"if(n >= many, array(at * many div n), sequence({first}, {last}))")).alias("nth", "block"))
    dealt = dealt.select("block", "doc_id", "label", (F.col("nth") == 0).cast("int").alias("own"), "x").repartition("block")
    dealt = dealt.sortWithinPartitions("block", F.xxhash64("doc_id"), "doc_id", F.xxhash64("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groups(batches, ["block"]):
            label, own, x = (np.array(rows.column("label")), np.array(rows.column("own")), np.concatenate(arrays(rows.column("x"))))
            yield pa.RecordBatch.from_arrays([lists([label], pa.int32()), lists([own], pa.int32()), lists([x], pa.float64())], names=["label", "own", "x"])

    return kept(dealt.mapInArrow(run, "label array<int>, own array<int>, x array<double>"), "preference-blocks")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for label, own, x in zip(*(arrays(batch.column(c)) for c in ("label", "own", "x")), strict=True):
            yield label, own == 1, x.reshape(len(label), -1)


def _summed(blocks: DataFrame, part: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``part`` over all blocks; one row of sums per task reaches the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for block in _unpacked(batches):
            total = part(*block) if total is None else total + part(*block)
        if total is not None:
            yield pa.RecordBatch.from_arrays([lists([total], pa.float64())], names=["total"])

    return np.sum(arrays(blocks.mapInArrow(run, "total array<double>").toArrow().column("total")), axis=0)


def _quantile(scores: DataFrame, share: float, n: int) -> float:
    """The quantile of a column ``s`` of ``n`` rows, as numpy interpolates it, by running counts of its values."""
    at = share * (n - 1)
    low, high = int(at), min(int(at) + 1, n - 1)
    upto = prefix_sum(scores.groupBy("s").agg(F.count(F.lit(1)).alias("n")), "s", {"upto": "n"}, descending=False)
    a, b = upto.agg(*[F.min(F.when(F.col("upto") > i, F.col("s"))) for i in (low, high)]).first()
    return a + (b - a) * (at - low)


def learn(docs: DataFrame, labels: DataFrame, block: int = BLOCK_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          pairs_each: int = PAIRS_EACH, ridge: float = 1e-3) -> Ranker:
    """Fit on all labelled documents that are not held out. Labels other than 0 and 1, null ids and ids with labels that differ are left out.

    Features are computed before labels are joined, so texts are read where they lie and only rows of N_FEATURES numbers are shuffled; they are written in
    blocks. Each Newton step is a job over them, of which sums reach the driver; centre and scale are those of all rows, and the threshold is a quantile of all
    their scores. Rows of up to one block are fitted as by ``fit``."""
    marks = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("label"))
    marks = marks.where("doc_id is not null and label in (0, 1)").where(~held_out(F.col("doc_id")))
    marks = marks.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")
    rows = texts(docs, id_col, text_col).where("doc_id is not null").where(~held_out(F.col("doc_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, items in parts(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists(list(features(items)), pa.float64())], names=["doc_id", "x"])

    found = kept(rows.mapInArrow(run, "doc_id long, x array<double>").join(marks, "doc_id").select("doc_id", "label", "x"), "preference-features")
    counts = {0: 0, 1: 0, **dict(found.groupBy("label").count().collect())}  # a row per label
    if not counts[0] or not counts[1]:
        return _indifferent(N_FEATURES)
    blocks, n = _blocks(found, counts, block), sum(counts.values())
    centre = _summed(blocks, lambda label, own, x: x[own].sum(axis=0)) / n
    scale = _some(np.sqrt(_summed(blocks, lambda label, own, x: ((x[own] - centre) ** 2).sum(axis=0)) / n))
    w = _newton(lambda w: _summed(blocks, lambda label, own, x: _terms(_preferences((x - centre) / scale, label, pairs_each), w)), N_FEATURES, ridge)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own, x in _unpacked(batches):
            yield pa.RecordBatch.from_arrays([pa.array(((x[own] - centre) / scale) @ w)], names=["s"])

    scores = kept(blocks.mapInArrow(score, "s double"), "preference-scores")
    return Ranker(centre, scale, w, _quantile(scores, counts[0] / n, n))


def scored(docs: DataFrame, ranker: Ranker, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score of every whole text; a null text scores as an empty one, a column that has the
    score's name gives way to it, and an empty table stays empty. One pass without a shuffle."""
    rows = in_small_batches(docs).drop(score_col)
    name = text_col

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, items in parts(batch, name):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ranker.score(features(items)))], names=[*part.schema.names, score_col])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(score_col, T.DoubleType())]))
