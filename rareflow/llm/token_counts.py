"""Exact token counts of whole texts, huge ones included: overlap resynchronisation.

A long text is encoded as chunks that overlap. Where two chunks overlap, both have token boundaries with
offsets into the text; a boundary that both have, and across which no merge can ever happen, is a proven
place to splice: what stands left of it is counted from the left chunk, the rest from the right one. If an
overlap holds no such boundary it is widened, up to the whole left chunk, which then doubles, up to the whole rest of the text.

Proof of a splice. A byte-pair merge makes a vocabulary piece, so two neighbouring characters that stand
side by side in no piece are never merged, and what lies left and right of them is segmented independently.
The model must leave characters as they are (no normalisation but the space mark), which is checked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rareflow.llm.common import texts

MARK = "▁"  # stands for a space inside pieces
#: Characters of a chunk and of the first overlap.
CHUNK, OVERLAP = 1 << 15, 256


class PieceCounter:
    """Counts tokens with a SentencePiece BPE model, chunk by chunk where a text is long."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        if not 0 < overlap < chunk:
            raise ValueError("an overlap must be shorter than a chunk")
        from sentencepiece import SentencePieceProcessor

        self.model, self.chunk, self.overlap = SentencePieceProcessor(model_file=path), chunk, overlap
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.length = np.array([1 if self.model.is_byte(i) else len(p.replace(MARK, " ").encode())
                                for i, p in enumerate(pieces)], np.int64)
        inside = {p[i:i + 2].replace(MARK, " ") for p in pieces for i in range(len(p) - 1)}
        self.inside = np.array(sorted(ord(a) << 32 | ord(b) for a, b in inside), np.int64)  # pairs of characters that a merge may cross
        probe = "a  éﬁＡ b\t\n "
        if self.model.decode(self.model.encode(probe)) != probe:
            raise ValueError("the model changes characters; chunks of its texts cannot be spliced")

    def ends(self, text: str) -> np.ndarray:
        """Byte offset in ``text`` at which each token ends (the model puts one space before the text)."""
        ids = np.array(self.model.encode(text), np.int64)
        return np.cumsum(self.length[ids]) - 1

    def splice(self, head: str, left_ends: np.ndarray, right_ends: np.ndarray) -> tuple[int, int] | None:
        """(tokens of the left chunk, tokens of the right one) up to a stable boundary that both have in the characters ``head`` that they
        share, the one nearest to its middle; ends are byte offsets from the beginning of ``head``. None if there is no such boundary."""
        code = np.frombuffer(head.encode("utf-32-le"), np.uint32).astype(np.int64)
        size = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        place = np.cumsum(size)[:-1]  # byte offset before each character but the first
        good = ~np.isin(code[:-1] << 32 | code[1:], self.inside) & np.isin(place, np.intersect1d(left_ends, right_ends))
        found = np.flatnonzero(good)
        if not len(found):
            return None
        at = place[found[np.argmin(np.abs(found - len(head) // 2))]]
        return int(np.searchsorted(left_ends, at, "right")), int(np.searchsorted(right_ends, at, "right"))

    def count(self, text: str) -> int:
        """Tokens of a text. Every character is encoded a bounded number of times: an overlap is widened fourfold, a chunk in which even that finds no
        splice doubles."""
        text = text.replace(MARK, " ")  # the model reads the mark as a space
        if len(text) <= self.chunk:
            return len(self.model.encode(text))
        total, begin, used = 0, 0, 0  # used: tokens of the current chunk that lie left of its splice
        end = self.chunk
        ends = self.ends(text[:end])
        while end < len(text):
            shared, found = self.overlap, None
            while True:
                shared = min(shared, end - begin - 1)
                start, stop = end - shared, min(len(text), max(end - shared + self.chunk, end + shared))
                right = self.ends(text[start:stop])
                base = len(text[begin:start].encode())
                found = self.splice(text[start:end], ends - base, right)
                if found or shared == end - begin - 1:
                    break
                shared *= 4
            if found:
                total += found[0] - used
                begin, end, used, ends = start, stop, found[1], right
            else:  # nothing to splice at
                end = min(len(text), begin + 2 * (end - begin))
                ends = self.ends(text[begin:end])
        return total + len(ends) - used


_COUNTERS: dict[tuple, PieceCounter] = {}


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, chunk: int = CHUNK, overlap: int = OVERLAP,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row; no begin, end or other added tokens.

    A null text counts as empty (0 tokens), repeated rows are counted each, other columns are not read, and an
    empty table gives no rows. One pass without a shuffle; a worker holds a batch and the token
    ends of two chunks, which are as long as the stretch without a splice that they cover: a text without any is held whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (model_path, chunk, overlap)
        if key not in _COUNTERS:
            _COUNTERS[key] = PieceCounter(*key)
        counter = _COUNTERS[key]
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            items = batch.column("text").to_pylist()
            short = [i for i, t in enumerate(items) if len(t) <= chunk]
            for k in range(0, len(short), 256):
                part = short[k:k + 256]
                n[part] = [len(x) for x in counter.model.encode([items[i] for i in part], num_threads=1)]
            for i in (i for i, t in enumerate(items) if len(t) > chunk):
                n[i] = counter.count(items[i])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n)],
                                             names=["doc_id", "n_bytes", "n_tokens"])

    rows = texts(docs, id_col, text_col).withColumn("n_bytes", F.octet_length("text").cast("long"))
    counted = rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
