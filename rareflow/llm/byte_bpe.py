"""Byte-level BPE from a file of ranks: whole texts to ids with offsets, and ids back to bytes and text.

The ``tokenizers`` library merges characters, so each of the 256 byte values stands as one printable character (the byte
table). Its merges follow from the ranks: a token is made of the two parts that are left when the merges of lower rank have
been applied to its bytes. Each match of the pattern is merged by itself. Texts come in Arrow batches, and the library sees each
distinct unit between two single white spaces once (``tokens``), since a match always begins there; the ids of a text are those of its units.

Decoding looks up the bytes of each id and joins them before any character is read: a character may be split over ids, and
over the portions in which ids arrive.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rareflow.llm.common import parts, texts
from rareflow.llm.grouped import arrays, lists
from rareflow.llm.tokens import UnitEncoder


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their rank, which is the id: a line each, base64 and number."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def byte_table() -> list[str]:
    """A printable character for each byte value: bytes that print in Latin-1 as themselves, the others, ascending, from U+0100 on."""
    prints = [33 <= b <= 126 or 161 <= b <= 172 or b >= 174 for b in range(256)]
    others = iter(range(256, 512))
    return [chr(b) if p else chr(next(others)) for b, p in enumerate(prints)]


def merges(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The two parts of each token of more than one byte, by ascending rank."""
    out = []
    for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
        if len(token) > 1:
            left = [token[i:i + 1] for i in range(len(token))]
            while len(left) > 2:
                found = [(ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(left, left[1:], strict=False))]
                best, i = min(found)
                if best >= rank:
                    raise ValueError(f"no two parts of lower rank make up token {rank}")
                left[i:i + 2] = [left[i] + left[i + 1]]
            out.append((left[0], left[1]))
    return out


class ByteBpe:
    """Encoder and decoder of one file of ranks."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks, char = read_ranks(path), byte_table()
        spelt = {token: "".join(char[b] for b in token) for token in ranks}
        library = Tokenizer(models.BPE(vocab={spelt[t]: i for t, i in ranks.items()}, merges=[(spelt[a], spelt[b]) for a, b in merges(ranks)], ignore_merges=True))
        library.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.units = UnitEncoder(library)
        byte = {c: b for b, c in enumerate(char)}
        size = max(ranks.values()) + 1
        #: The bytes of each id (an id without a token has none), and how many they are.
        self.bytes_of = [b""] * size
        for text, i in library.get_vocab().items():
            self.bytes_of[i] = bytes(byte[c] for c in text)
        self.length_of = np.array([len(b) for b in self.bytes_of], np.int64)

    def encode(self, items: list[bytes]) -> list[np.ndarray]:
        """The ids of each text. Bytes that are no UTF-8 are read as U+FFFD."""
        ids, edge = self.units.encode(items)
        return [ids[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The ids' bytes, joined."""
        return b"".join([self.bytes_of[i] for i in ids.tolist()])

    def decode_text(self, portions: Iterable[np.ndarray]) -> str:
        """The text of ids that arrive in portions; a character may be split over ids and portions. What is no UTF-8 gives U+FFFD."""
        read = codecs.getincrementaldecoder("utf-8")("replace")
        return "".join([read.decode(self.decode(ids)) for ids in portions] + [read.decode(b"", True)])

    def offsets(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First character of each id's bytes, and the one after their last: ids that share a character both cover it."""
        data = np.frombuffer(self.decode(ids), np.uint8)
        character = np.cumsum((data & 0xC0) != 0x80) - 1
        upto = np.cumsum(self.length_of[ids])
        return character[upto - self.length_of[ids]], character[upto - 1] + 1


_CODECS: dict[tuple[str, str], ByteBpe] = {}


def codec(path: str, pattern: str) -> ByteBpe:
    """The worker's codec for a file of ranks; built once."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = ByteBpe(path, pattern)
    return _CODECS[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, starts, ends) of every row: token ids and, in characters, where each begins and ends.

    A null or empty text has no ids. Repeated rows and rows with a null id give a row each; an empty table gives none.
    Columns of other names are not read, whatever they are called.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            for rows, items in parts(batch):
                ids = list(bpe.encode(items))
                spans = [bpe.offsets(i) for i in ids]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), lists(ids, pa.int32()), *[lists([s[k] for s in spans], pa.int32()) for k in (0, 1)]],
                                                 names=["doc_id", "ids", "starts", "ends"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids): ids that don't make up whole characters give U+FFFD; null ids are none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            found = [bpe.decode_text([ids]) for ids in arrays(batch.column("ids"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string())], names=["doc_id", "text"])

    return encoded.selectExpr("cast(doc_id as long) as doc_id", "coalesce(ids, array()) as ids").mapInArrow(run, "doc_id long, text string")


def round_trips(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: digests of its ids as little-endian unsigned 32-bit integers and of
    the bytes that they decode to. Encoded and decoded part by part in one pass; odd rows as in ``encode``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            for rows, items in parts(batch):
                count, own, back = [], [], []
                for ids in bpe.encode(items):
                    count.append(len(ids))
                    own.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    back.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(count, pa.int64()), pa.array(own), pa.array(back)],
                                                 names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
