"""Bounded-space online best-fit packing of token sequences.

Every partition packs its own documents in the order in which they come, with a fixed number of open bins. A bitset holds
a bit for every free space that some open bin has; the lowest bit at or above a piece's length names the best fit. Where
no bin fits and all are open, the fullest closes and a new one opens. Nothing is shuffled, and a partition that runs again
gives the same sequences, so lost executors cost only their partitions.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import encode_texts, slices

#: Pieces at whose bounds byte-level BPE always cuts: white space, or other characters after one blank at most. Unicode's
#: White_Space, which \s of re is not.
SPACE = r"\t-\r \x85\xa0  -     　"
BYTE_PIECES = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
PACKED = "doc_id long, piece int, start long, ids binary, sequence_id long, offset long"


class BestFit:
    """Online best fit into sequences of `size` with at most `open_bins` open ones."""

    def __init__(self, size: int, open_bins: int):
        self.size, self.open_bins = size, open_bins
        self.free = [[] for _ in range(size + 1)]  # by free space, the open bins that have it
        self.bits = self.open = self.made = 0

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece of this length."""
        fits = self.bits >> length << length
        if fits:
            space = (fits & -fits).bit_length() - 1
            b = self._take(space)
        else:
            if length < self.size and self.open == self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            b, space = self.made, self.size
            self.made += 1
        if left := space - length:
            self.free[left].append(b)
            self.bits |= 1 << left
            self.open += 1
        return b, self.size - space

    def _take(self, space: int) -> int:
        bins = self.free[space]
        b = bins.pop()
        if not bins:
            self.bits ^= 1 << space
        self.open -= 1
        return b


def pieces(n: int, size: int) -> Iterator[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else full pieces after a first that may be shorter."""
    at, end = 0, n % size or min(n, size)
    while end <= n:
        yield at, end - at
        at, end = end, end + size


def _pack(path: str, size: int, open_bins: int, end_id: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        bins, end = BestFit(size, open_bins), np.array([end_id], np.uint32).tobytes()
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in slices((len(t or "") for t in texts), 1000, 4 << 20) if texts else ():
                out = []
                for doc, ids in zip(docs[lo:hi], encode_texts(path, texts[lo:hi], BYTE_PIECES, False), strict=True):
                    raw = ids.tobytes() + end
                    for k, (at, length) in enumerate(pieces(len(raw) // 4, size)):
                        b, offset = bins.place(length)
                        out.append((doc, k, at, raw[4 * at : 4 * (at + length)], first + b, offset))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
                names = ["doc_id", "piece", "start", "ids", "sequence_id", "offset"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return run


def pack(docs: DataFrame, path: str, size: int = 1024, open_bins: int = 1024, end_id: int = 2) -> DataFrame:
    """(doc_id, piece, start, ids, sequence_id, offset): where each piece of docs(doc_id, text) lies in its sequence.

    ids: little-endian unsigned 32-bit token ids by the tokenizer file `path`, the end id after each document. A document
    of more than `size` tokens is cut into full pieces after a first one that may be shorter; others stay whole. Null and
    empty texts are the end id alone; a null doc_id is kept; repeated rows are packed each; an empty table gives no rows;
    other columns are ignored.
    """
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pack(path, size, open_bins, end_id), PACKED)
