"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

A pass joins passages to items by seeds, which are all the item's n-grams, and aligns the words around them with the item's.
Matches score 2, other words and gaps -1 and -2; the local score over that of the whole item is the similarity. No choice
among an item's n-grams is safe, as any of them may be the only one that an edited copy keeps; the rarest are, where exact
copies stand beside edited ones, those that the edited lack. What frequent n-grams bring is held against a bound instead: an
alignment has no more matches than the passage has words of the item.

Words are lower-cased and lose punctuation at their ends. The benchmark's seeds are a table sorted by hash, which is broadcast
in blocks of a bounded number of words; every document's n-grams are merged with it. A pass is a map, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_ENTRIES, slices, windows, written

BLOCK_WORDS, MATCH, OTHER, GAP = 2_000_000, 2, -1, -2  # a block takes 32 bytes a word in every Python worker
FILTER_BITS = 20


class _Normal(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        plain = word.decode("utf-8", "replace").lower().strip(".,;:!?\"'()[]{}*_-|/\\") or word.decode("utf-8", "replace")
        h = self[word] = xxhash.xxh3_64_intdigest(plain.encode("utf-8", "surrogatepass"))
        return h


_normal = _Normal()


def codes_of(text: str | None) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").split() if text else []
    return np.fromiter(map(_normal.__getitem__, words), np.uint64, len(words))


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """(score, first, last + 1) of the best local alignment of item's words in passage."""
    gap = np.arange(len(passage) + 1) * GAP
    row = np.zeros(len(passage) + 1, np.int64)
    start = np.arange(len(passage) + 1)
    best = (0, 0, 0)
    for word in item:
        diagonal = row[:-1] + np.where(passage == word, MATCH, OTHER)
        new = np.maximum(row + GAP, 0)
        come = np.where(row + GAP > 0, start, np.arange(len(start)))
        better = diagonal > new[1:]
        new[1:] = np.where(better, diagonal, new[1:])
        come[1:] = np.where(better, start[:-1], come[1:])
        level = new - gap
        top = np.maximum.accumulate(level)
        source = np.maximum.accumulate(np.where(level == top, np.arange(len(level)), 0))
        row, start = top + gap, come[source]
        at = int(row.argmax())
        if row[at] > best[0]:
            best = (int(row[at]), int(start[at]), at)
    return best


class Leaks:
    """The items of a block with their seeds; find() aligns a document's passages with them."""

    def __init__(self, ids: list, items: list[np.ndarray], n: int, threshold: float):
        self.ids, self.items, self.n, self.threshold = ids, items, n, threshold
        grams = [windows(codes, n) for codes in items]
        h = np.concatenate([np.empty(0, np.uint64), *grams])
        order = np.argsort(h, kind="stable")
        self.item = np.repeat(np.arange(len(items), dtype=np.int32), [len(g) for g in grams])[order]
        self.place = np.concatenate([np.empty(0, np.int32), *(np.arange(len(g), dtype=np.int32) for g in grams)])[order]
        self.grams, first = np.unique(h[order], return_index=True)
        self.bounds = np.append(first, len(h))
        self.table = np.zeros(1 << FILTER_BITS, bool)  # most n-grams of a corpus are in no item
        self.table[self.grams >> np.uint64(64 - FILTER_BITS)] = True
        self.words = [np.unique(codes, return_counts=True) for codes in items]

    def seeds(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in h, item, place in the item) of each seed, by item and place."""
        at = np.flatnonzero(self.table[h >> np.uint64(64 - FILTER_BITS)]) if len(self.grams) else np.empty(0, np.int64)
        number = np.minimum(np.searchsorted(self.grams, h[at]), max(0, len(self.grams) - 1))
        hit = self.grams[number] == h[at] if len(at) else np.empty(0, bool)
        at, number = at[hit], number[hit]
        times = self.bounds[number + 1] - self.bounds[number]
        row = np.repeat(self.bounds[number] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
        at, item, place = np.repeat(at, times), self.item[row], self.place[row]
        order = np.lexsort((at, item))
        return at[order], item[order], place[order]

    def most(self, i: int, passage: np.ndarray) -> int:
        """No alignment of item i in the passage scores more: its words that are there, as often as they are."""
        words, n = self.words[i]
        at = np.minimum(np.searchsorted(words, passage), len(words) - 1)
        there = np.bincount(at[words[at] == passage], minlength=len(words))
        return MATCH * int(np.minimum(there, n).sum())

    def find(self, codes: np.ndarray) -> list[tuple]:
        """(item id, score, similarity, first word, last word + 1) of each item that the document holds, its best passage."""
        at, of, place = self.seeds(windows(codes, self.n))
        found = []
        for group in np.split(np.arange(len(of)), np.flatnonzero(np.diff(of)) + 1) if len(of) else ():
            i = int(of[group[0]])
            item, best = self.items[i], (0, 0, 0)
            least = self.threshold * MATCH * len(item)
            margin = max(0, int((MATCH * len(item) - least) / -GAP)) + 1  # more words between matches cost too much
            for near in np.split(group, np.flatnonzero(np.diff(at[group]) > len(item) + margin) + 1):
                begin = at[near] - place[near]
                lo, hi = max(0, int(begin.min()) - margin), int(begin.max()) + len(item) + margin
                if self.most(i, codes[lo:hi]) >= least:
                    score, first, last = align(item, codes[lo:hi])
                    best = max(best, (score, lo + first, lo + last), key=lambda x: (x[0], -x[1]))
            if best[0] >= least:
                found.append((self.ids[i], best[0], best[0] / (MATCH * len(item)), best[1], best[2]))
        return sorted(found)


def leaks(benchmark: DataFrame, n: int = 3, threshold: float = 0.4, block_words: int = BLOCK_WORDS) -> Iterator[Leaks]:
    """For each block of the benchmark(item_id, text) what finds its items; a block has about block_words words, or one item.

    Items with a null id, or with fewer than n words (null and empty texts among them), cannot be found.
    """
    words = F.size(F.split("text", r"\s+"))
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("item_id is not null and text is not null").distinct()
    items = written(items.withColumn("n", words))
    blocks = max(1, -(-(items.agg(F.sum("n")).first()[0] or 0) // block_words))
    for b in range(blocks):
        own = sorted(items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).select("item_id", "text").collect())
        yield Leaks([r[0] for r in own], [codes_of(r[1]) for r in own], n, threshold)


FOUND = "doc_id long, item_id long, score long, similarity double, first long, last long"


def find_leaks(docs: DataFrame, benchmark: DataFrame, n: int = 3, threshold: float = 0.4, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, score, similarity, first, last): each pair of a document and an item whose passage it holds.

    first and last + 1 bound the passage in the document's words. Null and empty texts hold none; a null doc_id is kept;
    repeated rows give their pairs each; empty tables give none; other columns are ignored. The benchmark is taken in blocks,
    each a pass over the documents.
    """
    context, out = docs.sparkSession.sparkContext, None
    for block in leaks(benchmark, n, threshold, block_words):

        def run(batches, shared=context.broadcast(block)):
            for batch in batches:
                texts = batch.column(1).to_pylist()
                for lo, hi in slices((len(t or "") for t in texts), 1000, 4 << 20) if texts else ():
                    rows = [(d, *x) for d, t in zip(batch.column(0)[lo:hi].to_pylist(), texts[lo:hi], strict=True) for x in shared.value.find(codes_of(t))]
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                    cols = zip(*rows, strict=True) if rows else [[]] * 6
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in FOUND.split(", ")])

        part = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, FOUND)
        out = part if out is None else out.union(part)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, n: int = 3, threshold: float = 0.4, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs, all columns, that hold no passage of the benchmark: the blocks' filters in one pass."""
    out = docs
    for block in leaks(benchmark, n, threshold, block_words):

        def run(batches, shared=docs.sparkSession.sparkContext.broadcast(block)):
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
                for lo, hi in slices((len(t or "") for t in texts), 1000, 4 << 20) if texts else ():
                    yield batch.slice(lo, hi - lo).filter(pa.array([not shared.value.find(codes_of(t)) for t in texts[lo:hi]], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out
