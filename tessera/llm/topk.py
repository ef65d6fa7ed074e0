"""Exact top-k inner-product search over a bit-sliced index.

The index holds blocks of vectors: their integers, and for every component the bitmaps of a coarse unsigned quantisation,
most significant last. For a block of queries, the coarse components, weighted by small multiples of the queries'
components, are added by bitmap arithmetic: 64 rows of a query in a machine word. From the most significant slice of the
sums downward the k-th largest is found, and with it a bound below which no row can be among the best, as the error of the
coarse sums is bounded by the norms of what quantisation leaves. Rows at or above the bound are resolved exactly.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, written

BLOCK_ROWS, SLICES, QUERY_ROWS, QUERY_BYTES = 4096, 6, 256, 16 << 20
ALL = np.uint64(2**64 - 1)
INDEX = "dim int, rows int, ids binary, vectors binary, slices binary, low binary, shift int, rest double, spread double"


def quantised(vector: list | None) -> list[int] | None:
    """floor(256 * x) of each component; None if it is null, or a component is null or not finite; ValueError from 2**63 on."""
    if vector is None or any(x is None for x in vector):
        return None
    x = np.array(vector, np.float64) * 256
    if not np.isfinite(x).all():
        return None
    if (np.abs(x) >= 2.0**63).any():
        raise ValueError("a component's floor(256 * x) takes more than 64 bits")
    return [int(v) for v in np.floor(x)]


def _block(ids: list[int], rows: list[list[int]]) -> tuple:
    exact = np.array(rows, np.int64).reshape(len(rows), -1)
    v = exact.astype(np.float64)  # rounds from 2**53 on, which the search's error bound covers
    n, dim = v.shape
    low = v.min(axis=0) if dim else np.zeros(0)
    width = float((v - low).max()) if dim else 0.0
    shift = max(0, int(np.ceil(np.log2(width + 1))) - SLICES)
    coarse = np.floor((v - low) / 2.0**shift)
    rest = np.sqrt(((v - low - coarse * 2.0**shift - (2.0**shift - 1) / 2) ** 2).sum(axis=1).max())
    spread = np.sqrt(((coarse - (2**SLICES - 1) / 2) ** 2).sum(axis=1).max())
    padded = np.zeros((dim, -(-n // 64) * 64), np.uint8)
    padded[:, :n] = coarse.T.astype(np.uint8)
    slices = np.stack([np.packbits(padded >> s & 1, axis=1, bitorder="little") for s in range(SLICES)], axis=1) if dim else np.zeros(0, np.uint8)
    return dim, n, np.array(ids, "<i8").tobytes(), exact.tobytes(), slices.tobytes(), low.tobytes(), shift, float(rest), float(spread)


def _index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.float64(), pa.float64()]
    names = [x.split()[0] for x in INDEX.split(", ")]
    pending: dict[int, tuple[list, list]] = {}

    def out(dim):
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(_block(*pending.pop(dim)), kinds, strict=True)], names)

    for batch in batches:
        for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if i is None or (v := quantised(x)) is None:
                continue
            ids, rows = pending.setdefault(len(v), ([], []))
            ids.append(i)
            rows.append(v)
            if len(ids) == BLOCK_ROWS:
                yield out(len(v))
    for dim in list(pending):
        yield out(dim)


def build_index(vectors: DataFrame) -> DataFrame:
    """The index of vectors(vec_id long, embedding array): every row but those that are null, or hold null or non-finite components."""
    return written(vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(_index, INDEX))


def coarse_sums(slices: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
    """Bit slices, least significant first, of the sums over components of |w| * c, or |w| * (2**n - 1 - c) where w < 0.

    slices: [components, n, words]; weights: [queries, components], small integers.
    """
    size = np.abs(weights)
    levels = int(size.sum(axis=1).max() * (2 ** slices.shape[1] - 1)).bit_length()
    total = [np.zeros((len(weights), slices.shape[2]), np.uint64) for _ in range(levels)]
    waiting: list[np.ndarray | None] = [None] * (levels + 1)
    negative = np.where(weights < 0, ALL, np.uint64(0))

    def add(bits: np.ndarray, at: int) -> None:
        """Two slices of a level are added to its sum at once, by a full adder, so that half as many carries go up."""
        while at < levels:
            if waiting[at] is None:
                waiting[at] = bits
                return
            other, waiting[at] = waiting[at], None
            both = bits & other
            np.bitwise_xor(bits, other, out=bits)
            np.bitwise_and(total[at], bits, out=other)
            np.bitwise_xor(total[at], bits, out=total[at])
            bits, at = np.bitwise_or(both, other, out=both), at + 1

    for d in range(slices.shape[0]):
        bits = int(size[:, d].max()).bit_length()
        masks = [np.where(size[:, d] >> b & 1, ALL, np.uint64(0))[:, None] for b in range(bits)]
        for s in range(slices.shape[1]):
            own = slices[d, s] ^ negative[:, d, None]
            for b, mask in enumerate(masks):
                add(own & mask, s + b)
    for at in range(levels):
        if (bits := waiting[at]) is not None:
            waiting[at] = None
            carry = total[at] & bits
            np.bitwise_xor(total[at], bits, out=total[at])
            add(carry, at + 1)
    return total


def kth_largest(total: list[np.ndarray], valid: np.ndarray, k: int) -> np.ndarray:
    """For each query the k-th largest sum of its valid rows, from the most significant slice down; -1 with fewer of them.

    valid: bitmaps [queries, words].
    """
    left = valid.copy()
    need = np.full(len(left), k)
    short = np.bitwise_count(left).sum(axis=1, dtype=np.int64) < k
    out = np.zeros(len(left), np.int64)
    for level in range(len(total) - 1, -1, -1):
        have = left & total[level]
        count = np.bitwise_count(have).sum(axis=1, dtype=np.int64)
        take = count >= need
        left = np.where(take[:, None], have, left & ~total[level])
        need = need - np.where(take, 0, count)
        out |= take.astype(np.int64) << level
    return np.where(short, -1, out)


def at_least(total: list[np.ndarray], valid: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Bitmaps of the valid rows whose sum is at least each query's bound."""
    bound = np.clip(bound, 0, 1 << len(total))
    same = np.where(bound[:, None] >> len(total), np.uint64(0), valid)
    more = np.zeros_like(same)
    for level in range(len(total) - 1, -1, -1):
        one = (bound >> level & 1).astype(bool)[:, None]
        more |= np.where(one, np.uint64(0), same & total[level])
        same &= np.where(one, total[level], ~total[level])
    return more | same


def candidates_of(own: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Bitmaps [queries, words] of a block's rows but those of each query's own id."""
    words = -(-len(own) // 64)
    rows = np.packbits(np.arange(words * 64) < len(own), bitorder="little")
    valid = np.tile(rows, (len(ids), 1))
    order = np.argsort(own)
    lo, hi = (np.searchsorted(own[order], ids, side) for side in ("left", "right"))
    for q in np.flatnonzero(hi > lo):
        r = order[lo[q] : hi[q]]
        np.bitwise_and.at(valid[q], r >> 3, ~(np.uint8(1) << (r & 7).astype(np.uint8)))
    return valid.view(np.uint64)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The rows' integer inner products; OverflowError if one takes more than 64 bits."""
    most = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * max(1, a.shape[1])
    if most < 2.0**52:
        return np.einsum("ij,ij->i", a.astype(np.float64), b.astype(np.float64)).astype(np.int64)
    if most < 2.0**62:
        return np.einsum("ij,ij->i", a, b)
    return np.array([sum(x * y for x, y in zip(r.tolist(), t.tolist(), strict=True)) for r, t in zip(a, b, strict=True)], np.int64)


class _Best:
    """The k best rows so far of each query; ties go to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k, self.n = k, queries
        self.query, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        query, score, ids = np.concatenate([self.query, query]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score, query))
        order = order[np.arange(len(order)) - np.searchsorted(query[order], query[order]) < self.k]
        self.query, self.score, self.id = query[order], score[order], ids[order]

    def kth(self) -> np.ndarray:
        """The k-th best score of each query, minus infinity with fewer."""
        out = np.full(self.n, -np.inf)
        count = np.bincount(self.query, minlength=self.n)
        last = np.cumsum(count) - 1
        full = count >= self.k
        score = self.score[last[full]].astype(np.float64)
        out[full] = score - np.abs(score) * 2.0**-52  # not more than the score itself
        return out


def _search_block(row: dict, ids: np.ndarray, exact: np.ndarray, best: _Best, at: int, k: int) -> None:
    """Adds to best what one index block has for some queries, whose first is number `at` of best's."""
    n, dim, shift = row["rows"], row["dim"], row["shift"]
    queries = exact.astype(np.float64)
    own = np.frombuffer(row["ids"], "<i8")
    vectors = np.frombuffer(row["vectors"], np.int64).reshape(n, dim)
    words = -(-n // 64)
    slices = np.frombuffer(row["slices"], np.uint64).reshape(dim, SLICES, words)
    low = np.frombuffer(row["low"], np.float64)
    valid = candidates_of(own, ids)
    step, most = 2.0**shift, 2**SLICES - 1
    unit = np.maximum(np.abs(queries).max(axis=1, initial=0) * step / most, 1e-9)
    weights = np.rint(queries * step / unit[:, None]).astype(np.int64)
    off = queries * step - unit[:, None] * weights
    base = queries @ (low + (step - 1) / 2) + off.sum(axis=1) * most / 2 - unit * most * np.where(weights < 0, -weights, 0).sum(axis=1)
    rounding = (dim + 8) * 2.0**-48 * np.abs(queries).sum(axis=1) * (np.abs(low).max(initial=0) + step * (most + 1))
    error = (np.sqrt((queries**2).sum(axis=1)) * row["rest"] + np.sqrt((off**2).sum(axis=1)) * row["spread"]) * (1 + 1e-9) + 1e-3 + rounding
    total = coarse_sums(slices, weights)
    kth = kth_largest(total, valid, k)
    floor = np.maximum(np.where(kth >= 0, unit * kth + base - error, -np.inf), best.kth()[at : at + len(queries)])
    bound = np.where(np.isfinite(floor), np.ceil((np.where(np.isfinite(floor), floor, 0) - error - base) / unit - 1e-6), 0)
    hits = at_least(total, valid, bound.clip(0, 2.0**62).astype(np.int64)) if total else valid
    q, r = np.nonzero(np.unpackbits(np.ascontiguousarray(hits).view(np.uint8), axis=1, bitorder="little"))
    for lo in range(0, len(q), 1 << 16):
        a, b = q[lo : lo + (1 << 16)], r[lo : lo + (1 << 16)]
        best.add(a + at, inner(exact[a], vectors[b]), own[b])


def _search(shared, k: int):
    def run(batches):
        by_dim = shared.value
        best = {d: _Best(len(x), k) for d, (x, _) in by_dim.items()}
        for batch in batches:
            for i in range(batch.num_rows):
                (row,) = batch.slice(i, 1).to_pylist()
                if row["dim"] in by_dim:
                    own, queries = by_dim[row["dim"]]
                    for at in range(0, len(own), QUERY_ROWS):
                        _search_block(row, own[at : at + QUERY_ROWS], queries[at : at + QUERY_ROWS], best[row["dim"]], at, k)
        for d, x in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(by_dim[d][0][x.query]), pa.array(x.id), pa.array(x.score)], ["query_id", "vec_id", "score"])

    return run


def top_k(index: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries(vec_id, embedding) its k highest inner products in the index.

    Components are floor(256 * x) and scores exact integers; components or scores of more than 64 bits are an error. Ties go
    to the smaller vec_id. A query's own row (its vec_id) is no candidate; vectors of another dimension aren't either. With
    fewer candidates, all are returned. Queries that are null or hold null or non-finite components give no rows; rows with
    a null vec_id are left out; other columns are ignored. Queries are searched in batches of about QUERY_BYTES, each sent
    to all tasks and freed before the next, and what a batch finds is written; so neither side must fit in memory.
    """
    spark = queries.sparkSession
    queries = queries.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null and embedding is not null").dropDuplicates(["vec_id"])
    rows, size = queries.select(F.count("*"), F.sum(F.size("embedding") * 8)).first()
    batches = max(1, -(-(size or 0) // QUERY_BYTES))
    if rows:
        path = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
        queries.withColumn("batch", F.pmod(F.xxhash64("vec_id"), F.lit(batches))).repartition("batch").write.partitionBy("batch").parquet(path)
        queries = spark.read.parquet(path)
    out = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
    for b in range(batches):
        some: dict[int, tuple[list, list]] = {}
        for i, x in queries.where(F.col("batch") == b).select("vec_id", "embedding").orderBy("vec_id").collect() if rows else []:
            if (v := quantised(x)) is not None:
                ids, vectors = some.setdefault(len(v), ([], []))
                ids.append(i)
                vectors.append(v)
        shared = spark.sparkContext.broadcast({d: (np.array(i, np.int64), np.array(r, np.int64).reshape(len(i), d)) for d, (i, r) in some.items()})
        index.mapInArrow(_search(shared, k), "query_id long, vec_id long, score long").write.mode("append").parquet(out)
        shared.destroy()
    found = spark.read.schema("query_id long, vec_id long, score long").parquet(out)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
