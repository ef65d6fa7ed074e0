"""N-gram Jaccard self-join by prefix trees.

A document's set holds its distinct k-word shingles; two documents link when their Jaccard similarity reaches the
threshold. The global order of n-grams is (document frequency, hash), rarest first, so that a linked pair shares one of
the first n - ceil(t*n) + 1 n-grams of either document.

1. Each task hashes the shingles of a chunk of documents and deals them, packed and sorted, to hash ranges. An n-gram that
   a chunk holds more than once goes as one entry with its count, so that a very common one is an entry a chunk.
2. A hash range counts its n-grams over all documents and returns those with two documents or more to their chunk.
3. A chunk orders what came back; n-grams of one document come first in the order, so a document with more of them than
   its prefix holds has no link and is done. Others keep their prefix and their shared n-grams.
4. Documents of the same words form a class with one representative. Representatives that share a prefix n-gram are
   chained by connected components to blocks, which no link leaves.
5. In a block, the sets, ordered by block frequency, form a trie; each set walks it with the overlap so far and leaves
   a subtree as soon as the remaining lengths cannot reach the needed overlap.
6. A block many times too large for one task is dealt at random to tasks in a few rounds. Between rounds, n-grams whose documents are
   all of one component drop out, which leaves little of a large group of near copies. What is then left of large blocks is
   joined in full: by prefix n-gram, or by pairs of chunks of the block, whichever moves less.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, dealing, from_planes, planes, shingles, shuffle_partitions, slices, split_words, tasks_for, word_codes, written

#: kind 0: a chunk's documents, and the lists of documents of its features with several; 1: features of one document of the
#: chunk; 2: features of several. counts: documents by feature, of the chunk (from deal) or of all documents (from count).
DEALT = "part long, chunk long, kind int, hashes binary, docs binary, counts binary, meta binary"
NAMES = [x.split()[0] for x in DEALT.split(", ")]
KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
META = np.dtype([("doc", "<i8"), ("n", "<i8"), ("fp", "S32")])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(NAMES), KINDS, strict=True)], NAMES)


def _by_part(h: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """(part, from, to) of sorted hashes."""
    if not len(h):
        return []
    part = ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    at = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(h)]
    return [(int(part[a]), a, b) for a, b in zip(at, at[1:], strict=False)]


def deal(feature, lower: bool, parts: int, chunk_docs: int, chunk_bytes: int):
    """For mapInArrow over (doc_id, text): hash ranges' shares of each chunk's distinct features, and a row about its documents."""

    def run(batches):
        chunk = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in slices((len(t or "") for t in texts), chunk_docs, chunk_bytes) if texts else ():
                hashes, docs, meta = [], [], np.zeros(hi - lo, META)
                for d in range(lo, hi):
                    words = split_words(texts[d], lower)
                    s = np.unique(feature(word_codes(words)))
                    hashes.append(s)
                    docs.append(np.full(len(s), d - lo, np.uint16))
                    meta[d - lo] = (ids[d], len(s), xxhash.xxh3_128_hexdigest(b" ".join(words)).encode())
                h, d = np.concatenate(hashes), np.concatenate(docs)
                order = np.argsort(h)
                h, d = h[order], d[order]
                first = np.flatnonzero(np.diff(h, prepend=~h[:1]))
                n = np.diff(first, append=len(h))
                one = np.repeat(n == 1, n)
                many, counts = h[first[n > 1]], n[n > 1].astype(np.uint32)
                rows = [(chunk % parts, chunk, 0, planes(many), d[~one].tobytes(), counts.tobytes(), meta.tobytes())]
                h, d = h[one], d[one]
                rows += [(p, chunk, 1, planes(h[a:b]), d[a:b].tobytes(), None, None) for p, a, b in _by_part(h, parts)]
                rows += [(p, chunk, 2, planes(many[a:b]), None, counts[a:b].tobytes(), None) for p, a, b in _by_part(many, parts)]
                for some in range(0, len(rows), 512):
                    yield _batch(rows[some : some + 512])
                chunk += 1

    return run


def count(t: pa.Table) -> pa.Table:
    """Of one hash range that deal() made: the features of at least two documents, for each chunk, with their document frequency."""
    own = t.filter(pc.equal(t["kind"], 0))
    rows = list(zip(*(own[c].to_pylist() for c in NAMES), strict=True))
    t = t.filter(pc.greater(t["kind"], 0))
    if t.num_rows:
        chunks, kinds = t["chunk"].to_pylist(), t["kind"].to_pylist()
        hs = [from_planes(x) for x in t["hashes"].to_pylist()]
        docs = t["docs"].to_pylist()
        weights = [np.ones(len(x), np.uint32) if c is None else np.frombuffer(c, np.uint32) for x, c in zip(hs, t["counts"].to_pylist(), strict=True)]
        bounds = np.cumsum([0, *map(len, hs)])
        h, w = np.concatenate(hs), np.concatenate(weights)
        del hs, weights
        order = np.argsort(h)
        first = np.flatnonzero(np.diff(h[order], prepend=~h[order[:1]]))
        df = np.empty(len(h), np.uint32)
        df[order] = np.repeat(np.add.reduceat(w[order], first), np.diff(first, append=len(h)))
        for i, (c, kind) in enumerate(zip(chunks, kinds, strict=True)):
            a, b = bounds[i], bounds[i + 1]
            keep = np.flatnonzero(df[a:b] > 1)
            if len(keep):
                rows.append((0, c, kind, planes(h[a + keep]), np.frombuffer(docs[i], np.uint16)[keep].tobytes() if kind == 1 else None, df[a + keep].tobytes(), None))
    return pa.Table.from_batches([_batch(rows)])


def gathered(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(documents, and of each shared feature of each: hash, place of its document, document frequency) of one chunk that count() returned."""
    of = lambda kind, c: t.filter(pc.equal(t["kind"], kind))[c].to_pylist()
    hashes = lambda kind: np.concatenate([np.empty(0, np.uint64), *map(from_planes, of(kind, "hashes"))])
    numbers = lambda kind: np.frombuffer(b"".join(of(kind, "counts")), np.uint32)
    h, many, own = hashes(1), hashes(2), hashes(0)
    times, df = numbers(0), numbers(2)[np.argsort(many)]  # own, sorted, holds what many does
    d = np.frombuffer(b"".join(of(1, "docs")) + b"".join(of(0, "docs")), np.uint16)
    return np.frombuffer(of(0, "meta")[0], META), np.concatenate([h, np.repeat(own, times)]), d, np.concatenate([numbers(1), np.repeat(df, times)])


def shared_features(docs: DataFrame, feature, lower: bool) -> DataFrame:
    """Rows of DEALT by chunk, for gathered(): what docs(doc_id, text) share of their features; chunks are dealt to tasks."""
    parts, chunk_docs, chunk_bytes = dealing(docs)
    tasks = tasks_for(docs)
    dealt = docs.mapInArrow(deal(feature, lower, parts, chunk_docs, chunk_bytes), DEALT).repartition(tasks, "part")
    return dealt.groupBy("part").applyInArrow(count, DEALT).repartition(tasks, "chunk")


SETS = "doc_id long, n long, fp string, prefix array<long>, shared binary"


def _order(threshold: float):
    def run(t: pa.Table) -> pa.Table:
        """Of one chunk: each document's size, and its prefix and shared n-grams in the global order if it may link."""
        meta, h, d, df = gathered(t)
        order = np.lexsort((h, df, d))
        h, d = h[order], d[order]
        at = np.searchsorted(d, np.arange(len(meta) + 1))
        prefixes, shared = [], []
        for i, n in enumerate(meta["n"].tolist()):
            s = h[at[i] : at[i + 1]]
            in_prefix = n - ceil(round(threshold * n, 9)) + 1 - (n - len(s)) if n else 0
            prefixes.append(s[:in_prefix].view(np.int64) if in_prefix > 0 else None)
            shared.append(s.tobytes() if in_prefix > 0 else None)
        fps = [x.decode() for x in meta["fp"].tolist()]
        return pa.table([pa.array(meta["doc"]), pa.array(meta["n"]), pa.array(fps), pa.array(prefixes, pa.list_(pa.int64())), pa.array(shared, pa.binary())], ["doc_id", "n", "fp", "prefix", "shared"])

    return run


# -- the trie ---------------------------------------------------------------------------------------------------------


def trie_join(n: np.ndarray, sets: list[np.ndarray], threshold: float, left: int | None = None, known: np.ndarray | None = None) -> np.ndarray:
    """Component label (an index) of each set; sets whose Jaccard similarity reaches the threshold are linked.

    n: full sizes; sets: the elements that other sets may hold too. left: if given, only pairs of one of the first
    `left` sets with one of the others are compared. known: sets of the same value are linked already.
    """
    size = len(sets)
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int64)
    rank[np.lexsort((values, -counts))] = np.arange(len(values))
    common = int((counts > 1).sum())
    ranks = rank[inverse]
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    lists = [np.sort(r[r < common]) for r in (ranks[a:b] for a, b in zip(bounds, bounds[1:], strict=False))]
    by = sorted(range(size), key=lambda i: lists[i].astype(">u4").tobytes())
    lists, n, side = [lists[i] for i in by], n[by], np.array(by) < (size if left is None else left)
    labels = np.arange(size)
    if known is not None:
        _, first, which = np.unique(known[by], return_index=True, return_inverse=True)
        labels = first[which]
    length = np.array([len(x) for x in lists])

    def shared(x, y):
        m = min(len(x), len(y))
        differs = np.flatnonzero(x[:m] != y[:m])
        return int(differs[0]) if len(differs) else m

    lcp = np.array([0, *(shared(x, y) for x, y in zip(lists, lists[1:], strict=False))])
    # nodes: (documents from, to, segment, depth of its end, longest list, smallest n, children, documents that end here)
    nodes, todo = [], [(0, size, 0, -1)]
    while todo:
        lo, hi, depth, parent = todo.pop()
        end = int(length[lo]) if hi - lo == 1 else int(min(lcp[lo + 1 : hi].min(), length[lo]))
        own = lo
        while own < hi and length[own] == end:
            own += 1
        nodes.append((lo, hi, lists[lo][depth:end], end, int(length[lo:hi].max()), int(n[lo:hi].min()), [], range(lo, own)))
        if parent >= 0:
            nodes[parent][6].append(len(nodes) - 1)
        if own < hi:
            cuts = [own, *(c for c in (np.flatnonzero(lcp[own + 1 : hi] == end) + own + 1).tolist()), hi]
            todo += [(a, b, end, len(nodes) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    member = np.zeros(common, bool)
    t = threshold / (1 + threshold)
    for q in range(size):
        mine, nq = lists[q], int(n[q])
        member[mine] = True
        todo = [(0, 0)]
        while todo:
            at, overlap = todo.pop()
            lo, hi, segment, end, longest, least, children, own = nodes[at]
            if left is None and hi - 1 <= q or (labels[max(lo, q + 1 if left is None else lo) : hi] == labels[q]).all():
                continue
            if len(segment):
                overlap += int(member[segment].sum())
                remaining = len(mine) - int(np.searchsorted(mine, segment[-1], "right"))
            else:
                remaining = len(mine)
            if overlap + min(remaining, longest - end) < t * (nq + least) - 1e-6:
                continue
            for y in own:
                if labels[y] != labels[q] and (left is None or side[y] != side[q]) and overlap >= t * (nq + int(n[y])) - 1e-6:
                    labels[labels == max(labels[y], labels[q])] = min(labels[y], labels[q])
            todo += [(c, overlap) for c in children]
        member[mine] = False
    out = np.empty(size, np.int64)
    by = np.array(by)
    # labels are positions in the trie's order; give each component the smallest index of its sets
    smallest = np.full(size, size)
    np.minimum.at(smallest, labels, by)
    out[by] = smallest[labels]
    return out


JOINED = "block long, i int, j int, side int, doc_id long, label long, n long, shared binary"


def _join_blocks(threshold: float):
    """Of some blocks, or pairs (i, j) of a block's chunks: (a, b), b the smallest document of a's component or an equal link."""

    def run(t: pa.Table) -> pa.Table:
        block, doc, label, n, side, i, j = (t[c].to_numpy() for c in ("block", "doc_id", "label", "n", "side", "i", "j"))
        raw = t["shared"].to_pylist()
        found = []
        order = np.lexsort((doc, side, block))
        for group in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
            left = int((side[group] == i[group[0]]).sum()) if i[group[0]] != j[group[0]] else None
            if left in (0, len(group)) or (label[group] == label[group[0]]).all():
                continue
            labels = trie_join(n[group], [np.frombuffer(raw[x], np.uint64) for x in group], threshold, left, label[group])
            found += [(int(doc[x]), int(min(doc[group[labels == y]]))) for x, y in zip(group, labels, strict=True)]
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _in_full(docs: DataFrame, sizes: DataFrame, threshold: float) -> DataFrame:
    """(a, b) links of docs(block, doc_id, label, n, shared), every pair of a block's chunks a task; sizes(block, cuts)."""
    cut = docs.join(sizes.select("block", "cuts"), "block").withColumn("side", F.pmod(F.xxhash64("doc_id"), "cuts").cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    cut = cut.withColumns({"i": F.least("side", "other"), "j": F.greatest("side", "other")})
    return cut.select(*(x.split()[0] for x in JOINED.split(", "))).groupBy("block", "i", "j").applyInArrow(_join_blocks(threshold), "a long, b long")


def _roots(able: DataFrame, threshold: float, block_elements: int, block_docs: int, rounds: int, few_cuts: int) -> DataFrame:
    """(node, root) of the components of able(doc_id, n, prefix, shared), for those with a link at least."""
    spark = able.sparkSession
    found: list[DataFrame] = []
    live = able.withColumn("label", F.col("doc_id"))
    for r in range(rounds + 1):
        grams = live.select("doc_id", "label", F.explode("prefix").alias("gram"))
        active = written(grams.groupBy("gram").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("doc_id").alias("b")).where("lo < hi").select("gram", "b"))
        edges = grams.join(active, "gram").where("doc_id <> b").select(F.col("doc_id").alias("a"), "b")
        blocks = connected_components(edges).select(F.col("node").alias("doc_id"), F.col("root").alias("block"))
        docs = live.join(blocks, "doc_id")
        weight = (F.length("shared") / 8).alias("m")
        cuts = lambda: F.ceil(F.greatest(F.col("m") / block_elements, F.col("docs") / block_docs, F.lit(1))).cast("int").alias("cuts")
        sizes = docs.select("block", weight).groupBy("block").agg(F.sum("m").alias("m"), F.count("*").alias("docs"))
        sizes = written(sizes.select("block", "m", cuts()))
        total = sizes.agg(F.sum("m")).first()[0] or 0
        bins = max(2 * shuffle_partitions(spark), ceil(total / (block_elements / 2)))
        zero = {c: F.lit(0) for c in ("i", "j", "side")}
        small = docs.join(sizes.where("cuts = 1").select("block"), "block").withColumns({"bin": F.pmod(F.hash("block"), F.lit(bins)), **zero})
        found.append(written(small.groupBy("bin").applyInArrow(_join_blocks(threshold), "a long, b long")))
        large = sizes.where("cuts > 1")
        most = large.agg(F.max("cuts")).first()[0]
        if most is None:
            break
        docs = written(docs.join(large.select("block", "cuts"), "block"))
        if r < rounds and most > few_cuts:
            dealt = docs.withColumns({**zero, "part": F.pmod(F.xxhash64("doc_id", F.lit(r)), "cuts")})
            found.append(written(dealt.groupBy("block", "part").applyInArrow(_join_blocks(threshold), "a long, b long")))
            own = connected_components(reduce(DataFrame.union, found)).select(F.col("node").alias("doc_id"), F.col("root").alias("label"))
            live = written(docs.select("doc_id", "n", "prefix", "shared").join(own, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id")))
            continue
        # what the rounds left of large blocks: by n-gram or by block, for each block what copies fewer elements
        grams = docs.select("block", "doc_id", "label", "n", "shared", F.explode("prefix").alias("gram")).join(active.select("gram"), "gram")
        cost = grams.select("block", weight).groupBy("block").agg(F.sum("m").alias("cost"))
        choice = written(large.join(cost, "block").select("block", "cuts", (F.col("cost") < F.col("m") * F.col("cuts")).alias("by_gram")))
        grams = grams.join(choice.where("by_gram").select("block"), "block").drop("block").withColumnRenamed("gram", "block")
        of_gram = grams.select("block", weight).groupBy("block").agg(F.sum("m").alias("m"), F.count("*").alias("docs")).select("block", cuts())
        found.append(written(_in_full(grams, of_gram, threshold)))
        found.append(written(_in_full(docs.drop("cuts"), choice.where("not by_gram"), threshold)))
        break
    if len(found) == 1:  # no block was cut
        return found[0].groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return connected_components(reduce(DataFrame.union, found))


def jaccard_components(docs: DataFrame, k: int = 5, threshold: float = 0.8, block_elements: int = 2_000_000, block_docs: int = 500, rounds: int = 4, few_cuts: int = 8) -> DataFrame:
    """(doc_id, n_shingles, component_id) of docs(doc_id long, text string); component_id: smallest doc_id reachable by links.

    Words are lower-cased in A-Z. Null, empty and blank texts have an empty set, no links, and their own doc_id. Rows
    with a null doc_id are left out; repeated rows of a doc_id are returned each, with the component of their own text. An
    empty table gives an empty result. Other columns are ignored. block_elements and block_docs bound what one task
    joins; blocks larger by more than few_cuts times are dealt in at most `rounds` rounds, and what is then larger than a task
    is joined in full, nothing is left out.
    """
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    dealt = shared_features(docs, lambda codes: shingles(codes, k), True)
    sets = written(dealt.groupBy("chunk").applyInArrow(_order(threshold), SETS))
    classes = written(sets.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    able = sets.where("prefix is not null").join(classes.select(F.col("rep").alias("doc_id"), "fp"), ["doc_id", "fp"], "left_semi")
    able = written(able.dropDuplicates(["doc_id", "fp"]).select("doc_id", "n", "prefix", "shared"))
    roots = written(_roots(able, threshold, block_elements, block_docs, rounds, few_cuts).withColumnRenamed("node", "rep"))
    out = sets.select("doc_id", "n", "fp").join(classes, "fp", "left").join(roots, "rep", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("root", "rep")).otherwise(F.col("doc_id")).alias("component_id"))
