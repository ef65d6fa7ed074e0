"""Removal of long word passages that repeat across documents.

Windows of `span` consecutive words are the edges of a de Bruijn graph of word k-mers. A word goes where a window covers it
that also starts in a document with a smaller doc_id.

1. Every window names the smallest hash among its k-mers (its minimizer), a function of the window's words alone. The
   minimizers, a sixteenth of the windows, are dealt to hash ranges; windows whose minimizer only one document holds
   cannot repeat. The rest of a document is done.
2. The remaining windows go to hash ranges as edges, with the words before and after them. A range finds the edges that
   several documents hold, and where the graph branches: where an edge has two successors, or predecessors, or a text ends.
   Both come back to the edge's chunk.
3. Between branches, a path of repeated edges is the same in all its documents. In source coordinates it compacts to one
   row: its first and last edge, its place, and a digest of the source's words from its first to its last.
4. Rows join on the digest: a path belongs to the smallest document that holds these very words. Paths that share an end but
   not the words show that hashes collided; they are taken apart to single windows, whose words are digested each.
5. Where a path belongs to a smaller document, the words that it covers are removed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealing, from_planes, planes, slices, split_words, tasks_for, windows, word_codes, written
from .ngram_join import _by_part, gathered, shared_features


def _sliding(a: np.ndarray, width: int, f) -> np.ndarray:
    """f (minimum or maximum) over each `width` consecutive values."""
    step = 1
    out = a
    while 2 * step <= width:
        out = f(out[:-step], out[step:])
        step *= 2
    n = len(a) - width + 1
    return f(out[:n], out[width - step : width - step + n])


def minimizers(codes: np.ndarray, span: int, k: int) -> np.ndarray:
    """For each window of `span` words the smallest hash among its k-mers."""
    if len(codes) < span:
        return np.empty(0, np.uint64)
    return _sliding(windows(codes, k), span - k + 1, np.minimum)


def _candidates(t: pa.Table) -> pa.Table:
    """Of one chunk: the minimizers of each document that other documents hold too."""
    meta, h, d, _ = gathered(t)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    found, at = np.unique(d, return_index=True)
    return pa.table([pa.array(meta["doc"][found]), pa.array([x.tobytes() for x in np.split(h, at[1:])] if len(found) else [], pa.binary())], ["doc_id", "shared"])


def sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


KEPT = "chunk long, at int, doc_id long, n_words long, sha string, text string, shared binary"


def _done(chunk_docs: int, chunk_bytes: int):
    def run(batches):
        """Documents without candidates get their result; the others go on in chunks."""
        chunk = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        for batch in batches:
            docs, texts, shared = (batch.column(i).to_pylist() for i in range(3))
            for lo, hi in slices((len(t or "") for t in texts), chunk_docs, chunk_bytes) if texts else ():
                rows = []
                for i in range(lo, hi):
                    words = split_words(texts[i], lower=False)
                    rows.append((chunk, i - lo, docs[i], len(words), *((None, texts[i], shared[i]) if shared[i] else (sha(words), None, None))))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["chunk", "at", "doc_id", "n_words", "sha", "text", "shared"])
                chunk += 1

    return run


EDGES = "part long, chunk long, hashes binary, many binary, after binary, before binary"
#: Of an edge's neighbours: BRANCH if they differ, END if there is none, else 32 bits of the word after or before it.
BRANCH, END = np.uint32(0), np.uint32(1)


def _neighbours(codes: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(words after, words before) of each window."""
    word = np.maximum((codes >> np.uint64(32)).astype(np.uint32), np.uint32(2))
    return np.append(word[span:], END), np.insert(word[: len(codes) - span], 0, END)


def _merged(h: np.ndarray, many: np.ndarray, *sides: np.ndarray) -> tuple:
    """(distinct edges, whether several documents hold each, their neighbours on each side) of edges sorted by hash."""
    first = np.flatnonzero(np.diff(h, prepend=~h[:1]))
    held = np.add.reduceat(many + 1, first) > 1
    return h[first], held, *(np.where(np.minimum.reduceat(x, first) == np.maximum.reduceat(x, first), x[first], BRANCH) for x in sides)


def _window_hashes(codes: np.ndarray, span: int, bits: int) -> np.ndarray:
    return windows(codes, span) & np.uint64(2**64 - 2 ** (64 - bits))


def _edges(span: int, k: int, bits: int, parts: int, chunk_docs: int, chunk_bytes: int):
    def run(batches):
        for batch in batches:
            chunks, texts, shared = (batch[c].to_pylist() for c in ("chunk", "text", "shared"))
            sizes = [len(t) for t in texts]
            bounds = [0, *(i for i in range(1, len(chunks)) if chunks[i] != chunks[i - 1]), len(chunks)] if chunks else []
            for start, end in zip(bounds, bounds[1:], strict=False):
                for lo, hi in slices(iter(sizes[start:end]), chunk_docs, chunk_bytes):
                    own = []
                    for i in range(start + lo, start + hi):
                        codes = word_codes(split_words(texts[i], lower=False))
                        at = np.flatnonzero(np.isin(minimizers(codes, span, k), np.frombuffer(shared[i], np.uint64)))
                        if len(at):
                            h = _window_hashes(codes, span, bits)[at]
                            order = np.argsort(h)
                            h, _, *sides = _merged(h[order], np.zeros(len(h), np.int64), *(x[at][order] for x in _neighbours(codes, span)))
                            own.append((h, *sides))
                    if not own:
                        continue
                    h, after, before = map(np.concatenate, zip(*own, strict=True))
                    order = np.argsort(h)
                    h, many, after, before = _merged(h[order], np.zeros(len(h), np.int64), after[order], before[order])
                    rows = [(p, chunks[start], planes(h[a:b]), np.packbits(many[a:b]).tobytes(), after[a:b].tobytes(), before[a:b].tobytes()) for p, a, b in _by_part(h, parts)]
                    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["part", "chunk", "hashes", "many", "after", "before"])

    return run


def _branches(t: pa.Table) -> pa.Table:
    """Of one hash range: the edges that several documents hold, for each chunk, and whether a path ends after or before each."""
    chunks = t["chunk"].to_pylist()
    hs = [from_planes(x) for x in t["hashes"].to_pylist()]
    bounds = np.cumsum([0, *map(len, hs)])
    many = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(h)) for x, h in zip(t["many"].to_pylist(), hs, strict=True)]).astype(np.int64)
    after, before = (np.frombuffer(b"".join(t[c].to_pylist()), np.uint32) for c in ("after", "before"))
    h = np.concatenate(hs)
    order = np.argsort(h)
    distinct, held, after, before = _merged(h[order], many[order], after[order], before[order])
    at = np.searchsorted(distinct, h)
    flags = ((after <= END) | (before <= END).astype(np.uint8) << 1).astype(np.uint8)[at]
    held, rows = held[at], []
    for i, c in enumerate(chunks):
        keep = np.flatnonzero(held[bounds[i] : bounds[i + 1]]) + bounds[i]
        if len(keep):
            rows.append((c, planes(h[keep]), flags[keep].tobytes()))
    c, h, f = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table([pa.array(c, pa.int64()), pa.array(h, pa.binary()), pa.array(f, pa.binary())], ["chunk", "hashes", "flags"])


MIXED = "chunk long, kind int, at int, doc_id long, n_words long, text string, hashes binary, flags binary, start long, n long"
PATHS = "chunk long, at int, doc_id long, start long, n long, first long, last long, digest binary"


def _path_table(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 8, kinds, strict=True)], [x.split()[0] for x in PATHS.split(", ")])


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _paths(span: int, bits: int):
    def run(t: pa.Table) -> pa.Table:
        """Of one chunk: each document's paths of repeated edges between branches."""
        mine, edges = t.filter(pc.equal(t["kind"], 0)), t.filter(pc.equal(t["kind"], 1))
        if not edges.num_rows:
            return _path_table([])
        h = np.concatenate([from_planes(x) for x in edges["hashes"].to_pylist()])
        flags = np.frombuffer(b"".join(edges["flags"].to_pylist()), np.uint8)
        order = np.argsort(h)
        h, flags = h[order], flags[order]
        rows = []
        for chunk, at, doc, text in zip(*(mine[c].to_pylist() for c in ("chunk", "at", "doc_id", "text")), strict=True):
            words = split_words(text, lower=False)
            own = _window_hashes(word_codes(words), span, bits)
            if not len(own):
                continue
            place = np.minimum(np.searchsorted(h, own), len(h) - 1)
            repeated = h[place] == own
            joined = repeated[1:] & repeated[:-1] & (flags[place[:-1]] & 1 == 0) & (flags[place[1:]] & 2 == 0)
            starts = np.flatnonzero(repeated & ~np.insert(joined, 0, False))
            ends = np.flatnonzero(repeated & ~np.append(joined, False))
            signed = own.view(np.int64)
            rows += [(chunk, at, doc, s, e - s + 1, int(signed[s]), int(signed[e]), _digest(words[s : e + span])) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
        return _path_table(rows)

    return run


def _single(span: int):
    def run(t: pa.Table) -> pa.Table:
        """Of one chunk: the windows of paths that hashes could not tell apart, a path each."""
        texts = {at: (c, d, x) for c, at, d, x, k in zip(*(t[c].to_pylist() for c in ("chunk", "at", "doc_id", "text", "kind")), strict=True) if k == 0}
        rows = []
        for at, start, n, kind in zip(*(t[c].to_pylist() for c in ("at", "start", "n", "kind")), strict=True):
            if kind:
                chunk, doc, text = texts[at]
                words = split_words(text, lower=False)
                rows += [(chunk, at, doc, s, 1, 0, 0, _digest(words[s : s + span])) for s in range(start, start + n)]
        return _path_table(rows)

    return run


def _remove(span: int):
    def run(t: pa.Table) -> pa.Table:
        mine, gone = t.filter(pc.equal(t["kind"], 0)), t.filter(pc.equal(t["kind"], 1))
        at, start, n = (gone[c].to_numpy() for c in ("at", "start", "n"))
        order = np.argsort(at, kind="stable")
        at, start, n = at[order], start[order], n[order]
        rows = []
        for a, doc, size, text in zip(*(mine[c].to_pylist() for c in ("at", "doc_id", "n_words", "text")), strict=True):
            words = split_words(text, lower=False)
            lo, hi = np.searchsorted(at, [a, a + 1])
            change = np.zeros(size + 1, np.int64)  # +1 where a path's first word is, -1 after its last
            np.add.at(change, start[lo:hi], 1)
            np.add.at(change, start[lo:hi] + n[lo:hi] + span - 1, -1)
            kept = [w for w, x in zip(words, (np.cumsum(change)[:size] > 0).tolist(), strict=True) if not x]
            rows.append((doc, size, size - len(kept), sha(kept), b" ".join(kept).decode("utf-8", "surrogatepass")))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        cols = zip(*rows, strict=True) if rows else [[]] * 5
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def _mixed(df: DataFrame, kind: int) -> DataFrame:
    """df as rows of MIXED, null where it has no such column."""
    names = [x.split() for x in MIXED.split(", ")]
    return df.select(*(F.lit(kind).alias(c) if c == "kind" else F.col(c) if c in df.columns else F.lit(None).cast(k).alias(c) for c, k in names))


def _verified(paths: DataFrame, rest: DataFrame, span: int, tasks: int) -> DataFrame:
    """paths whose ends and words agree wherever they meet others; the windows of all others."""
    clash = lambda end: paths.groupBy(end).agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select(end)
    heads, tails = written(clash("first")), written(clash("last"))
    if heads.isEmpty() and tails.isEmpty():
        return paths
    marked = paths.join(heads.withColumn("h", F.lit(1)), "first", "left").join(tails.withColumn("t", F.lit(1)), "last", "left")
    marked = written(marked.select(*paths.columns, F.coalesce("h", "t").isNotNull().alias("bad")))
    bad = marked.where("bad")
    own = rest.join(bad.select("chunk").distinct(), "chunk", "left_semi")
    single = _mixed(own, 0).union(_mixed(bad.select("chunk", "at", "start", "n"), 1)).repartition(tasks, "chunk").groupBy("chunk").applyInArrow(_single(span), PATHS)
    return written(marked.where("not bad").select(*paths.columns).union(single))


def remove_repeats(docs: DataFrame, span: int = 50, k: int = 20, bits: int = 64) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) of docs(doc_id, text).

    kept: the words that are left, joined by single blanks, of documents that lose words or might; null where the text
    stays as it is. Words are not lower-cased. Null, empty and blank texts have no words; rows with a null doc_id are left
    out. Rows of one doc_id count as one document for what repeats, and are returned each. An empty table gives an empty
    result; other columns are ignored. bits: of the windows' hashes, which decide what is compared and never what is
    removed; fewer, for tests, make them collide.
    """
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    (parts, chunk_docs, chunk_bytes), tasks = dealing(docs), tasks_for(docs)
    shared = shared_features(docs, lambda codes: minimizers(codes, span, k), False).groupBy("chunk").applyInArrow(_candidates, "doc_id long, shared binary")
    shared = written(shared.groupBy("doc_id").agg(F.array_join(F.collect_list(F.hex("shared")), "").alias("x")).select("doc_id", F.unhex("x").alias("shared")))
    kept = written(docs.join(shared, "doc_id", "left").select("doc_id", "text", "shared").mapInArrow(_done(chunk_docs, chunk_bytes), KEPT))
    rest = kept.where("text is not null").select("chunk", "at", "doc_id", "n_words", "text", "shared")
    edges = rest.select("chunk", "text", "shared").mapInArrow(_edges(span, k, bits, parts, chunk_docs, chunk_bytes), EDGES).repartition(tasks, "part")
    found = edges.groupBy("part").applyInArrow(_branches, "chunk long, hashes binary, flags binary")
    by_chunk = lambda other: _mixed(rest, 0).union(_mixed(other, 1)).repartition(tasks, "chunk").groupBy("chunk")
    paths = _verified(written(by_chunk(found).applyInArrow(_paths(span, bits), PATHS)), rest, span, tasks)
    owners = written(paths.groupBy("digest").agg(F.min("doc_id").alias("owner")))
    gone = paths.join(owners, "digest").where("owner < doc_id").select("chunk", "at", "start", "n")
    cut = by_chunk(gone).applyInArrow(_remove(span), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
    null = F.lit(None).cast("string").alias("kept")
    whole = kept.where("sha is not null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"), null)
    return whole.union(cut)
