"""Masked pseudo-likelihood scoring by a bidirectional window network that numpy trains.

Every word is predicted from the two words on either side: their embeddings, one layer of tanh, and a softmax in two steps,
over groups of the vocabulary and over a group's words, so that a vocabulary of thousands costs two of its square root.
The vocabulary is the corpus's most frequent words. The others are predicted as one of TAILS classes by their ends; within a
class a word has the probability of its count, by hash in a table of fixed size, whose cells hold how many occurrences and
how many different words of the corpus fell there. So the probabilities of all words sum to one wherever they stand.

Training is data-parallel over all documents: in each round every partition trains on its share of them from the same weights,
and the weights, averaged by words, start the next round. A document's score is the sum of the log probabilities of its words,
each masked in turn.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_ENTRIES, slices, written

PAD, TAILS, SIDE, BATCH, GROUP = 0, 15, 2, 16_384, 64
CELLS = 1 << 16  # of a tail class
TRAINERS, SUMS = 4096, 16  # partitions that train, and rows of weights that reach the driver


def _words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def _count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            seen.update(_words(text))
            if len(seen) > CACHE_ENTRIES:
                yield out()
                seen.clear()
    yield out()


def _tail(word: bytes) -> int:
    return 1 + crc32(word[-2:]) % TAILS


class Numbers(dict):
    """Numbers of words: those of the vocabulary after the pad and the classes of other words."""

    def __init__(self, words: list[bytes], counts: np.ndarray, different: np.ndarray):
        super().__init__()
        self.words = words
        self.counts, self.different = counts, different  # [class, cell]: occurrences and different words in the corpus
        self.totals = np.maximum(counts.sum(axis=1), 1)
        self._fill()

    def _fill(self) -> None:
        self.update((w, 1 + TAILS + i) for i, w in enumerate(self.words))

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES + len(self.words):
            self.clear()
            self._fill()
        n = self[word] = _tail(word)
        return n

    def __reduce__(self):
        return Numbers, (self.words, self.counts, self.different)

    def of(self, words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """(all numbers with SIDE pads around each text, positions of the words, words by text)."""
        pad, out = np.zeros(SIDE, np.int32), [np.zeros(SIDE, np.int32)]
        for w in words:
            out += [np.fromiter(map(self.__getitem__, w), np.int32, len(w)), pad]
        ids = np.concatenate(out)
        return ids, np.flatnonzero(ids), [len(w) for w in words]

    def within(self, words: list[list[bytes]], own: np.ndarray) -> np.ndarray:
        """The log probability of each word in its class, whose number is in own; 0 of the vocabulary's words. A word whose
        cell is empty counts as one that occurs once."""
        out = np.zeros(len(own))
        tail = np.flatnonzero(own <= TAILS)
        flat = [w for ws in words for w in ws]
        h = np.fromiter((xxhash.xxh64_intdigest(flat[i], 42) for i in tail.tolist()), np.uint64, len(tail))
        cell, c = (h % np.uint64(CELLS)).astype(np.int64), own[tail]
        out[tail] = np.log(np.maximum(self.counts[c, cell], 1) / np.maximum(self.different[c, cell], 1) / self.totals[c])
        return out


def _softmax(z: np.ndarray) -> np.ndarray:
    """Of each column, in place: numpy reduces long rows faster than many short ones."""
    z -= z.max(axis=0)
    np.exp(z, out=z)
    z /= z.sum(axis=0)
    return z


def _log_probability(z: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Of each column's number own, from logits, which are used up."""
    z -= z.max(axis=0)
    chosen = z[own, np.arange(z.shape[1])]
    np.exp(z, out=z)
    return chosen - np.log(z.sum(axis=0))


def by_group(own: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """(the order by group of numbers own, [(group, from, to)] in that order)."""
    group = (own // GROUP).astype(np.uint16)
    order = np.argsort(group, kind="stable")
    group = group[order]
    at = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(own)] if len(own) else [0]
    return order, [(int(group[a]), a, b) for a, b in zip(at, at[1:], strict=False)]


class Network:
    def __init__(self, size: int, width: int = 8, hidden: int = 24, seed: int = 7):
        r = np.random.default_rng(seed)
        self.size, self.width, self.hidden, self.groups = size, width, hidden, -(-size // GROUP)
        shapes = [(size, width), (2 * SIDE * width, hidden), (hidden,), (hidden, self.groups), (self.groups,), (self.groups, hidden, GROUP), (self.groups, GROUP)]
        self.p = [(r.standard_normal(s) * (0.3 if i in (0, 1, 3, 5) else 0)).astype(np.float32) for i, s in enumerate(shapes)]
        self.p[6].reshape(-1)[size:] = -30  # no such words

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.p])

    def load(self, flat: np.ndarray) -> Network:
        at = 0
        for i, x in enumerate(self.p):
            self.p[i] = flat[at : at + x.size].reshape(x.shape).astype(np.float32)
            at += x.size
        return self

    def hidden_layer(self, ids: np.ndarray, at: np.ndarray):
        """(numbers around, inputs, hidden layer, the groups' logits, a column a position) of positions."""
        e, w, b, u, c = self.p[:5]
        around = ids[at[:, None] + np.array([-2, -1, 1, 2])].astype(np.intp)
        x = e.take(around, axis=0).reshape(len(at), -1)
        h = x @ w
        h += b
        np.tanh(h, out=h)
        return around, x, h, self.logits(u, c, h)

    @staticmethod
    def logits(u: np.ndarray, c: np.ndarray, h: np.ndarray) -> np.ndarray:
        z = u.T @ h.T
        z += c[:, None]
        return z

    def log_probabilities(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.empty(len(at), np.float64)
        for lo in range(0, len(at), BATCH):
            some = at[lo : lo + BATCH]
            own = ids[some]
            h, z = self.hidden_layer(ids, some)[2:]
            found = _log_probability(z, own // GROUP)
            order, groups = by_group(own)
            h, inside, within = h[order], own[order] % GROUP, np.empty(len(some), z.dtype)
            for g, a, b in groups:
                within[a:b] = _log_probability(self.logits(self.p[5][g], self.p[6][g], h[a:b]), inside[a:b])
            found[order] += within
            out[lo : lo + BATCH] = np.maximum(found, -70)
        return out

    def train(self, ids: np.ndarray, at: np.ndarray, state: dict, rate: float = 0.01) -> None:
        """A step of Adam for each BATCH words."""
        for lo in range(0, len(at), BATCH):
            some = at[lo : lo + BATCH]
            n, own = len(some), ids[some]
            around, x, h, z = self.hidden_layer(ids, some)
            _softmax(z)
            z[own // GROUP, np.arange(n)] -= 1
            z /= n
            dh = z.T @ self.p[3].T
            du, dc = np.zeros_like(self.p[5]), np.zeros_like(self.p[6])
            order, groups = by_group(own)
            hs, inside, ds = h[order], own[order] % GROUP, np.empty_like(h)
            for g, a, b in groups:
                q = _softmax(self.logits(self.p[5][g], self.p[6][g], hs[a:b]))
                q[inside[a:b], np.arange(b - a)] -= 1
                q /= n
                du[g], dc[g] = (q @ hs[a:b]).T, q.sum(axis=1)
                ds[a:b] = q.T @ self.p[5][g].T
            dh[order] += ds
            dh *= 1 - h * h
            dx = (dh @ self.p[1].T).reshape(-1, self.width)
            de = np.stack([np.bincount(around.ravel(), dx[:, k], self.size) for k in range(self.width)], axis=1).astype(np.float32)
            state["t"] = t = state.get("t", 0) + 1
            for i, g in enumerate((de, x.T @ dh, dh.sum(axis=0), (z @ h).T, z.sum(axis=1), du, dc)):
                if ("m", i) not in state:
                    state["m", i], state["v", i] = np.zeros_like(g), np.zeros_like(g)
                m, v = state["m", i], state["v", i]
                m *= 0.9
                m += 0.1 * g
                v *= 0.99
                v += 0.01 * g * g
                self.p[i] -= (rate / (1 - 0.9**t)) * m / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)


def _summed(t: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.float32).astype(np.float64) * n for x, n in zip(t["w"].to_pylist(), t["n"].to_pylist(), strict=True))
    return pa.table([pa.array([total.tobytes()], pa.binary()), pa.array([sum(t["n"].to_pylist())], pa.int64())], ["w", "n"])


def train(docs: DataFrame, vocabulary: int = 4080, rounds: int = 2) -> tuple[Numbers, Network]:
    """The network trained on every document of docs(doc_id, text) once, a share of them a round.

    Bounds: `vocabulary` words, CELLS counts for each of TAILS classes, TRAINERS partitions. Null and empty texts train nothing;
    without any words the network is as it was drawn.
    """
    counts = docs.select("text").mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = written(counts)
    top = [(bytes(w), n) for w, n in counts.orderBy(F.desc("n"), "word").limit(vocabulary).collect()]
    known = docs.sparkSession.createDataFrame([(w,) for w, _ in top], "word binary")
    tail = counts.join(F.broadcast(known), "word", "left_anti")  # at most `vocabulary` rows
    part = (F.crc32(F.expr("substring(word, -2, 2)")) % TAILS + 1).cast("int").alias("class")
    # the cell is of the unsigned hash, as in within()
    cells = tail.select(part, F.xxhash64("word").bitwiseAND(F.lit(CELLS - 1)).cast("int").alias("cell"), "n")
    cells = cells.groupBy("class", "cell").agg(F.sum("n").alias("n"), F.count("*").alias("words")).toArrow()  # TAILS * CELLS rows at most
    own, different = np.zeros((1 + TAILS, CELLS)), np.zeros((1 + TAILS, CELLS), np.int32)
    at = cells["class"].to_numpy(), cells["cell"].to_numpy()
    own[at], different[at] = cells["n"].to_numpy(), cells["words"].to_numpy()
    words = Numbers([w for w, _ in top], own, different)
    context = docs.sparkSession.sparkContext
    numbers, size = context.broadcast(words), 1 + TAILS + len(top)
    network = Network(size)
    for r in range(rounds):
        weights = context.broadcast(network.flat())

        def run(batches, weights=weights):
            own, state, seen = Network(size).load(weights.value), {}, 0
            for batch in batches:
                texts = batch.column(0).to_pylist()
                for lo, hi in slices((len(t or "") for t in texts), 1000, 2 << 20) if texts else ():
                    ids, at, _ = numbers.value.of([_words(t) for t in texts[lo:hi]])
                    own.train(ids, at, state)
                    seen += len(at)
            if seen:
                k = TaskContext.get().partitionId() % SUMS
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([own.flat().tobytes()], pa.binary()), pa.array([seen], pa.int64())], ["k", "w", "n"])

        share = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == r).select("text").coalesce(TRAINERS)  # each document in one round
        found = share.mapInArrow(run, "k int, w binary, n long").groupBy("k").applyInArrow(_summed, "w binary, n long").collect()
        if found:
            network.load(sum(np.frombuffer(x["w"]) for x in found) / sum(x["n"] for x in found))
    return words, network


def score(docs: DataFrame, numbers: Numbers, network: Network) -> DataFrame:
    """(doc_id, n_words, log_likelihood, mean) of every row of docs(doc_id, text).

    log_likelihood: the sum over the words of the log probability of each given the others; 0 and a null mean for texts that
    are null, empty or blank. Very long texts are scored whole. A null doc_id is kept, repeated rows are scored each, an empty table gives an empty result,
    other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(numbers)

    def run(batches):
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in slices((len(t or "") for t in texts), 1000, 2 << 20) if texts else ():
                words = [_words(t) for t in texts[lo:hi]]
                ids, at, n = shared.value.of(words)
                total = np.concatenate([[0], np.cumsum(network.log_probabilities(ids, at) + shared.value.within(words, ids[at]))])
                ends = np.concatenate([[0], np.cumsum(n)])
                sums = total[ends[1:]] - total[ends[:-1]]
                means = [s / k if k else None for s, k in zip(sums.tolist(), n, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs[lo:hi], pa.int64()), pa.array(n, pa.int64()), pa.array(sums), pa.array(means, pa.float64())], ["doc_id", "n_words", "log_likelihood", "mean"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, log_likelihood double, mean double")
