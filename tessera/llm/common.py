"""Shared pieces of the training-data operators: durable intermediate tables, word hashing, tokenising, components."""

from __future__ import annotations

import string
from array import array
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.session import discard, shared_dir, written  # noqa: F401 - the operators take them from here

#: Entries kept by the per-worker word caches before they start anew; bounds the memory of a worker.
CACHE_ENTRIES = 300_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, longer where df has a column that Spark takes for the same."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of df, for a number of partitions; where it has none (rows from the driver), 8 MB a partition."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 58 else df.rdd.getNumPartitions() << 23


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tasks_for(df: DataFrame, bytes_each: int = 8 << 20) -> int:
    """How many tasks a shuffle of df's elements takes: from the input's size, as many as the session's at least."""
    return max(shuffle_partitions(df.sparkSession), min(-(-input_bytes(df) // bytes_each), 1 << 15))


def dealing(df: DataFrame) -> tuple[int, int, int]:
    """(hash ranges, documents a chunk, bytes a chunk) to deal df's elements with.

    Ranges grow with the input until a task holds about 100 MB of 100 TB; chunks grow with them, so that a chunk has 16
    elements or more for a range and rows stay packed.
    """
    parts = max(4 * shuffle_partitions(df.sparkSession), min(-(-input_bytes(df) // (8 << 20)), 1 << 20))
    chunk = min(max(8 << 20, 96 * parts), 96 << 20)
    return parts, min(1024 * chunk >> 23, (1 << 16) - 1), chunk


# -- words and hashes -------------------------------------------------------------------------------------------------


class WordHashes(dict):
    """64-bit hash by word; starts anew when full, so its memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = WordHashes()


def split_words(text: str | None, lower: bool) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of the whole text; lower: A-Z become a-z. Null and empty texts have none."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def word_codes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; fixed values: the multipliers of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def windows(codes: np.ndarray, k: int) -> np.ndarray:
    """A hash for each k consecutive codes."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    if k <= 8:
        h = np.zeros(n, np.uint64)
        for i in range(k):
            h = h * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n]
        return mixed(h)
    # a window of length k from two windows of half the length, which may overlap
    half = 1 << (k - 1).bit_length() - 1
    h, width = codes, 1
    while width < half:
        h = mixed(h[:-width] * np.uint64(0x9E3779B97F4A7C15) + h[width:] + np.uint64(width))
        width *= 2
    return mixed(h[:n] * np.uint64(0xD1B54A32D192ED03) + h[k - half : k - half + n] + np.uint64(k))


def shingles(codes: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of the k-word shingles, repeated ones included; with fewer words the whole sequence as one."""
    n = len(codes)
    if n == 0:
        return np.empty(0, np.uint64)
    return windows(codes, k) if n >= k else mixed(windows(codes, n) + np.uint64(n))


def planes(a: np.ndarray) -> bytes:
    """Little-endian bytes of a sorted uint64 array by significance, which the shuffle's codec then shrinks."""
    return np.ascontiguousarray(a, np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes()


def from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).reshape(-1).view(np.uint64)


def slices(sizes: Iterator[int], most_rows: int, most_bytes: int) -> Iterator[tuple[int, int]]:
    """Cuts one row or more of these sizes into runs of bounded rows and bytes; a longer row is a run of its own."""
    start = total = k = 0
    for k, size in enumerate(sizes):
        if k > start and (k - start >= most_rows or total + size > most_bytes):
            yield start, k
            start, total = k, 0
        total += size
    yield start, k + 1


# -- tokens -----------------------------------------------------------------------------------------------------------

_tokenizers: dict[tuple, object] = {}
_pieces: dict[str, dict] = {}


def tokenizer(path: str, ordinary: bool = False):
    """The tokenizer of a vocabulary file, loaded once in a worker; ordinary: special tokens' strings are ordinary text."""
    if (path, ordinary) not in _tokenizers:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = _tokenizers[path, ordinary] = Tokenizer.from_file(path)
        t.encode_special_tokens = ordinary
    return _tokenizers[path, ordinary]


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level BPE has for each byte; fixed values: the ranges that stay as they are."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_LETTERS = _byte_letters()


class Pieces(dict):
    """The ids of a text's pieces, as bytes; a piece that is new is encoded once. Starts anew when full.

    A piece of letters, perhaps with ASCII punctuation after it, is one or two words to the tokenizer's own splitting, so
    its BPE model encodes them directly, and forms with other punctuation share the letters' ids; where the tokenizer
    lower-cases, only Latin letters that NFC leaves alone and that have a single lower-case one. All other pieces take the
    whole tokenizer.
    """

    def __init__(self, path: str, lowers: bool):
        super().__init__()
        self.whole, self.lowers = tokenizer(path), lowers
        self.model = self.whole.model

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        core = piece.rstrip(string.punctuation)
        letters = core[1:] if core[:1] == " " else core
        if letters.isalpha() and (not self.lowers or letters.isascii() or max(letters) < "\u0250" and "\u0130" not in letters):
            if len(core) < len(piece):
                ids = self[core] + self[piece[len(core) :]]
            else:
                word = core.lower() if self.lowers else core
                raw = word if self.lowers and word.isascii() else word.encode("utf-8").decode("latin-1").translate(_LETTERS)
                ids = array("I", [t.id for t in self.model.tokenize(raw)]).tobytes()
        else:
            ids = array("I", self.whole.encode(piece, add_special_tokens=False).ids).tobytes()
        self[piece] = ids
        return ids


def encode_texts(path: str, texts: list[str | None], pattern, lowers: bool) -> list[np.ndarray]:
    """Token ids of whole texts, as the tokenizer gives them without special tokens.

    pattern finds the pieces of a text at whose bounds the tokenizer's own splitting always cuts, so that the ids of a
    text are those of its pieces; lowers: the tokenizer lower-cases and drops white space. All occurrences of a piece
    share its ids, which a bounded cache of the worker keeps. Null texts are empty.
    """
    if path not in _pieces:
        _pieces[path] = Pieces(path, lowers)
    ids = _pieces[path].__getitem__
    return [np.frombuffer(b"".join(map(ids, pattern.findall(t))) if t else b"", np.uint32) for t in texts]


# -- components -------------------------------------------------------------------------------------------------------


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a long, b long); root: the smallest node of its component.

    Each round hooks every node to its smallest neighbour, follows the hooks to their roots by pointer jumping and
    contracts the edges; at least half of the nodes that still have edges go in a round, so the rounds are
    logarithmic. Aggregates combine before they shuffle, and joins have plain exchanges that AQE can split, so a node
    with very many edges is no bottleneck. Every round is written to the shared folder.
    """
    pair = lambda a, b: [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]
    left = written(edges.where("a <> b").select(*pair("a", "b")).distinct())
    labels = None
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        up = written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("up")))
        while True:
            onto = up.select(F.col("node").alias("up"), F.col("up").alias("next"))
            up = written(up.join(onto, "up").select("node", F.col("next").alias("up"), (F.col("next") < F.col("up")).alias("moved")))
            moved = up.where("moved").isEmpty()
            up = up.select("node", "up")
            if moved:
                break
        root = up.select(F.col("node").alias("root"), "up")
        labels = up.withColumnRenamed("up", "root") if labels is None else written(labels.join(root, "root", "left").select("node", F.coalesce("up", "root").alias("root")))
        to = lambda c: up.select(F.col("node").alias(c), F.col("up").alias(f"{c}2"))
        left = written(left.join(to("a"), "a").join(to("b"), "b").where("a2 <> b2").select(*pair("a2", "b2")).distinct())
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    return labels
