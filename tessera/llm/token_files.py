"""Token-id files in a compressed binary format.

A file's rows are segments of whole documents: a header, an index of documents, and blocks of an adaptive context-mixing
range coder. A block holds a bounded number of ids and starts from fresh statistics. CRC-32 sums guard the header, every
block's bytes and every block's decoded ids, so that a damaged one is found.

The coder predicts an id from three orders. By the hash of the last two ids and by that of the last one, tables hold the
id that came then and how often it was right; each order has counts of what came in its context: order 2's id, order 1's id,
or another. The orders' probabilities are mixed with weights that follow how well each predicted. Another id is coded by
order 0: adaptive counts of all ids, as a tree whose nodes hold what is to their left, over a prior that falls with the id.
Blocks are coded in lockstep, a lane each, so that numpy does the arithmetic of many blocks at once; all of it is integers or
single IEEE operations, so that decoding repeats it exactly. The encoder, which knows all ids, counts order 0 over whole blocks.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import encode_texts, input_bytes, shuffle_partitions, slices, written

MAGIC, HEADER = b"TSR3", struct.Struct("<4sIQIBI")  # magic, documents, ids, ids of a block, bits of an id, bytes of the index

#: Pieces at whose bounds the word tokenizer always cuts: it drops white space and merges nothing across it.
WORD_PIECES = re.compile(r"[^ \t\n\r\x0b\x0c]+")
U = np.uint64
SLOTS, CONFIDENT, MOST_BITS, NODES = 1 << 11, 3, 24, 1 << 26
HIT2, HIT1, OTHER = 0, 1, 2
ORDERS = np.arange(3)[:, None]
CONTEXTS = 1 + 2 * (CONFIDENT + 1)  # of a lane: order 0, and orders 1 and 2 by their confidence
START, STEP, HALVE_EVERY, TOTAL_BITS, FORGET = (1.0, 1.0, 6.0), 2.0, 128, 16, 0.03
GAIN, TOP, BOTTOM = 64, U(1 << 48), U(1 << 44)
ROW = np.dtype("V32")  # a node's 16 counts, moved as one


class _Tree:
    """What all lanes share of order 0: the prior of ids of so many bits, and where a path's nodes lie.

    A node has 16 children, by four bits of the id, and is a row of 16 counts, so that a path touches a row for each four bits.
    """

    def __init__(self, bits: int):
        self.size = 1 << bits
        self.prior = 1 + (1 << 14) // (np.arange(self.size, dtype=np.int64) + 256)
        self.below = np.concatenate([[0], np.cumsum(self.prior)])
        self.total = int(self.below[-1])
        self.shifts = np.arange(0, bits, 4)[::-1]
        counts = ((self.size - 1) >> self.shifts + 4) + 1
        self.first = np.cumsum(counts) - counts
        self.nodes = int(counts.sum())
        self.up_to = np.zeros((self.nodes, 16), np.int32)  # the prior of a node's children up to each
        for first, n, shift in zip(self.first.tolist(), counts.tolist(), self.shifts.tolist(), strict=True):
            bounds = self.below[np.minimum(np.arange(16 * n + 1) << shift, self.size)]
            self.up_to[first : first + n] = bounds[1:].reshape(n, 16) - bounds[:-1:16, None]


#: What an id adds to a node's counts, by its child: one to those of this child and of the children to its right.
_UP_TO = (np.arange(16) >= np.arange(16)[:, None]).astype(np.uint16)
_trees: dict[int, _Tree] = {}


class _Model:
    """The statistics of every lane; encoder and decoder drive it alike."""

    def __init__(self, lanes: int, bits: int):
        self.at = np.arange(lanes)
        if bits not in _trees:
            _trees[bits] = _Tree(bits)
        self.tree = _trees[bits]
        self.table = np.zeros(2 * lanes * SLOTS, np.uint32)  # of orders 1 and 2: an id, and how sure it is in the last two bits
        self.counts = np.repeat(np.array(START, np.float32)[:, None], lanes * CONTEXTS, axis=1)  # by symbol
        self.weights = np.full((3, lanes), 1 / 3, np.float32)
        self.own = ORDERS * lanes + self.at  # places of the orders and lanes
        self.slot = np.stack([self.at * SLOTS, (lanes + self.at) * SLOTS])
        self.context = np.stack([self.at * CONTEXTS, self.at * CONTEXTS + 1, self.at * CONTEXTS + 2 + CONFIDENT])
        self.left, self.seen = np.zeros((lanes * self.tree.nodes, 16), np.uint16), np.zeros(lanes, np.int64)  # ids up to a node's child
        self.root = self.at * self.tree.nodes
        self.hashes, self.mixed_last = np.zeros((2, lanes), np.uint32), np.zeros(lanes, np.uint32)
        self.cumulative = np.zeros((4, lanes), np.int64)
        self.cumulative[3] = 1 << TOTAL_BITS
        self.steps = 0

    def look(self) -> np.ndarray:
        """The ids of orders 1 and 2, rows over the lanes."""
        self.s = self.slot + (self.hashes >> np.uint32(21))
        self.found = self.table.take(self.s)
        self.guess, self.sure = self.found >> np.uint32(2), self.found & np.uint32(3)
        return self.guess

    def note(self, ids: np.ndarray) -> None:
        """What came, as 32 bits, after look()."""
        miss = np.where(self.sure > 1, self.found - np.uint32(1), ids << np.uint32(2))
        self.table[self.s] = np.where(self.guess == ids, self.found + (self.sure < CONFIDENT), miss)
        np.multiply(ids, np.uint32(0x9E3779B1), out=self.hashes[0])
        np.bitwise_xor(self.hashes[0], self.mixed_last, out=self.hashes[1])
        self.hashes[1] *= np.uint32(0xC2B2AE3D)
        self.mixed_last = ids * np.uint32(0x85EBCA77)

    def predict(self, sure: np.ndarray) -> np.ndarray:
        """Cumulative frequencies of HIT2, HIT1 and OTHER where orders 1 and 2 are so sure."""
        self.k = self.context.copy()
        self.k[1:] += sure
        n = self.counts.take(self.k, axis=1)  # by symbol, order and lane
        self.p = n / (n[0] + n[1] + n[2])
        mixed = self.p[:2] * self.weights
        mixed = mixed[:, 0] + mixed[:, 1] + mixed[:, 2]
        mixed *= (1 << TOTAL_BITS) - 8  # what rounding may add to the sum is left to OTHER
        np.add(mixed.astype(np.int32), 1, out=self.cumulative[1:3])
        self.cumulative[2] += self.cumulative[1]
        return self.cumulative.view(np.uint64)

    def learn(self, symbol: np.ndarray) -> None:
        counts = self.counts.reshape(-1)
        place = len(counts) // 3 * symbol + self.k
        counts[place] = counts.take(place) + STEP
        w = self.weights * self.p.reshape(-1).take(3 * len(self.at) * symbol + self.own)
        self.weights = w * ((1 - FORGET) / (w[0] + w[1] + w[2])) + FORGET / 3
        self.steps += 1
        if self.steps % HALVE_EVERY == 0:
            self.counts = self.counts * 0.5 + 0.25

    def share(self, lanes: np.ndarray, x: np.ndarray, at=None, rows=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of ids of some lanes by order 0: (frequencies below, own frequencies, totals); then order 0 learns them.

        at, rows: the nodes of the ids' paths and what is there, where find() has just found them.
        """
        t, nodes, below = self.tree, self.left.view(ROW).reshape(-1), None
        if at is None:
            up = x >> t.shifts[:, None]
            child = up & 15
            at = (up >> 4) + t.first[:, None]
            at += self.root.take(lanes)
            rows = nodes.take(at).view(np.uint16)
        else:
            at, rows, child, below = at.T, rows.transpose(1, 0, 2), self.child, self.below
        rows = rows.reshape(-1, 16)
        more = rows + _UP_TO.take(child.reshape(-1), axis=0)
        for level, new in zip(at, more.view(ROW).reshape(at.shape), strict=True):
            nodes[level] = new
        flat, place = rows.reshape(-1), np.arange(0, 16 * child.size, 16).reshape(child.shape) + child
        if below is None:
            below = t.below.take(x) + GAIN * (flat.take(place - 1, mode="wrap") * (child > 0)).sum(axis=0, dtype=np.int64)
        own = flat.take(place[-1]) - flat.take(place[-1] - 1, mode="wrap") * (child[-1] > 0)
        seen = self.seen.take(lanes)
        self.seen[lanes] = seen + 1
        own = t.prior.take(x) + own * np.int64(GAIN)
        return below.view(np.uint64), own.view(np.uint64), (t.total + GAIN * seen).view(np.uint64)

    def find(self, lanes: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of some lanes in whose frequencies the values fall, with the nodes of their paths and what is there."""
        t, nodes, rest = self.tree, self.left.view(ROW).reshape(-1), value.astype(np.int32)
        n = len(lanes)
        x, root, each = np.zeros(n, np.int64), self.root.take(lanes), np.arange(-1, 16 * n - 1, 16)
        at, rows, self.child = np.empty((len(t.shifts), n), np.int64), np.empty((len(t.shifts), 16 * n), np.uint16), np.empty((len(t.shifts), n), np.int64)
        for level, first in enumerate(t.first.tolist()):
            node = x + first
            at[level] = own = root + node
            rows[level] = found = nodes.take(own).view(np.uint16)
            up_to = found.astype(np.int32)
            up_to *= GAIN
            up_to += t.up_to.take(node, axis=0).reshape(-1)
            past = np.bitwise_count((rest.repeat(16) >= up_to).view(np.uint64))
            child = self.child[level]
            np.add(past[::2], past[1::2], out=child)
            rest -= up_to.take(each + child, mode="wrap") * (child > 0)
            x = 16 * x + child
        self.below = value.astype(np.int64) - rest
        return x, at.T, rows.reshape(-1, n, 16).transpose(1, 0, 2)


def _earlier(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each id of each row, how many before it in the row are smaller, and how many are the same; rows of 2^n ids, 2^16 at most.

    In ascending order, where the same ids stay in order of time, those of a row's first half that precede one of its
    second half are earlier and smaller or the same; then so within each half.
    """
    rows, n = ids.shape
    at = (np.argsort(ids, axis=1, kind="stable") + np.arange(0, rows * n, n)[:, None]).reshape(-1)
    ranked = ids.reshape(-1).take(at)
    place, first = np.arange(rows * n, dtype=np.int32), np.zeros(rows * n, np.int32)
    np.multiply(place[1:], ranked[1:] != ranked[:-1], out=first[1:])
    first[::n] = place[::n]
    same_ranked = place - np.maximum.accumulate(first)
    same = np.empty_like(first)
    same[at] = same_ranked
    # in a word of 32 bits: how many are smaller (less those that are the same, which count as before it), and the time
    both, half = (-same_ranked << 16 | (at & (n - 1)).astype(np.int32)).view(np.uint32), n // 2
    while half:
        late = (both & np.uint32(half)) != 0
        ones = np.flatnonzero(late)
        before = ones.astype(np.uint32).reshape(-1, half) - np.arange(half, dtype=np.uint32)
        before -= np.arange(0, rows * n, 2 * half, dtype=np.uint32)[:, None]
        parts = both.take(np.flatnonzero(~late)).reshape(-1, half), both.take(ones).reshape(-1, half) + (before << np.uint32(16))
        both, half = np.stack(parts, axis=1).reshape(-1), half // 2
    return (both >> np.uint32(16)).astype(np.int32).reshape(rows, n), same.reshape(rows, n)


def _shares(tree: _Tree, ids: np.ndarray, other: np.ndarray) -> np.ndarray:
    """What _Model.share gives step by step for the ids (rows over the lanes) that are coded by order 0; 0, 1 and 1 for others."""
    out = np.empty((3, *ids.shape), np.uint32)
    for lo in range(0, ids.shape[1], 32):
        taken, every = np.ascontiguousarray(other[:, lo : lo + 32].T), np.ascontiguousarray(ids[:, lo : lo + 32].T)
        at, seen = np.flatnonzero(taken), taken.sum(axis=1)
        x = every.reshape(-1).take(at)
        row = np.zeros((len(seen), 1 << int(seen.max(initial=1) - 1).bit_length()), np.uint16 if tree.size <= 1 << 16 else np.uint32)
        turn = np.arange(len(at)) - np.repeat(np.cumsum(seen) - seen, seen)
        place = turn + np.repeat(np.arange(0, row.size, row.shape[1]), seen)
        row.reshape(-1)[place] = x
        smaller, same = (a.reshape(-1).take(place) for a in _earlier(row))
        shares = tree.below.take(x) + GAIN * smaller, tree.prior.take(x) + GAIN * same, tree.total + GAIN * turn
        for i, share in enumerate(shares):
            part = np.full(taken.shape, min(i, 1), np.uint32)
            part.reshape(-1)[at] = share
            out[i, :, lo : lo + 32] = part.T
    return out


def _settle(low: np.ndarray, width: np.ndarray, move) -> None:
    """Shifts out settled 16-bit words of the lanes' ranges until every range has 44 bits or more; move(lanes, lows) does it."""
    l, w, lanes = low, width, None
    while True:
        straddles, narrow = (l ^ (l + w)) >= TOP, w < BOTTOM
        go = (straddles <= narrow).nonzero()[0]
        if not len(go):
            return
        cut = (straddles & narrow).nonzero()[0]
        if len(cut):
            w[cut] = (U(0) - l[cut]) & (BOTTOM - U(1))
        lanes, l = go if lanes is None else lanes.take(go), l.take(go)
        move(lanes, l)
        l, w = l << U(16), w.take(go) << U(16)
        low[lanes], width[lanes] = l, w


def encode_blocks(blocks: list[np.ndarray], bits: int) -> list[bytes]:
    """The payload of each array of ids of so many bits, all coded in lockstep; shorter ones are filled up with zeros."""
    lanes, steps = len(blocks), max(map(len, blocks))
    ids = np.zeros((steps, lanes), np.uint32)
    for lane, block in enumerate(blocks):
        ids[: len(block), lane] = block
    model = _Model(lanes, bits)
    symbols, sure = np.empty((steps, lanes), np.int8), np.empty((steps, 2, lanes), np.uint8)
    for t, x in enumerate(ids):
        guess = model.look()
        symbols[t], sure[t] = np.where(x == guess[1], HIT2, np.where(x == guess[0], HIT1, OTHER)), model.sure
        model.note(x)
    shares = _shares(model.tree, ids, symbols == OTHER)
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, U(2**64 - 1))
    words = np.zeros((lanes, 3 * steps + 8), "<u2")
    flat, start = words.reshape(-1), model.at * words.shape[1]
    at = start.copy()

    def move(go, lows):
        to = at.take(go)
        flat[to] = lows >> U(48)
        at[go] = to + 1

    for t in range(steps):
        cumulative, symbol = model.predict(sure[t]), symbols[t].astype(np.int64)
        place = symbol * lanes + model.at
        below = cumulative.reshape(-1).take(place)
        width >>= U(TOTAL_BITS)
        low += width * below
        width *= cumulative.reshape(-1).take(place + lanes) - below
        width //= shares[2, t]
        low += width * shares[0, t]
        width *= shares[1, t]
        _settle(low, width, move)
        model.learn(symbol)
    for shift in (48, 32, 16, 0):
        flat[at] = low >> U(shift) & U(0xFFFF)
        at += 1
    return [words[lane, :n].tobytes() for lane, n in enumerate((at - start).tolist())]


def decode_blocks(payloads: list[bytes], lengths: list[int], bits: int) -> list[np.ndarray]:
    """What encode_blocks was given, from its payloads and the arrays' lengths."""
    lanes, steps = len(payloads), max(lengths)
    words = np.frombuffer(b"".join([*payloads, bytes(6 * steps + 16)]), "<u2")
    at = np.cumsum([0, *(len(p) // 2 for p in payloads[:-1])])
    model = _Model(lanes, bits)
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, U(2**64 - 1))
    code = np.zeros(lanes, np.uint64)
    for _ in range(4):
        code = code << U(16) | words.take(at)
        at += 1
    ids = np.zeros((steps, lanes), np.uint32)

    def move(go, lows):
        next_ = at.take(go)
        code[go] = code.take(go) << U(16) | words.take(next_)
        at[go] = next_ + 1

    for t in range(steps):
        guess = model.look()
        cumulative = model.predict(model.sure)
        width >>= U(TOTAL_BITS)
        ahead = code - low
        symbol = (ahead >= width * cumulative[1]).astype(np.int64) + (ahead >= width * cumulative[2])
        place = symbol * lanes + model.at
        below = cumulative.reshape(-1).take(place)
        low += width * below
        width *= cumulative.reshape(-1).take(place + lanes) - below
        x = np.where(symbol == HIT2, guess[1], guess[0])
        other = (symbol == OTHER).nonzero()[0]
        if len(other):
            total = (model.tree.total + GAIN * model.seen.take(other)).view(np.uint64)
            r, start = width.take(other) // total, low.take(other)
            found, *path = model.find(other, np.minimum((code.take(other) - start) // r, total - U(1)))
            x[other] = found
            below, own, _ = model.share(other, found, *path)
            low[other] = start + r * below
            width[other] = r * own
        _settle(low, width, move)
        model.learn(symbol)
        model.note(x)
        ids[t] = x
    return [ids[:n, lane].copy() for lane, n in enumerate(lengths)]


def _in_groups(code, bits: int, *lists: list) -> list:
    """code(...) of some lanes at a time, so that the trees of order 0 take bounded memory."""
    most, out = max(1, NODES >> bits), []
    for lo in range(0, len(lists[0]), most):
        out += code(*(x[lo : lo + most] for x in lists), bits)
    return out


# -- segments: a file's rows ------------------------------------------------------------------------------------------


def pack_segment(docs: list[int | None], ids: list[np.ndarray], block_ids: int) -> bytes:
    """The bytes of a segment: a header, the zlib-packed index (doc ids, whether null, lengths), the blocks' table, payloads."""
    every = np.concatenate(ids)
    bits = max(1, int(every.max(initial=0)).bit_length())
    if bits > MOST_BITS:
        raise ValueError(f"ids of more than {MOST_BITS} bits")
    if min(block_ids, len(every)) >= 1 << 16:
        raise ValueError("blocks of 65536 ids or more, whose counts have 16 bits")
    blocks = [every[i : i + block_ids] for i in range(0, len(every), block_ids)]
    payloads = _in_groups(encode_blocks, bits, blocks)
    index = zlib.compress(np.array([[d or 0 for d in docs], [d is None for d in docs], [len(x) for x in ids]], "<i8").tobytes(), 1)
    own = np.array([[len(p), zlib.crc32(p), zlib.crc32(b.astype("<u4").tobytes())] for p, b in zip(payloads, blocks, strict=True)], "<u4").tobytes()
    head = HEADER.pack(MAGIC, len(docs), len(every), block_ids, bits, len(index))
    return b"".join([head, zlib.crc32(head + index + own).to_bytes(4, "little"), index, own, *payloads])


def read_segment(data: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    """The doc ids and token ids of a segment; ValueError if a checksum doesn't hold."""
    magic, docs, n, block_ids, bits, size = HEADER.unpack_from(data)
    at, count = HEADER.size + 4, -(-n // max(block_ids, 1))
    index, own = data[at : at + size], data[at + size : at + size + 12 * count]
    if magic != MAGIC or zlib.crc32(data[: HEADER.size] + index + own) != int.from_bytes(data[at - 4 : at], "little"):
        raise ValueError("damaged segment header")
    doc, null, lengths = np.frombuffer(zlib.decompress(index), "<i8").reshape(3, docs)
    at += size + 12 * count
    payloads, checks = [], np.frombuffer(own, "<u4").reshape(-1, 3).tolist()
    for b, (length, crc, _) in enumerate(checks):
        payloads.append(data[at : at + length])
        at += length
        if zlib.crc32(payloads[-1]) != crc:
            raise ValueError(f"damaged block {b}")
    blocks = _in_groups(decode_blocks, bits, payloads, [min(block_ids, n - b * block_ids) for b in range(count)])
    for b, (block, (_, _, crc)) in enumerate(zip(blocks, checks, strict=True)):
        if zlib.crc32(block.astype("<u4").tobytes()) != crc:
            raise ValueError(f"block {b} decodes to other ids")
    return [None if x else d for d, x in zip(doc.tolist(), null.tolist(), strict=True)], np.split(np.concatenate(blocks), np.cumsum(lengths)[:-1])


def _write(path: str, end_id: int, block_ids: int, segment_ids: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        seq, docs, ids, n, end = 0, [], [], 0, np.array([end_id], np.uint32)

        def row():
            names = ["part", "seq", "n_docs", "n_ids", "data"]
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([seq]), pa.array([len(docs)]), pa.array([n]), pa.array([pack_segment(docs, ids, block_ids)])], names)

        for batch in batches:
            doc, text = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in slices((len(t or "") for t in text), 1000, 4 << 20) if text else ():
                for d, x in zip(doc[lo:hi], encode_texts(path, text[lo:hi], WORD_PIECES, True), strict=True):
                    docs.append(d)
                    ids.append(np.concatenate([x, end]))
                    n += len(x) + 1
                    if n >= segment_ids:
                        yield row()
                        seq, docs, ids, n = seq + 1, [], [], 0
        if docs:
            yield row()

    return run


def write_tokens(docs: DataFrame, tokenizer_path: str, out: str, end_id: int = 1, block_ids: int = 2048, segment_ids: int = 1 << 21) -> None:
    """Writes the token ids of docs(doc_id, text), each with the end id, as segments in ascending order of doc_id to `out`.

    Rows with a null doc_id come first; rows of the same doc_id are ordered by text; null and empty texts are the end id
    alone; other columns are ignored; an empty table gives no segments. Ids of more than 24 bits are an error.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    parts = max(shuffle_partitions(docs.sparkSession), -(-min(input_bytes(docs), 1 << 50) // (32 << 20)))
    keys = ["doc_id", F.xxhash64("text")]
    rows = rows.repartitionByRange(parts, *keys).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    rows.mapInArrow(_write(tokenizer_path, end_id, block_ids, segment_ids), "part long, seq long, n_docs long, n_ids long, data binary").write.parquet(out)


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for base, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            docs, ids = read_segment(data.as_py())
            starts = base + np.cumsum([0, *map(len, ids[:-1])])
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())], ["doc_id", "start", "ids"])


def read_tokens(files: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of written segments; start: how many ids lie before the document's in the order of the files."""
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    own = files.select("part", "seq", "n_ids").select("part", "seq", (F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")).alias("own"))
    base = written(own.join(before, "part").select("part", "seq", (F.col("own") + F.col("before")).alias("base")))
    if base.count() <= 1_000_000:  # 24 bytes a row
        base = F.broadcast(base)
    return files.join(base, ["part", "seq"]).select("base", "data").mapInArrow(_read, "doc_id long, start long, ids binary")
