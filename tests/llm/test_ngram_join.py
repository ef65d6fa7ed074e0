import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from tessera.llm.common import connected_components, shingles
from tessera.llm.ngram_join import count, deal, gathered, jaccard_components, trie_join


def sets_of(text):
    raw = (text or "").encode().lower().split()
    return {tuple(raw[i : i + 5]) for i in range(len(raw) - 4)} if len(raw) >= 5 else {tuple(raw)} if raw else set()


def brute(rows, t=0.8):
    """{doc_id: (n, component)} by comparing all pairs."""
    sets = [(d, sets_of(x)) for d, x in rows]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= round(100 * t) * len(x | y):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {d: (len(x), find(d)) for d, x in sets}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_odd_documents(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect() if r.doc_id is not None]
    assert result(jaccard_components(odd)) == brute(rows)
    assert jaccard_components(odd).count() == len(rows)
    assert jaccard_components(odd.limit(0)).collect() == []


@pytest.mark.parametrize("bounds", [{}, {"block_elements": 300, "block_docs": 6}, {"block_elements": 300, "block_docs": 6, "few_cuts": 1}])
def test_random_near_copies(spark, bounds):
    r = random.Random(5)
    bases = [[f"w{r.randrange(400)}" for _ in range(r.randrange(5, 90))] for _ in range(12)]
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for i in range(220):
        words = list(r.choice(bases))
        for _ in range(r.randrange(0, 5)):
            words[r.randrange(len(words))] = f"e{r.randrange(1000)}"
        if r.random() < 0.3:
            at = r.randrange(len(words))
            words[at:at] = passage
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(jaccard_components(df, **bounds)) == brute(rows)


def test_trie_against_all_pairs():
    r = np.random.default_rng(1)
    for _ in range(30):
        base = r.choice(10_000, 40, replace=False)
        sets = [np.unique(np.where(r.random(40) < 0.08, r.choice(10_000, 40), base)[: r.integers(25, 41)]).astype(np.uint64) for _ in range(14)]
        n = np.array([len(s) for s in sets])
        labels, want = trie_join(n, sets, 0.8), np.arange(14)
        for a in range(14):
            for b in range(a):
                o = len(set(sets[a].tolist()) & set(sets[b].tolist()))
                if 10 * o >= 8 * (n[a] + n[b] - o):
                    want[want == max(want[a], want[b])] = min(want[a], want[b])
        assert labels.tolist() == want.tolist()


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 200), (200, 250)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}, 200: 200, 250: 200, 300: 200}


def test_common_ngrams_are_an_entry_a_chunk():
    """A shingle that all documents of a chunk share goes to its hash range once, and its document frequency is whole."""
    texts = [f"one two three four five {i} {i} {i} x y" for i in range(50)] + ["", None, "one two three four five"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(53), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    chunks = [b for n in (batch, batch) for b in deal(lambda c: shingles(c, 5), True, 3, 100, 1 << 20)([n])]
    t = pa.Table.from_batches(chunks)
    assert sum(len(x) // 8 for x, k in zip(t["hashes"].to_pylist(), t["kind"].to_pylist()) if k == 2) == 2
    parts = [count(t.filter(pc.equal(t["part"], p))) for p in range(3)]
    back = pa.concat_tables(parts)
    own = pa.concat_tables([back.filter(pc.equal(back["chunk"], c)) for c in set(back["chunk"].to_pylist())])
    assert sum(k == 0 for k in own["kind"].to_pylist()) == 2
    rows = pa.Table.from_batches(chunks[: len(chunks) // 2])
    back = pa.concat_tables([count(rows.filter(pc.equal(rows["part"], p))) for p in range(3)])
    meta, h, d, df = gathered(back)
    assert len(meta) == 53 and sorted(d[df == 51].tolist()) == [*range(50), 52] and len(set(h[df == 51].tolist())) == 1 and set(df.tolist()) <= {51}
