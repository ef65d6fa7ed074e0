"""Chat formatting, top-k search, decontamination, PII, quality, masked LM and the pipeline."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm.chat import format_chats, intersect, parse, read_back, render
from tessera.llm.common import shared_dir, tokenizer
from tessera.llm.decontaminate import align, decontaminated, find_leaks
from tessera.llm.masked_lm import Network, _log_probability, _softmax, score, train
from tessera.llm.pii import _drawn_anew, pseudonymised
from tessera.llm.quality import Model, Vocabulary, classify, fit, kept, perplexities
from tessera.llm.topk import INDEX, _Best, _block, _search_block, at_least, build_index, coarse_sums, inner, kth_largest, top_k

TEXT = st.text(st.sampled_from("\\#/<>turn: \nAé\U0001f600"), max_size=30)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), max_size=4))
def test_rendering_reads_back(turns):
    text, spans = render(turns, {r for r, _ in turns[:1]})
    assert parse(text) == turns
    assert len(spans) == sum(r == turns[0][0] for r, _ in turns) if turns else spans == []


def test_intersection():
    tokens = np.array([[0, 3], [3, 5], [5, 6], [5, 6], [6, 9]])  # two tokens share a character
    mask, a, b = intersect(tokens, [(1, 4), (5, 7)])
    assert mask.tolist() == [1, 1, 1, 1, 1] and list(zip(a, b)) == [(1, 3), (3, 4), (5, 6), (6, 7)]
    mask, a, b = intersect(tokens, [(3, 3)])
    assert not mask.any() and not len(a)


def test_chats(spark):
    rows = [(1, 0, "user", "hi ### x"), (1, 1, "assistant", " </turn> \\ \U0001f600\n"), (1, 2, "assistant", ""), (1, 3, "assistant", "<|endoftext|>"), (2, None, None, None), (None, 0, "assistant", "no id"), (2, 5, "assistant", "x" * 5000), (2, 5, "assistant", "x" * 5000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, mask string")
    out = format_chats(df, public_tokenizers.path("byte_bpe_50k.json"))
    back = {r.conv_id: r for r in read_back(out).collect()}
    for conv in (1, 2, None):
        own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "", r[2] or ""))
        assert [(t.role, t.text) for t in back[conv].turns] == [(r[1] or "", r[2] or "") for r in own]
        assert "".join(back[conv].loss) == "".join(r[2] or "" for r in own if r[1] == "assistant")
    masks = {r.conv_id: r for r in out.collect()}
    decoder = tokenizer(public_tokenizers.path("byte_bpe_50k.json"), ordinary=True)
    for r in masks.values():  # the mask by token holds the texts under the loss, and no more than a token's rest around them
        loss = decoder.decode([i for i, m in zip(r.ids, r.mask) if m], skip_special_tokens=False)
        spans = "".join(r.formatted[a:b] for a, b in zip(r.loss_starts, r.loss_ends))
        rest = iter(loss)
        assert all(c in rest for c in spans) and len(loss) - len(spans) <= 16 * sum(t.role == "assistant" for t in back[r.conv_id].turns)
    assert len(masks[1].mask) == len(masks[1].ids) and 0 < sum(masks[1].mask) < len(masks[1].mask)
    assert format_chats(df.limit(0), public_tokenizers.path("byte_bpe_50k.json")).collect() == []


def test_bit_slices():
    r = np.random.default_rng(2)
    c, w = r.integers(0, 8, (5, 130)), r.integers(-7, 8, (6, 5))
    padded = np.zeros((5, 192), np.uint8)
    padded[:, :130] = c
    slices = np.stack([np.packbits(padded >> s & 1, axis=1, bitorder="little") for s in range(3)], axis=1).view(np.uint64)
    total = coarse_sums(slices, w)
    want = np.where(w[:, :, None] >= 0, w[:, :, None] * c, -w[:, :, None] * (7 - c)).sum(axis=1)
    bits = lambda x: np.unpackbits(np.ascontiguousarray(x).view(np.uint8), axis=1, bitorder="little")[:, :130].astype(int)
    assert (sum(bits(t) << i for i, t in enumerate(total)) == want).all()
    valid = np.tile(np.packbits(np.arange(192) < 130, bitorder="little").view(np.uint64), (6, 1))
    assert (kth_largest(total, valid, 4) == np.sort(want, axis=1)[:, -4]).all()
    assert (kth_largest(total, valid, 131) == -1).all()
    bound = np.sort(want, axis=1)[:, -4]
    assert (bits(at_least(total, valid, bound)) == (want >= bound[:, None])).all()


def test_sums_take_few_operations(monkeypatch):
    """About five of whole bitmaps for each slice that is added, however many levels the sums have."""
    r, ops = np.random.default_rng(23), []
    slices, weights = r.integers(0, 2**63, (64, 3, 2)).astype(np.uint64), r.integers(-7, 8, (5, 64))

    class Counted(np.ndarray):
        def __array_ufunc__(self, ufunc, method, *inputs, out=None, **kw):
            ops.append(ufunc.__name__)
            plain = lambda x: x.view(np.ndarray) if isinstance(x, Counted) else x
            done = getattr(ufunc, method)(*map(plain, inputs), **({"out": tuple(map(plain, out))} if out else {}), **kw)
            return out[0] if out else done.view(Counted) if isinstance(done, np.ndarray) else done

    zeros = np.zeros
    monkeypatch.setattr("tessera.llm.topk.np.zeros", lambda *a, **kw: zeros(*a, **kw).view(Counted))
    monkeypatch.setattr("tessera.llm.topk.np.empty_like", lambda x: zeros(x.shape, x.dtype).view(Counted))
    total = coarse_sums(slices.view(Counted), weights)
    monkeypatch.undo()
    bits = np.unpackbits(slices.view(np.uint8), axis=2, bitorder="little").astype(np.int64)
    c = bits[:, 0] + 2 * bits[:, 1] + 4 * bits[:, 2]
    want = np.array([np.where(w[:, None] < 0, -w[:, None] * (7 - c), w[:, None] * c).sum(axis=0) for w in weights])
    got = sum(np.unpackbits(np.ascontiguousarray(np.asarray(t)).view(np.uint8), axis=1, bitorder="little").astype(np.int64) << i for i, t in enumerate(total))
    assert (got == want).all()
    assert len(ops) < 8 * 64 * 3 * 3


def test_slices_leave_few_rows_to_resolve(monkeypatch):
    r, pairs = np.random.default_rng(29), []
    vectors = [[int(x) for x in v] for v in r.normal(0, 40, (4096, 64))]
    row = dict(zip([x.split()[0] for x in INDEX.split(", ")], _block(list(range(4096)), vectors), strict=True))
    monkeypatch.setattr("tessera.llm.topk.inner", lambda a, b: pairs.append(len(a)) or inner(a, b))
    best, queries = _Best(100, 5), np.array(vectors[:100])
    _search_block(row, np.arange(100), queries, best, 0, 5)
    scores = queries @ np.array(vectors).T
    scores[np.arange(100), np.arange(100)] = -(2**40)
    assert (best.score.reshape(100, 5) == -np.sort(-scores, axis=1)[:, :5]).all()
    assert sum(pairs) < 0.1 * 100 * 4096


@pytest.mark.parametrize("ties", [False, True])
def test_top_k(spark, ties):
    r = np.random.default_rng(4)
    rows = [(i, [float(x) for x in (np.ones(6) * (i % 3) if ties else r.normal(0, 1, 6))], "c") for i in range(300)]
    rows += [(1000, None, "c"), (1001, [1.0, None, 1.0, 1.0, 1.0, 1.0], "c"), (1002, [float("nan")] * 6, "c"), (1003, [float("inf")] * 6, "c"), (1004, [1.0, 2.0], "c"), (None, [1.0] * 6, "c"), (1005, [0.0] * 6, "c"), (1006, [], "c"), (1007, [3e5] * 6, "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    vectors = {i: [math.floor(256 * x) for x in v] for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in (0, 50, 100, 1004, 1005, 1006, 1007):
        s = sorted((-sum(a * b for a, b in zip(vectors[q], v)), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q]))[:5]
        want += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s)]
    got = top_k(build_index(df), df.where("vec_id in (0, 50, 100, 1000, 1001, 1002, 1003, 1004, 1005, 1006, 1007)"))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert top_k(build_index(df.limit(0)), df).collect() == []


@pytest.mark.parametrize("bits", [(22, 22), (30, 30), (8, 52)])
def test_top_k_of_large_components(spark, bits):
    """Scores are exact integers, however large the components, and an id that stands twice leaves room for others."""
    r = np.random.default_rng(14)
    vectors = {i: (r.random(2 if max(bits) > 22 else 16) * 2 - 1) * 2.0 ** (bits[i % 2] - 9) for i in range(120)}
    rows = [(i, [float(x) for x in v]) for i, v in vectors.items()]
    rows += [rows[7]] * 7
    whole = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    want = []
    for q in range(0, 120, 10):
        s = sorted((-sum(a * b for a, b in zip(whole[q], whole[i])), i) for i, _ in rows if i != q)[:5]
        want += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = top_k(build_index(df), df.where("vec_id % 10 = 0"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_inner_products_are_exact():
    a = np.array([[2**30, -(2**30) + 1], [3, 4]], np.int64)
    b = np.array([[2**30 - 1, 2**30], [5, -6]], np.int64)
    assert inner(a, b).tolist() == [sum(x * y for x, y in zip(r, t)) for r, t in zip(a.tolist(), b.tolist())]
    with pytest.raises(OverflowError):
        inner(np.array([[2**61, 2**61]]), np.array([[2**61, 2**61]]))


def smith_waterman(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 2, h[i][j - 1] - 2)
    return max(max(r) for r in h)


def test_alignment():
    r = np.random.default_rng(5)
    for _ in range(60):
        a, b = r.integers(0, 5, r.integers(1, 12)).astype(np.uint64), r.integers(0, 5, r.integers(0, 30)).astype(np.uint64)
        score_, first, last = align(a, b)
        assert score_ == smith_waterman(a.tolist(), b.tolist()) and (not score_ or smith_waterman(a.tolist(), b[first:last].tolist()) == score_)


def test_decontamination(spark, odd):
    r = random.Random(6)
    words = lambda n: " ".join(r.choice("abcdefghij") + r.choice("klmnopqrst") + r.choice("uvwxyz") for _ in range(n))
    items = [(i, words(30)) for i in range(8)] + [(90, None), (91, ""), (92, "too short"), (None, words(20))]
    bench = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, doc_id string")
    edited = items[3][1].split()
    for i in range(4, 30, 7):
        edited[i] = "changed"
    docs = [(0, words(100)), (1, words(20) + " " + items[1][1].upper() + ". " + words(20)), (2, " ".join(edited)), (3, None), (4, ""), (5, words(3000) + " " + items[2][1] + " " + items[2][1]), (6, items[5][1][: len(items[5][1]) // 5]), (7, "the " * 500)] + [(100 + i, items[4][1]) for i in range(60)]
    df = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, score int")
    got = {(x.doc_id, x.item_id) for x in find_leaks(df, bench).collect()}
    assert got == {(1, 1), (2, 3), (5, 2), *((100 + i, 4) for i in range(60))}
    clean = decontaminated(df, bench)
    assert clean.columns == df.columns and {x.doc_id for x in clean.collect()} == {0, 3, 4, 6, 7}
    assert find_leaks(odd, bench).count() == 0 and decontaminated(odd, bench).count() == odd.count()
    assert find_leaks(df.limit(0), bench).collect() == [] and find_leaks(df, bench.limit(0)).collect() == []


def test_edited_and_partial_copies_are_found(spark):
    """Copies with every 4th or 5th word changed, and halves copied often, of items that occur nowhere else."""
    r = random.Random(16)
    words = lambda n: [r.choice("abcdefghij") + r.choice("klmnopqrst") + r.choice("uvwxyz") + r.choice("abcdef") for _ in range(n)]
    items, docs, want = {}, [], set()
    for n in (20, 30, 40, 60):
        for step in (4, 5):
            i = len(items)
            items[i] = words(n)
            copy = [f"changed{k}" if k % step == step - 1 else w for k, w in enumerate(items[i])]
            docs.append((i, " ".join(words(50) + copy + words(50))))
            want.add((i, i))
    for i, often in ((20, 1), (21, 300)):
        items[i] = words(40)
        docs += [(1000 * i + k, " ".join(words(30) + items[i][:20] + words(30))) for k in range(often)]
        want |= {(1000 * i + k, i) for k in range(often)}
    items[30] = words(5)  # a single n-gram of a short item, similarity 0.6
    docs.append((30, " ".join(words(9) + items[30][:3] + words(9))))
    want.add((30, 30))
    items[31] = words(40)  # 20 words between two halves, similarity 0.5
    docs.append((31, " ".join(items[31][:20] + words(20) + items[31][20:])))
    want.add((31, 31))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    df = spark.createDataFrame(docs + [(99, " ".join(words(4000)))], "doc_id long, text string")
    assert {(x.doc_id, x.item_id) for x in find_leaks(df, bench).collect()} == want
    assert [x.doc_id for x in decontaminated(df, bench).collect()] == [99]


def test_recall_against_every_alignment(spark):
    """Copies with random words changed, dropped and put in, beside exact ones, against aligning every pair in full."""
    r = random.Random(26)
    words = [r.choice("abcdefghij") + r.choice("klmnopqrst") + r.choice("uvwxyz") for _ in range(150)]
    items = {i: r.choices(words, k=r.randrange(8, 50)) for i in range(12)}
    docs = []
    for i in range(150):
        copy = []
        for w in items[i % 12]:
            x = r.random() / (0.02 + i % 5 / 10)
            copy += [w] if x > 1 else [r.choice(words)] if x > 0.6 else [] if x > 0.3 else [w, r.choice(words)]
        docs.append((i, r.choices(words, k=r.randrange(60)) + copy + r.choices(words, k=r.randrange(60))))
    want = {(d, i) for d, text in docs for i, item in items.items() if smith_waterman(item, text) >= 0.4 * 2 * len(item)}
    df = spark.createDataFrame([(d, " ".join(t)) for d, t in docs], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()], "item_id long, text string")
    for block_words in (1 << 20, 90):
        found = find_leaks(df, bench, block_words=block_words).collect()
        got = {(x.doc_id, x.item_id) for x in found}
        assert got <= want and len(got) >= 0.9 * len(want) and len(want) > 60, (len(got), len(want))
        for x in found:
            assert x.score == smith_waterman(items[x.item_id], docs[x.doc_id][1])
        assert {x.doc_id for x in decontaminated(df, bench, block_words=block_words).collect()} == {d for d, _ in docs} - {d for d, _ in got}


LUHN = lambda s: sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(s))) % 10


def test_pii(spark, odd):
    texts = ["Mail Bob.Smith@Mail3.Example.com or bob.smith@mail3.example.com, ip 10.20.30.40.", "Call +49 (0)30 1234567 or 0049-123-4567; card 4539 1488 0343 6467.", "Mrs. Anna Müller and Mr. MÜLLER met Г-жа Анна Петрова; Herr Müller.", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"### 4539148803436467$$$ DE89 3704 0044 0532 0130 00', None, "", "clean 12 34 and 5 of them", "again bob.smith@mail3.example.com 10.20.30.40"]
    df = spark.createDataFrame([(i, t, "m", "x") for i, t in enumerate(texts)], "doc_id long, text string, mention string, surrogate string")
    out = pseudonymised(df, "key", count="n").orderBy("doc_id").collect()
    got = [r.text for r in out]
    assert [r.n for r in out] == [3, 3, 4, 3, 0, 0, 0, 2] and got[4:7] == [None, "", texts[6]]
    for secret in ("mith", "10.20.30.40", "1234567", "4539", "ller", "Петров", "24be", "DE89 3704"):
        assert [t for t in got if secret.lower() in (t or "").lower()] == [], secret
    mails = re.findall(r"\S+@\S+?\.com", " ".join(t for t in got if t))
    assert len(mails) == 3 and len({m.lower() for m in mails}) == 1 and mails[0][0].isupper()  # one entity, its case kept
    ips = re.findall(r"(?:\d+\.){3}\d+", " ".join(t for t in got if t))
    assert len(set(ips)) == 1 and all(0 < int(x) < 256 for x in ips[0].split("."))
    first, second = re.search(r"card ([\d ]+)\.", got[1])[1], re.search(r"(\d{16})\$", got[3])[1]
    assert first.replace(" ", "") == second and LUHN(second) == LUHN("4539148803436467") and re.fullmatch(r"\d{4} \d{4} \d{4} \d{4}", first)
    names = re.fullmatch(r"Mrs\. (\w+) (\w+) and Mr\. (\w+) met Г-жа (\w+) (\w+ова); Herr (\w+)\.", got[2])
    assert names and names[2].upper() == names[3] and names[2] == names[6] and re.search("[а-я]", names[4])
    assert pseudonymised(df, "key").columns == df.columns
    assert [r.text for r in pseudonymised(df, "other").orderBy("doc_id").collect()][0] != got[0]
    assert pseudonymised(odd, "key").count() == odd.count() and pseudonymised(odd.limit(0), "key").collect() == []


def test_pii_draws_without_long_sql(spark, monkeypatch):
    """Spark's parser keeps what it learnt of long nested SQL in the driver's heap; what is drawn hasn't changed."""
    cards = [("NUMBER", "4111111111111111"), ("NUMBER", "0000000000000"), ("NUMBER", "49301234567"), ("HEX", "0123456789abcdef" * 2)]
    parsed, expr = [], F.expr
    monkeypatch.setattr(F, "expr", lambda sql: parsed.append(sql) or expr(sql))
    left = spark.createDataFrame(cards, "type string, entity string")
    drawn = {(n, r["entity"]): r["surrogate"] for n in (0, 5) for r in _drawn_anew(left, "key", n).collect()}
    assert max(map(len, parsed)) < 1000
    assert [drawn[0, e] for _, e in cards] == ["4232850381376094", "1819447135254", "64345302603", "1822539082ecceef8137632942cacaba"]
    assert [drawn[5, e] for _, e in cards] == ["5753819781785465", "0193363488985", "1782728005702", "6643947976bffaee2833005145fbafea50"]


def test_pii_joins_alike_at_any_size(spark):
    """So that what it shuffles on a small input tells what it does on a large one."""
    df = spark.createDataFrame([(1, "a@b.org")], "doc_id long, text string")
    plan = pseudonymised(df, "k")._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_pii_stays_distinct(spark):
    """Three-letter addresses have few surrogates, so that draws collide and are drawn anew."""
    texts = [f"{a}{b}@x.io" for a in "abcdefghijklmnopqrst" for b in "abcdefghij"]
    df = spark.createDataFrame([(i, t + " and " + t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = [r.text.split(" and ") for r in pseudonymised(df, "key").collect()]
    assert all(a == b for a, b in got) and len({a for a, _ in got}) == len(texts) and not {a for a, _ in got} & set(texts)


def test_pii_with_fewer_free_values_than_entities(spark):
    """Addresses of one digit an octet: 10,000 of them, and 6,561 surrogates of that format; all columns' names are taken."""
    texts = [f"{a}.{b}.{c}.{d}" for a in range(10) for b in range(10) for c in range(10) for d in range(10)]
    df = spark.createDataFrame([(None if i % 2 else i, t, "x", "y", "z") for i, t in enumerate(texts)], "doc_id long, text string, id string, __map string, found string")
    out = pseudonymised(df, "key").collect()
    got = [r.text for r in out]
    assert len(set(got)) == len(texts) and not set(got) & set(texts)
    assert all(re.fullmatch(r"(\d{1,3}\.){3}\d{1,3}", t) and max(map(int, t.split("."))) < 256 for t in got)
    assert {(r.id, r["__map"], r.found) for r in out} == {("x", "y", "z")}


def test_kneser_ney_sums_to_one():
    r = np.random.default_rng(7)
    v = Vocabulary([f"w{i}" for i in range(12)])
    keys = []
    for _ in range(40):
        w = np.concatenate([np.zeros(2, np.uint64), v.numbers(" ".join(f"w{i}" for i in r.zipf(1.5, 30) % 14))])
        keys.append((w[:-2] * np.uint64(v.size) + w[1:-1]) * np.uint64(v.size) + w[2:])
    tri, n = np.unique(np.concatenate(keys), return_counts=True)
    m = Model.trained(v, tri, n)
    for context in ([], [80], [75, 80], [80, 81], [3, 79]):
        p = [math.exp(m.log_probabilities(np.array([*context, w], np.uint64))[-1]) for w in range(v.size)]
        assert abs(sum(p) - 1) < 1e-9, (context, sum(p))


def test_perplexity_by_the_formula():
    """Against interpolated modified Kneser-Ney probabilities computed from dictionaries, n-gram by n-gram."""
    r = np.random.default_rng(17)
    v = Vocabulary([f"w{i}" for i in range(9)])
    texts = [" ".join(f"w{i}" for i in r.zipf(1.4, 25) % 11) for _ in range(30)]
    tri: dict = {}
    for t in texts:
        w = [0, 0, *map(int, v.numbers(t))]
        for g in zip(w, w[1:], w[2:], strict=False):
            tri[g] = tri.get(g, 0) + 1
    counts = {3: tri, 2: {}, 1: {}}
    for n in (2, 1):
        for g in counts[n + 1]:
            counts[n][g[1:]] = counts[n].get(g[1:], 0) + 1
    off = {}
    for n, c in counts.items():
        of = [sum(x == k for x in c.values()) for k in (1, 2, 3, 4)]
        if not of[0] or not of[1]:
            off[n] = [0, 0.5, 0.5, 0.5]
            continue
        y = of[0] / (of[0] + 2 * of[1])
        off[n] = [0, *(min(max(k - (k + 1) * y * of[k] / of[k - 1], 0.05), k - 0.05) if of[k - 1] else 0.5 * k for k in (1, 2, 3))]

    def p(g):
        n = len(g)
        if n == 0:
            return 1 / v.size
        c, own = counts[n], {h: x for h, x in counts[n].items() if h[:-1] == g[:-1]}
        if not own:
            return p(g[1:])
        total, rest = sum(own.values()), sum(off[n][min(x, 3)] for x in own.values())
        x = c.get(g, 0)
        return (x - off[n][min(x, 3)]) / total + rest / total * p(g[1:] if n > 1 else ())

    size = np.uint64(v.size)
    keys = {(int(a) * v.size + int(b)) * v.size + int(c): x for (a, b, c), x in tri.items()}
    order = sorted(keys)
    m = Model.trained(v, np.array(order, np.uint64), np.array([keys[k] for k in order]))
    assert size == v.size
    for t in [*texts[:5], "w1 w1 w1 new W3! w2", "zz"]:
        w = [0, 0, *map(int, v.numbers(t))]
        log = [math.log(p(g)) for g in zip(w, w[1:], w[2:], strict=False)]
        assert abs(m.perplexity(t)[2] - math.exp(-sum(log) / len(log))) < 1e-6 * m.perplexity(t)[2]


def test_quality(spark, odd):
    r = random.Random(8)
    vocab = [r.choice("bcdfg") + r.choice("aeiou") + r.choice("lmnrs") + r.choice(["", "a", "ent"]) for _ in range(120)]
    clean = lambda: " ".join(w + r.choice(["", "", "", ".", ","]) for w in r.sample(sorted(set(vocab)), 60))
    docs = [(i, clean(), "en" if i % 2 else None, "x") for i in range(300)]
    junk = [(1000, " ".join(r.choice(vocab).upper() + "!!" for _ in range(80)), "en", "x"), (1001, "| ".join(r.choice(vocab) for _ in range(80)), "en", "x"), (1002, " ".join(["same"] * 90), None, "x"), (1003, None, "en", "x"), (1004, "", "en", "x"), (1005, " \n", "zz", "x")]
    df = spark.createDataFrame(docs + junk, "doc_id long, text string, lang string, perplexity string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)] + [(1000, 0, 0), (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in classify(df, labels, least=20).collect()}
    assert len(got) == 306 and sum(got[i].keep for i in range(300)) >= 295 and not any(got[i].keep for i in range(1000, 1006))
    assert got[1003].perplexity is None and got[1003].n_words == 0
    rows = kept(df, labels, least=20)
    assert rows.columns == df.columns and sorted(x.doc_id for x in rows.collect()) == sorted(i for i, x in got.items() if x.keep)
    none = labels.limit(0)
    assert sum(x.keep for x in classify(df, none).collect()) == 303 and kept(df, none).count() == 303
    twice = df.union(df).withColumn("lang", F.when(F.col("lang").isNotNull(), F.length("lang")))  # rows twice, a numeric lang
    assert kept(twice, labels, least=20).count() % 2 == 0
    assert classify(odd, labels).count() == odd.count() and classify(df.limit(0), labels).collect() == []


def test_runs_of_a_word_are_rejected(spark):
    """Although some trusted documents repeat a word three times, which makes runs cheap to the model."""
    r = random.Random(18)
    vocab = [r.choice("bcdfg") + r.choice("aeiou") + r.choice("lmnrs") + r.choice("aeiou") for _ in range(150)]
    clean = lambda i: " ".join([*r.choices(vocab, k=40), *(["so"] * 4 if i % 60 < 2 else []), *r.choices(vocab, k=40)])
    docs = [(i, clean(i), "en" if i % 2 else "de") for i in range(600)]
    junk = [(1000 + i, " ".join([r.choice(vocab)] * 150), "en" if i % 2 else "de") for i in range(20)]
    junk += [(1100 + i, " ".join(r.choices(vocab, k=8) + ["for"] * 90), "en") for i in range(5)]
    df = spark.createDataFrame(docs + junk, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(500)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x.keep for x in classify(df, labels).collect()}
    assert not any(k for i, k in got.items() if i >= 1000) and sum(got[i] for i in range(600)) >= 585
    assert sorted(x.doc_id for x in kept(df, labels).collect()) == sorted(i for i, k in got.items() if k)


def test_training_takes_every_trusted_document(spark):
    """Beyond 2,000 documents, too; and a model in blocks gives what one in memory does."""
    r = random.Random(19)
    docs = [(i, " ".join(r.choices("abcdefgh", k=r.randint(0, 9))), "en" if i % 3 else None) for i in range(4500)]
    df = spark.createDataFrame([*docs, (None, "a b", "en"), (7000, None, "en"), (7001, "c", "zz"), (7002, "", "en"), (5, docs[5][1], "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(4500)], "doc_id long, quality int, toxic int")
    ids = [x.doc_id for x in labels.where(F.xxhash64("doc_id") % 2 == 0).collect()]
    model, v = fit(df, labels), Vocabulary(sorted("abcdefgh"))
    assert len(ids) > 2000 and sorted(model.vocabulary.words) == v.words
    of = [np.concatenate([np.zeros(2, np.uint64), model.vocabulary.numbers(docs[i][1])]) for i in ids]
    tri, n = np.unique(np.concatenate([(w[:-2] * np.uint64(v.size) + w[1:-1]) * np.uint64(v.size) + w[2:] for w in of]), return_counts=True)
    whole = Model.trained(model.vocabulary, tri, n)
    assert (model.tri == tri).all() and np.allclose(model.tri_p, whole.tri_p) and np.allclose(model.uni, whole.uni)
    tables = fit(df, labels, in_memory=0, block=200)
    assert tables.blocks > 2
    rows = lambda m: sorted(((x.id, x.doc_id, x.lang, x.n_words, x.repeated, x.perplexity) for x in perplexities(df, m).collect()), key=repr)
    a, b = rows(model), rows(tables)
    assert len(a) == len(b) == 4505
    for x, y in zip(a, b, strict=True):
        assert x[:5] == y[:5] and (x[5] == y[5] or abs(x[5] - y[5]) < 1e-5 * x[5])
    ids = lambda **bounds: sorted(map(repr, kept(df, labels, quantile=0.9, **bounds).collect()))
    blocks = lambda: set(Path(shared_dir(spark).removeprefix("file://")).glob("*/block=*"))
    before = blocks()
    assert ids() == ids(in_memory=0, block=200) and 0 < len(ids()) < 4504
    assert classify(df, labels, in_memory=0, block=200).count() == 4505 and before and blocks() == before  # those of `tables`


def test_blocks_reach_the_driver_ready(spark):
    """The driver only joins the parts of a block's arrays."""
    r = random.Random(20)
    words = [f"w{i}" for i in range(400)]
    df = spark.createDataFrame([(i, " ".join(r.choices(words, k=300)), "en") for i in range(1500)], "doc_id long, text string, lang string")
    tables = fit(df, spark.createDataFrame([(i, 1, 0) for i in range(1500)], "doc_id long, quality int, toxic int"), in_memory=0, block=1_000_000)
    tracemalloc.start()
    try:
        size = sum(x.nbytes for x in tables.block(spark, 0))
        assert size > 3_000_000 and tracemalloc.get_traced_memory()[1] < 2.5 * size  # as they came, and joined
    finally:
        tracemalloc.stop()


def test_masked_lm(spark, odd):
    r = random.Random(9)
    docs = [(i, " ".join("a b c d e f g h".split()[j % 8] for j in range(r.randrange(8), 400))) for i in range(60)]
    shuffled = [(1000 + i, " ".join(r.choice("abcdefgh") for _ in range(200))) for i in range(3)]
    df = spark.createDataFrame(docs + shuffled + [(2000, None), (2001, " ")], "doc_id long, text string")
    model = train(df, vocabulary=8, rounds=2)
    got = {x.doc_id: x for x in score(df, *model).collect()}
    assert min(got[i].mean for i in range(60)) > max(got[1000 + i].mean for i in range(3))  # ordered text is predicted from both sides
    assert got[2000].n_words == 0 and got[2000].log_likelihood == 0 and got[2001].mean is None
    assert abs(got[5].log_likelihood / got[5].n_words - got[5].mean) < 1e-9
    assert score(odd, *train(odd)).count() == odd.count() and score(odd.limit(0), *train(odd.limit(0))).collect() == []


def test_words_of_a_class_have_their_own_probabilities(spark):
    """A rare word and a frequent one of the same end differ, and those of a class add up to it."""
    docs = [(i, "a b a b a b often" + ("" if i % 10 else " rather-often")) for i in range(50)] + [(90, "a b a once-often x"), (91, "a b a often x")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    numbers, network = train(df, vocabulary=2, rounds=1)
    got = {x.doc_id: x.log_likelihood for x in score(df, numbers, network).collect()}
    assert abs(got[91] - got[90] - math.log(51)) < 1e-4
    words = [b"often", b"rather-often", b"once-often", b"x"]
    own = numbers.of([words])[0][2:-2]
    p = np.exp(numbers.within([words], own))
    for c in set(own.tolist()):
        assert abs(p[own == c].sum() - 1) < 1e-9


def test_network_gradient():
    """Gradients are those of the loss, training lowers it, and the probabilities of all words sum to one."""
    net, state = Network(150), {}
    ids = np.concatenate([[0, 0], np.tile(np.arange(1, 150), 8), [0, 0]]).astype(np.int32)
    at = np.flatnonzero(ids)
    every = []
    for w in range(150):  # each word in one place
        own = ids.copy()
        own[70] = w
        every.append(net.log_probabilities(own, np.array([70]))[0])
    assert abs(np.exp(every).sum() - 1) < 1e-5
    net.p = [x.astype(np.float64) for x in net.p]
    loss = lambda: -net.log_probabilities(ids, at[:200]).mean()
    kept, before = [x.copy() for x in net.p], loss()
    seen = {}
    net.train(ids, at[:200], seen)
    for i in range(7):
        flat = np.abs(seen["m", i]).argmax()
        net.p = [x.copy() for x in kept]
        net.p[i].reshape(-1)[flat] += 1e-5
        slope = (loss() - before) / 1e-5
        assert abs(slope - 10 * seen["m", i].reshape(-1)[flat]) < 1e-3 * abs(slope) + 1e-6, i
    net.p = [x.astype(np.float32) for x in kept]
    before = net.log_probabilities(ids, at).mean()
    for _ in range(60):
        net.train(ids, at, state)
    assert net.log_probabilities(ids, at).mean() > before + 1


def test_logits_lie_in_long_rows():
    """A row a group, so that numpy doesn't reduce many short rows; the probabilities of a column sum to one."""
    n, ids = Network(700), np.arange(2, 502, dtype=np.int32)
    z = n.hidden_layer(ids, np.arange(2, 400))[3]
    assert z.shape == (n.groups, 398) and z.flags.c_contiguous
    own = np.arange(398) % n.groups
    p = _softmax(z.copy())
    assert np.allclose(p.sum(axis=0), 1, atol=1e-5) and np.allclose(np.exp(_log_probability(z, own)), p[own, np.arange(398)], rtol=1e-4)


def test_scores_are_sums_of_log_probabilities(spark):
    """Every word's probability by a plain formula from the network's weights and the corpus's counts."""
    r = random.Random(19)
    vocab = [f"{a}{b}{c}" for a in "bcd" for b in "aeiou" for c in "klmnst"]
    rows = [(i, " ".join(r.choices(vocab, range(len(vocab), 0, -1), k=60))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    numbers, net = train(df, vocabulary=70, rounds=1)
    counts = {}
    for _, t in rows:
        for w in t.split():
            counts[w] = counts.get(w, 0) + 1
    known = {w.decode(): i + 16 for i, w in enumerate(numbers.words)}
    assert sorted(known, key=lambda w: known[w]) == sorted(counts, key=lambda w: (-counts[w], w))[:70]
    number = lambda w: known.get(w) or 1 + zlib.crc32(w[-2:].encode()) % 15
    e, w, b, u, c, v, d = net.p
    for got in score(df, numbers, net).collect()[:5]:
        text = ["", "", *rows[got.doc_id][1].split(), "", ""]
        total = 0.0
        for i in range(2, len(text) - 2):
            x = np.concatenate([e[number(y) if y else 0] for y in (text[i - 2], text[i - 1], text[i + 1], text[i + 2])])
            h, n = np.tanh(x @ w + b), number(text[i])
            first, second = np.exp(h @ u + c), np.exp(h @ v[n // 64] + d[n // 64])
            total += math.log(first[n // 64] / first.sum() * second[n % 64] / second.sum())
            if n < 16:
                total += math.log(counts[text[i]] / sum(k for x, k in counts.items() if x not in known and number(x) == n))
        assert abs(total - got.log_likelihood) < 1e-2


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, ids = docs.columns, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = corpus_pipeline.written(stage(spark, docs, sf))
        assert docs.columns == columns, name
        now = {x.doc_id for x in docs.select("doc_id").collect()}
        assert now <= (ids or {x.doc_id for x in before.select("doc_id").collect()})
        ids = now
    packed = corpus_pipeline.packing(spark, docs, sf)
    assert {x.doc_id for x in packed.select("doc_id").distinct().collect()} == ids
    sizes = packed.groupBy("sequence_id").agg({"offset": "count"}).count()
    assert sizes * 1024 * 0.8 < sum(len(x.ids) // 4 for x in packed.collect()) + 1024 * packed.rdd.getNumPartitions() * 4
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "pii", "packing"]
    assert hashlib.sha256(b"").hexdigest()
