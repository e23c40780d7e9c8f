"""Product codes, spelling variants and the language model against brute force, and on odd input."""

import hashlib
import itertools
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import attention, code_compression, embedding_dedup, language_model, pipeline, spelling, url_filter

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# product codes ------------------------------------------------------------------------------------


def lloyd(rows, rounds=4):
    """{vec_id: (code, error, label_error, sha)} by plain loops in whole numbers."""
    kept = [(i, label, [math.floor(1024 * x) for x in v]) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(kept[0][2]) // 4
    cut = [[r[2][p * width : (p + 1) * width] for p in range(4)] for r in kept]
    books = [[c[p] for c in cut[:256]] for p in range(4)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def assign():
        return [[min((far(c[p], e), j) for j, e in enumerate(books[p])) for p in range(4)] for c in cut]

    for _ in range(rounds):
        own = assign()
        for p in range(4):
            for j in range(len(books[p])):
                mine = [c[p] for c, o in zip(cut, own) if o[p][1] == j]
                if mine:
                    books[p][j] = [sum(x) // len(mine) for x in zip(*mine)]
    own = assign()
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    total = Counter()
    for r, o in zip(kept, own):
        total[r[1]] += sum(d for d, _ in o)
    return [(r[0], "".join(f"{j:02x}" for _, j in o), sum(d for d, _ in o), total[r[1]], sha) for r, o in zip(kept, own)]


def clustered(n, dim=8, seed=3):
    rng = random.Random(seed)
    centers = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(40)]
    return [(i * 3, [x + rng.gauss(0, 0.2) for x in rng.choice(centers)], rng.choice([None, 1, 2])) for i in range(n)]


EMB = "vec_id long, embedding array<double>, label int"
shown = lambda rows: sorted(map(str, rows))


def test_codes_against_plain_rounds(spark, monkeypatch):
    rows = clustered(700)
    rows += [(5, None, 1), (6, [1.0, None] * 4, 1), (7, [float("nan")] * 8, 1), (8, [float("inf")] * 8, 2), (None, [0.25] * 8, 2), (9, rows[0][1], None), (9, rows[1][1], None)]
    monkeypatch.setattr(code_compression, "BLOCK", 8 * 64)
    d = spark.createDataFrame(rows, EMB).withColumn("code", F.lit("clash")).repartition(5)
    got = code_compression.compress(d)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert shown(map(tuple, got.collect())) == shown(lloyd(rows))


def test_heaps_pop_only_what_drift_has_violated(spark):
    rows = spark.createDataFrame(clustered(600), EMB).select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
    _, _, shares = code_compression.fit(rows)
    assert len(shares) == 4 and shares[-1] < min(0.8, shares[0])  # the later rounds leave parts alone
    heaps = code_compression.Heaps(np.array([0, 0, 1, 1]), np.array([3.0, 1.0, 2.0, 9.0]))
    assert sorted(heaps.pop(np.array([1.5, 5.0])).tolist()) == [1, 2]
    heaps.push(np.array([1]), np.array([1]), np.array([20.0]))
    assert sorted(heaps.pop(np.array([5.0, 10.0])).tolist()) == [0, 2, 3]


def test_distances_are_exact_for_large_numbers():
    x, c = np.array([[2**27, -(2**27)]], np.int64), np.array([[-(2**27), 2**27 - 1], [2**27, 1]], np.int64)
    assert code_compression.distances(x, c).tolist() == [[(2**28) ** 2 + (2**28 - 1) ** 2, (2**27 + 1) ** 2]]


def test_codes_of_odd_input(spark):
    assert code_compression.compress(spark.createDataFrame([], EMB)).collect() == []
    rows = [(1, [], 1), (2, [], 1), (3, [0.5] * 3, 1), (4, [0.5] * 3, 1), (5, [1e300] * 4, None), (6, [-1e300] * 4, None), (6, [-1e300] * 4, None)]
    got = {r["vec_id"]: r for r in code_compression.compress(spark.createDataFrame(rows, EMB)).collect()}
    assert got[1]["code"] == got[2]["code"] == "00000000" and got[1]["error"] == 0
    assert got[3]["code"] == got[4]["code"] == "00000000" and got[5]["code"] != got[6]["code"]
    assert len({r["codebooks_sha256"] for r in got.values()}) == 3


# spelling variants --------------------------------------------------------------------------------


def edits(w):
    return {("r", i, w[:i] + "*" + w[i + 1 :]) for i in range(len(w))}, {w[:i] + w[i + 1 :] for i in range(len(w))}


def variants(count):
    """[(word, n, n_near, form, form_n, root)] by comparing all words."""
    words = sorted(count)
    cut = {w: edits(w) for w in words}
    form, near = {}, {}
    for w in words:
        near[w] = [o for o in words if o != w and (cut[w][0] & cut[o][0] or o in cut[w][1] or w in cut[o][1])]
        best = min(((-count[o], o) for o in near[w]), default=None)
        form[w] = best[1] if best and -best[0] >= 2 * count[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, count[w], len(near[w]), form[w], count[form[w]] if form[w] else None, root))
    return out


def shaken(seed=1, n=60):
    rng = random.Random(seed)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(5, 9))) for _ in range(n)} | {"aaaaa", "aaaaaa", "aaaaaaa", "baaaa", "aaaab", "𝒳aaaa"}
    return {w: rng.choice([3, 4, 7, 20, 50, 200]) for w in words}


@pytest.mark.parametrize("points", [40_000, 7])
def test_variants_against_all_words(spark, monkeypatch, points):
    monkeypatch.setattr(spelling, "POINTS", points)
    count = shaken()
    rows = spark.createDataFrame(list(count.items()), "word string, n long")
    pairs = [tuple(r) for r in spelling.near_pairs(rows).collect()]
    assert len(pairs) == len(set(pairs))  # no pair comes twice
    got = [tuple(r) for r in spelling.variants(rows).select("word", "n", "n_near", "form", "form_n", "root").collect()]
    assert sorted(got, key=str) == sorted(variants(count), key=str)


def test_wavelet_tree_reports_rectangles():
    rng = np.random.default_rng(0)
    for n in (1, 2, 33, 200):
        v = rng.permutation(n)
        tree = spelling.WaveletTree(v)
        lo, hi, low, high = (rng.integers(0, n + 1, 50) for _ in range(4))
        q, got = tree.report(lo, hi, low, high)
        for i in range(50):
            assert sorted(got[q == i].tolist()) == sorted(x for x in v[lo[i] : hi[i]].tolist() if low[i] <= x < high[i])


def spoiled(key, run):
    h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
    return run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]


def test_words_of_odd_texts(spark):
    rng = random.Random(2)
    rows = [(i if i % 7 else None, " ".join(rng.choice(["HELLO", "hello", "Größe", "Ärger", "a1b", "naïve", "x" * 3000, "wörter×"]) for _ in range(40))) for i in range(60)]
    rows += [(1, None), (2, ""), (2, "12 34 ,;")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(0))
    low = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
    want = Counter(spoiled(k, r.translate(low)) for k, t in rows for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""))
    got = {r["word"]: r["n"] for r in spelling.word_counts(d).collect()}
    assert got == {w: n for w, n in want.items() if len(w) >= 5 and n >= 3}
    assert spelling.variants(spelling.word_counts(d.limit(0))).collect() == []


# the language model -------------------------------------------------------------------------------


def tables(seed=0):
    rng = np.random.default_rng(seed)
    return attention.Tables(rng.poisson(0.2, (attention.VOCAB,) * 2).astype(float), rng.poisson(1.0, attention.VOCAB).astype(float), rng.poisson(1.0, attention.VOCAB).astype(float))


def weights(seed=1):
    rng = np.random.default_rng(seed)
    return {k: (v + 0.2 * rng.standard_normal(v.shape)).astype(np.float32) for k, v in attention.start(seed).items()}


def by_hand(w, t, seq, i):
    """Logarithms of all next ids at place i of the inputs, from the formulas."""
    lo = max(0, i // attention.STEP * attention.STEP - attention.STEP)
    at = list(range(lo, i + 1))
    q = w["e"][seq[i]] @ w["q"]
    s = np.array([q @ (w["e"][seq[j]] @ w["k"]) / attention.DIM**0.5 + w["near"][i - j] for j in at], np.float64)
    a = np.exp(s - s.max())
    a /= a.sum()
    h = w["e"][seq[i]] + sum(x * (w["e"][seq[j]] @ w["v"]) for x, j in zip(a, at))
    if i > lo:
        h = h + w["p"][seq[i - 1]]
    g = h + np.maximum(0, h @ w["w1"] + w["b1"]) @ w["w2"]
    norm = lambda z: z - (np.log(np.exp(z - z.max()).sum()) + z.max())
    one = norm(g @ w["u1"] + t.of_class[seq[i]])
    return np.concatenate([one[c] + norm(g @ w["u2"][c] + t.of_member[seq[i] * attention.CLASS + c]) for c in range(attention.CLASS)])


def test_scores_by_hand_and_probabilities_add_up():
    t, w, rng = tables(), weights(), np.random.default_rng(2)
    seqs = [rng.integers(0, attention.VOCAB, n) for n in (1, 16, 17, 50)]
    targets = [np.r_[s[1:], 7] for s in seqs]
    got = attention.Scorer(w, t).score(np.concatenate(seqs), np.concatenate(targets), np.array([len(s) for s in seqs]), windows_at_once=2)
    want = []
    for s, y in zip(seqs, targets):
        for i in range(len(s)):
            p = by_hand(w, t, s, i)
            assert abs(np.exp(p).sum() - 1) < 1e-3
            want.append(p[y[i]])
    assert np.allclose(got, want, atol=2e-3)


def test_gradients_against_differences():
    t, rng = tables(), np.random.default_rng(3)
    w = {k: v.astype(np.float64) for k, v in weights(4).items()}
    x, y, _ = attention.windows(rng.integers(0, attention.VOCAB, 45), rng.integers(0, attention.VOCAB, 45), np.array([40, 5]))
    d, _ = attention.gradients(w, t, x, y)
    n = (y >= 0).sum()
    for k, v in w.items():
        flat, i = v.reshape(-1), int(np.abs(d[k]).argmax())
        was = flat[i]
        flat[i] = was + 1e-4
        up = attention.gradients(w, t, x, y)[1]
        flat[i] = was - 1e-4
        down = attention.gradients(w, t, x, y)[1]
        flat[i] = was
        assert abs((up - down) / 2e-4 / n - d[k].reshape(-1)[i]) < 1e-6


def test_a_text_in_parts_scores_as_a_whole():
    t, w, rng = tables(), weights(), np.random.default_rng(5)
    ids, scorer = rng.integers(0, attention.VOCAB, 131).astype(np.int32), attention.Scorer(w, t)

    def total(cuts):
        s, out = language_model._Sequence(3), 0.0
        for k, (a, b) in enumerate(itertools.pairwise([0, *cuts, len(ids)])):
            x, y = s.feed(ids[a:b], k == len(cuts))
            out += scorer.score(x, y, np.array([len(x)])).sum()
        return out

    assert abs(total([]) - total([5, 9, 70, 71, 128])) < 1e-2


def corpus(spark, n=90):
    rng = random.Random(4)
    words = ["the", "House", "river", "Grüne", "stone", "happy", "walks", "läuft"]
    rows = [(i, " ".join(rng.choice(words[:4] if i % 2 else words[4:]) for _ in range(rng.randint(5, 80)))) for i in range(n)]
    rows += [(None, "no key House"), (3, "the House again"), (500, None), (510, ""), (520, " \n\t"), (531, "neverseen " * 20), (540, "x" * 5000 + " the")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("row", F.lit(1))


def test_base_scores_and_counts(spark, monkeypatch):
    monkeypatch.setattr(language_model, "HOT", 4)
    monkeypatch.setattr(language_model, "COUNTED", 3)
    monkeypatch.setattr(language_model, "CHUNK", 200)
    monkeypatch.setattr(language_model, "SLAB", 150)
    monkeypatch.setattr(language_model, "SCORED", 170)
    rows, d = corpus(spark)
    low = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
    tokens = [(k, [*WORD.findall((t or "").translate(low)), None]) for k, t in rows]
    held = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 10 == 0
    c = Counter(w for k, ws in tokens if not held(k) for w in ws)
    n, v = sum(c.values()), len(c)
    base = lambda ws: round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)
    got = language_model.score(d).collect()
    assert sorted(((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got)) == sorted((str(k), held(k), len(ws), sum(c[w] > 0 for w in ws), n, base(ws)) for k, ws in tokens)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_words_are_split_as_the_pattern_says():
    import pyarrow as pa

    rng = random.Random(1)
    texts = ["".join(rng.choice(" \t\n\x0b\x0c\r\x1c\x85\u00a0\u2003aZÄé0") for _ in range(rng.randint(0, 12))) for _ in range(400)] + [None, "", "  "]
    words, n = language_model.split(pa.array(texts, pa.string()))
    low = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
    want = [WORD.findall((t or "").translate(low)) for t in texts]
    assert words.to_pylist() == [w for ws in want for w in ws] and n.tolist() == [len(ws) for ws in want]


def test_language_model_of_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    assert language_model.score(d).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = language_model.score(spark.createDataFrame([(held, "only held out")], d.schema)).collect()[0]
    assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (4, 0, 0) and math.isfinite(r["score"])


@needs_data
def test_the_model_beats_the_words_on_held_out_texts(spark):
    d = spark.read.parquet(f"{DATA}/documents.parquet")
    r = language_model.score(d).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


# the exact way of the embedding join, and names of equal slices -------------------------------------


def test_exact_embedding_links(spark, monkeypatch):
    """Families just above the threshold, all links against all pairs."""
    monkeypatch.setattr(embedding_dedup, "CELL", 6)
    rng = np.random.default_rng(9)
    base = rng.standard_normal((250, 16))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    noise = rng.standard_normal((250, 16))
    noise -= (noise * base).sum(1, keepdims=True) * base
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    x = np.concatenate([base, 0.9505 * base + (1 - 0.9505**2) ** 0.5 * noise, base[:40], rng.standard_normal((30, 7)) @ np.ones((7, 16)) + 0.01 * rng.standard_normal((30, 16))])
    d = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())] + [(900, [1.0, 2.0]), (901, None), (902, [2.0, 4.0])], "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.95
    want = {i: int(n) - 1 for i, n in enumerate(link.sum(1))} | {900: 1, 901: 0, 902: 1}
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_embeddings(d, exact=True, block=64).collect()}
    assert got == want


def test_equal_slices_have_numbers(spark):
    rows = [(1, "a b"), (1, "a b"), (1, "a b"), (1, "c"), (2, "a b"), (None, None), (None, None), (3, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("name", F.lit("clash")).repartition(3)
    got = [tuple(r) for r in pipeline.numbered(d).select("doc_id", "text", "copy_").collect()]
    assert sorted(got, key=str) == sorted([(1, "a b", 0), (1, "a b", 1), (1, "a b", 2), (1, "c", 0), (2, "a b", 0), (None, None, 0), (None, None, 1), (3, None, 0)], key=str)


def test_empty_urls_go_around_a_large_filter(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "BROADCAST_BYTES", 0)
    rows = [(1, None), (2, ""), (3, "nothing"), (4, "http://a.org/x"), (5, "http://b.org/" + "y" * 5000), (6, None), (6, "http://a.org/x/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("block", F.lit("clash"))
    listed = spark.createDataFrame([("a.org/x",), ("",), (None,)], "canonical string")
    got = {(r["page_id"], r["canonical"][:9]): (r["listed"], r["verdict"]) for r in url_filter.filter_urls(pages, listed, []).collect()}
    free = (False, "allow")
    assert got == {(1, ""): free, (2, ""): free, (3, ""): free, (4, "a.org/x"): (True, "block"), (5, "b.org/yyy"): free, (6, ""): free, (6, "a.org/x"): (True, "block")}


def test_network_is_trained_on_every_subword(spark):
    import numpy as np

    from graphloom.llm import language_model as L

    rows = [(str(i), f"a quite plain text {i} of " + "several longer words and others " * (i * 9)) for i in range(40)] + [("x", None), ("y", "")]
    d = spark.createDataFrame(rows, "key string, text string").repartition(3)
    with open(L.model_file(), "rb") as f:
        proto = f.read()
    corpus = L.Corpus(L.count_words(d).cache(), len(rows), proto)
    end = int(corpus.tables.number[L.END])
    sent = {"hot": L._hot(corpus.hot, proto), "below": corpus.below, "share": corpus.share, "number": corpus.tables.number[corpus.own], "end": end, "tables": corpus.tables}
    got = L.training_windows(d, spark.sparkContext.broadcast(sent), proto).collect()
    x, y = (np.concatenate([np.frombuffer(r[c], np.int16) for r in got]) for c in ("inputs", "targets"))
    assert len(x) == len(y) == corpus.subwords and (y == end).sum() == (x == end).sum() == len(rows)
    assert sum(int(np.frombuffer(r["sizes"], np.int32).sum()) for r in got) == len(y) and len({r["slot"] for r in got}) == L.ROUNDS


def test_rows_of_windows_are_small(spark):
    """A row of all pieces that a task holds would be hundreds of kilobytes, and the writer holds a hundred of them in buffers."""
    L = language_model
    rows = [(str(i), f"text {i} of " + "several longer words and others " * 3000) for i in range(12)]
    d = spark.createDataFrame(rows, "key string, text string").coalesce(1)
    with open(L.model_file(), "rb") as f:
        proto = f.read()
    corpus = L.Corpus(L.count_words(d).cache(), len(rows), proto)
    sent = {"hot": L._hot(corpus.hot, proto), "below": corpus.below, "share": corpus.share, "number": corpus.tables.number[corpus.own], "end": int(corpus.tables.number[L.END]), "tables": corpus.tables}
    got = L.training_windows(d, spark.sparkContext.broadcast(sent), proto).collect()
    sizes = [np.frombuffer(r["sizes"], np.int32) for r in got]
    assert sum(int(s.sum()) for s in sizes) == corpus.subwords
    assert all(s.sum() < L.ROW + s[-1] for s in sizes) and max(len(r["inputs"]) for r in got) < 4 * L.ROW


def test_softmax_of_low_and_high_rows():
    s = np.array([[0.0] * 32, [-200.0] * 32, [300.0] + [0.0] * 31, [-1e9] * 31 + [-90.0]], np.float32)
    for part in (s, s[:1], s[[0, 1]], s[[0, 3]]):
        want = np.exp(part.astype(np.float64) - part.max(1, keepdims=True))
        assert np.allclose(attention._softmax(part.copy()), want / want.sum(1, keepdims=True), atol=1e-6)


def test_rows_are_summed_by_any_number():
    at, rows = np.array([1, 65537, 1, 40000, 65537]), np.arange(15, dtype=np.float32).reshape(5, 3)
    want = np.zeros((65538, 3), np.float32)
    np.add.at(want, at, rows)
    assert np.array_equal(attention._add_rows(at, rows, 65538), want)


def test_a_step_of_training_is_adam():
    rng = np.random.default_rng(2)
    t = attention.Tables(rng.random((attention.VOCAB, attention.VOCAB)), rng.random(attention.VOCAB), rng.random(attention.VOCAB))
    x, y = rng.integers(0, attention.VOCAB, (6, 2 * attention.STEP)), rng.integers(0, attention.VOCAB, (6, attention.STEP))
    got = attention.flat(attention.train(attention.start(), t, x, y, 0.01, batch=2, seed=3)[0])
    row = attention.flat(attention.start()).astype(np.float64)
    m, s, order = np.zeros_like(row), np.zeros_like(row), np.random.default_rng(3).permutation(6)
    for i in range(3):
        at = order[2 * i : 2 * i + 2]
        grad = attention.flat(attention.gradients(attention.shaped(row), t, x[at], y[at])[0]).astype(np.float64)
        m, s = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad * grad
        row -= 0.01 * m / (1 - 0.9 ** (i + 1)) / (np.sqrt(s / (1 - 0.99 ** (i + 1))) + 1e-6)
    assert np.abs(got - row).max() < 2e-4
