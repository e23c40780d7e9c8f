"""The stored indexes against full scans, and on odd input."""

import math
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import fulltext, index, product, proximity, vectors

DATA = "/root/testdata/sf0.1"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


# full text ----------------------------------------------------------------------------------------


def bm25(texts, query, k):
    """[(id, score)] of a full scan."""
    words = {i: re.findall("[a-z]+", t.lower()) for i, t in texts.items()}
    words = {i: w for i, w in words.items() if w}
    mean = sum(map(len, words.values())) / len(words)
    df = Counter(w for ws in words.values() for w in set(ws))
    score = Counter()
    for w, q in Counter(re.findall("[a-z]+", query.lower())).items():
        for i, ws in words.items():
            if tf := ws.count(w):
                score[i] += q * math.log(1 + (len(words) - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / mean))
    return sorted(((i, round(s, 6)) for i, s in score.items()), key=lambda r: (-r[1], r[0]))[:k]


@pytest.mark.parametrize("block", [128, 2])
def test_fulltext_against_a_full_scan(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(fulltext, "BLOCK", block)
    rng = random.Random(block)
    vocabulary = [f"{a}{b}" for a in "abcdefgh" for b in "xyz"]
    texts = {i: " ".join(rng.choices(vocabulary, weights=[1 / (n + 1) for n in range(24)], k=rng.randint(1, 40))) for i in range(300)}
    rows = [(i, t) for i, t in texts.items()] + [(900, None), (901, ""), (902, "12 %"), (None, None)]
    d = spark.createDataFrame(rows, "id long, text string").withColumn("term", F.lit("clash"))
    path = str(tmp_path / "x")
    fulltext.FullTextIndex.build(d, path)
    x = fulltext.FullTextIndex(spark, path)
    for query, k in (("ax", 5), ("HZ gy, ax", 7), ("hz hz unknown", 4), ("ax by cz dx", 300), ("bx", 1)):
        got = [(r["id"], round(r["score"], 6)) for r in x.search(query, k).collect()]
        assert [i for i, _ in got] == [i for i, _ in bm25(texts, query, k)] and np.allclose([s for _, s in got], [s for _, s in bm25(texts, query, k)], atol=2e-6)
    assert x.search("nowhere", 3).count() == x.search("", 3).count() == 0
    assert "documents" not in x.search("ax", 3)._jdf.queryExecution().toString()


def test_fulltext_skips_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fulltext, "BLOCK", 4)
    texts = spark.range(2000).selectExpr("id", "case when id % 50 = 0 then concat('rare ', repeat('rare ', int(id / 400)), 'common') else concat('common', repeat(' other', int(id % 60))) end as text")
    x = fulltext.FullTextIndex.build(texts, str(tmp_path / "x"))
    weights = x._weights("rare common")
    live, all_ = x.live_blocks(weights, 3).count(), x.postings(list(weights)).count()
    assert live < all_ / 2
    assert [r["id"] for r in x.search("rare common", 3).collect()] == [i for i, _ in bm25({r["id"]: r["text"] for r in texts.collect()}, "rare common", 3)]


def test_fulltext_of_odd_tables(spark, tmp_path):
    none = fulltext.FullTextIndex.build(spark.createDataFrame([], "id long, text string"), str(tmp_path / "none"))
    assert none.search("a", 3).count() == 0
    with pytest.raises(ValueError):
        fulltext.FullTextIndex.build(spark.createDataFrame([(None, "a")], "id long, text string"), str(tmp_path / "bad"))
    twice = fulltext.FullTextIndex.build(spark.createDataFrame([(1, "a b"), (1, "a"), (2, "b")], "id long, text string"), str(tmp_path / "twice"))
    assert [r["id"] for r in twice.search("a", 3).collect()] == [1] and twice.stats["docs"] == 2


# vectors ------------------------------------------------------------------------------------------


@needs_data
def test_small_beams_find_the_nearest_with_a_tenth_of_the_comparisons(spark, tmp_path):
    v = spark.read.parquet(f"{DATA}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = v.where("id % 10 = 0")
    x = proximity.ProximityIndex.build(v, str(tmp_path / "x"))
    found = proximity.ProximityIndex(spark, str(tmp_path / "x")).knn_join(asked, 3, beam=6, self_join=True).cache()
    assert index.recall(vectors.knn_join(asked, v, 3, self_join=True), found).first()["recall"] >= 0.9
    assert found.groupBy("src").agg(F.max("compared").alias("n")).agg(F.avg("n")).first()[0] <= v.count() / 10
    # several shards, merged; every query visits the three nearest
    many = proximity.ProximityIndex.build(v, str(tmp_path / "many"), shard=300).knn_join(asked, 3, beam=16, probes=5, self_join=True)
    assert x.graph().select("cell").distinct().count() == 1
    assert index.recall(vectors.knn_join(asked, v, 3, self_join=True), many).first()["recall"] >= 0.8


def test_beams_find_all_in_a_small_shard():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((200, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    place, sim, n = proximity.beams(x, proximity.links_of(x, 8), np.array([3, 50]), x[:40], 200)
    assert (np.sort(place, axis=1) == np.arange(200)).all() and (n == 200).all()
    assert np.allclose(sim, (x[:40] @ x.T)[np.arange(40)[:, None], place])


def odd(spark):
    rows = [(i, [1.0, i / 7, -i / 3, 0.5]) for i in range(30)] + [(40, None), (41, [1.0, None, 0.0, 0.0]), (42, [float("nan")] * 4), (43, [1.0]), (44, [0.0] * 4), (45, [])]
    return spark.createDataFrame(rows, "id long, vector array<double>").withColumn("cell", F.lit("clash"))


def test_indexes_of_odd_vectors(spark, tmp_path):
    v, q = odd(spark).drop("cell"), [1.0, 0.3, -0.2, 0.5]
    want = [r["id"] for r in vectors.search(v, q, 5).collect()]
    x = proximity.ProximityIndex.build(v, str(tmp_path / "x"), links=4)
    p = product.ProductIndex.build(v, str(tmp_path / "p"), parts=2)
    assert [r["id"] for r in x.search(q, 5).collect()] == [r["id"] for r in p.search(q, 5, recall=20).collect()] == want
    assert p.codes().count() == 30 and p.codes().where("octet_length(code) <> 2").count() == 0
    assert p.search([1.0], 3).count() == 0 and [r["id"] for r in p.search(q, 2, where=F.col("id") > 9).collect()] == [r["id"] for r in vectors.search(v.where("id > 9"), q, 2).collect()]
    exact = pairs(vectors.knn_join(v.where("id < 40"), v.where("id < 40"), 2, self_join=True))
    for how in (True, False):
        assert pairs(proximity.NeighbourGraph.build(v, str(tmp_path / f"n{how}"), 2, exact=how).edges()) == exact
    assert proximity.NeighbourGraph(spark, str(tmp_path / "nTrue")).edges(1).count() == 30
    none = v.limit(0)
    assert product.ProductIndex.build(none, str(tmp_path / "e")).search(q, 3).count() == 0


@needs_data
def test_product_codes_recall(spark, tmp_path):
    v = spark.read.parquet(f"{DATA}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    x, hits = product.ProductIndex.build(v, str(tmp_path / "x")), 0
    assert x.codes().where("octet_length(code) <> 16").isEmpty()  # of 64 single floats: a sixteenth
    for i in (0, 500, 1000, 1500):
        q = [float(c) for c in v.where(F.col("id") == i).first()["vector"]]
        hits += len({r["id"] for r in x.search(q, 10, recall=100).collect()} & {r["id"] for r in vectors.search(v, q, 10).collect()})
    assert hits >= 36


def test_product_codes_are_exact_beyond_the_recall(spark, tmp_path):
    # codes of two bytes, and hardly more candidates than hits: what the codes rank too low is found all the same
    rng = np.random.default_rng(5)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.standard_normal((1500, 12)))], "id long, vector array<double>")
    x = product.ProductIndex.build(v, str(tmp_path / "x"), parts=2)
    for q in rng.standard_normal((3, 12)).tolist():
        assert pairs(x.search(q, 10, recall=10).select("id", "score")) == pairs(vectors.search(v, q, 10).select("id", "score"))


def test_blocks_meet_without_a_shuffle_of_pairs(spark):
    v = spark.createDataFrame([(i, [1.0, i / 7, -i / 3], i % 2) for i in range(12)], "id long, vector array<double>, label int")
    for by in (None, "label"):
        plan = vectors.pairwise(v, block=3, by=by)._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"(?<!Broadcast)Exchange", plan)


def test_an_exact_join_copies_no_query_to_its_cells(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.standard_normal((300, 8)))], "id long, vector array<double>")
    x, seen, compared = index.VectorIndex.build(v, str(tmp_path / "x")), [], index.VectorIndex._compared
    monkeypatch.setattr(index.VectorIndex, "_compared", lambda self, queries, k, probes, *more: seen.append(probes) or compared(self, queries, k, probes, *more))
    monkeypatch.setattr(vectors, "BLOCK", 64)
    got = x.knn_join(v, 3, self_join=True)
    assert seen == [index.FIRST]
    assert pairs(got) == pairs(vectors.knn_join(v, v, 3, self_join=True))


def test_an_exact_join_lists_cells_by_block(spark, tmp_path, monkeypatch):
    """Lists of cells of each query grow faster than the input, and were read again for each partition of the other side."""
    rng = np.random.default_rng(4)
    x = np.round(rng.standard_normal((600, 6)), 3)
    x[1], x[2] = 0, x[3]
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(9000, None), (9001, [1.0])], "id long, vector array<double>")
    seen, blocks = [], vectors.blocks
    monkeypatch.setattr(vectors, "BLOCK", 64)
    monkeypatch.setattr(vectors, "blocks", lambda *a, **k: seen.append(blocks(*a, **k)) or seen[-1])
    got = pairs(index.VectorIndex.build(v, str(tmp_path / "x"), cells=40).knn_join(v, 4, self_join=True))
    asked = seen[0]
    assert "cells" not in asked.columns and asked.where("any is null or size(any) > 40 or size(array_distinct(any)) < size(any)").count() == 0
    assert got == pairs(vectors.knn_join(v.where("id <> 1"), v.where("id <> 1"), 4, self_join=True))
    assert [vectors.block_for(n) for n in (0, 64 * 16, 64 * 32, 10**9)] == [64, 64, 128, 256]


def test_links_are_looked_for_in_bounded_memory():
    import tracemalloc

    import numpy as np

    from graphloom.operators import proximity

    x = np.random.default_rng(0).normal(size=(3000, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tracemalloc.start()
    got = proximity.nearest(x, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    assert (got == np.argsort(-s, axis=1, kind="stable")[:, :5]).all() and peak < 40_000_000
