"""Hand-checked results on tiny inputs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import converged, graph, iterate, knowledge, local, predicates, structure, vectors
from graphloom.sources.store import LogStore, Registry, Store, TieredStore


def edges(spark, rows, weighted=False):
    return spark.createDataFrame(rows, "src string, dst string" + ", weight double" * weighted)


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


V = vectors.literal


@pytest.mark.parametrize(
    "name, a, b, distance",
    [
        ("cosine", [1, 0, 0], [1, 0, 0], 0.0), ("cosine", [1, 0, 0], [0, 1, 0], 1.0), ("cosine", [1, 0, 0], [-1, 0, 0], 2.0), ("cosine", [0, 0], [1, 0], 1.0),
        ("euclidean", [0, 0], [1, 1], math.sqrt(2)), ("Manhattan", [0, 0], [1, 1], 2.0), ("dotproduct", [1, 0], [1, 0], -1.0),
        ("jaccard", [1, 1, 1, 1], [0, 0, 0, 0], 1.0), ("jaccard", [0, 0], [0, 0], 0.0), ("hamming", [1, 1, 1, 1], [0, 0, 0, 0], 4.0),
    ],
)
def test_metrics(spark, name, a, b, distance):
    assert one(spark, vectors.metric(name)[0](V(a), V(b))) == pytest.approx(distance)


def test_metric_names(spark):
    with pytest.raises(ValueError):
        vectors.metric("chebyshev")
    assert one(spark, vectors.jaccard(V([0.8, 0.6, 0.9, 0.4]), V([0.7, 0.5, 0.8, 0.3]), 0.7)) == 1.0
    assert one(spark, vectors.cosine(F.array().cast("array<double>"), F.array().cast("array<double>"))) == 1.0


def test_quantisation(spark):
    back = one(spark, vectors.dequantize(vectors.quantize(V([0.1, 0.5, 0.9]))))
    assert max(abs(x - y) for x, y in zip(back, [0.1, 0.5, 0.9])) < 0.01
    assert one(spark, vectors.quantize(V([2.0, 2.0])))["codes"] == [0, 0]


def test_search_and_knn(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.9, 0.1, 0.0]), (3, [0.0, 0.0, 1.0]), (4, [0.0, 0.0, 0.0])], "id long, vector array<double>")
    got = vectors.search(v, [1.0, 0.0, 0.0], 2).collect()
    assert [r["id"] for r in got] == [1, 2] and got[0]["score"] > 0.99
    j = vectors.knn_join(v, v, 1, self_join=True).collect()
    assert {r["src"]: r["dst"] for r in j}[1] == 2
    blocks = vectors.knn_join(v, v, 2, self_join=True, block=2)
    assert pairs(blocks) == pairs(vectors.knn_join(v, v, 2, self_join=True))


def test_pairwise_gives_every_pair(spark):
    rng = random.Random(4)
    own = {i * 3 - 40: [rng.uniform(-1, 1) for _ in range(5)] for i in range(40)}
    odd = {200: [0.0] * 5, 201: None, 202: [], 203: [], 204: [1.0, 2.0], 205: [1.0, None, 0.0, 0.0, 0.0]}
    rows = [*own.items(), *odd.items(), (None, [1.0] * 5), (200, [0.0] * 5)]
    v = spark.createDataFrame(rows, "id long, vector array<double>")

    def cosine(x, y):
        if x is None or y is None or None in x + y or len(x) != len(y):
            return None
        norm = math.sqrt(sum(c * c for c in x) * sum(c * c for c in y))
        return round(sum(c * d for c, d in zip(x, y)) / norm, 5) + 0.0 if norm else 0.0 if x else 1.0

    want = [(i, j, cosine(x, y)) for i, x in rows for j, y in rows if i is not None and j is not None and i < j]
    for block in (1024, 7):
        got = vectors.pairwise(v, digits=5, block=block).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_pairwise_query_crosses_labels(spark, tmp_path):
    from graphloom.plans.registry import queries

    spark.createDataFrame([(i, [1.0, float(i)], i % 2) for i in range(6)], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries()["pairwise_all"](spark, str(tmp_path)).collect()
    assert {(r["a"], r["b"]) for r in got} == {(i, j) for j in range(6) for i in range(j)} and len(got) == 15


def test_payloads(spark):
    d = spark.createDataFrame([("v1", "A", 0.8, 1), ("v2", "B", 0.9, 2)], "id string, category string, score double, n long")
    d = d.select("id", F.create_map(F.lit("category"), predicates.string(F.col("category")), F.lit("score"), predicates.number(F.col("score")), F.lit("n"), predicates.integer(F.col("n"))).alias("fields"))
    ids = lambda f: [r["id"] for r in d.where(f.column(F.col("fields"))).orderBy("id").collect()]
    assert ids(predicates.PayloadFilter().must_match("A")) == ["v1"]
    assert ids(predicates.PayloadFilter().must_match(1)) == ["v1"]
    assert ids(predicates.PayloadFilter().must_match(1.0)) == []
    assert ids(predicates.PayloadFilter(must=[(predicates.Range(0.85, None), "score")])) == ["v2"]
    assert ids(predicates.PayloadFilter().should_match("A").should_match("B").must_not_match(2)) == ["v1"]
    near = spark.range(1).select(predicates.geo(F.lit(52.5), F.lit(13.4)).alias("v"))
    assert near.where(predicates.GeoRadius(52.5, 13.41, 1000)(F.col("v"))).count() == 1
    assert near.where(predicates.GeoRadius(52.5, 14.4, 1000)(F.col("v"))).count() == 0


def test_time_scopes_and_quarters(spark):
    now, hour = 1700000000000, 3600000
    d = spark.createDataFrame([(now - 25 * hour,), (now - 8 * 24 * hour,), (1500,), (now,)], "t long")
    n = lambda s, c=None: d.where(predicates.time_scope(F.col("t"), s, now, c)).count()
    assert n("today") == 1 and n("week") == 2 and n("month") == 3 and n("custom", (1000, 2000)) == 1 and n("chat") == 4
    q = lambda ms: one(spark, knowledge.quarter(F.lit(ms)))
    assert [q(1705320000000), q(1713182400000), q(1721044800000)] == ["2024-Q1", "2024-Q2", "2024-Q3"]


def test_traversal(spark):
    ring = edges(spark, [(f"n{i}", f"n{(i + 1) % 6}") for i in range(6)] * 2)
    assert pairs(iterate.bfs(ring, "n0", 2)) == [("n0", 0), ("n1", 1), ("n2", 2)]
    assert sorted(r[0] for r in iterate.graph_filter(ring, "n0", 2, inclusive=False).collect()) == ["n0", "n1"]
    assert iterate.graph_filter(ring, "n0", 0, inclusive=False).count() == 0
    g = graph.Graph(ring)
    assert g.counts().first() == (6, 12) and iterate.strong_components(g.edges, g.nodes).select("component").distinct().count() == 1
    assert iterate.topo_levels(ring, g.nodes).count() == 0


def test_weighted_paths(spark):
    e = edges(spark, [("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 2.0), ("c", "d", 1.0), ("x", "a", 1.0)], True)
    assert pairs(iterate.sssp(e, "a")) == [("a", 0.0), ("b", 1.0), ("c", 2.0), ("d", 3.0)]
    assert iterate.least_path(e, "a", "d").first() == (3.0, ["a", "b", "c", "d"])
    assert iterate.k_shortest(e, "a", "d", 5, 4).count() == 2
    bad = edges(spark, [("a", "b", 1.0), ("b", "a", -2.0)], True)
    with pytest.raises(ArithmeticError):
        iterate.sssp(bad, "a", rounds=3).count()
    assert sorted(local.negative_cycle(local.collect(bad, "weight"))) == ["a", "b"]


def test_structure(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("x", "y")])
    g = graph.Graph(e)
    assert pairs(iterate.connected_components(g.edges, g.nodes)) == [(n, "a") for n in "abcde"] + [("x", "x"), ("y", "x")]
    assert dict(pairs(iterate.strong_components(g.edges, g.nodes)))["c"] == "a"
    assert local.low_links(local.collect(e))[0] == [("c", "d"), ("d", "e"), ("x", "y")] and local.low_links(local.collect(e))[1] == ["c", "d"]
    assert sorted(map(tuple, (r["clique"] for r in structure.maximal_cliques(g.edges, g.nodes).collect()))) == [("a", "b", "c"), ("c", "d"), ("d", "e"), ("x", "y")]
    assert not iterate.is_bipartite(g.edges, g.nodes).first()[0]
    assert dict(pairs(iterate.clustering(g.edges, g.nodes)))["a"] == 1.0
    assert [r["path"] for r in iterate.simple_cycles(e, 4).collect()] == [["a", "b", "c"]]
    assert pairs(iterate.reduction(edges(spark, [("a", "b"), ("b", "c"), ("a", "c")]))) == [("a", "b"), ("b", "c")]


def test_spanning_and_matching_agree_with_greedy(spark):
    rng = random.Random(3)
    rows = [(f"n{a}", f"n{b}", float(rng.randint(1, 9))) for a in range(9) for b in range(a + 1, 9) if rng.random() < 0.6]
    e = edges(spark, rows, True)
    g = graph.Graph(e)
    forest = iterate.minimum_spanning_forest(g.edges, g.nodes).collect()
    assert sum(r["weight"] for r in forest) == sum(w for w, _, _ in local._forest(sorted((w, a, b) for a, b, w in rows)))
    used, want = set(), []
    for w, a, b in sorted((-w, a, b) for a, b, w in rows):
        if a not in used and b not in used:
            used |= {a, b}
            want.append((a, b, -w))
    assert pairs(iterate.greedy_matching(e)) == sorted(want)


def test_flows_and_local_invariants():
    unit = [("s", "a", 1.0), ("s", "b", 1.0), ("b", "a", 1.0), ("a", "t", 1.0), ("b", "t", 1.0)]
    assert local.max_flow(unit, "s", "t")[0] == 2.0 and local.max_flow(unit, "s", "s")[0] == 0.0
    # the second path has to push flow back over a -> b
    back = [("s", "a", 1.0), ("a", "b", 1.0), ("b", "t", 1.0), ("s", "b", 1.0), ("a", "t", 1.0)]
    assert local.max_flow(back, "s", "t")[0] == 2.0
    assert local.min_cost_flow([("s", "a", 1.0, 1.0), ("a", "t", 1.0, 1.0)], "s", "t") == (1.0, 2.0)
    e = [(a, b) for a in range(7) for b in range(7) if a != b and (a * b) % 3 != 1]
    color = dict(local.coloring(e))
    assert all(color[a] != color[b] for a, b in e)
    back_arcs = set(local.feedback_arc_set(e))
    assert all(c != "back" for _, _, c in local.edge_classes([x for x in e if x not in back_arcs]))
    assert local.dominators([(0, 1), (0, 2), (1, 3), (2, 3), (3, 4)], 0) and dict(local.dominators([(0, 1), (0, 2), (1, 3), (2, 3), (3, 4)], 0)) == {1: 0, 2: 0, 3: 0, 4: 3}
    assert local.steiner_tree([("a", "x", 1.0), ("b", "x", 1.0), ("c", "x", 1.0), ("a", "b", 5.0), ("x", "y", 1.0)], ["a", "b", "c"]) == [("a", "x", 1.0), ("b", "x", 1.0), ("c", "x", 1.0)]
    assert dict(local.betweenness([(0, 1), (1, 2)])) == {0: 0.0, 1: 1.0, 2: 0.0}


def test_pagerank_drops_dangling_mass(spark):
    e = edges(spark, [("a", "b"), ("a", "c")])
    g = graph.Graph(e)
    r = dict(pairs(iterate.pagerank(g.edges, g.nodes, 20)))
    assert r["a"] == pytest.approx(0.05) and r["b"] == pytest.approx(0.05 + 0.85 * 0.05 / 2) and sum(r.values()) < 1


def test_label_propagation_two_communities(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("y", "z"), ("z", "x"), ("c", "x")])
    g = graph.Graph(e)
    labels = dict(pairs(iterate.label_propagation(g.edges, g.nodes, 6)))
    assert labels["a"] == labels["b"] and labels["y"] == labels["z"]


def test_converged(spark):
    n = spark.createDataFrame([(1, "en"), (2, "en"), (3, "de")], "id long, lang string")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.1])], "id long, vector array<double>")
    e = spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")
    q = converged.ConvergedQuery([("lang", "Equals", "en")], converged.Neighbourhood(1, 2), converged.Semantic([1.0, 0.0], 0.5))
    assert [r["id"] for r in q.run(n, e, v).collect()] == [1]
    with pytest.raises(ValueError):
        converged.ConvergedQuery().run(n)


def test_knowledge(spark):
    a = F.create_map(F.lit("colour"), F.lit("red"), F.lit("size"), F.lit("1"))
    b = F.create_map(F.lit("colour"), F.lit("red"), F.lit("kind"), F.lit("2"))
    assert one(spark, knowledge.property_similarity(F.lit("Fruit"), a, F.lit("Fruit"), b)) == pytest.approx(0.6 + 0.4 / 3)
    t = spark.createDataFrame([(1, "I like New York a lot"), (2, "york new")], "id long, text string")
    l = spark.createDataFrame([("ny", "New York"), ("y", "york")], "id string, label string")  # noqa: E741
    assert pairs(knowledge.link_entities(t, l)) == [(1, "ny"), (1, "y"), (2, "y")]
    assert pairs(knowledge.entities_in(spark.createDataFrame([(1, "Anna met Bo in Rome")], "id long, text string"))) == [(1, "Anna"), (1, "Rome")]


def test_stores(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.upsert(spark.createDataFrame([("a", 1), ("b", 2)], "id string, v long"))
    s.upsert(spark.createDataFrame([("b", 3), ("b", 4), ("c", 5)], "id string, v long"), order="v")
    assert pairs(s.read()) == [("a", 1), ("b", 4), ("c", 5)]
    assert pairs(s.delete(spark.createDataFrame([("a",)], "id string"))) == [("a", 1)]
    assert pairs(s.scan_prefix("b")) == [("b", 4)] and s.get("zz").count() == 0
    with pytest.raises(ValueError):
        s.upsert(spark.createDataFrame([("", 1)], "id string, v long"))
    r = Registry(spark, str(tmp_path / "r"))
    r.add("one").upsert(spark.createDataFrame([("a",)], "id string"))
    r.add("two")
    assert pairs(r.find_anywhere("a")) == [("one", "a")] and r.names() == ["one", "two"] and r.remove("two") and not r.remove("two")
    t = TieredStore(spark, str(tmp_path / "t"))
    t.stores["active"].upsert(spark.createDataFrame([("a", 1), ("b", 1)], "id string, v long"))
    t.promote(spark.createDataFrame([("a",)], "id string"), "active", "recent")
    assert sorted((x["id"], x["tier"]) for x in t.read().collect()) == [("a", "recent"), ("b", "active")]


def test_logs(spark, tmp_path):
    logs = LogStore(spark, str(tmp_path / "l"))
    logs.append(spark.createDataFrame([(1, 1000, "error", "db open", "m", "Storage"), (2, 2000, "error", "net", "m", "GrpcServer"), (3, 3000, "info", "db", "m", "Storage")], "id long, timestamp long, level string, context string, message string, source string"))
    assert [r["id"] for r in logs.query(level="ERROR").collect()] == [2, 1] and [r["id"] for r in logs.query(context="db").collect()] == [3, 1]
    assert logs.query(source="grpc").count() == 1
    for bad in (0, 10001):
        with pytest.raises(ValueError):
            logs.query(limit=bad)
    with pytest.raises(ValueError):
        logs.query(since="yesterday")
    assert {(r["kind"], r["value"]): r["n"] for r in logs.stats().collect()}[("level", "error")] == 2
    assert logs.clear() == 3 and logs.query().count() == 0


def test_batches_and_generators(spark):
    ops = spark.createDataFrame([("a", 1, "add"), ("a", 2, "remove"), ("b", 3, "add")], "k string, seq long, op string")
    assert pairs(graph.apply_batch(ops, ["k"])) == [("b",)]
    assert graph.complete(spark, 4).count() == 12 and graph.cycle(spark, 4).count() == 4 and graph.star(spark, 4).count() == 3 and graph.binary_tree(spark, 2).count() == 6
    assert pairs(graph.random(spark, 10, 0.3, 1)) == pairs(graph.random(spark, 10, 0.3, 1))
    g = graph.Graph(graph.path(spark, 3))
    assert [r["line"] for r in g.dot("g").orderBy("line_no").collect()] == ["digraph g {", '  "0";', '  "1";', '  "2";', '  "0" -> "1";', '  "1" -> "2";', "}"]


def test_running_totals_over_ranges(spark, monkeypatch):
    from graphloom.operators import ordering

    monkeypatch.setattr(ordering, "ROWS_PER_RANGE", 7)
    rows = [(f"k{i:03d}", i % 5) for i in range(50)]
    random.Random(1).shuffle(rows)
    got = {r["k"]: (r["n"], r["t"]) for r in ordering.running(ordering.running(spark.createDataFrame(rows, "k string, v long"), ["k"], out="n"), ["k"], F.col("v"), "t").collect()}
    total = 0
    for i, (k, v) in enumerate(sorted(rows)):
        total += v
        assert got[k] == (i + 1, total)


def test_k_shortest_against_enumeration(spark):
    rng = random.Random(11)
    rows = sorted({(rng.randrange(8), rng.randrange(8)) for _ in range(30)})
    e = spark.createDataFrame([(a, b, float(rng.randrange(1, 4))) for a, b in rows], "src long, dst long, weight double")
    want = sorted((r["cost"], r["path"]) for r in iterate.simple_paths(e.where("src <> dst"), 0, 5, 9).collect())
    for k in (1, 4, 12):
        got = [(r["cost"], r["path"]) for r in iterate.k_shortest(e, 0, 5, k).orderBy("rank").collect()]
        assert got == want[:k]
    assert iterate.k_shortest(e, 0, 99, 3).count() == 0
    assert [r["path"] for r in iterate.k_shortest(e, 3, 3, 2).collect()] == [[3]]


def test_searches_agree_with_relaxation(spark):
    """A* with a true bound visits less and finds the same, so do the two-sided search and Johnson's costs; long chains are no cycles."""
    rng = random.Random(2)
    rows = [(a, b, float(rng.randrange(1, 9))) for a, b in sorted({(rng.randrange(20), rng.randrange(20)) for _ in range(60)}) if a != b]
    e = spark.createDataFrame(rows, "src long, dst long, weight double")
    dist = {r["id"]: r["cost"] for r in iterate.sssp(e, 0).collect()}
    goal = max(dist, key=lambda x: (dist[x], x))
    hops = iterate.bfs(e, goal, direction="in").withColumnRenamed("depth", "h")
    zero = spark.createDataFrame([], "id long, h double")
    plain, guided = iterate.astar(e, 0, goal, zero).first(), iterate.astar(e, 0, goal, hops).first()
    assert plain["cost"] == guided["cost"] == dist[goal] and guided["settled"] <= plain["settled"]
    assert iterate.bidirectional(e, 0, goal).first()["cost"] == dist[goal] and iterate.bidirectional(e, 0, 99).count() == 0 and iterate.bidirectional(e, 4, 4).first()["cost"] == 0
    low = e.withColumn("weight", F.col("weight") + (F.col("src") - F.col("dst")) * 3)
    costs, potential = iterate.johnson(low)
    assert {(r["src"], r["dst"]): r["cost"] for r in costs.collect()} == {(r["src"], r["dst"]): r["cost"] + 3 * (r["src"] - r["dst"]) for r in iterate.apsp(e).collect()}
    assert potential.where("potential < 0").count() > 0
    chain = spark.range(70).selectExpr("id as src", "id + 1 as dst", "1.0D as weight")
    assert iterate.sssp(chain, 0).agg(F.max("cost")).first()[0] == 70
    with pytest.raises(ArithmeticError):
        iterate.sssp(spark.createDataFrame([(0, 1, 1.0), (1, 0, -2.0)], "src long, dst long, weight double"), 0)


def test_strong_components_by_colours(spark):
    rng = random.Random(4)
    rows = sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(60)})
    e = spark.createDataFrame(rows, "src long, dst long")
    nodes = spark.range(42)
    c = {(r["src"], r["dst"]) for r in iterate.closure(e).collect()}
    want = {i: min([j for j in range(42) if (i, j) in c and (j, i) in c] + [i]) for i in range(42)}
    assert {r["id"]: r["component"] for r in iterate.strong_components(e, nodes).collect()} == want
    assert iterate.has_cycle(e) and not iterate.has_cycle(spark.range(9).selectExpr("id as src", "id + 1 as dst"))


def test_walks(spark):
    e = spark.createDataFrame([(0, 1, "a"), (1, 2, "a"), (2, 0, "b"), (1, 3, "b")], "src long, dst long, edge_type string")
    start = spark.range(1)
    assert pairs(iterate.walks(e, start, 0, 2)) == [(0, 0, 0), (0, 1, 1), (0, 2, 2), (0, 3, 2)]
    assert pairs(iterate.walks(e, start, 1, 3, ["a"])) == [(0, 1, 1), (0, 2, 2)]


def test_the_smallest_after_three_edges_is_looked_for_from_all(spark, monkeypatch):
    """F5 of r04: not only from the smallest that three edges reach; and the SQL ends no walk at 60 edges."""
    import duckdb

    from graphloom.plans import q_graph, registry

    def both(rows, run=True):
        con = duckdb.connect()
        con.execute("create table edges(src bigint, dst bigint)")
        con.executemany("insert into edges values (?, ?)", rows or [(None, None)])
        want = con.execute(registry.oracle_sql()["sim_bidirectional"].replace(q_graph._SIM_AS, "with recursive trade as (select * from edges)", 1)).fetchall()
        if run:
            e = spark.createDataFrame(rows, "src long, dst long")
            monkeypatch.setattr(q_graph, "sim_edges", lambda s, d: e)
            assert [tuple(r) for r in registry.queries()["sim_bidirectional"](spark, "").collect()] == want
        return want

    # three edges reach 5, which leads nowhere else, and 9, which leads to 3
    assert both([(0, 7), (7, 8), (8, 5), (8, 9), (5, 6), (6, 5), (9, 3), (3, 9)]) == [(4.0,)]
    assert both([(0, 7), (7, 8)]) == both([]) == []
    assert both([(0, 7), (7, 0)]) == [(0.0,)]
    assert both([(0 if i == 90 else i, i - 1) for i in range(2, 91)], run=False) == [(89.0,)]


def test_flows_agree():
    rng = random.Random(3)
    for _ in range(40):
        e = sorted({(rng.randrange(7), rng.randrange(7)): float(rng.randrange(1, 9)) for _ in range(20)}.items())
        e = [(a, b, w) for (a, b), w in e]
        (v, f), (x, g) = local.max_flow(e, 0, 6), local.dinic(e, 0, 6)
        cuts = [sum(w for a, b, w in e if a in s and b not in s) for m in range(32) for s in [{0} | {i + 1 for i in range(5) if m >> i & 1}]]
        assert v == x == min(cuts)
        for flow in (f, g):
            for n in range(1, 6):
                assert sum(z for a, _, z in flow if a == n) == sum(z for _, b, z in flow if b == n)


def test_greedy_orders_by_heaps():
    """The heaps give what the plain greedy rules give."""
    rng = random.Random(7)
    for _ in range(60):
        e = sorted({(rng.randrange(9), rng.randrange(9)) for _ in range(rng.randrange(1, 30))})
        near = local.adjacency([x for x in e if x[0] != x[1]], undirected=True)
        left, color = set(local.nodes_of(e)), {}
        while left:
            n = min(left, key=lambda x: (-len({color[y] for y in near.get(x, ()) if y in color}), -len(near.get(x, ())), x))
            used = {color[y] for y in near.get(n, ()) if y in color}
            color[n] = next(c for c in range(99) if c not in used)
            left.discard(n)
        assert dict(local.coloring(e)) == color
        p = [x for x in e if x[0] != x[1]]
        left, head, tail = set(local.nodes_of(e)), [], []
        while left:
            out = {x: [b for a, b in p if a == x and b in left] for x in left}
            into = {x: [a for a, b in p if b == x and a in left] for x in left}
            sinks, sources = [x for x in left if not out[x]], [x for x in left if not into[x]]
            n = min(sinks or sources or left, key=(lambda x: x) if sinks or sources else lambda x: (len(into[x]) - len(out[x]), x))
            (tail if sinks else head).append(n)
            left.discard(n)
        place = {n: i for i, n in enumerate(head + tail[::-1])}
        assert local.feedback_arc_set(e) == [x for x in p if place[x[0]] > place[x[1]]] + [x for x in e if x[0] == x[1]]
    sets = local.DisjointSet(range(6))
    assert sets.union(4, 2) and sets.union(5, 4) and not sets.union(2, 5)
    assert sets.labels() == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 2), (5, 2)]


def test_random_graph_density(spark):
    g = graph.random(spark, 200, 0.03, 5)
    n = g.count()
    assert abs(n - 200 * 199 * 0.03) < 5 * math.sqrt(200 * 199 * 0.03) and g.distinct().count() == n and g.where("src = dst or src >= 200 or dst >= 200 or dst < 0").isEmpty()
    assert pairs(g) == pairs(graph.random(spark, 200, 0.03, 5)) != pairs(graph.random(spark, 200, 0.03, 6))
    assert graph.random(spark, 5, 1.0).count() == 20 and graph.random(spark, 5, 0.0).count() == 0


def test_coarse_index(spark, tmp_path):
    import numpy as np

    from graphloom.operators import index

    rng = np.random.default_rng(1)
    base = rng.normal(size=(30, 16))
    x = np.concatenate([b + 0.3 * rng.normal(size=(20, 16)) for b in base])
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)] + [(900, [0.0] * 16, 0), (901, None, 0)]
    v = spark.createDataFrame(rows, "id long, vector array<double>, label long")
    ix = index.VectorIndex.build(v, str(tmp_path / "ix"))
    again = index.VectorIndex(spark, str(tmp_path / "ix"))
    for q in (x[5], x[77] + 0.5, -x[3]):
        want = pairs(vectors.search(v.where("vector is not null"), q.tolist(), 12).select("id", "score"))
        assert pairs(again.search(q.tolist(), 12).select("id", "score")) == want
        assert len(set(pairs(ix.search(q.tolist(), 12, probes=12).select("id", "score"))) & set(want)) >= 9
    filtered = pairs(ix.search(x[5].tolist(), 7, where=F.col("label") == 1).select("id", "score"))
    assert filtered == pairs(vectors.search(v.where("label = 1"), x[5].tolist(), 7).select("id", "score"))
    good = v.where("vector is not null and id < 900")
    exact = vectors.knn_join(good, good, 5, self_join=True)
    assert pairs(ix.knn_join(good, 5, len(ix.centers), self_join=True)) == pairs(exact)
    assert index.recall(exact, ix.knn_join(good, 5, 6, self_join=True)).first()["recall"] >= 0.9
    # a crowded cell is compared block by block
    index.BLOCK, held = 7, index.BLOCK
    assert pairs(ix.knn_join(good, 5, len(ix.centers), self_join=True)) == pairs(exact)
    index.BLOCK = held
    none = index.VectorIndex.build(v.limit(0), str(tmp_path / "none"))
    assert none.search([1.0] * 16, 3).count() == 0


def test_segments_and_warm_cache(spark, tmp_path):
    from graphloom.operators import index

    v = spark.range(25).selectExpr("id", "array(1.0D, id / 10.0D) as vector", "id % 2 as label")
    s = index.SegmentedIndex(spark, str(tmp_path / "s"), roll=10)
    s.add(v.where("id < 12"))
    s.add(v.where("id >= 12"))
    assert sorted(r["n"] for r in s.segments().collect()) == [5, 10, 10]
    assert sorted(r["n"] for r in s.optimize(str(tmp_path / "t")).segments().collect()) == [5, 10, 10]
    assert pairs(s.search([1.0, 1.0], 4).select("id")) == pairs(vectors.search(v, [1.0, 1.0], 4).select("id"))
    assert pairs(s.search([1.0, 1.0], 4, where=F.col("label") == 0).select("id")) == pairs(vectors.search(v.where("label = 0"), [1.0, 1.0], 4).select("id"))
    now = [0.0]
    cache = index.WarmCache(lambda k: vectors.search(v, [1.0, 1.0], k), ttl=10, size=2, clock=lambda: now[0])
    assert cache.get(2) == cache.get(2) and (cache.hits, cache.misses) == (1, 1)
    now[0] = 11
    cache.get(2), cache.get(3), cache.get(4)
    assert (cache.hits, cache.misses) == (1, 4) and len(cache.held) == 2


def test_store_deltas_and_transactions(spark, tmp_path):
    import os

    s = Store(spark, str(tmp_path / "s"))
    row = lambda *r: spark.createDataFrame(list(r), "id string, x int")
    s.upsert(row(("a", 1), ("b", 2)))
    s.upsert(row(("b", 3), ("c", 4)))
    assert [n.rsplit(".")[-1] for n in s.segments()] == ["delta", "delta"] and pairs(s.read()) == [("a", 1), ("b", 3), ("c", 4)]
    with s.transaction() as t:
        t.delete(row(("a", 0)))
        t.upsert(row(("d", 5)))
        t.upsert(row(("a", 7)))
        t.delete(row(("c", 0)))
        assert pairs(t.read()) == [("a", 7), ("b", 3), ("d", 5)] and pairs(s.read()) == [("a", 1), ("b", 3), ("c", 4)]
    assert pairs(s.read()) == [("a", 7), ("b", 3), ("d", 5)] and pairs(s.get("a")) == [("a", 7)]
    with pytest.raises(RuntimeError), s.transaction() as t:
        t.delete(row(("b", 0)))
        raise RuntimeError("no")
    t = s.transaction()
    t.upsert(row(("z", 1)))
    t.abort()
    with pytest.raises(RuntimeError):
        t.commit()
    assert pairs(s.read()) == [("a", 7), ("b", 3), ("d", 5)]
    # a write that was cut off has no marker
    last = s.segments()[-1]
    os.remove(tmp_path / "s" / last / "_SUCCESS")
    assert pairs(s.read()) == [("a", 1), ("b", 3), ("c", 4)]
    for i in range(12):
        s.upsert(row((f"k{i}", i)))
    assert s.segments()[0].endswith(".base") and len(s.segments()) <= 9 and s.read().count() == 15
    before = pairs(s.read())
    assert s.vacuum() > 0 and pairs(s.read()) == before
    assert pairs(s.delete(row(("a", 0), ("nobody", 0)))) == [("a", 1)] and s.read().count() == 14


def test_labels_of_many_lengths(spark):
    texts = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(120)))], "id long, text string")
    entities = spark.createDataFrame([(n, " ".join(f"w{i}" for i in range(n))) for n in range(1, 101)] + [(500, "w1 w3"), (501, "")], "id long, label string")
    assert sorted(r["entity_id"] for r in knowledge.link_entities(texts, entities).collect()) == list(range(1, 101))
    assert knowledge.link_entities(texts, entities.limit(0)).count() == 0


def test_file_formats(spark, tmp_path):
    from graphloom.sources import files

    d = spark.createDataFrame([(1, "a,b\n\"c\"", None), (2, "", 2.5), (3, None, 0.0)], "id long, t string, x double")
    for kind in files.FORMATS:
        at = str(tmp_path / f"t.{kind}")
        files.write(d, at)
        assert sorted(map(tuple, files.read(spark, at, schema=d.schema).collect())) == sorted(map(tuple, d.collect()))
    with pytest.raises(ValueError):
        files.read(spark, "x.xlsx")


def test_rows_without_an_order_are_kept(spark, tmp_path):
    d = spark.createDataFrame([("a", 5, 1), ("a", None, 2), ("b", None, 3)], "id string, ts int, x int")
    s = Store(spark, str(tmp_path / "s"))
    s.upsert(d, order="ts")
    assert pairs(s.read()) == [("a", 5, 1), ("b", None, 3)]
    assert pairs(knowledge.latest(d, ["id"], F.col("ts"))) == [("a", 5, 1), ("b", None, 3)]
    ops = spark.createDataFrame([(1, None, "add"), (2, 1, "add"), (2, None, "remove"), (3, 1, "remove"), (3, None, "add")], "k int, seq int, op string")
    assert pairs(graph.apply_batch(ops, ["k"])) == [(1,), (2,)]
    copies = spark.createDataFrame([(1, None), (1, "cold"), (2, "odd"), (3, "cold"), (3, "hot")], "id int, tier string")
    assert pairs(knowledge.first_tier(copies, ["hot", "cold"])) == [(1, "cold"), (2, "odd"), (3, "hot")]


def test_two_writers(spark, tmp_path):
    from graphloom.sources.log import Conflict

    s, row = Store(spark, str(tmp_path / "s")), lambda *r: spark.createDataFrame(list(r), "id string, x int")
    s.upsert(row(("a", 1), ("b", 1)))
    first, second, apart = s.transaction(), s.transaction(), s.transaction()
    first.upsert(row(("a", 2)))
    second.upsert(row(("a", 3), ("c", 3)))
    apart.upsert(row(("d", 4)))
    first.commit()
    assert pairs(second.read()) == [("a", 3), ("b", 1), ("c", 3)] and pairs(apart.get("a")) == [("a", 1)]
    with pytest.raises(Conflict):
        second.commit()
    apart.commit()  # other keys: goes through behind the first
    assert pairs(s.read()) == [("a", 2), ("b", 1), ("d", 4)] and pairs(s.read(1)) == [("a", 1), ("b", 1)]
    late, gone = s.transaction(), s.transaction()
    for i in range(12):  # a new base of the same rows is no conflict
        s.upsert(row(("x", i)))
    late.upsert(row(("y", 1)))
    late.commit()
    s.vacuum()
    gone.upsert(row(("z", 1)))
    with pytest.raises(Conflict):
        gone.commit()
    t = s.transaction()
    s.write(row(("only", 1)))
    t.delete(row(("nobody", 0)))
    with pytest.raises(Conflict):
        t.commit()
    assert pairs(s.read()) == [("only", 1)]


def test_segments_fill_and_forget(spark, tmp_path):
    import shutil

    from graphloom.operators import index

    s = index.SegmentedIndex(spark, str(tmp_path / "s"), roll=10)
    assert s.search([1.0, 0.0], 3).count() == 0 and s.segments().count() == 0
    v = lambda lo, hi: spark.range(lo, hi).selectExpr("id", "array(1.0D, id / 10.0D) as vector")
    for lo, hi in ((0, 3), (3, 6), (6, 9), (9, 10)):
        s.add(v(lo, hi))
    assert pairs(s.segments()) == [(0, 10)]
    s.add(v(10, 12))
    assert pairs(s.segments()) == [(0, 10), (1, 2)]
    s.remove(spark.range(0, 4))
    assert pairs(s.segments()) == [(0, 6), (1, 2)] and pairs(s.search([1.0, 0.0], 2).select("id")) == [(4,), (5,)]
    s.add(v(1, 2))
    assert pairs(s.search([1.0, 0.0], 2).select("id")) == [(1,), (4,)]
    # a batch without an entry in the log was cut off
    shutil.copytree(next((tmp_path / "s" / "add").iterdir()), tmp_path / "s" / "add" / "batch_=cut")
    assert s.rows().count() == 9 and pairs(s.optimize(str(tmp_path / "t")).segments()) == [(0, 9)]


def test_odd_vectors_agree(spark, tmp_path):
    from graphloom.operators import index

    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, i / 7, -i / 3]) for i in range(9)] + [(20, [nan, 1.0, 0.0]), (21, None), (22, [1.0, None, 0.0]), (23, [1.0, 0.0]), (24, [inf, 1.0, 0.0]), (25, [0.0, 0.0, 0.0]), (26, [])]
    v = spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)
    q, x = [1.0, 0.2, -0.4], index.VectorIndex.build(v, str(tmp_path / "x"), cells=3)
    s = index.SegmentedIndex(spark, str(tmp_path / "s"), roll=4)
    s.add(v)
    want = pairs(vectors.search(v, q, 20).select("id", "score"))
    assert [i for i, _ in want] == [*range(9), 25]
    for got in (x.search(q, 20), x.search(q, 20, probes=3), s.search(q, 20)):
        assert pairs(got.select("id", "score")) == want
    score = {r["id"]: r["c"] for r in v.select("id", vectors.cosine(F.col("vector"), vectors.literal(q)).alias("c")).collect()}
    assert all(score[i] is None for i in (20, 21, 22, 23, 24, 26)) and score[25] == 0.0
    exact = pairs(vectors.knn_join(v.where("id < 20"), v, 3, self_join=True).where("dst <> 25"))
    assert pairs(x.knn_join(v.where("id < 20"), 3, self_join=True)) == exact and len(exact) == 27
    assert {r["src"] for r in vectors.knn_join(v, v, 3, self_join=True).collect()} == {*range(9), 23, 25} - {23}
    lone = {(r["a"], r["b"]): r["sim"] for r in vectors.pairwise(v).collect()}
    assert lone[(0, 20)] is None and lone[(0, 24)] is None and lone[(0, 23)] is None and lone[(0, 25)] == 0.0


def test_a_store_by_format_name(spark, tmp_path):
    from graphloom.sources import source

    source.register(spark)
    s = Store(spark, str(tmp_path / "s"))
    row = lambda *r: spark.createDataFrame(list(r), "id string, x int")
    s.write(spark.range(5000).selectExpr("lpad(id, 5, '0') as id", "cast(id as int) as x").repartition(4))
    s.upsert(row(("00007", -7), ("zzz", 1)))
    s.delete(row(("00009", 0), ("zzz", 0)))
    s.upsert(spark.createDataFrame([("00011", 3, "more")], "id string, x int, note string"))
    read = lambda **o: spark.read.format("graphloom").options(**o).load(str(tmp_path / "s"))
    d = read()
    assert d.columns == ["id", "x", "note"] and pairs(d.selectExpr("id", "x", "coalesce(note, '') as n")) == pairs(s.read().selectExpr("id", "x", "coalesce(note, '') as n"))
    one = d.where("id = '00007'")
    assert [tuple(r)[:2] for r in one.collect()] == [("00007", -7)] and d.where("id between '00005' and '00010' and x > 5").count() == 3
    assert read(version="1").count() == 5000 and read(version="2").count() == 5001
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "graphloom" in plan.lower() and "00007" not in plan.split("BatchScan")[0]  # no filter is left above the scan
    reader = source.StoreReader(str(tmp_path / "s"), "id", None, d.schema)
    every = len(reader.partitions())
    assert list(reader.pushFilters([source.EqualTo(("id",), "00007"), source.EqualTo(("x",), 1)])) == [source.EqualTo(("x",), 1)] and len(reader.partitions()) < every
    with pytest.raises(Exception):
        read(version="0").count()


def test_hot_keys_are_split(spark, monkeypatch):
    from graphloom.functions import ml

    scores = spark.createDataFrame([(i, "a" if i < 900 else None, i / 100) for i in range(1000)], "id long, k string, score double")
    top = {k: sum(math.exp(i / 100 - m / 100) for i in r) for k, r, m in (("a", range(900), 899), (None, range(900, 1000), 999))}
    got = {r["id"]: r["p"] for r in ml.softmax(scores, "k", digits=9).collect()}
    assert all(got[i] == pytest.approx(math.exp((i - (899 if i < 900 else 999)) / 100) / top["a" if i < 900 else None], abs=1e-8) for i in got)
    assert "Window" not in ml.softmax(scores, "k")._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(knowledge, "HUB", 7)
    rng = random.Random(4)
    rels = [(rng.randrange(30), 99, "r", rng.uniform(-1, 1)) for _ in range(60)] + [(99, rng.randrange(30), "r", rng.uniform(-1, 1)) for _ in range(40)] + [(1, 2, "q", 0.5)]
    best = {}
    for a, m, r, c in rels:
        for b, t, q, e in rels:
            if m == b and r == q and a != t and not any((a, t, r) == x[:3] for x in rels):
                best[a, t, r] = max(best.get((a, t, r), -9), c * e)
    got = {(r["src"], r["dst"], r["rel"]): r["confidence"] for r in knowledge.infer(spark.createDataFrame(rels, "src long, dst long, rel string, confidence double")).collect()}
    assert got.keys() == best.keys() and all(got[k] == pytest.approx(best[k], abs=1e-6) for k in best)
    v = spark.createDataFrame([(i, [float(i), 1.0], i % 3 if i else None) for i in range(20)], "id long, vector array<double>, label int")
    want = {(r["a"], r["b"], r["sim"]) for r in vectors.pairwise(v).collect() if r["a"] and r["a"] % 3 == r["b"] % 3}
    assert {tuple(r) for r in vectors.pairwise(v, block=3, by="label").collect()} == want


def test_blocks_are_looked_through_in_single_precision(spark):
    """Places above bounds; and neighbours that single precision cannot tell apart, copies and zeros come out as in double."""
    import numpy as np

    from graphloom.operators import vectors as V

    rng = np.random.default_rng(0)
    for shape in ((16, 24), (5, 7), (1, 8), (3, 0)):
        s, low = rng.normal(size=shape).astype(np.float32), rng.normal(size=shape[0]).astype(np.float32)
        assert [list(x) for x in V.at_least(s, low)] == [list(x) for x in np.nonzero(s >= low[:, None])]
    x = rng.normal(size=(300, 16))
    x[100:200] = x[0] + rng.normal(size=(100, 16)) * 1e-5
    x[200:280], x[299] = x[1], 0
    unit = np.divide(x, np.linalg.norm(x, axis=1, keepdims=True), out=np.zeros_like(x), where=x.any(1)[:, None])
    sim = np.round(unit @ unit.T, 9)
    np.fill_diagonal(sim, -np.inf)
    want = sorted((i, int(j)) for i in range(300) for j in np.lexsort((np.arange(300), -sim[i]))[:3])
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    got = V.knn_join(d, d, 3, self_join=True, digits=9, block=64)
    assert sorted((r["src"], r["dst"]) for r in got.collect()) == want


def test_few_of_many_near_places_are_compared_again():
    """Of places above a weak bound those that can be among a row's k best are left, copies at the k-th best included."""
    import numpy as np

    from graphloom.operators import vectors as V

    rng = np.random.default_rng(2)
    s = rng.normal(size=(40, 500)).astype(np.float32)
    s[3], s[4, 100:300], s[5, 2:] = 0.5, 4.0, -np.inf
    low = np.full(40, -1.0, np.float32)
    low[6] = 9
    rows, cols = V.at_least(s, low)
    got = set(zip(*(x.tolist() for x in V.near_best(s, rows, cols, 3, 1e-3))))
    want = set()
    for i in range(40):
        own = cols[rows == i]
        bar = np.sort(s[i, own])[-3] - 1e-3 if len(own) >= 3 else -np.inf
        want |= {(i, int(j)) for j in own if s[i, j] >= bar}
    assert got == want and len(got) < len(rows) // 4 and sum(i == 3 for i, _ in got) == 500


def test_cliques_are_grown_in_all_tasks(spark, monkeypatch):
    from graphloom.operators import structure

    held, write = {}, structure.materialize
    monkeypatch.setattr(structure, "materialize", lambda df, tag="t": held.setdefault(tag, df) is None or write(df, tag))
    e = spark.range(200).selectExpr("id as src", "(id * 7 + 1) % 200 as dst")
    structure.maximal_cliques(e, spark.range(200)).collect()
    assert held["cliques"].rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
