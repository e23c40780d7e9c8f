"""Reachability, eccentricities, communities, isomorphism, cliques and places against brute force."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import graph, iterate, reach, spatial, structure


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


def drawn(spark, n, m, seed):
    rng = random.Random(seed)
    e = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    return e, spark.createDataFrame(e, "src long, dst long")


def hops(e, nodes):
    near = {v: {b for a, b in e if a == v} for v in nodes}
    out = {}
    for v in nodes:
        dist, ring, k = {v: 0}, {v}, 0
        while ring:
            k += 1
            ring = {w for u in ring for w in near[u]} - dist.keys()
            dist.update(dict.fromkeys(ring, k))
        out[v] = dist
    return out


@pytest.mark.parametrize("seed, m, first", [(1, 30, 16), (2, 60, 2), (3, 12, 1)])
def test_reachability_labels_against_search(spark, tmp_path, monkeypatch, seed, m, first):
    monkeypatch.setattr(reach, "FIRST", first)
    monkeypatch.setattr(reach, "GROWTH", 3)
    e, d = drawn(spark, 25, m, seed)
    nodes = spark.range(25)
    x = reach.ReachabilityIndex.build(d, nodes, str(tmp_path / "x"))
    far = hops(e, range(25))
    asked = [(a, b) for a in range(-1, 26) for b in range(-1, 26)]
    got = reach.ReachabilityIndex(spark, str(tmp_path / "x")).reaches(spark.createDataFrame(asked + asked[:5], "src long, dst long"))
    assert pairs(got) == sorted((a, b, a in far and b in far.get(a, {})) for a, b in asked)
    assert "closure" not in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("seed, m, low", [(5, 30, False), (6, 40, True)])
def test_reachability_of_the_ends_of_edges_needs_no_numbers(spark, tmp_path, monkeypatch, seed, m, low):
    """F2 of r04: no join for numbers and none of components without a cycle; cycles are still found."""
    e, d = drawn(spark, 20, m, seed)
    e = [(min(x), max(x)) if low else x for x in e]
    d = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in e] * 2 + [(None, "n1")], "src string, dst string")
    monkeypatch.setattr(iterate, "trimmed", (lambda *a: pytest.fail("trimmed")) if low else iterate.trimmed)
    x = reach.ReachabilityIndex.build(d, None, str(tmp_path / "x"))
    ends = {v for x in e for v in x} | {1}
    far = hops(e, ends)
    asked = [(a, b) for a in range(21) for b in range(21)]
    got = x.reaches(spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in asked], "src string, dst string"))
    assert pairs(got) == sorted((f"n{a}", f"n{b}", b in far.get(a, {})) for a, b in asked)
    assert not low or got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2


def test_sinks_with_most_edges_go_at_once(spark):
    e = spark.createDataFrame([(a, b) for a in range(30) for b in range(100, 104)] + [(200 + a, a) for a in range(30)], "src long, dst long")
    left, _, gone, _, marks = reach._round(e)
    assert marks == "d" and pairs(gone) == [(b,) for b in range(100, 104)] and left.count() == 30


def test_labels_of_a_chain_are_few(spark, tmp_path):
    n = 64
    x = reach.ReachabilityIndex.build(graph.path(spark, n), spark.range(n), str(tmp_path / "x"), acyclic=True)
    assert sum(r["n"] for r in x.labels().collect()) < n * (n + 1) / 2  # a closure has 2080 pairs
    none = reach.ReachabilityIndex.build(graph.path(spark, 0), spark.range(0), str(tmp_path / "none"))
    assert none.reaches(spark.createDataFrame([(1, 1)], "src long, dst long")).first()["reaches"] is False


def test_eccentricities_against_search(spark):
    e, d = drawn(spark, 40, 70, 4)
    far = hops(e, range(40))
    got = {r["id"]: (r["eccentricity"], r["reached"]) for r in reach.eccentricities(d, spark.range(40)).collect()}
    assert got == {v: (max(x.values()), len(x)) for v, x in far.items()}
    assert reach.eccentricities(d.limit(0), spark.range(2)).where("eccentricity > 0").isEmpty()


def test_communities(spark):
    e = [(a, b) for k in range(4) for a, b in itertools.combinations(range(k * 6, k * 6 + 6), 2)] + [(k * 6, (k * 6 + 6) % 24) for k in range(4)]
    d = spark.createDataFrame(e, "src long, dst long")
    g = graph.Graph(d, spark.range(26))
    got = structure.communities(g.edges, g.nodes)
    assert pairs(got) == [(i, i // 6 * 6) for i in range(24)] + [(24, 24), (25, 25)]
    both = structure.symmetric(d)
    inside, total = 2 * 15 * 4, 2 * 64
    assert structure.modularity(both, got) == pytest.approx(inside / total - 4 * (32 / total) ** 2)
    assert structure.communities(d.limit(0), spark.range(3)).count() == 3


def test_communities_are_not_worse_than_label_votes(spark):
    rng = random.Random(8)
    e = [(i, rng.choice([j for j in range(60) if j % 5 == i % 5 or rng.random() < 0.1])) for i in range(60) for _ in range(3)]
    g = graph.Graph(spark.createDataFrame(e, "src long, dst long"))
    both = structure.symmetric(g.edges)
    assert structure.modularity(both, structure.communities(g.edges, g.nodes)) >= structure.modularity(both, iterate.label_propagation(g.edges, g.nodes, 8))


def test_isomorphism(spark):
    e, d = drawn(spark, 14, 45, 1)
    perm = list(range(14))
    random.Random(2).shuffle(perm)
    other = spark.createDataFrame([(perm[a] * 10, perm[b] * 10) for a, b in e], "src long, dst long")
    found = dict(pairs(structure.isomorphism(d, other)))
    assert sorted((found[a], found[b]) for a, b in e) == sorted((perm[a] * 10, perm[b] * 10) for a, b in e)
    cut = [(perm[a] * 10, perm[b] * 10) for a, b in e[:-1]] + [(perm[e[-1][0]] * 10, perm[(e[-1][1] + 1) % 14] * 10)]
    assert structure.isomorphism(d, spark.createDataFrame(cut, "src long, dst long")) is None
    # equal degrees, told apart only by trying: two triangles and a hexagon; and a graph with many symmetries
    ring = lambda *rings: spark.createDataFrame([(r[i], r[(i + 1) % len(r)]) for r in rings for i in range(len(r))], "src long, dst long")
    assert structure.isomorphism(ring([0, 1, 2], [3, 4, 5]), ring([0, 1, 2, 3, 4, 5])) is None
    assert structure.isomorphism(ring([0, 1, 2, 3, 4, 5]), ring([9, 7, 5, 3, 1, 0])) is not None
    with pytest.raises(RuntimeError):
        structure.isomorphism(ring([0, 1, 2], [3, 4, 5]), ring([0, 1, 2, 3, 4, 5]), tries=2)
    assert structure.isomorphism(d.limit(0), d.limit(0), spark.range(1), spark.range(1)).count() == 1


def test_isomorphism_pairs_nodes_that_can_be_swapped(spark):
    # a path of four nodes with two leaves each: four pairs, more than may be tried; the mapping that keeps the orders is taken
    e = [(i, i + 1) for i in range(3)] + [(i, 10 * (i + 1) + k) for i in range(4) for k in (0, 1)]
    d = spark.createDataFrame(e, "src long, dst long")
    minus = d.select((-F.col("src")).alias("src"), (-F.col("dst")).alias("dst"))
    nodes = sorted({v for x in e for v in x})
    assert pairs(structure.isomorphism(d, minus, tries=2, order_b=-F.col("id"))) == [(v, -v) for v in nodes]
    found = dict(pairs(structure.isomorphism(d, minus, tries=2)))
    assert sorted((found[a], found[b]) for a, b in e) == sorted((-a, -b) for a, b in e)


def test_cliques(spark):
    e, d = drawn(spark, 20, 90, 6)
    near = {v: set() for v in range(22)}
    for a, b in e:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    want = set()

    def grow(r, p, x):
        if not p and not x:
            want.add(tuple(sorted(r)))
        for v in list(p):
            grow(r | {v}, p & near[v], x & near[v])
            p, x = p - {v}, x | {v}

    grow(set(), set(near), set())
    assert sorted(map(tuple, (r["clique"] for r in structure.maximal_cliques(d, spark.range(22)).collect()))) == sorted(want)
    forty = spark.createDataFrame(list(itertools.combinations(range(40), 2)) + [(0, 50)], "src long, dst long")
    assert sorted(len(r["clique"]) for r in structure.maximal_cliques(forty, graph.Graph(forty).nodes).collect()) == [2, 40]
    assert structure.maximal_cliques(d.limit(0), spark.range(0)).count() == 0 and iterate.pagerank(d.limit(0), spark.range(0), 2).count() == 0


def metres(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * 6371000.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def test_places_against_all_distances(spark, tmp_path):
    rng = random.Random(3)
    at = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(400)] + [(500, 90.0, 0.0), (501, -90.0, 77.0), (502, 0.0, 180.0), (503, 0.0, -180.0), (504, 89.9, 179.9)]
    bad = [(600, None, 1.0), (601, float("nan"), 1.0), (602, 91.0, 0.0), (603, 0.0, 190.0)]
    x = spatial.SpatialIndex.build(spark.createDataFrame(at + bad, "id long, lat double, lon double"), str(tmp_path / "x"))
    asked = [(0.0, 180.0, 1.5e6), (0.0, -179.9, 1e5), (89.0, 10.0, 2e6), (-88.0, -120.0, 5e5), (48.0, 11.0, 3e6), (10.0, 10.0, 1.9e7), (0.0, 0.0, 2.1e7), (45.0, 170.0, 4e6), (30.0, 30.0, 0.0)]
    for lat, lon, r in asked:
        assert sorted(q["id"] for q in x.within(lat, lon, r).collect()) == sorted(i for i, a, b in at if metres(a, b, lat, lon) <= r)
    assert [q["id"] for q in x.nearest(-89.0, 0.0, 5).collect()] == [i for _, i in sorted((metres(a, b, -89.0, 0.0), i) for i, a, b in at)[:5]]
    assert x.nearest(0.0, 0.0, 1000).count() == len(at)
    centers = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(asked)] + [(77, None, 1.0)], "center long, lat double, lon double")
    for r in (3e5, 4e6):
        assert sorted((q["center"], q["id"]) for q in x.join(centers, r).collect()) == sorted((k, i) for k, (c, d, _) in enumerate(asked) for i, a, b in at if metres(a, b, c, d) <= r)
    y = spatial.refresh(x, spark.createDataFrame([(0, 1.0, 1.0)], "id long, lat double, lon double"))
    assert y.rows().count() == len(at) + len(bad) and 0 in {q["id"] for q in y.within(1.0, 1.0, 10.0).collect()}


def test_counts_around_centers_compare_places_once(spark, tmp_path, monkeypatch):
    """F4 of r04: rows at one place and centers at one place are one pair."""
    rng = random.Random(5)
    at = [(i, float(rng.randrange(-90, 91, 5)), float(rng.randrange(-180, 181, 12))) for i in range(600)] + [(700, None, 1.0), (701, float("nan"), 1.0), (702, 91.0, 0.0)]
    centers = [(k % 70, float(rng.randrange(-90, 91, 9)), float(rng.randrange(-180, 181, 12))) for k in range(80)] + [(90, 1.0, None), (91, 0.0, 181.0)]
    x = spatial.SpatialIndex.build(spark.createDataFrame(at, "id long, lat double, lon double"), str(tmp_path / "x"))
    c = spark.createDataFrame(centers, "center long, lat double, lon double")
    for r in (7e5, 5e6):
        want = {}
        for k, a, b in centers[:-2]:
            for _, lat, lon in at[:-3]:
                if (m := metres(lat, lon, a, b)) <= r:
                    n, far = want.get(k, (0, 0.0))
                    want[k] = n + 1, max(far, m)
        got = {q["center"]: (q["n"], q["farthest"]) for q in x.around(c, r).collect()}
        assert {k: n for k, (n, _) in got.items()} == {k: n for k, (n, _) in want.items()}
        assert all(got[k][1] == pytest.approx(far, abs=1e-3) for k, (_, far) in want.items())
    seen, near = [], spatial.SpatialIndex._near
    monkeypatch.setattr(spatial.SpatialIndex, "_near", staticmethod(lambda *a: seen.append(near(*a)) or seen[-1]))
    y = spatial.SpatialIndex.build(spark.range(300).selectExpr("id", "10D as lat", "20D as lon"), str(tmp_path / "y"))
    assert {(q["n"], q["farthest"]) for q in y.around(spark.range(200).selectExpr("id as center", "10D as lat", "20D as lon"), 1000.0).collect()} == {(300, 0.0)}
    assert seen[0].count() == 1


def test_stretches_reach_the_files(spark, tmp_path):
    x = spatial.SpatialIndex.build(spark.range(20_000).selectExpr("id", "(id * 37 % 18000) / 100D - 90 as lat", "(id * 91 % 36000) / 100D - 180 as lon"), str(tmp_path / "x"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    plan = x.within(10.0, 20.0, 50_000)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(cell_" in plan
    kept = x.rows().where(F.col("cell_").between(*spatial.cover(spatial.boxes(10.0, 20.0, 50_000))[0])).count()
    assert kept < 200


def test_two_sided_paths_and_orders(spark):
    rng = random.Random(11)
    e = [(rng.randrange(15), rng.randrange(15), float(rng.randint(1, 3))) for _ in range(40)]
    d = spark.createDataFrame(e, "src long, dst long, weight double")
    for goal in (3, 7, 14):
        want = [(r["cost"], r["path"]) for r in iterate.least_path(d, 0, goal).collect()]
        assert [(r["cost"], r["path"]) for r in iterate.bidirectional_path(d, 0, goal).collect()] == want
        assert [r["cost"] for r in iterate.bidirectional(d, 0, goal).collect()] == [c for c, _ in want]
    assert iterate.bidirectional_path(d.where("dst <> 14"), 0, 14).count() == 0
    dag = d.where("src < dst")
    order = {r["id"]: r["place"] for r in iterate.topo_sort(dag, spark.range(15)).collect()}
    assert sorted(order.values()) == list(range(1, 16)) and all(order[a] < order[b] for a, b, _ in e if a < b)
    with pytest.raises(ArithmeticError):
        iterate.topo_sort(d, spark.range(15))


def test_labels_take_nodes_out_in_few_rounds(spark, tmp_path, monkeypatch):
    """A graph of orders, customers and parts under one root: nearly all nodes go by whole layers, and no landmark is searched from one by one."""
    searched, rounds, plain, one = [], [], reach.two_hop_labels, reach._round
    monkeypatch.setattr(reach, "two_hop_labels", lambda *a: searched.append(1) or plain(*a))
    monkeypatch.setattr(reach, "_round", lambda *a: rounds.append(1) or one(*a))
    rng = random.Random(5)
    e = [("r", f"c{c}") for c in range(60)] + [(f"c{c}", f"o{c}-{o}") for c in range(60) for o in range(5)]
    e += [(f"o{c}-{o}", f"p{rng.randrange(40)}") for c in range(60) for o in range(5) for _ in range(3)]
    d = spark.createDataFrame(e, "src string, dst string")
    g = graph.Graph(d)
    x = reach.ReachabilityIndex.build(g.edges, g.nodes, str(tmp_path / "x"))
    assert not searched and len(rounds) <= 5
    names = sorted({v for p in e for v in p})
    far = hops(e, names)
    asked = [(a, b) for a in names if a[0] in "rc" for b in names if b[0] in "pr"]
    assert pairs(x.reaches(spark.createDataFrame(asked, "src string, dst string"))) == sorted((a, b, b in far[a]) for a, b in asked)


@pytest.mark.parametrize("seed, m", [(6, 60), (7, 200), (8, 250)])
def test_labels_of_a_core_against_search(spark, seed, m):
    """Acyclic graphs too dense to take all nodes out."""
    rng = random.Random(seed)
    e = sorted({tuple(sorted(rng.sample(range(30), 2))) for _ in range(m)})
    far = hops(e, range(30))
    out, into = (dict(tuple(r) for r in x.collect()) for x in reach.label_lists(spark.createDataFrame(e, "src long, dst long"), spark.range(31)))
    assert sorted(out) == sorted(into) == list(range(31))
    assert all(bool({*out[a]} & {*into[b]}) == (b in far[a]) for a in range(30) for b in range(30)) and out[30] == into[30] == [30]


@pytest.mark.parametrize("cycle", [False, True])
def test_eccentricity_rounds_write_what_can_change(spark, monkeypatch, cycle):
    """Layers, with or without a cycle at the top: sketches of nodes that are done are not written again, and edges that are double count once."""
    wrote, plain = [], reach.materialize
    monkeypatch.setattr(reach, "materialize", lambda d, tag="t": (lambda m: wrote.append((tag, m.count())) or m)(plain(d, tag)))
    e = [("r", f"c{c}") for c in range(10)] + [(f"c{c}", f"o{c}-{o}") for c in range(10) for o in range(5)] + [(f"o{c}-{o}", f"p{(c + o) % 7}") for c in range(10) for o in range(5)]
    e += e[:20] + [("p0", "p0")] + ([("c0", "r")] if cycle else [])
    d = spark.createDataFrame(e, "src string, dst string")
    g = graph.Graph(d)
    names = sorted({v for p in e for v in p})
    far = hops(set(e), names)
    got = {r["id"]: (r["eccentricity"], r["reached"]) for r in reach.eccentricities(g.edges, g.nodes).collect()}
    assert got == {v: (max(x.values()), len(x)) for v, x in far.items()}
    sizes = [n for tag, n in wrote if tag == "sketch"]
    assert sizes[0] == 61 and max(sizes[1:]) == 11
