"""Graph operators against golden values and brute force."""

from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from motifloom.functions import atlas, equations
from motifloom.operators import blocks, estimate, experiments, four, frames, graph, lists, orbits, sets, walks
from motifloom.operators.components import components
from motifloom.operators.graph import Graph
from motifloom.sources import edges, truth

CYCLE = [(i, (i + 1) % 6) for i in range(6)]
TINY_GRAPHS = {
    "K6": (list(combinations(range(6), 2)), [0, 20], [0, 0, 0, 0, 0, 15], {20: 6}, 1.0),
    "C6": (CYCLE, [6, 0], [6, 0, 0, 0, 0, 0], {0: 6}, 0.0),
    "star": ([(0, i) for i in range(1, 7)], [15, 0], [0, 20, 0, 0, 0, 0], {2: 15}, 0.0),
    "wheel": ([(0, i) for i in range(1, 6)] + [(i, i % 5 + 1) for i in range(1, 6)], [10, 5], [5, 0, 0, 5, 5, 0], {6: 1, 15: 5}, 0.638888889),
    "K33": ([(a, b) for a in range(3) for b in range(3, 6)], [18, 0], [0, 6, 9, 0, 0, 0], {11: 6}, 0.0),
    "Petersen": (
        [(i, (i + 1) % 5) for i in range(5)] + [(i, i + 5) for i in range(5)] + [(5 + i, 5 + (i + 2) % 5) for i in range(5)],
        [30, 0], [60, 10, 0, 0, 0, 0], {0: 60, 1: 60, 6: 12}, 0.0,
    ),
    "grid": (
        [(r * 3 + c, r * 3 + c + 1) for r in range(3) for c in range(2)] + [(r * 3 + c, r * 3 + c + 3) for r in range(2) for c in range(3)],
        [22, 0], [24, 8, 4, 0, 0, 0], {0: 20, 1: 12, 2: 1, 7: 16}, 0.0,
    ),
}


def frame(spark, pairs):
    return spark.createDataFrame([tuple(map(int, p)) for p in pairs], "src long, dst long")


def vector(df, size):
    got = {r["type"]: r["cnt"] for r in df.collect()}
    return [got.get(i, 0) for i in range(size)]


@pytest.mark.parametrize("name", TINY_GRAPHS)
def test_tiny_graphs(spark, name):
    pairs, three, four_, five, clustering = TINY_GRAPHS[name]
    g = Graph.from_raw(frame(spark, pairs))
    assert vector(graph.line_triangle(g, g.triangles), 2) == three
    assert vector(graph.line_triangle(g, g.triangles_naive), 2) == three
    assert vector(four.graphlet4(g), 6) == four_
    typed = sets.with_type(sets.connected_sets(g, 5), 5)
    assert {i: n for i, n in enumerate(vector(sets.counts(typed, 5), 21)) if n} == five
    assert vector(sets.totals(sets.orbits(typed, 5), 5), 21) == [five.get(i, 0) for i in range(21)]
    assert graph.global_clustering(g).first()["avg_clustering"] == clustering
    assert all(r.lhs == r.rhs for r in four.identities(g, four.graphlet4(g)).collect())


def test_edge_list_text(spark, tmp_path):
    path = tmp_path / "g.txt"
    path.write_text("8 9\n0 1 5\n1 0 5\n1 2 1\n2 0 1\n2 3 7\n3 3 1\n4 5 1\n4 5 2\n6 6 1\n# note\n-1 2\n9 1\n\n")
    raw = edges.read_edge_list(spark, str(path))
    stats = graph.scan_stats(raw).first()
    assert (stats.n_raw, stats.loops, stats.n_kept, stats.n_edges) == (9, 2, 7, 5)
    simple = graph.simple(raw)
    sizes = {r.comp_id: (r.n_nodes, r.n_edges) for r in graph.component_sizes(simple).collect()}
    assert sizes == {0: (4, 4), 4: (2, 1)}
    g = Graph.from_raw(raw)
    assert sorted(map(tuple, g.edge.collect())) == [(0, 1), (0, 2), (1, 2), (2, 3)]
    assert vector(graph.line_triangle(g, g.triangles), 2) == [2, 1]
    assert vector(four.graphlet4(g), 6) == [0, 0, 0, 1, 0, 0]


def test_empty_graph(spark):
    g = Graph.from_raw(frame(spark, []))
    assert g.size == (0, 0)
    assert vector(graph.line_triangle(g, g.triangles), 2) == [0, 0]
    assert vector(four.graphlet4(g), 6) == [0] * 6
    assert graph.global_clustering(g).first()["avg_clustering"] is None


def test_empty_edge_list_file(spark, tmp_path):
    path = tmp_path / "none.txt"
    path.write_text("")
    assert edges.read_edge_list(spark, str(path)).count() == 0
    path.write_text("nodes and edges\n")
    with pytest.raises(ValueError):
        edges.read_edge_list(spark, str(path))


def test_atlas_rules():
    assert [g["beta"] for g in atlas.graphlets(4)] == [2, 3, 4, 5, 8, 12]
    assert [g["walk_div"] for g in atlas.graphlets(4)] == [1, 3, 6, 3, 6, 6]
    assert len(atlas.orbits(4)) == 11 and len(atlas.orbits(5)) == 58
    assert [o["orbit"] for o in atlas.orbits(5)] == list(range(15, 73))
    for k in (3, 4, 5):
        assert len(atlas.type_numbers(k)) == len(atlas.TYPES[k])


def brute_types(n, pairs, k):
    es = frozenset((min(p), max(p)) for p in pairs)
    out = [0] * len(atlas.TYPES[k])
    for s in combinations(range(n), k):
        inner = atlas.induced(s, es)
        if atlas.connected(s, inner):
            names = {v: i for i, v in enumerate(s)}
            out[atlas.type_of(range(k), frozenset((names[a], names[b]) for a, b in inner))] += 1
    return out


@settings(max_examples=4, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 7), st.integers(0, 7)).filter(lambda p: p[0] < p[1]), min_size=6, max_size=16))
def test_random_graphs(spark, pairs):
    full = pairs | {(i, i + 1) for i in range(7)}  # connected
    g = Graph.from_raw(frame(spark, full))
    for k in (4, 5):
        expected = brute_types(8, full, k)
        assert vector(sets.counts(sets.with_type(sets.connected_sets(g, k), k), k), len(expected)) == expected
        rows = {r["type"]: (r.basic, r.improved) for r in estimate.twin(g, k).collect()}
        assert [rows[i][0] for i in range(len(expected))] == expected
        assert [rows[i][1] for i in range(len(expected))] == expected
    assert vector(four.graphlet4(g), 6) == brute_types(8, full, 4)


def brute_orbits(n, pairs):
    """Counts by (node, orbit), over all sets of three to five nodes."""
    es = frozenset((min(p), max(p)) for p in pairs)
    number = {(k, r["type"], r["node_key"]): r["orbit"] for k in (3, 4, 5) for r in atlas.orbits(k)}
    out = {(v, 0): sum(v in e for e in es) for v in range(n)}
    for k in (3, 4, 5):
        for s in combinations(range(n), k):
            inner = atlas.induced(s, es)
            if atlas.connected(s, inner):
                place = {v: i for i, v in enumerate(s)}
                kind = atlas.type_of(range(k), frozenset((place[a], place[b]) for a, b in inner))
                for v, key in atlas.node_keys(s, inner).items():
                    o = number[k, kind, key[0] * 100 + key[1]]
                    out[v, o] = out.get((v, o), 0) + 1
    return out


@pytest.mark.parametrize("n, m, seed", [(9, 14, 1), (9, 26, 2), (7, 21, 3), (12, 22, 4)])
def test_orbits_by_equations(spark, n, m, seed):
    """Sparse, dense and complete graphs."""
    pairs = sorted(combinations(range(n), 2))
    np.random.default_rng(seed).shuffle(pairs)
    pairs = {tuple(map(int, p)) for p in pairs[:m]} | {(i, i + 1) for i in range(n - 1)}
    g = Graph.from_raw(frame(spark, pairs))
    expected = brute_orbits(n, pairs)
    assert {(r.node, r.orbit): r.cnt for r in orbits.node_orbits(g, 5).collect()} == expected
    assert {(r.node, r.orbit): r.cnt for r in orbits.node_orbits(g, 4).collect()} == {x: c for x, c in expected.items() if x[1] < 15}


def test_atlas_of_five():
    """Fixed values of the five-node types: half the walks that see them, pairs of connected parts, central nodes."""
    five = atlas.graphlets(5)
    assert [g["beta"] for g in five] == [2, 2, 0, 5, 4, 4, 5, 6, 10, 8, 10, 12, 10, 18, 18, 17, 18, 28, 28, 42, 60]
    assert [g["walk_div"] for g in five] == [c * (c - 1) // 2 for c in (2, 3, 4, 3, 3, 4, 5, 4, 4, 4, 4, 5, 5, 5, 4, 5, 5, 5, 5, 5, 5)]
    assert [g["phi"] for g in five] == [0, 0, 1, 0, 0, 1, 0, 0, 1, 1, 0, 0, 0, 2, 1, 1, 0, 2, 1, 3, 5]
    keys = {r["orbit"]: (r["type"], r["node_key"]) for r in atlas.orbits(5)}
    assert [keys[o] for o in (15, 17, 23, 30, 44, 48, 55, 64, 69, 72)] == [(0, 102), (0, 204), (2, 404), (4, 306), (9, 408), (10, 308), (13, 410), (16, 309), (18, 412), (20, 416)]
    edges = [len(atlas.example(5, g["type"])) for g in five]
    for row in equations.solution(5):  # an orbit's count follows from sums of at least as many edges
        kind = {r["orbit"]: r["type"] for r in atlas.orbits(5)}
        assert row["sum"] == row["orbit"] or edges[kind[row["sum"]]] > edges[kind[row["orbit"]]]


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (300, 300), (101, 100)]
    got = dict(map(tuple, components(frame(spark, chain).toDF("u", "v")).collect()))
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 300: 300}
    hub = [(0, i) for i in range(1, 200)] + [(500, i) for i in range(600, 620)]
    got = dict(map(tuple, components(frame(spark, hub).toDF("u", "v")).collect()))
    assert {got[i] for i in range(200)} == {0} and {got[i] for i in range(600, 620)} == {500}
    named = spark.createDataFrame([("b", "c"), ("c", "a"), (None, "z")], "u string, v string")
    assert dict(map(tuple, components(named).collect())) == {"a": "a", "b": "a", "c": "a"}


def test_dense_ids(spark):
    rng = np.random.default_rng(5)
    values = sorted({int(v) for v in rng.integers(-(2**40), 2**40, 3000)})
    df = spark.createDataFrame([(v,) for v in values], "node long").repartition(7)
    got = {r.node: r.id for r in graph.dense_ids(df).collect()}
    assert got == {v: i for i, v in enumerate(values)}


def test_walks_agree(spark):
    g = Graph.from_raw(frame(spark, TINY_GRAPHS["wheel"][0]))
    by_arrays = sorted(map(tuple, walks.walk(g.adj, 6, 5).collect()))
    assert by_arrays == sorted(map(tuple, walks.walk_by_joins(g.adj, 6, 5).collect()))
    linked = {(r.u, r.v) for r in g.adj.collect()}
    assert all((a[2], b[2]) in linked for a, b in zip(by_arrays, by_arrays[1:], strict=False) if a[0] == b[0])
    with pytest.raises(ValueError):
        walks.walk(g.adj, 6, 5, least_degree=99)


@pytest.mark.parametrize("k", [3, 4, 5])
def test_state_walks_agree(spark, k):
    """By arrays and by joins; each move is one between neighbours, of the type that the union of both has."""
    g = Graph.from_raw(frame(spark, TINY_GRAPHS["grid"][0] + [(0, 4), (1, 3), (4, 8)]))
    by_arrays = {(r.sim, r.step): (tuple(r.nodes), r.type) for r in walks.state_walk(g.adj, k, 2, 3).collect()}
    assert by_arrays == {(r.sim, r.step): (tuple(r.nodes), r.type) for r in walks.state_walk_by_joins(g.adj, k, 2, 3).collect()}
    assert len(by_arrays) == 9
    kinds = {tuple(r.nodes): r.type for r in sets.with_type(sets.connected_sets(g, k), k).collect()}
    for (sim, step), (nodes, kind) in by_arrays.items():
        if step:
            union = tuple(sorted({*nodes, *by_arrays[sim, step - 1][0]}))
            assert len(union) == k and kinds[union] == kind
    named = graph.ranked(sets.connected_sets(g, k - 1).select("nodes"), "nodes")
    pairs = sets.state_pairs(named, sets.with_type(sets.connected_sets(g, k), k))
    moves = {(tuple(r.s), tuple(r.t)) for r in pairs.collect()}
    long = {(r.sim, r.step): tuple(r.nodes) for r in walks.state_walk(g.adj, k, 4000, 8).collect()}
    taken = Counter((long[sim, step - 1], t) for (sim, step), t in long.items() if step)
    assert set(taken) == moves  # all neighbours are reached, nothing else is
    # Neighbours of a state are equally likely, so all moves are.
    expected = 8 * 4000 / len(moves)
    assert sum((taken[m] - expected) ** 2 for m in moves) / expected / len(moves) < 3
    with pytest.raises(ValueError):
        walks.state_walk(Graph.from_raw(frame(spark, [(0, 1)])).adj, k, 3, 1)


def test_state_walk_shares_are_near(spark):
    g = Graph.from_raw(edges.shipped_together(spark, "/root/testdata/sf0.001"))
    for k in (4,):
        metrics, seconds = experiments.compare_walks(g, k, experiments.exact(g, k), 1500, 16)
        rows = {(r.variant, r["type"]): r for r in metrics.collect()}
        assert set(seconds) == {"Basic", "PSRW"} and min(seconds.values()) > 0
        assert rows["PSRW", 0].RE < 0.2 and rows["Basic", 0].RE < 0.2


def test_experiment_program(spark, tmp_path, capsys, monkeypatch):
    path = tmp_path / "g.txt"
    pairs = TINY_GRAPHS["wheel"][0]
    path.write_text(f"6 {len(pairs)}\n" + "".join(f"{a} {b}\n" for a, b in pairs))
    monkeypatch.setattr(experiments, "SWEEP", (20,))
    monkeypatch.setattr(experiments, "COMPARED", 20)
    experiments.main([str(path), "4", "3"])
    out = capsys.readouterr().out
    assert "NRMSE      SRWIMPR = " in out and "seconds a run" in out
    assert experiments.vector_line([0.25, None, 1234567.0]) == "      0.25\t         -\t1.23457e+06\t"
    with pytest.raises(SystemExit):
        experiments.main(["g"])


def test_edge_list_sink(spark, tmp_path):
    raw = frame(spark, [(0, 1), (1, 0), (2, 2), (1, 2)])
    edges.write_edge_list(raw, 3, f"{tmp_path}/g")
    back = edges.read_edge_list(spark, f"{tmp_path}/g/edges", f"{tmp_path}/g/header")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, raw.collect()))


def test_estimates_are_near(spark):
    g = Graph.from_raw(edges.co_purchase(spark, "/root/testdata/sf0.001", 40))
    est = estimate.estimate(g, walks.walk(g.adj, 2001, 30), 3).withColumn("steps", F.lit(2000))
    rows = estimate.error_metrics(est, graph.line_triangle(g, g.triangles)).collect()
    assert len(rows) == 4
    for r in rows:
        assert r.NRMSE < (0.06 if r["type"] == 1 else 0.03)
        assert r.LB <= r.RV <= r.UB


def test_truth_files(spark, tmp_path):
    path = tmp_path / "truth.txt"
    path.write_text("/a/one.txt\t 5\t 2\t\n\\b\\two.txt\t 1\t 0\t\n/c/one.txt\t 9\t 9\t\n")
    known = truth.read_truth(spark, str(path))
    assert [tuple(r) for r in truth.lookup(known, "x/one.txt").orderBy("type").collect()] == [("one.txt", 0, 5), ("one.txt", 1, 2)]
    asked = spark.createDataFrame([("x/one.txt",), ("y\\\\one.txt",), ("none.txt",), (None,)], "path string")
    assert sorted(map(tuple, truth.lookup_all(known, asked).collect())) == [("one.txt", 0, 5), ("one.txt", 1, 2)]
    assert truth.lookup_all(known.where("false"), asked).count() == 0
    out = str(tmp_path / "t")
    for n in (3, 4):
        truth.write_truth(spark.createDataFrame([(0, n)], "type int, cnt long"), "g", 3, out)
    truth.write_truth(spark.createDataFrame([(0, 8)], "type int, cnt long"), "h", 3, out)
    assert sorted((r.graph, r.cnt) for r in spark.read.parquet(out).collect()) == [("g", 4), ("h", 8)]
    metric = spark.createDataFrame([("SRW", 10, 0, 1.0, 0.1, 0.5, 1.5, 0.2)], "variant string, steps int, type int, RV double, RE double, LB double, UB double, NRMSE double")
    log = str(tmp_path / "log")
    truth.append_metrics(metric, "g", 3, log)
    truth.append_metrics(metric, "g", 3, log)
    assert spark.read.parquet(log).count() == 10


def test_unknown_sizes(spark):
    g = Graph.from_raw(frame(spark, CYCLE))
    with pytest.raises(ValueError):
        estimate.estimate(g, walks.walk(g.adj, 4, 2), 6)
    with pytest.raises(ValueError):
        sets.connected_sets(g, 1)


@pytest.mark.parametrize("k", [None, 5])
def test_walks_bring_no_adjacency_to_the_driver(spark, monkeypatch, k):
    """Neighbour lists are read by the tasks, which may forget and read them again."""
    pairs = [(i, (i * 7 + j) % 400) for i in range(400) for j in (1, 3, 11) if i != (i * 7 + j) % 400]
    g = Graph.from_raw(frame(spark, pairs))
    run = lambda: sorted(map(tuple, (walks.walk(g.adj, 30, 6) if k is None else walks.state_walk(g.adj, k, 30, 6)).collect()))
    with monkeypatch.context() as m:
        m.setattr(type(g.adj), "toPandas", lambda self: pytest.fail("the graph went to the driver"))
        m.setattr(spark.sparkContext, "broadcast", lambda *a: pytest.fail("the graph was broadcast"))
        m.setattr(walks, "GROUP_BYTES", 1)
        m.setattr(walks, "HELD", 50)
        got = run()
    assert got == run()
    assert len(got) == 6 * (30 if k is None else 31)
    if k is None:  # replayed
        near = {}
        for u, v in sorted(map(tuple, g.adj.collect())):
            near.setdefault(u, []).append(v)
        for sim in range(6):
            state = 1 + (sim * 7919 + 42) % (walks.MODULUS - 1)
            for _ in range(walks.SKIPPED + 1):
                state = state * walks.MULTIPLIER % walks.MODULUS
            node, path = sorted(near)[state % len(near)], []
            for step in range(30):
                path.append((sim, step, node))
                state = state * walks.MULTIPLIER % walks.MODULUS
                node = near[node][state % len(near[node])]
            assert path == got[sim * 30 : sim * 30 + 30]


def test_components_by_sides_first(spark, monkeypatch):
    """Dense graphs whose least and greatest neighbours don't link all that belongs together."""
    from motifloom.operators import components as cc

    first = [(i, j) for i in range(0, 60, 2) for j in range(i + 2, 60, 2)]
    second = [(i, j) for i in range(1, 61, 2) for j in range(i + 2, 61, 2)]
    joined = [(100 + a, 100 + b) for a, b in [*first, *second]] + [(120, 131)]
    pairs = [*first, *second, *joined, (500, 501)]
    rounds = []
    real = cc._rooted
    monkeypatch.setattr(cc, "_rooted", lambda rows: rounds.append(rows.count()) or real(rows))
    got = dict(map(tuple, cc.components(frame(spark, pairs).toDF("u", "v")).collect()))
    assert got == {**dict.fromkeys(range(0, 60, 2), 0), **dict.fromkeys(range(1, 61, 2), 1), **dict.fromkeys(range(100, 160), 100), 500: 500, 501: 500}
    assert len(rounds) == 2 and rounds[0] < len(pairs) / 4 and rounds[1] == 1


def test_stars_take_no_round(spark, monkeypatch):
    """Links to the least of each group, either way round, are components as they are; others end without a round that changes nothing."""
    from motifloom.operators import components as cc

    rounds, real = [], cc._large_star
    monkeypatch.setattr(cc, "_large_star", lambda e: rounds.append(1) or real(e))
    stars = [(i, 0) for i in range(1, 9)] + [(10, i) for i in range(11, 14)] + [(20, 20)]
    for extra, expected, n in (([], {}, 0), ([(8, 13)], dict.fromkeys(range(10, 14), 0), 1)):
        rounds.clear()
        got = dict(map(tuple, cc.components(frame(spark, stars + extra).toDF("u", "v")).collect()))
        assert got == {**dict.fromkeys(range(9), 0), **dict.fromkeys(range(10, 14), 10), 20: 20, **expected}
        assert len(rounds) == 0 if not n else 1 <= len(rounds) <= 2


def test_edges_of_a_graph_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(len(b))
            yield b

    raw = frame(spark, CYCLE + [(7, 8)]).mapInPandas(count, "src long, dst long")
    assert Graph.from_raw(raw).edge.count() == 6
    assert made.value == 7


@pytest.mark.parametrize("k", [3, 4, 5])
def test_sets_are_made_once(spark, k):
    """Each set once, without a shuffle that tells sets apart; numbered pairs of states are those of joined unions."""
    hub = [(0, i) for i in range(1, 9)] + [(1, 2), (2, 3), (3, 1), (4, 9), (9, 10), (10, 5), (7, 8)]
    g = Graph.from_raw(frame(spark, hub))
    whole = sets.connected_sets(g, k)
    assert "hashpartitioning(nodes" not in whole._jdf.queryExecution().executedPlan().toString()
    got = [tuple(r.nodes) for r in whole.collect()]
    assert len(got) == len(set(got)) == sum(brute_types(11, hub, k))
    assert all(list(n) == sorted(n) for n in got)
    named = graph.ranked(sets.connected_sets(g, k - 1), "nodes")
    place = {tuple(r.nodes): r.id for r in named.collect()}
    joined = sets.state_pairs(named.select("nodes", "id"), sets.with_type(whole, k)).collect()
    assert sorted((place[tuple(r.s)], place[tuple(r.t)], r.type) for r in joined) == sorted(map(tuple, sets.numbered_state_pairs(named, g, k).collect()))


def test_common_neighbours_by_blocks(spark, monkeypatch):
    """By pairs of blocks all is as by joins, and no wedges are joined."""
    monkeypatch.setattr(blocks, "ENTRIES", 80)
    rng = np.random.default_rng(5)
    pairs = [(a, b) for a, b in combinations(range(30), 2) if rng.random() < 0.3] + [(0, i) for i in range(1, 50)] + [(49, 50)]
    joined = Graph.from_raw(frame(spark, pairs))
    ours = Graph(joined.edge, by_blocks=True)
    assert "Join" not in ours.support._jdf.queryExecution().executedPlan().toString()
    for what in ("support", "triangles", "node_triangles", "pairs_of_paths"):
        assert sorted(map(tuple, getattr(ours, what).collect())) == sorted(map(tuple, getattr(joined, what).collect())), what
    assert graph.line_triangle(Graph(joined.edge.limit(0), by_blocks=True)).collect()[1].cnt == 0


def test_no_table_of_nodes_is_broadcast(spark):
    """Degrees, ids and edges are small on disk at sizes where they fill a driver; joins don't send them through it."""
    pairs = spark.createDataFrame(TINY_GRAPHS["grid"][0], "u long, v long")
    g = Graph(pairs)
    for made in (g.with_degrees, g.clustering, g.triangles, estimate.visited(g, pairs.toDF("sim", "node"))):
        assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_groups_take_no_join(spark):
    rows = spark.createDataFrame([(1, 5), (1, 7), (1, 5), (1, 6), (2, 5), (2, 5), (None, 1), (3, None), (3, 8), (3, 9)], "g long, m long")
    pairs = edges.from_pairs(rows, "g", "m")
    assert sorted(map(tuple, pairs.collect())) == [(5, 6), (5, 7), (6, 7), (8, 9)]
    shipped = edges.shipped_together(spark, "/root/testdata/sf0.001")
    for df in (pairs, shipped):
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_dense_edges_of_one_component_are_not_joined_to_roots(spark, monkeypatch):
    from motifloom.operators import components as cc

    joined, real = [], cc._joined
    monkeypatch.setattr(cc, "_joined", lambda *a: joined.append(1) or real(*a))
    for apart, expected in ((0, []), (100, [1])):
        pairs = [(a + apart * b, c + apart * b) for b in (0, 1) for a in range(30) for c in range(a + 1, 30)]
        of = {r.node: r.component for r in cc.components(frame(spark, pairs).toDF("u", "v")).collect()}
        assert of == {n + apart * b: apart * b for b in (0, 1) for n in range(30)} and joined == expected


def test_common_neighbours_of_blocks_that_tasks_read(spark, monkeypatch):
    """Nothing is sent for them, and all is as by joins, and as by pairs of blocks where tasks can't open the shared folder."""
    monkeypatch.setattr(lists, "GROUP_BYTES", 1 << 10)
    monkeypatch.setattr(blocks, "HELD", 500)
    rng = np.random.default_rng(5)
    pairs = [(a, b) for a, b in combinations(range(400), 2) if rng.random() < 0.05] + [(0, i) for i in range(1, 401)]
    joined = Graph.from_raw(frame(spark, pairs))
    read, sent = Graph(joined.edge, by_blocks=True), Graph(joined.edge, by_blocks=True)
    sent.__dict__["lists"] = None
    assert len(read.lists.runs(500)) > 3 and read.by_lists and not sent.by_lists
    for what in ("support", "triangles", "pairs_of_paths"):
        assert sorted(map(tuple, getattr(read, what).collect())) == sorted(map(tuple, getattr(joined, what).collect())) == sorted(map(tuple, getattr(sent, what).collect())), what
    assert "Exchange" not in read.support._jdf.queryExecution().executedPlan().toString()
    for f in (four.graphlet4, graph.line_triangle, graph.global_clustering):
        assert f(read).collect() == f(joined).collect() == f(sent).collect()
    assert [r.cnt for r in four.graphlet4(Graph(joined.edge.limit(0), by_blocks=True)).collect()] == [0] * 6


@pytest.mark.parametrize("k", [4, 5])
def test_all_frames_are_observed_where_they_are_listed(spark, monkeypatch, k):
    """No frame is sent, and all is as by joins, which are left for folders that tasks can't open."""
    g = Graph.from_raw(frame(spark, [*TINY_GRAPHS["grid"][0], *((0, 100 + i) for i in range(9)), (100, 101), (100, 1)]))
    joined = Graph(g.edge)
    joined.__dict__["lists"] = None
    want = sorted(map(tuple, estimate.twin(joined, k).collect()))
    monkeypatch.setattr(estimate, "all_frames", None)
    assert sorted(map(tuple, estimate.twin(g, k).collect())) == want and sum(r[1] for r in want) > 0


def test_frames_in_parts(monkeypatch):
    rng = np.random.default_rng(7)
    link = np.triu(rng.random((20, 20)) < 0.3, 1)
    link |= link.T
    made = frames._Frames(np.concatenate(([0], np.cumsum(link.sum(1)))), np.nonzero(link)[1].astype(np.int32), 5)
    add = lambda: [Counter({tuple(map(int, r[:-1])): int(r[-1]) for r in zip(*rows, strict=True)}) for rows in made.observed(np.arange(20))]
    whole = sum(add(), Counter())
    monkeypatch.setattr(lists, "AT_ONCE", 64)
    parts = add()
    assert len(parts) > 20 and sum(parts, Counter()) == whole
