"""The registered graph queries: one for each operator.

The graph: parts of one order that ship within ``DAYS`` days of one another,
from all lines of all orders. Queries named ``copurchase_`` take the whole
co-purchase graph, which is too dense to enumerate sets of four nodes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifloom.functions import atlas
from motifloom.operators import cuts, estimate, experiments, four, graph, sets, walks
from motifloom.operators.graph import Graph
from motifloom.session import Stored, let_workers_import, shared_dir, store
from motifloom.sources import edges, truth

Query = Callable[[SparkSession, str], DataFrame]

DAYS = 30
#: Simulations and frames of the estimation queries, and the walks' seed.
SIMS, STEPS, SEED = 100, 200, 42
#: The published protocol of walks on states, less its longest runs.
PROTOCOL = (1000, 2000)
#: Steps of the two runs of the sweep.
SWEEP = (100, 250)

_kept: dict[tuple, object] = {}


def _once(spark: SparkSession, sf_dir: str, what: str, make: Callable[[], object]):
    """Prepared tables are kept for the session: queries on one graph share them."""
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    let_workers_import(spark)
    return edges.shipped_together(spark, sf_dir, DAYS)


def prepared(spark: SparkSession, sf_dir: str) -> Graph:
    return _once(spark, sf_dir, "graph", lambda: Graph.from_raw(raw(spark, sf_dir)))


def dense(spark: SparkSession, sf_dir: str) -> Graph:
    """The whole co-purchase graph."""
    return _once(spark, sf_dir, "dense", lambda: Graph.from_raw(edges.co_purchase(spark, sf_dir), by_blocks=True))


def orbit_counts(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    g = prepared(spark, sf_dir)
    return _once(spark, sf_dir, f"orbits{k}", lambda: cuts.node_orbits(g, k))


def dense_orbits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orbits of the whole co-purchase graph, which has too many sets of four nodes to list."""
    return _once(spark, sf_dir, "dense-orbits", lambda: cuts.node_orbits(dense(spark, sf_dir), 5))


def typed(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """Connected sets with their types; they are made as they are read and not stored, as those of five nodes are many times the graph."""
    return sets.with_type(sets.connected_sets(prepared(spark, sf_dir), k), k)


def trail(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """The walk of an estimation query: enough nodes for ``STEPS`` frames of k-1."""
    g = prepared(spark, sf_dir)
    return walks.walk(g.adj, STEPS + k - 2, SIMS, SEED, 2 if k == 5 else 1)


def states(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """``(u, v, type)`` between the states for size k, which are numbered in the order of their nodes."""
    g = prepared(spark, sf_dir)
    named = _once(spark, sf_dir, f"states{k}", lambda: store(graph.ranked(sets.connected_sets(g, k - 1), "nodes"), "states"))
    return sets.numbered_state_pairs(named.read(), g, k)


def psrw(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    path = store(walks.state_walk(prepared(spark, sf_dir).adj, k, STEPS, SIMS, SEED), "psrw").read()
    return estimate.state_walk_shares(path, k)


def dense_psrw(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """Shares of the whole co-purchase graph's types, from 1,000 walks of 2,000 moves."""
    sims, steps = PROTOCOL
    path = store(walks.state_walk(dense(spark, sf_dir).adj, k, steps, sims, SEED), "psrw").read()
    return estimate.state_walk_shares(path, k)


def state_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states that four-node walks visit, as text, with the type of each move."""
    path = walks.state_walk(prepared(spark, sf_dir).adj, 5, STEPS, SIMS, SEED)
    return path.select("sim", "step", F.array_join(F.transform("nodes", lambda n: n.cast("string")), ",").alias("nodes"), "type")


def text_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a scan of the graph as edge-list text finds; the text holds both directions, loops and lines that are no edges."""
    raw_ = raw(spark, sf_dir)
    n = raw_.agg(F.max("dst")).first()[0] or 0
    lines = raw_.union(raw_.select("dst", "src")).union(raw_.select("src", F.col("src").alias("dst"))).union(raw_.select(F.lit(-1).alias("src"), "dst"))
    held = Stored(spark, f"{shared_dir(spark)}/motifloom-text-{uuid.uuid4().hex}")
    edges.write_edge_list(lines, n + 1, held.path)
    return graph.scan_stats(edges.read_edge_list(spark, f"{held.path}/edges", f"{held.path}/header"))


def exact_counts(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    g = prepared(spark, sf_dir)
    if k == 3:
        return graph.line_triangle(g, g.triangles)
    return four.graphlet4(g) if k == 4 else sets.totals(orbit_counts(spark, sf_dir, 5), 5)


def truth_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact counts of all sizes, written and read back; a size that is written again is replaced."""
    held = Stored(spark, f"{shared_dir(spark)}/motifloom-truth-{uuid.uuid4().hex}")
    for k in (3, 3, 4, 5):
        truth.write_truth(exact_counts(spark, sf_dir, k), "shipped", k, held.path)
    return held.read().select("graph", "k", "type", "cnt")


def metric_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error metrics, written and read back."""
    held = Stored(spark, f"{shared_dir(spark)}/motifloom-log-{uuid.uuid4().hex}")
    truth.append_metrics(metrics(spark, sf_dir), "shipped", 3, held.path)
    return held.read().select("graph", "k", "metric", "variant", "steps", "type", "value")


def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.count_errors(prepared(spark, sf_dir), 3, exact_counts(spark, sf_dir, 3), SWEEP, SIMS, SEED)


def unit_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NRMSE of estimates in units of their truth."""
    est = estimate.estimate(prepared(spark, sf_dir), trail(spark, sf_dir, 3), 3)
    return estimate.nrmse(estimate.relative(est, exact_counts(spark, sf_dir, 3)))


def constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The constants of each type beside the number of its sets in the graph."""
    rows = atlas.constants()
    found = [exact_counts(spark, sf_dir, k).select(F.lit(k).alias("k"), "type", "cnt") for k in (3, 4, 5)]
    sizes = found[0].union(found[1]).union(found[2])
    return atlas.table(spark, rows, list(rows[0])).join(sizes, ["k", "type"], "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = prepared(spark, sf_dir)
    est = estimate.estimate(g, trail(spark, sf_dir, 3), 3).withColumn("steps", F.lit(STEPS).cast("long"))
    return estimate.error_metrics(est, graph.line_triangle(g, g.triangles))


def concentration_metrics(spark: SparkSession, sf_dir: str, k: int = 4) -> DataFrame:
    """The node walk's improved shares and the state walk's, against the exact ones."""
    g = prepared(spark, sf_dir)
    ours = estimate.concentration(estimate.estimate(g, trail(spark, sf_dir, k), k), "SRWIMPR").select(F.lit("Basic").alias("variant"), "type", F.col("value").alias("estimate"))
    base = psrw(spark, sf_dir, k).select(F.lit("PSRW").alias("variant"), "type", F.col("value").alias("estimate"))
    exact = sets.frequencies(sets.counts(typed(spark, sf_dir, k), k)).select("type", F.col("freq").alias("cnt"))
    return estimate.error_metrics(ours.union(base), exact, by=("variant",))


def truth_lines(g: Graph) -> DataFrame:
    """``(line_no, line)``: each node's open wedges and triangles as truth of a file named after it, then a stale line of zeros, and empty lines."""
    t = F.coalesce("t", F.lit(0))
    wedges = F.expr("d * (d - 1) div 2") - t
    lines = F.array(F.concat(F.lit("C:\\data\\"), "u", F.lit(".txt\t "), wedges, F.lit("\t "), t, F.lit("\t")), F.concat(F.lit("old/"), "u", F.lit(".txt\t 0\t 0\t")), F.lit(""))
    both = g.degree.join(g.node_triangles.hint("merge"), "u", "left")
    return both.select("u", F.posexplode(lines).alias("i", "line")).select((F.col("u") * 3 + F.col("i")).alias("line_no"), "line")


def truth_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The truth of each node's file, asked for by a path with the other kind of slash."""
    g = prepared(spark, sf_dir)
    asked = g.degree.select(F.concat(F.lit("/x/"), "u", F.lit(".txt")).alias("path"))
    return truth.lookup_all(truth.parse_truth(truth_lines(g)), asked).select("graph", F.lit(3).alias("k"), "type", "cnt")


def _on_graph(f: Callable[[Graph], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(prepared(spark, sf_dir))


def _on_sets(k: int, f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(typed(spark, sf_dir, k))


QUERIES: dict[str, Query] = {
    "edge_list": lambda s, d: graph.simple(raw(s, d)),
    "scan_stats": lambda s, d: graph.scan_stats(raw(s, d).union(raw(s, d).select("dst", "src")).union(raw(s, d).select("src", F.col("src").alias("dst")))),
    "components": lambda s, d: graph.component_sizes(graph.simple(raw(s, d))),
    "lcc_edges": _on_graph(lambda g: g.edge),
    "neighbors": _on_graph(lambda g: g.nbr.select("u", F.array_join(F.transform("nbrs", lambda n: n.cast("string")), ",").alias("nbrs"), "d")),
    "degree_hist": _on_graph(lambda g: g.degree.groupBy("d").agg(F.count("*").alias("cnt"))),
    "graph_stats": _on_graph(graph.graph_stats),
    "triangle_line": _on_graph(lambda g: graph.line_triangle(g, g.triangles)),
    "triangle_line_naive": _on_graph(lambda g: graph.line_triangle(g, g.triangles_naive)),
    "edge_support": _on_graph(lambda g: g.support),
    "local_clustering": _on_graph(lambda g: g.clustering.select("node", F.round("cc", 9).alias("cc"))),
    "global_clustering": _on_graph(graph.global_clustering),
    "common2": _on_graph(lambda g: g.common2),
    "common3": _on_graph(lambda g: g.common3),
    "graphlet4": _on_graph(four.graphlet4),
    "graphlet4_identities": _on_graph(lambda g: four.identities(g, four.graphlet4(g))),
    "neighbor_sides": _on_graph(four.neighbor_sides),
    "edge_stats": _on_graph(four.edge_stats),
    "graphlet4_by_edges": _on_graph(four.graphlet4_by_edges),
    "cliques4": _on_graph(four.cliques),
    "graphlet5": lambda s, d: cuts.graphlet5(prepared(s, d), orbit_counts(s, d, 5)),
    "orbits4": lambda s, d: orbit_counts(s, d, 4),
    "orbit_matrix4": lambda s, d: sets.wide_orbits(orbit_counts(s, d, 4), 14),
    "orbits5": lambda s, d: orbit_counts(s, d, 5).where("orbit >= 15"),
    "orbit_matrix5": lambda s, d: sets.wide_orbits(orbit_counts(s, d, 5), 72),
    "orbit_totals4": lambda s, d: sets.totals(orbit_counts(s, d, 4), 4),
    "orbit_totals5": lambda s, d: sets.totals(orbit_counts(s, d, 5), 5),
    "sets_orbits5": _on_sets(5, lambda t: sets.orbits(t, 5)),
    "two_paths": _on_graph(lambda g: g.two_paths),
    "edge_order": _on_graph(lambda g: g.edge_order),
    "reweight4": lambda s, d: estimate.reweighted(prepared(s, d), typed(s, d, 4)).select(F.array_join(F.transform("nodes", lambda n: n.cast("string")), ",").alias("nodes"), "type", "weight"),
    "report4": lambda s, d: experiments.report(four.graphlet4(prepared(s, d))),
    "constants": constants,
    "text_scan": text_scan,
    "truth_table": truth_table,
    "metric_log": metric_log,
    "count_sweep": sweep,
    "unit_errors": unit_errors,
    "state_trace": state_trace,
    "copurchase_edges": lambda s, d: dense(s, d).edge,
    "copurchase_degrees": lambda s, d: dense(s, d).degree.select(F.col("u").alias("node"), "d"),
    "copurchase_triangle_line": lambda s, d: graph.line_triangle(dense(s, d)),
    "copurchase_edge_support": lambda s, d: dense(s, d).support,
    "copurchase_clustering": lambda s, d: graph.global_clustering(dense(s, d)),
    "copurchase_graphlet4": lambda s, d: four.graphlet4(dense(s, d)),
    "copurchase_graphlet5": lambda s, d: cuts.graphlet5(dense(s, d), dense_orbits(s, d)),
    "copurchase_orbits5": dense_orbits,
    "copurchase_psrw5": dense_psrw,
    "walk_trace": lambda s, d: walks.walk(prepared(s, d).adj, STEPS, SIMS, SEED),
    "edges_hat": lambda s, d: estimate.edges_hat(prepared(s, d), trail(s, d, 3)).select("sim", F.round("e_hat", 6).alias("e_hat")),
    "error_metrics": metrics,
    "concentration_metrics": concentration_metrics,
    "truth_lookup": truth_lookup,
}
for _k in (3, 4, 5):
    QUERIES |= {
        f"graphlet_gfd{_k}": _on_sets(_k, lambda t, k=_k: sets.frequencies(sets.counts(t, k))),
        f"cis{_k}": _on_sets(_k, sets.rows_as_text),
        f"frames{_k}_twin": _on_graph(lambda g, k=_k: estimate.twin(g, k)),
        f"est{_k}_count": lambda s, d, k=_k: estimate.estimate(prepared(s, d), trail(s, d, k), k),
        f"est{_k}_conc": lambda s, d, k=_k: estimate.concentration(estimate.estimate(prepared(s, d), trail(s, d, k), k), "SRW" if k == 3 else "SRWIMPR"),
        f"state_adj{_k - 1}": lambda s, d, k=_k: states(s, d, k),
        f"psrw{_k}": lambda s, d, k=_k: psrw(s, d, k),
    }
