"""Estimators of graphlet counts from walks, and their exact twins.

A frame is k-1 consecutive nodes of a walk. Each different frame is observed
once: its neighbours, with the frame nodes they are adjacent to, tell how many
sets of k nodes of each type contain it. Frames are then weighted and summed
for each simulation. Replacing the walk by all frames of the graph gives exact
counts by the same observation; that is what the twins do.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motifloom.functions import atlas
from motifloom.operators.frames import observed as all_observed
from motifloom.operators.graph import Graph
from motifloom.session import store

NAMES = "uvwz"
#: Names of the estimator variants, in order.
VARIANTS = ("SRW", "SRWIMPR", "SRWNOE", "SRWIMPRNOE")
#: Results are rounded; short walks often end halfway between two of them, where the last bit of a sum would decide.
DIGITS, OFF_TIES = 6, 1e-9


def frames(walk: DataFrame, k: int) -> DataFrame:
    """``(sim, step, u, v, ...)``: k-1 consecutive nodes from each step that has as many."""
    along = Window.partitionBy("sim").orderBy("step")
    ahead = [F.lead("node", i).over(along).alias(NAMES[i]) for i in range(1, k - 1)]
    return walk.select("sim", "step", F.col("node").alias("u"), *ahead).where(f"{NAMES[k - 2]} is not null")


def all_frames(g: Graph, k: int) -> DataFrame:
    """Every walk of k-1 nodes in the graph, without immediate or later returns."""
    out = g.adj.select("u", "v")
    for i in range(2, k - 1):
        a, b = NAMES[i - 1], NAMES[i]
        out = out.join(g.adj.select(F.col("u").alias(a), F.col("v").alias(b)), a)
        for c in NAMES[: i - 1]:
            out = out.where(F.col(b) != F.col(c))
    return out.select(*NAMES[: k - 1])


def different(k: int) -> Column:
    """Whether the nodes of a frame all differ."""
    names = NAMES[: k - 1]
    test = F.lit(True)
    for i, a in enumerate(names):
        for b in names[i + 2 :]:
            test = test & (F.col(a) != F.col(b))
    return test


def observe(g: Graph, frame: DataFrame, k: int) -> DataFrame:
    """``(u, v, ..., type, n)`` for each of the distinct frames of different nodes: sets of each type over it."""
    names = list(NAMES[: k - 1])
    some = frame.select(*names).where(different(k)).distinct()
    place = some.select(*names, F.posexplode(F.array(*names)).alias("i", "a"))
    near = place.join(g.adj.select(F.col("u").alias("a"), F.col("v").alias("x")), "a")
    seen = near.groupBy(*names, "x").agg(F.bit_or(F.expr("shiftleft(1, i)")).alias("bits"))
    # Rows of frame nodes themselves tell the chords; the others are neighbours.
    inside = F.expr(f"array_position(array({', '.join(names)}), x)").cast("int")
    seen = seen.withColumn("at", inside)
    pairs = atlas.chord_pairs(k)
    chord = [F.max(F.when((F.col("at") == a + 1) & (F.col("bits").bitwiseAND(1 << b) != 0), 1 << j).otherwise(0)) for j, (a, b) in enumerate(pairs)]
    total = sum(chord[1:], chord[0]) if chord else F.lit(0)
    outside = F.when(F.col("at") == 0, F.col("bits"))
    per = seen.groupBy(*names).agg(total.alias("chords"), F.collect_list(outside).alias("out"))
    dim = F.broadcast(atlas.table(frame.sparkSession, atlas.extensions(k), ["chords", "bits", "type"]))
    return per.select(*names, "chords", F.explode("out").alias("bits")).join(dim, ["chords", "bits"]).groupBy(*names, "chords", "type").agg(F.count("*").alias("n"))


def weights(k: int) -> list[Column]:
    """Basic and improved weight of a frame, from degrees ``du, dv, ...`` and ``chords``.

    Basic: the product of the inner degrees. Improved: the mean over all
    orders in which a walk can visit the frame's nodes of one over that product,
    inverted.
    """
    m = k - 1
    d = [F.col(f"d{c}").cast("double") for c in NAMES[:m]]
    basic = F.lit(1.0)
    for x in d[1:-1]:
        basic = basic * x
    pairs = atlas.chord_pairs(k)

    def linked(a: int, b: int) -> Column:
        a, b = min(a, b), max(a, b)
        return F.lit(True) if b - a == 1 else F.col("chords").bitwiseAND(1 << pairs.index((a, b))) != 0

    n, total = F.lit(0.0), F.lit(0.0)
    for p in permutations(range(m)):
        if p[0] < p[-1]:
            fine = F.lit(True)
            for a, b in zip(p, p[1:], strict=False):
                fine = fine & linked(a, b)
            inner = F.lit(1.0)
            for i in p[1:-1]:
                inner = inner / d[i]
            n, total = n + F.when(fine, 1.0).otherwise(0.0), total + F.when(fine, inner).otherwise(0.0)
    return [basic, n / total]


def _with_degrees(g: Graph, seen: DataFrame, k: int) -> DataFrame:
    for c in NAMES[: k - 1]:
        seen = seen.join(g.degree.select(F.col("u").alias(c), F.col("d").alias(f"d{c}")).hint("merge"), c)
    return seen


def _kinds(g: Graph, k: int) -> DataFrame:
    return F.broadcast(atlas.table(g.edge.sparkSession, atlas.graphlets(k), ["type", "beta", "phi", "walk_div"]))


def _star(rows: DataFrame, by: list[str], k: int, stars: DataFrame) -> DataFrame:
    """For k = 5, the type no frame sees (the 4-star) from ``stars``: its total less what other types hold."""
    if k != 5:
        return rows
    held = rows.groupBy(*by).agg(F.sum(F.col("phi") * F.col("value")).alias("held"))
    fixed = rows.where("beta > 0").select(*by, "type", "value")
    star = held.join(stars, [c for c in by if c in stars.columns]) if set(by) & set(stars.columns) else held.crossJoin(F.broadcast(stars))
    return fixed.union(star.select(*by, F.lit(2).alias("type"), (F.col("stars") - F.col("held")).alias("value")))


def twin(g: Graph, k: int) -> DataFrame:
    """``(type, basic, improved)``: exact counts from all frames, by either weight.

    Frames weigh alike in the first column; the second checks that improved
    weights over basic ones, averaged over a set's frames, change nothing.
    """
    if k == 3:
        seen = _with_degrees(g, _edge_types(g), k)
    elif g.lists is not None:
        seen = all_observed(g, k, NAMES[: k - 1])
    else:
        seen = _with_degrees(g, observe(g, all_frames(g, k), k), k)
    basic, improved = weights(k) if k > 3 else (F.lit(1.0), F.lit(1.0))
    rows = seen.groupBy("type").agg(F.sum("n").alias("a"), F.sum(F.col("n") * improved / basic).alias("b"))
    kinds = _kinds(g, k)
    rows = kinds.join(rows, "type", "left").select("type", "beta", "phi", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in "ab"])
    out = None
    for name, c in (("basic", "a"), ("improved", "b")):
        part = rows.select(F.lit(name).alias("w"), "type", "beta", "phi", F.coalesce(F.try_divide(F.col(c), 2 * F.col("beta")), F.lit(0.0)).alias("value"))
        out = part if out is None else out.union(part)
    stars = g.degree.agg(F.coalesce(F.sum(F.expr("d * (d - 1) * (d - 2) * (d - 3) / 24.0D")), F.lit(0.0)).alias("stars"))
    out = _star(out, ["w"], k, stars)
    pick = lambda w: F.round(F.max(F.when(F.col("w") == w, F.col("value"))), DIGITS).alias(w)
    return out.groupBy("type").agg(pick("basic"), pick("improved"))


def _edge_types(g: Graph) -> DataFrame:
    """``(u, v, type, n)`` for k = 3: wedges and triangles over each directed edge."""
    base = g.support.join(g.with_degrees.hint("merge"), ["u", "v"])
    both = base.select("u", "v", "t", "du", "dv").union(base.select("v", "u", "t", "dv", "du"))
    n = F.array(F.struct(F.lit(0).alias("type"), (F.col("du") + F.col("dv") - 2 - 2 * F.col("t")).alias("n")), F.struct(F.lit(1).alias("type"), F.col("t").alias("n")))
    return both.select("u", "v", F.inline(n))


def visited(g: Graph, walk: DataFrame) -> DataFrame:
    """``(sim, m, r, s)``: visited nodes, their sum of 1/d, and of (d-1)(d-2)(d-3)/12."""
    d = walk.join(g.degree.select(F.col("u").alias("node"), "d").hint("merge"), "node")
    return d.groupBy("sim").agg(F.count("*").alias("m"), F.sum(F.lit(1.0) / F.col("d")).alias("r"), F.sum(F.expr("(d - 1) * (d - 2) * (d - 3) / 12.0D")).alias("s"))


def edges_hat(g: Graph, walk: DataFrame) -> DataFrame:
    """``(sim, e_hat)``: the number of edges estimated from the degrees seen."""
    n, _ = g.size
    return visited(g, walk).select("sim", (F.lit(float(n)) * F.col("m") / F.col("r") / 2).alias("e_hat"))


def estimate(g: Graph, walk: DataFrame, k: int) -> DataFrame:
    """``(sim, variant, type, estimate)``, a row for each type.

    Variants: basic and improved weights (for k = 3 they are the same and left
    out), each with the true and with the estimated number of edges.
    """
    if k not in (3, 4, 5):
        raise ValueError("k is 3, 4 or 5")
    _, m = g.size
    path = store(walk, "walk").read()
    framed = frames(path, k)
    seen = store(_with_degrees(g, _edge_types(g) if k == 3 else observe(g, framed, k), k), "seen").read()
    names = list(NAMES[: k - 1])
    basic, improved = weights(k) if k > 3 else (F.lit(1.0), F.lit(1.0))
    joined = framed.groupBy("sim", *names).agg(F.count("*").alias("times")).join(seen, names)
    sums = joined.groupBy("sim", "type").agg(F.sum(F.col("n") * F.col("times") * basic).alias("a"), F.sum(F.col("n") * F.col("times") * improved).alias("b"))
    steps = framed.groupBy("sim").agg(F.count("*").alias("steps"))
    grid = steps.crossJoin(_kinds(g, k)).join(sums, ["sim", "type"], "left")
    values = F.array(*[F.struct(F.lit(i).alias("w"), F.coalesce(F.try_divide(F.col(c), F.col("steps") * F.col("beta")), F.lit(0.0)).alias("value")) for i, c in enumerate("ab"[: 1 if k == 3 else 2])])
    rows = grid.select("sim", "type", "beta", "phi", F.inline(values))
    seen_nodes = visited(g, path)
    rows = _star(rows, ["sim", "w"], k, seen_nodes.select("sim", F.expr("s / m").alias("stars")))
    n = g.size[0]
    e = seen_nodes.select("sim", F.array(F.lit(float(m)), F.lit(float(n)) * F.col("m") / F.col("r") / 2).alias("es"))
    out = rows.join(e, "sim").select("sim", "w", "type", "value", F.posexplode("es").alias("known", "e"))
    labels = F.array(*map(F.lit, VARIANTS))
    return out.select("sim", F.element_at(labels, (F.col("w") + 2 * F.col("known") + 1).cast("int")).alias("variant"), "type", F.round(F.col("value") * F.col("e") + OFF_TIES, DIGITS).alias("estimate"))


def concentration(estimates: DataFrame, variant: str) -> DataFrame:
    """``(sim, type, value)``: one variant's estimates as shares (null if they sum to zero)."""
    one = estimates.where(F.col("variant") == variant)
    total = one.groupBy("sim").agg(F.sum("estimate").alias("total"))
    return one.join(total, "sim").select("sim", "type", F.round(F.try_divide("estimate", "total"), DIGITS).alias("value"))


def state_walk_shares(trail: DataFrame, k: int) -> DataFrame:
    """``(sim, type, value)``: shares from a walk over states.

    ``trail(sim, step, nodes, type)`` is that of ``walks.state_walk``; a type's
    tally is divided by the number of its pairs of states.
    """
    moves = trail.groupBy("sim", "type").agg(F.count("*").alias("n"))
    kinds = F.broadcast(atlas.table(trail.sparkSession, atlas.graphlets(k), ["type", "walk_div"]))
    grid = moves.select("sim").distinct().crossJoin(kinds).join(moves, ["sim", "type"], "left")
    rows = grid.select("sim", "type", (F.coalesce("n", F.lit(0)) / F.col("walk_div")).alias("x"))
    total = rows.groupBy("sim").agg(F.sum("x").alias("total"))
    return rows.join(total, "sim").select("sim", "type", F.round(F.try_divide("x", "total"), DIGITS).alias("value"))


def error_metrics(estimates: DataFrame, truth: DataFrame, by: tuple[str, ...] = ("variant", "steps")) -> DataFrame:
    """``(by..., type, RV, RE, LB, UB, NRMSE)`` of ``estimates(by..., type, estimate)`` against ``truth(type, cnt)``.

    RV is the mean estimate, RE the mean relative error, LB and UB the sorted
    estimates at places ``int(0.05 n)`` and ``int(0.95 n)``. A true count of
    zero gives null errors. Shares measured in units of their truth, as by
    ``relative``, go against a truth of one.
    """
    off = F.try_divide(F.col("estimate"), F.col("cnt").cast("double")) - 1
    at = lambda q: F.get(F.sort_array(F.collect_list("estimate")), (F.count("*") * F.lit(q)).cast("int"))
    r = lambda c: F.round(c, DIGITS)
    return estimates.join(truth.select("type", "cnt"), "type").groupBy(*by, "type").agg(
        r(F.avg("estimate")).alias("RV"), r(F.avg(F.abs(off))).alias("RE"), at(0.05).alias("LB"), at(0.95).alias("UB"), r(F.sqrt(F.avg(F.pow(off, F.lit(2))))).alias("NRMSE")
    )


def relative(estimates: DataFrame, truth: DataFrame) -> DataFrame:
    """``estimates(..., type, estimate)`` in units of the true count (null if that is zero)."""
    return estimates.join(truth.select("type", "cnt"), "type").withColumn("estimate", F.try_divide(F.col("estimate"), F.col("cnt").cast("double"))).drop("cnt")


def nrmse(estimates: DataFrame, by: tuple[str, ...] = ("variant", "type")) -> DataFrame:
    """``(by..., NRMSE)`` of estimates in units of their truth."""
    return estimates.groupBy(*by).agg(F.round(F.sqrt(F.avg(F.pow(F.col("estimate") - 1, F.lit(2)))), DIGITS).alias("NRMSE"))


def reweighted(g: Graph, typed: DataFrame) -> DataFrame:
    """``(nodes, type, weight)`` of four-node sets ``typed(nodes, keys, type)``: the improved weight in closed form.

    One over the sum, over all walks of three nodes inside the set but for their
    direction, of one over the middle node's degree. A node is the middle of as
    many as it has pairs of neighbours in the set.
    """
    places = typed.select("nodes", "type", F.inline(F.arrays_zip(F.col("nodes").alias("u"), F.col("keys").alias("key"))))
    inner = F.expr("key div 100")
    parts = places.join(g.degree, "u").groupBy("nodes", "type").agg(F.sum(inner * (inner - 1) / 2 / F.col("d")).alias("s"))
    return parts.select("nodes", "type", F.round(F.lit(1.0) / F.col("s"), 9).alias("weight"))
