"""Orbit counts of each node without sets of its size: sums over linked pairs, wedges, triangles and four-cliques.

``functions.cuts`` says which sums: factors of up to three nodes, each a column
of one of five tables, and how they make the orbit counts. Here each round of
factors of one kind is one grouped sum over the rows of that kind, with the
factors that it is made of joined on; tables are stored between the rounds.

Nothing of four nodes is written but cliques. The rows that are made and summed
at once are wedges (the sum of squared degrees), pairs of triangles on an edge,
and, for the five-cycle, a neighbour of either end of each pair with a common
neighbour; that last sum is the largest. What is stored has a row for each pair
with a common neighbour, and for each node with two neighbours that a fourth
links. For graphs ``by_blocks`` all but the sums over edges are made around each node
(``operators.rooted``), and none of those tables. Sums are exact: 64 bits where they overflow with an error, decimals
elsewhere.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifloom.functions import atlas, cuts
from motifloom.operators import four, rooted, sets
from motifloom.operators.graph import Graph
from motifloom.operators.orbits import cliques
from motifloom.session import scratch, store, store_all

_WHOLE = "decimal(38,0)"


class _Sums:
    """The factors computed so far: for each its table and column."""

    def __init__(self, g: Graph):
        self.g = g
        self.column: dict[tuple, str] = {}
        self.table: dict[tuple, DataFrame] = {}
        made = rooted.tables(g) if g.by_blocks else None
        self.made, self.five = made or ({}, None)
        if self.made:
            return
        self.triangles = store(g.triangles.select(F.explode(_orders("xyz")).alias("t")).select(*[F.col("t")[i].alias(f"q{i}") for i in range(3)]), "corners").read()

    def adj(self, a: int, b: int) -> DataFrame:
        return self.g.adj.select(F.col("u").alias(f"q{a}"), F.col("v").alias(f"q{b}"))

    def corners(self, *places: int) -> DataFrame:
        return self.triangles.select(*[F.col(f"q{i}").alias(f"q{p}") for i, p in enumerate(places)])

    def values(self, factors: list[tuple], at: tuple[int, ...]) -> DataFrame:
        """Columns of one table as a side to join: its keys named for the places ``at``."""
        keys = [F.col(f"q{i}").alias(f"q{p}") for i, p in enumerate(at)]
        names = [F.col(self.column[f]).alias(_name(self.column[f], at)) for f in factors]
        return self.table[factors[0]].select(*keys, *names)

    def joined(self, rows: DataFrame, wanted: set[tuple]) -> DataFrame:
        """``rows`` with the values of ``wanted`` ``(factor, at)``; those that have none are 0."""
        sides: dict[tuple, list] = {}
        for f, at in sorted(wanted, key=repr):
            if _name(self.column[f], at) not in rows.columns:
                sides.setdefault((id(self.table[f]), at), []).append(f)
        for (_, at), factors in sides.items():
            rows = rows.join(self.values(factors, at), [f"q{p}" for p in at], "left")
            rows = rows.fillna(0, [_name(self.column[f], at) for f in factors])
        return rows

    def rows(self, kind: str, wanted: set[tuple]) -> DataFrame:
        """The rows that a kind's factors sum over."""
        two_at = lambda places: {w for w in wanted if set(w[1]) <= places}
        if kind == "edges":
            return self.joined(self.adj(0, 1), wanted)
        if kind == "triangles":
            return self.joined(self.corners(0, 1, 2), wanted)
        if kind == "wedges":
            left, right = two_at({0, 2}), two_at({1, 2}) - two_at({2})
            return self.joined(self.adj(2, 0), left).join(self.joined(self.adj(2, 1), right), "q2")
        if kind == "cliques":
            k4 = four.cliques(self.g).select(F.explode(_orders("xyzw")).alias("t")).select(*[F.col("t")[i].alias(f"q{i}") for i in range(4)])
            return self.joined(k4, wanted)
        if kind == "hubs":
            return self.corners(0, 3, 1).join(self.corners(0, 3, 2), ["q0", "q3"])
        if kind == "spans":
            return self.joined(self.adj(0, 1).join(self.adj(0, 2), "q0"), wanted)
        if kind == "walks":
            (one,) = wanted
            return self.adj(0, 2).join(self.values([one[0]], one[1]), "q2")
        # Of pairs, and of hubs with two neighbours: the rows of the table itself.
        first = min(wanted, key=lambda w: (len(w[1]) < 3, w[0][0] != "wedges", repr(w)))
        mine = [f for f, at in sorted(wanted, key=repr) if at == first[1] and self.table[f] is self.table[first[0]]]
        return self.joined(self.values(mine, first[1]), wanted)

    def add(self, step: list[tuple[str, list[tuple]]]) -> None:
        """Compute a round of factors; those of one kind together if they sum over the same rows."""
        frames = []
        for kind, factors in step:
            factors = [f for f in factors if not self._is_made(f)]
            groups: dict[tuple, list] = {}
            for f in factors:
                # Sums over a table's own rows go by where its factor lies; all else shares its rows.
                own = tuple(sorted({at for n, at in cuts.inner(f) if len(at) > 1}, key=repr)) if kind in ("pairs", "diamonds", "tops", "walks") else ()
                groups.setdefault((len(own[0]), own[0]) if kind == "pairs" else own, []).append(f)
            for mine in groups.values():
                frames.append((mine, *self._sum(kind, mine)))
        if not frames:
            return
        tables = store_all([(df, mine[0][0]) for mine, df, _ in frames])
        for (mine, _, turn), table in zip(frames, tables, strict=True):
            held = table.read()
            if turn:
                a, b = turn
                other = {a: b, b: a}
                held = held.union(held.where(f"{a} < {b}").select(*[F.col(other.get(c, c)) for c in held.columns]))
            for f in mine:
                self.table[f] = held

    def _is_made(self, f: tuple) -> bool:
        """Whether a factor is among those summed around each node, or only a part of them."""
        name = rooted.says(f)
        if name in self.made:
            self.table[f] = self.made[name]
            self.column[f] = rooted.COLUMNS[name]
        return name in self.made or (bool(self.made) and name in rooted.INSIDE)

    def _sum(self, kind: str, factors: list[tuple]) -> tuple[DataFrame, tuple]:
        """The grouped sums; and the two keys, if any, of which only one order was taken, as counts alone are the same in the other."""
        wanted = {(n, at) for f in factors for n, at in cuts.inner(f)}
        kept = _WHOLE if cuts.TABLES[kind] == "N" else "long"
        for f in factors:
            self.column[f] = f"c{len(self.column)}"
        sums = [F.sum(self._term(f, kept)).cast(kept).alias(self.column[f]) for f in factors]
        keys = [f"q{i}" for i in range(factors[0][1][1])]
        rows = self.rows(kind, wanted)
        turn = tuple(keys[-2:]) if kind in ("hubs", "wedges") and not wanted else ()
        return (rows.where(f"{turn[0]} <= {turn[1]}") if turn else rows).groupBy(*keys).agg(*sums), turn

    def _term(self, f: tuple, kept: str) -> Column:
        parts = [F.col(_name(self.column[n], at)).cast(kept) for n, at in cuts.inner(f)]
        return reduce(lambda a, b: a * b, parts, F.lit(1).cast(kept))


def _name(column: str, at: tuple[int, ...]) -> str:
    return f"{column}_{''.join(map(str, at))}"


def _orders(columns: str) -> Column:
    """All orders of some columns."""
    return F.array(*[F.array(*p) for p in permutations(columns)])


def node_orbits(g: Graph, k: int) -> DataFrame:
    """``(node, orbit, cnt)`` of all orbits up to size ``k``, 3 to 5; orbit 0 is the degree, zeros are left out."""
    if k not in (3, 4, 5):
        raise ValueError("k is 3, 4 or 5")
    spark = g.edge.sparkSession
    with scratch(spark):
        sums = _Sums(g)
        for step in cuts.rounds(k):
            sums.add(step)
        nodes = g.degree.select(F.col("u").alias("q0"))
        patterns = cuts.patterns(k)
        nodes = sums.joined(nodes, {(f, (0,)) for p in patterns for f in cuts.elimination(p)})
        one = F.lit(1).cast(_WHOLE)
        maps = [reduce(lambda a, b: a * b, [F.col(_name(sums.column[f], (0,))) for f in cuts.elimination(p)], one) for p in patterns]
        maps = nodes.select(F.col("q0").alias("node"), F.posexplode(F.array(*maps)).alias("pattern", "n")).where("n <> 0")
        number = {p: i for i, p in enumerate(patterns)}
        if k == 5:
            full = sums.five if sums.five is not None else cliques(g, 5).select(F.explode("nodes").alias("node")).groupBy("node").agg(F.count("*").alias("n"))
            full = full.select("node", (F.col("n") * 24).cast(_WHOLE).alias("n"))
            number[next(r["pattern"] for r in cuts.solution(5) if r["pattern"] not in number)] = len(patterns)
            maps = maps.union(full.select("node", F.lit(len(patterns)).alias("pattern"), "n"))
        rows = [{"pattern": number[r["pattern"]], **{c: r[c] for c in ("orbit", "num", "den")}} for size in range(3, k + 1) for r in cuts.solution(size)]
        dim = F.broadcast(atlas.table(spark, rows, ["pattern", "orbit", "num", "den"]))  # of fixed size
        counts = maps.join(dim, "pattern").groupBy("node", "orbit", "den").agg(F.sum(F.col("n") * F.col("num")).alias("x"))
        counts = counts.select("node", "orbit", F.expr("cast(x div den as bigint)").alias("cnt")).where("cnt > 0")
        degree = g.degree.select(F.col("u").alias("node"), F.lit(0).alias("orbit"), F.col("d").alias("cnt"))
        return store(degree.union(counts), "cut-orbits").keep().read()


def graphlet5(g: Graph, orbit: DataFrame | None = None) -> DataFrame:
    """``(type, name, cnt)`` of the 21 types of five nodes."""
    orbit = node_orbits(g, 5) if orbit is None else orbit
    names = atlas.table(g.edge.sparkSession, atlas.graphlets(5), ["type", "name"])
    return names.join(sets.totals(orbit, 5), "type").select("type", "name", "cnt")
