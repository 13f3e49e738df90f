"""DuckDB SQL for the graph queries, by other routes than the operators where there are any.

Counts come from enumerated node sets, components from recursive reachability,
walks from replayed random numbers.
"""

from __future__ import annotations

import re
from itertools import permutations

from motifloom.functions import atlas
from motifloom.operators.walks import MODULUS, MULTIPLIER, SKIPPED
from motifloom.plans.queries import DAYS, SEED, SIMS, STEPS, SWEEP

_PAIR = f"""
  select distinct x.l_orderkey as g, x.l_partkey as u, y.l_partkey as v from lineitem x join lineitem y
    on x.l_orderkey = y.l_orderkey and x.l_partkey < y.l_partkey
  where abs(date_diff('day', x.l_shipdate, y.l_shipdate)) <= {DAYS}
"""

_ALL_PAIRS = "select distinct x.l_partkey as u, y.l_partkey as v from lineitem x join lineitem y on x.l_orderkey = y.l_orderkey and x.l_partkey < y.l_partkey"

_RAW = f"""
raw as materialized (
  select distinct u, v from ({_PAIR})
), both_ways as materialized (
  select u, v from raw union all select v, u from raw
), low as (
  select u from both_ways group by u having min(v) > u
), reach(root, node) as (
  select u, u from low union select r.root, b.v from reach r join both_ways b on r.node = b.u
), comp as materialized (
  select node, min(root) as c from reach group by node
)"""

_GRAPH = (
    "with recursive"
    + _RAW
    + """, top as (
  select c from comp group by c order by count(*) desc, c limit 1
), ids as (
  select node, row_number() over (order by node) - 1 as id from comp where c = (select c from top)
), e as materialized (
  select a.id as u, b.id as v from raw join ids a on raw.u = a.node join ids b on raw.v = b.node
), adj as materialized (
  select u, v from e union all select v, u from e
), deg as materialized (
  select u, count(*) as d from adj group by u
)"""
)

_DENSE = _GRAPH.replace(f"select distinct u, v from ({_PAIR})", _ALL_PAIRS)

_TRI = """, tri as (
  select x.u as x, x.v as y, y.v as z from e x join e y on x.v = y.u join e w on w.u = x.u and w.v = y.v
)"""


def _values(rows: list[tuple]) -> str:
    show = lambda x: f"'{x}'" if isinstance(x, str) else str(x)
    return "values " + ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows)


def _kinds(k: int) -> str:
    rows = [(g["type"], g["name"], g["shape"], g["beta"], g["phi"], g["walk_div"]) for g in atlas.graphlets(k)]
    return f", kind(type, name, shape, beta, phi, walk_div) as ({_values(rows)})"


def _sets(k: int) -> str:
    """Tables s2 to sk of sorted node lists."""
    out = ", s2 as materialized (select [u, v] as s from e)"
    for i in range(3, k + 1):
        out += f""", s{i} as materialized (
  select distinct list_sort(list_append(s, adj.v)) as s
  from (select s, unnest(s) as n from s{i - 1}) t join adj on t.n = adj.u where not list_contains(s, adj.v)
)"""
    return out


def _typed(k: int) -> str:
    """Tables typed{k}(s, type) and place{k}(s, n, key)."""
    return (
        _sets(k)
        + _kinds(k)
        + f""", member{k} as materialized (
  select s, unnest(s) as n from s{k}
), inner{k} as materialized (
  select a.s, a.n, b.n as o from member{k} a join member{k} b on a.s = b.s join adj on adj.u = a.n and adj.v = b.n
), size{k} as materialized (
  select s, n, count(*) as dg from inner{k} group by s, n
), place{k} as materialized (
  select i.s, i.n, (100 * any_value(x.dg) + sum(y.dg))::int as key
  from inner{k} i join size{k} x on x.s = i.s and x.n = i.n join size{k} y on y.s = i.s and y.n = i.o group by i.s, i.n
), typed{k} as materialized (
  select s, type from (select s, string_agg(key::varchar, ',' order by key) as shape from place{k} group by s) join kind using (shape)
)"""
    )


def _walk(adjacency: str, nodes: int, least: int = 1, seed: int = SEED, starts: str = "select sim, st, u from first join eligible on place = st % n") -> str:
    """Table walk(sim, step, st, node) on ``adjacency(u, v)``."""
    start = f"(1 + (sim * 7919 + {seed}) % {MODULUS - 1})"
    for _ in range(SKIPPED + 1):
        start = f"({start} * {MULTIPLIER} % {MODULUS})"
    return f""", nb as materialized (
  select u, list(v order by v) as vs, count(*) as d from {adjacency} group by u
), eligible as materialized (
  select u, row_number() over (order by u) - 1 as place, count(*) over () as n from nb where d >= {least}
), first as (
  select sim, {start} as st from range({SIMS}) r(sim)
), walk(sim, step, st, node) as (
  select sim, 0::bigint, st, u from ({starts})
  union all
  select sim, step + 1, st * {MULTIPLIER} % {MODULUS}, vs[st * {MULTIPLIER} % {MODULUS} % d + 1]
  from walk join nb on node = u where step + 1 < {nodes}
)"""


_NAMES = "uvwz"


def _frames(k: int) -> str:
    cols = ", ".join(f"lead(node, {i}) over (partition by sim order by step) as {_NAMES[i]}" for i in range(1, k - 1))
    return f", frame as materialized (select * from (select sim, step, node as u, {cols} from walk) where {_NAMES[k - 2]} is not null)"


def _seen(k: int) -> str:
    """Table seen(u, ..., type, n) and weight columns: sets over each different frame, from the enumerated sets."""
    names = _NAMES[: k - 1]
    cols = ", ".join(names)
    out = f""", distinct_frame as materialized (
  select distinct {cols} from frame where len(list_distinct([{cols}])) = {k - 1}
), seen as materialized (
  select {cols}, type, count(*) as n from distinct_frame f join member{k} m on m.n = f.u join typed{k} using (s)
  where list_has_all(s, [{cols}]) group by {cols}, type
)"""
    links = {}
    for a, b in atlas.chord_pairs(k):
        links[a, b] = f"exists (from adj x where x.u = f.{names[a]} and x.v = f.{names[b]})"
    flags = "".join(f", {q} as l{a}{b}" for (a, b), q in links.items())
    degrees = "".join(f", (select d from deg where deg.u = f.{c}) as d{c}" for c in names)
    out += f", weighed as materialized (select *{flags}{degrees} from distinct_frame f)"
    number, total = [], []
    for p in permutations(range(k - 1)):
        if p[0] < p[-1]:
            need = [f"l{min(a, b)}{max(a, b)}" for a, b in zip(p, p[1:], strict=False) if abs(a - b) > 1]
            cond = " and ".join(need) or "true"
            number.append(f"(case when {cond} then 1.0::double else 0 end)")
            product = "*".join(f"d{names[i]}" for i in p[1:-1]) or "1"
            total.append(f"(case when {cond} then 1.0::double / ({product}) else 0 end)")
    basic = "*".join(f"d{c}" for c in names[1:-1]) or "1"
    return out + f", weights as materialized (select {cols}, ({basic})::double as w0, ({'+'.join(number)}) / ({'+'.join(total)}) as w1 from weighed)"


def _estimates(k: int, steps: int = STEPS, seed: int = SEED) -> str:
    """Table est(sim, variant, type, estimate)."""
    names = _NAMES[: k - 1]
    same = " and ".join(f"f.{c} = x.{c}" for c in names)
    same_w = " and ".join(f"f.{c} = w.{c}" for c in names)
    variants = [(0, 0, "SRW"), (0, 1, "SRWNOE")] if k == 3 else [(0, 0, "SRW"), (1, 0, "SRWIMPR"), (0, 1, "SRWNOE"), (1, 1, "SRWIMPRNOE")]
    star = "type <> 2" if k == 5 else "true"
    out = (
        _typed(k)
        + _walk("adj", steps + k - 2, 2 if k == 5 else 1, seed)
        + _frames(k)
        + _seen(k)
        + f""", sums as (
  select sim, type, sum(n * w0) as a0, sum(n * w1) as a1 from frame f join seen x on {same} join weights w on {same_w} group by sim, type
), grid as (
  select sim, kind.type, phi, case when beta = 0 then 0 else coalesce(a0, 0) / {steps} / beta end as v0, case when beta = 0 then 0 else coalesce(a1, 0) / {steps} / beta end as v1
  from range({SIMS}) r(sim) cross join kind left join sums using (sim, type)
), visit as (
  select sim, count(*) as m, sum(1.0::double / d) as r, sum((d - 1) * (d - 2) * (d - 3) / 12.0::double) as s from walk join deg on node = deg.u group by sim
), fixed as (
  select sim, type, v0, v1 from grid where {star}"""
    )
    if k == 5:
        out += " union all select sim, 2, any_value(s / m) - sum(phi * v0), any_value(s / m) - sum(phi * v1) from grid join visit using (sim) group by sim"
    out += f"), how(w, known, variant) as ({_values(variants)})"
    return (
        out
        + """, est as (
  select sim, variant, type, round((case when w = 0 then v0 else v1 end) * (case when known = 0 then (select count(*) from e)::double else (select count(*) from deg)::double * m / r / 2 end) + 1e-9, 6) as estimate
  from fixed join visit using (sim) cross join how
)"""
    )


def _states(k: int) -> str:
    """Table pairs(u, v, type) over state ids."""
    return (
        _typed(k)
        + f""", state as materialized (
  select s, row_number() over (order by s) - 1 as id from s{k - 1}
), meets as materialized (
  select a.id as u, b.id as v, list_sort(list_distinct(list_concat(a.s, b.s))) as s
  from (select id, s, unnest(s) as n from state) a join (select id, s, unnest(s) as n from state) b on a.n = b.n and a.id <> b.id
), pairs as materialized (
  select distinct u, v, type from meets join typed{k} using (s) where len(s) = {k}
)"""
    )


def _state_walk(k: int) -> str:
    """Tables pairs, state and walk: the latter over ids of states, each start grown from a node of its own draw."""
    out = _states(k) + _walk("adj", 1).replace("nb as", "nb0 as").replace("from nb ", "from nb0 ").replace("join nb ", "join nb0 ").replace("walk(", "walk0(").replace("from walk ", "from walk0 ")
    out += ", grow1 as materialized (select sim, st, [node] as s from walk0)"
    for i in range(2, k):
        out += f""", grow{i} as materialized (
  select sim, st * {MULTIPLIER} % {MODULUS} as st, list_sort(list_append(s, vs[st * {MULTIPLIER} % {MODULUS} % len(vs) + 1])) as s from (
    select g.sim, any_value(g.st) as st, any_value(g.s) as s, list(distinct a.v order by a.v) as vs
    from grow{i - 1} g join adj a on list_contains(g.s, a.u) and not list_contains(g.s, a.v) group by g.sim)
)"""
    # A draw: a node by degree and one of its neighbours, and another node to leave; the walk stays unless all fits.
    m = k - 1
    place = "case " + " ".join(f"when slot < {' + '.join(f'd{j}' for j in range(1, i + 1))} then {i}" for i in range(1, m + 1)) + " end"
    before = "case p " + " ".join(f"when {i} then {' + '.join(['0', *(f'd{j}' for j in range(1, i))])}" for i in range(1, m + 1)) + " end"
    picked = "case p " + " ".join(f"when {i} then l{i}" for i in range(1, m + 1)) + " end"
    first = "case " + " ".join(f"when q <> {i} and list_contains(l{i}, y) then {i}" for i in range(1, m + 1)) + " end"
    others = "list_sort(list_append(list_filter(s, lambda n: n <> s[q]), y))"
    lists = ", ".join(f"n{i}.vs as l{i}, n{i}.d as d{i}" for i in range(1, m + 1))
    joins = " ".join(f"join nb0 n{i} on n{i}.u = s[{i}]" for i in range(1, m + 1))
    total = " + ".join(f"d{i}" for i in range(1, m + 1))
    return out + f""", draws(sim, st, s, step, moved) as (
  select sim, st, s, 0::bigint, true from grow{m}
  union all
  select sim, st, case when ok then t else s end, step + ok::int, ok from (
    select d.sim, d.st, d.s, t, step, not list_contains(d.s, y) and f = p and state.id is not null as ok from (
      select *, {others} as t, {first} as f from (
        select *, ({picked})[slot - ({before}) + 1] as y, case when x + 1 < p then x + 1 else x + 2 end as q from (
          select *, {place} as p from (
            select *, st % (({total}) * {m - 1}) // {m - 1} as slot, st % (({total}) * {m - 1}) % {m - 1} as x from (
              select sim, st * {MULTIPLIER} % {MODULUS} as st, s, step, {lists} from draws {joins} where step < {STEPS}))))) d left join state on state.s = d.t)
), walk as materialized (
  select sim, step, id as node from draws join state using (s) where moved
)"""


def _orbit_dim(k: int) -> str:
    return f"orbit_dim(type, key, orbit) as ({_values([(r['type'], r['node_key'], r['orbit']) for r in atlas.orbits(k)])})"


def _orbits(k: int) -> str:
    return f"select n as node, orbit, count(*) as cnt from place{k} join typed{k} using (s) join orbit_dim using (type, key) group by n, orbit"


_LINES = "select 0 as type, 'line' as name, (select sum(d * (d - 1) // 2) from deg)::bigint - 3 * (select count(*) from tri) as cnt union all select 1, 'triangle', (select count(*) from tri)"
_SUPPORT = "support as materialized (select u, v, (select count(*) from adj x join adj y on x.v = y.v where x.u = e.u and y.u = e.v) as t from e)"
_PER_EDGE = f"{_SUPPORT}, part as (select t, a.d - t - 1 as su, b.d - t - 1 as sv from support s join deg a on a.u = s.u join deg b on b.u = s.v)"


def _identities() -> str:
    sides = [
        ("sum((t + su + sv) * (t + su + sv - 1) // 2)", {1: 3, 3: 3, 2: 4, 0: 1, 4: 5, 5: 6}),
        ("sum((su + sv) * (su + sv - 1) // 2)", {1: 3, 3: 1, 2: 4, 0: 1}),
        ("sum(t * (t - 1) // 2)", {4: 1, 5: 6}),
        ("sum(t * (su + sv))", {3: 2, 4: 4}),
        ("sum(su * sv)", {0: 1, 2: 4}),
        ("sum(su * (su - 1) // 2 + sv * (sv - 1) // 2)", {1: 3, 3: 1}),
    ]
    rows = []
    for i, (left, right) in enumerate(sides, 1):
        total = " + ".join(f"{c} * count(*) filter (type = {t})" for t, c in right.items())
        rows.append(f"select {i} as id, (select {left} from part)::bigint as lhs, ({total})::bigint as rhs from typed4")
    return " union all ".join(rows)


def _counts(k: int) -> str:
    return f"select kind.type, name, count(s) as cnt from kind left join typed{k} using (type) group by kind.type, name"


_METRICS = """
select variant, STEPS::bigint as steps, type, round(avg(estimate), 6) as RV, round(avg(abs(estimate / cnt - 1)), 6) as RE,
  list_sort(list(estimate))[(count(*) * 0.05)::double::int + 1] as LB, list_sort(list(estimate))[floor(count(*) * 0.95)::int + 1] as UB,
  round(sqrt(avg(pow(estimate / cnt - 1, 2))), 6) as NRMSE
from est join (select type, count(*)::double as cnt from typed3 group by type) using (type) group by variant, type
"""

_NODE_TRUTH = """, closed as (select x.u, count(*) // 2 as t from adj x join adj y on x.u = y.u join adj z on z.u = x.v and z.v = y.v group by x.u),
both_counts as (select deg.u, d * (d - 1) // 2 - coalesce(t, 0) as wedges, coalesce(t, 0) as t from deg left join closed using (u))
select u || '.txt' as graph, 3 as k, 0 as type, wedges::bigint as cnt from both_counts union all select u || '.txt', 3, 1, t::bigint from both_counts
"""

_SIDES = "sides as materialized (select e.u, e.v, x, case sum(b) when 1 then -1 when 3 then 0 else 1 end as side from (select e.u, e.v, a.v as x, 1 as b from e join adj a on a.u = e.u and a.v <> e.v union all select e.u, e.v, a.v, 2 from e join adj a on a.u = e.v and a.v <> e.u) e group by e.u, e.v, x)"

_EDGE_STATS = """
select e.u, e.v, count(*) filter (side = 0) as t, count(*) filter (side = -1) as su, count(*) filter (side = 1) as sv,
  (select count(*) from adj a join adj b on a.u = e.u and b.u = e.u and a.v < b.v join adj c on c.u = a.v and c.v = b.v join adj x on x.u = e.v and x.v = a.v join adj y on y.u = e.v and y.v = b.v) as k4,
  (select count(*) from adj a join adj c on c.u = a.v join adj b on b.u = e.v and b.v = c.v where a.u = e.u and a.v <> e.v and b.v <> e.u
    and not exists (from adj z where z.u = e.v and z.v = a.v) and not exists (from adj z where z.u = e.u and z.v = b.v)) as c4
from e left join sides using (u, v) group by e.u, e.v
"""


def _all_orbits(k: int) -> str:
    """A query for (node, orbit, cnt), orbit 0 included."""
    parts = ["select u as node, 0 as orbit, d as cnt from deg"]
    for size in range(3, k + 1):
        if size < k:
            dims = _orbit_dim(size).replace("orbit_dim(", f"orbit_dim{size}(")
            parts.append(f"select * from (with {_typed(size).removeprefix(', ')}, {dims} {_orbits(size).replace('orbit_dim', f'orbit_dim{size}')})")
        else:
            parts.append(_orbits(size))
    return f"{_GRAPH}{_typed(k)}, {_orbit_dim(k)}, long as ({' union all '.join(parts)})"


def _orbit_matrix(k: int, last: int) -> str:
    cols = ", ".join(f"coalesce(sum(cnt) filter (orbit = {o}), 0)::bigint as o{o}" for o in range(last + 1))
    return f"{_all_orbits(k)} select node, {cols} from long group by node"


def _metrics(steps: int = STEPS, seed: int = SEED) -> str:
    return f"{_GRAPH}{_estimates(3, steps, seed)} {_METRICS.replace('STEPS', str(steps))}"


def _metric_log() -> str:
    lists = ", ".join(f"{m}" for m in ("RV", "RE", "LB", "UB", "NRMSE"))
    return f"select 'shipped' as graph, 3 as k, metric, variant, steps, type, value from (unpivot (select * from ({_metrics()})) on {lists} into name metric value value)"


#: Signature, walks that see it, pairs of its parts, central nodes, parts by type, and weight of each type.
CONSTANTS = (
    (4, 0, "1,1,2,2", 2, 1, 0, "2,0", 1), (4, 1, "1,1,1,3", 3, 3, 1, "3,0", 3), (4, 2, "2,2,2,2", 4, 6, 0, "4,0", 4),
    (4, 3, "1,2,2,3", 5, 3, 1, "2,1", 5), (4, 4, "2,2,3,3", 8, 6, 2, "2,2", 12), (4, 5, "3,3,3,3", 12, 6, 4, "0,4", 24),
    (5, 0, "1,1,2,2,2", 2, 1, 0, "2,0,0,0,0,0", 2), (5, 1, "1,1,1,2,3", 2, 3, 0, "2,1,0,0,0,0", 5), (5, 2, "1,1,1,1,4", 0, 6, 1, "0,4,0,0,0,0", 12),
    (5, 3, "1,1,2,3,3", 5, 3, 0, "1,0,0,2,0,0", 11), (5, 4, "1,2,2,2,3", 4, 3, 0, "2,0,0,1,0,0", 7), (5, 5, "1,1,2,2,4", 4, 6, 1, "0,2,0,2,0,0", 16),
    (5, 6, "2,2,2,2,2", 5, 10, 0, "5,0,0,0,0,0", 5), (5, 7, "1,2,2,2,3", 6, 6, 0, "2,1,1,0,0,0", 9), (5, 8, "1,2,2,3,4", 10, 6, 1, "0,1,0,2,1,0", 25),
    (5, 9, "2,2,2,2,4", 8, 6, 1, "0,0,0,4,0,0", 20), (5, 10, "1,2,3,3,3", 10, 6, 0, "2,0,0,1,1,0", 19), (5, 11, "2,2,2,3,3", 12, 10, 0, "0,2,3,0,0,0", 18),
    (5, 12, "2,2,2,3,3", 10, 10, 0, "2,0,1,2,0,0", 16), (5, 13, "2,2,2,4,4", 18, 10, 2, "0,2,0,0,3,0", 42), (5, 14, "1,3,3,3,4", 18, 6, 1, "0,0,0,3,0,1", 39),
    (5, 15, "2,2,3,3,4", 17, 10, 1, "1,0,0,2,2,0", 35), (5, 16, "2,3,3,3,3", 18, 10, 0, "0,0,2,2,1,0", 30), (5, 17, "2,3,3,4,4", 28, 10, 2, "0,0,0,2,2,1", 58),
    (5, 18, "3,3,3,3,4", 28, 10, 1, "0,0,1,0,4,0", 52), (5, 19, "3,3,4,4,4", 42, 10, 3, "0,0,0,0,3,2", 84), (5, 20, "4,4,4,4,4", 60, 10, 5, "0,0,0,0,0,5", 120),
)

_REWEIGHT = """
select array_to_string(s, ',') as nodes, type, round(1.0::double / sum(i * (i - 1) / 2 / d), 9) as weight
from (select s, type, n, key // 100 as i from place4 join typed4 using (s)) join deg on n = deg.u group by s, type
"""

_DENSE4 = f"""{_DENSE}, tri as materialized (
  select x.u as x, x.v as y, y.v as z from e x join e y on x.v = y.u join e w on w.u = x.u and w.v = y.v
), side as (
  select x as u, y as v from tri union all select x, z from tri union all select y, z from tri
), support as materialized (
  select u, v, coalesce(t, 0) as t from e left join (select u, v, count(*) as t from side group by u, v) using (u, v)
), k4 as (
  select count(*) as n from tri a join tri b on a.x = b.x and a.y = b.y and a.z < b.z join e on e.u = a.z and e.v = b.z
), co as (
  select sum(n * (n - 1) // 2) // 2 as quads from (select count(*) as n from adj x join adj y on x.u = y.u and x.v < y.v group by x.v, y.v)
), part as (
  select sum(t * (t - 1) // 2) as pairs, sum(t * (a.d + b.d - 2 - 2 * t)) as tails, sum((a.d - t - 1) * (b.d - t - 1)) as ends,
    sum((a.d - t - 1) * (a.d - t - 2) // 2 + (b.d - t - 1) * (b.d - t - 2) // 2) as forks
  from support s join deg a on a.u = s.u join deg b on b.u = s.v
), dia as (
  select pairs - 6 * k4.n as dia, k4.n as k4, tails, ends, forks, quads from part, k4, co
), rest as (
  select *, quads - dia - 3 * k4 as c4, (tails - 4 * dia) // 2 as paw from dia
)
select 0 as type, 'path' as name, (ends - 4 * c4)::bigint as cnt from rest union all select 1, 'star', ((forks - paw) // 3)::bigint from rest
union all select 2, 'cycle', c4::bigint from rest union all select 3, 'tailed triangle', paw::bigint from rest
union all select 4, 'chordal cycle', dia::bigint from rest union all select 5, 'clique', k4::bigint from rest
"""


def _concentration_metrics(k: int) -> str:
    states = _state_walk(k).removeprefix(_typed(k))
    for name in ("nb0", "nb", "eligible2", "eligible", "first2", "first", "walk0", "walk"):
        states = re.sub(rf"\b{name}\b", f"{name}x", states)
    return f"""{_GRAPH}{_estimates(k)}{states}, move as (
  select sim, node as u, lead(node) over (partition by sim order by step) as v from walkx
), tally as (
  select sim, type, count(*) as n from move join pairs using (u, v) group by sim, type
), share as (
  select sim, kind.type, coalesce(n, 0)::double / walk_div as x from range({SIMS}) r(sim) cross join kind left join tally using (sim, type)
), value as (
  select 'PSRW' as variant, sim, type, round(x / sum(x) over (partition by sim), 6) as estimate from share
  union all select 'Basic', sim, type, round(estimate / sum(estimate) over (partition by sim), 6) from est where variant = 'SRWIMPR'
), exact as (
  select kind.type, round(count(s)::double / (select count(*) from typed{k}), 9) as cnt from kind left join typed{k} using (type) group by kind.type
)
select variant, type, round(avg(estimate), 6) as RV, round(avg(case when cnt > 0 then abs(estimate / cnt - 1) end), 6) as RE,
  list_sort(list(estimate))[(count(*) * 0.05)::double::int + 1] as LB, list_sort(list(estimate))[floor(count(*) * 0.95)::int + 1] as UB,
  round(sqrt(avg(case when cnt > 0 then pow(estimate / cnt - 1, 2) end)), 6) as NRMSE
from value join exact using (type) group by variant, type"""


_SCAN = f"select 3 * count(*) as n_raw, count(*) as loops, 2 * count(*) as n_kept, count(distinct (u, v)) as n_edges from ({_PAIR})"

#: ``(k, type, cnt)`` of all sizes.
_SIZES = " union all ".join(f"select {k} as k, type, cnt from ({_GRAPH}{_typed(k)} {_counts(k)})" for k in (3, 4, 5))

ORACLE_SQL: dict[str, str] = {
    "edge_list": f"with recursive{_RAW} select u, v from raw",
    "scan_stats": _SCAN,
    "components": f"with recursive{_RAW} select comp.c as comp_id, count(distinct node) as n_nodes, (select count(*) from raw join comp x on raw.u = x.node where x.c = comp.c) as n_edges from comp group by comp.c",
    "lcc_edges": f"{_GRAPH} select u, v from e",
    "neighbors": f"{_GRAPH} select u, string_agg(v::varchar, ',' order by v) as nbrs, count(*) as d from adj group by u",
    "degree_hist": f"{_GRAPH} select d, count(*) as cnt from deg group by d",
    "graph_stats": f"{_GRAPH} select count(*) as n_nodes, (select count(*) from e) as n_edges, max(d) as max_degree, round(avg(d), 9) as avg_degree, sum(d * (d - 1) // 2)::bigint as two_stars from deg",
    "triangle_line": f"{_GRAPH}{_TRI} {_LINES}",
    "triangle_line_naive": f"{_GRAPH}{_sets(3)}{_kinds(3)}, tri as (select s from s3 where (select count(*) from e where list_contains(s, u) and list_contains(s, v)) = 3) {_LINES}",
    "edge_support": f"{_GRAPH}, {_SUPPORT} select u, v, t from support",
    "local_clustering": f"{_GRAPH}, closed as (select x.u, count(*) // 2 as t from adj x join adj y on x.u = y.u join adj z on z.u = x.v and z.v = y.v group by x.u) select deg.u as node, case when d > 1 then round(2.0::double * coalesce(t, 0) / (d * (d - 1)), 9) else 0.0 end as cc from deg left join closed using (u)",
    "global_clustering": f"{_GRAPH}, closed as (select x.u, count(*) // 2 as t from adj x join adj y on x.u = y.u join adj z on z.u = x.v and z.v = y.v group by x.u) select round(avg(case when d > 1 then 2.0::double * coalesce(t, 0) / (d * (d - 1)) else 0 end), 9) as avg_clustering, round(sum(coalesce(t, 0))::double / sum(d * (d - 1) // 2)::double, 9) as global_clustering from deg left join closed using (u)",
    "common2": f"{_GRAPH} select x.v as a, y.v as b, count(*) as n from adj x join adj y on x.u = y.u and x.v < y.v group by x.v, y.v",
    "common3": f"{_GRAPH}{_sets(3)} select s[1] as a, s[2] as b, s[3] as c, count(*) as n from s3 join adj x on x.u = s[1] join adj y on y.u = s[2] and y.v = x.v join adj z on z.u = s[3] and z.v = x.v group by s",
    "graphlet4": f"{_GRAPH}{_typed(4)} {_counts(4)}",
    "graphlet4_identities": f"{_GRAPH}{_typed(4)}, {_PER_EDGE} {_identities()}",
    "graphlet5": f"{_GRAPH}{_typed(5)} {_counts(5)}",
    "orbits4": f"{_all_orbits(4)} select node, orbit, cnt from long",
    "orbit_matrix4": _orbit_matrix(4, 14),
    "orbit_matrix5": _orbit_matrix(5, 72),
    "sets_orbits5": f"{_GRAPH}{_typed(5)}, {_orbit_dim(5)} {_orbits(5)}",
    "two_paths": f"{_GRAPH} select x.v as a, y.v as b, count(*) as n from adj x join adj y on x.u = y.u and x.v < y.v where (x.v, y.v) not in (select (u, v) from e) group by x.v, y.v",
    "edge_order": f"{_GRAPH} select row_number() over (order by a.d + b.d desc, e.u desc, e.v desc) - 1 as place, e.u, e.v, a.d + b.d as bound from e join deg a on a.u = e.u join deg b on b.u = e.v",
    "reweight4": f"{_GRAPH}{_typed(4)} {_REWEIGHT}",
    "report4": f"{_GRAPH}{_typed(4)} select type, rpad(name, 20, ' ') || lpad(cnt::varchar, 20, ' ') || lpad(printf('%.6f', cnt::double / (select count(*) from typed4)), 12, ' ') as line from ({_counts(4)})",
    "constants": f"select c.*, coalesce(n.cnt, 0)::bigint as cnt from ({_values(list(CONSTANTS))}) c(k, type, signature, beta, walk_div, phi, parts, reweight) left join ({_SIZES}) n on n.k = c.k and n.type = c.type",
    "text_scan": _SCAN,
    "truth_table": f"select 'shipped' as graph, k, type, cnt from ({_SIZES})",
    "metric_log": _metric_log(),
    "count_sweep": " union all ".join(f"select * from ({_metrics(n, SEED + i)})" for i, n in enumerate(SWEEP)),
    "unit_errors": f"{_GRAPH}{_estimates(3)} select variant, type, round(sqrt(avg(pow(estimate / cnt - 1, 2))), 6) as NRMSE from est join (select type, count(*)::double as cnt from typed3 group by type) using (type) group by variant, type",
    "state_trace": f"{_GRAPH}{_state_walk(5)}, visit as (select sim, step, node, lag(node) over (partition by sim order by step) as before from walk) select sim, step, array_to_string(s, ',') as nodes, type from visit join state on id = node left join pairs on pairs.u = before and pairs.v = node",
    "copurchase_edges": f"{_DENSE} select u, v from e",
    "copurchase_degrees": f"{_DENSE} select u as node, d from deg",
    "copurchase_triangle_line": f"{_DENSE}{_TRI} {_LINES}",
    "copurchase_edge_support": f"{_DENSE}, {_SUPPORT} select u, v, t from support",
    "copurchase_clustering": f"{_DENSE}, closed as (select x.u, count(*) // 2 as t from adj x join adj y on x.u = y.u join adj z on z.u = x.v and z.v = y.v group by x.u) select round(avg(case when d > 1 then 2.0::double * coalesce(t, 0) / (d * (d - 1)) else 0 end), 9) as avg_clustering, round(sum(t) / sum(d * (d - 1) // 2), 9) as global_clustering from deg left join closed using (u)",
    "copurchase_graphlet4": _DENSE4,
    "neighbor_sides": f"{_GRAPH}, {_SIDES} select u, v, x, side from sides",
    "edge_stats": f"{_GRAPH}, {_SIDES} {_EDGE_STATS}",
    "graphlet4_by_edges": f"{_GRAPH}{_typed(4)} {_counts(4)}",
    "cliques4": f"{_GRAPH}{_typed(4)} select s[1] as x, s[2] as y, s[3] as z, s[4] as w from typed4 where type = 5",
    "concentration_metrics": _concentration_metrics(4),
    "orbits5": f"{_GRAPH}{_typed(5)}, {_orbit_dim(5)} {_orbits(5)}",
    "orbit_totals4": f"{_GRAPH}{_typed(4)} select kind.type, count(s) as cnt from kind left join typed4 using (type) group by kind.type",
    "orbit_totals5": f"{_GRAPH}{_typed(5)} select kind.type, count(s) as cnt from kind left join typed5 using (type) group by kind.type",
    "walk_trace": f"{_GRAPH}{_walk('adj', STEPS)} select sim, step, node from walk",
    "edges_hat": f"{_GRAPH}{_walk('adj', STEPS + 1)} select sim, round((select count(*) from deg)::double * count(*) / sum(1.0::double / d) / 2, 6) as e_hat from walk join deg on node = deg.u group by sim",
    "error_metrics": _metrics(),
    "truth_lookup": _GRAPH + _NODE_TRUTH,
}
for _k in (3, 4, 5):
    _total = f"(select count(*) from typed{_k})"
    _conc = "SRW" if _k == 3 else "SRWIMPR"
    ORACLE_SQL |= {
        f"graphlet_gfd{_k}": f"{_GRAPH}{_typed(_k)} select type, round(cnt::double / {_total}, 9) as freq from ({_counts(_k)})",
        f"cis{_k}": f"{_GRAPH}{_typed(_k)} select array_to_string(s, ',') as nodes, type from typed{_k}",
        f"frames{_k}_twin": f"{_GRAPH}{_typed(_k)} select type, cnt::double as basic, cnt::double as improved from ({_counts(_k)})",
        f"est{_k}_count": f"{_GRAPH}{_estimates(_k)} select sim, variant, type, estimate from est",
        f"est{_k}_conc": f"{_GRAPH}{_estimates(_k)} select sim, type, round(estimate / sum(estimate) over (partition by sim), 6) as value from est where variant = '{_conc}'",
        f"state_adj{_k - 1}": f"{_GRAPH}{_states(_k)} select u, v, type from pairs",
        f"psrw{_k}": f"{_GRAPH}{_state_walk(_k)}, move as (select sim, node as u, lead(node) over (partition by sim order by step) as v from walk), tally as (select sim, type, count(*) as n from move join pairs using (u, v) group by sim, type), share as (select sim, kind.type, coalesce(n, 0)::double / walk_div as x from range({SIMS}) r(sim) cross join kind left join tally using (sim, type)) select sim, type, round(x / sum(x) over (partition by sim), 6) as value from share",
    }
