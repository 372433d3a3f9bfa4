"""Oracle SQL (DuckDB) for seeded random formation and the search steps.

Random draws are the same md5 values as the DataFrame code; attempts and
genes are expanded into rows, Floyd's sampling is a recursive CTE.
"""

from __future__ import annotations

import re

from basketry.functions.rng import DRAW_SPAN, sql_draw, sql_draw_mod
from basketry.operators.slicing import UNIVERSE_BUCKETS
from basketry.plans.oracle import lookback_ctes

D = "double"
LO, HI = "cast(0.01 as double)", "cast(0.25 as double)"


def universe_index_ctes() -> list[tuple[str, str]]:
    return [
        ("iu", "select dt, win, symbol, mean, adj_close, currency, row_number() over (partition by dt, win order by "
               f"{sql_draw_mod('0', 'universe', str(UNIVERSE_BUCKETS), 'symbol')}, symbol) - 1 as pos from universe"),
        ("sizes", "select dt, win, count(*) as m from universe group by dt, win"),
    ]


def floyd_cte(name: str, src: str, purpose: str, keys: list[str], size: str) -> tuple[str, str]:
    """Recursive CTE: rows of ``src`` (with seed, m, ``size``) -> acc list of positions."""
    k = ", ".join(keys)
    t = sql_draw_mod("seed", purpose, "j + 1", *keys, "j")
    return (name, f"""
select {k}, seed, m, m - {size} as j, cast([] as bigint[]) as acc from {src} where {size} > 0
union all
select {k}, seed, m, j + 1,
       case when list_contains(acc, {t}) then list_append(acc, j) else list_append(acc, {t}) end
from {name} where j < m""")


def constrained_ctes(x: str, individuals: str, purpose: str) -> list[tuple[str, str]]:
    """Random constrained portfolios for ``individuals`` (scenario_id, generation,
    indiv_id, dt, win, n_assets, seed) -> {x}_rc rows."""
    keys = ["scenario_id", "generation", "indiv_id"]
    k = ", ".join(keys)
    gene = sql_draw_mod("seed", f"{purpose}:gene", "1000", *keys, "k")
    return [
        (f"{x}_ind", f"select i.scenario_id, i.generation, i.indiv_id, i.dt, i.win, i.n_assets, i.seed, z.m "
                     f"from {individuals} i join sizes z using (dt, win)"),
        (f"{x}_gk", f"select *, unnest(range(0, n_assets)) as k from {x}_ind"),
        (f"{x}_g", f"select *, {gene} as g from {x}_gk"),
        (f"{x}_w0", f"""
select *, {LO} + (cast(1.0 as {D}) - cast(n_assets as {D}) * {LO}) * cast(g + 1 as {D}) / cast(sum(g + 1) over w as {D}) as w0
from {x}_g window w as (partition by {k})"""),
        (f"{x}_w1", f"""
select {k}, list_reduce(list(greatest(w0 - {HI}, cast(0 as {D})) order by k), lambda a, b: a + b) as excess,
       list_reduce(list({HI} - least(w0, {HI}) order by k), lambda a, b: a + b) as room
from {x}_w0 group by {k}"""),
        (f"{x}_w", f"""
select {k}, z.k, least(z.w0, {HI}) + case when o.room > 0 then o.excess * ({HI} - least(z.w0, {HI})) / o.room else cast(0 as {D}) end as weight
from {x}_w0 z join {x}_w1 o using ({k})"""),
        floyd_cte(f"{x}_fl", f"{x}_ind", f"{purpose}:pos", keys, "least(n_assets, m)"),
        (f"{x}_pos", f"""
select i.scenario_id, i.generation, i.indiv_id, i.dt, i.win, unnest(f.acc) as pos, generate_subscripts(f.acc, 1) - 1 as slot
from {x}_fl f join {x}_ind i using ({k}) where f.j = f.m"""),
        (f"{x}_rc", f"""
select p.scenario_id, p.generation, p.indiv_id, cast(p.slot as integer) as slot, u.symbol, w.weight,
       u.adj_close as price, u.currency, u.mean
from {x}_pos p join {x}_w w on w.scenario_id = p.scenario_id and w.generation = p.generation
     and w.indiv_id = p.indiv_id and w.k = p.slot
join iu u on u.dt = p.dt and u.win = p.win and u.pos = p.pos"""),
    ]


def init_ctes() -> list[tuple[str, str]]:
    return universe_index_ctes() + [
        ("inds0", "select scenario_id, cast(0 as integer) as generation, unnest(range(0, pop_size)) as indiv_id, "
                  "formation_date as dt, win, n_assets, seed from scenarios"),
    ] + constrained_ctes("ini", "inds0", "init") + [
        ("pop0", "select scenario_id, generation, indiv_id, symbol, weight, price, currency, mean from ini_rc"),
    ]


def unconstrained_ctes() -> list[tuple[str, str]]:
    """random_unconstrained: binomial inverse-CDF size, Floyd positions, hash weights."""
    u = f"cast({sql_draw('seed', 'unc:thin', 'scenario_id')} as {D}) / {DRAW_SPAN!r}"
    p = "cast(0.25 as double)"
    return universe_index_ctes() + [
        ("uc0", f"select s.scenario_id, s.formation_date as dt, s.win, s.n_assets, s.seed, z.m, {u} as u "
                f"from scenarios s join sizes z on z.dt = s.formation_date and z.win = s.win"),
        ("ucb", f"""
select scenario_id, 0 as k, pow(cast(1 as {D}) - {p}, cast(m as {D})) as pmf, pow(cast(1 as {D}) - {p}, cast(m as {D})) as cdf,
       case when pow(cast(1 as {D}) - {p}, cast(m as {D})) > u then 0 end as hit, n_assets, m, u from uc0
union all
select scenario_id, k + 1,
       pmf * (cast(m as {D}) - cast(k as {D})) / cast(k + 1 as {D}) * ({p} / (cast(1 as {D}) - {p})),
       cdf + pmf * (cast(m as {D}) - cast(k as {D})) / cast(k + 1 as {D}) * ({p} / (cast(1 as {D}) - {p})),
       case when hit is null and cdf + pmf * (cast(m as {D}) - cast(k as {D})) / cast(k + 1 as {D}) * ({p} / (cast(1 as {D}) - {p})) > u
            then k + 1 else hit end, n_assets, m, u
from ucb where k + 1 < n_assets"""),
        ("ucsize", "select scenario_id, least(coalesce(max(hit), any_value(n_assets)), any_value(m)) as kk from ucb group by scenario_id"),
        ("uc1", "select u.*, z.kk from uc0 u join ucsize z using (scenario_id)"),
        floyd_cte("ucfl", "uc1", "unc:pos", ["scenario_id"], "kk"),
        ("ucpos", """
select u.scenario_id, u.dt, u.win, unnest(f.acc) as pos, generate_subscripts(f.acc, 1) - 1 as slot, u.seed
from ucfl f join uc1 u using (scenario_id) where f.j = f.m"""),
        ("unc", f"""
select p.scenario_id, cast(1 as bigint) as portfolio_id, i.symbol,
       (cast({sql_draw('p.seed', 'unc:weight', 'p.scenario_id', 'p.slot')} as {D}) / {DRAW_SPAN!r})
         / cast(sum(cast(cast({sql_draw('p.seed', 'unc:weight', 'p.scenario_id', 'p.slot')} as {D}) / {DRAW_SPAN!r} as decimal(38,18)))
                over (partition by p.scenario_id) as double) as weight,
       i.adj_close as price, i.currency, i.mean
from ucpos p join iu i on i.dt = p.dt and i.win = p.win and i.pos = p.pos"""),
    ]


def variance_identity_ctes(p: str, keys: str) -> list[tuple[str, str]]:
    """{p}_fit: keys, ret, variance, fitness (linear) from {p}_complete (lookback_ctes)."""
    return [
        (f"{p}_pd", f"select {keys}, dt, sum(weight * ror) as pr from {p}_complete group by {keys}, dt"),
        (f"{p}_var", f"select {keys}, var_samp(pr) as variance from {p}_pd group by {keys}"),
        (f"{p}_ret", f"select {keys}, sum(mean * weight) as ret from {p} group by {keys}"),
        (f"{p}_fit", f"""
select r.{keys.split(',')[0].strip()}, r.{keys.split(',')[1].strip()}, r.ret, v.variance,
       r.ret * cast(0.75 as {D}) - v.variance * cast(0.25 as {D}) as fitness
from {p}_ret r left join {p}_var v using ({keys})"""),
    ]


def eval_ctes(p: str) -> list[tuple[str, str]]:
    """{p}_eval: fitness by each scenario's type, from {p}_fit ("return" scenarios have no variance)."""
    return [(f"{p}_eval", f"""
select f.scenario_id, f.indiv_id, f.ret, case when s.fitness_type = 'linear' then f.variance end as variance,
       case when s.fitness_type = 'linear' then f.fitness else f.ret end as fitness
from {p}_fit f join scenarios s using (scenario_id)""")]


def step_ctes(gen: int = 0) -> list[tuple[str, str]]:
    """rank -> parents -> roulette pairs -> cuts -> children -> mutation -> next generation,
    from pop0_fit / pop0 (generation ``gen``)."""
    g = str(gen)
    pk = ["scenario_id", "indiv_id"]
    cut = sql_draw_mod("c.seed", "cut", "c.nexp", "c.scenario_id", g, "c.pair")
    ua = sql_draw("s.seed", "pair:a", "s.scenario_id", g, "s.pair")
    ub = sql_draw("a.seed", "pair:b", "a.scenario_id", g, "a.pair")
    mut = sql_draw_mod("s.seed", "mut", "100", "c.scenario_id", g, "c.indiv_id")
    mgene = sql_draw_mod("any_value(seed)", "mut:gene", "sum(tickets)", "scenario_id", g, "indiv_id")
    mweight = sql_draw_mod("g.seed", "mut:weight", "g.v", "g.scenario_id", g, "g.indiv_id")
    return [
        ("ranked", "select *, row_number() over (partition by scenario_id order by fitness desc nulls last, indiv_id) as rank "
                   "from pop0_eval"),
        ("parents", "select r.* from ranked r join scenarios s using (scenario_id) where r.rank <= floor(s.pop_size * 0.5)"),
        ("tickets", f"""
select p.*, cast(floor(case when s.fitness_type = 'linear'
                 then ((p.fitness - cast(-10000.0 as {D})) * cast(9999.0 as {D})) / cast(20000.0 as {D}) + cast(1.0 as {D})
                 else p.fitness - least(min(p.fitness) over (partition by p.scenario_id), cast(0 as {D})) end
                 * cast(1000000.0 as {D})) as bigint) as t0
from parents p join scenarios s using (scenario_id)"""),
        ("tk", """
select scenario_id, indiv_id, rank, coalesce(greatest(t0, 0), 0) + 1 as tickets,
       sum(coalesce(greatest(t0, 0), 0) + 1) over (partition by scenario_id order by rank rows between unbounded preceding and current row) as hi,
       sum(coalesce(greatest(t0, 0), 0) + 1) over (partition by scenario_id) as total
from tickets"""),
        ("pairs0", """
select s.scenario_id, s.seed, t.total, unnest(range(0, cast(floor((s.pop_size - floor(s.pop_size * 0.5) - 1) / 2) as bigint) + 1)) as pair
from scenarios s join (select distinct scenario_id, total from tk) t using (scenario_id)"""),
        ("pairs1", f"select s.*, {ua} % s.total as u_a from pairs0 s"),
        ("pairs2", """
select p.*, k.indiv_id as indiv_a, k.hi - k.tickets as lo_a, k.tickets as t_a
from pairs1 p join tk k on k.scenario_id = p.scenario_id and p.u_a >= k.hi - k.tickets and p.u_a < k.hi"""),
        ("pairs3", f"select a.*, {ub} % (a.total - a.t_a) as ub0 from pairs2 a"),
        ("pairs", """
select p.scenario_id, cast(p.pair as integer) as pair, p.indiv_a, k.indiv_id as indiv_b
from (select *, case when ub0 >= lo_a then ub0 + t_a else ub0 end as u_b from pairs3) p
join tk k on k.scenario_id = p.scenario_id and p.u_b >= k.hi - k.tickets and p.u_b < k.hi"""),
        ("hold", """
select *, row_number() over (partition by scenario_id, indiv_id order by symbol) as asc_rank,
       count(*) over (partition by scenario_id, indiv_id) as cnt from pop0"""),
        ("hold2", "select *, cnt - asc_rank + 1 as desc_rank from hold"),
        ("ivs", """
select p.scenario_id, p.pair, a.desc_rank as lo, s.n_assets - b.asc_rank as hi
from pairs p join scenarios s using (scenario_id)
join hold2 a on a.scenario_id = p.scenario_id and a.indiv_id = p.indiv_a
join hold2 b on b.scenario_id = p.scenario_id and b.indiv_id = p.indiv_b and b.symbol = a.symbol
union all
select p.scenario_id, p.pair, b.desc_rank as lo, s.n_assets - a.asc_rank as hi
from pairs p join scenarios s using (scenario_id)
join hold2 a on a.scenario_id = p.scenario_id and a.indiv_id = p.indiv_a
join hold2 b on b.scenario_id = p.scenario_id and b.indiv_id = p.indiv_b and b.symbol = a.symbol"""),
        ("validcuts", """
select p.scenario_id, p.pair, r.r
from pairs p join scenarios s using (scenario_id), lateral (select unnest(range(1, s.n_assets + 1)) as r) r
where not exists (select 1 from ivs v where v.scenario_id = p.scenario_id and v.pair = p.pair and r.r between v.lo and v.hi)"""),
        ("expanded", """
select scenario_id, pair, r, row_number() over (partition by scenario_id, pair order by r) - 1 as ord,
       count(*) over (partition by scenario_id, pair) as nexp
from (select scenario_id, pair, r from validcuts union all select scenario_id, pair, r from validcuts where r = 1) t"""),
        ("cuts", f"""
select c.scenario_id, c.pair, p.indiv_a, p.indiv_b, cast(c.r as integer) as cut
from (select e.*, s.seed from expanded e join scenarios s using (scenario_id)) c
join pairs p on p.scenario_id = c.scenario_id and p.pair = c.pair
where c.ord = {cut}"""),
        ("kids0", """
select c.scenario_id, c.pair * 2 + 1 as indiv_id, h.symbol, h.weight, h.price, h.currency, h.mean
from cuts c join hold2 h on h.scenario_id = c.scenario_id and h.indiv_id = c.indiv_a where h.desc_rank <= c.cut
union all
select c.scenario_id, c.pair * 2 + 1, h.symbol, h.weight, h.price, h.currency, h.mean
from cuts c join scenarios s using (scenario_id) join hold2 h on h.scenario_id = c.scenario_id and h.indiv_id = c.indiv_b
where h.asc_rank <= s.n_assets - c.cut
union all
select c.scenario_id, c.pair * 2 + 2, h.symbol, h.weight, h.price, h.currency, h.mean
from cuts c join hold2 h on h.scenario_id = c.scenario_id and h.indiv_id = c.indiv_b where h.desc_rank <= c.cut
union all
select c.scenario_id, c.pair * 2 + 2, h.symbol, h.weight, h.price, h.currency, h.mean
from cuts c join scenarios s using (scenario_id) join hold2 h on h.scenario_id = c.scenario_id and h.indiv_id = c.indiv_a
where h.asc_rank <= s.n_assets - c.cut"""),
        ("kids", f"""
select scenario_id, cast({gen + 1} as integer) as generation, cast(indiv_id as bigint) as indiv_id, symbol,
       weight / cast(sum(cast(weight as decimal(38,18))) over (partition by scenario_id, indiv_id) as double) as weight,
       price, currency, mean
from kids0"""),
        ("mflag", f"""
select c.*, s.seed, s.mutation_rate, s.n_assets, s.formation_date as dt, s.win,
       cast({mut} as {D}) / cast(100.0 as {D}) < s.mutation_rate as is_mut
from kids c join scenarios s using (scenario_id)"""),
        ("mh", """
select *, row_number() over (partition by scenario_id, indiv_id order by weight desc, symbol) - 1 as idx,
       count(*) over (partition by scenario_id, indiv_id) as cnt,
       sum(weight) over (partition by scenario_id, indiv_id) as total
from mflag where is_mut"""),
        ("mstat", """
select scenario_id, indiv_id, any_value(seed) as seed, any_value(cnt) as cnt, any_value(total) as total,
       max(case when idx = 0 then weight end) as w0, max(case when idx = 1 then weight end) as w1,
       max(case when idx = cnt - 1 then weight end) as wl, max(case when idx = cnt - 2 then weight end) as wl2
from mh group by scenario_id, indiv_id"""),
        ("mvalid", f"""
select scenario_id, indiv_id, gi, k, row_number() over (partition by scenario_id, indiv_id, gi order by k) - 1 as ord from (
  select h.scenario_id, h.indiv_id, h.idx as gi, r.k, cast(r.k as {D}) / cast(1000.0 as {D}) as nw,
         (h.total - h.weight) + cast(r.k as {D}) / cast(1000.0 as {D}) as s2, h.cnt,
         case when h.idx = 0 then m.w1 else m.w0 end as mx, case when h.idx = h.cnt - 1 then m.wl2 else m.wl end as mn
  from mh h join mstat m using (scenario_id, indiv_id),
       (select unnest(list_prepend(1, range(1, 250))) as k) r) q
where nw / s2 >= {LO} and nw / s2 <= {HI} and (cnt = 1 or (mn / s2 >= {LO} and mx / s2 <= {HI}))"""),
        ("mgene", f"""
select scenario_id, indiv_id, gi, v, seed, cast(floor((cast(1 as {D}) - m16 * m4) * cast(1000000000 as {D})) as bigint) as tickets from (
  select *, m4 * m4 * (m4 * m4) as m16 from (
    select *, miss * miss * (miss * miss) as m4 from (
      select v.scenario_id, v.indiv_id, v.gi, count(*) as v, any_value(m.seed) as seed,
             cast(1 as {D}) - cast(count(*) as {D}) / cast(250 as {D}) as miss
      from mvalid v join mstat m using (scenario_id, indiv_id) group by v.scenario_id, v.indiv_id, v.gi) a) b) c"""),
        ("mu", f"select scenario_id, indiv_id, {mgene} as u from mgene group by scenario_id, indiv_id"),
        ("mpick", f"""
select g.scenario_id, g.indiv_id, g.gi, cast(v.k as {D}) / cast(1000.0 as {D}) as nw
from (select *, sum(tickets) over (partition by scenario_id, indiv_id order by gi rows unbounded preceding) as hi from mgene) g
join mu using (scenario_id, indiv_id)
join mvalid v on v.scenario_id = g.scenario_id and v.indiv_id = g.indiv_id and v.gi = g.gi and v.ord = {mweight}
where mu.u < g.hi and mu.u >= g.hi - g.tickets"""),
        ("mdone", """
select h.scenario_id, h.generation, h.indiv_id, h.symbol,
       case when h.idx = p.gi then p.nw else h.weight end / (h.total - o.weight + p.nw) as weight, h.price, h.currency, h.mean
from mh h join mpick p using (scenario_id, indiv_id)
join mh o on o.scenario_id = h.scenario_id and o.indiv_id = h.indiv_id and o.idx = p.gi"""),
        ("mlost", """
select distinct m.scenario_id, m.generation, m.indiv_id, m.dt, m.win, m.n_assets, m.seed
from mh m left join mpick p using (scenario_id, indiv_id) where p.gi is null"""),
    ] + constrained_ctes("mfb", "mlost", f"mutfb{gen}") + [
        ("mutated", """
select scenario_id, generation, indiv_id, symbol, weight, price, currency, mean from mflag where not is_mut
union all select * from mdone
union all select scenario_id, generation, indiv_id, symbol, weight, price, currency, mean from mfb_rc"""),
        ("immi", f"""
select scenario_id, cast({gen + 1} as integer) as generation,
       unnest(range(cast(1 + (floor((pop_size - floor(pop_size * 0.5) - 1) / 2) + 1) * 2 as bigint), cast(pop_size as bigint))) as indiv_id,
       formation_date as dt, win, n_assets, seed
from scenarios"""),
    ] + constrained_ctes("imm", "immi", "imm") + [
        ("nextgen", f"""
select p.scenario_id, cast({gen + 1} as integer) as generation, cast(0 as bigint) as indiv_id, p.symbol, p.weight, p.price, p.currency, p.mean
from pop0 p join ranked r on r.scenario_id = p.scenario_id and r.indiv_id = p.indiv_id and r.rank = 1
union all select * from mutated
union all select scenario_id, generation, indiv_id, symbol, weight, price, currency, mean from imm_rc"""),
    ]


def evolve_ctes(generations: int, keys: str = "scenario_id, indiv_id") -> list[tuple[str, str]]:
    """The whole search over ``scenarios``: pop_g0 .. pop_g{n}, ``history`` and ``best``.

    One generation's CTEs are those of the step queries, renamed per generation."""
    out = [(("pop_g0" if n == "pop0" else n), q) for n, q in init_ctes()]
    for g in range(generations):
        step = lookback_ctes("pop0", keys) + variance_identity_ctes("pop0", keys) + eval_ctes("pop0") + step_ctes(g)
        names = {n: f"{n}_g{g}" for n, _ in step} | {"pop0": f"pop_g{g}", "nextgen": f"pop_g{g + 1}"}
        pattern = re.compile(r"\b(" + "|".join(map(re.escape, names)) + r")\b")
        out += [(names[n], pattern.sub(lambda m: names[m[1]], q)) for n, q in step]  # noqa: B023
    last = f"pop_g{generations}"
    return out + [
        ("history", " union all ".join(
            f"select scenario_id, {g} as generation, max(fitness) as best_fitness from pop0_eval_g{g} group by scenario_id" for g in range(generations))),
        ("final_ret", f"select {keys}, sum(mean * weight) as ret from {last} group by {keys}"),
        ("final_rank", "select *, row_number() over (partition by scenario_id order by ret desc nulls last, indiv_id) as rank from final_ret"),
        ("best", f"""
select p.scenario_id, cast(2 as bigint) as portfolio_id, p.symbol, p.weight, p.price, p.currency, p.mean
from {last} p join final_rank r using (scenario_id, indiv_id) where r.rank = 1"""),
    ]
