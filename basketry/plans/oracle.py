"""Oracle SQL (DuckDB dialect) for the registered queries.

Written independently of the DataFrame code: as-of lookups use DuckDB's
ASOF JOIN, variance uses the pairwise covariance form, random draws are
expanded into rows.  Fragments are CTEs over the driver's views.
"""

from __future__ import annotations

from basketry.functions.rng import sql_draw, sql_draw_mod
from basketry.plans.scenarios import sql_scenario_grid
from basketry.sources.fixtures import SQL_FX, SQL_PANEL, SQL_PANEL_RAW  # noqa: F401
from basketry.sources.schemas import HORIZONS, LOOKBACK_DAYS, WINDOWS


def with_ctes(ctes: list[tuple[str, str]], final: str, recursive: bool = False, materialized: bool = False) -> str:
    """``materialized``: every CTE but the self-referencing ones is computed once (long chains)."""
    import re
    as_ = lambda n, q: "as materialized" if materialized and not re.search(rf"from {n}\b", q) else "as"
    body = ",\n".join(f"{n} {as_(n, q)} (\n{q.strip()}\n)" for n, q in ctes)
    return f"with {'recursive ' if recursive else ''}{body}\n{final.strip()}"


def features_sql(src: str = "panel") -> list[tuple[str, str]]:
    lags = ",\n       ".join(
        f"(adj_close - lag(adj_close, {k}) over w) / nullif(lag(adj_close, {k}) over w, 0) * 100 as ror_{k}"
        for k in WINDOWS)
    stats = ",\n       ".join(
        [f"stddev_samp(ror_{k}) over (partition by symbol order by dt rows between {k} preceding and current row) as std_{k}"
         for k in WINDOWS]
        + [f"avg(ror_{k}) over (partition by symbol order by dt rows between {k} preceding and current row) as mean_{k}"
           for k in WINDOWS])
    rors = ", ".join(f"ror_{k}" for k in WINDOWS)
    return [
        ("prices_c", f"""
select translate(symbol, '.', '_') as symbol, dt,
       max(struct_pack(volume := volume, adj_close := adj_close, index_name := index_name, currency := currency)) as b
from {src} group by translate(symbol, '.', '_'), dt"""),
        ("prices", "select symbol, dt, b.adj_close as adj_close, b.volume as volume, b.index_name as index_name, b.currency as currency from prices_c"),
        ("f1", f"""
select symbol, dt, adj_close, volume, index_name, currency,
       cast(year(dt) as integer) as year, cast(month(dt) as integer) as month, cast(day(dt) as integer) as day,
       {lags}
from prices window w as (partition by symbol order by dt)"""),
        ("features", f"""
select symbol, dt, adj_close, volume, index_name, currency, year, month, day, {rors},
       {stats}
from f1"""),
        ("flong", "\nunion all\n".join(
            f"select symbol, dt, {k} as win, ror_{k} as ror, std_{k} as std, mean_{k} as mean, adj_close, currency from features"
            for k in WINDOWS)),
    ]


def base_ctes(with_fx: bool = True, **scen) -> list[tuple[str, str]]:
    c = [("panel_raw", SQL_PANEL_RAW), ("panel", SQL_PANEL)]
    if with_fx:
        c.append(("fx", SQL_FX))
    c += features_sql("panel")
    c.append(("scenarios", sql_scenario_grid("panel", **scen)))
    c.append(("universe", """
select f.dt, f.win, f.symbol, f.mean, f.adj_close, f.currency
from flong f where f.mean is not null
  and exists (select 1 from scenarios s where s.formation_date = f.dt and s.win = f.win)"""))
    return c


def bh_ctes() -> list[tuple[str, str]]:
    return [
        ("ranked", "select *, row_number() over (partition by dt, win order by mean desc, symbol) as rank from universe"),
        ("bh", """
select s.scenario_id, cast(0 as bigint) as portfolio_id, r.symbol, 1.0 / cast(s.n_assets as double) as weight,
       r.adj_close as price, r.currency, r.mean
from scenarios s join ranked r on r.dt = s.formation_date and r.win = s.win
where r.rank <= s.n_assets"""),
    ]


def lookback_ctes(portfolios: str, keys: str = "scenario_id, portfolio_id") -> list[tuple[str, str]]:
    days = " ".join(f"when {k} then {d}" for k, d in LOOKBACK_DAYS.items())
    return [
        (f"{portfolios}_bounds", f"""
select scenario_id, win, formation_date, formation_date - cast(case win {days} end as integer) as left_date,
       formation_date + 1 as right_date from scenarios"""),
        (f"{portfolios}_rets", f"""
select p.scenario_id, p.symbol, f.dt, f.ror
from (select distinct scenario_id, symbol from {portfolios}) p
join {portfolios}_bounds b on b.scenario_id = p.scenario_id
join flong f on f.symbol = p.symbol and f.win = b.win and f.dt between b.left_date and b.right_date"""),
        (f"{portfolios}_nheld", f"select {keys}, count(*) as n_held from {portfolios} group by {keys}"),
        (f"{portfolios}_x", f"""
select {', '.join('p.' + k.strip() for k in keys.split(','))}, p.symbol, p.weight, r.dt, r.ror
from {portfolios} p join {portfolios}_rets r on r.scenario_id = p.scenario_id and r.symbol = p.symbol"""),
        (f"{portfolios}_ok", f"""
select x.{keys.split(',')[0].strip()}, {', '.join('x.' + k.strip() for k in keys.split(',')[1:])}, x.dt
from {portfolios}_x x join {portfolios}_nheld n using ({keys})
group by {', '.join('x.' + k.strip() for k in keys.split(','))}, x.dt, n.n_held
having count(x.ror) = n.n_held"""),
        (f"{portfolios}_complete", f"select x.* from {portfolios}_x x join {portfolios}_ok o using ({keys}, dt)"),
    ]


def variance_pairwise_ctes(portfolios: str, keys: str = "scenario_id, portfolio_id") -> list[tuple[str, str]]:
    """Variance as Σ_i Σ_j w_i w_j covar_samp(r_i, r_j) over complete dates."""
    k = [c.strip() for c in keys.split(",")]
    on = " and ".join(f"a.{c} = b.{c}" for c in k)
    return [
        (f"{portfolios}_cov", f"""
select {', '.join('a.' + c for c in k)}, a.symbol as symbol_i, b.symbol as symbol_j,
       covar_samp(a.ror, b.ror) as cov, corr(a.ror, b.ror) as corr,
       any_value(a.weight) as wi, any_value(b.weight) as wj
from {portfolios}_complete a join {portfolios}_complete b on {on} and a.dt = b.dt
group by {', '.join('a.' + c for c in k)}, a.symbol, b.symbol"""),
        (f"{portfolios}_var", f"""
select {keys}, sum(wi * wj * cov) as variance from {portfolios}_cov group by {keys}"""),
    ]


def shares_ctes(portfolios: str) -> list[tuple[str, str]]:
    return [
        (f"{portfolios}_shares", f"""
select p.*, s.budget, s.fee, s.n_assets, s.formation_date,
       cast(trunc(p.weight * cast(s.budget as double) / nullif(p.price, 0)) as bigint) as shares
from {portfolios} p join scenarios s using (scenario_id)"""),
    ]


def value_ctes(portfolios: str, dates: str) -> list[tuple[str, str]]:
    """Value of {portfolios}_shares at (scenario_id, val_dt) rows of ``dates``."""
    return [
        (f"{portfolios}_hold", f"""
select sh.scenario_id, sh.portfolio_id, sh.symbol, sh.shares, sh.currency, d.val_dt
from {portfolios}_shares sh join {dates} d using (scenario_id)"""),
        (f"{portfolios}_priced", f"""
select h.*, p.dt as price_dt, p.adj_close as price
from {portfolios}_hold h asof left join prices p on h.symbol = p.symbol and h.val_dt >= p.dt"""),
        (f"{portfolios}_rated", f"""
select q.*, case when q.currency = 'EUR' then 1.0 else f.adj_close end as rate
from {portfolios}_priced q asof left join (select * from fx where to_ccy = 'EUR') f
  on q.currency = f.from_ccy and q.price_dt >= f.dt"""),
        (f"{portfolios}_value", f"""
select scenario_id, portfolio_id, val_dt,
       case when count(comp) = count(*) then sum(comp) end as value, count(*) as n_held, count(comp) as n_priced
from (select *, case when currency = 'EUR' then shares * price else (price * rate) * shares end as comp
      from {portfolios}_rated) t
group by scenario_id, portfolio_id, val_dt"""),
    ]


def roi_ctes(portfolios: str) -> list[tuple[str, str]]:
    hz = ", ".join(f"('{a}', {d})" for a, d in HORIZONS)
    return shares_ctes(portfolios) + [
        ("ends", f"""
select s.scenario_id, h.horizon, s.formation_date + cast(h.days as integer) as end_date
from scenarios s, (values {hz}) h(horizon, days)"""),
        ("vdates", """
select distinct scenario_id, val_dt from (
  select scenario_id, end_date as val_dt from ends
  union all select scenario_id, formation_date as val_dt from scenarios) t"""),
    ] + value_ctes(portfolios, "vdates") + [
        (f"{portfolios}_roi", f"""
select e.scenario_id, st.portfolio_id, e.horizon, e.end_date,
       st.value - cast(s.fee * s.n_assets as double) as start_value, en.value as end_value,
       (en.value - (st.value - cast(s.fee * s.n_assets as double))) / nullif(st.value - cast(s.fee * s.n_assets as double), 0) as roi
from ends e join scenarios s using (scenario_id)
join {portfolios}_value st on st.scenario_id = e.scenario_id and st.val_dt = s.formation_date
join {portfolios}_value en on en.scenario_id = e.scenario_id and en.portfolio_id = st.portfolio_id and en.val_dt = e.end_date"""),
    ]


__all__ = ["SQL_PANEL_RAW", "with_ctes", "features_sql", "base_ctes", "bh_ctes", "lookback_ctes", "variance_pairwise_ctes",
           "shares_ctes", "value_ctes", "roi_ctes", "sql_draw", "sql_draw_mod"]
