"""Evolutionary search over one population table for all scenarios.

population: scenario_id, generation, indiv_id, symbol, weight, price, currency, mean
(one row per holding).  Each step below is one DataFrame transformation over
every scenario; the driver only counts generations and cuts lineage.

Draws are md5 functions of (seed, purpose, scenario, generation, ids), so a
retried task or a lost executor recomputes the same population.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.columns import exact_sum, let, ratio, rescale_range
from basketry.functions.rng import draw, draw_mod
from basketry.operators import risk
from basketry.operators.formation import OPTIMIZED, individuals_of, random_constrained
from basketry.operators.slicing import accepted, asked_folders, indexed_universe, lookback_bounds
from basketry.session import path_exists, remove_path, scratch_path, stage, stage_scratch
from basketry.sources.schemas import (RETURN_WEIGHT, RISK_WEIGHT, ROULETTE_NEW, ROULETTE_OLD,
                                      SELECTION_THRESHOLD, WEIGHT_CEILING, WEIGHT_FLOOR)

IKEYS = ["scenario_id", "indiv_id"]
POP_COLS = ["scenario_id", "generation", "indiv_id", "symbol", "weight", "price", "currency", "mean"]
TICKETS_PER_UNIT = 1_000_000
MUTATION_TRIES_PER_GENE = 20
MUTATION_DRAWS = 250             # new weights 0..249 thousandths, 0 read as 1
GENE_TICKETS = 1_000_000_000


def init_population(scenarios: DataFrame, flong: DataFrame, iu: DataFrame | None = None) -> DataFrame:
    """pop_size random constrained portfolios per scenario (generation 0)."""
    iu = iu if iu is not None else _cut(indexed_universe(scenarios, flong))
    r = random_constrained(individuals_of(scenarios, 0), iu, "init")
    return r.select(*POP_COLS)


# ------------------------------------------------------------------ fitness

def fitness_return(pop: DataFrame) -> DataFrame:
    """scenario_id, indiv_id, ret."""
    return risk.portfolio_return(pop, IKEYS)


def fitness_linear(pop: DataFrame, scenarios: DataFrame, flong: DataFrame,
                   a: float = RETURN_WEIGHT, b: float = RISK_WEIGHT) -> DataFrame:
    """scenario_id, indiv_id, ret, variance, fitness = a*ret - b*variance."""
    r = fitness_return(pop)
    v = risk.portfolio_variance(pop, scenarios, flong, IKEYS, store=False).select(*IKEYS, "variance")
    j = r.join(v, IKEYS, "left")
    return j.withColumn("fitness", F.col("ret") * F.lit(a) - F.col("variance") * F.lit(b))


def evaluate_population(pop: DataFrame, scenarios: DataFrame, flong: DataFrame,
                        fitness_type: Column | None = None) -> DataFrame:
    """scenario_id, indiv_id, ret, variance, fitness by each scenario's fitness type
    ("return" or "linear"; scenarios of any other type get no rows, and
    validate_scenarios names them).  The variance is computed only for scenarios
    that use it."""
    ft = fitness_type if fitness_type is not None else F.col("fitness_type")
    s = scenarios.select("scenario_id", ft.alias("_ft"))
    tagged = pop.join(s, "scenario_id")
    lin = tagged.filter(F.col("_ft") == "linear").drop("_ft")
    ret = tagged.filter(F.col("_ft") == "return").drop("_ft")
    a = fitness_linear(lin, scenarios, flong)
    b = fitness_return(ret).select(*IKEYS, "ret", F.lit(None).cast("double").alias("variance"),
                                   F.col("ret").alias("fitness"))
    return a.select(*IKEYS, "ret", "variance", "fitness").unionByName(b)


def rank_population(fit: DataFrame) -> DataFrame:
    """+ rank: 1 = best fitness; NULL fitness last; indiv_id breaks ties."""
    w = Window.partitionBy("scenario_id").orderBy(F.col("fitness").desc_nulls_last(), "indiv_id")
    return fit.withColumn("rank", F.row_number().over(w))


def select_parents(ranked: DataFrame, scenarios: DataFrame, threshold: float = SELECTION_THRESHOLD) -> DataFrame:
    """Truncation selection: rank <= floor(pop_size * threshold)."""
    s = scenarios.select("scenario_id", "pop_size")
    keep = F.floor(F.col("pop_size") * F.lit(threshold))
    return ranked.join(s, "scenario_id").filter(F.col("rank") <= keep).drop("pop_size")


def elite(ranked: DataFrame) -> DataFrame:
    """The best individual of each scenario."""
    return ranked.filter(F.col("rank") == 1)


def roulette_tickets(parents: DataFrame, scenarios: DataFrame) -> DataFrame:
    """parents + tickets, lo, hi, total: integer roulette intervals [lo, hi).

    "linear" fitness is first mapped [-10000, 10000] -> [1, 10000] as in the
    reference; "return" fitness is shifted so the smallest is at least 0 (a
    negative value would break the cumulative scan).  Every parent gets one
    extra ticket, so each has a non-empty interval; weights below 0 count as 0."""
    s = scenarios.select("scenario_id", "fitness_type")
    p = parents.join(s, "scenario_id")
    w_all = Window.partitionBy("scenario_id")
    shifted = F.col("fitness") - F.least(F.min("fitness").over(w_all), F.lit(0.0))
    v = F.when(F.col("fitness_type") == "linear",
               rescale_range(F.col("fitness"), ROULETTE_OLD[0], ROULETTE_OLD[1], ROULETTE_NEW[0], ROULETTE_NEW[1])
               ).otherwise(shifted)
    # clamp at 0: "linear" fitness below -10000 maps below the new range (no clamping in the map itself)
    raw = F.greatest(F.floor(v * F.lit(float(TICKETS_PER_UNIT))).cast("bigint"), F.lit(0).cast("bigint"))
    p = p.withColumn("tickets", F.coalesce(raw, F.lit(0).cast("bigint")) + 1)
    w = Window.partitionBy("scenario_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumn("hi", F.sum("tickets").over(w)).withColumn("lo", F.col("hi") - F.col("tickets"))
    return p.withColumn("total", F.sum("tickets").over(w_all)).drop("fitness_type")


def _bucketed(t: DataFrame) -> DataFrame:
    """Parents' ticket intervals cut into buckets of width ceil(total / n_parents).

    Each parent spans at most tickets/width + 2 buckets, so a scenario has at
    most 3 x n_parents bucket rows, and a draw finds its parent by an
    equi-join on (scenario, bucket) plus the interval test: O(pop), not
    O(pop^2), per scenario."""
    n_par = F.count(F.lit(1)).over(Window.partitionBy("scenario_id"))
    t = t.withColumn("width", F.greatest(F.ceil(F.col("total") / n_par), F.lit(1)).cast("bigint"))
    first, last = F.floor(F.col("lo") / F.col("width")), F.floor((F.col("hi") - 1) / F.col("width"))
    return t.withColumn("bucket", F.explode(F.sequence(first, last)))


def _pick(draws: DataFrame, buckets: DataFrame, u: str, out: str) -> DataFrame:
    b = buckets.select(F.col("scenario_id").alias("_s"), F.col("bucket").alias("_b"), F.col("indiv_id").alias(out),
                       F.col("lo").alias(f"lo_{out}"), F.col("hi").alias(f"hi_{out}"), F.col("tickets").alias(f"t_{out}"))
    d = draws.withColumn("_db", F.floor(F.col(u) / F.col("width")))
    j = d.join(b, (F.col("scenario_id") == F.col("_s")) & (F.col("_db") == F.col("_b"))
               & (F.col(u) >= F.col(f"lo_{out}")) & (F.col(u) < F.col(f"hi_{out}")))
    return j.drop("_s", "_b", "_db")


def roulette_pairs(parents: DataFrame, scenarios: DataFrame, generation: int) -> DataFrame:
    """scenario_id, pair, indiv_a, indiv_b: z+1 fitness-proportional pairs per scenario.

    z = (selection - 1) // 2 with selection = pop_size - floor(pop_size/2).  A
    is drawn on [0, total); B on [0, total - tickets_A) with A's interval
    skipped: the distribution of "redraw until B != A", without the loop."""
    t = roulette_tickets(parents, scenarios).select("scenario_id", "indiv_id", "lo", "hi", "tickets", "total")
    buckets = _bucketed(t)
    totals = buckets.select("scenario_id", "total", "width").distinct()
    s = scenarios.select("scenario_id", "seed", "pop_size")
    sel = F.col("pop_size") - F.floor(F.col("pop_size") * F.lit(SELECTION_THRESHOLD))
    z = F.floor((sel - 1) / 2).cast("int")
    pairs = s.join(totals, "scenario_id").select(
        "scenario_id", "seed", "total", "width", F.explode(F.sequence(F.lit(0), z)).alias("pair"))
    g = F.lit(generation)
    pairs = pairs.withColumn("u_a", F.pmod(draw(F.col("seed"), "pair:a", F.col("scenario_id"), g, F.col("pair")), F.col("total")))
    pa = _pick(pairs, buckets, "u_a", "indiv_a")
    u_b = F.pmod(draw(F.col("seed"), "pair:b", F.col("scenario_id"), g, F.col("pair")), F.col("total") - F.col("t_indiv_a"))
    pa = pa.withColumn("u_b", F.when(u_b >= F.col("lo_indiv_a"), u_b + F.col("t_indiv_a")).otherwise(u_b))
    pb = _pick(pa, buckets, "u_b", "indiv_b")
    return pb.select("scenario_id", F.col("pair").cast("int").alias("pair"), "indiv_a", "indiv_b")


# ---------------------------------------------------------------- crossover

def _ranked_holdings(pop: DataFrame) -> DataFrame:
    w = Window.partitionBy("scenario_id", "indiv_id")
    return pop.select("scenario_id", "indiv_id", "symbol", "weight", "price", "currency", "mean",
                      F.row_number().over(w.orderBy("symbol")).alias("asc_rank"),
                      F.count(F.lit(1)).over(w).alias("cnt")) \
              .withColumn("desc_rank", F.col("cnt") - F.col("asc_rank") + 1)


def crossover_cuts(pairs: DataFrame, pop: DataFrame, scenarios: DataFrame, generation: int) -> DataFrame:
    """scenario_id, pair, indiv_a, indiv_b, cut.

    Cut r in 1..n; child 1 = A's r largest symbols + B's n-r smallest, child 2
    the mirror.  r is invalid when a shared symbol s has descrank_A(s) <= r and
    ascrank_B(s) <= n-r (or A, B swapped): an interval of r per shared symbol.
    The cut is drawn among the valid ones, r = 1 twice (the reference maps a
    draw of 0 to 1); r = n is always valid."""
    # an individual's holdings lie in one array by symbol (at most n_assets), so the pairs are read once and no row
    # is made per shared symbol
    h = pop.groupBy("scenario_id", "indiv_id").agg(F.sort_array(F.collect_list(F.struct("symbol"))).alias("h"))
    h = h.select("scenario_id", "indiv_id", F.transform("h", lambda x, i: F.struct(
        x["symbol"].alias("symbol"), (i + 1).alias("asc"), (F.size("h") - i).alias("desc"))).alias("h"))
    p = pairs.join(scenarios.select("scenario_id", "n_assets", "seed"), "scenario_id")
    for side in ("a", "b"):
        p = p.join(h.select("scenario_id", F.col("indiv_id").alias(f"indiv_{side}"), F.col("h").alias(f"h_{side}")),
                   ["scenario_id", f"indiv_{side}"], "left")
    n = F.col("n_assets")
    ivs = F.flatten(F.transform("h_a", lambda a: F.flatten(F.transform(
        F.filter("h_b", lambda b: b["symbol"] == a["symbol"]),
        lambda b: F.array(F.struct(a["desc"].alias("lo"), (n - b["asc"]).alias("hi")),
                          F.struct(b["desc"].alias("lo"), (n - a["asc"]).alias("hi")))))))
    p = p.withColumn("ivs", ivs)
    ivcol = F.coalesce(F.col("ivs"), F.array().cast("array<struct<lo:int,hi:int>>"))
    valid = F.filter(F.sequence(F.lit(1), F.col("n_assets")),
                     lambda r: ~F.exists(ivcol, lambda iv: (r >= iv["lo"]) & (r <= iv["hi"])))
    expanded = F.concat(F.when(F.array_contains(valid, 1), F.array(F.lit(1))).otherwise(F.array().cast("array<int>")), valid)
    pick = draw_mod(F.col("seed"), "cut", F.size(expanded), F.col("scenario_id"), F.lit(generation), F.col("pair"))
    return p.select("scenario_id", "pair", "indiv_a", "indiv_b",
                    F.element_at(expanded, (pick + 1).cast("int")).cast("int").alias("cut"))


def crossover(cuts: DataFrame, pop: DataFrame, scenarios: DataFrame, generation: int) -> DataFrame:
    """Children (indiv_id 1+2*pair and 2+2*pair) with renormalised weights."""
    h = _ranked_holdings(pop)
    n = scenarios.select("scenario_id", "n_assets")
    c = cuts.join(n, "scenario_id")
    cols = ["symbol", "weight", "price", "currency", "mean"]
    # one row per parent: its largest symbols go to its own child, its smallest to the other parent's
    one, two = F.col("pair") * 2 + 1, F.col("pair") * 2 + 2
    parent = F.explode(F.array(F.struct(F.col("indiv_a").alias("indiv_id"), one.alias("own"), two.alias("other")),
                               F.struct(F.col("indiv_b").alias("indiv_id"), two.alias("own"), one.alias("other"))))
    c = c.select("scenario_id", "cut", (F.col("n_assets") - F.col("cut")).alias("rest"), parent.alias("p"))
    c = c.select("scenario_id", "cut", "rest", "p.indiv_id", "p.own", "p.other")
    child = F.array(F.when(F.col("desc_rank") <= F.col("cut"), F.col("own")), F.when(F.col("asc_rank") <= F.col("rest"), F.col("other")))
    kids = c.join(h, ["scenario_id", "indiv_id"]).select("scenario_id", F.explode(child).alias("indiv_id"), *cols)
    kids = kids.filter(F.col("indiv_id").isNotNull())
    total = exact_sum("weight").over(Window.partitionBy("scenario_id", "indiv_id")).cast("double")
    kids = kids.withColumn("weight", ratio(F.col("weight"), total))
    return kids.select("scenario_id", F.lit(generation + 1).alias("generation"),
                       F.col("indiv_id").cast("bigint").alias("indiv_id"), *cols)


# ----------------------------------------------------------------- mutation

def mutate(children: DataFrame, scenarios: DataFrame, iu: DataFrame, generation: int,
           lo: float = WEIGHT_FLOOR, hi: float = WEIGHT_CEILING) -> DataFrame:
    """Mutate each child with probability mutation_rate.

    A mutated child re-draws one gene's weight (1..249 thousandths) and is
    renormalised; every weight must then lie in [lo, hi].  Same distribution as
    "draw until valid, with a new gene every 20 tries", without attempts: gene
    g has v_g valid draws of 250, so it is the one that succeeds with weight
    1 - (1 - v_g/250)^20, and its weight is uniform over its valid draws.  Only
    a child without any valid (gene, draw) is replaced by a fresh portfolio."""
    s = scenarios.select("scenario_id", "seed", "mutation_rate", "n_assets", F.col("formation_date").alias("dt"), "win")
    g = F.lit(generation)
    ck = children.join(s, "scenario_id")
    ids = (F.col("scenario_id"), g, F.col("indiv_id"))
    m = draw_mod(F.col("seed"), "mut", 100, *ids)
    ck = ck.withColumn("_mut", (m.cast("double") / F.lit(100.0)) < F.col("mutation_rate"))
    keep = ck.filter(~F.col("_mut")).select(*POP_COLS)
    mut = ck.filter(F.col("_mut"))
    keys = ["scenario_id", "generation", "indiv_id", "seed", "n_assets", "dt", "win"]
    arr = mut.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(
        (-F.col("weight")).alias("nw"), "symbol", "weight", "price", "currency", "mean"))).alias("h"))
    # every value that is read more than once is bound by ``let``: computed once a row, not once a draw
    cnt = F.size("h")

    def valid_draws(p, i):
        """The valid new weights (in thousandths) of gene i, rising, 1 twice as it stands for two draws."""
        w = p["w"]
        mx = F.when(i == 0, F.try_element_at(w, F.lit(2))).otherwise(F.try_element_at(w, F.lit(1)))
        mn = F.when(i == cnt - 1, F.try_element_at(w, F.lit(-2))).otherwise(F.try_element_at(w, F.lit(-1)))
        others = F.struct((p["total"] - F.element_at(w, (i + 1).cast("int"))).alias("rest"), mn.alias("mn"), mx.alias("mx"))

        def ok(o, nw):
            def held(s2):
                rest_held = (cnt == 1) | ((o["mn"] / s2 >= lo) & (o["mx"] / s2 <= hi))
                return (nw / s2 >= lo) & (nw / s2 <= hi) & rest_held
            return let(o["rest"] + nw, held)

        every = F.concat(F.array(F.lit(1)), F.sequence(F.lit(1), F.lit(MUTATION_DRAWS - 1)))
        return let(others, lambda o: F.filter(every, lambda k: ok(o, k.cast("double") / F.lit(1000.0))))

    def tickets(draws):
        miss = F.lit(1.0) - F.size(draws).cast("double") / F.lit(float(MUTATION_DRAWS))
        m4 = miss * miss * (miss * miss)
        m16 = m4 * m4 * (m4 * m4)
        return F.floor((F.lit(1.0) - m16 * m4) * F.lit(float(GENE_TICKETS))).cast("bigint")

    assert MUTATION_TRIES_PER_GENE == 20  # the power that ``tickets`` spells out

    def gene(t):
        """The gene whose ticket interval holds u: as many genes as have their interval's end at or below u."""
        start = F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).alias("gi"))
        return let(draw_mod(F.col("seed"), "mut:gene", t["all"], *ids), lambda u: F.aggregate(t["tickets"], start, lambda a, x: F.struct(
            (a["end"] + x).alias("end"), (a["gi"] + F.when(a["end"] + x <= u, 1).otherwise(0)).alias("gi")), lambda a: a["gi"]))

    def weight(draws):
        pick = draw_mod(F.col("seed"), "mut:weight", F.size(draws), *ids)
        return F.element_at(draws, (pick + 1).cast("int")).cast("double") / F.lit(1000.0)

    def redrawn(p, draws, t):
        """gi, nw, s2: the gene, its new weight and the new sum; NULL without any valid (gene, draw)."""
        found = let(gene(t), lambda gi: let(weight(F.element_at(draws, gi + 1)), lambda nw: F.struct(
            gi.alias("gi"), nw.alias("nw"), (p["total"] - F.element_at(p["w"], gi + 1) + nw).alias("s2"))))
        return F.when(t["all"] > 0, found)

    def with_tickets(draws, body):
        return let(F.transform(draws, tickets), lambda x: let(F.struct(
            x.alias("tickets"), F.aggregate(x, F.lit(0).cast("bigint"), lambda a, y: a + y).alias("all")), body))

    weights = F.struct(F.col("h.weight").alias("w"), F.aggregate(F.col("h.weight"), F.lit(0.0), lambda a, x: a + x).alias("total"))
    arr = arr.withColumn("m", let(weights, lambda p: let(
        F.transform(F.sequence(F.lit(0), cnt - 1), lambda i: valid_draws(p, i)),
        lambda draws: with_tickets(draws, lambda t: redrawn(p, draws, t)))))
    # rows of a child come out of the array with their weight and whether there is one: a filter on them does not
    # go below the array, where it would compute the draws again
    rows = F.transform("h", lambda x, i: F.struct(
        F.col("m").isNotNull().alias("found"), i.alias("i"), x["symbol"].alias("symbol"),
        (F.when(i == F.col("m.gi"), F.col("m.nw")).otherwise(x["weight"]) / F.col("m.s2")).alias("weight"),
        x["price"].alias("price"), x["currency"].alias("currency"), x["mean"].alias("mean")))
    ex = arr.select(*keys, F.explode_outer(rows).alias("x"))
    done = ex.filter("x.found").select("scenario_id", "generation", "indiv_id", *[f"x.{c}" for c in POP_COLS[3:]])
    lost = ex.filter("not x.found and x.i = 0").select("scenario_id", "generation", "indiv_id", "dt", "win", "n_assets", "seed")
    fresh = random_constrained(lost, iu, f"mutfb{generation}").select(*POP_COLS)
    return keep.unionByName(done.select(*POP_COLS)).unionByName(fresh)


def immigrants(scenarios: DataFrame, iu: DataFrame, generation: int) -> DataFrame:
    """Fresh random constrained portfolios for slots 1 + 2(z+1) .. pop_size-1."""
    sel = F.col("pop_size") - F.floor(F.col("pop_size") * F.lit(SELECTION_THRESHOLD))
    first_slot = F.lit(1) + (F.floor((sel - 1) / 2) + 1) * 2
    slots = F.when(first_slot <= F.col("pop_size") - 1,
                   F.sequence(first_slot.cast("bigint"), (F.col("pop_size") - 1).cast("bigint"))
                   ).otherwise(F.array().cast("array<bigint>"))
    ind = scenarios.select("scenario_id", F.lit(generation + 1).alias("generation"),
                           F.explode(slots).alias("indiv_id"),
                           F.col("formation_date").alias("dt"), "win", "n_assets", "seed")
    return random_constrained(ind, iu, "imm").select(*POP_COLS)


def next_generation(pop: DataFrame, fit: DataFrame, scenarios: DataFrame, iu: DataFrame, generation: int) -> DataFrame:
    """Elite (indiv 0) + mutated crossover children + immigrants (lazy form)."""
    return generation_step(pop, fit, scenarios, iu, generation, cut=lambda d: d)


def _cut(df: DataFrame) -> DataFrame:
    """Lineage cut: a Parquet table in the shared checkpoint folder (survives executor loss)."""
    return stage_scratch(df, "search")


def lookback_returns(scenarios: DataFrame, flong: DataFrame) -> DataFrame:
    """symbol, dt, win, ror of the windows and the span of dates that the scenarios look back on.

    Cut once per run, so every generation's evaluation reads this narrow table
    instead of re-deriving the feature panel.  The span is one row a window."""
    span = lookback_bounds(scenarios).groupBy("win").agg(F.min("left_date").alias("_l"), F.max("right_date").alias("_r"))
    parts = [c for c in ("year",) if c in flong.columns]
    if parts:  # the folders of the stored panel: a row a window and year
        span = span.filter(F.col("_l").isNotNull()).select("*", F.explode(F.sequence(F.year("_l"), F.year("_r"))).alias("year"))
        flong = asked_folders(flong, span)
    j = flong.select("symbol", "dt", "win", "ror", *parts).join(F.broadcast(span), ["win", *parts]).drop(*parts)
    return j.filter(F.col("dt").between(F.col("_l"), F.col("_r"))).drop("_l", "_r")


def generation_step(pop: DataFrame, fit: DataFrame, scenarios: DataFrame, iu: DataFrame,
                    generation: int, cut=_cut) -> DataFrame:
    """next_generation with the crossover children materialised before mutation
    (mutation reads them more than once)."""
    ranked = rank_population(fit)
    best = elite(ranked).select("scenario_id", "indiv_id")
    el = pop.join(best, IKEYS).select("scenario_id", F.lit(generation + 1).alias("generation"),
                                      F.lit(0).cast("bigint").alias("indiv_id"), *POP_COLS[3:])
    pairs = roulette_pairs(select_parents(ranked, scenarios), scenarios, generation)
    kids = cut(crossover(crossover_cuts(pairs, pop, scenarios, generation), pop, scenarios, generation))
    return el.unionByName(mutate(kids, scenarios, iu, generation)).unionByName(immigrants(scenarios, iu, generation))


HISTORY = "scenario_id bigint, generation int, best_fitness double, runtime_s double"
HISTORY_COLS = ["scenario_id", "generation", "best_fitness", "runtime_s"]


def _last_whole(spark, root: str, n_gen: int) -> int | None:
    """The last generation whose population is wholly written below ``root``."""
    return next((g for g in range(n_gen, -1, -1) if path_exists(spark, f"{root}/g{g}/population/_SUCCESS")), None)


def evolve(scenarios: DataFrame, flong: DataFrame, final_fitness: str = "return",
           run_dir: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Run the search for every valid scenario at once.

    Returns (best, population, history): ``best`` the final portfolio per
    scenario in the portfolios layout (portfolio_id 2); ``population`` the last
    generation; ``history`` (scenario_id, generation, best_fitness, runtime_s).
    Scenarios that break a rule are left out; ``validate_scenarios`` names them
    with their reasons.  The loop runs max(generations) steps; a scenario stops
    evolving after its own count.  Each step is a fixed set of jobs whatever the
    population size, n_assets or number of scenarios.

    Scenarios, universe and returns are written once as Parquet below the shared
    checkpoint folder; population, fitness and children once a generation, and
    those of a generation are removed when the one after the next is written.
    History is one folder a generation.

    ``run_dir`` names the folder instead, and a run that was broken off there goes
    on from its last whole generation, with the universe and returns that it
    began with: draws depend on ids alone, so its rows are those of an unbroken
    run (but runtime_s).  Other scenarios than the run began with are an error."""
    spark = scenarios.sparkSession
    root = run_dir.rstrip("/") if run_dir else scratch_path(spark, "evolve")

    def cut(make, name):
        path = f"{root}/{name}"
        if run_dir and path_exists(spark, f"{path}/_SUCCESS"):
            return spark.read.parquet(path)
        if run_dir:
            remove_path(spark, path)
        return stage(make(), path)

    def keep_history(g, fit, seconds):
        (fit.groupBy("scenario_id").agg(F.max("fitness").alias("best_fitness"))
            .select("scenario_id", "best_fitness", F.lit(seconds).cast("double").alias("runtime_s"))
            .write.mode("overwrite").parquet(f"{root}/history/generation={g}"))

    began = accepted(scenarios)
    scen = cut(lambda: began, "scenarios")
    if run_dir and not (scen.exceptAll(began).isEmpty() and began.exceptAll(scen).isEmpty()):
        raise ValueError(f"{root} holds a run of other scenarios")
    iu = cut(lambda: indexed_universe(scen, flong), "universe")
    rets = cut(lambda: lookback_returns(scen, flong), "returns")
    n_gen = scen.agg(F.max("generations")).first()[0] or 0
    start = _last_whole(spark, root, n_gen) if run_dir else None
    pop = cut(lambda: init_population(scen, flong, iu), f"g{start or 0}/population")
    if start and not path_exists(spark, f"{root}/history/generation={start - 1}/_SUCCESS"):
        keep_history(start - 1, spark.read.parquet(f"{root}/g{start - 1}/fitness"), None)
    for g in range(start or 0, n_gen):
        t0 = time.perf_counter()
        active = scen.filter(F.col("generations") > g)
        fit = cut(lambda: evaluate_population(pop.join(active.select("scenario_id"), "scenario_id", "left_semi"), active, rets), f"g{g}/fitness")  # noqa: B023
        nxt = generation_step(pop, fit, active, iu, g, cut=lambda d, g=g: cut(lambda: d, f"g{g}/children"))
        frozen = pop.join(active.select("scenario_id"), "scenario_id", "left_anti")
        pop = cut(lambda: nxt.unionByName(frozen), f"g{g + 1}/population")  # noqa: B023
        keep_history(g, fit, round(time.perf_counter() - t0, 3))
        if g:
            remove_path(spark, f"{root}/g{g - 1}")
    final = cut(lambda: evaluate_population(pop, scen, rets, F.lit(final_fitness)), f"final-{final_fitness}")
    best = rank_population(final).filter(F.col("rank") == 1).select("scenario_id", "indiv_id")
    port = pop.join(best, IKEYS).select("scenario_id", F.lit(OPTIMIZED).cast("bigint").alias("portfolio_id"),
                                        "symbol", "weight", "price", "currency", "mean")
    hist = spark.read.schema(HISTORY).parquet(f"{root}/history").select(*HISTORY_COLS) if n_gen else spark.createDataFrame([], HISTORY)
    return port, pop, hist
