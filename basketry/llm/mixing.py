"""Mixing sources to target weights by entropy balancing.

Document rates are the closest ones to "take everything once", in bounded
relative entropy, under two overlapping sets of constraints: every source gives
its target of words (met exactly), and every size class keeps, over all
sources, the share of words that it has in the corpus (met up to a stated
slack, since the targets may not allow it).  So a mix that favours a source of
short documents takes more of that source's long ones.

The dual of this convex problem has one variable a source and one a class; joint
Newton steps solve it.  The rate of a document is the exponential tilt
``most / (1 + (most - 1) exp(-x))`` with x the sum of its source's and its
class's dual, so none exceeds ``most``.

Rates are then rounded into copies: within a source, documents run from long
to short and systematic rounding keeps the running number of copies within one
of its rate; single-class corrections bring the words taken near the target.
Everything works on counts of (source, size), and equal rows are counted before
they meet.  DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import n_words, staged

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: How loosely class shares are kept: a class may miss its words by this part of them for each unit of its dual.
SLACK = 0.1
#: Newton steps end by themselves; reaching this bound is an error.
NEWTON_STEPS = 100
#: Largest gap of a constraint, as a part of its words, that counts as met.
TOLERANCE = 1e-8
#: Classes that a balance may have: their system of equations is solved in one place.
MOST_CLASSES = 256
#: Documents of one class that a task ranks; larger classes are dealt out over more buckets.
CLASS_ROWS = 256


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from one row a source with its ``source_size``.

    Sources in code-point order, null last, take ``weights`` in turn and
    ``share`` of all words by weight.  A source stops at ``most`` times its
    size; what is left goes to the others by weight.  Water level: sources
    sorted by size / weight fill up one after the other, so the level is found
    by cumulative sums and one filter.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    turn = (F.row_number().over(order) - 1) % len(weights)
    s = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * float(most)).withColumn("ratio", F.col("cap") / F.col("weight"))
    by = Window.orderBy("ratio", F.col("source").isNull(), F.col("source").cast("binary"))
    up_to = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy()
    s = (s.withColumn("full", F.sum("cap").over(up_to) - F.col("cap"))
         .withColumn("open", F.sum("weight").over(whole) - F.sum("weight").over(up_to) + F.col("weight"))
         .withColumn("total", F.sum("source_size").over(whole) * share))
    # the level if all sources before this one are full and this one is not; it is true for the first source that holds it,
    # and that is the highest level that its own source holds
    s = s.withColumn("level", (F.col("total") - F.col("full")) / F.col("open"))
    level = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(whole)
    return s.withColumn("water", level).select(
        "source", "source_size", F.when(F.col("water").isNull() | (F.col("ratio") <= F.col("water")), F.col("cap"))
        .otherwise(F.col("weight") * F.col("water")).alias("target"))


def _rate(x: Column, most: int) -> Column:
    """The tilt of a rate of one by exp(x), below ``most``."""
    return most / (1 + (most - 1) * F.exp(-x))


def _exact(x: Column) -> Column:
    """Sum in decimals, so that it does not depend on the order of the rows and reruns agree."""
    return F.sum(x.cast("decimal(38,10)")).cast("double")


def size_class(size: Column) -> Column:
    """Sizes by powers of four: the classes whose share of all words is kept (32 at most)."""
    return F.floor(F.log(size + 1.0) / F.log(F.lit(4.0))).cast("int")


def _total(cells: Column, field: str) -> Column:
    return F.aggregate(cells, F.lit(0.0), lambda s, c: s + c[field])


def _by_class(values: dict) -> Column:
    """A small map of class to number; classes that it does not name have 0."""
    if not values:
        return F.create_map().cast("map<int,double>")
    return F.create_map(*[F.lit(v) for kv in sorted(values.items()) for v in kv])


def _at_duals(table: DataFrame, mu: dict, most: int) -> DataFrame:
    """``table`` (source, need, words, dual, cells) with words taken and slope of each cell, and gap and slope of the source.

    Sources that need nothing, or ``most`` times everything, have that rate
    whatever the duals are: their slope is 0."""
    tilt, free = _by_class(mu), (F.col("need") > 0) & (F.col("need") < most)

    def cell(c):
        x = F.col("dual") + F.coalesce(F.element_at(tilt, c["class"]), F.lit(0.0))
        rate = F.when(free, _rate(x, most)).when(F.col("need") <= 0, 0.0).otherwise(float(most))
        return F.struct(c["class"].alias("class"), c["words"].alias("words"), rate.alias("rate"))

    def sums(c):
        slope = F.when(free, c["words"] * c["rate"] * (1 - c["rate"] / most)).otherwise(0.0)
        return F.struct(c["class"].alias("class"), c["words"].alias("words"), (c["words"] * c["rate"]).alias("taken"), slope.alias("slope"))

    t = table.withColumn("at", F.transform(F.transform("cells", cell), sums))
    gap = F.when(free, F.col("need") * F.col("words") - _total(F.col("at"), "taken")).otherwise(0.0)
    return t.withColumn("gap", gap).withColumn("slope", _total(F.col("at"), "slope"))


def _class_system(at: DataFrame) -> tuple[dict, dict]:
    """Class sums (taken, slope, part of the gap) and the products of slopes by pair of classes, summed over sources.

    One grouped pass each over one row a source; classes are few, so are these sums."""
    per = F.when(F.col("slope") > 0, 1 / F.col("slope")).otherwise(0.0)
    one = at.select("gap", per.alias("per"), F.explode("at").alias("a"))
    one = one.groupBy(F.col("a.class").alias("a"), F.lit(None).cast("int").alias("b")).agg(
        _exact(F.col("a.taken")).alias("v"), _exact(F.col("a.slope")).alias("slope"), _exact(F.col("a.slope") * F.col("gap") * F.col("per")).alias("part"))
    two = at.where("slope > 0").select(per.alias("per"), "at", F.explode("at").alias("a")).select("per", "a", F.explode("at").alias("b"))
    two = two.where("a.class <= b.class").groupBy(F.col("a.class").alias("a"), F.col("b.class").alias("b")).agg(
        _exact(F.col("a.slope") * F.col("b.slope") * F.col("per")).alias("v"), F.lit(0.0).alias("slope"), F.lit(0.0).alias("part"))
    rows = one.unionByName(two).collect()
    return {r.a: r for r in rows if r.b is None}, {(r.a, r.b): r.v for r in rows if r.b is not None}


def _solved(matrix: list[list[float]], right: list[float]) -> list[float]:
    """Solution of a small positive definite system, by elimination."""
    m, x = [row[:] + [r] for row, r in zip(matrix, right)], [0.0] * len(right)
    for i, pivot in enumerate(m):
        for row in m[i + 1:]:
            f = row[i] / pivot[i]
            for j in range(i, len(row)):
                row[j] -= f * pivot[j]
    for i in reversed(range(len(x))):
        x[i] = (m[i][-1] - sum(m[i][j] * x[j] for j in range(i + 1, len(x)))) / m[i][i]
    return x


def balanced_rates(classes: DataFrame, goals: DataFrame, most: int = MOST, steps: int = NEWTON_STEPS, slack: float = SLACK) -> DataFrame:
    """(source, class, size, n, rate): rates closest to 1 that give every source its target and keep class shares.

    ``classes`` (source, class, size, n) with any whole-number class, 256 of them
    at most; ``goals`` (source, source_size, target).  With w words in a cell
    (source s, class c), W_c in a class, T asked of all sources, the dual

        sum need_s W_s l_s + sum goal_c m_c - slack / 2 sum W_c m_c^2 - sum w P(l_s + m_c),   goal_c = T W_c / sum W,

    has P' = rate.  Its Hessian is diagonal in the sources, so a joint Newton step
    solves for the class duals first (the Schur complement, summed over sources
    in one pass) and each source then follows in its own row.  P is self-concordant
    in the sense that its third derivative stays below its second, for which steps of log(1 + d) / d, with d the
    largest change of any x, converge from everywhere.

    Sources that ask for nothing or for ``most`` times everything have their
    limit as rate and count in the classes as given.  Null sources are one
    source; documents without words are left out; an empty table gives no rows.
    """
    rows = classes.where("size > 0")
    cells = rows.groupBy("source", "class").agg(F.sum(F.col("n") * F.col("size")).cast("double").alias("words"))
    table = cells.groupBy("source").agg(F.sum("words").alias("words"), F.sort_array(F.collect_list(F.struct("class", "words"))).alias("cells"))
    g = goals.select(F.col("source").alias("s"), F.least(F.col("target") / F.col("source_size"), F.lit(float(most))).alias("need"))
    flat = F.when((F.col("need") > 0) & (F.col("need") < most), F.log(F.col("need") * (most - 1) / (most - F.col("need")))).otherwise(0.0)
    table = table.join(g, table["source"].eqNullSafe(g["s"])).select("source", "need", "words", flat.alias("dual"), "cells")
    table = staged(table, "mix-duals")
    sums = table.select("need", F.explode("cells").alias("c")).groupBy("c.class").agg(
        _exact(F.col("c.words")).alias("words"), _exact(F.col("c.words") * F.col("need")).alias("asked")).limit(MOST_CLASSES + 1).collect()
    if len(sums) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes")
    words = {r["class"]: r.words for r in sums}
    share = sum(r.asked for r in sums) / (sum(words.values()) or 1.0)
    names, mu = sorted(words), dict.fromkeys(words, 0.0)
    for _ in range(steps if names else 0):
        at = _at_duals(table, mu, most)
        one, two = _class_system(at)
        ahead = {c: share * words[c] - one[c].v - slack * words[c] * mu[c] for c in names}
        matrix = [[-two.get((min(a, b), max(a, b)), 0.0) + (one[a].slope + slack * words[a] if a == b else 0.0) for b in names] for a in names]
        step = dict(zip(names, _solved(matrix, [ahead[c] - one[c].part for c in names])))
        change = F.aggregate("at", F.lit(0.0), lambda s, c: s + c["slope"] * F.element_at(_by_class(step), c["class"]))  # noqa: B023
        at = at.withColumn("step", F.when(F.col("slope") > 0, (F.col("gap") - change) / F.col("slope")).otherwise(0.0))
        moved = F.transform("at", lambda c: F.abs(F.col("step") + F.element_at(_by_class(step), c["class"])))  # noqa: B023
        worst = at.agg(F.max(F.abs("gap") / F.col("words")).alias("gap"), F.max(F.when(F.col("slope") > 0, F.array_max(moved))).alias("move")).first()
        if worst.gap <= TOLERANCE and all(abs(ahead[c]) <= TOLERANCE * words[c] for c in names):
            break
        most_moved = max(worst.move or 0.0, *map(abs, step.values()))
        part = math.log1p(most_moved) / most_moved
        mu = {c: mu[c] + part * step[c] for c in names}
        table = staged(at.select("source", "need", "words", (F.col("dual") + part * F.col("step")).alias("dual"), "cells"), "mix-duals")
    else:
        if names:
            raise RuntimeError(f"the balance did not converge in {steps} Newton steps")
    at = _at_duals(table, mu, most).select(F.col("source").alias("s"), F.explode("at").alias("a"))
    at = at.select("s", F.col("a.class").alias("c"), (F.col("a.taken") / F.col("a.words")).alias("rate"))
    return rows.join(at, rows["source"].eqNullSafe(at["s"]) & (rows["class"] == at["c"])).select("source", "class", "size", "n", "rate")


def class_copies(rates: DataFrame, goals: DataFrame, most: int = MOST) -> DataFrame:
    """(source, size, n, copies): whole copies that all documents of a class take together.

    Each round of corrections brings at least one source strictly nearer to its
    target, by whole words, so the rounds end by themselves."""
    # copies up to a class, long documents first, in millionths and rounded: within half a copy of the rates
    run = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    goal = F.col("n") * F.round(F.col("rate") * 1_000_000).cast("long")
    c = rates.withColumn("goal", goal).withColumn("upto", F.sum("goal").over(run))
    copies = F.expr("(upto + 500000) div 1000000 - (upto - goal + 500000) div 1000000")
    c = c.withColumn("copies", F.greatest(F.lit(0), F.least(copies, F.col("n") * most)))
    c = staged(c.select("source", "size", "n", "copies"), "mix-copies")
    while True:
        gap = c.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken")).withColumnRenamed("source", "s")
        gap = gap.join(goals, gap["s"].eqNullSafe(goals["source"])).select("s", (F.col("target") - F.col("taken")).alias("gap"))
        at = c.join(gap, c["source"].eqNullSafe(gap["s"]))
        # copies that this class alone could add (or give back) without passing the target
        room = F.when(F.col("gap") > 0, F.col("n") * most - F.col("copies")).otherwise(F.col("copies"))
        moves = F.least(room, F.floor(F.abs("gap") / F.col("size") + 0.5)).cast("long")
        left = F.abs(F.abs("gap") - moves * F.col("size"))
        at = at.withColumn("moves", moves).withColumn("left", left)
        best = at.where("moves > 0 and left < abs(gap)").groupBy(F.col("source").alias("s2")).agg(
            F.min(F.struct("left", "size", "moves")).alias("b"))
        best = staged(best, "mix-moves")
        if best.isEmpty():
            break
        signed = F.when(F.col("gap") > 0, F.col("b.moves")).otherwise(-F.col("b.moves"))
        j = at.join(best, at["source"].eqNullSafe(best["s2"]), "left")
        c = staged(j.select("source", "size", "n", F.when(F.col("size") == F.col("b.size"), F.col("copies") + signed).otherwise(F.col("copies")).alias("copies")), "mix-copies")
    return c


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    return docs.select(docs[id_col].alias("doc_id"), docs[source_col].cast("string").alias("source"), n_words(docs[text_col]).alias("size"))


def mixed(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 42, class_rows: int = CLASS_ROWS) -> DataFrame:
    """Copies of each (doc_id, source, size) row: doc_id, source, size, source_size, target, copies, repeats.

    ``rows`` is as ``sized`` gives it.  Equal rows come out as one or two
    rows with their number in ``repeats``.  In a class (source, size) the
    documents that take one copy more than the others are the first by a seeded
    hash of doc_id, so reruns agree.
    """
    groups = staged(rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("m")), "mix-groups")
    classes = staged(groups.groupBy("source", "size").agg(F.sum("m").alias("n")), "mix-sizes")
    goals = staged(targets(classes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most), "mix-targets")
    rates = balanced_rates(classes.withColumn("class", size_class(F.col("size"))), goals, most)
    copies = class_copies(rates, goals, most)
    # documents without words take part in no constraint: once each
    copies = copies.unionByName(classes.where("size = 0").withColumn("copies", F.col("n")))
    g = goals.select(F.col("source").alias("gs"), "source_size", "target")
    c = copies.join(g, copies["source"].eqNullSafe(g["gs"])).select(
        F.col("source").alias("cs"), F.col("size").alias("cz"), "source_size", "target",
        F.expr("copies div n").alias("base"), (F.col("copies") % F.col("n")).alias("extra"),
        F.ceil(F.col("n") / class_rows).cast("long").alias("buckets"))
    at = groups.join(c, groups["source"].eqNullSafe(c["cs"]) & (groups["size"] == c["cz"])).drop("cs", "cz")
    lot = F.xxhash64(F.lit(seed), "doc_id")
    at = at.withColumn("lot", lot).withColumn("bucket", F.pmod(lot, F.col("buckets")))
    key = ["source", "size", "bucket"]
    inside = Window.partitionBy(*key).orderBy("lot", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = at.groupBy(*key).agg(F.sum("m").alias("rows"))
    across = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumn("before", F.sum("rows").over(across) - F.col("rows")).drop("rows")
    counts = counts.select(*[F.col(k).alias(f"_{k}") for k in key], "before")
    ranked = at.withColumn("upto", F.sum("m").over(inside))
    ranked = ranked.join(counts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")) & (F.col("bucket") == F.col("_bucket")))
    first = F.col("before") + F.col("upto") - F.col("m")
    lucky = F.greatest(F.lit(0), F.least(F.col("m"), F.col("extra") - first))
    ranked = ranked.withColumn("parts", F.array(F.struct((F.col("base") + 1).alias("copies"), lucky.alias("repeats")),
                                                F.struct(F.col("base").alias("copies"), (F.col("m") - lucky).alias("repeats"))))
    return ranked.select("doc_id", "source", "size", "source_size", "target", F.explode("parts").alias("p")).where("p.repeats > 0").select(
        "doc_id", "source", "size", "source_size", "target", "p.copies", "p.repeats")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 42,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Words that the mix takes of every document.

    Returns doc_id, size (words), source_size, target (of its source), taken
    (copies times size), copies.

    A null text has size 0; documents without words take no part in a
    constraint and are taken once (0 words); a null source is a source of its
    own, last in order; repeated rows come back as often as they are there; an
    empty table gives an empty result; other columns are ignored.
    """
    out = mixed(sized(docs, id_col, text_col, source_col), weights, share, most, seed)
    out = out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies",
                     F.explode(F.sequence(F.lit(1), F.col("repeats"))).alias("_i"))
    return out.drop("_i")


def mixed_documents(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 42,
                    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Every document as often as the mix takes it, all columns as they are.

    Copies are found on slim rows (a hash of id and text, source, size) and
    joined to the documents once.  Rows with one key share its copies: each has
    as many as all have, divided by their number, and the first ones in
    the order of all their columns one more.  They are ranked by a second hash in
    buckets, so many rows of one key are not one task.

    Rows that are equal in id and text and differ elsewhere are documents of
    their own, also if their keys collide.  A null text has size 0 and stays
    once; null ids and sources are values like others; very long texts go through
    the join once; an empty table gives an empty result; extra columns stay,
    whatever their names.
    """
    key = F.xxhash64(docs[id_col], docs[text_col])
    wide = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), key.alias("_key"),
                       docs[source_col].cast("string").alias("_source"), n_words(docs[text_col]).alias("_size"))
    return _copied(wide, weights, share, most, seed)


def _copied(wide: DataFrame, weights, share: float, most: int, seed: int) -> DataFrame:
    """The rows of ``wide`` (row, _key, _source, _size) as often as the mix takes them."""
    slim = wide.select(F.col("_key").alias("doc_id"), F.col("_source").alias("source"), F.col("_size").alias("size"))
    taken = mixed(slim, weights, share, most, seed).groupBy("doc_id", "source", "size").agg(
        F.sum("repeats").alias("m"), F.sum(F.col("repeats") * F.col("copies")).alias("total"))
    taken = staged(taken.select(F.col("doc_id").alias("k"), F.col("source").alias("s"), F.col("size").alias("z"), "m", "total"), "mix-taken")
    on = (F.col("_key") == F.col("k")) & (F.col("_size") == F.col("z")) & F.col("_source").eqNullSafe(F.col("s"))
    alone = wide.join(taken.where("m = 1 and total > 0"), on).select("row", F.col("total").alias("copies"))
    several = taken.where("m > 1 and total > 0")
    if not several.isEmpty():
        # equal rows are one with their number, so a hot row is folded before it is ranked or multiplied
        key = ["_key", "_source", "_size"]
        alike = wide.join(several, on).groupBy(*key, "row").agg(F.count("*").alias("n"), F.max("m").alias("m"), F.max("total").alias("total"))
        alike = alike.withColumn("_digest", F.xxhash64(F.lit(seed), "row"))
        alike = staged(alike.withColumn("_bucket", F.pmod("_digest", F.lit(256))), "mix-alike")
        before = Window.partitionBy(*key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = alike.groupBy(*key, "_bucket").agg(F.sum("n").alias("rows")).select(
            *[F.col(c).alias(f"{c}2") for c in (*key, "_bucket")], F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
        inside = Window.partitionBy(*key, "_bucket").orderBy("_digest", "row").rowsBetween(Window.unboundedPreceding, -1)
        ranked = alike.withColumn("first", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(
            sums, F.expr("_key = _key2 and _source <=> _source2 and _size = _size2 and _bucket = _bucket2"))
        extra = F.greatest(F.lit(0), F.least(F.col("n"), F.col("total") % F.col("m") - F.col("before") - F.col("first")))
        alone = alone.unionByName(ranked.select("row", (F.col("n") * F.expr("total div m") + extra).alias("copies")).where("copies > 0"))
    return alone.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_i")).select("row.*")
