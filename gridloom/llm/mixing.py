"""Mixing sources to target token weights by entropy balancing.

Document rates minimise their relative entropy to one copy each, under one token
constraint per source and at most ``most`` copies of a document.  The dual is convex
and separates by source: a document of z times its source's mean size gets the rate
``min(most, exp(lambda_s * z))``, and lambda_s is found by Newton steps, kept inside
a bracket, on log tokens.  Rates depend on (source, size) only, so each step is one
aggregation over the counts of those pairs, not over documents.

Rates become copies by systematic rounding along (source, size): the error of a
source stays below one document, and that rest is taken from, or cut off, one
document.  Every choice follows a hash of doc_id, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, materialize, running_sum

WORD = "[^\\x20\\x09-\\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: int) -> tuple[DataFrame, str]:
    """(source, source_size, n, target) by water-filling, from (source, size, n).

    Sources ordered by code point, null last, take ``weights`` in turn; the order is cut
    into ranges, so no task holds all sources.  Each has its weight times one level, or
    its cap where that is less.
    """
    spark = sizes.sparkSession
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n"))
    ranked, path = running_sum(per, [F.col("source").asc_nulls_last()], F.lit(1).cast("long"), "place")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    weighed = ranked.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    # the level rises as sources reach their caps, and none leaves its cap again: a few aggregations settle it
    total = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, before = 0.0, -1
    while True:
        capped = F.col("cap") < F.col("weight") * F.lit(level)
        full, open_, n = weighed.agg(F.coalesce(F.sum(F.when(capped, F.col("cap"))), F.lit(0)), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0)), F.count_if(capped)).first()
        if n == before or not open_:
            break
        level, before = (share * total - full) / open_, n
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(level))
    out = materialize(weighed.select("source", "source_size", "n", target.alias("target")), "targets")
    drop(spark, path)
    return out


def rate(z: Column, tilt: Column, most: int) -> Column:
    return F.when(tilt.isNull(), F.lit(float(most))).otherwise(F.exp(F.least(tilt * z, F.log(F.lit(float(most))))))


def solve_tilts(pairs: DataFrame, targets: DataFrame, most: int, tolerance: float = 1e-7, steps: int = 60) -> tuple[DataFrame, str]:
    """``targets`` with the tilt of each source: null means ``most`` copies of everything.

    ``pairs`` is (source, size, n).  Newton on log tokens minus log target; a step out
    of the bracket is replaced by its middle (or a doubling while it is open).
    """
    spark = pairs.sparkSession
    full = F.col("target") >= most * F.col("source_size") * (1 - 1e-12)
    start = targets.withColumn("mean", F.col("source_size") / F.greatest("n", F.lit(1))).withColumn("settled", full | (F.col("target") <= 0))
    state = start.withColumn("tilt", F.when(~full & (F.col("target") > 0), F.log(F.col("target") / F.col("source_size")))).withColumn("low", F.lit(None).cast("double")).withColumn("high", F.lit(None).cast("double"))
    state, path = materialize(state, "tilts")
    for _ in range(steps):
        open_ = state.where("not settled").select("source", "mean", "tilt")
        z = F.col("size") / F.col("mean")
        w = rate(z, F.col("tilt"), most)
        held = F.col("tilt") * z >= F.log(F.lit(float(most)))
        sums = (
            pairs.join(open_.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
            .groupBy("s")
            .agg(F.sum(F.col("n") * F.col("size") * w).alias("tokens"), F.sum(F.when(~held, F.col("n") * F.col("size") * z * w).otherwise(0.0)).alias("slope"))
        )
        off = F.log(F.col("tokens") / F.col("target"))
        low, high = F.when(off < 0, F.col("tilt")).otherwise(F.col("low")), F.when(off > 0, F.col("tilt")).otherwise(F.col("high"))
        step = F.col("tilt") - off * F.col("tokens") / F.nullif(F.col("slope"), F.lit(0.0))
        middle = F.when(low.isNull(), high - F.greatest(F.abs(high), F.lit(1.0))).when(high.isNull(), low + F.greatest(F.abs(low), F.lit(1.0))).otherwise((low + high) / 2)
        inside = step.isNotNull() & (low.isNull() | (step > low)) & (high.isNull() | (step < high)) & (F.abs(step - F.col("tilt")) <= 8 * F.greatest(F.abs(F.col("tilt")), F.lit(1.0)))
        moved = (
            state.join(sums, F.col("source").eqNullSafe(F.col("s")), "left")
            .withColumn("done", F.col("settled") | (F.abs(off) <= tolerance))
            .select("source", "source_size", "n", "target", "mean", F.col("done").alias("settled"), F.when(F.col("done"), F.col("tilt")).when(inside, step).otherwise(middle).alias("tilt"), low.alias("low"), high.alias("high"))
        )
        after, new = materialize(moved, "tilts")
        drop(spark, path)
        state, path = after, new
        if state.where("not settled").isEmpty():
            break
    return state, path


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, rows_per_share: int = 1024, key: str | None = None) -> DataFrame:
    """Words the mix takes of every row of ``docs`` (doc_id, text, source).

    Cases: null text has size 0 and takes nothing, as has a source without words;
    null is a source of its own, the last; rows that share a doc_id are told apart by
    their text, also where it is null; rows alike in both are mixed each, in an order
    that does not matter; an empty table gives no rows; further columns are ignored.

    A (source, size) pair may hold a third of all rows: its rows are dealt into shares
    of about ``rows_per_share`` by hash, and copies are rounded share by share.
    ``key`` names a column that tells rows of one doc_id apart in place of the text's
    hash; it is returned too.
    """
    spark = docs.sparkSession
    ids = ["doc_id", key or "_text"]
    if key is None:
        docs = docs.select("doc_id", "text", "source", F.xxhash64("text").alias("_text"))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized, sized_path = materialize(docs.select(*ids, "source", size.alias("size")), "sizes")
    pairs, pairs_path = materialize(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "pairs")
    targets, targets_path = source_targets(pairs, weights, share, most)
    tilts, tilts_path = solve_tilts(pairs, targets, most)
    # rounded, so that the order in which a cluster adds doubles cannot show
    w = F.when(F.col("size") == 0, 0).otherwise(F.round(rate(F.col("size") / F.col("mean"), F.round("tilt", 9), most) * 10**6).cast("long"))
    rated = pairs.join(tilts.select(F.col("source").alias("s"), "source_size", "target", "mean", "tilt"), F.col("source").eqNullSafe(F.col("s"))).select("source", "size", "n", "source_size", "target", w.alias("micro"), F.ceil(F.col("n") / rows_per_share).cast("int").alias("shares"))
    rated, rated_path = materialize(rated, "rated")
    drop(spark, tilts_path)
    drop(spark, pairs_path)
    part = F.pmod(F.xxhash64(*ids), F.col("shares").cast("long")).cast("int")
    keyed = sized.join(rated.withColumnRenamed("source", "s").withColumnRenamed("size", "z"), F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")))
    keyed = keyed.select(*ids, "source", "size", "source_size", "target", "micro", part.alias("share"))
    group = ["source", "size", "share"]
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.xxhash64(*ids, F.lit(7)), *ids))
    ranked, ranked_path = materialize(keyed.withColumn("rank", rank), "ranked")
    counts = ranked.groupBy(*group).agg(F.count("*").alias("rows"), F.first("micro").alias("micro"))
    # systematic rounding: cumulative rates along each source, in halves offset
    summed, summed_path = running_sum(counts, [F.col("source"), F.col("size"), F.col("share")], F.col("rows") * F.col("micro"), "upto", "source")
    whole = summed.withColumn("copies", F.floor((F.col("upto") + 500_000) / 10**6) - F.floor((F.col("upto") - F.col("rows") * F.col("micro") + 500_000) / 10**6))
    whole = whole.select(*[F.col(c).alias(f"_{c}") for c in group], "copies", "rows")
    same = F.lit(True)
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    base = F.floor(F.col("copies") / F.col("rows"))
    given = ranked.join(whole, same).withColumn("n_copies", F.least(F.lit(most), base + F.when(F.col("rank") <= F.col("copies") - base * F.col("rows"), 1).otherwise(0)))
    given, given_path = materialize(given.select(*ids, "source", "size", "source_size", "target", "share", "rank", (F.col("n_copies") * F.col("size")).alias("taken")), "copies")
    # the rest of each source goes to, or comes off, the one document with most room for it
    name = F.struct("size", "share", "rank")
    rest = given.groupBy("source").agg(
        (F.round(F.first("target")) - F.sum("taken")).cast("long").alias("rest"),
        F.max(F.struct((most * F.col("size") - F.col("taken")).alias("room"), name.alias("at"))).alias("more"),
        F.max(F.struct(F.col("taken").alias("room"), name.alias("at"))).alias("less"),
    )
    rest = rest.withColumn("use", F.when(F.col("rest") > 0, F.col("more")).otherwise(F.col("less"))).where("rest <> 0").select(F.col("source").alias("s"), F.col("use.at").alias("at"), (F.signum("rest") * F.least(F.abs("rest"), F.col("use.room"))).cast("long").alias("change"))
    final = given.join(rest, F.col("source").eqNullSafe(F.col("s")), "left")
    final = final.select("doc_id", "size", "source_size", "target", (F.col("taken") + F.when(F.col("at") == name, F.col("change")).otherwise(0)).alias("taken"), "source", *([key] if key else []))
    mixed, _ = materialize(final, "mixed")
    drop(spark, targets_path, rated_path, sized_path, ranked_path, summed_path, given_path)
    return mixed
