"""Problem 9: mixing sources to target weights.

Method: capped water-filling. Each source may give at most max_repeats times its size; a source whose share of the
total would exceed that is clamped there and the excess is spread over the others in proportion to their weights, until
no source is over. A source then repeats whole as often as fits, and a seeded sample of its texts makes up the fraction.
Sizes are tokens of a public tokenizer.

A text that several wanted documents hold is used by the smallest doc_id alone, so that no text passes its limit. The
sample takes texts in the order of a seeded hash up to the wanted size: the order's slices are summed first, and only
the slice in which the size is reached is ordered row by row, so a source of any size is never sorted in one task.

Defined cases: NULL and empty texts have no size and take no part; a NULL source is not wanted; a wanted source without
documents has share 0 and its weight goes to the others; weights that are NULL or not positive count as 0, max_repeats
below 1 as 0; repeated source rows add up their weights; weights are scaled to sum 1; an empty table gives no mixture.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import token_counts
from .common import cut

SLICES_BITS = 12
#: Weights this small count as 0: their amounts could not be told from rounding.
LEAST_WEIGHT = 1e-12


def water_level(sources: DataFrame, total: float) -> float:
    """The level L at which the amounts min(cap, weight * L) sum to total; infinite where the caps are out of reach.

    sources: (weight, cap), any number. Each round clamps the sources that the level before puts over their caps, so the
    level only rises, and ends where no further one is clamped. A round brings one row of sums to the driver.
    """
    free = sources.where((F.col("weight") > LEAST_WEIGHT) & (F.col("cap") > 0))
    level = 0.0
    clamped = -1
    while True:
        over = F.col("weight") * F.lit(level) >= F.col("cap")
        r = free.agg(F.count_if(over).alias("n"), F.sum(F.when(over, F.col("cap"))).alias("cap"), F.sum(F.when(~over, F.col("weight"))).alias("weight")).first()
        if r["n"] == clamped:
            return level
        if not r["weight"] or total <= (r["cap"] or 0.0):
            return math.inf if not r["weight"] else level
        clamped, level = r["n"], (total - (r["cap"] or 0.0)) / r["weight"]


def _plan(documents: DataFrame, targets: DataFrame, total: float | None) -> tuple[DataFrame, DataFrame]:
    """The sized texts of wanted sources, and the plan: (source, weight, size, amount, whole, part, capped)."""
    wanted = targets.where("source is not null").groupBy("source").agg(F.sum(F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))).alias("weight"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))).alias("max_repeats"))
    wanted = cut(wanted)
    rows = documents.select("doc_id", "source", "text").join(wanted.select("source"), "source", "left_semi")
    rows = rows.withColumns({"d1": F.xxhash64("text"), "d2": F.xxhash64(F.lit(7), "text", F.length("text"))})
    sized = cut(token_counts(rows, "doc_id", "source", "d1", "d2").where("n_tokens > 0"))
    one = sized.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "source", "n_tokens")).alias("x")).select("x.*")
    one = cut(one)
    size = one.groupBy("source").agg(F.sum("n_tokens").alias("size"))
    sums = wanted.agg(F.sum("weight").alias("w")).first()["w"] or 1.0
    plan = wanted.join(size, "source", "left").withColumns({"weight": F.col("weight") / sums, "size": F.coalesce("size", F.lit(0))})
    plan = cut(plan.withColumn("cap", (F.col("max_repeats") * F.col("size")).cast("double")))
    everything = float(plan.agg(F.sum("size").alias("n")).first()["n"] or 0) if total is None else float(total)
    level = water_level(plan, everything)
    usable = (F.col("weight") > LEAST_WEIGHT) & (F.col("cap") > 0)
    amount = F.when(usable, F.least(F.col("cap"), F.col("weight") * F.lit(level))).otherwise(0.0)
    whole = F.when(F.col("size") > 0, F.floor(amount / F.col("size") + 1e-9)).otherwise(0).cast("int")
    plan = plan.withColumns({"amount": amount, "whole": whole, "capped": usable & (amount >= F.col("cap"))})
    return one, plan.withColumn("part", F.greatest(F.lit(0.0), F.col("amount") - F.col("whole") * F.col("size"))).select("source", "weight", "size", "amount", "whole", "part", "capped")


def _mix(one: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    h = F.xxhash64(F.lit(seed), "doc_id")
    rows = one.withColumns({"h": h, "slice": F.shiftrightunsigned(h, 64 - SLICES_BITS)})
    sums = rows.groupBy("source", "slice").agg(F.sum("n_tokens").alias("n"))
    before = sums.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("slice")) - F.col("n")).select("source", "slice", "n", "before")
    # One row a slice of a source: small where sources are few, and then broadcast by its measured size.
    met = rows.join(before.join(plan.select("source", "whole", "part"), "source"), ["source", "slice"])
    edge = (F.col("before") < F.col("part")) & (F.col("before") + F.col("n") > F.col("part"))
    inner = met.where(edge).withColumn("upto", F.col("before") + F.sum("n_tokens").over(Window.partitionBy("source", "slice").orderBy("h", "doc_id")))
    inner = inner.withColumn("extra", (F.col("upto") - F.col("n_tokens") / 2 <= F.col("part")).cast("int"))
    outer = met.where(~edge).withColumn("extra", (F.col("before") + F.col("n") <= F.col("part")).cast("int"))
    cols = ["doc_id", "source", "n_tokens", (F.col("whole") + F.col("extra")).alias("copies")]
    return inner.select(*cols).unionByName(outer.select(*cols)).where("copies > 0")


def mixed(documents: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 20) -> DataFrame:
    """(doc_id, source, n_tokens, copies): how often each text is in the mixture. total: tokens, all of one epoch by default."""
    return _mix(*_plan(documents, targets, total), seed)


def shares(documents: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 20) -> DataFrame:
    """Each wanted source's target and the share that it reached."""
    one, plan = _plan(documents, targets, total)
    got = _mix(one, plan, seed).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    met = plan.join(got, "source", "left").withColumns({"tokens": F.coalesce("tokens", F.lit(0)), "most_copies": F.coalesce("most_copies", F.lit(0))})
    met = cut(met)
    every = met.agg(F.sum("tokens").alias("n")).first()["n"]
    met = met.withColumn("all", F.lit(every))
    return met.select("source", "weight", "size", F.col("amount").alias("wanted_tokens"), "tokens", F.coalesce(F.try_divide("tokens", "all"), F.lit(0.0)).alias("share"), F.try_divide("tokens", "size").alias("epochs"), "most_copies", "capped")
