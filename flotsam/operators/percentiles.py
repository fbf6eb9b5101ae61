"""Exact percentiles of groups by counting, without a group in one place."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.session import Scratch

#: Buckets that a stretch of values is counted in.
BUCKETS = 1024


def exact_percentiles(rows: DataFrame, keys: list[str], value: str, fractions: list[float]) -> DataFrame:
    """(keys, n, p0, p1, ...): for each fraction the value at that place of a group's sorted values, linear between two.

    Null and NaN values are left out, and so are groups without others; null keys are a group.  Every round counts the
    values of the stretch that holds a rank in buckets, and goes on with the one bucket that holds it, until that has a
    single value.  A round gives at most BUCKETS counts a group, rank and task, however many values a group has.
    """
    scratch = Scratch(rows.sparkSession)
    x = F.col(value).cast("double")
    kept = rows.select(*keys, x.alias("_x")).where(x.isNotNull() & ~F.isnan(x))
    whole = scratch.table("whole", kept.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi")))
    # both neighbours of each place: (number of the fraction, whether it is the upper one, rank from 0)
    place = lambda f: F.lit(float(f)) * (F.col("n") - 1)
    ranks = [F.struct(F.lit(k).alias("k"), F.lit(up).alias("up"), (F.ceil(place(f)) if up else F.floor(place(f))).cast("long").alias("rank")) for k, f in enumerate(fractions) for up in (False, True)]
    wanted = whole.select(*keys, "lo", "hi", F.lit(0).cast("long").alias("below"), F.explode(F.array_distinct(F.array(*(r["rank"] for r in ranks)))).alias("rank"))
    still = {"open": F.coalesce(F.sum((F.col("lo") < F.col("hi")).cast("long")), F.lit(0))}
    state, seen = scratch.measured("state", wanted, **still)
    found, rounds = [], 0
    while True:
        settled = state.where("lo = hi").select(*keys, "rank", F.col("lo").alias("v"))
        found.append(scratch.table(f"found{rounds}", settled))
        if not seen["open"]:
            break
        rounds += 1
        going = state.where("lo < hi")
        same = reduce(lambda a, b: a & b, (F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys), F.lit(True))
        met = kept.alias("r").join(going.alias("s"), same & (F.col("_x") >= F.col("s.lo")) & (F.col("_x") <= F.col("s.hi")))
        # halves keep a stretch of any two finite values finite; the last bucket takes the upper end
        share = (F.col("_x") / 2 - F.col("s.lo") / 2) / (F.col("s.hi") / 2 - F.col("s.lo") / 2)
        bucket = F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)).alias("bucket")
        counted = met.select(*(F.col(f"s.{k}").alias(k) for k in keys), "s.rank", "s.below", bucket, "_x").groupBy(*keys, "rank", "below", "bucket").agg(F.count("*").alias("c"), F.min("_x").alias("lo"), F.max("_x").alias("hi"))
        upto = F.sum("c").over(Window.partitionBy(*keys, "rank").orderBy("bucket"))
        held = counted.withColumn("upto", F.col("below") + upto).where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("c") <= F.col("rank")))
        state, seen = scratch.measured("state", held.select(*keys, "lo", "hi", (F.col("upto") - F.col("c")).alias("below"), "rank"), **still)
    values = reduce(DataFrame.unionByName, found)
    at = whole.select(*keys, "n", F.explode(F.array(*ranks)).alias("r")).select(*keys, "n", "r.*")
    same = reduce(lambda a, b: a & b, (F.col(f"a.{k}").eqNullSafe(F.col(f"v.{k}")) for k in keys), F.col("a.rank") == F.col("v.rank"))
    named = at.alias("a").join(values.alias("v"), same).select(*(F.col(f"a.{k}").alias(k) for k in keys), "a.n", "a.k", "a.up", "v.v")
    side = lambda k, up: F.max(F.when((F.col("k") == k) & (F.col("up") == up), F.col("v")))
    sides = named.groupBy(*keys, "n").agg(*(side(k, up).alias(f"_{k}_{int(up)}") for k in range(len(fractions)) for up in (False, True)))
    part = lambda f: place(f) - F.floor(place(f))
    between = [(F.col(f"_{k}_0") * (1 - part(f)) + F.col(f"_{k}_1") * part(f)).alias(f"p{k}") for k, f in enumerate(fractions)]
    return scratch.last(sides.select(*keys, "n", *between))
