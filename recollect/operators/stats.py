"""Means with intervals that treat a cluster, not a row, as the unit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Student's t at 0.975 for 1 to 30 degrees of freedom, and the normal quantile (fixed values).
T975 = (
    12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228,
    2.201, 2.179, 2.160, 2.145, 2.131, 2.120, 2.110, 2.101, 2.093, 2.086,
    2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042,
)
Z975 = 1.959964


def t975(df: Column) -> Column:
    """The quantile by table, and by its expansion around the normal one beyond."""
    z = Z975
    far = z + (z**3 + z) / (4 * df) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * df * df)
    table = F.array(*[F.lit(t) for t in T975])
    return F.when(df < 1, F.raise_error(F.lit("degrees of freedom must be positive")).cast("double")).when(df <= len(T975), F.get(table, df.cast("int") - 1)).otherwise(far)


def cluster_means(rows: DataFrame, by: list[str], value: str = "value", cluster: str = "cluster") -> DataFrame:
    """(by, mean, lo, hi, n, clusters) for each group: leave-one-cluster-out intervals.

    Rows are summed by cluster first, so what meets in a group is one row for each cluster; the
    totals are made from the same shuffle. The interval is cut to the range of the values; a single
    cluster has none, and lo = hi = mean. Null values are left out.
    """
    sums = rows.where(F.col(value).isNotNull()).groupBy(*by, cluster).agg(F.sum(value).alias("s"), F.count("*").alias("c"), F.min(value).alias("least"), F.max(value).alias("most"))
    totals = sums.groupBy(*by).agg(F.sum("s").alias("total"), F.sum("c").alias("n"), F.count("*").alias("clusters"), F.min("least").alias("least"), F.max("most").alias("most"))
    same = F.lit(True)
    for k in by:
        same &= F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}"))
    left_out = sums.alias("x").join(totals.alias("y"), same).select(*[F.col(f"x.{k}").alias(k) for k in by], "total", "n", "clusters", "y.least", "y.most", F.when(F.col("n") > F.col("c"), (F.col("total") - F.col("s")) / (F.col("n") - F.col("c"))).alias("loo"))
    spread = left_out.groupBy(*by).agg(*[F.first(k).alias(k) for k in ("total", "n", "clusters", "least", "most")], F.var_pop("loo").alias("v"))
    mean = F.col("total") / F.col("n")
    half = F.when(F.col("clusters") >= 2, t975(F.greatest(F.col("clusters") - 1, F.lit(1))) * F.sqrt((F.col("clusters") - 1) * F.col("v"))).otherwise(0.0)
    return spread.select(
        *by,
        mean.alias("mean"),
        F.when(F.col("clusters") < 2, mean).otherwise(F.greatest(mean - half, "least")).alias("lo"),
        F.when(F.col("clusters") < 2, mean).otherwise(F.least(mean + half, "most")).alias("hi"),
        "n",
        "clusters",
    )


def bootstrap(rows: DataFrame, by: list[str], value: str = "value", cluster: str = "cluster", resamples: int = 2000, seed: int = 0) -> DataFrame:
    """(by, boot_lo, boot_hi): the percentile bootstrap over clusters.

    Each resample draws as many clusters as there are, by a hash of the draw; a rerun agrees.
    Clusters are numbered, and the draws, resamples x clusters narrow rows for each group, are
    counted by number before they meet the clusters' sums in a join. A group's clusters are
    numbered in one window; its resamples meet in one array, rounded to 12 places, as the order
    of a sum is not fixed.
    """
    sums = rows.where(F.col(value).isNotNull()).groupBy(*by, cluster).agg(F.sum(value).alias("s"), F.count("*").alias("c"))
    group = F.xxhash64(*by).alias("_group")
    order = Window.partitionBy("_group").orderBy(F.col(cluster).cast("string"))
    numbered = sums.select(*by, group, cluster, "s", "c").withColumn("j", F.row_number().over(order) - 1)
    sizes = numbered.groupBy("_group").agg(F.count("*").alias("n"))
    drawn = numbered.select("_group", "j").join(sizes, "_group").select("_group", "j", "n", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("r"))
    times = drawn.select("_group", "r", F.pmod(F.xxhash64(F.lit(seed), "r", "j"), F.col("n")).cast("int").alias("j")).groupBy("_group", "r", "j").agg(F.count("*").alias("times"))
    means = times.join(numbered.select("_group", "j", "s", "c"), ["_group", "j"]).groupBy("_group", "r").agg(F.round(F.sum(F.col("s") * F.col("times")) / F.sum(F.col("c") * F.col("times")), 12).alias("m"))
    ordered = means.groupBy("_group").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    at = lambda q: F.get("ms", F.lit(int(q * (resamples - 1))))
    return numbered.where("j = 0").join(ordered, "_group").select(*by, at(0.025).alias("boot_lo"), at(0.975).alias("boot_hi"))
