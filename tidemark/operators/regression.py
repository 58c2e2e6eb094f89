"""Linear trends from sums that add up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pane_sums(df: DataFrame, keys: list[str], pane: str, ts: str, value: str) -> DataFrame:
    """n, sx, sy, cxy, cxx and last_ts of each pane, x being microseconds from the pane's start, cxy and cxx about the pane's means.

    Two readings may be a moment apart, and sums of squares from any fixed origin would lose that moment: so they are about the means
    from the first row on.
    """
    x = (F.unix_micros(ts) - F.unix_micros(pane)).cast("double")
    y = F.col(value)
    return df.groupBy(*keys, pane).agg(
        F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.regr_sxy(y, x).alias("cxy"), F.regr_sxx(y, x).alias("cxx"), F.max(ts).alias("last_ts")
    )


def trends(panes: DataFrame, keys: list[str], pane: str) -> DataFrame:
    """Least-squares slope per second, mean, count, last_ts and the line's value at last_ts, of the panes of each key.

    x is counted from the key's first pane that has rows. As that is known only with all panes at hand, a key's panes (a window has
    size / slide of them) are gathered and joined in one expression, each time about the means of both.
    """
    fields = ["n", "sx", "sy", "cxy", "cxx"]
    held = panes.groupBy(*keys).agg(F.collect_list(F.struct(F.unix_micros(pane).alias("p"), *fields)).alias("_p"), F.max("last_ts").alias("last_ts"))
    held = held.withColumn("_o", F.array_min(F.transform("_p", lambda x: x["p"])))

    def add(acc: Column, x: Column) -> Column:
        sx = x["sx"] + x["n"] * (x["p"] - F.col("_o")).cast("double")
        had = F.greatest(acc["n"], F.lit(1))
        dx, dy = sx / x["n"] - acc["sx"] / had, x["sy"] / x["n"] - acc["sy"] / had
        weight = acc["n"].cast("double") * x["n"] / (acc["n"] + x["n"])
        return F.struct(
            (acc["n"] + x["n"]).alias("n"), (acc["sx"] + sx).alias("sx"), (acc["sy"] + x["sy"]).alias("sy"),
            (acc["cxy"] + x["cxy"] + dx * dy * weight).alias("cxy"), (acc["cxx"] + x["cxx"] + dx * dx * weight).alias("cxx"),
        )

    zero = F.struct(F.lit(0).cast("long").alias("n"), *[F.lit(0.0).alias(f) for f in fields[1:]])
    sums = held.withColumn("_s", F.aggregate(F.array_sort("_p"), zero, add)).select(*keys, "last_ts", "_o", "_s.*")
    slope = F.when((F.col("n") < 2) | (F.col("cxx") == 0), F.lit(0.0)).otherwise(F.col("cxy") / F.col("cxx") * 1e6)
    sums = sums.withColumn("slope_per_second", slope)
    mean = F.col("sy") / F.col("n")
    x_last = F.unix_micros("last_ts") - F.col("_o")
    at_last = mean + F.col("slope_per_second") * ((x_last - F.col("sx") / F.col("n")) / 1e6)
    return sums.select(*keys, "slope_per_second", mean.alias("mean"), "n", "last_ts", at_last.alias("at_last"))
