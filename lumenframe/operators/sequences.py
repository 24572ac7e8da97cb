"""Ordered sequences (key, i, ...): resampling, running medians, circular morphology, filling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def resampled(seq: DataFrame, n: int, key: str, value: str = "value") -> DataFrame:
    """(key, k, value): n values at even places from the first to the last, linear between neighbours."""
    own = Window.partitionBy(key).orderBy("i")
    seq = seq.select(key, "i", F.col(value).alias("a"), F.lead(value).over(own).alias("b"), F.max("i").over(Window.partitionBy(key)).alias("end"))
    # Output k lies at k * end / (n - 1); each input i answers the outputs of [i, i + 1).
    first, stop = F.expr(f"cast(ceil(i * {n - 1}D / greatest(end, 1)) as int)"), F.expr(f"cast(ceil((i + 1) * {n - 1}D / greatest(end, 1)) as int) - 1")
    span = F.when(F.col("end") == 0, F.sequence(F.lit(0), F.lit(n - 1))).when(F.col("i") == F.col("end"), F.array(F.lit(n - 1))).when(first <= stop, F.sequence(first, stop))
    x = F.col("k") * F.col("end") / F.lit(float(n - 1)) - F.col("i")
    out = seq.withColumn("k", F.explode(span)).withColumn("f", x)
    return out.select(key, "k", F.round(F.when(F.col("b").isNull(), F.col("a")).otherwise((1 - F.col("f")) * F.col("a") + F.col("f") * F.col("b")), 6).alias("value"))


def timed(seq: DataFrame, n: int, key: str, time: str = "t_us", value: str = "value") -> DataFrame:
    """(key, k, value): n values at even times from the first to the last. A bracket is [t, next t); each bracket makes the outputs inside it,
    so no range join is needed. Repeated times of one key are an error."""
    own = Window.partitionBy(key).orderBy(time)
    whole = Window.partitionBy(key)
    s = seq.select(key, F.col(time).alias("t"), F.col(value).alias("a"), F.lead(time).over(own).alias("t2"), F.lead(value).over(own).alias("b"), F.min(time).over(whole).alias("t0"), F.max(time).over(whole).alias("t1"))
    s = s.withColumn("t2", F.when(F.col("t2") == F.col("t"), F.raise_error(F.lit("times must increase"))).otherwise(F.col("t2")))
    step = (F.col("t1") - F.col("t0")).cast("double") / (n - 1)
    place = lambda c: F.ceil((F.col(c) - F.col("t0")) / step - 1e-9).cast("int")
    span = F.when(F.col("t2").isNull(), F.array(F.lit(n - 1))).when(place("t") <= place("t2") - 1, F.sequence(place("t"), F.least(F.lit(n - 2), place("t2") - 1)))
    out = s.filter("t1 > t0").withColumn("k", F.explode(span))
    now = F.col("t0") + F.col("k") * step
    mix = ((F.col("t2") - now) * F.col("a") + (now - F.col("t")) * F.col("b")) / (F.col("t2") - F.col("t"))
    return out.select(key, "k", F.round(F.when(F.col("t2").isNull(), F.col("a")).otherwise(mix), 6).alias("value"))


def running_median(seq: DataFrame, half: int, key: str, value: str = "v") -> DataFrame:
    """(key, i, v): median of 2 half + 1 places; beyond the ends the end values count on."""
    own = Window.partitionBy(key).orderBy("i")
    whole = Window.partitionBy(key)
    ends = seq.withColumns({"__n": F.max("i").over(whole), "__a": F.first(value).over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "__z": F.last(value).over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    box = F.collect_list(value).over(own.rowsBetween(-half, half))
    pads = F.concat(box, F.array_repeat("__a", F.greatest(F.lit(0), half - F.col("i"))), F.array_repeat("__z", F.greatest(F.lit(0), F.col("i") + half - F.col("__n"))))
    return ends.select(key, "i", F.get(F.sort_array(pads), F.lit(half)).alias("v"))


def circular(seq: DataFrame, half: int, key: str, grow: bool, value: str = "v") -> DataFrame:
    """(key, i, v): largest or smallest of 2 half + 1 places on a circle: the sequence stands three times in a row, the middle one is kept."""
    whole = Window.partitionBy(key)
    wide = seq.withColumn("__n", F.max("i").over(whole) + 1).withColumn("__t", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn("__p", F.col("i") + F.col("__t") * F.col("__n"))
    own = Window.partitionBy(key).orderBy("__p").rowsBetween(-half, half)
    return wide.withColumn("s", (F.max(value) if grow else F.min(value)).over(own)).filter("__t = 0").select(key, "i", F.col("s").alias("v"))
