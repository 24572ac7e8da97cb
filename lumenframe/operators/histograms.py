"""Histograms of grey values and of sequences: counts, quantiles, smoothing, gaps, look-up tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import pixels


def histogram(df: DataFrame, key: str = "img_id", value: str = "v", bins: int = 256) -> DataFrame:
    """(key, bin, n) with every bin from 0 to bins - 1, empty ones too. Counts are pre-aggregated before the shuffle."""
    counts = df.groupBy(key, F.col(value).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = counts.select(key).distinct().select(key, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(counts, [key, "bin"], "left").select(key, "bin", F.coalesce("n", F.lit(0)).alias("n"))


def clamped(df: DataFrame, low: int, high: int, value: str = "v") -> DataFrame:
    """(bin, n): counts with values beyond the range put into its ends."""
    return df.groupBy(F.greatest(F.lit(low), F.least(F.lit(high), F.col(value))).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def flexible(df: DataFrame, length: int, key: str, value: str = "v") -> DataFrame:
    """(key, divisor, bin, n): bins as wide as the least power of two that keeps the largest value below `length` bins. Values are not negative."""
    width = F.pow(F.lit(2), F.greatest(F.lit(0), F.ceil(F.log2((F.max(value).over(Window.partitionBy(key)) + 1) / F.lit(length))))).cast("int")
    return df.filter(F.col(value) >= 0).withColumn("divisor", width).groupBy(key, "divisor", F.expr(f"cast({value} div divisor as int)").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def cumulated(hist: DataFrame, key: str = "img_id") -> DataFrame:
    up_to = Window.partitionBy(key).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return hist.withColumn("cum", F.sum("n").over(up_to)).withColumn("mass", F.sum("n").over(Window.partitionBy(key)))


def quantiles(df: DataFrame, per_mille: list[int], key: str = "img_id", bins: int = 256) -> DataFrame:
    """(key, q, pos): where the running count reaches q/1000 of the mass; if exactly, the middle between there and the next bin that isn't empty."""
    cum = cumulated(histogram(df, key, bins=bins), key).withColumn("q", F.explode(F.array(*(F.lit(q) for q in per_mille)))).withColumn("goal", F.expr("(mass * q) div 1000"))
    found = cum.groupBy(key, "q", "goal").agg(
        F.min(F.when((F.col("goal") > 0) & (F.col("cum") >= F.col("goal")), F.col("bin"))).alias("hit"),
        F.max(F.when(F.col("cum") == F.col("goal"), 1).otherwise(0)).alias("exact"),
        F.min(F.when((F.col("cum") > F.col("goal")) & (F.col("n") > 0), F.col("bin"))).alias("next"),
    )
    middle = F.expr(f"(coalesce(hit, -1) + coalesce(next, {bins - 1})) div 2")
    return found.select(key, "q", F.when((F.col("exact") == 1) | F.col("hit").isNull(), middle).otherwise(F.col("hit")).cast("int").alias("pos"))


def median(df: DataFrame, key: str = "img_id", value: str = "v") -> DataFrame:
    """(key, median): first value whose running count reaches (n div 2) made odd."""
    counts = df.groupBy(key, F.col(value).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return cumulated(counts, key).filter(F.expr("cum >= ((mass div 2) | 1)")).groupBy(key).agg(F.min("bin").cast("int").alias("median"))


def median_deviation(df: DataFrame, key: str = "img_id") -> DataFrame:
    """(key, median, mad): median of the distances to the median."""
    mid = median(df, key)
    away = median(df.join(mid, key).withColumn("d", F.abs(F.col("v") - F.col("median"))), key, "d").withColumnRenamed("median", "mad")
    return mid.join(away, key)


def moving_sum(hist: DataFrame, half: int, key: str = "img_id", bins: int = 256) -> DataFrame:
    """(key, bin, n): sums over 2 half + 1 bins; beyond the ends the end bins count on."""
    own = Window.partitionBy(key).orderBy("bin")
    ends = Window.partitionBy(key)
    first, final = F.max(F.when(F.col("bin") == 0, F.col("n"))).over(ends), F.max(F.when(F.col("bin") == bins - 1, F.col("n"))).over(ends)
    over = F.greatest(F.lit(0), half - F.col("bin")) * first + F.greatest(F.lit(0), F.col("bin") + half - (bins - 1)) * final
    return hist.withColumn("s", F.sum("n").over(own.rowsBetween(-half, half)) + over).select(key, "bin", F.col("s").cast("long").alias("n"))


def filled(hist: DataFrame, widest: int, key: str, bins: int) -> DataFrame:
    """(key, bin, n): runs of at most `widest` empty bins between others are interpolated; runs that begin in the last `widest` bins stay."""
    own = Window.partitionBy(key).orderBy("bin")
    full = F.when(F.col("n") != 0, F.struct("bin", "n"))
    out = hist.withColumn("p", F.last(full, True).over(own.rowsBetween(Window.unboundedPreceding, -1))).withColumn("q", F.first(full, True).over(own.rowsBetween(1, Window.unboundedFollowing)))
    near = (F.col("n") == 0) & F.col("p").isNotNull() & F.col("q").isNotNull() & (F.col("q.bin") - F.col("p.bin") <= widest + 1) & (F.col("p.bin") + 1 + widest < bins)
    line = F.expr("((bin - p.bin) * q.n + (q.bin - bin) * p.n) div greatest(1, q.bin - p.bin)")
    return out.select(key, "bin", F.when(near, line).otherwise(F.col("n")).cast("long").alias("n"))


def normalised(hist: DataFrame, most: int, key: str = "img_id") -> DataFrame:
    """(key, bin, n): scaled so that the largest magnitude is `most`, rounded away from zero at halves."""
    out = hist.withColumn("top", F.max(F.abs("n")).over(Window.partitionBy(key)))
    return out.select(key, "bin", F.expr(f"case when top = 0 then 0 when top = {most} then n else (n * {most} + (case when n >= 0 then top else -top end) div 2) div top end").cast("long").alias("n"))


def mapped(df: DataFrame, lut: DataFrame, out: Column) -> DataFrame:
    """v replaced by way of a table of at most 256 rows an image."""
    return pixels(df.join(lut.withColumnRenamed("bin", "v"), ["img_id", "v"]), out)


def equalised(df: DataFrame) -> DataFrame:
    """Histogram equalisation: v becomes the share of values up to it, scaled to 255 and rounded; 0 stays 0."""
    cum = cumulated(df.groupBy("img_id", F.col("v").alias("bin")).agg(F.count(F.lit(1)).alias("n")))
    return mapped(df, cum.select("img_id", "bin", F.when(F.col("bin") == 0, 0).otherwise(F.floor(F.col("cum") * 255 / F.col("mass") + 0.5)).alias("to")), F.col("to"))


def stretched(df: DataFrame, low: int, high: int) -> DataFrame:
    """Contrast stretch between the per-mille quantiles counted from below and from above; values beyond become 0 and 255."""
    cum = cumulated(histogram(df))
    above = F.col("mass") - F.col("cum") + F.col("n")
    ends = cum.groupBy("img_id").agg(
        F.coalesce(F.min(F.when(1000 * F.col("cum") >= F.col("mass") * low, F.col("bin"))) + 1, F.lit(256)).alias("a"),
        (F.max(F.when(1000 * above >= F.col("mass") * (1000 - high), F.col("bin"))) - 1).alias("b"),
    )  # as many bins as it takes, so one past the bin that reaches the share
    scaled = F.least(F.lit(255), F.greatest(F.lit(0), (255.0 * (F.col("v") - F.col("a")) / F.when(F.col("a") != F.col("b"), F.col("b") - F.col("a"))).cast("int")))
    return pixels(df.join(ends, "img_id"), F.coalesce(scaled, F.col("a")))
