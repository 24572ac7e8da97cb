"""Mixing sources to target weights by entropy balancing.

Document d of source s gets the rate r = min(2, exp(lambda_s * size_d / scale_s)): of all rates whose words add up to the target of s and
that don't exceed the most copies allowed, these lie closest to 1 in relative entropy. lambda_s solves a convex dual, whose gradient and
curvature are sums over documents. Documents of one source and size have one rate, so the sums run over counts by (source, size), an exact and
far smaller table; Newton steps that leave the bracket of the root are replaced by its middle. Rates become copies by rounding the words of
each size class, the largest sizes first, and carrying what is left over to the next.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_WORD, dropped, ranked, written

# The weights of sources in code point order, repeating, and the words that the mix takes of all.
WEIGHTS = [3, 1, 2]
SHARE = 1.5
COPIES = 2
SALTS = 64


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, fp): size counts the words of the whole text; a null text has none."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(SPACE_WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), F.xxhash64(text_col).alias("fp"))


def targets(sizes: DataFrame, weights: list[int] = WEIGHTS, share: float = SHARE, copies: int = COPIES) -> DataFrame:
    """(source, source_size, scale, least, target) from counts (source, size, n).

    Targets are in proportion to the weights until one would be above `copies` times its source's size; it stops there and the excess is
    shared by weight among the rest. With sources ordered by how soon they stop, the stopped ones are the first few, so one pass finds the
    level of the rest. One row a source.
    """
    words = F.col("size") * F.col("n")
    per = sizes.groupBy("source").agg(F.sum(words).alias("source_size"), F.try_divide(F.sum(words * F.col("size")), F.sum(words)).alias("scale"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # one row a source
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("most", copies * F.col("source_size").cast("double"))
    soon = Window.orderBy(F.col("most") / F.col("weight"), "source")
    before, rest = soon.rowsBetween(Window.unboundedPreceding, -1), soon.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    per = per.withColumn("budget", share * F.sum("source_size").over(everything))
    per = per.withColumn("level", (F.col("budget") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    per = per.withColumn("stops", F.col("most") <= F.col("level") * F.col("weight"))
    level = F.min_by(F.when(~F.col("stops"), F.col("level")), F.when(~F.col("stops"), F.col("most") / F.col("weight"))).over(everything)
    return per.withColumn("of_rest", level).select("source", "source_size", "scale", "least", F.when(F.col("stops"), F.col("most")).otherwise(F.least("most", F.col("of_rest") * F.col("weight"))).alias("target"))


def tilt(dual: Column, size: Column, scale: Column, copies: int = COPIES) -> Column:
    return F.least(F.lit(float(copies)), F.exp(dual * size / scale))


def solve(sizes: DataFrame, goals: DataFrame, copies: int = COPIES, most: int = 200, near: float = 1e-9) -> DataFrame:
    """goals with `dual`: damped Newton on each source's dual. A job a step, over the counts; stops when no target is off by more than `near` of it.

    A step that leaves the bracket halves it, so a bracket of doubles is used up long before `most` steps; where it has no doubles left inside, the dual is as
    near as doubles come. Still being off after `most` steps is an error.
    """
    full = F.col("target") >= copies * F.col("source_size") * (1 - 1e-12)
    high = F.log(F.lit(2.0 * copies)) * F.col("scale") / F.col("least")
    low = F.log(F.try_divide(F.greatest(F.col("target"), F.lit(1e-9)), F.col("source_size"))) * F.col("scale") / F.col("least")
    state = goals.withColumns({"fixed": full | (F.col("source_size") == 0), "high": F.greatest(high, F.lit(1.0)), "low": F.least(low, F.lit(0.0)) - 1e-6, "dual": F.when(full & (F.col("source_size") > 0), F.greatest(high, F.lit(1.0))).otherwise(0.0), "off": F.lit(1.0)})
    state = written(state, "mix-dual")
    keep = ["source", "source_size", "scale", "least", "target", "fixed"]
    for _ in range(most):
        here = sizes.join(state, sizes["source"].eqNullSafe(state["source"])).select(*(state[c] for c in state.columns), "size", "n")
        rate = tilt(F.col("dual"), F.col("size"), F.col("scale"), copies)
        mass = F.col("n") * F.col("size") * rate
        slope = F.when(rate < copies, mass * F.col("size") / F.col("scale")).otherwise(0.0)
        sums = here.groupBy(*keep, "high", "low", "dual").agg((F.sum(mass) - F.first("target")).alias("over"), F.sum(slope).alias("slope"))
        sums = sums.withColumns({"high": F.when(F.col("over") > 0, F.col("dual")).otherwise(F.col("high")), "low": F.when(F.col("over") > 0, F.col("low")).otherwise(F.col("dual"))})
        step = F.col("dual") - F.col("over") / F.when(F.col("slope") > 0, F.col("slope"))
        inside = step.isNotNull() & (step > F.col("low")) & (step < F.col("high"))
        middle = (F.col("low") + F.col("high")) / 2
        spent = ((F.col("high") - F.col("low")) <= 1e-15 * F.greatest(F.abs("high"), F.abs("low"))) | (middle <= F.col("low")) | (middle >= F.col("high"))
        done = F.col("fixed") | (F.abs("over") <= near * F.col("target")) | spent
        new = sums.select(*keep, "high", "low", F.when(done, F.col("dual")).when(inside, step).otherwise(middle).alias("dual"), F.when(done, 0.0).otherwise(F.abs("over") / F.greatest("target", F.lit(1.0))).alias("off"))
        new = written(new, "mix-dual")
        dropped(state)
        state = new
        if not (state.agg(F.max("off")).first()[0] or 0.0):
            break
    else:
        raise RuntimeError(f"the duals did not settle in {most} steps")
    return state.select("source", "source_size", "scale", "target", "dual")


def rounding(copies: int):
    def rounds(pdf: pd.DataFrame) -> pd.DataFrame:
        """Copies of each size class of one source; pdf has a row for each distinct size."""
        pdf = pdf.sort_values("size", ascending=False)
        left, taken = 0.0, []
        for size, n, rate in zip(pdf["size"].tolist(), pdf["n"].tolist(), pdf["rate"].tolist(), strict=True):
            words = n * rate * size + left
            k = min(copies * n, max(0, round(words / size))) if size else n
            left = words - k * size
            taken.append(k)
        return pdf.assign(k=taken)[["source", "size", "n", "source_size", "target", "rate", "k"]]

    return rounds


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: list[int] = WEIGHTS, share: float = SHARE, copies: int = COPIES) -> DataFrame:
    """(doc_id, source, fp, size, source_size, target, rate, copies) for every row of docs; fp is xxhash64 of the text.

    Null sources are one source, the last; a null text has no words. Documents without words are kept once and take nothing. Equal rows may
    trade copies; otherwise the result depends on the rows alone. Source sizes of 0 have target 0. An empty table gives an empty result.
    Only the three named columns are read.
    """
    base = written(sized(docs, id_col, text_col, source_col), "mix-sizes")
    sizes = written(base.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-counts")
    state = solve(sizes, targets(sizes, weights, share, copies), copies)
    rated = sizes.join(state, sizes["source"].eqNullSafe(state["source"])).select(sizes["source"], "size", "n", "source_size", "target", F.coalesce(tilt(F.col("dual"), F.col("size"), F.col("scale"), copies), F.lit(1.0)).alias("rate"))
    classes = rated.groupBy("source").applyInPandas(rounding(copies), "source string, size long, n long, source_size long, target double, rate double, k long")
    classes = written(classes, "mix-classes")
    # Each document of a class takes k div n copies, and the first k mod n by hash one more.
    placed = ranked(base, ["source", "size"], [F.xxhash64("doc_id", "fp"), "doc_id", "fp"], F.xxhash64("doc_id", "fp"), SALTS, "place", classes)
    made = F.floor(F.col("k") / F.col("n")) + (F.col("place") < F.col("k") % F.col("n")).cast("long")
    return placed.select("doc_id", "source", "fp", "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), "rate", made.cast("int").alias("copies"))


def op3(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "rate")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """docs with each row as often as the mix takes it, its columns unchanged.

    Null ids and texts are rows like others; equal rows are told apart by number and may trade copies; an empty table gives an empty one; long texts are read whole.
    """
    shares = mix(docs, id_col, text_col, **more).select(F.col("doc_id").alias("__id"), F.col("fp").alias("__fp"), F.col("copies").alias("__copies"))
    # Equal rows are told apart by number, so that each gets copies of its own.
    number = Window.partitionBy("__id", "__fp")
    shares = shares.withColumn("__row", F.row_number().over(number.orderBy("__copies"))).filter("__copies > 0")
    rows = docs.withColumn("__id", F.col(id_col)).withColumn("__fp", F.xxhash64(text_col)).withColumn("__row", F.row_number().over(number.orderBy(F.lit(0))))
    on = [rows["__id"].eqNullSafe(shares["__id"]), rows["__fp"] == shares["__fp"], rows["__row"] == shares["__row"]]
    repeated = rows.join(shares, on).withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("__copies"))))
    return repeated.select(*(rows[c] for c in docs.columns))
