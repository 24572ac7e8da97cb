"""Transforms of vectors (vec_id, i, e), image quality from differences, checksums and integer functions."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def transformed(df: DataFrame, key: str, axes: list[str], values: list[str], out: list[str], run: Callable[..., list[np.ndarray]]) -> DataFrame:
    """(key, axes, out): run on each key's values as arrays over the axes, which count from 0 without gaps. One key is one row while it is worked on."""
    packed = df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*axes, *(F.col(v).cast("double").alias(f"__{k}") for k, v in enumerate(values))))).alias("p"))
    packed = packed.select(key, *(F.array_max(F.col(f"p.{a}")).alias(f"__n{k}") for k, a in enumerate(axes)), *(F.col(f"p.__{k}").alias(f"__{k}") for k in range(len(values))))
    kind = df.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, " + ", ".join([f"{a} int" for a in axes] + [f"{o} double" for o in out])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                shape = [b.column(1 + k)[i].as_py() + 1 for k in range(len(axes))]
                found = run(*(np.asarray(b.column(1 + len(axes) + k)[i].as_py(), np.float64).reshape(shape) for k in range(len(values))))
                places = np.indices(found[0].shape, np.int32).reshape(len(axes), -1)
                n = places.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[i].as_py()] * n, b.column(0).type), *(pa.array(p) for p in places), *(pa.array(f.reshape(-1), pa.float64()) for f in found)], names=[key, *axes, *out])

    return packed.mapInArrow(each, schema)


def fourier(df: DataFrame, axes: list[str], value: str = "e", key: str = "vec_id", imaginary: str | None = None, inverse: bool = False) -> DataFrame:
    """(key, axes, re, im): discrete Fourier transform over one or more axes; the inverse is divided by the number of values."""

    def run(re, im=None):
        z = re if im is None else re + 1j * im
        f = np.fft.ifftn(z) if inverse else np.fft.fftn(z)
        return [np.round(f.real, 6) + 0.0, np.round(f.imag, 6) + 0.0]

    return transformed(df, key, axes, [value] + ([imaginary] if imaginary else []), ["re", "im"], run)


def bit_reversed(n: int) -> np.ndarray:
    """0 to n - 1, n being a power of two, with their bits in reverse order."""
    bits = n.bit_length() - 1
    k = np.arange(n)
    return sum(((k >> b) & 1) << (bits - 1 - b) for b in range(bits)) if bits else k


def walsh_lines(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform along the last axis, in dyadic order."""
    n = x.shape[-1]
    if n & (n - 1):
        raise ValueError("lengths must be powers of two")
    step = 1
    while step < n:
        pairs = x.reshape(*x.shape[:-1], n // (2 * step), 2, step)
        x = np.stack([pairs[..., 0, :] + pairs[..., 1, :], pairs[..., 0, :] - pairs[..., 1, :]], axis=-2).reshape(x.shape)
        step *= 2
    return x[..., bit_reversed(n)]


def haar_lines(x: np.ndarray) -> np.ndarray:
    """Un-normalised Haar transform along the last axis: first the sum, then differences from the coarsest to the finest."""
    if x.shape[-1] & (x.shape[-1] - 1):
        raise ValueError("lengths must be powers of two")
    parts = []
    while x.shape[-1] > 1:
        parts.append(x[..., 0::2] - x[..., 1::2])
        x = x[..., 0::2] + x[..., 1::2]
    return np.concatenate([x, *parts[::-1]], axis=-1)


def along_axes(run: Callable[[np.ndarray], np.ndarray]) -> Callable[[np.ndarray], list[np.ndarray]]:
    def f(x: np.ndarray) -> list[np.ndarray]:
        for axis in range(x.ndim):
            x = np.moveaxis(run(np.moveaxis(x, axis, -1)), -1, axis)
        return [np.round(x, 6) + 0.0]

    return f


def walsh(df: DataFrame, axes: list[str], value: str = "e", key: str = "vec_id") -> DataFrame:
    """(key, axes, e): Walsh-Hadamard transform over one or more axes, in dyadic order."""
    return transformed(df, key, axes, [value], ["e"], along_axes(walsh_lines))


def haar(df: DataFrame, axes: list[str], value: str = "e", key: str = "vec_id") -> DataFrame:
    """(key, axes, e): un-normalised Haar transform over one or more axes, one after the other."""
    return transformed(df, key, axes, [value], ["e"], along_axes(haar_lines))


def sync_loss(df: DataFrame) -> DataFrame:
    """(img_id, lost): whether the largest difference of even rows two apart stands out: its lead over the second exceeds one and the second's over the third."""
    down = Window.partitionBy("img_id", "x").orderBy("y")
    d = df.withColumn("d", F.lead("v", 2).over(down) - F.col("v")).filter("y % 2 = 0 and d is not null")
    rows = d.groupBy("img_id", "y").agg(F.sum(F.col("d") * F.col("d")).alias("s"), F.count(F.lit(1)).alias("w")).select("img_id", "y", F.floor(F.sqrt(F.expr("s div w").cast("double"))).cast("int").alias("m"))
    top = rows.withColumn("k", F.row_number().over(Window.partitionBy("img_id").orderBy(F.desc("m"), "y"))).filter("k <= 3").groupBy("img_id").agg(*(F.coalesce(F.max(F.when(F.col("k") == k, F.col("m"))), F.lit(255)).alias(f"m{k}") for k in (1, 2, 3)))
    return top.select("img_id", ((F.col("m1") - F.col("m2") > F.col("m2") - F.col("m3")) & (F.col("m1") - F.col("m2") > 1)).alias("lost"))


def checksums(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, crc32, adler32) of each text's UTF-8 bytes; a null text has the sums of no bytes."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([zlib.adler32((x.as_py() or "").encode()) for x in b.column(2)], pa.int64())], names=[id_col, "crc32", "adler32"])

    crc = F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).cast("long")
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, crc.alias("crc32"), text_col).mapInArrow(run, f"{id_col} {kind}, crc32 long, adler32 long")


def whole_functions(df: DataFrame, name: str) -> DataFrame:
    """name with its integer root, its logarithm to base 2 rounded down and up, its big-endian byte order reversed (32 bits)."""
    c = F.col(name)
    lo = F.length(F.bin(c)) - 1
    swap = F.shiftleft(c.bitwiseAND(255), 24).bitwiseOR(F.shiftleft(F.shiftright(c, 8).bitwiseAND(255), 16)).bitwiseOR(F.shiftleft(F.shiftright(c, 16).bitwiseAND(255), 8)).bitwiseOR(F.shiftright(c, 24).bitwiseAND(255))
    return df.select(name, F.floor(F.sqrt(c.cast("double"))).cast("long").alias("root"), lo.cast("int").alias("log_lo"), F.when(c == F.expr(f"shiftleft(1L, cast(length(bin({name})) - 1 as int))"), lo).otherwise(lo + 1).cast("int").alias("log_hi"), swap.cast("long").alias("swapped"))


def box_features(df: DataFrame, size: int = 8) -> DataFrame:
    """(img_id, label, feature, value): two-rectangle contrasts of small images: left less right, top less bottom, centre less border, and diagonal halves."""
    half, quarter = size // 2, size // 4
    centre = (F.col("x") >= quarter) & (F.col("x") < size - quarter) & (F.col("y") >= quarter) & (F.col("y") < size - quarter)
    sign = {"left_right": F.col("x") < half, "top_bottom": F.col("y") < half, "centre_border": centre, "diagonal": (F.col("x") < half) == (F.col("y") < half)}
    wide = df.groupBy("img_id", "label").agg(*(F.sum(F.when(c, F.col("v")).otherwise(-F.col("v"))).alias(n) for n, c in sign.items()))
    return wide.unpivot(["img_id", "label"], list(sign), "feature", "value")


# 20 bits after the point; pi, half of it and multiples as whole numbers; tables of 1024 steps a unit, rounded.
ONE, STEP, PI, HALF_PI = 1 << 20, 1 << 10, 3294199, 1647099
TURN, HALF_TURN, QUARTER_TURN = 6588397, 3294198, 1647099


def tabled(entry, place: Column, rest: Column, bits: int) -> Column:
    """Value between the rounded table entries at `place` and the next, `rest` of 2^bits on."""
    low, high = (F.floor(entry(p) * ONE + 0.5).cast("long") for p in (place, place + 1))
    return low + F.shiftright((high - low) * rest, bits)


def cosine(x: Column) -> Column:
    """Cosine of an angle in 2^-20 radians."""
    x = F.abs(x) % TURN
    folded = F.when(x >= HALF_TURN, x - HALF_TURN).otherwise(x)
    steep = folded >= QUARTER_TURN
    y = F.when(steep, F.lit(HALF_TURN) - folded).otherwise(folded)
    value = tabled(lambda p: F.cos(p / STEP), F.shiftright(y, 10), y % STEP, 10)
    return F.when((x >= HALF_TURN) != steep, -value).otherwise(value)


def logarithm(x: Column, fixed: bool = True) -> Column:
    """Logarithm to base 2, in 2^-20, of a number in 2^-20 (fixed) or a whole number, below 2^32; of 0 the least 32-bit number."""
    order = (F.length(F.bin(x)) - 1).cast("long")
    # The bits after the first, as 22 of them, or as all 32 for whole numbers, of which 10 are the place and 20 the rest.
    if fixed:
        part = F.when(order > 22, F.call_function("shiftrightunsigned", x, (order - 22).cast("int"))).otherwise(F.call_function("shiftleft", x, F.greatest(F.lit(0), 22 - order).cast("int"))) % (1 << 22)
        value = (order - 20) * ONE + tabled(lambda p: F.log2(1 + p / STEP), F.shiftright(part, 12), part % (1 << 12), 12)
    else:
        part = F.call_function("shiftleft", x, (32 - order).cast("int")) % (1 << 32)
        value = order * ONE + tabled(lambda p: F.log2(1 + p / STEP), F.shiftright(part, 22), F.shiftright(part, 2) % ONE, 20)
    return F.when(x == 0, F.lit(-(1 << 31))).otherwise(value)


def power(x: Column) -> Column:
    """Two to the power of a number in 2^-20; above 12 the largest 32-bit number."""
    shift = F.floor(x / ONE)
    part = F.pmod(x, F.lit(ONE))
    value = tabled(lambda p: F.pow(F.lit(2.0), p / STEP), F.shiftright(part, 10), part % STEP, 10)
    return F.when(shift >= 12, F.lit((1 << 32) - 1)).when(shift >= 0, F.call_function("shiftleft", value, shift.cast("int"))).otherwise(F.call_function("shiftright", value, (-shift).cast("int")))


def angle(y: Column, x: Column) -> Column:
    """Angle of (x, y) in 2^-20 radians; both below 2^31."""
    a, b = F.abs(x).cast("long"), F.abs(y).cast("long")
    ratio = F.when(b >= a, F.call_function("div", a * ONE, F.greatest(b, F.lit(1)))).otherwise(F.call_function("div", b * ONE, F.greatest(a, F.lit(1))))
    first = tabled(lambda p: F.atan(p / STEP), F.shiftright(ratio, 10), ratio % STEP, 10)
    first = F.when(b >= a, HALF_PI - first).otherwise(first)
    half = F.when(x < 0, PI - first).otherwise(first)
    return F.when(y == 0, F.when(x >= 0, 0).otherwise(PI)).when(x == 0, F.when(y > 0, HALF_PI).otherwise(-HALF_PI)).otherwise(F.when(y < 0, -half).otherwise(half)).cast("long")


def fixed_functions(df: DataFrame, name: str) -> DataFrame:
    """name with fixed-point functions of it (20 bits after the point): cosine, power of two of what is left by 16, both logarithms to base 2, angle of (name - 2^15, name)."""
    c = F.col(name).cast("long")
    return df.select(name, cosine(c).alias("cosine"), power(c % (16 * ONE) - 4 * ONE).alias("power"), logarithm(c).alias("logarithm"), logarithm(c, False).alias("logarithm_whole"), angle(c - 32768, c).alias("angle"))
