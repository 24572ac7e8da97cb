"""Images and markup as DataFrames: 8-bit BMP and PGM files in and out, circle markup in text, run reports."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIXELS = "path string, h int, w int, px binary, problem string"


def decode(data: bytes) -> tuple[int, int, bytes]:
    """(height, width, grey values by rows from the top) of an uncompressed BMP of 8, 24 or 32 bits, or a binary PGM."""
    if data[:2] == b"P5":
        fields, at = [], 2
        while len(fields) < 3:
            while data[at : at + 1].isspace():
                at += 1
            if data[at : at + 1] == b"#":
                at = data.index(b"\n", at)
                continue
            end = at
            while not data[end : end + 1].isspace():
                end += 1
            fields.append(int(data[at:end]))
            at = end
        w, h, most = fields
        if most > 255:
            raise ValueError("16-bit PGM")
        return h, w, data[at + 1 : at + 1 + w * h]
    if data[:2] != b"BM":
        raise ValueError("neither BMP nor PGM")
    start, head, w, h, _, bits, packed = struct.unpack_from("<I I i i H H I", data, 10)
    if packed:
        raise ValueError("compressed BMP")
    rows, stride = abs(h), (w * bits // 8 + 3) // 4 * 4
    raw = np.frombuffer(data, np.uint8, rows * stride, start).reshape(rows, stride)
    if bits == 8:
        palette = np.frombuffer(data, np.uint8, start - 14 - head, 14 + head)[:1024].reshape(-1, 4)[:, :3].mean(1).round().astype(np.uint8)
        grey = raw[:, :w] if not len(palette) else palette[raw[:, :w]]
    elif bits in (24, 32):
        grey = raw[:, : w * bits // 8].reshape(rows, w, bits // 8)[:, :, :3].mean(2).round().astype(np.uint8)
    else:
        raise ValueError(f"{bits}-bit BMP")
    return rows, w, (grey[::-1] if h > 0 else grey).tobytes()


def encode(h: int, w: int, px: bytes) -> bytes:
    """An 8-bit grey BMP."""
    stride = (w + 3) // 4 * 4
    rows = np.zeros((h, stride), np.uint8)
    rows[:, :w] = np.frombuffer(px, np.uint8).reshape(h, w)[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, axis=1)
    palette[:, 3] = 0
    start = 54 + 1024
    return b"BM" + struct.pack("<IHHI", start + rows.size, 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8, 0, rows.size, 2835, 2835, 256, 0) + palette.tobytes() + rows.tobytes()


def read_images(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, h, w, px, problem): one row a file; a file that can't be read has a problem and no pixels, and doesn't stop the others."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    out.append((path, *decode(bytes(content)), None))
                except (ValueError, struct.error, IndexError) as e:
                    out.append((path, None, None, None, str(e) or type(e).__name__))
            yield pd.DataFrame(out, columns=["path", "h", "w", "px", "problem"]).astype({"h": "Int32", "w": "Int32"})

    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content").mapInPandas(run, PIXELS)


def pixels(images: DataFrame) -> DataFrame:
    """(path, y, x, v) of images: the dense form in long form."""
    byte = F.posexplode(F.transform(F.sequence(F.lit(0), F.col("h") * F.col("w") - 1), lambda i: F.conv(F.hex(F.substring("px", i + 1, F.lit(1))), 16, 10).cast("int")))
    return images.filter("problem is null").select("path", "w", byte.alias("i", "v")).select("path", F.expr("cast(i div w as int)").alias("y"), F.expr("cast(i % w as int)").alias("x"), "v")


def packed(long: DataFrame, key: str = "img_id") -> DataFrame:
    """(key, h, w, bmp): long form to BMP files, an image a task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h, w = int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1
        a = np.zeros((h, w), np.uint8)
        a[pdf["y"], pdf["x"]] = pdf["v"].to_numpy() & 255
        return pd.DataFrame({key: [pdf[key].iloc[0]], "h": [h], "w": [w], "bmp": [encode(h, w, a.tobytes())]})

    kind = long.schema[key].dataType.simpleString()
    return long.select(key, "y", "x", "v").groupBy(key).applyInPandas(run, f"{key} {kind}, h int, w int, bmp binary")


MARKUP = "name string, px int, py int, pr int, ix int, iy int, ir int"


def read_markup(spark: SparkSession, path: str) -> DataFrame:
    """Lines `name px py pr ix iy ir`, parted by white space; lines of other shape are left out."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f")).filter(F.size("f") == 7)
    numbers = [F.expr(f"try_cast(f[{i + 1}] as int)").alias(n) for i, n in enumerate(("px", "py", "pr", "ix", "iy", "ir"))]
    return parts.select(F.col("f")[0].alias("name"), *numbers).dropna()


def write_report(histograms: DataFrame, path: str) -> None:
    """One line a kind: its name and the cumulative counts of all bins."""
    wide = histograms.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("b"))
    wide.select(F.concat_ws(" ", "kind", F.transform("b", lambda x: x["n"].cast("string"))).alias("line")).write.mode("overwrite").text(path)
