"""Helpers shared by the corpus operators: word splitting in the JVM, intermediate tables, table access."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The two word definitions of the corpus contracts.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ALNUM_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


_shipped: set[str] = set()


def shipped(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once for an application; they may have no copy on their path."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        root = Path(__file__).resolve().parents[1]
        folder = tempfile.mkdtemp(prefix="lumenframe-")
        with zipfile.ZipFile(at := f"{folder}/{root.name}.zip", "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(at)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    shipped(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only; other letters keep their case."""
    return F.translate(c, UPPER, LOWER)


def alnum_words(text: Column) -> Column:
    """Words of ALNUM_WORD of the lower-cased text; a null text has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), ALNUM_GAP), "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset a local one for a local master."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    spark.conf.set("spark.checkpoint.dir", at := "file://" + tempfile.mkdtemp(prefix="lumenframe-"))
    return at


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, reread: lineage ends there and lost executors cost nothing before it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table made by written()."""
    jvm, files = df.sparkSession._jvm, df.inputFiles()
    if files:
        folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def ranked(df: DataFrame, keys: list[str], order: list[str | Column], salt_on: Column, salts: int, name: str, extra: DataFrame | None = None) -> DataFrame:
    """Adds `name`, a gapless rank from 0 within keys, without bringing a key's rows together.

    Rows are split by a salt; counts of (keys, salt) give each piece its first rank, and pieces are numbered apart. `order` must settle
    the place of a row within its piece; equal rows may trade places. Keys may be null. extra: a table of one row for each value of the
    keys; its other columns are added too, by way of the pieces, so a hot key isn't joined in one task.
    """
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(F.lit(7), salt_on), F.lit(salts)).cast("int"))
    counts = salted.groupBy(*keys, "__salt").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "__salt", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    more = [c for c in extra.columns if c not in keys] if extra is not None else []
    if extra is not None:
        starts = starts.join(extra, [starts[k].eqNullSafe(extra[k]) for k in keys], "left").select(*(starts[c] for c in starts.columns), *(extra[c] for c in more))
    within = Window.partitionBy(*keys, "__salt").orderBy(*order)
    rows = salted.withColumn("__at", F.row_number().over(within) - 1)
    on = [rows["__salt"] == starts["__salt"], *(rows[k].eqNullSafe(starts[k]) for k in keys)]
    return rows.join(starts, on).select(*(rows[c] for c in df.columns), (starts["__first"] + rows["__at"]).cast("long").alias(name), *(starts[c] for c in more))


def before(df: DataFrame, keys: list[str], amount: str, order: list[str], salt_on: Column, salts: int, name: str, largest_first: bool = False) -> DataFrame:
    """Adds `name`, the sum of `amount` over the rows before, within keys, without bringing a key's rows together.

    Rows stand by salt, or by amount, the largest first, and then by salt; sums by (keys, amount, salt) give each such piece its start, and pieces are added
    up apart by `order`, which must settle the place of a row within its piece. Keys are not null.
    """
    major = [amount] if largest_first else []
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(F.lit(13), salt_on), F.lit(salts)).cast("int"))
    pieces = salted.groupBy(*keys, *major, "__salt").agg(F.sum(amount).alias("__sum"))
    earlier = Window.partitionBy(*keys).orderBy(*(F.desc(m) for m in major), "__salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select(*keys, *major, "__salt", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(*keys, *major, "__salt").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = salted.withColumn("__in", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    return rows.join(starts, [*keys, *major, "__salt"]).select(*(rows[c] for c in df.columns), (F.col("__start") + F.col("__in")).alias(name))
