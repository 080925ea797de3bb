"""Helpers shared by the training-data operators: shared folders, staging, row keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"

#: Near duplicates: words in a shingle, and the least similarity of a link.
SHINGLE_WORDS = 5
MIN_SIMILARITY = 0.8


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where the session names none and runs in one process (as in local tests) a temporary folder is set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = held.get() if held.isDefined() else None
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="graphloom-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def stage(df: DataFrame, tag: str, codec: str = "zstd", split_bytes: int | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a reread of these files, not a recomputation, and
    columns that a later step doesn't need aren't read.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphloom/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_key(side: DataFrame) -> DataFrame:
    """side, whose join is by a shuffle of both sides, however small Spark takes it for.

    Estimates come from the bytes of compressed files, so a side that grows with the input can be many times its estimate
    once it is a hash table in the driver's memory, and some such tables are there at once.
    """
    return side.hint("merge")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def digest(name: str = "text") -> Column:
    """128 bits that stand for a text in joins and groupings."""
    return F.unhex(F.md5(text_of(name)))


def sum_long(column: Column | str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0)).cast("long")


def boxed(docs: DataFrame, *needed: str | Column, without: tuple[str, ...] = ()) -> DataFrame:
    """docs as one column `row_box`, whatever its columns are called, beside those that are needed; `without`: columns that come anew."""
    inner = [(F.lit(None).cast(docs.schema[c].dataType) if c in without else F.col(f"`{c}`")).alias(f"c{k}") for k, c in enumerate(docs.columns)]
    return docs.select(F.struct(*inner).alias("row_box"), *needed)


def unboxed(df: DataFrame, columns: list[str], **replaced: Column) -> DataFrame:
    """The columns of boxed rows again, some of them replaced."""
    return df.select(*(replaced.get(c, F.col(f"row_box.c{k}")).alias(c) for k, c in enumerate(columns)))
