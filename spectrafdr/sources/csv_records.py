"""CSV files with quoted line breaks, read by many tasks.

A line break ends a record only where an even number of quotes stands before it in the file.
Spark splits text files at line breaks, so:

1. lines are stored with their file, split and place; quotes are counted per split, and the
   parities of the splits before it tell whether a split begins inside a quoted cell;
2. within a split a running parity marks the lines that start a record;
3. lines that are a record of their own stay where they are, only pieces of longer records
   are brought together, record by record;
4. records are parsed as CSV by Spark's own parser.

A file without a record over several lines, and without a carriage return in a quoted cell, goes
straight to Spark's splittable reader.

An empty cell is NULL without quotes and an empty text with them, as Spark writes the two.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spectrafdr.operators import scale

_OPTIONS = {"quote": '"', "escape": '"', "multiLine": "true", "lineSep": "\n"}


def _odd(line: str) -> Column:
    """1 for a line with an odd number of quotes."""
    return ((F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))) % 2).cast("long")


def _quoted_return(line: str) -> Column:
    """1 for a line with a carriage return in a quoted cell, where Spark's reader would end a record."""
    def returns(text: Column) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit("\r"), F.lit("")))

    unquoted = F.regexp_replace(line, '"[^"]*"', "")
    return F.when(F.contains(F.col(line), F.lit("\r")), (returns(F.col(line)) > returns(unquoted)).cast("int")).otherwise(0)


def read_csv(spark: SparkSession, path: str, split_bytes: int | None = None) -> DataFrame:
    """All cells as text, columns named by the header of the (first) file.

    Every file begins with the header. Empty cells without quotes are NULL; a shorter record has
    NULLs. ``split_bytes`` overrides Spark's split size, as tests need.
    """
    # Spark reads quoted empty cells as NULL unless NULL has another text; a new one is in no cell.
    absent = uuid.uuid4().hex
    reader = spark.read.option("lineSep", "\n")
    if split_bytes:
        before = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
    try:
        lines = reader.text(path).select(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
            F.monotonically_increasing_id().alias("at"), "value",
        )
        found = lines.select(F.max(_odd("value")).alias("odd"), F.max(_quoted_return("value")).alias("returns")).first()
        if not found["odd"] and not found["returns"]:
            return spark.read.csv(path, header=True, quote='"', escape='"', nullValue=absent)
        lines = scale.store(lines.withColumn("odd", _odd("value")))
    finally:
        if split_bytes:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    records = scale.store(_records(lines))
    first = scale.materialise(records.groupBy("file").agg(F.min("at").alias("at"), F.min_by("record", "at").alias("header")))
    header = first.orderBy("file").limit(1).select(F.from_csv("header", ", ".join(f"c{i} string" for i in range(2000)), _OPTIONS).alias("h"))
    names = [n for n in header.first()["h"] if n is not None]
    body = records.join(first.select("file", "at"), ["file", "at"], "left_anti").filter("record <> ''")
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    parsed = body.select(F.from_csv("record", schema, {**_OPTIONS, "nullValue": absent}).alias("r"))
    return parsed.select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)])


def _records(lines: DataFrame) -> DataFrame:
    """``file, at, record``: whole records with the place of their first line."""
    in_split = Window.partitionBy("file", "split").orderBy("at")
    before = in_split.rowsBetween(Window.unboundedPreceding, -1)
    upto = in_split.rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    # One row per split.
    splits = lines.groupBy("file", "split").agg(F.sum("odd").alias("odd"))
    splits = splits.select("file", "split", (F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2).alias("open"))
    placed = lines.join(splits, ["file", "split"]).withColumn(
        "inside", (F.col("open") + F.coalesce(F.sum("odd").over(before), F.lit(0))) % 2
    )
    own = F.last(F.when(F.col("inside") == 0, F.col("at")), ignorenulls=True).over(upto)
    placed = scale.materialise(placed.withColumn("start", own).select("file", "split", "at", "value", "odd", "inside", "start"))
    # Lines at the head of a split may belong to the last record begun before it.
    last = placed.groupBy("file", "split").agg(F.max("start").alias("start"))
    carried = last.select("file", "split", F.last("start", ignorenulls=True).over(earlier).alias("carried"))
    placed = placed.join(carried, ["file", "split"]).withColumn("start", F.coalesce("start", "carried"))
    alone = (F.col("inside") == 0) & (F.col("odd") == 0)
    single = placed.filter(alone).select("file", "at", F.col("value").alias("record"))
    pieces = placed.filter(~alone).groupBy("file", F.col("start").alias("at")).agg(
        F.array_sort(F.collect_list(F.struct("at", "value"))).alias("lines")
    )
    joined = pieces.select("file", "at", F.array_join(F.transform("lines", lambda x: x["value"]), "\n").alias("record"))
    return single.unionByName(joined).withColumn("record", F.regexp_replace("record", "\r$", ""))
