"""Exact-size random splits and samples without a global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectrafdr.operators import scale

# A boundary cell with at most this many rows is ranked directly.
_SMALL_CELL = 10_000


def _hash(id_column: str, seed: int) -> Column:
    return F.xxhash64(F.col(id_column).cast("string"), F.lit(seed))


def _cell(h: Column, level: int) -> Column:
    """Hash bits 63..48 (level 0), 47..32 (level 1), ... as an ordered integer."""
    return F.shiftrightunsigned(h, 48 - 16 * level).bitwiseAND(F.lit(0xFFFF))


def mark_random_rows(df: DataFrame, id_column: str, k: int, seed: int, name: str) -> DataFrame:
    """Add boolean ``name``: TRUE for exactly ``k`` rows, picked by a seeded hash of a unique id.

    The k-th smallest hash is located on counts of 65,536 equal hash cells, and
    again inside the boundary cell while that one is large; only the last, small
    cell is ranked. The choice depends on ids and seed alone, not on partitioning.
    """
    h = _hash(id_column, seed)
    if k <= 0:
        return df.withColumn(name, F.lit(False))
    inside, smaller, needed = F.lit(True), F.lit(False), k
    for level in range(3):
        cell = _cell(h, level)
        upto = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        edge = (
            df.filter(inside)
            .groupBy(cell.alias("cell"))
            .agg(F.count("*").alias("n"))
            .withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
            .filter((F.col("before") < needed) & (F.col("before") + F.col("n") >= needed))
            .first()
        )
        if edge is None:  # fewer than k rows in total
            return df.withColumn(name, F.lit(True))
        smaller = smaller | (inside & (cell < edge["cell"]))
        inside = inside & (cell == edge["cell"])
        needed -= edge["before"]
        if edge["n"] <= _SMALL_CELL:
            break
    own = F.struct(h.alias("h"), F.col(id_column).cast("string").alias("i"))
    last = (
        df.filter(inside)
        .select(own.alias("own"))
        .orderBy("own")
        .limit(needed)
        .agg(F.max("own").alias("own"))
        .first()["own"]
    )
    limit = F.struct(F.lit(last["h"]).alias("h"), F.lit(last["i"]).alias("i"))
    return df.withColumn(name, smaller | (inside & (own <= limit)))


def random_split(
    df: DataFrame, id_column: str, fraction: float, seed: int = 42
) -> tuple[DataFrame, DataFrame | None]:
    """(train, validation) with ``max(1, int(n * fraction))`` validation rows."""
    if not fraction or fraction <= 0:
        return df, None
    n_val = max(1, int(df.count() * fraction))
    marked = mark_random_rows(df, id_column, n_val, seed, "_val")
    return marked.filter(~F.col("_val")).drop("_val"), marked.filter("_val").drop("_val")


def sample_at_most(df: DataFrame, id_column: str, k: int | None, seed: int = 42) -> DataFrame:
    """The whole frame, or exactly ``k`` hash-picked rows when it is larger."""
    if not k or k <= 0 or df.count() <= k:
        return df
    return mark_random_rows(df, id_column, k, seed, "_keep").filter("_keep").drop("_keep")


def named_rows(df: DataFrame, name: str) -> DataFrame:
    """Rows with a unique id made of their values and, for equal rows, a number.

    So a split by this id does not depend on files or partitions. Equal rows are counted on the
    map side and numbered by a sequence, not by a window over all of them.
    """
    columns = [F.col(f"`{c}`") for c in df.columns]
    text = F.to_json(F.struct(*columns))
    counted = df.groupBy(*columns).agg(F.count("*").alias("_copies"))
    numbered = counted.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies")))
    return scale.materialise(
        numbered.withColumn(name, F.concat(F.sha2(text, 256), F.lit(":"), F.col("_copy").cast("string"))).select(*columns, name)
    )


def group_split(
    df: DataFrame, group: str, fraction: float, seed: int = 42
) -> tuple[DataFrame, DataFrame | None]:
    """(train, validation) without a group on both sides.

    Whole groups, in the order of a seeded hash, go to validation until it has at least
    ``fraction`` of the rows; so its share is met within one group. The last group always
    trains. Groups with a NULL name are one group. Rows are counted per group (map-side
    combined), the counts ordered in range buckets; no list of groups reaches the driver.
    """
    if not fraction or fraction <= 0:
        return df, None
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(group).cast("string"), F.lit("\0"))))
    sizes = scale.materialise(df.groupBy(F.col(group).alias("_group")).agg(F.count("*").alias("_n"), F.min(key).alias("_key")))
    total = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count("*").alias("groups")).first()
    order = [F.col("_key").asc()]
    bucketed = scale.order_buckets(sizes, order, total["groups"])
    before = scale.running_totals(bucketed, order, {"_before": F.col("_n")}, total["groups"])
    is_last = F.col("_before") + F.col("_n") == F.lit(total["rows"])
    marked = before.select("_group", ((F.col("_before") < F.lit(fraction * total["rows"])) & ~is_last).alias("_val"))
    marked = scale.materialise(marked.withColumn("_key", F.coalesce(F.col("_group").cast("string"), F.lit("\0"))).select("_key", "_val"))
    keyed = df.withColumn("_key", F.coalesce(F.col(group).cast("string"), F.lit("\0")))
    out = scale.attach(keyed, marked, "_key", table_rows=total["groups"]).drop("_key")
    return out.filter(~F.col("_val")).drop("_val"), out.filter("_val").drop("_val")
