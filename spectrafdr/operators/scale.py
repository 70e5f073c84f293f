"""Building blocks that keep ordered and keyed operators off single tasks.

``materialise``     cut lineage through the cluster's checkpoint folder
``store``           the same for wide rows, as a columnar table
``order_buckets``   range-partition rows into bounded, totally ordered buckets
``running_totals``  prefix sums over such buckets (bucket totals + local window)
``running_low``     running minimum over such buckets
``lookup_join``     equi-join against a unique-key table, safe for hot keys
``shuffle_join``    the same for wide tables: never broadcast, hot keys measured and salted
``attach``          counts a narrow table, then broadcasts it or uses ``shuffle_join``
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Rows one window task may order. Tables up to this size need no range exchange.
ROWS_PER_BUCKET = 2_000_000
# Largest row count of a table that may be broadcast (narrow, numeric rows).
BROADCAST_ROWS = 1_000_000
# A key with at least this many rows is split over several tasks in a join.
HOT_KEY_ROWS = 1_000_000
MAX_SALTS = 4096


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables.

    ``spark.checkpoint.dir`` wins. Only a local session, as in tests, may fall
    back to a temporary folder.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="spectrafdr-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into reliable storage; later jobs read the files."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """As ``materialise`` for wide rows: a columnar table in the shared folder.

    Later jobs read only the columns they use, e.g. one score instead of all peaks.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def order_buckets(df: DataFrame, keys: list[Column], n_rows: int) -> DataFrame:
    """Add ``_bucket`` so that bucket order follows ``keys`` order.

    One bucket suffices for up to ``ROWS_PER_BUCKET`` rows. Beyond that Spark's
    range partitioner samples the composite key, so a key value that repeats in a
    third of the rows is still split as long as a later key column tells its rows
    apart. The result is materialised because range bounds are re-sampled per
    execution and the bucket ids must not move between uses.
    """
    n_buckets = -(-n_rows // ROWS_PER_BUCKET)
    if n_buckets <= 1:
        return df.withColumn("_bucket", F.lit(0))
    ranged = df.repartitionByRange(n_buckets, *keys)
    return materialise(ranged.withColumn("_bucket", F.spark_partition_id()))


def _is_single_bucket(n_rows: int) -> bool:
    return n_rows <= ROWS_PER_BUCKET


def running_totals(
    bucketed: DataFrame,
    keys: list[Column],
    sums: dict[str, Column],
    n_rows: int,
    inclusive: bool = False,
    within: list[str] | None = None,
) -> DataFrame:
    """Add one running sum per entry of ``sums`` in ``keys`` order.

    Exclusive sums (rows strictly before) by default. ``within`` restarts the sums
    per group; groups may span buckets. Work per task is one bucket; the offsets
    table has one row per (bucket, group).
    """
    groups = list(within or [])
    last = 0 if inclusive else -1
    local = (
        Window.partitionBy("_bucket", *groups)
        .orderBy(*keys)
        .rowsBetween(Window.unboundedPreceding, last)
    )
    running = {name: F.coalesce(F.sum(value).over(local), F.lit(0)) for name, value in sums.items()}
    if _is_single_bucket(n_rows):
        return bucketed.withColumns(running)
    totals = bucketed.groupBy("_bucket", *groups).agg(
        *[F.sum(value).alias(f"_t_{name}") for name, value in sums.items()]
    )
    before = (
        Window.partitionBy(*groups)
        .orderBy("_bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = totals.select(
        "_bucket",
        *groups,
        *[
            F.coalesce(F.sum(f"_t_{name}").over(before), F.lit(0)).alias(f"_o_{name}")
            for name in sums
        ],
    )
    if not groups:
        offsets = F.broadcast(offsets)  # one row per bucket
    joined = bucketed.withColumns(running).join(offsets, ["_bucket", *groups])
    return joined.withColumns({name: F.col(name) + F.col(f"_o_{name}") for name in sums}).drop(
        *[f"_o_{name}" for name in sums]
    )


def running_low(
    bucketed: DataFrame, key: Column, value: Column, name: str, n_rows: int
) -> DataFrame:
    """Running minimum from the lowest key upward; buckets are in DESCENDING key order."""
    local = (
        Window.partitionBy("_bucket")
        .orderBy(key.asc())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    out = bucketed.withColumn(name, F.min(value).over(local))
    if _is_single_bucket(n_rows):
        return out
    lower = Window.orderBy(F.col("_bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    floors = (
        bucketed.groupBy("_bucket")
        .agg(F.min(value).alias("_low"))
        .select("_bucket", F.min("_low").over(lower).alias("_floor"))
    )
    return (
        out.join(F.broadcast(floors), "_bucket")
        .withColumn(name, F.least(F.col(name), F.col("_floor")))
        .drop("_floor")
    )


def carry_down(
    bucketed: DataFrame, key: Column, values: list[str], n_rows: int
) -> DataFrame:
    """Fill NULLs with the last value at a lower key; buckets are in DESCENDING key order."""
    local = (
        Window.partitionBy("_bucket")
        .orderBy(key.asc())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    out = bucketed.withColumns(
        {f"_f_{v}": F.last(v, ignorenulls=True).over(local) for v in values}
    )
    if not _is_single_bucket(n_rows):
        lower = Window.orderBy(F.col("_bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
        tops = (
            bucketed.groupBy("_bucket")
            .agg(
                *[
                    F.max_by(v, F.when(F.col(v).isNotNull(), key)).alias(f"_c_{v}")
                    for v in values
                ]
            )
            .select(
                "_bucket",
                *[F.last(f"_c_{v}", ignorenulls=True).over(lower).alias(f"_c_{v}") for v in values],
            )
        )
        out = out.join(F.broadcast(tops), "_bucket").withColumns(
            {f"_f_{v}": F.coalesce(f"_f_{v}", f"_c_{v}") for v in values}
        )
        out = out.drop(*[f"_c_{v}" for v in values])
    return out.withColumns({v: F.col(f"_f_{v}") for v in values}).drop(
        *[f"_f_{v}" for v in values]
    )


def lookup_join(
    left: DataFrame,
    table: DataFrame,
    key: str,
    table_rows: int | None,
    weight: str | None = None,
    how: str = "left",
    salt_on: list[str] | None = None,
) -> DataFrame:
    """Join ``left`` to a table with a unique ``key``.

    A table of at most ``BROADCAST_ROWS`` counted rows is broadcast. A larger one
    is shuffled; ``weight`` names its column with the number of left rows per key,
    and keys above ``HOT_KEY_ROWS`` are salted: the table row is repeated once per
    salt, the left rows of that key spread over the salts by a hash of
    ``salt_on`` (all comparable columns if omitted). At most
    ``rows / HOT_KEY_ROWS`` keys can be hot, so their list is small.
    """
    if table_rows is not None and table_rows <= BROADCAST_ROWS:
        payload = table.drop(weight) if weight else table
        return left.join(F.broadcast(payload), key, how)
    if weight is None:
        return left.join(table, key, how)
    hot = table.filter(F.col(weight) >= HOT_KEY_ROWS).select(key, _salt_count(weight))
    return _salted_join(left, table.drop(weight), key, hot, how, salt_on)


def _salt_count(weight: str) -> Column:
    return F.least(F.ceil(F.col(weight) / HOT_KEY_ROWS), F.lit(MAX_SALTS)).cast("int").alias("_salts")


def _salted_join(
    left: DataFrame,
    table: DataFrame,
    key: str,
    hot: DataFrame,
    how: str,
    salt_on: list[str] | None,
) -> DataFrame:
    """One shuffle per side; only rows of ``hot`` keys (key, _salts) are spread and repeated."""
    spread_by = salt_on or [
        f.name for f in left.schema.fields if f.dataType.typeName() not in ("map", "variant")
    ]
    salts = F.coalesce("_salts", F.lit(1))
    spread = left.join(F.broadcast(hot), key, "left").withColumn(
        "_salt", F.when(salts > 1, F.pmod(F.xxhash64(*spread_by), salts).cast("int")).otherwise(0)
    )
    repeated = table.join(F.broadcast(hot), key, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), salts - 1))
    )
    return spread.drop("_salts").join(repeated.drop("_salts"), [key, "_salt"], how).drop("_salt")


def shuffle_join(
    left: DataFrame,
    table: DataFrame,
    key: str,
    how: str = "left",
    salt_on: list[str] | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Join to a wide or large table with a unique ``key``, without a forced broadcast.

    Rows of ``left`` per key are counted (one narrow, map-side combined pass), unless the
    caller has such ``counts`` (``key, _w``), and only the hot keys are kept, at most
    ``rows / HOT_KEY_ROWS`` of them. Without any, this is a plain join.
    """
    if counts is None:
        counts = left.groupBy(key).agg(F.count("*").alias("_w"))
    hot = materialise(counts.filter(F.col("_w") >= HOT_KEY_ROWS).select(key, _salt_count("_w")))
    if hot.isEmpty():
        return left.join(table, key, how)
    return _salted_join(left, table, key, hot, how, salt_on)


def attach(
    left: DataFrame,
    table: DataFrame,
    key: str,
    how: str = "left",
    salt_on: list[str] | None = None,
    table_rows: int | None = None,
) -> DataFrame:
    """Join to a narrow unique-key table: broadcast if its count allows, else shuffled."""
    n = table.count() if table_rows is None else table_rows
    if n <= BROADCAST_ROWS:
        return lookup_join(left, table, key, n, how=how)
    return shuffle_join(left, table, key, how, salt_on)
