"""Deterministic PSM-like views over the given tables, in Spark and in SQL.

The given tables hold no mass spectra; these views read the whole tables and shape
them like PSMs, beams, spectra, peptides and proteins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrafdr.functions import peptides as P
from spectrafdr.operators import scale

# Letters with a residue mass, in table order.
RESIDUE_LETTERS = "GASPVTCLINDQKEMHFRYWUO"
EPOCH = 1704067200  # 2024-01-01T00:00:00Z


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table as a stream of files, whether it is one file or a folder of them."""
    schema = table(spark, folder, name).schema
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    reader = spark.readStream.schema(schema)
    if system.getFileStatus(path).isDirectory():
        return reader.parquet(f"{folder}/{name}.parquet")
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


# --- scored PSMs: one row per event ------------------------------------------

_PSM_COLUMNS = f"""
  concat(event_type, ':', event_id) AS spectrum_id,
  event_id,
  event_type AS experiment_name,
  user_id,
  value / (value + 5e1) AS confidence,
  ((event_id * 7919) % 1000) / 1e3 < value / (value + 5e1) AS correct,
  {{seconds}} - {EPOCH} AS retention_time,
  translate(cast(1000000 + user_id * 7919 AS varchar(20)), '0123456789', 'GASPVTCIND') AS peptide
"""

PSM_SQL = f"psm AS (SELECT {_PSM_COLUMNS.format(seconds='epoch_us(ts) / 1e6')} FROM events)"


def psm(spark: SparkSession, folder: str) -> DataFrame:
    return psm_of(table(spark, folder, "events"))


def psm_of(events: DataFrame) -> DataFrame:
    """The view over a table or a stream of events."""
    spark_sql = _PSM_COLUMNS.format(seconds="unix_micros(cast(ts AS timestamp)) / 1e6")
    parts = [p.strip() for p in spark_sql.replace("varchar(20)", "string").strip().split(",\n")]
    return events.selectExpr(*parts)


# --- the same with NaN and NULL scores; ``sound`` are the rows whose score can be ranked --------

GAPS_SQL = f"""{PSM_SQL}, gaps AS (
  SELECT * REPLACE (CASE WHEN event_id % 11 = 0 THEN 'nan'::double
                         WHEN event_id % 13 = 0 THEN NULL ELSE confidence END AS confidence) FROM psm),
sound AS (SELECT * FROM gaps WHERE confidence IS NOT NULL AND NOT isnan(confidence))"""


def psm_with_gaps(spark: SparkSession, folder: str) -> DataFrame:
    score = (
        F.when(F.col("event_id") % 11 == 0, F.lit(float("nan")))
        .when(F.col("event_id") % 13 == 0, F.lit(None).cast("double"))
        .otherwise(F.col("confidence"))
    )
    return psm(spark, folder).withColumn("confidence", score)


# --- labelled documents: NULL label where no label row exists -----------------

DOC_SQL = """doc AS (
  SELECT d.doc_id, d.source, d.n_chars / (d.n_chars + 1e3) AS confidence,
         l.quality IS NOT NULL AS valid_sequence, coalesce(l.quality, 0) = 1 AS correct
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def documents_scored(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "n_chars")
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id", "left").select(
        "doc_id",
        "source",
        F.expr("n_chars / (n_chars + 1e3)").alias("confidence"),
        F.col("quality").isNotNull().alias("valid_sequence"),
        (F.coalesce("quality", F.lit(0)) == 1).alias("correct"),
    )


# --- candidates: the lines of an order ----------------------------------------

LETTERS_SQL = f"regexp_replace(upper(p_name), '[^{RESIDUE_LETTERS}]', '', 'g')"

CANDIDATE_SQL = f"""cand AS (
  SELECT l_orderkey, l_linenumber, l_quantity, l_tax, l_discount * 1e1 AS prob, {LETTERS_SQL} AS seq
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def letters(column: str = "p_name"):
    return F.regexp_replace(F.upper(column), f"[^{RESIDUE_LETTERS}]", "")


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_tax",
        F.expr("l_discount * 1e1").alias("prob"),
    )
    parts = table(spark, folder, "part").select("p_partkey", letters().alias("seq"))
    named = parts.withColumnRenamed("p_partkey", "l_partkey")
    return scale.attach(lines, named, "l_partkey", how="inner").drop("l_partkey")


BEAM_SQL = f"""{CANDIDATE_SQL}, beam AS (
  SELECT l_orderkey, list(prob ORDER BY prob DESC, seq) AS p, list(seq ORDER BY prob DESC, seq) AS s
  FROM cand WHERE prob > 0 GROUP BY l_orderkey)"""


def beams(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order; its lines with a positive probability, best first."""
    entry = F.struct((-F.col("prob")).alias("k"), "seq", F.log("prob").alias("log_prob"))
    return (
        candidates(spark, folder)
        .filter("prob > 0")
        .groupBy("l_orderkey")
        .agg(F.array_sort(F.collect_list(entry)).alias("e"))
        .select(
            "l_orderkey",
            F.transform(
                "e",
                lambda x: F.struct(
                    P.tokenise(x["seq"]).alias("sequence"),
                    x["log_prob"].alias("log_prob"),
                    F.lit(None).cast("array<double>").alias("token_log_probs"),
                ),
            ).alias("beams"),
        )
    )


# --- precursor masses: parts ---------------------------------------------------

PART_SQL = f"""pep AS (
  SELECT p_partkey, {LETTERS_SQL} AS seq, p_retailprice AS precursor_mz,
         cast(1 + p_partkey % 4 AS integer) AS precursor_charge FROM part)"""


def part_peptides(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        "p_partkey",
        P.tokenise(letters()).alias("prediction"),
        F.col("p_retailprice").alias("precursor_mz"),
        F.expr("cast(1 + p_partkey % 4 AS int)").alias("precursor_charge"),
    )


# --- peptide notation: parts with modifications --------------------------------

NOTATION_CASE = """CASE p_partkey % 6
  WHEN 0 THEN concat('(+42.01)', seq)
  WHEN 1 THEN concat('M(ox)', seq)
  WHEN 2 THEN concat(seq, 'C(+57.02)K')
  WHEN 3 THEN concat('[UNIMOD:1]-', seq, 'S[UNIMOD:21]')
  WHEN 4 THEN concat(seq, '-[UNIMOD:2]')
  ELSE seq END"""


# --- spectra: embeddings as 64 peaks -------------------------------------------

SPECTRUM_SQL = """spec AS (
  SELECT vec_id, label, cast(generate_subscripts(embedding, 1) AS bigint) - 1 AS i,
         abs(cast(unnest(embedding) AS double)) AS h FROM embeddings)"""


def spectra(spark: SparkSession, folder: str) -> DataFrame:
    """64 peaks at m/z 100, 110, ...; intensities are the absolute components."""
    return table(spark, folder, "embeddings").select(
        "vec_id",
        "label",
        F.concat(F.lit("v:"), F.col("vec_id")).alias("spectrum_id"),
        F.expr("transform(sequence(0, size(embedding) - 1), i -> 1e2 + 1e1 * i)").alias("mz_array"),
        F.expr("transform(embedding, e -> abs(cast(e AS double)))").alias("intensity_array"),
    )


# Predicted ions of a spectrum: every second fragment b1, y1, b2, y2, ... sits on a
# peak (offset 0.005), the others miss by 0.5; predicted height from the position.
ION_SQL = """ion AS (
  SELECT vec_id, i, 1e2 + 1e1 * i + CASE WHEN (vec_id + i) % 3 = 0 THEN 5e-1 ELSE 5e-3 END AS mz,
         1e0 + (i * 7 + vec_id) % 10 AS intensity,
         CASE WHEN i % 2 = 0 THEN 'b' ELSE 'y' END AS kind, i // 2 + 1 AS num, h
  FROM spec WHERE i < 40)"""


def predicted_ions(spark: SparkSession, folder: str) -> DataFrame:
    """Long predicted-ion table, 40 ions per spectrum."""
    base = table(spark, folder, "embeddings").select(
        "vec_id", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("i")
    )
    return base.select(
        F.concat(F.lit("v:"), F.col("vec_id")).alias("spectrum_id"),
        F.lit("PEPTIDE").alias("peptide_sequences"),
        F.lit(2).alias("precursor_charges"),
        F.lit(27).alias("collision_energies"),
        F.expr("1e0 + (i * 7 + vec_id) % 10").alias("intensities"),
        F.expr("1e2 + 1e1 * i + CASE WHEN (vec_id + i) % 3 = 0 THEN 5e-1 ELSE 5e-3 END").alias("mz"),
        F.expr("concat(CASE WHEN i % 2 = 0 THEN 'b' ELSE 'y' END, i div 2 + 1, '+1')").alias(
            "annotation"
        ),
    )


# --- proteins and peptides: documents and benchmark passages --------------------

# Strip to the 20 residue letters in both cases FIRST, then fold the case.
_TWENTY = "ACDEFGHIKLMNPQRSTVWYacdefghiklmnpqrstvwy"
PROTEIN_SQL = f"""prot AS (
  SELECT doc_id, replace(upper(regexp_replace(text, '[^{_TWENTY}]', '', 'g')), 'I', 'L') AS hay
  FROM documents)"""

# Every passage whole, and all of its consecutive 9-letter and 30-letter pieces.
PEPTIDE_SQL = f"""stripped AS (
  SELECT item_id, upper(regexp_replace(text, '[^{_TWENTY}]', '', 'g')) AS t FROM benchmark),
pept AS (
  SELECT item_id, 0 AS k, 0 AS pos, t AS pep FROM stripped
  UNION ALL SELECT item_id, 9, j, substr(t, cast(j * 9 + 1 AS bigint), 9)
    FROM (SELECT item_id, t, unnest(range(0, length(t) // 9)) AS j FROM stripped)
  UNION ALL SELECT item_id, 30, j, substr(t, cast(j * 30 + 1 AS bigint), 30)
    FROM (SELECT item_id, t, unnest(range(0, length(t) // 30)) AS j FROM stripped))"""


def proteins(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        "doc_id", F.upper(F.regexp_replace("text", f"[^{_TWENTY}]", "")).alias("sequence")
    )


def benchmark_peptides(spark: SparkSession, folder: str) -> DataFrame:
    base = table(spark, folder, "benchmark").select(
        "item_id", F.upper(F.regexp_replace("text", f"[^{_TWENTY}]", "")).alias("t")
    )

    def pieces(size: int) -> DataFrame:
        whole = F.floor(F.length("t") / size)
        return base.filter(F.length("t") >= size).select(
            "item_id", F.lit(size).alias("k"), "t",
            F.explode(F.sequence(F.lit(0), (whole - 1).cast("int"))).alias("pos"),
        ).select(
            "item_id", "k", "pos",
            F.substring("t", F.col("pos") * size + 1, F.lit(size)).alias("pep"),
        )

    whole = base.select("item_id", F.lit(0).alias("k"), F.lit(0).alias("pos"), F.col("t").alias("pep"))
    return whole.unionByName(pieces(9)).unionByName(pieces(30))
