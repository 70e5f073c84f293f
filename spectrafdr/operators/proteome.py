"""Proteome hits: which peptides occur inside any protein, in one pass over the proteins.

A theta join on "contains" would compare every pair. Instead every peptide is looked up by
its head, the first ``SPAN`` letters (all of it, mostly), and every head by its seed, the
first ``SEED_LENGTH`` letters:

1. a Bloom filter of bounded size over the first ``SEED_LENGTH`` bytes of all heads is tested
   at every byte of the proteins, over whole Arrow batches at once; only positions that pass
   become rows (a window of ``SPAN`` letters). A known seed then cuts one head per wanted
   length - never one row per peptide sharing the seed; up to ``MAX_SEED_ROWS`` seeds and
   heads are broadcast, beyond that the survivors travel to their seeds;
2. heads that occur settle all peptides of at most ``SPAN`` letters by a semi join;
3. for longer ones the places of their heads, few by now, go to the proteins once more and
   cut out one substring per wanted length, which meet the peptides in a semi join.

Work is linear in protein letters (times lengths on matching seeds) whatever the number of
peptides behind a seed or of copies of a protein, and whatever the longest peptide.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spectrafdr.functions import peptides as P
from spectrafdr.operators import scale
from spectrafdr.operators.filters import long_enough

SEED_LENGTH = 7
SPAN = 64
# Bytes of the proteins tested at a time, and windows cut at a time.
CHUNK_LENGTH = 131_072
PIECE_LENGTH = 16_384
# Heads have at most SPAN letters and seeds at most SPAN lengths: below about 100 MB broadcast.
MAX_SEED_ROWS = 500_000
# The Bloom filter travels with the plan. Beyond this size it only lets more survivors through.
FILTER_BYTES = 8_388_608
FILTER_BYTES_PER_SEED = 8
# One odd multiplier per hash; the highest bits of the product are the place.
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def found_peptides(peptides: DataFrame, proteins: DataFrame) -> DataFrame:
    """Distinct ``peptide`` values that are substrings of any ``sequence``."""
    size = F.length("peptide")
    distinct = scale.materialise(
        peptides.select("peptide").filter(size > 0).distinct().withColumn("_head", F.substring("peptide", 1, SPAN))
    )
    heads = scale.materialise(
        distinct.groupBy(F.col("_head").alias("head")).agg(F.collect_set(F.when(size > SPAN, size)).alias("longer"))
    )
    places = scale.materialise(_places(heads, proteins))
    short = distinct.filter(size <= SPAN).join(
        places.select(F.col("head").alias("_head")).distinct(), "_head", "left_semi"
    )
    whole = _whole(places.filter("id IS NOT NULL"), heads, proteins)
    long = distinct.filter(size > SPAN).join(whole, "peptide", "left_semi")
    return short.select("peptide").unionByName(long.select("peptide"))


def _spots(keys: np.ndarray, size: int, factor: int, n_bits: int) -> np.ndarray:
    """Filter places of ``keys``, the first ``size`` bytes of seeds as numbers."""
    mixed = (keys ^ np.uint64(size << 8 * SEED_LENGTH)) * np.uint64(factor)
    return mixed >> np.uint64(64 - n_bits)


def _keys(data: np.ndarray, count: int, size: int) -> np.ndarray:
    """``size`` bytes from each of the first ``count`` places on; ``data`` has 8 bytes more."""
    return np.ndarray(count, "<u8", data, strides=(1,)) & np.uint64((1 << 8 * size) - 1)


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in one array, with the bounds of each."""
    whole = texts.cast(pa.large_string())
    _, bounds, data = whole.buffers()
    bounds = np.frombuffer(bounds, np.int64)[whole.offset : whole.offset + len(whole) + 1]
    return np.frombuffer(data or b"", np.uint8)[: bounds[-1]], bounds


def _held(held: np.ndarray, spots: np.ndarray) -> np.ndarray:
    """Whether the filter has these bits."""
    return (held[spots >> np.uint64(3)] >> (spots & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _seed_cells(n_bits: int) -> Callable:
    """Filter words that the seeds of a task set, as ``cell, bits``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = _bytes_of(batch.column(0))
            keys = _keys(np.append(data, np.zeros(8, np.uint8)), len(data), SEED_LENGTH)
            sizes = np.minimum(np.diff(bounds), SEED_LENGTH)
            found = [np.zeros(0, np.uint64)]
            for k in np.unique(sizes[sizes > 0]).tolist():
                own = keys[bounds[:-1][sizes == k]] & np.uint64((1 << 8 * k) - 1)
                found += [_spots(own, k, factor, n_bits) for factor in _FACTORS]
            spots = np.unique(np.concatenate(found)).astype(np.int64)
            bits = np.left_shift(np.int64(1), spots & 63)
            cells, first = np.unique(spots >> 6, return_index=True)
            words = np.bitwise_or.reduceat(bits, first) if len(cells) else bits
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(words)], ["cell", "bits"])

    return run


def _seed_filter(seeds: DataFrame, n_seeds: int) -> tuple[np.ndarray, int]:
    """Bloom filter over the first bytes of ``seed``, and the power of two of its bits.

    Bits are set and combined by Spark; at most ``FILTER_BYTES`` come to the driver.
    """
    n_bits = int(np.log2(max(8, min(FILTER_BYTES, FILTER_BYTES_PER_SEED * n_seeds)))) + 3
    cells = seeds.select("seed").mapInArrow(_seed_cells(n_bits), "cell long, bits long")
    cells = cells.groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(1 << (n_bits - 6), np.int64)
    words[cells.column("cell").to_numpy()] = cells.column("bits").to_numpy()
    return words.view(np.uint8), n_bits


def _passing(part: np.ndarray, count: int, sizes: list[int], held: np.ndarray, n_bits: int) -> dict[int, np.ndarray]:
    """Places of a slice whose first bytes may be a seed, per number of bytes."""
    found = {}
    for size in sizes:
        keys = _keys(part, count, size)
        at = np.arange(count)
        for factor in _FACTORS:
            spots = _spots(keys, size, factor, n_bits)
            kept = np.flatnonzero(_held(held, spots))
            keys, at = keys[kept], at[kept]
        found[size] = at
    return found


def _windows(data: np.ndarray, at: np.ndarray, end: np.ndarray) -> pa.Array:
    """The texts ``data[at:end]``."""
    size = end - at
    to = np.concatenate([[0], np.cumsum(size)])
    letters = data[np.arange(to[-1]) + np.repeat(at - to[:-1], size)]
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(to.astype(np.int32)), pa.py_buffer(letters))


def _survivors(held: np.ndarray, n_bits: int, sizes: list[int]) -> Callable:
    """``id, start, window`` of the places of each protein that pass the filter, ``start`` from 1 in letters."""
    span, chunk, piece = SPAN, CHUNK_LENGTH, PIECE_LENGTH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = _bytes_of(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            lead = None  # places where letters begin, if some letter has several bytes
            if len(data) and data.max() > 127:
                begins = (data & 0xC0) != 0x80
                lead, number = np.append(np.flatnonzero(begins), len(data)), np.cumsum(begins) - 1
            for low in range(int(bounds[0]), len(data), chunk):
                count = min(chunk, len(data) - low)
                part = np.zeros(count + 8, np.uint8)
                seen = data[low : low + count + 8]
                part[: len(seen)] = seen
                kept = []
                for size, at in _passing(part, count, sizes, held, n_bits).items():
                    at = at + low
                    kept.append(at[at + size <= bounds[np.searchsorted(bounds, at, "right")]])  # not into the next protein
                places = kept[0] if len(kept) == 1 else np.unique(np.concatenate(kept))
                if lead is not None:
                    places = places[(data[places] & 0xC0) != 0x80]
                for first in range(0, len(places), piece):
                    at = places[first : first + piece]
                    row = np.searchsorted(bounds, at, "right") - 1
                    if lead is None:
                        start, end = at - bounds[row], at + span
                    else:
                        start = number[at] - number[bounds[row]]
                        end = lead[np.minimum(number[at] + span, len(lead) - 1)]
                    windows = _windows(data, at, np.minimum(end, bounds[row + 1]))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(start + 1), windows], ["id", "start", "window"])

    return run


def _may_be_in(seeds: DataFrame) -> Column:
    """Whether column ``seed`` can be one of ``seeds``, by the same filter."""
    held, n_bits = _seed_filter(seeds, seeds.count())

    @F.arrow_udf("boolean")
    def known(texts: pa.Array) -> pa.Array:
        data, bounds = _bytes_of(texts)
        keys = _keys(np.append(data, np.zeros(8, np.uint8)), len(data) + 1, SEED_LENGTH)
        sizes = np.minimum(np.diff(bounds), SEED_LENGTH)
        keys = keys[bounds[:-1]] & ((np.uint64(1) << (8 * sizes).astype(np.uint64)) - np.uint64(1))
        found = np.ones(len(keys), bool)
        for k in np.unique(sizes).tolist():
            for factor in _FACTORS:
                found[sizes == k] &= _held(held, _spots(keys[sizes == k], k, factor, n_bits))
        return pa.array(found)

    return known(F.col("seed"))


def _named(proteins: DataFrame) -> DataFrame:
    """Proteins with a key of their sequence."""
    return proteins.select(F.xxhash64("sequence").alias("id"), "sequence")


def _places(heads: DataFrame, proteins: DataFrame) -> DataFrame:
    """``head`` of every head that occurs; for heads of longer peptides with ``id`` and ``start``."""
    seed = F.substring("head", 1, SEED_LENGTH)
    seeds = scale.materialise(heads.groupBy(seed.alias("seed")).agg(F.collect_set(F.length("head")).alias("lengths")))
    in_bytes = F.least(F.octet_length("seed"), F.lit(SEED_LENGTH))
    kinds = seeds.groupBy(F.length("seed").alias("k"), in_bytes.alias("b")).agg(F.count("*").alias("n")).collect()
    if not kinds:
        return heads.select("head", F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("start"))
    sizes = sorted({r["k"] for r in kinds})
    held, n_bits = _seed_filter(seeds, sum(r["n"] for r in kinds))
    at = _named(proteins).mapInArrow(
        _survivors(held, n_bits, sorted({r["b"] for r in kinds})), "id long, start long, window string"
    )
    window = F.col("window")
    probes = F.array(*[F.substring(window, F.lit(1), F.lit(k)) for k in sizes])
    if len(sizes) == 1:
        at = at.withColumn("seed", F.substring(window, F.lit(1), F.lit(sizes[0]))).filter(F.length("seed") == sizes[0])
    else:  # a window at the end of a protein gives its shorter seeds only
        at = at.withColumn("seed", F.explode(F.array_distinct(probes)))
    n_heads = heads.count()
    if n_heads <= MAX_SEED_ROWS:
        known = at.join(F.broadcast(seeds), "seed")
    else:
        if len(sizes) > 1:  # a window of one size brings a seed of every size
            at = at.filter(_may_be_in(seeds))
        known = scale.shuffle_join(scale.store(at), seeds, "seed", how="inner", salt_on=["id", "start"])
    cut = known.select("id", "start", "window", F.explode("lengths").alias("k")).select(
        "id", "start", F.substring(window, F.lit(1), F.col("k")).alias("head"), "k"
    ).filter(F.length("head") == F.col("k"))
    longer = heads.select("head", (F.size("longer") > 0).alias("more"))
    if n_heads <= MAX_SEED_ROWS:
        hit = cut.join(F.broadcast(longer), "head")
    else:
        hit = scale.shuffle_join(cut, longer, "head", how="inner", salt_on=["id", "start"])
    return hit.select("head", F.when(F.col("more"), F.col("id")).alias("id"), F.when(F.col("more"), F.col("start")).alias("start")).distinct()


def _whole(places: DataFrame, heads: DataFrame, proteins: DataFrame) -> DataFrame:
    """Substrings of more than ``SPAN`` letters (column ``peptide``) at the places of their heads."""
    wanted = scale.attach(places, heads.filter(F.size("longer") > 0), "head", how="inner", salt_on=["id", "start"])
    cuts = scale.materialise(wanted.select("id", "start", F.explode("longer").alias("k")).distinct())
    ids = cuts.select("id").distinct()
    own = scale.store(_named(proteins).join(ids, "id", "left_semi").dropDuplicates(["id"]))
    met = scale.shuffle_join(cuts, own, "id", how="inner", salt_on=["start", "k"])
    text = F.substring(F.col("sequence"), F.col("start").cast("int"), F.col("k"))
    return met.select(text.alias("peptide"), "k").filter(F.length("peptide") == F.col("k")).select("peptide").distinct()


def normalised_proteins(proteins: DataFrame) -> DataFrame:
    """I->L; an empty sequence contributes no piece."""
    return proteins.select(F.replace("sequence", F.lit("I"), F.lit("L")).alias("sequence"))


def annotate_hits(
    psms: DataFrame, proteins: DataFrame, min_residue_length: int = 7
) -> DataFrame:
    """Drop short peptides and add boolean ``proteome_hit``.

    ``proteins`` has one ``sequence`` per row, so a hit never spans two proteins.
    """
    if "prediction" not in psms.columns:
        raise ValueError("a 'prediction' column is required")
    kept = long_enough(psms, min_residue_length)
    if isinstance(kept.schema["prediction"].dataType, T.ArrayType):
        raw = F.col("prediction_untokenised") if "prediction_untokenised" in kept.columns else None
        text = P.match_string(F.col("prediction"), raw)
    else:
        text = P.stripped_for_match(F.col("prediction"))
    keyed = kept.drop("proteome_hit").withColumn("_pep", text)
    found = found_peptides(
        keyed.select(F.col("_pep").alias("peptide")), normalised_proteins(proteins)
    )
    hits = scale.materialise(found.select(F.col("peptide").alias("_pep"), F.lit(True).alias("_hit")))
    return (
        scale.attach(keyed, hits, "_pep")
        .withColumn("proteome_hit", F.coalesce("_hit", F.lit(False)))
        .drop("_pep", "_hit")
    )


def annotation_counts(psms: DataFrame, min_residue_length: int = 7) -> DataFrame:
    """Rows in, removed as too short, kept - one aggregation."""
    is_array = isinstance(psms.schema["prediction"].dataType, T.ArrayType)
    kept = P.residue_count(F.col("prediction"), is_array) >= min_residue_length
    return psms.agg(
        F.count("*").alias("num_input"),
        F.count_if(~kept).alias("num_removed_short"),
        F.count_if(kept).alias("num_kept"),
    )
