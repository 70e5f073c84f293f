"""Near copies: texts whose word shingles have a Jaccard similarity of 0.8 or more.

Texts with equal shingle sets are one. Candidates come from three sources, each taking up what
those before it left apart:

1. SimHash anchors (:mod:`simhash`) over the shingle set: a forest of the pairs that share an
   anchor and differ in at most ``max_bits`` bits.
2. MinHash bands, by stars: 96 minima in 24 bands of four; every text of a band value meets the
   first one of it, unless both are in one component already.
3. MinHash bands, by groups: for band values that still hold several components, pairs in
   different components whose minima agree in at least ``LEAST_AGREEING`` of 96 places meet,
   each pair in the first band it shares only.

Every candidate is confirmed by the exact similarity of both whole texts. Two texts of
similarity 0.8 share a band with probability 1 - 3e-6, and agree in fewer than
``LEAST_AGREEING`` minima with probability 1e-5; above 0.8 both vanish.

Size. A star ships the leader's text once and each other text once per leader. A group emits
a forest of what it confirmed, never its pairs, and its rows number at most one per text and
band. Groups of more than ``GROUP_ROWS`` rows or ``GROUP_BYTES`` of text are cut into blocks
that meet two at a time, and stars of more than ``STAR_ROWS`` are salted, so no task
holds an unbounded group. What a group compares is quadratic in its rows: in bytes of
sketches for pairs in different components, exactly only where sketches agree.

Cases: null, empty and blank texts have an empty set and are equal to each other; fewer words
than a shingle has are one shingle; null ids take part; repeated rows stay; an empty table
gives an empty result; of the input only id and text are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrafdr.llm import simhash
from spectrafdr.llm.common import text_slices
from spectrafdr.llm.components import components
from spectrafdr.operators import scale

WIDTH = 5
SIMILARITY = 0.8
MAX_BITS = 12
BANDS = 24
ROWS = 4
LEAST_AGREEING = 60
SEED = 42
GROUP_ROWS = 2000
GROUP_BYTES = 16_000_000
STAR_ROWS = 2000
SHINGLES_HELD = 1_000_000
_AT_ONCE = 2048
_random = np.random.default_rng(SEED)
# One odd factor and one flip of bits per minimum.
_FACTORS = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIPS = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: str | None, width: int = WIDTH) -> set[bytes]:
    """Word shingles of a whole text, ASCII letters folded; none for a text without a word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def jaccard(one: set, other: set) -> float:
    """Similarity of two sets; two empty ones are equal."""
    shared = len(one & other)
    either = len(one) + len(other) - shared
    return shared / either if either else 1.0


# --- sketches ----------------------------------------------------------------------------


def sketch(text: str | None, width: int = WIDTH) -> tuple[int, int, np.ndarray, bytes]:
    """Of a shingle set: its hash, its SimHash, a key per band, and a byte of every minimum."""
    import xxhash

    found = shingles(text, width)
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in found), dtype=np.uint64, count=len(found))
    hashes.sort()
    lowest = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _AT_ONCE):
        part = hashes[at : at + _AT_ONCE]
        mixed = (part[:, None] ^ _FLIPS) * _FACTORS
        lowest = np.minimum(lowest, (mixed ^ (mixed >> np.uint64(32))).min(axis=0))
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0]
    whole = xxhash.xxh64_intdigest(hashes.tobytes(), SEED)
    parts = lowest.reshape(BANDS, ROWS)
    keys = np.array([xxhash.xxh64_intdigest(parts[b].tobytes(), b) for b in range(BANDS)], dtype=np.uint64)
    return whole - (1 << 64 if whole >> 63 else 0), int(bits), keys.view(np.int64), lowest.astype(np.uint8).tobytes()


def sketches(texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """``content, same, bits, keys, minima`` of every row of ``content, text``; ``same`` names the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in text_slices(whole)):
            found = [sketch(t, width) for t in batch.column(1).to_pylist()]
            keys = np.concatenate([f[2] for f in found])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()),
                    pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype=np.int32) * BANDS, pa.array(keys)),
                    pa.array([f[3] for f in found], pa.binary()),
                ],
                ["content", "same", "bits", "keys", "minima"],
            )

    return texts.select("content", "text").mapInArrow(
        run, "content long, same long, bits long, keys array<long>, minima binary"
    )


# --- exact confirmation ------------------------------------------------------------------


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows with equal values in the first two columns; rows come in their order."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        one, two = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        edges = np.flatnonzero((one[1:] != one[:-1]) | (two[1:] != two[:-1])) + 1
        for start, stop in zip([0, *edges], [*edges, batch.num_rows], strict=True):
            name = (one[start], two[start])
            if held and name != last:
                yield _joined(held)
                held = []
            held.append(batch.slice(start, stop - start))
            last = name
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _star(width: int, similarity: float):
    """Rows ``u, salt, leads, content, text``, the leader first: links of the leader."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, leader = None, None
        for batch in (part for whole in batches for part in text_slices(whole)):
            us, ends = [], []
            for i in range(batch.num_rows):
                name = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
                own = shingles(batch.column(4)[i].as_py(), width)
                if name != last:
                    last, leader = name, own
                elif jaccard(leader, own) >= similarity:
                    us.append(name[0])
                    ends.append(batch.column(3)[i].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(ends, pa.int64())], ["u", "v"])

    return run


def confirm_stars(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs ``u, v`` whose texts are similar enough; every ``u`` is shipped once, not per pair."""
    pairs = scale.materialise(pairs)
    wanted = pairs.select(F.col("u").alias("content")).union(pairs.select("v")).distinct()
    known = scale.store(texts.join(wanted, "content", "left_semi").dropDuplicates(["content"]))
    hot = pairs.groupBy("u").count().filter(F.col("count") > STAR_ROWS)
    salted = scale.attach(pairs, hot.withColumn("salts", F.ceil(F.col("count") / STAR_ROWS).cast("int")), "u").select(
        "u", F.coalesce(F.pmod(F.xxhash64("v"), "salts"), F.lit(0)).cast("int").alias("salt"), "v"
    )
    leaders = salted.select("u", "salt").distinct().select("u", "salt", F.lit(0).alias("leads"), F.col("u").alias("content"))
    rows = leaders.union(salted.select("u", "salt", F.lit(1), "v"))
    dealt = rows.join(known, "content").select("u", "salt", "leads", "content", "text").repartition("u", "salt")
    ordered = dealt.sortWithinPartitions("u", "salt", "leads")
    return scale.materialise(ordered.mapInArrow(_star(width, similarity), "u long, v long"))


class Labels:
    """Components within one group, from labels and the links found so far."""

    def __init__(self, labels: list[int]):
        self.parent: dict[int, int] = {x: x for x in labels}

    def find(self, label: int) -> int:
        while self.parent[label] != label:
            self.parent[label] = self.parent[self.parent[label]]
            label = self.parent[label]
        return label

    def unite(self, one: int, other: int) -> None:
        self.parent[self.find(one)] = self.find(other)


def _meetings(group: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """Rows with their later partners in one group: in different components, of different blocks
    if there are two, agreeing in enough minima and in no earlier band."""
    band = group.column(2)[0].as_py()
    block, label = (group.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
    minima = np.frombuffer(b"".join(group.column(7).to_pylist()), np.uint8).reshape(len(label), -1)
    keys = np.asarray(group.column(6).flatten()).reshape(len(label), -1)[:, :band]
    crossing = len(np.unique(block)) > 1
    for i in range(len(label) - 1):
        rest = label[i + 1 :] != label[i]
        if crossing:
            rest &= block[i + 1 :] != block[i]
        at = np.flatnonzero(rest) + i + 1
        at = at[(minima[at] == minima[i]).sum(axis=1) >= LEAST_AGREEING]
        if len(at) and band:
            at = at[~(keys[at] == keys[i]).any(axis=1)]
        if len(at):
            yield i, at


def _hopeful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of every group that have a partner to meet."""
    for group in _runs(batches):
        chosen = np.zeros(group.num_rows, dtype=bool)
        for i, at in _meetings(group):
            chosen[i] = True
            chosen[at] = True
        if chosen.any():
            yield group.filter(pa.array(chosen))


def _confirmed(width: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _runs(batches):
            contents, labels, texts = (group.column(i) for i in (4, 5, 8))
            contents, labels = contents.to_pylist(), labels.to_pylist()
            joined, sets, held, us, vs = Labels(labels), {}, 0, [], []
            for i, at in _meetings(group):
                for j in at.tolist():
                    if joined.find(labels[i]) == joined.find(labels[j]):
                        continue
                    if held > SHINGLES_HELD:
                        sets, held = {}, 0
                    for k in (i, j):
                        if k not in sets:
                            sets[k] = shingles(texts[k].as_py(), width)
                            held += len(sets[k])
                    if jaccard(sets[i], sets[j]) >= similarity:
                        joined.unite(labels[i], labels[j])
                        us.append(contents[i])
                        vs.append(contents[j])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return run


_GROUP = "key long, pair long, band int, block int, content long, label long, keys array<long>, minima binary"


def _in_blocks(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows of large groups once per pair of blocks they take part in; others once."""
    placed = scale.attach(rows, blocks, "key").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("content"), "blocks").cast("int"))
    others = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda x: F.least(x, F.col("block")).cast("long") * F.col("blocks") + F.greatest(x, F.col("block")),
    )
    return placed.withColumn("pair", F.explode(F.when(F.col("blocks") > 1, others).otherwise(F.array(F.lit(0).cast("long")))))


def confirm_groups(rows: DataFrame, sets: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """Links between components that meet in a band value; ``rows`` are ``key, band, content, label``."""
    counts = rows.groupBy("key").count().filter(F.col("count") > GROUP_ROWS)
    blocks = counts.select("key", F.ceil(F.col("count") / GROUP_ROWS).cast("int").alias("blocks"))
    columns = ["key", "pair", "band", "block", "content", "label", "keys", "minima"]
    dealt = _in_blocks(rows.join(sets.select("content", "keys", "minima"), "content"), blocks).select(*columns)
    met = dealt.repartition("key", "pair").sortWithinPartitions("key", "pair", "content").mapInArrow(_hopeful, _GROUP)
    met = scale.store(met.select("key", "band", "content", "label").distinct())
    wanted = met.select("content").distinct()
    known = scale.store(texts.join(wanted, "content", "left_semi").dropDuplicates(["content"]))
    full = met.join(sets.select("content", "keys", "minima"), "content").join(known, "content")
    sizes = full.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    large = sizes.filter((F.col("n") > GROUP_ROWS) | (F.col("bytes") > GROUP_BYTES)).select(
        "key", F.greatest(F.ceil(F.col("n") / GROUP_ROWS), F.ceil(F.col("bytes") / GROUP_BYTES)).cast("int").alias("blocks")
    )
    again = _in_blocks(full, large).select(*columns, "text").repartition("key", "pair")
    ordered = again.sortWithinPartitions("key", "pair", "content")
    return scale.materialise(ordered.mapInArrow(_confirmed(width, similarity), "u long, v long"))


# --- the whole ---------------------------------------------------------------------------


def _open(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``key, band, content, label, lead`` of the band values that hold several components."""
    labelled = rows.join(labels.withColumnRenamed("node", "content"), "content", "left").select(
        "key", "band", "content", F.coalesce("label", "content").alias("label")
    )
    labelled = scale.store(labelled)
    several = labelled.groupBy("key").agg(
        F.min(F.struct("content", "label")).alias("lead"), F.min("label").alias("low"), F.max("label").alias("high")
    )
    return scale.store(labelled.join(several.filter("low <> high").select("key", "lead"), "key"))


def links(texts: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, max_bits: int = MAX_BITS,
          report: Callable[[str, int], None] | None = None) -> DataFrame:
    """``u, v``: links between values of ``content`` that give the components of all links.

    ``report`` is told how many links each source of candidates gave.
    """
    told = report or (lambda name, number: None)
    sketched = scale.store(sketches(texts, width))
    sets = scale.store(sketched.groupBy("same").agg(
        F.min("content").alias("content"), *[F.first(c).alias(c) for c in ("bits", "keys", "minima")]
    ))
    named = sets.select("same", F.col("content").alias("u"))
    equal = scale.materialise(
        sketched.select("same", F.col("content").alias("v")).distinct().join(named, "same").filter("u <> v").select("u", "v")
    )
    first = scale.materialise(sets.groupBy("bits").agg(F.min("content").alias("lead")))
    u, v = (first.select(F.col("bits").alias(c), F.col("lead").alias(f"{c}_lead")) for c in ("u", "v"))
    wide = simhash.links(sets, max_bits=max_bits).distinct().join(u, "u").join(v, "v")
    wide = wide.select(F.col("u_lead").alias("u"), F.col("v_lead").alias("v"))
    alike = sets.join(first, "bits").filter("content <> lead").select(F.col("lead").alias("u"), F.col("content").alias("v"))
    anchored = confirm_stars(wide.union(alike), texts, width, similarity)
    told("anchors", anchored.count() if report else 0)

    rows = sets.select("content", F.posexplode("keys").alias("band", "key"))
    common = rows.groupBy("key").count().filter("count > 1").select("key")
    rows = scale.store(rows.join(common, "key").select("key", "band", "content"))
    opened = _open(rows, components(anchored))
    pairs = opened.filter("label <> lead.label").select(F.col("lead.content").alias("u"), F.col("content").alias("v")).distinct()
    starred = confirm_stars(pairs, texts, width, similarity)
    told("stars", starred.count() if report else 0)

    near = anchored.union(starred)
    opened = _open(opened.select("key", "band", "content"), components(near))
    grouped = confirm_groups(opened.select("key", "band", "content", "label"), sets, texts, width, similarity)
    told("groups", grouped.count() if report else 0)
    return equal.union(near).union(grouped)


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH,
                similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, content, label`` for every row of ``docs``; ``label`` names its component."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("content"))
    labels = components(links(rows.select("content", "text"), width, similarity)).withColumnRenamed("node", "content")
    return rows.select("doc_id", "content").join(labels, "content", "left").select(
        "doc_id", "content", F.coalesce("label", "content").alias("label")
    )
