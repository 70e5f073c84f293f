"""Exact repeated passages: a sparse suffix array, range-partitioned and sorted in buckets.

``remove_repeats`` removes every byte of a text that lies in a string of ``LENGTH`` bytes
which also starts in a document with a smaller id. Texts are UTF-8 bytes; strings never
cross documents and are judged on the input.

Which suffixes. Only suffixes at synchronising positions are sorted: in every string of
``LENGTH`` bytes the ``SEED``-byte gram with the smallest hash. The choice depends on the
string alone, so two equal strings have it at the same place and meet in the sort, although
only about one suffix in sixteen takes part.

Steps, one plan, texts dealt once into groups of about ``GROUP_BYTES``:

1. each group sends its suffixes to buckets: their leading token (8 bytes), a hash of the
   rest of the seed, a hash of the context (all strings that could hold the seed, 80 bytes),
   and the document. Equal contexts within a group are combined before that, so a passage
   that a third of all documents share is one suffix per group;
2. buckets are ranges of leading tokens between splitters drawn from a sample. A token that
   fills several splitters is dealt on by the rest of its seed, so equal seeds share a
   bucket and no comparison across a boundary is left over. A bucket sorts by multikey
   quicksort (8-byte characters); neighbours with equal contexts settle most suffixes.
   Suffixes that share a seed but not the whole context are asked for;
3. the groups send the contexts asked for, which are compared string by string, bytes and
   not hashes; 4. the answers return to the groups, which cut their texts.

Hashes: a settled suffix relies on 64 bits over the context within one seed; everything
else is compared as bytes.

Cases: null text is empty; texts below ``LENGTH`` bytes keep everything; a null id counts as
larger than every id, rows that share an id do not match each other; rows repeat as they
come in; an empty table gives an empty result. Ids must be integers. Columns named in
``carry`` come through unchanged, no other column is read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 50
SEED = 20
SIDE = LENGTH - SEED  # bytes of context on either side of a seed
CONTEXT = SEED + 2 * SIDE
GROUP_BYTES = 8_000_000
SUFFIXES_PER_BUCKET = 500_000
LEAST_PARTS = 64
# Beyond this many groups and buckets they grow instead: a message between a group and a
# bucket then still holds some forty suffixes at 100 TB (groups of 250 MB).
MOST_PARTS = 400_000
SAMPLE_BYTES = 8_000_000
SLICE_BYTES = 400_000
SEEDS_AT_ONCE = 20_000
NO_ID = np.iinfo(np.int64).max
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


# --- suffixes of one group of texts ----------------------------------------------------


def _sliding(values: np.ndarray, best, width: int) -> np.ndarray:
    """``best`` over every run of ``width`` values, by doubling."""
    span = 1
    while span * 2 <= width:
        values = best(values[: len(values) - span], values[span:])
        span *= 2
    rest = width - span
    return best(values[: len(values) - rest], values[rest:]) if rest else values


def _power(exponent: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), exponent, 1 << 64))


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A mixed polynomial hash of the ``SEED`` bytes from every place on; never zero."""
    spans = {1: data.astype(np.uint64) + np.uint64(1)}
    span = 1
    while span * 2 <= SEED:
        own = spans[span]
        spans[span * 2] = own[:-span] * _power(span) + own[span:]
        span *= 2
    out, covered = spans[span], span
    for size in sorted(spans, reverse=True):
        if covered + size <= SEED:
            n = len(spans[size]) - covered
            out = out[:n] * _power(size) + spans[size][covered : covered + n]
            covered += size
    out ^= out >> np.uint64(32)
    out *= _MIX
    out ^= out >> np.uint64(29)
    return out | np.uint64(1)


def synchronised(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the smallest gram of every string of ``LENGTH`` bytes, and their hashes.

    ``data`` holds whole texts one after another; ``ends`` is the end of the text for every byte.
    """
    width = LENGTH - SEED + 1
    padded = np.append(data, np.zeros(LENGTH, dtype=np.uint8))
    hashes = _gram_hashes(padded)[: len(data) + width - 1]
    low = _sliding(hashes, np.minimum, width)[: len(data)]
    low = np.where(np.arange(len(data)) + LENGTH <= ends, low, np.uint64(0))
    high = _sliding(np.append(np.zeros(width - 1, dtype=np.uint64), low), np.maximum, width)
    places = np.flatnonzero(high == hashes[: len(data)])
    return places, hashes[places]


def contexts(data: np.ndarray, places: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Bytes around every place (zero outside its text), and how many belong to it before and behind."""
    padded = np.concatenate([np.zeros(SIDE, np.uint8), data, np.zeros(CONTEXT, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, CONTEXT)[places]
    before = np.minimum(SIDE, places - starts).astype(np.uint8)
    behind = np.minimum(SIDE, ends - places - SEED).astype(np.uint8)
    for i in np.flatnonzero((before < SIDE) | (behind < SIDE)):
        rows[i, : SIDE - before[i]] = 0
        rows[i, SIDE + SEED + behind[i] :] = 0
    return rows, before, behind


def _context_hashes(rows: np.ndarray, before: np.ndarray, behind: np.ndarray) -> np.ndarray:
    out = (before.astype(np.uint64) << np.uint64(8)) | behind
    for word in np.ascontiguousarray(rows).view("<u8").T:
        out = (out ^ word) * _MIX
        out ^= out >> np.uint64(32)
    return out


class Group:
    """Texts of one group in a fixed order (id, text), as bytes, with their suffixes."""

    def __init__(self, found: pa.Table):
        order = pc.sort_indices(
            found, sort_keys=[("doc_id", "ascending"), ("text", "ascending")], null_placement="at_end"
        )
        self.rows = found.take(order)
        ids = self.rows.column("doc_id").combine_chunks().cast(pa.int64())
        self.ids = np.asarray(pc.fill_null(ids, int(NO_ID)))
        texts = pc.fill_null(self.rows.column("text").combine_chunks(), "").cast(pa.large_binary())
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)
        self.offsets = offsets[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        self.data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)

    def text(self, row: int) -> np.ndarray:
        return self.data[self.offsets[row] : self.offsets[row + 1]]

    def suffixes(self) -> dict[str, np.ndarray]:
        """Row, place in its text, seed keys and context hash of every suffix, in one order."""
        parts = []
        sizes = np.diff(self.offsets)
        slot = (np.cumsum(sizes) - 1).clip(0) // SLICE_BYTES
        cuts = np.append(np.append(0, np.flatnonzero(np.diff(slot)) + 1), len(sizes))
        for first, last in zip(cuts[:-1], cuts[1:], strict=True):
            begin, end = self.offsets[first], self.offsets[last]
            if end - begin < LENGTH:
                continue
            data = self.data[begin:end]
            own = np.repeat(np.arange(first, last), sizes[first:last])
            starts = self.offsets[own] - begin
            ends = self.offsets[own + 1] - begin
            places, hashes = synchronised(data, ends)
            around = contexts(data, places, starts[places], ends[places])
            lead = np.zeros(len(places), dtype=np.uint64)
            for i in range(8):
                lead = (lead << np.uint64(8)) | around[0][:, SIDE + i].astype(np.uint64)
            parts.append(
                {
                    "row": own[places],
                    "place": places - starts[places],
                    "lead": lead,
                    "tail": (hashes >> np.uint64(1)).astype(np.uint32) & np.uint32(0xFFFFFF),
                    "full": _context_hashes(*around),
                }
            )
        names = {"row": np.int64, "place": np.int64, "lead": np.uint64, "tail": np.uint32, "full": np.uint64}
        return {
            n: np.concatenate([p[n] for p in parts]) if parts else np.zeros(0, dtype=kind)
            for n, kind in names.items()
        }

    def combined(self, splitters: np.ndarray):
        """Suffixes sorted by bucket, seed, context and document, and each one's representative.

        A representative is the first of the equal contexts: the one of the smallest document.
        """
        found = self.suffixes()
        bucket = bucket_of(found["lead"], found["tail"], splitters)
        order = multikey_quicksort([found["lead"], found["tail"].astype(np.uint64), found["full"]])
        order = order[np.argsort(bucket[order], kind="stable")]
        found = {n: v[order] for n, v in found.items()}
        found["bucket"] = bucket[order]
        new = _changes(found["lead"], found["tail"], found["full"], found["bucket"])
        found["head"] = np.flatnonzero(new)[np.cumsum(new) - 1]
        return found


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it."""
    out = np.ones(len(columns[0]), dtype=bool)
    if len(out) > 1:
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def multikey_quicksort(keys: list[np.ndarray]) -> np.ndarray:
    """Order by several 8-byte characters: sort by the first, then only inside its ties.

    Stable over all keys, so equal strings stay in the order of their documents.
    """
    order = np.argsort(keys[0], kind="stable")
    for depth in range(1, len(keys)):
        tied = ~_changes(*[k[order] for k in keys[:depth]])
        tied[:-1] |= tied[1:]  # members of a run of equal prefixes
        places = np.flatnonzero(tied)
        if not len(places):
            break
        run = np.cumsum(_changes(*[k[order[places]] for k in keys[:depth]]))
        inside = np.lexsort((keys[depth][order[places]], run))
        order[places] = order[places[inside]]
    return order


def bucket_of(lead: np.ndarray, tail: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    """Range of the leading token; a token that repeats among the splitters is dealt on by its tail."""
    low = np.searchsorted(splitters, lead, side="left")
    repeats = np.searchsorted(splitters, lead, side="right") - low
    return (low + ((tail.astype(np.int64) * np.maximum(repeats, 1)) >> 24)).astype(np.int64)


# --- messages between groups and buckets -----------------------------------------------


def pack(*columns: np.ndarray) -> bytes:
    """Arrays of equal length as bytes, byte planes together so that they compress."""
    import zstandard

    planes = []
    for c in columns:
        raw = np.ascontiguousarray(c)
        planes.append(raw.view(np.uint8).reshape(len(raw), raw.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(blob: bytes, kinds: list) -> list[np.ndarray]:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    widths = [np.dtype(k).itemsize for k in kinds]
    n = len(raw) // sum(widths)
    out, at = [], 0
    for kind, width in zip(kinds, widths, strict=True):
        planes = raw[at : at + n * width].reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += n * width
    return out


_SUFFIX = [np.uint64, np.uint32, np.uint64, np.int64]
_VERDICT = [np.uint8]
_DETAIL = [np.uint64, np.uint32, np.int64, np.int32, np.int32, np.uint8, np.uint8, f"V{CONTEXT}"]
_INTERVAL = [np.int32, np.int32, np.int32]
SETTLED, ASKED = 1, 2


def _message(rows: list[tuple], names: list[str]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[] for _ in names]
    kinds = [pa.binary() if n == "blob" else pa.int64() for n in names]
    return pa.table({n: pa.array(list(c), k) for n, c, k in zip(names, columns, kinds, strict=True)})


def _send_suffixes(splitters):
    def run(found: pa.Table) -> pa.Table:
        group = Group(found)
        mine = group.combined(splitters.value)
        heads = np.flatnonzero(mine["head"] == np.arange(len(mine["head"])))
        out, grp = [], found.column("grp")[0].as_py()
        for part in _runs(mine["bucket"][heads]):
            at = heads[part]
            blob = pack(mine["lead"][at], mine["tail"][at], mine["full"][at], group.ids[mine["row"][at]])
            out.append((int(mine["bucket"][at[0]]), grp, blob))
        return _message(out, ["bucket", "grp", "blob"])

    return run


def _runs(values: np.ndarray) -> list[slice]:
    """Slices of equal neighbours."""
    edges = np.append(np.flatnonzero(_changes(values)), len(values)) if len(values) else np.zeros(1, int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _judge_bucket(found: pa.Table) -> pa.Table:
    """Sort a bucket; answer each group's suffixes in the order they came: settled, asked for or neither."""
    groups = found.column("grp").to_pylist()
    parts = [unpack(b.as_py(), _SUFFIX) for b in found.column("blob")]
    lead, tail, full, doc = (np.concatenate(c) for c in zip(*parts, strict=True))
    by_doc = np.argsort(doc, kind="stable")
    order = by_doc[multikey_quicksort([lead[by_doc], tail[by_doc].astype(np.uint64), full[by_doc]])]
    lead, tail, full, doc = lead[order], tail[order], full[order], doc[order]
    new_seed = _changes(lead, tail)
    new_context = _changes(lead, tail, full)
    settled = doc > doc[np.flatnonzero(new_context)[np.cumsum(new_context) - 1]]
    seed = np.cumsum(new_seed) - 1
    n_seeds = int(seed[-1]) + 1 if len(seed) else 0
    kinds = np.bincount(seed[new_context], minlength=n_seeds)
    first = np.full(n_seeds, NO_ID)
    last = np.full(n_seeds, np.iinfo(np.int64).min)
    np.minimum.at(first, seed[new_context], doc[new_context])
    np.maximum.at(last, seed[new_context], doc[new_context])
    asked = ~settled & ((kinds > 1) & (first < last))[seed]
    verdict = np.zeros(len(order), dtype=np.uint8)
    verdict[order] = settled * np.uint8(SETTLED) + asked * np.uint8(ASKED)
    edges = np.cumsum([0, *(len(p[0]) for p in parts)])
    bucket = found.column("bucket")[0].as_py()
    out = [
        (grp, bucket, pack(verdict[a:b])) for grp, a, b in zip(groups, edges[:-1], edges[1:], strict=True)
    ]
    return _message(out, ["grp", "bucket", "blob"])


def _send_contexts(splitters, n_parts: int):
    """Settled suffixes become intervals of their own group; contexts asked for go to the comparison."""

    def run(found: pa.Table, answers: pa.Table) -> pa.Table:
        if not found.num_rows:
            return _message([], ["part", "grp", "blob"])
        group = Group(found)
        mine = group.combined(splitters.value)
        head, row, place = mine["head"], mine["row"], mine["place"]
        verdict = np.zeros(len(head), dtype=np.uint8)
        heads = np.flatnonzero(head == np.arange(len(head)))
        bounds = {int(mine["bucket"][heads[s][0]]): heads[s] for s in _runs(mine["bucket"][heads])}
        for bucket, blob in zip(answers.column("bucket").to_pylist(), answers.column("blob"), strict=True):
            verdict[bounds[bucket]] = unpack(blob.as_py(), _VERDICT)[0]
        later = group.ids[row] > group.ids[row[head]]
        settled = later | (verdict[head] == SETTLED)
        asked = ~later & (verdict[head] == ASKED)
        out, grp = [], found.column("grp")[0].as_py()
        size = np.diff(group.offsets)[row]
        start = np.maximum(0, place - SIDE)
        stop = np.minimum(size, place + SEED + SIDE)
        merged = merge(row[settled], start[settled], stop[settled])
        out.append((-1 - grp, grp, pack(*(m.astype(np.int32) for m in merged))))
        if asked.any():
            ends = np.flatnonzero(asked)
            ends = ends[np.argsort(_part_of(mine["lead"][ends], mine["tail"][ends], n_parts), kind="stable")]
            part = _part_of(mine["lead"][ends], mine["tail"][ends], n_parts)
            for s in _runs(part):
                at = ends[s]
                absolute = group.offsets[row[at]] + place[at]
                rows, before, behind = contexts(
                    group.data, absolute, group.offsets[row[at]], group.offsets[row[at] + 1]
                )
                out.append(
                    (
                        int(part[s.start]),
                        grp,
                        pack(
                            mine["lead"][at], mine["tail"][at], group.ids[row[at]],
                            row[at].astype(np.int32), place[at].astype(np.int32), before, behind,
                            np.ascontiguousarray(rows).view(f"V{CONTEXT}").ravel(),
                        ),
                    )
                )
        return _message(out, ["part", "grp", "blob"])

    return run


def _part_of(lead: np.ndarray, tail: np.ndarray, n_parts: int) -> np.ndarray:
    mixed = (lead ^ (tail.astype(np.uint64) << np.uint64(20))) * _MIX
    return ((mixed >> np.uint64(33)) % np.uint64(n_parts)).astype(np.int64)


def merge(row: np.ndarray, start: np.ndarray, stop: np.ndarray):
    """Unions of intervals per row, touching ones together."""
    order = np.lexsort((start, row))
    row, start, stop = row[order], start[order], stop[order]
    if not len(row):
        return row, start, stop
    # Rows far apart on one axis: a running maximum then never reaches into the next row.
    base = row.astype(np.int64) * (1 << 32)
    reach = np.maximum.accumulate(base + stop)
    new = np.append(True, (base + start)[1:] > reach[:-1])
    firsts = np.flatnonzero(new)
    return row[firsts], start[firsts], (np.append(reach[firsts[1:] - 1], reach[-1]) - base[firsts])


def _compare_contexts(found: pa.Table) -> pa.Table:
    """Per seed, string by string: intervals of strings that start in a smaller document too."""
    part = found.column("part")[0].as_py()
    groups, blobs = found.column("grp").to_pylist(), found.column("blob")
    if part < 0:  # a group's settled intervals on their way back
        return _message([(g, b.as_py()) for g, b in zip(groups, blobs, strict=True)], ["grp", "blob"])
    parts = [unpack(b.as_py(), _DETAIL) for b in blobs]
    owner = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    lead, tail, doc, row, place, before, behind, raw = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((doc, tail, lead))
    seed = np.cumsum(_changes(lead[order], tail[order])).astype(np.uint64)
    results: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    rows = raw.view(np.uint8).reshape(-1, CONTEXT)
    edges = [*np.flatnonzero(np.append(True, np.diff(seed // np.uint64(SEEDS_AT_ONCE)) > 0)), len(order)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        at = order[a:b]
        results.append((at, *repeated_strings(rows[at], before[at], behind[at], seed[a:b], doc[at])))
    at, low, high = (np.concatenate(c) for c in zip(*results, strict=True))
    hit = low <= high
    at, low, high = at[hit], low[hit], high[hit]
    start, stop = place[at] - high, place[at] - low + LENGTH
    out = []
    for number, grp in enumerate(groups):
        mine = owner[at] == number
        if mine.any():
            merged = merge(row[at][mine], start[mine], stop[mine])
            out.append((grp, pack(*(m.astype(np.int32) for m in merged))))
    return _message(out, ["grp", "blob"])


def repeated_strings(rows, before, behind, seed, doc):
    """Smallest and largest distance from string start to seed of the strings that repeat.

    Rows come by seed and document. For each of the ``SIDE + 1`` distances the strings are
    grouped by seed and hash, then compared with the first of their group as bytes; a group
    in which two different strings met is grouped again by its bytes.
    """
    n = len(rows)
    low, high = np.full(n, SIDE + 1), np.full(n, -1)
    prefix = np.zeros((n, CONTEXT + 1), dtype=np.uint64)
    for i in range(CONTEXT):
        prefix[:, i + 1] = prefix[:, i] * _BASE + rows[:, i] + np.uint64(1)
    for distance in range(SIDE + 1):
        fits = np.flatnonzero((before >= distance) & (behind >= SIDE - distance))
        if len(fits) < 2:
            continue
        begin = SIDE - distance
        key = prefix[fits, begin + LENGTH] - prefix[fits, begin] * _power(LENGTH)
        key = (key ^ (seed[fits] * _MIX)) * _BASE
        _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        lead = fits[first[inverse]]
        strings = rows[:, begin : begin + LENGTH]
        same = (seed[lead] == seed[fits]) & (strings[fits] == strings[lead]).all(axis=1)
        if not same.all():
            seen: dict = {}
            for i, k in enumerate(fits):
                lead[i] = seen.setdefault((int(seed[k]), strings[k].tobytes()), k)
        hit = fits[doc[fits] > doc[lead]]
        low[hit] = np.minimum(low[hit], distance)
        high[hit] = np.maximum(high[hit], distance)
    return low, high


def _cut(carry: list[str], schema_names: list[str], with_text: bool):
    def run(found: pa.Table, intervals: pa.Table) -> pa.Table:
        group = Group(found) if found.num_rows else None
        parts = [unpack(b.as_py(), _INTERVAL) for b in intervals.column("blob")]
        n = found.num_rows
        removed, spans = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        kept: list[bytes] = []
        where: dict[int, slice] = {}
        if parts and n:
            row, start, stop = merge(*(np.concatenate(c) for c in zip(*parts, strict=True)))
            where = {int(row[s.start]): s for s in _runs(row)}
        for i in range(n):
            data = group.text(i)
            if i in where:
                s = where[i]
                keep = np.ones(len(data), dtype=bool)
                for a, b in zip(start[s], stop[s], strict=True):
                    keep[a:b] = False
                removed[i], spans[i] = len(data) - keep.sum(), s.stop - s.start
                data = data[keep] if not with_text else data[_whole_characters(data, keep)]
            kept.append(data.tobytes())
        columns = {
            "doc_id": group.rows.column("doc_id") if n else pa.array([], found.schema.field("doc_id").type),
            "n_bytes": pa.array(np.diff(group.offsets) if n else [], pa.int64()),
            "n_removed": pa.array(removed),
            "n_spans": pa.array(spans),
        }
        if with_text:
            columns["kept_text"] = pa.array([k.decode("utf-8", "replace") for k in kept], pa.string())
        else:
            columns["kept_sha256"] = pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())
        for name in carry:
            columns[f"carry_{name}"] = (group.rows if n else found).column(f"carry_{name}")
        return pa.table({name: columns[name] for name in schema_names})

    return run


def _whole_characters(data: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """Widen what is kept to whole characters: one goes only if all its bytes go."""
    character = np.cumsum((data & 0xC0) != 0x80)
    stays = np.zeros(int(character[-1]) + 1 if len(character) else 1, dtype=bool)
    stays[character[keep]] = True
    return stays[character]


# --- the plan --------------------------------------------------------------------------


def _sample_leads(sample: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = Group(pa.Table.from_batches([batch])).suffixes()
                yield pa.RecordBatch.from_arrays([pa.array([pack(found["lead"])], pa.binary())], ["blob"])

    blobs = sample.select("doc_id", "text").mapInArrow(run, "blob binary").collect()
    return np.sort(np.concatenate([np.zeros(0, np.uint64), *(unpack(b.blob, [np.uint64])[0] for b in blobs)]))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   carry: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans`` and ``kept_sha256`` of every row of ``docs``.

    ``with_text`` gives ``kept_text`` instead of the digest: a character goes only if all its
    bytes go, so the text stays valid. Columns in ``carry`` come as ``carry_<name>``.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        *[F.col(c).alias(f"carry_{c}") for c in carry],
    )
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_groups = min(MOST_PARTS, max(LEAST_PARTS, -(-total // GROUP_BYTES)))
    n_buckets = min(MOST_PARTS, max(LEAST_PARTS, total // (SUFFIXES_PER_BUCKET * 16)))
    place = F.xxhash64("doc_id", "text")
    share = max(1, total // SAMPLE_BYTES)
    leads = _sample_leads(rows.filter(F.pmod(F.shiftright(place, 20), F.lit(share)) == 0))
    step = np.linspace(0, len(leads), n_buckets + 1)[1:-1].astype(int) if len(leads) else []
    splitters = spark.sparkContext.broadcast(leads[step] if len(leads) else leads)

    grouped = rows.withColumn("grp", F.pmod(place, F.lit(n_groups)).cast("long")).groupBy("grp")
    sent = grouped.applyInArrow(_send_suffixes(splitters), "bucket long, grp long, blob binary")
    answers = sent.groupBy("bucket").applyInArrow(_judge_bucket, "grp long, bucket long, blob binary")
    asked = grouped.cogroup(answers.groupBy("grp")).applyInArrow(
        _send_contexts(splitters, n_buckets), "part long, grp long, blob binary"
    )
    intervals = asked.groupBy("part").applyInArrow(_compare_contexts, "grp long, blob binary")
    last = "kept_text" if with_text else "kept_sha256"
    fields = [("doc_id", rows.schema["doc_id"].dataType.simpleString()), ("n_bytes", "long"),
              ("n_removed", "long"), ("n_spans", "long"), (last, "string"),
              *[(f"carry_{c}", docs.schema[c].dataType.simpleString()) for c in carry]]
    schema = ", ".join(f"`{n}` {k}" for n, k in fields)
    return grouped.cogroup(intervals.groupBy("grp")).applyInArrow(
        _cut(list(carry), [n for n, _ in fields], with_text), schema
    )
