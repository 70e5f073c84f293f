"""Alignment of two tokenizers over the same texts by pointer jumping.

Each text, with one blank before it, is encoded by a byte-level BPE (A) and a SentencePiece
model (B). Token ends in bytes come from the decoded tokens; texts that either side does not
give back byte for byte have no tokens.

``Groups``. Every token points to the farthest-right token of the other side that overlaps
it, or to itself if none reaches further; a B token that ends with an A token points to that.
Doubling ``pointer = pointer[pointer]`` over whole slices of texts takes every token to the
last A token of its group in logarithmically many steps, and that token names the group.

``Links`` are the overlapping token pairs, one for each stretch between neighbouring ends.
A pair's count is over the whole corpus. Encodings are stored once, as one number per link
(``A id * size of B + B id``), and counted by Spark. The at most ``FREQUENT_PAIRS`` most
frequent pairs and the best count per B id (bounded by the vocabulary) are broadcast; links
of rarer pairs are looked up by a join, in which no key can be hot.

Texts are cut into pieces before a single blank between two visible ASCII characters. There
both sides are certain to start a token (checked on both vocabularies; others are encoded
whole), so pieces are independent and no group crosses them. A task encodes and aligns each
distinct piece once as long as it is remembered (``MEMO_PIECES``). A text of more than
``PART_CHARS`` characters is worked on, and stored, in several rows; a run without such a
blank is one piece, however long.

Cases: null and empty texts and those that differ get zeros and an empty ``groups_sha256``;
ids may be null, rows may repeat; an empty table gives an empty result; only id and text
are read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrafdr.llm.common import text_slices
from spectrafdr.llm.token_counts import splits_at_white_space
from spectrafdr.operators import scale

PART_CHARS = 500_000
MEMO_PIECES = 400_000
MEMO_CHARS = 12_000_000
RUN_CHARS = 16_000
FREQUENT_PAIRS = 1 << 18
SLICE_CHARS = 150_000
LINKS_AT_ONCE = 500_000
_CUT = re.compile(r"(?<=[!-~]) (?=[!-~])")
_ENDS = re.compile(r"[!-~](?:.*[!-~])?", re.DOTALL)
_NONE = np.zeros(0, np.int64)
# Ids of neighbouring pieces, and how many each has.
_Side = tuple[np.ndarray, np.ndarray]
# Fixed value: SentencePiece's sign for a blank.
_BLANK = "▁"


def parts(text: str, size: int) -> list[str]:
    """A text cut into parts of about ``size`` characters; the blank at each cut is left out."""
    out, start = [], 0
    while len(text) - start > size:
        cut = _CUT.search(text, start + size)
        if cut is None:
            break
        out.append(text[start : cut.start()])
        start = cut.end()
    return [*out, text[start:]]


def byte_level_bytes() -> dict[str, int]:
    """Byte of every character of a byte-level vocabulary: visible Latin-1 characters stand
    for themselves, the other bytes follow from U+0100 on in their order."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def code_type(size_a: int, size_b: int) -> type:
    """The smaller integer type that holds every id pair as one number."""
    return np.int32 if size_a * size_b < 1 << 31 else np.int64


class Aligner:
    """Both tokenizers, loaded, and what is remembered of the pieces met so far."""

    def __init__(self, definition: str, model: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(definition)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        size_a, self.size_b = self.a.get_vocab_size(), self.b.get_piece_size()
        names_b = [self.b.id_to_piece(i) for i in range(self.size_b)]
        of_char = byte_level_bytes()
        names_a = [self.a.id_to_token(i) or "" for i in range(size_a)]
        self.bytes_a = [
            bytes(of_char[c] for c in n) if all(c in of_char for c in n) else n.encode() for n in names_a
        ]
        self.bytes_b = [
            bytes([int(n[3:5], 16)]) if self.b.is_byte(i) else n.replace(_BLANK, " ").encode()
            for i, n in enumerate(names_b)
        ]
        self.width_a = np.array([len(x) for x in self.bytes_a])
        self.width_b = np.array([len(x) for x in self.bytes_b])
        self.of_a, self.of_b = (self.bytes_a, self.width_a), (self.bytes_b, self.width_b)
        self.certain = splits_at_white_space(definition) and not any(re.search(f"[^{_BLANK}]{_BLANK}", n) for n in names_b)
        self.printed = [f"{i}{end}" for i in range(size_a) for end in ",|"]
        self.printed += [f"{i}{end}" for i in range(self.size_b) for end in ",;"]
        self.first_b = 2 * size_a
        self.code_type = code_type(size_a, self.size_b)
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        # Per piece: whether both sides give it back, A and B tokens, groups, links.
        self.facts = np.zeros((0, 5), np.int32)
        self.codes = np.zeros(0, self.code_type)
        self.chars = 0

    def parts(self, text: str, size: int) -> list[str]:
        return parts(text, size) if self.certain else [text]

    def pieces(self, part: str) -> list[str]:
        return _CUT.split(part) if self.certain else [part]

    def learn(self, wanted: set[str]) -> None:
        """Encode and align the pieces not known yet; all of ``wanted`` are known afterwards."""
        unknown = [p for p in wanted if p not in self.number]
        if len(self.number) + len(unknown) > MEMO_PIECES or self.chars > MEMO_CHARS:
            self._forget()
            unknown = list(wanted)
        if not unknown:
            return
        unknown, n_good, a, b = self._encode(unknown)
        facts, groups = np.zeros((len(unknown), 5), np.int32), [""] * len(unknown)
        if n_good:
            done = Aligned(self, a, b)
            facts[:n_good, 0] = 1
            facts[:n_good, 1:] = done.counts()
            groups[:n_good] = done.texts(self)
            self.codes = np.concatenate([self.codes, done.codes.astype(self.codes.dtype)])
        self.number.update(zip(unknown, range(len(self.number), len(self.number) + len(unknown)), strict=True))
        self.facts = np.concatenate([self.facts, facts])
        self.first_code = np.cumsum(self.facts[:, 4], dtype=np.int64) - self.facts[:, 4]
        self.groups += groups
        self.chars += sum(map(len, unknown))

    def _encode(self, pieces: list[str]) -> tuple[list[str], int, _Side, _Side]:
        """The pieces, those that both sides give back first, their number, and their tokens.

        Pieces with visible ASCII characters at both ends are encoded one behind the other:
        that is a text with certain cuts between them.
        """
        runs: list[list[str]] = []
        room = -1
        for piece in pieces:
            joins = self.certain and _ENDS.fullmatch(piece) is not None
            if not joins or room < 0:
                runs.append([])
                room = RUN_CHARS if joins else -1
            runs[-1].append(piece)
            room -= len(piece)
        good, bad, sides = [], [], ([], [])
        while runs:
            ids_a = [e.ids for e in self.a.encode_batch_fast([" " + " ".join(r) for r in runs], add_special_tokens=False)]
            ids_b = self.b.encode([" ".join(r) for r in runs], num_threads=1)
            again: list[list[str]] = []
            for run, a, b in zip(runs, ids_a, ids_b, strict=True):
                given = [(" " + p).encode() for p in run]
                both = [self._side(np.array(x, np.int64), given, *of) for x, of in ((a, self.of_a), (b, self.of_b))]
                if all(x is not None for x in both):
                    good += run
                    for side, found in zip(sides, both, strict=True):
                        side.append(found)
                elif len(run) > 1:
                    again += [[p] for p in run]
                else:
                    bad += run
            runs = again
        joined = [tuple(np.concatenate(x) for x in zip(*side, strict=True)) if side else (_NONE, _NONE) for side in sides]
        return good + bad, len(good), *joined

    @staticmethod
    def _side(ids: np.ndarray, given: list[bytes], decoded: list[bytes], width: np.ndarray) -> _Side | None:
        """Ids and the number of tokens of every piece, or nothing if the bytes differ."""
        ends, wanted = np.cumsum(width[ids]), np.cumsum([len(g) for g in given])
        upto = np.searchsorted(ends, wanted) + 1
        if not len(ids) or upto[-1] != len(ids) or not np.array_equal(ends[upto - 1], wanted):
            return None
        if b"".join(map(decoded.__getitem__, ids.tolist())) != b"".join(given):
            return None
        return ids, np.diff(upto, prepend=0)

    def numbers(self, pieces: list[str]) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, pieces), np.int64, count=len(pieces))

    def links(self, numbers: np.ndarray) -> np.ndarray:
        """Codes of all links of the pieces, in their order."""
        sizes = self.facts[numbers, 4].astype(np.int64)
        first = self.first_code[numbers] - (np.cumsum(sizes) - sizes)
        return self.codes[np.repeat(first, sizes) + np.arange(sizes.sum())]

    def text(self, numbers: np.ndarray) -> bytes:
        """The groups of the pieces, each with its final semicolon."""
        return "".join(map(self.groups.__getitem__, numbers.tolist())).encode()


def jump(pointer: np.ndarray) -> np.ndarray:
    """The end of every chain of pointers; ends point to themselves."""
    while True:
        onward = pointer[pointer]
        if np.array_equal(onward, pointer):
            return pointer
        pointer = onward


def group_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per A and per B token the number of the A token that ends its group.

    Both sides cover the same bytes, so the last ends are equal.
    """
    n = len(ends_a)
    over_a = np.searchsorted(ends_b, ends_a)  # the last B token that overlaps each A token
    over_b = np.searchsorted(ends_a, ends_b)
    pointer = np.concatenate([np.where(ends_b[over_a] > ends_a, n + over_a, np.arange(n)), over_b])
    found = jump(pointer)
    return found[:n], found[n:]


class Aligned:
    """Groups and links of pieces, whose bytes are laid end to end."""

    def __init__(self, aligner: Aligner, side_a: _Side, side_b: _Side):
        (a, sizes_a), (b, sizes_b) = side_a, side_b
        ends_a, ends_b = np.cumsum(aligner.width_a[a]), np.cumsum(aligner.width_b[b])
        last_a, last_b = group_ends(ends_a, ends_b)
        terminals = np.flatnonzero(last_a == np.arange(len(a)))
        group_a, group_b = np.searchsorted(terminals, last_a), np.searchsorted(terminals, last_b)
        stretches = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
        stretches = stretches[np.append(stretches[1:] != stretches[:-1], True)]
        self.codes = a[np.searchsorted(ends_a, stretches)] * aligner.size_b + b[np.searchsorted(ends_b, stretches)]
        # Printing order: the A tokens of a group, then its B tokens.
        in_a, in_b = np.bincount(group_a), np.bincount(group_b)
        before_b, upto_a = np.cumsum(in_b) - in_b, np.cumsum(in_a)
        self.order = np.empty(len(a) + len(b), np.int64)
        self.order[np.arange(len(a)) + before_b[group_a]] = 2 * a + np.append(group_a[1:] != group_a[:-1], True)
        self.order[np.arange(len(b)) + upto_a[group_b]] = (
            aligner.first_b + 2 * b + np.append(group_b[1:] != group_b[:-1], True)
        )
        # Running numbers of A and B tokens, groups and links at the end of every piece.
        n_a, n_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
        byte_ends = ends_a[n_a - 1]
        links, groups = (np.searchsorted(x, byte_ends, side="right") for x in (stretches, ends_a[terminals]))
        self.upto = np.stack([n_a, n_b, groups, links], axis=1)

    def counts(self) -> np.ndarray:
        """A and B tokens, groups and links of every piece."""
        return np.diff(self.upto, axis=0, prepend=0)

    def texts(self, aligner: Aligner) -> Iterator[str]:
        """The groups of every piece, each group with its final semicolon."""
        stops = (self.upto[:, 0] + self.upto[:, 1]).tolist()
        printed = list(map(aligner.printed.__getitem__, self.order.tolist()))
        return ("".join(printed[start:stop]) for start, stop in zip([0, *stops], stops, strict=False))


_FIELDS = ["n_a", "n_b", "n_groups", "n_links"]
_Row = tuple[int, int, list[int], str, np.ndarray]


def _rows(aligner: Aligner, texts: list[str | None], part_chars: int) -> Iterator[_Row]:
    """``text number, part number, counts, groups_sha256, codes``; the hash stands in part 0."""
    cut = {i: aligner.pieces(t) for i, t in enumerate(texts) if t and len(t) <= part_chars}
    aligner.learn({p for own in cut.values() for p in own})
    for i, text in enumerate(texts):
        if i in cut:
            found = aligner.numbers(cut[i])
            facts = aligner.facts[found]
            if facts[:, 0].all():
                digest = hashlib.sha256(aligner.text(found)[:-1]).hexdigest()
                yield i, 0, facts[:, 1:].sum(axis=0, dtype=np.int64).tolist(), digest, aligner.links(found)
                continue
        elif text:
            continue
        yield i, 0, [0, 0, 0, 0], "", _NONE
    for i, text in enumerate(texts):
        if text and i not in cut:
            yield from _long_rows(aligner, i, text, part_chars)


def _numbered(aligner: Aligner, text: str, part_chars: int) -> Iterator[np.ndarray]:
    for part in aligner.parts(text, part_chars):
        pieces = aligner.pieces(part)
        aligner.learn(set(pieces))
        yield aligner.numbers(pieces)


def _long_rows(aligner: Aligner, i: int, text: str, part_chars: int) -> Iterator[_Row]:
    """A long text part by part: once to see whether it counts, once for its rows."""
    if not all(aligner.facts[found, 0].all() for found in _numbered(aligner, text, part_chars)):
        yield i, 0, [0, 0, 0, 0], "", _NONE
        return
    digest, between = hashlib.sha256(), b""
    for number, found in enumerate(_numbered(aligner, text, part_chars), start=1):
        digest.update(between)
        digest.update(aligner.text(found)[:-1])
        between = b";"
        yield i, number, aligner.facts[found, 1:].sum(axis=0, dtype=np.int64).tolist(), "", aligner.links(found)
    yield i, 0, [0, 0, 0, 0], digest.hexdigest(), _NONE


def encodings(docs: DataFrame, vocabulary_a: str, model_b: str, doc_id: str = "doc_id", text: str = "text",
              part_chars: int = PART_CHARS) -> DataFrame:
    """``row, part, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, codes``, stored.

    ``row`` tells input rows apart. Paths are read on the driver; the files (about 2 MB,
    the same for any input) are broadcast.
    """
    with open(vocabulary_a, encoding="utf-8") as file, open(model_b, "rb") as model:
        shared = docs.sparkSession.sparkContext.broadcast((file.read(), model.read()))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text")
    )
    id_type = rows.schema["doc_id"].dataType.simpleString()
    kind = code_type(*_sizes(vocabulary_a, model_b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*shared.value)
        for batch in (part for whole in batches for part in text_slices(whole, SLICE_CHARS)):
            for found in _bounded(_rows(aligner, batch.column(2).to_pylist(), part_chars), part_chars):
                at = pa.array([r[0] for r in found], pa.int64())
                codes = np.concatenate([r[4] for r in found])
                edges = np.append(0, np.cumsum([len(r[4]) for r in found])).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(at),
                        pa.array([r[1] for r in found], pa.int32()),
                        batch.column(1).take(at),
                        *(pa.array([r[2][k] for r in found], pa.int64()) for k in range(4)),
                        pa.array([r[3] for r in found], pa.string()),
                        pa.ListArray.from_arrays(edges, pa.array(codes.astype(kind))),
                    ],
                    ["row", "part", "doc_id", *_FIELDS, "groups_sha256", "codes"],
                )

    numbers = ", ".join(f"{c} long" for c in _FIELDS)
    codes = _sql_type(kind)
    found = rows.mapInArrow(run, f"row long, part int, doc_id {id_type}, {numbers}, groups_sha256 string, codes array<{codes}>")
    return scale.store(found)


def _sql_type(kind: type) -> str:
    return "int" if kind is np.int32 else "long"


def _sizes(vocabulary_a: str, model_b: str) -> tuple[int, int]:
    import sentencepiece
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_a).get_vocab_size(), sentencepiece.SentencePieceProcessor(model_file=model_b).get_piece_size()


def _bounded(rows: Iterator[tuple], most: int) -> Iterator[list[tuple]]:
    """Rows in lists with about ``most`` links at the most."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[4])
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Exact sums of the stretches between neighbouring ``ends``."""
    return np.diff(np.append(0, np.cumsum(values, dtype=np.int64))[ends])


def _link_slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows with about ``most`` links each."""
    sizes = np.cumsum(np.asarray(batch.column(2).value_lengths()), dtype=np.int64)
    edges = np.flatnonzero(np.diff(sizes // most)) + 1
    for start, stop in zip([0, *edges], [*edges, batch.num_rows], strict=True):
        yield batch.slice(start, stop - start)


def pair_counts(encoded: DataFrame) -> DataFrame:
    """``code, count``: links of every id pair, over all texts."""
    return encoded.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("count"))


def _frequent_from(counts: DataFrame, most: int) -> int:
    """The smallest power of two that at most ``most`` pairs reach."""
    bits = F.length(F.bin("count")).alias("bits")
    sizes = {r["bits"]: r["count"] for r in counts.groupBy(bits).count().collect()}
    level, total = max(sizes, default=0) + 1, 0
    while level > 1 and total + sizes.get(level - 1, 0) <= most:
        level -= 1
        total += sizes.get(level, 0)
    return 1 << (level - 1)


def align(docs: DataFrame, vocabulary_a: str, model_b: str, doc_id: str = "doc_id", text: str = "text",
          frequent_pairs: int = FREQUENT_PAIRS, part_chars: int = PART_CHARS) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for every row."""
    spark = docs.sparkSession
    sizes = _sizes(vocabulary_a, model_b)
    size_b, kind = sizes[1], code_type(*sizes)
    encoded = encodings(docs, vocabulary_a, model_b, doc_id, text, part_chars)
    counts = scale.materialise(pair_counts(encoded))
    # One row per id of B at most.
    best_rows = scale.materialise(counts.groupBy((F.col("code") % size_b).alias("b")).agg(F.max("count").alias("best")))
    best = np.zeros(size_b, np.int64)
    for r in best_rows.collect():
        best[r["b"]] = r["best"]
    least = _frequent_from(counts, frequent_pairs)
    frequent = counts.filter(F.col("count") >= least).toArrow().sort_by("code")
    known = np.asarray(frequent.column("code"), kind), np.asarray(frequent.column("count"), np.int64)
    shared = spark.sparkContext.broadcast((*known, known[1] == best[known[0] % size_b]))
    carried = ["doc_id", *_FIELDS, "groups_sha256"]
    looked = encoded.select("row", "part", "codes", *carried)
    id_type = looked.schema["doc_id"].dataType.simpleString()

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, totals, top = shared.value
        for batch in (part for whole in batches for part in _link_slices(whole, LINKS_AT_ONCE)):
            lists = batch.column(2)
            asked = np.asarray(lists.flatten(), kind)
            ends = np.append(0, np.cumsum(np.asarray(lists.value_lengths()), dtype=np.int64))
            at = np.searchsorted(codes, asked).clip(max=max(len(codes) - 1, 0))
            hit = codes[at] == asked if len(codes) else np.zeros(len(asked), bool)
            n_best = _sums(hit & top[at] if len(codes) else hit, ends)
            total = _sums(np.where(hit, totals[at], 0) if len(codes) else hit, ends)
            rest = np.append(0, np.cumsum(_sums(~hit, ends))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(n_best), pa.array(total),
                 pa.ListArray.from_arrays(rest, pa.array(asked[~hit])), *batch.columns[3:]],
                ["row", "part", "n_best", "count_sum", "rest", *carried],
            )

    numbers = ", ".join(f"{c} long" for c in _FIELDS)
    found = looked.mapInArrow(
        look_up,
        f"row long, part int, n_best long, count_sum long, rest array<{_sql_type(kind)}>, doc_id {id_type}, {numbers}, "
        "groups_sha256 string",
    )
    if least > 1:
        found = scale.store(found)
        rare = counts.filter(F.col("count") < least).withColumn("b", F.col("code") % size_b)
        rare = rare.join(F.broadcast(best_rows), "b").select(
            "code", "count", (F.col("count") == F.col("best")).cast("long").alias("top")
        )
        late = (
            found.select("row", "part", F.explode("rest").alias("code")).join(rare, "code")
            .groupBy("row", "part").agg(F.sum("count").alias("late_sum"), F.sum("top").alias("late_best"))
        )
        found = found.join(late, ["row", "part"], "left").withColumns(
            {
                "n_best": F.col("n_best") + F.coalesce("late_best", F.lit(0)),
                "count_sum": F.col("count_sum") + F.coalesce("late_sum", F.lit(0)),
            }
        )
    columns = [*_FIELDS, "n_best", "count_sum"]
    if encoded.filter("part > 0").isEmpty():
        return found.select("doc_id", *columns, "groups_sha256")
    several = scale.materialise(encoded.filter("part > 0").select("row").distinct())
    whole = found.join(several, "row", "left_anti").select("doc_id", *columns, "groups_sha256")
    pieces = found.join(several, "row", "left_semi").groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        *[F.sum(c).alias(c) for c in columns],
        F.max("groups_sha256").alias("groups_sha256"),
    )
    return whole.unionByName(pieces.select("doc_id", *columns, "groups_sha256"))

