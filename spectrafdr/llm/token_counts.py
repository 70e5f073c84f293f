"""Token counts of whole texts with a public byte-level BPE vocabulary.

Ordinary texts are cut where the library's pre-tokenisation is certain to cut as well -
before white space that follows something else - and each distinct piece is encoded once
per batch run. Huge texts go through overlapping chunks that are encoded with offsets:
two neighbouring chunks are joined at a boundary both have inside their overlap, that is
certain in the same sense, and after which they agree; where none exists the overlap is
doubled, up to the chunk's start. A run without such a boundary is encoded once, up to the
next place that is certain, so the work stays in proportion to the text.

Why such a boundary is certain: no pre-token of the vocabulary's pattern holds white space
after another character, so a match never runs over the place where white space begins,
whatever stands to its left or right. A special string in a text could run over it only if
it held white space; vocabularies with such strings, and those without that pattern, are
encoded whole.

Cases: a null text counts like an empty one (0 bytes, 0 tokens); ids may be null and rows
may repeat; an empty table gives an empty result; only id and text are read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrafdr.llm.common import text_slices

HUGE_CHARS = 65_536
CHUNK_CHARS = 32_768
OVERLAP_CHARS = 256
MEMO_PIECES = 500_000
JOINED_CHARS = 65_536
# The characters of Unicode's White_Space property, as the pattern's \s has them.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# A piece starts with white space (or at the start) and goes on to the next white space
# that follows something else, or to a mark behind a letter: within a pre-token a letter is
# followed by letters only.
_PIECE = re.compile(
    f"[{_SPACE}]*[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[.,!?;:%&$*#|])|[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+"
)
_BLANK_PIECE = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
_IS_SPACE = re.compile(f"[{_SPACE}]")
# Where white space begins: a certain boundary, see above.
_EDGE = re.compile(f"(?<=[^{_SPACE}])[{_SPACE}]")
_WHOLE_PIECE = re.compile(f"[{_SPACE}]+[^{_SPACE}]+(?=[{_SPACE}])")


class PieceCounter:
    """Counts tokens with one loaded tokenizer; ``stats`` tells how huge texts were joined."""

    def __init__(self, definition: str, huge: int = HUGE_CHARS, chunk: int = CHUNK_CHARS,
                 overlap: int = OVERLAP_CHARS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.certain = splits_at_white_space(definition)
        self.specials = [t["content"] for t in json.loads(definition).get("added_tokens", [])]
        self.huge, self.chunk, self.overlap = huge, chunk, overlap
        self.memo: dict[str, int] = {}
        self.stats = {"joined": 0, "widened": 0}

    def count(self, text: str) -> int:
        return self.count_all([text])[0]

    def count_all(self, texts: list[str]) -> list[int]:
        """Token counts of whole texts; new pieces of all of them are encoded together."""
        if not self.certain:
            return [len(self.tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
        cut = [None if len(t) > self.huge else self._cut(t) for t in texts]
        self._learn(cut)
        known = self.memo.__getitem__
        return [
            self._chunked(text) if pieces is None else sum(map(known, pieces))
            for text, pieces in zip(texts, cut, strict=True)
        ]

    def _cut(self, text: str) -> list[str]:
        """Certain pieces; a special string holds marks behind letters, so it stays in one."""
        with_special = any(special in text for special in self.specials)
        return (_BLANK_PIECE if with_special else _PIECE).findall(text)

    def _learn(self, cut: list[list[str] | None]) -> None:
        if len(self.memo) > MEMO_PIECES:
            self.memo.clear()
        unknown = set().union(*(p for p in cut if p)) - self.memo.keys()
        # Pieces of white space and something else can stand behind one another; a first
        # piece without white space, and white space at an end, are encoded alone.
        run: list[str] = []
        length = 0
        for piece in unknown:
            if not _IS_SPACE.match(piece) or _IS_SPACE.match(piece, len(piece) - 1):
                self.memo[piece] = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
                continue
            run.append(piece)
            length += len(piece)
            if length > JOINED_CHARS:
                self._encode_run(run)
                run, length = [], 0
        self._encode_run(run)

    def _encode_run(self, run: list[str]) -> None:
        if not run:
            return
        encoded = self.tokenizer.encode("".join(run), add_special_tokens=False)
        starts = np.fromiter((a for a, _ in encoded.offsets), dtype=np.int64)
        edges = np.cumsum([0, *map(len, run)])
        counts = np.diff(np.searchsorted(starts, edges))
        self.memo.update(zip(run, counts.tolist(), strict=True))

    def _ends(self, text: str, start: int, stop: int) -> list[tuple[int, int]]:
        encoded = self.tokenizer.encode(text[start:stop], add_special_tokens=False)
        return [(a + start, b + start) for a, b in encoded.offsets]

    def _chunked(self, text: str) -> int:
        """Tokens before the current chunk's certain start, plus its own up to the next join."""
        total, start, stop = 0, 0, min(len(text), self.chunk)
        tokens = self._ends(text, start, stop)
        while stop < len(text):
            if _EDGE.search(text, start + 1, stop) is None:
                total, start, stop, tokens = self._run(text, total, start, stop)
                continue
            overlap = self.overlap
            while True:
                begin = max(start, stop - overlap)
                end = min(len(text), begin + self.chunk + overlap)
                following = self._ends(text, begin, end)
                at = common_boundary(text, tokens, following, begin, stop)
                if at is not None:
                    self.stats["joined"] += 1
                    break
                self.stats["widened"] += 1
                if begin == start:
                    break
                overlap *= 2
            if at is None:
                total, start, stop, tokens = self._run(text, total, start, stop)
                continue
            total += sum(1 for a, _ in tokens if a < at)
            tokens = [t for t in following if t[0] >= at]
            start, stop = at, end
        return total + len(tokens)


    def _run(self, text: str, total: int, start: int, stop: int) -> tuple[int, int, int, list[tuple[int, int]]]:
        """Past a run without a boundary in it: from its certain start to the next certain one, once."""
        edge = _EDGE.search(text, stop)
        end = edge.start() if edge else len(text)
        total += len(self._ends(text, start, end))
        following = min(len(text), end + self.chunk)
        return total, end, following, self._ends(text, end, following)


def common_boundary(text: str, left: list[tuple[int, int]], right: list[tuple[int, int]],
                    begin: int, stop: int) -> int | None:
    """First place where white space begins, both sides start a token, and then agree.

    ``left`` ends at ``stop`` and ``right`` begins at ``begin``. The tokens of one more
    piece must be equal on both sides, so a token cut short by an end is never counted.
    """
    starts = {a for a, _ in left}
    ours = [t for t in left if t[0] > begin]
    theirs = [t for t in right if begin < t[0]]
    known = {a for a, _ in theirs}
    for a, _ in ours:
        if a in known and a in starts and _IS_SPACE.match(text, a) and not _IS_SPACE.match(text, a - 1):
            following = _WHOLE_PIECE.match(text, a, stop)
            if following is None:
                return None
            piece_end = following.end()
            if [t for t in ours if a <= t[0] < piece_end] == [t for t in theirs if a <= t[0] < piece_end]:
                return a
    return None


def splits_at_white_space(definition: str) -> bool:
    """Whether the vocabulary's pre-tokenisation is the byte-level pattern, without normaliser."""
    read = json.loads(definition)
    pre = read.get("pre_tokenizer") or {}
    plain = all(
        not re.search(r"\s", t["content"]) and not t["lstrip"] and not t["rstrip"]
        for t in read.get("added_tokens", [])
    )
    return (
        plain
        and read.get("normalizer") is None
        and pre.get("type") == "ByteLevel"
        and pre.get("use_regex", True)
        and not pre.get("add_prefix_space", True)
    )


def count_tokens(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text",
                 limit: int = 1024) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row.

    ``vocabulary`` is the path of a tokenizers JSON file on the driver. Its contents
    (about 2 MB, the same for any input) are broadcast; executors need no such path.
    """
    with open(vocabulary, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(shared.value)
        for batch in (part for whole in batches for part in text_slices(whole)):
            texts = batch.column(1)
            tokens = counter.count_all([t or "" for t in texts.to_pylist()])
            n_bytes = pa.compute.fill_null(pa.compute.binary_length(texts), 0)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    n_bytes.cast(pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array([n > limit for n in tokens], pa.bool_()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return rows.mapInArrow(
        count, f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean"
    )
