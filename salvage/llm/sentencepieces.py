"""SentencePiece ids by a table of each prefix's last token, and their decoding.

In a merge-type vocabulary every text has one encoding, every prefix of it too, and the encoding of a prefix without
its last token is that of the shorter prefix. So it is enough to know, for each prefix, its last token: among the
pieces that end there (found by an automaton) it is the one that is compatible with the last token of what is left,
that is, the pair of them is left as it is when merged from scratch. Ids are then read off backwards.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from salvage.llm.common import documents, pieces

_SPACE = "▁"
_RUN = re.compile(f"{_SPACE}+")
# A lone surrogate occurs in no text that UTF-8 can hold.
_CUT = "\ud800"
# Segments, and pairs of pieces, a worker remembers.
KNOWN_SEGMENTS = 500_000
KNOWN_PAIRS = 500_000


class PieceEncoder:
    """Encoder for one model of merge type with byte fallback and without changes to the text.

    A text is cut where a space follows another character, and around line ends: no piece has a space behind another
    character, or a line end, so none crosses such a cut. Segments met before are looked up.
    """

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.processor = model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(size)]
        self._ids = {model.id_to_piece(i): i for i in range(size) if not special[i]}
        self._scores = {piece: model.get_score(i) for piece, i in self._ids.items()}
        self._bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self._characters = {c for piece in self._ids for c in piece}
        if not self._characters <= self._ids.keys():
            raise ValueError("a character occurs in pieces but is none itself")
        if "\n" in self._characters or any(_SPACE in p.lstrip(_SPACE) for p in self._ids):
            raise ValueError("a piece has a line end, or a space behind another character")
        if model.normalize("á Ａ  b ") != f"{_SPACE}á{_SPACE}Ａ{_SPACE}{_SPACE}b{_SPACE}":
            raise ValueError("the model changes texts before it encodes them")
        self._automaton = ahocorasick.Automaton()
        for piece, i in self._ids.items():
            self._automaton.add_word(piece, (len(piece), i))
        self._automaton.make_automaton()
        self._lengths = [len(model.id_to_piece(i)) for i in range(size)]
        self._own: dict[int, bool] = {}
        self._pairs: list[dict[int, bool]] = [{} for _ in range(size)]  # by the second token
        self._pair_count = 0
        self._segments: dict[str, tuple[int, ...]] = {}
        self._shown = [str(i) for i in range(size)]

    def merged(self, text: str) -> list[str]:
        """The encoding from scratch: the best neighbouring pair is merged, the leftmost of equals, until none is left."""
        never, score = float("-inf"), self._scores.get
        parts = list(text)
        scores = [score(a + b, never) for a, b in zip(parts, parts[1:])]
        while scores:
            best = max(scores)
            if best == never:
                break
            i = scores.index(best)
            parts[i : i + 2] = [whole := parts[i] + parts[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = score(parts[i - 1] + whole, never)
            if i < len(scores):
                scores[i] = score(whole + parts[i + 1], never)
        return parts

    def _fits(self, before: int, token: int) -> bool:
        """Whether two tokens are left as they are when they follow each other."""
        if self._pair_count >= KNOWN_PAIRS:
            for known in self._pairs:
                known.clear()
            self._pair_count = 0
        self._pair_count += 1
        a, b = self.processor.id_to_piece(before), self.processor.id_to_piece(token)
        fits = self._pairs[token][before] = self.merged(a + b) == [a, b]
        return fits

    def _is_own(self, token: int) -> bool:
        """Whether a piece is its own encoding."""
        own = self._own.get(token)
        if own is None:
            own = self._own[token] = len(self.merged(self.processor.id_to_piece(token))) == 1
        return own

    def _known_characters(self, segment: str) -> list[int] | None:
        """The ids of a segment by the table of last tokens; None if a character is no piece.

        The automaton gives the pieces that end at a place from the longest to the shortest. Exactly one of those
        that are their own encoding is compatible with the last token before it.
        """
        last = [0] * (len(segment) + 1)
        pairs = self._pairs
        for end, (length, token) in self._automaton.iter(segment):
            end += 1
            if last[end]:
                continue
            if length == end:
                if self._is_own(token):
                    last[end] = token
            elif before := last[end - length]:
                fits = pairs[token].get(before)
                if fits or fits is None and self._fits(before, token):
                    last[end] = token
        if 0 in last[1:]:
            return None
        ids, end = [], len(segment)
        while end:
            ids.append(last[end])
            end -= self._lengths[last[end]]
        ids.reverse()
        return ids

    def _segment_ids(self, segment: str) -> tuple[int, ...]:
        ids: list[int] = []
        for run in self._runs(segment):
            known = self._known_characters(run)
            ids += [self._bytes[b] for b in run.encode()] if known is None else known
        return tuple(ids)

    def _runs(self, segment: str) -> list[str]:
        """The segment cut around characters that occur in no piece; they are spelt in bytes."""
        if self._characters.issuperset(segment):
            return [segment]
        runs, start = [], 0
        for at, c in enumerate(segment):
            if c not in self._characters:
                runs += [segment[start:at], c]
                start = at + 1
        return [r for r in (*runs, segment[start:]) if r]

    def __call__(self, text: str) -> list[int]:
        """The ids of a text."""
        ids: list[int] = []
        if not text:
            return ids
        segments = self._segments
        for segment in _segments(text):
            known = segments.get(segment)
            if known is None:
                known = self._segment_ids(segment)
                if len(segments) < KNOWN_SEGMENTS and len(segment) <= 64:
                    segments[segment] = known
            ids += known
        return ids

    def shown(self, ids: list[int]) -> str:
        """The ids in decimal, joined by commas."""
        return ",".join([self._shown[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        return self.processor.decode(ids)


def _segments(text: str) -> list[str]:
    """The text with its leading space and spaces as marks, cut before each run of spaces and around line ends."""
    marked = text.replace(" ", _SPACE)
    if "\n" in marked:
        marked = marked.replace("\n", f"{_CUT}\n{_CUT}")
    if _SPACE * 2 in marked or marked[0] == _SPACE:
        marked = _RUN.sub(_CUT + r"\g<0>", _SPACE + marked)
    else:
        marked = _SPACE + marked.replace(_SPACE, _CUT + _SPACE)
    return [part for part in marked.split(_CUT) if part]


@cache
def piece_encoder(path: str) -> PieceEncoder:
    """The worker's encoder; tasks that follow in the same worker go on with its segments."""
    return PieceEncoder(path)


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id`` and ``ids`` of every whole text (null: empty), as the library encodes it, without begin or end.

    Repeated rows and null ids come back as they came; an empty text has no ids; no rows, no rows; other columns are
    ignored.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(model)
        for table in pieces(batches, 1 << 20):
            ids = [encoder(t) for t in table.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [table.column("doc_id").combine_chunks(), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"]
            )

    return documents(docs).mapInArrow(work, "doc_id long, ids array<int>")


def decoded(ids: DataFrame, model: str) -> DataFrame:
    """``doc_id`` and ``text`` for ``doc_id`` and ``ids`` (null: none); ids outside the vocabulary fail the task."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(model)
        for batch in batches:
            texts = [encoder.decode(i or []) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(work, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every text, encoded and decoded in one pass."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(model)
        for table in pieces(batches, 1 << 20):
            counts, of_ids, of_texts = [], [], []
            for text in table.column("text").to_pylist():
                ids = encoder(text)
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(encoder.shown(ids).encode()).hexdigest())
                of_texts.append(hashlib.sha256(encoder.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [table.column("doc_id").combine_chunks(), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_texts)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return documents(docs).mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
