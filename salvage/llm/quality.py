"""Text quality by a generalised additive model with pairwise interactions.

Every feature of a text falls into a bin. Cyclic boosting visits the features in turn and adds a shallow tree over the
bins of one feature at a time, then over the bins of pairs; all trees of a feature add up to one lookup table. A score is
a sum of table entries.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salvage.llm.common import documents, fold, one_array, pieces
from salvage.llm.learning import label_share, labelled_sample

# Labelled documents the model is fitted on, at most.
MOST_LABELLED = 40_000
THRESHOLD = 0.3

FEATURES = (
    "log_bytes", "log_words", "mean_word", "spread_word", "letters", "upper", "digits", "space", "stops", "exclaims",
    "signs", "brackets", "beyond_ascii", "lines_per_word", "upper_words", "signed_words", "lone_signs", "repeated_words",
    "repeated_pairs", "repeated_lines", "commonest_word", "neighbour_repeats",
)

_CLASSES = {
    "letters": bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(0xC2, 0xF5)),
    "upper": bytes(range(65, 91)),
    "digits": b"0123456789",
    "space": b" \t\n\x0b\x0c\r",
    "stops": b".,;:?",
    "exclaims": b"!",
    "signs": b"#$%&*+/<=>@\\^_`|~",
    "brackets": b"()[]{}\"'-",
    "beyond_ascii": bytes(range(0xC2, 0xF5)),
}


def features(texts: pa.Array) -> np.ndarray:
    """A row of ``FEATURES`` per text; no text may be null. Shares of an empty text are 0."""
    n = len(texts)
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, 8 * texts.offset)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    bounds = offsets - offsets[0]
    sizes = np.diff(bounds)

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(flags, dtype=np.int64))
        return (total[bounds[1:]] - total[bounds[:-1]]).astype(np.float64)

    of_class, counts = {}, {}
    for name, members in _CLASSES.items():
        table = np.zeros(256, bool)
        table[np.frombuffer(members, np.uint8)] = True
        of_class[name] = table[raw]
        counts[name] = per_text(of_class[name])
    chars = np.maximum(1, per_text((raw & 0xC0) != 0x80))

    words_of = pc.ascii_split_whitespace(texts)
    word_doc = np.repeat(np.arange(n), np.diff(np.asarray(words_of.offsets)))
    words = words_of.flatten()
    full = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    words, word_doc = words.filter(pa.array(full)), word_doc[full]
    coded = words.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    shapes = coded.dictionary
    lengths = pc.utf8_length(shapes).to_numpy(zero_copy_only=False).astype(np.float64)[code]
    upper_word = pc.utf8_is_upper(shapes).to_numpy(zero_copy_only=False)[code] & (lengths > 1)
    signed = pc.match_substring_regex(shapes, r"[^\s\pL\pN.,;:?]$").to_numpy(zero_copy_only=False)[code]
    lone = pc.match_substring_regex(shapes, r"^[^\pL\pN]+$").to_numpy(zero_copy_only=False)[code]

    def by_doc(values: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(word_doc, values, n).astype(np.float64)

    number = by_doc()
    some = np.maximum(1, number)
    mean = by_doc(lengths) / some
    spread = np.sqrt(np.maximum(0, by_doc(lengths**2) / some - mean**2))
    kinds = max(1, len(shapes))
    different, most = _different(word_doc, code, kinds, n)
    follows = np.flatnonzero(word_doc[1:] == word_doc[:-1])
    pair_doc = word_doc[follows]
    # Pairs are told apart by 32 mixed bits.
    pair = ((code[follows] * kinds + code[follows + 1]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    different_pairs, _ = _different(pair_doc, pair.astype(np.int64), 1 << 32, n)
    pairs = np.bincount(pair_doc, minlength=n)
    same_next = np.bincount(pair_doc, code[follows] == code[follows + 1], n)

    lines_of = pc.split_pattern(texts, "\n")
    line_doc = np.repeat(np.arange(n), np.diff(np.asarray(lines_of.offsets)))
    line = lines_of.flatten().dictionary_encode()
    different_lines, _ = _different(line_doc, line.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(line.dictionary)), n)
    lines = np.bincount(line_doc, minlength=n).astype(np.float64)

    size = np.maximum(1, sizes)
    rows = [
        np.log1p(sizes), np.log1p(number), mean, spread,
        counts["letters"] / chars, counts["upper"] / np.maximum(1, counts["letters"]),
        *(counts[c] / chars for c in ("digits", "space", "stops", "exclaims", "signs", "brackets")),
        counts["beyond_ascii"] / size, lines / some,
        by_doc(upper_word) / some, by_doc(signed) / some, by_doc(lone) / some,
        1 - different / some, 1 - different_pairs / np.maximum(1, pairs), 1 - different_lines / np.maximum(1, lines),
        most / some, same_next / some,
    ]
    return np.stack(rows, axis=1)


def _different(doc: np.ndarray, code: np.ndarray, kinds: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many different codes each document has, and how often its commonest."""
    keys, times = np.unique(doc * kinds + code, return_counts=True)
    of = keys // kinds
    most = np.zeros(n)
    np.maximum.at(most, of, times)
    return np.bincount(of, minlength=n).astype(np.float64), most


@dataclass
class AdditiveModel:
    """Bin edges and lookup tables; ``pairs`` holds (feature, feature, table over coarse bins)."""

    bins: int = 48
    coarse: int = 12
    rounds: int = 150
    rate: float = 0.1
    pair_count: int = 8
    bias: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    coarse_edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def fit(self, rows: np.ndarray, labels: np.ndarray, share: float | None = None) -> AdditiveModel:
        """Fits ``rows`` (one per text) to ``labels``; ``share`` is the share of ones that scores are made for.

        Without rows, or with one label value only, every score is near that value or the share.
        """
        share = min(0.999, max(0.001, 0.5 if share is None else share))
        if not len(rows) or labels.min() == labels.max():
            known = share if not len(rows) else min(0.99, max(0.01, labels.mean()))
            self.edges = self.coarse_edges = [np.zeros(0)] * len(FEATURES)
            self.tables, self.bias = [np.zeros(1)] * len(FEATURES), float(np.log(known / (1 - known)))
            return self
        quantiles = lambda column, k: np.unique(np.quantile(column, np.linspace(0, 1, k + 1)[1:-1]))
        self.edges = [quantiles(c, self.bins) for c in rows.T]
        self.coarse_edges = [quantiles(c, self.coarse) for c in rows.T]
        binned = self._binned(rows, self.edges)
        # Rows are weighted so that the labels have the share that scores are made for.
        mean = labels.mean()
        weight = np.where(labels == 1, share / mean, (1 - share) / (1 - mean))
        self.bias = float(np.log(share / (1 - share)))
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        raw = np.full(len(rows), self.bias)
        for _ in range(self.rounds):
            for f, table in enumerate(self.tables):
                gradient, curve = _slopes(raw, labels, weight)
                at = binned[:, f]
                step = self.rate * _tree(np.bincount(at, gradient, len(table)), np.bincount(at, curve, len(table)))
                table += step
                raw += step[at]
        coarse = self._binned(rows, self.coarse_edges)
        width = self.coarse
        cells = lambda i, j: coarse[:, i] * width + coarse[:, j]
        gradient, curve = _slopes(raw, labels, weight)
        gains = []
        for i, j in combinations(range(rows.shape[1]), 2):
            g, h = np.bincount(cells(i, j), gradient, width * width), np.bincount(cells(i, j), curve, width * width)
            gains.append((-float((g**2 / (h + 5)).sum()), i, j))
        self.pairs = [(i, j, np.zeros((width, width))) for _, i, j in sorted(gains)[: self.pair_count]]
        for _ in range(self.rounds // 2):
            for i, j, table in self.pairs:
                gradient, curve = _slopes(raw, labels, weight)
                at = cells(i, j)
                g = np.bincount(at, gradient, width * width).reshape(width, width)
                h = np.bincount(at, curve, width * width).reshape(width, width)
                step = self.rate * _pair_tree(g, h)
                table += step
                raw += step.reshape(-1)[at]
        return self

    @staticmethod
    def _binned(rows: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "right") for e, c in zip(edges, rows.T)], axis=1)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Between 0 and 1 for every row: bins are looked up and added, for all rows at once."""
        raw = np.full(len(rows), self.bias)
        for table, at in zip(self.tables, self._binned(rows, self.edges).T):
            raw += table[at]
        if self.pairs:
            coarse = self._binned(rows, self.coarse_edges)
            for i, j, table in self.pairs:
                raw += table[coarse[:, i], coarse[:, j]]
        return 1 / (1 + np.exp(-np.clip(raw, -40, 40)))


def _slopes(raw: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-raw))
    return weight * (labels - p), weight * p * (1 - p)


def _leaf(g: np.ndarray | float, h: np.ndarray | float) -> np.ndarray | float:
    return g / (h + 5)


def _cut(g: np.ndarray, h: np.ndarray) -> int:
    """Where a cut in two gains most; 0 for none."""
    if len(g) < 2:
        return 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = left_g**2 / (left_h + 5) + (g.sum() - left_g) ** 2 / (h.sum() - left_h + 5)
    return int(np.argmax(gain)) + 1


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of depth two over the bins of a feature, as a table."""
    out, middle = np.zeros(len(g)), _cut(g, h)
    for a, b in ((0, middle), (middle, len(g))):
        cut = a + _cut(g[a:b], h[a:b])
        for lo, hi in ((a, cut), (cut, b)):
            if hi > lo:
                out[lo:hi] = _leaf(g[lo:hi].sum(), h[lo:hi].sum())
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree that cuts one feature, then the other on either side, as a table; the better order of the two."""

    def cut_rows(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
        out, gain, row = np.zeros(g.shape), 0.0, _cut(g.sum(axis=1), h.sum(axis=1))
        for a, b in ((0, row), (row, len(g))):
            if b > a:
                own_g, own_h = g[a:b].sum(axis=0), h[a:b].sum(axis=0)
                column = _cut(own_g, own_h)
                for lo, hi in ((0, column), (column, g.shape[1])):
                    if hi > lo:
                        out[a:b, lo:hi] = _leaf(own_g[lo:hi].sum(), own_h[lo:hi].sum())
                        gain += own_g[lo:hi].sum() ** 2 / (own_h[lo:hi].sum() + 5)
        return gain, out

    (by_row, first), (by_column, second) = cut_rows(g, h), cut_rows(g.T, h.T)
    return first if by_row >= by_column else second.T


def fitted(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, label: str = "quality") -> AdditiveModel:
    """The model of a bounded sample; the driver holds its features, ``most`` rows of ``FEATURES``."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in pieces(batches):
            rows = features(one_array(table.column("text")))
            yield pa.RecordBatch.from_arrays(
                [one_array(table.column("doc_id")), one_array(table.column("label")), pa.array(list(rows), pa.list_(pa.float64()))],
                names=["doc_id", "label", "row"],
            )

    sample = labelled_sample(docs, labels, label, most).select("doc_id", "text", "label")
    found = sample.mapInArrow(work, "doc_id long, label int, row array<double>").toArrow().sort_by("doc_id")
    rows = found.column("row").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
    return AdditiveModel().fit(rows, found.column("label").to_numpy().astype(float), label_share(labels, label))


def scored(docs: DataFrame, model: AdditiveModel, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document, from its whole text alone.

    A null text is scored as empty; repeated rows and null ids come back as they came (a null id counts as empty text in the
    checksum); no rows, no rows; other columns are ignored.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in pieces(batches):
            score = model.score(features(one_array(table.column("text"))))
            yield pa.RecordBatch.from_arrays([one_array(table.column("doc_id")), pa.array(score)], names=["doc_id", "score"])

    return (
        documents(docs).mapInArrow(work, "doc_id long, score double")
        .select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
    )


def accepted(docs: DataFrame, model: AdditiveModel, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not rejected, columns as they came; rows without an id stay."""
    gone = scored(docs, model, threshold).where("predicted = 0").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
