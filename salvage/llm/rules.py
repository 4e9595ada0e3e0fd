"""Quality rules by distribution divergence: how far a document's characters and words lie from those of a language.

Two histograms of a document are compared with the same histograms of every language of the corpus: the classes of its
characters, and the most common words of the language with all other words as one more bin. The measure is the
Jensen-Shannon distance (square root of the divergence in bits, 0 to 1), the verdict goes by the nearest language, so that a
wrong or missing language tag condemns nobody. A histogram of few items is noise: below a least length it isn't asked.

The references are learnt from all documents of a least length that name their language: word counts are summed on the
map side, and what comes to the driver is bounded by ``LEAST_SHARE`` and ``COMMON``.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salvage.llm.common import documents, one_array, pieces

# Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of the words

# Signs around a word that do not belong to it, and the classes of characters (all others: other signs).
EDGES = b".,;:!?\"'()"
STOPS = b".,;:!?\"'()-"
CLASSES = ("lower", "upper", "digit", "space", "stop", "sign", "control", "beyond")

COMMON = 100
# A language is one that this share of the documents name: so there are at most a thousand.
LEAST_SHARE = 1 / 1000
# Where the comparison starts, and the greatest distances of an acceptable document.
CLASS_CHARS, CLASS_DISTANCE = 200, 0.3
WORD_COUNT, WORD_DISTANCE = 150, 0.4

_INSIDE = len(CLASSES)  # bytes inside a character, which are not counted


def _class_table() -> np.ndarray:
    table = np.full(256, CLASSES.index("sign"), np.uint8)
    table[[*range(0x20), 0x7F]] = CLASSES.index("control")
    table[[*b" \t\n\x0b\x0c\r"]] = CLASSES.index("space")
    table[[*STOPS]] = CLASSES.index("stop")
    table[ord("0") : ord("9") + 1] = CLASSES.index("digit")
    table[ord("A") : ord("Z") + 1] = CLASSES.index("upper")
    table[ord("a") : ord("z") + 1] = CLASSES.index("lower")
    table[0x80:0xC0] = _INSIDE
    table[0xC0:] = CLASSES.index("beyond")
    return table


_CLASS_OF = _class_table()
_SPACE, _REST = CLASSES.index("space"), bytes(set(range(256)) - set(SYMBOLS))


def class_counts(raw: bytes) -> np.ndarray:
    """How many characters of a text in UTF-8 are of each of ``CLASSES``."""
    return np.bincount(_CLASS_OF[np.frombuffer(raw, np.uint8)], minlength=_INSIDE + 1)[:_INSIDE]


def plain_words(raw: bytes) -> list[bytes]:
    """The words with A-Z in lower case and without the signs around them; a word of signs is empty."""
    return [w.strip(EDGES) for w in raw.lower().split()]


def repeated_words(words: list[bytes]) -> int:
    """How many words lie in a window of three words that the text holds twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    times = Counter(windows)
    if len(times) == len(windows):
        return 0
    again = bytearray(len(words))
    for at, window in enumerate(windows):
        if times[window] > 1:
            again[at : at + 3] = b"\1\1\1"
    return sum(again)


def repeated_lines(raw: bytes) -> int:
    """How many lines that hold a word equal an earlier line."""
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def distances(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """The Jensen-Shannon distance of every row of counts to the counts of a reference."""
    p = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    q = np.broadcast_to(reference / max(reference.sum(), 1), p.shape)
    middle = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        apart = np.where(p > 0, p * np.log2(p / middle), 0) + np.where(q > 0, q * np.log2(q / middle), 0)
    return np.sqrt(np.maximum(apart.sum(axis=1) / 2, 0))


@dataclass(frozen=True)
class References:
    """Of every language: counts of ``CLASSES``, its common words, and the counts of these and of all other words."""

    classes: dict[str, np.ndarray] = field(default_factory=dict)
    words: dict[str, list[bytes]] = field(default_factory=dict)
    counts: dict[str, np.ndarray] = field(default_factory=dict)


_COUNTED = "lang string, kind string, item string, docs long, times long"


def languages(docs: DataFrame) -> list[str]:
    """The languages that ``LEAST_SHARE`` of all documents name."""
    named = docs.groupBy(F.col("lang").cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("n"))
    total = named.agg(F.sum("n")).first()[0] or 0
    return sorted(r.lang for r in named.where(F.col("lang").isNotNull() & (F.col("n") >= total * LEAST_SHARE)).collect())


def references(docs: DataFrame, common: int = COMMON, least_words: int = LEAST_WORDS) -> References:
    """The references of all ``languages``, from their documents of ``least_words`` words or more.

    A language's common words are those that the most of its documents hold (ties: the least word).
    Documents without a language teach nothing; repeated rows count as often as they come; without documents there are
    no references.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in pieces(batches):
            held, times, classes = defaultdict(Counter), defaultdict(Counter), defaultdict(lambda: np.zeros(_INSIDE, np.int64))
            for lang, text in zip(table.column("lang").to_pylist(), table.column("text").to_pylist()):
                raw = text.encode()
                words = plain_words(raw)
                if len(words) >= least_words:
                    classes[lang] += class_counts(raw)
                    found = Counter(words)
                    times[lang].update(found)
                    held[lang].update(found.keys())
            rows = [(lang, "class", name, 0, int(n)) for lang, c in classes.items() for name, n in zip(CLASSES, c)]
            for lang, words in held.items():
                rows.append((lang, "all", "", 0, times[lang].total()))
                rows += [(lang, "word", w.decode(), n, times[lang][w]) for w, n in words.items() if w]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["lang", "kind", "item", "docs", "times"])

    known = languages(docs)
    named = documents(docs, F.col("lang").cast("string").alias("lang")).where(F.col("lang").isin(known))
    sums = named.mapInArrow(work, _COUNTED).groupBy("lang", "kind", "item")
    sums = sums.agg(F.sum("docs").alias("docs"), F.sum("times").alias("times"))
    # The limit of a window is applied before its shuffle, so few rows of a language meet.
    place = F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("docs"), "item"))
    first = sums.withColumn("place", place).where((F.col("place") <= max(common, _INSIDE))).orderBy("lang", "kind", "place")
    classes, words, every = defaultdict(lambda: np.zeros(_INSIDE)), defaultdict(dict), {}
    for r in first.collect():
        if r.kind == "class":
            classes[r.lang][CLASSES.index(r.item)] = r.times
        elif r.kind == "all":
            every[r.lang] = r.times
        elif r.place <= common:
            words[r.lang][r.item.encode()] = r.times
    counts = {lang: np.array([*words[lang].values(), every[lang] - sum(words[lang].values())], float) for lang in every}
    return References(dict(classes), {lang: list(words[lang]) for lang in every}, counts)


SCORED = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "class_distance double, word_distance double, base_failed boolean, kept boolean"
)


def scored(
    docs: DataFrame, learnt: References, class_distance: float = CLASS_DISTANCE, word_distance: float = WORD_DISTANCE
) -> DataFrame:
    """Counts, distances and verdict of every document, as ``SCORED`` names them.

    ``base_failed`` are texts of fewer than ``LEAST_WORDS`` words or with more than ``MOST_REPEATED`` per cent of them in repeated
    windows. ``kept`` are the others unless a distance to the nearest reference is greater than allowed.
    ``class_distance`` is null for texts of fewer than ``CLASS_CHARS`` characters, ``word_distance`` for those of fewer than
    ``WORD_COUNT`` words, both without references; null passes.

    A null or empty text has no words and fails. Every row is judged by itself and whole, however long; repeated rows
    and null ids come back as they came. No rows, no result rows; other columns are ignored.
    """
    places: dict[bytes, int] = {}
    for words in learnt.words.values():
        for w in words:
            places.setdefault(w, len(places))
    own = {lang: [places[w] for w in words] for lang, words in learnt.words.items()}

    def nearest(rows: list[np.ndarray]) -> np.ndarray:
        return np.min(rows, axis=0)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in pieces(batches):
            texts = table.column("text").to_pylist()
            base = np.zeros((len(texts), 5), np.int64)
            classes = np.zeros((len(texts), _INSIDE))
            found = np.zeros((len(texts), len(places) + 1))
            for row, text in enumerate(texts):
                raw = text.encode()
                words = raw.split()
                classes[row] = class_counts(raw)
                inside = classes[row].sum() - classes[row, _SPACE]
                base[row] = len(words), inside, len(raw.translate(None, _REST)), repeated_lines(raw), repeated_words(words)
                for w, n in Counter(plain_words(raw)).items():
                    found[row, places.get(w, -1)] += n
            far = np.full((2, len(texts)), np.nan)
            if own:
                of_classes = nearest([distances(classes, c) for c in learnt.classes.values()])
                every = found.sum(axis=1)
                of_words = nearest([
                    distances(np.column_stack([part := found[:, at], every - part.sum(axis=1)]), learnt.counts[lang])
                    for lang, at in own.items()
                ])
                far[0] = np.where(classes.sum(axis=1) >= CLASS_CHARS, of_classes, np.nan)
                far[1] = np.where(base[:, 0] >= WORD_COUNT, of_words, np.nan)
            failed = (base[:, 0] < LEAST_WORDS) | (100 * base[:, 4] > MOST_REPEATED * base[:, 0])
            kept = ~failed & ~(far[0] > class_distance) & ~(far[1] > word_distance)
            yield pa.RecordBatch.from_arrays(
                [
                    one_array(table.column("doc_id")), *map(pa.array, np.ascontiguousarray(base.T)),
                    *(pa.array(f, mask=np.isnan(f)) for f in far), pa.array(failed), pa.array(kept),
                ],
                names=[f.split()[0] for f in SCORED.split(", ")],
            )

    return documents(docs).mapInArrow(work, SCORED)


def accepted(docs: DataFrame, learnt: References, **limits: float) -> DataFrame:
    """The documents that are kept, columns as they came. Rows of one id go together if one of them goes; rows without
    an id cannot be told apart and stay. No rows, no result rows."""
    gone = scored(docs, learnt, **limits).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
