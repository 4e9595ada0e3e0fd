"""Token ids of whole texts by the tokenizers library, each different word encoded once per worker."""

from __future__ import annotations

import os
import sys
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from salvage.llm.common import ragged

# Words a worker remembers the ids of, and the share of new ones among those of a batch at which it starts afresh.
KNOWN_WORDS = 500_000
STALE = 0.5

# Words encoded in one call.
_AT_ONCE = 512

# A space next to white space or at either end of the text: such texts are encoded whole.
_ODD_SPACE = r"^ | $| [\s\p{Z}\x{85}\x0b\x1c-\x1f]|[\s\p{Z}\x{85}\x0b\x1c-\x1f] "
# Apostrophes begin contractions; control characters and marks beyond ASCII could join a run of signs or a letter.
_ODD_SIGNS = r"'|<\||[\x00-\x08\x0E-\x1F\x7F]|[^\x00-\x7F\p{L}]"
_SIGNS = r"([!-&(-/:-@\[-`{-~]+)"


class TextEncoder:
    """Encodes texts exactly as the tokenizer does, but every different word of a worker once.

    Both public tokenizers split a text before a space that stands alone between two visible characters, so the
    parts between such spaces can be encoded on their own, and many of them in one call. With ``keeps_spaces`` a part
    begins with its space, and texts with other arrangements of spaces are encoded whole. Without it the tokenizer
    drops white space, folds case and splits off runs of signs, so that case and runs of plain signs are set apart before
    words are compared.
    """

    def __init__(self, path: str, keeps_spaces: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        # Only words that are new to the worker reach the model; its own memory of words would not help them.
        self._tokenizer.model._resize_cache(0)
        self._keeps_spaces, self._space = keeps_spaces, " " * keeps_spaces
        vocabulary = self._tokenizer.get_vocab()
        self._edge = np.zeros(max(vocabulary.values()) + 1, bool)
        for piece, i in vocabulary.items():
            self._edge[i] = piece.startswith("Ġ") if keeps_spaces else piece.endswith("</w>")
        self._forget()

    def _forget(self) -> None:
        self._known = pa.array([], pa.string())
        self._ids = np.zeros(1 << 16, np.uint32)
        self._starts = np.zeros(1 << 16, np.int64)
        self._ends = np.zeros(1 << 16, np.int64)
        self._filled = self._count = 0
        self._kept = 0, 0

    def _one_by_one(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        encoded = [e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
        return np.fromiter((i for ids in encoded for i in ids), np.uint32, int(lengths.sum())), lengths

    def _joined(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words that begin with their only space, or that are one word of letters each."""
        ids, lengths = [], []
        for at in range(0, len(texts), _AT_ONCE):
            part = texts[at : at + _AT_ONCE]
            whole = ("" if self._keeps_spaces else " ").join(part)
            found = np.array(self._tokenizer.encode_batch_fast([whole], add_special_tokens=False)[0].ids, np.uint32)
            edges = np.flatnonzero(self._edge[found])
            if len(edges) != len(part):
                found, own = self._one_by_one(part)
            elif self._keeps_spaces:
                own = np.diff(np.append(edges, len(found)))
            else:
                own = np.diff(np.append(-1, edges))
            ids.append(found)
            lengths.append(own)
        return np.concatenate(ids), np.concatenate(lengths)

    def _stands_alone(self, word: str) -> bool:
        """Whether neighbours leave the ids of ``word`` as they are and its ids show its end."""
        if self._keeps_spaces:
            return len(word) > 1 and word[0] == " "
        return word.isalpha() and (word.isascii() or unicodedata.normalize("NFC", word).lower().isalpha())

    def _add(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Appends entries; their places."""
        first, count = self._count, len(lengths)
        self._ids = _grown(self._ids, self._filled + len(ids))
        self._starts, self._ends = _grown(self._starts, first + count), _grown(self._ends, first + count)
        self._ids[self._filled : self._filled + len(ids)] = ids
        ends = self._filled + np.cumsum(lengths)
        self._starts[first : first + count], self._ends[first : first + count] = ends - lengths, ends
        self._filled += len(ids)
        self._count += count
        return np.arange(first, first + count)

    def _places(self, words: pa.Array) -> np.ndarray:
        """Where the ids of different words are kept; new words are encoded and, while there is room, remembered."""
        places = pc.index_in(words, value_set=self._known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        missing = np.flatnonzero(places < 0)
        self._stale = len(self._known) >= KNOWN_WORDS and len(missing) > STALE * len(words)
        new = [self._space + w for w in words.take(pa.array(missing)).to_pylist()]
        alone = np.fromiter(map(self._stands_alone, new), bool, len(new))
        for which, encode in ((np.flatnonzero(alone), self._joined), (np.flatnonzero(~alone), self._one_by_one)):
            if len(which):
                at = missing[which]
                places[at] = self._add(*encode([new[i] for i in which.tolist()]))
                if len(self._known) < KNOWN_WORDS:
                    self._known = pa.concat_arrays([self._known, words.take(pa.array(at))])
                    self._kept = self._count, self._filled
        return places

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and how many each text has. No text may be null."""
        n = len(texts)
        odd = np.zeros(n, bool)
        if self._keeps_spaces:
            is_odd = pc.match_substring_regex(texts, _ODD_SPACE)
            odd = is_odd.to_numpy(zero_copy_only=False)
            if odd.any():
                whole = texts.filter(is_odd).to_pylist()
                texts = pc.if_else(is_odd, pa.scalar("", texts.type), texts)
        else:
            texts = pc.ascii_lower(texts)
            set_apart = pc.replace_substring_regex(texts, _SIGNS, r" \1 ")
            texts = pc.if_else(pc.match_substring_regex(texts, _odd_signs()), texts, set_apart)
        parts = pc.split_pattern(texts, " ")
        firsts = np.asarray(parts.offsets)[:-1].astype(np.int64) - parts.offsets[0].as_py()
        counts = np.diff(np.append(firsts, len(flat := parts.flatten())))
        coded = flat.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        different = coded.dictionary
        places = self._places(different.cast(pa.string()))
        starts, lengths = self._starts[places], self._ends[places] - self._starts[places]
        starts, lengths = starts[codes], lengths[codes]
        if self._keeps_spaces:
            first_places = self._add(*self._one_by_one(flat.take(pa.array(firsts)).to_pylist()))
            if odd.any():
                first_places[odd] = self._add(*self._one_by_one(whole))
            starts[firsts] = self._starts[first_places]
            lengths[firsts] = self._ends[first_places] - self._starts[first_places]
        ids = self._ids[ragged(starts, lengths)]
        before = np.append(0, np.cumsum(lengths))
        if self._stale:
            self._forget()
        else:
            self._count, self._filled = self._kept
        return ids, before[firsts + counts] - before[firsts]


def _grown(array: np.ndarray, size: int) -> np.ndarray:
    if size <= len(array):
        return array
    larger = np.zeros(max(size, 2 * len(array)), array.dtype)
    larger[: len(array)] = array
    return larger


@cache
def _odd_signs() -> str:
    """``_ODD_SIGNS`` and the letters that composing and folding case turn into more than letters."""
    letters = (c for c in map(chr, range(0x80, sys.maxunicode + 1)) if c.isalpha())
    odd = [c for c in letters if not unicodedata.normalize("NFC", c).lower().isalpha()]
    return _ODD_SIGNS + "|[" + "".join(f"\\x{{{ord(c):x}}}" for c in odd) + "]"


@cache
def text_encoder(path: str, keeps_spaces: bool) -> TextEncoder:
    """The worker's encoder; tasks that follow in the same worker go on with its words."""
    return TextEncoder(path, keeps_spaces)


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end`` after those of each text."""
    return np.insert(ids, np.cumsum(counts), np.uint32(end)).astype("<u4"), counts + 1
