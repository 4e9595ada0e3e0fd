"""Range asymmetric numeral system over token ids, many blocks and lanes at once.

A section holds a frequency table and blocks that share it. A block deals its ids to ``LANES`` interleaved states in
turn and has one stream of 32-bit words; checkpoints hold the states and the place in the stream every so many
steps. Any stretch between checkpoints can be decoded on its own; a whole section decodes all of its stretches side
by side. Every block carries the crc32 of its words and states.
"""

from __future__ import annotations

import struct
import zlib
from typing import NamedTuple

import numpy as np

LANES = 64
BLOCK_IDS = 1 << 16
CHECKPOINT_STEPS = 256

_MAGIC = b"TRANS001"
_HEADER = struct.Struct("<8sQIIIIII")  # magic, ids, table entries, bits, blocks, steps, stretches, lanes
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)
_WORD_MASK = np.uint64(0xFFFFFFFF)


def frequencies(counts: np.ndarray, bits: int) -> np.ndarray:
    """Counts over zero scaled to sum up to ``2 ** bits``, none of them to zero."""
    total = 1 << bits
    scaled = np.maximum(1, counts.astype(np.float64) / counts.sum() * total).astype(np.int64)
    spare = total - int(scaled.sum())
    if spare >= 0:
        scaled[int(np.argmax(scaled))] += spare
    while spare < 0:
        large = np.argsort(-scaled, kind="stable")[:1024]
        cut = np.minimum(scaled[large] // 2, -spare - np.append(0, np.cumsum(scaled[large] // 2)[:-1])).clip(0)
        scaled[large] -= cut
        spare += int(cut.sum())
    return scaled


def encode(ids: np.ndarray, block_ids: int = BLOCK_IDS, lanes: int = LANES) -> bytes:
    """One section. ``ids``: unsigned 32-bit integers, possibly none."""
    n = len(ids)
    if not n:
        return _HEADER.pack(_MAGIC, 0, 0, 0, 0, 0, 0, lanes)
    alphabet, counts, symbols = _alphabet(ids)
    bits = min(31, max(16, len(alphabet).bit_length() + 4))
    freq = frequencies(counts, bits)
    start = np.cumsum(freq) - freq

    blocks = -(-n // block_ids)
    steps = -(-n // (blocks * lanes))
    stretches = max(1, round(steps / CHECKPOINT_STEPS))
    length = -(-steps // stretches)
    steps = length * stretches
    padded = np.full(blocks * steps * lanes, int(np.argmax(freq)), np.int64)
    padded[:n] = symbols
    grid = padded.reshape(blocks, steps, lanes)

    freq64, start64, shift = freq.astype(np.uint64), start.astype(np.uint64), np.uint64(bits)
    state = np.full((blocks, lanes), _LOW, np.uint64)
    words = np.zeros((steps, blocks, lanes), np.uint32)
    sent = np.zeros((steps, blocks, lanes), bool)
    states = np.zeros((blocks, stretches, lanes), np.uint64)
    room = np.uint64(63 - bits)
    for step in range(steps - 1, -1, -1):
        s = grid[:, step, :]
        f = freq64[s]
        full = state >= (f << room)
        words[step], sent[step] = state & _WORD_MASK, full
        state = np.where(full, state >> _WORD, state)
        whole = state // f
        state = (whole << shift) + (state - whole * f) + start64[s]
        if step % length == 0:
            states[:, step // length] = state
    sent = sent.transpose(1, 0, 2)
    words = words.transpose(1, 0, 2)
    per_step = np.cumsum(sent.sum(axis=2), axis=1)
    places = np.zeros((blocks, stretches), np.uint32)
    places[:, 1:] = per_step[:, length - 1 : -1 : length][:, : stretches - 1]
    parts = [
        _HEADER.pack(_MAGIC, n, len(alphabet), bits, blocks, steps, stretches, lanes),
        table := alphabet.astype("<u4").tobytes() + freq.astype("<u4").tobytes(),
        struct.pack("<I", zlib.crc32(table)),
    ]
    for b in range(blocks):
        own = words[b][sent[b]].astype("<u4").tobytes()
        head = places[b].astype("<u4").tobytes() + states[b].astype("<u8").tobytes()
        parts += [struct.pack("<II", len(own) // 4, zlib.crc32(own, zlib.crc32(head))), head, own]
    return b"".join(parts)


def _alphabet(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different ids, their counts, and the ids as places among them."""
    top = int(ids.max())
    if top >= 1 << 24:
        alphabet, symbols, counts = np.unique(ids, return_inverse=True, return_counts=True)
        return alphabet, counts, symbols
    counts = np.bincount(ids, minlength=top + 1)
    alphabet = np.flatnonzero(counts)
    place = np.zeros(top + 1, np.int64)
    place[alphabet] = np.arange(len(alphabet))
    return alphabet, counts[alphabet], place[ids]


class Section(NamedTuple):
    """A parsed section: where every stretch starts."""

    n: int
    alphabet: np.ndarray
    freq: np.ndarray
    bits: int
    length: int  # steps of a stretch
    words: np.ndarray
    states: np.ndarray  # stretches x lanes
    places: np.ndarray  # of each stretch in words
    lanes: int


def parse(section: bytes) -> Section:
    """Reads a section and checks its checksums; ``ValueError`` if it is damaged."""
    if len(section) < _HEADER.size:
        raise ValueError("a section is cut short")
    magic, n, entries, bits, blocks, steps, stretches, lanes = _HEADER.unpack_from(section)
    if magic != _MAGIC:
        raise ValueError("not a section of token ids")
    at = _HEADER.size
    if not n:
        none = np.zeros(0, np.uint32)
        return Section(0, none, none, 0, 0, none, np.zeros((0, lanes), np.uint64), none, lanes)
    table = section[at : at + 8 * entries]
    at += 8 * entries
    if len(table) < 8 * entries or section[at : at + 4] != struct.pack("<I", zlib.crc32(table)):
        raise ValueError("the frequency table is damaged")
    at += 4
    alphabet, freq = np.frombuffer(table, "<u4").reshape(2, entries)
    words, states, places, before = [], [], [], 0
    for b in range(blocks):
        count, crc = struct.unpack_from("<II", section, at)
        head = section[at + 8 : at + 8 + stretches * (4 + 8 * lanes)]
        at += 8 + len(head)
        own = section[at : at + 4 * count]
        at += 4 * count
        if zlib.crc32(own, zlib.crc32(head)) != crc:
            raise ValueError(f"block {b} is damaged")
        words.append(np.frombuffer(own, "<u4"))
        places.append(np.frombuffer(head, "<u4", stretches).astype(np.int64) + before)
        states.append(np.frombuffer(head, "<u8", stretches * lanes, 4 * stretches).reshape(stretches, lanes))
        before += count
    return Section(
        n, alphabet, freq, bits, steps // stretches, np.concatenate(words),
        np.concatenate(states), np.concatenate(places), lanes,
    )


def decode(section: bytes | Section, stretches: slice = slice(None)) -> np.ndarray:
    """The ids of a section, or of some of its stretches (each ``length * lanes`` ids, the last ones fewer)."""
    s = parse(section) if isinstance(section, bytes) else section
    if not s.n:
        return np.zeros(0, "<u4")
    freq, shift, low_bits = s.freq.astype(np.uint64), np.uint64(s.bits), np.uint64((1 << s.bits) - 1)
    start = np.cumsum(freq) - freq
    symbol_at = np.repeat(np.arange(len(freq), dtype=np.int32), s.freq)
    state, place = s.states[stretches].copy(), s.places[stretches].copy()
    words = np.append(s.words, np.uint32(0)).astype(np.uint64)
    out = np.empty((len(state), s.length, s.lanes), np.int32)
    for step in range(s.length):
        slot = state & low_bits
        symbol = symbol_at[slot]
        out[:, step] = symbol
        state = freq[symbol] * (state >> shift) + slot - start[symbol]
        low = state < _LOW
        rank = np.cumsum(low, axis=1)
        next_words = words[np.where(low, place[:, None] + rank - 1, len(words) - 1)]
        state = np.where(low, (state << _WORD) | next_words, state)
        place += rank[:, -1]
    first, _, _ = stretches.indices(len(s.states))
    left = s.n - first * s.length * s.lanes
    return s.alphabet[out.reshape(-1)[: max(0, left)]]
