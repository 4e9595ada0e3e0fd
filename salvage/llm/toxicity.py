"""Toxicity by a bidirectional gated recurrent network with attention, in numpy.

A word enters as the sum of an embedding of the word and the mean of embeddings of its character n-grams, so that words
never seen share what their parts mean. A network reads windows of words in both directions; attention weighs what it has read.
The score of a text is that of its worst window, over all overlapping windows of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salvage.llm.common import documents, fold, one_array, pieces, string_hashes
from salvage.llm.learning import label_share, labelled_sample

WINDOW, STRIDE = 32, 16
THRESHOLD = 0.5
# The sample that is learnt from: documents, and characters of the longest of them.
MOST_LABELLED, LONGEST_LABELLED = 4_000, 8_000

WORDS, GRAMS = 1 << 13, 1 << 15
WIDTH, HIDDEN, ATTENTION = 16, 12, 12
EPOCHS, BATCH, RATE = 14, 64, 0.01
_BATCH_WINDOWS = 256


class Vocabulary:
    """The different words of some texts: hashed word, hashed character n-grams (3 and 4 bytes, ends marked)."""

    def __init__(self, words: pa.Array) -> None:
        marked = pc.binary_join_element_wise(pa.scalar("^"), words, pa.scalar("$"), "").cast(pa.large_string())
        n = len(marked)
        offsets = np.frombuffer(marked.buffers()[1], np.int64, n + 1, 8 * marked.offset) if n else np.zeros(1, np.int64)
        raw = np.frombuffer(marked.buffers()[2] or b"", np.uint8).astype(np.uint64)
        sizes = np.diff(offsets)
        starts = offsets[:-1]
        self.words = string_hashes(words) >> np.uint64(64 - WORDS.bit_length() + 1)
        grams, counts = [], np.zeros(n, np.int64)
        for width in (3, 4):
            count = np.maximum(0, sizes - width + 1)
            begin = np.repeat(starts - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum())
            code = sum(raw[begin + i] << np.uint64(8 * i) for i in range(width)) + np.uint64(width)
            grams.append(((code * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - GRAMS.bit_length() + 1), count))
            counts += count
        owner = np.concatenate([np.repeat(np.arange(n), c) for _, c in grams])
        order = np.argsort(owner, kind="stable")
        self.grams = np.concatenate([g for g, _ in grams])[order].astype(np.int64)
        self.words = self.words.astype(np.int64)
        self.gram_counts = counts
        self.gram_starts = np.cumsum(counts) - counts

    def vectors(self, words: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """The input of every word."""
        out = words[self.words]
        for at in range(0, len(out), 1 << 14):
            some = slice(at, at + (1 << 14))
            counts = self.gram_counts[some]
            first = self.gram_starts[some][0]
            own = grams[self.grams[first : first + counts.sum()]]
            # Every marked word but the empty one has a gram.
            full = np.flatnonzero(counts)
            if len(full):
                sums = np.add.reduceat(own, (self.gram_starts[some] - first)[full], axis=0)
                out[at + full] += sums / counts[full, None].astype(np.float32)
        return out


def read_words(texts: pa.Array) -> tuple[Vocabulary, np.ndarray, np.ndarray]:
    """The vocabulary of the texts, the code of each word in order, and how many words each text has."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    owner = np.repeat(np.arange(len(texts)), np.diff(np.asarray(split.offsets)))
    flat = split.flatten()
    full = pc.not_equal(flat, "")
    coded = flat.filter(full).dictionary_encode()
    counts = np.bincount(owner[full.to_numpy(zero_copy_only=False)], minlength=len(texts))
    bare = pc.utf8_trim(coded.dictionary, ".,;:!?\"'()[]{}*#$%&|")
    return Vocabulary(bare), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), counts


def windows(counts: np.ndarray, window: int = WINDOW, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first word and length of all windows: one every ``stride`` words until the text is covered."""
    number = np.where(counts > window, -(-(counts - window) // stride) + 1, (counts > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(counts)), number)
    inside = (np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)) * stride
    first = np.repeat(np.cumsum(counts) - counts, number) + inside
    return doc, first, np.minimum(window, counts[doc] - inside)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _sums(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """The sum of the rows at each of ``n`` places."""
    width = rows.shape[1]
    flat = (at[:, None] * width + np.arange(width)).ravel()
    return np.bincount(flat, rows.ravel(), n * width).reshape(n, width).astype(np.float32)


class Network:
    """Parameters, scores and gradients. Arrays are by step, then by window; both directions are read at once, the second
    of them from the last step to the first."""

    def __init__(self, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[-2:][0])).astype(np.float32)
        h = HIDDEN
        self.p = {
            "words": np.zeros((WORDS, WIDTH), np.float32), "grams": draw(GRAMS, WIDTH) * 20,
            "in": draw(2, WIDTH, 3 * h), "c": np.zeros((2, 1, 3 * h), np.float32),
            "u": draw(2, h, 3 * h), "q": np.zeros((2, 1, h), np.float32),
            "att": draw(2 * h, ATTENTION), "att_c": np.zeros(ATTENTION, np.float32), "att_v": draw(ATTENTION),
            "out": draw(2 * h), "bias": np.zeros(1, np.float32),
        }

    def _read(self, inputs: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        """The states by step, direction and window; ``inputs`` are already projected."""
        h, u, q = HIDDEN, self.p["u"], self.p["q"]
        steps, _, n, _ = inputs.shape
        states, state = np.empty((steps, 2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        for t in range(steps):
            moved = state @ u
            gates = _sigmoid(inputs[t, :, :, : 2 * h] + moved[:, :, : 2 * h])
            z, r, inner = gates[:, :, :h], gates[:, :, h:], moved[:, :, 2 * h :] + q
            new = np.tanh(inputs[t, :, :, 2 * h :] + r * inner)
            if keep is not None:
                keep.append((state, z, r, inner, new))
            state = state + mask[t] * ((1 - z) * (new - state))
            states[t] = state
        return states

    def project(self, vectors: np.ndarray) -> np.ndarray:
        """What the gates of either direction get from each word."""
        return vectors @ self.p["in"] + self.p["c"]

    def forward(self, projected: np.ndarray, at: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows; ``at`` (places of words) and ``mask`` are steps x windows."""
        p = self.p
        inputs = np.stack((projected[0][at], projected[1][at[::-1]]), axis=1)
        both = np.stack((mask, mask[::-1]), axis=1)[:, :, :, None]
        read = self._read(inputs, both, None if keep is None else keep.setdefault("steps", []))
        states = np.concatenate((read[:, 0], read[::-1, 1]), axis=2)
        seen = np.tanh(states @ p["att"] + p["att_c"])
        energy = np.where(mask > 0, seen @ p["att_v"], np.float32(-1e9))
        weight = np.exp(energy - energy.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", weight, states)
        if keep is not None:
            keep.update(at=at, both=both, states=states, seen=seen, weight=weight, pooled=pooled)
        return pooled @ p["out"] + p["bias"][0]

    def backward(self, keep: dict, slope: np.ndarray, vocabulary: Vocabulary, vectors: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of all parameters; ``slope`` is that of the loss by each logit."""
        p, h, g = self.p, HIDDEN, {}
        states, seen, weight, both, at = (keep[k] for k in ("states", "seen", "weight", "both", "at"))
        g["out"], g["bias"] = keep["pooled"].T @ slope, slope.sum(keepdims=True)
        d_pooled = slope[:, None] * p["out"]
        d_weight = np.einsum("tnh,nh->tn", states, d_pooled)
        d_energy = weight * (d_weight - (weight * d_weight).sum(axis=0))
        d_states = weight[:, :, None] * d_pooled
        g["att_v"] = np.tensordot(d_energy, seen, ((0, 1), (0, 1)))
        d_seen = d_energy[:, :, None] * p["att_v"] * (1 - seen**2)
        g["att"], g["att_c"] = np.tensordot(states, d_seen, ((0, 1), (0, 1))), d_seen.sum(axis=(0, 1))
        d_states = d_states + d_seen @ p["att"].T
        own = np.stack((d_states[:, :, :h], d_states[::-1, :, h:]), axis=1)
        back = p["u"].transpose(0, 2, 1)
        d_u, d_q, d_in = np.zeros_like(p["u"]), np.zeros_like(p["q"]), np.empty((*both.shape[:3], 3 * h), np.float32)
        d_state = np.zeros_like(own[0])
        for t in range(len(at) - 1, -1, -1):
            before, z, r, inner, new = keep["steps"][t]
            d_state = d_state + own[t]
            d_step = d_state * both[t]
            d_z, d_new = d_step * (before - new), d_step * (1 - z)
            d_inside = d_new * (1 - new**2)
            d_inner = d_inside * r
            d_gates = np.concatenate((d_z * z * (1 - z), d_inner * inner * (1 - r)), axis=2)
            d_moved = np.concatenate((d_gates, d_inner), axis=2)
            d_in[t] = np.concatenate((d_gates, d_inside), axis=2)
            d_u += before.transpose(0, 2, 1) @ d_moved
            d_q += d_inner.sum(axis=1, keepdims=True)
            d_state = d_state - d_step * (1 - z) + d_moved @ back
        by_word = np.stack((d_in[:, 0].reshape(-1, 3 * h), d_in[::-1, 1].reshape(-1, 3 * h)))
        place = at.reshape(-1)
        g["u"], g["q"], g["c"] = d_u, d_q, by_word.sum(axis=1, keepdims=True)
        g["in"] = vectors[place].T @ by_word
        d_vectors = _sums(place, (by_word @ p["in"].transpose(0, 2, 1)).sum(axis=0), len(vectors))
        g["words"] = _sums(vocabulary.words, d_vectors, WORDS)
        share = d_vectors / np.maximum(1, vocabulary.gram_counts)[:, None].astype(np.float32)
        g["grams"] = _sums(vocabulary.grams, np.repeat(share, vocabulary.gram_counts, axis=0), GRAMS)
        return g

    def logits(self, vectors: np.ndarray, codes: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Logits of any number of windows of words, some thousands at a time."""
        out, projected = np.empty(len(first), np.float32), self.project(vectors)
        for a in range(0, len(first), _BATCH_WINDOWS):
            at, mask = _grid(codes, first[a : a + _BATCH_WINDOWS], length[a : a + _BATCH_WINDOWS])
            out[a : a + _BATCH_WINDOWS] = self.forward(projected, at, mask)
        return out

    def logit_of_texts(self, texts: pa.Array) -> np.ndarray:
        """The logit of every text: its worst window. A text without words has the logit of nothing read."""
        vocabulary, codes, counts = read_words(texts)
        worst = np.full(len(texts), self.p["bias"][0] if len(texts) else 0, np.float64)
        doc, first, length = windows(counts)
        if len(doc):
            vectors = vocabulary.vectors(self.p["words"], self.p["grams"])
            logit = self.logits(vectors, codes, first, length)
            begin = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
            worst[doc[begin]] = np.maximum.reduceat(logit, begin)
        return worst

    def scores(self, texts: pa.Array) -> np.ndarray:
        return _sigmoid(self.logit_of_texts(texts))


def _grid(codes: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    step = np.arange(max(1, int(length.max())))[:, None]
    mask = step < length
    return codes[np.where(mask, first + step, first)], mask.astype(np.float32)


def train(texts: pa.Array, labels: np.ndarray, share: float = 0.5, epochs: int = EPOCHS, seed: int = 0) -> Network:
    """Learns from labels of whole texts: in the first epochs every window of a sample has the label of its text,
    then only the worst window of each text counts, chosen anew every other epoch. Both labels weigh the same.

    A fifth of the texts is only used to set the middle of the scores: where fewest of them are on the wrong side
    if ``share`` of all texts are toxic.
    """
    network = Network(seed)
    if not len(labels):
        network.p["bias"][0] = -3.0
        return network
    if labels.min() == labels.max():
        network.p["out"][:] = 0
        network.p["bias"][0] = 3.0 if labels[0] else -3.0
        return network
    rng = np.random.default_rng(seed)
    aside = np.arange(len(labels)) % 5 == 4
    aside &= len(np.unique(labels[aside])) == 2 == len(np.unique(labels[~aside]))
    kept_texts, kept_labels = texts.filter(pa.array(aside)), labels[aside]
    texts, labels = texts.filter(pa.array(~aside)), labels[~aside]
    vocabulary, codes, counts = read_words(texts)
    doc, first, length = windows(counts)
    truth = labels[doc].astype(np.float32)
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean())).astype(np.float32)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in network.p.items()}
    turn = 0
    for epoch in range(epochs):
        if epoch < 4:
            chosen = rng.permutation(len(doc))[: 6 * len(labels)]
        else:
            if epoch % 2 == 0:
                logit = network.logits(vocabulary.vectors(network.p["words"], network.p["grams"]), codes, first, length)
                order = np.lexsort((-logit, doc))
                worst = order[np.flatnonzero(np.append(True, doc[order][1:] != doc[order][:-1]))]
            chosen = rng.permutation(worst)
        # Small samples are cut into as many steps as large ones.
        size = max(8, min(BATCH * 4 if epoch < 4 else BATCH, len(chosen) // 60))
        for a in range(0, len(chosen), size):
            some = chosen[a : a + size]
            at, mask = _grid(codes, first[some], length[some])
            used, at = np.unique(at, return_inverse=True)
            own = _subset(vocabulary, used)
            keep: dict = {}
            inputs = own.vectors(network.p["words"], network.p["grams"])
            logit = network.forward(network.project(inputs), at.reshape(mask.shape), mask, keep)
            slope = (weight[doc[some]] * (_sigmoid(logit) - truth[some]) / len(some)).astype(np.float32)
            turn += 1
            rate = RATE * (1 - 0.9 * epoch / epochs)
            for k, g in network.backward(keep, slope, own, inputs).items():
                m, v = moments[k]
                m *= 0.9
                m += 0.1 * g
                v *= 0.99
                v += 0.01 * g * g
                network.p[k] -= rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-6)
    if len(kept_labels):
        network.p["bias"] -= _middle(network.logit_of_texts(kept_texts), kept_labels, share)
    return network


def _middle(logit: np.ndarray, labels: np.ndarray, share: float) -> np.float32:
    """The middle of the widest gap between logits where fewest labels are on the wrong side."""
    order = np.argsort(logit, kind="stable")
    logit, labels = logit[order], labels[order]
    missed = np.append(0, np.cumsum(labels)) * share / labels.sum()
    false = np.append(0, np.cumsum(1 - labels)) / (1 - labels).sum()
    wrong = missed + (1 - false) * (1 - share)
    edges = np.concatenate(([logit[0] - 2], logit, [logit[-1] + 2]))
    gaps = np.where(wrong <= wrong.min() + 1e-12, np.diff(edges), -1)
    best = int(np.argmax(gaps))
    return np.float32((edges[best] + edges[best + 1]) / 2)


def _subset(vocabulary: Vocabulary, used: np.ndarray) -> Vocabulary:
    own = object.__new__(Vocabulary)
    own.words, own.gram_counts = vocabulary.words[used], vocabulary.gram_counts[used]
    own.gram_starts = np.cumsum(own.gram_counts) - own.gram_counts
    at = np.repeat(vocabulary.gram_starts[used] - own.gram_starts, own.gram_counts) + np.arange(own.gram_counts.sum())
    own.grams = vocabulary.grams[at]
    return own


def fitted(
    docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, longest: int = LONGEST_LABELLED, label: str = "toxic"
) -> Network:
    """The network of a bounded sample: at most ``most`` texts of at most ``longest`` characters come to the driver."""
    sample = labelled_sample(docs, labels, label, most, longest).select("doc_id", "text", "label").toArrow().sort_by("doc_id")
    return train(one_array(sample.column("text")) if sample.num_rows else pa.array([], pa.string()), sample.column("label").to_numpy(), label_share(labels, label))


def scored(docs: DataFrame, network: Network, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document, from all windows of its whole text.

    A null text is scored as empty; repeated rows and null ids come back as they came (a null id counts as empty text in the
    checksum); no rows, no rows; other columns are ignored.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in pieces(batches, 4 << 20):
            score = network.scores(one_array(table.column("text")))
            yield pa.RecordBatch.from_arrays([one_array(table.column("doc_id")), pa.array(score)], names=["doc_id", "score"])

    return (
        documents(docs).mapInArrow(work, "doc_id long, score double")
        .select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
    )


def accepted(docs: DataFrame, network: Network, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not toxic, columns as they came; rows without an id stay."""
    gone = scored(docs, network, threshold).where("predicted = 1").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
