"""Language-model scores by prediction by partial matching over bytes, and a unigram base.

The model is a trie of byte contexts with the counts of what followed them in the training texts, pretrained and
shared by all documents. A byte is predicted in its longest context; if it never followed there, the model escapes to the
context one byte shorter, where the bytes already ruled out are excluded. Escapes are estimated from the number of
different bytes seen in a context (method D: a byte seen n times among T, with d different ones, gets (2n - 1) / 2T,
the escape d / 2T). Below the empty context all remaining bytes are equally likely. The end of a text is the byte 0xFF,
which UTF-8 never uses; the same byte fills the context before a text begins.

Documents lie in buckets of some MiB. A bucket sends its different contexts and words to be counted, gets back their
probabilities and counts, and scores its documents with them: so the statistics cover all training documents, no table
of the corpus is ever held in one place, and what is moved is small beside the texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salvage.llm.common import documents, fold, one_array, pieces, string_hashes, written

# Bytes of context; at most 6, so that a context and what follows it fit a long.
ORDER = 5
BUCKET_BYTES = 16 << 20
# Bytes of a bucket that are turned into numbers at once, each of them into some numbers of eight bytes.
_AT_ONCE = 2 << 20
# Groups of grams that are worked out together, for each shard.
PARTS = 16
_END = 0xFF


def grams(texts: pa.Array, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Every byte of every text and its end, each as one number with its context, and how many each text has."""
    n = len(texts)
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, 8 * texts.offset) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    sizes = np.diff(offsets)
    starts = np.arange(n) * (order + 1) + (offsets[:-1] - offsets[0]) + order
    # Masks, as places would take eight times as much as the text.
    between = (starts + sizes)[:, None] + np.arange(order + 1)
    padded = np.full(len(raw) + n * (order + 1), _END, np.uint8)
    mask = np.ones(len(padded) + order, bool)
    mask[:order] = False
    mask[between] = False
    padded[mask[: len(padded)]] = raw
    codes = np.zeros(max(0, len(padded) - order), np.int64)
    for at in range(order + 1):
        np.left_shift(codes, 8, out=codes)
        np.bitwise_or(codes, padded[at : at + len(codes)], out=codes)
    mask = np.ones(len(codes) + order, bool)
    mask[between[:, 1:] - order] = False
    return codes[mask[: len(codes)]], sizes + 1


def gram_log10(
    codes: np.ndarray, counts: np.ndarray, thirds: np.ndarray, third_n: np.ndarray,
    pairs: np.ndarray, singles: np.ndarray, order: int = ORDER,
) -> np.ndarray:
    """log10 of the probability of each gram, for all different grams whose contexts end in some triples of bytes.

    ``counts`` are those of training; grams only met elsewhere have 0. ``thirds`` are the last three bytes, in order, of all grams
    of the corpus whose contexts end in the same two bytes as one of these, ``third_n`` their counts; ``pairs`` (256 x 256) and
    ``singles`` (256) count the last two bytes and the last byte of all training grams.
    """
    byte, before = codes & 0xFF, codes >> 8 & 0xFF
    result = np.zeros(len(codes))
    open_ = np.ones(len(codes), bool)
    # Of the longer context, per gram: different bytes seen, and their counts in the shorter context.
    ruled_d, ruled_t = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
    keys, key_n, key_of = codes, counts, np.arange(len(codes))
    if order == 2:
        keys, key_n, key_of = thirds, third_n, np.searchsorted(thirds, codes)
    for k in range(order, -1, -1):
        if k >= 2:
            contexts, context_of = np.unique(keys >> 8, return_inverse=True)
            total = np.bincount(context_of, key_n, len(contexts)).astype(np.int64)
            kinds = np.bincount(context_of, key_n > 0, len(contexts)).astype(np.int64)
            n, t, d = key_n[key_of], total[context_of][key_of], kinds[context_of][key_of]
        elif k == 1:
            n, t, d = pairs[before, byte], pairs.sum(axis=1)[before], (pairs > 0).sum(axis=1)[before]
        else:
            n, t, d = singles[byte], np.full(len(codes), singles.sum()), np.full(len(codes), (singles > 0).sum())
        left_t, left_d = t - ruled_t, d - ruled_d
        seen = open_ & (n > 0)
        result[seen] += np.log10((2 * n[seen] - 1) / (2 * left_t[seen]))
        open_ &= n == 0
        escapes = open_ & (left_d > 0)
        result[escapes] += np.log10(left_d[escapes] / (2 * left_t[escapes]))
        if k > 2:
            ends = keys & ((1 << (8 * k)) - 1)
            if k == 3:
                shorter, shorter_of, shorter_n = thirds, np.searchsorted(thirds, ends), third_n
            else:
                shorter, shorter_of = np.unique(ends, return_inverse=True)
                shorter_n = np.bincount(shorter_of, key_n, len(shorter)).astype(np.int64)
            ruled = np.bincount(context_of, shorter_n[shorter_of] * (key_n > 0), len(contexts)).astype(np.int64)
            ruled_t, ruled_d = ruled[context_of][key_of], d
            keys, key_n, key_of = shorter, shorter_n, shorter_of[key_of]
        elif k == 2:
            ruled = np.bincount(context_of, pairs[keys >> 8 & 0xFF, keys & 0xFF] * (key_n > 0), len(contexts)).astype(np.int64)
            ruled_t, ruled_d = ruled[context_of][key_of], d
        elif k == 1:
            ruled_t, ruled_d = ((pairs > 0) * singles).sum(axis=1)[before], d
    result[open_] -= np.log10(np.maximum(1, 256 - (singles > 0).sum()))
    return result


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of the texts, one after another, and the text of each."""
    split = pc.ascii_split_whitespace(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(np.asarray(split.offsets)))
    flat = split.flatten()
    full = pc.not_equal(flat, "")
    return flat.filter(full), owner[full.to_numpy(zero_copy_only=False)]


def _shape(values: np.ndarray) -> bytes:
    """Whole numbers as bytes, all first bytes first, so that sorted or small ones compress well."""
    return values.astype(np.int64).view(np.uint8).reshape(len(values), 8).T.tobytes()


def _numbers(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(8, len(raw) // 8).T.copy().view(np.int64).reshape(-1)


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, with the sums of their counts."""
    all_keys, all_counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(all_keys, kind="stable")
    all_keys = all_keys[order]
    first = np.flatnonzero(np.append(True, all_keys[1:] != all_keys[:-1])) if len(order) else np.zeros(0, np.int64)
    return all_keys[first], np.add.reduceat(all_counts[order], first) if len(first) else all_counts


def _summed_words(words: pa.Array, counts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Different words with the sums of their counts."""
    coded = words.dictionary_encode()
    at = coded.indices.to_numpy(zero_copy_only=False)
    return coded.dictionary, np.bincount(at, counts, len(coded.dictionary)).astype(np.int64)


def _train_counts(table: pa.Table, order: int) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """The different grams and words of some documents, each with its count in training documents."""
    text, learnt = one_array(table.column("text")), one_array(table.column("held_out")).to_numpy(zero_copy_only=False) == 0
    codes, sizes = grams(text, order)
    keys = np.left_shift(codes, 1, out=codes)
    keys |= np.repeat(learnt, sizes)
    keys.sort()
    first = np.flatnonzero(np.append(True, keys[1:] >> 1 != keys[:-1] >> 1))
    words, owner = _words(text)
    words = pa.concat_arrays([words, pa.array([""] * len(text), words.type)])
    different, times = _summed_words(words, np.append(learnt[owner], learnt).astype(np.int64))
    return keys[first] >> 1, np.add.reduceat(keys & 1, first), different, times


def _bucket_counts(table: pa.Table, order: int) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """The same of a whole bucket, whose grams are added up part by part, so that only one part is there as numbers."""
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    words, times = [], []
    for part in pieces(table.to_batches(), _AT_ONCE):
        more, more_n, said, said_n = _train_counts(part, order)
        keys, counts = _merged([keys, more], [counts, more_n])
        words.append(said)
        times.append(said_n)
    return keys, counts, *_summed_words(pa.concat_arrays(words), np.concatenate(times))


def _parted(shard: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in order of their shard, and where each shard begins and the last one ends."""
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


_PACK = "bucket long, shard int, grams binary, gram_n binary, words array<string>, word_n array<long>"
_COUNTS = "gram long, c long, tokens long, kinds long"
_VALUES = "bucket long, grams binary, gram_value binary, words array<string>, word_n array<long>"
_SCORES = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


def _buckets(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[tuple[int, pa.Table]]:
    """The buckets of an input partition, numbered by the partition and their place in it; texts in lower case."""
    from pyspark import TaskContext

    first = TaskContext.get().partitionId() << 32
    for i, table in enumerate(pieces(batches, size)):
        # Neither the texts as they came nor what the bucket before has left stays beside them.
        table = table.set_column(table.schema.get_field_index("text"), "text", pc.ascii_lower(one_array(table.column("text"))))
        pa.default_memory_pool().release_unused()
        yield first + i, table


def scores(docs: DataFrame, order: int = ORDER, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Held out are documents whose checksum has the remainder 1; the model and the base learn from all others. ``score`` is
    log10 of the model's probability of the whole text in lower case (A-Z) and its end, a sum of logarithms that are each cut to
    single precision (relative error below 1e-6). The base adds log10((c + 0.5) /
    (N + 0.5 (V + 1))) over the words and the end of the text.

    Null texts count as empty, null ids as empty text in the checksum; repeated rows are counted, and come back, as often as
    they come. Without any training document every byte is as likely as any. No rows, no result; other columns are
    ignored. ``docs`` is read twice and must come in the same partitions both times, as a table does; a bucket that
    meets a context or word it did not ask about fails its task.
    """
    if not 2 <= order <= 6:
        raise ValueError("contexts have 2 to 6 bytes")
    source = documents(docs).withColumn("held_out", fold(F.col("doc_id")) == 1)
    # What a bucket asks about is dealt over shards, of which there are more for more input.
    shards = max(4, source.rdd.getNumPartitions())

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, table in _buckets(batches, bucket_bytes):
            keys, counts, words, times = _bucket_counts(table, order)
            by_key, key_edges = _parted(_mixed(keys) % np.uint64(shards), shards)
            by_word, word_edges = _parted(string_hashes(words) % np.uint64(shards), shards)
            for s in range(shards):
                k = by_key[key_edges[s] : key_edges[s + 1]]
                w = by_word[word_edges[s] : word_edges[s + 1]]
                yield pa.RecordBatch.from_pydict(
                    {
                        "bucket": pa.array([bucket], pa.int64()),
                        "shard": pa.array([s], pa.int32()),
                        "grams": pa.array([_shape(keys[k])], pa.binary()),
                        "gram_n": pa.array([_shape(counts[k])], pa.binary()),
                        "words": pa.ListArray.from_arrays([0, len(w)], words.take(pa.array(w)).cast(pa.string())),
                        "word_n": pa.ListArray.from_arrays([0, len(w)], pa.array(times[w])),
                    }
                )

    asked = written(source.mapInArrow(ask, _PACK), "asked")

    def count(table: pa.Table) -> pa.Table:
        keys, counts = _merged(*([_numbers(x) for x in table.column(c).to_pylist()] for c in ("grams", "gram_n")))
        _, times = _words_of(table)
        nothing = np.zeros(len(keys), np.int64)
        return pa.table(
            {
                "gram": np.append(keys, -1), "c": np.append(counts, 0),
                "tokens": np.append(nothing, times.sum()), "kinds": np.append(nothing, (times > 0).sum()),
            }
        )

    counted = written(asked.groupBy("shard").applyInArrow(count, _COUNTS), "counted")
    n, v = counted.agg(F.sum("tokens"), F.sum("kinds")).first()
    n, v = n or 0, v or 0
    counted = counted.where("gram >= 0").select("gram", "c")

    # 2^24 triples and 65,536 pairs of bytes at most.
    thirds = written(counted.groupBy(F.col("gram").bitwiseAND(F.lit(0xFFFFFF)).alias("third")).agg(F.sum("c").alias("c")), "thirds")
    pairs = np.zeros((256, 256), np.int64)
    two = thirds.groupBy(F.col("third").bitwiseAND(F.lit(0xFFFF)).alias("two")).agg(F.sum("c").alias("c")).toArrow()
    pairs.reshape(-1)[two.column("two").to_numpy()] = two.column("c").to_numpy()
    singles = pairs.sum(axis=0)

    def likely(table: pa.Table, lower: pa.Table) -> pa.Table:
        table, lower = table.sort_by("gram"), lower.sort_by("third")
        codes = table.column("gram").to_numpy()
        third, third_n = lower.column("third").to_numpy(), lower.column("c").to_numpy()
        value = gram_log10(codes, table.column("c").to_numpy(), third, third_n, pairs, singles, order)
        return pa.table({"gram": codes, "value": value, "shard": (_mixed(codes) % np.uint64(shards)).astype(np.int32)})

    # Grams whose contexts end in the same three bytes are worked out together, with the counts of the shorter contexts beside
    # them: at most 2^24 different grams for an ending at order 5, and as many parts as the input asks for.
    ending = F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFFFF))
    parted = counted.select("gram", "c", F.pmod(F.xxhash64(ending), F.lit(PARTS * shards)).alias("part"))
    needed = parted.select("part", F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFF)).alias("two")).distinct()
    lower = needed.join(thirds.withColumn("two", F.shiftright("third", 8)), "two").select("part", "third", "c")
    lower = written(lower, "lower")
    values = parted.groupBy("part").cogroup(lower.groupBy("part")).applyInArrow(
        lambda table, lower: likely(table.select(["gram", "c"]), lower.select(["third", "c"])), "gram long, value double, shard int"
    )

    def answer(packs: pa.Table, known: pa.Table) -> pa.Table:
        keys = [_numbers(x) for x in packs.column("grams").to_pylist()]
        order_ = np.argsort(codes := known.column("gram").to_numpy(), kind="stable")
        codes, value = codes[order_], known.column("value").to_numpy()[order_].astype(np.float32)
        words, times = _words_of(packs)
        spread = packs.column("words").combine_chunks()
        total = pa.array(times[pc.index_in(spread.flatten(), value_set=words).to_numpy(zero_copy_only=False)])
        return pa.table(
            {
                "bucket": packs.column("bucket"),
                "grams": packs.column("grams"),
                "gram_value": pa.array([value[np.searchsorted(codes, k)].tobytes() for k in keys], pa.binary()),
                "words": spread,
                "word_n": pa.ListArray.from_arrays(
                    pa.array(np.asarray(spread.offsets) - spread.offsets[0].as_py(), pa.int32()), total
                ),
            }
        )

    answered = asked.groupBy("shard").cogroup(values.groupBy("shard")).applyInArrow(answer, _VALUES)

    def carry(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, table in _buckets(batches, bucket_bytes):
            table = table.append_column("bucket", pa.array(np.full(table.num_rows, bucket)))
            yield from table.select(["doc_id", "text", "held_out", "bucket"]).to_batches()

    texts = source.mapInArrow(carry, "doc_id long, text string, held_out boolean, bucket long")

    def score(table: pa.Table, known: pa.Table) -> pa.Table:
        codes = pa.array(np.concatenate([_numbers(x) for x in known.column("grams").to_pylist()] or [np.zeros(0, np.int64)]))
        value = np.frombuffer(b"".join(known.column("gram_value").to_pylist()), np.float32)
        words = known.column("words").combine_chunks().flatten()
        word_n = known.column("word_n").combine_chunks().flatten().to_numpy()
        parts = [_scored(part, order, codes, value, words, word_n, n, v) for part in pieces(table.to_batches(), _AT_ONCE)]
        pa.default_memory_pool().release_unused()
        return pa.concat_tables(parts)

    return texts.groupBy("bucket").cogroup(answered.groupBy("bucket")).applyInArrow(score, _SCORES)


def _mixed(codes: np.ndarray) -> np.ndarray:
    return (codes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(20)


def _words_of(packs: pa.Table) -> tuple[pa.Array, np.ndarray]:
    """The different words of packs with the sums of their counts."""
    return _summed_words(
        packs.column("words").combine_chunks().flatten(), packs.column("word_n").combine_chunks().flatten().to_numpy()
    )


def _places(wanted: pa.Array, known: pa.Array) -> np.ndarray:
    at = pc.index_in(wanted, value_set=known)
    if at.null_count:
        raise ValueError("a bucket has changed between two reads of the documents")
    return at.to_numpy()


def _scored(
    table: pa.Table, order: int, codes: pa.Array, value: np.ndarray, words: pa.Array, word_n: np.ndarray, n: int, v: int
) -> pa.Table:
    text = one_array(table.column("text"))
    size = len(text)
    own, sizes = grams(text, order)
    model = np.bincount(np.repeat(np.arange(size), sizes), value[_places(pa.array(own), codes)], size)
    said, owner = _words(text)
    said = pa.concat_arrays([said, pa.array([""] * size, said.type)]).cast(pa.string())
    owner = np.append(owner, np.arange(size))
    count = word_n[_places(said, words)]
    return pa.table(
        {
            "doc_id": table.column("doc_id"),
            "held_out": table.column("held_out"),
            "n_tokens": np.bincount(owner, minlength=size),
            "n_known": np.bincount(owner, count > 0, size).astype(np.int64),
            "train_tokens": np.full(size, n, np.int64),
            "base_score": np.bincount(owner, np.log10((count + 0.5) / (n + 0.5 * (v + 1))), size),
            "score": model,
        }
    )
