"""The corpus operators against brute force, and on odd tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash

from salvage.llm import (
    exact, language, neighbours, packing, quality, rans, sentencepieces, shards, simhash, token_files, toxicity,
)
from salvage.llm.components import components

SPACES = r"[\x20\x09-\x0D]"
SCHEMA = "doc_id long, text string, lang string, shard int, score double, bits long, bucket long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns that clash with the operators' own."""
    texts = [
        "one two three four five", "one  two three four\tfive", "One two three four five", None, "", " \n ", "a",
        "word " * 30_000, "word " * 30_000, "日本語 の テキスト 😀", "it's 'odd'  spaces \n x", "<|endoftext|> <s>", "\x00 null byte",
        "one two three four five six seven eight nine ten eleven twelve", "one two three four five six seven eight nine ten eleven twelve!",
    ]
    rows = [(i, t, None, 7, None, i, None) for i, t in enumerate(texts)] + [(None, "without id", None, 1, 0.5, 1, 1)] * 2
    rows += [(5, " \n ", None, 7, None, 5, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def real(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def texts_of(df):
    return {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}


def roots(nodes, linked):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_exact_groups(real, odd):
    for docs in (real, odd.where("doc_id is not null").distinct()):
        groups = defaultdict(list)
        for i, text in texts_of(docs).items():
            groups[re.sub(SPACES, "", text)].append((-len(text), i))
        found = {r.doc_id: r for r in exact.exact_groups(docs).collect()}
        digests = {r.doc_id: r.text_sha256 for r in exact.text_digests(docs).collect()}
        for text, members in groups.items():
            for _, i in members:
                assert (found[i].keep_id, found[i].group_size) == (min(members)[1], len(members))
                assert found[i].kept == (i == min(members)[1])
                assert digests[i] == hashlib.sha256(text.encode()).hexdigest()
    assert exact.exact_groups(odd).count() == odd.count()
    assert {r.doc_id for r in exact.without_copies(odd).collect()} >= {None, 1, 9}


def test_simhash(real, odd):
    def expected(text):
        words = [w for w in re.split(f"{SPACES}+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
        shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum((sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) << b for b in range(64))

    for docs in (real.limit(80), odd.where("doc_id is not null").distinct()):
        texts = texts_of(docs)
        marks = {i: expected(t) for i, t in texts.items()}
        linked = [(a, b) for a in marks for b in marks if a < b and (marks[a] ^ marks[b]).bit_count() <= 4]
        parent = roots(marks, linked)
        found = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
        assert {i: int(r.fingerprint, 16) for i, r in found.items()} == marks
        assert {i: r.component_id for i, r in found.items()} == parent
        stay = {r.doc_id for r in simhash.one_of_each(docs).collect()}
        assert stay == set(parent.values())


@pytest.mark.parametrize("longest", [2, 8, 128])
def test_dense_postings_link_the_same(spark, longest):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2**63, dtype=np.int64)
    bits = {int(centre)}
    while len(bits) < 60:
        flips = rng.choice(63, rng.integers(1, 9), replace=False)
        bits.add(int(centre ^ np.bitwise_or.reduce(np.int64(1) << flips.astype(np.int64))))
    bits |= {int(x) for x in rng.integers(-(2**63), 2**63 - 1, 40)}
    linked = [(a, b) for a in bits for b in bits if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4]
    found = simhash.links(spark.createDataFrame([(b,) for b in bits], "bits long"), longest)
    mine = [(r.a, r.b) for r in found.collect()]
    assert set(mine) <= set(linked) if longest == 128 else True
    assert roots(bits, mine) == roots(bits, linked)


def test_components_of_chains_and_stars(spark):
    linked = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 40)] + [(300, 301), (301, 300)]
    found = {r.node: r.root for r in components(spark.createDataFrame(linked, "a long, b long")).collect()}
    assert found == roots({n for pair in linked for n in pair}, linked)


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def test_shards(real, odd):
    for docs in (real, odd):
        rows = shards.sharded(docs).collect()
        texts = texts_of(docs)
        assert len(rows) == docs.count()
        slots = defaultdict(list)
        for r in rows:
            slots[r.shard].append(r.slot)
            assert (r.shard, r.grown_shard) == (jump(r.doc_id or 0, 16), jump(r.doc_id or 0, 17))
            assert r.grown_shard in (r.shard, 16)
            raw = texts[r.doc_id].encode()
            assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("n", [0, 1, 63, 5000, 200_000])
def test_rans_round_trip(n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 50_257).astype("<u4")
    section = rans.encode(ids)
    assert (rans.decode(section) == ids).all()
    if n == 200_000:
        parsed = rans.parse(section)
        step = parsed.length * parsed.lanes
        assert (rans.decode(parsed, slice(3, 5)) == ids[3 * step : 5 * step]).all()
        entropy = -sum(c / n * math.log2(c / n) for c in Counter(ids.tolist()).values())
        assert len(section) * 8 < n * entropy * 1.1 + 64 * len(set(ids.tolist()))
    if n:
        with pytest.raises(ValueError):
            rans.decode(section[:-3] + bytes(3) if section[-3:] != bytes(3) else section[:-3] + b"abc")


def test_token_files(spark, real, odd, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    for name, docs in (("real", real), ("odd", odd)):
        token_files.write_token_files(docs, str(tmp_path / name), path)
        rows = token_files.read_token_files(spark, str(tmp_path / name)).collect()
        rows.sort(key=lambda r: r.start)
        texts, start = texts_of(docs), 0
        assert len(rows) == docs.count()
        ids_of = [r.doc_id for r in rows if r.doc_id is not None]
        assert ids_of == sorted(ids_of)
        for r in rows:
            ids = np.array([*tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids, 0], "<u4")
            assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
            start += len(ids)
    back = token_files.decode_tokens(spark, str(tmp_path / "odd")).where("doc_id = 0").first()
    assert tokenizer.decode(back.ids[:-1]) == "one two three four five"


def test_sentencepieces(real, odd):
    path = public_tokenizers.path("piece_bpe_32k.model")
    processor = sentencepieces.piece_encoder(path).processor
    for docs in (real.limit(60), odd):
        texts = texts_of(docs)
        for r in sentencepieces.round_trip_digests(docs, path).collect():
            ids = processor.encode(texts[r.doc_id])
            shown, text = ",".join(map(str, ids)), processor.decode(ids)
            digests = [hashlib.sha256(x.encode()).hexdigest() for x in (shown, text)]
            assert [r.n_tokens, r.ids_sha256, r.decoded_sha256] == [len(ids), *digests]
    ids = sentencepieces.encoded(odd, path)
    assert {r.doc_id: r.text for r in sentencepieces.decoded(ids, path).collect()}[0] == "one two three four five"


def test_packing(real, odd):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    for docs in (real, odd.where("doc_id is not null").distinct()):
        pieces = packing.packed(docs, path).collect()
        by_doc, by_sequence = defaultdict(list), defaultdict(list)
        for p in pieces:
            by_doc[p.doc_id].append(p)
            by_sequence[p.sequence_id].append(p)
        for i, text in texts_of(docs).items():
            ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
            own = sorted(by_doc[i], key=lambda p: p.start)
            assert [p.start for p in own] == np.cumsum([0, *(p.length for p in own)])[:-1].tolist()
            assert sum(p.length for p in own) == len(ids) == own[0].doc_tokens
            assert all(p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in own)
        short = 0
        for own in by_sequence.values():
            own.sort(key=lambda p: p.offset)
            assert [p.offset for p in own] == np.cumsum([0, *(p.length for p in own)])[:-1].tolist()
            short += sum(p.length for p in own) < 2048
        assert short <= docs.rdd.getNumPartitions()


def test_index_scores_are_bm25():
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 30, rng.integers(1, 40)) for _ in range(40)]
    counts = np.array([len(d) for d in docs])
    index = packing.Index(np.concatenate(docs).astype(np.uint32), counts, common=1.0)
    mean = counts.mean()
    df = Counter(t for d in docs for t in set(d.tolist()))
    for seed in (0, 7):
        expected = [
            sum(
                math.log1p((40 - df[t] + 0.5) / (df[t] + 0.5)) * (n := (d == t).sum()) * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(d) / mean))
                for t in set(docs[seed].tolist()) if df[t] > 1
            )
            for d in docs
        ]
        assert np.allclose(index.scores(seed), expected)


def test_neighbours(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.select("vec_id", "embedding").collect()]
    copies = [(10_000 + i, rows[0][1]) for i in range(60)]
    dim = len(rows[0][1])
    bad = [(20_000, None), (20_020, [0.0] * dim), (20_040, [float("nan")] * dim), (20_060, [None] * dim), (20_080, [1.0]), (None, rows[1][1])]
    frame = spark.createDataFrame(rows + copies + bad + rows[:3], "vec_id long, embedding array<float>").selectExpr("*", "'x' AS rank", "1 AS score")
    found = neighbours.nearest(frame, bucket_rows=16)
    by_query = defaultdict(list)
    for r in found.collect():
        by_query[r.query_id].append(r)
    ids = np.array([i for i, _ in rows + copies])
    matrix = np.array([v for _, v in rows + copies], np.float64)
    assert set(by_query) == {i for i in ids.tolist() if i % 20 == 0}
    hits = total = 0
    for q, own in by_query.items():
        own.sort(key=lambda r: r.rank)
        scores = matrix @ matrix[list(ids).index(q)]
        scores[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -scores.round(12)))][:20]
        assert [r.rank for r in own] == list(range(1, 21))
        assert all(abs(r.score - scores[list(ids).index(r.vec_id)]) < 1e-9 for r in own)
        hits += len(set(best) & {r.vec_id for r in own})
        total += 20
    assert hits / total >= 0.9
    deep = neighbours.nearest(frame, depth=2, probes=2000)
    assert deep.count() == len(by_query) * 20
    assert neighbours.nearest(frame.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 15, 25, 45])
def test_small_tables_are_searched_exactly(spark, sf, n):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").limit(n)
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    ids, matrix = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    by_query = defaultdict(list)
    for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), bucket_rows=8).collect():
        by_query[r.query_id].append((r.rank, r.vec_id))
    expected = {}
    for q in ids[ids % 20 == 0].tolist():
        scores = matrix @ matrix[list(ids).index(q)]
        best = [i for i in ids[np.lexsort((ids, -scores.round(12)))].tolist() if i != q]
        if best:
            expected[q] = list(enumerate(best[:20], 1))
    if n < 22:
        assert {q: sorted(own) for q, own in by_query.items()} == expected
    assert {q: len(own) for q, own in by_query.items()} == {q: len(own) for q, own in expected.items()}


def test_language_model_is_prediction_by_partial_matching(spark, real, odd):
    def brute(texts, order):
        lower = {k: re.sub(b"[A-Z]", lambda m: m[0].lower(), (t or "").encode()) for k, t in texts}
        train = [lower[k] for k, _ in texts if zlib.crc32(str(k).encode()) % 5 != 1]
        counts = [defaultdict(Counter) for _ in range(order + 1)]
        words = Counter()
        for t in train:
            line = b"\xff" * order + t + b"\xff"
            for i in range(order, len(line)):
                for k in range(order + 1):
                    counts[k][line[i - k : i]][line[i]] += 1
            words.update([*t.split(), b""])
        n, v = sum(words.values()), len(words)
        for key, _ in texts:
            t, total = lower[key], 0.0
            line = b"\xff" * order + t + b"\xff"
            for i in range(order, len(line)):
                ruled = set()
                for k in range(order, -1, -1):
                    left = {s: c for s, c in counts[k][line[i - k : i]].items() if s not in ruled}
                    if line[i] in left:
                        total += math.log10((2 * left[line[i]] - 1) / (2 * sum(left.values())))
                        break
                    if left:
                        total += math.log10(len(left) / (2 * sum(left.values())))
                        ruled |= left.keys()
                else:
                    total -= math.log10(256 - len(ruled))
            tokens = [*t.split(), b""]
            base = sum(math.log10((words[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
            yield key, (len(tokens), sum(words[w] > 0 for w in tokens), n, base, total)

    some = real.where("length(text) < 900").limit(25)
    for docs, order in ((some, 5), (some, 2), (odd.where("doc_id is not null and length(text) < 500 or doc_id = 3").distinct(), 5)):
        expected = dict(brute([(r.doc_id, r.text) for r in docs.collect()], order))
        found = language.scores(docs, order, 4000).collect()
        assert len(found) == len(expected)
        for r in found:
            n_tokens, n_known, n, base, total = expected[r.doc_id]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (n_tokens, n_known, n)
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
            assert r.base_score == pytest.approx(base) and r.score == pytest.approx(total, rel=1e-5)
    assert language.scores(odd).count() == odd.count()


def test_language_model_beats_its_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    held = [r for r in language.scores(docs).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_quality(spark, sf, real, odd):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fitted(real, labels)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = [r for r in quality.scored(real, model).collect() if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in rows) / len(rows) > 0.8
    scored = quality.scored(odd, model).collect()
    assert len(scored) == odd.count() and all(0 <= r.score <= 1 for r in scored)
    nothing = quality.fitted(real, labels.limit(0))
    assert {r.score for r in quality.scored(odd, nothing).collect()} == {0.5}
    assert quality.accepted(odd, model).columns == odd.columns


def test_toxicity_gradients():
    texts = pa.array(["some words of a text", "others, and more", "x"])
    network = toxicity.Network(1)
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    vocabulary, codes, counts = toxicity.read_words(texts)
    _, first, length = toxicity.windows(counts)
    at, mask = toxicity._grid(codes, first, length)
    truth = np.array([1.0, 0.0, 1.0])

    def loss(keep=None):
        inputs = vocabulary.vectors(network.p["words"], network.p["grams"])
        logit = network.forward(network.project(inputs), at, mask, keep)
        return np.log1p(np.exp(-np.where(truth == 1, logit, -logit))).sum(), logit, inputs

    keep = {}
    _, logit, inputs = loss(keep)
    gradients = network.backward(keep, 1 / (1 + np.exp(-logit)) - truth, vocabulary, inputs)
    for name, g in gradients.items():
        flat, slope = network.p[name].reshape(-1), g.reshape(-1)
        for i in np.argsort(-np.abs(slope))[:3]:
            before = flat[i]
            flat[i] = before + 1e-3
            up = loss()[0]
            flat[i] = before - 1e-3
            down = loss()[0]
            flat[i] = before
            assert slope[i] == pytest.approx((up - down) / 2e-3, rel=0.05, abs=1e-4), name


def test_toxicity_windows_cover_every_word():
    counts = np.array([0, 1, 32, 33, 48, 49, 1000])
    doc, first, length = toxicity.windows(counts)
    starts = np.cumsum(counts) - counts
    for d, n in enumerate(counts):
        seen = {w for f, k in zip(first[doc == d], length[doc == d]) for w in range(f, f + k)}
        assert seen == set(range(starts[d], starts[d] + n))


def test_toxicity(spark, odd):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(500):
        text = list(rng.choice(words, rng.integers(5, 80)))
        toxic = i % 4 == 0
        if toxic:
            text.insert(int(rng.integers(0, len(text))), rng.choice(["idiot", "scumbag."]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    network = toxicity.fitted(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    found = [r for r in toxicity.scored(docs, network).collect() if r.held_out]
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in found) / len(found) > 0.9
    scored = toxicity.scored(odd, network).collect()
    assert len(scored) == odd.count() and all(0 <= r.score <= 1 for r in scored)
    nothing = toxicity.fitted(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert not any(r.predicted for r in toxicity.scored(docs, nothing).collect())


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    byte, word, piece = (public_tokenizers.path(p) for p in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
    token_files.write_token_files(none, str(tmp_path / "none"), byte)
    model = quality.AdditiveModel().fit(np.zeros((0, len(quality.FEATURES))), np.zeros(0))
    for found in (
        exact.exact_groups(none), simhash.near_duplicates(none), shards.sharded(none), language.scores(none), packing.packed(none, word),
        sentencepieces.round_trip_digests(none, piece), token_files.read_token_files(spark, str(tmp_path / "none")),
        quality.scored(none, model), toxicity.scored(none, toxicity.Network()),
    ):
        assert found.count() == 0
