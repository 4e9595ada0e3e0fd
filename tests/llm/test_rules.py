"""Quality rules against plain loops, on odd tables."""

import math
import re
from collections import Counter, defaultdict

import pytest

from salvage.llm import rules

SPACE = r"[\x20\x09-\x0D]"
SCHEMA = "doc_id long, text string, lang string, kept boolean, n_words long, item string"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def class_of(c):
    if re.match(SPACE, c):
        return 3
    if ord(c) > 0x7F:
        return 7
    if ord(c) < 0x20 or c == "\x7f":
        return 6
    for k, pattern in enumerate(("[a-z]", "[A-Z]", "[0-9]")):
        if re.match(pattern, c):
            return k
    return 4 if c in ".,;:!?\"'()-" else 5


def plain(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return [w.strip(".,;:!?\"'()") for w in words_of(lower)]


def base(text):
    words = words_of(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    again = {i + k for i, w in enumerate(windows) if w in twice for k in range(3)}
    lines = [x for x in text.split("\n") if words_of(x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    counts = len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(again)
    return counts, len(words) < 50 or 100 * len(again) > 50 * len(words)


def distance(p, q):
    p, q = ([x / sum(d) for x in d] for d in (p, q))
    apart = 0.0
    for a, b in zip(p, q):
        m = (a + b) / 2
        apart += (a * math.log2(a / m) if a else 0) + (b * math.log2(b / m) if b else 0)
    return math.sqrt(max(0, apart / 2))


def expected(rows):
    """Of every row ``(id, text, lang)``: the counts, whether the base rules fail, both distances, the verdict."""
    named = Counter(lang for _, _, lang in rows if lang is not None)
    learnt = defaultdict(list)
    for _, text, lang in rows:
        if lang is not None and named[lang] * 1000 >= len(rows) and len(words_of(text or "")) >= 50:
            learnt[lang].append(text)
    classes = {lang: [sum(class_of(c) == k for t in texts for c in t) for k in range(8)] for lang, texts in learnt.items()}
    common = {}
    for lang, texts in learnt.items():
        held = Counter(w for t in texts for w in set(plain(t)) if w)
        best = sorted(held, key=lambda w: (-held[w], w.encode()))[:100]
        times = Counter(w for t in texts for w in plain(t))
        common[lang] = best, [times[w] for w in best] + [sum(n for w, n in times.items() if w not in best)]
    found = []
    for i, text, _ in rows:
        text = text or ""
        counts, failed = base(text)
        far = [None, None]
        if learnt and len(text) >= 200:
            own = [sum(class_of(c) == k for c in text) for k in range(8)]
            far[0] = min(distance(own, c) for c in classes.values())
        if learnt and counts[0] >= 150:
            own = Counter(plain(text))
            far[1] = min(distance([own[w] for w in best] + [counts[0] - sum(own[w] for w in best)], n) for best, n in common.values())
        kept = not failed and (far[0] or 0) <= rules.CLASS_DISTANCE and (far[1] or 0) <= rules.WORD_DISTANCE
        found.append((i, *counts, *(f if f is None else round(f, 9) for f in far), failed, kept))
    return Counter(found)


def rows_of(df):
    return Counter(
        (*r[:6], *(f if f is None else round(f, 9) for f in r[6:8]), *r[8:]) for r in df.collect()
    )


def test_documents_as_by_plain_loops(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(5)
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    assert rows_of(rules.scored(docs, rules.references(docs))) == expected(rows)


def test_odd_texts(spark):
    prose = "the cat of the house and a dog in the yard, it is. " * 5
    varied = " ".join(f"the w{i} of and{'' if i % 3 else '!'} {i}" for i in range(60))
    texts = [
        None, "", " \n\t", "a", prose, varied, varied.upper(), varied, "日本語 の " * 70, "\x00 \x7f # * $ " * 60, "x " * 50_000,
        "a b c a b c", "a b\n a b\na b\n\n\n", "### *** " + varied, " ".join(f"q{i}" for i in range(200)), "... !!! " * 100,
        "é" * 300, " ".join(map(str, range(49))), " ".join(map(str, range(50))), varied.replace(" ", " "),
    ]
    rows = [(i, t, ("en", None, "fr")[i % 3]) for i, t in enumerate(texts)] + [(None, varied, "en")] * 2 + [(5, varied, "fr")]
    docs = spark.createDataFrame([(*r, True, 7, "z") for r in rows], SCHEMA).repartition(3)
    learnt = rules.references(docs)
    assert rows_of(rules.scored(docs, learnt)) == expected(rows)
    kept = rules.accepted(docs, learnt)
    assert kept.columns == docs.columns
    bad = {r.doc_id for r in rules.scored(docs, learnt).collect() if not r.kept}
    stay = Counter((r.doc_id, r.text) for r in kept.collect())
    assert stay == Counter((i, t) for i, t, _ in rows if i is None or i not in bad)


@pytest.mark.parametrize("langs", [[], [None] * 3])
def test_without_references_only_the_base_rules_judge(spark, langs):
    docs = spark.createDataFrame([(i, "word " * 3 + " ".join(map(str, range(60))), lang) for i, lang in enumerate(langs)], "doc_id long, text string, lang string")
    learnt = rules.references(docs)
    assert learnt.counts == {} and rules.languages(docs) == []
    found = rules.scored(docs, learnt).collect()
    assert [(r.class_distance, r.word_distance, r.kept) for r in found] == [(None, None, True)] * len(langs)


def test_good_documents_stay_and_poor_ones_go(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    found = rules.scored(docs, rules.references(docs)).join(labels, "doc_id").collect()
    good = [r for r in found if r.quality == 1 and not r.base_failed]
    poor = [r for r in found if r.quality == 0 and not r.base_failed and r.n_words >= rules.WORD_COUNT]
    assert all(r.kept for r in good) and len(good) > 200
    assert sum(not r.kept for r in poor) >= 0.75 * len(poor) > 0
