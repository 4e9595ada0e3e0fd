"""The registered queries of the corpus operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from salvage.llm import (
    conversations, exact, language, neighbours, packing, quality, ranked, rules, sentencepieces, shards, simhash, token_files, toxicity,
)
from salvage.llm.common import forget_at_exit
from salvage.session import scratch_dir


def corpus_pipeline_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.exact_groups(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"))


def token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "token-files")
    token_files.write_token_files(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    forget_at_exit(spark, path)
    return token_files.read_token_files(spark, path)


def lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.scores(_table(spark, sf_dir, "documents"))


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.fitted(docs, _table(spark, sf_dir, "labels")))


def piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepieces.round_trip_digests(_table(spark, sf_dir, "documents"), model)


def packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def sharded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.sharded(_table(spark, sf_dir, "documents"))


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fitted(docs, _table(spark, sf_dir, "labels")))


def simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def ranked_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def repaired_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repaired(conversations.damaged(_table(spark, sf_dir, "conversations")), "there")


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return rules.scored(docs, rules.references(docs)).drop("class_distance", "word_distance")


QUERIES = {
    "op1_exact_dedup": exact_dedup,
    "op2_cross_polytope_neighbours": nearest_neighbours,
    "op3_token_files": token_id_files,
    "op4_lm_scores": lm_scores,
    "op5_quality": quality_scores,
    "op6_sentencepiece": piece_round_trip,
    "op7_packing": packed_sequences,
    "op8_sharding": sharded_documents,
    "op9_toxicity": toxicity_scores,
    "op10_simhash": simhash_components,
    "op11_ranked_search": ranked_benchmark,
    "op12_conversation_repair": repaired_conversations,
    "op13_quality_rules": quality_rules,
    "pipeline": corpus_pipeline_rows,
}

ORACLES = {
    "op1_exact_dedup": """
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS chars,
                   sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
            FROM documents
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
        FROM (
            SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
                   first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id
            FROM d
        )
    """,    "op11_ranked_search": """
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
        spelt AS (
            SELECT r, translate(unnest(regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
            FROM d
        ),
        lengths AS (SELECT r, count(*) AS n FROM spelt GROUP BY r),
        corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths),
        asked AS (
            SELECT DISTINCT item_id, translate(unnest(regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')),
                                               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
            FROM benchmark
        ),
        postings AS (SELECT r, term, count(*) AS tf FROM spelt WHERE term IN (SELECT term FROM asked) GROUP BY r, term),
        weights AS (
            SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
            FROM postings, corpus GROUP BY term, docs
        ),
        impacts AS (
            SELECT r, term, (1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms)) AS impact
            FROM postings JOIN lengths USING (r), corpus
        ),
        scored AS (
            SELECT item_id, r, CAST(sum(w * impact) AS BIGINT) AS score
            FROM asked JOIN weights USING (term) JOIN impacts USING (term) GROUP BY item_id, r
        )
        SELECT item_id, rank, doc_id, score FROM (
            SELECT item_id, doc_id, score,
                   CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank
            FROM scored JOIN d USING (r) WHERE score > 0
        ) WHERE rank <= 10
    """,
    "op12_conversation_repair": """
        WITH RECURSIVE source AS (
            -- crc32, bit by bit: a byte of the key is added, then eight steps (-1) follow
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(
                       string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
                       lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
                       lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END
                   ), 4294967295) % 20 AS fault
            FROM conversations
        ),
        kept AS (
            SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role,
                   CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                   unnest(CASE fault WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
            FROM source WHERE fault <> 0
        ),
        numbered AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS place,
                   row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
                   right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last
            FROM kept
        ),
        judged AS (
            SELECT *, last = '' AS blank, last <> '' AND again AS duplicate,
                   last NOT IN ('', '.', '!', '?') AND NOT again AS truncated,
                   left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY place) AS before
            FROM numbered
        ),
        facts AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank,
                   count_if(duplicate) AS duplicate, count_if(truncated) AS truncated,
                   count_if(before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
            FROM judged GROUP BY conv_id
        ),
        inserted(state, letters, reached, price) AS (VALUES
            ('-', '', '-', 0), ('-', 'I', 'u', 3), ('-', 'II', 'a', 6), ('s', '', 's', 0), ('s', 'I', 'u', 3), ('s', 'II', 'a', 6),
            ('u', '', 'u', 0), ('u', 'I', 'a', 3), ('a', '', 'a', 0), ('a', 'I', 'u', 3)
        ),
        follows(state, after) AS (VALUES ('-', 's'), ('-', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')),
        edits AS (
            SELECT reached, 'D' AS letter, reached AS after FROM (SELECT DISTINCT reached FROM inserted) UNION ALL
            SELECT state, 'K', after FROM follows UNION ALL
            SELECT state, 'R', after FROM follows WHERE after <> 's'
        ),
        best AS (
            SELECT conv_id, CAST(0 AS BIGINT) AS place, '-' AS state, CAST(0 AS BIGINT) AS cost, '' AS audit FROM facts
            UNION ALL
            SELECT conv_id, place, after, min(cost), arg_min(audit, (cost, audit)) FROM (
                SELECT j.conv_id, j.place, e.after, b.audit || i.letters || e.letter AS audit,
                       b.cost + i.price + CASE e.letter WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END
                           + CASE WHEN j.truncated AND e.letter <> 'D' THEN 3 ELSE 0 END AS cost
                FROM best b JOIN judged j ON j.conv_id IS NOT DISTINCT FROM b.conv_id AND j.place = b.place + 1
                JOIN inserted i ON i.state = b.state JOIN edits e USING (reached)
                WHERE e.letter = 'D' OR NOT (j.blank OR j.duplicate) AND (e.letter = 'R' OR e.after = j.initial)
            ) GROUP BY conv_id, place, after
        ),
        ended AS (
            SELECT b.conv_id, min(cost + price) AS cost, arg_min(audit || letters, (cost + price, audit || letters)) AS audit
            FROM best b JOIN facts f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.n = b.place JOIN inserted i USING (state)
            WHERE i.reached IN ('-', 'a') GROUP BY b.conv_id
        ),
        letter AS (SELECT conv_id, unnest(string_split(audit, '')) AS x, generate_subscripts(string_split(audit, ''), 1) AS k FROM ended),
        placed AS (
            SELECT conv_id, x, k, count_if(x <> 'I') OVER (PARTITION BY conv_id ORDER BY k) AS place,
                   count_if(x <> 'D') OVER (PARTITION BY conv_id ORDER BY k) AS out
            FROM letter WHERE x <> ''
        ),
        written AS (
            SELECT p.conv_id, k, x, out, j.role, j.text,
                   max(CASE WHEN out = 1 AND x = 'K' AND j.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY p.conv_id) AS opened
            FROM placed p LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM p.conv_id AND j.place = p.place WHERE x <> 'D'
        ),
        texts AS (
            SELECT conv_id, string_agg(
                CASE WHEN x = 'K' THEN role WHEN (out - opened) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':'
                || CASE WHEN x = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS repaired
            FROM written GROUP BY conv_id
        )
        SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
               coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
               coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c
        LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
        LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
        LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
    """,
    "op13_quality_rules": """
        WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
        spelt AS (SELECT r, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM d),
        word AS (SELECT r, unnest(words) AS w, generate_subscripts(words, 1) AS pos FROM spelt),
        windows AS (
            SELECT r, pos, w, lead(w, 1) OVER p AS w1, lead(w, 2) OVER p AS w2 FROM word WINDOW p AS (PARTITION BY r ORDER BY pos)
        ),
        again AS (
            SELECT r, count(DISTINCT place) AS n FROM (
                SELECT r, unnest([pos, pos + 1, pos + 2]) AS place FROM (
                    SELECT r, pos, count(*) OVER (PARTITION BY r, w, w1, w2) AS n FROM windows WHERE w2 IS NOT NULL
                ) WHERE n > 1
            ) GROUP BY r
        ),
        line AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
        lines AS (
            SELECT r, count(*) - count(DISTINCT line) AS n FROM line WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r
        ),
        base AS (
            SELECT d.r, doc_id, lang, len(words) AS n_words, length(text) AS chars,
                   length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
                   length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                   coalesce(lines.n, 0) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words
            FROM d JOIN spelt USING (r) LEFT JOIN lines USING (r) LEFT JOIN again USING (r)
        ),
        known AS (SELECT lang FROM d WHERE lang IS NOT NULL GROUP BY lang HAVING count(*) >= (SELECT count(*) FROM d) / 1000),
        taught AS (SELECT r, lang FROM base JOIN known USING (lang) WHERE n_words >= 50),
        classes AS (
            SELECT r, unnest(range(8)) AS k, unnest([
                length(regexp_replace(text, '[^a-z]', '', 'g')), length(regexp_replace(text, '[^A-Z]', '', 'g')),
                length(regexp_replace(text, '[^0-9]', '', 'g')), length(regexp_replace(text, '[^\\x20\\x09-\\x0D]', '', 'g')),
                length(regexp_replace(text, '[^.,;:!?"''()-]', '', 'g')),
                length(regexp_replace(text, '[^#$%&*+/<=>@\\[\\\\\\]^_`{|}~]', '', 'g')),
                length(regexp_replace(text, '[^\\x00-\\x08\\x0E-\\x1F\\x7F]', '', 'g')), length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g'))
            ]) AS n FROM d
        ),
        class_refs AS (SELECT lang, k, sum(n) AS n FROM classes JOIN taught USING (r) GROUP BY lang, k),
        class_shares AS (SELECT lang, k, n / sum(n) OVER (PARTITION BY lang) AS q FROM class_refs),
        class_far AS (
            SELECT r, min(far) AS far FROM (
                SELECT r, lang, sqrt(sum(
                    CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END
                ) / 2) AS far
                FROM (SELECT r, k, n / sum(n) OVER (PARTITION BY r) AS p FROM classes WHERE r IN (SELECT r FROM base WHERE chars >= 200))
                JOIN class_shares USING (k) GROUP BY r, lang
            ) GROUP BY r
        ),
        plain AS (
            SELECT r, trim(translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '.,;:!?"''()') AS w, count(*) AS n
            FROM word GROUP BY 1, 2
        ),
        common AS (
            SELECT lang, w, n FROM (
                SELECT lang, w, sum(n) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, w) AS place
                FROM plain JOIN taught USING (r) WHERE w <> '' GROUP BY lang, w
            ) WHERE place <= 100
        ),
        word_refs AS (
            SELECT lang, w, n FROM common UNION ALL
            SELECT lang, '', every - coalesce(named, 0)
            FROM (SELECT lang, sum(n) AS every FROM plain JOIN taught USING (r) GROUP BY lang)
            LEFT JOIN (SELECT lang, sum(n) AS named FROM common GROUP BY lang) USING (lang)
        ),
        word_shares AS (SELECT lang, w, n / sum(n) OVER (PARTITION BY lang) AS q FROM word_refs),
        long AS (SELECT r, n_words FROM base WHERE n_words >= 150),
        asked AS (
            SELECT r, lang, w, q, coalesce(plain.n, 0) / n_words AS p
            FROM long CROSS JOIN word_shares LEFT JOIN plain USING (r, w) WHERE w <> ''
        ),
        binned AS (
            SELECT r, lang, p, q FROM asked UNION ALL
            SELECT r, lang, 1 - sum(p), 1 - sum(q) FROM asked GROUP BY r, lang
        ),
        word_far AS (
            SELECT r, min(far) AS far FROM (
                SELECT r, lang, sqrt(sum(
                    CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END
                ) / 2) AS far FROM binned GROUP BY r, lang
            ) GROUP BY r
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
               n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
               NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
                   AND coalesce(c.far, 0) <= 0.3 AND coalesce(w.far, 0) <= 0.4 AS kept
        FROM base LEFT JOIN class_far c USING (r) LEFT JOIN word_far w USING (r)
    """,
}
