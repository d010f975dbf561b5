"""The queries of the training-data operators: thin views of what each operator returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import bwt_dedup, chat, decontaminate, html_content, importance, kmeans, langid, mixing, parity_join, pii, quality, simhash, tokencount
from folioscope.llm.shared import read_table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.train_quality(docs, read_table(spark, sf_dir, "labels")))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read_table(spark, sf_dir, "documents"), targets=mixing.TARGETS)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    own = read_table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    return chat.conversation_digests(chat.format_chat(own.unionByName(added)))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_content.extract_main_text(read_table(spark, sf_dir, "pages"), html_content.train_content_model())
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bwt_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + F.split(s, ":")[1].cast("long") - F.split(s, ":")[0].cast("long"))
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(read_table(spark, sf_dir, "documents"))
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")  # noqa: E731
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    return found.select("doc_id", *(number(k).alias(f"n_{k}") for k in pii.BASE_KINDS), F.sha2(pii.span_text(base), 256).alias("base_sha256"), pii.span_text(F.col("spans")).alias("spans"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", langid.held_out().alias("held_out"))
    model = langid.train_language_model(docs.filter("NOT held_out").select("doc_id", "text", "lang"))
    return langid.predict_language(docs, model, keep=("held_out",))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(read_table(spark, sf_dir, "documents"), tokencount.UnigramVocabulary.load())


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.cluster_vectors(read_table(spark, sf_dir, "embeddings"))[0]


def op12_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.similar_documents(read_table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counted part of the quality rules by itself, which SQL can express."""
    return quality.count_base(read_table(spark, sf_dir, "documents"))


def mixing_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells that are raked, which SQL can express."""
    return mixing.source_cells(read_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_mixing, op3_chat_format, op4_decontamination, op5_html_extraction, op6_bwt_dedup, op7_pii, op8_simhash, op9_language_id, op10_token_counts,
        op11_centroid_clustering, op12_ngram_jaccard_join, op13_importance_resampling, quality_base, mixing_cells,
    )
}  # fmt: skip

_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _lloyd_sql(k: int = 40, rounds: int = 5, dimensions: int = 64) -> str:
    """Each round as two steps of SQL: assignments, then centroids."""
    steps = [
        f"""x AS (SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                  WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = {dimensions}),
        c0 AS (SELECT row_number() OVER (ORDER BY h, vec_id, v) - 1 AS c, v FROM (SELECT sha256('2:' || vec_id) AS h, vec_id, v FROM x WHERE vec_id IS NOT NULL ORDER BY h, vec_id, v LIMIT {k}))"""
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} AS MATERIALIZED (SELECT vec_id, v, min(ROW(d, c)) AS m FROM (
                SELECT vec_id, x.v, c, CAST(list_sum(list_transform(list_zip(x.v, c{r}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM x, c{r}) GROUP BY vec_id, v)"""
        )
        if r < rounds:
            steps.append(
                f"""c{r + 1} AS MATERIALIZED (SELECT c, coalesce(n.v, c{r}.v) AS v FROM c{r} LEFT JOIN (
                    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (
                        SELECT m[2] AS c, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM (SELECT a{r}.v, m, unnest(range(1, {dimensions + 1})) AS i FROM x JOIN a{r} USING (vec_id, v)) GROUP BY ALL)
                    GROUP BY c) n USING (c))"""
            )
    return f"""WITH {", ".join(steps)},
        z AS (SELECT x.vec_id, m[2] AS c, m[1] AS distance FROM x JOIN a{rounds} a ON x.vec_id IS NOT DISTINCT FROM a.vec_id AND x.v = a.v)
        SELECT vec_id, CAST(c AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
               sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
        FROM z JOIN c{rounds} USING (c)"""


ORACLE_SQL = {
    "op11_centroid_clustering": _lloyd_sql(),
    "op12_ngram_jaccard_join": rf"""
        WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({_LOWER}, '[^ 	-]+') AS w FROM documents),
        s AS (SELECT k, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                     ELSE list_transform(range(1, len(w) - 2), lambda p: w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] || ' ' || w[p + 3]) END)) AS g FROM d),
        c AS MATERIALIZED (SELECT row_number() OVER () AS c, g, len(g) AS n FROM (SELECT DISTINCT g FROM s WHERE len(g) > 0)),
        e AS MATERIALIZED (SELECT c, n, unnest(g) AS g FROM c),
        pairs AS (SELECT a.c AS x, b.c AS y, count(*) AS i, any_value(a.n + b.n) AS n FROM e a JOIN e b USING (g) WHERE a.c < b.c AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL),
        links AS MATERIALIZED (SELECT x, y FROM pairs WHERE 100 * i >= 85 * (n - i)),
        reach AS (SELECT c, c AS r FROM c UNION SELECT reach.c, l.y FROM reach JOIN (SELECT x, y FROM links UNION ALL SELECT y, x FROM links) l ON reach.r = l.x),
        least AS (SELECT c.g, min(d.doc_id) AS m FROM s JOIN d USING (k) JOIN c ON s.g = c.g GROUP BY c.g),
        named AS (SELECT a.g, min(least.m) AS component_id FROM c a JOIN reach USING (c) JOIN c b ON b.c = reach.r JOIN least ON least.g = b.g GROUP BY a.g)
        SELECT doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, coalesce(component_id, CASE WHEN len(s.g) = 0 THEN doc_id END) AS component_id FROM s JOIN d USING (k) LEFT JOIN named ON s.g = named.g""",
    "op13_importance_resampling": rf"""
        WITH crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM (SELECT unnest(range(0, 256)) AS i))),
        d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({_LOWER}, {_WORDS}) AS w FROM documents),
        b AS MATERIALIZED (SELECT regexp_extract_all({_LOWER}, {_WORDS}) AS w FROM benchmark),
        words AS MATERIALIZED (
            SELECT x, xor(list_reduce(list_transform(range(0, octet_length(encode(x))), lambda i: CAST('0x' || substr(hex(encode(x)), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)),
                lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket
            FROM (SELECT unnest(w) AS x FROM d UNION SELECT unnest(w) FROM b), crc),
        own AS (SELECT k, bucket FROM (SELECT k, unnest(w) AS x FROM d) JOIN words USING (x)),
        s AS (SELECT bucket, count(*) AS s FROM own GROUP BY bucket),
        t AS (SELECT bucket, count(*) AS t FROM (SELECT unnest(w) AS x FROM b) JOIN words USING (x) GROUP BY bucket),
        gains AS (SELECT bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST((SELECT coalesce(sum(s), 0) FROM s) + 10000 AS DOUBLE)
                      / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * CAST((SELECT coalesce(sum(t), 0) FROM t) + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM s FULL JOIN t USING (bucket)),
        weighed AS (SELECT k, CAST(sum(gain) AS BIGINT) AS weight FROM own JOIN gains USING (bucket) GROUP BY k),
        scored AS (SELECT k, doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
                       coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN weighed USING (k)),
        ranked AS (SELECT k, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20 AND score IS NOT NULL)
        SELECT doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank FROM scored LEFT JOIN ranked USING (k)""",
    "op3_chat_format": r"""
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        sized AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n,
                   length(role) + length(text) + length(text) - length(replace(text, '\', ''))
                   + length(regexp_replace(replace(text, '\', '\\'),
                       '<\|turn\|>|<\|end\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>', '\0.', 'g'))
                   - length(replace(text, '\', '\\')) + length('<|turn|><|end|>') + 2 AS size
            FROM rows)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(size) AS BIGINT) AS formatted_chars,
               count(*) FILTER (role = 'assistant') AS n_examples,
               CAST(coalesce(sum(upto) FILTER (role = 'assistant'), 0) AS BIGINT) AS examples_chars
        FROM (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY n) AS upto FROM sized)
        GROUP BY conv_id""",
    "op4_decontamination": rf"""
        WITH dw AS (
            SELECT doc_id, row_number() OVER () AS doc, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS w FROM documents),
        iw AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS w FROM benchmark),
        windows AS (
            SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[p:p + least(10, len(w)) - 1], ' ') AS s
            FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS p FROM iw WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT k FROM windows),
        places AS (
            SELECT doc, p, k, array_to_string(w[p:p + k - 1], ' ') AS s
            FROM (SELECT doc, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM dw, sizes WHERE len(w) >= k)),
        found AS (SELECT doc, p, k, item_id FROM places JOIN windows USING (k, s)),
        hits AS (SELECT doc, count(DISTINCT q) AS n FROM (SELECT doc, unnest(range(p, p + k)) AS q FROM found) GROUP BY doc),
        items AS (SELECT doc, count(*) AS n, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT doc, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY doc)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hits.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
               sha256(coalesce(items.s, '')) AS items_sha256, coalesce(hits.n, 0) > 0 AS contaminated
        FROM dw LEFT JOIN hits USING (doc) LEFT JOIN items USING (doc)""",
    "quality_base": r"""
        WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        p AS (SELECT k, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS s FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS p FROM d WHERE len(w) >= 3)),
        again AS (SELECT k, p FROM (SELECT k, p, count(*) OVER (PARTITION BY k, s) AS n FROM p) WHERE n > 1),
        hit AS (SELECT k, count(DISTINCT q) AS n FROM (SELECT k, unnest(range(p, p + 3)) AS q FROM again) GROUP BY k),
        lines AS (SELECT k, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n FROM (SELECT k, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d)),
        c AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
                     CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, lines.n AS n_dup_lines, coalesce(hit.n, 0) AS n_repeat_words
              FROM d JOIN lines USING (k) LEFT JOIN hit USING (k))
        SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c""",
    "mixing_cells": r"""
        WITH d AS (SELECT source, lang, coalesce(text, '') AS t FROM documents),
        s AS (SELECT *, greatest(length(t), 1) AS size, 1 + length(t) - length(replace(t, chr(10), '')) AS lines FROM d),
        f AS (SELECT source, lang, CAST(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS BIGINT) AS n,
            CASE WHEN len(regexp_extract_all(t, '[{}();=<>\[\]]')) * 25 >= size THEN 'code'
                 WHEN len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[|\t]'))) * 2 >= lines THEN 'table'
                 WHEN lines >= 3 AND len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '^[ \t]*([-*\x{2022}]|[0-9]{1,3}[.)])[ \t]'))) * 2 >= lines THEN 'list'
                 WHEN len(regexp_extract_all(t, '[0-9]')) * 5 >= size THEN 'figures'
                 WHEN len(regexp_extract_all(t, '\p{Lu}')) * 3 >= size THEN 'capitals' ELSE 'prose' END AS topic FROM s)
        SELECT source, lang, topic, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS tokens FROM f GROUP BY ALL""",
}
