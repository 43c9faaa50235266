"""The thin registered queries of the training-data operators: contract columns from each operator's own output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.llm import ctw, decontaminate, html_extraction, language_id, merkle, near_dedup, packing, quality, substring_dedup, topk, toxicity, warc, whitening
from sievelake.llm.common import crc_mod, held_out, table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.score(docs, model, "doc_id", held_out()).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op2_exact_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding").where(topk.usable("embedding"))
    whole = rows.select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(1024.0) * x.cast("double")).cast("long")).alias("vector"))
    return topk.search(whole, F.col("vec_id") % 100 == 0)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    return warc.round_trip(spark, pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.passages(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality.score(docs, model, "doc_id", held_out()).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: the text that is left, and the removed spans as start-end:kept_doc_id@kept_start."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = substring_dedup.remove(docs, substring_dedup.repeats(docs), spans_column="spans")
    written_out = F.transform("spans", lambda s: F.format_string("%d-%d:%d@%d", s["start"], s["end"], s["kept_doc_id"], s["kept_start"]))
    return found.select("doc_id", "text", F.coalesce(F.array_join(written_out, " "), F.lit("")).alias("removed_spans"), F.coalesce(F.aggregate("spans", F.lit(0), lambda n, s: n + s["words"]), F.lit(0)).alias("removed_words"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = language_id.fit(docs.where(crc_mod("doc_id", 5) != 0))
    return language_id.predict(docs.select("doc_id", held_out(), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"), lambda: packing.word_encoder(tokenizer_path()))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = ctw.score(docs, crc_mod("doc_id", 10) != 0)
    return found.select("doc_id", held_out("doc_id", 10), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    docs = table(spark, sf_dir, "documents", *fields)
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    _, proofs = merkle.manifest(docs, fields, "doc_id", "source", {"text": F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))})
    return proofs


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), "vec_id", "embedding", 8, 1024.0, 100_000)
    return found.withColumn("deviation", F.expr("try_cast(deviation AS long)"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_exact_topk_search, op3_warc, op4_decontamination, op5_quality_classifier, op6_substring_dedup, op7_minhash_near_dedup, op8_language_id, op9_best_fit_packing, op10_lm_scoring, op11_html_extraction, op12_merkle_manifest, op13_embedding_whitening)}


#: DuckDB SQL by query name; the others are tested against brute force, a round trip or held-out accuracy.
ORACLE_SQL: dict[str, str] = {
    "op2_exact_topk_search": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                     CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op6_substring_dedup": r"""
        WITH s AS (SELECT doc_id, regexp_extract_all(text, '[^.!?\n]*[.!?]*[ \t\n\r\f]*') AS us FROM documents WHERE text IS NOT NULL),
        x AS (SELECT doc_id, unnest(us) AS u, generate_subscripts(us, 1) AS i FROM s),
        p AS (SELECT doc_id, i, u, CAST(coalesce(sum(length(u)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start,
                     regexp_extract_all(lower(u), '[\p{L}\p{N}]+') AS ws FROM x WHERE u <> ''),
        w AS (SELECT doc_id, start, start + length(u) AS "end", len(ws) AS words, array_to_string(ws, ' ') AS norm, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS nth FROM p WHERE len(ws) > 0),
        k AS (SELECT *, first_value(doc_id) OVER o AS kept_doc_id, first_value(start) OVER o AS kept_start, row_number() OVER o AS occurrence FROM w WINDOW o AS (PARTITION BY norm ORDER BY doc_id, start)),
        l AS (SELECT *, nth - row_number() OVER (PARTITION BY doc_id ORDER BY nth) AS island FROM k WHERE occurrence > 1),
        r AS (SELECT doc_id, min(start) AS start, max("end") AS "end", sum(words) AS words, min_by(kept_doc_id, nth) AS kept_doc_id, min_by(kept_start, nth) AS kept_start
              FROM l GROUP BY doc_id, island HAVING sum(CASE WHEN words >= 4 THEN words ELSE 0 END) >= 10),
        t AS (SELECT p.doc_id, coalesce(string_agg(p.u, '' ORDER BY p.i) FILTER (r.doc_id IS NULL), '') AS text FROM p LEFT JOIN r ON p.doc_id = r.doc_id AND p.start >= r.start AND p.start < r."end" GROUP BY p.doc_id),
        n AS (SELECT doc_id, string_agg(concat(start, '-', "end", ':', kept_doc_id, '@', kept_start), ' ' ORDER BY start) AS removed_spans, CAST(sum(words) AS INTEGER) AS removed_words FROM r GROUP BY doc_id)
        SELECT d.doc_id, CASE WHEN n.doc_id IS NULL THEN d.text WHEN trim(t.text, E' \t\n\r\f\v') = '' THEN '' ELSE t.text END AS text,
               coalesce(n.removed_spans, '') AS removed_spans, coalesce(n.removed_words, 0) AS removed_words
        FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op3_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
        m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to FROM m""",
    # crc32 byte by byte, its eight steps as zeros that follow each byte; every level of a tree from the one below
    "op12_merkle_manifest": """
        WITH RECURSIVE f AS (
            SELECT doc_id, source, text, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                   || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
                   xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
                       lambda c, x: xor(xor(c, x) // 2, (xor(c, x) % 2) * 3988292384)), 4294967295) % 2 = 0 AS even FROM documents),
        l AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                     CASE WHEN even THEN sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) END AS other FROM f),
        i AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM l),
        t AS (SELECT source, 0 AS level, idx, leaf AS h, n FROM i
              UNION ALL SELECT source, level + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (n + 2) // 3 FROM t WHERE n > 1 GROUP BY source, level, idx // 3, n),
        s AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM t WHERE n = 1),
        u AS (SELECT 0 AS level, idx, subroot AS h, n FROM s
              UNION ALL SELECT level + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (n + 2) // 3 FROM u WHERE n > 1 GROUP BY level, idx // 3, n),
        -- siblings left and right of a node, from the leaves to the root
        a AS (SELECT x.source, x.level, x.idx, coalesce(string_agg(y.h, '' ORDER BY y.idx) FILTER (y.idx < x.idx), '') AS l, coalesce(string_agg(y.h, '' ORDER BY y.idx) FILTER (y.idx > x.idx), '') AS r
              FROM t x JOIN t y ON x.source IS NOT DISTINCT FROM y.source AND x.level = y.level AND x.idx // 3 = y.idx // 3 WHERE x.n > 1 GROUP BY ALL),
        b AS (SELECT x.level, x.idx, coalesce(string_agg(y.h, '' ORDER BY y.idx) FILTER (y.idx < x.idx), '') AS l, coalesce(string_agg(y.h, '' ORDER BY y.idx) FILTER (y.idx > x.idx), '') AS r
              FROM u x JOIN u y ON x.level = y.level AND x.idx // 3 = y.idx // 3 WHERE x.n > 1 GROUP BY ALL),
        low AS (SELECT source, idx AS leaf_idx, doc_id, 0 AS level, idx, coalesce(other, leaf) AS h, '' AS sides FROM i
                UNION ALL SELECT w.source, w.leaf_idx, w.doc_id, w.level + 1, w.idx // 3, sha256(a.l || w.h || a.r), w.sides || a.l || a.r
                FROM low w JOIN a ON w.source IS NOT DISTINCT FROM a.source AND w.level = a.level AND w.idx = a.idx),
        ends AS (SELECT w.source, w.leaf_idx, w.doc_id, s.subroot, s.idx, w.h, w.sides FROM low w JOIN s ON w.source IS NOT DISTINCT FROM s.source
                 WHERE w.level = (SELECT max(level) FROM t WHERE t.source IS NOT DISTINCT FROM w.source)),
        high AS (SELECT source, leaf_idx, doc_id, subroot, 0 AS level, idx, h, sides FROM ends
                 UNION ALL SELECT w.source, w.leaf_idx, w.doc_id, w.subroot, w.level + 1, w.idx // 3, sha256(b.l || w.h || b.r), w.sides || b.l || b.r FROM high w JOIN b ON w.level = b.level AND w.idx = b.idx)
        SELECT i.doc_id, i.leaf, w.subroot, u.h AS root, sha256(w.sides) AS proof_sha256, w.h AS folded_root, w.h = u.h AS verified
        FROM high w JOIN i ON w.source IS NOT DISTINCT FROM i.source AND w.leaf_idx = i.idx JOIN u ON u.n = 1 AND u.level = w.level""",
}
