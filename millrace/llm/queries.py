"""The queries of this subpackage and, where SQL can say them, their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, chat_format, divergence, html_text, language_id, mixing, ngram_join, prefix_trie, quality_gbt, quality_rules, secrets, suffix_dedup, syncmer


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat_format.digest_columns(chat_format.format_chats(rows))


def op2_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmer.edited_fingerprints(_read(spark, sf_dir, "documents"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_read(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    said: Column = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id", *[F.size(kept(k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(said(kept("assign", "access", "hex")), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"),
    )


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = suffix_dedup.trim(_read(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(_read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op7_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    got = bpe.round_trip(_read(spark, sf_dir, "documents").select("doc_id", "text"), path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return got.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality_rules.judged(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return got.select("doc_id", *quality_rules.ADDED)


def op10_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gbt.classified(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identified(_read(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_read(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turns(rows)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_chat_format, op2_syncmer_fingerprints, op3_ngram_jaccard_join, op4_secret_scan, op5_suffix_dedup, op6_html_main_text,
            op7_soft_mixing, op8_byte_bpe, op9_quality_rules, op10_quality_trees, op11_language_id, op12_source_divergence, op13_prefix_trie,
            secret_base_counts, quality_base_counts,
        )
    }


OP1_SQL = r"""
WITH own AS (
    SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')) t(conv_id, turn, role, text)
), rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT * FROM own)
), sized AS (
    SELECT *, len(regexp_extract_all(text, '### (?:System|User|Assistant|Tool|Role):|</turn>')) AS marks,
        CASE WHEN role IN ('system', 'user', 'assistant', 'tool') THEN 5 + length(role)
             ELSE 10 + length(replace(replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '#', '%23'), '<', '%3C')) END AS head
    FROM rows
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    sum(head + 1 + length(text) + marks + 9)::BIGINT AS formatted_chars, true AS identical,
    (max(CASE WHEN marks > 0 THEN 1 ELSE 0 END))::BIGINT AS rounds
FROM sized GROUP BY conv_id
"""


OP3_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
    FROM words
), grams AS (
    SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), shared AS (
    SELECT g FROM grams GROUP BY g HAVING count(*) > 1
), few AS (
    SELECT grams.* FROM grams JOIN shared USING (g)
), links AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM few a JOIN few b ON a.g = b.g AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reached AS (
    SELECT doc_id AS node, doc_id AS root FROM documents
    UNION
    SELECT links.b, reached.root FROM reached JOIN links ON links.a = reached.node
), roots AS (
    SELECT node, min(root) AS root FROM reached GROUP BY node
)
SELECT sets.doc_id, len(s)::BIGINT AS n_shingles, root AS component_id FROM sets JOIN roots ON roots.node = sets.doc_id
"""


OP5_SQL = r"""
WITH h AS (
    SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), w AS (
    SELECT doc_id, x, unnest(range(0, greatest(n - 49, 0))) AS p FROM h
), v AS (
    SELECT doc_id, p, substring(x, 2 * p + 1, 100) AS s FROM w
), least AS (
    SELECT s, min(doc_id) AS d FROM v GROUP BY s HAVING min(doc_id) < max(doc_id)
), hit AS (
    SELECT v.doc_id, v.p FROM v JOIN least ON least.s = v.s WHERE least.d < v.doc_id
), marked AS (
    SELECT doc_id, p, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 1 ELSE 0 END AS fresh FROM hit
), grouped AS (
    SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS g FROM marked
), runs AS (
    SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM grouped GROUP BY doc_id, g
), gaps AS (
    SELECT doc_id, a AS stop, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS start FROM runs
    UNION ALL SELECT h.doc_id, n, coalesce(max(b), 0) FROM h LEFT JOIN runs ON runs.doc_id = h.doc_id GROUP BY h.doc_id, n
), kept AS (
    SELECT gaps.doc_id, sha256(unhex(string_agg(substring(x, (2 * start + 1)::BIGINT, (2 * (stop - start))::BIGINT), '' ORDER BY start, stop))) AS kept_sha256 FROM gaps JOIN h ON h.doc_id = gaps.doc_id GROUP BY gaps.doc_id
), sums AS (
    SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM runs GROUP BY doc_id
)
SELECT h.doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, kept_sha256
FROM h JOIN kept ON kept.doc_id = h.doc_id LEFT JOIN sums ON sums.doc_id = h.doc_id
"""


def secret_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op4_secret_scan finds by its fixed patterns alone: the part of it that SQL can say."""
    return op4_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


SECRET_SQL = r"""
SELECT doc_id,
    len(list_filter(regexp_extract_all(text, '(?i)(?:password|passwd|secret|token|api_?key)["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: length(x) >= 6))::BIGINT AS n_assign,
    len(list_filter(regexp_extract_all(text, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20))::BIGINT AS n_access, len(list_filter(regexp_extract_all(text, '[0-9a-f]+'), lambda x: length(x) >= 24))::BIGINT AS n_hex
FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)
"""


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op9_quality_rules counts: the part of it that SQL can say."""
    return op9_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUALITY_SQL = r"""
WITH t AS (
    SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[ 	-
]+'), lambda x: x <> '') AS w FROM documents
), i AS (
    SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM t WHERE len(w) >= 8
), g AS (
    SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM i
), twice AS (
    SELECT doc_id, g FROM g GROUP BY doc_id, g HAVING count(*) > 1
), covered AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + 8)) AS k FROM g JOIN twice USING (doc_id, g)
), r AS (
    SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id
), l AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t
), d AS (
    SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^ 	-
]') GROUP BY doc_id
)
SELECT t.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(d.n, 0)::BIGINT AS n_dup_lines,
    coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(w) < 20 OR 100 * coalesce(r.n, 0) > 30 * len(w) AS base_failed
FROM t LEFT JOIN d ON d.doc_id = t.doc_id LEFT JOIN r ON r.doc_id = t.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": OP1_SQL, "op3_ngram_jaccard_join": OP3_SQL, "op5_suffix_dedup": OP5_SQL, "op12_source_divergence": divergence.SQL, "op13_prefix_trie": prefix_trie.SQL, "secret_base_counts": SECRET_SQL, "quality_base_counts": QUALITY_SQL}
