"""The contract queries of the text operators and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import format_chats, read_loss, read_turns
from .embedding_dedup import near_duplicate_vectors
from .exact_dedup import exact_dedup
from .fim import fill_in_middle, restored
from .html import extract
from .langid import fold_of, identify, learn
from .media import digest_media, store_texts
from .mixing import mix
from .ngram_lm import score, train
from .packing import pack_documents
from .shared import load
from .simhash import near_duplicates
from .warc import read_archives, write_archives
from .whitening import whiten


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_media(store_texts(load(spark, sf_dir, "documents")))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(load(spark, sf_dir, "pages"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(load(spark, sf_dir, "documents").select("doc_id", "text"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    held_out = fold_of(F.col("doc_id"), 3) == 1
    filters = learn(docs.where(~held_out).select("text", "lang"))
    return identify(docs, filters).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = read_archives(write_archives(load(spark, sf_dir, "pages").select("page_id", "url", "html")))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "warc_date")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    held_out = fold_of(F.col("doc_id"), 7) == 2
    model = train(docs.where(~held_out).select("text"))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(load(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(load(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(probe).alias("text"),
    )
    chats = format_chats(rows.unionByName(more))
    back = chats.select("conv_id", "formatted", "valid", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("segments")).alias("loss"))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(load(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(load(spark, sf_dir, "embeddings"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(load(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_warc, op3_lm_scoring, op4_mixing, op5_best_fit_packing, op6_simhash_near_dedup, op7_media_columns, op8_html_extraction, op9_exact_dedup, op10_chat_formatting, op11_fill_in_middle, op12_embedding_near_dedup, op13_whitening)}


SQL = {
    "op2_warc": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages)
        SELECT page_id, strlen(html) AS payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + ((('0x' || substr(h, 1 + 5 * (i // 4)::INTEGER, 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31), 1)), '') AS payload_digest,
               CASE WHEN page_id = min(page_id) OVER (PARTITION BY html) THEN 'response' ELSE 'revisit' END AS record_type,
               nullif(min(page_id) OVER (PARTITION BY html), page_id) AS refers_to,
               strftime(make_timestamp((946684800 + page_id % 600000000) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS warc_date
        FROM p""",
    "op4_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                   ('0x' || substr(md5('mix' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS place
            FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight,
                     source_size::DOUBLE * 3.0::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE AS total FROM s),
        r AS (SELECT *, cap / weight AS ratio FROM w),
        l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                     / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM r),
        t AS (SELECT source, source_size, least(cap, max(share) OVER () * weight) AS target FROM l),
        p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size::DOUBLE)::BIGINT ELSE 0 END AS copies FROM t),
        b AS (SELECT *, target - (copies * source_size)::DOUBLE AS budget FROM p),
        c AS (SELECT d.*, b.* EXCLUDE (source),
                     sum(size) OVER (PARTITION BY d.source ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS after,
                     sum(size) OVER (PARTITION BY d.source, place) AS own
              FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source),
        k AS (SELECT *, least(3, copies + CASE WHEN budget > 0 AND (after <= budget OR
                     (after - own <= budget AND after - budget < budget - (after - own))) THEN 1 ELSE 0 END)::INTEGER AS n FROM c)
        SELECT doc_id, size, source_size, target, (size * n)::BIGINT AS taken, n AS copies FROM k""",
    "op10_chat_formatting": r"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        e AS (SELECT *, len(regexp_extract_all(text, '\\\\|<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|<s>|</s>|<<TURN>>|<</TURN>>|<</ROLE>>'))
                        AS escapes,
                     CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 END AS marks,
                     lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM c)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(marks + length(text) + escapes)::BIGINT AS formatted_chars,
               bool_and(coalesce(before, 'start') || '>' || role IN
                   ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user')) AS valid
        FROM e GROUP BY conv_id""",
    "op9_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, length(coalesce(text, '')) AS len,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
            FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER (PARTITION BY norm ORDER BY len DESC, doc_id) AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = first_value(doc_id) OVER (PARTITION BY norm ORDER BY len DESC, doc_id) AS kept,
               sha256(norm) AS text_sha256
        FROM n""",
    "op11_fill_in_middle": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
        h AS (SELECT *, len(u)::BIGINT AS n, ('0x' || s[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || s[9:16])::BIGINT % (len(u) + 1) AS b,
                     CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || s[17:24])::BIGINT % 100 >= 90 THEN 'plain'
                          WHEN ('0x' || s[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
        p AS (SELECT *, array_to_string(u[1:least(a, b)], '') AS pre, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS mid, array_to_string(u[greatest(a, b) + 1:], '') AS suf FROM h)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
               sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE text END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM p""",
}
