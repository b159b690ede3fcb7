"""The registered queries opN_<name>: each operator on its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers

from pyspark.sql import functions as F

from ..session import run_dir
from . import (common, compressq, grulm, langid, merkle, mixing, neardup, pieces, rules, secretscan, spelling, suffixes, tokenfile,
               topk)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


@query("op3_sentencepiece")
def op3(spark, sf_dir):
    """Pieces of every document, as counts and digests of the ids and of the decoded text."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), digests=True)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query("op6_token_files")
def op6(spark, sf_dir):
    """Token files of every document, read back: place, length and checksum of its ids."""
    path = run_dir(spark, "tokens")
    tokenfile.write(common.table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    found = tokenfile.read(spark, path, as_bytes=True)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op7_quality_rules", rules.sql())
def op7(spark, sf_dir):
    """Counts and verdicts of the quality rules on every document."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return rules.judge(docs, keep_text=False).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op10_compression_quality")
def op10(spark, sf_dir):
    """Compression score of every document; a fifth of the ids is held out of the fit."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = common.crc_of("doc_id") % 5 == 0
    model = compressq.fit(docs, common.table(spark, sf_dir, "labels").where(~held_out))
    return compressq.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query("op1_language_id")
def op1(spark, sf_dir):
    """Predicted language of every document; a quarter of the ids is held out of the fit."""
    docs = common.table(spark, sf_dir, "documents")
    held_out = common.crc_of("doc_id") % 4 == 2
    model = langid.fit(docs.where(~held_out))
    return langid.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op5_topk_search", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
 FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""")
def op5(spark, sf_dir):
    """The 20 largest inner products of every twentieth vector with all others."""
    return topk.search(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op2_near_duplicates")
def op2(spark, sf_dir):
    """Component of near duplicates of every document."""
    return neardup.near_duplicates(common.table(spark, sf_dir, "documents"))


@query("op9_repeated_substrings")
def op9(spark, sf_dir):
    """Bytes of every document that are left once all repeated 200-byte strings are gone."""
    return suffixes.remove_repeats(common.table(spark, sf_dir, "documents"), plain_files=True)


@query("op8_secret_scan")
def op8(spark, sf_dir):
    """Secrets of every document, by patterns and by the tagger."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secretscan.scan(docs, secretscan.fit(docs)).select("doc_id", "secrets")
    joined = lambda spans: F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("secrets", lambda s: s["kind"] != "tagged")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
                        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


@query("op4_source_mixing", mixing.sql())
def op4(spark, sf_dir):
    """Place of every document in a mix in which no source has more than a third."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs).select("doc_id", "source", *mixing.ADDED)


@query("op11_gru_scores")
def op11(spark, sf_dir):
    """Log-probability of every document; a seventh of the ids is held out of counts and weights."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = common.crc_of("doc_id") % 7 == 2
    return grulm.fit_and_score(docs, held_out).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens",
                                                     "base_score", "score")


@query("op12_spelling_variants")
def op12(spark, sf_dir):
    """Form and root of every word of six letters that occurs five times, with planted deletions."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling.variants(spelling.occurrences(docs).where("n >= 5"))


@query("op13_merkle_manifest", merkle.sql())
def op13(spark, sf_dir):
    """Proof of every document under its source's and the corpus' root, and the fate of tampered texts."""
    return merkle.audit(common.table(spark, sf_dir, "documents"))
