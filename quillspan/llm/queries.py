"""The operators over their whole tables, as the driver calls them, with SQL where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import chat, decontaminate, imatch, minhash, pieces, secret_scan, substring, surrogates, token_shards, toxicity


#: a real run passes a secret of its own
SURROGATE_KEY = "surrogates of the test tables"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where the box keeps its public tokenizer files."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_minmax_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), words=2, percent=80)


def op4_aho_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("piece_bpe_32k.model")
    back = pieces.decode(pieces.encode(_table(spark, sf_dir, "documents"), path), path)
    return back.select("doc_id", "n_pieces", "ids_crc32", F.sha2("text", 256).alias("decoded_sha256"))


def op5_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    tricky = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], rows.schema)
    parts = C.written(chat.formatted(chat.branches(chat.chained(rows.unionByName(extra)))), "chat")
    return chat.digests(parts).drop("leaf")


def op6_randomness_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(_table(spark, sf_dir, "documents"))


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replaced(_table(spark, sf_dir, "documents"), SURROGATE_KEY).select("doc_id", "n_entities", "text")


def op8_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.compared(_table(spark, sf_dir, "documents"))


def op9_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{C.shared_dir(spark)}/quillspan/shards-{uuid.uuid4().hex}"
    return token_shards.read_shards(token_shards.write_shards(_table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json")))


def op10_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scores = toxicity.scored(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return scores.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "span_starts", "span_ends")


QUERIES = {f.__name__: f for f in (op1_spaced_seeds, op2_substring_dedup, op3_minmax_hash, op4_aho_viterbi, op5_reply_trees, op6_randomness_battery, op7_surrogates, op8_imatch, op9_token_shards, op10_toxic_spans)}

ORACLES = {
    "op2_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        spots AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w),
        win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM spots),
        early AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g),
        gone AS (SELECT DISTINCT win.doc_id, i + j AS p FROM win JOIN early USING (g), (SELECT unnest(range(0, 13)) AS j) WHERE m < doc_id),
        pos AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM pos ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (doc_id)""",
    "op3_minmax_hash": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 2 THEN ws ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh FROM w),
        e AS (SELECT doc_id, unnest(sh) AS x FROM s),
        n AS (SELECT doc_id, len(sh)::BIGINT AS n_shingles FROM s),
        i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM e a JOIN e b USING (x) WHERE a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM i JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * inter >= 80 * (na.n_shingles + nb.n_shingles - inter)),
        two AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r(doc_id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT two.b, r.c FROM r JOIN two ON two.a = r.doc_id)
        SELECT n.doc_id, n_shingles, min(c) AS component_id, n.doc_id = min(c) AS kept FROM n JOIN r USING (doc_id) GROUP BY n.doc_id, n_shingles""",
}
