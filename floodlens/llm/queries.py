"""Queries of the corpus operators over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodlens.llm import (
    edit_counts, exact_dedup, hard_negatives, html_text, mixing, packing, paragraph_dedup, periodic_runs, pivot_search, simhash, token_store, toxicity,
    word_bpe,
)
from floodlens.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(read(spark, sf_dir, "documents"))


@query("op2_html_extraction")
def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query("op3_substring_dedup")
def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_dedup.repeated_spans(read(spark, sf_dir, "documents")).drop("text_key")


@query("op4_exact_top_k", pivot_search.top_k_sql())
def exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_search.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op5_token_store")
def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.read_back(token_store.write(read(spark, sf_dir, "documents")))


@query("op6_exact_dedup", """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)""")
def exact_dedup_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


@query("op7_edit_counts")
def edited_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document gets two edits: some characters give way to the name of its source, and its beginning is put in again."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "source")
    n, h = F.length("text"), F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))

    def change(start, length, text):
        return F.struct(start.cast("int").alias("start"), length.cast("int").alias("length"), text.alias("text"))

    edits = F.array(
        change(F.floor(n * (h % 97) / 97), h % 41, F.coalesce("source", F.lit(""))),
        change(F.floor(n * (h % 89) / 89), F.lit(0), F.substring("text", 1, 80)))
    docs = edit_counts.with_trees(docs.withColumn("edits", edits))
    return edit_counts.apply_edits(docs, "edits").select("doc_id", "n_tokens_before", "n_tokens", "n_encoded")


@query("op8_toxicity")
def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, read(spark, sf_dir, "labels")))


@query("op9_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


@query("op10_source_mix", mixing.mix_sql())
def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(read(spark, sf_dir, "documents"))


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with a period planted in a tenth of the documents: from a word on, a stretch of words repeats to the end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    docs = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), words.alias("words")).withColumn("n", F.size("words"))
    docs = docs.withColumn("a", F.when(F.col("n") > 0, F.expr("cast(g % n as int)")))
    docs = docs.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    repeated = F.expr("concat(slice(words, 1, a), slice(flatten(array_repeat(slice(words, a + 1, p), cast(ceil((n - a) / p) as int))), 1, n - a))")
    return docs.select("doc_id", F.when(F.col("n") > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs")
def periodic_run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(with_planted_periods(read(spark, sf_dir, "documents")))
    before = "l.length * r.period > r.length * l.period or l.length * r.period = r.length * l.period and (l.start < r.start or l.start = r.start and l.period < r.period)"
    best = F.expr(f"try_element_at(array_sort(runs, (l, r) -> case when l = r then 0 when {before} then -1 else 1 end), 1)")
    lines = F.expr("array_join(transform(runs, r -> concat(concat_ws(',', r.start, r.length, r.period), '\n')), '')")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.expr("1000 * best.length div best.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op12_word_bpe")
def word_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = word_bpe.encode(read(spark, sf_dir, "documents"))
    decoded = word_bpe.decode(encoded, word_bpe.token_bytes(spark))
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op13_hard_negatives", hard_negatives.hard_negatives_sql())
def mined_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = read(spark, sf_dir, "embeddings").withColumn("label", label)
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 50 == 0)
