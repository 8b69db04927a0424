"""Queries of the operators in this package, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithoframe.llm import fertility, html_text, impact_search, language, line_crf, merkle, mixing, ngram_join, packing, pitman_yor, sharding, spelling, toxicity
from lithoframe.llm.common import remainder, table
from lithoframe.llm.oracles import MERKLE, SPELLING


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_text.extract(pages, html_text.learn(pages)).select("page_id", "url", "text", "n_chars")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 4) == 2
    model = language.learn(docs, ~held_out)
    return language.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op3_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return impact_search.search(vectors.filter(F.col("vec_id") % 50 == 0), vectors)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = remainder("doc_id", 5) == 0
    model = toxicity.learn(docs, labels.filter(~held_out))
    return toxicity.score(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), "score", "predicted")


def op5_token_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.judge(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), settings=packing.Settings(words=524_288))


def op7_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    done = sharding.shard(docs, ["lang", "source", "size", "doc_id"], ["doc_id", "text_crc32", "size"])
    return done.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"), "curve")


def op8_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target",
                                   (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_similar(table(spark, sf_dir, "documents"))


def op10_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = remainder("doc_id", 5) == 0
    model = line_crf.learn(docs, labels.filter(~held_out))
    return line_crf.score(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), "score", "predicted", "good_share", "n_lines")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.when(remainder("doc_id", 2) == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    done = merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "source", "doc_id", {"text": tampered})
    return done.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = pitman_yor.score(docs, remainder("doc_id", 5) != 1)
    return scored.withColumn("learnt", ~F.col("learnt")).withColumnRenamed("learnt", "held_out")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("_text"))
    found = spelling.runs(docs, "_text", spelling.Settings().least)
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("_run")).cast("binary"))
    damaged = found.withColumn("_h", h).withColumn("_run", F.when(
        F.col("_h") % 31 == 0, spelling.without(F.col("_run"), (F.col("_h") % F.length("_run") + 1).cast("int"))).otherwise(F.col("_run")))
    return spelling.group(spelling.counted(damaged))


QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_language_id, op3_impact_search, op4_toxicity, op5_token_fertility, op6_best_fit_packing, op7_hilbert_shards, op8_pareto_mix, op9_ngram_join,
                                 op10_line_crf, op11_merkle_manifest, op12_pitman_yor, op13_spelling_variants)}
ORACLES = {"op3_impact_search": """
WITH sound AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM sound q JOIN sound c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5""", "op11_merkle_manifest": MERKLE, "op13_spelling_variants": SPELLING}
