"""The operators' queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.llm import ann, decontam, idstore, mixing, pii, rollup, sharding, simhash, toxicity, urls
from sparkweave.llm.common import stage


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


def op2_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.search(vectors, F.col("vec_id") % 20 == 0, k=20)


def op3_token_rollup(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """All documents are loaded; exact copies of a document with a smaller id are deleted; English documents that
    stay are recounted with an end id, under a new version; and the load is sent a second time, which changes nothing."""
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text", F.xxhash64("text").alias("h"), F.crc32("text").alias("c"), F.length("text").alias("n"))
    counts = stage(rollup.counted(docs, tokenizer or public_tokenizers.path("word_bpe_49k.json")), "counts")
    firsts = counts.groupBy("h", "c", "n").agg(F.min("doc_id").alias("first_id")).withColumnsRenamed({"h": "h1", "c": "c1", "n": "n1"})
    placed = counts.join(firsts, (F.col("h") == F.col("h1")) & F.col("c").eqNullSafe(F.col("c1")) & F.col("n").eqNullSafe(F.col("n1")))
    copies, kept = placed.where("doc_id > first_id"), placed.where("doc_id <= first_id or first_id is null")
    table, first, second = rollup.new(spark), "word_bpe_49k", "word_bpe_49k+end"
    table.commit("load-1", rollup.deltas(counts, first, "n_tokens"))
    table.commit("copies-1", rollup.deltas(copies, first, "n_tokens", -1))
    table.commit("recount-1", rollup.revised(kept.where("lang = 'en'"), first, "n_tokens", second, F.col("n_tokens") + 1))
    table.commit("load-1", rollup.deltas(counts, first, "n_tokens"))
    return table.totals()


def op4_token_ids(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    root, _ = idstore.encode(_table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return idstore.scan(spark, root)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents"))
    told = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    of_base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    counts = [F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}") for kind in pii.BASE]
    joined = F.array_join(F.transform("spans", told), ",")
    return found.select("doc_id", *counts, F.sha2(F.array_join(F.transform(of_base, told), ","), 256).alias("base_sha256"), joined.alias("spans"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.grade(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


#: The rules of the query.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op7_url_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(_table(spark, sf_dir, "documents"), shards=8)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pareto_mix": op1_pareto_mix,
    "op2_cross_polytope": op2_cross_polytope,
    "op3_token_rollup": op3_token_rollup,
    "op4_token_ids": op4_token_ids,
    "op5_pii": op5_pii,
    "op6_toxicity": op6_toxicity,
    "op7_url_aliases": op7_url_aliases,
    "op8_shards": op8_shards,
    "op9_simhash": op9_simhash,
    "op10_decontaminate": op10_decontaminate,
}
