"""One query for each operator, over the whole tables of a folder."""

from __future__ import annotations

import string

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockledger.llm import bpe, decontaminate, jaccard, knn, langid, lines, lm, merkle, periods, sharding, substrings, tokens, toxicity
from blockledger.llm.staging import shared_path

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Write the corpus as token files, read them back and sum up each document."""
    place = shared_path(spark, "tokens")
    tokens.write_tokens(table(spark, folder, "documents"), WORD_BPE, place, end_id=2)
    read = tokens.read_tokens(spark, place)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """The 5 nearest vectors, by integer inner product, of every 50th one among all."""
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return knn.top_k(rows.where(F.col("vec_id") % 50 == 0), rows, "vec_id", "embedding")


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """How much of every document is in the benchmark, and in which items."""
    docs, items = table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark")
    found = decontaminate.decontaminate(docs, items)
    names = F.sha2(F.array_join("item_ids", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", names.alias("items_sha256"), "contaminated")


def op4_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(bpe.encode_decode(table(spark, folder, "documents"), WORD_BPE))


def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without its repeated runs of lines, as counts and a sum of what is left."""
    docs = lines.drop_repeated_lines(table(spark, folder, "documents").select("doc_id", "text"))
    kept = F.sha2(F.coalesce("text", F.lit("")), 256)
    return docs.select("doc_id", "n_lines", "n_removed", "n_runs", kept.alias("kept_sha256"))


def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the strings of 50 bytes that an earlier one has."""
    found = substrings.drop_repeats(table(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_language(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every text, learnt from the rows outside the held-out fold."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", (langid.fold("doc_id", 5) == 0).alias("held_out"))
    profiles = langid.train(docs.where(~F.col("held_out")))
    return langid.predict(docs.select("doc_id", "text", "held_out"), profiles).drop("text")


def op5_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    """The probability of every text, learnt from the rows outside the held-out fold."""
    return lm.score(table(spark, folder, "documents"))


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """The toxicity of every text, learnt from labels outside the held-out fold."""
    docs = table(spark, folder, "documents").select("doc_id", "text", (langid.fold("doc_id", 3) == 1).alias("held_out"))
    labels = table(spark, folder, "labels").where(langid.fold("doc_id", 3) != 1).select("doc_id", "toxic")
    model = toxicity.train(docs.select("doc_id", "text"), labels)
    return toxicity.predict(docs, model).drop("text")


def op10_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """The component of near duplicates of every document."""
    return jaccard.near_duplicates(table(spark, folder, "documents"), width=4, share=85)


def with_tails(docs: DataFrame) -> DataFrame:
    """`docs` in which every tenth text, by the crc32 of doc_id, ends in a repeated stretch. A null doc_id changes nothing."""
    docs = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    docs = docs.withColumn("w", words).withColumns({"n": F.size("w").cast("long"), "g": F.expr("h div 10")})
    docs = docs.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    docs = docs.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    moved = F.expr("transform(sequence(0L, n - 1), i -> w[cast(if(i < a, i, a + (i - a) % p) as int)])")
    return docs.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(moved, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The periodic runs of every text, a tenth of them given a periodic tail, and the text with each run told once."""
    found = periods.collapse(with_tails(table(spark, folder, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("at"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.withColumn("longest", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.at")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.p")).alias("period"),
        F.expr("1000 * longest.length div -longest.p").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
    return found


def op12_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus in 24 shuffled shards of equal counts, read back from their files."""
    read = sharding.write_shards(table(spark, folder, "documents"), shared_path(spark, "shards"), shards=24, law="rows")
    size, crc = sharding.size_of("text").alias("size"), sharding.crc_of("text").alias("text_crc32")
    return read.select("doc_id", size, crc, F.lit("rows").alias("law"), "shard", "slot", "grown_shard")


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The proof of every row, and whether its content, changed in a third of the rows, still leads to the root."""
    docs = table(spark, folder, "documents")
    tampered = merkle.leaf_digest(text=F.translate("text", string.ascii_uppercase, string.ascii_lowercase))
    claim = F.when(langid.fold("doc_id", 3) == 0, tampered).otherwise(merkle.leaf_digest())
    found = merkle.verify(docs, claim)
    proof = merkle.proof_digest().alias("proof_sha256")
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof, "folded_root", "verified")


QUERIES = {x.__name__: x for x in (op1_token_files, op2_top_k, op3_decontamination, op4_bpe, op5_lm_score, op6_toxicity, op7_line_dedup, op8_substring_dedup, op9_language, op10_jaccard_join, op11_periodic_runs, op12_sharding, op13_merkle_manifest)}
