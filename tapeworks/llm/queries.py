"""The registered queries of the training-data operators: thin wrappers that read whole tables and
derive the digest columns from the operators' own output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.llm import conversations, decontam, langid, licenses, lines, packing, phrases, pii, quality, sharding, simhash, substring, warc
from tapeworks.llm.common import fresh_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where the executors find a public vocabulary; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Arrivals that the documents are dealt to, as if each had come on its own.
ARRIVALS = 8
KEY = "tw__arrival"


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appends the documents as arrivals, compacts the shards, and reads the newest version back."""
    docs = table(spark, sf_dir, "documents")
    dataset = sharding.Dataset(spark, fresh_dir(spark, "shards"))
    dataset.append(docs.withColumn(KEY, F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS))), key=KEY)
    dataset.compact()
    dataset.vacuum()
    return dataset.read().select("doc_id", "lang", "source", "n_chars", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), docs.where(langid.in_training(F.col("doc_id"))).select("text", "lang"))
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "__tw_lang.lang_pred", "__tw_lang.score")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: its repeated stretches (first byte:bytes), and the documents that keep them."""
    found = substring.repeated_runs(table(spark, sf_dir, "documents"))
    stretches = F.transform("runs", lambda x: F.concat_ws(":", x["at"].cast("string"), x["size"].cast("string")))
    return found.select(
        "doc_id", "n_bytes", F.size("runs").cast("long").alias("n_runs"),
        F.aggregate("runs", F.lit(0).cast("long"), lambda acc, x: acc + x["size"]).alias("dropped_bytes"),
        F.array_join(stretches, ",").alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.transform("runs", lambda x: x["keepers"])))).alias("kept_in"),
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.kept_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = decontam.overlap_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return report.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        "n_near",
    )


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    counts = [pii.count_of(F.col("base"), kind).alias(f"n_{kind}") for kind in pii.PATTERNS]
    return found.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_dir(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), folder).write.format("noop").mode("overwrite").save()
    read = warc.read_archives(spark, folder, payloads=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), with_ids=False)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.verdicts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "kept", *quality.MEASURES)


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repaired(table(spark, sf_dir, "conversations"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    named = lambda c: F.array_join(F.array_sort(c), ",").alias(c)
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", named("base_labels"), named("labels"), F.round("score", 6).alias("score"))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_language_id": op2_language_id,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_line_dedup": op4_line_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_pii": op6_pii,
    "op7_simhash": op7_simhash,
    "op8_warc": op8_warc,
    "op9_packing": op9_packing,
    "op10_quality": op10_quality,
    "op11_phrases": op11_phrases,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_license_scan": op13_license_scan,
}
