"""The registered queries of the numbered operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookpulse.llm import chat, classifier, exact_dedup, html, langid, mixing, negatives, pieces, pii, quality, simhash, spelling, toxicity
from bookpulse.llm.common import table


def fold(parts: int) -> Column:
    """The remainder of the checksum of a document's id as text; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % parts


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    keep = [F.col("doc_id"), (fold(4) == 2).alias("held_out")]
    scored = toxicity.score(docs, labels, fold(4), (0, 1), (3,), keep)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents")).drop("longest_repeat")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_components(table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string"
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.format_conversations(rows))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(3) == 1
    learned = langid.profiles(docs.where(~held_out).select("lang", "text"))
    return langid.detect(docs, learned, [F.col("doc_id"), held_out.alias("held_out")])


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"))


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    learned = classifier.fit(docs.where(fold(5) != 0), labels.where(fold(5) != 0))
    scored = classifier.score(docs, learned, [F.col("doc_id"), (fold(5) == 0).alias("held_out")])
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_groups(spelling.variant_counts(table(spark, sf_dir, "documents")))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    # Kept as doubles: a whole number in them is exact, and one beyond all longs stays what it is.
    whole = F.transform("embedding", lambda x: F.when(F.abs(x) < 2.0**40, F.floor(x.cast("double") * 256).cast("double")).otherwise(x.cast("double") * 256))
    rows = vectors.select(F.col("vec_id").alias("id"), moved.alias("label"), whole.alias("vector"))
    return negatives.hard_negatives(rows, F.col("id") % 100 == 0)


QUERIES = {
    f.__name__: f
    for f in (
        op1_pii,
        op2_toxicity,
        op3_exact_dedup,
        op4_mixing,
        op5_quality,
        op6_simhash,
        op7_chat_format,
        op8_language_id,
        op9_html_extract,
        op10_sentencepiece,
        op11_quality_classifier,
        op12_spelling_variants,
        op13_hard_negatives,
    )
}
