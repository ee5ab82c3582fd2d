"""The operators applied to the sample tables, as named queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.llm import divergence, hard_negatives, language_id, lm, mixing, near_dup, packing, quality_classifier, quality_rules, secrets, toxicity, vectors, warc
from broadsheet.llm._common import fold_of
from broadsheet.llm.checks import CHECKS  # noqa: F401

PLANS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(plan):
    PLANS[plan.__name__] = plan
    return plan


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out_fold(fold: int):
    return fold_of(F.col("doc_id")) == fold


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    train = ~held_out_fold(0)
    lexicon = toxicity.learn(docs.filter(train), labels.filter(train))
    scored = toxicity.score(docs, lexicon)
    return scored.select("doc_id", held_out_fold(0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_hits")


@query
def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), words=3, threshold=85)


@query
def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    base = [r.kind for r in secrets.BASE]

    def joined(matches):
        return F.array_join(F.transform(matches, lambda m: F.concat_ws(":", m["kind"], m["start"].cast("string"), m["end"].cast("string"))), ",")

    def number(kind):
        return F.size(F.filter("matches", lambda m: m["kind"] == kind)).cast("long").alias(f"n_{kind}")

    digest = F.sha2(joined(F.filter("matches", lambda m: m["kind"].isin(base))), 256)
    return found.select("doc_id", *[number(k) for k in base], digest.alias("base_sha256"), joined("matches").alias("spans"))


@query
def op4_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


@query
def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = lm.fit(docs.filter(~held_out_fold(1)))
    scored = lm.score(docs, model)
    return scored.select(
        "doc_id", held_out_fold(1).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity"
    )


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_measures")


@query
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the rated rows outside fold 0."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    train = ~held_out_fold(0)
    model = quality_classifier.fit(docs.filter(train), labels.filter(train).withColumn("grade", quality_classifier.grade_of(F.col("quality"), F.col("toxic"))))
    scored = quality_classifier.score(docs, model)
    return scored.select("doc_id", held_out_fold(0).alias("held_out"), "expected_grade", "tail_probability", (F.col("tail_probability") >= 0.5).alias("kept"))


def domains_of(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and domain of the rated rows."""
    rated = labels.select(F.col("doc_id").alias("l_id"), "quality").join(docs.select("doc_id", "lang"), F.col("l_id") == F.col("doc_id"))
    return rated.select("doc_id", mixing.label_domain(F.col("quality"), F.col("lang")).alias("domain"))


@query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rates = mixing.mix(docs, domains_of(docs, table(spark, sf_dir, "labels")), max_rate=None, total=1.0)
    return rates.withColumn("copies", mixing.copies(F.col("doc_id"), F.col("rate")))


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    records, _ = warc.read_archives(warc.write_archives(pages))
    kind = pages.schema["page_id"].dataType
    key = F.when(F.col("record_id") != "", F.col("record_id")).cast(kind)
    return records.select(key.alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


@query
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


@query
def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.learn(docs.filter(~held_out_fold(0)))
    judged = language_id.identify(docs, model)
    return judged.select("doc_id", held_out_fold(0).alias("held_out"), "lang_pred", "score", "ambiguous")


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=shifted)
