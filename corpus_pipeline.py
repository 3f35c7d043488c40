"""A training corpus from raw documents: five stages, each over all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hearthgauge.llm import bpe, decontaminate, near_duplicates, personal_data, quality_rules
from hearthgauge.llm.queries import TOKENIZER
from hearthgauge.sources.scratch import Scratch


#: Ids given to rows without one begin here.
LATE = 1 << 62


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects. Null and empty texts go; repeated rows and null ids stay as they are, as do all columns."""
    return quality_rules.quality_filter(docs)


def _free(docs: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates; of rows repeated with one doc_id and text, one.

    A row without doc_id counts as after all others, by an id of its text, so it stays only if it is near nothing else,
    and of equal ones one stays. Blank and null texts are near nothing. All columns stay, whatever their names.
    """
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(LATE) + F.xxhash64("text").bitwiseAND(F.lit(LATE - 1)))
    key, text_key = (_free(docs, name) for name in ("near_id", "near_text"))
    rows = docs.withColumns({key: own, text_key: F.xxhash64("text")})
    found = near_duplicates.near_duplicates(rows.select(F.col(key).alias("doc_id"), "text")).where("kept").select(F.col("doc_id").alias(key)).distinct()
    return rows.join(found, key, "left_semi").dropDuplicates([key, text_key]).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an item of the benchmark. Null and empty texts have none; equal rows go or stay alike, with all columns."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars is set anew, other columns and null texts stay."""
    return personal_data.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and the digest of the decoded text, for every row; null texts have no tokens."""
    out = bpe.encode_documents(docs, TOKENIZER, keep=["doc_id", "lang", "source"])
    return out.withColumn("decoded_sha256", F.sha2("decoded", 256)).drop("decoded")


STAGES = [("quality rules", quality), ("near dedup", near_dedup), ("decontamination", decontamination), ("personal data", redaction), ("bpe", tokens)]

#: SQL has neither the merges of the last stage nor the discovered spans; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's rows written before the next reads them."""
    scratch = Scratch(spark, "corpus")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), str(k))
        if k:
            scratch.drop(str(k - 1))
    return docs
