"""The corpus pipeline: quality, near duplicates, benchmark, personal data, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the documents of the next. All but the last return the columns of `documents`.

Empty tables pass through. Null texts count as empty ones: they are scored as such, link with
other texts without words, hold no benchmark item and no entity, and have null ids at the end.
Rows with a null doc_id are kept by decisions that name documents by their ids.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftlab.llm import decontaminate, pii, piece_model, quality, simhash
from shiftlab.llm.common import checkpoint_dir, delete, scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects; it learns from all labelled ones of the input."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), held_out=False)
    return quality.score(docs, model).where("quality_predicted = 1").select(*docs.columns)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies the document with the smallest id, and of rows that repeat it the first in order of all columns.

    SimHash fingerprints within three bits are linked by multi-index hashing, and texts with more edits, which no ball around a segment reaches, by a five-word Jaccard similarity of 0.8.

    Rows with a null id stay, as no decision can name them.
    """
    kept = simhash.similar(docs, radius=simhash.RADIUS).where("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept_n")).withColumnRenamed("doc_id", "kept_id")
    own = docs.join(kept, F.col("doc_id") == F.col("kept_id"))
    rest = [c for c in docs.columns if c != "doc_id"]
    repeated = own.where("kept_n > 1").groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("row")).select("doc_id", *[F.col(f"row.`{c}`").alias(c) for c in rest]).select(*docs.columns)
    return own.where("kept_n = 1").select(*docs.columns).unionByName(repeated).unionByName(docs.where("doc_id is null"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    found = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces entities by surrogates; `n_chars` follows the text."""
    return pii.surrogates(docs).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long"))).select(*docs.columns)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of each text, and whether decoding gives the text again."""
    done = piece_model.encoded(docs)
    return done.select("doc_id", "lang", "source", F.coalesce(F.size("piece_ids"), F.lit(0)).alias("n_ids"), F.col("piece_ids").alias("ids"), "round_trip")


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", simhash_stage),
    ("benchmark decontamination", decontamination_stage),
    ("PII surrogates", pii_stage),
    ("SentencePiece", pieces_stage),
]

#: Five stages, of which SQL can express none as a whole; tests/llm/test_pipeline.py holds a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents of `sf_dir`. What stages write on the way is deleted as soon as the next one has read it."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(f"{folder}/{i}")
        if i:
            delete(spark, f"{folder}/{i - 1}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{i}")
    return docs
