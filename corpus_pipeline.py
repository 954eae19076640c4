"""The corpus pipeline: language, near duplicates, benchmark leaks, personal data, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each as Parquet in the shared checkpoint folder and rereads it for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopcast.llm import decontam, langid, pieces, pii, simhash
from shopcast.llm.common import fresh, held_out, table
from shopcast.llm.queries import tokenizer_file
from shopcast.session import scratch_dir


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is clear, with that language as lang; texts without letters and narrow margins go."""
    model = langid.learn(docs.filter(~held_out(F.col("doc_id"))), "text", "lang")
    found = fresh(docs.columns, "_language")
    told = docs.withColumn(found, langid.identify(F.col("text"), model)).filter(~F.col(f"{found}.rejected"))
    return told.withColumn("lang", F.col(f"{found}.lang_pred")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.deduplicate(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found_in = decontam.profiles(table(spark, sf_dir, "benchmark"))
    return docs.filter(F.size(decontam.contamination(F.col("text"), found_in)) == 0)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; n_chars follows."""
    masked = docs.withColumn("text", pii.mask(F.col("text")))
    return masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each text that is left, in merge order: the ids this tokenizer itself gives."""
    coded = pieces.encode(docs.select("doc_id", "lang", "source", "text"), tokenizer_file(), fold="merges")
    return coded.select("doc_id", "lang", "source", F.size("ids").alias("n_tokens"), "ids")


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("PII", mask_personal_data),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: Compression sizes, XXH64 and piece folds have no SQL form; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        path = scratch_dir(spark, f"pipeline-{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
