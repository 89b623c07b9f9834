"""The corpus pipeline: documents in, encoded documents out, one operator of seamark.llm per stage.

Each stage takes (spark, docs, sf_dir) and all rows that the one before it kept; all but the last return the
columns of documents. ``run`` writes each stage's rows to the shared folder and reads them again.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamark.llm import decontamination, jaccard_join, language_id, pieces, pii
from seamark.llm.common import bucket, dropped, read, stored_at


#: Rows that go to Python at once in a stage, in bytes: texts are long, and a task holds a batch on both sides.
BATCH_BYTES = 4 << 20


def _small_batches(spark: SparkSession) -> None:
    """From here on the session sends batches of BATCH_BYTES, as a stage's rows are only computed when they are written."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose language can't be told; learns from the rows that op1_language_id learns from."""
    _small_batches(spark)
    return language_id.keep_identified(docs, language_id.fit(docs.where(bucket(F.col("doc_id"), 3) != 1)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near duplicates."""
    _small_batches(spark)
    return jaccard_join.keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that hold a window of a benchmark item."""
    _small_batches(spark)
    return decontamination.remove_documents(docs, read(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; n_chars follows the text."""
    _small_batches(spark)
    clean = pii.redact(docs, pii.fit(docs))
    return clean.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long")))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces texts by their SentencePiece ids."""
    _small_batches(spark)
    out = pieces.encode(docs, pieces.Vocabulary.load())
    return out.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("pii", redact_personal_data),
    ("pieces", encode_pieces),
]

#: Language identification and the encoder can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs, path = stored_at(stage(spark, docs, sf_dir))
        if before:
            dropped(spark, before)
        before = path
    return docs
