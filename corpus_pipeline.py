"""The corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of ``documents``.

Defined results, for every stage: an empty table gives an empty table. Null, empty
and blank texts are texts without words; they leak nothing, hold no personal data and
are packed as their end id. Texts are read whole at any length. Null ids take part; a
null in another column (lang, source, n_chars) and columns of any other name or type
change no decision and are passed on as they are, also where they bear a name that an
operator uses itself. Rows are judged one by one, so repeated rows share their fate,
but for ``near_duplicates``, which leaves one. Ties are decided by the smallest id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwash.llm import decontam, packing, pii, simhash
from ledgerwash.llm import toxicity as tox
from ledgerwash.llm.scratch import owned, written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labels of the
    documents at hand; the held-out fifth never trains it. Several labels of an id: the
    largest. Null ids, null labels and labels of no document teach nothing; with labels of
    one kind only, or none, nothing is rejected."""
    model = tox.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(tox.toxicity_score(F.col("text"), model) < 0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id stays of each group of linked fingerprints; a null
    id is larger than all others. Texts without words are one group. Of rows that repeat
    the id and the fingerprint that stay, the first by their columns stays."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go. Items without text or of fewer words
    than a shingle are not searched for; an empty benchmark keeps all documents."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind; n_chars follows. A null text stays
    null, and its n_chars is null."""
    masked = docs.withColumn("text", pii.redacted(F.col("text")))
    return masked.withColumn("n_chars", F.length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens. Repeated rows are packed each;
    a null id stays null."""
    return packing.pack(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("personal_data", personal_data), ("packing", packed)]

# A trained classifier and a tokenizer are beyond SQL; the tests hold the stages
# against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``. Tables that operators write go with their stage;
    what a stage keeps belongs to the caller (see ``scratch.owned``)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with owned(spark) as tables:
            docs = tables.kept(written(stage(spark, docs, sf_dir), name))
    return STAGES[-1][1](spark, docs, sf_dir)
