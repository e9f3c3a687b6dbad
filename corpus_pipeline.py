"""From documents to token files: quality, near-duplicates, benchmark leaks, mixing, tokens.

STAGES lists the stages in order. Each takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs. All but the last return the columns of
documents; a document that the mix takes twice is there twice.

Every stage passes on all columns of its input, whatever others are called, takes an empty table (and gives
one), reads texts whole however long they are, and knows a row by its id and its text, so rows that repeat an
id are documents of their own unless their texts are equal too. What each does with nulls and ties stands
with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklake.llm import classifier, decontam, minhash, mixing, token_files
from ticklake.llm.common import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier scores 0.5 or more. Two thirds of the labels teach it, as in its query.

    A null text is scored as an empty one, like a text of no words; equal texts score alike, so ties stay or go together.
    Rows without an id are scored too, but teach nothing; without any label all documents score 0.5 and stay.
    """
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    stats = classifier.measured(docs.where(third != 1))
    return classifier.keep(docs, classifier.fit(stats, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group, by sets of five words and a similarity of 0.8.

    Of a group the least id stays, of rows with that id the one whose text has the least hash, of equal rows one. Rows without
    an id, and those without words (nulls, empty texts), are linked with nothing and stay.
    """
    return minhash.deduplicate(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that hold no benchmark item.

    Null and empty texts hold none and stay; rows without an id are judged by their text like others. Items without an id
    or text don't count; of equal items each does.
    """
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source's share, documents as often as the mix has them.

    A null source is a source, the last one. Null and empty texts have no words: where a source has nothing else its
    target is 0 and its rows go. Equal rank, id and size (repeated rows) are taken or left together.
    """
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token files in the shared folder and reports every document from them.

    A null or empty text is the end id alone. Rows without an id can't be found in the files and are left out; rows that
    repeat one stand side by side, by their text.
    """
    return token_files.digest(spark, docs)


STAGES = [
    ("quality classifier", quality),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing", mix),
    ("token files", tokens),
]

#: SQL can't express the classifier, the similarity groups and the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{k}")
    return docs
