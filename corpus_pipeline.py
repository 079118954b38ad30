"""A training corpus from raw documents: five stages, each over all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns the columns of `documents`, whatever other columns
docs has; the last one returns the packed pieces. `run` writes each stage's rows to the shared folder
and reads them again. An empty table passes through every stage as an empty one, without labels no
document goes in the first, and without a benchmark none in the fourth. Very long texts are worked on
whole, each by one worker.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.jaccard_join import link
from tidemark.llm.packing import pack
from tidemark.llm.phrase_index import find_contamination
from tidemark.llm.quality import grade, learn_quality
from tidemark.llm.queries import tokenizer_path
from tidemark.llm.shared import plain_columns, stored, table
from tidemark.llm.substring_dedup import remove_repeats
from tidemark.sources.shipping import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier takes for the lowest grade go.

    Each row is judged by its own text; null and empty texts get the model's score for no evidence. A
    probability of exactly one half stays. Repeated rows and null ids stay or go like any other.
    """
    ship(spark)
    model = learn_quality(docs, table(spark, sf_dir, "labels"))
    return grade(docs, model, carry=["lang", "source", "n_chars", "text"]).where("keep").select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, that with the smallest id stays.

    Rows that share an id are one document; of those that also share the text, the least by lang, source
    and n_chars stays. Rows without an id, and null and empty texts, link with nothing and stay. A
    similarity of exactly 0.75 links.
    """
    ship(spark)
    groups = link(docs)
    dropped = stored(groups.where("component_id <> doc_id").select("doc_id").distinct())
    kept = docs.join(dropped, "doc_id", "left_anti").select(*COLUMNS)
    repeated = docs.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").limit(1).count()
    if repeated:
        once = kept.where("doc_id IS NOT NULL").groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("rest"))
        kept = once.select("doc_id", "text", "rest.*").select(*COLUMNS).unionByName(kept.where("doc_id IS NULL"))
    return kept


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that an earlier document has go; so do documents of which no word is left.

    What is left is words joined by one space, so line breaks go; n_chars counts that text. Null texts
    become empty. Rows without an id keep their words; rows that share an id are no source for each other.
    """
    ship(spark)
    kept = remove_repeats(docs, with_text=True, carry=["lang", "source"]).where("n_words = 0 OR n_removed < n_words")
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go.

    Null and empty texts hold nothing and stay; each row is judged by its own text, with or without an id.
    """
    ship(spark)
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"), carry=["lang", "source", "n_chars", "text"])
    return found.where("NOT contaminated").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their place in sequences of 4096 ids; every row, also a null or empty text, is a document."""
    ship(spark)
    return pack(docs, tokenizer_path())


STAGES = [("quality", quality), ("near_copies", near_copies), ("repeats", repeats), ("leaks", leaks), ("packing", packing)]
#: Models and tokens aren't SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = plain_columns(table(spark, sf_dir, "documents"), *COLUMNS)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
