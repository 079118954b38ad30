"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, each over its whole tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import sql
from tidemark.llm.jaccard_join import link
from tidemark.llm.langid import learn_languages, predict
from tidemark.llm.lexical import rank_documents
from tidemark.llm.license_templates import BASE, TEMPLATES, scan
from tidemark.llm.media import copies_of, picture_table
from tidemark.llm.merkle import manifest, without_line_feeds
from tidemark.llm.packing import pack
from tidemark.llm.phrase_index import find_contamination
from tidemark.llm.quality import grade, learn_quality
from tidemark.llm.shared import scratch, table
from tidemark.llm.simhash import near_copies
from tidemark.llm.substring_dedup import remove_repeats
from tidemark.llm.toxicity import learn_toxicity, score_toxicity
from tidemark.llm.warc import read_archives, write_archives
from tidemark.sources.shipping import ship


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, learn_languages(docs))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark)
    write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), near=20)


def op6_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies_of(picture_table(table(spark, sf_dir, "embeddings")))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return grade(docs, learn_quality(docs, table(spark, sf_dir, "labels")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, learn_toxicity(docs, table(spark, sf_dir, "labels")))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("spans")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    changed, where = without_line_feeds(docs)
    return manifest(docs, changed=changed, where=where)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))


def shipped(f):
    """The query, after the package is sent to the workers."""

    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return run


_ALL = (op1_substring_dedup, op2_packing, op3_language_id, op4_warc, op5_benchmark_decontamination, op6_media_copies, op7_quality, op8_toxicity, op9_license_scan, op10_jaccard_join, op11_merkle_manifest, op12_ranked_search, op13_simhash)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: shipped(f) for f in _ALL}
ORACLE_SQL = {"op1_substring_dedup": sql.REPEATS, "op4_warc": sql.ARCHIVED, "op5_benchmark_decontamination": sql.CONTAMINATION, "op9_license_scan": sql.licenses(BASE, TEMPLATES), "op10_jaccard_join": sql.NEAR_COPIES, "op11_merkle_manifest": sql.MANIFEST, "op12_ranked_search": sql.RANKED}
