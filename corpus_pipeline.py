"""The corpus pipeline: quality filter, near-duplicate removal, decontamination, PII surrogates, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import table, written
from tessera.llm.decontaminate import decontaminated
from tessera.llm.ngram_join import jaccard_components
from tessera.llm.packing import pack
from tessera.llm.pii import pseudonymised
from tessera.llm.quality import kept
from tessera.llm.queries import KEY, vocabulary_file


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the model of trusted text is not too high for their language."""
    return kept(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group of linked documents; rows without a doc_id stay."""
    groups = jaccard_components(docs.where("doc_id is not null"))
    return docs.join(groups.where("doc_id = component_id").select("doc_id"), "doc_id", "left_semi").select(docs.columns).union(docs.where("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data."""
    return pseudonymised(docs, KEY)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces in sequences of at most 1,024."""
    return pack(docs, vocabulary_file("byte_bpe_50k.json"), size=1024, open_bins=1024, end_id=2)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("pii", pii), ("packing", packing)]

#: No stage but PII can be put into SQL (trained model, trie, alignment, tokenizer); tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents, each written and read back before the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
