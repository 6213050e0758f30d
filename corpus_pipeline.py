"""A training corpus in five stages; each takes the documents that the one before kept.

1 quality rules reject documents, 2 the n-gram Jaccard join keeps one document of each component,
3 suffix-array dedup removes passages that earlier documents have, 4 mixing repeats or drops
documents to meet each source's target, 5 packing places the tokens of what is left in sequences.

Stages 1 to 4 return the columns of documents, whatever further columns those have. A stage has run
once its result is stored, and the next one starts from there.

Defined cases, stage by stage. 1: a null or empty text has no words and goes. 2: a null or empty text
and a null id link with nothing and stay; rows that repeat an id stay or go together. 3: a null or
empty text stays as it is; texts that lose all their bytes go; of rows that share an id none removes
from another. 4: a null source is a source of its own; a document without words takes no words; a row
that repeats another is a document of its own. 5: a null text gives a piece with the end id alone.
Texts of any length are taken whole; an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import jaccard_join, mixing, packing, quality, suffix_dedup
from tidemark.llm.common import written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that fail the base rules or the likelihood ratio."""
    return quality.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component."""
    found = jaccard_join.joined(docs)
    others = found.filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated passages. A character that a cut has split goes with the passage; texts left empty go."""
    out = suffix_dedup.without_repeats(docs, whole_chars=True)
    cut = F.size("_starts") > 0
    rest = out.withColumn("text", F.when(cut, F.col("_kept").cast("string")).otherwise(F.col("text"))).filter(~cut | (F.length("text") > 0))
    return rest.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document once for each copy that the mix takes."""
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packing.packed(docs, packing.tokenizer_path())


STAGES = [("quality rules", quality_stage), ("n-gram Jaccard join", jaccard_stage), ("suffix-array dedup", suffix_stage), ("mixing", mixing_stage), ("best-fit packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}")
    return docs


ORACLE_SQL = None
