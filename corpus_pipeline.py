"""The corpus pipeline: quality rules, near-duplicates, decontamination, mixing, token output.

Each stage takes the documents that its predecessor kept; all but the last return
the columns of documents, whatever others there are beside doc_id, text and source.
run() writes each stage's result to the shared folder and reads it back as the next
stage's documents; what a stage wrote meanwhile goes once its result is there.

All stages read whole texts, however long; an empty table passes through as an
empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veinmap import storage
from veinmap.llm import decontam, mixing, quality, simhash, token_output
from veinmap.llm.common import materialize, table
from veinmap.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that pass the fixed rules and the trees. Null and empty texts fail; rows of equal or null doc_id are judged each for itself."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, that of the least id, null ids last. Of rows equal in id and text any one stays; null and empty texts are one group."""
    return simhash.keep_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents and cuts benchmark passages from the others. Null and empty texts stay as they are; without a benchmark nothing changes."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents as the mix takes them. Null texts have size 0, a null source is a source; rows that repeat an id of a source share the decision."""
    return mixing.mix(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files, in order of doc_id, ties by text, and returns what their index says of each document. A null or empty text is the end id alone; an empty table has no files."""
    return token_output.read_index(spark, token_output.write_tokens(docs, tokenizer_path()))


STAGES = [
    ("quality", quality_rules),
    ("simhash", simhash_dedup),
    ("decontamination", decontamination),
    ("mixing", mix_sources),
    ("tokens", token_files),
]

#: SQL has no trees, fingerprints' components or tokenizer; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, began = table(spark, sf_dir, "documents"), storage.written()
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        storage.discard(spark, began, keep=(f"pipeline-{name}",))
    out = STAGES[-1][1](spark, docs, sf_dir)
    storage.discard(spark, began, keep=("tokens",))  # the result reads the token files
    return out
