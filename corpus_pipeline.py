"""From raw documents to training shards: five stages, each over all that the one before kept.

quality: rejected documents go. near_duplicates: of each component (five-word shingles, Jaccard 0.8 or more) the
document with the least id stays. benchmark: documents that hold a passage of an item go. mix: documents are repeated
or left out until the sources' words meet their targets. shards: rows get their shard and slot.

Columns of documents may have any names and there may be more of them; every stage takes an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadloom.llm.decontamination import drop_leaked
from threadloom.llm.jaccard import one_of_each
from threadloom.llm.mixing import repeat_documents
from threadloom.llm.quality import keep_good
from threadloom.llm.shared import documents, stored
from threadloom.llm.sharding import shard_columns

NEAR_WORDS, NEAR_PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier doesn't reject; null and empty texts are scored like others, ids may be null or repeat."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component; rows without words all stay, a null or repeated id is no reason to go."""
    return one_of_each(docs, NEAR_WORDS, NEAR_PERCENT)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage of an item, whatever their ids; null and empty texts stay."""
    return drop_leaked(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; a null source is one of the sources, rows without words stay once."""
    return repeat_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with shard and slot, repeated ones each with its own."""
    return shard_columns(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("mix", mix), ("shards", shards)]
ORACLE_SQL = None  # trained models, components and Newton iterations are beyond SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each one's rows written as Parquet in the shared folder and read again by the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
