"""From raw documents to sharded training data: five stages over the table documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; docs has the
columns of documents, and so has every result but the last, which adds the
shard. Stages keep all columns of what they keep, whatever their names; the last
replaces columns named shard, slot or curve_index.

1. quality_classifier: attention-based multiple-instance learning on
   labels.quality; documents that score below the threshold go.
2. near_duplicates: HyperMinHash; of each component one row of the smallest
   doc_id stays. Rows without doc_id or words stay.
3. decontamination: FM-index search for the benchmark's phrases; documents that
   are contaminated (hit words are a twentieth or more) go, others stay as they are.
4. source_mixture: hierarchical budgeting towards MIX_WEIGHTS; one epoch at most,
   so each document stays once or goes; rows without doc_id cannot be chosen and go.
5. sharding: Hilbert curve over source, language and size; equal counts.

An empty or null text passes each stage by the operators' own rules; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import attention_mil, budget, fm_index, hilbert, hyperminhash
from vellum.llm.runtime import Scratch, unused, written  # noqa: F401  written: for the tests

#: Relative weights of the mixture; a value that is not named weighs 1.
MIX_WEIGHTS: dict[str, dict[str, int]] = {"domain": {}, "lang": {"en": 4, "fr": 1, "de": 1, "es": 1}, "source": {}}
#: Share of the tokens that the mixture keeps.
MIX_PERCENT = 90


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return attention_mil.accepted(docs, attention_mil.fit(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return hyperminhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return fm_index.uncontaminated(docs, benchmark)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    levels = {"domain": budget.domain_of(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}
    return budget.drawn(docs, levels, MIX_WEIGHTS, tokens=budget.tokens_of(F.col("text")), budget_percent=MIX_PERCENT)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    sharded = hilbert.hilbert_shards(docs, hilbert.document_axes(size), F.struct("doc_id", F.xxhash64("text")))
    return sharded.withColumn(unused(docs, "size")[0], size)


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", source_mixture),
    ("sharding", sharding),
]

#: SQL does not express the first stages; tests hold each stage against brute force over its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written and read again; the input of the last stage stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark)
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.written(docs, f"stage-{k + 1}")
            scratch.drop(before)
    return docs
