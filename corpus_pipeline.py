"""A training-data pipeline over ``documents``: quality, near duplicates, secrets, mixture, pieces.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all rows that the stage before it kept; all but the
last return the columns of their input. Null and repeated rows, empty texts and empty tables are handled as the
operators in ``tidepanel.llm`` say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidepanel.llm import common, mixing, neardup, pieces, rules, secretscan


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return rules.judge(docs).where("kept").select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: one with the least id. Rows with a null or a repeated id are
    told apart by their texts."""
    return neardup.deduplicated(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of the texts; n_chars follows."""
    out = secretscan.scan(docs, secretscan.fit(docs), redact="[SECRET]")
    changed = F.size("secrets") > 0
    return out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(
        F.col("n_chars"))).select(docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in mixed order, a single one at a time; what is left of a source with over a third of all comes
    last, with gaps."""
    mixed = mixing.mix(docs, block_rows=1)
    return mixed.repartitionByRange(common.partitions(docs), "position").sortWithinPartitions("position") \
        .select(docs.columns)


def _numbered(docs: DataFrame) -> DataFrame:
    """Add position: the place of a row (from 0) in the order in which the stage before stored the rows. Reading does not
    keep that order; file names and places in files tell it. Rows that are not stored keep the order they have."""
    try:
        rows = docs.select(*docs.columns, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:
        return docs.withColumn("position", F.monotonically_increasing_id())
    files = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_rows"))
    past = Window.orderBy(F.length("_file"), "_file").rowsBetween(Window.unboundedPreceding, -1)     # one row per file
    files = files.select("_file", F.coalesce(F.sum("_rows").over(past), F.lit(0)).alias("_before"))
    return rows.join(files, "_file").withColumn("position", F.col("_before") + F.col("_row")).select(*docs.columns, "position")


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids and their byte spans of every document, and its position in the mixture: whoever takes documents by
    position meets the sources in their target shares."""
    return pieces.encode(_numbered(docs), public_tokenizers.path("piece_bpe_32k.model")).drop("decoded")


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("secret_scan", secret_scan),
          ("source_mixing", source_mixing), ("sentencepiece", sentencepiece)]

#: The secret tagger and the tokenizer have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.stored(docs, f"pipeline-{name}")
    return docs
