"""The corpus pipeline: quality classifier, toxicity, near duplicates, packing, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import near_dedup, packing, quality_classifier, toxicity
from graphloom.llm.common import fresh_path, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near copies link from this similarity on, in per cent.
PERCENT = 80


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject, every row with its own columns. Without usable labels all stay; null and
    empty texts are judged by their measures like any other; an empty table stays empty."""
    model = quality_classifier.train(stored(quality_classifier.measured(docs), "measured"), _labels(spark, sf_dir))
    if model is None:
        return docs.select(*COLUMNS)
    rows = quality_classifier.measured(docs, keep=COLUMNS)
    kept = rows.where(model.probability() >= quality_classifier.THRESHOLD)
    return kept.select(*[F.col(f"kept_{c}").alias(c) for c in COLUMNS])


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't judged toxic, every row with its own columns. Without usable labels, or without any text, all stay."""
    return toxicity.clean(docs.select(*COLUMNS), toxicity.train(docs, _labels(spark, sf_dir)))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the least id, one row of it. A group without any id keeps one of
    its rows. Texts without words are in no group: each id keeps one, and so does each such text with a null id."""
    null = F.col("doc_id").isNull()
    worded = F.col("n_shingles") > 0
    unit = F.when(null, F.when(worded, F.col("component").cast("string")).otherwise(F.hex("row")))
    kept = near_dedup.grouped(docs, percent=PERCENT).where("kept").groupBy("doc_id", unit.alias("unit"), (null & worded).alias("in_group"))
    kept = kept.agg(F.min(F.struct(~worded, "row")).alias("best")).select("best.row")
    rows = docs.select(*COLUMNS, near_dedup.row_key(F.col("doc_id"), F.col("text")).alias("row"))
    rows = rows.where(~null).unionByName(rows.where(null).dropDuplicates(["row"]))  # copies without an id would meet in one task
    return rows.join(kept, "row", "left_semi").dropDuplicates(["row"]).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 ids. A null or empty text is one closing id; an empty table gives no rows."""
    import public_tokenizers

    return packing.pack_digests(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("toxicity", toxic), ("near_dedup", dedup), ("packing", pack)]
#: The fitted models can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of sf_dir, each written as Parquet in the shared folder and read back by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = fresh_path(spark, f"stage-{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
