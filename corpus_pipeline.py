"""A training corpus from raw documents: STAGES in order, each written as Parquet and read again as the next one's input.

In every stage a row is a document of its own, also where rows share a doc_id, equal or not; null texts count as empty; texts are whole at
any length; columns other than those of documents are dropped; an empty table gives an empty result. Rows without a doc_id are kept by
no operator and go in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.llm import lines, mixing, neardup, packing, toxicity
from quadrille.llm.workspace import new_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ROW = ["doc_id", "row_hash"]
#: SQL expresses neither learned scores nor the tokenizer.
ORACLE_SQL = None


def keyed(docs: DataFrame) -> DataFrame:
    """The columns of documents, and a hash of them all, which with the doc_id tells rows apart that aren't equal."""
    facts = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in COLUMNS]
    return docs.where(F.col("doc_id").isNotNull()).select(*COLUMNS, F.xxhash64(*facts).alias("row_hash"))


def numbered(rows: DataFrame) -> DataFrame:
    """Equal rows, which a join on ROW has brought together, numbered from 1."""
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy(*ROW).orderBy("n_chars")))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator doesn't reject, whole."""
    docs = keyed(docs)
    found = toxicity.score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=["row_hash"])
    rejected = found.where("predicted = 1").select(*ROW).distinct()
    return docs.join(rejected, ROW, "left_anti").select(COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that a smaller doc_id holds. Documents that lose all their lines stay, as empty texts."""
    kept = lines.dedup_lines(docs, keep=["lang", "source"])
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: a row with the smallest doc_id. Shingles of five words. Texts without words stay."""
    docs = keyed(docs)
    groups = neardup.near_components(docs, keep=["row_hash"]).where("kept")
    alone = groups.where("n_shingles = 0").select(*ROW, F.lit(True).alias("all")).distinct()
    least = groups.where("n_shingles > 0").groupBy("component_id", "doc_id").agg(F.min("row_hash").alias("row_hash"))
    chosen = alone.union(least.select(*ROW, F.lit(False)))
    return numbered(docs.join(chosen, ROW)).where("all or turn = 1").select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: 0, 1 or 2 rows. What equal rows are taken is dealt among them."""
    docs = keyed(docs)
    taken = mixing.mix(docs, keep=["row_hash"]).groupBy(*ROW).agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).where("copies > 0")
    each = numbered(docs.join(taken, ROW)).withColumn("own", F.floor(F.col("copies") / F.col("rows")) + F.when(F.col("turn") <= F.col("copies") % F.col("rows"), 1).otherwise(0))
    return each.where("own > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("own")))).select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("near_duplicates", drop_near_copies), ("source_mix", mix_sources), ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
