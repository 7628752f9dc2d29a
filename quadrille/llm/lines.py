"""Line deduplication against levelled sorted runs of line hashes, in DataFrame operations only."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import new_path

BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORTEST = 10
#: Batches at least, and documents of a batch at most.
BATCHES, BATCH_DOCS = 4, 20_000_000
FANOUT = 3
KEY = ["h1", "h2"]
ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def line_key(line):
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


def row_key():
    """Tells rows that share a doc_id apart by their texts."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def line_hashes(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, row, pos, and the 128-bit hash (h1, h2) of every line whose key has at least `shortest` code points; other columns stay."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "row")]
    lines = docs.select("doc_id", "row", *rest, F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    keyed = lines.select("doc_id", "row", "pos", *rest, line_key(F.col("line")).alias("key")).where(F.char_length("key") >= shortest)
    return keyed.select("doc_id", "row", "pos", *rest, F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"))


class Runs:
    """Levels of sorted runs of line hashes: a new run enters level 0; FANOUT runs of a level are merged into one of the next.

    A run is a table of the shared folder, bucketed and sorted by its hashes with one file a bucket. So a batch's anti-join merges its
    own hashes, dealt once, with runs that are neither dealt nor sorted again, and compaction merges runs bucket by bucket. Runs hold
    disjoint hashes. drop() takes the tables from the catalog.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, fanout: int = FANOUT):
        self.spark, self.root, self.fanout = spark, root or new_path(spark, "line-runs"), fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.names: list[str] = []

    def tables(self) -> list[DataFrame]:
        """h1, h2 of each run."""
        return [self._table(n) for level in self.levels for n in level]

    def _table(self, name: str) -> DataFrame:
        table = self.spark.table(name)
        return (table.where("keeper is not null") if "keeper" in table.columns else table).select(*KEY)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, rows: DataFrame, dealt: bool) -> str:
        """Writes rows as a bucketed, sorted table. dealt: they come from a plan that has a bucket's rows in one task."""
        name = f"line_run_{uuid.uuid4().hex}"
        rows = rows if dealt else rows.repartition(self.buckets, *KEY)
        was = self.spark.conf.get(ORDERED, "false")
        self.spark.conf.set(ORDERED, "true")
        try:
            rows.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", self.path(name)).saveAsTable(name)
        finally:
            self.spark.conf.set(ORDERED, was)
        self.names.append(name)
        return name

    def add(self, name: str) -> None:
        """Enters a written table as a run, and compacts full levels."""
        self.levels[0].append(name)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = [self._table(n) for n in self.levels[level]], []
            merged = full[0]
            for other in full[1:]:
                # Runs share no hash, so a full join of sorted buckets is their merge.
                merged = merged.join(other, KEY, "full")
            if len(self.levels) == level + 1:
                self.levels.append([])
            self.levels[level + 1].append(self.write(merged.select(*KEY), dealt=True))
            level += 1

    def drop(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def batch_drops(hashes: DataFrame, runs: Runs) -> DataFrame:
    """doc_id, row, pos of the lines of a batch that an earlier batch, or a smaller doc_id of this one, holds; adds the batch's new hashes to runs."""
    judged = hashes.groupBy(*KEY).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).withColumn("old", F.lit(False))
    for run in runs.tables():
        met = judged.join(run.withColumn("seen", F.lit(True)), KEY, "left")
        judged = met.select(*KEY, "first", "last", (F.col("old") | F.col("seen").isNotNull()).alias("old"))
    judged = judged.select(*KEY, "first", "last", F.when(~F.col("old"), F.col("first")).alias("keeper"))
    name = runs.write(judged, dealt=False)
    runs.add(name)
    # Read as a plain table, since a join that deals both sides can split a very common line.
    written = runs.spark.read.schema("h1 long, h2 long, first long, last long, keeper long").parquet(runs.path(name))
    repeated = written.where(F.col("keeper").isNull() | (F.col("first") < F.col("last"))).select(*KEY, "keeper")
    return hashes.join(repeated, KEY).where(F.col("keeper").isNull() | (F.col("doc_id") != F.col("keeper"))).select("doc_id", "row", "pos")


def dedup_lines(docs: DataFrame, batches: int | None = None, runs: Runs | None = None, keep: list[str] | None = None) -> DataFrame:
    """Drops lines whose key (blanks stripped at both ends, A-Z lower-cased) is at least 10 code points and found in a smaller doc_id.

    Documents come in ascending batches of doc_id, each merge-anti-joined with the levelled runs of the batches before it.
    Returns doc_id, text (kept lines), n_lines, n_dropped and the columns of `keep`; other columns are ignored. Null and empty texts are
    one empty line; texts are whole at any length. Lines of one doc_id never drop each other, and rows that share a doc_id are returned
    each, with their own lines. Rows with a null doc_id are left out. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    extra = [c for c in (keep or []) if c not in ("doc_id", "text")]
    docs = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text", *extra)
    if batches is None:
        batches = max(BATCHES, -(-docs.count() // BATCH_DOCS))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 else []
    cuts = sorted(set(cuts or []))
    own = runs or Runs(spark)
    batch = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("doc_id"))) if cuts else F.lit(0)
    hashed = line_hashes(docs.select("doc_id", "text", row_key().alias("row"), batch.alias("batch")))
    schema = "doc_id long, row long, pos int, h1 long, h2 long, batch int"
    hashed.write.partitionBy("batch").parquet(f"{own.root}/hashes")
    hashes = spark.read.schema(schema).parquet(f"{own.root}/hashes")
    drops = []
    for k in range(len(cuts) + 1):
        path = f"{own.root}/drops{k}"
        batch_drops(hashes.where(F.col("batch") == k).drop("batch"), own).write.parquet(path)
        drops.append(path)
    if runs is None:
        own.drop()
    dropped = spark.read.schema("doc_id long, row long, pos int").parquet(*drops).groupBy("doc_id", "row").agg(F.collect_set("pos").alias("dropped"))
    # Made here, so that no column of `keep` clashes with it.
    lined = docs.select("doc_id", row_key().alias("row"), F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"), F.struct(F.lit(0).alias("none"), *extra).alias("kept"))
    joined = lined.join(dropped, ["doc_id", "row"], "left")
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped"))
    text = F.when(F.col("dropped").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n"))
    return joined.select("doc_id", text.alias("text"), F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), *[F.col(f"kept.{c}").alias(c) for c in extra])
