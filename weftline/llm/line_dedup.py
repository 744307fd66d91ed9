"""Line dedup against levelled sorted runs of line hashes, in DataFrame functions only.

A line's key is the line without white space at both ends and with A-Z in lower
case, and goes by 128 bits of hash.  Keys that MIN_DOCS documents or more have
lose all their lines everywhere.

LineRuns keeps, for the batches of documents it has been given, how many
documents have each key.  A batch becomes a run: its keys with their counts,
in buckets of the hash and sorted within each.  FAN_IN runs of one level are merged
into one run of the next, so that an entry is written again once a level.  A
new batch is first anti-joined, bucket by bucket, with the keys that some run
already has often enough: their verdict stands, and neither they nor their further
counts are stored again.  What is left is the batch's own run.

The texts are read once for their hashes, which the batches then read in turn, and
once more when lines go.  A key that a third of all documents have is counted
within each task before it moves; the join that finds its lines is split by Spark
(skew join).

Defined cases: a null text is one empty line; a line without any other character
than white space has no key and always stays; every row counts as a document
of its own, also where rows repeat or have no id; of a text with one key in
several lines all go, and it counts once; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import NO_ID, cut, ensure_checkpoint_dir, keyed, shuffle_partitions

MIN_DOCS = 10
#: Batches that a table is dealt to, and runs of a level that are merged into one.
BATCHES, FAN_IN = 4, 2

_BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is; the quick way where there is nothing else than ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def line_keys(text: Column) -> Column:
    """Per line of a text the 128-bit hash of its key, or null for a line without a key."""

    def hashed(line):
        key = F.btrim(line, F.lit(_BLANKS))
        return F.when(key != "", F.unhex(F.md5(lower_ascii(key))))

    return F.transform(lines_of(text), hashed)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


class LineRuns:
    """How many documents have each key, in levels of sorted runs; a run is a table of h, n in buckets of h and sorted within, in the shared folder. Buckets are dealt as exchanges deal their rows, so that a batch meets them without moving again."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fan_in: int = FAN_IN, buckets: int | None = None):
        ensure_checkpoint_dir(spark)
        self.spark, self.min_docs, self.fan_in = spark, min_docs, fan_in
        self.buckets = buckets or shuffle_partitions(spark)
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.folder = f"{spark.sparkContext.getCheckpointDir()}/{self.name}"
        self.levels: list[list[str]] = []
        self._paths: dict[str, str] = {}
        self._made = 0

    def runs(self) -> list[DataFrame]:
        return [self.spark.read.table(name) for level in self.levels for name in level]

    def add(self, keys: DataFrame) -> None:
        """A batch: keys (array of hashes; null ones don't count) of each of its documents."""
        own = keys.select(F.explode(F.array_distinct("keys")).alias("h")).where("h IS NOT NULL").groupBy("h").agg(F.count("*").alias("n"))
        for run in self.runs():
            own = own.join(run.where(F.col("n") >= self.min_docs).select("h").hint("merge"), "h", "left_anti")
        self._put(own, 0)

    def _put(self, run: DataFrame, level: int) -> None:
        """run: dealt by h, so that a bucket is one file."""
        name = f"{self.name}_{self._made}"
        self._made += 1
        self._paths[name] = f"{self.folder}/{name}"
        run.write.option("path", self._paths[name]).bucketBy(self.buckets, "h").sortBy("h").saveAsTable(name)
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) == self.fan_in:
            old, self.levels[level] = self.levels[level], []
            self._put(self._merged(old), level + 1)
            self._drop(old)

    def _merged(self, names: list[str]) -> DataFrame:
        """Runs added up, read by their paths: Spark takes a union of bucketed tables for one that is dealt by bucket, which it isn't."""
        every = self.spark.read.schema("h binary, n long").parquet(*(self._paths[name] for name in names))
        return every.groupBy("h").agg(F.sum("n").alias("n"))

    def frequent(self) -> DataFrame:
        """h of the keys that enough documents have; cut from the runs."""
        names = [name for level in self.levels for name in level]
        if not names:
            return self.spark.createDataFrame([], "h binary")
        return cut(self._merged(names).where(F.col("n") >= self.min_docs).select("h"))

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def close(self) -> None:
        self._drop([name for level in self.levels for name in level])
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def cleaned_lines(docs: DataFrame, min_docs: int = MIN_DOCS, batches: int = BATCHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tag, n_lines, dropped (array of the places, from 0, of the lines that go), cleaned (the others joined by a line feed), of every row."""
    spark = docs.sparkSession
    rows = keyed(docs, id_col, text_col)
    owner = F.coalesce("doc_id", F.lit(int(NO_ID))).alias("owner")
    runs = LineRuns(spark, min_docs)
    try:
        hashed = rows.select(owner, "tag", line_keys(F.col("text")).alias("keys")).withColumn("batch", F.pmod(F.xxhash64("owner", "tag"), F.lit(batches)).cast("int"))
        hashed.write.partitionBy("batch").parquet(f"{runs.folder}/hashed")
        hashed = spark.read.schema(hashed.schema).parquet(f"{runs.folder}/hashed")
        for b in range(batches):
            runs.add(hashed.where(F.col("batch") == b))
        placed = hashed.select("owner", "tag", F.posexplode("keys").alias("at", "h")).where("h IS NOT NULL")
        lost = placed.join(runs.frequent(), "h", "left_semi")
        lost = cut(lost.groupBy("owner", "tag").agg(F.collect_set("at").alias("lost")))
    finally:
        runs.close()
    met = rows.withColumn("owner", owner).join(lost, ["owner", "tag"], "left")
    lines = met.select("doc_id", "tag", lines_of(F.col("text")).alias("lines"), F.coalesce(F.array_sort("lost"), F.array().cast("array<int>")).alias("dropped"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped"))
    kept = F.when(F.size("dropped") == 0, F.col("lines")).otherwise(F.transform(stay, lambda i: F.get(F.col("lines"), i)))
    return lines.select("doc_id", "tag", F.size("lines").cast("long").alias("n_lines"), "dropped", F.array_join(kept, "\n").alias("cleaned"))


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256."""
    found = cleaned_lines(docs)
    return found.select("doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), F.sha2("cleaned", 256).alias("kept_sha256"))
