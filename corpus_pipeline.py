"""From raw documents to packed sequences: five operators, each on what the one before kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import NO_ID, ensure_checkpoint_dir, tag_of
from weftline.llm.minhash_dedup import near_duplicates
from weftline.llm.mixing import mixture
from weftline.llm.packing import packed
from weftline.llm.quality_rules import judgement, references
from weftline.llm.substring_dedup import removal_spans

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
_KEY = ["owner", "tag"]


def _owned(frame: DataFrame) -> DataFrame:
    """frame with its doc_id as a long that is never null."""
    return frame.withColumn("owner", F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NO_ID))))


def _matched(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """Rows of docs, once each, with what was found for their doc_id and tag; one exchange of the texts serves both."""
    rows = _owned(docs.select(*COLUMNS, tag_of().alias("tag"))).dropDuplicates(_KEY)
    return rows.join(_owned(found).drop("doc_id"), _KEY, how)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, with all their rows as they are; the language references are those of these documents.

    A null, empty or blank text has no words and goes; null ids and metadata stay
    null; repeated rows are judged each; columns beyond those of documents are
    left out; an empty table gives an empty one."""
    return docs.select(*COLUMNS).where(judgement(F.col("text"), references(docs)).kept)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity of 0.8 or more): the one of the smallest doc_id.

    Texts without words are no copies and stay; rows of one doc_id are one
    document, so that rows that repeat in id and text leave one; of different
    texts under one id or without an id each is compared by its text, ids come
    before none; columns beyond those of documents are left out; an empty table
    gives an empty one."""
    stay = near_duplicates(docs).where("stays").select("doc_id", "tag").distinct()
    return _matched(docs, stay, "left_semi").select(*COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that an earlier one has; a text that lost some has its words joined by one space.

    A text that loses nothing stays as it is, null included, and n_chars is
    measured again; a text may become empty; rows of one doc_id take nothing from
    each other; rows without an id come last; repeated rows stay, each;
    columns beyond those of documents are left out; an empty table gives an empty one."""
    found = removal_spans(docs, carry=("lang", "source"), as_it_was=True)
    return found.withColumnRenamed("cleaned", "text").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; one taken several times is as many rows.

    Texts without words weigh nothing and are not taken more often than their
    source's share in whole copies; a null source is a source of its own; repeated
    rows are drawn each; ties go by a hash; columns beyond those of documents are
    left out; an empty table gives an empty one."""
    taken = _owned(mixture(docs)).groupBy(*_KEY).agg(F.sum("copies").cast("int").alias("copies"), F.first("doc_id").alias("doc_id")).where("copies > 0")
    return _matched(docs, taken, "inner").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences.

    A null or empty text is the end id alone; null ids stay null; repeated rows are
    packed each; other columns are left out; an empty table gives an empty one."""
    return packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", keep_good),
    ("minhash_dedup", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: The draws of the mix and the cuts of the packing have no SQL form; the tests hold the stages against plain Python.
ORACLE_SQL = None


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each one's rows written as Parquet in the shared folder and read again.

    A stage's Parquet goes once the next one's is written; that before the last
    stage stays, as the result may still read it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                _remove(spark, f"{folder}/{k - 1}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
