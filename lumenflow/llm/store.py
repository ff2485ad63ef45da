"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenflow.deploy import ship

#: Rows that Python workers receive at a time; Spark's default suits short rows, not whole texts.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
DEFAULT_ROWS, ROWS = "10000", "1000"


def ready(spark: SparkSession) -> None:
    """Ship the package to the executors and bound Arrow batches, where the session has the defaults."""
    ship(spark)
    if spark.conf.get(BATCH) == DEFAULT_ROWS:
        spark.conf.set(BATCH, ROWS)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, one temporary folder (tests only)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="lumenflow-llm-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Folders written so far, oldest first.
made: list[str] = []


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet and go on from the files: computed once, read again after a lost executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, folders: list[str], needed: DataFrame) -> None:
    """Delete ``folders`` except those that ``needed`` reads."""
    files = needed.inputFiles() if folders else []
    for folder in folders:
        name = folder.rsplit("/", 1)[-1]
        if not any(f"/{name}/" in file for file in files):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def drop(df: DataFrame) -> None:
    """Delete the files of a table that ``saved`` wrote and nothing reads any more."""
    session = df.sparkSession._jsparkSession
    for file in df.inputFiles()[:1]:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(session.sessionState().newHadoopConf()).delete(path, True)


def no_rows(df: DataFrame) -> bool:
    return not df.take(1)


def own_ids(docs: DataFrame) -> bool:
    """Whether each row has a doc_id that no other row has."""
    counts = docs.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("ids")).first()
    return counts.n == counts.ids


def numbered(docs: DataFrame) -> DataFrame:
    """(doc_id, text, row): texts under distinct ids in the order of doc_id, and the other columns as struct ``row``.

    Distinct ids stay as they are. Otherwise rows are numbered by doc_id (null last) and text, so of
    repeated rows the first counts as the earliest.
    """
    rest = [F.col(f"`{c}`").alias(f"c_{c}") for c in docs.columns if c not in ("doc_id", "text")]
    others = F.struct(F.col("doc_id").alias("id"), F.col("text").isNull().alias("none"), *rest)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", others.alias("row"))
    if own_ids(docs):
        return rows
    place = [F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_first()]
    placed = rows.repartitionByRange(*place).sortWithinPartitions(*place)
    return saved(placed.withColumn("doc_id", F.monotonically_increasing_id()))


def numbered_columns(docs: DataFrame) -> list[Column]:
    """The columns of ``docs`` taken back out of what ``numbered`` made of it."""
    named = {"doc_id": F.col("row.id"), "text": F.col("text")}
    return [named.get(c, F.col(f"row.`c_{c}`")).alias(c) for c in docs.columns]
