"""Readers and writers."""

from __future__ import annotations

import sqlite3
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def delimited(spark: SparkSession, path: str, schema: StructType | str, sep: str = ",") -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("sep", sep).csv(path)


def named_files(spark: SparkSession, path: str, schema: StructType | str, pattern: str = r"([^/]+)\.[^./]*$", sep: str = ",") -> DataFrame:
    """All files under a glob, with the id that the pattern finds in a file's name."""
    return delimited(spark, path, schema, sep).withColumn("id", F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))


def zip_member(spark: SparkSession, path: str, member: str, schema: StructType | str) -> DataFrame:
    """A CSV in each zip file of a path; a member must fit in a task's memory."""

    def lines(rows):
        import io

        for r in rows:
            with zipfile.ZipFile(io.BytesIO(r.content)) as z:
                yield from ((x,) for x in z.read(member).decode("utf-8-sig").splitlines()[1:])

    text = spark.read.format("binaryFile").load(path).select("content").rdd.mapPartitions(lines).toDF("line string")
    schema = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return text.select(F.from_csv("line", schema).alias("r")).select("r.*")


def sqlite_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A small SQLite table, read on the driver; larger ones are for spark.read.jdbc."""
    with sqlite3.connect(path) as c:
        found = c.execute(f'SELECT * FROM "{table}"')
        names = [d[0] for d in found.description]
        return spark.createDataFrame(found.fetchall(), names)


def cohort_documents(spark: SparkSession, path: str) -> DataFrame:
    """(cohort, id, pos, time, v) of a nested cohort document. Only times and values are read: labels stay unseen."""
    schema = "cohort string, subjects array<struct<id:string, timestamps:array<string>, values:array<double>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select("cohort", F.explode("subjects").alias("s"))
    return rows.select("cohort", "s.id", F.posexplode(F.arrays_zip("s.timestamps", "s.values")).alias("pos", "x")).select("cohort", "id", "pos", F.to_timestamp_ntz("x.timestamps").alias("time"), F.nanvl("x.values", F.lit(None).cast("double")).alias("v"))


def wide_minutes(df: DataFrame, ids: list[str]) -> DataFrame:
    """Columns that are minute offsets, as rows."""
    return df.unpivot(ids, [c for c in df.columns if c not in ids], "minute", "v").withColumn("minute", F.col("minute").cast("int"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def append_log(spark: SparkSession, path: str, lines: list[str]) -> None:
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(path)


def delimited_out(df: DataFrame, path: str, sep: str) -> None:
    df.write.option("header", True).option("sep", sep).csv(path)


def latest(spark: SparkSession, pattern: str) -> str | None:
    """The last path by name that a glob finds, in any store; none if it finds nothing."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return max((str(f.getPath()) for f in found or []), default=None)
