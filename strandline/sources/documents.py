"""Documents in files of their own, written by tasks and seen all at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .manifest import Manifest


def save(documents: DataFrame, folder: str, replace: bool = False) -> str:
    """Write ``documents(name, text)``, a file for each name, into a segment of ``folder``; gives the segment's path.

    Tasks write side by side, and readers see the documents once the segment is
    in the folder's list: after a task or a writer that failed, what was there
    before is what there is. ``replace`` takes all earlier documents off the
    list in the same step. Rows without a name or a text are left out; of
    several texts of a name the least is taken. Other columns are ignored.
    """
    m = Manifest(documents.sparkSession, folder)
    path = m.new_segment()
    once = documents.select(F.col("name").cast("string").alias("name"), F.col("text").cast("string").alias("value")).where("name is not null and value is not null").groupBy("name").agg(F.min("value").alias("value"))
    once.write.partitionBy("name").text(path)
    segment = {"path": path}
    m.change(lambda segments: [segment] if replace else [*segments, segment])
    return path


def load(spark: SparkSession, folder: str) -> DataFrame:
    """``name, text`` of the documents of a folder; of those of one name the one that was saved last."""
    _, segments = Manifest(spark, folder).read()
    out = spark.createDataFrame([], "name string, text string, place int")
    for place, s in enumerate(segments):
        files = spark.read.schema("value string, name string").option("basePath", s["path"]).text(s["path"], wholetext=True)
        out = out.unionByName(files.select("name", F.expr("left(value, length(value) - 1)").alias("text"), F.lit(place).alias("place")))  # a file ends its last line
    return out.groupBy("name").agg(F.max_by("text", "place").alias("text"))
