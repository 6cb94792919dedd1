"""A citation graph from order tables: the inputs of every lineage query.

Orders are works. An order cites the order before it of the same part, its
title is made of its parts' names, its authors are its suppliers, its venue is
its customer's segment, and its abstract is the document with its number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``src, tgt, pos``: src cites tgt; pos is its place among the references."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    before = Window.partitionBy("l_partkey").orderBy("o_orderdate", "o_orderkey", "l_linenumber", "l_suppkey")
    pairs = lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(F.col("o_orderkey").alias("src"), F.lag("o_orderkey").over(before).alias("tgt"))
    return pairs.where("tgt is not null and tgt <> src").distinct().withColumn("pos", F.col("tgt"))


def ranks(spark: SparkSession, sf_dir: str, cites: DataFrame | None = None) -> DataFrame:
    """``id, publication_year, cited_by_count, venue, doi``: what works have but for the texts of their lines and documents; far cheaper to make."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id")).distinct()
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", F.year("o_orderdate").alias("publication_year")).join(lines, "id", "left_semi")
    cited = (citations(spark, sf_dir) if cites is None else cites).groupBy(F.col("tgt").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    customers = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("venue"))
    out = orders.join(cited, "id", "left").join(customers, F.col("o_custkey") == F.col("c_custkey"), "left")
    return out.select("id", "publication_year", F.coalesce("n", F.lit(0)).alias("cited_by_count"), "venue", F.concat(F.lit("https://doi.org/10.0/"), F.col("id").cast("string")).alias("doi"))


def works(spark: SparkSession, sf_dir: str, cites: DataFrame | None = None, only: DataFrame | None = None) -> DataFrame:
    """``id, title, abstract, publication_year, cited_by_count, authors, venue, doi``; of the ids in ``only`` where it is given."""
    lines, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    cites = citations(spark, sf_dir) if cites is None else cites
    if only is not None:  # before anything is grouped or joined
        ids = only.select(F.col("id").alias("__id"))
        lines = lines.join(ids, F.col("l_orderkey") == F.col("__id"), "left_semi")
        cites = cites.join(ids, F.col("tgt") == F.col("__id"), "left_semi")
    named = lines.join(read(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey")).join(read(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    told = named.groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "p_name"))).alias("parts"),
        F.array_sort(F.collect_set("s_name")).alias("authors"),
    )
    cited = cites.groupBy("tgt").agg(F.count(F.lit(1)).alias("n"))
    # An order meets its customer before it has a title: what is dealt by customer is narrow, all else stays dealt by order.
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    orders = orders.select("o_orderkey", "o_custkey", "o_orderdate").join(customers, F.col("o_custkey") == F.col("c_custkey"), "left")
    texts = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("abstract"))
    out = told.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(cited, F.col("o_orderkey") == F.col("tgt"), "left").join(texts, F.col("o_orderkey") == F.col("doc_id"), "left")
    return out.select(
        F.col("o_orderkey").alias("id"),
        F.array_join(F.col("parts.p_name"), " ").alias("title"),
        F.coalesce("abstract", F.lit("")).alias("abstract"),
        F.year("o_orderdate").alias("publication_year"),
        F.coalesce("n", F.lit(0)).alias("cited_by_count"),
        "authors",
        F.col("c_mktsegment").alias("venue"),
        F.concat(F.lit("https://doi.org/10.0/"), F.col("o_orderkey").cast("string")).alias("doi"),
    )


def seed(all_works: DataFrame):
    """The most cited work; of several the smallest id."""
    return all_works.orderBy(F.desc("cited_by_count"), "id").first().id


#: The same in DuckDB, to stand before an oracle query.
SQL = """
cites AS (
  SELECT DISTINCT src, tgt, tgt AS pos FROM (
    SELECT o_orderkey AS src, lag(o_orderkey) OVER (PARTITION BY l_partkey ORDER BY o_orderdate, o_orderkey, l_linenumber, l_suppkey) AS tgt
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE tgt IS NOT NULL AND tgt <> src
), told AS (
  SELECT l_orderkey, string_agg(p_name, ' ' ORDER BY l_linenumber, l_partkey, l_suppkey, p_name) AS title, list_sort(list(DISTINCT s_name)) AS authors
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_orderkey
), works AS (
  SELECT o_orderkey AS id, title, coalesce(text, '') AS abstract, CAST(year(o_orderdate) AS INTEGER) AS publication_year, coalesce(n, 0) AS cited_by_count, authors,
         c_mktsegment AS venue, 'https://doi.org/10.0/' || o_orderkey AS doi
  FROM told JOIN orders ON l_orderkey = o_orderkey LEFT JOIN (SELECT tgt, count(*) AS n FROM cites GROUP BY tgt) c ON o_orderkey = tgt
  LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN documents ON doc_id = o_orderkey
), seed AS (SELECT id AS seed_id, publication_year AS seed_year FROM works ORDER BY cited_by_count DESC, id LIMIT 1)
"""
