"""Deterministic positions: works on a diagonal of years, clusters on one of median years."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import wording as W
from .rank import placed as in_order

#: Fixed values of the drawing.
SCALE, STEP, CROWD, CROWD_FROM = 900.0, 70.0, 0.08, 4
CLUSTER_SCALE, LANE, SPACING = 1500.0, 520.0, 190.0
ASIDE = 1 / math.sqrt(2)


def diagonal(year: Column, seed_year: Column, first: Column, last: Column) -> Column:
    """-1 for the oldest year, 0 for the seed's and for none, 1 for the newest; linear between."""
    before, after = (seed_year - first).cast("double"), (last - seed_year).cast("double")
    older = F.when(before > 0, -((seed_year - year) / before)).otherwise(0.0)
    newer = F.when(after > 0, (year - seed_year) / after).otherwise(0.0)
    return F.when(year.isNull() | seed_year.isNull(), 0.0).when(year <= seed_year, older).otherwise(newer)


def _span(nodes: DataFrame, seed) -> DataFrame:
    """One row: the seed's year, and first and last known year."""
    own = F.max(F.when(F.col("id") == F.lit(seed), F.col("publication_year"))).alias("seed_year")
    got = nodes.agg(own, F.min("publication_year").alias("first"), F.max("publication_year").alias("last"))
    return got.select("seed_year", F.coalesce("first", "seed_year", F.lit(0)).alias("first"), F.coalesce("last", "seed_year", F.lit(0)).alias("last"))


def by_year(nodes: DataFrame, seed, spread: bool = True) -> DataFrame:
    """``id, x, y`` of ``nodes(id, publication_year)``: along the diagonal by year, fanned out across it within a year in order of id. ``spread`` as in ``rank.placed``."""
    placed = in_order(nodes.select("id", "publication_year"), ["publication_year"], [F.col("id")], spread).withColumnRenamed("nth", "i")  # null years are a group of their own
    crowd = nodes.groupBy("publication_year").count().agg(F.coalesce(F.max("count"), F.lit(1)).alias("busiest"))
    step = F.lit(STEP) * (1 + CROWD * F.greatest(F.lit(0), F.col("busiest") - CROWD_FROM))
    placed = placed.crossJoin(F.broadcast(_span(nodes, seed))).crossJoin(F.broadcast(crowd))  # one row each
    base = diagonal(F.col("publication_year"), F.col("seed_year"), F.col("first"), F.col("last")) * SCALE
    placed = placed.select("id", base.alias("base"), ((F.col("i") - (F.col("n") - 1) / 2) * step).alias("offset"), step.alias("step"))
    aside = F.when((F.col("base") == 0) & (F.col("offset") == 0), F.col("step") * 0.5).otherwise(F.col("offset"))
    at = lambda sign: F.when(F.col("id") == F.lit(seed), 0.0).otherwise(F.col("base") + sign * aside * ASIDE)
    return placed.select("id", at(1).alias("x"), at(-1).alias("y"))


def cluster_stats(nodes: DataFrame, seed) -> DataFrame:
    """``cluster_id, n, first_year, last_year, median_year, span`` of clustered nodes other than the seed."""
    members = nodes.where((F.col("id") != F.lit(seed)) & (F.col("cluster_id") != ""))
    # A row for each year of a cluster is all that the upper median needs: the year in which half of the known ones are passed.
    years = members.groupBy("cluster_id", "publication_year").agg(F.count(F.lit(1)).alias("c"), F.count("publication_year").alias("known"))
    own = Window.partitionBy("cluster_id")
    years = years.withColumn("upto", F.sum("known").over(own.orderBy(F.asc_nulls_last("publication_year")))).withColumn("all", F.sum("known").over(own))
    passed = F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("publication_year"))
    got = years.groupBy("cluster_id").agg(F.sum("c").alias("n"), F.min("publication_year").alias("first_year"), F.max("publication_year").alias("last_year"), F.min(passed).alias("median_year"))
    span = F.concat(F.col("first_year").cast("string"), F.lit("–"), F.col("last_year").cast("string"))
    return got.withColumn("span", F.coalesce(span, F.lit("")))


def cluster_centres(stats: DataFrame, seed_year: Column, spread: bool = True) -> DataFrame:
    """Adds ``x, y``: along the diagonal by median year, in lanes 0, 1, -1, 2, ... across it in that order."""
    order = [F.col("median_year").isNull(), F.coalesce("median_year", F.lit(0)), F.col("cluster_id")]
    kept = stats.columns
    placed = in_order(stats.withColumnRenamed("n", "members"), [], order, spread).drop("n").withColumnRenamed("members", "n").withColumnRenamed("nth", "lane").withColumn("seed_year", seed_year)
    ends = stats.agg(F.min("median_year").alias("first"), F.max("median_year").alias("last"))
    placed = placed.crossJoin(F.broadcast(ends))
    base = diagonal(F.col("median_year"), F.col("seed_year"), F.coalesce("first", "seed_year", F.lit(0)), F.coalesce("last", "seed_year", F.lit(0))) * CLUSTER_SCALE
    offset = F.floor((F.col("lane") + 1) / 2) * F.when(F.col("lane") % 2 == 1, 1).otherwise(-1) * LANE
    return placed.select(*kept, (base + offset * ASIDE).alias("x"), (base - offset * ASIDE).alias("y"))


def in_clusters(nodes: DataFrame, seed, seed_year: Column, spread: bool = True) -> DataFrame:
    """``id, cluster_id, x, y`` of clustered nodes: a near-square grid around their cluster's centre, oldest first."""
    centres = cluster_centres(cluster_stats(nodes, seed), seed_year, spread).select("cluster_id", F.col("x").alias("cx"), F.col("y").alias("cy"))
    members = nodes.where((F.col("id") != F.lit(seed)) & (F.col("cluster_id") != ""))
    placed = in_order(members.select("id", "cluster_id", F.coalesce("publication_year", F.lit(0)).alias("year")), ["cluster_id"], [F.col("year"), F.col("id")], spread).withColumnRenamed("nth", "i")
    columns = F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("n").cast("double"))).cast("int"))
    placed = placed.withColumn("columns", columns).withColumn("rows", F.ceil(F.col("n") / F.col("columns")).cast("int"))
    column, row = F.col("i") % F.col("columns"), F.floor(F.col("i") / F.col("columns"))
    placed = placed.join(centres, "cluster_id")
    return placed.select("id", "cluster_id", (F.col("cx") + (column - (F.col("columns") - 1) / 2) * SPACING).alias("x"), (F.col("cy") + (row - (F.col("rows") - 1) / 2) * SPACING).alias("y"))


def members(nodes: DataFrame, seed, spread: bool = True) -> DataFrame:
    """``cluster_id, id, place``: a cluster's works as a list shows them, from 1, oldest first, those without a year before all."""
    own = nodes.where((F.col("id") != F.lit(seed)) & (F.col("cluster_id") != "")).select("cluster_id", "id", F.coalesce("publication_year", F.lit(0)).alias("year"))
    return in_order(own, ["cluster_id"], [F.col("year"), F.col("id")], spread).select("cluster_id", "id", (F.col("nth") + 1).alias("place"))


def legend(payload: DataFrame) -> DataFrame:
    """``place, label, colour`` of what ``payload(role, ord)``, the drawn clusters in order, shows: the seed, then each role where it is first seen. Roles are few."""
    roles = payload.groupBy("role").agg(F.min("ord").alias("ord"))
    place = F.row_number().over(Window.orderBy("ord", "role"))  # a row for each of three roles
    rows = roles.select(place.alias("place"), W.role_label(F.col("role")).alias("label"), W.role_colour(F.col("role")).alias("colour"))
    seed = roles.sparkSession.range(1).select(F.lit(0).alias("place"), F.lit(W.SEED_LABEL).alias("label"), F.lit(W.SEED_COLOUR).alias("colour"))
    return seed.unionByName(rows)


def positions(nodes: DataFrame, seed, spread: bool = True) -> DataFrame:
    """``id, x, y``: by cluster where there is one, else by year."""
    year = nodes.where(F.col("id") == F.lit(seed)).select("publication_year").first()
    grid = in_clusters(nodes, seed, F.lit(year[0] if year else None).cast("int"), spread).select("id", F.col("x").alias("gx"), F.col("y").alias("gy"))
    return by_year(nodes, seed, spread).join(grid, "id", "left").select("id", F.coalesce("gx", "x").alias("x"), F.coalesce("gy", "y").alias("y"))


def cluster_payload(clusters: DataFrame, nodes: DataFrame, seed, seed_year: Column, spread: bool = True) -> DataFrame:
    """A drawn super-node for each of ``clusters(id, name, role, summary, ord)`` with members."""
    c = cluster_centres(cluster_stats(nodes, seed), seed_year, spread).withColumnRenamed("x", "cx").withColumnRenamed("y", "cy")
    label = F.concat("name", F.lit("\n("), F.col("n").cast("string"), F.lit(" papers)"))
    return clusters.join(c, clusters.id == c.cluster_id).select(F.concat(F.lit("cluster:"), "cluster_id").alias("id"), "cluster_id", label.alias("label"), "name", "summary", "role", W.role_label(F.col("role")).alias("role_label"), F.col("n").alias("count"), "span", F.col("cx").alias("x"), F.col("cy").alias("y"), W.role_colour(F.col("role")).alias("background"), W.cluster_size(F.col("n")).alias("size"), "ord")
