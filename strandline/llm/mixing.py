"""Mixing sources to target weights, by DataFrame functions alone.

The words of a source, document after document, are one stream that is packed
into blocks of BLOCK words. The mix is a sequence of slots, SHARD of them an
output shard. Every shard draws how many of its slots go to each source, a
multinomial draw with the sources' quotas as weights. Slot i of a source is
sent through a pseudorandom permutation of the source's block numbers, one for
each pass over the source, and joined with the block of that number.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.rank import placed
from .common import stored

#: Words of a block; slots of an output shard; rounds of a permutation.
BLOCK, SHARD, ROUNDS = 128, 4096, 32
#: The query's mix: weights by turns, share of all words, passes over a source at most.
WEIGHTS, SHARE, REPEATS = (5, 2, 1), 1.5, 2
#: Entries of a source that one task puts in order, about; and places that one sums up.
A_BUCKET, A_RUN = 50_000, 4096
WORD = r"[^\x20\x09-\x0D]+"


def permuted(rows: DataFrame, x: str, n: str, salt: list) -> DataFrame:
    """``rows`` with column ``x`` sent through a pseudorandom permutation of 0..``n``-1, another for every ``salt``.

    The swap-or-not shuffle: ROUNDS times a partner and a coin that both of a
    pair see alike. A round is a projection of its own, which compiles; the
    result is to be written down before it is filtered or joined, as a filter
    pushed below would repeat all rounds.
    """
    for r in range(ROUNDS):
        other = F.pmod(F.pmod(F.xxhash64(*salt, F.lit(r)), F.col(n)) - F.col(x), F.col(n))
        heads = F.xxhash64(F.greatest(x, other), *salt, F.lit(r)).bitwiseAND(1) == 1
        rows = rows.withColumn(x, F.when(heads, other).otherwise(F.col(x)))
    return rows


def running(rows: DataFrame, keys: list[str], at: str, value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same keys with a smaller ``at`` (whole numbers, unique within keys). Stretches of A_RUN places are summed first, so that no group has to be one task's."""
    part = rows.withColumn("__part", F.floor(F.col(at) / A_RUN))
    sums = part.groupBy(*keys, "__part").agg(F.sum(value).alias("__sum"))
    before = lambda keys, order, what: F.coalesce(F.sum(what).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*keys, "__part", before(keys, "__part", "__sum").alias("__base"))
    within = part.withColumn("__in", before([*keys, "__part"], at, value))
    return within.join(sums, [*keys, "__part"]).withColumn(out, F.col("__base") + F.col("__in")).drop("__part", "__base", "__in")


def located(points: DataFrame, at: str, intervals: DataFrame, total: int, n: int) -> DataFrame:
    """Each point of [0, total) with the interval ``lo <= at < hi`` that holds it: intervals are cut into cells of equal width, four for each of the ``n``, and a point looks into its own."""
    width = max(1, -(-total // (4 * n + 1024)))
    cells = intervals.where("hi > lo").withColumn("__cell", F.explode(F.sequence(F.expr(f"lo div {width}"), F.expr(f"(hi - 1) div {width}"))))
    inside = (F.col("__at") == F.col("__cell")) & (F.col(at) >= F.col("lo")) & (F.col(at) < F.col("hi"))
    return points.withColumn("__at", F.expr(f"{at} div {width}")).join(cells, inside).drop("__at", "__cell")


def level(sources: DataFrame, budget: float) -> float:
    """Words for each unit of weight, so that targets ``least(cap, level * weight)`` add up to ``budget``, or all stand at their caps: raised until no further source is above its cap."""
    at, full = 0.0, -1
    while True:
        above = F.col("cap") <= F.col("weight") * F.lit(at)
        n, held, weight = sources.agg(F.count_if(above), F.sum(F.when(above, F.col("cap"))), F.sum(F.when(~above, F.col("weight")))).first()
        if n == full or not weight:
            return at if weight else math.inf
        at, full = (budget - (held or 0)) / weight, n


def sources_of(sizes: DataFrame, weights: DataFrame | tuple, share: float, repeats: int, block: int) -> DataFrame:
    """``source, no, size, weight, cap, target, blocks, quota``: of each source its place by code point (null last), words, weight, the target in words and in slots."""
    sums = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("size"))
    rows = placed(sums, [], [F.asc_nulls_last("source")]).select("source", F.col("nth").alias("no"), "size")
    if isinstance(weights, tuple):
        rows = rows.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("no") % len(weights) + 1).cast("int")))
    else:
        given = weights.select(F.col("source").alias("__source"), F.col("weight").cast("double").alias("weight"))
        rows = rows.join(given, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source").fillna({"weight": 0.0})
    rows = stored(rows.withColumn("cap", F.col("size") * repeats), "mix-sources")
    total = rows.agg(F.sum("size")).first()[0] or 0
    at = level(rows, min(share, repeats) * total)
    target = F.col("cap").cast("double") if math.isinf(at) else F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(at))
    rows = rows.withColumn("target", F.when(F.col("weight") > 0, target).otherwise(0.0)).withColumn("blocks", F.ceil(F.col("size") / block))
    whole = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0)
    rest = F.when(F.col("size") > 0, F.round((F.col("target") - whole * F.col("size")) / F.col("size") * F.col("blocks"))).otherwise(0)
    return stored(rows.withColumn("quota", (whole * F.col("blocks") + rest).cast("long")), "mix-targets")


def entries_of(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """Where the documents of each source lie in its stream: sizes with ``no, bucket, nth, start``.

    Equal rows are one entry with a number of copies. Entries are dealt by hash
    over buckets that grow in number with the table, and a bucket begins where
    those before it end, so a source of any size is the work of many tasks.
    """
    n = max(64, -(-sizes.count() // A_BUCKET))
    known = sources.select(F.col("source").alias("__source"), "no")
    rows = sizes.join(known, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(n)))
    own = Window.partitionBy("no", "bucket").orderBy("doc_id", "tie", "size")
    words = F.col("size") * F.col("copies")
    rows = rows.withColumn("nth", F.row_number().over(own)).withColumn("__in", F.coalesce(F.sum(words).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sums = rows.groupBy("no", "bucket").agg(F.sum(words).alias("words"))
    base = running(sums, ["no"], "bucket", "words", "base").select("no", "bucket", "base")
    return rows.join(base, ["no", "bucket"]).withColumn("start", F.col("base") + F.col("__in")).drop("base", "__in")


def documents_of(entries: DataFrame) -> DataFrame:
    """A row for every document: ``no, bucket, nth, copy, doc_id, tie, size, start``."""
    each = entries.select("no", "bucket", "nth", "doc_id", "tie", "size", "start", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    return each.withColumn("start", F.col("start") + F.col("copy") * F.col("size"))


def slots_of(sources: DataFrame, shard: int, seed: int) -> DataFrame:
    """``shard, turn, no, block``: which block of which source each slot takes; ``turn`` orders a shard.

    Draws are independent, so a source's slots add up to its quota only about.
    Of what is drawn beyond a quota, slots picked by permutation are handed to
    the sources that were drawn too seldom: every source gets its quota, and no
    block comes more often than there are passes over its source.
    """
    spark = sources.sparkSession
    total, n = (x or 0 for x in sources.agg(F.sum("quota"), F.count(F.lit(1))).first())
    quotas = running(sources.select("no", "quota"), [], "no", "quota", "lo").select("no", "lo", (F.col("lo") + F.col("quota")).alias("hi"))
    drawn = spark.range(total, numPartitions=max(spark.sparkContext.defaultParallelism, total >> 22)).select(F.expr(f"id div {shard}").alias("shard"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(total, 1))).alias("u"))
    counts = stored(located(drawn, "u", quotas, total, n).groupBy("shard", "no").agg(F.count(F.lit(1)).alias("c")), "mix-draws")
    sums = counts.groupBy("no").agg(F.sum("c").alias("drawn"))
    each = sources.select("no", "blocks", "quota").join(sums, "no", "left").fillna(0, ["drawn"])
    each = each.withColumn("over", F.greatest(F.col("drawn") - F.col("quota"), F.lit(0))).withColumn("short", F.greatest(F.col("quota") - F.col("drawn"), F.lit(0)))
    each = stored(running(running(each, [], "no", "over", "over_at"), [], "no", "short", "lo"), "mix-settled")
    spare = max(each.agg(F.sum("over")).first()[0] or 0, 1)
    first = running(counts, ["no"], "shard", "c", "first").join(each.select("no", "blocks", "quota", "drawn", "over_at"), "no")
    tasks = max(spark.sparkContext.defaultParallelism, total >> 20)
    slots = first.repartition(tasks, "shard", "no").withColumn("i", F.explode(F.sequence("first", F.col("first") + F.col("c") - 1)))
    slots = slots.select("shard", F.xxhash64("no", "i", F.lit(seed)).alias("turn"), "no", "blocks", "quota", "drawn", "over_at", "i")
    slots = stored(permuted(slots, "i", "drawn", [F.lit(seed), F.lit("draw"), F.col("no")]).drop("drawn"), "mix-slots")
    own = slots.where("i < quota").select("shard", "turn", "no", "blocks", "i")
    over = slots.where("i >= quota").select("shard", "turn", (F.col("over_at") + F.col("i") - F.col("quota")).alias("e"), F.lit(spare).cast("long").alias("spare"))
    over = stored(permuted(over, "e", "spare", [F.lit(seed), F.lit("over")]), "mix-over")
    short = each.select("no", "blocks", "drawn", "lo", (F.col("lo") + F.col("short")).alias("hi"))
    given = located(over, "e", short, spare, n).select("shard", "turn", "no", "blocks", (F.col("drawn") + F.col("e") - F.col("lo")).alias("i"))
    both = own.unionByName(given).withColumn("pass", F.expr("i div blocks"))
    both = both.select("shard", "turn", "no", "pass", "blocks", (F.col("i") - F.col("pass") * F.col("blocks")).alias("block"))
    return stored(permuted(both, "block", "blocks", [F.lit(seed), F.lit("block"), F.col("no"), F.col("pass")]).select("shard", "turn", "no", "block"), "mix-blocks")


class Mix:
    """A mix of ``docs(doc_id, text, source)``; see ``mix``."""

    def __init__(self, docs: DataFrame, weights, share: float, repeats: int, block: int, shard: int, seed: int):
        self.docs = docs.select("doc_id", "source", F.col("text").alias("text"))
        self.block = block
        size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
        sizes = self.docs.select("doc_id", "source", F.xxhash64("text").alias("tie"), size.alias("size"))
        self.sizes = stored(sizes.groupBy("doc_id", "source", "tie", "size").agg(F.count(F.lit(1)).alias("copies")), "mix-sizes")
        self.sources = sources_of(self.sizes, weights, share, repeats, block)
        self.entries = stored(entries_of(self.sizes, self.sources), "mix-entries")
        self.slots = slots_of(self.sources, shard, seed)

    def pieces(self) -> DataFrame:
        """The mix: ``shard, turn, no, block, offset, doc_id, tie, bucket, nth, copy, size, first_word, n_words``, a row for each document in a slot."""
        d, size = documents_of(self.entries).where("size > 0"), self.block
        d = d.withColumn("block", F.explode(F.sequence(F.expr(f"start div {size}"), F.expr(f"(start + size - 1) div {size}"))))
        begin, end = F.greatest("start", F.col("block") * size), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * size)
        d = d.withColumns({"offset": begin - F.col("block") * size, "first_word": begin - F.col("start"), "n_words": end - begin})
        return self.slots.join(d.drop("start"), ["no", "block"])

    def taken(self) -> DataFrame:
        """A row per document: ``doc_id, source, size, source_size, target, taken``."""
        key = ["no", "bucket", "nth", "copy", "doc_id", "size"]
        used = self.pieces().select(*key, "n_words").unionAll(documents_of(self.entries).select(*key, F.lit(0).cast("long")))
        sums = used.groupBy(*key).agg(F.sum("n_words").alias("taken"))
        return sums.join(self.sources.select("no", "source", F.col("size").alias("source_size"), "target"), "no").select("doc_id", "source", "size", "source_size", "target", "taken")

    def texts(self) -> DataFrame:
        """``shard, turn, no, block, text``: the slots' words, joined by blanks."""
        tie = F.xxhash64("text")
        words = self.docs.select(F.col("doc_id").alias("__id"), tie.alias("__tie"), F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("__words")).dropDuplicates(["__id", "__tie"])
        found = self.pieces().join(words, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("tie") == F.col("__tie")))
        part = F.struct("offset", F.array_join(F.slice("__words", (F.col("first_word") + 1).cast("int"), F.col("n_words").cast("int")), " ").alias("words"))
        return found.groupBy("shard", "turn", "no", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["words"]), " ").alias("text"))


def mix(docs: DataFrame, weights: DataFrame | tuple = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, block: int = BLOCK, shard: int = SHARD, seed: int = 12) -> Mix:
    """A mix of all ``docs(doc_id, text, source)`` in which sources stand by their weights.

    ``weights`` is a table ``source, weight`` or a tuple that sources take by
    turns in code-point order, null last. All targets share ``share`` times all
    words by weight; a target stops at ``repeats`` times its source, and what
    it leaves is shared among the others. A source's words meet its target to
    within about a block; no word comes more than ``repeats`` times. The same
    table and seed give the same mix.

    Null and empty texts hold no words and are taken 0 times; rows without
    doc_id, and repeated rows, are documents each; null sources are a source;
    other columns are ignored; an empty table gives an empty mix.
    """
    return Mix(docs, weights, share, repeats, block, shard, seed)
