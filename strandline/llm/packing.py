"""Variable-capacity best-fit packing.

Lengths are whole numbers up to the largest permitted sequence, so the corpus
enters the packer as a histogram: how many pieces have each length. The packer
walks lengths downwards. Pieces go to the open bins with the least room that
still holds them; when no open bin does, it opens as many bins as this length
fills, of the size whose cost, less what its spare room can still earn, is least. Bins with equal contents
move together as one interval of bin numbers, so the work and the plan depend
on the capacity alone, never on the corpus. At the end each bin shrinks to the
smallest permitted size that holds its contents. A distributed rank within each
length then tells every piece its bin.
"""

from __future__ import annotations

import bisect
import heapq
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Permitted sequence lengths, in words with one end mark a document.
SIZES = (1024, 2048, 4096, 8192)
#: Hash groups that share the ranking of one length, at least; and pieces for each of them beyond that.
GROUPS, A_GROUP = 512, 1 << 20


def cost(size: int) -> float:
    """Of one sequence: a fixed part, its tokens, and attention that grows with the square."""
    return 64 + size + size * size / 65536


@dataclass
class Packer:
    """Best-fit decreasing over a histogram of lengths, for several bin sizes at once."""

    sizes: tuple[int, ...] = SIZES
    cost: object = cost
    bins: int = 0
    #: length, first rank, bin of that rank, offset in the bin, how many ranks.
    placed: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    #: by room left: heaps of (first bin, how many, contents so far).
    room: dict[int, list[tuple[int, int, int]]] = field(default_factory=dict)
    rooms: list[int] = field(default_factory=list)

    def _put(self, room: int, first: int, n: int, used: int) -> None:
        if room not in self.room:
            bisect.insort(self.rooms, room)
            self.room[room] = []
        heapq.heappush(self.room[room], (first, n, used))

    def _size_for(self, length: int, tokens: int) -> int:
        """The size to open: ``tokens`` is what is left to place beside this piece, the most its spare room can earn."""
        rate = min(self.cost(s) / s for s in self.sizes)
        return min((s for s in self.sizes if s >= length), key=lambda s: (self.cost(s) - rate * min(s - length, tokens), s))

    def pack(self, histogram: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """The plan as rows (length, first rank, bin, offset, count, size of the bin), sorted; and bins of each size."""
        left = sum(length * n for length, n in histogram.items())
        for length in sorted(histogram, reverse=True):
            n, rank = histogram[length], 0
            while n:
                k = bisect.bisect_left(self.rooms, length)
                if k < len(self.rooms):
                    room = self.rooms[k]
                    first, count, used = heapq.heappop(self.room[room])  # of equal room, the bin opened first
                    if not self.room[room]:
                        del self.room[room], self.rooms[k]
                else:
                    room = self._size_for(length, left - length)
                    first, count, used = self.bins, max(1, n // (room // length)), 0
                    self.bins += count
                each = min(n, room // length)  # as one piece after another: a bin takes all that fit before the next one does
                take = min(count, n // each)
                for j in range(each):
                    self.placed.append((length, rank + j * take, first, used + j * length, take))
                self._put(room - each * length, first, take, used + each * length)
                if take < count:
                    self._put(room, first + take, count - take, used)
                rank, n, left = rank + each * take, n - each * take, left - each * take * length
        final = np.zeros((0, 3), np.int64)
        if self.room:
            final = np.array(sorted((first, n, used) for xs in self.room.values() for first, n, used in xs), np.int64)
        plan = np.array(sorted(self.placed), np.int64).reshape(-1, 5)
        # Intervals only ever split, so a row may span several final ones; cut it where they meet.
        rows = []
        for length, rank, first, used, n in plan:
            i = int(np.searchsorted(final[:, 0], first, "right")) - 1
            while n:
                take = min(n, final[i, 0] + final[i, 1] - first)
                size = next(s for s in sorted(self.sizes) if s >= final[i, 2])
                rows.append((length, rank, first, used, take, size))
                rank, first, n, i = rank + take, first + take, n - take, i + 1
        return np.array(rows, np.int64).reshape(-1, 6), final


def pieces(docs: DataFrame, largest: int) -> DataFrame:
    """``doc_id, piece, start, length``: a document's words and one end mark, cut where it is longer than ``largest``."""
    words = F.coalesce(F.expr(r"regexp_count(text, '[^ \\t\\n\\x0B\\f\\r]+')"), F.lit(0)).cast("long") + 1
    cut = docs.select("doc_id", words.alias("n")).select("doc_id", "n", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / largest).cast("int"))).alias("piece"))
    start = F.col("piece").cast("long") * largest
    return cut.select("doc_id", "piece", start.alias("start"), F.least(F.lit(largest), F.col("n") - start).cast("int").alias("length"))


def pack(docs: DataFrame, sizes: tuple[int, ...] = SIZES, cost=cost) -> DataFrame:
    """Where each piece of ``docs(doc_id, text)`` goes.

    Returns ``doc_id, piece, start, length, bin_id, bin_offset, bin_size``: the
    piece is words [start, start + length) of the text with its end mark, at
    [bin_offset, bin_offset + length) of a sequence of bin_size. Every row is
    packed: a null or empty text is its end mark alone, a text longer than the
    largest size fills several pieces, repeated rows are packed each, and a null
    doc_id is packed like any other. An empty table gives no rows.
    """
    spark, largest = docs.sparkSession, max(sizes)
    # Pieces without doc_id are told apart by where they came from, so that they aren't one group.
    whence = F.when(F.col("doc_id").isNull(), F.spark_partition_id()).otherwise(0)
    all_pieces = stored(pieces(docs, largest).withColumn("whence", whence), "pieces")
    groups = max(GROUPS, all_pieces.count() // A_GROUP)
    all_pieces = all_pieces.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "whence"), F.lit(groups)).cast("int"))
    counts = stored(all_pieces.groupBy("length", "g").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row for each length: capacity at most
    plan, _ = Packer(tuple(sizes), cost).pack(histogram)
    order = np.lexsort((plan[:, 1], plan[:, 0]))
    held = spark.sparkContext.broadcast(plan[order])  # grows with the capacity, not with the corpus
    before = counts.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("length", "g", F.coalesce("base", F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "g").orderBy("doc_id", "piece", "start")
    ranked = all_pieces.withColumn("rank", F.row_number().over(within) - 1).join(before, ["length", "g"])
    ranked = ranked.select("doc_id", "piece", "start", "length", (F.col("base") + F.col("rank")).alias("rank"))

    def place(batches):
        plan = held.value
        wide = plan[:, 0] * (1 << 48) + plan[:, 1]
        for b in batches:
            length, rank = b.column(3).to_numpy().astype(np.int64), b.column(4).to_numpy()
            row = plan[np.searchsorted(wide, length * (1 << 48) + rank, "right") - 1]
            at = [row[:, 2] + rank - row[:, 1], row[:, 3].astype(np.int32), row[:, 5].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *map(pa.array, at)], names=[*b.schema.names[:4], "bin_id", "bin_offset", "bin_size"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length int, bin_id long, bin_offset int, bin_size int")
