"""Reductions and sorts of segments that are given by offset pairs; segments may be empty, overlap and nest.

Rows are folded into blocks of ``FAN`` rows, those into blocks of ``FAN`` blocks, and so on. A segment is then at most two
slices of a block per level, whatever its length, so no row is repeated for the segments it lies in. Level 0 is stored in
buckets of its block number: rows move once, and afterwards only slices travel to them.

All operators take a dense 0-based position ``pos`` (a hole or a repeated position raises an error) and a table of segments
with a unique id ``segment`` and the offsets ``begin`` (included) and ``end`` (left out). Offsets outside the rows are cut
to them; a null offset, or an end that is not after the begin, is an empty segment.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickforge.functions.scalars import int_div
from clickforge.operators.ordering import rank_in_group
from clickforge.session import materialize, materialize_bucketed

FAN = 1024
LONG_ROWS = 1 << 16  # rows of a segment that one task sorts at most
HOT_SHARE = 256  # a block that more than this part of all slices ask for is broadcast; fewer than HOT_SHARE blocks can be


class BlockTree:
    """Blocks of ``item`` over dense positions, with the folded values of whole blocks above them.

    ``fold`` turns an array of items into one; without it only level 0 is stored.
    """

    def __init__(self, df: DataFrame, pos: str, item: Column, fold: Callable[[Column], Column] | None, fan: int = FAN):
        if fan < 2:
            raise ValueError("a block needs at least two places")
        self.fan, self.fold = fan, fold
        self.buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = df.select(F.col(pos).cast("bigint").alias("_pos"), item.alias("_item"))
        blocks = self._blocks(rows, self.buckets)
        self.ground = materialize_bucketed(blocks, "blocks", ["block"], self.buckets)
        self.n_rows = self.ground.agg(F.max(F.col("block") * fan + F.size("items"))).first()[0] or 0
        sizes, level, self.upper = [self.n_rows], self.ground, None
        while sizes[-1] >= fan:
            sizes.append(-(-sizes[-1] // fan))
            if fold is not None:
                level = level.select(F.col("block").alias("_pos"), fold(F.col("items")).alias("_item"))
                level = materialize(self._blocks(level).withColumn("level", F.lit(len(sizes) - 1)), "blocks")
                self.upper = level if self.upper is None else self.upper.unionByName(level)
        self.levels = len(sizes)

    def _blocks(self, rows: DataFrame, buckets: int | None = None) -> DataFrame:
        """(block, items): a group holds at most ``fan`` rows."""
        placed = rows.select(
            int_div("_pos", self.fan).alias("block"),
            F.struct(F.pmod("_pos", F.lit(self.fan).cast("bigint")).alias("slot"), F.col("_item").alias("item")).alias("cell"),
        )
        if buckets:
            placed = placed.repartition(buckets, "block")
        cells = placed.groupBy("block").agg(F.sort_array(F.collect_list("cell")).alias("cells"))
        dense = F.col("cells.slot") == F.sequence(F.lit(0).cast("bigint"), F.size("cells").cast("bigint") - 1)
        items = F.when(dense, F.col("cells.item")).otherwise(F.raise_error(F.lit("positions are not dense")))
        return cells.select("block", items.alias("items"))

    def slices(self, segments: DataFrame, segment: str, begin: str, end: str) -> DataFrame:
        """(segment, begin, level, block, low, high): the slices that make up each segment."""
        low = F.greatest(F.lit(0).cast("bigint"), F.col(begin).cast("bigint"))
        high = F.least(F.lit(self.n_rows).cast("bigint"), F.col(end).cast("bigint"))
        given = F.col(begin).isNotNull() & F.col(end).isNotNull()
        found = []
        for level in range(self.levels):
            width = self.fan**level
            first, last = int_div(low + (width - 1), width), int_div(high, width)  # whole blocks of the level below
            left, right = int_div(first, self.fan), int_div(last, self.fan)
            at, to = first - left * self.fan, last - right * self.fan
            same, some = left == right, given & (first < last)

            def cut(block: Column, start: Column, stop: Column, level: int = level) -> Column:
                return F.struct(F.lit(level).alias("level"), block.alias("block"),
                                start.cast("int").alias("low"), stop.cast("int").alias("high"))

            found.append(F.when(some & same, cut(left, at, to)))
            found.append(F.when(some & ~same & (at > 0), cut(left, at, F.lit(self.fan))))
            found.append(F.when(some & ~same & (to > 0), cut(right, F.lit(0), to)))
        pieces = segments.select(F.col(segment).alias("segment"), F.col(begin).cast("bigint").alias("begin"),
                                 F.explode(F.array_compact(F.array(*found))).alias("piece"))
        return pieces.select("segment", "begin", "piece.*")

    def ground_slices(self, slices: DataFrame) -> DataFrame:
        """The same segments as slices of level 0 only: one for each block that a segment touches."""
        down = slices.filter(F.col("level") == self.levels - 1)
        for level in range(self.levels - 1, 0, -1):  # at most ``fan`` rows come of one
            inner = F.explode(F.sequence(F.col("low"), F.col("high") - 1)).alias("_place")
            down = down.select("*", inner).select(
                "segment", "begin", F.lit(level - 1).alias("level"), (F.col("block") * self.fan + F.col("_place")).alias("block"),
                F.lit(0).alias("low"), F.lit(self.fan).alias("high"),
            ).unionByName(slices.filter(F.col("level") == level - 1))
        return down

    def contents(self, slices: DataFrame) -> DataFrame:
        """Add ``items``, the part of its block that each slice names.

        Hot blocks are broadcast, as their slices would fill one task.
        """
        stored = materialize(slices, "slices")
        counts = materialize(stored.groupBy("level", "block").agg(F.count(F.lit(1)).alias("n")), "slice-counts")
        limit = (counts.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE
        hot = counts.filter((F.col("n") > limit) & (F.lit(limit) > 0)).select("level", "block")
        asked = F.broadcast(hot)  # fewer than HOT_SHARE rows
        levels = [self.ground.join(asked.filter("level = 0"), "block")]
        if self.upper is not None:
            levels.append(self.upper.join(asked, ["level", "block"]))
        hot_blocks = materialize(
            reduce(DataFrame.unionByName, [b.select("level", "block", F.col("items").alias("_hot")) for b in levels]), "hot-blocks"
        )
        marked = stored.join(F.broadcast(hot_blocks), ["level", "block"], "left")
        rest = marked.filter(F.col("_hot").isNull()).drop("_hot")
        dealt = rest.filter("level = 0").repartition(self.buckets, "block")
        met = [marked.filter(F.col("_hot").isNotNull()).withColumnRenamed("_hot", "items"), dealt.join(self.ground, "block")]
        if self.upper is not None:
            met.append(rest.filter("level > 0").join(self.upper, ["level", "block"]))
        part = F.slice("items", F.col("low") + 1, F.col("high") - F.col("low")).alias("items")
        return reduce(DataFrame.unionByName, [m.select(*stored.columns, part) for m in met])


def _sum_type(kind: T.DataType) -> T.DataType:
    if isinstance(kind, T.IntegralType):
        return T.LongType()
    return T.DecimalType(38, kind.scale) if isinstance(kind, T.DecimalType) else T.DoubleType()


def _array_sum(kind: T.DataType) -> Callable[[Column], Column]:
    def fold(items: Column) -> Column:
        return F.aggregate(items, F.lit(None).cast(kind), lambda a, x: F.coalesce((a + x).cast(kind), a, x))

    return fold


def _reduced(tree: BlockTree, segments: DataFrame, segment: str, begin: str, end: str, combine: Callable) -> DataFrame:
    """(segment, begin, result) for every segment, null for those without values."""
    cuts = tree.contents(tree.slices(segments, segment, begin, end))
    parts = cuts.select("segment", "begin", tree.fold(F.col("items")).alias("part"), F.lit(0).alias("own"))
    own = segments.select(F.col(segment).alias("segment"), F.col(begin).cast("bigint").alias("begin"),
                          F.lit(None).alias("part"), F.lit(1).alias("own"))
    result = F.when(F.sum("own") == 1, combine("part")).otherwise(F.raise_error(F.lit("segment ids are not unique")))
    return parts.unionByName(own).groupBy("segment").agg(F.max("begin").alias("begin"), result.alias("result"))


def reduce_between(
    df: DataFrame, pos: str, value: str, segments: DataFrame, op: str | tuple[Callable, Callable] = "sum", initial=None,
    segment: str = "segment", begin: str = "begin", end: str = "end", fan: int = FAN,
) -> DataFrame:
    """(segment, result) over the rows from ``begin`` to before ``end``; segments without values give ``initial``.

    ``op`` is ``"sum"``, ``"min"``, ``"max"``, or a pair of an associative fold of an array column and the aggregate function
    that combines its results. Null values are left out. Sums are added up, never differences of longer sums, so
    floating-point segments keep their own precision; integers are summed as BIGINT, and too large sums raise an error.
    """
    item = F.col(value)
    if op == "sum":
        kind = _sum_type(df.schema[value].dataType)
        item, fold, combine = item.cast(kind), _array_sum(kind), F.sum
    elif isinstance(op, str):
        fold, combine = {"min": (F.array_min, F.min), "max": (F.array_max, F.max)}[op]
    else:
        fold, combine = op
    reduced = _reduced(BlockTree(df, pos, item, fold, fan), segments, segment, begin, end, combine)
    result = F.col("result") if initial is None else F.coalesce("result", F.lit(initial))
    return reduced.select(F.col("segment").alias(segment), result.alias("result"))


def arg_between(
    df: DataFrame, pos: str, value: str, segments: DataFrame, largest: bool = False,
    segment: str = "segment", begin: str = "begin", end: str = "end", fan: int = FAN,
) -> DataFrame:
    """(segment, idx, value): the first smallest or largest value of each segment and its distance from ``begin``.

    Segments without values give nulls.
    """
    place = F.col(pos).cast("bigint")
    item = F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), (-place if largest else place).alias("p")))
    fold, combine = (F.array_max, F.max) if largest else (F.array_min, F.min)
    reduced = _reduced(BlockTree(df, pos, item, fold, fan), segments, segment, begin, end, combine)
    found = -F.col("result.p") if largest else F.col("result.p")
    return reduced.select(F.col("segment").alias(segment), (found - F.col("begin")).alias("idx"), F.col("result.v").alias("value"))


def sort_between(
    df: DataFrame, pos: str, order_by: Sequence[Column | str], segments: DataFrame, out: str = "out_pos",
    segment: str = "segment", begin: str = "begin", end: str = "end", fan: int = FAN,
) -> DataFrame:
    """(segment, columns of the rows..., out_pos): the rows of each segment with their place after sorting it.

    Places start at the segment's first row; ties keep their order. Rows in several segments come once for each, and rows in none
    do not come. A segment meets the blocks that it touches, and rows that are in it leave them. The pieces of a segment of up to
    ``LONG_ROWS`` rows travel to one task, which sorts them; longer segments are sorted by many tasks.
    """
    taken = {segment, out} & set(df.columns)
    if taken:
        raise ValueError(f"columns {sorted(taken)} of the rows have names of the result")
    tree = BlockTree(df, pos, F.struct(*df.columns), None, fan)
    pieces = materialize(tree.ground_slices(tree.slices(segments, segment, begin, end)), "pieces")
    lengths = pieces.groupBy("segment").agg(F.sum(F.col("high") - F.col("low")).alias("n"))
    long = materialize(lengths.filter(F.col("n") > LONG_ROWS).select(F.col("segment").alias("_long")), "long-segments")
    has_long = not long.isEmpty()

    def rows(some: DataFrame, together: bool) -> DataFrame:
        cuts = tree.contents(some)
        cuts = cuts.repartition("segment") if together else cuts
        found = cuts.select(F.col("segment").alias(segment), F.greatest("begin", F.lit(0)).alias("_begin"), F.explode("items").alias("_row"))
        return found.select(segment, "_begin", "_row.*")

    is_long = pieces["segment"].eqNullSafe(long["_long"])
    short = rows(pieces.join(long, is_long, "left_anti") if has_long else pieces, True)
    own = Window.partitionBy(segment).orderBy(*order_by, pos)  # at most LONG_ROWS rows
    ranked = short.withColumn("_rank", F.row_number().over(own).cast("bigint") - 1)
    if has_long:
        ranked = ranked.unionByName(rank_in_group(rows(pieces.join(long, is_long, "left_semi"), False), [segment], [*order_by, pos], "_rank"))
    return ranked.select(segment, *df.columns, (F.col("_begin") + F.col("_rank")).alias(out))
