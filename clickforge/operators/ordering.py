"""Positions, ranks and running values in a total order, without a one-task window.

Every operator here works in two levels. Rows are range partitioned on (group, order) and
sorted inside each partition, which splits even a group that holds most of the rows. Running values are formed
in the same pass, before the sorted rows are stored. One small row per partition then carries counts or totals
forward; its number is bounded by the number of shuffle partitions, so it may be broadcast whatever the data
size, and the stored rows are not shuffled again.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickforge.functions.scalars import int_div
from clickforge.functions.scans import Carried, sorted_pass
from clickforge.session import materialize

PART, SLOT = "_part", "_slot"
SCAN, CARRY = "_scanned", "_carried"  # structs, so that their fields clash with no column of the rows
CHUNK_ROWS = 1 << 16

_SLOT_BITS = 33  # monotonically_increasing_id keeps the row number of a partition in 33 bits

_RUNNING = {
    "sum": (F.sum, lambda a, b: a + b),
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
}


def _orders(columns: Sequence[Column | str]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in columns]


def same_keys(left: str, right: str, keys: Sequence[str]) -> Column:
    """Null-safe equality of all keys of two aliased frames."""
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def ranged(
    df: DataFrame, order_by: Sequence[Column | str], label: str = "ranged", partition_by: list[str] | None = None
) -> DataFrame:
    """Sort all rows over range partitions, store them, and tag each with its partition and slot.

    Range bounds come from a sample, so the result is written out before anything is counted:
    a recomputed partition could otherwise hold other rows.
    """
    order = _orders(order_by)
    tagged = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_row", F.monotonically_increasing_id())
        .select(
            *df.columns,
            F.shiftright("_row", _SLOT_BITS).alias(PART),
            F.col("_row").bitwiseAND(F.lit((1 << _SLOT_BITS) - 1)).alias(SLOT),
        )
    )
    return materialize(tagged, label, partition_by)


def _part_starts(stored: DataFrame) -> DataFrame:
    """Rows before each partition; one row per non-empty partition."""
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    return (
        stored.groupBy(PART)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(PART, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )


def index_rows(
    df: DataFrame, order_by: Sequence[Column | str], pos: str = "pos", label: str = "index"
) -> DataFrame:
    """Add the 0-based position of each row in the given total order."""
    stored = ranged(df, order_by, label)
    return stored.join(F.broadcast(_part_starts(stored)), PART).select(
        *df.columns, (F.col("_start") + F.col(SLOT)).alias(pos)
    )


def rank_in_group(
    df: DataFrame,
    group: Sequence[str],
    order_by: Sequence[Column | str],
    out: str = "rank",
    few_groups: bool = False,
) -> DataFrame:
    """0-based rank of each row inside its group.

    ``few_groups`` declares that the groups are a handful fixed by the schema (feature fields). The
    result is then stored by group, so a filter on the group reads its files only.
    """
    one = df.withColumn("_one", F.lit(1).cast("bigint"))
    ranked = running(one, order_by, "_one", out, group=group, inclusive=False).select(*df.columns, out)
    return materialize(ranked, "rank", list(group)) if few_groups else ranked


class SortedPass:
    """Rows sorted by (group, order) and stored once, with running values and runs formed on the way.

    ``values`` maps output names to (column, how, inclusive). A carry row per partition holds what the
    partition's first group brings along from earlier ones.
    """

    def __init__(self, df: DataFrame, order_by: Sequence[Column | str], group: Sequence[str] = (),
                 values: dict[str, tuple[str, str, bool]] | None = None, run_keys: Sequence[str] = (), label: str = "running"):
        self.columns, self.group, self.run_keys, self.values = df.columns, list(group), list(run_keys), values or {}
        order = _orders([*self.group, *order_by])
        carried = [Carried(how, df.schema[c].dataType, inclusive) for c, how, inclusive in self.values.values()]
        keys = [*self.group, *self.run_keys, *[c for c, _, _ in self.values.values()]]
        scan = sorted_pass(len(self.group), carried, len(self.run_keys))
        tagged = (
            df.repartitionByRange(*order).sortWithinPartitions(*order)
            .withColumn("_row", F.monotonically_increasing_id())
            .withColumn(SCAN, scan(*[F.col(k) for k in keys], F.lit(True)))  # iterators of one column carry no tuples
            .select(*self.columns, F.shiftright("_row", _SLOT_BITS).alias(PART),
                    F.col("_row").bitwiseAND(F.lit((1 << _SLOT_BITS) - 1)).alias(SLOT), SCAN)
        )
        self.stored = materialize(tagged, label)

    def _edges(self) -> DataFrame:
        """One row per non-empty partition, in order: its first and last row and what the partition before it held."""
        ends = self.stored.filter((F.col(SLOT) == 0) | F.col(f"{SCAN}.last"))  # at most two rows per partition
        totals = []
        for k, (column, how, inclusive) in enumerate(self.values.values()):
            own = F.col(f"{SCAN}.v{k}")
            if not inclusive:
                own = F.coalesce(own, F.lit(0)) + F.coalesce(column, F.lit(0)) if how == "sum" else _RUNNING[how][1](own, F.col(column))
            totals.append(own.alias(f"t{k}"))
        first = F.struct(*[F.col(c) for c in (*self.group, *self.run_keys)], F.lit(0).alias("_"))
        final = F.struct(*[F.col(c) for c in (*self.group, *self.run_keys)], *totals, F.col(f"{SCAN}.run").alias("_run"), SLOT)
        edges = ends.groupBy(PART).agg(
            F.first(F.when(F.col(SLOT) == 0, first), ignorenulls=True).alias("first"),
            F.first(F.when(F.col(f"{SCAN}.last"), final), ignorenulls=True).alias("final"),
        )
        line = Window.orderBy(PART)  # one row per partition
        same = Window.partitionBy(*[f"final.{g}" for g in self.group]).orderBy(PART)
        for k, (_, how, _) in enumerate(self.values.values()):
            edges = edges.withColumn(f"c{k}", _RUNNING[how][0](f"final.t{k}").over(same))
        edges = edges.select("*", F.lag(F.struct("final", *[f"c{k}" for k in range(len(self.values))])).over(line).alias("past"))

        def alike(names: list[str]) -> Column:
            equal = [F.col(f"first.{n}").eqNullSafe(F.col(f"past.final.{n}")) for n in names]
            return reduce(lambda a, b: a & b, equal, F.col("past").isNotNull())

        # a run that goes on from the partition before does not start here
        starts = F.when(alike(self.run_keys), F.lit(0)).otherwise(F.lit(1))
        before = line.rowsBetween(Window.unboundedPreceding, 0)
        carry = F.struct(
            F.struct(*[F.col(f"first.{g}").alias(g) for g in self.group], F.lit(0).alias("_")).alias("first"),
            *[F.when(alike(self.group), F.col(f"past.c{k}")).alias(f"c{k}") for k in range(len(self.values))],
            (starts == 1).alias("fresh"),
            (F.sum(starts.cast("bigint") + F.coalesce(F.col("past.final._run"), F.lit(0))).over(before) - 1).alias("runs"),
            F.sum(F.coalesce(F.col(f"past.final.{SLOT}") + 1, F.lit(0))).over(before).alias("start"),
        )
        return edges.select(F.col(PART), carry.alias(CARRY))

    def rows(self, initial: dict | None = None, pos: str | None = None, run: str | None = None, head: str | None = None) -> DataFrame:
        """The rows with their running values and, if named, their position, run number and whether they begin a run."""
        initial = initial or {}
        joined = self.stored.join(F.broadcast(self._edges()), PART)
        opening = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"{CARRY}.first.{g}")) for g in self.group], F.lit(True))
        out = [F.col(c) for c in self.columns]
        for k, (name, (_, how, _)) in enumerate(self.values.items()):
            parts = [F.when(opening, F.col(f"{CARRY}.c{k}")), F.col(f"{SCAN}.v{k}")]
            start = initial.get(name, 0 if how == "sum" else None)
            if start is not None:
                parts.append(F.lit(start))
            if how == "sum":
                total = reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0)) for p in parts])
            else:
                total = _RUNNING[how][1](*parts)
            out.append(total.alias(name))
        if pos:
            out.append((F.col(f"{CARRY}.start") + F.col(SLOT)).alias(pos))
        number = F.col(f"{CARRY}.runs") + F.col(f"{SCAN}.run")
        if run:
            out.append(number.alias(run))
        if head:
            out.append(F.when(F.col(SLOT) == 0, F.col(f"{CARRY}.fresh")).otherwise(F.col(f"{SCAN}.turn")).alias(head))
        return joined.select(*out)


def running(
    df: DataFrame,
    order_by: Sequence[Column | str],
    value: str,
    out: str,
    group: Sequence[str] = (),
    how: str = "sum",
    inclusive: bool = True,
    initial=None,
) -> DataFrame:
    """Running sum, max or min in a total order, per group if groups are given.

    The values are formed in the sorted pass that stores the rows; what a partition's first group brings from
    earlier partitions is joined on, one row per partition. An exclusive scan starts at ``initial``
    (0 for a sum, null otherwise).
    """
    scanned = SortedPass(df, order_by, group, {out: (value, how, inclusive)})
    return scanned.rows({} if initial is None else {out: initial}).select(*df.columns, out)


def with_neighbor(
    df: DataFrame, pos: str, columns: dict[str, str], step: int = -1, chunk: int = CHUNK_ROWS
) -> DataFrame:
    """Values of the previous (``step=-1``) or next (``step=1``) row by dense position.

    Rows are cut into chunks of fixed size; the row at a chunk's edge is also sent to the chunk
    that needs to see it. Windows stay bounded and no self join is needed.
    """
    home = int_div(pos, chunk)
    edge = chunk - 1 if step == -1 else 0
    guest = home - F.lit(step)
    seats = F.when(F.pmod(F.col(pos), F.lit(chunk)) == edge, F.array(home, guest)).otherwise(F.array(home))
    window = Window.partitionBy("_chunk").orderBy(pos)
    pick = F.lag if step == -1 else F.lead
    seated = df.withColumn("_chunk", F.explode(seats))
    for out, source in columns.items():
        seated = seated.withColumn(out, pick(source, 1).over(window))
    return seated.filter(F.col("_chunk") == home).drop("_chunk")


def file_order(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Add columns that order rows of text or Parquet files as they lie in the files.

    Must be applied to the scan itself. Partition ids do not follow file order, so the order is
    (file, block start, row number inside the scan).
    """
    tagged = df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    )
    return tagged, ["_file", "_block", "_line"]


def index_file_rows(scan: DataFrame, pos: str = "pos") -> DataFrame:
    """Add the 0-based position of each row in file order, without sorting the rows.

    The rows are stored once with the block they were read in: split bounds follow session settings and the
    number of cores, so a second scan could cut the files elsewhere. (file, block, row count) is then
    summed up, one row per scan split, and every row gets its block's start plus its place in the
    block. ``scan`` must be the bare file scan.
    """
    tagged, _ = file_order(scan)
    tagged = materialize(tagged, "file-rows")
    blocks = tagged.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_line").alias("_first"))
    ends = running(blocks, ["_file", "_block"], "_n", "_end")
    starts = ends.select("_file", "_block", "_first", (F.col("_end") - F.col("_n")).alias("_start"))
    joined = tagged.join(materialize(starts, "blocks"), ["_file", "_block"])
    return joined.select(*scan.columns, (F.col("_start") + F.col("_line") - F.col("_first")).alias(pos))
