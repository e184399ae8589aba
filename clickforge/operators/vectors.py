"""Keyed vector lookup: dense tables, bags, and tensor-train factored tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickforge.functions.arrow import from_matrix, to_matrix
from clickforge.functions.scalars import int_div, mixed_radix
from clickforge.functions.vectors import vector_sum, zero_vector
from clickforge.operators.ordering import running
from clickforge.session import materialize

CORE_LIMIT_BYTES = 256 << 20
BLOCK_IDS = 1 << 21  # ids that the rows of a block ask for, repeats included
BLOCK_ROWS = 1 << 21  # rows that pass by the vectors of a block
HELD_BYTES = 128 << 20  # vectors that a block holds for a key column, at 8 bytes a number
MAX_CELLS = 4096  # combinations of slices


def lookup(df: DataFrame, table: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    """Add the vector of each key; a key that is null or not in the table gets a null vector.

    The table is unique on the keys, so the adaptive skew join may split a hot id on the row side.
    """
    return df.join(table, list(keys), "left")


def lookup_fields(df: DataFrame, fields: Sequence[str], table: DataFrame, row: str) -> DataFrame:
    """(row, field, id, vec): several same-shape tables, keyed by (field, id), in one join."""
    long = df.select(row, *[F.col(f).cast("bigint").alias(f) for f in fields]).unpivot([row], list(fields), "field", "id")
    return lookup(long, table, ("field", "id"))


def lookup_distinct(df: DataFrame, table: DataFrame, batch: str = "batch", id_col: str = "id") -> DataFrame:
    """(batch, id, vec): one vector per distinct id of a batch; joins back to the rows on (batch, id). Unknown ids have a null vector."""
    distinct = df.select(batch, id_col).distinct()
    return distinct.join(table, id_col, "left").select(batch, id_col, "vec")


def expand_lookup(df: DataFrame, looked_up: DataFrame, batch: str = "batch", id_col: str = "id") -> DataFrame:
    """Vectors of ``lookup_distinct`` back on every row; a key matches at most one batch of rows."""
    return df.join(looked_up, [batch, id_col], "left")


def _n_blocks(spark: SparkSession, ids: int) -> int:
    return max(spark.sparkContext.defaultParallelism, -(-ids // BLOCK_IDS))


def _slices_and_rows(table: DataFrame, n_rows: int, n_keys: int) -> tuple[int, int]:
    """Slices of the table by which a key column is dealt to blocks, and the rows that a block may have."""
    n, numbers = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("vec")), F.lit(0))).first()
    fit = max(1, n * HELD_BYTES // max(1, numbers * 8))
    slices = max(1, -(-n // fit))
    most = max(1, min(BLOCK_ROWS, -(-n_rows // table.sparkSession.sparkContext.defaultParallelism)))
    if slices**n_keys > MAX_CELLS or n * n_keys * slices ** (n_keys - 1) > n_rows * n_keys:
        return 1, min(most, max(1, fit // n_keys))  # random blocks as small as that send fewer vectors
    return slices, most


def lookup_blocks(df: DataFrame, keys: dict[str, str], table: DataFrame) -> DataFrame:
    """Add the vectors of several key columns, {key: name of its vector}; rows without a vector for each of the keys are dropped.

    Rows are dealt to blocks, and a vector travels once to each block that asks for it, however many rows of the block do.
    All joins then happen inside the blocks, by hash, so no row is moved or sorted once it has become wide; the vectors that a
    block's rows ask for by one key column must fit ``HELD_BYTES``. The blocks of a small table are random. Those of a larger
    one share the slices of the table that their keys lie in, and a cell of slices has as many blocks as its rows
    need, however often a key comes. Of a table about as large as the rows, blocks are random again, and small.
    """
    stored = materialize(df.withColumn("_draw", F.rand(7)), "blocks")  # so that a block has the same rows in all branches
    n_rows = stored.count()
    slices, most = _slices_and_rows(table, n_rows, len(keys))
    cell = F.lit(0)
    for key in keys:
        cell = cell * slices + F.pmod(F.xxhash64(key), F.lit(slices)).cast("int")
    sizes = dict(stored.groupBy(cell.alias("c")).count().collect()) if slices > 1 else {0: n_rows}
    parts = [max(1, -(-sizes.get(c, 0) // most)) for c in range(slices ** len(keys))]
    starts, blocks = [sum(parts[:c]) for c in range(len(parts))], sum(parts)
    first, n = (F.element_at(F.lit(x), cell + 1) for x in (starts, parts))
    dealt = stored.withColumn("_block", (first + F.floor(F.col("_draw") * n)).cast("int")).drop("_draw")

    def met(*columns: str) -> DataFrame:
        asked = dealt.select("_block", F.explode(F.array(*columns)).alias("id")).distinct()
        return asked.join(table.select("id", "vec"), "id").select("_block", "id", "vec").repartitionById(blocks, "_block")

    # where all vectors fit, those of all key columns travel together
    found = {key: met(key) for key in keys} if slices > 1 else dict.fromkeys(keys, met(*keys))
    out = dealt.repartitionById(blocks, "_block")
    for key, vec in keys.items():
        vectors = found[key].select("_block", F.col("id").alias(key), F.col("vec").alias(vec))
        out = out.join(vectors.hint("shuffle_hash"), ["_block", key])
    return out.select(*df.columns, *keys.values())


def bag_sums(rows: DataFrame, members: DataFrame, keys: Sequence[str], found: Callable[[DataFrame], DataFrame], dim: int,
             row: str = "row") -> DataFrame:
    """(row, vec): sum of the vectors of the keys that ``members`` names for each row, zero without known ones.

    ``found`` adds ``vec`` to rows with key columns and leaves out unknown keys. Rows are dealt to blocks by hash together with
    their members; a vector travels once to each block that asks for it, and the wide sums are formed there and do not travel.
    A row with very many members is summed by many tasks instead, in parts that meet at the end.
    """
    stored = materialize(members.filter(F.col(row).isNotNull()).select(row, *keys), "members")
    blocks = _n_blocks(rows.sparkSession, stored.count())
    kind = stored.schema[row].dataType
    block = F.pmod(F.xxhash64(F.col(row).try_cast(kind)), F.lit(blocks)).cast("int")  # hashes follow the type
    counts = stored.groupBy(row).agg(F.count(F.lit(1)).alias("_n"))
    hot = materialize(counts.filter(F.col("_n") > BLOCK_IDS // 8).select(row), "hot-rows")  # few: each has many members
    has_hot = not hot.isEmpty()
    dealt = (stored.join(F.broadcast(hot), row, "left_anti") if has_hot else stored).withColumn("_block", block)
    met = found(dealt.select("_block", *keys).distinct()).select("_block", *keys, "vec")
    inside = dealt.repartitionById(blocks, "_block").join(met.repartitionById(blocks, "_block"), ["_block", *keys])
    sums = vector_sum(inside, ["_block", row], "vec", dim)
    wanted = rows.select(row, block.alias("_block")).repartitionById(blocks, "_block")
    out = wanted.join(sums, ["_block", row], "left").select(row, "vec")
    if has_hot:
        large = vector_sum(found(stored.join(F.broadcast(hot), row)), [row], "vec", dim).withColumnRenamed("vec", "_large")
        out = out.join(F.broadcast(large), row, "left").select(row, F.coalesce("vec", "_large").alias("vec"))
    return out.withColumn("vec", F.coalesce("vec", zero_vector(dim)))


def embedding_bag(rows: DataFrame, members: DataFrame, table: DataFrame, dim: int, row: str = "row") -> DataFrame:
    """(row, vec): sum of the vectors of each row's ids; a row without known ids gives the zero vector.

    ``members`` is the long form (row, id), so a bag of any length needs no list.
    """
    return bag_sums(rows, members, ["id"], lambda ids: ids.join(table.select("id", "vec"), "id"), dim, row)


def embedding_bag_lists(bags: DataFrame, ids: str, table: DataFrame, dim: int, row: str = "row") -> DataFrame:
    """The same for rows that hold their ids as an array."""
    return embedding_bag(bags, bags.select(row, F.explode(ids).alias("id")), table, dim, row)


def segment_sum(df: DataFrame, keys: Sequence[str], vec: str, dim: int) -> DataFrame:
    """Sum of the vectors of each segment."""
    return vector_sum(df, keys, vec, dim)


def lengths_to_offsets(lists: DataFrame, order_by: Sequence[Column | str], ids: str) -> DataFrame:
    """Add ``lo`` and ``hi``: where each list lies in the concatenation of all lists."""
    sized = lists.withColumn("_len", F.coalesce(F.size(ids), F.lit(0)).cast("bigint"))
    ends = running(sized, order_by, "_len", "hi")
    return ends.withColumn("lo", F.col("hi") - F.col("_len")).drop("_len")


def offsets_to_rows(values: DataFrame, offsets: DataFrame, n_rows: int, pos: str = "pos") -> DataFrame:
    """Values with (row, table): offsets (k, lo) run over tables x rows, row = k mod B, table = k div B.

    A value belongs to the last list that starts at or before it. List starts are merged into the
    value order and carried forward by a running max, instead of a range join.
    """
    columns = values.columns
    starts = offsets.select(
        F.col("lo").alias(pos), F.col("k").alias("_k"), F.lit(0).alias("_is_value"),
        *[F.lit(None).cast(values.schema[c].dataType).alias(c) for c in columns if c != pos],
    )
    items = values.withColumn("_k", F.lit(None).cast("bigint")).withColumn("_is_value", F.lit(1))
    merged = items.unionByName(starts)
    owned = running(merged, [pos, "_is_value"], "_k", "_owner", how="max").filter("_is_value = 1")
    return owned.select(
        *columns,
        F.pmod(F.col("_owner"), F.lit(n_rows)).cast("bigint").alias("row"),
        int_div("_owner", n_rows).alias("table"),
    )


def prefix_groups(df: DataFrame, p3: int, batch: str = "batch", id_col: str = "id") -> DataFrame:
    """(batch, n_rows, n_groups, reuse): distinct factored-table prefixes of each batch."""
    groups = df.groupBy(batch, int_div(id_col, p3).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    per_batch = groups.groupBy(batch).agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_groups"))
    return per_batch.withColumn("reuse", 1 - F.col("n_groups") / F.col("n_rows"))


@dataclass(frozen=True)
class FactoredShape:
    """Row factors ``p``, width factors ``q`` and inner ranks of a three-core table."""

    p: tuple[int, int, int]
    q: tuple[int, int, int]
    r: tuple[int, int]

    @property
    def rows(self) -> int:
        return self.p[0] * self.p[1] * self.p[2]

    @property
    def dim(self) -> int:
        return self.q[0] * self.q[1] * self.q[2]

    def edge(self, core: int) -> tuple[int, int, int]:
        """(left rank, width factor, right rank) of one core."""
        ranks = (1, *self.r, 1)
        return ranks[core], self.q[core], ranks[core + 1]

    def width(self, core: int) -> int:
        a, q, b = self.edge(core)
        return a * q * b

    @property
    def core_bytes(self) -> int:
        return 8 * sum(self.p[c] * self.width(c) for c in range(3))


def load_cores(cores: DataFrame, shape: FactoredShape, limit: int = CORE_LIMIT_BYTES) -> list[np.ndarray]:
    """The cores (core, i, vec) as matrices on the driver.

    Their size follows from the shape alone and is checked before anything is read. A core row that is
    missing or null counts as zeros; rows beyond the shape are left out.
    """
    if shape.core_bytes > limit:
        raise ValueError(f"cores take {shape.core_bytes} bytes, more than {limit}; use the join form")
    arrays = [np.zeros((shape.p[c], shape.width(c))) for c in range(3)]
    row = cores.select(F.col("core").cast("int"), F.col("i").cast("bigint"), F.col("vec").cast("array<double>").alias("vec"))
    found = row.filter(F.col("vec").isNotNull()).toArrow()
    for c in range(3):
        part = found.filter((pc.field("core") == c) & (pc.field("i") >= 0) & (pc.field("i") < shape.p[c])).combine_chunks()
        if part.num_rows:
            arrays[c][part["i"].to_numpy()] = to_matrix(part["vec"].chunk(0), shape.width(c))
    return arrays


def known_ids(id_col: str, shape: FactoredShape) -> Column:
    """True for the ids that the factored table has; never null."""
    return F.coalesce(F.col(id_col).between(0, shape.rows - 1), F.lit(False))


def _digits(ids: np.ndarray, shape: FactoredShape) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    g, i3 = ids // shape.p[2], ids % shape.p[2]
    return g, g // shape.p[1], g % shape.p[1], i3


def chain(left: np.ndarray, right: np.ndarray, inner: int, right_width: int) -> np.ndarray:
    """Row-wise product of (n, w, inner) by (n, inner, right_width), flattened to (n, w * right_width)."""
    n = len(left)
    product = np.matmul(left.reshape(n, -1, inner), right.reshape(n, inner, right_width))
    return product.reshape(n, -1)


def factored_vectors(ids: np.ndarray, cores: list[np.ndarray], shape: FactoredShape) -> np.ndarray:
    """Vectors of many ids; the first product is computed once per distinct prefix."""
    g, _, _, i3 = _digits(ids, shape)
    prefixes, inverse = np.unique(g, return_inverse=True)
    left = cores[0][prefixes // shape.p[1]]
    half = chain(left, cores[1][prefixes % shape.p[1]], shape.r[0], shape.q[1] * shape.r[1])
    return chain(half[inverse], cores[2][i3], shape.r[1], shape.q[2])


def tt_lookup(df: DataFrame, id_col: str, cores: DataFrame, shape: FactoredShape, out: str = "vec",
              limit: int = CORE_LIMIT_BYTES) -> DataFrame:
    """Add the vector of each id from the factored table.

    Ids that are null or outside the shape get a null vector, missing core rows count as zeros, with either form.
    Cores that fit the limit travel as a broadcast variable: the lookup is then a narrow Arrow
    projection without any shuffle, and ids of an Arrow batch share prefix products. Larger cores
    are joined on their indices.
    """
    if shape.core_bytes > limit:
        return tt_lookup_join(df, id_col, cores, shape, out)
    shared = df.sparkSession.sparkContext.broadcast(load_cores(cores, shape))

    @F.arrow_udf("array<double>")
    def vectors(ids: pa.Array) -> pa.Array:
        filled = ids.fill_null(-1).to_numpy(zero_copy_only=False)
        known = (filled >= 0) & (filled < shape.rows)
        return from_matrix(factored_vectors(np.where(known, filled, 0), shared.value, shape), missing=~known)

    return df.withColumn(out, vectors(F.col(id_col).cast("bigint")))


def _chain_udf(left_width: int, right_width: int, inner: int, columns: int):
    @F.arrow_udf("array<double>")
    def multiply(left: pa.Array, right: pa.Array) -> pa.Array:
        return from_matrix(chain(to_matrix(left, left_width), to_matrix(right, right_width), inner, columns))

    return multiply


def tt_lookup_join(df: DataFrame, id_col: str, cores: DataFrame, shape: FactoredShape, out: str = "vec") -> DataFrame:
    """The same lookup with cores joined by index: distinct prefixes, then distinct ids, then rows."""
    q1, q2, q3 = shape.q
    r1, r2 = shape.r
    i1, i2, i3 = mixed_radix("_id", shape.p)

    def core(k: int, index: str, vec: str) -> DataFrame:
        return cores.filter(F.col("core") == k).select(F.col("i").cast("bigint").alias(index), F.col("vec").alias(vec))

    def or_zeros(vec: str, k: int) -> Column:
        return F.coalesce(vec, zero_vector(shape.width(k)))

    ids = df.select(F.col(id_col).cast("bigint").alias("_id")).filter(known_ids("_id", shape)).distinct()
    split = ids.select("_id", i1.alias("_i1"), i2.alias("_i2"), i3.alias("_i3"))
    prefixes = split.select("_i1", "_i2").distinct()
    prefixes = prefixes.join(core(0, "_i1", "_a"), "_i1", "left").join(core(1, "_i2", "_b"), "_i2", "left")
    first = _chain_udf(q1 * r1, r1 * q2 * r2, r1, q2 * r2)
    second = _chain_udf(q1 * q2 * r2, r2 * q3, r2, q3)
    halves = prefixes.select("_i1", "_i2", first(or_zeros("_a", 0), or_zeros("_b", 1)).alias("_ab"))
    whole = split.join(halves, ["_i1", "_i2"]).join(core(2, "_i3", "_c"), "_i3", "left")
    vectors = whole.select("_id", second("_ab", or_zeros("_c", 2)).alias(out))
    return df.join(vectors, F.col(id_col).cast("bigint") == F.col("_id"), "left").drop("_id")


def tt_materialize(spark: SparkSession, cores: DataFrame, shape: FactoredShape, n: int | None = None) -> DataFrame:
    """(id, vec): the factored table as a dense table, cut to ``n`` rows."""
    n = shape.rows if n is None else min(n, shape.rows)
    return tt_lookup(spark.range(n), "id", cores, shape)


def hybrid_lookup(long: DataFrame, forms: DataFrame, dense: DataFrame, cores: DataFrame, shape: FactoredShape) -> DataFrame:
    """(…, field, id, vec): fields marked dense use the dense table, fields marked factored the cores.

    ``forms`` is (field, form), one row per field.
    """
    tagged = long.join(F.broadcast(forms.select("field", "form")), "field")
    columns = [*long.columns, "vec"]
    plain = tagged.filter("form = 'dense'").join(dense, ["field", "id"], "left")
    plain = plain.withColumn("vec", F.col("vec").cast("array<double>")).select(columns)
    factored = tt_lookup(tagged.filter("form = 'factored'"), "id", cores, shape).select(columns)
    return plain.union(factored)
