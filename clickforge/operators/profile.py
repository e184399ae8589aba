"""Access statistics, re-numbering by frequency, and hot/cold separation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clickforge.operators.batching import assign_batches
from clickforge.operators.encode import HEAD_BYTES, apply_mapping, categorify_fit, value_counts
from clickforge.operators.ordering import index_rows, rank_in_group, running
from clickforge.operators.primitives import partition_flagged
from clickforge.session import materialize


def id_space(spark: SparkSession, sizes: Mapping[str, int]) -> DataFrame:
    """(field, id) for every id of every table, generated in parallel."""
    ranges = [spark.range(n).select(F.lit(f).alias("field"), "id") for f, n in sizes.items()]
    return reduce(DataFrame.union, ranges)


def access_counts(df: DataFrame, fields: Sequence[str], sizes: Mapping[str, int] | None = None) -> DataFrame:
    """(field, id, cnt): how often each id occurs; with ``sizes``, unseen ids count 0."""
    seen = value_counts(df, fields).select("field", F.col("value").alias("id"), "cnt")
    if sizes is None:
        return seen
    return (
        id_space(df.sparkSession, sizes)
        .join(seen, ["field", "id"], "left")
        .select("field", "id", F.coalesce("cnt", F.lit(0)).alias("cnt"))
    )


def frequency_rank(counts: DataFrame) -> DataFrame:
    """Bijection (field, old_id, new_id, cnt): ids by count descending, then id; stored by field."""
    ranked = rank_in_group(counts, ["field"], [F.col("cnt").desc(), F.col("id").asc()], "new_id", few_groups=True)
    return ranked.select("field", F.col("id").alias("old_id"), "new_id", "cnt")


def store_bijection(bijection: DataFrame) -> DataFrame:
    """Keep a bijection from elsewhere as a table partitioned by field, ready for ``apply_bijection``."""
    return materialize(bijection.select("field", "old_id", "new_id"), "bijection", ["field"])


def apply_bijection(df: DataFrame, bijection: DataFrame, fields: Mapping[str, str] | Sequence[str]) -> DataFrame:
    """Renumber the ids of every field."""
    return apply_mapping(df, bijection, fields, old="old_id", new="new_id")


def choose_bijection(frequency: DataFrame, community: DataFrame, reorder_fields: Sequence[str],
                     reorder: bool = True) -> DataFrame:
    """Community map for the fields in the list, frequency map for all others."""
    columns = ["field", "old_id", "new_id"]
    if not reorder or not reorder_fields:
        return frequency.select(columns)
    listed = F.col("field").isin(list(reorder_fields))
    return community.filter(listed).select(columns).union(frequency.filter(~listed).select(columns))


def _field_totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("field").agg(F.sum("cnt").alias("total"))


def hot_ids(counts: DataFrame, threshold_pct: Mapping[str, float] | float = 0.0001) -> DataFrame:
    """(field, id, cnt, hot_no): ids whose share in percent exceeds the threshold, numbered over (field, id).

    Fewer than 100 / threshold ids per field can pass.
    """
    if isinstance(threshold_pct, Mapping):
        limit = F.coalesce(*[F.when(F.col("field") == f, F.lit(t)) for f, t in threshold_pct.items()])
    else:
        limit = F.lit(threshold_pct)
    totals = F.broadcast(_field_totals(counts))  # one row per field
    hot = counts.join(totals, "field").filter(F.col("cnt") * 100 / F.col("total") > limit)
    return index_rows(hot.select("field", "id", "cnt"), ["field", "id"], "hot_no", "hot")


def classify_rows(df: DataFrame, hot: DataFrame, fields: Sequence[str],
                  is_hot: str = "is_hot", numbers: str = "hot_numbers") -> DataFrame:
    """A row is hot when all its ids are; a hot row also gets the vector of hot numbers.

    Works on wide rows: one lookup per field and no regrouping of rows.
    """
    stored = materialize(hot.select("field", "id", "hot_no"), "hot", ["field"])
    tagged = df.withColumns({f"_hot_{f}": F.col(f) for f in fields})
    tagged = apply_mapping(tagged, stored, {f"_hot_{f}": f for f in fields}, old="id", new="hot_no")
    all_hot = reduce(lambda a, b: a & b, [F.col(f"_hot_{f}").isNotNull() for f in fields])
    vector = F.array(*[F.col(f"_hot_{f}") for f in fields])
    return (
        tagged.withColumn(is_hot, all_hot)
        .withColumn(numbers, F.when(F.col(is_hot), vector))
        .drop(*[f"_hot_{f}" for f in fields])
    )


def hot_batch_quota(rows: DataFrame, iterations: int, is_hot: str = "is_hot", epoch: bool = False) -> DataFrame:
    """(n_hot, n_normal, hot_iters, normal_iters): iterations shared out by row counts.

    ``epoch`` takes ``iterations`` as the number of batches of one epoch and leaves its last hot batch, which may be short,
    out. Neither share is below 0; without rows both are null.
    """
    hot = F.col(is_hot).cast("bigint")
    counts = rows.agg(F.sum(hot).alias("n_hot"), F.sum(1 - hot).alias("n_normal"))
    scaled = F.lit(iterations).cast("bigint") * F.col("n_normal") + 1
    normal = F.call_function("div", scaled, F.col("n_hot") + F.col("n_normal"))
    hot_iters = F.lit(iterations - int(epoch)) - F.col("normal_iters")
    return counts.withColumn("normal_iters", normal).withColumn("hot_iters", F.when(hot_iters < 0, 0).otherwise(hot_iters))


def hot_prefix(ranks: DataFrame, frac: float = 0.05) -> DataFrame:
    """(field, n_ids, hot, coverage): the first ``frac`` of the ranks and their share of all accesses."""
    sizes = ranks.groupBy("field").agg(
        F.count(F.lit(1)).alias("n_ids"), F.sum("cnt").alias("total")
    ).withColumn("hot", F.floor(F.col("n_ids") * F.lit(frac)).cast("bigint"))
    return (
        ranks.join(F.broadcast(sizes), "field")  # one row per field
        .groupBy("field")
        .agg(
            F.first("n_ids").alias("n_ids"),
            F.first("hot").alias("hot"),
            F.sum(F.when(F.col("new_id") < F.col("hot"), F.col("cnt")).otherwise(0)).alias("hot_cnt"),
            F.first("total").alias("total"),
        )
        .select("field", "n_ids", "hot", "hot_cnt", (F.col("hot_cnt") / F.col("total")).alias("coverage"))
    )


def profile_table(ranks: DataFrame, top: int | None = None) -> DataFrame:
    """(field, new_id, old_id, cnt, share, cum_cnt, cum_share) per field in rank order; ``top`` keeps the first ranks."""
    totals = F.broadcast(_field_totals(ranks))  # one row per field
    cumulated = running(ranks, ["new_id"], "cnt", "cum_cnt", group=["field"])
    if top is not None:
        cumulated = cumulated.filter(F.col("new_id") < top)
    return cumulated.join(totals, "field").select(
        "field", "new_id", "old_id", "cnt",
        (F.col("cnt") / F.col("total")).alias("share"),
        "cum_cnt",
        (F.col("cum_cnt") / F.col("total")).alias("cum_share"),
    )


def lfu_cache_set(lookups: DataFrame, cache_size: int, id_col: str = "id") -> DataFrame:
    """(id, cnt, slot) of the most frequent ids; ties go to the smaller id."""
    counts = lookups.groupBy(F.col(id_col).alias("id")).agg(F.count(F.lit(1)).alias("cnt"))
    ranked = index_rows(counts, [F.col("cnt").desc(), F.col("id").asc()], "slot", "cache")
    return ranked.filter(F.col("slot") < cache_size)


def cache_split(lookups: DataFrame, cache: DataFrame, pos: str, id_col: str = "id",
                warm_up: bool = False, tables: int = 1, head_bytes: int = HEAD_BYTES) -> DataFrame:
    """Add ``slot``, ``is_hit`` and ``out_pos``: misses first in order, then hits in reverse order.

    During warm-up every lookup is a miss, and so it is when the lookups belong to several tables.
    Slots go by frequency, so the first ones are broadcast and only ids that they do not know are sent to the rest.
    """
    if warm_up or tables > 1:
        joined = lookups.withColumn("slot", F.lit(None).cast("bigint"))
    else:
        slots = cache.select(F.lit("cache").alias("field"), "id", F.col("slot").cast("bigint").alias("slot"))
        joined = apply_mapping(lookups.withColumn("slot", F.col(id_col)), slots, {"slot": "cache"}, old="id", new="slot", head_bytes=head_bytes)
    flagged = joined.withColumn("_miss", F.col("slot").isNull())
    return partition_flagged(flagged, "_miss", pos=pos).withColumn("is_hit", ~F.col("_miss")).drop("_miss")


# ---- distinct ids of each mini-batch ------------------------------------------------------------


def _batch_sets(df: DataFrame, fields: Sequence[str], batch: str) -> DataFrame:
    """(batch, field, n_rows, ids): one shuffle for all fields, without multiplying the rows.

    A set holds at most one batch of rows. Rows of a batch mostly lie in one partition, so the sets
    form before the shuffle.
    """
    sets = df.groupBy(batch).agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.collect_set(F.col(f).cast("bigint")).alias(f) for f in fields]
    )
    return sets.unpivot([batch, "n_rows"], list(fields), "field", "ids").select(batch, "field", "n_rows", "ids")


def batch_unique(df: DataFrame, fields: Sequence[str], batch: str = "batch") -> DataFrame:
    """(batch, field, ids, n): sorted distinct ids of each batch."""
    lists = _batch_sets(df, fields, batch).select(batch, "field", F.sort_array("ids").alias("ids"))
    return lists.withColumn("n", F.size("ids").cast("bigint"))


def batch_inverse(df: DataFrame, fields: Sequence[str], batch: str = "batch", in_batch: str = "in_batch") -> DataFrame:
    """(batch, field, in_batch, inv): each row's place in the sorted distinct ids of its batch."""
    long = df.select(batch, in_batch, *[F.col(f).cast("bigint").alias(f) for f in fields]).unpivot(
        [batch, in_batch], list(fields), "field", "id"
    )
    window = Window.partitionBy(batch, "field").orderBy("id")  # at most one batch of rows
    return long.select(batch, "field", in_batch, (F.dense_rank().over(window) - 1).cast("bigint").alias("inv"))


def batch_sizes(df: DataFrame, fields: Sequence[str], batch: str = "batch") -> DataFrame:
    """(batch, field, n_rows, n_unique, max_id)."""
    return _batch_sets(df, fields, batch).select(
        batch, "field", "n_rows", F.size("ids").cast("bigint").alias("n_unique"), F.array_max("ids").alias("max_id")
    )


def unique_offsets(sizes: DataFrame, batch: str = "batch", n: str = "n_unique") -> DataFrame:
    """(field, batch, lo, hi): where each batch's list lies in the concatenated lists of its field."""
    ends = running(sizes.select("field", batch, n), [batch], n, "hi", group=["field"])
    return ends.select("field", batch, (F.col("hi") - F.col(n)).alias("lo"), "hi")


def max_unique(sizes: DataFrame, n: str = "n_unique") -> DataFrame:
    return sizes.groupBy("field").agg(F.max(n).alias("max_unique"))


def reuse_ratio(sizes: DataFrame, batch: str = "batch") -> DataFrame:
    """Share of lookups that per-batch deduplication saves."""
    return sizes.select(batch, "field", "n_rows", "n_unique", (1 - F.col("n_unique") / F.col("n_rows")).alias("reuse"))


def batch_overlap(unique: DataFrame, batch: str = "batch") -> DataFrame:
    """(batch, field, idx, id, prev_idx): place of each id in the previous batch's list, or -1."""
    long = unique.select(batch, "field", F.posexplode("ids").alias("idx", "id")).withColumn("idx", F.col("idx").cast("bigint"))
    previous = long.select((F.col(batch) + 1).alias(batch), "field", "id", F.col("idx").alias("prev_idx"))
    return long.join(previous, [batch, "field", "id"], "left").withColumn("prev_idx", F.coalesce("prev_idx", F.lit(-1)))


def cache_sync(current: DataFrame, batch: str = "batch", pos: str = "in_batch", id_col: str = "id",
               vec: str = "vec") -> DataFrame:
    """Replace a batch's vectors by the previous batch's vectors where the id occurs in both.

    When the previous batch has an id several times, its smallest position counts.
    """
    previous = (
        current.groupBy(batch, id_col)
        .agg(F.min_by(vec, pos).alias("_prev"))
        .withColumn(batch, F.col(batch) + 1)
    )
    joined = current.join(previous, [batch, id_col], "left")
    return joined.withColumn(vec, F.coalesce("_prev", vec)).withColumn("synced", F.col("_prev").isNotNull()).drop("_prev")


def rank_encoding(vocabulary: DataFrame, n_rows: int) -> tuple[DataFrame, dict[str, int]]:
    """Dictionary encoding and frequency re-numbering of the training rows as one mapping (field, value, new_id).

    The vocabulary already is in frequency order and holds the counts; the other rows of a field
    carry the unknown id 0. So the rank of an id is its place in the vocabulary, moved up by one
    if id 0 is at least as frequent, and neither the rows are counted again nor anything sorted.
    Also returns, per field, the rank of id 0 where it occurs.
    """
    known = {r["field"]: r["n"] for r in vocabulary.groupBy("field").agg(F.sum("cnt").alias("n")).collect()}
    unknown = {f: n_rows - n for f, n in known.items()}
    missing = F.coalesce(*[F.when(F.col("field") == f, F.lit(n)) for f, n in unknown.items()])
    ahead = ((missing > 0) & (missing >= F.col("cnt"))).cast("bigint")
    mapping = vocabulary.select("field", "value", (F.col("id") - 1 + ahead).alias("new_id"))
    rank_of_unknown: dict[str, int] = {}
    if any(unknown.values()):
        above = vocabulary.filter(F.col("cnt") > missing).groupBy("field").agg(F.count(F.lit(1)).alias("n"))
        rank_of_unknown = {f: 0 for f, n in unknown.items() if n} | {
            r["field"]: r["n"] for r in above.collect() if unknown[r["field"]]
        }
    return mapping, rank_of_unknown


def access_profile(df: DataFrame, fields: Sequence[str], pos: str, batch_size: int, max_size: int | None = None,
                   drop_last: bool = False) -> DataFrame:
    """Encode, count, re-number by frequency, and report per batch what deduplication saves.

    (batch, field, n_rows, n_unique, max_rank, reuse); with ``drop_last`` full batches only.
    """
    rows = df.select(pos, *fields)
    n_rows = rows.count()
    mapping, unknown = rank_encoding(categorify_fit(rows, fields, max_size), n_rows)
    renumbered = apply_mapping(rows, mapping, fields, new="new_id", default=unknown)
    batches = assign_batches(renumbered, batch_size, pos=pos, n_rows=n_rows, drop_last=drop_last)
    sizes = batch_sizes(batches, fields)
    return sizes.select(
        "batch", "field", "n_rows", "n_unique", F.col("max_id").alias("max_rank"),
        (1 - F.col("n_unique") / F.col("n_rows")).alias("reuse"),
    )
