"""Dictionary encoding, normalisation, the fitted workflow, and table planning."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickforge.functions.scalars import clip, fill_missing
from clickforge.operators.ordering import rank_in_group
from clickforge.session import materialize, materialize_bucketed

HEAD_BYTES = 64 << 20  # broadcast for all dictionaries of one lookup
ENTRY_BYTES, LONG_VALUE = 48, 256  # of an entry in a broadcast table beside its text; longer texts are in no head


def long_form(df: DataFrame, fields: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., field, value): all fields in one pass.

    Mixed types meet as BIGINT when all are integral, else as STRING.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    integral = all(isinstance(types[f], (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) for f in fields)
    common = "bigint" if integral else "string"
    casted = df.select(*keep, *[F.col(f).cast(common).alias(f) for f in fields])
    return casted.unpivot(list(keep), list(fields), "field", "value")


def value_counts(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, value, cnt) of all non-null values: one scan and one shuffle for every field."""
    return (
        long_form(df, fields)
        .filter(F.col("value").isNotNull())
        .groupBy("field", "value")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def categorify_fit(df: DataFrame, fields: Sequence[str], max_size: int | None = None) -> DataFrame:
    """Vocabulary (field, value, id, cnt), the most frequent value first.

    Id 0 stands for null and unknown values; ids from 1 go by count descending, then value.
    With ``max_size`` at most ``max_size - 1`` values per field get an id; by default all do.
    """
    ranked = rank_in_group(
        value_counts(df, fields), ["field"], [F.col("cnt").desc(), F.col("value").asc()], "_rank", few_groups=True
    )
    kept = ranked if max_size is None else ranked.filter(F.col("_rank") < max_size - 1)
    return kept.select(
        "field", "value", (F.col("_rank") + 1).alias("id"), "cnt"
    )


def head_sizes(mapping: DataFrame, names: Sequence[str], old: str, new: str, budget: int) -> dict[str, int | None]:
    """How many of each field's first entries may be broadcast within ``budget`` bytes; None for the whole dictionary.

    Small dictionaries leave their share of the budget to larger ones. Where numbers repeat, so that a bound on ``new``
    is no bound on the entries, a dictionary that is too large has no head.
    """
    text = isinstance(mapping.schema[old].dataType, T.StringType)
    width = F.least(F.max(F.octet_length(old)), F.lit(LONG_VALUE)) if text else F.lit(0)
    found = mapping.filter(F.col("field").isin(list(set(names)))).groupBy("field").agg(
        F.count(F.lit(1)).alias("n"), (width + ENTRY_BYTES).alias("bytes"), (F.max(F.octet_length(old)) if text else F.lit(0)).alias("longest")
    ).collect()  # one row per field
    heads: dict[str, int | None] = dict.fromkeys(names, 0)
    left = budget
    for i, row in enumerate(sorted(found, key=lambda r: r["n"] * r["bytes"])):
        share = left // (len(found) - i)
        fits = row["n"] * row["bytes"] <= share and (row["longest"] or 0) <= LONG_VALUE
        heads[row["field"]] = None if fits else share // row["bytes"]
        left -= row["n"] * row["bytes"] if fits else share
    cut = {f: h for f, h in heads.items() if h}
    if cut:
        inside = reduce(lambda a, b: a | b, [(F.col("field") == f) & (F.col(new) < h) for f, h in cut.items()])
        for row in mapping.filter(inside).groupBy("field").agg(F.count(F.lit(1)).alias("n")).collect():
            if row["n"] > cut[row["field"]]:
                heads[row["field"]] = 0
    return heads


def _head(mapping: DataFrame, field: str, head: int | None, old: str, new: str) -> DataFrame:
    part = mapping.filter(F.col("field") == field)
    return part if head is None else part.filter((F.col(new) < head) & _short(mapping, old))


def _short(mapping: DataFrame, old: str) -> Column:
    text = isinstance(mapping.schema[old].dataType, T.StringType)
    return F.octet_length(old) <= LONG_VALUE if text else F.lit(True)


def apply_mapping(
    df: DataFrame,
    mapping: DataFrame,
    fields: Mapping[str, str] | Sequence[str],
    old: str = "value",
    new: str = "id",
    default=None,
    head_bytes: int = HEAD_BYTES,
) -> DataFrame:
    """Replace each field's values through a (field, old, new) table; unmatched becomes ``default``,
    one value or one per field. ``fields`` may map a column to the field name used in the mapping.

    ``new`` goes by frequency, so the first entries of every dictionary hold most accesses. These heads are broadcast
    within ``head_bytes`` for all fields together, after their entries were counted. Dictionaries that fit need no shuffle
    at all. For the others, only values that no head knows are sent to the tails, all fields in one shuffle of
    (row, field, value); their numbers come back by row, while the rows stay where they are stored. Nulls are not sent.
    The result is the same for any budget.
    """
    names = dict(fields) if isinstance(fields, Mapping) else {f: f for f in fields}
    if df.isStreaming:
        return _join_each(df, mapping, names, old, new, default)
    heads = head_sizes(mapping, list(names.values()), old, new, head_bytes)
    old_type = mapping.schema[old].dataType
    found = {column: f"_new_{i}" for i, column in enumerate(names)}
    out = df
    for column, name in names.items():
        if heads[name] == 0:
            out = out.withColumn(found[column], F.lit(None).cast(mapping.schema[new].dataType))
            continue
        part = _head(mapping, name, heads[name], old, new).select(F.col(old).alias("_old"), F.col(new).alias(found[column]))
        out = out.join(F.broadcast(part), F.col(column).try_cast(old_type) == F.col("_old"), "left").drop("_old")
    tails = {column: name for column, name in names.items() if heads[name] is not None}
    if tails:
        out = _from_tails(out, mapping, tails, heads, found, old, new)
    values = {}
    for column, name in names.items():
        missing = default.get(name) if isinstance(default, Mapping) else default
        values[column] = F.col(found[column]) if missing is None else F.coalesce(found[column], F.lit(missing))
    return out.withColumns(values).select(*df.columns)


def _from_tails(rows: DataFrame, mapping: DataFrame, tails: dict[str, str], heads: dict[str, int | None],
                found: dict[str, str], old: str, new: str) -> DataFrame:
    """Fill the numbers that the heads did not know.

    The rows are stored once, bucketed by the task that wrote them, so what comes back for (task, slot) meets them
    without moving them. Hot values are in the heads; a frequent value that no dictionary has is left to the adaptive skew join.
    """
    old_type = mapping.schema[old].dataType
    buckets = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tagged = rows.withColumn("_row", F.monotonically_increasing_id()).select(
        *rows.columns, F.shiftright("_row", 33).alias("_task"), F.col("_row").bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")
    )
    stored = materialize_bucketed(tagged, "rows", ["_task"], buckets)
    asked = F.array(*[
        F.when(F.col(found[c]).isNull() & F.col(c).isNotNull(), F.struct(F.lit(i).alias("i"), F.lit(name).alias("field"), F.col(c).try_cast(old_type).alias("_old")))
        for i, (c, name) in enumerate(tails.items())
    ])
    requests = stored.select("_task", "_at", F.explode(F.filter(asked, lambda e: e.isNotNull())).alias("e")).select("_task", "_at", "e.*")
    outside = [(F.col("field") == name) & ~((F.col(new) < heads[name]) & _short(mapping, old)) for name in set(tails.values())]
    tail = mapping.filter(reduce(lambda a, b: a | b, outside)).select("field", F.col(old).alias("_old"), F.col(new).alias("_new"))
    answers = requests.join(tail, ["field", "_old"]).repartition(buckets, "_task").groupBy("_task", "_at").agg(
        *[F.max(F.when(F.col("i") == i, F.col("_new"))).alias(f"_tail_{i}") for i in range(len(tails))]
    )
    joined = stored.join(answers, ["_task", "_at"], "left")
    filled = {found[c]: F.coalesce(found[c], f"_tail_{i}") for i, c in enumerate(tails)}
    return joined.withColumns(filled).select(*rows.columns)


def _join_each(df: DataFrame, mapping: DataFrame, names: Mapping[str, str], old: str, new: str, default) -> DataFrame:
    """One left join per field, for streams, whose rows cannot be stored on the way."""
    out = df
    for column, name in names.items():
        part = mapping.filter(F.col("field") == name).select(F.col(old).alias("_old"), F.col(new).alias("_new"))
        joined = out.join(part, F.col(column).try_cast(mapping.schema[old].dataType) == F.col("_old"), "left")
        missing = default.get(name) if isinstance(default, Mapping) else default
        out = joined.withColumn(column, F.col("_new") if missing is None else F.coalesce(F.col("_new"), F.lit(missing))).drop("_old", "_new")
    return out


def categorify_apply(df: DataFrame, vocabulary: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Replace values by vocabulary ids; null, unseen and capped values become 0."""
    return apply_mapping(df, vocabulary, fields, default=0)


def _cleaned(name: str, fill: float, low: float | None):
    return clip(fill_missing(F.col(name).cast("double"), float(fill)), low=low)


def normalize_fit(df: DataFrame, fields: Sequence[str], fill: float = 0.0, low: float | None = 0.0) -> DataFrame:
    """(field, mean, std) of the filled and clipped columns; sample standard deviation, one scan."""
    moments = df.agg(*[
        F.struct(
            F.lit(f).alias("field"),
            F.avg(_cleaned(f, fill, low)).alias("mean"),
            F.coalesce(F.stddev_samp(_cleaned(f, fill, low)), F.lit(0.0)).alias("std"),
        ).alias(f) for f in fields
    ])
    return moments.select(F.explode(F.array(*fields)).alias("m")).select("m.*")


def normalize_apply(
    df: DataFrame, moments: DataFrame, fields: Sequence[str], fill: float = 0.0, low: float | None = 0.0
) -> DataFrame:
    """(x - mean) / std of the filled and clipped columns; a zero std only centres.

    The moments are one row per field, a number fixed by the schema, and enter the projection
    as literals: no join, and the same code serves batch and streaming rows.
    """
    rows = {r["field"]: (r["mean"], r["std"]) for r in moments.filter(F.col("field").isin(list(fields))).collect()}
    columns = {}
    for f in fields:
        mean, std = rows[f]
        centred = _cleaned(f, fill, low) - F.lit(mean)
        columns[f] = centred / F.lit(std) if std else centred
    return df.withColumns(columns)


def cast_schema(df: DataFrame, cats: Sequence[str], conts: Sequence[str], label: str | None = None) -> DataFrame:
    """Ids to BIGINT; dense columns and the label to FLOAT."""
    types = {c: "bigint" for c in cats} | {c: "float" for c in [*conts, *([label] if label else [])]}
    return df.withColumns({c: F.col(c).cast(t) for c, t in types.items()})


@dataclass
class Workflow:
    """Fitted vocabularies and moments, applied to training, validation or streaming rows."""

    cats: list[str]
    conts: list[str]
    label: str
    vocabulary: DataFrame
    moments: DataFrame
    fill: float = 0.0
    low: float | None = 0.0

    @classmethod
    def fit(cls, df: DataFrame, cats: Sequence[str], conts: Sequence[str], label: str,
            max_size: int | None = None, fill: float = 0.0, low: float | None = 0.0) -> Workflow:
        return cls(
            list(cats), list(conts), label,
            categorify_fit(df, cats, max_size),
            materialize(normalize_fit(df, conts, fill, low), "moments"),
            fill, low,
        )

    def transform(self, df: DataFrame) -> DataFrame:
        encoded = categorify_apply(df, self.vocabulary, self.cats)
        scaled = normalize_apply(encoded, self.moments, self.conts, self.fill, self.low)
        return cast_schema(scaled, self.cats, self.conts, self.label)

    def save(self, path: str) -> None:
        """Two Parquet tables and one JSON line of column roles."""
        self.vocabulary.write.mode("overwrite").partitionBy("field").parquet(f"{path}/vocabulary")
        self.moments.write.mode("overwrite").parquet(f"{path}/moments")
        roles = json.dumps({"cats": self.cats, "conts": self.conts, "label": self.label,
                            "fill": self.fill, "low": self.low})
        spark = self.vocabulary.sparkSession
        spark.createDataFrame([(roles,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/roles")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Workflow:
        roles = json.loads(spark.read.text(f"{path}/roles").first()["value"])
        # the partition column must stay text even if all field names look like numbers
        vocabulary = spark.read.parquet(f"{path}/vocabulary").withColumn("field", F.col("field").cast("string"))
        moments = spark.read.parquet(f"{path}/moments")
        return cls(roles["cats"], roles["conts"], roles["label"], vocabulary, moments, roles["fill"], roles["low"])


def suggested_dim(cardinality, cap: int = 16):
    """Vector width for a table: min(max(16, round(1.6 n^0.56)), 512), then the cap."""
    grown = F.round(F.lit(1.6) * F.pow(cardinality.cast("double"), F.lit(0.56))).cast("bigint")
    return F.least(F.lit(cap).cast("bigint"), F.least(F.greatest(F.lit(16).cast("bigint"), grown), F.lit(512).cast("bigint")))


def embedding_sizes(vocabulary: DataFrame, cap: int = 16) -> DataFrame:
    """(field, cardinality, dim); the cardinality counts the unknown id 0."""
    sizes = vocabulary.groupBy("field").agg((F.max("id") + 1).alias("cardinality"))
    return sizes.withColumn("dim", suggested_dim(F.col("cardinality"), cap))


def dense_footprint(sizes: DataFrame, dim: int, cardinality: str = "cardinality") -> DataFrame:
    """(field, bytes, mb) of dense FLOAT tables and the total as field ``total``."""
    return (
        sizes.rollup("field")
        .agg(F.sum(F.col(cardinality) * (dim * 4)).alias("bytes"))
        .select(
            F.coalesce("field", F.lit("total")).alias("field"),
            "bytes",
            F.round(F.col("bytes") / (1024 * 1024), 2).alias("mb"),
        )
    )


def factored_footprint(shapes: DataFrame, dim: int, q: Sequence[int], rank: Sequence[int]) -> DataFrame:
    """Floats of the factored form against the dense form for (field, cardinality, p1, p2, p3)."""
    cores = [F.col(f"p{i + 1}") * (rank[i] * q[i] * rank[i + 1]) for i in range(3)]
    return (
        shapes.withColumn("factored_floats", cores[0] + cores[1] + cores[2])
        .withColumn("dense_floats", F.col("cardinality") * dim)
        .withColumn("ratio", F.round(F.col("dense_floats") / F.col("factored_floats"), 6))
        .select("field", "factored_floats", "dense_floats", "ratio")
    )


def split_tables_by_size(sizes: DataFrame, threshold: int, cardinality: str = "cardinality") -> DataFrame:
    """Add ``form``: tables above the threshold are factored, the others dense."""
    form = F.when(F.col(cardinality) > threshold, "factored").otherwise("dense")
    return sizes.withColumn("form", form)


def assign_shards(sizes: DataFrame, workers: int, table_no: str = "table_no") -> DataFrame:
    """Whole tables to workers in turn."""
    return sizes.withColumn("worker", F.pmod(F.col(table_no), F.lit(workers)))


def column_shards(table: DataFrame, vec: str, dim: int, width: int) -> DataFrame:
    """Cut each vector into column shards of ``width``: (…, shard, part of the vector)."""
    parts = F.array(*[F.slice(vec, start + 1, width) for start in range(0, dim, width)])
    rest = [c for c in table.columns if c != vec]
    return table.select(*rest, F.posexplode(parts).alias("shard", vec))
