"""Vector lookup, interaction and keyed updates."""

from __future__ import annotations

import numpy as np
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from clickforge.functions.scalars import int_div, mixed_radix
from clickforge.functions.vectors import dequantize, fixed_point, quantize
from clickforge.operators import interaction, stores, update, vectors
from clickforge.operators.ordering import index_rows
from clickforge.plans.registry import CLICKS, Tables, fixed_point_sql, query
from clickforge.session import materialize

DIM = 64
LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]

_N = "n as (select count(*) as n from embeddings)"


def sum_sql(rows: str, keys: str, how: str = "sum") -> str:
    """SQL for the elementwise sum of (keys, vec) rows, as fixed-point text (name ``summed``)."""
    return f"""cells as (select {keys}, unnest(vec) as x, generate_subscripts(vec, 1) as i from {rows}),
cell_sums as (select {keys}, i, {how}(cast(x as double)) as s from cells group by {keys}, i),
summed as (select {keys}, list(s order by i) as vec from cell_sums group by {keys})"""


def as_text(df: DataFrame) -> DataFrame:
    return df.withColumn("vec", fixed_point("vec"))


def _vec_of(t: Tables, key) -> F.Column:
    return F.pmod(key, F.lit(t.n_vectors))


# ---- dense lookups ------------------------------------------------------------------------------


@query("lookup", f"""with {_N}
select o_orderkey, o_custkey % n as id, {fixed_point_sql('embedding')} as vec
from (select * from orders, n) o join embeddings on vec_id = o_custkey % n""")
def lookup(t):
    rows = t.orders.select("o_orderkey", _vec_of(t, F.col("o_custkey")).alias("id"))
    return as_text(vectors.lookup(rows, t.vectors))


@query("lookup_distinct", f"""with {_N}, {CLICKS}
select pos // 512 as batch, pos % 512 as in_batch, user_id % n as id, {fixed_point_sql('embedding')} as vec
from (select * from clicks, n) c join embeddings on vec_id = user_id % n""")
def lookup_distinct(t):
    rows = t.batches(512, "user_id").select("batch", "in_batch", _vec_of(t, F.col("user_id")).alias("id"))
    found = vectors.lookup_distinct(rows, t.vectors)
    return as_text(vectors.expand_lookup(rows, found).select("batch", "in_batch", "id", "vec"))


@query("embedding_bag", f"""with {_N},
members as (select l_orderkey as row, embedding as vec from (select * from lineitem, n) l join embeddings on vec_id = l_partkey % n),
{sum_sql('members', 'row')}
select o_orderkey as row, {fixed_point_sql("coalesce(vec, list_transform(range(64), lambda i: 0.0::double))")} as vec
from orders left join summed on row = o_orderkey""")
def embedding_bag(t):
    members = t.lineitem.select(F.col("l_orderkey").alias("row"), _vec_of(t, F.col("l_partkey")).alias("id"))
    rows = t.orders.select(F.col("o_orderkey").alias("row"))
    return as_text(vectors.embedding_bag(rows, members, t.vectors, DIM))


@query("segment_sum", f"""with {_N},
members as (select l_returnflag, l_linestatus, embedding as vec from (select * from lineitem, n) l join embeddings on vec_id = l_partkey % n),
{sum_sql('members', 'l_returnflag, l_linestatus')}
select l_returnflag, l_linestatus, {fixed_point_sql('vec')} as vec from summed""")
def segment_sum(t):
    rows = t.lineitem.select("l_returnflag", "l_linestatus", _vec_of(t, F.col("l_partkey")).alias("id"))
    return as_text(vectors.segment_sum(vectors.lookup(rows, t.vectors), ["l_returnflag", "l_linestatus"], "vec", DIM))


_TWO_TABLES = f"""{_N}, tab as (select 'part' as field, vec_id as id, embedding as vec from embeddings
  union all select 'supp', n - 1 - vec_id, embedding from embeddings, n)"""


def _two_tables(t):
    n = t.n_vectors
    part = t.vectors.select(F.lit("part").alias("field"), "id", "vec")
    supp = t.vectors.select(F.lit("supp").alias("field"), (F.lit(n) - 1 - F.col("id")).alias("id"), "vec")
    return part.union(supp)


@query("multi_table_lookup", f"""with {_TWO_TABLES},
long as (select l_orderkey, 'part' as field, l_partkey % n as id from lineitem, n
  union all select l_orderkey, 'supp', l_suppkey % n from lineitem, n)
select l_orderkey, field, id, {fixed_point_sql('vec')} as vec from long join tab using (field, id)""")
def multi_table_lookup(t):
    rows = t.lineitem.select("l_orderkey", _vec_of(t, F.col("l_partkey")).alias("part"), _vec_of(t, F.col("l_suppkey")).alias("supp"))
    # a vector is written as text once, not for every row that asks for it
    found = vectors.lookup_fields(rows, ["part", "supp"], as_text(_two_tables(t)), "l_orderkey")
    return found.select("l_orderkey", "field", "id", "vec")


_BAG_SQL = f"""with {_N},
members as (select l_orderkey as row, embedding as vec from (select * from lineitem, n) l join embeddings on vec_id = l_partkey % n),
{sum_sql('members', 'row')}
select o_orderkey as row, {fixed_point_sql("coalesce(vec, list_transform(range(64), lambda i: 0.0::double))")} as vec
from orders left join summed on row = o_orderkey"""


@query("bucketed_lookup", f"""with {_N}
select l_orderkey, l_linenumber, id, {fixed_point_sql('embedding')} as vec
from (select l_orderkey, l_linenumber, case when l_partkey % 3 = 0 then 5 else l_partkey % n end as id from lineitem, n) l join embeddings on vec_id = id""")
def bucketed_lookup(t):
    """A third of the rows ask for one id."""
    id_of = F.when(F.col("l_partkey") % 3 == 0, F.lit(5)).otherwise(_vec_of(t, F.col("l_partkey")))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", id_of.cast("bigint").alias("id"))
    return as_text(stores.VectorTable.create(t.vectors, DIM).lookup(rows))


@query("bucketed_bags", _BAG_SQL)
def bucketed_bags(t):
    members = t.lineitem.select(F.col("l_orderkey").alias("row"), _vec_of(t, F.col("l_partkey")).alias("id"))
    return as_text(stores.VectorTable.create(t.vectors, DIM).bags(t.orders.select(F.col("o_orderkey").alias("row")), members))


@query("bucketed_updates", f"""with {_N}, {CLICKS},
g as (select user_id % n as id, list_transform(embedding, lambda x: 3 * x::double) as vec
  from (select * from clicks, n) c join embeddings on vec_id = pos % n), {sum_sql('g', 'id')},
fresh as (select vec_id + n // 2 as id, list_reverse(embedding) as vec from embeddings, n),
stepped as (select vec_id as id, list_transform(range(1, 65), lambda i: embedding[i]::double - 0.1::double * coalesce(vec[i], 0)) as vec
  from embeddings left join summed on id = vec_id)
select coalesce(f.id, s.id) as id, {fixed_point_sql('coalesce(list_transform(f.vec, lambda x: x::double), s.vec)')} as vec
from stepped s full join fresh f on f.id = s.id""")
def bucketed_updates(t):
    """Two steps and an upsert, each from the version before: the gradients of the first step, then twice as large ones."""
    n = t.n_vectors
    events = t.clicks.select(F.pmod("user_id", F.lit(n)).alias("id"), F.pmod("pos", F.lit(n)).alias("source"))
    grads = events.join(t.vectors.withColumnRenamed("id", "source"), "source").select("id", "vec")
    double = grads.withColumn("vec", F.transform("vec", lambda x: x.cast("double") * 2))
    fresh = t.vectors.select((F.col("id") + n // 2).alias("id"), F.reverse("vec").alias("vec"))
    start = stores.VectorTable.create(t.vectors, DIM)
    return as_text(start.step(grads, 0.1).step(double, 0.1).overwrite(fresh).frame)


@query("lengths_to_offsets", """
with s as (select o_orderkey, count(l_orderkey) as n from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey)
select o_orderkey, cast(sum(n) over (order by o_orderkey) - n as bigint) as lo, cast(sum(n) over (order by o_orderkey) as bigint) as hi from s""")
def lengths_to_offsets(t):
    lists = t.lineitem.groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("ids"))
    orders = t.orders.join(lists, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", "ids")
    return vectors.lengths_to_offsets(orders, ["o_orderkey"], "ids").select("o_orderkey", "lo", "hi")


@query("offsets_to_rows", """
with s as (select o_orderkey as k, count(l_orderkey) as n from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey),
o as (select k, sum(n) over (order by k) - n as lo, sum(n) over (order by k) as hi from s),
v as (select l_orderkey, l_partkey, row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as pos from lineitem)
select pos, l_partkey as id, k % (select count(*) // 3 from orders) as row, k // (select count(*) // 3 from orders) as "table"
from v join o on pos >= lo and pos < hi""")
def offsets_to_rows(t):
    """Orders stand for the lists: list k belongs to row k mod B of table k div B."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    values = index_rows(t.lineitem.select(*order), order).select("pos", F.col("l_partkey").alias("id"))
    offsets = lengths_to_offsets(t).select(F.col("o_orderkey").alias("k"), "lo")
    return vectors.offsets_to_rows(values, offsets, t.orders.count() // 3)


# ---- factored tables ----------------------------------------------------------------------------


@query("mixed_radix", """
select p_partkey, p_partkey // 100 as i1, p_partkey // 10 % 10 as i2, p_partkey % 10 as i3 from part""")
def radix(t):
    i1, i2, i3 = mixed_radix("p_partkey", (200, 10, 10))
    return t.part.select("p_partkey", i1.alias("i1"), i2.alias("i2"), i3.alias("i3"))


@query("prefix_groups", f"""with {CLICKS}
select pos // 512 as batch, count(*) as n_rows, count(distinct user_id // 10) as n_groups,
  round(1 - count(distinct user_id // 10) / count(*)::double, 9) as reuse from clicks group by all""")
def prefix_groups(t):
    rows = t.batches(512, "user_id").withColumnRenamed("user_id", "id")
    return vectors.prefix_groups(rows, 10).withColumn("reuse", F.round("reuse", 9))


def _shape(t: Tables) -> vectors.FactoredShape:
    """20 x 10 x ceil(n / 200) rows for n parts; integer cores keep all sums exact."""
    return vectors.FactoredShape(p=(20, 10, -(-t.part.count() // 200)), q=(2, 2, 2), r=(3, 3))


def _core_value(core, i, at):
    return (F.pmod(core * 31 + i * 7 + at * 3, F.lit(11)) - 5).cast("double")


def _cores(t: Tables, shape: vectors.FactoredShape) -> DataFrame:
    parts = []
    for k in range(3):
        cells = F.transform(F.sequence(F.lit(0), F.lit(shape.width(k) - 1)), lambda at: _core_value(F.lit(k), F.col("id"), at))
        parts.append(t.spark.range(shape.p[k]).select(F.lit(k).alias("core"), F.col("id").alias("i"), cells.alias("vec")))
    return parts[0].union(parts[1]).union(parts[2])


def _cv(core: int, i: str, at: str) -> str:
    return f"(({core} * 31 + {i} * 7 + ({at}) * 3) % 11 - 5)"


_TT = f"""d as (select p_partkey as id, p_partkey // p3 // 10 as i1, p_partkey // p3 % 10 as i2, p_partkey % p3 as i3
  from part, (select (count(*) + 199) // 200 as p3 from part)),
ax as (select j1, j2, j3 from range(2) a(j1), range(2) b(j2), range(2) c(j3)),
rk as (select a, b from range(3) x(a), range(3) y(b)),
tt as (select id, list(v order by j1, j2, j3) as vec from (
  select id, j1, j2, j3, cast(sum({_cv(0, 'i1', 'j1 * 3 + a')} * {_cv(1, 'i2', 'a * 6 + j2 * 3 + b')} * {_cv(2, 'i3', 'b * 2 + j3')}) as double) as v
  from d, ax, rk group by id, j1, j2, j3) group by id)"""


@query("tt_lookup", f"""with {_TT} select l_orderkey, l_linenumber, l_partkey, {fixed_point_sql('vec')} as vec
from lineitem join tt on id = l_partkey""")
def tt_lookup(t):
    shape = _shape(t)
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    return as_text(vectors.tt_lookup(rows, "l_partkey", _cores(t, shape), shape))


@query("tt_lookup_join", f"""with {_TT} select l_orderkey, l_linenumber, l_partkey, {fixed_point_sql('vec')} as vec
from lineitem join tt on id = l_partkey""")
def tt_lookup_join(t):
    """The form for cores beyond the broadcast limit."""
    shape = _shape(t)
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    return as_text(vectors.tt_lookup_join(rows, "l_partkey", _cores(t, shape), shape))


@query("tt_materialize", f"with {_TT} select id, {fixed_point_sql('vec')} as vec from tt")
def tt_materialize(t):
    shape = _shape(t)
    return as_text(vectors.tt_materialize(t.spark, _cores(t, shape), shape, t.part.count()))


@query("hybrid_lookup", f"""with {_TT}, {_N}
select l_orderkey, 'part' as field, l_partkey as id, {fixed_point_sql('vec')} as vec from lineitem join tt on id = l_partkey
union all select l_orderkey, 'supp', l_suppkey % n, {fixed_point_sql('embedding')}
from (select * from lineitem, n) l join embeddings on vec_id = l_suppkey % n""")
def hybrid_lookup(t):
    """Parts are a factored table, suppliers a dense one."""
    shape = _shape(t)
    dense = t.vectors.select(F.lit("supp").alias("field"), "id", "vec")
    forms = t.spark.createDataFrame([("part", "factored"), ("supp", "dense")], "field string, form string")
    long = t.lineitem.select("l_orderkey", F.col("l_partkey").alias("part"), _vec_of(t, F.col("l_suppkey")).alias("supp")).unpivot(
        ["l_orderkey"], ["part", "supp"], "field", "id")
    return as_text(vectors.hybrid_lookup(long, forms, dense, _cores(t, shape), shape))


@query("quantize_vectors", """
with q as (select vec_id as id, list_min(embedding)::double as lo, (list_max(embedding)::double - list_min(embedding)::double) / 255.0::double as scale,
  embedding from embeddings)
select id, round(lo, 6) as lo, round(scale, 9) as scale,
  array_to_string(list_transform(embedding, lambda x: cast(cast(floor((x::double - lo) / scale + 0.5::double) as integer) as varchar)), ',') as q,
  true as close from q""")
def quantize_vectors(t):
    packed = t.vectors.withColumn("p", quantize("vec"))
    off = F.array_max(F.zip_with(dequantize("p"), "vec", lambda a, b: F.abs(a - b)))
    return packed.select(
        "id", F.round("p.lo", 6).alias("lo"), F.round("p.scale", 9).alias("scale"),
        F.array_join(F.col("p.q").cast("array<string>"), ",").alias("q"), (off <= F.col("p.scale") * 0.5000001).alias("close"),
    )


# ---- interaction and scoring --------------------------------------------------------------------

_TRIPLES = f"""{_N}, tri as (select o_orderkey, a.embedding::double[] as d, b.embedding::double[] as u, c.embedding::double[] as w
  from (select *, o_orderkey % n as ka, o_custkey % n as kb, (o_orderkey + o_custkey) % n as kc from orders, n) o
  join embeddings a on a.vec_id = ka join embeddings b on b.vec_id = kb join embeddings c on c.vec_id = kc)"""


def _keyed(t: Tables) -> DataFrame:
    """Per order: the keys of a dense vector and two field vectors."""
    return t.orders.select(
        "o_orderkey", _vec_of(t, F.col("o_orderkey")).alias("ka"), _vec_of(t, F.col("o_custkey")).alias("kb"),
        _vec_of(t, F.col("o_orderkey") + F.col("o_custkey")).alias("kc"),
    )


def _with_triple(keyed: DataFrame, table: DataFrame) -> DataFrame:
    found = vectors.lookup_blocks(keyed, {"ka": "d", "kb": "u", "kc": "w"}, table)
    return found.select(*[c for c in keyed.columns if c not in ("ka", "kb", "kc")], "d", F.array("u", "w").alias("vecs"))


def _triples(t: Tables) -> DataFrame:
    """Per order: a dense vector and two field vectors."""
    return _with_triple(_keyed(t), t.vectors)


@query("pairwise_dot", f"""with {_TRIPLES} select o_orderkey,
  {fixed_point_sql('list_concat(d, [list_dot_product(u, d), list_dot_product(w, d), list_dot_product(w, u)])')} as features from tri""")
def pairwise_dot(t):
    out = interaction.pairwise_dot(_triples(t), "d", "vecs", DIM)
    return out.select("o_orderkey", fixed_point("features").alias("features"))


@query("pairwise_dot_upper", f"""with {_TRIPLES} select o_orderkey,
  {fixed_point_sql('list_concat(d, [list_dot_product(d, u), list_dot_product(d, w), list_dot_product(u, w)])')} as features from tri""")
def pairwise_dot_upper(t):
    out = interaction.pairwise_dot_upper(_triples(t), "d", "vecs", DIM)
    return out.select("o_orderkey", fixed_point("features").alias("features"))


@query("concat_features", f"""with {_TRIPLES} select o_orderkey,
  {fixed_point_sql('list_concat(list_concat(d, u), w)')} as features from tri""")
def concat_features(t):
    out = interaction.concat_features(_triples(t), "d", "vecs")
    return out.select("o_orderkey", fixed_point("features").alias("features"))


def _layers() -> tuple[list[interaction.Layer], list[interaction.Layer]]:
    """Fixed weights: the bottom layer keeps 64 columns, the top layer adds the features up."""
    bottom = [(np.eye(DIM), np.zeros(DIM))]
    top = [(np.full((1, interaction.interaction_width(2, DIM)), 0.5), np.array([-1.0]))]
    return bottom, top


_SCORED = f"""{_TRIPLES}, r as (select o_orderkey, list_transform(d, lambda x: greatest(x, 0.0::double)) as h, u, w from tri),
scored as (select o_orderkey, 1 / (1 + exp(-(0.5 * (list_sum(h) + list_dot_product(u, h) + list_dot_product(w, h) + list_dot_product(w, u)) - 1.0))) as score from r)"""


@query("score_batch", f"with {_SCORED} select o_orderkey, cast(round(score, 6) as double) as score from scored")
def score_batch(t):
    bottom, top = _layers()
    out = interaction.score_batch(_triples(t), "d", "vecs", DIM, DIM, bottom, top)
    return out.select("o_orderkey", F.round("score", 6).alias("score"))


_PICKED = """lab as (select o_orderkey, o_orderkey // 512 as batch, o_orderkey % 512 as in_batch, cast(o_orderstatus = 'P' as bigint) as label from orders),
pick as (select *, 4 * sum(label) over (partition by batch) as quota, sum(1 - label) over (partition by batch order by in_batch) as nth from lab)"""


@query("score_with_pick", f"""with {_SCORED}, {_PICKED}
select o_orderkey, label, cast(round(score, 6) as double) as score from pick join scored using (o_orderkey) where label = 1 or nth <= quota""")
def score_with_pick(t):
    bottom, top = _layers()
    labels = t.orders.select(
        "o_orderkey", int_div("o_orderkey", 512).alias("batch"), F.pmod("o_orderkey", F.lit(512)).cast("bigint").alias("in_batch"),
        (F.col("o_orderstatus") == "P").cast("bigint").alias("label"))
    # orders without all vectors are no candidates; the vectors themselves come when the rows are picked, by their place
    placed = materialize(t.vectors.withColumn("at", F.monotonically_increasing_id()), "placed")
    rows = labels.join(_keyed(t), "o_orderkey")
    for key in ("ka", "kb", "kc"):
        rows = rows.join(placed.select(F.col("id").alias(key), F.col("at").alias(f"_{key}")), key).drop(key).withColumnRenamed(f"_{key}", key)
    table = placed.select(F.col("at").alias("id"), "vec")
    out = interaction.score_with_pick(rows, "label", "batch", "in_batch", prepare=lambda picked: _with_triple(picked, table),
                                      dense="d", vectors="vecs", n_dense=DIM, dim=DIM, bottom=bottom, top=top)
    return out.select("o_orderkey", "label", F.round("score", 6).alias("score"))


# ---- updates ------------------------------------------------------------------------------------

_GRADS = f"""{_N}, {CLICKS}, grads as (select pos, user_id as id, embedding as vec
  from (select * from clicks, n) c join embeddings on vec_id = pos % n)"""


def _grads(t: Tables) -> DataFrame:
    keyed = t.clicks.select("pos", F.col("user_id").alias("id"), _vec_of(t, F.col("pos")).alias("_v"))
    return keyed.join(t.vectors.withColumnRenamed("id", "_v"), "_v").select("pos", "id", "vec")


@query("aggregate_gradients", f"with {_GRADS}, {sum_sql('grads', 'id')} select id, {fixed_point_sql('vec')} as vec from summed")
def aggregate_gradients(t):
    return as_text(update.aggregate_gradients(_grads(t), ["id"], DIM))


@query("apply_sgd", f"""with {_GRADS}, g as (select id % n as id, vec from grads, n), {sum_sql('g', 'id')}
select vec_id as id, {fixed_point_sql("case when vec is null then embedding::double[] else list_transform(range(1, 65), lambda i: embedding[i]::double + vec[i] * -0.1::double) end")} as vec
from embeddings left join summed on id = vec_id""")
def apply_sgd(t):
    grads = _grads(t).withColumn("id", _vec_of(t, F.col("id")))
    return as_text(update.apply_sgd(t.vectors, grads, ["id"], DIM, lr=0.1))


@query("overwrite_rows", f"""with {_N}, fresh as (select vec_id + n // 2 as id, list_reverse(embedding) as vec from embeddings, n)
select coalesce(f.id, vec_id) as id, {fixed_point_sql('coalesce(f.vec, embedding)')} as vec from embeddings full join fresh f on f.id = vec_id""")
def overwrite_rows(t):
    fresh = t.vectors.select((F.col("id") + t.n_vectors // 2).alias("id"), F.reverse("vec").alias("vec"))
    return as_text(update.overwrite_rows(t.vectors, fresh, ["id"]))


@query("replica_average", f"with {_GRADS}, {sum_sql('grads', 'id', 'avg')} select id, {fixed_point_sql('vec')} as vec from summed")
def replica_average(t):
    """Event rows of a user stand for the copies that the workers hold."""
    return as_text(update.replica_average(_grads(t), ["id"], DIM))


@query("tt_core_gradients", """
select cast(3 as bigint) as n_cores, (select 20 + 10 + (count(*) + 199) // 200 from part) as core_rows, true as same_as_rows""")
def tt_core_gradients(t):
    """Gradients summed per distinct id first must equal the row-by-row form."""
    shape = _shape(t)
    cores = materialize(_cores(t, shape), "cores")
    grads = t.lineitem.select(F.col("l_partkey").alias("id"), F.array(*[
        F.pmod(F.col("l_suppkey") + i, F.lit(5)).cast("double") for i in range(shape.dim)]).alias("vec"))
    dedup = update.tt_core_gradients(grads, cores, shape)
    plain = update.tt_core_gradients(grads, cores, shape, dedup=False).withColumnRenamed("vec", "other")
    both = dedup.join(plain, ["core", "i"], "full")
    return both.agg(
        F.countDistinct("core").alias("n_cores"), F.count(F.lit(1)).alias("core_rows"),
        F.bool_and(F.coalesce(F.col("vec") == F.col("other"), F.lit(False))).alias("same_as_rows"),
    )


@query("tt_core_gradients_by_value", f"""with ax as (select j1, j2, j3 from range(2) a(j1), range(2) b(j2), range(2) c(j3)),
rk as (select a, b from range(3) x(a), range(3) y(b)),
g as (select l_partkey as id, j1, j2, j3, sum((l_suppkey + j1 * 4 + j2 * 2 + j3) % 5) as g from lineitem, ax group by all),
d as (select g.*, id // p3 // 10 as i1, id // p3 % 10 as i2, id % p3 as i3
  from g, (select (count(*) + 199) // 200 as p3 from part) where id between 0 and 200 * p3 - 1),
cells as (select 0 as core, i1 as i, j1 * 3 + a as cell, g * {_cv(1, 'i2', 'a * 6 + j2 * 3 + b')} * {_cv(2, 'i3', 'b * 2 + j3')} as v from d, rk
  union all select 1, i2, a * 6 + j2 * 3 + b, g * {_cv(0, 'i1', 'j1 * 3 + a')} * {_cv(2, 'i3', 'b * 2 + j3')} from d, rk
  union all select 2, i3, b * 2 + j3, g * {_cv(0, 'i1', 'j1 * 3 + a')} * {_cv(1, 'i2', 'a * 6 + j2 * 3 + b')} from d, rk),
s as (select core, i, cell, cast(sum(v) as double) as x from cells group by all),
vecs as (select cast(core as bigint) as core, cast(i as bigint) as i, list(x order by cell) as vec from s group by core, i)
select core, i, {fixed_point_sql('vec')} as vec from vecs""")
def tt_core_gradients_by_value(t):
    """Every entry of the gradients; integer cores and row gradients keep all sums exact."""
    shape = _shape(t)
    grads = t.lineitem.select(F.col("l_partkey").alias("id"), F.array(*[
        F.pmod(F.col("l_suppkey") + i, F.lit(5)).cast("double") for i in range(shape.dim)]).alias("vec"))
    return as_text(update.tt_core_gradients(grads, materialize(_cores(t, shape), "cores"), shape))
