"""Sources, splits, batching, encoding and normalisation."""

from __future__ import annotations

import pyarrow as pa
import pyspark.sql.functions as F

from clickforge.functions.scalars import clip, fill_missing, hex_to_long, int_div, to_cold_range
from clickforge.functions.vectors import fixed_point
from clickforge.operators import batching, encode
from clickforge.operators.ordering import index_rows
from clickforge.plans.registry import CLICKS, Tables, query
from clickforge.session import scratch_path
from clickforge.sources import clicks, edges, synthetic, tables

LINE_COLUMNS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity",
                "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
LINE_ORDER = ", ".join(LINE_COLUMNS)


def scratch(t: Tables, name: str) -> str:
    return scratch_path(t.spark, name)


# ---- sources and sinks --------------------------------------------------------------------------


@query("read_clicks", """
select cast(l_returnflag = 'R' as integer) as label, cast(l_quantity as integer) as "I1",
  case when l_linenumber > 1 then l_linenumber end as "I2", l_partkey as "C1",
  l_orderkey * 65537 as "C2" from lineitem""")
def read_clicks(t):
    path = scratch(t, "clicks")
    t.lineitem.select(
        (F.col("l_returnflag") == "R").cast("int"), F.col("l_quantity").cast("int"),
        F.when(F.col("l_linenumber") > 1, F.col("l_linenumber")),
        F.lower(F.lpad(F.hex("l_partkey"), 8, "0")), F.lower(F.hex(F.col("l_orderkey") * 65537)),
    ).toDF("a", "b", "c", "d", "e").write.csv(path, sep="\t")
    return clicks.read_clicks(t.spark, path, n_ints=2, n_cats=2)


@query("read_ad_log", f"""with {CLICKS}
select cast(label as integer) as label, cast(day(e.ts) as integer) as "I1", cast(hour(e.ts) as integer) as "I2",
  cast(k as integer) as "I3", {", ".join(f'e.user_id as "C{i}"' for i in range(1, 20) if i != 2)}, pos * 4099 as "C2", e.user_id + k as "C20"
from clicks join events e on e.event_id = clicks.pos""")
def read_ad_log(t):
    path = scratch(t, "adlog")
    rows = t.events.select(
        "event_id", (F.col("event_type") == "purchase").cast("int").alias("click"),
        F.date_format("ts", "yyMMddHH").alias("hour"),
        F.get_json_object("props", "$.k").alias("k"), "user_id",
    )
    fields = ["event_id", "click", "hour", "k"]
    texts = []
    for i in range(1, 21):
        number = F.col("event_id") * 4099 if i == 2 else (F.col("user_id") + F.col("k").cast("bigint") if i == 20 else F.col("user_id"))
        texts.append((F.lower(F.hex(number)) if i in clicks.AD_HEX else number.cast("string")).alias(f"f{i}"))
    rows.select(*fields, *texts).write.csv(path, header=True)
    return clicks.read_ad_log(t.spark, path)


@query("hex_to_long", """
with w as (select doc_id, unnest(string_split_regex(concat_ws(' ', text, lower(hex(doc_id * 1000003))), '[^0-9A-Za-z]+')) as word from documents)
select doc_id, case when regexp_full_match(word, '[0-9a-fA-F]{1,16}') then try_cast('0x' || word as bigint) end as number, count(*) as n
from w group by all""")
def hex_query(t):
    """Every word of every text, and one long number per document; words that are no hex numbers count under null."""
    texts = F.concat_ws(" ", "text", F.lower(F.hex(F.col("doc_id") * 1000003)))
    words = t.documents.select("doc_id", F.explode(F.split(texts, "[^0-9A-Za-z]+")).alias("word"))
    return words.groupBy("doc_id", hex_to_long("word").alias("number")).agg(F.count(F.lit(1)).alias("n"))


@query("read_file_order", """
select l_orderkey, l_partkey, row_number() over (order by l_orderkey, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 as pos
from lineitem""")
def read_file_order(t):
    """Rows written sorted into text files come back with their position in the files."""
    path = scratch(t, "lines")
    order = ["l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
    t.lineitem.select(F.lit(0).alias("label"), *order).orderBy(*order).select(
        "label", "l_orderkey", F.hex("l_partkey")).write.csv(path, sep="\t")
    rows = clicks.read_clicks(t.spark, path, n_ints=1, n_cats=1, keep_order=True)
    return rows.select(F.col("I1").cast("bigint").alias("l_orderkey"), F.col("C1").alias("l_partkey"), "pos")


@query("write_by_source", """
select 'events.parquet' as source_file, event_type, count(*) as n from events group by event_type""")
def write_by_source(t):
    path = scratch(t, "bysource")
    tables.write_parquet(t.scan("events").select("event_type", "event_id"), path, by_source=True)
    return t.spark.read.parquet(path).groupBy("source_file", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("write_shuffled", f"with {CLICKS} select pos, user_id, cast(value as float) as value from clicks")
def write_shuffled(t):
    path = scratch(t, "shuffled")
    rows = encode.cast_schema(t.clicks.select("pos", "user_id", "value"), ["user_id"], ["value"])
    tables.write_shuffled(rows, path, ["pos"], seed=7)
    return tables.read_parquet_glob(t.spark, path, rows.schema)


@query("training_matrix", f"""with {CLICKS}
select pos, cast(label as float) as label, user_id || ',' || k as cats, cast(value as float) as cont from clicks""")
def training_matrix(t):
    root = scratch(t, "matrix")
    tables.write_training_matrix(t.clicks, root, "avazu_reordered", ["user_id", "k"], ["value"], "label", keep=["pos"])
    saved = tables.read_training_matrix(t.spark, root, "avazu_reordered")
    return saved.select("pos", "label", F.array_join(F.col("cats").cast("array<string>"), ",").alias("cats"),
                        F.col("conts")[0].alias("cont"))


@query("read_edge_list", """
select user_id as src, event_id % 97 as dst, cast(1.0 as double) as w from events""")
def read_edge_list(t):
    path = scratch(t, "edges")
    src, dst = F.col("user_id").cast("string"), F.pmod("event_id", F.lit(97)).cast("string")
    sep = F.when(F.col("event_id") % 3 == 0, "\t").when(F.col("event_id") % 3 == 1, ",").otherwise(" ")
    line = F.concat(src, sep, dst)
    noise = F.when(F.col("event_id") % 5 == 0, F.array(F.lit("# comment"), line)).otherwise(F.array(line, F.lit("")))
    t.events.select(F.explode(noise).alias("value")).write.text(path)
    return edges.read_edge_list(t.spark, path)


@query("loss_series", """
select 'm' as model, event_id as iter, value as loss from events""")
def loss_series(t):
    path = scratch(t, "loss")
    t.events.orderBy("event_id").select(F.col("value").cast("string")).write.text(path)
    return tables.read_loss_series(t.spark, path, "m")


@query("synthetic_uniform", """
select (select count(*) from events) as n, true as labels_ok, true as dense_ok, true as ids_ok""")
def synthetic_uniform(t):
    sizes = [t.part.count(), t.supplier.count(), 7]
    rows = synthetic.synthetic_uniform(t.spark, t.events.count(), sizes, 3, seed=5)
    ids_ok = None
    for j, size in enumerate(sizes):
        ok = (F.col("cats")[j] >= 0) & (F.col("cats")[j] < size)
        ids_ok = ok if ids_ok is None else ids_ok & ok
    dense_ok = F.forall("conts", lambda x: (x >= 0) & (x <= 1))
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(F.col("label").isin(0, 1)).alias("labels_ok"),
        F.bool_and(dense_ok).alias("dense_ok"), F.bool_and(ids_ok).alias("ids_ok"),
    )


@query("synthetic_power_law", """
select (select count(*) from lineitem) as n, true as in_range, true as skewed""")
def synthetic_power_law(t):
    n, size = t.lineitem.count(), t.part.count()
    rows = synthetic.synthetic_power_law(t.spark, n, size, exponent=1.2, seed=3)
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.bool_and((F.col("C1") >= 0) & (F.col("C1") < size)).alias("in_range"),
        (F.sum((F.col("C1") < size // 10).cast("bigint")) > F.lit(n // 2)).alias("skewed"),
    )


@query("embedding_init", """
select (select count(*) from part) as n, cast(16 as bigint) as dim, true as bounded""")
def embedding_init(t):
    n = t.part.count()
    table = synthetic.embedding_init(t.spark, n, 16, seed=1)
    bounded = F.forall("vec", lambda x: F.abs(x) <= F.lit((1.0 / n) ** 0.5 * 1.000001))
    return table.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).cast("bigint").alias("dim"),
                     F.bool_and(bounded).alias("bounded"))


# ---- splits and batches -------------------------------------------------------------------------


@query("index_rows", f"select {LINE_ORDER}, row_number() over (order by {LINE_ORDER}) - 1 as pos from lineitem".replace(
    "l_shipdate, row", "cast(l_shipdate as varchar) as l_shipdate, row"))
def index_query(t):
    indexed = index_rows(t.lineitem.select(*LINE_COLUMNS), LINE_COLUMNS)
    return indexed.withColumn("l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"))


@query("split_prefix", """
with o as (select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) - 1 as pos, count(*) over () as n from orders)
select o_orderkey, pos, case when pos < floor(n * 0.9::double) then 'train' else 'valid' end as part from o""")
def split_prefix(t):
    train, valid = batching.split_prefix(t.orders.select("o_orderkey", "o_orderdate"), 0.9, ["o_orderdate", "o_orderkey"])
    both = train.withColumn("part", F.lit("train")).union(valid.withColumn("part", F.lit("valid")))
    return both.select("o_orderkey", "pos", "part")


@query("split_every_nth", """
with o as (select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) - 1 as pos from orders)
select o_orderkey, case when pos % 10 = 9 then 'valid' else 'train' end as part from o""")
def split_every_nth(t):
    train, valid = batching.split_every_nth(t.orders.select("o_orderkey", "o_orderdate"), 10, ["o_orderdate", "o_orderkey"])
    return train.select("o_orderkey", F.lit("train").alias("part")).union(valid.select("o_orderkey", F.lit("valid")))


@query("split_by_file", """
select 'train' as part, o_orderkey as key, null as line, o_totalprice as price from orders
union all select 'valid', l_orderkey, l_linenumber, l_extendedprice from lineitem""")
def split_by_file(t):
    """Two files read as one table that has the columns of both."""
    rows = t.spark.read.option("mergeSchema", True).parquet(f"{t.folder}/orders.parquet", f"{t.folder}/lineitem.parquet")
    train, valid = batching.split_by_file(rows, ["lineitem.parquet"])

    def part(half, name):
        key, price = F.coalesce("o_orderkey", "l_orderkey"), F.coalesce("o_totalprice", "l_extendedprice")
        return half.select(F.lit(name).alias("part"), key.alias("key"), F.col("l_linenumber").alias("line"), price.alias("price"))

    return part(train, "train").union(part(valid, "valid"))


@query("assign_batches", f"""
with r as (select l_orderkey, l_linenumber, l_partkey, row_number() over (order by {LINE_ORDER}) - 1 as pos,
  count(*) over () as n from lineitem)
select l_orderkey, l_linenumber, l_partkey, pos // 512 as batch, pos % 512 as in_batch from r where pos // 512 < n // 512""")
def assign_batches(t):
    out = batching.assign_batches(t.lineitem.select(*LINE_COLUMNS), 512, LINE_COLUMNS)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "batch", "in_batch")


@query("map_batches", f"""with {CLICKS}, r as (select pos // 512 as batch, pos % 512 as in_batch, user_id, label from clicks)
select batch, in_batch, user_id, cast(sum(label) over (partition by batch order by in_batch) as bigint) as positives,
  in_batch - min(in_batch) over (partition by batch, user_id) as since_first from r""")
def map_batches(t):
    """A function of the user sees whole mini-batches in order; they are spread over the partitions before."""
    def collate(rows):
        frame = rows.to_pandas()
        frame["positives"] = frame["label"].cumsum()
        frame["since_first"] = frame["in_batch"] - frame.groupby("user_id", dropna=False)["in_batch"].transform("min")
        return pa.Table.from_pandas(frame, preserve_index=False)

    rows = t.batches(512, "user_id", "label").repartition("in_batch")
    schema = "batch bigint, in_batch bigint, user_id bigint, positives bigint, since_first bigint"
    return batching.map_batches(rows, collate, schema)


_ORDER_BATCHES = """with r as (select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) - 1 as pos, count(*) over () as n
  from orders), b as (select o_orderkey, pos // 128 as batch, pos % 128 as in_batch from r where pos // 128 < n // 128)"""


def _order_batches(t):
    rows = t.orders.select("o_orderkey", "o_orderdate")
    return batching.assign_batches(rows, 128, ["o_orderdate", "o_orderkey"]).drop("o_orderdate", "pos")


@query("limit_batches", f"{_ORDER_BATCHES} select * from b where batch < 10")
def limit_batches(t):
    return batching.limit_batches(_order_batches(t), 10)


@query("rank_slice", f"{_ORDER_BATCHES} select * from b where in_batch // 32 = 2")
def rank_slice(t):
    return batching.rank_slice(_order_batches(t), worker=2, per_worker=32)


@query("pack_features", """
select l_orderkey, l_partkey || ',' || l_suppkey as cats,
  cast(round(cast(cast(l_quantity as float) as double) * 100) as bigint) || ',' ||
  cast(round(cast(cast(l_discount as float) as double) * 100) as bigint) as conts from lineitem""")
def pack_features(t):
    rows = batching.select_roles(t.lineitem, ["l_partkey", "l_suppkey"], ["l_quantity", "l_discount"], "l_orderkey")
    packed = batching.pack_features(rows, ["l_partkey", "l_suppkey"], ["l_quantity", "l_discount"])
    return packed.select(
        "l_orderkey", F.array_join(F.col("cats").cast("array<string>"), ",").alias("cats"),
        F.array_join(F.transform("conts", lambda x: F.round(x.cast("double") * 100).cast("bigint").cast("string")), ",").alias("conts"),
    )


@query("downsample_negatives", f"""
with {CLICKS}, b as (select pos // 512 as batch, pos % 512 as in_batch, label from clicks),
r as (select *, 4 * sum(label) over (partition by batch) as quota,
  sum(1 - label) over (partition by batch order by in_batch) as nth from b)
select batch, in_batch, label from r where label = 1 or nth <= quota""")
def downsample_negatives(t):
    return batching.downsample_negatives_batch(t.batches(512, "label"), "label")


@query("undersample_negatives", f"""
with {CLICKS} select pos, label from clicks where label = 1 or (pos * 48271) % 1000003 < 250000""")
def undersample_negatives(t):
    return batching.undersample_negatives(t.clicks.select("pos", "label"), "label", "pos", 0.25)


@query("to_cold_range", "select event_id, greatest(user_id, 40) - 40 as cold from events")
def cold_range(t):
    return t.events.select("event_id", to_cold_range("user_id", 40).alias("cold"))


@query("fill_and_clip", """
select l_orderkey, l_linenumber, l_partkey, coalesce(nullif(l_discount, 0), 0) as filled,
  greatest(l_extendedprice - 20000, 0) as clipped from lineitem""")
def fill_and_clip(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        fill_missing(F.nullif("l_discount", F.lit(0.0)), 0.0).alias("filled"),
        clip(F.col("l_extendedprice") - 20000, low=0.0).alias("clipped"),
    )


@query("fill_clip_normalize", """
with o as (select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) - 1 as pos, count(*) over () as n from orders),
r as (select l.*, o.pos < floor(o.n * 0.9::double) as train, coalesce(nullif(l_discount, 0), 0) as x1,
  greatest(l_extendedprice - 20000, 0) as x2 from lineitem l join o on o.o_orderkey = l.l_orderkey),
m as (select avg(x1) as m1, stddev_samp(x1) as s1, avg(x2) as m2, stddev_samp(x2) as s2 from r where train)
select l_orderkey, l_linenumber, l_partkey, train, cast(round((x1 - m1) / s1, 4) as double) as discount,
  cast(round((x2 - m2) / s2, 4) as double) as price from r, m""")
def fill_clip_normalize(t):
    """Moments come from the training orders only and are applied to all rows."""
    split = batching.flag_prefix(t.orders.select("o_orderkey", "o_orderdate"), 0.9, ["o_orderdate", "o_orderkey"])
    rows = t.lineitem.select(
        F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey",
        F.nullif("l_discount", F.lit(0.0)).alias("discount"), (F.col("l_extendedprice") - 20000).alias("price"),
    ).join(split.select("o_orderkey", "train"), "o_orderkey")
    moments = encode.normalize_fit(rows.filter("train"), ["discount", "price"])
    scaled = encode.normalize_apply(rows, moments, ["discount", "price"])
    return scaled.select(F.col("o_orderkey").alias("l_orderkey"), "l_linenumber", "l_partkey", "train",
                         F.round("discount", 4).alias("discount"), F.round("price", 4).alias("price"))


# ---- dictionaries -------------------------------------------------------------------------------

LINE_CATS = ["l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"]

_VOCABULARY = """counts as (
  select 'l_partkey' as field, cast(l_partkey as varchar) as value, count(*) as cnt from lineitem group by all
  union all select 'l_suppkey', cast(l_suppkey as varchar), count(*) from lineitem group by all
  union all select 'l_returnflag', l_returnflag, count(*) from lineitem group by all
  union all select 'l_linestatus', l_linestatus, count(*) from lineitem group by all),
vocabulary as (select field, value, row_number() over (partition by field order by cnt desc, value) as id, cnt from counts)"""


@query("categorify_fit", f"with {_VOCABULARY} select field, value, id, cnt from vocabulary")
def categorify_fit(t):
    return encode.categorify_fit(t.lineitem, LINE_CATS).select("field", "value", "id", "cnt")


@query("categorify_capped", f"with {_VOCABULARY} select field, value, id, cnt from vocabulary where id < 100")
def categorify_capped(t):
    return encode.categorify_fit(t.lineitem, LINE_CATS, max_size=100).select("field", "value", "id", "cnt")


@query("categorify_apply", """
with o as (select o_orderkey, o_custkey, row_number() over (order by o_orderkey) - 1 as pos, count(*) over () as n from orders),
v as (select o_custkey, row_number() over (order by count(*) desc, o_custkey) as id from o where pos < floor(n * 0.1::double) group by o_custkey)
select o_orderkey, coalesce(id, 0) as o_custkey from o left join v using (o_custkey)""")
def categorify_apply(t):
    """Fitted on the first tenth of the orders, applied to all."""
    orders = t.orders.select("o_orderkey", "o_custkey")
    fit, _ = batching.split_prefix(orders, 0.1, ["o_orderkey"])
    return encode.categorify_apply(orders, encode.categorify_fit(fit, ["o_custkey"]), ["o_custkey"])


@query("workflow_transform", f"""
with {_VOCABULARY}, m as (select avg(l_quantity) as mq, stddev_samp(l_quantity) as sq from lineitem)
select l_orderkey, l_linenumber, p.id as l_partkey, s.id as l_suppkey, r.id as l_returnflag, k.id as l_linestatus,
  cast(l_quantity > 25 as float) as label, cast(round(cast(cast((l_quantity - mq) / sq as float) as double), 4) as double) as quantity
from lineitem, m, vocabulary p, vocabulary s, vocabulary r, vocabulary k
where p.field = 'l_partkey' and p.value = cast(l_partkey as varchar) and s.field = 'l_suppkey' and s.value = cast(l_suppkey as varchar)
  and r.field = 'l_returnflag' and r.value = l_returnflag and k.field = 'l_linestatus' and k.value = l_linestatus""")
def workflow_transform(t):
    """Fit, save, load, apply."""
    path = scratch(t, "workflow")
    rows = t.lineitem.select("l_orderkey", "l_linenumber", *LINE_CATS, F.col("l_quantity").alias("quantity"),
                             (F.col("l_quantity") > 25).cast("int").alias("label"))
    encode.Workflow.fit(rows, LINE_CATS, ["quantity"], "label").save(path)
    out = encode.Workflow.load(t.spark, path).transform(rows)
    return out.withColumn("quantity", F.round(F.col("quantity").cast("double"), 4))


_SIZES = f"""{_VOCABULARY}, sizes as (select field, max(id) + 1 as cardinality from vocabulary group by field)"""


def _sizes(t):
    return encode.embedding_sizes(encode.categorify_fit(t.lineitem, LINE_CATS))


@query("embedding_sizes", f"""with {_SIZES}
select field, cardinality, least(16, least(greatest(16, cast(round(1.6 * cardinality ** 0.56) as bigint)), 512)) as dim from sizes""")
def embedding_sizes(t):
    return _sizes(t)


@query("dense_footprint", f"""with {_SIZES}
select coalesce(field, 'total') as field, cast(sum(cardinality * 256) as bigint) as bytes,
  round(sum(cardinality * 256) / (1024 * 1024)::double, 2) as mb from sizes group by rollup (field)""")
def dense_footprint(t):
    return encode.dense_footprint(_sizes(t), 64)


@query("factored_footprint", f"""with {_SIZES}, s as (select field, cardinality, (cardinality + 199) // 200 as p3 from sizes)
select field, 20 * 32 + 10 * 256 + p3 * 32 as factored_floats, cardinality * 64 as dense_floats,
  round((cardinality * 64) / (20 * 32 + 10 * 256 + p3 * 32)::double, 6) as ratio from s""")
def factored_footprint(t):
    shapes = _sizes(t).withColumns({"p1": F.lit(20).cast("bigint"), "p2": F.lit(10).cast("bigint"),
                                    "p3": int_div(F.col("cardinality") + 199, 200)})
    return encode.factored_footprint(shapes, 64, q=(4, 4, 4), rank=(1, 8, 8, 1))


@query("split_tables", f"""with {_SIZES} select field, cardinality, case when cardinality > 1000 then 'factored' else 'dense' end as form from sizes""")
def split_tables(t):
    return encode.split_tables_by_size(_sizes(t).drop("dim"), 1000)


@query("assign_shards", """select p_partkey as table_no, p_partkey % 4 as worker from part""")
def assign_shards(t):
    return encode.assign_shards(t.part.select(F.col("p_partkey").alias("table_no")), 4)


@query("column_shards", """
select vec_id as id, cast(s as integer) as shard, {} as vec from (select vec_id, embedding, unnest([0, 1, 2, 3]) as s from embeddings)""".format(
    "array_to_string(list_transform(embedding[s * 16 + 1 : s * 16 + 16], lambda x: cast(cast(floor(cast(x as double) * 1000000.0::double + 0.5::double) as bigint) as varchar)), ',')"))
def column_shards(t):
    return encode.column_shards(t.vectors, "vec", 64, 16).withColumn("vec", fixed_point("vec"))
