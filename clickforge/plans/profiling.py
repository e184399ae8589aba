"""Access statistics, frequency re-numbering, hot/cold separation, and distinct ids per mini-batch."""

from __future__ import annotations

import pyspark.sql.functions as F

from clickforge.functions.vectors import fixed_point
from clickforge.operators import batching, profile
from clickforge.plans.etl import scratch
from clickforge.plans.registry import CLICKS, fixed_point_sql, query
from clickforge.sources import tables

FIELDS = ["user_id", "event_type", "k"]


@query("access_profile", f"""
with {CLICKS}, long as (
  select pos, 'user_id' as field, cast(user_id as varchar) as value from clicks
  union all select pos, 'event_type', event_type from clicks
  union all select pos, 'k', cast(k as varchar) from clicks),
ranks as (select field, value, row_number() over (partition by field order by count(*) desc, value) - 1 as rank
  from long group by field, value)
select pos // 512 as batch, field, count(*) as n_rows, count(distinct rank) as n_unique, max(rank) as max_rank,
  round(1 - count(distinct rank) / count(*)::double, 6) as reuse
from long join ranks using (field, value) group by all""")
def access_profile(t):
    report = profile.access_profile(t.clicks, FIELDS, "pos", 512)
    return report.withColumn("reuse", F.round("reuse", 6))


# ---- counts and ranks ---------------------------------------------------------------------------

LINE_FIELDS = ["l_partkey", "l_suppkey"]

_COUNTS = """ids as (select 'l_partkey' as field, p_partkey as id from part union all select 'l_suppkey', s_suppkey from supplier),
seen as (select 'l_partkey' as field, l_partkey as id, count(*) as c from lineitem group by all
  union all select 'l_suppkey', l_suppkey, count(*) from lineitem group by all),
counts as (select field, id, coalesce(c, 0) as cnt from ids left join seen using (field, id))"""
_RANKS = _COUNTS + """,
ranks as (select field, id as old_id, row_number() over (partition by field order by cnt desc, id) - 1 as new_id, cnt from counts)"""


def _counts(t):
    return profile.access_counts(t.lineitem, LINE_FIELDS, {"l_partkey": t.part.count(), "l_suppkey": t.supplier.count()})


def _ranks(t):
    return profile.frequency_rank(_counts(t))


@query("access_counts", f"with {_COUNTS} select field, id, cnt from counts")
def access_counts(t):
    return _counts(t)


@query("frequency_rank", f"with {_RANKS} select field, old_id, new_id, cnt from ranks")
def frequency_rank(t):
    return _ranks(t)


@query("apply_bijection", f"""with {_RANKS}
select l_orderkey, l_linenumber, p.new_id as l_partkey, s.new_id as l_suppkey from lineitem
join ranks p on p.field = 'l_partkey' and p.old_id = l_partkey join ranks s on s.field = 'l_suppkey' and s.old_id = l_suppkey""")
def apply_bijection(t):
    bijection = _ranks(t)
    rows = t.lineitem.select("l_orderkey", "l_linenumber", *LINE_FIELDS)
    return profile.apply_bijection(rows, bijection, LINE_FIELDS)


@query("choose_bijection", f"""with {_RANKS}
select field, old_id, new_id from ranks where field = 'l_partkey'
union all select 'l_suppkey', s_suppkey, (select count(*) from supplier) - 1 - s_suppkey from supplier""")
def choose_bijection(t):
    """The community map stands in as the reversed numbering of the suppliers."""
    n = t.supplier.count()
    community = t.supplier.select(F.lit("l_suppkey").alias("field"), F.col("s_suppkey").alias("old_id"),
                                  (F.lit(n) - 1 - F.col("s_suppkey")).alias("new_id"))
    return profile.choose_bijection(_ranks(t), community, ["l_suppkey"])


@query("profile_table", f"""with {_RANKS}
select field, new_id, old_id, cnt, round(cnt / sum(cnt) over (partition by field)::double, 9) as share,
  cast(sum(cnt) over (partition by field order by new_id) as bigint) as cum_cnt,
  round(sum(cnt) over (partition by field order by new_id)::double / sum(cnt) over (partition by field)::double, 9) as cum_share
from ranks""")
def profile_table(t):
    report = profile.profile_table(_ranks(t))
    return report.withColumns({c: F.round(c, 9) for c in ("share", "cum_share")})


@query("hot_prefix", f"""with {_RANKS}, n as (select field, count(*) as n_ids, cast(floor(count(*) * 0.05::double) as bigint) as hot, sum(cnt) as total from ranks group by field)
select field, n_ids, hot, cast(sum(case when new_id < hot then cnt else 0 end) as bigint) as hot_cnt,
  round(sum(case when new_id < hot then cnt else 0 end)::double / any_value(total)::double, 9) as coverage
from ranks join n using (field) group by field, n_ids, hot""")
def hot_prefix(t):
    return profile.hot_prefix(_ranks(t)).withColumn("coverage", F.round("coverage", 9))


# ---- hot and cold -------------------------------------------------------------------------------

# thresholds in percent; parts lie near 100 / n_parts, suppliers near 100 / n_suppliers
_HOT = """n as (select (select count(*) from part) as n_part, (select count(*) from supplier) as n_supp),
seen as (select 'l_partkey' as field, l_partkey as id, count(*) as cnt from lineitem group by all
  union all select 'l_suppkey', l_suppkey, count(*) from lineitem group by all),
tot as (select field, sum(cnt) as total from seen group by field),
hot as (select field, id, cnt, row_number() over (order by field, id) - 1 as hot_no from seen join tot using (field), n
  where cnt * 100 / total::double > case when field = 'l_partkey' then 100.0::double / n_part else 100.0::double / n_supp end)"""
_CLASSIFIED = _HOT + """,
rows as (select l_orderkey, l_linenumber, l_quantity, p.hot_no is not null and s.hot_no is not null as is_hot,
  p.hot_no || ',' || s.hot_no as hot_numbers from lineitem
  left join hot p on p.field = 'l_partkey' and p.id = l_partkey left join hot s on s.field = 'l_suppkey' and s.id = l_suppkey)"""


def _hot(t):
    limits = {"l_partkey": 100.0 / t.part.count(), "l_suppkey": 100.0 / t.supplier.count()}
    return profile.hot_ids(profile.access_counts(t.lineitem, LINE_FIELDS), limits)


def _classified(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", *LINE_FIELDS)
    return profile.classify_rows(rows, _hot(t), LINE_FIELDS)


@query("hot_ids", f"with {_HOT} select field, id, cnt, hot_no from hot")
def hot_ids(t):
    return _hot(t)


@query("classify_rows", f"with {_CLASSIFIED} select * from rows")
def classify_rows(t):
    text = F.array_join(F.col("hot_numbers").cast("array<string>"), ",")
    return _classified(t).withColumn("hot_numbers", text).drop(*LINE_FIELDS)


@query("hot_batch_quota", f"""with {_CLASSIFIED}, c as (select count(*) filter (is_hot) as n_hot, count(*) filter (not is_hot) as n_normal from rows)
select n_hot, n_normal, (1000 * n_normal + 1) // (n_hot + n_normal) as normal_iters,
  1000 - (1000 * n_normal + 1) // (n_hot + n_normal) as hot_iters from c""")
def hot_batch_quota(t):
    return profile.hot_batch_quota(_classified(t), 1000)


@query("hot_batch_quota_epoch", f"""with {_CLASSIFIED}, c as (select count(*) filter (is_hot) as n_hot, count(*) filter (not is_hot) as n_normal from rows),
e as (select *, (n_hot + n_normal) // 512 as batches from c), q as (select *, (batches * n_normal + 1) // (n_hot + n_normal) as normal_iters from e)
select n_hot, n_normal, normal_iters, greatest(batches - normal_iters - 1, 0) as hot_iters from q""")
def hot_batch_quota_epoch(t):
    """The full batches of 512 rows of one epoch."""
    rows = _classified(t)
    return profile.hot_batch_quota(rows, rows.count() // 512, epoch=True)


@query("write_hot_cold", f"""with {_CLASSIFIED}, byno as (select hot_no, field, id from hot)
select l_orderkey, l_linenumber, l_quantity, is_hot, p.id as part, s.id as supplier from rows
  left join byno p on is_hot and p.hot_no = cast(split_part(hot_numbers, ',', 1) as bigint)
  left join byno s on is_hot and s.hot_no = cast(split_part(hot_numbers, ',', 2) as bigint)""")
def write_hot_cold(t):
    path = scratch(t, "hotcold")
    tables.write_hot_cold(_classified(t), _hot(t), path)
    hot, normal, numbers = tables.read_hot_cold(t.spark, path)
    rows = hot.union(normal)
    for at, name in enumerate(["part", "supplier"]):
        ids = numbers.select(F.col("hot_no").alias(f"_no{at}"), F.col("id").alias(name))
        rows = rows.withColumn(f"_no{at}", F.get("hot_numbers", F.lit(at))).join(ids, f"_no{at}", "left")
    return rows.select("l_orderkey", "l_linenumber", "l_quantity", "is_hot", "part", "supplier")


_CACHE = """lim as (select count(distinct user_id) // 10 as size from events),
cache as (select id, cnt, row_number() over (order by cnt desc, id) - 1 as slot
  from (select user_id as id, count(*) as cnt from events group by user_id) qualify slot < (select size from lim))"""


def _cache(t):
    users = t.clicks.select("pos", F.col("user_id").alias("id"))
    return profile.lfu_cache_set(users, users.select("id").distinct().count() // 10)


@query("lfu_cache_set", f"with {_CACHE} select id, cnt, slot from cache")
def lfu_cache_set(t):
    return _cache(t)


@query("cache_split", f"""with {_CACHE},
j as (select event_id as pos, user_id as id, slot, slot is not null as is_hit from events left join cache on id = user_id)
select pos, id, slot, is_hit, case when is_hit then count(*) over () - row_number() over (partition by is_hit order by pos)
  else row_number() over (partition by is_hit order by pos) - 1 end as out_pos from j""")
def cache_split(t):
    return profile.cache_split(t.clicks.select("pos", F.col("user_id").alias("id")), _cache(t), "pos")


# ---- distinct ids per mini-batch ----------------------------------------------------------------

_LONG = f"""{CLICKS}, long as (select pos // 512 as batch, pos % 512 as in_batch, 'user_id' as field, user_id as id from clicks
  union all select pos // 512, pos % 512, 'k', k from clicks)"""
_BATCH_SIZES = f"""{_LONG}, sizes as (select batch, field, count(*) as n_rows, count(distinct id) as n_unique from long group by batch, field)"""
_BATCH_FIELDS = ["user_id", "k"]


def _rows(t):
    return t.batches(512, *_BATCH_FIELDS)


@query("batch_unique", f"""with {_LONG}
select batch, field, string_agg(cast(id as varchar), ',' order by id) as ids, count(*) as n
from (select distinct batch, field, id from long) group by batch, field""")
def batch_unique(t):
    lists = profile.batch_unique(_rows(t), _BATCH_FIELDS)
    return lists.withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


@query("batch_inverse", f"""with {_LONG}
select batch, field, in_batch, dense_rank() over (partition by batch, field order by id) - 1 as inv from long""")
def batch_inverse(t):
    return profile.batch_inverse(_rows(t), _BATCH_FIELDS)


@query("unique_offsets", f"""with {_BATCH_SIZES}
select field, batch, cast(sum(n_unique) over w - n_unique as bigint) as lo, cast(sum(n_unique) over w as bigint) as hi
from sizes window w as (partition by field order by batch)""")
def unique_offsets(t):
    return profile.unique_offsets(profile.batch_sizes(_rows(t), _BATCH_FIELDS))


@query("max_unique", f"with {_BATCH_SIZES} select field, max(n_unique) as max_unique from sizes group by field")
def max_unique(t):
    return profile.max_unique(profile.batch_sizes(_rows(t), _BATCH_FIELDS))


@query("reuse_ratio", f"""with {_BATCH_SIZES}
select batch, field, n_rows, n_unique, round(1 - n_unique / n_rows::double, 9) as reuse from sizes""")
def reuse_ratio(t):
    return profile.reuse_ratio(profile.batch_sizes(_rows(t), _BATCH_FIELDS)).withColumn("reuse", F.round("reuse", 9))


@query("unique_csr", f"""with {_BATCH_SIZES},
lists as (select batch, field, n_unique as n, cast(sum(n_unique) over (partition by field order by batch) - n_unique as bigint) as lo,
  max(n_unique) over (partition by field) as max_unique from sizes)
select batch, field, in_batch, id, dense_rank() over (partition by batch, field order by id) - 1 as inv, n, lo, max_unique
from long join lists using (batch, field)""")
def unique_csr(t):
    """Write the four tables, read them back and put every row's id together again."""
    path = scratch(t, "csr")
    tables.write_unique_csr(_rows(t), path, _BATCH_FIELDS)
    saved = tables.read_unique_csr(t.spark, path)
    joined = saved["unique"].join(saved["offsets"], ["batch", "field"]).join(F.broadcast(saved["max_unique"]), "field")
    ids = joined.select("batch", "field", F.posexplode("ids").alias("inv", "id"), "n", "lo", "max_unique")
    rows = saved["inverse"].join(ids, ["batch", "field", "inv"])
    return rows.select("batch", "field", "in_batch", "id", "inv", "n", "lo", "max_unique")


@query("batch_overlap", """
with u as (select distinct event_id // 64 as batch, user_id as id from events),
p as (select batch, id, row_number() over (partition by batch order by id) - 1 as idx from u)
select c.batch, 'user_id' as field, c.idx, c.id, coalesce(q.idx, -1) as prev_idx
from p c left join p q on q.batch = c.batch - 1 and q.id = c.id""")
def batch_overlap(t):
    out = profile.batch_overlap(profile.batch_unique(t.batches(64, "user_id"), ["user_id"]))
    return out.select("batch", "field", "idx", "id", "prev_idx")


@query("cache_sync", f"""
with n as (select count(*) as n from embeddings),
cur as (select event_id // 64 as batch, event_id % 64 as in_batch, user_id as id, embedding as vec
  from events, n join embeddings on vec_id = event_id % n),
prev as (select batch + 1 as batch, id, arg_min(vec, in_batch) as vec from cur group by batch, id)
select c.batch, c.in_batch, c.id, p.vec is not null as synced, {fixed_point_sql('coalesce(p.vec, c.vec)')} as vec
from cur c left join prev p using (batch, id)""".replace("from events, n join", "from (select * from events, n) e join"))
def cache_sync(t):
    rows = t.batches(64, "pos", "user_id").withColumnRenamed("user_id", "id")
    vectors = t.vectors.withColumnRenamed("id", "vec_no")
    gathered = rows.withColumn("vec_no", F.pmod("pos", F.lit(t.n_vectors))).join(vectors, "vec_no").drop("vec_no", "pos")
    return profile.cache_sync(gathered).withColumn("vec", fixed_point("vec"))
