"""Histograms, runs, scans, reductions and sorts over the event log and the order tables."""

from __future__ import annotations

import numpy as np
import pyspark.sql.functions as F

from clickforge.functions.scalars import int_div
from clickforge.operators import primitives as seq
from clickforge.operators import segments as cut
from clickforge.plans.registry import query


def _cents(c: str):
    return F.round(F.col(c) * 100).cast("bigint")


def _events(t):
    return t.events.select(F.col("event_id").alias("pos"), "user_id", "event_type", _cents("value").alias("cents"))


_EVENTS = "ev as (select event_id as pos, user_id, event_type, cast(round(value * 100) as bigint) as cents from events)"
_RUNS = f"""{_EVENTS}, h as (select pos, event_type, cents, case when event_type = lag(event_type) over (order by pos) then 0 else 1 end as head from ev),
r as (select *, sum(head) over (order by pos) - 1 as run from h),
runs as (select cast(run as bigint) as run, any_value(event_type) as event_type, min(pos) as "offset", count(*) as len, cast(sum(cents) as bigint) as cents from r group by run)"""

# ---- histograms ---------------------------------------------------------------------------------


@query("histogram_even", """
with b as (select cast(floor(value / 10.0::double) as bigint) as bin from events where value >= 0 and value < 100)
select r.bin, count(b.bin) as cnt from (select range as bin from range(10)) r left join b using (bin) group by r.bin""")
def histogram_even(t):
    return seq.histogram_even(t.events, "value", 0.0, 100.0, 11)


@query("histogram_region", """
with b as (select cast(floor(value / 10.0::double) as bigint) as bin from events
  where event_id // 100 between 2 and 90 and event_id % 100 between 10 and 49 and value >= 0 and value < 100)
select r.bin, count(b.bin) as cnt from (select range as bin from range(10)) r left join b using (bin) group by r.bin""")
def histogram_region(t):
    """The events as a picture 100 wide; rows 2 to 90 and columns 10 to 49 of it."""
    region = seq.region(t.events, "event_id", row_stride=100, first_row=2, n_rows=89, first_col=10, n_cols=40)
    return seq.histogram_even(region, "value", 0.0, 100.0, 11)


_LEVELS = [0.0, 1.0, 5.0, 20.0, 50.0, 120.0, 1000.0]


def _range_sql(c: str, levels: list[float]) -> str:
    whens = " ".join(f"when {c} < {b}::double then {i}" for i, b in enumerate(levels[1:]))
    return f"cast(case when {c} < {levels[0]}::double then null {whens} end as bigint)"


@query("histogram_range", f"""
with b as (select {_range_sql('value', _LEVELS)} as bin from events)
select r.bin, count(b.bin) as cnt from (select range as bin from range({len(_LEVELS) - 1})) r left join b using (bin) group by r.bin""")
def histogram_range(t):
    return seq.histogram_range(t.events, "value", _LEVELS)


_CHANNELS = {"l_quantity": [0.0, 10.0, 20.0, 60.0], "l_discount": [0.0, 0.02, 0.05, 0.2], "l_tax": [0.0, 0.03, 0.3]}


@query("histogram_multi", "with b as (" + " union all ".join(
    f"select '{c}' as channel, {_range_sql(c, v)} as bin from lineitem" for c, v in _CHANNELS.items()) + "), r as (" + " union all ".join(
    f"select '{c}' as channel, range as bin from range({len(v) - 1})" for c, v in _CHANNELS.items()) + """)
select r.channel, r.bin, count(b.bin) as cnt from r left join b using (channel, bin) group by all""")
def histogram_multi(t):
    return seq.histogram_multi(t.lineitem, _CHANNELS)


# ---- runs ---------------------------------------------------------------------------------------


@query("run_length_encode", f"""with {_RUNS} select run, event_type, "offset", len from runs""")
def run_length_encode(t):
    return seq.run_length_encode(_events(t), "event_type", "pos")


@query("nontrivial_runs", f"""with {_RUNS} select "offset", len from runs where len > 1""")
def nontrivial_runs(t):
    return seq.nontrivial_runs(_events(t), "event_type", "pos")


@query("dedupe_consecutive", f"with {_RUNS} select pos, event_type from h where head = 1")
def dedupe_consecutive(t):
    return seq.dedupe_consecutive(_events(t), "event_type", "pos").select("pos", "event_type")


@query("reduce_by_run", f"with {_RUNS} select run, event_type, cents, len as n from runs")
def reduce_by_run(t):
    return seq.reduce_by_run(_events(t), "event_type", "pos", {"cents": F.sum("cents"), "n": F.count(F.lit(1))})


# ---- selection ----------------------------------------------------------------------------------


@query("select_if", f"""with {_EVENTS} select pos, cents, row_number() over (order by pos) - 1 as out_pos from ev where cents > 5000""")
def select_if(t):
    return seq.select_if(_events(t), F.col("cents") > 5000, "pos").select("pos", "cents", "out_pos")


@query("select_where", f"""with {_EVENTS} select pos, cents, row_number() over (order by pos) - 1 as out_pos from ev where cents % 7 = 3""")
def select_where(t):
    """A predicate of the user over Arrow batches."""
    def chosen(batch):
        return batch.column("cents").to_numpy() % 7 == 3

    return seq.select_where(_events(t).select("pos", "cents"), chosen, "pos")


@query("selected_count", f"""with {_EVENTS} select count(*) as n_rows, count(*) filter (cents > 5000) as n_selected from ev""")
def selected_count(t):
    return seq.selected_count(_events(t), F.col("cents") > 5000)


@query("partition_flagged", f"""with {_EVENTS}
select pos, event_type, case when event_type = 'purchase' then row_number() over (partition by event_type = 'purchase' order by pos) - 1
  else count(*) over () - row_number() over (partition by event_type = 'purchase' order by pos) end as out_pos from ev""")
def partition_flagged(t):
    flagged = _events(t).withColumn("flag", F.col("event_type") == "purchase")
    return seq.partition_flagged(flagged, "flag", "pos").select("pos", "event_type", "out_pos")


# ---- scans --------------------------------------------------------------------------------------


@query("prefix_sum", f"""with {_EVENTS} select pos, cast(sum(cents) over (order by pos) as bigint) as inclusive,
  cast(sum(cents) over (order by pos) - cents as bigint) as exclusive from ev""")
def prefix_sum(t):
    rows = _events(t).select("pos", "cents")
    both = seq.prefix_sum(rows, "cents", "pos", out="inclusive")
    return both.withColumn("exclusive", F.col("inclusive") - F.col("cents")).drop("cents")


@query("prefix_sum_exclusive", f"""with {_EVENTS} select pos, cast(sum(cents) over (order by pos) - cents as bigint) as prefix from ev""")
def prefix_sum_exclusive(t):
    return seq.prefix_sum(_events(t).select("pos", "cents"), "cents", "pos", inclusive=False).select("pos", "prefix")


@query("prefix_scan", f"""with {_EVENTS} select pos, max(cents) over (order by pos) as scan from ev""")
def prefix_scan(t):
    return seq.prefix_scan(_events(t).select("pos", "cents"), "cents", ["pos"], "max").select("pos", "scan")


@query("prefix_scan_ufunc", f"""with {_EVENTS} select pos, cast(greatest(500, max(cents) over (order by pos)) as double) as scan from ev""")
def prefix_scan_ufunc(t):
    """Any associative ufunc; here the maximum with an initial value."""
    return seq.prefix_scan(_events(t).select("pos", "cents"), "cents", ["pos"], np.maximum, initial=500.0).select("pos", "scan")


# ---- reductions ---------------------------------------------------------------------------------


@query("reduce_values", f"""with {_EVENTS} select cast(sum(cents) + 7 as bigint) as total, min(cents) as lo, max(cents) as hi, cast(max(cents) as double) as hi_ufunc from ev""")
def reduce_values(t):
    rows = _events(t)
    total = seq.reduce_values(rows, "cents", "sum", initial=7).select(F.col("result").alias("total"))
    return total.select(
        "total",
        seq.reduce_values(rows, "cents", "min").scalar().alias("lo"),
        seq.reduce_values(rows, "cents", "max").scalar().alias("hi"),
        seq.reduce_values(rows, "cents", np.maximum).scalar().alias("hi_ufunc"),
    )


@query("arg_min", f"with {_EVENTS} select pos, cents as value from ev order by cents, pos limit 1")
def arg_min(t):
    return seq.arg_extreme(_events(t), "cents", "pos")


@query("arg_max", f"with {_EVENTS} select pos, cents as value from ev order by cents desc, pos limit 1")
def arg_max(t):
    return seq.arg_extreme(_events(t), "cents", "pos", largest=True)


_PRICES = "pr as (select l_orderkey, cast(round(l_extendedprice * 100) as bigint) as cents from lineitem)"


def _prices(t):
    return t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), _cents("l_extendedprice").alias("cents"))


@query("segmented_reduce", f"""with {_PRICES} select o_orderkey, cast(coalesce(sum(cents), 0) as bigint) as result from orders left join pr on l_orderkey = o_orderkey group by o_orderkey""")
def segmented_reduce(t):
    return seq.segmented_reduce(_prices(t), "o_orderkey", "cents", "sum", 0, t.orders)


@query("segmented_reduce_ufunc", f"""with {_PRICES} select o_orderkey, cast(coalesce(max(cents), -1) as double) as result from orders left join pr on l_orderkey = o_orderkey group by o_orderkey""")
def segmented_reduce_ufunc(t):
    return seq.segmented_reduce(_prices(t), "o_orderkey", "cents", np.maximum, -1.0, t.orders)


@query("segmented_arg", f"""with {_EVENTS}, s as (select pos // 512 as segment, pos, cents, pos - min(pos) over (partition by pos // 512) as idx from ev)
select segment, idx, cents as value from s qualify row_number() over (partition by segment order by cents desc, pos) = 1""")
def segmented_arg(t):
    rows = _events(t).withColumn("segment", int_div("pos", 512))
    return seq.segmented_arg(rows, "segment", "cents", "pos", largest=True)


# segments by offset pairs: one per customer, with any overlaps; some are empty or lie partly outside the rows
_CUTS = f"""{_EVENTS}, cuts as (select c_custkey as segment, c_custkey * 7919 % (select count(*) from events) - 40 as "begin",
  c_custkey * 7919 % (select count(*) from events) - 60 + c_custkey * 31 % 700 as "end" from customer),
hit as (select segment, "begin", pos, cents, user_id from cuts left join ev on pos >= "begin" and pos < "end")"""


def _cuts(t):
    start = F.col("c_custkey").cast("bigint") * 7919 % t.events.agg(F.count(F.lit(1))).scalar()
    length = F.col("c_custkey").cast("bigint") * 31 % 700
    return t.customer.select(F.col("c_custkey").alias("segment"), (start - 40).alias("begin"), (start - 60 + length).alias("end"))


@query("segments_sum", f"with {_CUTS} select segment, cast(coalesce(sum(cents), 0) as bigint) as result from hit group by segment")
def segments_sum(t):
    return cut.reduce_between(_events(t), "pos", "cents", _cuts(t), "sum", 0)


@query("segments_max", f"with {_CUTS} select segment, coalesce(max(cents), -1) as result from hit group by segment")
def segments_max(t):
    return cut.reduce_between(_events(t), "pos", "cents", _cuts(t), "max", -1)


@query("segments_arg", f"""with {_CUTS} select segment, coalesce(pos - "begin", -1) as idx, coalesce(cents, 0) as value from hit
qualify row_number() over (partition by segment order by cents, pos) = 1""")
def segments_arg(t):
    """Empty segments get -1 and 0."""
    return cut.arg_between(_events(t), "pos", "cents", _cuts(t)).fillna({"idx": -1, "value": 0})


@query("segments_sort", f"""with {_CUTS} select segment, pos, user_id, greatest("begin", 0) + row_number() over (
  partition by segment order by cents desc, user_id, pos) - 1 as out_pos from hit where pos is not null""")
def segments_sort(t):
    rows = _events(t).select("pos", "user_id", "cents")
    ordered = cut.sort_between(rows, "pos", [F.col("cents").desc(), "user_id"], _cuts(t))
    return ordered.select("segment", "pos", "user_id", "out_pos")


# ---- sorts --------------------------------------------------------------------------------------


@query("sort_rows", """select o_orderkey, row_number() over (order by o_totalprice desc, o_orderkey) - 1 as out_pos from orders""")
def sort_rows(t):
    rows = t.orders.select("o_orderkey", "o_totalprice")
    return seq.sort_rows(rows, [F.col("o_totalprice").desc(), "o_orderkey"]).select("o_orderkey", "out_pos")


@query("segmented_sort", """select l_returnflag, l_orderkey, l_partkey, row_number() over (partition by l_returnflag
  order by l_extendedprice desc, l_orderkey, l_partkey, l_suppkey, l_linenumber) - 1 as out_pos from lineitem""")
def segmented_sort(t):
    """Three segments, each with about a third of all rows."""
    rows = t.lineitem.select("l_returnflag", "l_extendedprice", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    order = [F.col("l_extendedprice").desc(), "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    return seq.segmented_sort(rows, ["l_returnflag"], order).select("l_returnflag", "l_orderkey", "l_partkey", "out_pos")


@query("spmv", """select o_orderkey as row, coalesce(sum(l_quantity * p_size), 0.0::double) as y from orders
  left join (lineitem join part on p_partkey = l_partkey) on l_orderkey = o_orderkey group by o_orderkey""")
def spmv(t):
    matrix = t.lineitem.select(F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("col"), F.col("l_quantity").alias("value"))
    x = t.part.select(F.col("p_partkey").alias("col"), F.col("p_size").alias("x"))
    return seq.spmv(matrix, x, t.orders.select(F.col("o_orderkey").alias("row")))
