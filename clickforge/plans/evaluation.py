"""Losses, accuracy, reports."""

from __future__ import annotations

import pyspark.sql.functions as F

from clickforge.functions.scalars import int_div
from clickforge.operators import evaluate
from clickforge.plans.etl import scratch
from clickforge.plans.registry import CLICKS, query
from clickforge.sources import tables


def _score(width: float = 50.0):
    return 1 / (1 + F.exp(-(F.col("value") - 50.0) / width))


_SCORED = f"""{CLICKS}, scored as (select pos // 512 as batch, label, 1 / (1 + exp(-(value - 50.0::double) / 50.0::double)) as score from clicks)"""


def _scored(t, width: float = 50.0):
    return t.batches(512, "label", "value").withColumn("score", _score(width))


def _bce(width: str) -> str:
    p = f"(1 / (1 + exp(-(value - 50.0::double) / {width}::double)))"
    return f"round(avg(-(label * greatest(ln({p}), -100) + (1 - label) * greatest(ln(1 - {p}), -100))), 5)"


@query("bce_per_batch", f"with {CLICKS} select pos // 512 as batch, {_bce('50.0')} as loss from clicks group by all")
def bce_per_batch(t):
    return evaluate.bce_per_batch(_scored(t), "score", "label")


@query("mse_per_batch", f"with {_SCORED} select batch, round(avg((score - label) * (score - label)), 6) as mse from scored group by batch")
def mse_per_batch(t):
    return evaluate.mse_per_batch(_scored(t), "score", "label")


@query("accuracy", f"""with {_SCORED} select cast(sum(case when round_even(score, 0) = label then 1 else 0 end) as bigint) as n_hit, count(*) as n_rows,
  sum(case when round_even(score, 0) = label then 1 else 0 end)::double / count(*)::double as accuracy
from scored where batch < (select max(batch) from scored)""")
def accuracy(t):
    return evaluate.accuracy(_scored(t), "score", "label", batch="batch")


@query("best_epoch", f"""with {CLICKS}, e as (select pos // 2048 as epoch,
  sum(case when round_even(1 / (1 + exp(-(value - 50.0::double) / 50.0::double)), 0) = label then 1 else 0 end)::double / count(*)::double as accuracy from clicks group by all)
select epoch, accuracy from e order by accuracy desc, epoch limit 1""")
def best_epoch(t):
    rows = t.clicks.select(int_div("pos", 2048).alias("epoch"), "label", _score().alias("score"))
    return evaluate.best_epoch(evaluate.accuracy(rows, "score", "label", keys=["epoch"]))


@query("align_curves", f"""with {CLICKS}
select * from (select pos // 512 as iter, {_bce('50.0')} as a, {_bce('25.0')} as b, {_bce('100.0')} as c from clicks group by all)
where iter <= (select count(*) // 1024 from clicks)""")
def align_curves(t):
    """Three models; the third was logged for half of the iterations."""
    curves = []
    for model, width in (("a", 50.0), ("b", 25.0), ("c", 100.0)):
        curve = evaluate.bce_per_batch(_scored(t, width), "score", "label").select(F.lit(model).alias("model"), F.col("batch").alias("iter"), "loss")
        curves.append(curve)
    curves[2] = curves[2].filter(F.col("iter") <= t.clicks.count() // 1024)
    return evaluate.align_curves(curves[0].union(curves[1]).union(curves[2]), ["a", "b", "c"])


@query("throughput_report", """
select o_orderpriority as setting, o_orderstatus as dataset, o_custkey % 3 as batch, round(sum(4 * o_custkey)::double / sum(o_totalprice), 9) as throughput
from orders group by all""")
def throughput_report(t):
    """Orders stand for logged runs; the log is appended to and read back."""
    path = scratch(t, "metrics")
    runs = t.orders.select(
        F.col("o_orderpriority").alias("setting"), F.col("o_orderstatus").alias("dataset"), F.pmod("o_custkey", F.lit(3)).alias("batch"),
        F.lit(4).cast("bigint").alias("workers"), F.col("o_custkey").alias("iterations"), F.col("o_totalprice").alias("seconds"))
    odd = F.pmod("iterations", F.lit(2)) == 1
    for part in (runs.filter(odd), runs.filter(~odd)):
        tables.append_metrics(t.spark, path, part)
    report = evaluate.throughput_report(tables.read_metrics(t.spark, path))
    return report.withColumn("throughput", F.round("throughput", 9))
