"""Co-occurrence graphs, communities and permutations."""

from __future__ import annotations

import pyspark.sql.functions as F

from clickforge.functions.scalars import int_div
from clickforge.operators import graph, profile
from clickforge.plans.registry import query
from clickforge.session import materialize

BATCH = 32  # rows per co-occurrence batch

# vertex v is user or customer v - 1, as id 0 stands for hot ids and makes no pairs

_PAIRS = """cold as (select distinct event_id // 32 as batch, user_id + 1 as id from events),
pairs as (select a.batch, a.id as src, b.id as dst from cold a join cold b on a.batch = b.batch and a.id < b.id)"""
_WEIGHTS = _PAIRS + """,
half as (select src, dst, cast(count(*) as double) as w from pairs group by src, dst),
weights as (select src, dst, w from half union all select dst, src, w from half)"""
_STRENGTH = _WEIGHTS + """,
strength as (select src as v, count(*) as degree, sum(w) as strength from weights group by src)"""


def _pairs(t, block=None):
    return graph.cooccurrence_edges(t.clicks.select("pos", (F.col("user_id") + 1).alias("id")), "id", "pos", BATCH, block)


def _weights(t):
    return graph.edge_weights(_pairs(t, "block"), block="block")


@query("cooccurrence_edges", f"with {_PAIRS} select batch, src, dst from pairs")
def cooccurrence_edges(t):
    return _pairs(t)


@query("edge_weights", f"with {_WEIGHTS} select src, dst, w from weights")
def edge_weights(t):
    return _weights(t)


@query("vertex_count", f"with {_PAIRS} select max(greatest(src, dst)) + 1 as n from pairs")
def vertex_count(t):
    return graph.vertex_count(_pairs(t))


@query("unused_ids", f"""with {_PAIRS} select id from (select 0 as id union all select c_custkey + 1 from customer)
where id not in (select src from pairs union select dst from pairs)""")
def unused_ids(t):
    return graph.unused_ids(_pairs(t), t.customer.count() + 1)


@query("degrees", f"with {_STRENGTH} select v, degree, strength from strength")
def degrees(t):
    return graph.degrees(_weights(t))


@query("adjacency_lists", f"""with {_WEIGHTS},
r as (select src, dst, w, (row_number() over (partition by src order by dst) - 1) // 64 as chunk from weights)
select src, chunk, string_agg(dst || ':' || cast(w as bigint), ',' order by dst) as neighbors from r group by src, chunk""")
def adjacency_lists(t):
    lists = graph.adjacency_lists(_weights(t), chunk=64)
    text = F.transform("neighbors", lambda e: F.concat(e["dst"].cast("string"), F.lit(":"), e["w"].cast("bigint").cast("string")))
    return lists.withColumn("neighbors", F.array_join(text, ","))


@query("best_neighbor", f"""with {_STRENGTH}, tot as (select sum(strength) as total from strength),
g as (select src, dst, w - s.strength * d.strength / total as gain from weights join strength s on s.v = src join strength d on d.v = dst, tot)
select src as v, dst as u, round(gain, 6) as gain from g where gain > 0
qualify row_number() over (partition by src order by gain desc, dst) = 1""")
def best_neighbor(t):
    weights = materialize(_weights(t), "edges")
    return graph.best_neighbor(weights).select("v", "u", F.round("gain", 6).alias("gain"))


@query("contract_graph", f"""with {_WEIGHTS}
select src // 10 * 10 as src, dst // 10 * 10 as dst, sum(w) as w from weights where src // 10 <> dst // 10 group by all""")
def contract_graph(t):
    weights = materialize(_weights(t), "edges")
    parents = t.customer.select((F.col("c_custkey") + 1).alias("v")).withColumn("parent", int_div("v", 10) * 10)
    return graph.contract_graph(weights, parents)


@query("relabel_edges", f"""with {_WEIGHTS}, n as (select count(*) as n from customer)
select n - src as src, n - dst as dst, w from weights, n""")
def relabel_edges(t):
    n = t.customer.count()
    mapping = t.customer.select((F.col("c_custkey") + 1).alias("old"), (F.lit(n) - 1 - F.col("c_custkey")).alias("new"))
    return graph.relabel_edges(_weights(t), mapping)


_MEMBERS = "members as (select c_custkey + 1 as v, c_custkey % 10 as community from customer)"


@query("modularity", f"""with {_WEIGHTS}, {_MEMBERS},
c as (select a.community, sum(w) as all_w, sum(case when a.community = b.community then w else 0 end) as loop_w
  from weights join members a on a.v = src join members b on b.v = dst group by a.community)
select round(sum(loop_w / m2 - (all_w / m2) * (all_w / m2)), 9) as modularity from c, (select sum(w) as m2 from weights)""")
def modularity(t):
    members = t.customer.select((F.col("c_custkey") + 1).alias("v"), F.pmod("c_custkey", F.lit(10)).alias("community"))
    return graph.modularity(materialize(_weights(t), "edges"), members).select(F.round("modularity", 9).alias("modularity"))


@query("count_communities", "select count(distinct c_nationkey) as n_communities from customer")
def count_communities(t):
    return graph.count_communities(t.customer.select(F.col("c_custkey").alias("v"), F.col("c_nationkey").alias("community")))


@query("trace_community", """
with recursive up as (select p_partkey as v, p_partkey as node from part
  union all select v, ((node // 7) // 2) * 7 + node % 7 from up where node >= 7)
select v, min(node) as root from up group by v""")
def trace_community(t):
    """Seven binary trees over the parts: k * 7 + c has the parent (k div 2) * 7 + c."""
    parent = int_div(int_div("p_partkey", 7), 2) * 7 + F.pmod("p_partkey", F.lit(7))
    return graph.trace_community(t.part.select(F.col("p_partkey").alias("v"), parent.alias("parent")))


_TREES = """up as (select p_partkey as v, p_partkey as node, [p_partkey] as path from part
  union all select v, (((node // 7) // 2) * 7 + node % 7) as node, list_prepend(((node // 7) // 2) * 7 + node % 7, path) from up where node >= 7),
placed as (select v as old, row_number() over (order by path) - 1 as new from up where node < 7)"""


def _trees(t):
    """The seven trees of ``trace_community`` as a forest."""
    parent = int_div(int_div("p_partkey", 7), 2) * 7 + F.pmod("p_partkey", F.lit(7))
    return t.part.select(F.col("p_partkey").alias("v"), parent.alias("parent"))


@query("permutation", f"with recursive {_TREES} select old, new from placed")
def permutation(t):
    return graph.permutation(_trees(t))


@query("offset_permutation", f"with recursive {_TREES} select old, new + 5 as new from placed")
def offset_permutation(t):
    return graph.offset_permutation(graph.permutation(_trees(t)), 5)


@query("compose_bijection", f"""with recursive {_TREES}, n as (select count(*) as n from part), hot as (select n // 20 as hot from n),
ranks as (select p_partkey as old_id, n - 1 - p_partkey as k from part, n),
cold as (select old + 1 + hot as k, new + 1 + hot as moved from placed, hot, n where old < n - 1 - hot),
dense as (select k, (select hot from hot) + row_number() over (order by moved) as moved from cold)
select old_id, coalesce(moved, k) as new_id from ranks left join dense using (k)""")
def compose_bijection(t):
    """Parts ranked from the last to the first; all behind the first twentieth are moved by the trees' order."""
    n = t.part.count()
    hot = n // 20
    ranks = t.part.select(F.col("p_partkey").alias("old_id"), (F.lit(n) - 1 - F.col("p_partkey")).alias("new_id"))
    cold = _trees(t).filter(F.col("v") < n - 1 - hot)  # children have larger ids than their parents, so whole trees stay
    moved = graph.permutation(cold).select((F.col("old") + 1).alias("old"), (F.col("new") + 1).alias("new"))
    return graph.compose_bijection(ranks, moved, hot)


_N = "(select max(user_id) + 2 from events)"


@query("communities_check", f"""
select {_N} as n_vertices, true as one_top_each, true as tops_are_roots, true as is_permutation, true as better_than_singletons""")
def communities_check(t):
    weights = materialize(_weights(t), "edges")
    n = graph.vertex_count(weights).first()["n"]
    forest = materialize(graph.communities(weights, n), "forest")
    perm = materialize(graph.permutation(forest), "permutation")
    verdict = graph.check_partition(forest, perm, n)
    found = graph.trace_community(forest).select("v", F.col("root").alias("community"))
    alone = forest.select("v", F.col("v").alias("community"))
    gain = graph.modularity(weights, found).scalar() > graph.modularity(weights, alone).scalar()
    return verdict.withColumn("better_than_singletons", gain)


@query("compose_check", """
select count(distinct user_id) as n, count(distinct user_id) as n_new, cast(0 as bigint) as lo,
  count(distinct user_id) - 1 as hi, cast(0 as bigint) as hot_moved from events""")
def compose_check(t):
    """Re-ordering of the users behind the 5% most frequent: a bijection that leaves the hot ids alone."""
    users = t.clicks.select("pos", F.col("user_id").alias("id"))
    counts = users.groupBy(F.lit("id").alias("field"), "id").agg(F.count(F.lit(1)).alias("cnt"))
    ranks = profile.frequency_rank(counts)
    hot = int(ranks.count() * 0.05)
    ranked = profile.apply_bijection(users, ranks, ["id"])
    final = graph.reorder_cold_ids(ranked, ranks, "id", "pos", hot, BATCH)
    both = final.join(ranks.select("old_id", F.col("new_id").alias("rank")), "old_id")
    return both.agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("new_id").alias("n_new"), F.min("new_id").alias("lo"), F.max("new_id").alias("hi"),
        F.sum(((F.col("rank") <= hot) & (F.col("rank") != F.col("new_id"))).cast("bigint")).alias("hot_moved"),
    )
