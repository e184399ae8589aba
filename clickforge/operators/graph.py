"""Co-occurrence graphs of cold ids, communities, and the id permutation they give."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickforge.functions.proposals import BEST_ROWS, best_edges
from clickforge.functions.scalars import int_div, to_cold_range
from clickforge.operators.ordering import rank_in_group, running
from clickforge.session import materialize

LIST_CHUNK = 1024  # neighbours per adjacency list row
TASK_PAIRS = 1 << 22  # pairs that a task makes from its batches at most, about
HUB_DEGREE = 1 << 16  # neighbours that are collected in one place at most
STORED_EDGES = 2  # edges per member of a batch that are written out at most


def cooccurrence_edges(df: DataFrame, id_col: str, pos: str, batch_size: int = 512, block: str | None = None,
                       times: str | None = None, groups: int | None = None) -> DataFrame:
    """(batch, src, dst) with src < dst: pairs of distinct cold ids that meet in a mini-batch.

    Batches are cut by position here, so no group can exceed ``batch_size`` rows and the output
    is at most ``batch_size / 2`` pairs per input row whatever the id distribution. Id 0 stands
    for the hot ids and makes no pairs. The pairs of a batch are generated after one shuffle,
    without a self join.

    With a name ``block``, equal pairs of all batches are made in the same task, which this column numbers; ``edge_weights``
    then adds them up without moving any. Ids are dealt to groups by hash, and each batch sends the lists of two groups to
    the task of these two: an id travels once per group instead of once per pair. ``groups`` is their number where the caller
    knows how many pairs there are. ``times`` says how often an id counts in its batch, and adds the product of both as w.
    """
    cold = df.filter(F.col(id_col) > 0).select(int_div(pos, batch_size).alias("batch"), id_col, *([] if times is None else [times]))
    if groups is not None:
        return _pairs_in_blocks(cold, id_col, groups, groups * (groups + 1) // 2, block, times)
    n = cold.count()
    tasks = -(-n * batch_size // (2 * TASK_PAIRS)) or 1  # the lists are short, so their size says little about the pairs
    if block is not None:
        tasks = _enough_tasks(df, tasks)
        return _pairs_in_blocks(cold, id_col, _groups(tasks), max(tasks, -(-n * _groups(tasks) // TASK_PAIRS)), block, times)
    lists = (
        cold.repartition(tasks, "batch")
        .groupBy("batch")
        .agg(F.sort_array(F.collect_set(id_col)).alias("ids"))
    )
    firsts = lists.select("batch", "ids", F.posexplode("ids").alias("at", "src"))
    return firsts.select("batch", "src", F.explode(F.slice("ids", F.col("at") + 2, F.size("ids"))).alias("dst"))


def _enough_tasks(df: DataFrame, tasks: int) -> int:
    """All cores where a task would have an eighth of its pairs at least."""
    return max(tasks, min(df.sparkSession.sparkContext.defaultParallelism, tasks * 8))


def _groups(tasks: int) -> int:
    """Groups of ids whose pairs make ``tasks`` blocks at least."""
    return next(g for g in count(1) if g * (g + 1) // 2 >= tasks)


def _group_of(id_col: str, groups: int) -> Column:
    return F.pmod(F.xxhash64(id_col), F.lit(groups)).cast("int")


def _block_of(a: Column, b: Column) -> Column:
    """The number of the block of two groups, a <= b."""
    return (int_div(b * (b + 1), 2) + a).cast("int")


def _pairs_in_blocks(cold: DataFrame, id_col: str, groups: int, readers: int, block: str, times: str | None) -> DataFrame:
    """(batch, src, dst, block[, w]): the block is a pair of groups of ids. ``readers`` tasks make the lists of the batches."""
    dealt_rows = cold.repartition(readers, "batch")
    if times is None:
        members, lists = dealt_rows.distinct(), {"ids": F.sort_array(F.collect_list(id_col))}
    else:
        members = dealt_rows.groupBy("batch", id_col).agg(F.sum(times).alias("n"))
        entries = F.sort_array(F.collect_list(F.struct(F.col(id_col).alias("id"), "n")))
        lists = {"ids": entries["id"], "ns": entries["n"]}
    grouped = (
        members.groupBy("batch", _group_of(id_col, groups).alias("g"))
        .agg(*[c.alias(name) for name, c in lists.items()])
        .groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("g", *lists))).alias("parts"))
    )
    lefts = grouped.select("batch", "parts", F.posexplode("parts").alias("at", "a"))
    both = lefts.select("batch", "a", F.explode(F.slice("parts", F.col("at") + 1, F.size("parts"))).alias("b"))
    counted = [] if times is None else [F.col("a.ns").alias("a_n"), F.col("b.ns").alias("b_n")]
    dealt = both.select("batch", _block_of(F.col("a.g"), F.col("b.g")).alias(block), F.col("a.ids").alias("a"), F.col("b.ids").alias("b"),
                        (F.col("a.g") == F.col("b.g")).alias("own"), *counted).repartitionById(groups * (groups + 1) // 2, block)
    rest = F.when(F.col("own"), F.slice("b", F.col("at") + 2, F.size("b"))).otherwise(F.col("b"))
    ends = [F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst"), block]
    if times is None:
        firsts = dealt.select("batch", block, "b", "own", F.posexplode("a").alias("at", "x"))
        return firsts.select("batch", block, "x", F.explode(rest).alias("y")).select("batch", *ends)
    firsts = dealt.select("batch", block, "b", "b_n", "a_n", "own", F.posexplode("a").alias("at", "x"))
    skipped = F.when(F.col("own"), F.col("at") + 1).otherwise(0)
    pairs = firsts.select("batch", block, "x", "b_n", F.get("a_n", F.col("at")).alias("x_n"), skipped.alias("skipped"),
                          F.posexplode(rest).alias("at", "y"))
    return pairs.select("batch", *ends, (F.col("x_n") * F.get("b_n", F.col("skipped") + F.col("at"))).alias("w"))


def edge_weights(edges: DataFrame, weight: str | None = None, block: str | None = None, mirrored: bool = True) -> DataFrame:
    """(src, dst, w) in both directions without self loops; weights of equal edges are added.

    Weights are added per unordered pair first, and mirrored after the shuffle. Where a column ``block`` says which
    task has all edges of a pair, as ``cooccurrence_edges`` can deal them, there is no shuffle. If not ``mirrored``, each pair
    is one row with src < dst, and keeps its block.
    """
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    halves = (
        edges.filter("src <> dst")
        .groupBy(*([] if block is None else [block]), F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
        .agg(F.sum(w).alias("w"))
        .filter("w > 0")
    )
    if not mirrored:
        return halves.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w", *([] if block is None else [block]))
    both = F.array(
        F.struct(F.col("a").alias("src"), F.col("b").alias("dst")),
        F.struct(F.col("b").alias("src"), F.col("a").alias("dst")),
    )
    return halves.select(F.explode(both).alias("e"), "w").select("e.src", "e.dst", "w")


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id"))


def vertex_count(edges: DataFrame) -> DataFrame:
    """(n): largest id plus one."""
    return edges.agg((F.coalesce(F.max(F.greatest("src", "dst")), F.lit(-1)) + 1).alias("n"))


def unused_ids(edges: DataFrame, n: int) -> DataFrame:
    """(id): vertices of [0, n) without an edge. The ends are reduced to distinct ids and stay out of the driver."""
    return edges.sparkSession.range(n).join(_ends(edges).distinct().hint("merge"), "id", "left_anti")


def adjacency_lists(weights: DataFrame, chunk: int = LIST_CHUNK) -> DataFrame:
    """(src, chunk, neighbors): neighbours by id with weights, in pieces of bounded length.

    A hub with many neighbours becomes several rows instead of one huge list. Vertices of up to ``HUB_DEGREE`` neighbours
    are gathered, sorted and cut in one place; only the edges of larger ones are ranked over many tasks.
    """
    stored = materialize(weights.select("src", "dst", "w"), "edges")
    entries = F.sort_array(F.collect_list(F.struct("dst", "w")))
    hubs = materialize(stored.groupBy("src").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HUB_DEGREE).select("src"), "hubs")
    has_hubs = not hubs.isEmpty()
    small = stored.join(hubs, stored["src"].eqNullSafe(hubs["src"]), "left_anti") if has_hubs else stored
    gathered = small.groupBy("src").agg(entries.alias("_all"))
    starts = F.sequence(F.lit(0), F.size("_all") - 1, F.lit(chunk))
    pieces = F.posexplode(F.transform(starts, lambda at: F.slice("_all", at + 1, F.lit(chunk)))).alias("chunk", "neighbors")
    lists = gathered.select("src", pieces).withColumn("chunk", F.col("chunk").cast("bigint"))
    if not has_hubs:
        return lists
    ranked = rank_in_group(stored.join(hubs, stored["src"].eqNullSafe(hubs["src"]), "left_semi"), ["src"], ["dst"], "_rank")
    return lists.union(ranked.groupBy("src", int_div("_rank", chunk).alias("chunk")).agg(entries.alias("neighbors")))


def degrees(weights: DataFrame) -> DataFrame:
    """(v, degree, strength): neighbours and weight of each vertex."""
    return weights.groupBy(F.col("src").alias("v")).agg(
        F.count(F.lit(1)).alias("degree"), F.sum("w").alias("strength")
    )


def total_weight(strengths: DataFrame) -> DataFrame:
    return strengths.agg(F.sum("strength").alias("total"))


def best_neighbor(weights: DataFrame, strengths: DataFrame | None = None, seed: int | None = None) -> DataFrame:
    """(v, u, gain): the neighbour with the largest positive gain w - str(v) str(u) / total; ties to the smaller id.

    With a ``seed``, ties go to the neighbour with the smaller hash of the pair, which is the same from both ends.

    ``strengths`` (v, strength) may carry weight that contraction has turned into self loops.
    """
    strengths = (degrees(weights) if strengths is None else strengths).select("v", "strength")
    total = total_weight(strengths).scalar()
    of_v = strengths.select(F.col("v").alias("src"), F.col("strength").alias("sv"))
    of_u = strengths.select(F.col("v").alias("dst"), F.col("strength").alias("su"))
    return _best(weights.join(of_u, "dst").join(of_v, "src"), total, seed)


def _best(edges: DataFrame, total: Column, seed: int | None) -> DataFrame:
    """The proposals of ``best_neighbor`` from (src, dst, w, sv, su), which is read twice.

    The largest gains are found first, as plain numbers that are kept by hash; only edges that reach them are compared further.
    Comparing whole edges at once would sort all of them by vertex.
    """
    gains = edges.withColumn("gain", F.col("w") - F.col("sv") * F.col("su") / total).filter("gain > 0")
    tops = materialize(gains.groupBy("src").agg(F.max("gain").alias("_top")), "tops")
    tie = F.lit(0) if seed is None else F.xxhash64(F.least("src", "dst"), F.greatest("src", "dst"), F.lit(seed))
    best = gains.join(tops, "src").filter(F.col("gain") == F.col("_top")).groupBy("src").agg(
        F.min(F.struct(tie.alias("tie"), "dst", "w", "sv", "su", "gain")).alias("b")
    )
    return best.select(F.col("src").alias("v"), F.col("b.dst").alias("u"), "b.gain", "b.w", "b.sv", "b.su")


def contract_graph(weights: DataFrame, parents: DataFrame) -> DataFrame:
    """Edges between communities: endpoints mapped through (v, parent), loops dropped, weights added.

    Vertices that are not in ``parents`` stay as they are.
    """
    mapped = relabel_edges(weights, parents.select(F.col("v").alias("old"), F.col("parent").alias("new")))
    return mapped.filter("src <> dst").groupBy("src", "dst").agg(F.sum("w").alias("w"))


def relabel_edges(weights: DataFrame, mapping: DataFrame) -> DataFrame:
    """Apply (old, new) to both ends of each edge."""
    left = mapping.select(F.col("old").alias("src"), F.col("new").alias("_s"))
    right = mapping.select(F.col("old").alias("dst"), F.col("new").alias("_d"))
    joined = weights.join(left, "src", "left").join(right, "dst", "left")
    return joined.select(F.coalesce("_s", "src").alias("src"), F.coalesce("_d", "dst").alias("dst"), "w")


def trace_community(parents: DataFrame, with_path: bool = False) -> DataFrame:
    """(v, root[, path]): follow parent pointers to the top.

    Pointer jumping: every round doubles the distance covered, so log2(depth) rounds suffice.
    Each round is written out, which keeps the plan flat and survives lost executors. The path
    runs from the root to the vertex; its length is the depth of the merge forest. Pointers that
    run in a circle raise ``ValueError``.
    """
    furthest = parents.count()
    state = parents.select("v", F.col("parent").alias("root"))
    is_root = F.col("v") == F.col("root")
    steps = F.when(is_root, F.array().cast("array<bigint>")).otherwise(F.array("v"))
    state = state.withColumn("path", steps) if with_path else state
    for jumps in count():
        above = state.select(
            F.col("v").alias("root"), F.col("root").alias("_root"),
            *([F.col("path").alias("_path")] if with_path else []),
        )
        joined = state.join(above, "root", "left")
        # a root points at itself and its own step list is empty, so joining past it changes nothing
        columns = ["v", F.coalesce("_root", "root").alias("root")]
        if with_path:
            columns.append(F.coalesce(F.concat("_path", "path"), "path").alias("path"))
        columns.append((F.col("_root") != F.col("root")).alias("_moved"))
        stepped = materialize(joined.select(*columns), "trace")
        state = stepped.drop("_moved")
        if stepped.filter("_moved").isEmpty():
            break
        if 1 << jumps > furthest:
            raise ValueError("parent pointers run in a circle")
    # a circle of two, four, ... vertices comes to rest on vertices that are no roots
    tops = state.select(F.col("root").alias("v")).distinct()
    if not tops.join(parents.filter(F.col("v") != F.col("parent")), "v", "left_semi").isEmpty():
        raise ValueError("parent pointers run in a circle")
    if with_path:
        state = state.withColumn("path", F.concat(F.array("root"), "path"))
    return state


QUEUE_SLOTS = 64  # hash slots per power of two of strength


def _senders(proposals: DataFrame) -> DataFrame:
    """(v, u, w, sv, su): proposals to a heavier vertex, and those to a lighter one that sends to nobody heavier itself.

    A finished community would else take a vertex at the border of its neighbour before that joins its own.
    """
    lighter = (F.col("su") > F.col("sv")) | ((F.col("su") == F.col("sv")) & (F.col("u") < F.col("v")))
    columns = ["v", "u", "w", "sv", "su"]
    up = proposals.filter(lighter).select(*columns)
    down = proposals.filter(~lighter).join(up.select(F.col("v").alias("u")), "u", "left_anti").select(*columns)
    return up.union(down)


def _attempts(senders: DataFrame, seed: int) -> DataFrame:
    """The senders that may join at the same time: each joins a vertex that stays.

    A coin per vertex (a hash of the id and the seed) says whether it stays or joins. A vertex that sends nothing stays
    without a coin, one that nobody sends to joins without a coin. So each sender is among the attempts with a chance of
    at least one in four, whatever the shape of the graph, and the attempts form stars.
    """
    stays = F.pmod(F.xxhash64("v", F.lit(seed)), F.lit(2)) == 0
    wanted = senders.select(F.col("u").alias("v"), F.lit(True).alias("_wanted")).distinct()
    tails = senders.join(wanted, "v", "left").filter(F.col("_wanted").isNull() | ~stays).drop("_wanted")
    movers = senders.filter(~stays).select(F.col("v").alias("u"))  # if wanted, they join; the target of a sender is wanted
    return tails.join(movers, "u", "left_anti")


def _accepted_merges(attempts: DataFrame, total) -> DataFrame:
    """(v, parent): the attempts of one round that may all happen together.

    The proposers of u queue from light to heavy, in slots of (power of two of the strength, hash).
    v is accepted when it gains even if everybody in earlier slots and in its own slot joins; the
    edges among them, which this bound leaves out, only add to the gain. The lightest vertex of the
    first slot gains in any case. A queue has a bounded number of slots, and joining on (u, slot)
    spreads the proposers of a hub over many tasks.
    """
    slot = F.floor(F.log2("sv")) * QUEUE_SLOTS + F.pmod(F.xxhash64("v"), F.lit(QUEUE_SLOTS))
    queued = attempts.select("v", "u", "w", "sv", "su", slot.alias("slot"))
    queue = Window.partitionBy("u").orderBy("slot")
    slots = (
        queued.groupBy("u", "slot")
        .agg(F.sum("sv").alias("_own"), F.min(F.struct("sv", "v")).alias("_lightest"))
        .select(
            "u", "slot", F.sum("_own").over(queue).alias("_ahead"),
            F.when(F.row_number().over(queue) == 1, F.col("_lightest.v")).alias("_first"),
        )
    )
    gain_left = F.col("w") - F.col("sv") * (F.col("su") + F.col("_ahead") - F.col("sv")) / total
    taken = queued.join(slots, ["u", "slot"]).filter((gain_left > 0) | (F.col("_first") == F.col("v")))
    return taken.select("v", F.col("u").alias("parent"))


CROWDED = 8  # a round is crowded when fewer than one of so many senders merges


def _with_strengths(halves: DataFrame, parents: DataFrame) -> DataFrame:
    """(src, dst, w, sv, su) with src < dst: each edge as one between the parents of its ends, with their strengths.

    ``parents`` is (v, parent, strength of the parent) for every vertex of an edge. Both directions of an edge have the same gain,
    so one row is kept for both, and with the strengths in it no round has to fetch them again.
    """
    left = parents.select(F.col("v").alias("src"), F.col("parent").alias("_s"), F.col("strength").alias("_ps"))
    right = parents.select(F.col("v").alias("dst"), F.col("parent").alias("_d"), F.col("strength").alias("_pd"))
    ends = halves.select("src", "dst", "w").join(left, "src").join(right, "dst").filter("_s <> _d")
    up = F.col("_s") < F.col("_d")
    return ends.select(
        F.when(up, F.col("_s")).otherwise(F.col("_d")).alias("src"), F.when(up, F.col("_d")).otherwise(F.col("_s")).alias("dst"), "w",
        F.when(up, F.col("_ps")).otherwise(F.col("_pd")).alias("sv"), F.when(up, F.col("_pd")).otherwise(F.col("_ps")).alias("su"),
    )


def _both_ways(halves: DataFrame) -> DataFrame:
    ways = F.array(F.struct("src", "dst", "sv", "su"),
                   F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("su").alias("sv"), F.col("sv").alias("su")))
    return halves.select("w", F.explode(ways).alias("e")).select("e.src", "e.dst", "w", "e.sv", "e.su")


class _Edges:
    """A graph for ``communities``: (src, dst, w, sv, su) with src < dst, written out for every round."""

    def __init__(self, current: DataFrame, strengths: DataFrame):
        self.current, self.strengths = materialize(current, "graph"), strengths

    @classmethod
    def of(cls, weights: DataFrame) -> _Edges:
        strengths = materialize(degrees(weights).select("v", "strength"), "strength")
        themselves = strengths.select("v", F.col("v").alias("parent"), "strength")
        return cls(_with_strengths(weights.filter("src < dst"), themselves), strengths)

    def proposals(self, total: Column, seed: int, refused: DataFrame | None) -> DataFrame:
        among = self.current
        if refused is not None:
            among = among.join(refused.select(F.col("v").alias("src")), "src", "left_semi")
            among = among.join(refused.select(F.col("v").alias("dst")), "dst", "left_semi")
        return _best(_both_ways(among), total, seed)

    def contract(self, moved: DataFrame, strengths: DataFrame) -> _Edges:
        parents = moved.select("v", "parent").join(strengths.withColumnRenamed("v", "parent"), "parent")
        contracted = _with_strengths(self.current, materialize(parents, "parents")).groupBy("src", "dst")
        return _Edges(contracted.agg(F.sum("w").alias("w"), F.max("sv").alias("sv"), F.max("su").alias("su")), strengths)


class Meetings:
    """A graph given by the batches in which vertices meet: (batch, v, times), one row for each vertex of a batch.

    The weight of an edge is the sum over the batches of the products of both ``times``, and merged vertices add theirs up.
    A round makes its edges from the batches, block by block, keeps the best ones in the task that made them, and drops them:
    a batch of n vertices is stored and sent as lists, never as its n * (n - 1) / 2 pairs. Once there can be no more than
    ``STORED_EDGES`` edges per member, they are written out, so that many rounds on few vertices need not make them again.
    """

    def __init__(self, members: DataFrame, strengths: DataFrame | None = None):
        self.members = members
        self.strengths = self._strengths() if strengths is None else strengths

    def _strengths(self) -> DataFrame:
        batches = self.members.groupBy("batch").agg(F.collect_list(F.struct("v", "times")).alias("m"), F.sum("times").alias("n"))
        each = batches.select("n", F.explode("m").alias("m"))
        met = F.sum(F.col("m.times") * (F.col("n") - F.col("m.times"))).cast("double")
        return materialize(each.groupBy(F.col("m.v").alias("v")).agg(met.alias("strength")).filter("strength > 0"), "strength")

    def _halves(self, members: DataFrame, pairs: int) -> DataFrame:
        """(src, dst, w, sv, su) with src < dst, made and joined with the strengths in the block of src and dst."""
        groups = _groups(_enough_tasks(members, -(-pairs // TASK_PAIRS) or 1))
        edges = edge_weights(cooccurrence_edges(members, "v", "batch", 1, "block", "times", groups), "w", "block", mirrored=False)
        other = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("h")
        homes = self.strengths.select("v", "strength", _group_of("v", groups).alias("g"), other)
        block = _block_of(F.least("g", "h"), F.greatest("g", "h")).alias("block")
        dealt = homes.select(block, "v", "strength").repartitionById(groups * (groups + 1) // 2, "block")
        for end, strength in (("src", "sv"), ("dst", "su")):
            of_end = dealt.select("block", F.col("v").alias(end), F.col("strength").alias(strength))
            edges = edges.join(of_end.hint("shuffle_hash"), ["block", end])
        return edges.select("src", "dst", "w", "sv", "su")

    def as_stored(self) -> Meetings | _Edges:
        """The edges themselves where they take no more room than the members."""
        n, pairs = _sizes(self.members)
        vertices = self.strengths.count()
        if min(pairs, vertices * (vertices - 1) // 2) > n * STORED_EDGES:
            return self
        return _Edges(self._halves(self.members, pairs), self.strengths)

    def proposals(self, total: Column, seed: int, refused: DataFrame | None) -> DataFrame:
        members = self.members if refused is None else self.members.join(refused, "v", "left_semi")
        edges = self._halves(members, _sizes(members)[1])
        gains = edges.withColumn("gain", F.col("w") - F.col("sv") * F.col("su") / total).filter("gain > 0")
        found = gains.withColumn("tie", F.xxhash64("src", "dst", F.lit(seed))).mapInArrow(best_edges, BEST_ROWS)
        best = found.groupBy("v").agg(F.min(F.struct((-F.col("gain")).alias("loss"), "tie", "u", "w", "sv", "su")).alias("b"))
        return best.select("v", "b.u", (-F.col("b.loss")).alias("gain"), "b.w", "b.sv", "b.su")

    def contract(self, moved: DataFrame, strengths: DataFrame) -> Meetings | _Edges:
        renamed = self.members.join(moved.select("v", "parent"), "v").groupBy("batch", F.col("parent").alias("v"))
        return Meetings(materialize(renamed.agg(F.sum("times").alias("times")), "members"), strengths).as_stored()


def _sizes(members: DataFrame) -> tuple[int, int]:
    """The members and the pairs of all batches."""
    k = F.col("k")
    n, pairs = members.groupBy("batch").agg(F.count(F.lit(1)).alias("k")).agg(F.sum(k), F.sum(int_div(k * (k - 1), 2))).first()
    return n or 0, pairs or 0


def communities(weights: DataFrame | Meetings, n: int | None = None) -> DataFrame:
    """(v, parent, round): merge forest of greedy modularity clustering.

    Every round each vertex proposes its best neighbour, coins turn the proposals into stars, and the merged edges are
    contracted. Each accepted merge raises the modularity. A vertex without a proposal never gets one again, as the gain
    with a merged neighbour is the sum of the gains with its parts. A quarter of the senders may be expected to try in a
    round, and of those who try to join the same vertex at least one succeeds, all of them while the gain lasts. Where many keep to
    one that gains from few of them, the next round is among the refused only, as they may gain from each other. The rounds
    follow the logarithm of the number of vertices on paths, stars and rings of cliques (measured). There is no such bound
    for all graphs: one clique that is the whole graph takes about half as many rounds as vertices (13 for 24). The loop ends when nobody proposes.
    ``weights`` is as ``edge_weights`` gives it, and read twice, or ``Meetings``, which give the same forest without their edges being
    written out while they are many. Senders, merges and the smaller graph of each round are. Coins
    are hashes, so the result is the same on every run. Roots have themselves as parent and round -1.
    """
    current = weights.as_stored() if isinstance(weights, Meetings) else _Edges.of(weights)
    strengths = current.strengths
    everyone = strengths.select("v") if n is None else strengths.sparkSession.range(n).select(F.col("id").alias("v"))
    total = strengths.agg(F.sum("strength")).first()[0]
    merges, refused = [], None
    for step in count():
        proposals = current.proposals(F.lit(total), step, refused)
        senders = materialize(_senders(materialize(proposals, "proposals")), "senders")
        n_senders = senders.count()
        if not n_senders and refused is None:
            break
        accepted = materialize(_accepted_merges(_attempts(senders, step), total), "merges")
        n_accepted, refused = accepted.count(), None
        if not n_accepted:  # nobody refused has a gain with another, or the coins fell badly
            continue
        merges.append(accepted.withColumn("round", F.lit(step)))
        moved = materialize(strengths.join(accepted, "v", "left").select("v", F.coalesce("parent", "v").alias("parent"), "strength"), "moved")
        strengths = materialize(moved.groupBy(F.col("parent").alias("v")).agg(F.sum("strength").alias("strength")), "strength")
        current = current.contract(moved, strengths)
        if n_accepted * CROWDED < n_senders:
            merged = accepted.select(F.explode(F.array("v", "parent")).alias("v"))
            refused = materialize(senders.select("v").join(merged, "v", "left_anti"), "refused")
    if not merges:
        return everyone.select("v", F.col("v").alias("parent"), F.lit(-1).alias("round"))
    forest = reduce(DataFrame.union, merges)
    return everyone.join(forest, "v", "left").select(
        "v", F.coalesce("parent", "v").alias("parent"), F.coalesce("round", F.lit(-1)).alias("round")
    )


def modularity(weights: DataFrame, membership: DataFrame) -> DataFrame:
    """(modularity): sum over communities of loop / m2 - (all / m2)^2 for (v, community)."""
    left = membership.select(F.col("v").alias("src"), F.col("community").alias("cs"))
    right = membership.select(F.col("v").alias("dst"), F.col("community").alias("cd"))
    inside = F.when(F.col("cs") == F.col("cd"), F.col("w")).otherwise(0.0)
    per_community = (
        weights.join(left, "src").join(right, "dst")
        .groupBy("cs").agg(F.sum("w").alias("all_w"), F.sum(inside).alias("loop_w"))
    )
    m2 = weights.agg(F.sum("w")).scalar()
    return per_community.agg(
        F.sum(F.col("loop_w") / m2 - (F.col("all_w") / m2) * (F.col("all_w") / m2)).alias("modularity")
    )


def count_communities(membership: DataFrame) -> DataFrame:
    return membership.agg(F.countDistinct("community").alias("n_communities"))


def _climb(state: DataFrame, columns: dict[str, Column], n: int, gained: Column | None = None) -> DataFrame:
    """Double the reach of (v, up, ...) until nobody has anything above.

    Before a round, ``up`` is the ancestor 2^k steps away or null. ``columns`` are the values after the round, in terms of
    v's own and of ``_`` + name of the one at ``up``; ``gained``, if given, is summed over all vertices that have v as ``up`` and
    arrives as ``_gained``. Rows keep their width, and there are as many rounds as the logarithm of the depth.
    """
    for step in count():
        if state.filter("up is not null").isEmpty():
            return state
        if 1 << step > max(1, n):
            raise ValueError("parent pointers run in a circle")
        above = state.select(F.col("v").alias("up"), F.col("up").alias("_up"), *[F.col(c).alias(f"_{c}") for c in columns])
        joined = state.join(above, "up", "left")
        if gained is not None:
            sums = state.filter("up is not null").groupBy(F.col("up").alias("v")).agg(F.sum(gained).alias("_gained"))
            joined = joined.join(sums, "v", "left")
        state = materialize(joined.select("v", F.col("_up").alias("up"), *[c.alias(name) for name, c in columns.items()]), "climb")


def subtree_sizes(forest: DataFrame) -> DataFrame:
    """(v, parent, size): how many vertices hang below and at each vertex of (v, parent); roots are their own parents.

    A round adds to v the sizes of those that have v 2^k steps above, so it counts twice as deep as the one before.
    """
    up = F.when(F.col("parent") != F.col("v"), F.col("parent"))
    start = materialize(forest.select("v", up.alias("up"), F.lit(1).cast("bigint").alias("size")), "climb")
    grown = F.col("size") + F.coalesce("_gained", F.lit(0))
    sizes = _climb(start, {"size": grown}, start.count(), gained=F.col("size")).select("v", "size")
    return forest.select("v", "parent").join(sizes, "v")


def permutation(forest: DataFrame) -> DataFrame:
    """(old, new): ids numbered community by community, depth first along the merge tree.

    A vertex stands behind its parent by one plus the sizes of its earlier siblings (by id), a root behind all earlier
    trees; its place is the sum of these distances up to the root. Both come from doubling rounds over rows of
    constant width, the sums over siblings from one sorted pass, in which a hub's children may lie in many partitions.
    The result covers [0, n) when the forest does.
    """
    sizes = subtree_sizes(forest)
    siblings = sizes.withColumn("up", F.when(F.col("parent") != F.col("v"), F.col("parent")))
    placed = running(siblings, ["v"], "size", "_earlier", group=["up"], inclusive=False)
    behind = F.col("_earlier") + F.when(F.col("up").isNotNull(), 1).otherwise(0)
    start = materialize(placed.select("v", "up", behind.alias("at")), "climb")
    places = _climb(start, {"at": F.col("at") + F.coalesce("_at", F.lit(0))}, start.count())
    return places.select(F.col("v").alias("old"), F.col("at").alias("new"))


def offset_permutation(perm: DataFrame, hot: int) -> DataFrame:
    """The permutation of cold ids, moved behind the ``hot`` first ids."""
    return perm.select("old", (F.col("new") + hot).alias("new"))


def compose_bijection(ranks: DataFrame, cold_permutation: DataFrame, hot: int) -> DataFrame:
    """(old_id, new_id): frequency rank k, replaced for cold ids by the community order.

    ``cold_permutation`` permutes cold ids 1..n among themselves; rank ``hot`` (cold id 0) and all
    ranks outside the graph keep their number, so the result is a bijection.
    """
    moved = offset_permutation(cold_permutation, hot)
    keyed = ranks.select("old_id", F.col("new_id").alias("k"))
    cold = moved.filter("old > 0").select((F.col("old") + hot).alias("k"), F.col("new").alias("_new"))
    return keyed.join(cold, "k", "left").select("old_id", F.coalesce("_new", "k").alias("new_id"))


def reorder_cold_ids(df: DataFrame, ranks: DataFrame, id_col: str, pos: str, hot: int, batch_size: int = 512) -> DataFrame:
    """(old_id, new_id): the whole re-ordering of one field.

    Ranked ids -> cold range -> co-occurrence graph per batch -> communities -> permutation of the
    cold ids 1..n -> composed with the ranks. ``df`` holds frequency ranks in ``id_col``. The graph is kept as the
    members of the batches; its edges are made where they are needed and written out only when they are few.
    """
    cold = df.select(int_div(pos, batch_size).alias("batch"), to_cold_range(id_col, hot).alias("v")).filter("v > 0")
    members = materialize(cold.distinct().withColumn("times", F.lit(1).cast("bigint")), "members")
    reach = members.groupBy("batch").agg(F.min("v").alias("src"), F.max("v").alias("dst")).filter("src < dst")  # of the ids with an edge
    n = vertex_count(reach).first()["n"]
    forest = materialize(communities(Meetings(members), n).filter("v > 0"), "forest")
    shifted = permutation(forest).select("old", (F.col("new") + 1).alias("new"))
    return compose_bijection(ranks, shifted, hot)


def order_graph(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Communities (v, community) and new numbering (old, new) of an edge list (src, dst)."""
    weights = materialize(edge_weights(edges), "edges")
    n = vertex_count(edges).first()["n"]
    forest = materialize(communities(weights, n), "forest")
    members = trace_community(forest).select("v", F.col("root").alias("community"))
    return members, permutation(forest)


def check_partition(forest: DataFrame, perm: DataFrame, n: int) -> DataFrame:
    """One verdict row: every vertex has one top, tops are their own parents, the permutation covers [0, n)."""
    traced = trace_community(forest)
    tops = traced.select(F.col("root").alias("v")).distinct()
    own_parents = tops.join(forest, "v").agg(
        F.count(F.lit(1)).alias("n_tops"),
        F.sum((F.col("v") == F.col("parent")).cast("bigint")).alias("n_own"),
    )
    vertices = traced.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("v").alias("n_vertices"))
    covered = perm.agg(
        F.count(F.lit(1)).alias("n_perm"), F.countDistinct("new").alias("n_new"),
        F.min("new").alias("lo"), F.max("new").alias("hi"),
    )
    one = F.lit(1).alias("_k")
    joined = (
        vertices.select("*", one).join(own_parents.select("*", one), "_k").join(covered.select("*", one), "_k")
    )
    return joined.select(
        "n_vertices",
        ((F.col("n_rows") == n) & (F.col("n_vertices") == n)).alias("one_top_each"),
        (F.col("n_tops") == F.col("n_own")).alias("tops_are_roots"),
        ((F.col("n_perm") == n) & (F.col("n_new") == n) & (F.col("hi") - F.col("lo") == n - 1)).alias("is_permutation"),
    )
