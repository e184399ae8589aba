"""SimHash near-duplicates by a binary trie self-join.

A document's fingerprint has 64 bits; a bit is set if it is set in over half of its shingles' hashes. Two
fingerprints link at ``BUDGET`` or fewer differing bits, and a component is what links reach.

Search: two fingerprints that differ in at most 4 bits agree in at least two of six blocks of bits. So the
distinct fingerprints are put into 15 tries, one for each pair of blocks, whose first levels are these two
blocks. In a trie's first levels no bit may differ; below, pairs of nodes are walked together, differing
bits are added up, and a pair is dropped when they exceed the budget. A trie is a sorted array and a node a
range of it, so a whole partition of tries is walked level by level with numpy. Within a node whose
remaining bits cannot exceed the budget, all fingerprints are linked in a chain instead of in pairs; every
task turns its links into a forest, so it returns fewer rows than it read.

Scale: exact copies collapse to one fingerprint before the search. A trie node of the first levels holds
2 ** -21 of random fingerprints. Crowded ones (one family of near copies) are cut into chunks, and the
pairs of chunks are dealt to tasks. Links are joined to components by ``components``. Nothing is collected.

Cases: a null or blank text has fingerprint zero and links like any other; fewer than ``SHINGLE`` words are one
shingle; repeated rows and equal texts share a component; a null document id takes part, and a component with
null ids only has a null id; extra columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickforge.llm.common import free_name, whole
from clickforge.llm.components import components
from clickforge.session import materialize

SHINGLE, SEED, BUDGET = 4, 42, 4
BLOCKS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]  # first bit, width
CROWD = 4096  # fingerprints of a first-level node that one task takes alone
STEP = 1 << 18  # node pairs walked at a time
LEAF = 64  # node pairs of so few fingerprint pairs are compared one by one


def shingle_hashes(text: str, width: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Hash of each shingle of the words, in order, repeats included."""
    words = text.encode().lower().split()  # A-Z only; splits at 0x20 and 0x09-0x0D
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = max(1, len(words) - width + 1)
    last = ends[min(width, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), last.tolist())), np.uint64, n)


def fingerprint(text: str, width: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of the words' shingles, repeats included."""
    hashes = shingle_hashes(text, width, seed)
    n = len(hashes)
    ones = np.zeros(64, np.int64)
    for a in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[a : a + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = np.array([fingerprint(t) for t in batch.column(batch.num_columns - 1).to_pylist()], np.uint64)
        columns = [batch.column(i) for i in range(batch.num_columns - 1)] + [pa.array(marks.view(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


def with_fingerprint(docs: DataFrame, keep: list[str], text: str, name: str) -> DataFrame:
    """The columns ``keep`` and the signed 64-bit fingerprint ``name``."""
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], whole(text).alias(name))
    schema = rows.drop(name).schema.add(name, "long")
    return rows.mapInArrow(_fingerprints, schema)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable position for each of n positions under the links (a, b)."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        open_ = low != high
        a, b, low, high = a[open_], b[open_], low[open_], high[open_]
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    return root


class _Forest:
    """Links of a task, folded into roots whenever many have come."""

    def __init__(self, n: int):
        self.n, self.root, self.a, self.b, self.held = n, np.arange(n), [], [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.root[a], self.root[b]
        new = a != b
        self.a.append(a[new])
        self.b.append(b[new])
        self.held += int(new.sum())
        if self.held > 4 * STEP:
            self.fold()

    def fold(self) -> np.ndarray:
        if self.held:
            self.root = _roots(self.n, np.concatenate(self.a), np.concatenate(self.b))[self.root]
            self.a, self.b, self.held = [], [], 0
        return self.root


def walk(sorted_bits: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray, other_end: np.ndarray,
         depth: int, forest: _Forest, budget: int = BUDGET) -> None:
    """Walk node pairs [start, end) x [other, other_end) that agree in their first ``depth`` bits.

    A node paired with itself has other == start. Frontiers are cut to ``STEP`` pairs, deepest first, so
    memory stays bounded.
    """
    stack = [(depth, start, end, other, other_end, np.zeros(len(start), np.int8))]
    while stack:
        d, a, b, c, e, off = stack.pop()
        if len(a) > STEP:
            stack += [(d, *(x[i : i + STEP] for x in (a, b, c, e, off))) for i in range(0, len(a), STEP)]
            continue
        same = a == c
        # all below are within the budget: a chain links them
        sure = off + (64 - d) <= budget
        if sure.any():
            for i in np.flatnonzero(sure):
                span = np.r_[np.arange(a[i], b[i]), np.arange(c[i], e[i])]
                forest.add(span[:-1], span[1:])
        n_pairs = (b - a) * (e - c)
        small = ~sure & (n_pairs <= LEAF)
        if small.any():
            sa, sc, wide, count = a[small], c[small], (e - c)[small], n_pairs[small]
            which = np.repeat(np.arange(len(sa)), count)
            k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            left, right = sa[which] + k // wide[which], sc[which] + k % wide[which]
            near = np.bitwise_count(sorted_bits[left] ^ sorted_bits[right]) <= budget
            near &= left != right
            forest.add(left[near], right[near])
        go = ~sure & ~small
        if not go.any():
            continue
        a, b, c, e, off, same = a[go], b[go], c[go], e[go], off[go], same[go]
        bit = np.uint64(63 - d)
        ones = np.r_[0, np.cumsum((sorted_bits >> bit) & np.uint64(1))].astype(np.int64)
        m, q = b - (ones[b] - ones[a]), e - (ones[e] - ones[c])  # zeros come first inside a node
        parts = [(a, m, c, q, off), (m, b, q, e, off), (a, m, q, e, off + 1), (m, b, c, q, off + 1)]
        # a node with itself crosses its halves once
        keep = [np.ones(len(a), bool), np.ones(len(a), bool), np.ones(len(a), bool), ~same]
        alive = [k & (x[1] > x[0]) & (x[3] > x[2]) & (x[4] <= budget) for k, x in zip(keep, parts)]
        merged = [np.concatenate([x[i][k] for x, k in zip(parts, alive)]) for i in range(5)]
        if len(merged[0]):
            stack.append((d + 1, *merged))


def turned(mark: np.ndarray, front: tuple[int, int]) -> np.ndarray:
    """The bits with the two blocks in front, the others after them in their order."""
    out, used = np.zeros(len(mark), np.uint64), 0
    for k in [*front, *(i for i in range(len(BLOCKS)) if i not in front)]:
        first, width = BLOCKS[k]
        block = (mark >> np.uint64(64 - first - width)) & np.uint64((1 << width) - 1)
        used += width
        out |= block << np.uint64(64 - used)
    return out


_FRONTS = list(combinations(range(len(BLOCKS)), 2))


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (front, lot, side, mark) of whole lots to a forest of links (a, b)."""
    own = list(batches)
    if not own:
        return
    table = pa.Table.from_batches(own)
    front, lot, side, mark = (table.column(i).to_numpy() for i in range(4))
    mark = mark.view(np.uint64)
    out_a, out_b = [], []
    for f in np.unique(front):
        own = front == f
        key, sides, marks = lot[own], side[own], mark[own]
        bits = turned(marks, _FRONTS[f])
        order = np.lexsort((bits, sides, key))
        key, sides, marks, bits = key[order], sides[order], marks[order], bits[order]
        depth = BLOCKS[_FRONTS[f][0]][1] + BLOCKS[_FRONTS[f][1]][1]
        cut = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (sides[1:] != sides[:-1])])
        end = np.r_[cut[1:], len(key)]
        forest = _Forest(len(key))
        # side 0 with itself, or sides 1 and 2 with each other; equal marks of two sides do not occur
        alone = sides[cut] == 0
        walk(bits, cut[alone], end[alone], cut[alone], end[alone], depth, forest)
        one, two = np.flatnonzero(sides[cut] == 1), np.flatnonzero(sides[cut] == 2)
        both, i, j = np.intersect1d(key[cut[one]], key[cut[two]], return_indices=True)
        if len(both):
            one, two = one[i], two[j]
            walk(bits, cut[one], end[one], cut[two], end[two], depth, forest)
        root = forest.fold()
        linked = np.flatnonzero(root != np.arange(len(root)))
        out_a.append(marks[linked].view(np.int64))
        out_b.append(marks[root[linked]].view(np.int64))
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["a", "b"])


def links(marks: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column ``mark``) that connect whatever is within the budget."""
    fronts = []
    for k, (i, j) in enumerate(_FRONTS):
        value = [F.shiftrightunsigned("mark", 64 - a - w).bitwiseAND(F.lit((1 << w) - 1)) for a, w in (BLOCKS[i], BLOCKS[j])]
        fronts.append(F.struct(F.lit(k).alias("front"), (F.shiftleft(value[0], 11) + value[1]).alias("node")))
    dealt = marks.select("mark", F.explode(F.array(*fronts)).alias("x")).select("x.front", "x.node", "mark")
    sizes = dealt.groupBy("front", "node").count()
    crowded = sizes.filter(F.col("count") > crowd).select(
        "front", "node", F.ceil(F.col("count") / crowd).cast("int").alias("chunks")
    )
    crowded = materialize(crowded, "crowded")
    if crowded.isEmpty():
        lots = dealt.select("front", F.col("node").cast("long").alias("lot"), F.lit(0).alias("side"), "mark")
    else:
        # chunk i meets every chunk: alone with itself, else as side 1 of (i, j) or side 2 of (j, i), i < j
        mine = F.pmod(F.xxhash64("mark"), F.coalesce("chunks", F.lit(1))).cast("int")
        meets = F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1))
        lots = dealt.join(crowded, ["front", "node"], "left").select("front", "node", "mark", mine.alias("i"), meets.alias("j"))
        low, high = F.least("i", "j"), F.greatest("i", "j")
        lots = lots.select(
            "front", F.xxhash64("node", low, high).alias("lot"),
            F.when(F.col("i") == F.col("j"), 0).when(F.col("i") < F.col("j"), 1).otherwise(2).alias("side"), "mark",
        )
    parts = int(marks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return lots.repartition(parts, "front", "lot").mapInArrow(_search, "a long, b long")


def _named(own: DataFrame, mark: str, least: Column) -> DataFrame:
    """(mark, group): the smallest ``least`` that links reach from each fingerprint."""
    marks = materialize(own.groupBy(F.col(f"`{mark}`").alias("mark")).agg(F.min(least).alias("least")), "marks")
    roots = components(links(marks.select("mark"))).withColumnRenamed("vertex", "mark")
    linked = marks.join(roots, "mark")
    group = linked.groupBy("root").agg(F.min("least").alias("group"))
    moved = linked.join(group, "root").select("mark", "root", "group")
    return marks.join(moved, "mark", "left").select(
        F.col("mark").alias("_mark"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("group")).alias("_group")
    )


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key, fingerprint (16 hex digits) and component_id: the smallest key that links reach."""
    own = materialize(with_fingerprint(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")), ["_key"], "_text", "_own"), "fingerprints")
    named = _named(own, "_own", F.col("_key"))
    return own.join(named, F.col("_own") == F.col("_mark")).select(
        F.col("_key").alias(key), F.lower(F.lpad(F.hex("_own"), 16, "0")).alias("fingerprint"), F.col("_group").alias("component_id")
    )


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Whole rows, one of each component: that with the smallest key (any one of repeated rows)."""
    mark, row = free_name(docs, "_mark_own"), free_name(docs, "_row")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    own = with_fingerprint(docs.withColumn(row, F.col(f"`{text}`")), docs.columns, row, mark)
    own = materialize(own.withColumn(row, F.monotonically_increasing_id()), "marked")
    least = F.struct(F.col(f"`{key}`").isNull(), F.col(f"`{key}`"), F.col(row).alias("row"))
    stay = _named(own, mark, least).select(F.col("_group.row").alias(row)).distinct()
    return own.join(stay, row, "left_semi").select(*columns)
