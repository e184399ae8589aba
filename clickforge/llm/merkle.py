"""Merkle manifest of a document set: leaf, subroot of the language, root, and a checked proof for every document.

A leaf is the hash of a document's columns. Inside a group (language) leaves ascend by key; every ``FAN``
consecutive nodes become their hash until one is left, the subroot. Subroots, ordered by group, are hashed the same way.

Levels are sibling-shift self-joins: a slot-zero node joins its siblings at the computed indices idx + 1 ... idx + 7
and emits the parent. All seven joins have the same key (group, first index of the run), so a level moves each
node once. Proofs go down from the root: a run takes its parent's proof, so a level costs an eighth of the one below.

Scale: leaves are stored once with their digests, texts are never moved. Places come from ``rank_in_group``, which
splits a group that holds most rows; join keys hold the node's index, so a hot group is no hot key. Digests travel as 32
bytes. The number of levels is the logarithm of the largest group. Only the root reaches the driver.

Cases: null columns hash as ``-``; a null group is a group of its own, before all others; null keys come first and are
never tampered with; repeated keys follow each other by their leaf's hash, so equal rows get the proofs of
consecutive places; a group of one document is its leaf, and a proof without siblings is the hash of the
empty text; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickforge.functions.scalars import int_div
from clickforge.llm.common import ascii_lower
from clickforge.operators.ordering import rank_in_group
from clickforge.session import materialize

FAN = 8
WIDTH = 32  # bytes of a digest
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "struct<left: binary, right: binary>"


def _field(value: Column) -> Column:
    shown = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown), F.lit("-"))


def leaf_hash(values: Sequence[Column]) -> Column:
    """Binary digest of values: each ``-`` if null, else byte count, ``:``, value."""
    return F.unhex(F.sha2(F.concat(*map(_field, values)), 256))


def _hex(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def _siblings(digests: Column, slot: Column) -> Column:
    """The digests of a run to the left and to the right of a slot."""
    left = digests.substr(F.lit(1), slot * WIDTH)
    right = digests.substr(slot * WIDTH + WIDTH + 1, F.lit(FAN * WIDTH))
    return F.struct(left.alias("left"), right.alias("right"))


def _slot(idx: str) -> Column:
    return F.pmod(F.col(idx), F.lit(FAN)).cast("int")


def runs_of(nodes: DataFrame) -> DataFrame:
    """(g, run, digests, alone) of nodes (g, idx, digest): one row for each run of siblings.

    ``alone`` marks a group's only node.
    """
    joined = nodes.filter(_slot("idx") == 0).select("g", F.col("idx").alias("first"), F.col("digest").alias("d0"))
    for shift in range(1, FAN):
        # the sibling's index is first + shift
        sibling = nodes.filter(_slot("idx") == shift).select("g", (F.col("idx") - shift).alias("first"), F.col("digest").alias(f"d{shift}"))
        joined = joined.join(sibling, ["g", "first"], "left")
    none = F.lit(b"")
    digests = F.concat("d0", *[F.coalesce(f"d{k}", none) for k in range(1, FAN)])
    alone = (F.col("first") == 0) & F.col("d1").isNull()
    return joined.select("g", int_div("first", FAN).alias("run"), digests.alias("digests"), alone.alias("alone"))


class Tree:
    """Stored levels of runs from the leaves up, for every group at once."""

    def __init__(self, nodes: DataFrame):
        self.levels: list[DataFrame] = []
        while True:
            level = materialize(runs_of(nodes), "merkle-level")
            self.levels.append(level)
            runs = level.filter(~F.col("alone"))
            if runs.isEmpty():
                break
            parent = F.unhex(F.sha2(_hex(F.col("digests")), 256))
            nodes = materialize(runs.select("g", F.col("run").alias("idx"), parent.alias("digest")), "merkle-nodes")

    def _tops(self, level: int) -> DataFrame:
        return self.levels[level].filter("alone").select("g", F.col("digests").alias("top"))

    def tops(self) -> DataFrame:
        """(g, top): the last node of each group."""
        out = self._tops(0)
        for level in range(1, len(self.levels)):
            out = out.union(self._tops(level))
        return out

    def proofs(self, nodes: DataFrame, upper: DataFrame) -> DataFrame:
        """The nodes of the lowest level (g, idx, ...) with their group's ``top`` and their proof, an array of siblings.

        ``upper`` is (g, above): the steps that follow the group's top.
        """
        above = None  # of the runs one level up: the steps above the run
        for level in range(len(self.levels) - 1, -1, -1):
            ends = self._tops(level).join(upper, "g")  # one row for each group that ends here
            if above is not None:
                runs = self.levels[level].filter(~F.col("alone")).select("g", "run", "digests")
                runs = runs.join(above, ["g", "run"])
            if level == 0:
                # leaves that are their group's only node, and all others
                own = nodes.withColumn("run", int_div("idx", FAN))
                alone = own.filter("idx = 0").join(ends, "g").select(*nodes.columns, "top", F.col("above").alias("proof"))
                if above is None:
                    return alone
                many = own.join(runs, ["g", "run"])
                steps = F.concat(F.array(_siblings(F.col("digests"), _slot("idx"))), F.col("above"))
                return alone.union(many.select(*nodes.columns, "top", steps.alias("proof")))
            # what stands above the runs of the level below: its node here has the index ``run``
            finished = ends.select("g", F.lit(0).cast("bigint").alias("run"), "top", "above")
            if above is not None:
                slots = runs.withColumn("slot", F.explode(F.sequence(F.lit(0), (F.octet_length("digests") / WIDTH).cast("int") - 1)))
                steps = F.concat(F.array(_siblings(F.col("digests"), F.col("slot"))), F.col("above"))
                spread = slots.select("g", (F.col("run") * FAN + F.col("slot")).alias("run"), "top", steps.alias("above"))
                finished = finished.union(spread)
            above = materialize(finished, "merkle-proofs")
        raise AssertionError("a tree has at least one level")


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf (hex) and its siblings give."""
    return F.aggregate(proof, start, lambda own, step: F.sha2(F.concat(_hex(step["left"]), own, _hex(step["right"])), 256))


def prove(docs: DataFrame, key: str = "doc_id", group: str = "lang", text: str = "text", fields: Sequence[str] = FIELDS) -> DataFrame:
    """The key, leaf, subroot, root, proof_sha256, folded_root and verified of every document.

    Where 3 divides the CRC-32 of the key, the text is tampered with (A-Z become small) before its leaf is folded.
    """
    columns = {c: F.col(f"`{c}`") for c in fields}
    tampered = columns | {text: ascii_lower(F.col(f"`{text}`"))}
    hit = F.coalesce(F.crc32(columns[key].cast("string").cast("binary")) % 3 == 0, F.lit(False))
    leaves = docs.select(
        columns[key].alias("k"),
        F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit("-")).alias("g"),
        leaf_hash(list(columns.values())).alias("digest"),
        F.when(hit, leaf_hash(list(tampered.values()))).alias("changed"),
    )
    leaves = materialize(leaves, "merkle-leaves")
    placed = materialize(rank_in_group(leaves, ["g"], [F.col("k").asc_nulls_first(), F.col("digest")], "idx"), "merkle-placed")
    tree = Tree(placed.select("g", "idx", "digest"))
    subroots = materialize(rank_in_group(tree.tops(), [], ["g"], "idx"), "merkle-subroots")
    over = Tree(subroots.select(F.lit("").alias("g"), "idx", F.col("top").alias("digest")))
    lone = over.tops().select("g", F.lit(None).cast(f"array<{STEP}>").alias("above")).withColumn("above", F.coalesce("above", F.array().cast(f"array<{STEP}>")))
    upper = over.proofs(subroots.select(F.lit("").alias("g"), "idx", F.col("g").alias("own")), lone)
    upper = materialize(upper.select(F.col("own").alias("g"), F.col("proof").alias("above"), F.col("top").alias("root")), "merkle-upper")
    first = upper.select("root").first()
    root = F.lit(first["root"].hex() if first else None).cast("string")
    proven = tree.proofs(placed, upper.select("g", "above"))
    siblings = F.array_join(F.transform("proof", lambda s: F.concat(_hex(s["left"]), _hex(s["right"]))), "")
    folded = fold(_hex(F.coalesce("changed", "digest")), F.col("proof"))
    return proven.select(
        F.col("k").alias(key), _hex(F.col("digest")).alias("leaf"), _hex(F.col("top")).alias("subroot"), root.alias("root"),
        F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
