"""Threshold-scaled document fingerprints: every shingle hash below a fixed share of the hash range is kept.

The kept hashes of a text are a sample of its shingles that does not depend on the text's length, so the
fingerprint of two texts together follows from theirs (``merge``), and the share of the smaller fingerprint that
the other one holds estimates containment between very unequal documents.

The query compares each text with an edited one that takes its end from the next document in descending
order of ids. Neighbours are found without a global window: bounds from ``approx_percentile`` cut the ids
into ranges, each range is sorted by one task, and the first document of a range also goes to the range that
needs it as a neighbour.

Scale: texts are shuffled once (by range); everything else is a column expression of a row.

Cases: a null text is empty and has an empty fingerprint; fewer than ``SHINGLE`` words are one shingle; if no
hash is below the threshold the smallest one is kept, so only texts without words have an empty fingerprint.
Likeness of two empty fingerprints is 1, of an empty one and another 0. Equal texts have equal fingerprints.
Repeated ids are neighbours, in the order of their texts' hashes; null ids come last. Extra columns are
ignored. The only row of a table is its own neighbour; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickforge.llm.common import let, whole, words_of

SHINGLE = 5
SCALE_BITS = 3  # one hash in 2 ** SCALE_BITS is kept
MOST_RANGES = 1 << 14  # of ids; bounds an array in the plan


def hashes(text: Column, width: int = SHINGLE, scale_bits: int = SCALE_BITS) -> Column:
    """Sorted distinct shingle hashes whose first ``scale_bits`` bits are zero; never empty for a text with words."""

    def below(every: Column) -> Column:
        kept = F.filter(every, lambda h: F.shiftrightunsigned(h, 64 - scale_bits) == 0)
        return let(kept, lambda k: F.when(F.size(k) > 0, F.sort_array(F.array_distinct(k)))
                   .when(F.size(every) > 0, F.array(F.array_min(every))).otherwise(F.array().cast("array<bigint>")))

    def shingles(words: Column) -> Column:
        return F.transform(
            F.slice(words, 1, F.greatest(F.size(words) - (width - 1), F.least(F.size(words), F.lit(1)))),
            lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, width)]),
        )

    return let(words_of(text), lambda w: let(shingles(w), below))


def merge(left: Column, right: Column, scale_bits: int = SCALE_BITS) -> Column:
    """Fingerprint of the shingles of two documents together, exactly as ``hashes`` would make it of all of them.

    A hash above the threshold stands for a text that had none below; it counts only if the other side has none below either,
    and then the smaller one stays. So merging is associative and commutative, with the empty fingerprint as its neutral element.
    """
    def both(every: Column) -> Column:
        below = F.filter(every, lambda h: F.shiftrightunsigned(h, 64 - scale_bits) == 0)
        return let(below, lambda k: F.when((F.size(k) > 0) | (F.size(every) == 0), F.sort_array(k)).otherwise(F.array(F.array_min(every))))

    return let(F.array_union(left, right), both)


def likeness(left: Column, right: Column) -> Column:
    """Share of the smaller fingerprint's hashes that the other holds."""
    small = F.least(F.size(left), F.size(right))
    return F.when((F.size(left) == 0) & (F.size(right) == 0), F.lit(1.0)).when(small == 0, F.lit(0.0)).otherwise(
        F.size(F.array_intersect(left, right)) / small
    )


def as_text(fingerprint: Column) -> Column:
    """Sixteen hex digits for each hash, in order."""
    return F.array_join(F.transform(fingerprint, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def _rank(cuts: Column, n: int, key: Column) -> Column:
    """How many of n sorted cuts are below the key, by halving."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, n.bit_length())))])
    return F.aggregate(steps, F.lit(0), lambda low, s: F.when(
        (low + s <= n) & F.coalesce(F.get(cuts, low + s - 1) < key, F.lit(False)), low + s).otherwise(low))


def _longs(values: list) -> Column:
    return F.array(*[F.lit(v).cast("bigint") for v in values]).cast("array<bigint>")


def with_next(rows: DataFrame, key: str, text: str, tie: str, carried: list[str]) -> DataFrame:
    """``rows`` and, for each carried column, ``next_`` of it: its value in the next row in descending order of
    the key (then ascending ``tie``, nulls last); after the last row comes the first."""
    ranges = min(MOST_RANGES, 8 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    at_cuts = [i / ranges for i in range(1, ranges)] or [0.5]
    cuts = rows.agg(F.percentile_approx(key, at_cuts, 10 * ranges).alias("c")).first()["c"]
    cuts = sorted(set(cuts or []))
    at = F.when(F.col(key).isNull(), F.lit(0)).otherwise(_rank(_longs(cuts), len(cuts), F.col(key)))
    # largest key of each range that has rows (at most ``ranges`` numbers)
    tops = dict(rows.filter(F.col(key).isNotNull()).select(at.alias("r"), key).groupBy("r").agg(F.max(key)).collect())
    filled = sorted(tops)
    goes = {r: filled[(i + 1) % len(filled)] for i, r in enumerate(filled)}
    # a range's largest key follows the smallest one of the range above; the very first follows the last of all
    span = range(len(cuts) + 1)
    top, up = _longs([tops.get(r) for r in span]), _longs([goes.get(r) for r in span])
    last = F.lit(filled[-1] if filled else None).cast("int")
    to = F.when(at == last, F.lit(0)).otherwise(F.get(up, at).cast("int"))
    ghost = F.when(F.get(top, at) == F.col(key), F.struct(to.alias("r"), F.lit(1).alias("ghost")))
    copies = F.array_compact(F.array(F.struct(at.alias("r"), F.lit(0).alias("ghost")), ghost))
    dealt = rows.select("*", F.explode(copies).alias("_c")).select("*", F.col("_c.r").alias("_r"), F.col("_c.ghost").alias("_ghost"))
    order = Window.partitionBy("_r").orderBy("_ghost", F.col(key).desc_nulls_last(), tie)
    return dealt.select(
        *rows.columns, "_ghost",
        *[F.coalesce(F.lead(c).over(order), F.first(c).over(order)).alias(f"next_{c}") for c in carried],
    ).filter("_ghost = 0").drop("_ghost")


def compare_edited(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text (its last third replaced by the start of the next
    document), and their likeness; columns as in the query."""
    rows = docs.select(F.col(key).cast("bigint").alias("key"), whole(text).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("own", hashes(F.col("text")))
    near = with_next(rows, "key", "text", "tie", ["text", "own"])
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    near = near.select("key", n.cast("bigint").alias("n_chars"), edited.alias("edited"), "own", "next_own")
    near = near.withColumn("changed", hashes(F.col("edited")))
    return near.select(
        F.col("key").alias(key), "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        as_text(F.col("own")).alias("fingerprint"), as_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
