"""The best edge of every vertex of a task, kept while the edges pass by, as a function over Arrow batches.

Catalyst compares whole edges by sorting all of them by vertex; here one edge per vertex is held, in arrays sorted by vertex.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BEST_ROWS = "v bigint, u bigint, w double, sv double, su double, gain double, tie bigint"
CHUNK_EDGES = 1 << 16  # edges that are compared at once at least

_FIELDS = ("v", "u", "w", "sv", "su", "gain", "tie")


def _both_ways(edges: pa.Table) -> dict[str, np.ndarray]:
    columns = {c: edges[c].to_numpy() for c in ("src", "dst", "w", "sv", "su", "gain", "tie")}
    there = [columns[c] for c in ("src", "dst", "w", "sv", "su", "gain", "tie")]
    back = [columns[c] for c in ("dst", "src", "w", "su", "sv", "gain", "tie")]
    return {name: np.concatenate(pair) for name, pair in zip(_FIELDS, zip(there, back))}


def _better(held: dict[str, np.ndarray] | None, new: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """One edge per vertex, sorted by vertex: the largest gain, then the smallest tie, then the smallest neighbour."""
    if held is not None:
        at = np.minimum(np.searchsorted(held["v"], new["v"]), len(held["v"]) - 1)
        behind = (held["v"][at] == new["v"]) & (new["gain"] < held["gain"][at])
        new = {c: np.concatenate([held[c], x[~behind]]) for c, x in new.items()}
    order = np.lexsort((new["u"], new["tie"], -new["gain"], new["v"]))
    sorted_v = new["v"][order]
    first = order[np.r_[True, sorted_v[1:] != sorted_v[:-1]]]
    return {c: x[first] for c, x in new.items()}


def best_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``BEST_ROWS`` of a task from its edges (src, dst, w, sv, su, gain, tie), each of which counts for both of its ends.

    What is held follows the number of vertices; as many edges as that are compared at once, so each is sorted a bounded
    number of times.
    """
    held, waiting, rows = None, [], 0
    for batch in batches:
        waiting.append(batch)
        rows += len(batch)
        if rows >= max(CHUNK_EDGES, 0 if held is None else len(held["v"])):
            held, waiting, rows = _better(held, _both_ways(pa.Table.from_batches(waiting))), [], 0
    if rows:
        held = _better(held, _both_ways(pa.Table.from_batches(waiting)))
    if held is not None:
        yield from pa.table(held).to_batches(max_chunksize=CHUNK_EDGES)
