"""Best-fit packing of texts into contexts of fixed length, in bulk-synchronous rounds.

A text's length is its number of words (runs without white space).  A text longer than a context
is cut into pieces, all but the last filling a context each.

*Sort.*  Pieces are range-sorted by length, id and place in their text.  Pieces of one length are thus a run, in which
a piece has a rank; contexts with the same history are a run of equal gaps, numbered one after the other.  There are
at most ``capacity`` runs of pieces, and a round adds at most two runs of gaps, whatever the input.

*Rounds.*  A round takes the next shorter run of pieces and sweeps the sorted gaps upwards from its successor, the
smallest gap that is large enough: the run's pieces go there by rank, as many to each gap as it can hold, then to the next
larger gap, and what is left opens contexts.  So conflicts are settled by rank, k-th piece and k-th place meeting.  Then
the gaps that were used shrink and the next round begins.  This is best fit on decreasing lengths, exactly, for small pieces
too.  A round works on the runs' counts alone; what it yields are slots: stretches of ranks and the contexts they go to.
A run of gaps takes at most sqrt(2 * capacity) different lengths, which bounds the slots by 3 * capacity * sqrt(2 * capacity).

*Sweeps.*  Every task then sweeps its own range of the sorted pieces against the slots of their lengths, a successor search
for all of them at once.  Its ranks go on where the ranges before it stop: one count for each range and length in it.

Results: one row for each piece with ``context`` (numbered as opened, from 0), ``start`` (its place in the context),
the id, ``piece`` (0, 1, ...) and ``length``.  They don't depend on how the input is partitioned.

Defined results: null, empty and blank texts have length 0, no context and start 0.  Rows with a null or repeated id are packed
each; pieces of equal length, id and number can't be told apart in the result.  An empty table gives an empty one.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

CAPACITY = 2048

#: Of a length: first ranks, first contexts, pieces in each context, first piece's place.
Slots = dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def fit(counts: dict[int, int], capacity: int) -> Slots:
    """The slots of runs of pieces, given as {length: number}."""
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room: runs of contexts as (first, number)
    rooms: list[int] = []
    opened, slots = 0, {}

    def leave(room: int, first: int, number: int) -> None:
        if room and number:
            if not gaps[room]:
                insort(rooms, room)
            gaps[room].append((first, number))

    for length in sorted((n for n in counts if n), reverse=True):
        left, rank, found = counts[length], 0, []
        at = bisect_left(rooms, length)
        used = []
        while left and at < len(rooms):
            room = rooms[at]
            runs, each = gaps.pop(room), room // length
            rest = []
            for first, number in runs:
                full = min(number, left // each)
                if full:
                    found.append((rank, first, each, capacity - room))
                    used.append((room - each * length, first, full))
                    rank, left = rank + full * each, left - full * each
                if full < number and left:  # fewer than a gap can hold
                    found.append((rank, first + full, left, capacity - room))
                    used.append((room - left * length, first + full, 1))
                    rank, left, full = rank + left, 0, full + 1
                if full < number:
                    rest.append((first + full, number - full))
            rooms.pop(at)
            for first, number in rest:
                leave(room, first, number)
            if rest:
                break
        if left:
            each = capacity // length
            full, more = divmod(left, each)
            if full:
                found.append((rank, opened, each, 0))
                used.append((capacity - each * length, opened, full))
            if more:
                found.append((rank + full * each, opened + full, more, 0))
                used.append((capacity - more * length, opened + full, 1))
            opened += full + bool(more)
        for x in used:
            leave(*x)
        slots[length] = tuple(np.array(x, np.int64) for x in zip(*found))
    return slots


def _rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the range's number and each piece's rank among those of its length in the range."""
    from pyspark import TaskContext

    part, last, seen = TaskContext.get().partitionId(), -1, 0
    for b in batches:
        if not b.num_rows:
            continue
        length = b.column("length").to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], length[1:] != length[:-1])))
        begin = np.zeros(b.num_rows, np.int64)
        begin[starts] = starts
        rank = np.arange(b.num_rows) - np.maximum.accumulate(begin)
        if length[0] == last:
            rank[: starts[1] if len(starts) > 1 else b.num_rows] += seen
        last, seen = int(length[-1]), int(rank[-1]) + 1
        yield pa.record_batch([pa.array(np.full(b.num_rows, part, np.int32)), pa.array(rank), *b.columns[:3]], ["part", "rank", "doc", "piece", "length"])


def _place(shared, id_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, before = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            part, rank, length = (b.column(k).to_numpy() for k in ("part", "rank", "length"))
            context, start = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            cuts = np.flatnonzero((part[1:] != part[:-1]) | (length[1:] != length[:-1])) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
                n = int(length[i])
                if n:
                    low, first, each, place = slots[n]
                    r = rank[i:j] + before[int(part[i]), n]
                    at = np.searchsorted(low, r, side="right") - 1
                    context[i:j], own = first[at] + (r - low[at]) // each[at], (r - low[at]) % each[at]
                    start[i:j] = place[at] + own * n
            yield pa.record_batch([pa.array(context, mask=length == 0), pa.array(start.astype(np.int32)), b.column("doc"), b.column("piece"), b.column("length")], ["context", "start", id_col, "piece", "length"])

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table described above, one row for each piece of each row of ``docs``."""
    kind = dict(docs.dtypes)[id_col]
    length = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"\S+")), F.lit(0))
    rows = docs.select(F.col(id_col).alias("doc"), length.alias("n"))
    cuts = F.when(F.col("n") == 0, F.array(F.struct(F.lit(0).alias("piece"), F.lit(0).alias("length")))).otherwise(
        F.expr(f"transform(sequence(0, int((n - 1) div {capacity})), i -> struct(int(i) as piece, int(least({capacity}, n - i * {capacity})) as length))")
    )
    # The number splits ranges of pieces that are alike; which of them comes first makes no difference to the result.
    pieces = cut(rows.select("doc", F.explode(cuts).alias("p")).select("doc", "p.piece", "p.length", F.monotonically_increasing_id().alias("number")), "packing-pieces")
    order = ["length", "doc", "piece", "number"]
    ranked = pieces.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_rank, f"part int, rank long, doc {kind}, piece int, length int")
    ranked = cut(ranked, "packing-ranked")
    # As many rows as there are ranges and lengths together.
    ranges = sorted((r[0], r[1], r[2]) for r in ranked.where("length > 0").groupBy("part", "length").count().collect())
    before, counts = {}, defaultdict(int)
    for part, n, count in ranges:
        before[part, n] = counts[n]
        counts[n] += count
    shared = docs.sparkSession.sparkContext.broadcast((fit(counts, capacity), before))
    return ranked.mapInArrow(_place(shared, id_col), f"context long, start int, `{id_col}` {kind}, piece int, length int")
