"""Nearest neighbours by Euclidean distance: exact, and through an inverted file.

Distances are computed in numpy on Arrow batches; each partition returns its k best only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import matrix
from .bm25 import ranked

#: Rows from which an inverted file pays, and rows for each of its cells.
ANN_ROWS, CELL_ROWS = 65_536, 256
#: Vectors that the cells' centres are fitted on.
FIT_VECTORS = 100_000


def _typed(df: DataFrame, id_col: str) -> str:
    return dict(df.dtypes)[id_col]


def nearest(vectors: DataFrame, query: list[float], k: int, id_col: str = "chunk_id", vector_col: str = "embedding", dist: str = "dist") -> DataFrame:
    """(id, dist, rank) of the k nearest, ties by id.  Null vectors, and those of another length than the query, take no part."""
    q = np.asarray(query, np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, best = None, np.zeros(0)
        for b in batches:
            m, at = matrix(b.column(1), len(q))
            if not len(m):
                continue
            d = np.sqrt(((m - q) ** 2).sum(axis=1))
            found = b.column(0).take(pa.array(at))
            ids = found if ids is None else pa.concat_arrays([ids, found])
            best = np.concatenate((best, d))
            if len(best) > 4 * k + 1024:
                ids, best = _keep(ids, best, k)
        if ids is not None:
            ids, best = _keep(ids, best, k)
            yield pa.record_batch([ids, pa.array(best)], [id_col, dist])

    found = vectors.select(id_col, vector_col).mapInArrow(run, f"`{id_col}` {_typed(vectors, id_col)}, `{dist}` double")
    return ranked(found.orderBy(dist, id_col).limit(k), [F.col(dist), F.col(id_col)])


def _keep(ids: pa.Array, d: np.ndarray, k: int) -> tuple[pa.Array, np.ndarray]:
    """All that may be among the k nearest: ties with the k-th stay for the order by id to decide."""
    if len(d) <= k:
        return ids, d
    at = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
    return ids.take(pa.array(at)), d[at]


#: Vectors of a block, entries of a product that are held at a time, and parts that the vectors are searched in.
BLOCK, ENTRIES, PARTS = 4096, 1 << 22, 4


def nearest_each(queries: DataFrame, vectors: DataFrame, k: int, id_col: str, vector_col: str, rows: int = BLOCK) -> DataFrame:
    """(query, id, dist, rank): the k nearest of every query vector, the query's own id left out.

    Both sides are cut into blocks of at most ``rows`` vectors.  A task takes some blocks of queries, one at a time, past a part of
    the vectors' blocks: a product of two blocks, in slices of ``ENTRIES``, gives rough distances with a bound on their error, and
    only what may be nearer than the k-th found so far is measured exactly.  Neither a side nor a product of blocks is ever held whole.
    """
    kind, other = _typed(queries, id_col), _typed(vectors, id_col)

    def blocks(df: DataFrame, names: tuple[str, ...], parts: int) -> DataFrame:
        single = "float" in _typed(df, vector_col)

        def block(ids: list, m: list, n: int) -> pa.RecordBatch:
            held, flat = pa.concat_arrays(ids), np.concatenate(m).astype("<f4" if single else "<f8")
            lists = pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held)
            return pa.record_batch([pa.array([f"{TaskContext.get().partitionId()}-{n}"]), lists, pa.array([flat.shape[1]], pa.int32()), pa.array([flat.tobytes()], pa.binary())], list(names))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, held, n = [], [], 0
            for b in batches:
                m, at = matrix(b.column(1))
                found = b.column(0).take(pa.array(at))
                while len(m):
                    room = rows - sum(map(len, held))
                    if held and (not room or held[0].shape[1] != m.shape[1]):
                        yield block(ids, held, n)
                        ids, held, n = [], [], n + 1
                        continue
                    ids.append(found[:room])
                    held.append(m[:room])
                    found, m = found[room:], m[room:]
            if held:
                yield block(ids, held, n)

        cut = df.select(id_col, vector_col).mapInArrow(pack, f"{names[0]} string, {names[1]} array<{_typed(df, id_col)}>, {names[2]} int, {names[3]} binary")
        return cut.repartition(parts)

    widths = [4 if "float" in _typed(df, vector_col) else 8 for df in (queries, vectors)]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last = None, None
        for b in batches:
            for i in range(len(b)):
                if b.column(2)[i].as_py() != b.column(6)[i].as_py():
                    continue
                v = np.frombuffer(b.column(7)[i].as_buffer(), f"<f{widths[1]}").reshape(-1, b.column(6)[i].as_py())
                if (name := b.column(0)[i].as_py()) != last:
                    if own:
                        yield own.found()
                    q = np.frombuffer(b.column(3)[i].as_buffer(), f"<f{widths[0]}").reshape(-1, b.column(2)[i].as_py())
                    own, last = _Nearest(b.column(1)[i].values, q.astype(np.float64), k), name
                own.meet(b.column(5)[i].values, v.astype(np.float64))
        if own:
            yield own.found()

    spark = queries.sparkSession
    # Blocks are sent, not sides: a task reads its queries' blocks once and one part of the vectors' blocks.
    left = blocks(queries, ("q", "qi", "qd", "qv"), 2 * spark.sparkContext.defaultParallelism)
    pairs = left.crossJoin(blocks(vectors, ("v", "vi", "vd", "vv"), PARTS).hint("shuffle_replicate_nl"))
    found = pairs.mapInArrow(near, f"query {kind}, id {other}, dist double")
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("query").orderBy("dist", "id"))
    return found.withColumn("rank", place - 1).where(F.col("rank") < k)


class _Nearest:
    """The k nearest of each query of a block among the vectors met so far."""

    def __init__(self, ids: pa.Array, q: np.ndarray, k: int):
        self.ids, self.q, self.k, self.qq = ids, q, k, (q * q).sum(1)
        self.limit = np.full(len(q), np.inf)  # squared distances beyond which none is among the k nearest
        self.kept: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        self.new = 0

    def meet(self, ids: pa.Array, v: np.ndarray) -> None:
        coded = pa.concat_arrays([self.ids, ids.cast(self.ids.type)]).dictionary_encode("encode").indices.to_numpy()
        mine, theirs = coded[: len(self.q)], coded[len(self.q) :]
        most = int(np.bincount(theirs).max())
        d, vv = self.q.shape[1], (v * v).sum(1)
        # Single precision where nothing can overflow.
        single = bool(max(self.qq.max(), vv.max()) < 1e30)
        kind = np.float32 if single else np.float64
        right = np.concatenate((v, vv[:, None]), axis=1).astype(kind).T
        left = np.concatenate((-2 * self.q, np.ones((len(self.q), 1))), axis=1).astype(kind)
        # What rounding may do to a product, in either direction.
        slack = 4 * (d + 4) * (np.finfo(kind).eps * (self.qq + vv.max()) + np.finfo(kind).tiny)
        step = max(1, ENTRIES // len(v))
        for a in range(0, len(self.q), step):
            part = slice(a, a + step)
            e = left[part] @ right  # squared distances less the query's own square
            limit = self.limit[part] - self.qq[part]
            if np.isinf(limit).any():  # as many of the first as are surely not the query's own give a bound
                n = self.k + most
                few = e[:, : max(512, 4 * n)]
                if few.shape[1] >= n:
                    limit = np.fmin(limit, np.partition(few, n - 1, axis=1)[:, n - 1] + slack[part])
            top = np.nextafter((limit + slack[part]).astype(kind), kind(np.inf))[:, None]
            at = np.flatnonzero(e <= top if single else ~(e > top))
            row, col = at // len(v) + a, at % len(v)
            other = mine[row] != theirs[col]
            row, col = row[other], col[other]
            for c in range(0, len(row), 1 << 16):
                r, o = row[c : c + (1 << 16)], col[c : c + (1 << 16)]
                dist = np.sqrt(((v[o] - self.q[r]) ** 2).sum(axis=1))
                self.kept.append((r, dist, ids.take(pa.array(o))))
                self.new += len(r)
                if self.new > max(1 << 18, len(self.q) * self.k):
                    self._trim()
        if self.new > len(self.q) * self.k // 2:
            self._trim()

    def _trim(self) -> None:
        if not self.kept:
            return
        row, dist = (np.concatenate([x[j] for x in self.kept]) for j in (0, 1))
        ids = pa.concat_arrays([x[2] for x in self.kept])
        order = pc.sort_indices(pa.table({"r": row, "d": dist, "i": ids}), [("r", "ascending"), ("d", "ascending"), ("i", "ascending")], null_placement="at_start").to_numpy()
        sorted_ = row[order]
        starts = np.flatnonzero(np.diff(sorted_, prepend=-1))
        place = np.arange(len(sorted_)) - np.repeat(starts, np.diff(starts, append=len(sorted_)))
        order, place = order[place < self.k], place[place < self.k]
        row, dist, ids = row[order], dist[order], ids.take(pa.array(order))
        full = place == self.k - 1
        self.limit[row[full]] = dist[full] ** 2 * (1 + 1e-12)
        self.kept, self.new = [(row, dist, ids)], 0

    def found(self) -> pa.RecordBatch:
        self._trim()
        row, dist, ids = self.kept[0] if self.kept else (np.zeros(0, np.int64), np.zeros(0), self.ids[:0])
        return pa.record_batch([self.ids.take(pa.array(row)), ids, pa.array(dist)], ["query", "id", "dist"])


# ------------------------------------------------------------------ inverted file


def cells_for(rows: int) -> int:
    return max(1, rows // CELL_ROWS)


def fit_cells(vectors: DataFrame, cells: int, vector_col: str = "embedding", sample: int = FIT_VECTORS, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Cell centres by Lloyd's algorithm on at most ``sample`` vectors, picked by a hash of their values."""
    picked = vectors.select(vector_col).where(F.col(vector_col).isNotNull()).orderBy(F.xxhash64(vector_col)).limit(sample)
    m, _ = matrix(picked.toArrow().column(0))
    rng = np.random.default_rng(seed)
    cells = min(cells, len(m))
    centres = m[rng.choice(len(m), cells, replace=False)]
    for _ in range(rounds):
        own = _cell(m, centres)
        count = np.bincount(own, minlength=cells)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, m)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def _cell(m: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([((centres * centres).sum(1) - 2 * m[a : a + 8192] @ centres.T).argmin(1) for a in range(0, len(m), 8192)]) if len(m) else np.zeros(0, np.int64)


def assign_cells(vectors: DataFrame, centres: np.ndarray, id_col: str = "chunk_id", vector_col: str = "embedding") -> DataFrame:
    """(id, vector, cell): to be written partitioned by ``cell``, so that a search opens the probed cells only."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)  # cells times dimensions numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m, at = matrix(b.column(1), shared.value.shape[1])
            if len(m):
                kept = b.take(pa.array(at))
                yield pa.record_batch([*kept.columns, pa.array(_cell(m, shared.value).astype(np.int32))], [id_col, vector_col, "cell"])

    return vectors.select(id_col, vector_col).mapInArrow(run, f"`{id_col}` {_typed(vectors, id_col)}, `{vector_col}` {_typed(vectors, vector_col)}, cell int")


def probe(assigned: DataFrame, centres: np.ndarray, query: list[float], k: int, probes: int = 8, id_col: str = "chunk_id", vector_col: str = "embedding") -> DataFrame:
    """``nearest`` within the cells whose centres are nearest to the query."""
    d = ((centres - np.asarray(query)) ** 2).sum(axis=1)
    cells = np.argsort(d, kind="stable")[:probes].tolist()
    return nearest(assigned.where(F.col("cell").isin(*cells)), query, k, id_col, vector_col)


def cell_radii(assigned: DataFrame, centres: np.ndarray, vector_col: str = "embedding") -> np.ndarray:
    """The distance of each cell's farthest vector from its centre, -1 of an empty cell."""
    shared = assigned.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far = np.full(len(shared.value), -1.0)
        for b in batches:
            m, at = matrix(b.column(0), shared.value.shape[1])
            own = b.column(1).to_numpy()[at]
            np.maximum.at(far, own, np.sqrt(((m - shared.value[own]) ** 2).sum(axis=1)))
        held = np.flatnonzero(far >= 0)
        yield pa.record_batch([pa.array(held.astype(np.int32)), pa.array(far[held])], ["cell", "radius"])

    far = np.full(len(centres), -1.0)
    for r in assigned.select(vector_col, "cell").mapInArrow(run, "cell int, radius double").groupBy("cell").agg(F.max("radius").alias("radius")).collect():  # a row for each cell
        far[r["cell"]] = r["radius"]
    return far


def nearest_in_cells(assigned: DataFrame, centres: np.ndarray, radii: np.ndarray, query: list[float], k: int, probes: int = 8, id_col: str = "chunk_id", vector_col: str = "embedding") -> DataFrame:
    """``nearest``, exactly, opening only cells that may hold one of the k.

    ``probes`` cells give a k-th distance; a cell is passed over if its centre is farther than that by more
    than its radius.  Where the cells overlap too much for that, all are read.
    """
    first = [r["dist"] for r in probe(assigned, centres, query, k, probes, id_col, vector_col).collect()]
    limit = max(first) if len(first) == k else np.inf
    d = np.sqrt(((centres - np.asarray(query)) ** 2).sum(axis=1))
    cells = np.flatnonzero((radii >= 0) & (d - radii <= limit + 1e-9 * (1 + d + radii)))
    if len(cells) < np.count_nonzero(radii >= 0):
        held = assigned.sparkSession.createDataFrame(pa.table({"cell": pa.array(cells.astype(np.int32))}))
        assigned = assigned.join(F.broadcast(held), "cell", "left_semi")
    return nearest(assigned, query, k, id_col, vector_col)
