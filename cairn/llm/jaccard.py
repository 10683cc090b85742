"""N-gram Jaccard join: texts whose word n-gram sets are alike, by signature trees.

A text's words are its runs of letters and digits, lower-cased; its set holds the hashes of its
word 3-grams, of a shorter text the one hash of all its words.  Two texts are linked when their sets'
Jaccard coefficient is at least ``THRESHOLD``: one word in ten edited leaves about 0.57.

*Equal sets.*  Texts with equal sets are one node, named by its smallest id, before anything is
compared; copies, however many, cost one partial aggregate.

*Forest.*  Each of ``TREES`` directories sends a node to the tree named by its smallest n-gram
under that directory's own hash.  Two nodes of coefficient J meet in at least one with probability
1 - (1 - J)**TREES: 0.998 at 0.5, more above.  Nodes that may be linked in a tree are joined to blocks.

*Rest.*  What the directories miss is found by prefixes, which miss nothing: the n-grams of all texts have one
order, rare ones first, and sets of x and y n-grams with coefficient t share t / (1 + t) * (x + y) of them, so the first
one they share has as many behind it, itself included, in both, the second one less, and so on.  Nodes of different blocks that share ``SHARED``
such n-grams (fewer only where a link needs fewer) are compared; their links join blocks.  One such n-gram is shared by many texts by
chance, and more of them the more texts there are.  The order is fitted on about ``SAMPLE`` texts; another order costs time, but no link.

*Tree.*  Each block is then one tree, and every link lies in one block.  A leaf entry has a bitmap of the text's n-grams (two to four bits for each) and its size.
A tree node holds the OR of its children's bitmaps, their sizes' range and their largest collision count
(n-grams less bits set).  The dual traversal begins with (root, root) and descends into pairs of
nodes that may still hold a qualifying pair: common bits plus the smaller collision count bound
every overlap below, and the overlap needed follows from the smallest sizes.  Bitmaps of
different widths are compared after the wider one is folded.  Pairs come in stretches of bounded length.

*Large trees.*  A tree of more than ``SPLIT`` entries, or ``CELL_GRAMS`` n-grams, is cut into cells: by size class (linked sizes
differ by less than the factor 1 / threshold, so only neighbouring classes meet) and within a class by hash.
Every pair of cells that can hold a link is traversed by a task of its own, so that no task ever holds
more than two cells.

*Proof.*  Entries that survive on both sides are compared by their sets where they are.  Each cell pair yields links
counted for each node, and which nodes hang together: rows in proportion to its entries, not to its links.

*Memory.*  What is used more than once is kept by the executors (``_kept``), not written as files: on a local file system
without Hadoop's native library every file has the executor start two processes, each of which counts as large as the
executor until it has become ``chmod``.

Defined results: null and empty texts, and those without a letter or digit, are linked to nothing.  Rows with a null
id have no class and no links.  Of an id that is repeated with different texts the set that is first in hash order
counts.  Ids may be numbers or strings.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import rolling as R
from .common import texts

GRAM, THRESHOLD, TREES, FANOUT = 3, 0.5, 9, 8
SLICE_CHARS = 1 << 20
#: Trees with more entries are cut into cells of about so many.
SPLIT = 4096
#: Up to so many rows a table that only steers others is broadcast (16 to 40 bytes a row); a larger one is joined.
BROADCAST_ROWS = 1 << 20
PAIR_WORDS = 1 << 21
#: Pairs of tree nodes that are opened at once.
STRETCH = 1 << 13
#: Cells of blocks hold their texts' sets; one of more n-grams is cut as well.
CELL_GRAMS = 1 << 21
#: The order of n-grams is fitted on about so many texts, in so many counters.
SAMPLE, COUNTERS = 1 << 15, 1 << 22
#: Counters in a row of their sums.
CHUNK = 1 << 16
#: Spark's setting that a query's shuffle files are removed when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: So many n-grams, or as many as a link needs, have to be shared by what is compared beside the directories.
SHARED = 4
#: Postings that a task sorts at once, about; and that are gathered before they are sent.
POSTINGS, FLUSH = 1 << 18, 1 << 18


def gram_sets(values: list[str], gram: int = GRAM) -> list[np.ndarray]:
    """The sorted set of n-gram hashes of each text."""
    parts = [R.codes(v.lower() + "\n") for v in values]
    bounds = np.cumsum([0, *map(len, parts)])
    c = np.concatenate(parts)
    starts, ends = R.spans(R.is_alnum(c))
    words = R.span_hashes(c, starts, ends)
    grams = R.gram_hashes(words, gram)
    at = np.searchsorted(starts, bounds)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        own = grams[a : b - gram + 1] if b - a >= gram else R.gram_hashes(words[a:b], b - a) if b > a else grams[:0]
        own = np.sort(own)
        out.append(own[np.concatenate(([True], own[1:] != own[:-1]))] if len(own) > 1 else own)
    return out


def bitmap(own: np.ndarray) -> np.ndarray:
    """Two to four bits for each n-gram, 64 at least, as 64-bit words."""
    width = max(64, 1 << (2 * len(own) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[(own & R.U(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(R.U)


def _digest(own: np.ndarray, seed: int) -> int:
    return int(R.mix(own, seed).sum()) - (1 << 63)


def keys(own: np.ndarray, trees: int) -> np.ndarray:
    """The smallest n-gram under each directory's hash."""
    return np.array([R.mix(own, 1000 + t).min() for t in range(trees)], R.U).view(np.int64)


def fold(bits: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps, one a row, brought down to ``width`` words."""
    while bits.shape[1] > width:
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return bits


class Tree:
    """Levels from the entries up to the root; a node's children are FANOUT neighbours below it."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray):
        lost = sizes - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.levels = [(bits, sizes, sizes, lost)]
        while len(self.levels[-1][0]) > 1:
            b, low, high, lost = self.levels[-1]
            cuts = np.arange(0, len(b), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(b, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts), np.maximum.reduceat(lost, cuts)))


def _possible(a: tuple, b: tuple, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of nodes may hold a qualifying pair of entries."""
    (bits_a, low_a, high_a, lost_a), (bits_b, low_b, high_b, lost_b) = a, b
    ok = (high_a[i] >= threshold * low_b[j]) & (high_b[j] >= threshold * low_a[i])
    at = np.flatnonzero(ok)
    need = threshold / (1 + threshold) * (low_a[i[at]] + low_b[j[at]]) - 1e-9
    lost = np.minimum(lost_a[i[at]], lost_b[j[at]])
    step = max(1, PAIR_WORDS // bits_a.shape[1])
    for k in range(0, len(at), step):
        p = at[k : k + step]
        common = np.bitwise_count(bits_a[i[p]] & bits_b[j[p]]).sum(axis=1, dtype=np.int64)
        ok[p] = common + lost[k : k + step] >= need[k : k + step]
    return ok


def walk(a: Tree, b: Tree, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of entries that survive, in stretches; within one tree each pair once, the earlier entry first."""
    same, depth = a is b, max(len(a.levels), len(b.levels))
    last_a, last_b = len(a.levels) - 1, len(b.levels) - 1
    if same and depth == 1:
        return
    root = np.zeros(1, np.int64)
    i, j = (x[_possible(a.levels[last_a], b.levels[last_b], root, root, threshold)] for x in (root, root))
    waiting = [(depth - 1, i, j)]
    grid = np.arange(FANOUT)
    while waiting:
        level, i, j = waiting.pop()
        if not len(i):
            continue
        if not level:
            yield i, j
            continue
        if len(i) > STRETCH:
            waiting.append((level, i[STRETCH:], j[STRETCH:]))
            i, j = i[:STRETCH], j[:STRETCH]
        level -= 1  # the children of these pairs
        at_a, at_b = min(level, last_a), min(level, last_b)
        di, dj = (x.ravel() for x in np.meshgrid(grid if at_a < last_a else grid[:1], grid if at_b < last_b else grid[:1], indexing="ij"))
        i = ((i * FANOUT if at_a < last_a else i)[:, None] + di).ravel()
        j = ((j * FANOUT if at_b < last_b else j)[:, None] + dj).ravel()
        ok = (i < len(a.levels[at_a][0])) & (j < len(b.levels[at_b][0]))
        if same:
            ok &= i <= j if level else i < j
        i, j = i[ok], j[ok]
        ok = _possible(a.levels[at_a], b.levels[at_b], i, j, threshold)
        waiting.append((level, i[ok], j[ok]))


def _joined(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    parts = [(np.zeros(0, np.int64),) * 2, *found]
    return np.concatenate([i for i, _ in parts]), np.concatenate([j for _, j in parts])


def candidates(bits: list[np.ndarray], sizes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Surviving pairs among one tree's texts, as positions."""
    return _joined(within(bits, sizes, threshold))


def within(bits: list[np.ndarray], sizes: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Surviving pairs among one tree's texts, as positions, in stretches."""
    width = np.array([len(b) for b in bits])
    classes = np.unique(width)
    members, native = {}, {}
    for w in classes.tolist():
        at = np.flatnonzero(width == w)
        at = at[np.argsort(sizes[at], kind="stable")]
        members[w], native[w] = at, Tree(np.stack([bits[k] for k in at]), sizes[at])
        yield from ((at[i], at[j]) for i, j in walk(native[w], native[w], threshold))
    for n, w in enumerate(classes.tolist()):
        for wide in classes[n + 1 :].tolist():
            low, high = members[w], members[wide]
            if sizes[low].max() < threshold * sizes[high].min():
                break  # wider ones are longer still
            near = high[sizes[high] * threshold <= sizes[low].max()]
            other = Tree(fold(np.stack([bits[k] for k in near]), w), sizes[near])
            yield from ((low[i], near[j]) for i, j in walk(native[w], other, threshold))


def between(bits_a: list[np.ndarray], sizes_a: np.ndarray, bits_b: list[np.ndarray], sizes_b: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Surviving pairs of an entry of one list and one of the other, as positions in them, in stretches."""
    width_a, width_b = (np.array([len(b) for b in bits]) for bits in (bits_a, bits_b))
    for w in np.unique(width_a).tolist():
        at = np.flatnonzero(width_a == w)
        at = at[np.argsort(sizes_a[at], kind="stable")]
        for v in np.unique(width_b).tolist():
            on = np.flatnonzero(width_b == v)
            on = on[np.argsort(sizes_b[on], kind="stable")]
            if sizes_a[at[-1]] < threshold * sizes_b[on[0]] or sizes_b[on[-1]] < threshold * sizes_a[at[0]]:
                continue
            least = min(w, v)
            one, other = (Tree(fold(np.stack([bits[k] for k in of]), least), sizes[of]) for bits, sizes, of in ((bits_a, sizes_a, at), (bits_b, sizes_b, on)))
            yield from ((at[i], on[j]) for i, j in walk(one, other, threshold))


class Joined:
    """Which of ``n`` entries hang together: each has the label of the first one it is joined to."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.label[i], self.label[j]
            open_ = a != b
            if not open_.any():
                return
            a, b = a[open_], b[open_]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while (self.label[self.label] != self.label).any():
                self.label = self.label[self.label]


class Overlaps:
    """Exact sizes of intersections among sets."""

    def __init__(self, own: list[np.ndarray]):
        sizes = np.array([len(x) for x in own])
        grams = np.concatenate(own)
        order = np.argsort(grams)
        grams = grams[order]
        again = grams[1:] == grams[:-1]
        del grams
        shared = np.concatenate(([False], again)) | np.concatenate((again, [False]))  # others are in no intersection
        order = order[shared]
        number = np.cumsum(~np.concatenate(([False], again))[shared], dtype=np.int32) - 1
        self.width = int(number[-1]) + 1 if len(number) else 0
        column = np.full(int(sizes.sum()), -1, np.int32)
        column[order] = number
        del order, number, again, shared
        row = np.repeat(np.arange(len(own), dtype=np.int32), sizes)[column >= 0]
        column = column[column >= 0]
        words = -(-self.width // 64)
        self.bits = None
        if words <= 8 * sizes.mean() and len(own) * words <= 1 << 23:
            self.bits = np.zeros((len(own), 8 * words), np.uint8)
            np.bitwise_or.at(self.bits, (row, column >> 3), (1 << (column & 7)).astype(np.uint8))
            self.bits = self.bits.view(R.U)
        else:
            self.rows = np.split(column, np.searchsorted(row, np.arange(1, len(own))))

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        if not self.width:
            return out
        if self.bits is not None:
            step = max(1, PAIR_WORDS // self.bits.shape[1])
            for k in range(0, len(i), step):
                p = slice(k, k + step)
                out[p] = np.bitwise_count(self.bits[i[p]] & self.bits[j[p]]).sum(axis=1, dtype=np.int64)
            return out
        order = np.argsort(i, kind="stable")
        mask = np.zeros(self.width, bool)
        for of in np.split(order, np.flatnonzero(np.diff(i[order])) + 1):
            if len(of):
                mask[self.rows[i[of[0]]]] = True
                out[of] = [np.count_nonzero(mask[self.rows[k]]) for k in j[of].tolist()]
                mask[self.rows[i[of[0]]]] = False
        return out


def _fleeting(df: DataFrame) -> DataFrame:
    """``df``, whose shuffle files go when an action on it ends, not when the driver happens to collect its garbage."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return df.select("*")  # a plan takes the setting when it is made
    finally:
        if before is None:
            conf.unset(CLEANUP)
        else:
            conf.set(CLEANUP, before)


def _kept(df: DataFrame) -> DataFrame:
    """``df`` computed and kept on the disks of two executors, without lineage: losing one of them costs no recomputation."""
    return _fleeting(df).localCheckpoint(True, StorageLevel.DISK_ONLY_2)


def _pieces(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Pieces of about ``SLICE_CHARS`` bytes of column ``text``, and their texts; a whole batch's strings are never held at once."""
    for batch in batches:
        for a, b in _runs(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist(), SLICE_CHARS):
            piece = batch.slice(a, b - a)
            yield piece, texts(piece.column(text))


def _sketches(docs: DataFrame, id_col: str, text_col: str, gram: int, trees: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, values in _pieces(batches, 1):
            rows = [(i, own) for i, own in zip(piece.column(0).to_pylist(), gram_sets(values, gram)) if len(own)]
            yield pa.record_batch(
                [
                    pa.array([i for i, _ in rows], piece.column(0).type),
                    pa.array([len(own) for _, own in rows], pa.int32()),
                    pa.array([_digest(own, 7) for _, own in rows], pa.int64()),
                    pa.array([_digest(own, 8) for _, own in rows], pa.int64()),
                    pa.array([keys(own, trees) for _, own in rows], pa.list_(pa.int64())),
                    pa.array([bitmap(own).tobytes() for _, own in rows], pa.binary()),
                ],
                ["id", "n", "h1", "h2", "keys", "bits"],
            )

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).where(F.col(id_col).isNotNull()).mapInArrow(run, f"id {kind}, n int, h1 long, h2 long, keys array<long>, bits binary")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Runs of rows with the same tree, key and cells, in sorted partitions, across batches.

    Runs of one row, most of them, are passed over without being turned into Python objects.
    """
    held: list[pa.RecordBatch] = []
    last = None

    def emit() -> list[dict]:
        rows = [r for b in held for r in b.to_pylist()]
        held.clear()  # the batches go before the rows are worked on
        return rows

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in ("tree", "key", "cell", "other")]
        cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        bounds = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(bounds[:-1], bounds[1:]):
            name = tuple(c[a] for c in columns)
            if name != last and held:
                if sum(x.num_rows for x in held) > 1:
                    yield emit()
                held = []
            last = name
            if b - a > 1 or held or b == batch.num_rows:
                held.append(batch.slice(a, b - a))
    if sum(x.num_rows for x in held) > 1:
        yield emit()


def _pairs(rows: list[dict], bits: list[np.ndarray], sizes: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The surviving pairs of a tree, or of two cells of a large one, as positions in ``rows``."""
    if rows[0]["cell"] == rows[0]["other"]:
        yield from within(bits, sizes, threshold)
        return
    side = np.array([r["side"] for r in rows])  # each against the other only
    here, there = np.flatnonzero(side == 0), np.flatnonzero(side)
    if len(here) and len(there):
        for i, j in between([bits[k] for k in here], sizes[here], [bits[k] for k in there], sizes[there], threshold):
            yield here[i], there[j]


def _table(out: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[k] for r in out], schema.types[k]) for k in range(len(schema))], schema.names)


def _search(threshold: float, kind: pa.DataType):
    """Which entries of each tree may be linked: rows (entry, first entry that it hangs together with)."""
    schema = pa.schema([("doc_a", kind), ("doc_b", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for rows in _groups(batches):
            joined = Joined(len(rows))
            for i, j in _pairs(rows, [np.frombuffer(r["bits"], R.U) for r in rows], np.array([r["n"] for r in rows], np.int64), threshold):
                joined.add(i, j)
            out += ((rows[k]["id"], rows[x]["id"]) for k, x in enumerate(joined.label.tolist()) if k != x)
            if len(out) > 50_000:
                yield _table(out, schema)
                out = []
        if out:
            yield _table(out, schema)

    return run


def _cells(reps: DataFrame, threshold: float, split: int, broadcast_rows: int, cell_grams: int | None = None, carried: tuple[str, ...] = ("id", "n", "bits")) -> DataFrame:
    """``reps`` once for each directory and pair of cells they take part in: tree, key, cell, other, side and the entry.

    A tree that isn't split is cell 0 against itself.  A cell's number holds its size class and its part of that class.
    """
    # A shade less than one class for the factor 1 / threshold, so that rounding can't put two classes between linked sizes.
    grade = F.floor(F.log("n") * F.lit((1 - 1e-9) / -math.log(min(threshold, 0.99)))).cast("int")
    many = reps.select(F.posexplode("keys").alias("tree", "key"), grade.alias("grade"), "n").groupBy("tree", "key", "grade").agg((F.count("*") / split).alias("count"), (F.sum("n") / (cell_grams or math.inf)).alias("grams"))
    parts = F.greatest(F.ceil(F.greatest("count", "grams")), F.lit(1)).cast("int")
    large = many.groupBy("tree", "key").agg(F.greatest(F.sum("count"), F.sum("grams")).alias("all"), F.map_from_entries(F.collect_list(F.struct("grade", parts.alias("parts")))).alias("parts"))
    large = _kept(large.where(F.col("all") > 1).select("tree", "key", "parts"))
    routed = reps.select(F.posexplode("keys").alias("tree", "key"), "id", *(c for c in carried if c != "id"), *(() if "n" in carried else ("n",)), grade.alias("grade"))
    zero = F.lit(0).cast("long")
    plain = [zero.alias("cell"), zero.alias("other"), F.lit(0).alias("side")]
    count = large.count()
    if not count:
        return routed.select("tree", "key", *plain, *carried)
    # Most keys are in no large tree: the table of those that are is small beside the entries.
    routed = routed.join(F.broadcast(large) if count <= broadcast_rows else large, ["tree", "key"], "left")
    own = F.pmod(F.xxhash64("id", F.lit(5)), F.element_at("parts", F.col("grade"))).cast("int")
    number = lambda g, p: f"shiftleft(cast({g} as long), 32) + {p}"
    meet = f"""concat(
        transform(sequence(own, parts[grade] - 1), p -> struct({number('grade', 'own')} as cell, {number('grade', 'p')} as other, 0 as side)),
        if(own = 0, array(), transform(sequence(0, own - 1), p -> struct({number('grade', 'p')} as cell, {number('grade', 'own')} as other, 1 as side))),
        if(map_contains_key(parts, grade + 1), transform(sequence(0, parts[grade + 1] - 1), p -> struct({number('grade', 'own')} as cell, {number('grade + 1', 'p')} as other, 0 as side)), array()),
        if(map_contains_key(parts, grade - 1), transform(sequence(0, parts[grade - 1] - 1), p -> struct({number('grade - 1', 'p')} as cell, {number('grade', 'own')} as other, 1 as side)), array()))"""
    whole = F.array(F.struct(*plain))
    routed = routed.withColumn("own", own).withColumn("meet", F.when(F.col("parts").isNull(), whole).otherwise(F.expr(meet)))
    return routed.select("tree", "key", F.explode("meet").alias("at"), *carried).select("tree", "key", "at.*", *carried)


_PLACE = ("tree", "key", "cell", "other")
_PLACED = pa.schema([("tree", pa.int32()), ("key", pa.int64()), ("cell", pa.int64()), ("other", pa.int64()), ("side", pa.int32()), ("copies", pa.int64())])


def _sets(docs: DataFrame, id_col: str, text_col: str, gram: int, kind: str, wanted=None) -> DataFrame:
    """(tree, key, cell, other, side, copies, a, h1, grams) of texts at their places; ``wanted``: their ids and places, broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def hits() -> Iterator[pa.RecordBatch]:
            ids = wanted.value[0]
            for batch in batches:
                own = batch.column(0).to_numpy(zero_copy_only=False)
                yield batch.filter(pa.array(ids[np.minimum(np.searchsorted(ids, own), len(ids) - 1)] == own))

        for piece, values in _pieces(batches if wanted is None else hits(), 1):
            if wanted is not None:
                ids, offsets, flat = wanted.value
                at = np.searchsorted(ids, piece.column(0).to_numpy(zero_copy_only=False))
                places = [flat.slice(offsets[k], offsets[k + 1] - offsets[k]).to_pylist() for k in at.tolist()]
            else:
                places = piece.column(2).to_pylist()
            rows = [(p, i, _digest(own, 7), own.tobytes()) for i, of, own in zip(piece.column(0).to_pylist(), places, gram_sets(values, gram)) if len(own) for p in of]
            # A text at many places is sent to each: in batches of bounded size.
            for x, y in _runs([len(r[3]) for r in rows], 8 * SLICE_CHARS):
                yield pa.record_batch(
                    [*(pa.array([r[0][f.name] for r in rows[x:y]], f.type) for f in _PLACED), *(pa.array([r[k] for r in rows[x:y]], t) for k, t in ((1, piece.column(0).type), (2, pa.int64()), (3, pa.binary())))],
                    [*_PLACED.names, "a", "h1", "grams"],
                )

    return docs.mapInArrow(run, f"tree int, key long, cell long, other long, side int, copies long, a {kind}, h1 long, grams binary")


def _runs(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    start = total = 0
    for k, n in enumerate(sizes):
        total += n
        if total >= most:
            yield start, k + 1
            start, total = k + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def _placed_sets(docs: DataFrame, places: DataFrame, id_col: str, text_col: str, gram: int, broadcast_rows: int) -> DataFrame | None:
    """Sets at ``places`` (id and the columns of ``_PLACED``), each place's rows together and sorted by id; None where there are no places."""
    kind = dict(docs.dtypes)[id_col]
    wanted = _kept(places.groupBy("id").agg(F.collect_list(F.struct(*_PLACED.names)).alias("places")))
    size = wanted.agg(F.coalesce(F.sum(F.size("places")), F.lit(0))).first()[0]
    if not size:
        return None
    source = docs.select(id_col, text_col).where(F.col(id_col).isNotNull())
    if size <= broadcast_rows:
        got = wanted.toArrow().sort_by("id").combine_chunks()
        at = got.column("places").chunk(0)
        sets = _sets(source, id_col, text_col, gram, kind, docs.sparkSession.sparkContext.broadcast((got.column("id").chunk(0).to_numpy(zero_copy_only=False), at.offsets.to_numpy(), at.values)))
    else:
        sets = _sets(source.join(wanted.withColumnRenamed("id", id_col), id_col).select(id_col, text_col, "places"), id_col, text_col, gram, kind)
    return sets.repartition(*_PLACE).sortWithinPartitions(*_PLACE, "a", "h1")


def _prove(threshold: float, kind: pa.DataType, pairs: bool):
    """The links at each place, by the sets: (doc_a, doc_b, jaccard) of each, or for each entry that has one the first entry it hangs together with, and how many texts it is linked to."""
    schema = pa.schema([("doc_a", kind), ("doc_b", kind), ("jaccard", pa.float64()) if pairs else ("links", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for rows in _groups(batches):
            rows = [r for k, r in enumerate(rows) if not k or r["a"] != rows[k - 1]["a"]]  # of a repeated id its first set
            own = [np.frombuffer(r["grams"], R.U) for r in rows]
            n, copies = np.array([len(x) for x in own], np.int64), np.array([r["copies"] for r in rows], np.int64)
            overlaps, joined, links = None, Joined(len(rows)), np.zeros(len(rows), np.int64)
            for i, j in _pairs(rows, [bitmap(x) for x in own], n, threshold):
                overlaps = overlaps or Overlaps(own)
                common = overlaps.of(i, j)
                alike = common / (n[i] + n[j] - common)
                ok = alike >= threshold
                i, j = i[ok], j[ok]
                if pairs:
                    for p, q, x in zip(i.tolist(), j.tolist(), alike[ok].tolist()):
                        out.append((min(rows[p]["a"], rows[q]["a"]), max(rows[p]["a"], rows[q]["a"]), x))
                        if len(out) > 50_000:
                            yield _table(out, schema)
                            out = []
                else:
                    joined.add(i, j)
                    np.add.at(links, i, copies[j])
                    np.add.at(links, j, copies[i])
            if not pairs:
                out += ((rows[k]["a"], rows[joined.label[k]]["a"], int(links[k])) for k in np.flatnonzero(links).tolist())
            if len(out) > 50_000:
                yield _table(out, schema)
                out = []
        if out:
            yield _table(out, schema)

    return run


def _levels(docs: DataFrame, id_col: str, text_col: str, gram: int, count: int) -> np.ndarray:
    """How often n-grams of each of ``COUNTERS`` hash values are in about ``SAMPLE`` of ``count`` texts, up to 255.

    The texts are counted where they are; counters are added up by the executors, so the driver gets each of them once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for _, values in _pieces(batches, 0):
            at, times = np.unique((np.concatenate(gram_sets(values, gram)) >> R.U(42)).astype(np.int64), return_counts=True)
            total[at] += times
        for chunk, own in enumerate(total.reshape(-1, CHUNK)):
            at = np.flatnonzero(own)
            if len(at):
                yield pa.record_batch([pa.array([chunk], pa.int32()), pa.array([at.astype(np.uint16).tobytes()], pa.binary()), pa.array([np.minimum(own[at], 255).astype(np.uint8).tobytes()], pa.binary())], ["chunk", "at", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for r in batch.to_pylist():
                sums.setdefault(r["chunk"], np.zeros(CHUNK, np.int64))[np.frombuffer(r["at"], np.uint16)] += np.frombuffer(r["counts"], np.uint8)
        for chunk, own in sums.items():
            yield pa.record_batch([pa.array([chunk], pa.int32()), pa.array([np.minimum(own, 255).astype(np.uint8).tobytes()], pa.binary())], ["chunk", "counts"])

    some = docs.where(F.col(id_col).isNotNull() & (F.pmod(F.xxhash64(id_col), F.lit(max(1, count // SAMPLE))) == 0)).select(text_col)
    sums = some.mapInArrow(run, "chunk int, at binary, counts binary").repartition(min(8, 1 + count // 1024), "chunk").mapInArrow(add, "chunk int, counts binary")
    levels = np.zeros((COUNTERS // CHUNK, CHUNK), np.uint8)
    for r in _fleeting(sums).collect():
        levels[r["chunk"]] = np.frombuffer(r["counts"], np.uint8)
    return levels.ravel()


_POSTING = (("k", np.uint32), ("rest", np.uint16), ("n", np.uint32), ("node", np.int64), ("block", np.int64))


def _postings(levels, gram: int, threshold: float, parts: int, shared: int):
    """Of (block, text): the n-grams that may be among the first ``shared`` ones of a link, each with how many of the set are from it on."""
    fields = [("part", pa.int32()), *((name, pa.binary()) for name, _ in _POSTING)]

    def send(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        g, *columns = (np.concatenate(c) for c in zip(*held))
        part = ((g >> R.U(32)) % R.U(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        bounds = np.searchsorted(part[order], np.arange(parts + 1))
        columns = [c[order] for c in (g.astype(np.uint32), *columns)]
        some = [p for p in range(parts) if bounds[p] < bounds[p + 1]]
        return pa.record_batch([pa.array(some, pa.int32()), *(pa.array([c[bounds[p] : bounds[p + 1]].tobytes() for p in some], pa.binary()) for c in columns)], [name for name, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for piece, values in _pieces(batches, 1):
            for block, own in zip(piece.column(0).to_pylist(), gram_sets(values, gram)):
                n = len(own)
                if not n:
                    continue
                # Sets are sorted by hash: a stable sort by level gives the order that all texts have.
                first = np.argsort(levels.value[(own >> R.U(42)).astype(np.int64)], kind="stable")[: n - math.ceil(threshold * n - 1e-9) + shared]
                node = _digest(own, 7)
                held.append((own[first], np.minimum(n - np.arange(len(first)), 0xFFFF).astype(np.uint16), np.full(len(first), n, np.uint32), np.full(len(first), node), np.full(len(first), node if block is None else block)))
                total += len(first)
                if total >= FLUSH:
                    yield send(held)
                    held, total = [], 0
        if held:
            yield send(held)

    return run


def _meetings(threshold: float, shared: int):
    """(x, y, need, times): nodes of different blocks, how many n-grams with enough of both sets from them on they have to share, and how many of these were seen; a pair may come more than once."""

    def pairs(k: np.ndarray, rest: np.ndarray, n: np.ndarray, node: np.ndarray, block: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        order = np.lexsort((rest, node, block, k))
        # Copies send the same postings: each counts once.  An n-gram's place tells it from others of the text, up to the largest number.
        again = np.logical_and.reduce([c[order[1:]] == c[order[:-1]] for c in (k, node, rest)]) & (rest[order[1:]] < 0xFFFF)
        order = order[np.concatenate(([True], ~again))]
        k, block = k[order], block[order]
        new = np.concatenate(([True], k[1:] != k[:-1]))
        start = np.flatnonzero(new)
        end = np.concatenate((start[1:], [len(k)]))[np.cumsum(new) - 1]
        run = np.concatenate(([True], new[1:] | (block[1:] != block[:-1])))
        after = np.concatenate((np.flatnonzero(run)[1:], [len(k)]))[np.cumsum(run) - 1]
        count = end - after  # of other blocks, behind its own
        some = np.flatnonzero(count)
        sums = np.cumsum(count[some])
        rest = rest[order].astype(np.int64)
        rest[rest == 0xFFFF] = np.iinfo(np.int64).max
        n, node = n[order].astype(np.int64), node[order]
        at = 0
        while at < len(some):
            to = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + (1 << 18), side="right")))
            for low in range(0, int(count[some[at]]) if to == at + 1 else 1, 1 << 18):
                x = some[at:to]
                c = np.minimum(count[x] - low, 1 << 18) if to == at + 1 else count[x]
                i = np.repeat(x, c)
                j = np.repeat(after[x] + low - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))
                need = np.ceil(threshold / (1 + threshold) * (n[i] + n[j]) - 1e-9).astype(np.int64)
                ok = np.minimum(rest[i], rest[j]) >= need - (shared - 1)
                i, j, need = node[i[ok]], node[j[ok]], np.minimum(need[ok], shared)
                if len(i):
                    yield np.unique(np.stack([np.minimum(i, j), np.maximum(i, j), need]), axis=1, return_counts=True)
            at = to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        last = None

        def emit() -> Iterator[pa.RecordBatch]:
            columns = [list(c) for c in zip(*held)]
            held.clear()
            k = np.concatenate(columns[0])
            order = np.argsort(k)
            again = k[order[1:]] == k[order[:-1]]
            # Most n-grams are in one text: only the others are looked at.
            some = order[np.concatenate(([False], again)) | np.concatenate((again, [False]))]
            del order, again
            for c, column in enumerate(columns):
                columns[c] = (k if not c else np.concatenate(column))[some]
            if len(some):
                for (x, y, need), times in pairs(*columns):
                    yield pa.record_batch([pa.array(x), pa.array(y), pa.array(need), pa.array(times)], ["x", "y", "need", "times"])

        for batch in batches:
            for r in range(batch.num_rows):
                if (part := batch.column(0)[r].as_py()) != last and held:
                    yield from emit()
                last = part
                held.append(tuple(np.frombuffer(batch.column(1 + c)[r].as_buffer(), t).copy() for c, (_, t) in enumerate(_POSTING)))
        if held:
            yield from emit()

    return run


def _met(docs: DataFrame, blocks: DataFrame, count: int, grams: int, id_col: str, text_col: str, gram: int, threshold: float, broadcast_rows: int, shared: int) -> DataFrame:
    """(x, y): the digests of nodes of different blocks that share as many of their first n-grams as links do."""
    levels = docs.sparkSession.sparkContext.broadcast(_levels(docs, id_col, text_col, gram, count))
    parts = max(1, math.ceil((grams * (1 - threshold) + count * shared) / POSTINGS))
    many = blocks.count()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null")
    source = source.join(F.broadcast(blocks) if many <= broadcast_rows else blocks, "id", "left").select("block", "text")
    binaries = ", ".join(f"{name} binary" for name, _ in _POSTING)
    sent = source.mapInArrow(_postings(levels, gram, threshold, parts, shared), f"part int, {binaries}")
    met = sent.repartition(min(parts, 4096), "part").sortWithinPartitions("part").mapInArrow(_meetings(threshold, shared), "x long, y long, need long, times long")
    return met.groupBy("x", "y", "need").agg(F.sum("times").alias("times")).where("times >= need").select("x", "y")


def _rest(docs: DataFrame, reps: DataFrame, blocks: DataFrame, count: int, grams: int, id_col: str, text_col: str, gram: int, threshold: float, broadcast_rows: int, shared: int) -> DataFrame | None:
    """(doc_a, doc_b): links between nodes of different blocks; ``blocks``: (id, block) of all texts in one of several nodes."""
    kind = dict(docs.dtypes)[id_col]
    met = _met(docs, blocks, count, grams, id_col, text_col, gram, threshold, broadcast_rows, shared)
    ends = reps.select("h1", "id", "n", "bits")
    both = met.join(ends.select(F.col("h1").alias("x"), F.struct("id", "n", "bits").alias("p")), "x").join(ends.select(F.col("h1").alias("y"), F.struct("id", "n", "bits").alias("q")), "y")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for r in batch.to_pylist():
                u, v = (np.frombuffer(r[k], R.U)[None] for k in ("u", "v"))
                least = min(u.shape[1], v.shape[1])
                lost = min(r[k] - int(np.bitwise_count(fold(w, least)).sum()) for k, w in (("n", u), ("m", v)))
                keep.append(int(np.bitwise_count(fold(u, least) & fold(v, least)).sum()) + lost >= threshold / (1 + threshold) * (r["n"] + r["m"]) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = both.select(F.col("p.id").alias("a"), F.col("q.id").alias("b"), F.col("p.n").alias("n"), F.col("q.n").alias("m"), F.col("p.bits").alias("u"), F.col("q.bits").alias("v"))
    left = both.mapInArrow(bound, f"a {kind}, b {kind}")
    # A place for each pair.
    place = [F.lit(0).alias("tree"), F.xxhash64("a", "b").alias("key"), F.xxhash64("b", "a").alias("cell"), F.xxhash64("b", "a").alias("other"), F.lit(0).alias("side"), F.lit(1).cast("long").alias("copies")]
    sets = _placed_sets(docs, left.select(F.explode(F.array("a", "b")).alias("id"), *place), id_col, text_col, gram, broadcast_rows)
    if sets is None:
        return None
    return sets.mapInArrow(_prove(threshold, to_arrow_type(docs.schema[id_col].dataType), True), f"doc_a {kind}, doc_b {kind}, jaccard double").select("doc_a", "doc_b")


def _links(docs: DataFrame, id_col: str, text_col: str, pairs: bool, threshold: float = THRESHOLD, gram: int = GRAM, trees: int = TREES, split: int = SPLIT, broadcast_rows: int = BROADCAST_ROWS, cell_grams: int = CELL_GRAMS, shared: int = SHARED) -> tuple[DataFrame, DataFrame]:
    """(id, rep): each text with a set, and the smallest id whose set equals its own; and what ``_prove`` says of the links between such smallest ids.  Both are kept (``_kept``)."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id_col]
    arrow = to_arrow_type(docs.schema[id_col].dataType)
    sketch = _sketches(docs, id_col, text_col, gram, trees).persist(StorageLevel.DISK_ONLY)
    reps = None
    try:
        shape = ["h1", "h2", "n"]
        # An id that is repeated counts with its first set; as a rule there is none, and no sketch is moved for it.
        twice = _kept(sketch.groupBy("id").agg(F.min(F.struct(*shape)).alias("first"), F.max(F.struct(*shape)).alias("last")).where("first <> last").select("id", "first"))
        repeated = twice.count()
        single = sketch
        if repeated:
            single = sketch.join(F.broadcast(twice) if repeated <= broadcast_rows else twice, "id", "left").where(F.col("first").isNull() | (F.struct(*shape) == F.col("first")))
        reps = single.groupBy(*shape).agg(F.min(F.struct("id", "keys", "bits")).alias("r")).select("r.id", *shape, "r.keys", "r.bits").persist(StorageLevel.DISK_ONLY)
        same = _kept(single.select("id", *shape).distinct().join(reps.select(F.col("id").alias("rep"), *shape), shape).select("id", "rep"))
        third = "jaccard double" if pairs else "links long"
        count, grams = sketch.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        sketch.unpersist()  # all that is still needed of it is in the other two
        if count < 2:
            return same, spark.createDataFrame([], f"doc_a {kind}, doc_b {kind}, {third}")
        routed = _cells(reps, threshold, split, broadcast_rows).repartition(*_PLACE).sortWithinPartitions(*_PLACE, "id")
        found = _kept(routed.mapInArrow(_search(threshold, arrow), f"doc_a {kind}, doc_b {kind}").distinct())
        heads = components(found)
        blocks = _kept(same.join(heads.withColumnRenamed("id", "rep"), "rep").select("id", F.xxhash64("head").alias("block")))
        rest = _rest(docs, reps, blocks, count, grams, id_col, text_col, gram, threshold, broadcast_rows, shared)
        if rest is not None:
            rest = _kept(rest)
            if not rest.isEmpty():
                heads = components(found.unionAll(rest))
        # Each block is a tree.  Two whose hashes are equal would be one tree, which changes nothing.
        copies = same.groupBy(F.col("rep").alias("id")).agg(F.count("*").alias("copies"))
        inside = reps.select("id", "n").join(heads, "id").join(copies, "id").select("id", "n", "copies", F.array(F.xxhash64("head")).alias("keys"))
        placed = _cells(inside, threshold, split, broadcast_rows, cell_grams, ("id", "copies"))
        sets = _placed_sets(docs, placed, id_col, text_col, gram, broadcast_rows)
        if sets is None:
            return same, spark.createDataFrame([], f"doc_a {kind}, doc_b {kind}, {third}")
        return same, _kept(sets.mapInArrow(_prove(threshold, arrow, pairs), f"doc_a {kind}, doc_b {kind}, {third}"))
    finally:
        for df in (sketch, reps):
            if df is not None:
                df.unpersist()


def alike(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> tuple[DataFrame, DataFrame]:
    """(id, rep): each text with a set, and the smallest id whose set equals its own; and (doc_a, doc_b, jaccard): all links between such smallest ids.  Both are kept (``_kept``)."""
    return _links(docs, id_col, text_col, True, **options)


def components(pairs: DataFrame) -> DataFrame:
    """(id, head): each id in a pair, and the smallest id reachable from it.

    Every round a text takes the smallest label next to it, then the label of its label; the
    rounds needed grow with the logarithm of a component's diameter.
    """
    edges = _kept(pairs.select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b")).unionAll(pairs.select("doc_b", "doc_a")).distinct())
    labels = _kept(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("head")))
    while True:
        near = edges.join(labels.select(F.col("id").alias("b"), "head"), "b").groupBy(F.col("a").alias("id")).agg(F.min("head").alias("near"))
        step = labels.join(near, "id").select("id", "head", F.least("head", "near").alias("low"))
        jump = labels.select(F.col("id").alias("low"), F.col("head").alias("far"))
        step = _kept(step.join(jump, "low", "left").select("id", F.col("head").alias("old"), F.least("low", F.coalesce("far", "low")).alias("head")))
        labels = step.select("id", "head")
        if step.where("old <> head").isEmpty():
            break
    return labels


def _edges(links: DataFrame) -> DataFrame:
    return links.where("doc_a <> doc_b").select("doc_a", "doc_b").distinct()


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row for each row of ``docs``: id, ``class_id`` (the smallest id that links lead to, its own where there are none) and ``links`` (how many other ids it is linked to, copies included)."""
    same, links = _links(docs, id_col, text_col, False, **options)
    copies = same.groupBy("rep").agg(F.count("*").alias("copies"))
    near = links.groupBy(F.col("doc_a").alias("rep")).agg(F.sum("links").alias("near"))
    found = copies.join(near, "rep", "left").join(components(_edges(links)).withColumnRenamed("id", "rep"), "rep", "left")
    found = _kept(found.select("rep", F.coalesce("head", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("links")))
    member = same.join(found, "rep").select(F.col("id").alias("_member"), "class_id", "links")
    out = docs.select(id_col).join(member, F.col(id_col) == F.col("_member"), "left")
    return out.select(id_col, F.coalesce("class_id", id_col).alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` less all but the smallest id of each class of linked texts.

    Rows with a null id stay.  Of rows that repeat an id, all stay or all go.
    """
    same, links = _links(docs, id_col, text_col, False, **options)
    heads = components(_edges(links)).withColumnRenamed("id", "rep")
    gone = same.join(heads, "rep", "left").select(F.col("id").alias("_gone"), F.coalesce("head", "rep").alias("_head")).where("_gone <> _head").select("_gone")
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
