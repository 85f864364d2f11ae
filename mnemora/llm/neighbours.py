"""The most similar vectors of every vector.

Vectors are scaled to length one and projected onto a few directions drawn from the normal distribution, which is
stable: a projected difference is normal with the distance as its deviation.  A kd-tree over the projections, one
direction a level and medians of a bounded sample as cuts, groups the rows into leaves, and neighbouring leaves into
blocks, which are written to the shared folder.  Each block's rows then search, with exact cosines: their own leaf
first, then the other leaves in steps, in the order of their projected distance.  A leaf is left out for a query when a
chi-square test holds that none of the sought neighbours can lie in it: the squared projected distance to the leaf's
cell, over the squared distance of the query's k-th best so far, exceeds the quantile for as many directions as separate
the two.  The test is made again before each step, with what was found; more steps would spare comparisons, but break the
matrix products into small ones, which costs more.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemora.sources.shared import materialize, new_path

#: Neighbours of a vector and the least cosine that counts.
K, LEAST = 5, 0.85
#: Error of the stopping test; rows of a leaf and of a block; rows in the sample that the cuts are fitted on.
ERROR, LEAF_ROWS, BLOCK_ROWS, SAMPLE = 0.3, 64, 16_384, 65_536
#: Copies of one vector that are indexed; by the tie rule the others' neighbours are the first of these.
COPIES = K + 1
#: Directions that are there for levels of a tree (2**32 leaves); blocks that a search keeps at hand.
MOST_LEVELS, AT_HAND = 32, 24
#: Parts of a statistic's limit at which the test is made again.
STEPS = np.array([0.3], np.float32)
_SEED = 20_240_229


@lru_cache
def quantile(df: int, error: float) -> float:
    """Upper quantile of the chi-square distribution, by bisection on its survival function."""
    import math

    def survival(x: float) -> float:
        if df % 2:
            total, term = math.erfc(math.sqrt(x / 2)), math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
            for k in range(1, (df - 1) // 2 + 1):
                total += term
                term *= x / (2 * k + 1)
            return total
        total, term = 0.0, math.exp(-x / 2)
        for k in range(df // 2):
            total += term
            term *= x / (2 * (k + 1))
        return total

    low, high = 0.0, 10.0 * df + 50
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if survival(middle) > error else (low, middle)
    return high


class ProjectionTree:
    """kd-tree with one stable projection a level; ``cuts[level]`` has the cut of each node of the level."""

    def __init__(self, sample: np.ndarray, levels: int):
        self.levels = levels
        self.dims = sample.shape[1]
        self.cuts: list[np.ndarray] = []
        directions = self.directions
        at = np.zeros(len(sample), np.int64)
        for level in range(levels):
            p = sample @ directions[level]
            order = np.lexsort((p, at))
            bounds = np.searchsorted(at[order], np.arange((1 << level) + 1))
            n = np.diff(bounds)
            # the median of the node's rows; a node without any takes that of all
            cuts = np.full(1 << level, float(np.median(p)) if len(p) else 0.0, np.float32)
            low, high = np.minimum(bounds[:-1] + (n - 1) // 2, max(0, len(p) - 1)), np.minimum(bounds[:-1] + n // 2, max(0, len(p) - 1))
            if len(p):
                cuts[n > 0] = ((p[order[low]] + p[order[high]]) / 2)[n > 0]
            self.cuts.append(cuts)
            at = 2 * at + (p > cuts[at])

    @property
    def directions(self) -> np.ndarray:
        return np.random.default_rng([_SEED, self.dims]).standard_normal((MOST_LEVELS, self.dims)).astype(np.float32)

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        p = vectors @ self.directions[: self.levels].T
        at = np.zeros(len(vectors), np.int64)
        for level, cuts in enumerate(self.cuts):
            at = 2 * at + (p[:, level] > cuts[at])
        return at

    def limits(self, error: float) -> np.ndarray:
        """What the statistic of a leaf may be, by the number of crossed cuts."""
        return np.array([0.0, *(quantile(d, error) for d in range(1, self.levels + 1))], np.float32)

    def reach(self, projected: np.ndarray, squared: np.ndarray, error: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of a leaf and a query for which the test can't leave the leaf out, its statistic and its crossed cuts.

        ``squared`` is the squared distance within which a query's neighbours are sought.  The test is made at each
        crossed cut on the way down, so that what is left out takes no more work.
        """
        limits = self.limits(error)
        scaled = 1 / squared
        query = np.arange(len(projected), dtype=np.int32)
        node = np.zeros(len(projected), np.int32)
        far = np.zeros(len(projected), np.float32)
        apart = np.zeros(len(projected), np.int8)
        for level, cuts in enumerate(self.cuts):
            over = projected[:, level][query] - cuts[node]
            right = over > 0
            crossed = over * over
            crossed *= scaled[query]
            crossed += far
            goes = np.flatnonzero(crossed <= limits[1:][apart])
            node *= 2
            node += right
            node = np.concatenate([node, node[goes] ^ 1])
            query = np.concatenate([query, query[goes]])
            far = np.concatenate([far, crossed[goes]])
            apart = np.concatenate([apart, apart[goes] + np.int8(1)])
        return node, query, far, apart


class _Blocks:
    """The blocks of one space in the shared folder, read by whatever task needs them."""

    def __init__(self, path: str):
        from pyarrow import fs

        self._fs, self._root = fs.FileSystem.from_uri(path)
        self._selector = fs.FileSelector

    def read(self, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, leaves and vectors of a block in the order of leaf and id, one row for each id."""
        import pyarrow.parquet as pq
        from pyarrow import fs

        folder = f"{self._root}/block={block}"
        files = [i.path for i in self._fs.get_file_info(self._selector(folder, allow_not_found=True)) if i.type == fs.FileType.File and i.path.endswith(".parquet")]
        tables = [pq.ParquetFile(self._fs.open_input_file(f)).read(columns=["id", "leaf", "vector"]) for f in sorted(files)]
        if not tables:
            return np.empty(0, object), np.empty(0, np.int64), np.empty((0, 0), np.float32)
        table = pa.concat_tables(tables).combine_chunks()
        ids = table.column("id").to_numpy(zero_copy_only=False)
        leaf = table.column("leaf").to_numpy()
        raw = table.column("vector").combine_chunks()
        raw = raw.chunk(0) if isinstance(raw, pa.ChunkedArray) else raw
        first = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset]
        vectors = np.frombuffer(raw.buffers()[2], np.float32, offset=int(first)).reshape(-1)[: table.num_rows * (len(raw[0].as_py()) // 4)].reshape(table.num_rows, -1)
        same = leaf[1:] == leaf[:-1]
        if (leaf[1:] < leaf[:-1]).any() or (same & (ids[1:] < ids[:-1])).any():  # they are written in this order
            order = np.lexsort((ids.astype(str), leaf))
            ids, leaf, vectors = ids[order], leaf[order], vectors[order]
        keep = np.ones(len(ids), bool)
        keep[1:] = ids[1:] != ids[:-1]
        return ids[keep], leaf[keep], vectors[keep]


def _best_first(q: np.ndarray, cos: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The order by query, falling cosine and id; ids are compared in ties only, which are few."""
    order = np.lexsort((-cos, q))
    tied = np.zeros(len(q) + 1, bool)
    tied[1:-1] = (q[order][1:] == q[order][:-1]) & (cos[order][1:] == cos[order][:-1])
    places = np.flatnonzero(tied[1:] | tied[:-1])
    if len(places):
        among = order[places]
        order[places] = among[np.lexsort((ids[among].astype(str), -cos[among], q[among]))]
    return order


class _Best:
    """The k best of every query so far, ties to the smaller id."""

    def __init__(self, n: int, k: int, least: float):
        self.n, self.k, self.least = n, k, least
        self.q = np.empty(0, np.int64)
        self.cos = np.empty(0)
        self.ids = np.empty(0, object)
        self.floor = np.full(n, least - 1e-6, np.float32)
        self._more: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self._waiting = 0

    def add(self, q: np.ndarray, cos: np.ndarray, ids: np.ndarray) -> None:
        self._more.append((q, cos, ids))
        self._waiting += len(q)
        if self._waiting > max(self.n, len(self.q) // 2):  # a share of what is sorted, so that sorting stays in proportion to what is found
            self.settle()

    def settle(self) -> None:
        if not self._more:
            return
        q, cos, ids = (np.concatenate(x) for x in zip((self.q, self.cos, self.ids), *self._more))
        self._more, self._waiting = [], 0
        order = _best_first(q, cos, ids)
        q, cos, ids = q[order], cos[order], ids[order]
        start = np.searchsorted(q, np.arange(self.n))
        rank = np.arange(len(q)) - start[q]
        keep = rank < self.k
        full = rank == self.k - 1
        self.floor[q[full]] = np.maximum(self.floor[q[full]], cos[full] - 1e-6)
        self.q, self.cos, self.ids = q[keep], cos[keep], ids[keep]


def within(best: _Best, n: int, k: int, least: float) -> np.ndarray:
    """Of each query the squared distance of its k-th best so far, or of the least cosine that counts."""
    squared = np.full(n, 2 - 2 * least, np.float32)
    rank = np.arange(len(best.q)) - np.searchsorted(best.q, np.arange(n))[best.q]
    last = rank == k - 1
    squared[best.q[last]] = np.minimum(squared[best.q[last]], (2 - 2 * best.cos[last]).astype(np.float32))
    return np.maximum(squared, 1e-6, out=squared)


def search_block(tree: ProjectionTree, blocks: _Blocks, block: int, block_bits: int, k: int, least: float, error: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Up to 2 k neighbours of all rows of a block: ids, neighbours' ids, cosines rounded to 6 places."""
    ids, leaf, vectors = blocks.read(block)
    n = len(ids)
    if not n:
        return ids, ids, np.empty(0)
    exact = vectors.astype(np.float64)
    exact /= np.linalg.norm(exact, axis=1)[:, None]
    best = _Best(n, 2 * k, least)  # more than k: what one side misses, the other may have found
    shift = tree.levels - block_bits

    def hold(queries: np.ndarray, other: np.ndarray, other_ids: np.ndarray) -> None:
        cos = vectors[queries] @ other.T
        near = np.flatnonzero(cos >= best.floor[queries][:, None])
        if len(near):
            a, b = np.divmod(near, len(other))
            q = queries[a]
            cos = np.round(np.einsum("ij,ij->i", exact[q], _unit(other[b])), 6)
            fits = (cos >= least) & (other_ids[b] != ids[q])
            best.add(q[fits], cos[fits], other_ids[b[fits]])

    bounds = np.flatnonzero(np.concatenate([[True], leaf[1:] != leaf[:-1], [True]]))
    for a, b in zip(bounds[:-1], bounds[1:]):  # each query's own leaf first: it may narrow the search
        hold(np.arange(a, b), vectors[a:b], ids[a:b])
    best.settle()
    squared = within(best, n, k, least)
    projected = vectors @ tree.directions[: tree.levels].T
    found = [tree.reach(projected[at : at + 2048], squared[at : at + 2048], error) for at in range(0, n, 2048)]
    queries = np.concatenate([q + np.int32(2048 * i) for i, (_, q, _, _) in enumerate(found)])
    leaves, far, apart = (np.concatenate([x[j] for x in found]) for j in (0, 2, 3))
    others = leaves != leaf[queries]
    leaves, queries, far, apart = leaves[others], queries[others], far[others], apart[others]
    # by projected distance: leaves whose statistic is a small part of its limit first, the others in further steps
    limits = tree.limits(error)
    rounds = np.searchsorted(STEPS, far / limits[apart], side="right")
    at_hand: OrderedDict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = OrderedDict({block: (ids, leaf, vectors)})
    for turn in range(int(rounds.max()) + 1 if len(rounds) else 0):
        now = within(best, n, k, least)
        # the test again: what was found since may rule a leaf out
        chosen = np.flatnonzero((rounds == turn) & (far * (squared / now)[queries] <= limits[apart]))
        order = chosen[np.argsort(leaves[chosen], kind="stable")]
        l, q = leaves[order], queries[order]
        starts = np.flatnonzero(np.concatenate([[True], l[1:] != l[:-1]])) if len(l) else np.empty(0, int)
        for a, b in zip(starts.tolist(), np.append(starts[1:], len(l)).tolist()):
            other = int(l[a]) >> shift
            if other not in at_hand:
                at_hand[other] = blocks.read(other)
                while len(at_hand) > AT_HAND:
                    at_hand.popitem(last=False)
            at_hand.move_to_end(other)
            other_ids, other_leaf, other_vectors = at_hand[other]
            lo, hi = np.searchsorted(other_leaf, [l[a], l[a] + 1])
            for c in range(a, b, 8192):
                for r in range(lo, hi, 1024):
                    hold(q[c : min(b, c + 8192)], other_vectors[r : min(hi, r + 1024)], other_ids[r : min(hi, r + 1024)])
        best.settle()
    best.settle()
    return ids[best.q], best.ids, best.cos


def _unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v /= np.linalg.norm(v, axis=1)[:, None]
    return v


def _matrix(column: pa.Array, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Undamaged vectors as unit rows, by length: the places of the rows, and the rows."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    lengths = np.diff(offsets)
    valid = np.asarray(column.is_valid()) & (lengths == size) & (lengths > 0)
    values = column.values
    flat = values.to_numpy(zero_copy_only=False).astype(np.float32)  # a null number becomes NaN
    for length in np.unique(lengths[valid]).tolist():
        rows = np.flatnonzero(valid & (lengths == length))
        v = flat[offsets[rows][:, None] + np.arange(length)].astype(np.float64)
        norm = np.linalg.norm(v, axis=1)
        good = np.isfinite(norm) & (norm > 0)
        yield rows[good], (v[good] / norm[good][:, None]).astype(np.float32)


def nearest(vectors: DataFrame, k: int = K, least: float = LEAST, error: float = ERROR, leaf_rows: int = LEAF_ROWS, block_rows: int = BLOCK_ROWS, sample: int = SAMPLE) -> DataFrame:
    """space, id, neighbour, cosine (rounded to 6 places), rank: for each vector the up to k most similar of its space.

    ``vectors`` has space (string), id (string), size (int, the right length) and vector (array<float>).  Only
    neighbours with a cosine of ``least`` or more come out; ties go to the smaller id.  The cosine is exact; the search
    misses a neighbour with a probability that ``error`` sets (measured recall in the README).

    Defined results: vectors that are null, not of their space's length, with a null, NaN or infinite number or all
    zero are no rows of the search; nor are null ids and spaces; deliveries of an id are one row; copies of one vector
    beyond COPIES have the first copies as neighbours, by the tie rule; an empty table gives no rows; the cuts are
    fitted on about ``sample`` rows of each space, all rows are indexed.
    """
    spark = vectors.sparkSession
    schema = "space string, id string, neighbour string, cosine double, rank int"
    clean = vectors.select("space", "id", F.col("size").cast("int").alias("size"), F.col("vector").cast("array<float>").alias("vector")).filter("space is not null and id is not null and size > 0 and size(vector) = size")
    counts = {(r[0], r[1]): r[2] for r in clean.groupBy("space", "size").count().collect()}  # one row for each model
    if not counts:
        return spark.createDataFrame([], schema)
    numbers = {key: number for number, key in enumerate(sorted(counts))}
    share = F.lit(False)
    for (space, size), n in counts.items():
        every = max(1, n // sample)
        share = F.when((F.col("space") == space) & (F.col("size") == size), F.pmod(F.xxhash64("id"), F.lit(every)) == 0).otherwise(share)
    drawn = clean.filter(share).select("space", "size", "vector").toArrow().combine_chunks()
    trees: dict[int, ProjectionTree] = {}
    for (space, size), number in numbers.items():
        own = drawn.filter(pa.array([x == (space, size) for x in zip(drawn["space"].to_pylist(), drawn["size"].to_pylist())], pa.bool_()))
        column = own["vector"].combine_chunks()
        parts = [m for c in (column.chunks if isinstance(column, pa.ChunkedArray) else [column]) for _, m in _matrix(c, np.full(len(c), size))]
        fitted = np.concatenate(parts) if parts else np.zeros((0, size), np.float32)
        levels = max(0, min(MOST_LEVELS, int(np.ceil(np.log2(max(1, counts[space, size] / leaf_rows))))))
        trees[number] = ProjectionTree(fitted, levels)
    sent = spark.sparkContext.broadcast((numbers, trees))  # 2 ** levels cuts each: one number for leaf_rows rows

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, trees = sent.value
        for batch in batches:
            column = batch.column(3)
            sizes = batch.column(2).to_numpy(zero_copy_only=False)
            spaces = np.array(batch.column(0).to_pylist(), object)
            for rows, unit in _matrix(column, sizes):
                for space in set(spaces[rows]):
                    own = spaces[rows] == space
                    number = numbers[space, unit.shape[1]]
                    leaf = trees[number].leaves(unit[own])
                    data = np.ascontiguousarray(unit[own])
                    offsets = np.arange(len(data) + 1, dtype=np.int32) * (4 * unit.shape[1])
                    packed = pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(data), number, np.int32)), batch.column(1).take(pa.array(rows[own])), pa.array(leaf), packed], names=["number", "id", "leaf", "vector"])

    rows = clean.mapInArrow(index, "number int, id string, leaf bigint, vector binary")
    bits = {number: max(0, min(trees[number].levels, int(np.ceil(np.log2(max(1, counts[key] / block_rows)))))) for key, number in numbers.items()}
    block = F.lit(0).cast("bigint")
    for number, tree in trees.items():
        block = F.when(F.col("number") == number, F.shiftright("leaf", tree.levels - bits[number])).otherwise(block)
    rows = materialize(rows.withColumn("block", block).withColumn("copy", F.xxhash64("vector")), "vectors")
    # vectors of which there are many copies: only the first few are indexed
    heavy = materialize(rows.groupBy("number", "copy").count().filter(F.col("count") > COPIES).select("number", "copy"), "copies")
    many = not heavy.isEmpty()
    extra = None
    if many:
        copies = rows.join(heavy, ["number", "copy"], "left_semi").select("number", "copy", "id").distinct()
        window = Window.partitionBy("number", "copy").orderBy("id")
        firsts = materialize(copies.withColumn("place", F.row_number().over(window)).filter(F.col("place") <= COPIES), "firsts")
        kept = rows.join(heavy, ["number", "copy"], "left_anti").unionByName(rows.join(firsts.select("number", "copy", "id"), ["number", "copy", "id"], "left_semi"))
        rest = copies.join(firsts.select("number", "copy", "id"), ["number", "copy", "id"], "left_anti")
        extra = rest.join(firsts.filter(F.col("place") <= k).withColumnRenamed("id", "neighbour"), ["number", "copy"]).select("number", "id", "neighbour", F.lit(1.0).alias("cosine"), F.col("place").alias("rank"))
    else:
        kept = rows
    path = new_path(spark, "blocks")
    kept.select("number", "block", "id", "leaf", "vector").repartition("number", "block").sortWithinPartitions("number", "block", "leaf", "id").write.partitionBy("number", "block").parquet(path)
    tasks = [(number, b) for number in bits for b in range(1 << bits[number])]
    plan = spark.createDataFrame(tasks, "number int, block int").repartitionByRange(len(tasks), "number", "block")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, trees = sent.value
        for batch in batches:
            for number, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = search_block(trees[number], _Blocks(f"{path}/number={number}"), b, bits[number], k, least, error)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found[0]), number, np.int32)), pa.array(found[0], pa.string()), pa.array(found[1], pa.string()), pa.array(found[2], pa.float64())], names=["number", "id", "neighbour", "cosine"])

    found = materialize(plan.mapInArrow(search, "number int, id string, neighbour string, cosine double"), "found")
    # each pair counts for both of its sides, whichever of them found it
    both = found.unionByName(found.select("number", F.col("neighbour").alias("id"), F.col("id").alias("neighbour"), "cosine"))
    both = both.repartition("number", "id").distinct()
    order = Window.partitionBy("number", "id").orderBy(F.desc("cosine"), "neighbour")
    result = both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    if extra is not None:
        result = result.unionByName(extra)
    name = F.lit(None).cast("string")
    for (space, _), number in numbers.items():
        name = F.when(F.col("number") == number, space).otherwise(name)
    return result.select(name.alias("space"), "id", "neighbour", "cosine", "rank")
