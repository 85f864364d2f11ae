"""Exact best matches of a stated query set, by matrix products over Arrow batches.

Queries are sent to all tasks in blocks of a bounded size; each task keeps the best few rows of each query over all of
its batches, so what is shuffled is that few times the queries and tasks, however many rows there are.  Where there are
many queries, each task takes a block of them instead and reads all rows (a million at a time) from the shared folder,
so that no query's best are shuffled for every task.  There a product in single precision, with a bound of its error,
picks what may be among the best, and only that is scored in double precision: the result is the exact one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from mnemora.sources.shared import Parts, materialize, new_path, ship

#: Bytes of query vectors (as double) that are sent at once; rows and queries of one matrix product.
BLOCK_BYTES = 64_000_000
_ROWS, _QUERIES = 4_096, 1_024
_PLACES = 12
#: Queries from which tasks take blocks of queries, queries of such a block, rows of a file, and files of a task.
MANY, _BLOCK, _FILE_ROWS, _FILES = 8_192, 2_048, 65_536, 16


def _matrix(vectors: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors that have ``size`` finite numbers, not all zero, and these at length one."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lengths = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    right = np.flatnonzero(lengths == size)
    if not len(right) or not size:
        return right[:0], np.empty((0, size))
    flat = vectors.take(pa.array(right)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    norms = np.sqrt((flat * flat).sum(1))
    good = np.isfinite(norms) & (norms > 0)
    return right[good], flat[good] / norms[good, None]


def _ranks(ids: list) -> np.ndarray:
    order = {x: k for k, x in enumerate(sorted(set(ids)))}
    return np.fromiter((order[x] for x in ids), np.int64, len(ids))


class _Best:
    """The ``k`` best rows of each query so far, ties by the smaller id."""

    def __init__(self, k: int):
        self.k, self.query, self.score, self.ids = k, np.empty(0, np.int64), np.empty(0), []

    def add(self, query: np.ndarray, score: np.ndarray, ids: list) -> None:
        self.query, self.score = np.concatenate([self.query, query]), np.concatenate([self.score, score])
        self.ids.extend(ids)

    def settle(self) -> None:
        if not len(self.query):
            return
        order = np.lexsort((_ranks(self.ids), -self.score, self.query))
        q = self.query[order]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        kept = order[place < self.k]
        self.query, self.score, self.ids = self.query[kept], self.score[kept], [self.ids[i] for i in kept]


def activation_score(cosines: np.ndarray, base: np.ndarray, emotion: np.ndarray) -> np.ndarray:
    """A memory's own activation for each query: cubed cosine by emotion and recency."""
    recency = np.clip((base + 10.0) / 10.0, 0.0, 1.0)
    return np.minimum(cosines, 1.0) ** 3 * (1.0 + emotion - 0.5) * (1.0 + recency)


def _activation_root(base: np.ndarray, emotion: np.ndarray) -> np.ndarray:
    return np.cbrt((1.0 + emotion - 0.5) * (1.0 + np.clip((base + 10.0) / 10.0, 0.0, 1.0)))


#: Of a row, what its cosine times is the cube root of the score: such scores are ordered as products of vectors are.
activation_score.root = _activation_root


class _Top:
    """The ``k`` best rows of each query so far, by number of a row; ties to the smaller number."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.query, self.score, self.row = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        self.last = np.full(n, -np.inf)  # the k-th best score
        self._more: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self._waiting = 0

    def add(self, query: np.ndarray, score: np.ndarray, row: np.ndarray) -> None:
        self._more.append((query, score, row))
        self._waiting += len(query)
        if self._waiting > self.k * self.n:
            self.settle()

    def settle(self) -> None:
        if not self._waiting:
            return
        query, score, row = (np.concatenate(x) for x in zip((self.query, self.score, self.row), *self._more))
        self._more, self._waiting = [], 0
        order = np.lexsort((row, -score, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, np.arange(self.n))[query]
        keep = place < self.k
        self.query, self.score, self.row = query[keep], score[order][keep], row[order][keep]
        full = place[keep] == self.k - 1
        self.last[self.query[full]] = self.score[full]


def _search_block(queries: np.ndarray, names: list, parts: Iterator[pa.Table], k: int, others: bool, score, extra: int) -> tuple[np.ndarray, list, np.ndarray]:
    """Places of queries, ids and scores of the ``k`` best rows of each; the rows come in the order of their ids."""
    size = queries.shape[1]
    single = queries.astype(np.float32)
    tops = [_Top(len(queries[a : a + _QUERIES]), k + 1 if others else k) for a in range(0, len(queries), _QUERIES)]
    ids, seen = [], 0
    for table in parts:
        if not table.num_rows:
            continue
        rows = np.frombuffer(b"".join(table.column("v").to_pylist()), np.float64).reshape(-1, size)
        more = [table.column(2 + j).to_numpy() for j in range(extra)]
        root = score.root(*more) if score else np.ones(len(rows))
        scaled = np.ascontiguousarray((rows * root[:, None]).astype(np.float32))
        # what the product in single precision may be off, rounding of both factors included
        slack = np.float32((size + 8) * 1.2e-7 * max(1e-30, float(np.nanmax(np.abs(root), initial=0.0))))
        for at, top in zip(range(0, len(queries), _QUERIES), tops):
            q = single[at : at + _QUERIES]
            for r in range(0, len(rows), _QUERIES):
                s = q @ scaled[r : r + _QUERIES].T
                floor = np.cbrt(top.last - 2 * 10.0**-_PLACES) if score else top.last - 2 * 10.0**-_PLACES
                if not np.isfinite(floor).all() and s.shape[1] > top.k:
                    here = -np.partition(-s, top.k - 1, axis=1)[:, top.k - 1]
                    floor = np.fmax(floor, here - slack)
                near = np.flatnonzero(s >= (floor - slack).astype(np.float32)[:, None])
                if len(near):
                    a, b = np.divmod(near, s.shape[1])
                    exact = np.einsum("ij,ij->i", queries[at + a], rows[r + b])
                    if score:
                        exact = score(exact, *[x[r + b] for x in more])
                    top.add(a, np.round(exact, _PLACES), seen + r + b)
        for top in tops:
            top.settle()
        ids.append(table.column("id"))
        seen += len(rows)
    if not ids:
        return np.empty(0, np.int64), [], np.empty(0)
    query = np.concatenate([top.query + at for at, top in zip(range(0, len(queries), _QUERIES), tops)])
    row, found = np.concatenate([top.row for top in tops]), np.concatenate([top.score for top in tops])
    ids = pa.chunked_array([c for x in ids for c in x.chunks]).take(pa.array(row)).to_pylist()
    if others:
        keep = [names[q] != x for q, x in zip(query, ids)]
        query, found, ids = query[keep], found[keep], [x for x, y in zip(ids, keep) if y]
    return query, ids, found


def _by_blocks(q: DataFrame, n: int, chosen: DataFrame, size: int, k: int, others: bool, score, extra: tuple[str, ...], schema: str) -> DataFrame:
    """query, id, s: what :func:`top_matches` finds for vectors of one length, by blocks of queries."""
    spark = chosen.sparkSession
    kinds = to_arrow_type(q.schema["id"].dataType), to_arrow_type(chosen.schema["id"].dataType)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, unit = _matrix(batch.column(1), size)
            offsets = np.arange(len(places) + 1, dtype=np.int32) * (8 * size)
            packed = pa.Array.from_buffers(pa.binary(), len(places), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(unit))])
            at = pa.array(places)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), packed, *[c.take(at) for c in batch.columns[2:]]], names=batch.schema.names)

    def packed(df: DataFrame) -> DataFrame:
        return df.mapInArrow(pack, ", ".join(f"{name} {'binary' if name == 'v' else kind}" for name, kind in df.dtypes))

    rows = materialize(packed(chosen), "rows")
    files = max(1, -(-rows.count() // _FILE_ROWS))
    in_order, blocks = new_path(spark, "rows_in_order"), new_path(spark, "probes")
    # in the order of their ids, so that a row's number decides ties
    rows.repartitionByRange(files, "id").sortWithinPartitions("id").write.option("compression", "zstd").parquet(in_order)
    count = -(-n // _BLOCK)
    packed(q).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")).repartition(count, "block").write.partitionBy("block").parquet(blocks)
    together = _FILES
    pieces = -(-files // together)
    grid = spark.createDataFrame([(b, p) for b in range(count) for p in range(pieces)], "block int, piece int").repartitionByRange(count * pieces, "block", "piece")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = pa.concat_tables([pa.table({"id": pa.array([], kinds[0]), "v": pa.array([], pa.binary())}), *Parts(f"{blocks}/block={block}").tables(["id", "v"])]).combine_chunks()
                if not own.num_rows:
                    continue
                names = own.column("id").to_pylist()
                vectors = np.frombuffer(b"".join(own.column("v").to_pylist()), np.float64).reshape(-1, size)
                query, ids, s = _search_block(vectors, names, Parts(in_order).tables(["id", "v", *extra], piece * together, (piece + 1) * together), k, others, score, len(extra))
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in query], kinds[0]), pa.array(ids, kinds[1]), pa.array(s)], names=["query", "id", "s"])

    return grid.mapInArrow(search, schema)


def top_matches(queries: DataFrame, rows: DataFrame, k: int = 1, others: bool = False, score=None, extra: tuple[str, ...] = (), block_bytes: int = BLOCK_BYTES, many: int = MANY) -> DataFrame:
    """query, id, s, rank: the ``k`` best rows of each query, by cosine or by ``score(cosines, *extra columns)``.

    ``queries`` has id and v, ``rows`` id, v and the ``extra`` double columns.  Scores are rounded to 12 places; ties
    go to the smaller id.  Vectors that are null, damaged, all zero or of another length than the query's match
    nothing.  With ``others`` a query's own id isn't among its matches.
    """
    ship(rows.sparkSession)
    context = rows.sparkSession.sparkContext
    q = queries.select("id", "v").filter("id is not null and v is not null")
    sizes = q.groupBy(F.size("v").alias("size")).count().collect()  # one row for each length of vector
    kinds = dict(queries.dtypes)["id"], dict(rows.dtypes)["id"]
    schema = f"query {kinds[0]}, id {kinds[1]}, s double"
    chosen = rows.select("id", "v", *[F.col(c).cast("double").alias(c) for c in extra]).filter("id is not null and v is not null")
    found = None
    for size, n in sorted((r["size"], r["count"]) for r in sizes):
        if size < 1:
            continue
        if n >= many and (score is None or hasattr(score, "root")):
            one = _by_blocks(q.filter(F.size("v") == size), n, chosen.filter(F.size("v") == size), size, k, others, score, extra, schema)
            found = one if found is None else found.unionByName(one)
            continue
        blocks = -(-n * 8 * size // block_bytes)
        for b in range(blocks):
            own = q.filter(F.size("v") == size)
            part = (own if blocks == 1 else own.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)).toArrow()  # a block of bounded size
            places, matrix = _matrix(part.column("v"), size)
            names = part.column("id").take(pa.array(places)).combine_chunks()
            sent = context.broadcast((names, matrix))

            def search(batches: Iterator[pa.RecordBatch], sent=sent, size=size) -> Iterator[pa.RecordBatch]:
                names, matrix = sent.value
                own_ids, best = names.to_pylist(), _Best(k + 1 if others else k)
                for batch in batches:
                    places, vectors = _matrix(batch.column(1), size)
                    if not len(places):
                        continue
                    ids = batch.column(0).take(pa.array(places)).to_pylist()
                    more = [batch.column(2 + j).to_numpy(zero_copy_only=False)[places] for j in range(len(extra))]
                    for r in range(0, len(places), _ROWS):
                        for at in range(0, len(matrix), _QUERIES):
                            s = matrix[at : at + _QUERIES] @ vectors[r : r + _ROWS].T
                            if score is not None:
                                s = score(s, *[x[None, r : r + _ROWS] for x in more])
                            s = np.round(s, _PLACES)
                            kept = min(best.k, s.shape[1])
                            least = -np.partition(-s, kept - 1, axis=1)[:, kept - 1 : kept]
                            where = np.nonzero(s >= least)
                            best.add(where[0] + at, s[where], [ids[r + j] for j in where[1]])
                    if len(best.query) > 4 * best.k * len(matrix):
                        best.settle()
                best.settle()
                keep = [not others or own_ids[i] != x for i, x in zip(best.query, best.ids)]
                best.query, best.score, best.ids = best.query[keep], best.score[keep], [x for x, y in zip(best.ids, keep) if y]
                if len(best.query):
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(best.query)), pa.array(best.ids, batch.schema.field(0).type), pa.array(best.score)], names=["query", "id", "s"])

            one = chosen.filter(F.size("v") == size).mapInArrow(search, schema)
            found = one if found is None else found.unionByName(one)
    if found is None:
        return rows.sparkSession.createDataFrame([], schema + ", rank int")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("s"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def best_match(queries: DataFrame, rows: DataFrame, block_bytes: int = BLOCK_BYTES, others: bool = False) -> DataFrame:
    """id, match, s: the most similar row of each query; ties go to the smaller id.

    Both tables have id and v.  A query with a null or damaged vector has no match; an empty table gives no rows.  With
    ``others`` a query's own id isn't among its matches.
    """
    return top_matches(queries, rows, 1, others, block_bytes=block_bytes).select(F.col("query").alias("id"), F.col("id").alias("match"), "s")


def recent_matches(rows: DataFrame, within_ms: int, least: float, k: int, chunk: int = 512) -> DataFrame:
    """src, dst, s: of each row its ``k`` most similar ones of the same key made less than ``within_ms`` before it.

    ``rows`` has key, id, at and v.  Rows meet in slots of ``within_ms``, each slot cut into chunks of at most about
    ``chunk`` rows; pairs of chunks, not of rows, are joined, and each is one matrix product that keeps ``k`` rows of
    each query.  So no task holds a slot, however many rows it has.  Cosines under ``least`` don't count; ties go to
    the smaller id; rows with a null or a damaged vector, and those made at the same instant, don't match.
    """
    ship(rows.sparkSession)
    r = rows.select("key", "id", "at", "v").filter("key is not null and id is not null and at is not null and v is not null").withColumn("slot", F.floor(F.col("at") / within_ms))
    n = r.groupBy("key", "slot").agg(F.ceil(F.count("*") / chunk).alias("parts"))
    r = r.join(n, ["key", "slot"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    chunks = r.groupBy("key", "slot", "part").agg(F.collect_list("id").alias("ids"), F.collect_list("at").alias("ats"), F.collect_list("v").alias("vs"))
    late = chunks.select("key", F.col("ids").alias("a"), F.col("ats").alias("ta"), F.col("vs").alias("va"), F.explode(F.array("slot", F.col("slot") - 1)).alias("slot"))
    early = chunks.select("key", "slot", F.col("ids").alias("b"), F.col("ats").alias("tb"), F.col("vs").alias("vb"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, ta, va, b, tb, vb in zip(*[batch.column(i).to_pylist() for i in range(6)]):
                best = _Best(k)
                for size in {len(x) for x in va}:
                    pa_, qa = _matrix(pa.array(va, pa.list_(pa.float64())), size)
                    pb, qb = _matrix(pa.array(vb, pa.list_(pa.float64())), size)
                    if not len(pa_) or not len(pb):
                        continue
                    gap = np.array(ta)[pa_][:, None] - np.array(tb)[pb][None, :]
                    s = np.where((gap > 0) & (gap < within_ms), np.round(qa @ qb.T, _PLACES), -2.0)
                    where = np.nonzero(s >= least)
                    best.add(pa_[where[0]], s[where], [b[pb[j]] for j in where[1]])
                best.settle()
                yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in best.query], batch.schema.field(0).type.value_type), pa.array(best.ids, batch.schema.field(3).type.value_type), pa.array(best.score)], names=["src", "dst", "s"])

    kind = dict(rows.dtypes)["id"]
    found = late.join(early, ["key", "slot"]).select("a", "ta", "va", "b", "tb", "vb").mapInArrow(compare, f"src {kind}, dst {kind}, s double")
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("s"), "dst"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")
