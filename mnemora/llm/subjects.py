"""Subject areas of documents.

Document vectors (hashed words, weighted by rarity, projected to a few dimensions and scaled to length one) are
clustered by bisecting k-means over the whole corpus, level by level: each pass assigns every document to a child of
its cluster and sums the children.  A leaf is labelled by its discriminative terms, the words that are more frequent in
it than elsewhere: what labelled documents and the titles and notes of the subjects say about these words makes the
leaf's subjects.  A document is a mixture of leaves, by its words and by its nearness to their centres, and so a
mixture of the leaves' subjects, of which those with a large enough share are assigned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemora.llm.leaks import byte_words
from mnemora.sources.shared import materialize

#: Bits of the word table; dimensions of the vectors; levels of the tree; passes for each level.
WORD_BITS, DIMS, LEVELS, PASSES = 18, 128, 7, 3
#: Words a document needs to be judged; documents that a word needs.
LEAST_WORDS, RARE = 12, 3
#: Share of documents from which a word's spread over the labelled subjects is judged (below it a few labelled documents
#: can't tell), the lift up to which it is even, and the documents of the usual rate that each subject's rate is mixed with.
JUDGED, EVEN, PRIOR = 0.1, 1.5, 20
#: How far a word's leaning to a subject is sharpened, and the leaning from which it tells.
SHARPEN, TELLING = 4, 0.7
#: F1 by which choices are nearly equal; labelled documents of a leaf that its terms' label counts as many as; its discriminative terms; documents that a word of a subject's title or note counts for; how sharply nearness
#: to a leaf's centre tells, and the parts of a mixture that may come from it.
NEARLY, AS_MANY, TERMS, NAMED, SHARP, PARTS = 0.003, 4.0, 60, 5.0, 24.0, (0.0, 0.1, 0.2, 0.35)
#: Labelled rows that the leaves' subjects and the threshold are fitted on at most.
LABELLED = 20_000
_SEED = 77
_WORDS = 1 << WORD_BITS


def _lengths(texts: pa.Array) -> tuple[np.ndarray, bytes]:
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return np.diff(offsets), bytes(data[int(offsets[0]) : int(offsets[-1])]) if data is not None else b""


def document_words(lengths: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Of texts that lie end to end in ``data``: the text and the slot of each word of three letters or more without digits."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts, sizes, codes = byte_words(data)
    first = np.frombuffer(data, np.uint8)[starts]
    good = (sizes >= 3) & (first > 57)
    starts, codes = starts[good], codes[good]
    text = np.searchsorted(np.cumsum(lengths), starts, side="right")
    slots = ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    return text, slots


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            text, slots = document_words(*_lengths(part.column(1).cast(pa.large_binary()).fill_null(b"")))
            yield part, part.num_rows, text, slots


def _sparse(n: int, text: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, slot) with their counts."""
    pair, count = np.unique(text * _WORDS + slots, return_counts=True)
    return pair >> WORD_BITS, pair & (_WORDS - 1), count


def projection() -> np.ndarray:
    return np.random.default_rng(_SEED).integers(0, 2, (_WORDS, DIMS), np.int8) * np.int8(2) - np.int8(1)


def vectors_of(n: int, t: np.ndarray, s: np.ndarray, c: np.ndarray, rarity: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Unit rows of the distinct (text, slot, count); all zero for a text without telling words."""
    weight = (np.log1p(c) * rarity[s]).astype(np.float32)
    out = np.zeros((n, DIMS), np.float32)
    bounds = np.searchsorted(t, np.arange(n + 1))
    for k in range(n):
        a, b = bounds[k], bounds[k + 1]
        if b > a:
            out[k] = weight[a:b] @ signs[s[a:b]].astype(np.float32)
    norm = np.linalg.norm(out, axis=1)
    out /= np.maximum(norm, 1e-9)[:, None]
    return out


class BisectingTree:
    """Centres of the clusters of each level; the children of cluster c are 2 c and 2 c + 1."""

    def __init__(self) -> None:
        self.levels: list[np.ndarray] = []

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        at = np.zeros(len(vectors), np.int64)
        for centres in self.levels:
            left = np.einsum("ij,ij->i", vectors, centres[2 * at])
            right = np.einsum("ij,ij->i", vectors, centres[2 * at + 1])
            at = 2 * at + (right > left)
        return at

    def nearness(self, vectors: np.ndarray) -> np.ndarray:
        """Of each vector its mixture of leaves, by the cosines to their centres; zeros for a vector of zeros."""
        near = np.exp(SHARP * (vectors @ self.levels[-1].T - 1.0))
        near[~vectors.any(1)] = 0.0
        return near / np.maximum(near.sum(1), 1e-12)[:, None]


def _matrix(column: pa.Array) -> np.ndarray:
    data = column.buffers()[2]
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.float32, count=(int(offsets[-1]) - int(offsets[0])) // 4, offset=int(offsets[0])).reshape(len(column), DIMS)


_SUMS = "node int, total binary, square binary, n double"


def _add_up(rows: pa.Table) -> pa.Table:
    """The sums of one node over all tasks, in an order that doesn't depend on theirs."""
    order = sorted(range(rows.num_rows), key=lambda k: rows["total"][k].as_py())
    total, square = np.zeros(DIMS), np.zeros(DIMS)
    for k in order:
        total += np.frombuffer(rows["total"][k].as_py())
        square += np.frombuffer(rows["square"][k].as_py())
    return pa.table({"node": rows["node"][:1].cast(pa.int32()), "total": pa.array([total.tobytes()], pa.binary()), "square": pa.array([square.tobytes()], pa.binary()), "n": pa.array([float(rows["n"].to_numpy().sum())])})


def fit_tree(vectors: DataFrame, levels: int, passes: int) -> BisectingTree:
    """Bisecting k-means by passes over all vectors; what comes to the driver are the sums of each pass."""
    spark = vectors.sparkSession
    tree, chance = BisectingTree(), np.random.default_rng(_SEED)

    def sums(tree_now: BisectingTree, children: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sent = spark.sparkContext.broadcast((tree_now, children))

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree_, centres = sent.value
            n = (1 << len(tree_.levels)) * (1 if centres is None else 2)
            total, square, count = np.zeros((n, DIMS)), np.zeros((n, DIMS)), np.zeros(n)
            for batch in batches:
                v = _matrix(batch.column(0)).astype(np.float32)
                at = tree_.leaves(v)
                if centres is not None:
                    at = 2 * at + (np.einsum("ij,ij->i", v, centres[2 * at + 1]) > np.einsum("ij,ij->i", v, centres[2 * at]))
                order = np.argsort(at, kind="stable")
                v, at = v[order], at[order]
                firsts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.empty(0, int)
                if len(firsts):
                    total[at[firsts]] += np.add.reduceat(v, firsts)
                    square[at[firsts]] += np.add.reduceat(v * v, firsts)
                    count[at[firsts]] += np.diff(np.append(firsts, len(at)))
            used = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([total[k].tobytes() for k in used], pa.binary()), pa.array([square[k].tobytes() for k in used], pa.binary()), pa.array(count[used])], names=["node", "total", "square", "n"])

        # each task's sums are added up node by node, by as many tasks as there are nodes
        rows = vectors.select("vector").mapInArrow(add, _SUMS).groupBy("node").applyInArrow(_add_up, _SUMS).toArrow()
        n = (1 << len(tree_now.levels)) * (1 if children is None else 2)
        total, square, count = np.zeros((n, DIMS)), np.zeros((n, DIMS)), np.zeros(n)
        for node, t, q, c in zip(*(rows[x].to_pylist() for x in ("node", "total", "square", "n"))):
            total[node] += np.frombuffer(t)
            square[node] += np.frombuffer(q)
            count[node] += c
        return total, square, count

    total, square, count = sums(tree, None)
    for _ in range(levels):
        mean = total / np.maximum(count, 1)[:, None]
        spread = np.sqrt(np.maximum(square / np.maximum(count, 1)[:, None] - mean**2, 1e-9))
        step = spread * chance.choice([-1.0, 1.0], spread.shape)
        children = np.stack([mean + step, mean - step], 1).reshape(-1, DIMS)
        for _ in range(passes):
            children /= np.maximum(np.linalg.norm(children, axis=1), 1e-9)[:, None]
            total, square, count = sums(tree, children.astype(np.float32))
            children = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], children)
        # the sums belong to the centres of the last pass, so those are kept
        final = children / np.maximum(np.linalg.norm(children, axis=1), 1e-9)[:, None]
        tree.levels.append(final.astype(np.float32))
    return tree


class _Cells:
    """Counts of cells of a large table, of which a task meets a part."""

    def __init__(self) -> None:
        self.cells, self.counts, self.fresh, self.held = np.empty(0, np.int64), np.empty(0, np.int64), [], 0

    def add(self, cells: np.ndarray) -> None:
        self.fresh.append(cells)
        self.held += len(cells)
        if self.held > 2_000_000:
            self.settled()

    def settled(self) -> tuple[np.ndarray, np.ndarray]:
        if self.fresh:
            cells, counts = np.unique(np.concatenate(self.fresh), return_counts=True)
            both = np.concatenate([self.cells, cells])
            self.cells, at = np.unique(both, return_inverse=True)
            self.counts = np.bincount(at, np.concatenate([self.counts, counts]), minlength=len(self.cells)).astype(np.int64)
            self.fresh, self.held = [], 0
        return self.cells, self.counts


class Corpus:
    """Counts, vectors and clusters of all documents; one pass over the texts each for the first two.

    Defined results: null and empty texts have no words and a vector of zeros; equal documents count each; extra
    columns are ignored; an empty table has no words.  No word is left out for its share of the documents: one in many
    of them keeps its low weight, unless ``labelled`` (doc_id, subjects) shows that all subjects have it alike.
    """

    def __init__(self, documents: DataFrame, labelled: DataFrame | None = None, names: list[str] | None = None):
        self.documents = documents.select("doc_id", "text").filter("doc_id is not null")
        self.spark = documents.sparkSession

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            df, total = np.zeros(_WORDS, np.int64), 0
            for part, n, text, slots in _batches(batches):
                _, s, _ = _sparse(n, text, slots)
                df += np.bincount(s, minlength=_WORDS)
                total += n
            used = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1).astype(np.int32)), pa.array(np.append(df[used], total))], names=["slot", "n"])

        counts = self.documents.mapInArrow(count, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # a row for each slot
        slot, n = counts["slot"].to_numpy(), counts["n"].to_numpy()
        self.total = int(n[slot < 0].sum())
        self.df = np.zeros(_WORDS, np.int64)
        self.df[slot[slot >= 0]] = n[slot >= 0]
        telling = self.df >= RARE
        if labelled is not None:
            telling &= (self.df <= JUDGED * self.total) | ~even_words(*self.subject_words(labelled, names))
        self.rarity = np.where(telling, np.log(max(1, self.total) / np.maximum(self.df, 1)), 0.0).astype(np.float32)
        sent = self.spark.sparkContext.broadcast(self.rarity)

        def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rarity, signs = sent.value, projection()
            for part, n, text, slots in _batches(batches):
                total = np.bincount(text, minlength=n)
                t, s, c = _sparse(n, text, slots)
                keep = rarity[s] > 0
                t, s, c = t[keep], s[keep], np.minimum(c[keep], 255)
                v = vectors_of(n, t, s, c, rarity, signs)
                bounds = np.searchsorted(t, np.arange(n + 1))
                s, c = s.astype(np.uint32), c.astype(np.uint8)
                rows = list(zip(bounds[:-1], bounds[1:]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(total.astype(np.int32)), pa.array([s[a:b].tobytes() for a, b in rows], pa.binary()), pa.array([c[a:b].tobytes() for a, b in rows], pa.binary()), pa.array([x.tobytes() for x in v], pa.binary())],
                    names=["doc_id", "words", "slots", "counts", "vector"],
                )

        kind = documents.schema["doc_id"].dataType.simpleString()
        self.table = materialize(self.documents.mapInArrow(describe, f"doc_id {kind}, words int, slots binary, counts binary, vector binary"), "documents")
        self.tree = fit_tree(self.table.filter("octet_length(slots) > 0"), LEVELS, PASSES)

    def subject_words(self, labelled: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Labelled documents of each subject, and of each slot and subject those that have the word.

        The labelled documents are a bounded sample, so they are broadcast.
        """
        many = len(names)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            place = {n: k for k, n in enumerate(names)}
            table, sizes = _Cells(), np.zeros(many, np.int64)
            for part, n, text, slots in _batches(batches):
                own = np.zeros((n, many), np.int64)
                for k, subjects_ in enumerate(part.column(2).to_pylist()):
                    own[k, [place[x] for x in subjects_]] = 1
                sizes += own.sum(0)
                t, s, _ = _sparse(n, text, slots)
                pair, subject = np.nonzero(own[t])
                table.add(s[pair] * many + subject)
            used, n_used = table.settled()
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([used, -1 - np.arange(many)]).astype(np.int32)), pa.array(np.concatenate([n_used, sizes]).astype(np.int64))], names=["cell", "n"])

        rows = self.documents.join(F.broadcast(labelled), "doc_id").select("doc_id", "text", "subjects").mapInArrow(count, "cell int, n bigint")
        rows = rows.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # no more rows than the table has cells
        cell, n = rows["cell"].to_numpy(), rows["n"].to_numpy()
        table, sizes = np.zeros(_WORDS * many), np.zeros(many)
        table[cell[cell >= 0]] = n[cell >= 0]
        sizes[-1 - cell[cell < 0]] = n[cell < 0]
        return sizes, table.reshape(_WORDS, many)

    def leaf_words(self) -> tuple[np.ndarray, DataFrame]:
        """Documents of each leaf; of each slot the leaves whose documents have the word, with their number, as a table."""
        sent = self.spark.sparkContext.broadcast(self.tree)
        leaves = 1 << LEVELS

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree, table, sizes = sent.value, _Cells(), np.zeros(leaves, np.int64)
            for batch in batches:
                leaf = tree.leaves(_matrix(batch.column(1)))
                sizes += np.bincount(leaf, minlength=leaves)
                rows = [np.frombuffer(x, np.uint32) for x in batch.column(0).to_pylist()]
                if rows:
                    table.add(np.concatenate(rows).astype(np.int64) * leaves + np.repeat(leaf, [len(x) for x in rows]))
            used, n_used = table.settled()
            slot, leaf = np.concatenate([used // leaves, np.full(leaves, -1)]), np.concatenate([used % leaves, np.arange(leaves)])
            yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(leaf.astype(np.int32)), pa.array(np.concatenate([n_used, sizes]).astype(np.int64))], names=["slot", "leaf", "n"])

        rows = self.table.filter("octet_length(slots) > 0").select("slots", "vector").mapInArrow(count, "slot int, leaf int, n bigint")
        rows = materialize(rows.groupBy("slot", "leaf").agg(F.sum("n").alias("n")), "cells")
        of = rows.filter("slot < 0").select("leaf", "n").toArrow()  # a row for each leaf
        sizes = np.zeros(leaves)
        sizes[of["leaf"].to_numpy()] = of["n"].to_numpy()
        return sizes, rows.filter("slot >= 0 and n > 0")

    def leaf_terms(self, sizes: np.ndarray, cells: DataFrame) -> list[tuple[int, int, float]]:
        """(leaf, slot, weight) of each leaf's discriminative terms: the words that tell most about being in it."""
        total = float(sizes.sum())
        size = F.element_at(F.array(*[F.lit(float(x)) for x in sizes]), F.col("leaf") + 1)
        every = cells.groupBy("slot").agg(F.sum("n").alias("all"))
        inside = F.col("n") / size
        lift = inside / (F.col("all") / F.lit(total))
        scored = cells.join(every, "slot").filter(F.col("all") >= RARE).select("leaf", "slot", (inside * F.log(lift)).alias("weight")).filter("weight > 0")
        rank = F.row_number().over(Window.partitionBy("leaf").orderBy(F.desc("weight"), "slot"))
        return [tuple(r) for r in scored.withColumn("rank", rank).filter(F.col("rank") <= TERMS).select("leaf", "slot", "weight").collect()]  # TERMS rows for each leaf

    def leanings(self, sizes: np.ndarray, cells: DataFrame, of_leaf: np.ndarray) -> np.ndarray:
        """How far each word leans to each subject, through the leaves that it is more frequent in; 0 where it doesn't tell."""
        many = of_leaf.shape[1]
        sent = self.spark.sparkContext.broadcast((sizes, of_leaf))

        def lean(rows: pa.Table) -> pa.Table:
            sizes, of_leaf = sent.value
            slots, at = np.unique(rows["slot"].to_numpy(), return_inverse=True)
            rate = np.zeros((len(slots), len(sizes)))
            rate[at, rows["leaf"].to_numpy()] = rows["n"].to_numpy() / np.maximum(sizes[rows["leaf"].to_numpy()], 1)
            out = leanings(rate, of_leaf)
            used = np.flatnonzero(out.any(1))
            return pa.table({"slot": pa.array(slots[used].astype(np.int32)), "lean": pa.array([x.tobytes() for x in out[used]], pa.binary())})

        found = cells.withColumn("share", F.pmod(F.xxhash64("slot"), F.lit(64))).groupBy("share").applyInArrow(lean, "slot int, lean binary").toArrow()  # a row for each slot at most
        table = np.zeros((_WORDS, many), np.float32)
        if found.num_rows:
            table[found["slot"].to_numpy()] = np.stack([np.frombuffer(x, np.float32) for x in found["lean"].to_pylist()])
        return table


def term_subjects(sizes: np.ndarray, table: np.ndarray, named: list[np.ndarray]) -> np.ndarray:
    """Of each slot how its labelled documents are spread over the subjects, each taken as equally large.

    ``named`` has the slots of each subject's title and note, which count as some labelled documents of it.
    """
    usual = table.sum(1) / max(1.0, sizes.sum())
    rate = (table + PRIOR * usual[:, None]) / (sizes + PRIOR)
    for k, slots in enumerate(named):
        rate[slots, k] += NAMED / (sizes.mean() + PRIOR)
    return rate / np.maximum(rate.sum(1), 1e-12)[:, None]


def label_leaves(terms: list[tuple[int, int, float]], of_term: np.ndarray) -> np.ndarray:
    """The subjects of each leaf, by its discriminative terms."""
    out = np.full((1 << LEVELS, of_term.shape[1]), 1e-6)
    for leaf, slot, weight in terms:
        sharp = of_term[slot] ** 2
        out[leaf] += weight * sharp / max(1e-12, sharp.sum())
    out = (out / out.sum(1)[:, None]) ** 2
    return out / out.sum(1)[:, None]


def even_words(sizes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which words no labelled subject has much more often than the subjects have on average, however large each is."""
    sizes, table = sizes[sizes > 0], table[:, sizes > 0]
    if len(sizes) < 2:
        return np.zeros(len(table), bool)
    usual = table.sum(1) / sizes.sum()
    rate = (table + PRIOR * usual[:, None]) / (sizes + PRIOR)
    return (usual > 0) & (rate.max(1) <= EVEN * rate.mean(1))


def leanings(rate: np.ndarray, of_leaf: np.ndarray) -> np.ndarray:
    """Leanings of words with these rates in the leaves."""
    leaf = rate / np.maximum(rate.sum(1), 1e-12)[:, None]
    lift = (leaf @ of_leaf) / np.maximum(of_leaf.mean(0), 1e-9)
    lean = lift**SHARPEN
    lean /= np.maximum(lean.sum(1), 1e-12)[:, None]
    lean[lean.max(1) < TELLING] = 0
    return lean.astype(np.float32)


def shares_of(slots: list[bytes], counts: list[bytes], lean: np.ndarray) -> np.ndarray:
    """Of each document its mixture of subjects by words; zeros where no word tells."""
    out = np.zeros((len(slots), lean.shape[1]), np.float32)
    for k, (s, c) in enumerate(zip(slots, counts)):
        if s:
            out[k] = np.log1p(np.frombuffer(c, np.uint8)).astype(np.float32) @ lean[np.frombuffer(s, np.uint32)]
    total = out.sum(1)
    out /= np.maximum(total, 1e-9)[:, None]
    return out


def mixtures(words: np.ndarray, near: np.ndarray, of_leaf: np.ndarray, part: float) -> np.ndarray:
    """The mixture by words, and a ``part`` of it by the leaves that the document is near to."""
    out = (1 - part) * words + part * (near @ of_leaf)
    out[~words.any(1)] = 0.0
    return out


def assigned(shares: np.ndarray, threshold: float) -> np.ndarray:
    """Which subjects a document has: the largest share, and a second one that reaches the threshold."""
    order = np.argsort(-shares, axis=1, kind="stable")
    out = np.zeros(shares.shape, bool)
    rows = np.arange(len(shares))
    out[rows, order[:, 0]] = shares[rows, order[:, 0]] > 0
    if shares.shape[1] > 1:
        out[rows, order[:, 1]] = shares[rows, order[:, 1]] >= threshold
    return out


def subjects(documents: DataFrame, labels: DataFrame, areas: DataFrame, labelled: int = LABELLED) -> DataFrame:
    """doc_id, subject_id, share: the one or two subject areas of each document.

    ``labels`` has doc_id and subject_id, of which ``labelled`` documents are used, up to chance; ``areas`` has
    subject_id, and may have title and note.  Defined results: documents with fewer than LEAST_WORDS words, or without a telling word, have no row,
    nor have null ids; labels of unknown subjects or documents don't count; equal documents come out each; without
    labels there are no rows; ties go to the first subject_id; other columns are ignored; texts are read whole.
    """
    spark = documents.sparkSession
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, subject_id string, share double"
    told = areas.select("subject_id", *[F.coalesce(c, F.lit("")).alias(c) if c in areas.columns else F.lit("").alias(c) for c in ("title", "note")]).filter("subject_id is not null").collect()  # a few subjects
    names = sorted({r["subject_id"] for r in told})
    pairs = labels.select("doc_id", "subject_id").filter("doc_id is not null").filter(F.col("subject_id").isin(names)).distinct()
    every = max(1, -(-pairs.select("doc_id").distinct().count() // labelled))
    chosen = pairs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).groupBy("doc_id").agg(F.collect_set("subject_id").alias("subjects"))
    corpus = Corpus(documents, chosen, names)
    taught = corpus.table.join(chosen, "doc_id").filter("octet_length(slots) > 0").select(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)).alias("third"), "slots", "counts", "vector", "subjects").toArrow()
    if not taught.num_rows:
        return spark.createDataFrame([], schema)
    truth = np.array([[n in own for n in names] for own in taught["subjects"].to_pylist()], bool)
    slots, counts = taught["slots"].to_pylist(), taught["counts"].to_pylist()
    vectors = np.stack([np.frombuffer(v, np.float32) for v in taught["vector"].to_pylist()])
    near, leaf = corpus.tree.nearness(vectors), corpus.tree.leaves(vectors)
    named = [np.unique(document_words(*_lengths(pa.array([" ".join(f"{r['title']} {r['note']}" for r in told if r["subject_id"] == n).encode()], pa.large_binary())))[1]) for n in names]
    leaf_sizes, cells = corpus.leaf_words()
    terms = corpus.leaf_terms(leaf_sizes, cells)

    def learn(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The subjects of leaves and words, as these labelled documents teach them."""
        table, sizes = np.zeros((_WORDS, len(names))), truth[rows].sum(0).astype(float)
        for k in rows:
            table[np.frombuffer(slots[k], np.uint32)] += truth[k]
        of_leaf = AS_MANY * label_leaves(terms, term_subjects(sizes, table, named))
        np.add.at(of_leaf, leaf[rows], truth[rows] / truth[rows].sum(1)[:, None])
        of_leaf /= of_leaf.sum(1)[:, None]
        return of_leaf, corpus.leanings(leaf_sizes, cells, of_leaf)

    # a third of the labels is held out to choose the threshold and the part of nearness; then all of them teach
    held = np.flatnonzero(taught["third"].to_numpy() == 0)
    rest = np.setdiff1d(np.arange(len(truth)), held)
    threshold, part = 0.25, PARTS[0]
    if len(held) and len(rest):
        of_leaf, lean = learn(rest)
        words = shares_of([slots[k] for k in held], [counts[k] for k in held], lean)
        tried = []
        for p in PARTS:
            mixed = mixtures(words, near[held], of_leaf, p)
            for t in (0.15, 0.2, 0.25, 0.3, 0.35, 0.4):
                found = assigned(mixed, t)
                tried.append((2 * (found & truth[held]).sum() / max(1, found.sum() + truth[held].sum()), -p, -t))
        best = max(tried)[0]
        # some labels are missing, which makes a second subject look wrong: of nearly equal choices the lowest threshold
        threshold, part = min((-t, -p) for f1, p, t in tried if f1 >= best - NEARLY)
    of_leaf, lean = learn(np.arange(len(truth)))
    sent = spark.sparkContext.broadcast((names, lean, of_leaf, corpus.tree, part, threshold))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, lean, of_leaf, tree, part, threshold = sent.value
        for batch in batches:
            words = shares_of(batch.column(1).to_pylist(), batch.column(2).to_pylist(), lean)
            shares = mixtures(words, tree.nearness(_matrix(batch.column(3))), of_leaf, part)
            row, subject = np.nonzero(assigned(shares, threshold))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array([names[k] for k in subject], pa.string()), pa.array(shares[row, subject].astype(float))], names=["doc_id", "subject_id", "share"])

    return corpus.table.filter(f"words >= {LEAST_WORDS}").select("doc_id", "slots", "counts", "vector").mapInArrow(assign, schema)
