"""Repeats of earlier notes, batch by batch.

Each distinct content is a *class*: the sequence of its words after folding of case, spacing, punctuation and markup.
The classes of a batch are fingerprinted: a hash of the whole, and hashes of neighbouring identifying words (numbers,
references, component names), thinned by winnowing.  Fingerprints that occur once in the batch and that a partitioned
Bloom filter of the history doesn't know are dropped; the others are looked up in the persistent fingerprint store, and
the classes found there are verified by how much of the two word sequences is shared, in order.  Then store and filter
take up the batch.

Every batch adds one version of the store.  Its fingerprints and its words are in buckets of a bounded size, as many as
the batch needs, each with its part of the filter; a later batch reads the buckets that its positive fingerprints and
their classes fall in, and no other.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.sources.shared import discard, materialize, new_path
from mnemora.sources.versions import Manifest

LEAST_CHARS = 20
#: Words that may differ: so many, or this part of the longer note; words of a tag before or after a note.
CHANGED_WORDS, CHANGED_PART, TAG_WORDS = 2, 0.2, 4
#: Winnowing: of so many neighbouring fingerprints at least one is kept.
WINDOW = 4
#: Fingerprints and classes of a bucket; bits of the Bloom filter for each fingerprint, and hashes.
BUCKET, CLASSES, BITS_EACH, HASHES = 65_536, 32_768, 16, 4
#: Up to so many buckets each task writes its rows into all of them; beyond, rows are brought together by bucket first.
LAYOUT = 64
#: Notes of so many words without two identifying ones are found by what is left of them without one or two words.
SHORT = 8

_WORD = re.compile(r"[^\W_]+(?:[-._][^\W_]+)*")
_MARKUP = re.compile(r"</?[a-zA-Z][^<>]*>")
_ENDED = re.compile(r"[.!?;:)\]}\"'`*>|]\s*$")
_M64 = (1 << 64) - 1

_SKETCH = "class bigint, prints array<struct<print: bigint, sig: bigint>>, words array<int>, strict array<int>, open string"


def _signed(x: int) -> int:
    x &= _M64
    return x - (1 << 64) if x >> 63 else x


def _identifying(word: str) -> bool:
    return "-" in word or "_" in word or "." in word or any(map(str.isdigit, word))


def _mix(a: int, b: int) -> int:
    return ((a ^ (a >> 29)) * 0x9E3779B97F4A7C15 + b * 0xD6E8FEB86659FD93) & _M64


def _sequence(hashes: list[int]) -> int:
    return xxhash.xxh3_64_intdigest(np.array(hashes, np.uint64).tobytes())


def _grams(hashes: list[int], strict: list[int]) -> set[int]:
    """Pairs of neighbouring identifying words, winnowed; of a note with fewer than two, triples of words or what is left of it without one or two."""
    if len(strict) >= 2:
        grams = [_mix(a, b) for a, b in zip(strict, strict[1:])]
        return {min(grams[k : k + WINDOW]) for k in range(max(1, len(grams) - WINDOW + 1))}
    if len(hashes) > SHORT:
        return {_mix(_mix(a, b), c) for a, b, c in zip(hashes, hashes[1:], hashes[2:])}
    n = len(hashes)
    less = [hashes[:i] + hashes[i + 1 :] for i in range(n)] + [hashes[:i] + hashes[i + 1 : j] + hashes[j + 1 :] for i in range(n) for j in range(i + 1, n)]
    return {_sequence(x) for x in [hashes, *less] if x}


def sketch(content: str, seen: dict[str, tuple[int, bool]] | None = None) -> tuple[int, list[tuple[int, int]], list[int], list[int], str | None]:
    """Class, fingerprints with the signature of the identifying words, all words and the identifying ones, open word.

    A note that ends without an end in an identifying word may have lost a part of that word, its *open* word; it has
    each fingerprint for its signature with and without it.
    """
    seen = {} if seen is None else seen
    text = unicodedata.normalize("NFKC", content)
    if "<" in text:
        text = _MARKUP.sub(" ", text)
    text = text.lower().replace("&", " and ")
    hashes, strict, last = [], [], ""
    for word in _WORD.findall(text):
        known = seen.get(word)
        if known is None:
            if len(seen) > 500_000:
                seen.clear()
            known = seen[word] = (xxhash.xxh3_64_intdigest(word), _identifying(word))
        hashes.append(known[0])
        last = word
        if known[1]:
            strict.append(known[0])
    open_ = last if strict and strict[-1] == hashes[-1] and not _ENDED.search(content) else None
    whole = _sequence(hashes)
    prints = set()
    for firm in (strict, strict[:-1]) if open_ else (strict,):
        sig = _signed(sum(firm))
        prints |= {(_signed(k), sig) for k in _grams(hashes, firm)}
    return _signed(whole), sorted(prints), [h & 0x7FFFFFFF for h in hashes], [h & 0x7FFFFFFF for h in strict], open_


_PRINTS = pa.list_(pa.struct([("print", pa.int64()), ("sig", pa.int64())]))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, tuple[int, bool]] = {}
    for batch in batches:
        rows = [sketch(c, seen) for c in batch.column(2).to_pylist()]
        whole, prints, words, strict, open_ = zip(*rows) if rows else ((),) * 5
        sizes = np.cumsum([0, *map(len, prints)])
        flat = [p for x in prints for p in x]
        pairs = pa.StructArray.from_arrays([pa.array([p[0] for p in flat], pa.int64()), pa.array([p[1] for p in flat], pa.int64())], names=["print", "sig"])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(whole, pa.int64()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pairs), pa.array(words, pa.list_(pa.int32())), pa.array(strict, pa.list_(pa.int32())), pa.array(open_, pa.string())],
            names=["id", "at", "class", "prints", "words", "strict", "open"],
        )


def shared(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bits of one integer."""
    places: dict[int, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    left = full
    for w in b:
        met = left & places.get(w, 0)
        left = ((left + met) | (left - met)) & full
    return len(a) - left.bit_count()


def repeats(a: list[int], b: list[int], strict_a: list[int], strict_b: list[int], open_a: str | None, open_b: str | None) -> bool:
    """Whether two notes are one: the same identifying words, and all but a few words shared in order.

    The open word of a note may be a part of the other's.
    """
    if sorted(strict_a) != sorted(strict_b):
        if not (open_a and open_b and (open_a.startswith(open_b) or open_b.startswith(open_a)) and sorted(strict_a[:-1]) == sorted(strict_b[:-1])):
            return False
        a, b = a[:-1], b[:-1]
    n, m = len(a), len(b)
    longer, shorter = (a, b) if n >= m else (b, a)
    more = abs(n - m)
    if more <= TAG_WORDS and (longer[: len(shorter)] == shorter or longer[more:] == shorter):
        return True
    least = max(n, m) - max(CHANGED_WORDS, int(max(n, m) * CHANGED_PART))
    return min(n, m) >= least and shared(a, b) >= least


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(1, 7)]
        good = [k for k, x in enumerate(zip(*columns)) if repeats(*x)]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good, pa.int64()))], names=["class"])


def _places(prints: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = prints.astype(np.uint64)
        a = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        b = ((x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
        return np.stack([((a + np.uint64(k) * b) >> np.uint64(20)) % np.uint64(bits) for k in range(HASHES)]).astype(np.int64)


def _test(prints: pa.Table, filters: pa.Table) -> pa.Table:
    """Of one bucket: the fingerprints that the filter of the history knows."""
    values = prints.column("print").to_numpy()
    known = np.zeros(len(values), bool)
    for bits in filters.column("bits").to_pylist():
        array = np.frombuffer(bits, np.uint8)
        places = _places(values, 8 * len(array))
        known |= ((array[places >> 3] >> (places & 7)) & 1).all(0)
    return pa.table({"print": pa.array(values[known], pa.int64()), "bucket": prints.column("bucket").filter(pa.array(known)).cast(pa.int32())})


def _build(prints: pa.Table) -> pa.Table:
    """Of one bucket: a filter of its fingerprints, as large as they are many."""
    values = np.unique(prints.column("print").to_numpy())
    size = max(1 << 10, 1 << int(np.ceil(np.log2(max(1, len(values)) * BITS_EACH))))
    bits = np.zeros(size, np.uint8)
    bits[_places(values, size).ravel()] = 1
    return pa.table({"bucket": prints.column("bucket")[:1].cast(pa.int32()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})


def _bucket(c: str, n: int):
    return F.pmod(F.xxhash64(c), F.lit(n)).cast("int")


class NoteHistory:
    """All notes accepted so far, in ``path``; :meth:`merge` adds a batch and returns its repeats.

    A batch has ``id`` (string), ``at`` (bigint ms) and ``content`` (string).  A note repeats an earlier one (by at,
    then id) if the identifying words of both are the same, as a bag, and the words, in order, differ in no more than
    CHANGED_WORDS, or CHANGED_PART of the longer note's words, or in a tag of up to TAG_WORDS words before or after.

    Defined results: rows with a null in a column and contents under LEAST_CHARS characters are neither repeats nor
    history; deliveries of one id are one note, in whatever batch they come; of equal contents the earliest is no
    repeat; an empty batch has no repeats.  Notes of any length are read whole.  A stored note that repeats one which
    comes later with an earlier time isn't reported again.
    """

    _NOTES = "class bigint, first struct<at: bigint, id: string>, words array<int>, strict array<int>, open string"
    _PRINTS = "print bigint, sig bigint, at bigint, class bigint"

    def __init__(self, spark: SparkSession, path: str, bucket: int = BUCKET, classes: int = CLASSES):
        self.spark, self.path, self.bucket, self.classes = spark, path.rstrip("/"), bucket, classes
        self.manifest = Manifest(spark, self.path)

    def _load(self, kind: str, schema: str, paths: list[str]) -> DataFrame:
        paths = [f"{self.path}/{kind}/{p}" for p in paths]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _buckets(self, kind: str, schema: str, touched: list) -> DataFrame:
        """The rows of these (version, bucket), and of no other bucket."""
        out = self.spark.createDataFrame([], schema)
        of: dict[int, list[int]] = {}
        for r in touched:
            of.setdefault(r["n"], []).append(r["bucket"])
        for n, buckets in sorted(of.items()):
            one = self.spark.read.schema(schema + ", bucket int").parquet(f"{self.path}/{kind}/v{n}").filter(F.col("bucket").isin(buckets)).drop("bucket")
            out = out.unionByName(one)
        return out

    def merge(self, batch: DataFrame) -> DataFrame:
        """id of each repeat in the batch."""
        version, content = self.manifest.read()
        before, version = content.get("versions", []), version + 1
        notes = batch.select("id", "at", "content").filter(f"id is not null and at is not null and length(content) >= {LEAST_CHARS}")
        day = F.floor(F.col("at") / 86_400_000).cast("int")
        days = [r[0] for r in notes.select(day).distinct().collect()]  # one row for each day of the batch
        if before:
            seen = [f"v{v['n']}/day={d}" for v in before for d in days if d in v["days"]]
            if seen:
                notes = notes.join(self._load("ids", "id string", seen), "id", "left_anti")
        sketches, schema = new_path(self.spark, "sketches"), "id string, at bigint, " + _SKETCH
        notes.mapInArrow(_sketches, schema).write.option("compression", "zstd").parquet(sketches)
        members = self.spark.read.schema(schema).parquet(sketches)
        parts = max(1, -(-members.count() // self.classes))
        first = F.min(F.struct("at", "id")).alias("first")
        rest = F.min_by(F.struct("prints", "words", "strict", "open"), F.struct("at", "id")).alias("x")
        classes = members.groupBy("class").agg(first, rest).select("class", "first", "x.*", _bucket("class", parts).alias("bucket"))
        # the batch's part of the store is written at once; it holds classes that the store has as well
        (classes if parts <= LAYOUT else classes.repartition("bucket")).write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/notes/v{version}")
        classes = self.spark.read.schema("class bigint, first struct<at: bigint, id: string>, prints array<struct<print: bigint, sig: bigint>>, words array<int>, strict array<int>, open string").parquet(f"{self.path}/notes/v{version}")
        members = materialize(members.select("id", "at", "class"), "members")
        discard(self.spark, sketches)  # all that is read below is in the two tables
        prints, buckets = self._write_prints(classes, version)
        own = prints.filter("not (print = class and sig = 0)")
        old = self._looked_up(prints, before).distinct()
        same = old.filter("print = class and sig = 0").select("class").distinct()  # the whole content was there before
        own = own.select("print", "sig", "at", "class", F.lit(True).alias("own"))
        entries = own
        if before:
            # a content that the store has counts from when it came first
            entries = own.join(same, "class", "left_anti").unionByName(old.filter("not (print = class and sig = 0)").withColumn("own", F.lit(False)))
        # what shares a fingerprint and a signature with others; of these the earliest leads
        groups = entries.groupBy("print", "sig").agg(F.min("at").alias("lead_at"), F.count("*").alias("n")).filter("n > 1")
        near = materialize(entries.join(groups, ["print", "sig"]), "near")
        lead = near.filter("at = lead_at").groupBy("print", "sig").agg(F.min("class").alias("lead"))
        # the classes of a group may be many near-copies: each is held against the leading one first
        met = materialize(near.filter("own").join(lead, ["print", "sig"]).filter("class <> lead").select("print", "sig", "class", "at", "lead", "lead_at", "n"), "met")
        here = met.select("class", F.col("lead").alias("old"))
        # of classes of one instant the id says which is the earlier: both ways are tried, and one is left below
        here = here.unionByName(met.filter("at = lead_at").select(F.col("lead").alias("class"), F.col("class").alias("old"))).distinct()
        # the words of whatever shares a fingerprint, once for all comparisons
        words = materialize(self._words(classes.join(same, "class", "left_anti") if before else classes, old if before else None, before).join(near.select("class").distinct(), "class", "left_semi"), "words")
        by_lead = self._verified(here, words)
        by_lead = materialize(same.union(by_lead).distinct() if before else by_lead, "verified")
        # what isn't near the earliest may be near another one
        others = met.filter("n > 2").join(by_lead, "class", "left_anti").select("print", "sig", "class", F.col("at").alias("then"), "lead")
        earlier = near.select("print", "sig", F.col("class").alias("old"), "at")
        pairs = others.join(earlier, ["print", "sig"]).filter("at <= then and old <> lead and old <> class")
        repeated = by_lead.union(self._verified(pairs.select("class", "old").distinct(), words)).distinct()
        starts = classes.select("class", F.col("first.id").alias("id"))
        later_ones = members.select("class", "id").distinct().join(starts, ["class", "id"], "left_anti").select("id")
        result = materialize(later_ones.union(starts.join(repeated, "class", "left_semi").select("id")).distinct(), "repeats")
        prints.select("print", "bucket").groupBy("bucket").applyInArrow(_build, "bucket int, bits binary").write.mode("overwrite").parquet(f"{self.path}/filters/v{version}")
        ids = members.select("id", day.alias("day"))
        ids.write.mode("overwrite").option("compression", "zstd").partitionBy("day").parquet(f"{self.path}/ids/v{version}")
        self.manifest.commit(version, {"versions": [*before, {"n": version, "buckets": buckets, "classes": parts, "days": days}]})
        return result

    def _write_prints(self, classes: DataFrame, version: int) -> tuple[DataFrame, int]:
        """The batch's part of the fingerprint store, the hash of the whole among them, and its number of buckets."""
        all_ = F.concat("prints", F.array(F.struct(F.col("class").alias("print"), F.lit(0).cast("bigint").alias("sig"))))
        n = classes.agg(F.coalesce(F.sum(F.size("prints") + 1), F.lit(0))).first()[0]
        buckets = max(1, -(-n // self.bucket))
        new = classes.select(F.explode(all_).alias("p"), F.col("first.at").alias("at"), "class").select("p.print", "p.sig", "at", "class", _bucket("p.print", buckets).alias("bucket"))
        path = f"{self.path}/prints/v{version}"
        (new if buckets <= LAYOUT else new.repartition("bucket")).write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(path)
        return self.spark.read.schema(self._PRINTS + ", bucket int").parquet(path), buckets

    def _looked_up(self, prints: DataFrame, before: list[dict]) -> DataFrame:
        """Stored entries of the batch's fingerprints and classes, out of the buckets that the filters let through."""
        if not before:
            return self._load("prints", self._PRINTS, [])
        asked = prints.select("print").distinct()
        positive, sizes = None, {v["n"]: v["buckets"] for v in before}
        for n, buckets in sizes.items():
            filters = self._load("filters", "bucket int, bits binary", [f"v{n}"])
            one = asked.withColumn("bucket", _bucket("print", buckets)).groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(_test, "print bigint, bucket int").withColumn("n", F.lit(n))
            positive = one if positive is None else positive.unionByName(one)
        positive = materialize(positive, "positive")
        touched = positive.select("n", "bucket").distinct().collect()  # one row for each bucket of the store at most
        found = self._buckets("prints", self._PRINTS, touched).join(positive.select("print").distinct(), "print", "left_semi")
        return materialize(found, "found")

    def _words(self, classes: DataFrame, old: DataFrame | None, before: list[dict]) -> DataFrame:
        """First place and words of the batch's classes and of those found in the store, out of the buckets that hold these."""
        words = classes.select("class", "first", "words", "strict", "open")
        if old is None:
            return words
        wanted = old.select("class").distinct()
        places = F.explode(F.array(*[F.struct(F.lit(v["n"]).alias("n"), _bucket("class", v["classes"]).alias("bucket")) for v in before]))
        touched = wanted.select(places.alias("x")).select("x.*").distinct().collect()  # one row for each bucket of the store at most
        stored = self._buckets("notes", self._NOTES, touched).join(wanted, "class", "left_semi")
        return words.unionByName(stored.dropDuplicates(["class"]))

    @staticmethod
    def _verified(pairs: DataFrame, words: DataFrame) -> DataFrame:
        """class of each that repeats an earlier ``old``."""
        a = words.select("class", F.col("first").alias("fa"), F.col("words").alias("a"), F.col("strict").alias("sa"), F.col("open").alias("oa"))
        b = words.select(F.col("class").alias("old"), F.col("first").alias("fb"), F.col("words").alias("b"), F.col("strict").alias("sb"), F.col("open").alias("ob"))
        return pairs.join(a, "class").join(b, "old").filter("fa > fb").select("class", "a", "b", "sa", "sb", "oa", "ob").mapInArrow(_verify, "class bigint").distinct()
