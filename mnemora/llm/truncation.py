"""Texts that lost their end.

Values are cut at random places to make positives; the values as they are make the negatives.  A logistic regression on
hashed features of the end (last words, closing characters, open brackets and quotes, length up to the limits of the
source) learns how much likelier an end is among cut values than among stored ones.  As a few of the stored values are
themselves cut, the odds of a cut value stay finite.  The threshold on the odds is the one with the best F1: recall is
measured on artificial cuts, and the number found is that of the stored values, so that no label is needed.

A feature is the CRC-32 of a string.  What a value and its cuts have in common is found once, and the strings are never
made: the CRCs of their parts are put together for many rows at once.

All values take part in all of this.  The features of every value and of what is made from it are written to the shared
folder, in halves and each half in shards of a bounded size.  A shard is fitted by itself, and a weight of the half's
model is the mean of those of its shards, by how many rows of each have the feature.  A half is judged by the model of
the other one only: in the fit, for the threshold and in the result.
"""

from __future__ import annotations

import random
import re
import zlib
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.sources.shared import Parts, new_path

#: Cuts of each value, and bits of the vocabulary and feature tables.
CUTS = 2
WORD_BITS, FEATURE_BITS = 18, 18
#: Values of a shard; rows that its fit reads, the same ones again if there are fewer, but no more than so many times.
SHARD, FIT_ROWS, MOST_ROUNDS = 100_000, 500_000, 10
#: The threshold on the odds where nothing could be cut; steps of a log odd in which the scores are counted.
ODDS, STEP = 0.35, 1 / 64
#: What a row of features is: a value as it is, a cut of one that ends in a full stop or of another, one without its
#: full stop, a blank value.
STORED, CUT, CUT_OTHER, WHOLE, BLANK = range(5)
#: Share of a source's values that have one and the same length, from which that length may be a limit.
LIMIT_SHARE = 0.004

#: Zeros that are put behind a CRC by one table, a power of two; strings of a kind that a reader remembers; values read in one go.
FEW, REMEMBERED, STEP_VALUES = 64, 200_000, 4_096
#: Marks of omission behind a cut text (fixed forms).
MARK = re.compile(r"\s*(?:\[(?:\.\.\.|…|cut|snip|truncated)\]|\((?:\.\.\.|…|cut|truncated)\)|<(?:cut|truncated|snip)>|…|\.\.\.+)\s*$", re.I)
#: Characters of the longest mark in brackets.
LONGEST_MARK = len("[truncated]")
_TOKEN = re.compile(r"[^\W_]+(?:[-._/:@][^\W_]+)*|[^\w\s]")
_REFERENCE = re.compile(r"[a-z]+-\d+(?:-\d+)*$")
_SENTENCE = re.compile(r"[.!?]['\")\]”»]*\s+|\n")
_STOP = re.compile(r"[.!?]['\")\]”»*`]*(?=\s)")
_ONE, _EIGHT = re.compile(r"\W*\w"), re.compile(r"(?:\W*\w){8}")
_OPENING = re.compile(r'[(\[{“«"`]')


def _stopped(text: str) -> bool:
    """Whether ``text`` ends in a full stop, apart from closing characters and spaces."""
    return not text[-1:].isalnum() and text.rstrip().rstrip("'\")]”»*`").endswith((".", "!", "?"))


def _slot(text: str, bits: int) -> int:
    return zlib.crc32(text.encode()) & ((1 << bits) - 1)


def _plain(token: str) -> str | None:
    """The class of a token that stands for many, None for a word that stands for itself."""
    if token.isdigit():
        return "<n>"
    if _REFERENCE.match(token):
        return "<r>"
    if any(map(str.isdigit, token)):
        return "<m>"
    return None


@cache
def _zeros(bit: int) -> np.ndarray:
    """The table of four times 256 that turns a CRC-32 into that of the same bytes and 2 ** ``bit`` zeros behind them."""
    if bit:
        half = _zeros(bit - 1)
        return _through(half, half)
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = (c >> 1) ^ np.where(c & 1, np.uint32(0xEDB88320), np.uint32(0))
    bytes_ = np.arange(256, dtype=np.uint32) << np.array([[0], [8], [16], [24]], np.uint32)
    return (bytes_ >> 8) ^ c[bytes_ & 255]


def _through(table: np.ndarray, c: np.ndarray) -> np.ndarray:
    return table[0][c & 255] ^ table[1][c >> 8 & 255] ^ table[2][c >> 16 & 255] ^ table[3][c >> 24]


@cache
def _few_zeros() -> np.ndarray:
    """Tables like those of _zeros for 0 to FEW - 1 zeros."""
    tables = [np.arange(256, dtype=np.uint32) << np.array([[0], [8], [16], [24]], np.uint32)]
    while len(tables) < FEW:
        tables.append(_through(_zeros(0), tables[-1]))
    return np.stack(tables)


class Strings:
    """A string of each row, known by CRC-32 and bytes only, which is enough to put strings together."""

    def __init__(self, crc: np.ndarray, size: np.ndarray):
        self.crc, self.size = crc, size

    def _add(self, moved: np.ndarray, more: np.ndarray) -> None:
        """To CRCs behind which fewer than FEW zeros were put, add the others of ``more``."""
        bit = FEW.bit_length() - 1
        rest = more >> bit
        while rest.any():
            odd = np.flatnonzero(rest & 1)
            moved[odd] = _through(_zeros(bit), moved[odd])
            rest, bit = rest >> 1, bit + 1

    def __add__(self, other: Strings) -> Strings:
        at, tables = (other.size & (FEW - 1)) << 10, _few_zeros().ravel()
        moved = tables.take(at + (self.crc & 255))
        for k in (1, 2, 3):
            moved ^= tables.take(at + (k << 8) + (self.crc >> np.uint32(8 * k) & 255))
        self._add(moved, other.size)
        return Strings(moved ^ other.crc, self.size + other.size)

    def __radd__(self, before: str) -> Strings:
        crc = zlib.crc32(before.encode())
        tables = _few_zeros()
        moved = (tables[:, 0, crc & 255] ^ tables[:, 1, crc >> 8 & 255] ^ tables[:, 2, crc >> 16 & 255] ^ tables[:, 3, crc >> 24]).take(self.size & (FEW - 1))
        self._add(moved, self.size)
        return Strings(moved ^ self.crc, self.size + len(before.encode()))


def _body(text: str) -> tuple[str, bool]:
    """``text`` without spaces and a mark of omission (MARK) at its end, and whether it had one."""
    body = text.rstrip()
    last = body[-1:]
    if last == "…":
        return body[:-1].rstrip(), True
    if last == ".":
        return (body.rstrip(".").rstrip(), True) if body.endswith("...") else (body, False)
    if last and last in "])>":
        mark = MARK.search(body, max(0, len(body) - LONGEST_MARK))
        if mark:
            return body[: mark.start()].rstrip(), True
    return body, False


def _head(line: str) -> str:
    """The first character of a line, or the class of letters that it belongs to."""
    head = line.lstrip()[:1]
    return head if not head.isalpha() else ("A" if head.isupper() else "a")


def _kind(text: str) -> str:
    return "`" if "```" in text[:8] else text[:1] if text[:1] in "{[<#*>|-" else ""


class Value:
    """Where sentences, lines and stops of a text are; the same places count for any beginning of it."""

    def __init__(self, text: str):
        self.sentences = [0, *[x.end() for x in _SENTENCE.finditer(text)]]
        self.stops = [x.end() for x in _STOP.finditer(text)]
        opening = _OPENING.search(text)
        self.opening = opening.start() if opening else len(text)
        self.kind = _kind(text)
        # of each line: its place, its head, and how many lines before it aren't blank, and end in a full stop
        self.lines, self.heads, self.filled, self.closed = [0], [_head(text)], [0], [0]
        if "\n" in text:
            lines = text.split("\n")
            self.heads = [_head(x) for x in lines]
            for line in lines[:-1]:
                self.lines.append(self.lines[-1] + len(line) + 1)
                self.filled.append(self.filled[-1] + (line.strip() != ""))
                self.closed.append(self.closed[-1] + _stopped(line))


class _Kept(dict):
    """What a function gives for its argument, kept."""

    def __init__(self, function):
        super().__init__()
        self.function = function

    def __missing__(self, key):
        found = self[key] = self.function(key)
        return found


class Reader:
    """Features of the ends of texts."""

    def __init__(self, counts: np.ndarray, limits: dict[str, list[int]]):
        self.counts, self.limits = counts, limits
        self._forget()

    def _forget(self) -> None:
        self._crc, self._size = array("I"), array("q")
        self._pieces = _Kept(self._piece)
        for k in range(-1, 25):  # the piece of a small number is one more than itself
            self._pieces[str(k)]
        self._names, self._finals, self._classes = _Kept(self._named), _Kept(self._final), _Kept(self._class)

    def _piece(self, text: str) -> int:
        data = text.encode()
        self._crc.append(zlib.crc32(data))
        self._size.append(len(data))
        return len(self._crc) - 1

    def _name(self, token: str) -> str:
        plain = _plain(token)
        if plain:
            return plain
        if not token[0].isalnum():
            return token
        known = self.counts[_slot(token, WORD_BITS)]
        if known < 3:
            return "<?+>" if any(c in token for c in "-._/") else "<?>"
        return "<c>" if any(c in token for c in "-._/") else token

    def _named(self, part: str) -> tuple[int, ...]:
        """The pieces of the names of the tokens of a part without white space."""
        return tuple(self._pieces[self._name(t)] for t in _TOKEN.findall(part))

    def _final(self, part: str) -> tuple[int, int]:
        """Of its last token: the pieces of how often it is known and of its last characters."""
        token = _TOKEN.findall(part)[-1]
        known = int(self.counts[_slot(token, WORD_BITS)])
        return (min(8, known.bit_length()) if token[0].isalnum() and not _plain(token) else -1) + 1, self._pieces[token[-3:]]

    def _class(self, key: tuple) -> tuple[int, ...]:
        end, closing, marked, head, open_, limit, kind, lines, before, closed = key
        # how the sentences and lines before the last one end
        style = "-" if not before else "a" if closed == before else "s" if closed else "n"
        said = (end, closing, "m" if marked else "-", head, open_, limit, kind + ("n" if lines else ""), style)
        return tuple(self._pieces[x] for x in said)

    def row(self, value: Value, text: str, source: str | None) -> tuple[int, ...]:
        """The pieces that features are made of, of a ``text`` that is a beginning of ``value``, apart from a mark."""
        if len(self._names) > REMEMBERED:  # the pieces stay, as rows that weren't put together yet have them
            self._names.clear()
            self._finals.clear()
        body, marked = _body(text)
        n, none = len(body), self._pieces[""]
        sentences, lines, at = value.sentences, value.lines, 0
        parts = body[sentences[bisect_left(sentences, n, 1) - 1] :].lower().split()
        names = list(chain.from_iterable(map(self._names.__getitem__, parts)))
        many = len(names)
        if many > 4:
            words, first = names[-5:], (names[0], names[1], self._pieces[" "])
        else:
            words = [self._pieces["^"]] * (5 - many) + names
            first = (names[0], names[1], self._pieces[" "]) if many > 1 else (*names, *[none] * (3 - many))
        while parts and not self._names[parts[-1]]:
            parts.pop()
        bucket, final = self._finals[parts[-1]] if parts else (0, none)
        end = body[-1:]
        if end.isalnum():
            end = closing = "0" if end.isdigit() else "a"
        else:
            closing = "." if _stopped(body) else end
        if len(lines) > 1:
            at = bisect_left(lines, n, 1) - 1
        open_ = limit = ""
        if value.opening < n:
            open_ = "".join([a for a, b in ("()", "[]", "{}", "“”", "«»") if body.count(a) > body.count(b)] + [q for q in '"`' if body.count(q) % 2])
        for most in self.limits.get(source or "", ()):
            if 0 <= most - len(text) <= 16:
                limit = str(min(3, (most - len(text)) // 4)) if most != len(text) else "="
        kind = value.kind if n > 7 else _kind(body)
        classes = self._classes[end, closing, marked, value.heads[at] if n else "", open_, limit, kind, at > 0, value.filled[at], value.closed[at]]
        short = self._pieces[body.lower()] if n < 25 else none
        return (*words, *first, min(many, 12) + 1, min(many, 24) + 1, bucket, final, *classes, min(4, bisect_left(value.stops, n)) + 1, min(3, body.count(",")) + 1, min(12, n // 16) + 1, short)

    def features(self, rows: list[tuple[int, ...]]) -> np.ndarray:
        """The features of rows: slots of named strings."""
        places = np.array(rows, np.int64).T
        crcs, sizes = np.array(self._crc, np.uint32), np.array(self._size, np.int64)
        e, d, c, b, a, first, second, between, many, more, bucket, final, end, closing, m, head, open_, limit, kind, style, stops, commas, length, short = (Strings(crcs[x], sizes[x]) for x in places)
        start = first + (between + second)
        style = stops + (style + (closing + m))
        endm = end + m
        spaced = " " + a
        ab = b + spaced
        spaced_ab = " " + ab
        abc = c + spaced_ab
        abcd = d + (" " + abc)
        said = [
            "p " + style,
            "q " + (style + bucket),
            "r " + (style + a),
            "v " + (style + (commas + kind)),
            "w " + (style + (" " + (start + (" " + many)))),
            "end " + endm,
            "1 " + (a + endm),
            "2 " + ab,
            "3 " + abc,
            "4 " + abcd,
            "5 " + (e + (" " + abcd)),
            "s " + (start + spaced),
            "t " + (start + spaced_ab),
            "u " + (start + (" " + more)),
            "k " + (bucket + end),
            "K " + (bucket + b),
            "o " + open_,
            "l " + (limit + end),
            "h " + (head + (end + kind)),
            "c " + (final + endm),
            "n " + (length + end),
            "m " + (m + kind),
            "z " + short,
        ]
        mask = (1 << FEATURE_BITS) - 1
        slots = np.empty((len(rows), len(said) + 1), np.int32)
        for k, x in enumerate(said):
            slots[:, k] = x.crc & mask
        slots[:, -1] = _slot("bias", FEATURE_BITS)
        if len(self._pieces) + len(self._classes) > REMEMBERED:
            self._forget()
        return slots


def _loses(text: str, at: int, least: int = 1) -> bool:
    """Whether a cut at ``at`` loses the end of a sentence or of a line, ``least`` (1 or 8) word characters of it."""
    if _stopped(text[:at]) or "\n" in text[at - 1 : at + 1]:
        return False
    end = _SENTENCE.search(text, at)
    return (_ONE if least == 1 else _EIGHT).match(text, at, end.start() if end else len(text)) is not None


def _marked(kept: str, chance: random.Random) -> str:
    kind = chance.random()
    if kind < 0.15:
        return kept.rstrip() + "…"
    if kind < 0.28:
        return kept.rstrip() + "..."
    if kind < 0.34:
        return kept.rstrip() + " [...]"
    if kind < 0.55 and " " in kept[20:]:  # cut at the word's end
        return kept.rsplit(" ", 1)[0]
    return kept


def _cut(text: str, chance: random.Random) -> str | None:
    """``text`` without its end, sometimes with a mark of omission; None where no cut loses anything."""
    if len(text) < 24:
        return None
    least = 1 if _stopped(text) else 8  # what has no full stop may end in any digit of its last number
    for _ in range(8):
        at = chance.randint(12, len(text) - 1)
        if _loses(text, at, least):
            return _marked(text[:at], chance)
    return None


def _whole(text: str) -> str | None:
    """The first sentence of ``text`` without the full stop."""
    end = _STOP.search(text + " ")
    return text[: end.start()] if end and end.start() >= 12 else None


def _regress(x: np.ndarray, y: np.ndarray, c: np.ndarray, rounds: int, seed: int) -> np.ndarray:
    used = np.zeros(1 << FEATURE_BITS, bool)
    used[x.ravel()] = True
    x = (np.cumsum(used) - 1)[x]  # only the weights that are used are gone through
    w, squares = np.zeros(np.count_nonzero(used)), np.full(np.count_nonzero(used), 1e-4)
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        for part in np.array_split(order.permutation(len(x)), max(1, len(x) // 1024)):
            xb = x[part]
            p = 1 / (1 + np.exp(-w[xb].sum(1)))
            g = np.bincount(xb.ravel(), np.repeat(c[part] * (p - y[part]), x.shape[1]), minlength=len(w))
            touched = np.flatnonzero(g != 0)
            wt = w[touched]
            gt = g[touched] / len(part) + 2e-6 * wt
            st = squares[touched] + gt * gt
            squares[touched] = st
            w[touched] = wt - 0.15 * gt / np.sqrt(st)
    whole = np.zeros(1 << FEATURE_BITS)
    whole[used] = w
    return whole


def _made(text: str, source: str, places: list[tuple[str, int]], chance: random.Random) -> Iterator[tuple[int, str, str]]:
    """Kind, text and source of what is made from a value: cuts and its first sentence without the full stop."""
    text = text.rstrip()
    if _body(text)[1]:
        return
    kind = CUT if _stopped(text) else CUT_OTHER
    for _ in range(CUTS if kind == CUT else 1):  # lists, code, logs and titles are cut, too
        kept = _cut(text, chance)
        if kept:
            yield kind, kept, source
    longer = [(s, at) for s, at in places if len(text) > at + 8]
    if longer:  # as the source with that limit would have cut it
        other, at = chance.choice(longer)
        if _loses(text, at):
            yield kind, _marked(text[:at], chance), other
    kept = _whole(text)
    if kept:
        yield WHOLE, kept, source


def _best_odds(stored: np.ndarray, n: np.ndarray, cut: np.ndarray, weight: np.ndarray, share: float) -> float:
    """The threshold with the best F1, from the log odds of stored values and of artificial cuts.

    ``n`` has how many stored values have the odds; ``weight`` has how many artificial cuts do, times how often their
    source cuts; ``share`` is the part of the stored values that are cut.  At a threshold with recall r that finds a
    part s of the stored values, F1 is 2 * share * r / (s + share).
    """
    if not n.sum() or not weight.sum():
        return ODDS
    at = np.linspace(np.log(0.02), np.log(2.0), 60)
    recall = np.array([weight[cut >= t].sum() for t in at]) / weight.sum()
    found = np.array([n[stored >= t].sum() for t in at]) / n.sum()
    return float(np.exp(at[np.argmax(2 * share * recall / (found + share))]))


def _distinct(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Features and kinds of a shard's rows, deliveries of a value once; the rows come in the order of value and number."""
    place, nth, kind = (table.column(c).to_numpy() for c in ("place", "nth", "kind"))
    keep = kind != BLANK
    keep[1:] &= (place[1:] != place[:-1]) | (nth[1:] != nth[:-1])
    return _rows(table)[keep], kind[keep]


def _rows(table: pa.Table) -> np.ndarray:
    parts = []
    for column in table.column("x").chunks:  # all values have the same size and none is null, so they lie end to end
        _, offsets, data = column.buffers()
        first, end = np.frombuffer(offsets, np.int32)[[column.offset, column.offset + len(column)]]
        parts.append(np.frombuffer(data, np.int32, (end - first) // 4, first) if end > first else np.empty(0, np.int32))
    return np.concatenate([*parts, np.empty(0, np.int32)]).reshape(table.num_rows, -1 if table.num_rows else 1)


def fit_shard(x: np.ndarray, kind: np.ndarray, judge: np.ndarray | None, bound: float, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the features, and of how many rows each is one.

    Stored values that ``judge``, the weights of the other half, holds to be cut are no negatives any more.
    """
    if judge is not None:
        keep = (kind != STORED) | (judge[x].sum(1) < bound)
        x, kind = x[keep], kind[keep]
    y = np.isin(kind, (CUT, CUT_OTHER)).astype(float)
    if not len(x) or not y.any():
        return np.zeros(1 << FEATURE_BITS), np.zeros(1 << FEATURE_BITS, np.int64)
    c = np.where((y == 1) | (kind == STORED), 1.0, 0.6)
    c[y == 1] *= c[y == 0].sum() / y.sum()
    rounds = min(MOST_ROUNDS, -(-FIT_ROWS // len(x)))
    return _regress(x, y, c, rounds, seed), np.bincount(x.ravel(), minlength=1 << FEATURE_BITS)


def priors(sources: np.ndarray, at: np.ndarray, n: np.ndarray) -> dict[str, float]:
    """Of each source the log odds that one of its values is cut, by expectation maximisation on counts of scores."""
    prior: dict[str, float] = {}
    for s in sorted(set(sources)):
        own, many, share = np.exp(at[sources == s]), n[sources == s], 0.05
        for _ in range(30):
            share = min(0.5, max(1e-4, float((many * (share * own / (share * own + 1 - share))).sum() / many.sum())))
        prior[s] = float(np.log(share / (1 - share)))
    return prior


def _usual(prior: dict[str, float]) -> float:
    return sorted(prior.values())[len(prior) // 2] if prior else 0.0


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << WORD_BITS, np.int64)
    seen: Counter[str] = Counter()  # parts without white space: no token has any
    last: Counter[str] = Counter()  # those at the end of texts, whose last token isn't counted

    def enter(parts: Counter[str], end: int | None) -> None:
        for part, n in parts.items():
            for token in _TOKEN.findall(part)[:end]:
                if token[0].isalnum() and not _plain(token):
                    counts[_slot(token, WORD_BITS)] += n
        parts.clear()

    for batch in batches:
        for text in batch.column(0).to_pylist():
            parts = text.lower().split()
            while parts and not parts[-1].strip("_"):  # underscores are no token
                parts.pop()
            if parts:
                last[parts.pop()] += 1
            seen.update(parts)
            if len(seen) + len(last) > 500_000:
                enter(seen, None)
                enter(last, -1)
    enter(seen, None)
    enter(last, -1)
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], names=["slot", "n"])


def source_limits(texts: DataFrame) -> dict[str, list[int]]:
    """Of each source: lengths that so many values have that they may be limits."""
    n = texts.groupBy("source", F.length("text").alias("length")).count()
    total = n.groupBy("source").agg(F.sum("count").alias("total"))
    often = n.join(total, "source").filter((F.col("length") >= 64) & (F.col("count") >= 5) & (F.col("count") >= LIMIT_SHARE * F.col("total")))
    found: dict[str, dict[int, int]] = {}
    for r in often.collect():  # at most 1 / LIMIT_SHARE rows for each source
        found.setdefault(r["source"], {})[r["length"]] = r["count"]
    return {s: sorted(at for at, n in x.items() if n == max(m for b, m in x.items() if abs(b - at) <= 15)) for s, x in found.items()}


def cut_texts(texts: DataFrame, shard: int = SHARD) -> DataFrame:
    """id, source, odds, cut: of every text, the odds that it lost its end, and whether they pass the threshold.

    ``texts`` has id, source and text.  Vocabulary, lengths of the sources, models, shares of the sources and threshold
    are those of all texts, deliveries of one counted once (but in the vocabulary and the lengths); ``shard`` is how many
    texts are fitted in one go.  Defined results: null and blank texts have odds 0 and aren't cut; a null source has no
    limits; equal rows come out as often as they come in; texts of any length are read whole; other columns are ignored.
    """
    spark = texts.sparkSession
    chosen = texts.select(F.col("id").cast("string").alias("id"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    counts = np.zeros(1 << WORD_BITS, np.int64)
    counted = chosen.select("text").mapInArrow(_count_words, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    counted = counted.toArrow()  # no more rows than the table has slots
    counts[counted["slot"].to_numpy()] = counted["n"].to_numpy()
    limits = source_limits(chosen)
    shards = max(1, -(-chosen.count() // (2 * shard)))
    sent = spark.sparkContext.broadcast((np.minimum(counts, 1 << 20).astype(np.int32), limits))
    names = ["id", "source", "half", "shard", "place", "nth", "kind", "x"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(*sent.value)
        places = [(s, at) for s, x in sorted(reader.limits.items()) for at in x]
        for batch in (b.slice(k, STEP_VALUES) for b in batches for k in range(0, b.num_rows, STEP_VALUES)):
            out: list[tuple] = []
            ends: list[tuple[int, ...]] = []
            for i, source, half, part, place, text in zip(*[c.to_pylist() for c in batch.columns]):
                blank, value = not text.strip(), Value(text)
                out.append((i, source, half, part, place, 0, BLANK if blank else STORED))
                ends.append(reader.row(value, text, source))
                if not blank:
                    for nth, (kind, made, of) in enumerate(_made(text, source, places, random.Random(place)), 1):
                        out.append((None, of, half, part, place, nth, kind))
                        ends.append(reader.row(value, made, of))
            x = reader.features(ends)
            offsets = np.arange(len(x) + 1, dtype=np.int32) * (4 * x.shape[1])
            packed = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(x)])
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([*[pa.array(c, kind) for c, kind in zip(zip(*out), kinds)], packed], names=names)

    place = F.xxhash64("id", "text", "source")  # deliveries of a value are in one shard; stock phrases are in both halves
    split = chosen.select("id", "source", F.pmod(place, F.lit(2)).cast("int"), F.pmod(F.shiftright(place, 1), F.lit(shards)).cast("int"), place, "text")
    path = new_path(spark, "ends")
    rows = split.mapInArrow(read, "id string, source string, half int, shard int, place bigint, nth int, kind int, x binary")
    rows = rows.repartition(2 * shards, "half", "shard").sortWithinPartitions("half", "shard", "place", "nth")
    rows.write.option("compression", "zstd").partitionBy("half", "shard").parquet(path)
    tasks = spark.createDataFrame([(h, s) for h in (0, 1) for s in range(shards)], "half int, shard int").repartitionByRange(2 * shards, "half", "shard")

    def each(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[int, pa.Table]]:
        for batch in batches:
            for half, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for table in Parts(f"{path}/half={half}/shard={part}").tables(columns):
                    yield half, table

    def learn(models, bound: float):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for half, table in each(batches, ["place", "nth", "kind", "x"]):
                w, n = fit_shard(*_distinct(table), None if models is None else models.value[1 - half], bound)
                used = np.flatnonzero(n)
                # whole numbers, so that the order of a sum doesn't matter
                total = np.round(w[used] * n[used] * (1 << 20)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), half, np.int32)), pa.array(used.astype(np.int32)), pa.array(total), pa.array(n[used])], names=["half", "slot", "total", "n"])

        found = tasks.mapInArrow(run, "half int, slot int, total bigint, n bigint").groupBy("half", "slot").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toArrow()  # a row for each weight
        w = np.zeros((2, 1 << FEATURE_BITS))
        w[found["half"].to_numpy(), found["slot"].to_numpy()] = found["total"].to_numpy() / (1 << 20) / found["n"].to_numpy()
        return spark.sparkContext.broadcast(w.astype(np.float32))

    models = None
    for bound in (0.0, -0.5, 0.0):  # the first fit judges nothing
        models = learn(models, bound)

    def scores(half: int, table: pa.Table) -> np.ndarray:
        return np.clip(models.value[1 - half][_rows(table)].sum(1).astype(np.float64), -30, 30)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for half, table in each(batches, ["source", "place", "nth", "kind", "x"]):
            place, nth, kind = (table.column(c).to_numpy() for c in ("place", "nth", "kind"))
            keep = (kind == STORED) | (kind == CUT)
            keep[1:] &= (place[1:] != place[:-1]) | (nth[1:] != nth[:-1])
            at = np.floor(scores(half, table)[keep] / STEP).astype(np.int32)
            yield pa.RecordBatch.from_arrays([table.column("source").combine_chunks().filter(pa.array(keep)), pa.array(kind[keep]), pa.array(at)], names=["source", "kind", "at"])

    seen = tasks.mapInArrow(count, "source string, kind int, at int").groupBy("source", "kind", "at").count().toArrow()  # a row for each step of a source
    source, kind, at, n = np.array(seen["source"].to_pylist(), object), seen["kind"].to_numpy(), (seen["at"].to_numpy() + 0.5) * STEP, seen["count"].to_numpy()
    stored, cut = kind == STORED, kind == CUT
    prior = priors(source[stored], at[stored], n[stored])
    usual = _usual(prior)
    known = np.array([prior.get(x, usual) for x in source])
    log_odds = at + known
    share = float((n * (1 / (1 + np.exp(-log_odds))))[stored].sum() / max(1, n[stored].sum()))
    threshold = _best_odds(log_odds[stored], n[stored], log_odds[cut], (n / (1 + np.exp(-known)))[cut], share)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for half, table in each(batches, ["id", "source", "nth", "kind", "x"]):
            table = table.filter(pa.array(table.column("nth").to_numpy() == 0))
            sources = table.column("source").to_pylist()
            odds = np.exp(scores(half, table) + np.array([prior.get(x, usual) for x in sources]))
            odds[table.column("kind").to_numpy() == BLANK] = 0.0
            yield from pa.table({"id": table.column("id"), "source": table.column("source"), "odds": odds, "cut": odds >= threshold}).to_batches(max_chunksize=65_536)

    return tasks.mapInArrow(score, "id string, source string, odds double, cut boolean")
