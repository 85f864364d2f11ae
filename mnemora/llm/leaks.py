"""Test passages in training text.

A generalised suffix automaton of the normalised test items is streamed over the words of every document.  It gives,
at each word, the longest stretch of the text ending there that occurs in an item.  Stretches of one item that follow
one another with a few foreign words between them are chained; a chain that spans enough of the item's words is a leak.
Where no item holds the three words that begin at a place, the automaton's match is shorter than three words, so only
stretches around known word triples are streamed; that changes no result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of an item that a chain must span, the shortest exact stretch, words that may stand between two stretches,
#: and the part of the spanned words that must be exact.
LEAST_WORDS = 20
STRETCH = 3
GAP = 4
EXACT = 0.6
#: Bytes of all items together that are sent to every worker; more must be given in parts, each with its own call.
MOST_BYTES = 64_000_000

#: Lead-ins before a passage and answer marks behind it (fixed forms of the test material).
LEAD_IN = re.compile(r"^\s*(?:(?:Question|Context|Passage|Problem|Task)\s*\d*\s*[:.]|Q\s*\d+\s*[.:)]|\d+\s*[.)]|Read the (?:passage|text)[^.:]*[.:])\s*", re.I)
ANSWER = re.compile(r"\s*(?:Answer|Solution|Correct answer|Key)\s*:\s*\(?\w{1,3}\)?\.?\s*$", re.I)

_CLASS = np.zeros(256, np.uint8)  # lower-case form of a byte that belongs to a word, else 0
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789":
    _CLASS[_c] = _c
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _CLASS[_c] = _c + 32
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def byte_words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and sizes in bytes of the runs of ASCII letters and digits, and a 64-bit code of each in lower case."""
    padded = np.zeros(len(data) + 17, np.uint8)
    np.take(_CLASS, np.frombuffer(data, np.uint8), out=padded[1 : len(data) + 1])
    inside = padded != 0
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    words = np.ndarray((len(data) + 9,), "<u8", padded[1:], strides=(1,))
    low = words[starts] & _MASKS[np.minimum(sizes, 8)]
    high = words[np.minimum(starts + 8, len(data) + 8)] & _MASKS[np.clip(sizes - 8, 0, 8)]
    with np.errstate(over="ignore"):
        code = (low * _ODD[0]) ^ ((high + np.uint64(1)) * _ODD[1]) ^ (sizes.astype(np.uint64) << np.uint64(56))
        code ^= code >> np.uint64(29)
    return starts, sizes, code


def passage(text: str | None) -> str:
    """An item's text without lead-in and answer mark."""
    text = text or ""
    while (m := LEAD_IN.match(text)) and m.end():
        text = text[m.end() :]
    return ANSWER.sub("", text)


class Automaton:
    """Generalised suffix automaton over word numbers, with the places in which each state's stretch ends."""

    def __init__(self, items: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        own: list[tuple[int, int, int]] = []
        for number, words in enumerate(items):
            last = 0
            for at, word in enumerate(words):
                last = self._extend(last, word)
                own.append((last, number, at))
        self._words = [(number, at, word) for number, words in enumerate(items) for at, word in enumerate(words)]
        for state, number, at in own:
            self.ends[state].append((number, at))
        self._own = own
        self._all: dict[int, list[tuple[int, int]]] = {}
        self._children: list[list[int]] = [[] for _ in self.link]
        for state, link in enumerate(self.link):
            if link >= 0:
                self._children[link].append(state)

    def _add(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.next) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        clone = self._add(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: int) -> int:
        q = self.next[last].get(word)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
        new, p = self._add(self.length[last] + 1, 0, {}), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
        return new

    def occurrences(self, state: int) -> list[tuple[int, int]]:
        """(item, place of the last word) of every occurrence of a state's stretches."""
        found = self._all.get(state)
        if found is None:
            found, stack = [], [state]
            while stack:
                s = stack.pop()
                found += self.ends[s]
                stack += self._children[s]
            self._all[state] = found
        return found

    def overlaps(self, least: int) -> dict[int, list[tuple[int, int, int, int]]]:
        """Of each item what it shares with items: (its last place, length, item, place there) of stretches of ``least`` words or more that can't be made longer.

        A text's maximal stretch belongs to the items that hold all of it; those that share a passage of it are among these.
        """
        words = {(number, at): word for number, at, word in self._words}
        out: dict[int, list[tuple[int, int, int, int]]] = {}
        for state, number, at in self._own:
            seen, s = {(number, at)}, state
            while s > 0 and self.length[s] >= least:
                for other in self.occurrences(s):
                    if other not in seen:
                        seen.add(other)
                        following = words.get((number, at + 1))
                        if following is None or following != words.get((other[0], other[1] + 1)):
                            out.setdefault(number, []).append((at, min(self.length[s], at + 1), *other))
                s = self.link[s]
        return out

    def stretches(self, words: list[int]) -> list[tuple[int, int, int]]:
        """Maximal stretches of ``words``: (place of the last word, length, state), of STRETCH words or more."""
        state, length, out = 0, 0, []
        next_, link, lengths = self.next, self.link, self.length
        before = (0, 0)
        for at, word in enumerate(words):
            grown = next_[state].get(word)
            if grown is not None:
                state, length = grown, length + 1
            else:
                if length >= STRETCH:
                    out.append((at - 1, length, state))
                while state >= 0 and (grown := next_[state].get(word)) is None:
                    state = link[state]
                if state < 0:
                    state = length = 0
                else:
                    length = lengths[state] + 1
                    state = grown
            before = (state, length)
        if before[1] >= STRETCH:
            out.append((len(words) - 1, before[1], before[0]))
        return out


class Finder:
    """Finds the items of which texts hold passages."""

    def __init__(self, items: list[tuple[int, str]], least: int = LEAST_WORDS, gap: int = GAP, exact: float = EXACT):
        self.least, self.gap, self.exact = least, gap, exact
        self.ids = [i for i, _ in items]
        coded = [byte_words(passage(t).encode())[2] for _, t in items]
        self.vocabulary = np.unique(np.concatenate(coded)) if coded else np.empty(0, np.uint64)
        numbered = [(np.searchsorted(self.vocabulary, c) + 1).tolist() for c in coded]
        self.sizes = [len(x) for x in numbered]
        self.automaton = Automaton(numbered)
        self.overlaps = self.automaton.overlaps(least)
        self.base = len(self.vocabulary) + 1
        triples = [(a * self.base + b) * self.base + c for x in numbered for a, b, c in zip(x, x[1:], x[2:])]
        self.triples = np.unique(np.array(triples, np.int64))
        # word codes by their upper bits, so that most foreign words are told apart by one look
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.vocabulary & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def numbers(self, codes: np.ndarray) -> np.ndarray:
        """The words' numbers, 0 for a word that no item has."""
        out = np.zeros(len(codes), np.int64)
        maybe = np.flatnonzero(self.sieve[(codes & np.uint64(0xFFFFF)).astype(np.int64)])
        if len(maybe):
            at = np.searchsorted(self.vocabulary, codes[maybe])
            at[at == len(self.vocabulary)] = 0
            out[maybe] = np.where(self.vocabulary[at] == codes[maybe], at + 1, 0)
        return out

    def batch(self, lengths: np.ndarray, data: bytes) -> list[tuple[int, int, int, int, int, int]]:
        """(text, item's place, words spanned, exact words, first byte, last byte + 1) of every leak in the texts that lie end to end in ``data``."""
        if not len(data) or not len(self.vocabulary):
            return []
        ends = np.cumsum(lengths)
        starts, sizes, codes = byte_words(data)
        if len(starts) < 3:
            return []
        number = self.numbers(codes)
        triple = (number[:-2] * self.base + number[1:-1]) * self.base + number[2:]
        solid = np.flatnonzero((number[:-2] > 0) & (number[1:-1] > 0) & (number[2:] > 0))
        at = np.searchsorted(self.triples, triple[solid])
        at[at == len(self.triples)] = 0
        hits = solid[self.triples[at] == triple[solid]] if len(self.triples) else solid[:0]
        if not len(hits):
            return []
        text = np.searchsorted(ends, starts[hits], side="right")
        found = []
        for group in np.split(hits, np.flatnonzero((np.diff(text) != 0) | (np.diff(hits) > 2 * self.least)) + 1):
            if len(group) < 3:  # too few triples for a chain
                continue
            doc = int(np.searchsorted(ends, starts[group[0]], side="right"))
            first, last = int(group[0]), int(group[-1]) + 3
            for item, a, b, spanned, exact in self._chains(number[first:last].tolist()):
                found.append((doc, item, spanned, exact, int(starts[first + a]), int(starts[first + b] + sizes[first + b])))
        return found

    def _chains(self, words: list[int]) -> Iterator[tuple[int, int, int, int, int]]:
        met: dict[int, set[tuple[int, int, int]]] = {}
        for at, length, state in self.automaton.stretches(words):
            for item, place in self.automaton.occurrences(state):
                met.setdefault(item, set()).add((at, place, length))
                for end, size, other, there in self.overlaps.get(item, ()):
                    last = min(end, place)  # what of the shared stretch the text has
                    size -= end - last
                    size = min(size, last - (place - length))
                    if size >= self.least:
                        met.setdefault(other, set()).add((at - (place - last), there - (end - last), size))
        by_item = {item: sorted(pieces) for item, pieces in met.items()}
        for item, pieces in by_item.items():
            if sum(p[2] for p in pieces) < self.exact * self.least:
                continue
            # best chain that ends in each piece: exact words, where it began in the text and in the item
            best: list[tuple[int, int, int]] = []
            for k, (at, place, length) in enumerate(pieces):
                own = (length, at - length + 1, place - length + 1)
                for (at0, place0, _), (exact0, a0, p0) in zip(reversed(pieces[:k]), reversed(best)):
                    if at - length - at0 > self.gap + 1:
                        if at0 < at - length - 64:
                            break
                        continue
                    over = max(0, at0 - (at - length), place0 - (place - length))
                    if place0 < place and at0 < at and length > over and place - length - place0 <= self.gap and exact0 + length - over > own[0]:
                        own = (exact0 + length - over, a0, p0)
                best.append(own)
            taken: set[int] = set()
            for (exact, a, p), (at, place, _) in sorted(zip(best, pieces), key=lambda x: -x[0][0]):
                spanned = place - p + 1
                if spanned >= min(self.least, self.sizes[item]) and spanned >= self.least and exact >= self.exact * spanned and not taken & set(range(p, place + 1)):
                    taken |= set(range(p, place + 1))
                    yield item, a, at, spanned, exact


def leaked_passages(documents: DataFrame, items: DataFrame, least: int = LEAST_WORDS, gap: int = GAP, exact: float = EXACT) -> DataFrame:
    """Every passage of an item in a document: doc_id, item_id, words, exact_words, start_byte, end_byte.

    ``documents`` has doc_id and text, ``items`` has item_id and text.  A passage is a chain of stretches that spans at
    least ``least`` words of the item without lead-in and answer mark; between two stretches stand at most ``gap``
    words on either side, and at least the part ``exact`` of the spanned words is exact.  Words are runs of ASCII
    letters and digits; case, punctuation, spacing and markup don't count.  The places are bytes of the text in UTF-8.

    Defined results: null and empty texts and items give no rows, nor do items shorter than ``least`` words; equal
    documents come out each with their own rows; texts are read whole, whatever their length; other columns are
    ignored.  The items go to every worker, so they may be no more than MOST_BYTES together (checked).
    """
    spark = documents.sparkSession
    chosen = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").filter("item_id is not null and text is not null")
    size = chosen.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > MOST_BYTES:
        raise ValueError(f"the items have {size} bytes; give them in parts of {MOST_BYTES} at most")
    sent = spark.sparkContext.broadcast(sorted(map(tuple, chosen.distinct().collect())))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(sent.value, least, gap, exact)
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary()).fill_null(b"")
            for at in range(0, batch.num_rows, 512):
                part = texts.slice(at, 512)
                offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
                data = bytes(part.buffers()[2][int(offsets[0]) : int(offsets[-1])]) if part.buffers()[2] is not None else b""
                rows = finder.batch(np.diff(offsets), data)
                if rows:
                    doc, item, spanned, exact_words, first, last = (np.array(x) for x in zip(*rows))
                    base = (offsets - offsets[0])[doc]
                    keys = batch.column(0).slice(at, 512).take(pa.array(doc))
                    item_ids = pa.array(np.array(finder.ids)[item], pa.int64())
                    yield pa.RecordBatch.from_arrays([keys, item_ids, *(pa.array(x.astype(np.int32)) for x in (spanned, exact_words, first - base, last - base))], names=["doc_id", "item_id", "words", "exact_words", "start_byte", "end_byte"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(find, f"doc_id {kind}, item_id bigint, words int, exact_words int, start_byte int, end_byte int")
