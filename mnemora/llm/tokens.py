"""Token ids of whole texts by a public byte-level BPE.

Forced-boundary splitting: two neighbouring bytes that stand side by side in no token of the vocabulary can't end up
in one token, so the text may be cut between them for certain.  The fragments between such cuts are encoded on their
own, each distinct fragment once for as long as it is remembered, and their ids are put in a row.

A cut must also leave the tokenizer's own split of the text into words as it is.  It does, if the cut is between two
characters, the left one isn't white space (runs of white space look ahead) and the right one isn't an apostrophe
(contractions are matched first).
"""

from __future__ import annotations

import base64
import importlib.util
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the vocabulary files lie, if the caller names no folder.
TOKENIZERS = "/opt/tokenizers"
#: Distinct fragments that a worker remembers; beyond that it forgets all and goes on.
REMEMBERED = 1_000_000
SLOT_BITS = 18
SLOTS = 1 << SLOT_BITS
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def _pattern(folder: str) -> str:
    spec = importlib.util.spec_from_file_location("_tokenizer_files", Path(folder) / "__init__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module.PATTERN


class BoundaryEncoder:
    """Encodes texts by the ranks in ``<folder>/<name>.tiktoken``."""

    def __init__(self, name: str = "byte_bpe_50k", folder: str = TOKENIZERS, remembered: int = REMEMBERED):
        import tiktoken

        with open(Path(folder) / f"{name}.tiktoken", "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._whole = tiktoken.Encoding(name, pat_str=_pattern(folder), mergeable_ranks=ranks, special_tokens={})
        inside = np.zeros((256, 256), bool)
        for token in ranks:
            if len(token) > 1:
                b = np.frombuffer(token, np.uint8)
                inside[b[:-1], b[1:]] = True
        left, right = np.arange(256)[:, None], np.arange(256)[None, :]
        # the last bytes that a white space character can have in UTF-8
        blank = np.isin(left, [9, 10, 11, 12, 13, 32, 0x85, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF, *range(0x80, 0x8B)])
        self._cut = ~(inside | blank | (right & 0xC0 == 0x80) | (right == ord("'"))).ravel()
        self._remembered = remembered
        self._forget()

    def _forget(self) -> None:
        self._known: dict[bytes, int] = {}  # fragment -> its place in the two lists below
        self._pool = np.zeros(1 << 16, np.int32)  # ids of all known fragments, end to end
        self._used = 0
        self._first, self._count = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        # fragments of up to 16 bytes by their bytes as two words; a fragment whose slot is taken stays in the dict
        self._low, self._high = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint64)
        self._slot, self._size = np.full(SLOTS, -1, np.int32), np.zeros(SLOTS, np.int64)

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """For each two neighbouring bytes of ``data``, whether they are cut apart."""
        pairs = data[:-1].astype(np.uint16)
        pairs <<= 8
        pairs |= data[1:]
        return self._cut[pairs]

    def _learn(self, fragment: bytes) -> int:
        ids = self._whole.encode_ordinary(fragment.decode())
        place = len(self._known)
        if place == len(self._first):
            self._first, self._count = np.resize(self._first, 2 * place), np.resize(self._count, 2 * place)
        while self._used + len(ids) > len(self._pool):
            self._pool = np.resize(self._pool, 2 * len(self._pool))
        self._pool[self._used : self._used + len(ids)] = ids
        self._first[place], self._count[place] = self._used, len(ids)
        self._used += len(ids)
        self._known[fragment] = place
        return place

    def batch(self, lengths: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that lie end to end in ``data``: the number of each text's ids, and all ids."""
        ends = np.cumsum(lengths)
        if not len(data):
            return np.zeros(len(lengths), np.int64), np.empty(0, np.int32)
        if len(self._known) > self._remembered or self._used > 32 * self._remembered:
            self._forget()
        bytes_ = np.frombuffer(data, np.uint8)
        begin = np.zeros(len(data) + 1, bool)
        begin[1:-1] = self.cuts(bytes_)
        begin[0] = True
        begin[ends] = True
        bounds = np.flatnonzero(begin)
        starts, sizes = bounds[:-1], np.diff(bounds)
        padded = np.zeros(len(data) + 16, np.uint8)
        padded[: len(data)] = bytes_
        words = np.ndarray((len(data) + 9,), "<u8", padded, strides=(1,))
        low = words[starts] & _MASKS[np.minimum(sizes, 8)]
        high = words[np.minimum(starts + 8, len(data))] & _MASKS[np.clip(sizes - 8, 0, 8)]
        short = sizes <= 16
        with np.errstate(over="ignore"):
            mixed = (low ^ (high * _ODD[0]) ^ sizes.astype(np.uint64)) * _ODD[1]
        slot = (mixed >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        place = self._slot[slot].astype(np.int64)
        place[(self._low[slot] != low) | (self._high[slot] != high) | (self._size[slot] != sizes)] = -1
        known = self._known
        for k in np.flatnonzero(place < 0).tolist():
            at = starts[k]
            fragment = data[at : at + sizes[k]]
            found = known.get(fragment)
            if found is None:
                found = self._learn(fragment)
                if short[k] and self._slot[slot[k]] < 0:
                    self._slot[slot[k]], self._size[slot[k]], self._low[slot[k]], self._high[slot[k]] = found, sizes[k], low[k], high[k]
            place[k] = found
        counts = self._count[place]
        after = np.cumsum(counts)
        flat = self._pool[np.repeat(self._first[place] - after + counts, counts) + np.arange(after[-1])]
        at = np.searchsorted(starts, np.concatenate([[0], ends]))
        return np.diff(np.concatenate([[0], after])[at]), flat


@lru_cache(maxsize=2)
def encoder_of(name: str, folder: str) -> BoundaryEncoder:
    """The encoder of a Python worker, which its tasks share with all fragments that it knows."""
    return BoundaryEncoder(name, folder)


def token_ids(documents: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``key`` and ``ids``, the token ids (array of integers) of ``text`` without special tokens.

    Strings of special tokens in a text are ordinary text.  Defined results: a null or an empty text has an empty
    list; every row comes out once, equal rows as often as they come in; a null key stays null; other columns are
    ignored.  Texts of any length are encoded whole.
    """
    kind = documents.schema[key].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(name, folder)
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary()).fill_null(b"")
            step = 256
            for at in range(0, batch.num_rows, step):
                part = texts.slice(at, step)
                offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
                data = bytes(part.buffers()[2][int(offsets[0]) : int(offsets[-1])]) if part.buffers()[2] is not None else b""
                counts, flat = encoder.batch(np.diff(offsets), data)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, step), lists], names=[key, "ids"])

    return documents.select(key, text).mapInArrow(encode, f"`{key}` {kind}, ids array<int>")
