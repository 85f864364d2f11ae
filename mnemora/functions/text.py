"""Gists, token estimates and media paths as column expressions."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that are no key terms (fixed values).
STOP_WORDS = """the a an is are was were be been being have has had do does did will would could should may might must shall
can need dare to of in for on with at by from as into through during before after above below between under again further then
once here there when where why how all each every both few more most other some such no nor not only own same so than too very
just also now and but or if because this that these those it its i we you he she they them their our your my""".split()
IMAGE_TYPES, VIDEO_TYPES = "jpg|jpeg|png|gif|webp|heic|heif", "mp4|mov|avi|mkv|webm|m4v"


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def sentences(text: Column) -> Column:
    """The text's sentences: a mark of their end and a space part them."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?]) "), lambda s: F.trim(s)), lambda s: s != "")


_WORD = re.compile(r"\b[a-z]+\b", re.ASCII)


def key_terms(text: str, first: str, stop: frozenset[str] = frozenset(STOP_WORDS)) -> list[str]:
    """Up to three words of four letters or more that come twice and not in the first sentence, by count, then place."""
    own = set(_WORD.findall(first.lower()))
    counts = Counter(w for w in _WORD.findall(text.lower()) if len(w) > 3 and w not in stop and w not in own)
    return [w for w, n in counts.most_common() if n > 1][:3]


def gist_of(content: str | None, most: int = 150) -> str | None:
    """The text if short; else its first sentence of more than 20 characters with key terms, or its first words."""
    if content is None:
        return None
    text = " ".join(content.split())
    if len(text) <= most:
        return text
    parts = [p for p in re.split(r"(?<=[.!?]) ", text) if p]
    first = next((p for p in parts if len(p) > 20), parts[0])
    if len(first) <= most:
        terms = ", ".join(key_terms(text, first))
        return f"{first} [{terms}]" if terms and len(first) + len(terms) + 3 <= most else first
    kept = ""
    for word in text.split(" "):
        longer = f"{kept} {word}" if kept else word
        if len(longer) > most - 3:
            return kept + "..."
        kept = longer
    return kept


@F.pandas_udf(T.StringType())
def gist(content: pd.Series) -> pd.Series:
    """Counting words by place has no built-in; whole Arrow batches go to Python."""
    return content.map(gist_of, na_action="ignore")


def units(text: Column) -> Column:
    """Length in UTF-16 units: characters outside the basic plane count twice."""
    return F.length(text) + F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))


def tokens(text: Column) -> Column:
    return F.ceil(units(text) / 4.0).cast("int")


def media_path(text: Column, types: str = IMAGE_TYPES) -> Column:
    """The first quoted path, else URL, else bare path with one of the endings; null if there is none."""
    found = [F.regexp_extract(text, p, 1) for p in (rf'"([^"]+\.(?:{types}))"', rf"'([^']+\.(?:{types}))'", rf"(https?://[^\s]+\.(?:{types}))", rf"([^\s]+\.(?:{types}))")]
    return F.coalesce(*[F.when(c != "", c) for c in found])
