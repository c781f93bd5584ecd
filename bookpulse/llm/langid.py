"""Language by rank-order profiles.

The letter sequences of one to three characters (words padded with a space) of all training texts
are counted per language; the most frequent form its profile, in order. A document's own most
frequent sequences are compared with each profile by how far each is out of place; a sequence that
the profile lacks counts as the profile's length. The language with the least distance is predicted.

Sequences are integers: three code points of 21 bits. Ties in frequency are ordered by that integer,
ties in distance by the language's name. Counts cover whole texts, however long; a profile has
``PROFILE`` entries. What the tasks get are the profiles' postings, ``PROFILE`` a language: a text
meets only the postings of its own sequences, so any number of languages can be told apart.

Null texts and texts without a letter are ``und`` with score 0; so is every text if nothing could be
learned. Null languages are not learned from. Repeated rows count as often as they occur. Extra columns
are not looked at, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookpulse.llm.common import map_rows, pa_schema, store, text_of

PROFILE = 400
UNKNOWN = "und"


@cache
def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def sequences(text: str) -> np.ndarray:
    """All letter sequences of a text as integers, repeats included, in order of their integer."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    letter = letters()[points]
    padded = np.concatenate(([32], np.where(letter, points, 32), [32]))
    is_letter = padded != 32
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    keep[0] = True
    line = padded[keep]
    if len(line) < 3:
        return np.empty(0, np.int64)
    solid = line != 32
    two = (line[:-1] << 21) | line[1:]
    three = (two[:-1] << 21) | line[2:]
    return np.sort(np.concatenate((line[solid], two, three[solid[1:-1]])))


def counted(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    return ordered[start], np.diff(np.append(start, len(ordered)))


def ranked(text: str, most: int) -> np.ndarray:
    """The most frequent sequences of a text, the most frequent first."""
    ordered = sequences(text)
    if not len(ordered):
        return ordered
    found, count = counted(ordered)
    if len(found) > 4 * most:  # ties at the border stay in, the sort below decides
        border = np.partition(count, len(count) - most)[len(count) - most]
        found, count = found[count >= border], count[count >= border]
    return found[np.lexsort((found, -count))][:most]


class Tally:
    """Counts of sequences in bounded memory: what has come in is summed up whenever it is much."""

    MUCH = 2_000_000

    def __init__(self) -> None:
        self.found, self.count = np.empty(0, np.int64), np.empty(0, np.int64)
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, ordered: np.ndarray) -> None:
        self.parts.append(ordered)
        self.size += len(ordered)
        if self.size >= self.MUCH:
            self.total()

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if self.size:
            found, count = counted(np.sort(np.concatenate(self.parts)))
            both, at = np.unique(np.concatenate((self.found, found)), return_inverse=True)
            self.count = np.bincount(at, np.concatenate((self.count, count)), len(both)).astype(np.int64)
            self.found, self.parts, self.size = both, [], 0
        return self.found, self.count


def profiles(train: DataFrame, size: int = PROFILE) -> dict[str, np.ndarray]:
    """The profile of each language in rows of (lang, text)."""
    schema = "lang string, sequence long, n long"
    fields = pa_schema(train.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang: dict[str, Tally] = {}
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                by_lang.setdefault(lang, Tally()).add(sequences(text))
            for lang, tally in by_lang.items():
                found, count = tally.total()
                if len(found):
                    columns = [pa.array([lang] * len(found), pa.string()), pa.array(found), pa.array(count, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, schema=fields)

    labelled = train.where("lang is not null").select(F.col("lang").cast("string"), text_of())
    counts = labelled.mapInArrow(run, schema).groupBy("lang", "sequence").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "sequence"))
    top = store(counts.withColumn("place", place).where(F.col("place") <= size), "profiles")
    found = top.orderBy("lang", "place").toArrow().to_pydict()  # ``size`` rows a language
    values = np.array(found["sequence"], np.int64)
    ends = np.cumsum(list(Counter(found["lang"]).values()))  # in order of languages
    return dict(zip(dict.fromkeys(found["lang"]), np.split(values, ends[:-1]), strict=True)) if len(values) else {}


class Postings:
    """For each sequence of any profile, the languages that have it and its places there."""

    def __init__(self, learned: dict[str, np.ndarray]):
        self.names = sorted(learned)
        own = [learned[name] for name in self.names]
        sequence = np.concatenate([np.empty(0, np.int64), *own])
        lang = np.repeat(np.arange(len(own)), [len(x) for x in own]).astype(np.int32)
        place = np.concatenate([np.empty(0, np.int64), *(np.arange(len(x)) for x in own)]).astype(np.int32)
        order = np.argsort(sequence, kind="stable")
        self.lang, self.place = lang[order], place[order]
        self.sequences, self.start = np.unique(sequence[order], return_index=True)
        self.count = np.diff(np.append(self.start, len(sequence)))

    def of(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Languages, places there, and places in ``wanted`` of all its sequences that profiles have."""
        at = np.searchsorted(self.sequences, wanted)
        at[at == len(self.sequences)] = 0
        known = np.flatnonzero(self.sequences[at] == wanted)
        count = self.count[at[known]]
        ahead = np.cumsum(count) - count
        row = np.repeat(self.start[at[known]] - ahead, count) + np.arange(count.sum())
        return self.lang[row], self.place[row], np.repeat(known, count)


def closest(text: str, postings: Postings, size: int) -> tuple[int, float]:
    """The profile nearest to a text and one less the distance's part of the greatest; -1 if none."""
    own = ranked(text, size)
    if not len(own) or not len(postings.sequences):
        return -1, 0.0
    lang, there, here = postings.of(own)
    most = size * len(own)
    distance = most - np.bincount(lang, size - np.abs(there - here), len(postings.names))
    best = int(np.argmin(distance))
    return best, 1.0 - float(distance[best]) / most


def detect(docs: DataFrame, learned: dict[str, np.ndarray], keep: list[Column] | None = None, size: int = PROFILE) -> DataFrame:
    """The kept columns (``doc_id`` if none are named) with lang_pred and score for every document."""
    keep = keep or [F.col("doc_id")]
    model = docs.sparkSession.sparkContext.broadcast(Postings(learned))

    def rows(*columns: list) -> list[list]:
        postings = model.value
        found = [closest(text, postings, size) for text in columns[-1]]
        said = [postings.names[k] if k >= 0 else UNKNOWN for k, _ in found]
        return [*columns[:-1], said, [score for _, score in found]]

    kept = docs.select(*keep).schema
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return map_rows(docs, [*keep, text_of()], f"{kinds}, lang_pred string, score double", rows)
