"""Quality rules: repeated passages of a text by suffix arrays over its words.

A text's words are sorted as suffixes by prefix doubling. Neighbours in that order share their
longest common prefix, and the intervals of neighbours that share at least ``k`` words are the
maximal repeated word sequences. The union of their spans gives the covered fraction.

Texts of a batch share one array: a word's first rank carries its text, so suffixes of different
texts share no prefix. A text longer than a batch makes a batch of its own; memory follows the
longest text.

Null and empty texts have no words, fail the base rules and are not kept. Repeated rows are judged
alike, one by one. Other columns of the table are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookpulse.llm.common import SPACE, at_hand, map_rows, text_of

SYMBOLS = "#*$%&|<>"
#: Words that one suffix array takes, unless a single text has more.
ARRAY_WORDS = 200_000


@dataclass(frozen=True)
class Limits:
    """A text is kept if it passes the base rules and these limits on its repeats."""

    min_words: int = 10
    base_window: int = 5
    base_percent: int = 20
    repeat_words: int = 10  # a repeat counts for the covered fraction from so many words
    max_covered: float = 0.15
    max_longest: int = 100


def ranks_by_doubling(doc: np.ndarray, word: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """For prefixes of 1, 2, 4 ... words, the rank of each suffix by that prefix; the last is total."""
    n = len(word)
    key = doc * (int(word.max()) + 1) + word
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    fresh = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    levels, width = [rank], 1
    active = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
    while active.size:
        after = active + width
        second = np.where(after < end[active], rank[np.minimum(after, n - 1)] + 1, 0)
        first = rank[active]
        order = np.argsort(first * (n + 1) + second, kind="stable")
        place, first, second = active[order], first[order], second[order]
        at = np.arange(len(place))
        group = np.concatenate(([True], first[1:] != first[:-1]))
        split = group | np.concatenate(([True], second[1:] != second[:-1]))
        group_start = np.maximum.accumulate(np.where(group, at, 0))
        split_start = np.maximum.accumulate(np.where(split, at, 0))
        rank = rank.copy()
        rank[place] = first + split_start - group_start
        levels.append(rank)
        width *= 2
        size = np.diff(np.append(np.flatnonzero(split), len(place)))
        active = np.sort(place[np.repeat(size > 1, size)])
    return levels


def longest_repeats(doc: np.ndarray, word: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each word, the length of the longest sequence from there that its text has twice."""
    n = len(word)
    longest = np.zeros(n, np.int64)
    levels = ranks_by_doubling(doc, word, end)
    suffixes = np.empty(n, np.int64)
    suffixes[levels[-1]] = np.arange(n)
    left, right = suffixes[:-1], suffixes[1:]
    common = levels[0][left] == levels[0][right]
    left, right = left[common], right[common]
    shared = np.zeros(len(left), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = left + shared, right + shared
        inside = (a < end[left]) & (b < end[right])
        a, b = np.minimum(a, n - 1), np.minimum(b, n - 1)
        shared += (inside & (levels[k][a] == levels[k][b])) << k
    np.maximum.at(longest, left, shared)
    np.maximum.at(longest, right, shared)
    return longest


def covered(longest: np.ndarray, at_least: int) -> np.ndarray:
    """Which words the repeats of at least so many words cover."""
    start = np.flatnonzero(longest >= at_least)
    steps = np.zeros(len(longest) + 1, np.int64)
    np.add.at(steps, start, 1)
    np.add.at(steps, start + longest[start], -1)
    return np.cumsum(steps[:-1]) > 0


def repeats(texts: list[list[bytes]], limits: Limits) -> Iterator[tuple[int, int, int]]:
    """Of each text: words that base windows repeat, words that long repeats cover, longest repeat."""
    sizes = np.array([len(words) for words in texts], np.int64)
    if not sizes.sum():
        yield from [(0, 0, 0)] * len(texts)
        return
    numbers: dict[bytes, int] = {}
    word = np.array([numbers.setdefault(w, len(numbers)) for words in texts for w in words], np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    longest = longest_repeats(doc, word, np.cumsum(sizes)[doc])
    base = np.bincount(doc, covered(longest, limits.base_window), len(texts)).astype(np.int64)
    long = np.bincount(doc, covered(longest, limits.repeat_words), len(texts)).astype(np.int64)
    most = np.zeros(len(texts), np.int64)
    np.maximum.at(most, doc, longest)
    yield from zip(base.tolist(), long.tolist(), most.tolist(), strict=True)


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split("\n") if line.strip(SPACE)]
    return len(lines) - len(set(lines))


def judged(texts: list[str], limits: Limits = Limits()) -> list[tuple]:
    """The fields of FIELDS for each text."""
    out, group, size = [], [], 0

    def flush() -> None:
        for (text, words), (base, long, most) in zip(
            group, repeats([words for _, words in group], limits), strict=True
        ):
            n = len(words)
            failed = n < limits.min_words or 100 * base > limits.base_percent * n
            kept = not failed and long <= limits.max_covered * n and most <= limits.max_longest
            out.append((
                n,
                len(text) - sum(map(text.count, SPACE)),
                sum(map(text.count, SYMBOLS)),
                duplicate_lines(text),
                base,
                long,
                most,
                failed,
                kept,
            ))
        group.clear()

    for text in texts:
        words = text.encode().split()
        if group and size + len(words) > ARRAY_WORDS:
            flush()
            size = 0
        group.append((text, words))
        size += len(words)
    flush()
    return out


FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_covered_words long, longest_repeat long, base_failed boolean, kept boolean"
)


def quality_report(docs: DataFrame, limits: Limits = Limits(), key: str = "doc_id") -> DataFrame:
    """A row with the measures and the verdict for each document."""

    def rows(keys: list, texts: list[str]) -> list[list]:
        return [keys, *map(list, zip(*judged(texts, limits), strict=True))]

    kind = docs.schema[key].dataType.simpleString()
    return map_rows(docs, [F.col(key), text_of()], f"{key} {kind}, {FIELDS}", rows)


def good_documents(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The documents that pass, with all their columns."""
    at_hand(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                texts = [text or "" for text in batch.column(at).to_pylist()]
                yield batch.filter(pa.array([row[-1] for row in judged(texts, limits)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
