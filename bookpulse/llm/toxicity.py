"""Toxicity by class-conditional Kneser-Ney models of words.

A document is the set of its words, so that a line repeated in it isn't new evidence. Two models share
one backoff. A word's probability in a class is its document count there less the class's discount,
over all counts of the class, plus the discounted mass times the word's share of continuation counts:
after how many different words (or at the start) it has been met in either class. The discounts come
from the counts of counts, n1 / (n1 + 2 n2), for each class.

A document's raw score is the log-likelihood of its words under the toxic model less that under the
ordinary one, per word. Each word's log ratio is first moved towards zero by ``SURE`` standard errors
of the ratio of its two counts. Documents come in languages, subjects and near copies, so that counts
vary more than chance: ``SPREAD`` is the variance a ratio keeps however many documents there are. A word that neither class has seen tells nothing. A logistic curve
over raw scores, fitted on labelled documents that the counts leave out, gives the score.

Counts, continuation pairs and ratios cover every labelled document of the training part and grow with
them; words go by 64-bit hashes. Up to ``TABLE`` ratios are sent to the tasks; beyond that the words of
documents are joined with them. Ratios are whole millionths, so both ways give the same sums.

Null and empty texts, and texts without a letter or digit, have raw score 0. Texts of any length are
read whole, and counted pair by pair. Null labels are not learned from; if an id has several labels,
the highest counts. Without both classes every score is the share of toxic labels (0 without labels).
Repeated rows are scored alike; of equal texts of one class the counts learn once. Equal raw scores get
equal scores. Without documents there are no rows. Only doc_id, text and the kept columns are read, so
other columns may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookpulse.llm.common import map_rows, pa_schema, store, text_of

WORD = re.compile(r"[^\W_]+")
#: Standard errors that a log ratio gives up: the one-sided bound of 95%.
SURE = 1.645
SPREAD = 0.3
#: Alike words added to every document, so that a single word doesn't decide a short one.
ALIKE = 15
#: Log ratios are kept in whole parts of one in so many.
PARTS = 1_000_000
#: Up to so many ratios (16 bytes each) are sent to the tasks.
TABLE = 1_000_000
#: Pairs of words that a task gathers before it hands them on.
GATHERED = 100_000
ID_BITS = 1 << 24
#: Raw scores are bent so that short texts, whose scores are large, don't rule the curve; then cut in steps.
UNIT, STEPS, STEP = 0.005, 500, 0.02


def key(word: str) -> int:
    """A word's 64-bit number, signed."""
    value = xxhash.xxh64_intdigest(word)
    return value - (1 << 64) if value >> 63 else value


def among(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that may have a label: those whose id's bit is set in a map of fixed size.

    Texts without a label needn't move to meet the labels; the join after it is exact.
    """
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(ID_BITS))
    cells = (
        labels.select(spot.alias("spot"))
        .groupBy(F.floor(F.col("spot") / 64).alias("cell"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(spot % 64 as int))")).alias("bits"))
        .toArrow()
    )
    bits = np.zeros(ID_BITS // 64, np.int64)
    bits[cells["cell"].to_numpy()] = cells["bits"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, spot long"
    pa_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).to_numpy()
            known = (shared.value[at >> 6] >> (at & 63)) & 1
            yield batch.filter(pa.array(known.astype(bool)))

    return docs.select("doc_id", text_of().alias("text"), spot.alias("spot")).mapInArrow(run, schema).drop("spot")


def counts(train: DataFrame) -> DataFrame:
    """(word, toxic, ordinary, lefts) from rows of (text, toxic): different texts by class, and different words before it."""
    schema = "word long, before long, toxic long, ordinary long"
    fields = pa_schema(train.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list[int]] = {}
        pairs: set[tuple[int, int]] = set()
        known: dict[str, int] = {}

        def gathered() -> pa.RecordBatch:
            words, lefts = [*seen], [*pairs]
            none = [0] * len(lefts)
            columns = (
                words + [word for _, word in lefts],
                [None] * len(words) + [left for left, _ in lefts],
                [n[0] for n in seen.values()] + none,
                [n[1] for n in seen.values()] + none,
            )
            seen.clear(), pairs.clear(), known.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=fields)

        for batch in batches:
            for text, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                left, of_text = key(""), set()
                for match in WORD.finditer(text.lower()):
                    word = known.get(match[0])
                    if word is None:
                        word = known[match[0]] = key(match[0])
                    of_text.add(word)
                    pairs.add((left, word))
                    left = word
                    if len(pairs) >= GATHERED:
                        yield gathered()
                for word in of_text:
                    seen.setdefault(word, [0, 0])[0 if toxic else 1] += 1
        yield gathered()

    found = train.select("text", "toxic").distinct().mapInArrow(run, schema)
    pairs = found.groupBy("word", "before").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    return pairs.groupBy("word").agg(
        F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"), F.count("before").alias("lefts")
    )


def discount(ones: int, twos: int) -> float:
    """What Kneser-Ney takes from every count; one half where the counts of counts don't say."""
    return ones / (ones + 2 * twos) if ones and twos else 0.5


def ratios(counted: DataFrame) -> DataFrame:
    """(word, part): the bounded log ratio of both models in whole parts, for the words where it isn't 0."""
    of_class = [
        f(c).alias(f"{c}_{name}")
        for c in ("toxic", "ordinary")
        for name, f in (
            ("all", F.sum),
            ("types", lambda c: F.count_if(F.col(c) > 0)),
            ("ones", lambda c: F.count_if(F.col(c) == 1)),
            ("twos", lambda c: F.count_if(F.col(c) == 2)),
        )
    ]
    n = counted.agg(*of_class, F.sum("lefts").alias("lefts")).first()
    if not n.toxic_all or not n.ordinary_all:
        return counted.select("word", F.lit(0).cast("long").alias("part")).where("false")
    shared = F.col("lefts") / n.lefts

    def chance(c: str) -> Column:
        off = discount(n[f"{c}_ones"], n[f"{c}_twos"])
        freed = off * n[f"{c}_types"] / n[f"{c}_all"]
        return F.greatest(F.col(c) - off, F.lit(0.0)) / n[f"{c}_all"] + shared * freed

    ratio = F.log(chance("toxic") / chance("ordinary"))
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("ordinary") + 0.5) + SPREAD)
    bounded = F.signum(ratio) * F.greatest(F.abs(ratio) - SURE * error, F.lit(0.0))
    return counted.select("word", F.round(bounded * PARTS).cast("long").alias("part")).where("part <> 0")


def raw_scores(docs: DataFrame, model: DataFrame, keep: list[Column]) -> DataFrame:
    """The kept columns and the difference of log-likelihoods per word, by a written table of ratios."""
    small = model.count() <= TABLE
    return (by_table if small else by_join)(docs, model, keep)


def kinds_of(docs: DataFrame, keep: list[Column]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)


def per_word(total: int, words: int) -> float:
    return total / PARTS / (ALIKE + words)


def by_table(docs: DataFrame, model: DataFrame, keep: list[Column]) -> DataFrame:
    """Raw scores with all ratios in every task."""
    found = model.toArrow()
    words = found["word"].to_numpy()
    order = np.argsort(words)
    shared = docs.sparkSession.sparkContext.broadcast((words[order], found["part"].to_numpy()[order]))

    def rows(*columns: list) -> list[list]:
        names, parts = shared.value
        out: list[float] = []
        for text in columns[-1]:
            words = {*WORD.findall(text.lower())}
            total = 0
            if words and len(names):
                keys = np.fromiter(map(key, words), np.int64, len(words))
                at = np.minimum(np.searchsorted(names, keys), len(names) - 1)
                total = int(parts[at][names[at] == keys].sum())
            out.append(per_word(total, len(words)))
        return [*columns[:-1], out]

    return map_rows(docs, [*keep, text_of()], f"{kinds_of(docs, keep)}, raw double", rows)


def by_join(docs: DataFrame, model: DataFrame, keep: list[Column]) -> DataFrame:
    """Raw scores by a join of each document's words with the ratios; a document's row is written first."""

    def rows(*columns: list) -> list[list]:
        return [*columns[:-1], [[*map(key, {*WORD.findall(text.lower())})] for text in columns[-1]]]

    kept = [F.struct(*keep).alias("kept")]
    listed = map_rows(docs, [*kept, text_of()], f"{kinds_of(docs, kept)}, words array<long>", rows)
    listed = store(listed.withColumn("row", F.monotonically_increasing_id()), "words-of-rows")
    totals = (
        listed.select("row", F.explode("words").alias("word")).join(model, "word")
        .groupBy("row").agg(F.sum("part").alias("total"))
    )
    mean = F.coalesce("total", F.lit(0)) / F.lit(float(PARTS)) / (ALIKE + F.size("words"))
    return listed.join(totals, "row", "left").select("kept.*", mean.alias("raw"))


def logistic(x: np.ndarray, ones: np.ndarray, all_: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the curve through shares of ones, by Newton steps on a slightly damped fit."""
    slope, offset = 1.0, float(np.log((ones.sum() + 1) / (all_.sum() - ones.sum() + 1)))
    scale = float(np.sqrt((all_ * x * x).sum() / max(all_.sum(), 1))) or 1.0
    z = x / scale
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(slope * z + offset, -30, 30)))
        weight = all_ * p * (1 - p)
        gap = ones - all_ * p
        gradient = np.array([(gap * z).sum() - 1e-3 * slope, gap.sum()])
        curve = np.array([[(weight * z * z).sum() + 1e-3, (weight * z).sum()], [(weight * z).sum(), weight.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(curve, gradient), -2, 2)
        slope, offset = slope + step[0], offset + step[1]
    return slope / scale, offset


def score(docs: DataFrame, labels: DataFrame, fold: Column, count_folds: tuple[int, ...], fit_folds: tuple[int, ...], keep: list[Column]) -> DataFrame:
    """The kept columns, ``raw`` and ``score`` of every document; only labels of the given folds are read."""
    known = (
        labels.where("toxic is not null and doc_id is not null")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .withColumn("toxic", F.col("toxic") > 0)
    )
    train = known.where(fold.isin(*count_folds))
    counted = store(counts(among(docs, train).join(train, "doc_id")), "word-counts")
    model = store(ratios(counted), "word-ratios")
    raw = store(raw_scores(docs, model, [F.col("doc_id").alias("__id"), *keep]), "raw-scores")
    bent = F.asinh(F.col("raw") / UNIT)
    step = F.round(bent / STEP).cast("int")
    fitted = (
        raw.select("__id", "raw").join(known.where(fold.isin(*fit_folds)), F.col("__id") == F.col("doc_id"))
        .groupBy(F.least(F.greatest(step, F.lit(-STEPS)), F.lit(STEPS)).alias("step"))
        .agg(F.sum(F.col("toxic").cast("long")).alias("ones"), F.count("*").alias("n"))
        .toArrow()
    )
    if fitted.num_rows:
        slope, offset = logistic(*(fitted[c].to_numpy().astype(float) * f for c, f in (("step", STEP), ("ones", 1), ("n", 1))))
    else:
        slope, offset = 0.0, -30.0
    curve = 1 / (1 + F.exp(-(bent * slope + offset)))
    return raw.withColumn("score", curve).drop("__id")
