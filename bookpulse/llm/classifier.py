"""Quality by logistic regression over hashed word n-grams, learned with follow-the-regularised-leader.

A text's tokens are its runs of letters and digits and its runs of other signs. Its features are
single tokens and pairs of neighbours, hashed into ``SIZE`` places; a feature's value is 1 + log of
its count, and a text's values have length 1. A score is the logistic of one sparse dot product.

Learning takes at most ``SAMPLE`` labelled documents, those whose ids have the least hashes; a
smaller set is taken whole. They are dealt into ``SHARDS`` shards. In each of ``ROUNDS`` rounds every
shard runs the per-coordinate FTRL-proximal updates from the common state, example by example,
``PASSES`` times over, and the changes of a coordinate are averaged over the shards that met it. The
state has two numbers a place, whatever the input, and a shard that loses its executor is computed
again to the same state.

Null and empty texts have no feature and get the score of the offset alone. Null labels and null ids
aren't learned from; if an id has several labels the highest counts, and of several texts of an id one
is learned from. Without labels every score is 0.5. Repeated rows are scored alike, one by one. Whole
texts count, whatever their length. Extra columns are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookpulse.llm.common import map_rows, pa_schema, store, text_of

TOKEN = re.compile(r"[^\W_]+|(?:[^\w\s]|_)+")
#: Places of features; the offset has the place after them.
SIZE = 1 << 20
#: Labelled documents that are learned from at most, and into how many shards they are dealt.
SAMPLE, SHARDS, ROUNDS, PASSES = 20_000, 4, 3, 3
#: Token hashes a worker remembers.
REMEMBERED = 500_000
PAIR, AGAIN = np.uint64(0x9E3779B97F4A7C15), np.uint64(1)


@dataclass(frozen=True)
class Rates:
    """FTRL-proximal: learning rate, its damping, and the penalties."""

    alpha: float = 20.0
    beta: float = 1.0
    l1: float = 0.01
    l2: float = 0.005


class Hashes(dict):
    """Token to 64-bit number, computed when first asked for."""

    def __missing__(self, token: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        value = self[token] = xxhash.xxh64_intdigest(token)
        return value


def features(text: str, known: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Places of a text and their counts."""
    tokens = TOKEN.findall(text)
    if not tokens:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    one = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
    two = np.where(one[:-1] == one[1:], AGAIN, (one[:-1] * PAIR) ^ (one[1:] >> np.uint64(1)))
    both = np.sort((np.concatenate((one, two * PAIR)) >> np.uint64(44)).astype(np.int32))
    start = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1])))
    return both[start], np.diff(np.append(start, len(both))).astype(np.int32)


def values_of(counts: np.ndarray) -> np.ndarray:
    values = 1 + np.log(counts)
    return values / np.sqrt((values * values).sum())


def weights(z: np.ndarray, n: np.ndarray, rates: Rates) -> np.ndarray:
    """The weights a state stands for; the last of it is the offset, which has no penalty."""
    penalty = np.ones(len(z))
    penalty[-1] = 0
    shrunk = np.sign(z) * np.maximum(np.abs(z) - rates.l1 * penalty, 0)
    return -shrunk / ((rates.beta + np.sqrt(n)) / rates.alpha + rates.l2 * penalty)


def learn(examples: list[tuple[np.ndarray, np.ndarray, int]], z: np.ndarray, n: np.ndarray, rates: Rates) -> None:
    """Runs the updates over examples (places, counts, label), in place."""
    for places, counts, label in examples:
        at = np.append(places, SIZE)
        x = np.append(values_of(counts), 1.0)
        w = weights(z[at], n[at], rates)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - label) * x
        squares = n[at] + g * g
        z[at] += g - (np.sqrt(squares) - np.sqrt(n[at])) / rates.alpha * w
        n[at] = squares


def examples_of(docs: DataFrame, known: DataFrame, sample: int) -> DataFrame:
    """(shard, at, label, places, counts) of at most ``sample`` documents with a label."""
    place = F.xxhash64("doc_id", F.lit(11))
    chosen = store(known.orderBy(place, "doc_id").limit(sample), "chosen")
    # At most ``sample`` rows of an id and a label: texts without one needn't move to meet them.
    met = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id")

    def rows(ids: list, texts: list[str], labels: list[int]) -> list[list]:
        memory = Hashes()
        found = [features(text, memory) for text in texts]
        return [ids, labels, [xxhash.xxh64_intdigest(t) >> 1 for t in texts], [f[0] for f in found], [f[1] for f in found]]

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = map_rows(
        met, [F.col("doc_id"), F.col("text"), F.col("label")],
        f"doc_id {kind}, label int, text_hash long, places array<int>, counts array<int>", rows,
    )
    one = made.groupBy("doc_id").agg(F.min(F.struct("text_hash", "label", "places", "counts")).alias("x"))
    return store(
        one.select(F.pmod(place, F.lit(SHARDS)).cast("int").alias("shard"), place.alias("at"), "x.label", "x.places", "x.counts"),
        "examples",
    )


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rates: Rates = Rates()) -> np.ndarray:
    """The weights, learned from documents (doc_id, text) and labels (doc_id, label)."""
    spark = docs.sparkSession
    known = labels.where("label is not null and doc_id is not null").groupBy("doc_id").agg(
        F.max(F.col("label").cast("int")).alias("label")
    )
    examples = examples_of(docs, known.withColumn("label", (F.col("label") > 0).cast("int")), sample)
    z, n = np.zeros(SIZE + 1), np.zeros(SIZE + 1)
    schema = "place int, z float, n float"
    fields = pa_schema(spark, schema)

    def pass_from(state: Broadcast) -> Callable[[pa.Table], pa.Table]:
        def run(shard: pa.Table) -> pa.Table:
            rows = shard.sort_by("at")
            columns = [rows[c].combine_chunks() for c in ("places", "counts")]
            flat, ends = [c.flatten().to_numpy() for c in columns], columns[0].offsets.to_numpy()
            own = [x.copy() for x in state.value]
            each = zip(ends[:-1], ends[1:], rows["label"].to_pylist(), strict=True)
            learn([(flat[0][a:b], flat[1][a:b], label) for a, b, label in each] * PASSES, *own, rates)
            changed = np.flatnonzero(own[1] != state.value[1])
            out = [changed, *[(now - was)[changed] for now, was in zip(own, state.value, strict=True)]]
            return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(out, fields, strict=True)], schema=fields)

        return run

    for _ in range(ROUNDS):
        state = spark.sparkContext.broadcast((z, n))
        changes = examples.groupBy("shard").applyInArrow(pass_from(state), schema)
        # At most SIZE + 1 rows come back.
        moved = changes.groupBy("place").agg(F.avg("z").alias("z"), F.avg("n").alias("n")).toArrow()
        z[moved["place"].to_numpy()] += moved["z"].to_numpy()
        n[moved["place"].to_numpy()] += moved["n"].to_numpy()
        state.destroy()
    return weights(z, n, rates)


def score(docs: DataFrame, learned: np.ndarray, keep: list[Column]) -> DataFrame:
    """The kept columns and ``score`` of every document."""
    model = docs.sparkSession.sparkContext.broadcast(learned.astype(np.float32))
    kept = docs.select(*keep).schema
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def rows(*columns: list) -> list[list]:
        w, memory, out = model.value, Hashes(), []
        for text in columns[-1]:
            places, counts = features(text, memory)
            raw = float(w[places].astype(np.float64) @ values_of(counts)) + float(w[SIZE])
            out.append(1 / (1 + float(np.exp(-np.clip(raw, -35, 35)))))
        return [*columns[:-1], out]

    return map_rows(docs, [*keep, text_of()], f"{kinds}, score double", rows)
