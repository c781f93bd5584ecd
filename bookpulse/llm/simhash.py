"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint has a bit set if more than half of its text's shingle hashes have. Fingerprints within
``limit`` bits are found so:

1. Bit and bit-pair counts over all fingerprints give the correlation of bits; correlated bits are
   grouped into parts, so that the parts are as independent of each other as they can be.
2. Each part gets a threshold of its own, from -1 (not probed) up. If they add up to
   ``limit - parts + 1``, two fingerprints within ``limit`` bits differ by at most the threshold in at
   least one part. Dynamic programming picks the thresholds with the least estimated work: the exact
   number of pairs that share a part's value, widened by the odds that further bits differ.
3. Every fingerprint is put in the bucket of its value of each probed part, and of each value within
   the threshold.
4. Buckets with more than ``BUCKET`` members are dealt again by parts of their other bits (two members
   within ``limit`` bits agree in one of ``limit + 1`` parts), so large buckets are split exactly.
5. Within a bucket distances are computed a row at a time, and only the links of a spanning forest
   leave it, nearest first: no more links than members, and the same components as all pairs give.

Equal fingerprints are one node. Links are joined to components by stars (components.py).

Null and empty texts have fingerprint zero, which links like any other. Null ids are never the id of
a component that has another. Repeated rows are in one component. Other columns don't matter.

``without_near_duplicates`` keeps one document of each component, the one with the least id (null ids
last, then the least digest of the text); extra columns go along, whatever their names. Long texts are
read whole; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookpulse.llm.common import keep_rows, map_rows, pa_schema, store, text_of
from bookpulse.llm.components import components

SEED = 42
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
BITS = 64
BUCKET = 20_000
#: What a row that moves costs, in compared pairs; for the choice of thresholds.
ROW_COST = 400
#: Shingles whose bits are added up at once.
BLOCK = 1 << 16


def words_of(text: str) -> list[bytes]:
    """Words with A to Z in lower case; bytes.split knows the same six white-space characters."""
    return text.encode().translate(LOWER).split()


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of each shingle; fewer words are one shingle, none give none."""
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    line = b" ".join(words)
    if len(words) <= size:
        return np.array([digest(line, SEED)], np.uint64)
    starts = list(accumulate((len(word) + 1 for word in words), initial=0))
    return np.array([digest(line[a : b - 1], SEED) for a, b in zip(starts, starts[size:], strict=False)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The 64 bits as a signed integer."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), BLOCK):
        octets = hashes[k : k + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, size: int = 3, keep: dict[str, Column] | None = None) -> DataFrame:
    """The kept columns (``doc_id`` if none are named) and ``fingerprint`` of every document."""
    kept = docs.select(*[c.alias(name) for name, c in (keep or {"doc_id": F.col("doc_id")}).items()]).schema

    def rows(*columns: list) -> list[list]:
        return [*columns[:-1], [fingerprint(shingle_hashes(words_of(text), size)) for text in columns[-1]]]

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    return map_rows(docs, [*(keep or {"doc_id": F.col("doc_id")}).values(), text_of()], f"{kinds}, fingerprint long", rows)


def signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def bits_set(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(values.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_statistics(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """The number of nodes, and for each pair of bits how many nodes have both set."""
    schema = "i int, j int, n long"
    fields = pa_schema(nodes.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS + 1, BITS + 1), np.int64)
        for batch in batches:
            if batch.num_rows:
                values = bits_set(batch.column(0).to_numpy())
                set_bits = np.column_stack((values, np.ones(len(values)))).astype(np.float64)
                total += (set_bits.T @ set_bits).astype(np.int64)
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], schema=fields)

    both = np.zeros((BITS + 1, BITS + 1))
    for i, j, n in nodes.select("probe").mapInArrow(run, schema).groupBy("i", "j").agg(F.sum("n")).collect():
        both[i, j] = n
    return int(both[BITS, BITS]), both[:BITS, :BITS]


def correlation(n: int, both: np.ndarray) -> np.ndarray:
    share = np.diag(both) / max(n, 1)
    apart = both / max(n, 1) - np.outer(share, share)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    found = np.abs(apart / np.outer(spread, spread))
    np.fill_diagonal(found, 0)
    return found


def grouped_bits(related: np.ndarray, parts: int) -> list[list[int]]:
    """Parts of nearly equal width; each grows from a bit by the bits most related to it."""
    free, out = set(range(BITS)), []
    for k in range(parts):
        width = (BITS - sum(map(len, out))) // (parts - k)
        part: list[int] = []
        while len(part) < width:
            near = part or sorted(free)
            part.append(max(sorted(free), key=lambda b: related[b, near].sum()))
            free.remove(part[-1])
        out.append(part)
    return out


def mask_of(bits: list[int]) -> int:
    return signed(sum(1 << b for b in bits))


def widened(odds: np.ndarray, most: int) -> list[float]:
    """Elementary symmetric sums: the weight of 0, 1 .. most further bits that differ."""
    sums = [1.0] + [0.0] * most
    for o in odds:
        for k in range(most, 0, -1):
            sums[k] += o * sums[k - 1]
    return sums


def allocate(work: list[list[float]], total: int) -> tuple[float, list[int]] | None:
    """Thresholds from -1 up with the given sum and the least work; ``work[p][t + 1]``."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for costs in work:
        grown: dict[int, tuple[float, list[int]]] = {}
        for done, (cost, chosen) in best.items():
            for t, more in enumerate(costs, start=-1):
                if done + t not in grown or cost + more < grown[done + t][0]:
                    grown[done + t] = (cost + more, [*chosen, t])
        best = grown
    return best.get(total)


def plan(nodes: DataFrame, limit: int) -> tuple[list[list[int]], list[int]]:
    """Parts and thresholds for these nodes."""
    n, both = bit_statistics(nodes)
    related = correlation(n, both)
    share = np.clip(np.diag(both) / max(n, 1), 1e-3, 1 - 1e-3)
    differ = 2 * share * (1 - share)
    layouts = [grouped_bits(related, parts) for parts in sorted({limit + 1, limit // 2 + 1}) if parts > 1 or limit == 0]
    numbered = [(k, p, mask_of(bits)) for k, layout in enumerate(layouts) for p, bits in enumerate(layout)]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(p).alias("p"), F.lit(m).alias("mask")) for k, p, m in numbered]))
    shared = (
        nodes.select("probe", each.alias("s"))
        .groupBy("s.k", "s.p", F.col("probe").bitwiseAND(F.col("s.mask")).alias("value"))
        .agg(F.count("*").cast("double").alias("n"))
        .groupBy("k", "p")
        .agg(F.sum(F.col("n") * F.col("n")).alias("pairs"))
    )
    pairs = {(row.k, row.p): row.pairs for row in shared.collect()}
    choices = []
    for k, layout in enumerate(layouts):
        work = []
        for p, bits in enumerate(layout):
            sums = widened(differ[bits] / (1 - differ[bits]), 2)
            count, costs = pairs.get((k, p), 0.0), [0.0]
            rows = 0
            for t in range(3):
                rows += len(list(combinations(bits, t)))
                costs.append(count * sum(sums[: t + 1]) / 2 + ROW_COST * n * rows)
            work.append(costs)
        if found := allocate(work, limit - len(layout) + 1):
            choices.append((found[0], layout, found[1]))
    _, layout, thresholds = min(choices, key=lambda c: c[0])
    return layout, thresholds


def probes(nodes: DataFrame, layout: list[list[int]], thresholds: list[int]) -> DataFrame:
    """(mask, value, id, probe, check): each node in all its buckets."""
    flips = [
        (mask_of(bits), mask_of(list(flipped)))
        for bits, t in zip(layout, thresholds, strict=True)
        for k in range(t + 1)
        for flipped in combinations(bits, k)
    ]
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("mask"), F.lit(f).alias("flip")) for m, f in flips]))
    value = F.col("probe").bitwiseAND(F.col("s.mask")).bitwiseXOR(F.col("s.flip"))
    return nodes.select("id", "probe", "check", each.alias("s")).select("s.mask", value.alias("value"), "id", "probe", "check")


def refined(large: DataFrame, masks: list[int], limit: int) -> DataFrame:
    """Members of large buckets, dealt again by parts of the bits that their mask leaves."""
    def parts(mask: int) -> Column:
        free = [b for b in range(BITS) if not mask >> b & 1]
        slices = [free[k :: limit + 1] for k in range(limit + 1)]
        return F.array(*[F.lit(mask_of(bits)).cast("long") for bits in slices if bits])

    more = reduce(lambda rest, mask: F.when(F.col("mask") == mask, parts(mask)).otherwise(rest), masks, F.lit(None).cast("array<long>"))
    dealt = large.withColumn("more", F.explode(more))
    return dealt.select(
        F.col("mask").bitwiseOR(F.col("more")).alias("mask"),
        F.col("value").bitwiseOR(F.col("probe").bitwiseAND(F.col("more"))).alias("value"),
        "id", "probe", "check",
    ).distinct()


def forest(ids: np.ndarray, probe: np.ndarray, check: np.ndarray, limit: int, check_limit: int) -> tuple[list, list]:
    """A minimum spanning forest over pairs within both limits, by the distance of ``check``."""
    n, far = len(ids), 127
    near, parent, open_ = np.full(n, far, np.uint8), np.zeros(n, np.int64), np.ones(n, bool)
    a, b = [], []
    now = 0
    for _ in range(n - 1):
        open_[now] = False
        weight = np.bitwise_count(check ^ check[now])
        weight[(np.bitwise_count(probe ^ probe[now]) > limit) | (weight > check_limit)] = far
        better = weight < near
        near[better] = weight[better]
        parent[better] = now
        now = int(np.argmin(np.where(open_, near, 255)))
        if near[now] < far:
            a.append(ids[parent[now]])
            b.append(ids[now])
    return a, b


def forests(members: DataFrame, limit: int, check_limit: int) -> DataFrame:
    """The links (a, b) of each bucket's forest; a bucket streams through as one run of sorted rows."""
    schema = "a long, b long"
    fields = pa_schema(members.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in chain(batches, [None]):
            last = batch is None
            if not last:
                columns = [c.to_numpy() for c in batch.columns]
                columns[3:] = [c.view(np.uint64) for c in columns[3:]]  # bits of a negative number count as they are
                held = columns if held is None else [np.concatenate(x) for x in zip(held, columns, strict=True)]
            if held is None or not len(held[0]):
                continue
            mask, value = held[0], held[1]
            start = np.flatnonzero(np.concatenate(([True], (mask[1:] != mask[:-1]) | (value[1:] != value[:-1]))))
            stop = np.append(start[1:], len(mask))
            whole = len(start) if last else len(start) - 1
            a, b = [], []
            for s, e in zip(start[:whole].tolist(), stop[:whole].tolist(), strict=True):
                if e - s > 1:
                    links = forest(*[x[s:e] for x in held[2:]], limit, check_limit)
                    a += links[0]
                    b += links[1]
            held = None if last else [x[start[-1] :] for x in held]
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=fields)

    ordered = members.select("mask", "value", "id", "probe", "check").repartition("mask", "value")
    return ordered.sortWithinPartitions("mask", "value", "id").mapInArrow(run, schema)


def links(nodes: DataFrame, limit: int, check_limit: int = BITS) -> DataFrame:
    """Links (a, b) that join all nodes (id, probe, check) within the limits of each other."""
    spark = nodes.sparkSession
    if nodes.isEmpty():
        return spark.createDataFrame([], "a long, b long")
    found = None
    dealt = probes(nodes, *plan(nodes, limit))
    while True:
        sizes = store(dealt.groupBy("mask", "value").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
        members = store(dealt.join(sizes, ["mask", "value"]), "members")
        masks = [row.mask for row in members.where(F.col("n") > BUCKET).select("mask").distinct().collect()]
        # Masks are as many as there are ways through the parts. Where few bits are left, a bucket is small.
        split = [m for m in masks if BITS - (m % (1 << BITS)).bit_count() > 8]
        ends = (F.col("n") <= BUCKET) | ~F.col("mask").isin(split) if split else F.lit(True)
        more = store(forests(members.where(ends), limit, check_limit).distinct(), "forests")
        found = more if found is None else found.unionByName(more)
        if not split:
            return found.distinct()
        dealt = refined(members.where(~ends), split, limit)


def linked(rows: DataFrame, limit: int) -> DataFrame:
    """(fingerprint, component) of every fingerprint among the rows; a component is named by one of its own."""
    nodes = rows.select("fingerprint").distinct()
    graph = store(nodes.select(*[F.col("fingerprint").alias(name) for name in ("id", "probe", "check")]), "nodes")
    labels = store(components(links(graph, limit)), "labels")
    joined = graph.join(labels, F.col("node") == F.col("id"), "left")
    return joined.select(F.col("id").alias("fingerprint"), F.coalesce("component", "id").alias("component"))


def fingerprint_components(docs: DataFrame, size: int = 3, limit: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document; the component is its least ``doc_id``."""
    rows = store(fingerprints(docs, size), "fingerprints")
    first = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first"))
    joined = store(first.join(linked(rows, limit), "fingerprint"), "components")
    least = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    named = joined.join(least, "component").select("fingerprint", "component_id")
    return rows.join(named, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def without_near_duplicates(docs: DataFrame, size: int = 3, limit: int = 2) -> DataFrame:
    """One document of each component of fingerprints, with its own columns."""
    sha = F.sha2(text_of().cast("binary"), 256)
    rows = store(fingerprints(docs, size, {"doc_id": F.col("doc_id"), "sha": sha}), "fingerprints")
    counted = rows.groupBy("fingerprint", "doc_id", "sha").agg(F.count("*").alias("rows"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "sha", "rows").alias("row")
    stays = counted.join(linked(rows, limit), "fingerprint").groupBy("component").agg(F.min(order).alias("row"))
    return keep_rows(docs, stays.select("row.doc_id", "row.sha", "row.rows"))
