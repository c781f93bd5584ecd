"""SentencePiece encoding and decoding by a max-plus parallel scan.

A text's segmentations are paths through a lattice whose edges are pieces. A unigram model weighs an
edge by its piece's score. A byte-pair model weighs a step from piece to piece by 0 if encoding the
two together gives the two again, else by minus infinity: a sequence of pieces is the encoding of its
text exactly if each adjacent pair is (a first merge across a border would happen in the pair alone
as well), so each prefix has one path. Both give the ids that the model's own library gives.

Long texts are cut into chunks anywhere. The states at a border are the pieces that can lie over its
last character. Each chunk yields a matrix with the best weight from each state at its start to each
at its end; matrices are combined by (max, +) products, which are associative, in a scan; then every
chunk is traced back alone between its two states. Where no piece of the vocabulary can lie across a
place (before a space mark that follows another character), all paths meet: between the first and the
last such place of a chunk the path doesn't depend on the states, so the matrix takes work only at
both ends, and words between such places are encoded once and remembered.

Texts up to ``CHUNK`` characters are one chunk. Chunks of a longer text go to different tasks; what
meets in one task is its matrices, of a few states each. Null and empty texts have no ids. Characters
outside the vocabulary become bytes if the model has them, else its unknown id. Pieces marked unused
or user-defined are treated like others; the model file's own normalisation is applied before.
Other columns are carried along. Repeated rows are encoded one by one.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookpulse.llm.common import pa_schema, store, text_of

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 65_536
MARK = "▁"
#: Words and pairs that a worker remembers before it drops the older ones.
REMEMBERED = 500_000
#: Characters at a word's start whose paths are remembered for other words.
HEAD = 6
#: Documents that are encoded before they are handed on.
SLICE = 500
NEVER = -math.inf
#: The parts of a text between its cuts.
WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Lattice:
    """Best paths over the pieces of a vocabulary (piece -> score), ``merged`` for byte-pair models."""

    def __init__(self, scores: dict[str, float], merged: bool):
        self.scores, self.merged = scores, merged
        self.longest = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - 10.0
        self.cuts = not any(b == MARK != a for piece in scores for a, b in zip(piece, piece[1:], strict=False))
        self.pairs: dict[tuple[str, str], bool] = {}
        #: Last pieces of all prefixes of the first characters that words share.
        self.heads: dict[str, list[str]] = {}

    def merge(self, text: str) -> list[str]:
        """Byte-pair encoding: of all adjacent pairs that form a piece, the best and leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            found = [(-self.scores[both], k) for k in range(len(parts) - 1) if (both := parts[k] + parts[k + 1]) in self.scores]
            if not found:
                break
            k = min(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def follows(self, a: str, b: str) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= REMEMBERED:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merge(a + b) == ([a, b] if a else [b])
        return known

    def forward(self, text: str, start: int, end: int, before: str = "") -> tuple[list[float], list[int]]:
        """For each place from ``start`` to ``end``: the best weight and where the last piece began.

        ``before`` is the piece that ends at ``start``, if there is one.
        """
        size = end - start
        best, back = [NEVER] * (size + 1), [-1] * (size + 1)
        best[0] = 0.0
        scores, longest = self.scores, self.longest
        last = [before] + [""] * size
        for at in range(1, size + 1):
            for width in range(min(longest, at), 0, -1):
                piece = text[start + at - width : start + at]
                from_ = best[at - width]
                if from_ == NEVER or (width > 1 and piece not in scores):
                    continue
                if self.merged:
                    if self.follows(last[at - width], piece):
                        best[at], back[at], last[at] = 0.0, at - width, piece
                        break
                else:
                    weight = from_ + scores.get(piece, self.unknown)
                    if weight > best[at]:
                        best[at], back[at], last[at] = weight, at - width, piece
        return best, back

    def trace(self, text: str, start: int, end: int, before: str = "") -> list[str]:
        back = self.forward(text, start, end, before)[1]
        out, at = [], end - start
        while at > 0:
            out.append(text[start + back[at] : start + at])
            at = back[at]
        return out[::-1]

    def word(self, text: str) -> list[str]:
        """The pieces of a text between two cuts."""
        if not self.merged:
            return self.trace(text, 0, len(text))
        # ``forward`` for byte pairs from a text's start: a prefix has one path, so its last piece is enough.
        pairs, scores, longest = self.pairs, self.scores, self.longest
        head = text[:HEAD] if len(text) > HEAD else ""
        last = self.heads.get(head)
        last = [""] if last is None else last.copy()
        for at in range(len(last), len(text) + 1):
            if at == HEAD + 1 and head and head not in self.heads:
                if len(self.heads) >= REMEMBERED:
                    self.heads.clear()
                self.heads[head] = last.copy()
            for begin in range(at - 1, max(at - longest, 0) - 1, -1):
                piece = text[begin:at]
                if piece in scores or begin == at - 1:
                    fits = pairs.get((last[begin], piece))
                    if self.follows(last[begin], piece) if fits is None else fits:
                        last.append(piece)
                        break
        out, at = [], len(text)
        while at:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def places(self, text: str, start: int, end: int) -> list[int]:
        """The cuts from ``start`` to ``end``: before a mark that doesn't follow a mark."""
        if not self.cuts:
            return []
        out, at = [], text.find(MARK, max(start, 1), end)
        while at >= 0:
            if text[at - 1] != MARK:
                out.append(at)
            at = text.find(MARK, at + 1, end)
        return out

    def states(self, text: str, border: int) -> list[tuple[int, int]]:
        """The pieces, as spans, that can lie over the character before the border."""
        return [
            (a, b)
            for a in range(max(0, border - self.longest), border)
            for b in range(border, min(len(text), a + self.longest) + 1)
            if b - a == 1 or text[a:b] in self.scores
        ]

    def weight(self, text: str, reached: float, before: str, state: tuple[int, int]) -> float:
        piece = text[state[0] : state[1]]
        if reached == NEVER or (self.merged and not self.follows(before, piece)):
            return NEVER
        return reached + (0.0 if self.merged else self.scores.get(piece, self.unknown))

    def from_(self, text: str, start: int, before: str, ends: list[tuple[int, int]]) -> list[float]:
        """The best weight from ``start``, where the piece ``before`` ends, to each of the states."""
        furthest = max(a for a, _ in ends)
        best, back = self.forward(text, start, max(furthest, start), before)
        out = []
        for a, b in ends:
            at = a - start
            if at < 0:  # only a piece that reaches over the whole chunk is both its first and its last state
                out.append(0.0 if before and (a, b) == (start - len(before), start) else NEVER)
                continue
            last = text[start + back[at] : a] if at > 0 and back[at] >= 0 else before
            out.append(self.weight(text, best[at], last, (a, b)))
        return out

    def matrix(self, text: str, low: int, high: int, final: bool) -> np.ndarray:
        """The best weights of a chunk [low, high) of ``text``, from its first states to its last ones."""
        ins = self.states(text, low) if low else [(0, 0)]
        outs = [s for s in self.states(text, high) if not final or s[1] == high]
        cuts = self.places(text, low, high)
        if not cuts:
            return np.array([self.from_(text, b, text[a:b], outs) for a, b in ins])
        first, last = cuts[0], cuts[-1]
        heads = [self.forward(text, b, first, text[a:b])[0][-1] for a, b in ins]
        return np.add.outer(heads, self.from_(text, last, "", outs))

    def chunk(
        self, text: str, low: int, high: int, final: bool, enter: int, leave: int
    ) -> tuple[list[str], str, list[str]]:
        """The pieces that begin in a chunk, between two states given by their number.

        First those up to the first cut, then the text up to the last cut, then the pieces from there.
        """
        a, b = (self.states(text, low) if low else [(0, 0)])[enter]
        end = [s for s in self.states(text, high) if not final or s[1] == high][leave]
        if low and (a, b) == end:
            return [], "", []
        cuts = self.places(text, low, high)
        first, last = (cuts[0], cuts[-1]) if cuts else (end[0], end[0])
        tail = self.trace(text, last, end[0]) if cuts else []
        return self.trace(text, b, first, text[a:b]), text[first:last], [*tail, text[end[0] : end[1]]]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The (max, +) product."""
    return np.max(a[:, :, None] + b[None, :, :], axis=1)


def prefixes(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """The products of the first 1, 2, 3 ... matrices, pairs first: any bracketing gives the same."""
    if len(matrices) == 1:
        return matrices
    pairs = prefixes([product(a, b) for a, b in zip(matrices[::2], matrices[1::2], strict=False)])
    out = [matrices[0]]
    for k in range(1, len(matrices)):
        out.append(pairs[k // 2] if k % 2 else product(pairs[k // 2 - 1], matrices[k]))
    return out


def borders(matrices: list[np.ndarray]) -> list[int]:
    """The number of the state at the start of each chunk and, last, at the end."""
    reached = [product[0] for product in prefixes(matrices)]
    states = [int(np.argmax(reached[-1]))]
    for k in range(len(matrices) - 1, 0, -1):
        states.append(int(np.argmax(reached[k - 1] + matrices[k][:, states[-1]])))
    return [0, *states[::-1]]


def model_kind(raw: bytes) -> int:
    """The model type in a model file: field 3 of the message in field 2 (1 unigram, 2 byte pairs)."""

    def number(data: bytes, at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            octet = data[at]
            value, shift, at = value | (octet & 127) << shift, shift + 7, at + 1
            if octet < 128:
                return value, at

    def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
        at = 0
        while at < len(data):
            tag, at = number(data, at)
            if tag & 7 == 0:
                value, at = number(data, at)
            else:
                size, at = (number(data, at) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], at))
                value, at = data[at : at + size], at + size
            yield tag >> 3, value

    trainer = next((v for k, v in fields(raw) if k == 2), b"")
    return next((v for k, v in fields(trainer) if k == 3), 1)


class Model:
    """A model file's vocabulary with its lattice."""

    def __init__(self, path: str):
        import sentencepiece

        self.file = sentencepiece.SentencePieceProcessor(model_file=path)
        numbers = range(self.file.get_piece_size())
        plain = [k for k in numbers if not (self.file.is_control(k) or self.file.is_unknown(k) or self.file.is_byte(k))]
        self.pieces = [self.file.id_to_piece(k) for k in numbers]
        self.ids = {self.pieces[k]: k for k in plain}
        self.octets = {int(self.pieces[k][3:5], 16): k for k in numbers if self.file.is_byte(k)}
        octet_of = {k: bytes([octet]) for octet, k in self.octets.items()}
        self.said = [
            octet_of.get(k, b"" if self.file.is_control(k) else self.pieces[k].replace(MARK, " ").encode()) for k in numbers
        ]
        self.written = [str(k) for k in numbers]
        self.lattice = Lattice({self.pieces[k]: self.file.get_score(k) for k in plain}, model_kind(self.file.serialized_model_proto()) == 2)
        self.words: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def normal(self, text: str) -> str:
        return self.file.normalize(text) if text else ""

    def numbers(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for piece in pieces:
            known = self.ids.get(piece)
            if known is not None:
                out.append(known)
            elif self.octets:
                out += [self.octets[octet] for octet in piece.encode()]
            else:
                out.append(self.file.unk_id())
        return out

    def encode(self, text: str) -> list[int]:
        """The ids of a normalised text from one cut (or its start) to another (or its end)."""
        out: list[int] = []
        if not self.lattice.cuts:
            return self.numbers(self.lattice.word(text)) if text else out
        words = self.words
        for part in WORDS.findall(text):
            known = words.get(part)
            if known is None:
                known = self.older.pop(part, None) or tuple(self.numbers(self.lattice.word(part)))
                if len(part) <= 4 * self.lattice.longest:
                    words[part] = known
                    if len(words) >= REMEMBERED:
                        self.older, self.words = words, (words := {})
            out += known
        return out

    def chunk(self, *place) -> list[int]:
        """The ids of a chunk between two states."""
        head, middle, tail = self.lattice.chunk(*place)
        return [*self.numbers(head), *self.encode(middle), *self.numbers(tail)]

    def decode(self, ids: list[int], first: bool = True) -> str:
        """The text of ids; ``first`` takes away the space that encoding puts before a text."""
        text = b"".join(map(self.said.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if first and text.startswith(" ") else text


@cache
def model(path: str) -> Model:
    return Model(path)


def with_fields(df: DataFrame, drop: tuple[str, ...], extra: str) -> tuple[list[str], str]:
    """The columns that stay and the schema of them with more fields."""
    kept = [f for f in df.schema.fields if f.name not in drop]
    return [f.name for f in kept], ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), extra])


#: What a part of a document is given as: its ids, or what can be told from them (see ``told``).
IDS, TOLD = "ids array<int>", "n_ids long, said string, decoded string"


def told(own: Model, ids: list[int], part: int, whole: bool) -> tuple[int, str, str]:
    """The number of ids, the ids as text, the decoded text; of a whole document the digests of both."""
    said, text = ",".join(map(own.written.__getitem__, ids)), own.decode(ids, part == 0)
    if whole:
        said, text = (hashlib.sha256(value.encode()).hexdigest() for value in (said, text))
    return len(ids), said, text


def encode(docs: DataFrame, path: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """All columns but ``text``, with ``__row``, ``part``, ``parts`` and the ``ids`` of that part.

    Columns of the same names are replaced. A text of one chunk is one part without a ``__row``; the
    parts of a longer one share its ``__row``.
    """
    short, long = encode_each(docs, path, chunk, IDS)
    return short.unionByName(long)


def encode_each(docs: DataFrame, path: str, chunk: int, give: str) -> tuple[DataFrame, DataFrame]:
    """The parts of texts of one chunk, and those of longer texts."""
    spark = docs.sparkSession
    docs = docs.drop("__row", "part", "parts", *[f.split()[0] for f in f"{IDS}, {TOLD}".split(", ")])
    marked = docs.withColumn("text", text_of())
    short = marked.where(F.length("text") < chunk)
    names, schema = with_fields(docs, ("text",), f"__row long, part int, parts int, {give}")
    fields = pa_schema(spark, schema)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for large in batches:
            for start in range(0, large.num_rows, SLICE):
                batch = large.slice(start, SLICE)
                n = batch.num_rows
                coded = (own.encode(own.normal(text)) for text in batch.column("text").to_pylist())
                if give == IDS:
                    made = [pa.array([np.array(ids, np.int32) for ids in coded], pa.list_(pa.int32()))]
                else:
                    kinds = (pa.int64(), pa.string(), pa.string())
                    facts = zip(*[told(own, ids, 0, True) for ids in coded], strict=True)
                    made = [pa.array(values, kind) for values, kind in zip(facts, kinds, strict=True)]
                ends = [pa.nulls(n, pa.int64()), pa.array([0] * n, pa.int32()), pa.array([1] * n, pa.int32()), *made]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).cast(fields.field(c).type) for c in names), *ends], schema=fields)

    long = encode_long(marked.where(F.length("text") >= chunk), path, chunk, give)
    return short.mapInArrow(whole, schema), long


def encode_long(docs: DataFrame, path: str, chunk: int, give: str) -> DataFrame:
    """``encode`` for texts of several chunks."""
    spark = docs.sparkSession
    names, _ = with_fields(docs, ("text",), "")
    numbered = store(docs.withColumn("__row", F.monotonically_increasing_id()), "long-texts")
    cut_schema = "__row long, part int, parts int, low int, high int, around string"
    cut_fields = pa_schema(spark, cut_schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks with as much text around them as a piece can reach."""
        own = model(path)
        reach = 2 * own.lattice.longest
        for batch in batches:
            for row, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                line = own.normal(text)
                parts = max(1, math.ceil(len(line) / chunk))
                for k in range(parts):
                    low, high = k * chunk, min(len(line), (k + 1) * chunk)
                    base = max(0, low - reach)
                    values = row, k, parts, low - base, high - base, line[base : high + reach]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([v], f.type) for v, f in zip(values, cut_fields, strict=True)], schema=cut_fields
                    )

    chunks = store(numbered.select("__row", "text").mapInArrow(cut, cut_schema).repartition("__row", "part"), "chunks")
    weight_schema = "__row long, part int, ins int, weights array<double>"
    weight_fields = pa_schema(spark, weight_schema)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = model(path).lattice
        for batch in batches:
            for row, part, parts, low, high, around in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = lattice.matrix(around, low, high, part == parts - 1)
                values = row, part, len(found), found.ravel().tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], f.type) for v, f in zip(values, weight_fields, strict=True)], schema=weight_fields
                )

    def scan(key, frame):
        frame = frame.sort_values("part")
        states = borders([np.array(w).reshape(n, -1) for n, w in zip(frame["ins"], frame["weights"], strict=True)])
        return frame.assign(enter=states[:-1], leave=states[1:])[["__row", "part", "enter", "leave"]]

    weights = chunks.mapInArrow(weigh, weight_schema)
    states = store(weights.groupBy("__row").applyInPandas(scan, "__row long, part int, enter int, leave int"), "states")
    id_schema = f"__row long, part int, parts int, {give}"
    id_fields = pa_schema(spark, id_schema)

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            for row, part, parts, low, high, around, enter, leave in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = own.chunk(around, low, high, part == parts - 1, enter, leave)
                values = row, part, parts, *([ids] if give == IDS else told(own, ids, part, False))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], f.type) for v, f in zip(values, id_fields, strict=True)], schema=id_fields
                )

    between = chunks.join(states, ["__row", "part"]).select("__row", "part", "parts", "low", "high", "around", "enter", "leave")
    coded = between.mapInArrow(trace, id_schema)
    return coded.join(numbered.drop("text"), "__row").select(
        *names, "__row", "part", "parts", *[f.name for f in id_fields][3:]
    )


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """All columns but ``ids``, with the ``text`` of each part; parts in order make up the document."""
    names, schema = with_fields(encoded, ("ids",), "text string")
    fields = pa_schema(encoded.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            if batch.num_rows:
                parts = zip(batch.column("ids").to_pylist(), batch.column("part").to_pylist(), strict=True)
                text = pa.array([own.decode(ids or [], part == 0) for ids, part in parts], pa.string())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).cast(fields.field(c).type) for c in names), text], schema=fields)

    return encoded.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_chars, n_ids, ids_sha256, decoded_sha256, round_trip) of every document.

    The digest of ids is that of their decimal numbers, comma-joined.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = docs.select("doc_id", text_of().alias("text"), F.length(text_of()).cast("long").alias("n_chars"), F.sha2(text_of().cast("binary"), 256).alias("own"))
    whole, parts = encode_each(own, path, chunk, TOLD)
    short = whole.select(
        "doc_id", "n_chars", "n_ids", F.col("said").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256"), "own"
    )

    def joined(frame):
        frame = frame.sort_values("part")
        first = frame.iloc[0]
        return frame.head(1).assign(
            n_ids=frame["n_ids"].sum(),
            ids_sha256=hashlib.sha256(",".join(frame["said"]).encode()).hexdigest(),
            decoded_sha256=hashlib.sha256("".join(frame["decoded"]).encode()).hexdigest(),
            own=first["own"],
        )[["doc_id", "n_chars", "n_ids", "ids_sha256", "decoded_sha256", "own"]]

    schema = f"doc_id {kind}, n_chars long, n_ids long, ids_sha256 string, decoded_sha256 string, own string"
    long = parts.groupBy("__row").applyInPandas(joined, schema)
    return short.unionByName(long).withColumn("round_trip", F.col("own") == F.col("decoded_sha256")).drop("own")
