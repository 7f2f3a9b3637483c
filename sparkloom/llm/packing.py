"""Packing by non-negative least squares over length combinations.

A document's ids are cut at every `window` ids; what is left is one shorter piece. The histogram of piece
lengths (at most `window` numbers) goes to the driver. Combinations of up to three lengths that fill a
window exactly are enumerated, and their repeat counts solved: minimise |A x - h| with x >= 0. Rounded
down to what the histogram holds, they use up most pieces; the residual histogram is packed greedily, the
longest first, each time with the longest length that still fits. The plan is a bounded list of patterns
with repeat counts. A piece's rank among the pieces of its length then gives its sequence and offset by
arithmetic, so no piece is moved to be packed. Ranks come from counts for each partition of a written table.

Defined results: a null or empty text is its closing id alone; repeated rows are packed each; a null
doc_id is kept. Sequence ids are 0 to n-1 without gaps; pieces fill a sequence from offset 0 without gaps.
"""

from __future__ import annotations

import os
import re
import zlib
from dataclasses import dataclass
from functools import lru_cache
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import pick, table


@dataclass(frozen=True)
class PackingParams:
    window: int = 1024
    closing_id: int = 0
    iterations: int = 400


#: White space of the vocabulary's own pattern (fixed values: Unicode's property White_Space).
_BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters of ASCII and Latin: all in the pattern's class of letters.
_LETTER = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u02af"
#: No pre-token crosses an end of letters before an ASCII character that is none, nor an end of other signs before a blank.
_CHUNK = re.compile(f" ?[{_LETTER}]++(?=[\\x00-@\\[-`{{-\\x7f]|\\Z)|[{_BLANK}]*+[^{_BLANK}]+|[{_BLANK}]+")
_CUT = re.compile(f"[^{_BLANK}](?=[{_BLANK}])")


class _Encoder:
    """A vocabulary of `tokenizers` with the ids of chunks met before; one for each Python worker."""

    #: Characters of remembered chunks, and of a text that are handled at once.
    remember, slab = 8_000_000, 1 << 20

    def __init__(self, path: str):
        import tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.vocabulary = tokenizers.Tokenizer.from_file(path)
        self.vocabulary.encode_special_tokens = True
        self.known: dict[str, bytes] = {}
        self.chars = 0

    def slabs(self, text: str):
        at = 0
        while len(text) - at > self.slab and (m := _CUT.search(text, at + self.slab)):
            yield text[at : m.end()]
            at = m.end()
        yield text[at:]

    def encode(self, slab: str) -> bytes:
        chunks = _CHUNK.findall(slab)
        if self.chars > self.remember:
            self.known.clear()
            self.chars = 0
        new = list(set(chunks).difference(self.known))
        for c, e in zip(new, self.vocabulary.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self.known[c] = pack_ids(f"<{len(e)}I", *e.ids)
            self.chars += len(c)
        return b"".join(map(self.known.__getitem__, chunks))


_encoder = lru_cache(maxsize=2)(_Encoder)


class Tokenizer:
    """ids of a byte-level BPE by `tokenizers`; strings of special tokens in a text are ordinary text.

    A text is cut where no pre-token can cross, and each distinct chunk is encoded once. Ids are those of the whole
    text (tested), at about half of the time. Memory follows a slab of the text, or its longest run without a cut.
    """

    def __init__(self, path: str):
        self.path = path

    def __call__(self, text: str) -> np.ndarray:
        e = _encoder(self.path)
        return np.frombuffer(b"".join(map(e.encode, e.slabs(text))), "<u4")


def tokenised(docs: DataFrame, tokenizer: Tokenizer, p: PackingParams) -> DataFrame:
    """(id, text) to (id, doc_tokens, crcs): crcs has the CRC of each piece's ids, in order."""
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            n, crcs = [], []
            for t in b.column(1):
                ids = np.append(tokenizer(t.as_py() or ""), p.closing_id).astype("<u4")
                n.append(len(ids))
                crcs.append([zlib.crc32(ids[i : i + p.window].tobytes()) for i in range(0, len(ids), p.window)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], names=["id", "doc_tokens", "crcs"])

    return docs.mapInArrow(run, f"id {id_type}, doc_tokens long, crcs array<long>")


def combinations(h: np.ndarray, p: PackingParams) -> list[np.ndarray]:
    """Pairs and triples (a <= b <= c) of lengths that occur and that fill the window exactly."""
    w, there = p.window, h > 0
    a = np.arange(1, w // 2 + 1)
    pairs = np.stack([a, w - a], 1)
    triples = [np.zeros((0, 3), np.int64)]
    for x in np.flatnonzero(there[: w // 3 + 1]):
        if x:
            y = np.arange(x, (w - x) // 2 + 1)
            y = y[there[y] & there[w - x - y]]
            triples.append(np.stack([np.full(len(y), x), y, w - x - y], 1))
    return [pairs[there[pairs].all(1)], np.concatenate(triples)]


def solve(h: np.ndarray, groups: list[np.ndarray], p: PackingParams) -> list[np.ndarray]:
    """Non-negative repeat counts x that minimise |A x - h|, by multiplicative updates (they keep the sign)."""
    x = [np.ones(len(g)) for g in groups]
    goal = [h[g].sum(1) for g in groups]
    for _ in range(p.iterations):
        made = np.zeros(len(h))
        for g, v in zip(groups, x, strict=True):
            for k in range(g.shape[1]):
                made += np.bincount(g[:, k], v, minlength=len(h))
        for i, g in enumerate(groups):
            if len(g):
                x[i] = x[i] * goal[i] / np.maximum(made[g].sum(1), 1e-12)
    return x


def plan(h: np.ndarray, p: PackingParams) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, repeats) that use up the histogram h (index = length, to the window)."""
    left = h.astype(np.int64).copy()
    out = [((p.window,), int(left[p.window]))] if left[p.window] else []
    left[p.window] = 0
    groups = combinations(left, p)
    found = [(int(np.rint(v)), tuple(int(y) for y in g)) for gs, x in zip(groups, solve(left.astype(float), groups, p), strict=True) for g, v in zip(gs, x, strict=True) if v >= 0.5]
    for count, lengths in sorted(found, key=lambda f: (-f[0], f[1])):
        need = np.bincount(lengths, minlength=1)
        at = np.flatnonzero(need)
        count = min(count, int((left[at] // need[at]).min()))
        if count > 0:
            left[at] -= count * need[at]
            out.append((lengths, count))
    while left.any():
        lengths, room = [], p.window
        rest = left.copy()
        while room > 0:
            fits = np.flatnonzero(rest[: room + 1])
            if not len(fits):
                break
            lengths.append(int(fits[-1]))
            rest[fits[-1]] -= 1
            room -= int(fits[-1])
        need = np.bincount(lengths, minlength=len(left))
        at = np.flatnonzero(need)
        count = int((left[at] // need[at]).min())
        left[at] -= count * need[at]
        out.append((tuple(lengths), count))
    return out


@dataclass
class Slots:
    """The plan by (length, rank): slot s serves ranks from `first` on."""

    key: np.ndarray  # length * BIG + first rank, ascending
    length: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray


_BIG = 1 << 44


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> Slots:
    used: dict[int, int] = {}
    rows, base = [], 0
    for lengths, count in patterns:
        at = 0
        for n in lengths:
            rows.append((n, used.get(n, 0), base, at))
            used[n] = used.get(n, 0) + count
            at += n
        base += count
    rows.sort()
    n, first, sequence, offset = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 4
    return Slots(n * _BIG + first, n, first, sequence, offset)


def pack(docs: DataFrame, tokenizer: Tokenizer, p: PackingParams = PackingParams(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    # the part is stored: a scan's own splits change with the number of executors, and ranks need the same parts in two jobs
    t = table(tokenised(pick(docs, id=id_col, text=text), tokenizer, p).withColumn("part", F.spark_partition_id()), "tokens")
    pieces = t.select("id", "doc_tokens", "part", F.posexplode("crcs").alias("k", "ids_crc32"))
    start = F.col("k").cast("long") * p.window
    pieces = pieces.select("id", start.alias("start"), F.least(F.lit(p.window).cast("long"), F.col("doc_tokens") - start).alias("length"), "ids_crc32", "doc_tokens", "part")
    counts = table(pieces.groupBy("part", "length").count(), "counts")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = table(counts.withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))).select(F.col("part").alias("in_part"), F.col("length").alias("of_length"), "base"), "bases")
    h = np.zeros(p.window + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("count").alias("n")).collect():  # at most `window` rows
        h[row["length"]] = row["n"]
    sent = spark.sparkContext.broadcast(slots(plan(h, p)))
    within = Window.partitionBy("part", "length").orderBy("id", "start", "ids_crc32")
    ranked = pieces.withColumn("rank", F.row_number().over(within) - 1)
    # the window has dealt the pieces by part and length, so only `bases` moves, however large it gets
    ranked = ranked.join(bases.hint("merge"), (F.col("part") == F.col("in_part")) & (F.col("length") == F.col("of_length"))).withColumn("rank", F.col("rank") + F.col("base"))

    def place(batches):
        s = sent.value
        for b in batches:
            length, rank = b.column(2).to_numpy(), b.column(5).to_numpy()
            at = np.searchsorted(s.key, length * _BIG + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(s.sequence[at] + rank - s.first[at]), pa.array(s.offset[at])], names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    id_type = t.schema["id"].dataType.simpleString()
    out = ranked.select("id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(place, f"id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
