"""What the operators share: picking columns, written tables, byte-level words and hashes.

Words are found in UTF-8 bytes with numpy over whole Arrow buffers, a slice of documents at a
time, so no Python code runs for each word and memory follows the slice, not the partition.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one numpy step handles; a longer text is a step of its own.
STEP_BYTES = 1 << 21


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under new names, found by exact name; columns that clash with them are left out."""
    at = {new: df.columns.index(old) for new, old in columns.items()}
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{i}").alias(new) for new, i in at.items()])


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or the context's; where both are unset, in local mode only, one of this process."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if given:
        return given.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not hasattr(shared_dir, "own"):
        shared_dir.own = tempfile.mkdtemp(prefix="tables-")
        atexit.register(shutil.rmtree, shared_dir.own, ignore_errors=True)
    return f"file://{shared_dir.own}"


def table(df: DataFrame, name: str = "t") -> DataFrame:
    """df written as Parquet in the shared folder and read back: cuts lineage, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remainder(id_col: str, modulus: int):
    """crc32(id as text) mod modulus; -1 for a null id, which so counts as a training row."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus, F.lit(-1))


def small_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "left", limit: int = 100_000) -> DataFrame:
    """Joins a written table: broadcast if it has at most `limit` rows, by a shuffle beyond that."""
    return big.join(F.broadcast(small) if small.count() <= limit else small, on, how)


def append_columns(df: DataFrame, make, schema: T.StructType, text: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """df with the columns that make(text array) -> list of arrays gives, in one Arrow pass, without those to drop.

    A column of df that has the name of an added one is replaced. make gets about 4 MB at a time, or one longer value.
    """
    names, added = df.columns, {f.name for f in schema.fields} | set(drop)
    at = names.index(text)
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    kept = [i for i, n in enumerate(names) if n not in added]

    def run(batches):
        for batch in batches:
            for a, z in steps(buffers(batch.column(at))[1], 1 << 22):
                part = batch.slice(a, z - a)
                yield pa.RecordBatch.from_arrays([part.column(i) for i in kept] + list(make(part.column(at))), names=[f"c{i}" for i in kept] + [f.name for f in schema.fields])

    out = T.StructType([T.StructField(f"c{i}", plain.schema[i].dataType) for i in kept] + schema.fields)
    return plain.mapInArrow(run, out).toDF(*[names[i] for i in kept], *[f.name for f in schema.fields])


# ---- bytes, words and hashes -------------------------------------------------------------------

#: Lower-cases A-Z only.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: True for the bytes that end a word `[^\x20\x09-\x0D]+`.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: True for every ASCII byte that is no letter or digit.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:128] = True
NOT_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False

def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over all output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (UTF-8 of strings) and offsets (from 0) of a string or binary array; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    raw = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    column = column.cast(pa.large_binary() if raw else pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if raw else "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def cuts(data: np.ndarray, budget: int):
    """Ranges of about `budget` bytes of one text that cut no word; a longer word is a range of its own."""
    at, n = 0, len(data)
    while at < n:
        end = min(at + budget, n)
        while end < n and not SPACE[data[end - 1]]:  # on to the next separator
            there = np.flatnonzero(SPACE[data[end : end + budget]])
            end = end + int(there[0]) + 1 if len(there) else min(end + budget, n)
        yield at, end
        at = end


def steps(off: np.ndarray, budget: int = STEP_BYTES):
    """Ranges of documents with at most `budget` bytes, or of one longer document."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + budget, side="right")) - 1)
        j = min(j, n)
        yield i, j
        i = j


def hashes(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits of each b[start:end]; b goes on for 8 bytes at least beyond the last.

    Eight bytes at a time are chained through mix(), so a collision is chance; words over 32 bytes go to xxh3.
    """
    size = end - start
    eight = np.ndarray(max(len(b) - 7, 0), "<u8", b.data, strides=(1,))
    h = mix(size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    for k in range(0, 32, 8):
        on = np.flatnonzero(size > k) if k else slice(None)
        rest = size[on] - k
        x = eight[start[on] + k]
        x <<= (8 * np.maximum(8 - rest, 0)).astype(np.uint64)
        h[on] = mix((h[on] ^ x) + np.uint64(0x9E3779B97F4A7C15))
    long = np.flatnonzero(size > 32)
    if len(long):
        import xxhash

        h[long] = [xxhash.xxh3_64_intdigest(b[i:j]) for i, j in zip(start[long].tolist(), end[long].tolist(), strict=True)]
    return h


class Words:
    """Words of some documents: doc (index), start and end (in `bytes`, which 8 zeros follow), hash (64 bits)."""

    def __init__(self, data: np.ndarray, off: np.ndarray, separators: np.ndarray = SPACE):
        self.n_docs = len(off) - 1
        off = off - off[0]
        n = len(data)
        self.bytes = np.zeros(n + 8, np.uint8)
        np.take(FOLD, data, out=self.bytes[:n])
        word = ~separators[data]
        edges = off[1:-1]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        at = edges[edges < n]
        first[at] = word[at]
        at = edges[edges > 0] - 1
        last[at] = word[at]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = np.repeat(np.arange(self.n_docs), np.diff(np.searchsorted(self.start, off)))
        self.hash = hashes(self.bytes, self.start, self.end)

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)


def text_steps(column: pa.Array, separators: np.ndarray = SPACE, budget: int = STEP_BYTES):
    """(first, last, Words) for each range of documents of a string array."""
    raw, off = buffers(column)
    for i, j in steps(off, budget):
        yield i, j, Words(raw[off[i] : off[j]], off[i : j + 1], separators)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles as 64-bit hashes: (doc, hash), sorted by both.

    A document with fewer than k words has its whole sequence as one shingle; one without words has none.
    """
    n, doc, h = len(words.hash), words.doc, words.hash
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    per = words.counts()
    length = np.minimum(per[doc], k)
    first = np.concatenate([[0], np.cumsum(per)])[:-1][doc]
    place = np.arange(n) - first
    keep = np.flatnonzero(place <= per[doc] - length)
    s, sizes = np.zeros(len(keep), np.uint64), length[keep]
    for i in range(k):
        on = sizes > i
        s[on] = mix(s[on] * np.uint64(3) + h[keep[on] + i] + np.uint64(i + 1))
    return distinct(doc[keep], s, words.n_docs)


def distinct(doc: np.ndarray, h: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (doc, h), sorted by both; doc ascends."""
    if n_docs == 1:
        h = np.unique(h)
        return np.zeros(len(h), np.int64), h
    out_d, out_h = [], []
    for a in range(0, n_docs, 1 << 16):  # 16-bit keys are sorted by counting
        lo, hi = np.searchsorted(doc, [a, a + (1 << 16)])
        order = np.argsort(h[lo:hi])
        d = (doc[lo:hi] - a).astype(np.uint16)[order]
        by = np.argsort(d, kind="stable")
        d, x = d[by], h[lo:hi][order[by]]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (x[1:] != x[:-1])
        out_d.append(d[new].astype(np.int64) + a)
        out_h.append(x[new])
    return np.concatenate(out_d), np.concatenate(out_h)


def components(links: DataFrame) -> DataFrame:
    """(node, label) for the nodes of links (a, b): label is the smallest node that can be reached.

    Each round takes the smallest label among a node and its neighbours, then the label's own
    label, so a path of length n takes about log n rounds. No link reaches the driver.
    """
    e = table(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).where("u <> v").distinct(), "links")
    labels = table(e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = e.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("m"))
        hooked = table(labels.join(near, "node", "left").select("node", "label", F.least("label", F.coalesce("m", "label")).alias("next")), "labels")
        above = hooked.select(F.col("node").alias("next"), F.col("next").alias("top"))
        new = table(hooked.join(above, "next", "left").select("node", F.col("label").alias("old"), F.least("next", F.coalesce("top", "next")).alias("label")), "labels")
        labels = new.select("node", "label")
        if not new.where("old <> label").limit(1).count():
            return labels
