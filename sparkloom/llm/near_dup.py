"""MinHash near-dedup with SetSketch registers.

A register is the smallest of a set's exponential hash values, truncated to a power of the base; registers
of a union are the maxima, and equal registers tell of similar sets. Bands of registers make buckets;
within buckets the similarity is estimated jointly from the counts of larger, smaller and equal registers
by likelihood, and pairs that the likelihood does not rule out are confirmed on the full sets.

Sets that are equal (128-bit sums over the distinct shingles and the size) are one class, compared once
through its smallest id. Classes are linked in rounds, so a bucket of any size costs about its number of
rows: (1) each class against the pivot that most of its buckets have; (2) twice, in buckets that still span several
components, each class against its best estimated partner of another component; (3) all pairs of different
components that remain plausible, in blocks, each pair in the first band that it shares; such pairs travel
packed, and the sets of two groups of classes meet once for all their pairs. Nothing is capped.

With 32 bands of 5 registers a pair at similarity 0.8 shares no bucket with probability 3e-6.

Defined results: a null or empty text, or one without words, has an empty set, is linked with nothing and
stays; a null id is linked with nothing and stays; rows with one id are one node; ties do not arise.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, mix, pick, shingles, table, text_steps


@dataclass(frozen=True)
class NearDupParams:
    #: Words of a shingle, and the threshold as percent: linked if 100 * common >= percent * union.
    words: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 5
    base: float = 1.001
    rate: float = 20.0
    #: Classes of a block in large buckets.
    block: int = 512
    #: Pairs whose log likelihood at the threshold is worse than the best by more are ruled out (5 sigma).
    max_loss: float = 12.5
    #: Pairs that one step compares (or one group, if it has more), and pairs in one packed row.
    step_pairs: int = 1 << 20
    row_pairs: int = 1024
    #: At most so many candidate ids are broadcast to pick their texts; more are joined by a shuffle.
    broadcast_ids: int = 500_000

    @property
    def m(self) -> int:
        return self.bands * self.rows


def registers(doc: np.ndarray, h: np.ndarray, n_docs: int, p: NearDupParams) -> np.ndarray:
    """(n_docs, m) uint16 SetSketch registers; documents without shingles have zeros."""
    out = np.zeros((n_docs, p.m), np.uint16)
    if not len(h):
        return out
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    x = mix(h + np.uint64(0x9E3779B97F4A7C15))
    odd = mix(np.arange(1, p.m + 1, dtype=np.uint64)) | np.uint64(1)
    shift = mix(np.arange(1, p.m + 1, dtype=np.uint64) + np.uint64(1 << 40))
    low = np.empty((p.m, len(first)), np.uint64)
    for i in range(p.m):
        low[i] = np.minimum.reduceat(x * odd[i] + shift[i], first)
    value = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**64) / p.rate
    k = np.clip(np.floor(1 - np.log(np.maximum(value, 1e-300)) / np.log(p.base)), 0, 65535)
    out[doc[first]] = k.T.astype(np.uint16)
    return out


def sketches(docs: DataFrame, p: NearDupParams) -> DataFrame:
    """(id, text) to (id, n_shingles, fp (16 bytes that stand for the set), regs)."""

    def run(batches):
        for b in batches:
            for i, j, words in text_steps(b.column(1)):
                doc, h = shingles(words, p.words)
                n = np.bincount(doc, minlength=j - i)
                sums = np.zeros((j - i, 2), np.uint64)
                for k, salt in enumerate((0x243F6A8885A308D3, 0x13198A2E03707344)):
                    v = mix(h ^ np.uint64(salt))
                    if len(h):
                        at = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
                        sums[doc[at], k] = np.add.reduceat(v, at)
                regs = registers(doc, h, j - i, p)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array([x.tobytes() for x in sums], pa.binary()), pa.array([x.tobytes() for x in regs], pa.binary())], names=["id", "n_shingles", "fp", "regs"])

    return docs.mapInArrow(run, "id long, n_shingles long, fp binary, regs binary")


def _sets(docs: DataFrame, p: NearDupParams) -> DataFrame:
    """(id, text) to (id, shingles as 8 bytes each, ascending)."""

    def run(batches):
        for b in batches:
            for i, j, words in text_steps(b.column(1)):
                doc, h = shingles(words, p.words)
                ends = np.searchsorted(doc, np.arange(j - i + 1))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([h[a:z].tobytes() for a, z in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], names=["id", "items"])

    return docs.mapInArrow(run, "id long, items binary")


def _open(items: bytes) -> np.ndarray:
    return np.frombuffer(items, np.uint64)


def _confirm(pairs: DataFrame, sets: DataFrame, p: NearDupParams) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("items").alias("items_b")), "b").join(sets.select(F.col("id").alias("a"), F.col("items").alias("items_a")), "a")

    def run(batches):
        for b in batches:
            keep = []
            for k, (x, y) in enumerate(zip(b.column(2), b.column(3), strict=True)):
                u, v = _open(x.as_py()), _open(y.as_py())
                common = len(u) + len(v) - len(np.unique(np.concatenate([u, v])))
                if 100 * common >= p.percent * (len(u) + len(v) - common):
                    keep.append(k)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], names=["a", "b"])

    return both.select("a", "b", "items_a", "items_b").mapInArrow(run, "a long, b long")


def log_likelihoods(larger, smaller, equal, n_a, n_b, p: NearDupParams, grid: np.ndarray) -> np.ndarray:
    """(pairs, grid) joint log likelihood of similarities, given the sizes (SetSketch's three register cases)."""
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    j = np.minimum(grid[None, :], np.minimum(u / v, v / u))
    step = (p.base - 1) / p.base
    up = -np.log1p(-np.clip(u - v * j, 0, 1) * step) / np.log(p.base)
    down = -np.log1p(-np.clip(v - u * j, 0, 1) * step) / np.log(p.base)
    tiny = 1e-9
    return larger[:, None] * np.log(np.maximum(up, tiny)) + smaller[:, None] * np.log(np.maximum(down, tiny)) + equal[:, None] * np.log(np.maximum(1 - up - down, tiny))


_GRID = np.linspace(0, 1, 101)


def _estimates(ra, rb, na, nb, p: NearDupParams) -> tuple[np.ndarray, np.ndarray]:
    """(estimate, plausible) of pairs of registers: plausible if likelihood and sizes allow the threshold."""
    larger, equal = (ra > rb).sum(1), (ra == rb).sum(1)
    ll = log_likelihoods(larger, p.m - larger - equal, equal, na.astype(float), nb.astype(float), p, _GRID)
    best = ll.max(1)
    fits = ll[:, _GRID >= p.percent / 100 - 1e-9].max(1) >= best - p.max_loss
    return _GRID[ll.argmax(1)], fits & (100 * np.minimum(na, nb) >= p.percent * np.maximum(na, nb))


def _bucket_pairs(members: DataFrame, p: NearDupParams, every: bool) -> DataFrame:
    """Plausible pairs of different components in one bucket, each in the first band that it shares.

    Each member's best such partner as (a, b, est), or with `every` all pairs, packed: rows for each pair of homes
    (ha <= hb) that a step has met, with the ids of p.row_pairs pairs at most in one binary. Spark reads and
    writes thousands of rows at once, so longer ones would not fit its memory where a group is large.

    members: key, bi, bj, blk, band, id, n, comp, home, regs. Rows of (key, bi, bj) are together and sorted;
    a group holds two blocks at most, so one step's memory is bounded.
    """

    def packed(a, b, ha, hb):
        swap = (ha > hb) | ((ha == hb) & (a > b))
        a, b, ha, hb = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, hb, ha), np.where(swap, ha, hb)
        order = np.lexsort((hb, ha))
        a, b, ha, hb = a[order], b[order], ha[order], hb[order]
        first = np.flatnonzero(np.concatenate([[True], (ha[1:] != ha[:-1]) | (hb[1:] != hb[:-1])])) if len(a) else np.zeros(0, np.int64)
        first = np.concatenate([np.arange(i, j, p.row_pairs) for i, j in zip(first, [*first[1:], len(a)], strict=True)]) if len(a) else first
        both = np.stack([a, b], 1)
        return pa.RecordBatch.from_arrays([pa.array(ha[first], pa.int64()), pa.array(hb[first], pa.int64()), pa.array([both[i:j].tobytes() for i, j in zip(first, [*first[1:], len(a)], strict=True)], pa.binary())], names=["ha", "hb", "pairs"])

    def solve(group, blk, bi, bj, band, ids, n, comp, home, regs):
        out = []
        # row i against the rows d further on, within the group
        size = np.bincount(group)
        last = np.cumsum(size)[group] - 1
        places = np.arange(len(group))
        for d in range(1, int(size.max()) if len(size) else 0):
            i = places[places + d <= last]
            k = i + d
            ok = (comp[i] != comp[k]) & ((bi[i] == bj[i]) | (blk[i] != blk[k]))
            i, k = i[ok], k[ok]
            if not len(i):
                continue
            ra, rb = regs[i], regs[k]
            same = (ra == rb).reshape(len(i), p.bands, p.rows).all(2)
            new = same.argmax(1) == band[i]  # this is the first band that the pair shares
            i, k = i[new], k[new]
            if len(i):
                est, fits = _estimates(ra[new], rb[new], n[i], n[k], p)
                out.append((ids[i][fits], ids[k][fits], est[fits], home[i][fits], home[k][fits]))
        if not out:
            return None
        a, b, est, ha, hb = (np.concatenate(x) for x in zip(*out, strict=True))
        if every:
            return packed(a, b, ha, hb)
        if len(a):
            x, y, e = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([est, est])
            order = np.lexsort((y, -e, x))
            x, y, e = x[order], y[order], e[order]
            first = np.concatenate([[True], x[1:] != x[:-1]])
            a, b, est = x[first], y[first], e[first]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(est, pa.float64())], names=["a", "b", "est"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows = 0

        def parts(t: pa.Table):
            """t cut between groups, so that a part has about p.step_pairs pairs at most."""
            c = [t.column(x).to_numpy() for x in ("key", "bi", "bj")]
            first = np.flatnonzero(np.concatenate([[True], (c[0][1:] != c[0][:-1]) | (c[1][1:] != c[1][:-1]) | (c[2][1:] != c[2][:-1])]))
            size = np.diff(np.append(first, t.num_rows))
            at = 0
            pairs = np.cumsum(size * (size - 1) // 2)
            while at < len(first):
                end = max(at + 1, int(np.searchsorted(pairs, (pairs[at - 1] if at else 0) + p.step_pairs, side="right")))
                yield t.slice(first[at], (first[end] if end < len(first) else t.num_rows) - first[at])
                at = end

        def work(t: pa.Table):
            c = [t.column(x).to_numpy() for x in ("key", "bi", "bj")]
            new = np.concatenate([[False], (c[0][1:] != c[0][:-1]) | (c[1][1:] != c[1][:-1]) | (c[2][1:] != c[2][:-1])])
            regs = np.frombuffer(b"".join(t.column("regs").to_pylist()), np.uint16).reshape(t.num_rows, p.m)
            return solve(np.cumsum(new), t.column("blk").to_numpy(), c[1], c[2], t.column("band").to_numpy(), t.column("id").to_numpy(), t.column("n").to_numpy(), t.column("comp").to_numpy(), t.column("home").to_numpy(), regs)

        def flush(all_of_it: bool):
            nonlocal held, rows
            t = pa.Table.from_batches(held)
            k = [t.column(x).to_numpy() for x in ("key", "bi", "bj")]
            cut = t.num_rows
            if not all_of_it:  # the last group may go on in the next batch
                while cut and all(x[cut - 1] == x[-1] for x in k):
                    cut -= 1
            rest = t.slice(cut)
            held, rows = rest.to_batches(), rest.num_rows
            for part in parts(t.slice(0, cut)) if cut else ():
                out = work(part)
                if out is not None:
                    yield out

        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
                if rows >= 8192:
                    yield from flush(False)
        if held:
            yield from flush(True)

    columns = ["key", "bi", "bj", "blk", "band", "id", "n", "comp", "home", "regs"]
    schema = "ha long, hb long, pairs binary" if every else "a long, b long, est double"
    return members.select(columns).repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "id").mapInArrow(run, schema)


def _confirm_packed(packed: DataFrame, sets: DataFrame, homes: DataFrame, labels: DataFrame, p: NearDupParams) -> DataFrame:
    """Links (a, b) among packed pairs. The sets of two homes go to their pairs once; pairs are never rows.

    A pair of documents that earlier links of the step have joined is not compared again.
    """
    packed = table(packed, "packed")
    meet = table(packed.select("ha", "hb").distinct(), "meet")
    owned = sets.join(homes, "id").join(labels.withColumnRenamed("node", "id"), "id", "left").select("home", "id", "items", F.coalesce("label", "id").alias("comp"))
    sides = meet.select("ha", "hb", F.explode(F.array_distinct(F.array("ha", "hb"))).alias("home"))
    nothing = F.lit(None)
    rows = sides.join(owned, "home").select("ha", "hb", F.lit(0).alias("kind"), "id", "comp", "items")
    rows = rows.union(packed.select("ha", "hb", F.lit(1), nothing.cast("long"), nothing.cast("long"), "pairs"))

    def run(batches):
        at, found, comp, parent = None, {}, {}, {}

        def root(x):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for batch in batches:
            a, b = [], []
            ha, hb, kind, ids, comps, data = batch.columns
            for i, where in enumerate(zip(ha.to_numpy(), hb.to_numpy(), strict=True)):
                if where != at:
                    at, found, comp, parent = where, {}, {}, {}
                if kind[i].as_py() == 0:
                    found[ids[i].as_py()] = data[i].as_py()
                    comp[ids[i].as_py()] = comps[i].as_py()
                    continue
                for x, y in np.frombuffer(data[i].as_py(), np.int64).reshape(-1, 2).tolist():
                    rx, ry = root(comp[x]), root(comp[y])
                    if rx == ry:
                        continue
                    for k in (x, y):
                        if isinstance(found[k], bytes):
                            found[k] = _open(found[k])
                    u, v = found[x], found[y]
                    s = np.sort(np.concatenate([u, v]), kind="stable")
                    common = int((s[1:] == s[:-1]).sum())
                    if 100 * common >= p.percent * (len(s) - common):
                        parent[rx] = ry
                        a.append(x), b.append(y)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.repartition("ha", "hb").sortWithinPartitions("ha", "hb", "kind").mapInArrow(run, "a long, b long")


def _open_buckets(buckets: DataFrame, classes: DataFrame, labels: DataFrame, homes: DataFrame, p: NearDupParams) -> DataFrame:
    """Members of the buckets that span several components, dealt to pairs of blocks, with their registers."""
    b = table(buckets.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("label", "id")).drop("label"), "buckets")
    per = b.groupBy("key", "comp").agg(F.count("*").alias("n"))
    wide = per.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("m"), F.sum("n").alias("size"), F.count("*").alias("k")).where("k > 1")
    wide = table(wide.select("key", F.col("m.comp").alias("main"), F.ceil(F.col("m.n") / p.block).cast("int").alias("mains"), F.ceil((F.col("size") - F.col("m.n")) / p.block).cast("int").alias("others")), "wide")
    b = b.join(wide, "key")
    # the bucket's largest component needs no pairs of its own: its blocks come first and meet the others' blocks only
    own = F.col("comp") == F.col("main")
    turn = F.xxhash64("id", F.lit(5))
    b = b.withColumn("blk", F.when(own, F.pmod(turn, F.col("mains"))).otherwise(F.col("mains") + F.pmod(turn, F.col("others"))).cast("int"))
    meets = F.when(own, F.sequence(F.col("mains"), F.col("mains") + F.col("others") - 1)).otherwise(F.sequence(F.lit(0), F.col("mains") + F.col("others") - 1))
    b = b.withColumn("other", F.explode(meets)).withColumn("bi", F.least("blk", "other")).withColumn("bj", F.greatest("blk", "other"))
    return b.join(classes.select("id", F.col("n_shingles").alias("n"), "regs"), "id").join(homes, "id")


def link(docs: DataFrame, p: NearDupParams = NearDupParams(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id_col, n_shingles, component_id, kept."""
    d = pick(docs, id=id_col, text=text).withColumn("id", F.col("id").cast("long"))
    rows = table(sketches(d, p), "sketches")
    some = rows.where("id is not null and n_shingles > 0")
    classes = table(some.groupBy("fp", "n_shingles").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("regs").alias("regs")), "classes")
    reg = F.col("regs")
    keys = F.transform(F.sequence(F.lit(0), F.lit(p.bands - 1)), lambda i: F.xxhash64(i, F.substring(reg, i * (2 * p.rows) + 1, F.lit(2 * p.rows))))
    banded = classes.select("id", F.posexplode(keys).alias("band", "key"))
    shared = table(banded.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("size")).where("lo < hi").select("key", "size"), "shared")
    buckets = table(banded.join(shared, "key").select("id", "band", "key", "size"), "buckets")

    # the texts of classes that share a bucket, as sets
    need = table(buckets.select("id").distinct(), "need")
    few = need.count() <= p.broadcast_ids
    sets = table(_sets(d.join(F.broadcast(need) if few else need, "id", "left_semi").select("id", "text"), p), "sets")

    # a bucket's pivot is its member in the fullest buckets: of copies of one original, most likely the original
    weight = table(buckets.groupBy("id").agg(F.sum("size").alias("weight")), "weights")
    pivots = buckets.join(weight, "id").groupBy("key").agg(F.max(F.struct("weight", (-F.col("id")).alias("m"))).alias("x")).select("key", (-F.col("x.m")).alias("pivot"))
    per = buckets.join(table(pivots, "pivots"), "key").where("id <> pivot").groupBy("id", "pivot").count()
    best = per.groupBy(F.col("id").alias("b")).agg(F.max(F.struct("count", (-F.col("pivot")).alias("p"))).alias("m")).select((-F.col("m.p")).alias("a"), "b")
    best = table(best, "best")
    # homes: classes with one pivot, in blocks; most plausible pairs lie within a home or between few
    near = need.join(best.select(F.col("b").alias("id"), "a"), "id", "left").select("id", F.coalesce("a", "id").alias("pivot"))
    parts = near.groupBy("pivot").agg(F.ceil(F.count("*") / p.block).alias("parts"))
    homes = table(near.join(parts, "pivot").select("id", F.xxhash64("pivot", F.pmod(F.xxhash64("id", F.lit(9)), F.col("parts"))).alias("home")), "homes")
    # an id with several texts ties its classes together
    ties = some.groupBy("id").agg(F.countDistinct("fp").alias("k")).where("k > 1").select("id")
    rep = classes.select("fp", "n_shingles", F.col("id").alias("rep"))
    tied = some.join(ties, "id").join(rep, ["fp", "n_shingles"]).select(F.col("id").alias("a"), F.col("rep").alias("b")).where("a <> b")
    links = table(_confirm(best, sets, p).union(tied), "links")
    labels = components(links)

    for every in (False, False, True):
        found = _bucket_pairs(_open_buckets(buckets, classes, labels, homes, p), p, every)
        if every:
            new = _confirm_packed(found, sets, homes, labels, p)
        else:
            found = found.groupBy("a").agg(F.max(F.struct("est", (-F.col("b")).alias("m"))).alias("x")).select("a", (-F.col("x.m")).alias("b"))
            pairs = table(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
            if not pairs.limit(1).count():
                break  # no plausible pair is left
            new = _confirm(pairs, sets, p)
        new = table(new, "links")
        if new.limit(1).count():
            links = table(links.union(new), "links")
            labels = components(links)

    named = classes.join(labels.withColumnRenamed("node", "id"), "id", "left").where("copies > 1 or label is not null")
    named = table(named.select("fp", "n_shingles", F.coalesce("label", "id").alias("component")), "named")
    out = rows.select("id", "n_shingles", "fp").join(named, ["fp", "n_shingles"], "left").select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, p: NearDupParams = NearDupParams(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows whose id is not the smallest of its group; rows with a null id stay."""
    gone = table(link(docs, p, id_col, text).where("not kept").select(id_col).distinct(), "gone")
    gone = gone.select(F.col(id_col).cast(docs.schema[id_col].dataType).alias("gone_id"))
    few = gone.count() <= p.broadcast_ids
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = F.col(f"c{names.index(id_col)}")
    return plain.join(F.broadcast(gone) if few else gone, at == F.col("gone_id"), "left_anti").toDF(*names)
