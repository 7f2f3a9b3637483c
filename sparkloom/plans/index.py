"""The index: tables of one branch as Parquet, brought up to date by content hash.

Tables of files are dealt to buckets by a hash of the path. An update writes the touched buckets anew and leaves the
others; a pointer file, replaced at the end, says which folders count. All folders are paths of any file
system that Spark knows.
"""

from __future__ import annotations

import json
import time
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..config import Config
from ..functions.columns import symbol_id
from ..operators import vectors
from ..operators.extract import extract_chunks, extract_errors, extract_refs, extract_symbols, with_embeddings
from ..operators.intervals import line_nodes, symbol_chunks
from ..operators.resolve import resolve
from ..operators.search import postings
from ..sources.repo import scan_repo
from ..store import by_shuffle, delete, read_text, subfolders, write_text, written


def branch_of(root: str) -> str:
    """The checked-out branch, `default` if there is none."""
    head = Path(root, ".git/HEAD")
    text = head.read_text().strip() if head.is_file() else ""
    return text.removeprefix("ref: refs/heads/") if text.startswith("ref: refs/heads/") else "default"


def classify(stored: DataFrame, scanned: DataFrame) -> DataFrame:
    """path, status: new, updated, removed or skipped, by content hash."""
    s = stored.select("path", F.col("hash").alias("old"))
    n = scanned.select("path", F.col("hash").alias("new"))
    status = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "skipped").otherwise("updated")
    return s.join(n, "path", "full_outer").select("path", status.alias("status"))


def replace_rows(stored: DataFrame, gone: DataFrame, new: DataFrame) -> DataFrame:
    """stored without the paths of gone, and new."""
    return stored.join(gone.select("path"), "path", "left_anti").unionByName(new, allowMissingColumns=True)


def build_edges(symbols: DataFrame, chunks: DataFrame, refs: DataFrame) -> DataFrame:
    """All edges from the stored nodes and references; resolved anew each time, so none goes stale."""
    d1 = symbols.select(F.col("path").alias("src"), F.col("symbol_id").alias("dst"), F.lit("defines").alias("relation"))
    child = symbols.where("parent_scope is not null").select(symbol_id(F.col("path"), F.col("parent_scope")).alias("src"), F.col("symbol_id").alias("dst"))
    d2 = child.join(by_shuffle(symbols.select(F.col("symbol_id").alias("src"))), "src", "left_semi").select("src", "dst", F.lit("defines").alias("relation"))
    c = symbol_chunks(symbols, chunks).select(F.col("symbol_id").alias("src"), F.col("chunk_id").alias("dst"), F.lit("contains").alias("relation"))
    keyed = refs.withColumn("ref_id", F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(x).cast("string"), F.lit("")) for x in refs.columns]), 256)).dropDuplicates(["ref_id"])
    keyed = written(keyed, "keyed")
    to = resolve(keyed, symbols).select("ref_id", "ref_kind", F.col("symbol_id").alias("dst"))
    at = line_nodes(keyed, symbols, chunks).select("ref_id", F.col("node").alias("src"))
    r = to.join(by_shuffle(at), "ref_id").select("src", "dst", F.when(F.col("ref_kind") == "call", "calls").otherwise("imports").alias("relation"))
    return d1.union(d2).union(c).union(r).dropDuplicates(["src", "dst", "relation"])


#: Tables whose rows belong to one file each, and their schemas.
OF_FILES = {"files": schema.FILES, "chunks": schema.CHUNKS + ", embedding array<float>", "symbols": schema.SYMBOLS, "refs": schema.REFS, "postings": "path string, term string, chunk_id string, tf long, dl long", "errors": "path string, error string"}
WHOLE = {"edges": schema.EDGES, "commit_log": schema.COMMITS}


def bucket_of(path, buckets: int):
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


class Index:
    """Tables below root_dir/branch=<b>/. The pointer names the folders of each table, by bucket for tables of files."""

    def __init__(self, spark: SparkSession, root_dir: str, branch: str = "default", buckets: int = 16):
        self.spark, self.dir, self.buckets = spark, f"{root_dir}/branch={branch}", buckets

    def _pointer(self) -> dict:
        text = read_text(self.spark, f"{self.dir}/pointer.json")
        return json.loads(text) if text else {"buckets": self.buckets, "tables": {}, "centres": []}

    def _point(self, new: dict) -> None:
        old = self._pointer()
        write_text(self.spark, f"{self.dir}/pointer.json", json.dumps(new))
        dirs = lambda x: {d for t in x["tables"].values() for d in t.values()}
        for gone in dirs(old) - dirs(new):  # a reader that began before this has to begin again
            delete(self.spark, f"{self.dir}/{gone}")

    def exists(self) -> bool:
        return bool(self._pointer()["tables"])

    def read(self, name: str, only: list[int] | None = None) -> DataFrame:
        """A table; with `only` the rows of these buckets."""
        kind = OF_FILES.get(name) or WHOLE[name]
        at = self._pointer()["tables"].get(name, {})
        paths = [f"{self.dir}/{d}" for k, d in sorted(at.items()) if only is None or int(k) in only]
        return self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)

    def _replace(self, pointer: dict, name: str, rows: DataFrame, touched: list[int]) -> None:
        """Writes the touched buckets of a table of files; `rows` are all that they hold from now on."""
        new = f"{name}-{uuid.uuid4().hex}"
        n = pointer["buckets"]
        rows.withColumn("bucket", bucket_of(F.col("path"), n)).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.dir}/{new}")
        there = [x.removeprefix("bucket=") for x in subfolders(self.spark, f"{self.dir}/{new}") if x.startswith("bucket=")]
        at = {k: d for k, d in pointer["tables"].get(name, {}).items() if int(k) not in touched}
        pointer["tables"][name] = at | {k: f"{new}/bucket={k}" for k in there}

    def _apply(self, gone: DataFrame, new: dict[str, DataFrame], note: str) -> None:
        """Takes the files of gone (path) out, puts new rows in, resolves edges and adds a commit."""
        pointer = self._pointer()
        touched = [r[0] for r in gone.select(bucket_of(F.col("path"), pointer["buckets"])).distinct().collect()]  # at most `buckets`
        if touched:
            for name in OF_FILES:
                if name == "postings":  # made from the written chunks
                    continue
                kept = self.read(name, touched).join(gone.select("path"), "path", "left_anti")
                self._replace(pointer, name, kept.unionByName(new[name]) if name in new else kept, touched)
            self._point(pointer)
            self._replace(pointer, "postings", postings(self.read("chunks", touched), "path").select("path", "term", "chunk_id", "tf", "dl"), touched)
            edges = f"edges-{uuid.uuid4().hex}"
            build_edges(self.read("symbols"), self.read("chunks"), self.read("refs")).write.parquet(f"{self.dir}/{edges}")
            pointer["tables"]["edges"] = {"0": edges}
        now = int(time.time() * 1000)
        log = pointer["tables"].get("commit_log", {})
        entry = f"commit_log-{uuid.uuid4().hex}"
        self.spark.createDataFrame([(f"commit:{now}", now, note)], schema.COMMITS).coalesce(1).write.parquet(f"{self.dir}/{entry}")
        pointer["tables"]["commit_log"] = log | {str(len(log)): entry}
        self._point(pointer)

    def update(self, files: DataFrame, config: Config | None = None, full: bool = False, partial: bool = False) -> dict[str, int]:
        """Brings the index to the scanned files: counts of new, updated, removed and skipped.

        With full all files count as changed; with partial, files that were not scanned stay.
        """
        config = config or Config()
        c = config.chunking
        files = files.select("path", "language", "content", "hash", F.col("last_modified") if "last_modified" in files.columns else F.lit(None).cast("long").alias("last_modified")).persist()
        try:
            status = classify(self.read("files"), files)
            if partial:
                status = status.where("status <> 'removed'")
            if full:
                status = status.withColumn("status", F.when(F.col("status") == "skipped", "updated").otherwise(F.col("status")))
            status = status.persist()
            stats = {"new": 0, "updated": 0, "removed": 0, "skipped": 0} | {r["status"]: r["count"] for r in status.groupBy("status").count().collect()}
            changed = files.join(status.where("status in ('new', 'updated')"), "path", "left_semi")
            chunks = with_embeddings(extract_chunks(changed, c.max_chars, c.max_tokens, c.overlap, c.strategy, c.ast), config.embedding.dim, batch=config.embedding.batch)
            new = {"files": changed, "chunks": chunks, "symbols": extract_symbols(changed), "refs": extract_refs(changed), "errors": extract_errors(changed)}
            self._apply(status.where("status <> 'skipped'"), new, ", ".join(f"{k} {v}" for k, v in stats.items()))
            status.unpersist()
        finally:
            files.unpersist()
        return stats

    def delete(self, path: str) -> None:
        self._apply(self.spark.createDataFrame([(path,)], "path string"), {}, f"deleted {path}")

    def fit_vectors(self, lists: int = 16) -> None:
        """Fits the vector index's centres to the stored vectors and deals them to lists."""
        pointer = self._pointer()
        pointer["centres"] = vectors.centres(self.read("chunks"), lists)
        new = f"vectors-{uuid.uuid4().hex}"
        dealt = vectors.with_lists(self.read("chunks").where("embedding is not null").select("chunk_id", "embedding"), pointer["centres"])
        dealt.repartition("list").write.partitionBy("list").parquet(f"{self.dir}/{new}")
        pointer["tables"]["vectors"] = {"0": new}
        self._point(pointer)

    def nearest(self, query: list[float], k: int = 10, probes: int = 4) -> DataFrame:
        """chunk_id, score by the vector index; by a scan of all vectors where there is none."""
        pointer = self._pointer()
        if not pointer["tables"].get("vectors"):
            return vectors.search(self.read("chunks"), [], query, k)
        stored = self.spark.read.schema("chunk_id string, embedding array<float>, list int").parquet(f"{self.dir}/{pointer['tables']['vectors']['0']}")
        return vectors.search(stored, pointer["centres"], query, k, probes)

    def commits(self, limit: int = 5) -> DataFrame:
        return self.read("commit_log").orderBy(F.desc("timestamp"), "commit_id").limit(limit)

    def counts(self) -> DataFrame:
        out = None
        for n in ("files", "symbols", "chunks"):
            x = self.read(n).agg(F.count("*").alias("n")).select(F.lit(n).alias("table_name"), "n")
            out = x if out is None else out.union(x)
        return out.union(self.read("edges").groupBy("relation").count())


class Session:
    """A tree with its configuration and the index of its branch."""

    def __init__(self, spark: SparkSession, root: str, config: Config | None = None, index_dir: str | None = None):
        self.spark, self.root, self.config = spark, root, config or Config()
        self.index = Index(spark, index_dir or f"{Path(root).resolve()}/.loom", branch_of(root))

    def update(self, full: bool = False) -> dict[str, int]:
        return self.index.update(scan_repo(self.spark, self.root, self.config.core.include, self.config.core.exclude), self.config, full)

    def opened(self) -> Session:
        """The session, if its tree has an index."""
        if not self.index.exists():
            raise ValueError(f"no index of {self.root}: run `index` first")
        return self


def index_repo(spark: SparkSession, root: str, config: Config | None = None, index_dir: str | None = None) -> tuple[Index, dict[str, int]]:
    session = Session(spark, root, config, index_dir)
    return session.index, session.update()


def codebase_map(files: DataFrame, symbols: DataFrame, depth: int = 5) -> DataFrame:
    """path, entry: files to a depth, indented by folder, with their first five top-level symbols."""
    from ..functions.columns import has_hidden_part
    from ..operators.search import first_per

    top = first_per(symbols.where("kind in ('class', 'function', 'interface', 'struct') and parent_scope is null"), "path", 5, "start_line", "symbol_id")
    names = top.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_line", "name"))), lambda x: x["name"]), ", ").alias("names"))
    f = files.where(~has_hidden_part(F.col("path")) & (F.size(F.split("path", "/")) <= depth)).join(names, "path", "left")
    entry = F.concat(F.repeat(F.lit("  "), F.size(F.split("path", "/")) - 1), F.regexp_extract("path", "([^/]*)$", 1), F.when(F.col("names").isNotNull(), F.concat(F.lit(": "), F.col("names"))).otherwise(""))
    return f.select("path", entry.alias("entry")).orderBy("path")
