"""Scans of a source tree: globs, languages, ignore rules, reads, spans and listings."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import content_hash, has_hidden_part, lines

#: Languages by file extension (fixed values).
LANGUAGES = {"py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "rs": "rust", "go": "go", "java": "java", "c": "c", "h": "cpp", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "cs": "csharp", "rb": "ruby", "php": "php"}
#: Folders at the root that are never scanned (fixed values).
BUILT_IN_EXCLUDES = ("node_modules/**", "dist/**", "build/**", "target/**", ".git/**")


def glob_to_regex(glob: str) -> str:
    """`*` and `?` stay within a path part, `**` spans parts, `{a,b}` and `[..]` as usual. ValueError if it can't be read."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[":
            end = glob.find("]", i + 2)
            if end < 0:
                raise ValueError(f"glob {glob!r}")
            body = glob[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] == "!" else body) + "]", end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += re.escape(c)
        i += 1
    if depth:
        raise ValueError(f"glob {glob!r}")
    return f"^{out}$"


def matches(path, globs) -> F.Column:
    """Whether any of the globs matches; globs that can't be read are skipped."""
    found = F.lit(False)
    for g in globs:
        try:
            found = found | path.rlike(glob_to_regex(g))
        except ValueError:
            continue
    return found


#: Names of the languages as they are shown (fixed values).
SHOWN = {"python": "Python", "javascript": "JavaScript", "typescript": "TypeScript", "rust": "Rust", "go": "Go", "java": "Java", "cpp": "Cpp", "c": "C", "ruby": "Ruby", "php": "Php", "csharp": "CSharp"}


def language_from_name(name) -> F.Column:
    """The language of that name in any case; `unknown` for others."""
    return F.when(F.lower(name).isin(*SHOWN), F.lower(name)).otherwise("unknown")


def shown(language) -> F.Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SHOWN.items() for x in kv]), language), F.lit("Unknown"))


def language_of(path) -> F.Column:
    """The language of a path's extension, which is case-sensitive; null if unknown."""
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.try_element_at(known, F.regexp_extract(path, "\\.([^./]+)$", 1))


def ignore_rules(root: str) -> list[tuple[bool, str]]:
    """(ignored, regex) of the tree's .gitignore files, in the order that they apply."""
    rules = []
    for f in sorted(Path(root).rglob(".gitignore"), key=lambda f: len(f.parts)):
        base = f.parent.relative_to(root).as_posix()
        for line in f.read_text(errors="replace").splitlines():
            rule = line.rstrip()
            if not rule or rule.startswith("#"):
                continue
            keep, rule = rule.startswith("!"), rule.lstrip("!")
            anchored = "/" in rule.rstrip("/")
            body = rule.strip("/")
            glob = (f"{base}/" if base != "." else "") + (body if anchored else f"**/{body}")
            try:
                rules.append((not keep, glob_to_regex(glob)[:-1] + ("/.*$" if rule.endswith("/") else "(?:/.*)?$")))
            except ValueError:
                continue
    return rules


def ignored(path, rules) -> F.Column:
    found = F.lit(False)
    for out, regex in rules:
        found = F.when(path.rlike(regex), F.lit(out)).otherwise(found)
    return found


def scan_repo(spark: SparkSession, root: str, include=("**/*",), exclude=(), use_ignore: bool = True) -> DataFrame:
    """files: path, language, content, hash, last_modified; only known languages and valid UTF-8."""
    base = Path(root).resolve().as_posix()
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"file://{base}")
    path = F.regexp_replace("path", "^file:/*" + re.escape(base.lstrip("/")) + "/", "")
    f = raw.select(path.alias("path"), "content", F.unix_seconds("modificationTime").alias("last_modified"))
    f = f.withColumn("language", language_of(F.col("path"))).where("language is not null")
    f = f.where(matches(F.col("path"), include) & ~matches(F.col("path"), (*BUILT_IN_EXCLUDES, *exclude)))
    if use_ignore:
        f = f.where(~ignored(F.col("path"), ignore_rules(root)))
    f = f.where(F.is_valid_utf8("content")).withColumn("content", F.col("content").cast("string"))
    return f.select("path", "language", "content", content_hash(F.col("content")).alias("hash"), "last_modified")


def listing(files: DataFrame, folder: str = "", depth: int = 1, limit: int = 100, exclude=()) -> DataFrame:
    """path, is_dir below a folder to a depth, hidden ones left out, in path order."""
    f = files.select("path").where(~has_hidden_part(F.col("path")) & ~matches(F.col("path"), (*BUILT_IN_EXCLUDES, *exclude)))
    start = folder.strip("/")
    skip = 0 if not start else start.count("/") + 1
    f = f.where(F.col("path").startswith(f"{start}/")) if start else f
    parts = F.split("path", "/")
    steps = f.select("path", parts.alias("parts"), F.explode(F.sequence(F.lit(skip + 1), F.least(F.size(parts), F.lit(skip + depth)))).alias("n")).where(F.col("n") > skip)
    out = steps.select(F.array_join(F.slice("parts", 1, F.col("n")), "/").alias("path"), (F.col("n") < F.size("parts")).alias("is_dir")).distinct()
    return out.orderBy("path").limit(limit)


def read_span(files: DataFrame, start: int = 0, end: int = 0) -> DataFrame:
    """path, text: lines start to end (from 1, inclusive); all if either is 0 or start lies past the end."""
    ls = lines(F.col("content"))
    whole = F.lit(start == 0 or end == 0) | (F.lit(start) > F.size(ls)) | F.lit(end < start)
    return files.select("path", F.when(whole, F.col("content")).otherwise(F.array_join(F.slice(ls, start or 1, max(end - start + 1, 1)), "\n")).alias("text"))


def read_files(files: DataFrame, paths: list[str]) -> DataFrame:
    return files.where(F.col("path").isin(paths)).select("path", "content")


def inside(root: str, path: str) -> Path:
    """The resolved path; ValueError if it lies outside root."""
    base = Path(root).resolve()
    full = (base / path).resolve()
    if not full.is_relative_to(base):
        raise ValueError(f"{path} lies outside {root}")
    return full
