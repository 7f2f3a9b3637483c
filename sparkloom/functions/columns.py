"""Scalar column helpers: all of them are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented letters and what the `ascii` filter makes of them (fixed values).
ACCENTED = "àâäáãåçéèêëíìîïñóòôöõúùûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def content_hash(c) -> Column:
    return F.sha2(c, 256)


def short_hash(*parts) -> Column:
    """The first 16 hex digits of the SHA-256 of the parts put together."""
    return F.substring(F.sha2(F.concat(*parts), 256), 1, 16)


def symbol_id(path, name) -> Column:
    return F.concat(path, F.lit("::"), name)


def dirname(path) -> Column:
    """The folder; an empty string for a bare file name, `root` for an empty path."""
    return F.when(path == "", "root").otherwise(F.regexp_extract(path, "^(.*)/[^/]*$", 1))


def file_of_id(node_id) -> Column:
    """The path of `path::name` ids and of plain paths."""
    return F.substring_index(node_id, "::", 1)


def last_component(name) -> Column:
    """What follows the last `::`, `.` or `/`."""
    return F.regexp_extract(name, "([^:./]*)$", 1)


def module_path(name) -> Column:
    """`::` and `.` become `/`, unless the name has a `/`."""
    return F.when(name.contains("/"), name).otherwise(F.replace(F.replace(name, F.lit("::"), F.lit("/")), F.lit("."), F.lit("/")))


def pascal_case(name) -> Column:
    """A type name guessed from a snake_case name."""
    return F.array_join(F.transform(F.filter(F.split(name, "_"), lambda w: w != ""), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), "")


def non_blank_length(c) -> Column:
    return F.length(F.regexp_replace(c, "\\s", ""))


def lines(c) -> Column:
    """Lines without their ends; a last empty line doesn't count."""
    return F.split(F.regexp_replace(c, "\\r?\\n\\z", ""), "\\r?\\n")


def has_hidden_part(path) -> Column:
    return F.exists(F.split(path, "/"), lambda p: p.startswith("."))


def terms(c) -> Column:
    """Analyzer: runs of letters and digits, lower case, accents folded."""
    return F.regexp_extract_all(F.translate(F.lower(c), ACCENTED, PLAIN), F.lit("([a-z0-9]+)"), F.lit(1))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def boost(in_degree) -> Column:
    """1 + ln(1 + calls) / 10."""
    return 1 + F.log1p(in_degree) * 0.1
