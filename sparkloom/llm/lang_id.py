"""Language ID by compression: per-language zstandard raw-content dictionaries, the smallest code wins.

A text is normalised (lower case, ASCII non-letters to blanks) and encoded whole, repeated words
included, in segments, once with each language's dictionary. A dictionary is the language's most frequent
words, the most frequent last (nearest to what is coded), from a sample of all learning rows.

Defined results: a null text or one without letters is `und` with score 0; without learned languages
all are `und`. Ties go to the language of more learning documents, then the smaller name. `rejected` marks narrow margins.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import append_columns, pick, table

_LETTER = regex.compile(r"\p{L}")
#: ASCII letters lower-cased, other ASCII to blanks, bytes of other letters kept.
_TABLE = bytes(c if 97 <= c < 123 or c >= 128 else c + 32 if 65 <= c < 91 else 32 for c in range(256))


@dataclass(frozen=True)
class LanguageParams:
    #: Learning documents for each language, those with the smallest hash of the id, and bytes of each dictionary.
    docs_per_language: int = 1_500
    dictionary_bytes: int = 32_000
    level: int = 6
    segment: int = 512
    #: Margins of a smaller share of the second size are rejected.
    min_margin: float = 0.01


def normalise(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_TABLE).split())


def learn(docs: DataFrame, p: LanguageParams, learn_from, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """Dictionaries by language, those of more learning documents first. Counts give each language's sampling rate, then the rows are read.

    The sample holds about docs_per_language documents of each language, of any length. Words are counted by
    Spark, and only the words of a dictionary reach the driver.
    """
    d = pick(docs, id=id_col, text=text, lang=lang).where("text is not null and lang is not null").where(learn_from(F.col("id")))
    rates = table(d.groupBy("lang").count().withColumn("rate", F.least(F.lit(1.0), F.lit(float(p.docs_per_language)) / F.col("count"))), "rates")
    u = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    sample = d.join(rates.select("lang", "rate"), "lang").where(u < F.col("rate")).select("lang", "text")

    def count(batches):
        for b in batches:
            found: dict[str, Counter] = {}
            for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found.setdefault(lang, Counter()).update(normalise(t).split())
            for lang, c in found.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array([w.decode("utf-8", "replace") for w in c], pa.string()), pa.array(c.values(), pa.int64())], names=["lang", "word", "n"])

    words = sample.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    top = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    best = words.withColumn("k", F.row_number().over(top)).where(F.col("k") <= p.dictionary_bytes // 2).orderBy("lang", "k").toArrow().to_pydict()
    docs_of = {r["lang"]: r["count"] for r in rates.collect()}  # a row for each language
    out: dict[str, list[bytes]] = {}
    for lang, word in zip(best["lang"], best["word"], strict=True):
        out.setdefault(lang, []).append(word.encode())
    return {lang: b" ".join(reversed(ws))[-p.dictionary_bytes :] for lang, ws in sorted(out.items(), key=lambda x: (-docs_of[x[0]], x[0]))}


def predict(docs: DataFrame, dictionaries: dict[str, bytes], p: LanguageParams = LanguageParams(), text: str = "text") -> DataFrame:
    """docs with lang_pred, score (0 to 1, 0.5 at no margin) and rejected; ties go to the earlier dictionary."""
    sent = docs.sparkSession.sparkContext.broadcast(list(dictionaries.items()))
    coders: dict = {}

    def make(column):
        import zstandard

        if "all" not in coders:
            for lang, content in sent.value:
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=p.level)
                coders[lang] = zstandard.ZstdCompressor(level=p.level, dict_data=d, write_checksum=False, write_content_size=False).compress
            coders["all"] = [(lang, coders[lang]) for lang, _ in sent.value]
        langs, scores, rejected = [], [], []
        for value in column:
            t = value.as_py()
            if not t or not coders["all"] or not _LETTER.search(t):
                langs.append("und"), scores.append(0.0), rejected.append(True)
                continue
            b = normalise(t)
            parts = [b[i : i + p.segment] for i in range(0, len(b), p.segment)]
            sizes = sorted((sum(len(code(x)) for x in parts), k, lang) for k, (lang, code) in enumerate(coders["all"]))
            margin = (sizes[1][0] - sizes[0][0]) / sizes[1][0] if len(sizes) > 1 else 1.0
            langs.append(sizes[0][2])
            scores.append(float(1 / (1 + np.exp(-40 * margin))))
            rejected.append(margin < p.min_margin)
        return pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())

    return append_columns(docs, make, T.StructType().add("lang_pred", "string").add("score", "double").add("rejected", "boolean"), text)
