"""Repeated runs of lines, by winnowing over line hashes.

A run is a stretch of consecutive lines with at least ``MIN_WORDS`` words. From
every line the shortest such stretch is taken, forwards and backwards; the line
with the least hash in it is a guaranteed fingerprint: wherever a run is repeated,
every shortest stretch inside picks the same line. Fingerprints that occur once are
done with. Positions of the others are joined back and extended both ways to the
stretches around them; a stretch whose content has occurred earlier marks its
lines, and marked lines are deleted. The stretches of a run cover all its lines
(forward ones up to the last that fits, backward ones from there), so exactly the
lines of later repeated runs go. Passages repeated inside longer lines stay.

The order of documents is that of (doc_id with nulls last, content key); rows that
repeat both are one document and share their fate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from asofspark.llm.common import checkpointed, column_of, content_key, in_parts, text_of, unused

MIN_WORDS = 50
"""Least words of a run."""

def line_stretches(text: str, min_words: int = MIN_WORDS) -> list[tuple[int, int, int, int, bytes]]:
    """(fingerprint, its line, first line, last line, content digest) of the shortest stretches, forwards and backwards.

    Lines without a word count nothing and do not break a run; ties between
    hashes go to the earlier line. Outer white space of a line is ignored.
    """
    import xxhash

    lines = [x.strip() for x in text.split("\n")]
    at = [i for i, x in enumerate(lines) if x]
    if not at:
        return []
    words = np.array([len(lines[i].split()) for i in at])
    reach = np.concatenate([[0], np.cumsum(words)])
    if reach[-1] < min_words:
        return []
    ends = np.searchsorted(reach, reach[:-1] + min_words)  # the first prefix that is long enough
    starts = np.searchsorted(reach, reach[1:] - min_words, "right") - 1
    n = len(at)
    pairs = {(i, int(e) - 1) for i, e in enumerate(ends) if e <= n} | {(int(s), j) for j, s in enumerate(starts) if s >= 0}
    hashes = [xxhash.xxh64_intdigest(lines[i]) for i in at]
    out = []
    for a, b in sorted(pairs):
        best = min(range(a, b + 1), key=lambda k: (hashes[k], k))
        digest = xxhash.xxh3_128_digest("\n".join(lines[i] for i in at[a : b + 1]))
        out.append((hashes[best] - (1 << 64) if hashes[best] >= 1 << 63 else hashes[best], at[best], at[a], at[b], digest))
    return out


def stretches(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(doc_id, key, print, spot, first, last, run) of all documents, written once.

    Null and empty texts, and those with too few words, have no stretch; an empty
    table gives none.
    """
    kind = docs.select(column_of(docs, id_col)).schema[0].dataType
    body = docs.select(column_of(docs, id_col).cast("string").alias("doc_id"), content_key(text_of(docs, text)).alias("key"), text_of(docs, text).alias("text"))
    columns = ["doc_id", "key", "print", "spot", "first", "last", "run"]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in in_parts(batches):
            rows = [(d, k, *s) for d, k, t in zip(b["doc_id"], b["key"], b["text"], strict=True) for s in line_stretches(t)]
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    out = body.mapInPandas(cut, "doc_id string, key binary, print long, spot int, first int, last int, run binary")
    return checkpointed(out.withColumn("doc_id", F.col("doc_id").cast(kind)))


def later_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, key, firsts, lasts): the stretches of a document whose content has occurred before."""
    found = stretches(docs, id_col, text)
    place = F.xxhash64("doc_id", "key", "spot")
    # grouped sides are written, so that each join meets two plain shuffles and a hot line or run is split over tasks
    repeated = checkpointed(found.groupBy("print").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter("a <> b").select("print"))
    position = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key", "first")
    near = checkpointed(found.join(repeated, "print", "left_semi").select("run", position.alias("at"), "last"))
    earliest = checkpointed(near.groupBy("run").agg(F.min("at").alias("source")))
    later = near.join(earliest, "run").filter(F.col("at") > F.col("source"))
    spans = later.select("at.doc_id", "at.key", F.struct(F.col("at.first").alias("first"), "last").alias("s")).distinct()
    return spans.groupBy("doc_id", "key").agg(F.collect_list("s.first").alias("firsts"), F.collect_list("s.last").alias("lasts"))


def kept_lines(text: str, firsts, lasts) -> str:
    """The text without the lines from each first to its last."""
    lines = text.split("\n")
    edge = np.zeros(len(lines) + 1, np.int64)
    np.add.at(edge, np.asarray(firsts, np.int64), 1)
    np.add.at(edge, np.asarray(lasts, np.int64) + 1, -1)
    gone = np.cumsum(edge) > 0
    return "\n".join(x for x, g in zip(lines, gone, strict=False) if not g)


@pandas_udf(StringType())
def _kept(texts: pd.Series, firsts: pd.Series, lasts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else kept_lines(t, a, b) for t, a, b in zip(texts, firsts, lasts, strict=True)], dtype=object)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with later repeated runs cut out of the text; every row stays, and other columns as they are.

    Null texts stay null; a text that is all repetition becomes empty; an empty
    table stays empty. Columns may have any name. Only texts that lose lines pass
    through Python.
    """
    run_id, run_key, firsts, lasts, cut = names = unused(docs, "run_id", "run_key", "firsts", "lasts", "cut")
    spans = later_runs(docs, id_col, text).toDF(run_id, run_key, firsts, lasts)
    body = column_of(docs, text)
    joined = docs.join(spans, column_of(docs, id_col).eqNullSafe(F.col(run_id)) & (content_key(text_of(docs, text)) == F.col(run_key)), "left")
    joined = joined.withColumn(cut, _kept(F.when(F.col(firsts).isNotNull(), body), F.col(firsts), F.col(lasts)))
    return joined.withColumn(text, F.coalesce(F.col(cut), body)).drop(*names)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed (lines) and the text that is left, per document.

    A null text counts as one empty line. Every row is answered, repeated ones
    too; an empty table gives no rows, and other columns are not read.
    """
    rows = docs.select(column_of(docs, "doc_id").alias("doc_id"), F.size(F.split(text_of(docs), "\n", -1)).cast("bigint").alias("n_lines"), text_of(docs).alias("text"))
    whole_gone = (F.col("text") == "") & (F.col("n_chars") > 0)
    left = F.when(whole_gone, 0).otherwise(F.size(F.split("text", "\n", -1)))
    out = without_repeats(rows.withColumn("n_chars", F.length("text")))
    return out.select("doc_id", "n_lines", (F.col("n_lines") - left).cast("bigint").alias("n_removed"), "text")
