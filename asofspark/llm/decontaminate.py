"""Benchmark passages in documents, by a prefix-filtered join.

Every window of 13 consecutive item words (a shorter item is one window) is a
set of tokens, and containment must be exact, so one token of each window is a
sufficient prefix: its rarest one over all documents. Document words meet those
tokens in a join; where one is met, the token's place in the window fixes where
the window would have to start (the positional bound) and end (the length
bound). What is left is compared word by word with the document.

Item windows are broadcast only where their counted number is within
``MAX_BROADCAST_WINDOWS``; larger benchmarks are joined by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from asofspark.llm.common import checkpointed, column_of, content_key, text_of, unused

SPAN = 13
MIN_SHARE = 20
"""A document is contaminated if hit words times this reach its words."""
MAX_BROADCAST_WINDOWS = 200_000

_APART = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Runs of ASCII letters, digits and characters beyond ASCII, in their own case."""
    return F.filter(F.split(text, _APART, -1), lambda w: w != "")


def folded(word: Column) -> Column:
    """A-Z in lower case; other letters as they are."""
    return F.when(F.regexp_like(word, F.lit("[A-Z]")), F.translate(word, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(word)


def item_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, window, words): distinct windows of every item with a word; null ids stay null."""
    items = benchmark.select(column_of(benchmark, item_id).cast("string").alias("item"), F.transform(words_of(text_of(benchmark, text)), folded).alias("all"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - SPAN + 1, F.lit(1)))
    cut = items.filter(F.size("all") > 0).select("item", F.explode(F.transform(starts, lambda i: F.slice("all", i, SPAN))).alias("words"))
    return cut.select("item", F.array_join("words", " ").alias("window"), "words").distinct()


def _sized(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= MAX_BROADCAST_WINDOWS else df


def prefix_index(windows: DataFrame, spoken: DataFrame, n: int) -> DataFrame:
    """(token, offset, span, window): each window under its rarest token; windows with a token no document has are left out."""
    each = windows.select("window", F.size("words").alias("span"), F.posexplode("words").alias("offset", "token"))
    counts = spoken.join(_sized(each.select("token").distinct(), n), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    first = F.row_number().over(Window.partitionBy("window").orderBy(F.coalesce("n", F.lit(0)), "token", "offset"))
    best = each.join(counts, "token", "left").withColumn("k", first).filter("k = 1 AND n > 0")
    return best.select("token", "offset", "span", "window")


def occurrences(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(key, n_hit, windows) per text with an occurrence, keyed by content, and (item, window) of the benchmark.

    Equal texts share a key, so copies are verified per row but counted once.
    """
    items = checkpointed(item_windows(benchmark))
    windows = items.select("window", "words").distinct()
    n = items.count()
    body = docs.select(content_key(text_of(docs, text)).alias("key"), text_of(docs, text).alias("text"))
    spoken = body.select(F.explode(words_of(F.col("text"))).alias("word")).select(folded(F.col("word")).alias("token"))
    index = checkpointed(prefix_index(windows, spoken, n))

    placed = body.select("key", F.posexplode(words_of(F.col("text"))).alias("pos", "word")).select("key", "pos", folded(F.col("word")).alias("token"))
    met = placed.join(_sized(index.select("token").distinct(), n), "token", "left_semi").distinct()
    starts = met.join(_sized(index, n), "token").select("key", F.struct((F.col("pos") - F.col("offset")).alias("start"), "span", "window").alias("c"))
    wanted = starts.filter("c.start >= 0").groupBy("key").agg(F.collect_list("c").alias("candidates"))

    whole = body.join(wanted, "key").select("key", F.transform(words_of(F.col("text")), folded).alias("words"), "candidates")
    exact = F.filter(
        "candidates",
        lambda c: (c["start"] + c["span"] <= F.size("words")) & (F.array_join(F.slice("words", c["start"] + 1, c["span"]), " ") == c["window"]),
    )
    found = whole.select("key", exact.alias("found"))
    spans = F.sort_array(F.transform("found", lambda c: F.struct(c["start"].alias("a"), (c["start"] + c["span"]).alias("b"))))
    hit = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("total"), F.lit(0).alias("reach")),
        lambda acc, s: F.struct(
            (acc["total"] + F.greatest(F.lit(0), s["b"] - F.greatest(s["a"], acc["reach"]))).alias("total"), F.greatest(acc["reach"], s["b"]).alias("reach")
        ),
        lambda acc: acc["total"],
    )
    seen = F.array_distinct(F.transform("found", lambda c: c["window"]))
    # filtered once written: a filter before would be pushed below the word arrays and compute them per candidate
    out = checkpointed(found.select("key", hit.alias("n_hit"), seen.alias("windows")))
    return out.filter("n_hit > 0"), items.select("item", "window")


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items, contaminated and key per document.

    Null and empty texts have no words and are not contaminated. An item with a
    null id marks words but is not listed. Equal rows all appear; other columns
    are not read. ``items`` is in string order and null where nothing was found.
    """
    found, items = occurrences(docs, benchmark)
    per = found.groupBy("key").agg(F.max("n_hit").alias("n_hit"))
    named = found.select("key", F.explode("windows").alias("window")).distinct().join(items.filter("item IS NOT NULL"), "window")
    lists = named.select("key", "item").distinct().groupBy("key").agg(F.sort_array(F.collect_list("item")).alias("items"))
    per = per.join(lists, "key", "left")
    base = docs.select(
        column_of(docs, id_col).alias("doc_id"), content_key(text_of(docs)).alias("key"), F.size(words_of(text_of(docs))).cast("bigint").alias("n_words")
    )
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return base.join(per, "key", "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce(F.array_size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        "items",
        ((n_hit > 0) & (n_hit * MIN_SHARE >= F.col("n_words"))).alias("contaminated"),
        "key",
    )


def hit_digests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The report with the item list as a digest."""
    out = report(docs, benchmark)
    listed = F.coalesce(F.array_join("items", ","), F.lit(""))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(listed, 256).alias("items_sha256"), "contaminated")


def clean_only(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with the columns of ``docs``, whatever their names.

    Null and empty texts have no words and stay; repeated rows all stay or go.
    """
    n, key = unused(docs, "n_hit", "hit_key")
    found, _ = occurrences(docs, benchmark)
    hit = found.groupBy("key").agg(F.max("n_hit").alias(n)).withColumnRenamed("key", key)
    joined = docs.join(hit, content_key(text_of(docs)) == F.col(key), "left")
    n_words = F.size(words_of(text_of(docs)))
    bad = F.col(n).isNotNull() & (F.col(n) * MIN_SHARE >= n_words)
    return joined.filter(~bad).drop(n, key)
