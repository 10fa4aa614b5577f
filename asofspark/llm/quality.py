"""Line-first quality rules, in SQL expressions alone.

Every line is judged on its own: closing punctuation, symbols, stutter, capitals,
navigation (``NAV_RUN`` short lines in a row without a sentence's end), and
boilerplate: known phrases, a repetition of an earlier line, or a short line that the
corpus shows among many different neighbours. Failed lines go, and a document
that loses too much of its text goes with them.

Boilerplate is learned from all documents, in any language: a line counts by the
different pairs of lines around it, so copies of a text count once. A learned line needs
one such pair for every ``DOCUMENTS_A_CONTEXT`` documents, which bounds the learned
lines by that number times the lines of a mean document, however large the corpus.
Texts are read and judged in one pass; only hashes of lines are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asofspark.llm.common import checkpointed, column_of, content_key, text_of

SPACE = " \t\n\x0b\x0c\r"
_GAP = r"[\x20\x09-\x0D]+"
_WORD_START = r"[^\x20\x09-\x0D]"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

MIN_KEPT_SHARE = 0.5
"""Share of a document's characters that its good lines must hold."""
LONG_LINE = 60
"""From so many characters on a line must close like a sentence."""

NAV_WORDS, NAV_RUN = 5, 5
"""A line of so few words is short; so many short lines in a row are navigation."""
LEARNED_CHARS = 120
"""Longer lines are never learned as boilerplate."""
LEAST_CONTEXTS, DOCUMENTS_A_CONTEXT = 20, 5_000
"""Different neighbourhoods a learned line has at least, alone and by the number of documents."""

# fixed values: phrases of site furniture, lower-cased
BOILERPLATE = (
    "accept cookies", "all rights reserved", "click here", "cookie policy", "enable javascript", "javascript is disabled", "lorem ipsum",
    "privacy policy", "sign up for our newsletter", "terms of use", "use of cookies", "powered by", "skip to content",
)


def words_of(text: Column) -> Column:
    """Maximal runs of anything but ASCII white space."""
    trimmed = F.trim(text, F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _GAP, -1))


def measured(line: Column, suspect: Column) -> Column:
    """What the rules need of a line, each figure taken once; phrases are sought only where ``suspect``."""
    words = words_of(line)
    low = F.lower(line)
    phrase = F.lit(False)
    for p in BOILERPLATE:
        phrase = phrase | F.contains(low, F.lit(p))
    return F.struct(
        line.alias("line"),
        F.length(line).alias("chars"),
        F.length(F.regexp_replace(line, r"\P{L}+", "")).alias("letters"),
        F.length(F.regexp_replace(line, r"\P{Lu}+", "")).alias("capitals"),
        F.length(F.regexp_replace(line, r"[^#*$%&|<>{}\[\]=_~^»›•·]+", "")).alias("symbols"),
        F.struct(F.array_size(words).alias("all"), F.size(F.array_distinct(words)).alias("distinct")).alias("words"),
        F.regexp_like(line, F.lit(r"[.!?…:;\"'”’»)\]。！？]\s*$")).alias("closed"),
        (suspect & phrase).alias("phrase"),
    )


def navigation(measured_lines: Column) -> Column:
    """For each measured line n, where it lies in a run of short open lines, or another letter; null where there is no such run."""
    flags = F.array_join(F.transform(measured_lines, lambda m: F.when((m["words"]["all"] <= NAV_WORDS) & ~m["closed"], "s").otherwise("l")), "")
    inside = "|".join(f"(?<=s{{{k}}})s(?=s{{{NAV_RUN - 1 - k}}})" for k in range(NAV_RUN))
    return F.when(F.contains(flags, F.lit("s" * NAV_RUN)), F.split(F.regexp_replace(flags, inside, "n"), ""))


def line_places(body: DataFrame) -> DataFrame:
    """(key, h, around) of every line with a word that is short enough to be learned; written."""
    has_word = lambda line: F.regexp_like(line, F.lit(_WORD_START))
    lines = body.select("key", F.filter(F.split("text", "\n", -1), has_word).alias("lines"))
    hashed = lines.select("key", F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("h"), (F.length(x) <= LEARNED_CHARS).alias("few"))).alias("hs"))
    at = lambda i, edge: F.coalesce(F.get("hs", i).h, F.lit(edge))
    found = F.transform("hs", lambda p, i: F.when(p.few, F.struct(p.h.alias("h"), F.xxhash64(at(i - 1, 1), at(i + 1, 2)).alias("around"))))
    return checkpointed(hashed.select("key", F.inline(F.filter(found, lambda p: p.isNotNull()))))


def learned_lines(body: DataFrame) -> DataFrame:
    """(key, learned): per text the hashes of its lines that the corpus shows to be boilerplate."""
    places = line_places(body)
    least = body.agg(F.greatest(F.lit(LEAST_CONTEXTS), F.ceil(F.count(F.lit(1)) / DOCUMENTS_A_CONTEXT)).alias("n"))
    contexts = places.select("h", "around").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    common = contexts.filter(F.col("n") >= least.scalar()).select("h")
    return places.join(common, "h", "left_semi").groupBy("key").agg(F.collect_set("h").alias("learned"))


def passes(m: Column) -> Column:
    """Whether a measured line with a word passes: closed if long, few symbols, letters, not shouting, no stutter, no phrase."""
    w = m["words"]
    return (
        ((m["chars"] < LONG_LINE) | m["closed"])
        & (m["symbols"] * 20 <= m["chars"])
        & (m["letters"] * 2 >= m["chars"])
        & ((m["letters"] < 20) | (m["capitals"] * 2 <= m["letters"]))
        & ((w["all"] < 12) | (w["distinct"] * 5 >= F.least(w["all"], F.lit(60)) * 2))
        & ~m["phrase"]
    )


def judge(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds nothing but returns doc_id, kept_text, the counts, base_failed and kept per document.

    Null texts have no words: all counts are zero and the base rule fails. A
    line that equals an earlier line of its document is boilerplate. Every row
    appears, equal rows too; an empty table gives none; other columns are not read.
    """
    body = docs.select(column_of(docs, id_col).alias("doc_id"), content_key(text_of(docs, text)).alias("key"), text_of(docs, text).alias("text"))
    learned = checkpointed(learned_lines(body))  # a plain table, so that the rows of a hot text are split over tasks
    has_word = lambda line: F.regexp_like(line, F.lit(_WORD_START))
    suspect = F.lit(False)
    for p in BOILERPLATE:
        suspect = suspect | F.contains(F.lower("text"), F.lit(p))
    rows = body.select(
        "doc_id",
        "key",
        "text",
        suspect.alias("suspect"),
        words_of(F.col("text")).alias("words"),
        F.filter(F.split("text", "\n", -1), has_word).alias("lines"),
    )
    n = F.size("words")
    rows = rows.select(
        "doc_id",
        "key",
        "suspect",
        "lines",
        F.array_distinct("lines").alias("first_lines"),
        n.cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    window = lambda i: F.xxhash64(*[F.col("hashes")[i + k] for k in range(WINDOW)])
    windows = F.transform(F.sequence(F.lit(0), F.size("hashes") - WINDOW), window)
    rows = rows.select(
        "*",
        F.when(F.size("hashes") > WINDOW, windows).otherwise(F.array().cast("array<bigint>")).alias("windows"),
        F.transform("first_lines", lambda line: measured(line, F.col("suspect"))).alias("measured"),
    )
    rows = rows.withColumn("nav", navigation(F.col("measured")))
    rows = rows.select(
        "doc_id",
        "key",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size("first_lines")).cast("bigint").alias("n_dup_lines"),
        F.transform(
            F.filter("measured", lambda m, i: passes(m) & F.coalesce(F.get("nav", i) != "n", F.lit(True))),
            lambda m: F.struct(m["line"].alias("line"), F.when(m["chars"] <= LEARNED_CHARS, F.xxhash64(m["line"])).alias("h"), m["chars"].alias("chars")),
        ).alias("good"),
        "windows",
        F.length(F.array_join("lines", "")).alias("n_chars"),
        F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("placed"),
    )
    twice = F.filter(
        F.transform(
            "placed",
            lambda e, k: F.when(
                ((k > 0) & (F.col("placed")[F.greatest(k - 1, F.lit(0))]["h"] == e["h"]))
                | ((k < F.size("placed") - 1) & (F.col("placed")[F.least(k + 1, F.size("placed") - 1)]["h"] == e["h"])),
                e["i"],
            ),
        ),
        lambda i: i.isNotNull(),
    )
    covered = F.aggregate(
        F.sort_array(twice),
        F.struct(F.lit(0).alias("total"), F.lit(-WINDOW).alias("last")),
        lambda acc, i: F.struct((acc["total"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("total"), i.alias("last")),
        lambda acc: acc["total"],
    )
    chars = lambda entries: F.aggregate(entries, F.lit(0), lambda acc, g: acc + g["chars"])
    rows = rows.select(
        "doc_id", "key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_chars", "good",
        F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"),
        chars(F.col("good")).alias("good_chars"),
        F.transform(F.filter("good", lambda g: g["h"].isNotNull()), lambda g: F.struct(g["h"].alias("h"), g["chars"].alias("chars"))).alias("short"),
    )
    rows = rows.join(learned, "key", "left")
    found = lambda g: F.coalesce(F.array_contains("learned", g["h"]), F.lit(False))
    lost = F.when(F.col("learned").isNull(), 0).otherwise(chars(F.filter("short", found)))
    kept_text = F.array_join(F.transform(F.filter("good", lambda g: ~found(g)), lambda g: g["line"]), "\n")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    enough = F.col("good_chars") - lost >= MIN_KEPT_SHARE * F.col("n_chars")
    return rows.select(
        "doc_id", kept_text.alias("kept_text"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & enough).alias("kept"),
    )
