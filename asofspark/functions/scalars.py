"""Column-to-column helpers: ids, times, hashes and small numeric forms.

Each takes and returns Spark columns, so Catalyst can fold, prune and
compile them like any built-in.
"""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from asofspark.fixed_values import PROBABILITY_CLIP


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- identifiers -----------------------------------------------------------


def canonical_id(c: str | Column, aliases: dict[str, str]) -> Column:
    """Trim, upper-case and resolve a short alias map; nulls stay null."""
    key = F.upper(F.trim(col(c)))
    table = F.create_map(*[F.lit(v) for v in chain.from_iterable(aliases.items())])
    return F.coalesce(F.try_element_at(table, key), key)


def fallback_id(identifier: str | Column, name: str | Column) -> Column:
    """``UNRESOLVED:<name>`` where the identifier is null or empty."""
    return F.coalesce(
        F.nullif(col(identifier), F.lit("")),
        F.concat(F.lit("UNRESOLVED:"), F.coalesce(col(name), F.lit(""))),
    )


def stable_id(*parts: str | Column) -> Column:
    """SHA-256 of the key parts joined by a bar."""
    return F.sha2(F.concat_ws("|", *[col(p).cast("string") for p in parts]), 256)


# --- content hashes ----------------------------------------------------------


def _canonical_text(name: str, dtype: T.DataType) -> Column:
    c = F.col(name)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        finite = ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
        whole = F.when(F.abs(c) < 1e15, c == F.floor(c))
        text = F.when(finite & whole, c.cast("bigint").cast("string")).when(
            finite, c.cast("decimal(38,12)").cast("string")
        )
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        text = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    elif isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)):
        text = F.to_json(c)
    else:
        text = c.cast("string")
    body = F.concat(F.length(text).cast("string"), F.lit(":"), text)
    return F.concat(F.lit(name + "="), F.coalesce(body, F.lit("null")))


def content_hash(df: DataFrame, exclude: tuple[str, ...] = ("content_hash", "retrieved_at_utc")) -> Column:
    """SHA-256 over the row in a canonical text form.

    The form is ``name=<length>:<value>`` per column in name order, joined by
    a bar. Whole doubles print as integers, other doubles with 12 decimals,
    non-finite numbers and nulls as ``null``; ``exclude`` names the transient
    columns. The length prefix makes the text unambiguous.
    """
    fields = sorted((f.name, f.dataType) for f in df.schema.fields if f.name not in exclude)
    return F.sha2(F.concat_ws("|", *[_canonical_text(n, t) for n, t in fields]), 256)


def dataset_digest(hash_col: str | Column = "content_hash") -> Column:
    """Order-independent digest of a whole table, as one aggregate.

    Row hashes are split into eight 32-bit words that are summed exactly, so
    the digest combines map-side and never collects the rows anywhere.
    """
    h = col(hash_col)
    words = [
        F.sum(F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)")
        for i in range(8)
    ]
    parts = [F.count(h).cast("string")] + [F.coalesce(w, F.lit(0)).cast("string") for w in words]
    return F.sha2(F.concat_ws("|", *parts), 256)


# --- times -----------------------------------------------------------------


def civil_to_utc(day: str | Column, clock: str | Column, zone: str, default_clock: str = "00:00") -> Column:
    """Local calendar date and clock text in ``zone`` to a UTC timestamp."""
    text = F.concat_ws("T", col(day), F.coalesce(F.nullif(col(clock), F.lit("")), F.lit(default_clock)))
    return F.to_utc_timestamp(F.try_to_timestamp(text), zone)


def parse_utc(c: str | Column) -> Column:
    """ISO-8601 text with an explicit offset to a timestamp; naive text gives null."""
    text = col(c)
    return F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(text))


def local_week_start(ts: str | Column, zone: str) -> Column:
    """Date of the Tuesday that opens the local week of ``ts``."""
    day = F.to_date(F.from_utc_timestamp(col(ts).cast("timestamp"), zone))
    return F.date_sub(day, F.pmod(F.weekday(day) - F.lit(1), F.lit(7)))


def season_of(ts: str | Column) -> Column:
    return F.year(col(ts))


def minutes_between(later: str | Column, earlier: str | Column) -> Column:
    """Signed minutes with fractions, from whole microseconds."""
    gap = F.timestamp_diff("MICROSECOND", col(earlier), col(later))
    return gap / F.lit(60_000_000.0)


# --- numbers and flags -------------------------------------------------------


def clip(c: str | Column, low: float, high: float) -> Column:
    """Clamp, keeping nulls null (``least``/``greatest`` alone would skip them)."""
    x = col(c)
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def clip_probability(c: str | Column, eps: float = PROBABILITY_CLIP) -> Column:
    return clip(c, eps, 1.0 - eps)


def logit(c: str | Column, eps: float = PROBABILITY_CLIP) -> Column:
    p = clip_probability(c, eps)
    return F.ln(p / (F.lit(1.0) - p))


def logistic(c: str | Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(c)))


def conservative_probability(p: str | Column, margin: str | Column) -> Column:
    return clip(col(p) - col(margin), 0.0, 1.0)


def all_present(*cols: str | Column) -> Column:
    return reduce(lambda a, b: a & b, [col(c).isNotNull() for c in cols])


def equals_flag(c: str | Column, value: str) -> Column:
    return (F.lower(col(c).cast("string")) == value).cast("double")


def contains_flag(c: str | Column, fragment: str) -> Column:
    return F.contains(F.lower(col(c).cast("string")), F.lit(fragment)).cast("double")


def reasons(*pairs: tuple[Column, str]) -> Column:
    """All matching reason texts of a row, joined by ``;``."""
    return F.concat_ws(";", *[F.when(cond, F.lit(text)) for cond, text in pairs])


def first_reason(*pairs: tuple[Column, str], otherwise: str | None = None) -> Column:
    """The first matching code of an ordered ladder."""
    ladder = reduce(lambda acc, p: acc.when(p[0], F.lit(p[1])), pairs[1:], F.when(pairs[0][0], F.lit(pairs[0][1])))
    return ladder.otherwise(F.lit(otherwise))
