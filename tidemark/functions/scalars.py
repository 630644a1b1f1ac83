"""Scalar functions, all as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels of exit kinds; several kinds may share one.
EXIT_LABELS = {"A": "accepted", "N": "none", "R": "returned"}


def slug(text: Column) -> Column:
    """Lower case; everything but letters and digits as single underscores, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def task_id(*parts: Column) -> Column:
    return F.concat_ws("__", *map(slug, parts))


def normalize_symbol(symbol: Column) -> Column:
    """Upper case, ending in USDT."""
    s = F.upper(F.trim(symbol))
    return F.when(s.endswith("USDT"), s).otherwise(F.concat(s, F.lit("USDT")))


def epoch(value: Column) -> Column:
    """A time from an epoch in milliseconds or, from 10^14 on, microseconds."""
    return F.when(value >= 10**14, F.timestamp_micros(value)).otherwise(F.timestamp_millis(value))


def align_floor(ms: Column, period: int) -> Column:
    return ms - F.pmod(ms, F.lit(period))


def align_ceil(ms: Column, period: int) -> Column:
    return F.when(F.pmod(ms, F.lit(period)) == 0, ms).otherwise(align_floor(ms, period) + period)


def clamp01(value: Column) -> Column:
    """Within 0..1; what is no number is 0."""
    x = value.try_cast("double")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.when(~F.isnan(x), x), F.lit(0.0))))


def exit_label(kind: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in EXIT_LABELS.items() for x in kv))
    return F.when(F.coalesce(F.trim(kind), F.lit("")) == "", "-").otherwise(F.coalesce(table[kind], kind))


def month_list(start: Column, end: Column) -> Column:
    """First days of all months from start to end."""
    return F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("interval 1 month"))


def json_field(text: Column, field: str) -> Column:
    """A field of the payload `data`, or of the root."""
    return F.coalesce(F.get_json_object(text, f"$.data.{field}"), F.get_json_object(text, f"$.{field}"))


def percent(change: Column) -> Column:
    return F.format_string("%+.2f%%", 100 * change)


def quantile_key(quantiles: Column, key: str) -> Column:
    return F.try_element_at(quantiles, F.lit(key))
