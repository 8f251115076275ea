"""Names, codes and parameters as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_instrument(c: Column) -> Column:
    """Upper case without spaces, "/" and "-" to "_"; six letters in a row are two currencies."""
    name = F.replace(F.regexp_replace(F.upper(F.trim(c)), "[/-]", "_"), F.lit(" "), F.lit(""))
    return F.when(name.rlike("^[A-Z]{6}$"), F.concat(F.substring(name, 1, 3), F.lit("_"), F.substring(name, 4, 3))).otherwise(name)


def path_safe(c: Column) -> Column:
    return F.replace(c, F.lit("/"), F.lit("_"))


def short_id(c: Column, length: int = 8) -> Column:
    return F.when(F.char_length(c) > length, F.concat(F.substring(c, 1, length), F.lit("…"))).otherwise(c)


def model_kind(c: Column, other: str | None = None) -> Column:
    """The part after "side_" and before the next "_"; of other ids `other`, or the id itself."""
    return F.when(c.startswith("side_") & (F.split_part(c, F.lit("_"), F.lit(2)) != ""), F.split_part(c, F.lit("_"), F.lit(2))).otherwise(c if other is None else F.lit(other))


def labelled(c: Column, labels: dict[str, str]) -> Column:
    """A code's label, or the code itself."""
    return F.coalesce(F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))[c], c)


def parts(c: Column, by: str = ";") -> Column:
    """A joined list cut at `by`, trimmed, without empty parts."""
    return F.filter(F.transform(F.split(c, by), lambda x: F.trim(x)), lambda x: x != "")


def snippet(values: dict[str, Column]) -> Column:
    """name=value pairs in the given order; whole numbers have no decimals, nor have values of 100 or more; those of 10 or more have one, others two; nulls are left out."""
    shown = lambda v: F.when((v == F.floor(v)) | (F.abs(v) >= 100), F.format_string("%.0f", v)).when(F.abs(v) >= 10, F.format_string("%.1f", v)).otherwise(F.format_string("%.2f", v))
    return F.concat_ws(" ", *(F.when(v.isNotNull(), F.concat(F.lit(f"{k}="), shown(v))) for k, v in values.items()))


def signed_confidence(direction: Column, confidence: Column) -> Column:
    return F.when(direction == "long", confidence).when(direction == "short", -confidence).otherwise(0.0)


def risk_block(spread_bp: Column, age_ms: Column, day_pnl: Column, day_peak: Column, most_spread: float, most_age_ms: int, loss_limit: float, pause: float) -> Column:
    """The first rule that stops trading, or null (P20)."""
    return F.when(spread_bp > most_spread, "spread").when(age_ms > most_age_ms, "stale").when(day_pnl <= -loss_limit, "daily_loss").when(day_peak - day_pnl >= pause, "drawdown")


def entry_side(p_long: Column, p_short: Column, take: float, margin: float, long: float, short: float) -> Column:
    """1, -1, or 0 where the larger probability, its lead or its side's own threshold is too small."""
    able = (F.greatest(p_long, p_short) >= take) & (F.abs(p_long - p_short) >= margin)
    return F.when(able & (p_long > p_short) & (p_long >= long), 1).when(able & (p_short > p_long) & (p_short >= short), -1).otherwise(0)


def json_number(value: Column, digits: int) -> Column:
    """
    A double of at most `digits` decimal places as JSON text without an exponent up to 1e21; to_json turns to exponents below 0.001 and
    from 10 million on. Null is null; NaN and infinities, which JSON has no numbers for, stay words.
    """
    plain = F.regexp_replace(value.cast(f"decimal(38,{digits})").cast("string"), r"(\.\d+?)0+$", "$1")
    exponent = F.replace(F.replace(value.cast("string"), F.lit(".0E"), F.lit("e")), F.lit("E"), F.lit("e"))
    small = (F.abs(value) >= 0.001) & (F.abs(value) < 10_000_000) | (value == 0)
    return F.when(value.isNull(), "null").when(small | F.isnan(value), value.cast("string")).when(F.abs(value) < 1e21, plain).otherwise(exponent)
