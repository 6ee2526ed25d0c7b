"""Names, decisions and texts for people, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HIGH_FROM, MEDIUM_FROM = 75, 25  # of the screening
UI_HIGH_FROM, UI_MEDIUM_FROM = 70, 30  # of the console


def falsy(x: Column, default: Column) -> Column:
    """The default for null and for empty text."""
    return F.coalesce(F.nullif(x, F.lit("")), default)


def display_name(full: Column, name: Column, given: Column, surname: Column) -> Column:
    some = lambda x: F.nullif(x, F.lit(""))
    return F.coalesce(some(full), some(name), some(F.concat_ws(" ", some(given), some(surname))))


def decision_of_level(level: Column) -> Column:
    """LOW is clear, HIGH is high_risk, all else (null too) needs a review."""
    return F.when(level == "LOW", "clear").when(level == "HIGH", "high_risk").otherwise("review")


def decision_of_score(level: Column, score: Column) -> Column:
    return F.when(level == "LOW", "clear").when(score >= UI_HIGH_FROM, "high_risk").otherwise("review")


def level_of(score: Column) -> Column:
    return F.when(score >= HIGH_FROM, "HIGH").when(score >= MEDIUM_FROM, "MEDIUM").otherwise("LOW")


def ui_level_of(score: Column) -> Column:
    return F.when(score >= UI_HIGH_FROM, "HIGH").when(score >= UI_MEDIUM_FROM, "MEDIUM").when(score.isNotNull(), "LOW").otherwise("UNKNOWN")


def badge(value: Column, labels: dict[str, str], unknown: str = "Unknown") -> Column:
    """A label by value, or the one for unknown values and null."""
    table = F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))
    return F.coalesce(F.try_element_at(table, value), F.lit(unknown))


def backend_type(ui_type: Column) -> Column:
    return F.when(ui_type == "National ID", "AADHAAR").otherwise(F.upper(ui_type))


def percent(share: Column) -> Column:
    return F.format_string("%.1f%%", share * 100)


def short_hash(text: Column) -> Column:
    """The first six and the last four characters of a long text."""
    return F.when(F.length(text) <= 10, text).otherwise(F.concat(F.substring(text, 1, 6), F.lit("..."), F.substring(text, -4, 4)))


def day(ts: Column) -> Column:
    return F.date_format(ts, "dd MMM yyyy")


def box_text(box: Column) -> Column:
    """A box in shares of the image as whole percents, halves rounded up."""
    pct = lambda f: F.floor(box[f] * 100 + 0.5).cast("int")
    return F.when(box.isNull(), "Unavailable").otherwise(F.format_string("%d%%, %d%% | %d%% x %d%%", *map(pct, ("x", "y", "width", "height"))))
