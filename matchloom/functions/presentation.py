"""How states and scores are shown, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels of categories, in the order in which they are shown.
CATEGORIES = {"required": "Required", "core": "Core", "responsibilities": "Duties", "preferred": "Preferred", "domain": "Domain", "bonus": "Bonus"}
#: Class and label of a band, by all its names.
BANDS = {"strong": ("score-high", "High"), "high": ("score-high", "High"), "moderate": ("score-moderate", "Moderate"), "medium": ("score-moderate", "Moderate"), "weak": ("score-low", "Low"), "low": ("score-low", "Low")}
SOURCES = {"cached": "Cached", "fetched": "Fetched", "computed": "Computed"}


def _cases(col: Column, known: dict[str, str], error: str) -> Column:
    out = F.raise_error(F.lit(error)).cast("string")
    for name, value in known.items():
        out = F.when(col == name, value).otherwise(out)
    return out


def duplicate_status(exists: Column, status: Column) -> tuple[Column, Column]:
    """(text, class) for a posting that was or wasn't applied for."""
    gone, rejected = ~F.coalesce(exists, F.lit(False)), status.eqNullSafe(F.lit("Rejected"))
    return F.when(gone, "Not applied yet").when(rejected, "Rejected").otherwise("Already applied"), F.when(gone, "clear").when(rejected, "rejected").otherwise("exists")


def number_text(value: Column) -> Column:
    """A number without a fraction where it has none."""
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))


def score_text(score: Column, band: Column, fit_label: Column) -> tuple[Column, Column]:
    """(text, class) of a score: by its fit label if it has one, else by its band; what isn't known is an error."""
    fit, named = F.lower(F.trim(F.coalesce(fit_label, F.lit("")))), F.lower(F.trim(F.coalesce(band, F.lit(""))))
    label = F.when(fit != "", _cases(fit, {"good fit": "Good Fit", "no fit": "No Fit"}, "no such fit label")).otherwise(_cases(named, {k: v[1] for k, v in BANDS.items()}, "no such band"))
    kind = F.when(fit != "", _cases(fit, {"good fit": "score-high", "no fit": "score-low"}, "no such fit label")).otherwise(_cases(named, {k: v[0] for k, v in BANDS.items()}, "no such band"))
    checked = F.when(score.between(0, 100) & ~F.isnan(score), score).otherwise(F.raise_error(F.lit("a score lies from 0 to 100")).cast("double"))
    return F.concat(number_text(checked), F.lit("/100 ("), label, F.lit(")")), kind


def source_label(source: Column) -> Column:
    return _cases(source, SOURCES, "no such source of a score")


def tenths(value: Column) -> Column:
    """Rounded to one decimal, halves upwards."""
    return F.floor(value * 10 + 0.5) / 10


def breakdown(categories: Column) -> Column:
    """Known categories of a map as an array of (label, value, class), in their fixed order; others are left out."""
    rows = []
    for name, label in CATEGORIES.items():
        value = F.try_element_at(categories, F.lit(name))
        r = tenths(value)
        kind = F.when(r >= 75, "score-high").when(r >= 55, "score-moderate").otherwise("score-low")
        rows.append(F.when(value.isNotNull() & ~F.isnan(value), F.struct(F.lit(label).alias("label"), r.alias("value"), kind.alias("class"))))
    return F.array_compact(F.array(*rows))


def decision(probability: Column, threshold: Column, fit_label: Column) -> Column:
    """A classifier's decision as an array of (label, value); empty without both numbers."""
    percent = lambda c: F.concat(number_text(tenths(100 * c)), F.lit("%"))
    rows = F.array(*(F.struct(F.lit(n).alias("label"), v.alias("value")) for n, v in (("Decision", fit_label), ("Good Fit probability", percent(probability)), ("Decision threshold", percent(threshold)))))
    known = probability.isNotNull() & threshold.isNotNull() & ~F.isnan(probability) & ~F.isnan(threshold)
    return F.when(known, rows).otherwise(F.slice(rows, F.lit(1), F.lit(0)))


def normal_url(value: Column) -> Column:
    """A trimmed http or https address; empty stays empty, anything else is an error."""
    bare = F.trim(F.coalesce(value, F.lit("")))
    known = F.lower(F.try_parse_url(bare, F.lit("PROTOCOL"))).isin("http", "https") & F.try_parse_url(bare, F.lit("HOST")).isNotNull()
    return F.when((bare == "") | F.coalesce(known, F.lit(False)), bare).otherwise(F.raise_error(F.lit("an address begins with http:// or https://")).cast("string"))


def is_on(value: Column, domain: str) -> Column:
    """Whether an address is empty or on a domain or below it."""
    host = F.lower(F.try_parse_url(value, F.lit("HOST")))
    return (F.coalesce(value, F.lit("")) == "") | F.coalesce((host == domain) | host.endswith(f".{domain}"), F.lit(False))
