"""Text to typed value: inference, feature coercion, hyper-parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings the number format accepts for non-finite doubles.
NON_FINITE = ("NaN", "+NaN", "-NaN", "Infinity", "+Infinity", "-Infinity")


def to_number(text: Column) -> Column:
    """Feature value of a field; text, NaN and blanks are missing (null)."""
    return F.nanvl(F.trim(text).try_cast("double"), F.lit(None).cast("double"))


def _double_or_null(text: Column) -> Column:
    value = text.try_cast("double")
    finite = ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))
    return F.when(finite | text.isin(*NON_FINITE) | text.rlike("[0-9]"), value)


def infer_kind(text: Column) -> Column:
    """First of int, double, boolean, string that fits the trimmed text."""
    t = F.trim(text)
    return (
        F.when(F.coalesce(t, F.lit("")) == "", F.lit("null"))
        .when(t.try_cast("int").isNotNull(), F.lit("int"))
        .when(_double_or_null(t).isNotNull(), F.lit("double"))
        .when(F.lower(t).isin("true", "false"), F.lit("boolean"))
        .otherwise(F.lit("string"))
    )


def infer_value(text: Column) -> Column:
    """The inferred value as a VARIANT scalar."""
    t = F.trim(text)
    kind = infer_kind(text)
    return (
        F.when(kind == "int", t.try_cast("int").cast("variant"))
        .when(kind == "double", t.try_cast("double").cast("variant"))
        .when(kind == "boolean", (F.lower(t) == "true").cast("variant"))
        .when(kind == "string", t.cast("variant"))
    )


def typed_kind(text: Column) -> Column:
    """Feature kind for the typed encoder: numeric, date, time or categorical."""
    t = F.trim(text)
    return (
        F.when(F.coalesce(t, F.lit("")) == "", F.lit(None).cast("string"))
        .when(t.try_cast("double").isNotNull(), F.lit("numeric"))
        .when(date_number(t).isNotNull(), F.lit("date"))
        .when(time_number(t).isNotNull(), F.lit("time"))
        .otherwise(F.lit("categorical"))
    )


def date_number(text: Column) -> Column:
    """Epoch day of a ``dd/MM/yyyy`` text, else null."""
    shaped = F.when(text.rlike(r"^\d{2}/\d{2}/\d{4}$"), text)
    day = F.to_date(F.try_to_timestamp(shaped, F.lit("dd/MM/yyyy")))
    return F.datediff(day, F.lit("1970-01-01").cast("date")).cast("double")


def time_number(text: Column) -> Column:
    """Second of the day of an ``HH:mm:ss`` text, else null."""
    part = lambda i: F.regexp_extract(text, r"^([01]\d|2[0-3]):([0-5]\d):([0-5]\d)$", i).try_cast("int")
    return (part(1) * 3600 + part(2) * 60 + part(3)).cast("double")


def param(params: Column, names: str | tuple[str, ...], default: float) -> Column:
    """Numeric hyper-parameter; the first spelling present wins."""
    names = (names,) if isinstance(names, str) else names
    tried = [F.trim(F.try_element_at(params, F.lit(n))).try_cast("double") for n in names]
    return F.coalesce(*tried, F.lit(float(default)))


def param_int(params: Column, names: str | tuple[str, ...], default: int) -> Column:
    return param(params, names, default).cast("int")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient that is 0 for a zero denominator."""
    return F.coalesce(numerator / F.nullif(denominator.cast("double"), F.lit(0.0)), F.lit(0.0))
