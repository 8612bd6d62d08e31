"""Label normalisation and class mappings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Event codes of each broad class, as used for sampling.
SAMPLING_CLASSES = {
    "bckg": "background",
    "fnsz": "focal", "cpsz": "focal", "spsz": "focal",
    "gnsz": "generalized", "tcsz": "generalized", "tnsz": "generalized", "absz": "generalized", "mysz": "generalized",
}
# The audit counts one more code as generalized.
AUDIT_CLASSES = SAMPLING_CLASSES | {"combined": "generalized"}

BACKGROUND = "bckg"


def literal_map(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def normalise_label(label: Column) -> Column:
    return F.lower(F.trim(label))


def map_class(code: Column, mapping: dict, unmapped: str = "drop") -> Column:
    """The code's class; an unknown code is null, or stays as it is with unmapped="keep"."""
    mapped = F.try_element_at(literal_map(mapping), code)
    return F.coalesce(mapped, code) if unmapped == "keep" else mapped


def map_classes(df: DataFrame, mapping: dict, column: str = "label", target: str = "macro_class") -> DataFrame:
    """Rows of known classes only, with the class as ``target``."""
    return df.withColumn(target, map_class(normalise_label(F.col(column)), mapping)).na.drop(subset=[target])


def display_label(code: Column, names: dict[str, str]) -> Column:
    """The code's display name, or else the code with its first letter in upper and the rest in lower case."""
    return F.coalesce(F.try_element_at(literal_map(names), F.lower(code)), F.concat(F.upper(F.left(code, F.lit(1))), F.lower(F.substring(code, 2, 1 << 20))))


def hover_label(code: Column, names: dict[str, str]) -> Column:
    return F.format_string("%s (%s)", display_label(code, names), F.upper(code))


def not_background(label: Column, background: str = BACKGROUND) -> Column:
    return normalise_label(label) != background


def clean_number(value: Column) -> Column:
    """NaN as null, so that aggregates pass over it."""
    return F.when(F.isnan(value), None).otherwise(value)


def sanitised(value: Column) -> Column:
    """Null, NaN and infinite as 0."""
    v = value.cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v)
