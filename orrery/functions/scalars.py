"""Column functions on single records. All stay in built-in expressions."""

from __future__ import annotations

import string
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Speed of light in km/s and the WMAP9 Hubble constant in km/s/Mpc.
LIGHT_KM_S = 299792.458
HUBBLE_KM_S_MPC = 69.32

NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"

# ASCII punctuation.
PUNCTUATION_MARKS = string.punctuation


def first_present(*values: Column) -> Column:
    return F.coalesce(*values)


def fill_band_gaps(bands: Sequence[Column]) -> list[Column]:
    """Fill gaps left to right: a gap sees the neighbour already filled on its left and the raw one on its right."""
    last = len(bands) - 1
    filled: list[Column] = []
    for i, own in enumerate(bands):
        if i == 0:
            filled.append(F.coalesce(own, bands[1]))
        elif i == last:
            filled.append(F.coalesce(own, filled[-1]))
        else:
            left, right = filled[-1], bands[i + 1]
            filled.append(F.coalesce(own, (left + right) / 2.0, left, right))
    return filled


def redshift_velocity(z: Column) -> Column:
    """Relativistic velocity in km/s, two places, ties to even."""
    return F.bround(_velocity(z), 2)


def hubble_distance(z: Column) -> Column:
    """Distance in Mpc that belongs to the velocity, two places, ties to even."""
    return F.bround(_velocity(z) / HUBBLE_KM_S_MPC, 2)


def _velocity(z: Column) -> Column:
    ratio = (1 + z) * (1 + z)
    return F.lit(LIGHT_KM_S) * (ratio - 1) / (ratio + 1)


def sexagesimal_degrees(parts: Column, hours: bool = False) -> Column:
    """[units, minutes, seconds] as text to degrees. The sign is read from the text, so '-00' stays negative."""
    units, minutes, seconds = (F.trim(F.get(parts, F.lit(i))) for i in range(3))
    size = F.abs(units.cast("double")) + minutes.cast("double") / 60 + seconds.cast("double") / 3600
    signed = F.when(units.startswith("-"), -size).otherwise(size)
    return signed * 15 if hours else signed


def sexagesimal_parts(text: Column) -> Column:
    """'05h55m10.3s', '+07d24m25.4s', '05:55:10.3' or blanks between the parts -> array of three texts."""
    return F.split(F.trim(F.regexp_replace(text, r"[hdms:\s]+", " ")), " ")


def pad_sexagesimal(parts: Column) -> Column:
    """Two parts become three: decimal minutes move to the seconds place, whole minutes get '00' seconds."""
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    padded = F.when(second.contains("."), F.array(first, F.lit("00"), second)).otherwise(
        F.array(first, second, F.lit("00"))
    )
    return F.when(F.size(parts) == 2, padded).otherwise(parts)


def position_text(ra: Column, dec: Column) -> Column:
    """Degrees to 'hh:mm:ss.ss +dd:mm:ss.ss' from the record's own coordinates."""
    return F.concat_ws(" ", _clock(F.pmod(ra, F.lit(360.0)) / 15, signed=False), _clock(dec, signed=True))


def _clock(value: Column, signed: bool) -> Column:
    hundredths = F.round(F.abs(value) * 360000).cast("long")
    text = F.format_string(
        "%02d:%02d:%02d.%02d",
        F.floor(hundredths / 360000),
        F.floor(hundredths / 6000) % 60,
        F.floor(hundredths / 100) % 60,
        hundredths % 100,
    )
    return F.concat(F.when(value < 0, "-").otherwise("+"), text) if signed else text


def separation_arcsec(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Great-circle separation in the Vincenty form, stable at small and large angles."""
    d_ra = F.radians(ra2 - ra1)
    p1, p2 = F.radians(dec1), F.radians(dec2)
    across = F.cos(p2) * F.sin(d_ra)
    along = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d_ra)
    cosine = F.sin(p1) * F.sin(p2) + F.cos(p1) * F.cos(p2) * F.cos(d_ra)
    return F.degrees(F.atan2(F.sqrt(across * across + along * along), cosine)) * 3600


def flux_magnitude(flux: Column) -> Column:
    """22.5 - 2.5 log10(flux); no magnitude for zero or negative flux."""
    return F.when(flux > 0, 22.5 - 2.5 * F.log10(flux))


def line_flag(chi2: Column) -> Column:
    """0 when chi-square is at most one, else 1; a missing value counts as 1."""
    return F.when(chi2 <= 1.0, 0.0).otherwise(1.0)


def number_or_null(text: Column) -> Column:
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(NUMBER_PATTERN), trimmed.try_cast("double"))


def text_or_na(value: Column, binary: bool = False) -> Column:
    """Decode if binary, strip, and write NA for blank text."""
    text = F.trim(F.decode(value, "UTF-8") if binary else value)
    return F.when(text == "", "NA").otherwise(text)


def best_identifier(best: Column, fallback: Column) -> Column:
    """The best id when it holds text, else the other id; null when neither does."""
    return F.coalesce(F.nullif(F.trim(best), F.lit("")), F.nullif(F.trim(fallback), F.lit("")))


def collapse_blanks(text: Column) -> Column:
    trimmed = F.trim(text)
    return F.when(trimmed.contains("  "), F.regexp_replace(trimmed, " +", " ")).otherwise(trimmed)


def punctuation_to_blank(text: Column) -> Column:
    return collapse_blanks(F.translate(text, PUNCTUATION_MARKS, " " * len(PUNCTUATION_MARKS)))


def category_label(text: Column) -> Column:
    """Column-name form of a category value: punctuation dropped, words capitalised and joined."""
    return F.regexp_replace(F.initcap(F.translate(text, PUNCTUATION_MARKS, "")), r"\s+", "")


def set_value(column: Column, old: str, new: object) -> Column:
    """Replace one value; the comparison is on the text form."""
    return F.when(column.cast("string") == old, F.lit(new)).otherwise(column)


def replace_packed(packed: Column, old: str, new: str, sep: str = ";") -> Column:
    """Replace whole trimmed elements inside a separator-packed text."""
    parts = F.transform(F.split(packed, _literal(sep)), lambda x: F.trim(x))
    return F.array_join(F.transform(parts, lambda x: F.when(x == old, F.lit(new)).otherwise(x)), sep)


def replace_by_mapping(column: Column, mapping: Mapping[str, str], sep: str | None = ";") -> Column:
    """Apply the replacements one after the other in key order, so a later key sees an earlier result."""
    if sep is None:
        for old, new in mapping.items():
            column = F.when(column == old, F.lit(new)).otherwise(column)
        return column

    def one(element: Column) -> Column:
        for old, new in mapping.items():
            element = F.when(element == old, F.lit(new)).otherwise(element)
        return element

    parts = F.transform(F.split(column, _literal(sep)), lambda x: F.trim(x))
    return F.array_join(F.transform(parts, one), sep)


def _literal(sep: str) -> str:
    return r"\Q" + sep + r"\E"


def euclidean(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x - y).cast("double") * (x - y).cast("double"))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v))


def manhattan(a: Column, b: Column) -> Column:
    steps = F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double"))
    return F.aggregate(steps, F.lit(0.0), lambda s, v: s + v)


def drop_columns_containing(df: DataFrame, *fragments: str) -> DataFrame:
    """Keep the columns whose name contains none of the fragments."""
    return df.select([c for c in df.columns if not any(f in c for f in fragments)])


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def categorical_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema if not isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def split_numeric_categorical(
    df: DataFrame, target: str | None = None, id_col: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Two projections: numeric columns plus the target, and the categorical columns."""
    skip = [c for c in (target, id_col) if c]
    numeric = numeric_columns(df, skip) + ([target] if target else [])
    return df.select(numeric), df.select(categorical_columns(df, skip))


def drop_blank_ids(df: DataFrame, id_col: str) -> DataFrame:
    return df.filter(F.col(id_col) != "")


def skip_prefixed(df: DataFrame, id_col: str, prefix: str = "123") -> DataFrame:
    return df.filter(~F.col(id_col).startswith(prefix))


def record_changes(old: DataFrame, new: DataFrame, id_col: str, features: Sequence[str]) -> DataFrame:
    """(id, feature, old, new) for every feature of the records found on both sides."""
    both = old.select(id_col, *[F.col(c).cast("string").alias(f"o_{c}") for c in features]).join(
        new.select(id_col, *[F.col(c).cast("string").alias(f"n_{c}") for c in features]), id_col
    )
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), F.col(f"o_{c}").alias("old"), F.col(f"n_{c}").alias("new"))
            for c in features
        ]
    )
    return both.select(id_col, F.inline(rows))
