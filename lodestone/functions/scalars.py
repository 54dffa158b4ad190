"""Scalar column functions: finite guard, text keys, colours and hashes. All stay inside Catalyst."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """A number, or null where it is missing, NaN or infinite."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def significant(c: Column, digits: int = 5) -> Column:
    """Rounded to significant digits; null where not finite."""
    return F.format_string(f"%.{digits - 1}e", finite(c)).cast("double")


def brand_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def corpus_of(c: Column) -> Column:
    """Text before the first slash, empty where there is none."""
    return F.when(F.instr(c, "/") > 0, F.substring_index(c, "/", 1)).otherwise(F.lit(""))


def slug(c: Column, limit: int = 48) -> Column:
    """Lower-case words joined by hyphens, cut at a word boundary; null when nothing is left.
    Accents of the Latin letters below are stripped."""
    plain = F.translate(F.lower(c), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    words = F.trim(F.regexp_replace(F.regexp_replace(plain, "&", " and "), "[^a-z0-9]+", " "))
    joined = F.replace(words, F.lit(" "), F.lit("-"))
    cut = F.regexp_extract(F.substring(joined, 1, limit + 1), f"^(.{{1,{limit}}})(?:-|$)", 1)
    whole = F.when(F.length(joined) <= limit, joined).when(cut != "", cut).otherwise(F.substring(joined, 1, limit))
    return F.when(joined == "", None).otherwise(whole)


def bucket_of(c: Column) -> Column:
    return F.when(c <= 1, "1").when(c <= 3, "2-3").when(c <= 8, "4-8").otherwise("9+")


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes of a string."""
    pairs = F.regexp_extract_all(F.hex(F.encode(c, "UTF-8")), F.lit("(..)"), F.lit(1))
    step = lambda h, b: (h.bitwiseXOR(F.conv(b, 16, 10).cast("long")) * F.lit(16777619)).bitwiseAND(F.lit(4294967295))
    return F.aggregate(pairs, F.lit(2166136261).cast("long"), step)


def channels_to_hex(r: Column, g: Column, b: Column) -> Column:
    clamp = lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.round(x).cast("int")))
    return F.lower(F.concat(F.lit("#"), *[F.lpad(F.hex(clamp(x)), 2, "0") for x in (r, g, b)]))


def hex_to_rgb(c: Column) -> list[Column]:
    return [F.conv(F.substring(c, i, 2), 16, 10).cast("int") for i in (2, 4, 6)]


def linear(c: Column) -> Column:
    """One sRGB channel, 0 to 255, as linear light."""
    x = c / 255.0
    return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.2126 * linear(r) + 0.7152 * linear(g) + 0.0722 * linear(b)


def contrast(a: Column, b: Column) -> Column:
    return (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)


#: Linear sRGB to XYZ under D65, scaled by the white point.
XYZ = ((0.4124564, 0.3575761, 0.1804375, 0.95047), (0.2126729, 0.7151522, 0.0721750, 1.0), (0.0193339, 0.1191920, 0.9503041, 1.08883))


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """CIELAB of sRGB channels from 0 to 255."""
    rgb = [linear(c) for c in (r, g, b)]

    def f(row: tuple[float, ...]) -> Column:
        t = reduce(Column.__add__, [w * c for w, c in zip(row[:3], rgb, strict=True)]) / row[3]
        return F.when(t > 216 / 24389, F.cbrt(t)).otherwise((24389 / 27 * t + 16) / 116)

    fx, fy, fz = map(f, XYZ)
    return 116 * fy - 16, 500 * (fx - fy), 200 * (fy - fz)


def distance(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    return F.sqrt(reduce(Column.__add__, [F.pow(x - y, F.lit(2)) for x, y in zip(a, b, strict=True)]))
