"""Colour column functions: Oklab, luma, colour text, and gradients along a line or from a focus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import linear

#: Linear sRGB to cone responses, and their cube roots to Oklab.
CONES = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
OKLAB = ((0.2104542553, 0.793617785, -0.0040720468), (1.9779984951, -2.428592205, 0.4505937099), (0.0259040371, 0.7827717662, -0.808675766))


def _dot(weights: tuple[float, ...], columns: list[Column]) -> Column:
    return reduce(Column.__add__, [w * c for w, c in zip(weights, columns, strict=True)])


def oklab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Oklab of sRGB channels from 0 to 255: white is (1, 0, 0), black (0, 0, 0)."""
    light = [linear(c) for c in (r, g, b)]
    roots = [F.cbrt(_dot(row, light)) for row in CONES]
    return tuple(_dot(row, roots) for row in OKLAB)


def luma709(r: Column, g: Column, b: Column) -> Column:
    return _dot((0.2126, 0.7152, 0.0722), [r, g, b])


def l1(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    return reduce(Column.__add__, [F.abs(x - y) for x, y in zip(a, b, strict=True)])


#: The colour names of the CSS standard and their channels.
NAMES = dict(
    pair.split()
    for pair in """
    aliceblue f0f8ff,antiquewhite faebd7,aqua 00ffff,aquamarine 7fffd4,azure f0ffff,beige f5f5dc,bisque ffe4c4,black 000000,
    blanchedalmond ffebcd,blue 0000ff,blueviolet 8a2be2,brown a52a2a,burlywood deb887,cadetblue 5f9ea0,chartreuse 7fff00,
    chocolate d2691e,coral ff7f50,cornflowerblue 6495ed,cornsilk fff8dc,crimson dc143c,cyan 00ffff,darkblue 00008b,
    darkcyan 008b8b,darkgoldenrod b8860b,darkgray a9a9a9,darkgreen 006400,darkgrey a9a9a9,darkkhaki bdb76b,
    darkmagenta 8b008b,darkolivegreen 556b2f,darkorange ff8c00,darkorchid 9932cc,darkred 8b0000,darksalmon e9967a,
    darkseagreen 8fbc8f,darkslateblue 483d8b,darkslategray 2f4f4f,darkslategrey 2f4f4f,darkturquoise 00ced1,
    darkviolet 9400d3,deeppink ff1493,deepskyblue 00bfff,dimgray 696969,dimgrey 696969,dodgerblue 1e90ff,
    firebrick b22222,floralwhite fffaf0,forestgreen 228b22,fuchsia ff00ff,gainsboro dcdcdc,ghostwhite f8f8ff,gold ffd700,
    goldenrod daa520,gray 808080,green 008000,greenyellow adff2f,grey 808080,honeydew f0fff0,hotpink ff69b4,
    indianred cd5c5c,indigo 4b0082,ivory fffff0,khaki f0e68c,lavender e6e6fa,lavenderblush fff0f5,lawngreen 7cfc00,
    lemonchiffon fffacd,lightblue add8e6,lightcoral f08080,lightcyan e0ffff,lightgoldenrodyellow fafad2,lightgray d3d3d3,
    lightgreen 90ee90,lightgrey d3d3d3,lightpink ffb6c1,lightsalmon ffa07a,lightseagreen 20b2aa,lightskyblue 87cefa,
    lightslategray 778899,lightslategrey 778899,lightsteelblue b0c4de,lightyellow ffffe0,lime 00ff00,limegreen 32cd32,
    linen faf0e6,magenta ff00ff,maroon 800000,mediumaquamarine 66cdaa,mediumblue 0000cd,mediumorchid ba55d3,
    mediumpurple 9370db,mediumseagreen 3cb371,mediumslateblue 7b68ee,mediumspringgreen 00fa9a,mediumturquoise 48d1cc,
    mediumvioletred c71585,midnightblue 191970,mintcream f5fffa,mistyrose ffe4e1,moccasin ffe4b5,navajowhite ffdead,
    navy 000080,oldlace fdf5e6,olive 808000,olivedrab 6b8e23,orange ffa500,orangered ff4500,orchid da70d6,
    palegoldenrod eee8aa,palegreen 98fb98,paleturquoise afeeee,palevioletred db7093,papayawhip ffefd5,peachpuff ffdab9,
    peru cd853f,pink ffc0cb,plum dda0dd,powderblue b0e0e6,purple 800080,rebeccapurple 663399,red ff0000,rosybrown bc8f8f,
    royalblue 4169e1,saddlebrown 8b4513,salmon fa8072,sandybrown f4a460,seagreen 2e8b57,seashell fff5ee,sienna a0522d,
    silver c0c0c0,skyblue 87ceeb,slateblue 6a5acd,slategray 708090,slategrey 708090,snow fffafa,springgreen 00ff7f,
    steelblue 4682b4,tan d2b48c,teal 008080,thistle d8bfd8,tomato ff6347,turquoise 40e0d0,violet ee82ee,wheat f5deb3,
    white ffffff,whitesmoke f5f5f5,yellow ffff00,yellowgreen 9acd32
    """.split(",")
)

#: A number with its unit, or "none"; and what a colour function looks like with a mark for each of these.
QUANTITY = r"([+-]?(?:[0-9]*[.])?[0-9]+(?:e[+-]?[0-9]+)?)(%|deg|grad|rad|turn)?|none"
WITH_COMMAS, WITH_BLANKS = r"(rgb|hsl)a?\( *@( *, *@){2,3} *\)", r"(rgb|hsl)a?\( *@( +@){2}( */ *@)? *\)"


def _clamped(c: Column, high: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(float(high)), c))


def _let(value: Column, use) -> Column:
    """``use(value)``, with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _rgba(*channels: Column) -> Column:
    return F.struct(*[c.cast("double").alias(n) for n, c in zip("rgba", channels, strict=True)])


def _of_digits(digits: Column) -> Column:
    """Channels of 3, 4, 6 or 8 hexadecimal digits; a single digit stands for two of it."""
    each = F.when(F.length(digits) <= 4, 1).otherwise(2)
    values = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.conv(F.substring(digits, k * each + 1, each), 16, 10).cast("double") * F.when(each == 1, 17.0).otherwise(1.0))
    at = lambda v, k: F.get(v, F.lit(k))
    return F.when(F.length(digits).isin(3, 4, 6, 8), _let(values, lambda v: _rgba(at(v, 0), at(v, 1), at(v, 2), F.coalesce(at(v, 3), F.lit(255.0)) / 255)))


def _of_hue(hue: Column, saturation: Column, lightness: Column) -> list[Column]:
    """Red, green and blue of a hue in degrees: the colour wheel's six sectors, in each of which one
    channel is full, one rises or falls, and one is empty."""
    full = (1 - F.abs(2 * lightness - 1)) * saturation
    turn = F.pmod(hue, F.lit(360.0)) / 60
    part = full * (1 - F.abs(F.pmod(turn, F.lit(2.0)) - 1))
    sector = F.floor(turn).cast("int")
    wheel = F.array(full, part, F.lit(0.0), F.lit(0.0), part, full)
    return [255 * (lightness - full / 2 + F.get(wheel, (sector + shift) % 6)) for shift in (0, 4, 2)]


def _of_function(text: Column) -> Column:
    """rgb() and hsl() with commas or with blanks: the quantities are taken out, and what is left must
    have one of the two shapes."""
    found = F.regexp_extract_all(text, F.lit(QUANTITY), F.lit(0))
    amounts = F.transform(found, lambda q: F.struct(F.coalesce(F.regexp_extract(q, QUANTITY, 1).try_cast("double"), F.lit(0.0)).alias("n"), F.regexp_extract(q, QUANTITY, 2).alias("unit")))

    def channels(q: Column) -> Column:
        amount, unit = (lambda k: F.get(q, F.lit(k))["n"]), (lambda k: F.get(q, F.lit(k))["unit"])
        share = lambda k, whole: F.when(unit(k) == "%", amount(k) * whole / 100).otherwise(amount(k))
        degrees = F.create_map(*[x for u, d in (("", 1.0), ("deg", 1.0), ("grad", 0.9), ("turn", 360.0)) for x in (F.lit(u), F.lit(d))])
        hue = F.when(unit(0) == "rad", F.degrees(amount(0))).otherwise(amount(0) * F.try_element_at(degrees, unit(0)))
        parts = F.struct(hue.alias("h"), (_clamped(amount(1), 100) / 100).alias("s"), (_clamped(amount(2), 100) / 100).alias("l"))
        alpha = F.when(F.size(q) > 3, _clamped(share(3, 1), 1)).otherwise(1.0)
        hsl = _let(parts, lambda p: _rgba(*_of_hue(p["h"], p["s"], p["l"]), alpha))
        rgb = _rgba(*[_clamped(share(k, 255), 255) for k in range(3)], alpha)
        return F.when(text.startswith("rgb"), rgb).when(hue.isNotNull(), hsl)

    shape = F.regexp_replace(text, QUANTITY, "@")
    return F.when(shape.rlike(f"^(?:{WITH_COMMAS}|{WITH_BLANKS})$"), _let(amounts, channels))


def css_color(text: Column, names: dict[str, str] = NAMES) -> Column:  # noqa: B006
    """A CSS colour as a struct (r, g, b from 0 to 255, a from 0 to 1): hexadecimal digits, rgb and
    hsl in both list forms, names; null for anything else."""
    t = F.lower(F.trim(text))
    table = F.create_map(*[F.lit(x) for name, digits in {**names, "transparent": "00000000"}.items() for x in (name, digits)])
    digits = F.coalesce(F.try_element_at(table, t), F.nullif(F.regexp_extract(t, "^#([0-9a-f]+)$", 1), F.lit("")))
    return F.coalesce(_let(digits, _of_digits), _of_function(t))


def paint(text: Column, names: dict[str, str] = NAMES) -> Column:  # noqa: B006
    """A paint in one form: #rrggbb for a colour, whatever its opacity, url(#id) for a reference, null
    for no paint; words that are none of these stay. The text's own colour is black."""
    t = F.lower(F.trim(F.split(text, "!")[0]))
    two = lambda level: F.lower(F.lpad(F.hex(F.floor(level + 0.5).cast("int")), 2, "0"))
    shown = _let(css_color(F.when(t == "currentcolor", "black").otherwise(t), names), lambda c: F.concat(F.lit("#"), *[two(c[n]) for n in "rgb"]))
    target = F.regexp_extract(t, r"^url\( *[\"']?#([^\"' )]+)[\"']? *\)", 1)
    return F.when(~t.isin("", "none", "transparent"), F.when(target != "", F.concat(F.lit("url(#"), target, F.lit(")"))).otherwise(F.coalesce(shown, t)))


def linear_place(x1: Column, y1: Column, x2: Column, y2: Column, x: Column, y: Column) -> Column:
    """Where a point lies between the two ends of a linear gradient, from 0 to 1."""
    dx, dy = x2 - x1, y2 - y1
    length = dx * dx + dy * dy
    return _clamped(((x - x1) * dx + (y - y1) * dy) / F.when(length == 0, 1.0).otherwise(length), 1)


def radial_place(cx: Column, cy: Column, r: Column, fx: Column, fy: Column, x: Column, y: Column) -> Column:
    """Where a point lies between the focus and the circle of a radial gradient, from 0 to 1.

    With p the way from the focus to the point and e that to the centre, the circle at t has its
    centre at t e and the radius t r, so the point is on it where (r r - e e) t t + 2 (p e) t = p p.
    Solved for 1 / t there is no division by a coefficient that may be zero. The outermost circle
    counts; a point on none lies at 1."""
    px, py, ex, ey = x - fx, y - fy, cx - fx, cy - fy
    inner, along, far = r * r - (ex * ex + ey * ey), px * ex + py * ey, px * px + py * py
    under = along * along + inner * far
    slope = along + F.when(inner < 0, -1.0).otherwise(1.0) * F.sqrt(F.greatest(under, F.lit(0.0)))
    return F.when(far == 0, 0.0).when((under < 0) | (slope <= 0), 1.0).otherwise(_clamped(far / F.nullif(slope, F.lit(0.0)), 1))


def between_stops(stops: list[tuple[float, float]], t: Column) -> Column:
    """The value at ``t`` on the polyline of (place, value), flat before the first and after the last."""
    out = F.when(t <= stops[0][0], F.lit(float(stops[0][1])))
    for (a, u), (b, v) in zip(stops[:-1], stops[1:], strict=True):
        out = out.when(t <= b, u + (t - a) * ((v - u) / (b - a)))
    return out.otherwise(F.lit(float(stops[-1][1])))


def solved(a: Column, b: Column, c: Column, u: Column, v: Column) -> Column:
    """x, y of a x + b y = u, b x + c y = v; null where the system is singular."""
    det = a * c - b * b
    return F.when(F.abs(det) >= 1e-9, F.struct(((c * u - b * v) / det).alias("x"), ((a * v - b * u) / det).alias("y")))


def main_axis(a: Column, b: Column, c: Column) -> Column:
    """The unit vector along which ((a, b), (b, c)) is largest."""
    size = (a + c) / 2 + F.sqrt(F.pow((a - c) / 2, F.lit(2)) + b * b)
    length = F.sqrt(b * b + F.pow(size - a, F.lit(2)))
    even = F.struct(F.when(a >= c, 1.0).otherwise(0.0).alias("x"), F.when(a >= c, 0.0).otherwise(1.0).alias("y"))
    return F.when(F.abs(b) < 1e-12, even).otherwise(F.struct((b / length).alias("x"), ((size - a) / length).alias("y")))
