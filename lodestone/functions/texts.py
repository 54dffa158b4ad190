"""Column functions that read text: names, transforms, coordinates, style sheets, arguments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Characters that file names must not have, besides control characters.
UNSAFE = '<>:"/\\|?*'


def affix(c: Column) -> Column:
    """A part of a file name: characters that names must not have go, blanks become hyphens."""
    controls = "".join(map(chr, range(32)))
    return F.array_join(F.split(F.translate(c, UNSAFE + controls, ""), r"\s+"), "-")


def kind(file: Column, width: Column, height: Column) -> Column:
    wide = width / F.greatest(F.lit(1), height) >= 2
    return F.when(file.endswith("-icon.svg"), "symbol").when(wide, "wordmark").otherwise("symbol")


#: A transform is an array of six: the images of the x axis, the y axis and the origin.
SAME = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def _six(*values: Column | float) -> Column:
    return F.array(*[(v if isinstance(v, Column) else F.lit(float(v))).cast("double") for v in values])


def applied(m: Column, x: Column, y: Column) -> tuple[Column, Column]:
    at = lambda k: F.get(m, F.lit(k))
    return at(0) * x + at(2) * y + at(4), at(1) * x + at(3) * y + at(5)


def composed(outer: Column, inner: Column) -> Column:
    """The transform that applies ``inner`` first: the outer one moves the inner one's images."""
    at = lambda m, k: F.get(m, F.lit(k))
    moved = [[at(outer, row) * at(inner, k) + at(outer, row + 2) * at(inner, k + 1) for row in (0, 1)] for k in (0, 2, 4)]
    return F.array(*moved[0], *moved[1], moved[2][0] + at(outer, 4), moved[2][1] + at(outer, 5))


#: By name: how many numbers the SVG grammar allows, and the transforms that these stand for in turn.
KINDS = {
    "matrix": ((6,), lambda n: [_six(*n)]),
    "translate": ((1, 2), lambda n: [_six(1, 0, 0, 1, n[0], F.coalesce(n[1], F.lit(0.0)))]),
    "scale": ((1, 2), lambda n: [_six(n[0], 0, 0, F.coalesce(n[1], n[0]), 0, 0)]),
    "rotate": ((1, 3), lambda n: _turned_about(F.radians(n[0]), F.coalesce(n[1], F.lit(0.0)), F.coalesce(n[2], F.lit(0.0)))),
    "skewx": ((1,), lambda n: [_six(1, 0, F.tan(F.radians(n[0])), 1, 0, 0)]),
    "skewy": ((1,), lambda n: [_six(1, F.tan(F.radians(n[0])), 0, 1, 0, 0)]),
}
NUMBER = r"[+-]?(?:[0-9]*[.][0-9]+|[0-9]+[.]?)(?:[eE][+-]?[0-9]+)?"


def _turned_about(angle: Column, x: Column, y: Column) -> list[Column]:
    """To the centre, round, and back."""
    return [_six(1, 0, 0, 1, x, y), _six(F.cos(angle), F.sin(angle), -F.sin(angle), F.cos(angle), 0, 0), _six(1, 0, 0, 1, -x, -y)]


def transform(text: Column) -> Column:
    """A list of transforms as one array (a, b, c, d, e, f). A function that the grammar does not know,
    or with a number of arguments that it does not allow, changes nothing."""
    call = rf"([A-Za-z]+)\s*\(\s*((?:{NUMBER}(?:\s*,?\s*))*)\)"

    def steps(item: Column) -> Column:
        name = F.lower(F.regexp_extract(item, call, 1))
        found = F.transform(F.regexp_extract_all(F.regexp_extract(item, call, 2), F.lit(NUMBER), F.lit(0)), lambda x: x.cast("double"))
        numbers = [F.get(found, F.lit(k)) for k in range(6)]
        out = F.lit(None).cast("array<array<double>>")
        for kind, (counts, parts) in KINDS.items():
            out = F.when((name == kind) & F.size(found).isin(*counts), F.array(*parts(numbers))).otherwise(out)
        return F.coalesce(out, F.array(_six(*SAME)))

    items = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(call), F.lit(0)), steps))
    return F.aggregate(items, _six(*SAME), composed)


def rounded(text: Column, places: int) -> Column:
    """Numbers with a fraction rounded; where two numbers would touch, a blank goes between."""
    number = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
    tokens = F.regexp_extract_all(text, F.lit(f"({number})|([^0-9.+-]+|[+-])"), F.lit(0))
    is_number = lambda t: t.rlike(f"^{number}$")
    short = lambda t: F.regexp_replace(F.round(t.try_cast("double"), places).cast("string"), r"\.0$", "")
    shown = F.transform(tokens, lambda t: F.when(is_number(t) & t.rlike("[.eE]"), short(t)).otherwise(t))
    touch = lambda t, i: (i > 0) & is_number(t) & ~t.rlike("^[+-]") & is_number(F.get(shown, i - 1))
    return F.array_join(F.transform(shown, lambda t, i: F.when(F.coalesce(touch(t, i), F.lit(False)), F.concat(F.lit(" "), t)).otherwise(t)), "")


def rules(sheets: DataFrame, css: str) -> DataFrame:
    """(other columns, ord, selector, weight, name, value, important) of flat style sheets: comments
    and statements without a block go, and declarations without a name or a value. ``weight`` has the
    selector's counts of ids, classes and element names, which compare in this order."""
    plain = F.regexp_replace(F.regexp_replace(css, r"/\*[\s\S]*?\*/", ""), r"@[^{};]*;", "")
    blocks = F.regexp_extract_all(plain, F.lit(r"([^{}]+)\{([^{}]*)\}"), F.lit(0))
    keep = [c for c in sheets.columns if c != css]
    split = F.transform(blocks, lambda b: F.struct(F.trim(F.regexp_extract(b, r"^([^{]+)\{", 1)).alias("prelude"), F.regexp_extract(b, r"\{([^}]*)\}", 1).alias("body")))
    flat = F.flatten(F.transform(split, lambda b: F.transform(F.split(b["prelude"], ","), lambda s: F.struct(F.trim(F.regexp_replace(s, r"\s+", " ")).alias("selector"), b["body"].alias("body")))))
    r = sheets.select(*keep, F.posexplode(flat).alias("ord", "r")).select(*keep, "ord", "r.*")
    d = r.select(*keep, "ord", "selector", F.explode(F.split("body", ";")).alias("d"))
    value = F.trim(F.regexp_extract("d", r"(?s)^[^:]*:(.*)$", 1))
    d = d.select(*keep, "ord", "selector", F.lower(F.trim(F.regexp_extract("d", r"(?s)^([^:]*):", 1))).alias("name"), F.regexp_replace(value, r"(?i)\s*!\s*important$", "").alias("value"), value.rlike(r"(?i)!\s*important$").alias("important"))
    count = lambda pattern: F.size(F.regexp_extract_all("selector", F.lit(pattern), F.lit(0)))
    weight = F.struct(count("#[A-Za-z_]").alias("ids"), count(r"\.[A-Za-z_]").alias("classes"), count(r"(?:^|[ >+~])[A-Za-z]").alias("elements"))
    return d.where("name <> '' and value <> ''").withColumn("weight", weight)


def arguments(text: Column) -> Column:
    """Lines key=value as a map; only the first sign of equality parts them, and the last line of a key counts."""
    parts = F.filter(F.split(text, "\n"), lambda s: F.instr(s, "=") > 1)
    entry = lambda s: F.struct(F.substring_index(s, "=", 1).alias("key"), F.regexp_extract(s, r"^[^=]*=([\s\S]*)$", 1).alias("value"))
    pairs = F.transform(parts, entry)
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    last = lambda k: F.struct(k.alias("key"), F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"].alias("value"))
    return F.map_from_entries(F.transform(keys, last))


#: Beginnings of paths on a local machine.
LOCAL = r"^(?:/(?:home|Users|root|tmp)/|[A-Za-z]:\\|file://)"


def paths_in(rows: DataFrame, key: str, json: str, checkpoint, most_rounds: int = 1000) -> DataFrame:
    """(key, at) of local paths in JSON text. Objects, lists and texts are walked level by level until
    nothing nested is left, however deep; ``checkpoint`` writes each level, so none is read twice."""
    level = rows.select(key, F.lit("$").alias("at"), F.parse_json(json).alias("v"))
    found = None
    for _ in range(most_rounds):
        kind = F.schema_of_variant("v")
        text = F.when(kind == "STRING", F.variant_get("v", "$", "string"))
        nested = F.when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.to_json("v"))
        level = checkpoint(level.select(key, "at", text.alias("s"), nested.alias("nested")).where("s is not null or nested is not null"))
        here = level.where(F.col("s").rlike(LOCAL)).select(key, "at")
        found = here if found is None else found.unionByName(here)
        inner = level.where("nested is not null").select(key, "at", F.parse_json("nested").alias("v"))
        if inner.isEmpty():
            return found
        named = F.when(F.col("key").isNotNull(), F.concat("at", F.lit("."), F.col("key"))).otherwise(F.concat("at", F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        level = inner.lateralJoin(inner.sparkSession.tvf.variant_explode(F.col("v").outer())).select(key, named.alias("at"), F.col("value").alias("v"))
    raise RuntimeError(f"values are nested deeper than {most_rounds} levels")
