"""The cascade of style sheets as a join of selectors with elements."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: At-rules whose blocks hold no rules for elements.
OTHER = ("@font-face", "@keyframes", "@-webkit-keyframes", "@page", "@counter-style", "@property")
COMPOUND = r"^(\*|[A-Za-z][\w-]*)?((?:[.#][\w-]+)*)$"


def blocks(css: str) -> list[dict]:
    """(prelude, body, conditional) of the rules of a sheet in order; conditional are those inside
    other at-rules. Comments go; blocks that never close end with the text."""
    css = re.sub(r"/\*.*?\*/|<!\[CDATA\[|\]\]>", "", css or "", flags=re.S)
    out, inside, text = [], [], ""
    for piece in re.findall(r"[{}]|[^{}]+", css) + ["}"] * css.count("{"):
        if piece == "{":
            # what stands before the last semicolon is a statement, or the end of a rule without braces
            inside.append(text.rpartition(";")[2].strip() if text.lstrip().startswith("@") else text.strip().lstrip("; \n\t"))
            text = ""
        elif piece == "}":
            prelude = inside.pop() if inside else ""
            skipped = any(p.lower().startswith(OTHER) for p in [*inside, prelude])
            if prelude and not prelude.startswith("@") and not skipped:
                out.append({"prelude": prelude, "body": text, "conditional": any(p.startswith("@") for p in inside)})
            text = ""
        else:
            text = piece
    return out


BLOCKS = "array<struct<prelude:string,body:string,conditional:boolean>>"


def _each(css: pd.Series) -> pd.Series:
    """Sheets that come again in a batch are read once."""
    known = {text: blocks(text) for text in css.dropna().unique()}
    return css.map(lambda text: known.get(text, []))


def declarations(body: Column) -> Column:
    """(name, value, important) of a block's declarations; those without a name or a value go."""
    parts = F.transform(F.split(body, ";"), lambda d: F.named_struct(F.lit("name"), F.lower(F.trim(F.substring_index(d, ":", 1))), F.lit("value"), F.trim(F.regexp_extract(d, r"(?s)^[^:]*:(.*)$", 1))))
    mark = r"(?i)\s*!\s*important$"
    full = F.transform(parts, lambda p: F.named_struct(F.lit("name"), p["name"], F.lit("value"), F.regexp_replace(p["value"], mark, ""), F.lit("important"), p["value"].rlike(mark)))
    return F.filter(full, lambda p: (p["name"] != "") & (p["value"] != ""))


def selectors(sheets: DataFrame, doc: str, css: str) -> DataFrame:
    """(doc, ord, tag, ids, classes, loose, declarations): a row for each selector. A loose one is
    conditional or more than one compound of name, ids and classes; what is left of its last compound
    without further conditions is the least that an element must have."""
    of_sheet = F.pandas_udf(_each, BLOCKS)  # made on use: it needs a session
    r = sheets.select(doc, F.posexplode(of_sheet(css)).alias("block", "b")).select(doc, "block", "b.*")
    r = r.select(doc, "block", "conditional", F.posexplode(F.split("prelude", ",")).alias("pos", "selector"), declarations(F.col("body")).alias("declarations")).where("size(declarations) > 0")
    s = F.trim("selector")
    last = F.element_at(F.split(s, r"\s*[>+~]\s*|\s+"), -1)
    bare = F.regexp_replace(F.regexp_replace(last, r"::?[\w-]+(?:\([^)]*\))?", ""), r"\[[^\]]*\]", "")
    plain = s.rlike(COMPOUND) & (s != "")
    text = F.when(plain, s).when(bare.rlike(COMPOUND), bare).otherwise("*")
    names = lambda mark: F.transform(F.regexp_extract_all(text, F.lit(rf"\{mark}([\w-]+)"), F.lit(1)), lambda x: x)
    tag = F.lower(F.regexp_extract(text, COMPOUND, 1))
    return r.select(doc, F.struct("block", "pos").alias("ord"), F.when(~tag.isin("", "*"), tag).alias("tag"), names("#").alias("ids"), names(".").alias("classes"), (F.col("conditional") | ~plain).alias("loose"), "declarations")


def inlined(elements: DataFrame, rules: DataFrame, doc: str) -> DataFrame:
    """(doc, el, name, value, origin) of the declarations that win for each element, and a row of
    origin "unresolved" for an element that a loose selector may match: it keeps its markup.

    ``elements``: (doc, el, tag, id, classes, style); ``rules`` as ``selectors`` gives them. A selector
    meets the elements that have its first id, else class, else name. Important declarations win over
    the element's own style, which wins over others; then ids, classes and names count in this order,
    and the later one wins."""
    e = elements.select(doc, "el", F.lower("tag").alias("tag"), F.col("id"), F.coalesce("classes", F.array().cast("array<string>")).alias("classes"), "style")
    word = lambda mark, c: F.concat(F.lit(mark), c)
    keys = F.array_distinct(F.array_compact(F.concat(F.array(word("#", F.col("id")), word("<", F.col("tag")), F.lit("*")), F.transform("classes", lambda c: word(".", c)))))
    first = F.coalesce(word("#", F.get("ids", F.lit(0))), word(".", F.get("classes", F.lit(0))), word("<", F.col("tag")), F.lit("*"))
    r = rules.select(doc, first.alias("key"), *[F.col(c).alias(f"r_{c}") for c in ("ord", "tag", "ids", "classes", "loose", "declarations")])
    met = e.drop("style").withColumn("key", F.explode(keys)).join(r.hint("merge"), [doc, "key"])
    fits = (F.col("r_tag").isNull() | (F.col("r_tag") == F.col("tag"))) & F.forall("r_ids", lambda x: F.coalesce(x == F.col("id"), F.lit(False))) & (F.size(F.array_except("r_classes", "classes")) == 0)
    met = met.where(fits)
    weight = F.struct(F.size("r_ids").alias("ids"), F.size("r_classes").alias("classes"), F.col("r_tag").isNotNull().cast("int").alias("tag"), F.col("r_ord").alias("ord"))
    # a loose selector has one row without a declaration
    stated = F.posexplode_outer(F.when(~F.col("r_loose"), F.col("r_declarations")))
    taken = met.select(doc, "el", weight.alias("weight"), stated.alias("pos", "d"))
    rank = F.when(F.col("d.important"), 2).otherwise(0)
    given = taken.select(doc, "el", "d.name", F.struct(rank.alias("rank"), "weight", "pos", F.col("d.value").alias("value")).alias("w"))
    own = e.select(doc, "el", F.posexplode(declarations(F.col("style"))).alias("pos", "d"))
    none = F.struct(F.lit(0).alias("ids"), F.lit(0).alias("classes"), F.lit(0).alias("tag"), F.struct(F.lit(0).alias("block"), F.lit(0).alias("pos")).alias("ord"))
    mine = own.select(doc, "el", "d.name", F.struct(F.lit(1).alias("rank"), none.alias("weight"), "pos", F.col("d.value").alias("value")).alias("w"))
    won = given.unionByName(mine).groupBy(doc, "el", "name").agg(F.max("w").alias("w"))
    loose = F.bool_or(F.col("name").isNull())
    won = won.withColumn("loose", loose.over(Window.partitionBy(doc, "el"))).where("not loose or name is null")
    origin = F.element_at(F.array(F.lit("rule"), F.lit("own"), F.lit("important")), F.col("w.rank") + 1)
    shown = F.when(~F.col("loose"), F.col("w.value"))
    return won.select(doc, "el", "name", shown.alias("value"), F.when(F.col("loose"), "unresolved").otherwise(origin).alias("origin"))
