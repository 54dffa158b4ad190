"""Vector drawings as rows: one pass over a document's markup with the state that elements inherit, and
the whole grammar of path data. All geometry becomes cubic segments in the coordinates of the root."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Point = tuple[float, float]
#: What children take over from their parents, with the values at the root.
INHERITED = {"fill": "black", "stroke": "none", "stroke-width": "1", "fill-rule": "nonzero", "fill-opacity": "1", "stroke-opacity": "1", "color": "black", "visibility": "visible"}
#: Content of these is not painted where it stands.
UNPAINTED = {"defs", "symbol", "clipPath", "mask", "pattern", "marker", "linearGradient", "radialGradient", "filter", "style", "title", "desc", "metadata"}
NUMBER = re.compile(r"[+-]?(?:\d*\.\d+|\d+\.?)(?:[eE][+-]?\d+)?")
TRANSFORM = re.compile(r"(\w+)\s*\(([^)]*)\)")
IMPORTANT = re.compile(r"\s*!important\s*$")
FLAG, SKIP = re.compile(r"[01]"), re.compile(r"[\s,]*")
IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
#: Numbers that each path command takes.
TAKES = {"M": 2, "L": 2, "H": 1, "V": 1, "C": 6, "S": 4, "Q": 4, "T": 2, "A": 7, "Z": 0}


def numbers(text: str | None) -> list[float]:
    return [float(x) for x in NUMBER.findall(text or "")]


def length(text: str | None, otherwise: float = 0.0) -> float:
    found = NUMBER.match((text or "").strip())
    return float(found[0]) if found else otherwise


def matrix(text: str | None) -> tuple[float, ...]:
    """A list of transforms as (a, b, c, d, e, f)."""
    out = IDENTITY
    if not text:
        return out
    for name, body in TRANSFORM.findall(text):
        n, kind = numbers(body), name.lower()
        steps: list[tuple[float, ...]] = []
        if kind == "matrix" and len(n) == 6:
            steps = [tuple(n)]
        elif kind == "translate" and len(n) in (1, 2):
            steps = [(1, 0, 0, 1, n[0], n[1] if len(n) > 1 else 0)]
        elif kind == "scale" and len(n) in (1, 2):
            steps = [(n[0], 0, 0, n[-1], 0, 0)]
        elif kind == "rotate" and len(n) in (1, 3):
            x, y = n[1:] or (0, 0)
            c, s = math.cos(math.radians(n[0])), math.sin(math.radians(n[0]))
            steps = [(1, 0, 0, 1, x, y), (c, s, -s, c, 0, 0), (1, 0, 0, 1, -x, -y)]
        elif kind in ("skewx", "skewy") and len(n) == 1:
            t = math.tan(math.radians(n[0]))
            steps = [(1, 0, t, 1, 0, 0) if kind == "skewx" else (1, t, 0, 1, 0, 0)]
        for step in steps:
            out = times(out, step)
    return out


def times(m: tuple[float, ...], k: tuple[float, ...]) -> tuple[float, ...]:
    a, b, c, d, e, f = m
    return (*(a * k[0] + c * k[1], b * k[0] + d * k[1]), *(a * k[2] + c * k[3], b * k[2] + d * k[3]), a * k[4] + c * k[5] + e, b * k[4] + d * k[5] + f)


def quarters(p: Point, q: Point, rx: float, ry: float, turn: float, large: bool, sweep: bool) -> list[tuple[Point, ...]]:
    """An elliptic arc as cubic pieces of a quarter turn at most. On the circle that the ellipse becomes
    when it is turned back and its radii are taken out, the centre lies on the middle line of the two
    ends; radii too small for the way are made just large enough."""
    if p == q:
        return []
    if not rx or not ry:
        return [(p, p, q, q)]
    rx, ry, cos, sin = abs(rx), abs(ry), math.cos(math.radians(turn)), math.sin(math.radians(turn))
    flat = lambda z: ((cos * z[0] + sin * z[1]) / rx, (cos * z[1] - sin * z[0]) / ry)
    (ux, uy), (vx, vy) = flat(p), flat(q)
    half = math.hypot(vx - ux, vy - uy) / 2
    grow = max(1.0, half)
    ux, uy, vx, vy, half, rx, ry = ux / grow, uy / grow, vx / grow, vy / grow, half / grow, rx * grow, ry * grow
    # from the middle to the centre, to the left or right of the way
    off = math.sqrt(max(0.0, 1 - half * half)) * (1 if large != sweep else -1) / (2 * half)
    cx, cy = (ux + vx) / 2 - off * (vy - uy), (uy + vy) / 2 + off * (vx - ux)
    start, angle = math.atan2(uy - cy, ux - cx), math.atan2(vy - cy, vx - cx)
    span = (angle - start) % (2 * math.pi) if sweep else -((start - angle) % (2 * math.pi))
    n = max(1, math.ceil(abs(span) / (math.pi / 2) - 1e-9))
    step = span / n
    reach = 4 / 3 * math.tan(step / 4)
    back = lambda x, y: (cos * rx * x - sin * ry * y, sin * rx * x + cos * ry * y)
    out, here = [], p
    for k in range(n):
        a, b = start + k * step, start + (k + 1) * step
        there = q if k == n - 1 else back(cx + math.cos(b), cy + math.sin(b))
        one = back(cx + math.cos(a) - reach * math.sin(a), cy + math.sin(a) + reach * math.cos(a))
        two = back(cx + math.cos(b) + reach * math.sin(b), cy + math.sin(b) - reach * math.cos(b))
        out.append((here, one, two, there))
        here = there
    return out


def path_segments(d: str | None) -> list[tuple[int, str, tuple[Point, ...]]]:
    """(ring, kind, four points) of path data. A ring that closes gets its last line, of kind Z, even
    where that has no length. What follows an error is left out."""
    out: list[tuple[int, str, tuple[Point, ...]]] = []
    here: Point = (0.0, 0.0)
    start, ring, before, fresh = here, -1, None, True
    text, at = d or "", 0
    command = None
    while True:
        at = SKIP.match(text, at).end()
        if at >= len(text):
            return out
        if text[at].isalpha():
            command, at = text[at], at + 1
        elif command is None or command in "zZ":
            return out
        kind, values = command.upper(), []
        if kind not in TAKES or (ring < 0 and kind != "M"):
            return out
        for k in range(TAKES[kind]):
            at = SKIP.match(text, at).end()
            found = (FLAG if kind == "A" and k in (3, 4) else NUMBER).match(text, at)
            if not found:
                return out
            values.append(float(found[0]))
            at = found.end()
        base = here if command.islower() else (0.0, 0.0)
        pts = [(base[0] + values[i], base[1] + values[i + 1]) for i in range(0, len(values) - 1, 2)] if kind in "MLCSQT" else []
        if kind == "M":
            here = start = pts[0]
            ring, before, fresh = ring + 1, None, False
            command = "l" if command == "m" else "L"  # further pairs are lines
            continue
        if fresh and kind != "Z":  # drawing on after a close starts a new ring there
            ring, fresh = ring + 1, False
        if kind == "Z":
            out.append((ring, "Z", (here, here, start, start)))
            here, before, fresh = start, None, True
            continue
        mirror = (2 * here[0] - before[1][0], 2 * here[1] - before[1][1]) if before and before[0] == ("C" if kind == "S" else "Q") else here
        if kind in "HVL":
            to = pts[0] if kind == "L" else (base[0] + values[0], here[1]) if kind == "H" else (here[0], base[1] + values[0])
            pieces, before = [(here, here, to, to)], None
        elif kind in "CS":
            one, two, to = (mirror, *pts) if kind == "S" else pts
            pieces, before = [(here, one, two, to)], ("C", two)
        elif kind in "QT":
            mid, to = (mirror, pts[0]) if kind == "T" else pts
            lean = lambda a: (a[0] + 2 / 3 * (mid[0] - a[0]), a[1] + 2 / 3 * (mid[1] - a[1]))  # noqa: B023, E731
            pieces, before = [(here, lean(here), lean(to), to)], ("Q", mid)
        else:
            to = (base[0] + values[5], base[1] + values[6])
            pieces, before = quarters(here, to, *values[:3], bool(values[3]), bool(values[4])), None
        out += [(ring, "L" if kind in "HVL" else kind, p) for p in pieces]
        here = to


def shape_data(tag: str, get) -> str | None:
    """A basic shape as path data; None for what is no shape or has no extent."""
    n = lambda name, otherwise=0.0: length(get(name), otherwise)
    if tag == "path":
        return get("d")
    if tag == "rect" and n("width") > 0 and n("height") > 0:
        x, y, w, h = n("x"), n("y"), n("width"), n("height")
        rx, ry = n("rx", n("ry")), n("ry", n("rx"))
        rx, ry = min(rx, w / 2), min(ry, h / 2)
        if rx <= 0 or ry <= 0:
            return f"M{x} {y}h{w}v{h}h{-w}z"
        corner = lambda dx, dy: f"a{rx} {ry} 0 0 1 {dx} {dy}"
        return f"M{x + rx} {y}h{w - 2 * rx}{corner(rx, ry)}v{h - 2 * ry}{corner(-rx, ry)}h{2 * rx - w}{corner(-rx, -ry)}v{2 * ry - h}{corner(rx, -ry)}z"
    if tag in ("circle", "ellipse"):
        rx, ry = (n("r"), n("r")) if tag == "circle" else (n("rx"), n("ry"))
        x, y = n("cx"), n("cy")
        return f"M{x + rx} {y}A{rx} {ry} 0 0 1 {x - rx} {y}A{rx} {ry} 0 0 1 {x + rx} {y}z" if rx > 0 and ry > 0 else None
    if tag == "line":
        return f"M{n('x1')} {n('y1')}L{n('x2')} {n('y2')}"
    if tag in ("polyline", "polygon"):
        p = numbers(get("points"))
        pairs = [f"{x} {y}" for x, y in zip(p[::2], p[1::2], strict=False)]
        return "M" + "L".join(pairs) + ("z" if tag == "polygon" else "") if pairs else None
    return None


#: Path data up to this length is read once for all elements that repeat it, as far as a small cache holds it.
SHORT = 128
_short_path = lru_cache(4096)(path_segments)


def _painted(markup: str | None) -> list[tuple]:
    """The painted elements of a document in order: (tag, id, fill, stroke, width, even_odd, fill_opacity,
    stroke_opacity, segments), a segment being (ring, kind, eight coordinates)."""
    out: list[tuple] = []
    stack: list[tuple[dict, tuple[float, ...], float, bool]] = [(INHERITED, IDENTITY, 1.0, True)]

    def opened(name: str, attributes: dict) -> None:
        tag = name.rpartition(":")[2]
        state, m, opacity, shown = stack[-1]
        own = {k: v.strip() for k, v in attributes.items()}
        if "style" in own:
            own |= {k.strip().lower(): IMPORTANT.sub("", v.strip()) for k, _, v in (x.partition(":") for x in own["style"].split(";")) if v}
        new = {k: v for k, v in own.items() if k in INHERITED and v != "inherit"}
        state = state | new if new else state
        if "transform" in own:
            m = times(m, matrix(own["transform"]))
        opacity = opacity * length(own.get("opacity"), 1.0)
        shown = shown and tag not in UNPAINTED and own.get("display") != "none"
        stack.append((state, m, opacity, shown))
        data = shape_data(tag, own.get) if shown and state["visibility"] == "visible" else None
        if data:
            fill, stroke = (state["color"] if state[c].lower() == "currentcolor" else state[c] for c in ("fill", "stroke"))
            a, b, c, d, e, f = m
            scale = math.sqrt(abs(a * d - b * c))
            found = _short_path(data) if len(data) <= SHORT else path_segments(data)
            segments = [
                (ring, kind, (a * x0 + c * y0 + e, b * x0 + d * y0 + f, a * x1 + c * y1 + e, b * x1 + d * y1 + f, a * x2 + c * y2 + e, b * x2 + d * y2 + f, a * x3 + c * y3 + e, b * x3 + d * y3 + f))
                for ring, kind, ((x0, y0), (x1, y1), (x2, y2), (x3, y3)) in found
            ]
            fill_opacity, stroke_opacity = (opacity * length(state[c], 1.0) for c in ("fill-opacity", "stroke-opacity"))
            out.append((tag, own.get("id"), fill, stroke, length(state["stroke-width"], 1.0) * scale, state["fill-rule"] == "evenodd", fill_opacity, stroke_opacity, segments))

    def refused(*_) -> None:
        raise ValueError("documents that define entities are not read")

    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler, parser.EntityDeclHandler = opened, lambda _: stack.pop(), refused
    try:
        if markup and markup.strip():
            parser.Parse(markup.strip(), True)
    except (expat.ExpatError, ValueError):
        out.append(("broken", *[None] * 7, []))
    return out


FIELDS = {
    "tag": pa.string(), "id": pa.string(), "fill": pa.string(), "stroke": pa.string(), "width": pa.float64(), "even_odd": pa.bool_(),
    "fill_opacity": pa.float64(), "stroke_opacity": pa.float64(),
}


def items(markup: str | None) -> list[dict]:
    """The painted elements of a document in order, each with its segments; [] for no document, and
    one item of tag "broken" after what could be read of a document that is not well formed."""
    out = []
    for *values, segments in _painted(markup):
        own = {"tag": "broken"} if values[0] == "broken" and values[2] is None else dict(zip(FIELDS, values, strict=True))
        out.append(own | {"segments": [{"ring": r, "kind": k, "p": list(p)} for r, k, p in segments]})
    return out


ITEMS = "item int, tag string, id string, fill string, stroke string, width double, even_odd boolean, fill_opacity double, stroke_opacity double, segments array<struct<ring:int,kind:string,p:array<double>>>"
#: Segments and items that are handed on at once.
MOST = 16_384


def _batch(keys: pa.Array, name: str, rows: list[tuple]) -> pa.RecordBatch:
    """Rows (place of the key, item, painted element) as one batch."""
    at, number, found = zip(*rows, strict=True)
    *values, segments = zip(*found, strict=True)
    ends, flat = [0], []
    for s in segments:
        flat += s
        ends.append(len(flat))
    ring, kind, points = zip(*flat, strict=True) if flat else ((), (), ())
    coordinates = pa.array([v for p in points for v in p], pa.float64())
    p = pa.ListArray.from_arrays(pa.array(range(0, 8 * len(flat) + 1, 8), pa.int32()), coordinates)
    each = pa.StructArray.from_arrays([pa.array(ring, pa.int32()), pa.array(kind, pa.string()), p], ["ring", "kind", "p"])
    columns = {name: keys.take(pa.array(at, pa.int32())), "item": pa.array(number, pa.int32())}
    columns |= {n: pa.array(v, t) for (n, t), v in zip(FIELDS.items(), values, strict=True)}
    columns["segments"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)
    return pa.RecordBatch.from_pydict(columns)


def _items_of(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items of batches of (key, markup), handed on as soon as ``MOST`` segments or items wait, so that no
    more than these and one document are held, however many documents a batch has."""
    for batch in it:
        rows, waiting = [], 0
        for at, markup in enumerate(batch.column(1)):
            for number, found in enumerate(_painted(markup.as_py())):
                rows.append((at, number, found))
                waiting += 1 + len(found[-1])
            if waiting >= MOST:
                yield _batch(batch.column(0), batch.schema.names[0], rows)
                rows, waiting = [], 0
        if rows:
            yield _batch(batch.column(0), batch.schema.names[0], rows)


def drawn_items(docs: DataFrame, key: str, markup: str) -> DataFrame:
    """(key, item, tag, id, fill, stroke, width, even_odd, fill_opacity, stroke_opacity, segments) of the
    painted elements of drawings; documents are read where they lie, none is shuffled. Paths, basic
    shapes, groups, presentation attributes and inline styles count; references, text and images do
    not, nor do style sheets (``operators.cascade`` settles these)."""
    rows = docs.select(key, markup)
    return rows.mapInArrow(_items_of, f"`{key}` {rows.schema[key].dataType.simpleString()}, {ITEMS}")


def segment_rows(drawn: DataFrame, key: str) -> DataFrame:
    """(key, item, ring, seg, kind, x0, y0, ..., x3, y3): a row for each cubic segment."""
    s = drawn.select(key, "item", F.posexplode("segments").alias("seg", "s"))
    return s.select(key, "item", "s.ring", "seg", "s.kind", *[F.get("s.p", F.lit(2 * k + c)).alias(f"{n}{k}") for k in range(4) for c, n in enumerate("xy")])
