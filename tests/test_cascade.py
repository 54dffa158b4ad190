"""The cascade: blocks of sheets, and winners against a loop over elements and rules."""

from __future__ import annotations

import random

from lodestone.operators import cascade as Y


def test_blocks_of_a_sheet():
    css = "@import 'x'; a{b:c} /* q{r:s} */ @media m{ d , e{f:g} @supports s{h{i:j}} } @keyframes k{from{a:b} to{c:d}} l{m:n"
    assert [(b["prelude"], b["body"].strip(), b["conditional"]) for b in Y.blocks(css)] == [("a", "b:c", False), ("d , e", "f:g", True), ("h", "i:j", True), ("l", "m:n", False)]
    assert Y.blocks("") == Y.blocks(None) == Y.blocks("a;b") == []


def test_cascade_equals_a_loop(spark):
    r = random.Random(4)
    tags, names, ids, props = ["rect", "g", "path"], ["a", "b", "c"], ["x", "y"], ["fill", "stroke", "width"]
    docs, expected = [], set()
    elements = []
    for doc in range(30):
        rules, css = [], ""
        for order in range(r.randint(0, 12)):
            tag, i, classes = r.choice([None, None, *tags]), r.choice([None, None, *ids]), r.sample(names, r.choice([0, 1, 1, 2]))
            text = (tag or "") + (f"#{i}" if i else "") + "".join(f".{c}" for c in classes) or "*"
            loose = r.random() < 0.1
            decls = [(r.choice(props), f"v{doc}-{order}-{k}", r.random() < 0.2) for k in range(r.randint(1, 3))]
            body = ";".join(f"{n}:{v}{' !important' if m else ''}" for n, v, m in decls)
            css += (f"@media m{{{text}{{{body}}}}}" if r.random() < 0.5 else f"g {text}{{{body}}}") if loose else f"{text}{{{body}}}"
            rules.append((order, tag, i, classes, decls, loose))
        docs.append((doc, css))
        for el in range(8):
            tag, i, classes = r.choice(tags), r.choice([None, *ids]), r.sample(names, r.randint(0, 3))
            own = [(p, f"own{el}") for p in props if r.random() < 0.2]
            elements.append((doc, el, tag, i, classes or None, ";".join(f"{n}: {v}" for n, v in own) or None))
            hits = [x for x in rules if x[1] in (None, tag) and x[2] in (None, i) and set(x[3]) <= set(classes)]
            if any(x[5] for x in hits):
                expected.add((doc, el, None, None, "unresolved"))
                continue
            won = {}
            for order, t, j, cs, decls, _ in sorted(hits, key=lambda x: (x[2] is not None, len(x[3]), x[1] is not None, x[0])):
                for n, v, m in decls:
                    if m or won.get(n, (0,))[0] < 2:
                        won[n] = (2 if m else 0, v)
            for n, v in own:
                if won.get(n, (0,))[0] < 2:
                    won[n] = (1, v)
            expected |= {(doc, el, n, v, ("rule", "own", "important")[k]) for n, (k, v) in won.items()}
    rules = Y.selectors(spark.createDataFrame(docs, "doc int, css string"), "doc", "css")
    out = Y.inlined(spark.createDataFrame(elements, "doc int, el int, tag string, id string, classes array<string>, style string"), rules, "doc").collect()
    assert {tuple(x) for x in out} == expected and len(out) == len(expected)
