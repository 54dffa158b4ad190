"""Plain Python answers, for small inputs, that the operators are held against."""

from __future__ import annotations

import random
import re
from hashlib import sha256

WORD = re.compile("[^\x20\x09-\x0d]+")


def sha(data: bytes) -> str:
    return sha256(data).hexdigest()


def op1(rows, window=20):
    """rows: (doc_id, text), one for each id."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        words = WORD.findall(text or "")
        gone = set()
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                gone.update(range(i, i + window))
            seen.add(key)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out[doc_id] = (len(words), len(gone), sha(kept.encode()))
    return out


def op9(rows, window=50):
    least = {}
    texts = {d: (t or "").encode() for d, t in rows}
    for d in sorted(texts, key=lambda d: (d is not None, d)):
        for i in range(len(texts[d]) - window + 1):
            least.setdefault(texts[d][i : i + window], d)
    out = {}
    for d, b in texts.items():
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if least[b[i : i + window]] != d:
                gone[i : i + window] = b"\1" * window
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[d] = (len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def corpus(seed=0, n=60, vocabulary=40):
    """Random documents with copies, shared passages, loops, empty and null texts, odd white space."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeéß中") for _ in range(r.randint(1, 7))) for _ in range(vocabulary)]
    passages = [[r.choice(words) for _ in range(r.randint(18, 60))] for _ in range(5)]
    rows = []
    for i in range(n):
        body = []
        for _ in range(r.randint(0, 4)):
            kind = r.random()
            if kind < 0.4:
                body += r.choice(passages)
            elif kind < 0.5:
                body += [r.choice(words)] * r.randint(5, 90)
            elif kind < 0.6:
                p = r.choice(passages)
                body += p[r.randint(0, 15) :]
            else:
                body += [r.choice(words) for _ in range(r.randint(0, 80))]
        text = "".join(w + r.choice([" ", " ", " ", "\n", "\t ", "\xa0 "]) for w in body)
        rows.append((i * 3, text))
    rows += [(1, None), (2, ""), (4, rows[7][1]), (5, rows[7][1]), (7, " \n "), (None, rows[9][1])]
    for k in range(8):
        words_of = (rows[12 + k][1] or "x").split(" ")
        words_of[len(words_of) // 2 :: 37] = ["changed"] * len(words_of[len(words_of) // 2 :: 37])
        rows.append((1000 + k, " ".join(words_of)))
    return rows


ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def op6(rows, items, window=13):
    windows = {}
    for item, text in items:
        words = ALNUM.findall(ascii_lower(text or ""))
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            windows.setdefault(tuple(words[i : i + size]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = {}
    for doc_id, text in rows:
        words = ALNUM.findall(ascii_lower(text or ""))
        hit, found = set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                key = tuple(words[i : i + size])
                if key in windows:
                    hit.update(range(i, i + size))
                    found |= windows[key]
        out[doc_id] = (len(words), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(words))
    return out


def op8(rows, n=5, threshold=0.8):
    """(class_id, n_links, n_text_links, copy_of) of each doc_id; ids are not null here."""
    sets = {}
    for d, t in rows:
        w = WORD.findall(t or "")
        sets[d] = frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else None
    ids = sorted(sets)
    link = {d: set() for d in ids}
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and len(x & y) >= threshold * len(x | y):
                link[a].add(b)
                link[b].add(a)
    out = {}
    for d in ids:
        seen, stack = {d}, [d]
        while stack:
            for e in link[stack.pop()] - seen:
                seen.add(e)
                stack.append(e)
        copies = [e for e in ids if sets[e] == sets[d] and sets[d]] or [d]
        out[d] = (min(seen), len(link[d]), len({sets[e] for e in link[d]} - {sets[d]}), min(copies))
    return out


def near_corpus(seed=0):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(300)]
    rows, k = [], 0
    for base in range(25):
        body = [r.choice(words) for _ in range(r.choice([1, 3, 5, 8, 40, 150, 400]))]
        for copy in range(r.choice([1, 1, 2, 5, 30 if base % 9 == 0 else 3])):
            text = list(body)
            for _ in range(r.choice([0, 0, 1, 2, len(body) // 60, len(body) // 20])):
                text[r.randrange(len(text))] = r.choice(words)
            k += r.randint(1, 3)
            rows.append((k, " ".join(text) if copy % 2 else "\n".join(text)))
    return [*rows, (100_000, None), (100_001, ""), (100_002, " \n")]
