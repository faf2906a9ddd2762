"""Small tables with the odd cases, and brute-force versions."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names operators use inside.
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, id string, digest string, row string, node string, root string, group string, score string, part string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], SCHEMA)


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None, *["x"] * 8) for i, t, s in rows], CLASHING)


def lower_ascii(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0d]+", lower_ascii(text or ""))


def shingles(text: str | None, n: int = 4) -> set:
    w = words(text)
    return set(zip(*[w[k:] for k in range(n)], strict=False)) if len(w) >= n else ({tuple(w)} if w else set())


def brute_components(sets: dict, part: int) -> dict:
    """key -> least key of its component, over all pairs with 100 * intersection >= part * union."""
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held = defaultdict(list)
    for k, s in sets.items():
        for h in s:
            held[h].append(k)
    for k, s in sets.items():
        for other, n in Counter(o for h in s for o in held[h] if o > k).items():
            if 100 * n >= part * (len(s) + len(sets[other]) - n):
                a, b = sorted((find(k), find(other)))
                parent[b] = a
    return {k: find(k) for k in sets}
