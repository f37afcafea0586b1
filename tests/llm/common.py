"""Fixtures and brute-force helpers of the operator tests."""

import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, id string, h long, found string, row string, score double, kept string"


def docs_frame(spark, rows):
    """documents with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "k", "i", 1, "f", "r", 0.5, "y") for i, t in rows], DOCS)


def by_id(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


def lowered(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


def item_words(s):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(s))


def spaced(s):
    return re.findall(r"[^\x20\x09-\x0D]+", s or "")


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}
