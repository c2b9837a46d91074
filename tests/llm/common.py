"""Awkward documents that every operator must take."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Columns named as operators name theirs inside.
CLASHING = SCHEMA + ", doc long, node long, component long, length long, rank int, _gone long, key string, copies long"


def awkward():
    base = " ".join(f"word{i}" for i in range(60))
    near = base.replace("word30", "other")
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
    rows = [
        (1, base, "en", "a"), (2, base.upper(), "en", "a"), (3, near, "en", "b"), (4, None, "en", "b"), (5, "", None, "c"), (6, " \t\n", "en", "c"),
        (7, "one two", "en", None), (8, "one two", "en", None), (9, long, "de", "a"), (10, long + " end", "de", "a"), (11, "Émile à l'école <|endoftext|> x", "fr", "é"),
        (12, "solo", None, "a"), (13, "you stupid idiot", "en", "b"), (None, "no id", "en", "a"), (None, None, None, None),
    ]
    return [(i, t, la, s, None if t is None else len(t)) for i, t, la, s in rows]


def documents(spark, rows=None, clashing=False):
    rows = awkward() if rows is None else rows
    if clashing:
        return spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6, "k", 7) for r in rows], CLASHING)
    return spark.createDataFrame(rows, SCHEMA)


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def shingles(text, k):
    w = words(text)
    if len(w) >= k:
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    return {tuple(w)} if w else set()


def components(ids, linked):
    """Least id reachable, by brute force over all pairs."""
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(ids)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if linked(a, b):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {i: root(i) for i in ids}
