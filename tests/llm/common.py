"""Hard rows that every operator must take, and brute-force versions."""

from collections import defaultdict

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, kept string, h1 string, key string"


def ascii_lower(t):
    return (t or "").encode().lower().decode()


def hard_docs(spark):
    """Nulls in each column, empty and very long texts, ties, repeated rows, other columns with clashing names."""
    base = "the quick brown fox jumps over the lazy dog and runs far away from here again"
    rows = [
        (1, None, "en", "a"),
        (2, "", "en", "a"),
        (3, "   \n\t ", None, "a"),
        (4, base, "en", None),
        (5, base.upper(), "en", "b"),
        (6, base + " today", "en", "b"),
        (7, "one two", "en", "b"),
        (8, "ONE two", "en", "b"),
        (9, "word " * 60_000, "en", "b"),
        (10, "ÄÖÜ äöü straße", "de", "b"),
        (11, "äöü äöü straße", "de", "b"),
        (12, "line\n\nline\nother ", "en", "b"),
        (12, "line\n\nline\nother ", "en", "b"),
        (None, "no id here at all", None, None),
        (13, "12345 !!! ###", "en", "c"),
    ]
    return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t), "x", "y", "z", "k") for i, t, lang, src in rows], DOCS)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text, k=5):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    k = min(k, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def near_components(docs, percent=75):
    """{id: (n_shingles, component)} by comparing all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in docs}
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    shared = defaultdict(int)
    for ids in where.values():
        ids = sorted(set(ids))
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                shared[a, b] += 1
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}
