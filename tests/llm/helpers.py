"""Small fixtures: documents with nulls, blanks, ties, copies and clashing extra columns."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, key string, _id string"


def docs(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "x", "y", "z") for r in rows]
    return spark.createDataFrame(full, DOCS)


def roots(pairs):
    """Smallest member of each item's component, by plain union-find."""
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}
