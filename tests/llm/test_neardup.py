from lodestore.llm.components import components
from lodestore.llm.neardup import drop_near_duplicates, near_duplicates


def brute(rows, size, percent):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        n = min(size, len(w))
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset())
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                group[top(i)] = top(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if top(j) == top(i) and rows[j][0] is not None]
        first = min(ids) if ids else None
        out.append((doc, len(sets[i]), first if sets[i] else doc, doc == (first if sets[i] else doc)))
    return out


def key(r):
    return tuple((x is not None, x) for x in r)


def test_against_all_pairs(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for size in (2, 5):
        got = [tuple(r) for r in near_duplicates(docs, size, 80).select("doc_id", "n_shingles", "component_id", "kept").collect()]
        assert sorted(got, key=key) == sorted(brute(rows, size, 80), key=key)


def test_drop_keeps_one_of_each_group(docs, empty):
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 0 in ids and 1 not in ids and 2 not in ids and {5, 6, 7, 3, 4} <= set(ids)
    assert near_duplicates(empty).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 9), (9, 8), (5, 5), (7, None), (4, 1), (100, 3)] + [(20 + i, 21 + i) for i in range(30)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "u long, v long")).collect())
    want = {1: 1, 2: 1, 3: 1, 4: 1, 100: 1, 8: 8, 9: 8, 10: 8} | {20 + i: 20 for i in range(31)}
    assert got == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
