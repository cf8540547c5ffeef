"""Line dedup, decontamination, mixing, licences and passages against brute force."""

import collections
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from lodestore.llm.decontam import contamination, decontaminated, positional_index, proximity
from lodestore.llm.licenses import TEMPLATES, license_scan, longest, needed
from lodestore.llm.linededup import drop_boilerplate
from lodestore.llm.mixing import mix_sources, mixed_documents, shared_targets
from lodestore.llm.passages import BAND, HASHES, SHINGLE, WORDS, repeated_passages, shared_passages, signatures, window_minima

from .conftest import words


def test_line_dedup(spark, docs):
    lines = ["menu", "footer", "", " \r"] + [f"line {i}" for i in range(40)]
    rng = random.Random(5)
    rows = [(i, "\n".join(rng.sample(lines[4:], 3) + ["menu"] * (i % 2) + ["footer", "", " \r", "footer"] * (i % 5 == 0)), "s" if i < 60 else None) for i in range(100)] + [(200, None, "s"), (201, "menu", "s"), (202, "menu", "t"), (201, "menu", "s")]
    # a host of nine pages that all have one line, and columns with odd or taken names
    rows += [(300 + i, f"own {i}\nall have it", "small") for i in range(9)]
    given = spark.createDataFrame(rows, "doc_id long, text string, site string").withColumn("a.b", F.lit(1)).withColumn("_lines", F.lit(2))
    got = drop_boilerplate(given, "site", ratio=0.25, doubt=1.5).collect()
    assert all(r["a.b"] == 1 and r["_lines"] == 2 for r in got)
    total = collections.Counter(s for _, _, s in rows)
    pages = collections.Counter((s, x) for _, t, s in rows if t is not None for x in set(t.split("\n")) if x.strip(" \t\r"))
    bad = {k for k, n in pages.items() if n - 1.5 * n**0.5 > 0.25 * total[k[0]]}
    assert ("small", "all have it") in bad and ("s", "menu") in bad
    cut = lambda t, s: None if t is None else "\n".join(x for x in t.split("\n") if (s, x) not in bad)
    show = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((r["doc_id"], r["text"], r["site"]) for r in got), key=show) == sorted(((i, cut(t, s), s) for i, t, s in rows), key=show)
    assert bad and sum(r["n_dropped"] for r in got) > 40
    assert drop_boilerplate(docs.where("false")).count() == 0


@pytest.fixture(scope="module")
def items(spark, docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    a = texts[3].split()
    rows = [(1, " ".join(a[45:70])), (2, "nothing of this is there at all in any of these texts"), (10, "é, Ü"), (11, ""), (12, None), (None, " ".join(a[45:70])), (13, "ONE"), (14, " ".join(a[:10] + ["other"])), (1, " ".join(a[45:70]))]
    return spark.createDataFrame(rows, "item_id long, text string")


def brute_hits(text, windows):
    w, hit, found = words(text), set(), set()
    for n in {len(p) for p in windows}:
        for k in range(len(w) - n + 1):
            own = windows.get(tuple(w[k : k + n]))
            if own:
                hit.update(range(k, k + n))
                found |= own
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block", [1 << 20, 100])
def test_decontamination(docs, items, block):
    windows = collections.defaultdict(set)
    for r in items.where("item_id is not null").collect():
        w = words(r["text"])
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(r["item_id"])
    got = contamination(docs, items, block_bytes=block).collect()
    show = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got), key=show) == sorted(((r["doc_id"], *brute_hits(r["text"], windows)) for r in docs.collect()), key=show)
    assert sum(r["n_hit"] > 0 for r in got) >= 5


def test_decontaminated_rows(docs, items):
    left = decontaminated(docs, items)
    assert left.columns == docs.columns and {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in left.collect()} == {3, 4, 8, 9, 10}
    assert contamination(docs, items.where("false")).where("n_hit > 0").count() == 0
    assert contamination(docs.where("false"), items).count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a b x c"), (2, "c q q q b a"), (3, "a c"), (4, None), (5, "b. A! c, a b c")], "doc_id long, text string")
    got = {tuple(r) for r in proximity(positional_index(docs), [(7, "A b C"), (8, "")], slop=1).collect()}
    assert got == {(1, 7, 0, 4), (5, 7, 0, 3)}


def test_targets():
    got = shared_targets({"a": 100, "b": 10, None: 50}, (3, 1, 2), 1.5, 2)
    assert list(got) == ["a", "b", None] and abs(sum(got.values()) - 240) < 1e-9
    assert got["b"] == 20 and got[None] == pytest.approx(88) and got["a"] == pytest.approx(132)
    assert shared_targets({}, (1,), 1.5, 2) == {}


def test_mixing(docs):
    rows = mix_sources(docs).collect()
    assert len(rows) == docs.count()
    size = collections.Counter()
    taken = collections.Counter()
    for r in rows:
        assert 0 <= r["copies"] <= 2
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
    targets = {r["source"]: r["target"] for r in rows}
    assert targets == pytest.approx(shared_targets(dict(size), (3, 1, 2), 1.5, 2))
    longest = {s: max(r["size"] for r in rows if r["source"] == s) for s in size}
    for s, t in targets.items():
        assert abs(taken[s] - t) <= min(longest[s] / 2 + 1, 0.5 * t + 1)
    again = mix_sources(docs.repartition(7)).collect()
    show = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, rows), key=show) == sorted(map(tuple, again), key=show)
    whole = mixed_documents(docs)
    assert whole.columns == [*docs.columns, "copies"] and sorted((r["copies"] for r in whole.collect())) == sorted(r["copies"] for r in rows)
    assert mix_sources(docs.where("false")).count() == 0
    clash = docs.withColumns({c: F.lit(7) for c in ("size", "rate", "of", "part", "copies", "row", "target")})
    odd = mixed_documents(clash)
    assert sorted(r["copies"] for r in odd.collect()) == sorted(r["copies"] for r in rows) and {r["rate"] for r in odd.collect()} == {7}
    lines = drop_boilerplate(docs.withColumns({c: F.lit(7) for c in ("host", "of", "gone", "t1", "n_lines", "row")}), "source")
    assert lines.count() == docs.count() and {r["gone"] for r in lines.collect()} == {7}


def test_mixing_solves_the_dual(docs):
    """Rates against a bisection of each source's tilt, made without the operator; dotted names stay."""
    rows = mix_sources(docs.withColumn("a.b", F.lit(1))).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    for own in by.values():
        sizes = [r["size"] for r in own]
        target, whole = own[0]["target"], sum(sizes)
        if not 0 < target < 2 * whole:
            continue
        mean = whole / sum(n > 0 for n in sizes)
        rate = lambda tilt, n: min(2.0, math.exp(min(50.0, tilt * n / mean)))  # noqa: B023, E731
        low, high = -60.0, 60.0
        for _ in range(200):
            tilt = (low + high) / 2
            low, high = (tilt, high) if sum(n * rate(tilt, n) for n in sizes) < target else (low, tilt)
        assert [r["rate"] for r in own] == pytest.approx([rate(low, n) for n in sizes], rel=1e-5)
    assert {r["a.b"] for r in mixed_documents(docs.withColumn("a.b", F.lit(1))).collect()} == {1}


def test_licenses(spark):
    rows = [(1, "x. ALL rights\nreserved, all rights reserved"), (2, "Licensed under the Apache License, Version 2.0."), (3, "licensed under the\napache license version 2.0 q"), (4, None), (5, ""), (6, "this file is under CC-BY and CC BY"), (None, "Released under the MIT License"), (7, "version 2.0 of the license"), (8, "permission is hereby granted free of charge to any person obtaining a copy of this software and the documentation files")]
    got = {r["doc_id"]: r for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(p["start"], p["label"]) for p in got[1]["places"]] == [(1, "reserved"), (4, "reserved")]
    assert [(p["start"], p["label"]) for p in got[6]["places"]] == [(4, "cc-by"), (7, "cc-by")]
    labels = {k: [m["label"] for m in r["matches"]] for k, r in got.items()}
    assert labels == {1: ["reserved"], 2: ["apache"], 3: ["apache"], 4: [], 5: [], 6: [], None: ["mit"], 7: [], 8: ["mit"]}
    assert needed(10, 0.8) == 8 and needed(3, 0.85) == 3
    assert license_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_licenses_against_every_block(spark):
    """Notices broken over any lines, with changed words, against all runs of words of each text."""
    rng = random.Random(11)
    rows = []
    for i in range(120):
        label, text = TEMPLATES[i % len(TEMPLATES)]
        own = text.split()
        for _ in range(rng.randrange(4)):
            own[rng.randrange(len(own))] = rng.choice(["x", "the license", ""])
        body = [f"w{rng.randrange(50)}" for _ in range(20)] + own + rng.sample(["the", "rights", "license", "under", "of"], 3) + [f"w{rng.randrange(50)}" for _ in range(10)]
        rows.append((i, "".join(w + rng.choice([" ", " ", "\n", "\n\n"]) for w in body)))
    rows += [(500, "All rights reserved. " + "z " * 200_000 + "released under\nthe\nMIT License"), (501, rows[0][1]), (501, rows[0][1])]
    got = license_scan(spark.createDataFrame(rows, "doc_id long, text string").withColumns({"words": F.lit(1), "label": F.lit(2)})).collect()
    assert len(got) == len(rows)
    found = 0
    for r in got:
        w = words(dict(rows)[r["doc_id"]])
        want = {}
        for label, text in TEMPLATES if r["doc_id"] < 500 else ():
            t = words(text)
            best = max(len(set(t) & set(w[k : k + longest(text, 0.85)])) for k in range(len(w)))
            if best >= needed(len(set(t)), 0.85):
                want[label] = max(want.get(label, 0), best / len(set(t)))
        if r["doc_id"] < 500:
            assert {m["label"]: m["containment"] for m in r["matches"]} == pytest.approx(want)
            found += len(want)
        if r["doc_id"] == 500:
            assert [(m["label"], m["start"]) for m in r["matches"]] == [("mit", 200_003), ("reserved", 0)]
    assert found > 60


def tree_windows(values, least):
    """(l, c, r) of the nodes of the Cartesian tree that span ``least`` places or more."""
    out, todo = [], [(0, len(values))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo >= least:
            c = lo + int(values[lo:hi].argmin())
            out.append((lo, c, hi - 1))
            todo += [(lo, c), (c + 1, hi)]
    return out


@pytest.mark.parametrize("repeats", [1, 7])
def test_compact_windows(repeats):
    import numpy as np

    v = np.tile(np.random.default_rng(1).integers(0, 1 << 62, 200 // repeats, dtype=np.uint64), repeats)
    found = tree_windows(v, 10)
    for i, low in enumerate(window_minima(v, 10)):
        assert [v[c] for lo, c, hi in found if lo <= i <= c <= i + 9 <= hi] == [low]


def test_signatures_are_joined_windows():
    """Each stretch of LEAST shingles is in one run of each band; stretches share a run if and only if they share all minima's places."""
    import numpy as np

    rng = np.random.default_rng(2)
    bounds = np.array([0, 46, 300, 345, 600])
    items = rng.integers(0, 1 << 62, 600, dtype=np.uint64)
    items[500:600] = items[120:220]
    text, key, s, e = signatures(items, bounds)
    bands = HASHES // BAND
    count = {}
    for t, k, a, z in zip(text.tolist(), key.tolist(), s.tolist(), e.tolist(), strict=True):
        for i in range(a, z + 1):
            count.setdefault((t, i), []).append(k)
    assert set(count) == {(t, i) for t in range(4) for i in range(bounds[t + 1] - bounds[t] - 45)}
    assert all(len(v) == bands and len(set(v)) == bands for v in count.values())
    # equal stretches have equal signatures wherever they stand
    for i in range(120, 220 - 45):
        assert sorted(count[1, i - 46]) == sorted(count[3, i + 380 - 345])


def test_passages(docs, empty):
    got = {r["doc_id"]: r for r in repeated_passages(docs).collect()}
    own = {}
    for r in docs.where("doc_id is not null").collect():
        own[r["doc_id"]] = words(r["text"])
    seen = collections.defaultdict(set)
    for i, w in own.items():
        for k in range(len(w) - WORDS + 1):
            seen[tuple(w[k : k + WORDS])].add(i)
    for i, w in own.items():
        must = {p for k in range(len(w) - WORDS + 1) if len(seen[tuple(w[k : k + WORDS])]) > 1 for p in range(k, k + WORDS)}
        have = {p for s in (got[i]["spans"] if i in got else []) for p in range(s["start"], s["stop"])}
        assert must <= have
    assert {0, 1, 2, 3, 4} <= set(got) and not set(got) & set(range(20, 50)) and not set(got) & {5, 6, 7, 8, 9, 10, 11, 12}
    assert got[1]["copy_of"] == 0 and got[2]["class_id"] == 0 and got[4]["class_id"] == 3
    assert repeated_passages(empty).count() == 0


@pytest.mark.parametrize("block", [2, 512])
def test_passages_all_partners(spark, monkeypatch, block):
    """Documents of a star share passages that neither its smallest document nor the one before has."""
    monkeypatch.setattr("lodestore.llm.passages.BLOCK", block, raising=False)
    rng = random.Random(9)
    new = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    shared, other = new(200), new(60)
    # 0 has every second stretch of 20 words of the passage, so its contexts meet but it shares no passage of 50 words
    texts = {0: [w for k in range(0, 200, 40) for w in shared[k : k + 20] + new(9)], 1: new(30) + shared + new(30), 2: new(20) + [w for k in range(0, 200, 40) for w in shared[k : k + 20] + new(7)], 3: new(10) + shared + new(25)}
    # 5 and 7 share more than either shares with 4 and 6
    texts |= {4: new(9) + other[:52] + new(9), 5: new(12) + other + new(8), 6: new(4) + other[5:57] + new(9), 7: new(5) + other + new(20)}
    got = {r["doc_id"]: r for r in repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")).collect()}
    assert {i: r["class_id"] for i, r in got.items()} == {1: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: 4}
    assert {i: r["n_dup_words"] for i, r in got.items()} == {1: 200, 3: 200, 4: 52, 5: 60, 6: 52, 7: 60}


def test_shared_passages_repeated_ends():
    """Repeats of a part of the passage beside it don't hide the passage; failing stretches keep their similar part."""
    import numpy as np

    from lodestore.llm.tokens import mix, shingles

    items = lambda w: shingles(mix(np.array(w, np.uint64)), SHINGLE)
    p = list(range(1, 51))
    for a, b in [(p, p + [91, 92, 93] + p[-5:] + [94, 95, 96] + p[-5:]), (p + [91, 92, 93] + p[-5:] + [94, 95, 96] + p[-5:], p)]:
        assert (0, 46, 0, 46) in shared_passages(items(a), items(b))
    q = list(range(100, 220))
    near = q[:40] + [901] + q[41:80] + [902] + q[81:]
    ends = [x for k in range(6) for x in [300 + 9 * k + n for n in range(6)] + [1000 + 9 * k + n for n in range(9)]]
    other = [x for k in range(6) for x in [300 + 9 * k + n for n in range(6)] + [2000 + 9 * k + n for n in range(9)]]
    found = shared_passages(items(q + ends), items(near + other))
    assert any(s <= 1 and 110 <= e <= 130 for s, e, _, _ in found)


def near_stretches(a, b):
    """Starts (i, j) of stretches of 46 shingles of two word lists with a Jaccard similarity of 0.8 or more, on shared diagonals."""
    least = WORDS - SHINGLE + 1
    x, y = ([tuple(w[k : k + SHINGLE]) for k in range(len(w) - SHINGLE + 1)] for w in (a, b))
    at = collections.defaultdict(list)
    for j, v in enumerate(y):
        at[v].append(j)
    lines = collections.defaultdict(set)
    for i, v in enumerate(x):
        for j in at.get(v, ()):
            lines[j - i].add(i)
    for d, hits in lines.items():
        if len(hits) < 30:
            continue
        for i in range(max(0, -d, min(hits) - 8), min(len(x) - least, len(y) - least - d, max(hits)) + 1):
            if sum(k in hits for k in range(i, i + least)) >= 36:
                p, q = set(x[i : i + least]), set(y[i + d : i + d + least])
                if len(p & q) >= 0.8 * len(p | q):
                    yield i, i + d


def test_passages_recall(spark):
    """Of all near-duplicate stretches of a real table's texts, found without the operator, nine tenths and more are in spans."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r for r in repeated_passages(docs).collect()}
    first = {}
    for r in sorted(docs.where("text is not null").collect()):
        first.setdefault(r["text"], r["doc_id"])
    texts = {i: words(t) for t, i in first.items()}
    seen = collections.defaultdict(set)
    for i, w in texts.items():
        for k in range(len(w) - SHINGLE + 1):
            seen[tuple(w[k : k + SHINGLE])].add(i)
    common = collections.Counter(p for own in seen.values() if 1 < len(own) for p in itertools.combinations(sorted(own), 2))
    stretches = hit = pairs = joined = 0
    for (u, v), n in common.items():
        found = list(near_stretches(texts[u], texts[v])) if n >= 30 else []
        if not found:
            continue
        pairs += 1
        joined += u in got and v in got and got[u]["class_id"] == got[v]["class_id"]
        for doc, starts in ((u, {i for i, _ in found}), (v, {j for _, j in found})):
            spans = got[doc]["spans"] if doc in got else []
            stretches += len(starts)
            hit += sum(any(s["start"] <= i and i + WORDS <= s["stop"] for s in spans) for i in starts)
    print("pairs", joined, "of", pairs, "stretches", hit, "of", stretches)
    assert pairs > 50 and joined >= 0.95 * pairs and hit >= 0.95 * stretches


def test_passages_repetitive(spark):
    """Two texts of 20,000 equal words, which meet at all offsets, and one that repeats a line."""
    line = [f"r{k}" for k in range(30)]
    texts = [(1, "same " * 20_000), (2, "same " * 20_001), (3, " ".join(line * 600)), (4, " ".join(["q"] + line * 500)), (5, "same " * 30)]
    got = {r["doc_id"]: r for r in repeated_passages(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert {i: (r["class_id"], r["n_dup_words"]) for i, r in got.items()} == {1: (1, 20_000), 2: (1, 20_001), 3: (3, 18_000), 4: (3, 15_000)}


def test_passages_often_shingles():
    """A near copy of a line that a text repeats more than 16 times, whose shingles are all frequent there."""
    import numpy as np

    from lodestore.llm.tokens import mix, shingles

    items = lambda w: shingles(mix(np.array(w, np.uint64)), SHINGLE)
    line = list(range(1, 91))
    near = line[:45] + [901] + line[46:]
    many = [x for k in range(20) for x in line + list(range(1000 + 20 * k, 1020 + 20 * k))]
    found = shared_passages(items(near), items(many))
    assert {p for s, e, _, _ in found for p in range(s, e)} >= set(range(86))
    # each repeat of the line is a passage, too
    places = {p for _, _, s, e in found for p in range(s, e)}
    assert all(set(range(110 * k, 110 * k + 86)) <= places for k in range(20))
    assert {p for _, _, s, e in shared_passages(items(many), items(near)) for p in range(s, e)} >= set(range(86))


def test_passages_every_partner():
    """A document of which two open windows of one group are near to different partners of one class gets both passages."""
    import numpy as np

    from lodestore.llm import passages

    words = np.random.default_rng(5).integers(1, 1 << 62, 400).astype(np.uint64)
    one, two, gap, fill = (words[k : k + 60] for k in (0, 60, 120, 180))
    asker = np.concatenate([one, gap, two])
    items = [asker, np.concatenate([one, fill]), np.concatenate([two, fill])]
    places = [np.arange(len(x)) for x in items]
    runs = [np.array(r, np.int64) for r in ([[1, 2, 0, 14], [2, 2, 120, 134]], [[1, 0, 0, 14]], [[2, 0, 0, 14]])]
    found = passages._near(items, places, runs, np.array([2, 0, 0]), np.array([7, 8, 9]), np.array([7, 8, 8]), np.zeros(3, int))
    assert {(other, start, stop) for _, doc, other, start, stop, _, _ in found if doc == 7} == {(8, 0, 60), (9, 120, 180)}


def test_passages_two_more_words():
    """A stretch with two more words in its middle is near by 40 of its 46 shingles: 40 of 50 in all."""
    import numpy as np

    from lodestore.llm import passages
    from lodestore.llm.tokens import mix, shingles

    items = lambda w: shingles(mix(np.array(w, np.uint64)), SHINGLE)
    a, b = items([*range(1, 25), 901, 902, *range(25, 49)]), items(list(range(1, 49)))
    assert len(a) == 46 and len(set(a.tolist()) & set(b.tolist())) == 40
    b = np.append(b, items([990, 991, 992, 993, 994, 995, 996]))
    assert shared_passages(a, b)
    found = passages._near([a, b], [np.arange(len(a)), np.arange(len(b))], [np.array([[1, 2, 0, 0]], np.int64), np.array([[1, 0, 0, len(b) - 46]], np.int64)], np.array([2, 0]), np.array([7, 8]), np.array([7, 8]), np.zeros(2, int))
    assert {doc for _, doc, *_ in found} == {7, 8}


def test_passages_open_window_without_company():
    """Windows with more shingles of their own than a near repeat may have are held against no other, however many meet."""
    import numpy as np

    from lodestore.llm import passages

    rng = np.random.default_rng(6)
    line = rng.integers(1, 1 << 62, 36).astype(np.uint64)
    items = [np.concatenate([line, rng.integers(1, 1 << 62, 10).astype(np.uint64)]) for _ in range(400)]
    items.append(np.concatenate([items[17][:20], line[:1] + np.uint64(1), items[17][21:]]))
    n = len(items)
    made = []
    text = passages.Text

    class Counted(text):
        def __init__(self, x):
            made.append(1)
            super().__init__(x)

    passages.Text = Counted
    try:
        found = passages._near(items, [np.arange(46)] * n, [np.array([[1, 2, 0, 0]], np.int64)] * n, np.full(n, 2), np.arange(n), np.arange(n), np.zeros(n, int))
    finally:
        passages.Text = text
    assert {doc for _, doc, *_ in found} == {17, 400} and len(made) == 2


def test_passages_equal_partners(monkeypatch):
    """Partners that hold the same of a window are compared once, even where one of its stretches stays open."""
    import numpy as np

    from lodestore.llm import passages

    rng = np.random.default_rng(7)
    one, two = (rng.integers(1, 1 << 62, 60).astype(np.uint64) for _ in range(2))
    asker = np.concatenate([one, rng.integers(1, 1 << 62, 60).astype(np.uint64), two, two[:3]])
    items = [asker] + [np.concatenate([one, rng.integers(1, 1 << 62, 40).astype(np.uint64)]) for _ in range(50)]
    n, calls, compare = len(items), [], passages.shared_passages
    monkeypatch.setattr(passages, "shared_passages", lambda a, b: calls.append(1) or compare(a, b))
    runs = [np.array([[1, 2, 0, 14], [2, 2, 120, 137]], np.int64)] + [np.array([[1, 0, 0, 14]], np.int64)] * (n - 1)
    found = passages._near(items, [np.arange(len(x)) for x in items], runs, np.array([2] + [0] * (n - 1)), np.arange(n), np.array([0] + [1] * (n - 1)), np.zeros(n, int))
    assert {(start, stop) for _, doc, _, start, stop, _, _ in found if doc == 0} == {(0, 60)} and len(calls) == 1


def test_passages_hashes_each_text_once_for_its_keys(spark, docs, monkeypatch, tmp_path):
    from lodestore.llm import passages

    keys, seen = passages._keys, str(tmp_path / "seen")

    def counted(batches):
        def each():
            for b in batches:
                with open(seen, "a") as to:
                    to.write("".join(f"{d}\n" for d in b.column(0).to_pylist()))
                yield b

        return keys(each())

    monkeypatch.setattr(passages, "_keys", counted)
    assert repeated_passages(docs.where("doc_id < 60")).count()
    with open(seen) as lines:
        assert max(collections.Counter(lines).values()) == 1


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_passages_shared_keys(size):
    """Keys of several documents, whatever batches their rows come in; a repeated row is one."""
    import pyarrow as pa

    from lodestore.llm import passages

    rng = random.Random(size)
    rows = sorted((k, rng.randrange(40)) for k in range(-30, 30) for _ in range(rng.choice([1, 1, 2, 3, 4, 9, 30])))
    batches = [pa.record_batch({"key": [k for k, _ in rows[i : i + size]], "doc": [d for _, d in rows[i : i + size]]}) for i in range(0, len(rows), size)]
    groups = collections.defaultdict(set)
    for k, d in rows:
        groups[k].add(d)
    found = [tuple(r.values()) for b in passages._shared_keys(iter(batches)) for r in b.to_pylist()]
    assert found == [(k, d, min(len(of), 3), min(of)) for k, of in sorted(groups.items()) if len(of) > 1 for d in sorted(of)]


def test_passages_seeds_without_reach(monkeypatch):
    """Of words that two texts repeat over and over, no offset is looked at that leads to no open stretch of a passage's length."""
    import numpy as np

    from lodestore.llm import passages

    rng = np.random.default_rng(8)
    new = lambda n: rng.integers(1, 1 << 62, n).astype(np.uint64)
    often, line = np.repeat(new(1), 40), new(60)
    a, b = (np.concatenate([often, new(60), line[:30], line[30 + k :], new(60), often]) for k in (0, 1))
    looked, similar = [], []
    lexsort, argsort, compare = np.lexsort, np.argsort, passages._similar
    monkeypatch.setattr(np, "lexsort", lambda keys, *x: looked.append(len(keys[0])) or lexsort(keys, *x))
    monkeypatch.setattr(np, "argsort", lambda keys, *x, **y: looked.append(len(keys)) or argsort(keys, *x, **y))
    monkeypatch.setattr(passages, "_similar", lambda *x: similar.append(1) or compare(*x))
    found = shared_passages(a, b)
    assert (100, 160, 100, 159) in found and len(similar) == 1
    assert sum(looked) < 8 * 40 * 40 * 4
