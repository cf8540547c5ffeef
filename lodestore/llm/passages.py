"""Substring dedup by compact windows: near-duplicate passages of different documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestore.llm.components import components
from lodestore.llm.shared import among, apart, few, small_batches, stash, stash_at, unstash
from lodestore.llm.tokens import ALNUM, hashed_texts, mix, pieces, powers, shingles, text_buffers, word_hashes

#: Words of a shingle, and of the shortest passage that counts.
SHINGLE, WORDS = 5, 50
#: Shingles of the shortest passage.
LEAST = WORDS - SHINGLE + 1
#: Hash functions, and how many of them one signature joins. Two stretches of similarity 0.8 share one of both signatures
#: in 0.65 of all cases, equal ones always; a repeat has many stretches that can meet (measured recall: see README).
HASHES, BAND = 8, 4
#: A passage pair is near-duplicate from this similarity of its shingle sets on.
SIMILARITY = 0.8
#: Unbroken shingles from which a comparison of two passages starts: similarity 0.8 leaves runs of about 20.
CONTEXT = 12
#: Shingles that a changed word breaks: matched runs that are further apart are different passages.
GAP = 2 * SHINGLE
#: Shingles on each side of a window that are compared with it.
MARGIN = LEAST
#: Of a shingle that stands more often in a text, equal surroundings are compared once for all (none are left out).
OFTEN = 16
#: Places that two texts share and that are held at once, if no passage's length has more.
PLACES = 1 << 22
#: Places around the first seeds of two texts that are looked at together; later turns take more.
FIRST = 1 << 10
#: Documents that one task compares with their hub.
PART = 256
#: Documents of one side of a group's open windows that are compared in one task.
BLOCK = 8192
#: Places of open windows that are sought in several documents at once.
TURN = 1 << 17
#: Rows of small groups that one task's turn compares, group by group.
BUNDLE = 250

_U = np.uint64
_SALT = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * _U(0x632BE59BD9B4E019))
_B = _U(0xC2B2AE3D27D4EB4F)
_INVERSE = _U(pow(int(_B), -1, 1 << 64))
#: Places between two stretches of one text that are compared as one array: more than any run may bridge.
_APART = 4 * GAP


def window_minima(values: np.ndarray, least: int) -> np.ndarray:
    """The minimum of each stretch [i, i + least).

    The stretches of one minimum are those that lie in its compact window, the node of the Cartesian tree of ``values``
    that spans at least ``least`` places around it without a smaller value: a run of starts for each such node.
    """
    n = len(values) - least + 1
    if n <= 0:
        return values[:0]
    low, span = values, 1
    while 2 * span <= least:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    return np.minimum(low[:n], low[least - span : least - span + n])


def signatures(items: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, key, s, e) for texts that hold items[bounds[k]:bounds[k + 1]]: starts s to e of stretches of LEAST shingles.

    The compact windows of a band's hash functions are joined as intervals: a key stands for the minima of all of them,
    and all stretches from s to e share it. Runs of one text may share a key.
    """
    n = len(items) - LEAST + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.searchsorted(bounds, np.arange(n), "right") - 1
    whole = np.arange(n) + LEAST <= bounds[text + 1]
    found = []
    for band in range(HASHES // BAND):
        change, key = np.append(True, (text[1:] != text[:-1]) | ~whole[:-1]), np.full(n, band + 1, np.uint64)
        for salt in _SALT[band * BAND : (band + 1) * BAND]:
            low = window_minima(((items ^ salt) * _B >> _U(32)).astype(np.uint32), LEAST)
            change[1:] |= low[1:] != low[:-1]
            key = key * _U(0x9E3779B97F4A7C15) + low
        heads = np.flatnonzero(change & whole)
        # a run ends before the next change or where its text's last stretch ends
        nexts = np.append(np.flatnonzero(change), n)
        stop = np.minimum(nexts[np.searchsorted(nexts, heads, "right")], bounds[text[heads] + 1] - LEAST + 1)
        found.append((text[heads], mix(key[heads]), heads - bounds[text[heads]], stop - 1 - bounds[text[heads]]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _hashed(column: pa.Array) -> Iterator[tuple[np.ndarray, list[int], np.ndarray, list[np.ndarray], bytes]]:
    """(items, rows, bounds, byte places of each text's words, bytes) of a piece of the column's texts of WORDS words or more."""
    data, offsets = text_buffers(column)
    for i, j in pieces(offsets):
        lo, hi = offsets[i], offsets[j]
        hashes, words, at = word_hashes(data[lo:hi], offsets[i : j + 1] - lo, ALNUM)
        rows = [k for k in range(j - i) if words[k + 1] - words[k] >= WORDS]
        parts = [shingles(hashes[words[k] : words[k + 1]], SHINGLE) for k in rows]
        if rows:
            ends = offsets[i + 1 : j + 1] - lo
            places = [np.append(at[words[k] : words[k + 1]], ends[k]) for k in rows]
            yield np.concatenate(parts), [i + k for k in rows], np.append(0, np.cumsum([len(p) for p in parts])), places, data[lo:hi].tobytes()


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, doc): the signatures of each document, once each."""
    for b in batches:
        ids = b.column(0).to_numpy(zero_copy_only=False)
        for items, rows, bounds, _, _ in _hashed(b.column(1)):
            text, key, _, _ = signatures(items, bounds)
            order = np.lexsort((key, text))
            text, key = text[order], key[order]
            first = np.append(True, (text[1:] != text[:-1]) | (key[1:] != key[:-1]))
            yield pa.RecordBatch.from_arrays([pa.array(key[first].view(np.int64)), pa.array(ids[np.array(rows)[text[first]]])], names=["key", "doc"])


def _shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, doc, n, hub) of the keys that several documents have, from rows (key, doc) by key and doc. The hub is the
    smallest of them; n is 2, or 3 for any more. At most two rows wait for the next batch, however long a group is."""
    key, doc, gone = np.zeros(0, np.int64), np.zeros(0, np.int64), None

    def row(k: np.ndarray, d: np.ndarray, n: np.ndarray, hub: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (k, d, n.astype(np.int64), hub)], names=["key", "doc", "n", "hub"])

    for b in batches:
        if not b.num_rows:
            continue
        key, doc = (np.append(old, b.column(c).to_numpy(zero_copy_only=False)) for c, old in enumerate((key, doc)))
        new = np.append(gone is None or (key[0], doc[0]) != (gone[0], gone[2]), (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))
        key, doc = key[new], doc[new]
        if not len(key):
            continue
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        rows = np.diff(np.append(heads, len(key)))
        n, hub = np.minimum(rows, 3), doc[heads]
        if gone is not None and key[0] == gone[0]:
            n[0], hub[0] = 3, gone[1]
        # the last group may go on
        done = len(key) if n[-1] > 2 else heads[-1]
        gone = (key[-1], hub[-1], doc[-1]) if n[-1] > 2 else None
        take = np.flatnonzero(np.repeat(n > 1, rows)[:done])
        if len(take):
            yield row(key[take], doc[take], np.repeat(n, rows)[take], np.repeat(hub, rows)[take])
        key, doc = key[done:], doc[done:]
    if len(key) > 1:
        yield row(key, doc, np.full(2, 2), np.full(2, doc[0]))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _grams(items: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Hashes of all stretches of so many items; equal ones hash alike wherever they stand."""
    n = len(items)
    if n < least:
        return np.zeros(0, np.uint64)
    size = 1 << n.bit_length()
    if size not in _powers:
        if len(_powers) > 20:
            _powers.clear()
        _powers[size] = powers(size, _B), powers(size, _INVERSE)
    up, down = _powers[size]
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(items * up[:n], out=prefix[1:])
    return mix((prefix[least:] - prefix[:-least]) * down[: n - least + 1])


def _stretches(at: np.ndarray, gap: int) -> np.ndarray:
    """(start, stop) of the stretches of the sorted places ``at`` in which no gap exceeds ``gap``."""
    cut = np.flatnonzero(np.diff(at) > gap + 1)
    return np.stack([at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)] + 1], axis=1)


def _covered(inside: np.ndarray, stretches: np.ndarray) -> np.ndarray:
    """Of which stretches all places are inside."""
    start, stop = stretches.T
    total = np.append(0, np.cumsum(inside))
    return total[stop] - total[start] == stop - start


def _full(inside: np.ndarray, stretches: np.ndarray) -> bool:
    """Whether all places of the stretches that are long enough for a passage are inside."""
    return bool((_covered(inside, stretches) | (stretches[:, 1] - stretches[:, 0] < LEAST)).all())


def _around(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n places lie in a stretch of so many places from one of the starts on."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + length, -1)
    return np.cumsum(change)[:-1] > 0


class Text:
    """The shingles of a text, with what comparisons with several others need."""

    def __init__(self, items: np.ndarray):
        self.items, self.grams = items, _grams(items)
        self.places = np.argsort(items, kind="stable")
        self.ranked = items[self.places]

    @cached_property
    def often(self) -> np.ndarray:
        """Which places have a shingle that stands more than OFTEN times."""
        if len(self.items) <= OFTEN or not (self.ranked[OFTEN:] == self.ranked[:-OFTEN]).any():
            return np.zeros(len(self.items), bool)
        return np.searchsorted(self.ranked, self.items, "right") - np.searchsorted(self.ranked, self.items, "left") > OFTEN

    @cached_property
    def fresh(self) -> np.ndarray:
        """Which places are compared for all that have equal surroundings: any stretch that a passage of LEAST can meet
        stands wholly in them, if not there, then where it stood first. Shingles that aren't often are at all their places."""
        grams = _grams(self.items, LEAST + GAP)
        if not len(grams):
            return np.ones(len(self.items), bool)
        return ~self.often | _around(np.unique(grams, return_index=True)[1], LEAST + GAP, len(self.items))

    @cached_property
    def plain(self) -> bool:
        """Whether no shingle stands twice."""
        return not (self.ranked[1:] == self.ranked[:-1]).any()

    def met(self, other: Text) -> np.ndarray:
        """Which places have a shingle that stands in the other text too."""
        out = np.zeros(len(self.items), bool)
        if len(other.ranked):
            # sorted ones are found faster
            out[self.places] = other.ranked[np.minimum(np.searchsorted(other.ranked, self.ranked), len(other.ranked) - 1)] == self.ranked
        return out

    @cached_property
    def by_gram(self) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(self.grams, kind="stable")
        return order, self.grams[order]


def _live(a: Text, met: np.ndarray) -> np.ndarray:
    """The places of a that ``met`` names, of often shingles only those in stretches that can be near to one of what they met."""
    if not a.often.any():
        return met
    total = np.append(0, np.cumsum(met))
    starts = np.flatnonzero(total[LEAST:] - total[:-LEAST] >= SIMILARITY * LEAST) if len(met) >= LEAST else np.zeros(0, np.int64)
    return met & (~a.often | _around(starts, LEAST, len(met)))


def _pairs(a: Text, b: Text, of_a: np.ndarray, of_b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places (i, j) with a[i] == b[j] among those of a and of b, by offset j - i and then by i.

    Where they are more than PLACES, they come in parts of a that have twice a passage's least length in common.
    """
    at, own = b.places[of_b[b.places]], a.places[of_a[a.places]]
    ranked, items = b.items[at], a.items[own]
    lo = np.searchsorted(ranked, items, "left")
    n = np.searchsorted(ranked, items, "right") - lo
    if n.sum() <= PLACES:
        i = np.repeat(own, n)
        j = at[np.arange(len(i)) + np.repeat(lo - (np.cumsum(n) - n), n)]
        line = np.lexsort((i, j - i))
        yield i[line], j[line]
        return
    places = np.sort(own)
    lo = np.searchsorted(ranked, a.items[places], "left")
    n = np.searchsorted(ranked, a.items[places], "right") - lo
    total, x = np.append(0, np.cumsum(n)), 0
    while x < len(places):
        z = max(int(np.searchsorted(total, total[x] + PLACES, "right")) - 1, int(np.searchsorted(places, places[x] + 4 * LEAST)))
        part = slice(x, min(z, len(places)))
        i = np.repeat(places[part], n[part])
        j = at[np.arange(len(i)) + np.repeat(lo[part] - (np.cumsum(n[part]) - n[part]), n[part])]
        line = np.lexsort((i, j - i))
        yield i[line], j[line]
        if z >= len(places):
            return
        x = max(x + 1, int(np.searchsorted(places, places[z] - 2 * LEAST)))


def _places(a: Text, b: Text, met_a: np.ndarray, met_b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places (i, j) of which each text's have to be compared: all of one text with what stands fresh in the other."""
    if not (a.often.any() or b.often.any()):
        yield from _pairs(a, b, met_a, met_b)
        return
    met_a, met_b = _live(a, met_a), _live(b, met_b)
    yield from _pairs(a, b, met_a, met_b & b.fresh)
    yield from _pairs(a, b, met_a & a.fresh, met_b)


def _exact(a: Text, b: Text) -> list[tuple[int, int, int, int]]:
    """Runs of stretches of LEAST items of a that b has too, each with the first place of b that goes on like it."""
    if not len(b.grams):
        return []
    order, ranked = b.by_gram
    at = np.searchsorted(ranked, a.grams)
    hit = np.flatnonzero(ranked[np.minimum(at, len(ranked) - 1)] == a.grams)
    if not len(hit):
        return []
    j = order[at[hit]]
    cut = np.flatnonzero((np.diff(hit) != 1) | (np.diff(j) != 1))
    first, last = np.append(0, cut + 1), np.append(cut, len(hit) - 1)
    return [(int(hit[f]), int(hit[t]) + LEAST, int(j[f]), int(j[t]) + LEAST) for f, t in zip(first, last, strict=True)]


def _similar(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int, int, int]]:
    """The near-duplicate stretches of one run of places (i, j): the whole run, or else the unions of its similar stretches
    of LEAST, each beside the stretch of b that its places lead to."""
    start, stop = int(i[0]), int(i[-1]) + 1
    from_, to = int(j.min()), int(j.max()) + 1
    if stop - start < LEAST:
        return []
    x, y = np.unique(a[start:stop]), np.unique(b[from_:to])
    both = len(np.intersect1d(x, y, assume_unique=True))
    if both >= SIMILARITY * (len(x) + len(y) - both):
        return [(start, stop, from_, to)]
    hit = np.zeros(stop - start, np.int64)
    hit[i - start] = 1
    total = np.append(0, np.cumsum(hit))
    at = np.flatnonzero(total[LEAST:] - total[:-LEAST] >= SIMILARITY * LEAST)
    first, last = total[at], total[at + LEAST] - 1
    shared = last - first + 1
    # what stands before the first and behind the last place in a stands there in b too
    low, high = j[first] - (i[first] - start - at), j[last] + at + LEAST - (i[last] - start)
    near = (high > low) & (shared >= SIMILARITY * (LEAST + high - low - shared) - 1e-9)
    at, low, high = at[near], np.maximum(low[near], from_), np.minimum(high[near], to)
    if not len(at):
        return []
    cut = np.append(0, np.flatnonzero(np.diff(at) > 1) + 1)
    ends = np.append(cut[1:], len(at)) - 1
    return [(start + int(at[f]), start + int(at[t]) + LEAST, int(low[f : t + 1].min()), int(high[f : t + 1].max())) for f, t in zip(cut, ends, strict=True)]


def shared_passages(a: np.ndarray | Text, b: np.ndarray | Text) -> list[tuple[int, int, int, int]]:
    """(start, stop, start, stop) in shingles of a and b: passages that are near-duplicates.

    Every stretch of LEAST shingles that stands in both is taken as it is, so an exact repeat is always found, whatever
    else the texts repeat. Around each unbroken run of CONTEXT or more, the shared shingles of its offset give or take GAP
    are joined over gaps of GAP and checked as sets; where the whole isn't similar enough, its stretches of LEAST are.
    What a text repeats over and over is compared where it stands fresh, and in parts, so memory is bounded without a cap.
    """
    a, b = (x if isinstance(x, Text) else Text(x) for x in (a, b))
    in_a, in_b = np.zeros(len(a.items), bool), np.zeros(len(b.items), bool)
    out: list[tuple[int, int, int, int]] = []

    def add(s: int, z: int, s2: int, z2: int) -> None:
        # what repeats within a text meets in many pairs of places: those that add no place are left out
        if not (in_a[s:z].all() and in_b[s2:z2].all()):
            in_a[s:z] = in_b[s2:z2] = True
            out.append((s, z, s2, z2))

    for found in _exact(a, b):
        add(*found)
    if out:
        for s2, z2, s, z in _exact(b, a):
            add(s, z, s2, z2)
    met_a = a.met(b)
    if not met_a.any():
        return out
    met_b = b.met(a)
    # the widest stretches that a seed can be joined with, whatever its offset
    wide_a, wide_b = _stretches(np.flatnonzero(met_a), GAP), _stretches(np.flatnonzero(met_b), 3 * GAP)
    if all(_full(inside, wide) for inside, wide in ((in_a, wide_a), (in_b, wide_b))):
        return out
    for i, j in _places(a, b, met_a, met_b):
        _seeded(a, b, i, j, in_a, in_b, add)
    return out


def _reaches(i: np.ndarray, j: np.ndarray, start: np.ndarray, d: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(reach of each seed, stretch of a, stretch of b of each reach): what a seed at ``start`` on offset d can be joined with
    at most, as the places (i, j) of all bands of 2 * GAP offsets, without wider gaps than GAP in a."""
    zone = (j - i + GAP) // (2 * GAP)
    zone -= (least := int(zone.min()) - 1)
    seeded = np.zeros(int(zone.max()) + 1, bool)
    seeded[d // (2 * GAP) - least] = True
    own, below = np.flatnonzero(seeded[zone]), np.flatnonzero(seeded[zone - 1])
    cell = np.append(zone[own], zone[below] - 1) * n + np.append(i[own], i[below])
    line = np.argsort(cell)
    cell, line = cell[line], np.append(own, below)[line]
    p, q = i[line], j[line]
    heads = np.append(0, np.flatnonzero((np.diff(cell) > GAP + 1) | (np.diff(p) < 0)) + 1)
    wide_a = np.stack([p[heads], np.append(p[heads[1:] - 1], p[-1]) + 1], axis=1)
    wide_b = np.stack([np.minimum.reduceat(q, heads), np.maximum.reduceat(q, heads) + 1], axis=1)
    return np.searchsorted(cell[heads], (d // (2 * GAP) - least) * n + start, "right") - 1, wide_a, wide_b


def _bands(i: np.ndarray, j: np.ndarray, offsets: np.ndarray, low: np.ndarray, high: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cell, p, q, heads): the places of each band low[k]:high[k] around an offset, by the place of a, and where a run without
    wider gaps than GAP begins. One place of b for each of a, the one nearest to the offset; a cell is k * n + p."""
    size = high - low
    band = np.repeat(np.arange(len(low)), size)
    at = np.arange(len(band)) + np.repeat(low - (np.cumsum(size) - size), size)
    p, q = i[at], j[at]
    off = q - p - offsets[band]
    cell = band * n + p
    line = np.argsort(cell * (2 * GAP + 2) + 2 * np.abs(off) + (off > 0))
    line = line[np.append(True, np.diff(cell[line]) != 0)]
    cell, p, q = cell[line], p[line], q[line]
    heads = np.append(0, np.flatnonzero((np.diff(p) > GAP + 1) | (np.diff(band[line]) != 0)) + 1)
    return cell, p, q, heads


def _seeded(a: Text, b: Text, i: np.ndarray, j: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, add: Callable[[int, int, int, int], None]) -> None:
    """Adds the near-duplicate stretches around the unbroken runs of CONTEXT or more among the places (i, j)."""
    if not len(i):
        return
    offset = j - i
    cut = np.flatnonzero((np.diff(offset) != 0) | (np.diff(i) != 1))
    first, last = np.append(0, cut + 1), np.append(cut, len(i) - 1)
    size = last - first + 1
    seeds = np.flatnonzero(size >= CONTEXT)
    seeds = seeds[np.argsort(-size[seeds], kind="stable")]
    start, d = i[first[seeds]], offset[first[seeds]]
    low, high = np.searchsorted(offset, d - GAP, "left"), np.searchsorted(offset, d + GAP, "right")
    # a seed alone in its band has nothing to be joined with
    left = np.flatnonzero(high - low > size[seeds])
    if not len(left):
        return
    reach, wide_a, wide_b = _reaches(i, j, start, d, n := len(a.items))
    left = left[(wide_a[:, 1] - wide_a[:, 0] >= LEAST)[reach[left]]]
    tried: set[tuple[int, int, int, int]] = set()
    most = FIRST
    while len(left):
        left = left[~(_covered(in_a, wide_a) & _covered(in_b, wide_b))[reach[left]]]
        if not len(left):
            return
        # the longest seeds first, as they often leave nothing to the others
        now = left[: max(1, int(np.searchsorted(np.cumsum(high[left] - low[left]), most, "right")))]
        left, most = left[len(now) :], min(4 * most, PLACES >> 4)
        offsets, where, band = np.unique(d[now], return_index=True, return_inverse=True)
        cell, p, q, heads = _bands(i, j, offsets, low[now[where]], high[now[where]], n)
        ends = np.append(heads[1:], len(p))
        # seeds of one run are one, which comes where the longest of them does
        runs, where = np.unique(np.searchsorted(heads, np.searchsorted(cell, band * n + start[now]), "right") - 1, return_index=True)
        runs = runs[np.argsort(where)]
        runs = runs[p[ends[runs] - 1] + 1 - p[heads[runs]] >= LEAST]
        for x, y in zip(heads[runs].tolist(), ends[runs].tolist(), strict=True):
            whole = (int(p[x]), int(p[y - 1]) + 1, int(q[x:y].min()), int(q[x:y].max()) + 1)
            if whole not in tried and not (in_a[whole[0] : whole[1]].all() and in_b[whole[2] : whole[3]].all()):
                tried.add(whole)
                for found in _similar(a.items, b.items, p[x:y], q[x:y]):
                    add(*found)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, z in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(z, out[-1][1])
        else:
            out.append((s, z))
    return out


# what is cut out of a document for one hub: its runs (key, group size, s, e), and the words around them
_SLICES = "hub long, doc long, tag long, asks int, runs binary, starts binary, texts array<binary>"
_SLICES_KIND = pa.schema([("hub", pa.int64()), ("doc", pa.int64()), ("tag", pa.int64()), ("asks", pa.int32()), ("runs", pa.binary()), ("starts", pa.binary()), ("texts", pa.list_(pa.binary()))])


def _slices(margin: int):
    """For rows (doc, text, wanted(hub, tag, asks, key, n, s, e)): the windows that each hub wants, with ``margin`` around
    them. A wanted key stands for all runs of the text that have it; where s is 0 or more, for [s, e] alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, wants = b.column(0).to_pylist(), b.column(2)
            flat, ends = wants.flatten(), wants.offsets.to_numpy()
            fields = [flat.field(k).to_pylist() for k in range(7)]
            for items, rows, bounds, places, data in _hashed(b.column(1)):
                text, keys, s, e = signatures(items, bounds)
                order = np.lexsort((keys.view(np.int64), text))
                text, keys, s, e = text[order], keys[order].view(np.int64), s[order].tolist(), e[order].tolist()
                of = np.searchsorted(text, np.arange(len(rows) + 1))
                cells: list[list] = [[] for _ in _SLICES_KIND]
                for k, row in enumerate(rows):
                    total, at = int(bounds[k + 1] - bounds[k]), places[k]
                    part = [f[ends[row] - ends[0] : ends[row + 1] - ends[0]] for f in fields]
                    lows, highs = (np.searchsorted(keys[of[k] : of[k + 1]], part[3], side) + of[k] for side in ("left", "right"))
                    runs: dict[int, list[tuple[int, int, int, int]]] = {}
                    about: dict[int, tuple[int, int]] = {}
                    for hub, tag, asks, key, n, a, z, lo, hi in zip(*part, lows.tolist(), highs.tolist(), strict=True):
                        if a < 0:
                            found = [(key, n, s[r], e[r]) for r in range(lo, hi)]
                        else:
                            found = [(key, n, a, z)] if z + LEAST <= total else []
                        if found:
                            runs.setdefault(hub, []).extend(found)
                            about[hub] = tag, max(asks, about.get(hub, (0, 0))[1])
                    for hub, found in runs.items():
                        spans = _merged([(max(0, a - margin), min(total, z + LEAST + margin)) for _, _, a, z in found])
                        cut = [data[at[x] : at[y + SHINGLE - 1]] for x, y in spans]
                        for c, v in zip(cells, (hub, ids[row], *about[hub], np.array(found, np.int64).tobytes(), np.array([x for x, _ in spans], np.int64).tobytes(), cut), strict=True):
                            c.append(v)
                if cells[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, _SLICES_KIND, strict=True)], schema=_SLICES_KIND)

    return run


def _parts(rows: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """For the rows of a group the shingles of all slices, the document's place of each (-1 between slices), and the runs."""
    texts = rows.column("texts").combine_chunks()
    ends = texts.offsets.to_numpy()
    cut = [shingles(words, SHINGLE) for _, words in hashed_texts(texts.flatten().cast(pa.large_string()), ALNUM)]
    items, places, runs, fill = [], [], [], 0
    for k, (starts, own) in enumerate(zip(rows.column("starts").to_pylist(), rows.column("runs").to_pylist(), strict=True)):
        x, at = [], []
        for start, part in zip(np.frombuffer(starts, np.int64), cut[ends[k] - ends[0] : ends[k + 1] - ends[0]], strict=True):
            # items that nothing else has keep the slices apart
            x += [part, mix(np.arange(fill, fill + _APART, dtype=np.uint64) * _U(0xA0761D6478BD642F))]
            at += [np.arange(start, start + len(part)), np.full(_APART, -1)]
            fill += _APART
        items.append(np.concatenate(x))
        places.append(np.concatenate(at))
        runs.append(np.frombuffer(own, np.int64).reshape(-1, 4))
    return items, places, runs


# kinds of the rows that a comparison makes
_PASSAGE, _OPEN, _EDGE = range(3)
_FOUND = "kind int, doc long, other long, start long, stop long, key long, at long"
_COLUMNS = ("kind", "doc", "other", "start", "stop", "key", "at")


def _rows(out: list[tuple[int, ...]]) -> pa.Table:
    found = list(zip(*dict.fromkeys(out), strict=True)) or [[]] * 7
    return pa.table({n: pa.array(v, pa.int32() if n == "kind" else pa.int64()) for n, v in zip(_COLUMNS, found, strict=True)})


def _compared(rows: pa.Table) -> pa.Table:
    """Compares a hub's document with those of one part of its group; rows of _FOUND in shingles.

    Passages of both documents; and the windows of groups of three and more of which no stretch is in a passage (open), or
    some are, then with place and hash of the first one on each side that isn't (edge).
    """
    docs, hub = rows.column("doc").to_numpy(), rows.column("hub")[0].as_py()
    items, places, runs = _parts(rows)
    hubs = [(Text(items[c]), places[c]) for c in np.flatnonzero(docs == hub)]
    out: list[tuple[int, ...]] = []
    of_hub: dict[int, list[tuple[int, int]]] = {}
    for k in np.flatnonzero(docs != hub):
        a, at, doc, spans = Text(items[k]), places[k], int(docs[k]), []
        for b, at_b in hubs:
            for s, z, s2, z2 in shared_passages(a, b):
                spans.append((int(at[s]), int(at[z - 1]) + 1))
                of_hub.setdefault(doc, []).append((int(at_b[s2]), int(at_b[z2 - 1]) + 1))
        spans = _merged(spans)
        out += [(_PASSAGE, doc, hub, s, z, 0, 0) for s, z in spans]
        own = runs[k][runs[k][:, 1] > 2]
        first, last = (np.array([x for x in spans if x[1] - x[0] >= LEAST], np.int64).reshape(-1, 2) - [0, LEAST]).T
        # the first passage that ends behind a window's first stretch decides
        near = np.searchsorted(last, own[:, 2], "left")
        first, last = np.append(first, 1 << 62), np.append(last, 1 << 62)
        x, z = first[near], last[near]
        out += [(_OPEN, doc, hub, s, e, key, 0) for key, _, s, e in own[x > own[:, 3]].tolist()]
        edged = np.flatnonzero((x <= own[:, 3]) & ((x > own[:, 2]) | (z < own[:, 3])))
        where = {int(p): i for i, p in enumerate(at)} if len(edged) else {}
        for key, _, s, e in own[edged].tolist():
            inside = [(x, z) for x, z in zip(first.tolist(), last.tolist(), strict=True) if max(s, x) <= min(e, z)]
            for g in {x - 1 for x, _ in inside if x > s} | {z + 1 for _, z in inside if z < e}:
                if not any(x <= g <= z for x, z in inside) and where.get(g, len(at)) < len(a.grams):
                    out.append((_EDGE, doc, hub, s, e, int(a.grams[where[g]].view(np.int64)), g))
    # the hub's passages with the smallest other document, where they add something
    seen: list[tuple[int, int]] = []
    for doc in sorted(of_hub):
        for s, z in _merged(of_hub[doc]):
            if not any(x <= s and z <= y for x, y in seen):
                out.append((_PASSAGE, hub, doc, s, z, 0, 0))
                seen = _merged([*seen, (s, z)])
    return _rows(out)


#: Shared shingles that a stretch of LEAST different ones must have: a break within one takes SHINGLE - 1 of the other, too.
_SHARED = SIMILARITY * (LEAST + SHINGLE - 1) - 1e-9


def _local(rows: pa.Table) -> pa.Table:
    """Compares the asking windows of each group of several whole ones, or of one pair of a group's blocks, with the others."""
    items, places, runs = _parts(rows)
    hubs = rows.column("hub").to_numpy()
    columns = [rows.column(c).to_numpy() for c in ("asks", "doc", "tag", "side")]
    order = np.argsort(hubs, kind="stable")
    out: list[tuple[int, ...]] = []
    for group in np.split(order, np.flatnonzero(np.diff(hubs[order])) + 1):
        out += _near([items[k] for k in group], [places[k] for k in group], [runs[k] for k in group], *(c[group] for c in columns))
    return _rows(out)


def _distinct(x: np.ndarray) -> int:
    """The least number of different items in a stretch of LEAST of x."""
    order = np.argsort(x, kind="stable")
    before = np.full(len(x), -1)
    before[order[1:]] = np.where(x[order[1:]] == x[order[:-1]], order[:-1], -1)
    return int((np.lib.stride_tricks.sliding_window_view(before, LEAST) < np.arange(len(x) - LEAST + 1)[:, None]).sum(axis=1).min())


def _windows(x: np.ndarray, size: int) -> np.ndarray:
    """How many are true in each stretch of so many columns."""
    total = np.zeros((len(x), x.shape[1] + 1), np.int32)
    np.cumsum(x, axis=1, out=total[:, 1:])
    return total[:, size:] - total[:, :-size]


def _near_starts(j: np.ndarray, where: np.ndarray, plain: np.ndarray, asked: np.ndarray, known: dict[bytes, np.ndarray]) -> np.ndarray:
    """Which stretches of LEAST of different items, at the places ``where``, may be near to one of each other text: by the
    shingles shared, and in a text where none stands twice, by the stretch of it that they span around an unbroken run of
    CONTEXT. A row of j has the items' places in one other text, -1 for those that it lacks; only the stretches that
    ``asked`` names are looked at. ``known`` keeps what was found for what stands alike around a run."""
    held = j >= 0
    near = (_windows(held, LEAST) >= _SHARED) & asked
    rows = np.flatnonzero(near.any(axis=1) & plain)
    if not len(rows):
        return near
    near[rows] = False
    held, asked = held[rows], asked[rows]
    offset = np.where(held, j[rows] - where, 1 << 60)
    on = (offset[:, 1:] == offset[:, :-1]) & held[:, 1:] & (np.diff(where) == 1)
    row, x = np.nonzero(_windows(on, CONTEXT - 1) == CONTEXT - 1)
    if not len(row):
        return near
    lines = np.unique(np.stack([row, offset[row, x]], axis=1), axis=0)
    for at in range(0, len(lines), 256):
        row, d = lines[at : at + 256].T
        off = offset[row] - d[:, None]
        hit = np.abs(off) <= GAP
        enough = _windows(hit, LEAST) >= _SHARED
        able = np.flatnonzero((enough & asked[row]).any(axis=1))
        off = np.where(hit[able], off[able], GAP + 1).astype(np.int8)
        for k, place in zip(able.tolist(), off, strict=True):
            alike = place.tobytes()
            if alike not in known:
                starts, (i,), total = np.flatnonzero(enough[k]), np.nonzero(hit[k]), np.append(0, np.cumsum(hit[k]))
                # a passage goes from a shared place to one, without gaps of more than GAP
                runs = _stretches(i, GAP)
                starts = starts[starts >= runs[0, 0]]
                starts = starts[runs[np.searchsorted(runs[:, 0], starts, "right") - 1, 1] >= starts + LEAST]
                first, last = i[total[starts]], i[total[starts + LEAST] - 1]
                shared, span = total[starts + LEAST] - total[starts], where[last] + place[last] - where[first] - place[first] + LEAST - (last - first)
                known[alike] = starts[shared >= SIMILARITY * (LEAST + span - shared) - 1e-9]
            near[rows[row[k]], known[alike]] = True
    return near


def _near(items: list[np.ndarray], places: list[np.ndarray], runs: list[np.ndarray], asks: np.ndarray, docs: np.ndarray, classes: np.ndarray, side: np.ndarray) -> list[tuple[int, ...]]:
    """Passages between asking windows (runs whose second number is over 0) and the others, by counts of shared shingles and
    then as passages.

    A stretch that has fewer than _SHARED shingles that any other document of the group has is near to none, whatever the
    group's size; the rest meets what its shingles' postings name. A document asks on until each stretch of its open windows
    is in a passage or was held against all that may have one; classes that a pair links are one from then on, and what is
    in passages asks for other classes alone.
    """
    asking, begins, sets = [], [], []
    for x, at, own in zip(items, places, runs, strict=True):
        inside, open_, begin = (np.zeros(len(x), bool) for _ in range(3))
        for _, n, s, e in own.tolist():
            here = (at >= s) & (at < e + LEAST)
            inside |= here
            if n > 0:
                open_ |= here
            if n > 1:
                begin |= (at >= s) & (at <= e)
        asking.append(np.flatnonzero(open_))
        begins.append(begin)
        sets.append(np.unique(x[inside]))
    size = np.array([len(x) for x in sets])
    cols = np.flatnonzero(side != 1)
    every, slot = np.unique(np.concatenate([sets[c] for c in cols] or [np.zeros(0, np.uint64)]), return_inverse=True)
    # the documents of each shingle
    posted = np.repeat(np.arange(len(cols)), size[cols])[np.argsort(slot, kind="stable")]
    often = np.bincount(slot, minlength=len(every))
    heads = np.append(0, np.cumsum(often))
    searched = set(docs[cols].tolist())
    made: dict[int, Text] = {}
    # numbers for all shingles, and the texts in which none stands twice
    names, codes = np.unique(np.concatenate(items), return_inverse=True)
    bounds = np.append(0, np.cumsum([len(x) for x in items]))
    each = np.sort(np.repeat(np.arange(len(items)), np.diff(bounds)) * len(names) + codes)
    single = np.ones(len(items), bool)
    single[each[1:][each[1:] == each[:-1]] // len(names)] = False
    slots = np.full(len(names), -1)
    root = np.unique(classes, return_inverse=True)[1]
    out: list[tuple[int, ...]] = []
    for k in np.flatnonzero((asks > 0) & (side != 2)).tolist():
        where = asking[k]
        if len(where) < LEAST or not len(every):
            continue
        w = items[k][where]
        at = np.minimum(np.searchsorted(every, w), len(every) - 1)
        count = np.where(every[at] == w, often[at], 0) - (int(docs[k]) in searched)
        whole = where[LEAST - 1 :] - where[: 1 - LEAST] == LEAST - 1
        plain = len(np.unique(w)) == len(w)
        if plain:
            total = np.append(0, np.cumsum(count > 0))
            able = np.flatnonzero(whole & (total[LEAST:] - total[:-LEAST] >= _SHARED))
            if not len(able):
                continue
            wanted, need = at[_around(able, LEAST, len(w)) & (count > 0)], _SHARED
        else:
            wanted, need = np.unique(at[count > 0]), SIMILARITY * _distinct(w) - 1e-9
        shared = np.zeros(len(cols), np.int64)
        if len(wanted):
            shared += np.bincount(np.concatenate([posted[heads[i] : heads[i + 1]] for i in wanted.tolist()]), minlength=len(cols))
        near = np.flatnonzero((shared >= need) & (docs[cols] != docs[k]))
        todo = whole & begins[k][where[: 1 - LEAST]]
        own = codes[bounds[k] + where]
        mine = own if plain else np.unique(own)
        slots[mine] = np.arange(len(mine))
        partners, tried, turn, x = cols[near[np.lexsort((docs[cols[near]], -shared[near]))]], set(), 4, 0
        known: dict[bytes, np.ndarray] = {}
        while x < len(partners):
            now = partners[x : x + turn]
            x, turn = x + turn, max(4, min(4 * turn, TURN // len(where)))
            if not todo.any():
                now = now[root[now] != root[k]]
                if not len(now):
                    continue
            froms = np.append(0, np.cumsum(bounds[now + 1] - bounds[now]))
            slot = slots[np.concatenate([codes[bounds[c] : bounds[c + 1]] for c in now.tolist()])]
            if plain:
                at = np.flatnonzero(slot >= 0)
                row = np.searchsorted(froms, at, "right") - 1
                j = np.full((len(now), len(w)), -1)
                j[row, slot[at]] = at - froms[row]
                starts = _near_starts(j, where, single[now], np.where((root[now] == root[k])[:, None], todo, whole), known)
            for r, c in enumerate(now.tolist()):
                same = root[c] == root[k]
                if same and not todo.any() or plain and not ((todo if same else whole) & starts[r]).any():
                    continue
                # what holds the same of the asking windows in the same order has the same passages with them
                held = slot[froms[r] : froms[r + 1]]
                ends = np.flatnonzero(held >= 0)
                alike = held[ends[0] : ends[-1] + 1].tobytes() if len(ends) else b""
                if same and alike in tried:
                    continue
                tried.add(alike)
                for t in (k, c):
                    if t not in made:
                        made[t] = Text(items[t])
                for s, z, s2, z2 in shared_passages(made[k], made[c]):
                    todo = todo & ~((where[: 1 - LEAST] >= s) & (where[LEAST - 1 :] < z))
                    root[root == root[c]] = root[k]
                    out.append((_PASSAGE, int(docs[k]), int(docs[c]), int(places[k][s]), int(places[k][z - 1]) + 1, 0, 0))
                    out.append((_PASSAGE, int(docs[c]), int(docs[k]), int(places[c][s2]), int(places[c][z2 - 1]) + 1, 0, 0))
        slots[mine] = -1
    return out


def _cut(texts: DataFrame, wanted: DataFrame, margin: int) -> DataFrame:
    """The slices of ``texts(doc, text)`` that the rows ``wanted(doc, hub, tag, asks, key, n, s, e)`` name."""
    own = wanted.groupBy("doc").agg(F.collect_list(F.struct("hub", "tag", "asks", "key", "n", "s", "e")).alias("wanted"))
    own = stash(own, "wanted", compact=True)
    return among(texts, own.select("doc"), "doc").join(own, "doc").select("doc", "text", "wanted").mapInArrow(_slices(margin), _SLICES)




def _stars(texts: DataFrame, met: DataFrame) -> DataFrame:
    """Compares the documents of ``met(key, doc, n, hub, s, e)`` with their hubs; rows of _FOUND, stored."""
    shape = met.select("hub", "doc").distinct().groupBy("hub").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    large = stash(shape.where("parts > 1"), "shape", compact=True)
    cut = _cut(texts, met.select("doc", "hub", F.lit(0).cast("long").alias("tag"), F.lit(0).alias("asks"), "key", "n", "s", "e"), MARGIN)
    cut = cut.join(F.broadcast(large) if few(large) else large, "hub", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    # a hub's own slices go to each part of its group, those of any other document to one
    part = F.when(F.col("doc") == F.col("hub"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int")))
    placed = cut.withColumn("part", F.explode(part))
    return stash(placed.groupBy("hub", "part").applyInArrow(_compared, _FOUND), "compared", compact=True)


def _hubs(rows: DataFrame) -> DataFrame:
    """(key, n, hub) of the keys that several documents of ``rows(key, doc)`` have."""
    groups = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("doc").alias("hub"), F.max("doc").alias("last"))
    return groups.where("hub < last").select("key", "n", "hub")


def _spans(passages: DataFrame, reach: int = 0) -> DataFrame:
    """(doc, spans): the merged passages of each document, their stops moved by ``reach``, with the smallest other one."""
    merged = F.expr("""aggregate(spans, cast(array() as array<struct<start:bigint,stop:bigint,other:bigint>>), (acc, x) ->
        case when size(acc) > 0 and element_at(acc, -1).stop >= x.start
             then concat(slice(acc, 1, size(acc) - 1), array(struct(element_at(acc, -1).start as start, greatest(element_at(acc, -1).stop, x.stop) as stop, least(element_at(acc, -1).other, x.other) as other)))
             else concat(acc, array(x)) end)""")
    each = passages.groupBy("doc", "start", "stop").agg(F.min("other").alias("other"))
    return each.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("start", (F.col("stop") + reach).alias("stop"), "other"))).alias("spans")).select("doc", merged.alias("spans"))


def _classes(passages: DataFrame) -> DataFrame:
    return components(passages.select(F.col("doc").alias("u"), F.col("other").alias("v")))


def _rest(texts: DataFrame, met: DataFrame, found: DataFrame, passages: DataFrame) -> DataFrame | None:
    """Passages between windows that a group's hub left open and all others of the group; None if there are none to ask.

    An open window asks if its stretches are in no passage by now or if the group holds several classes. All groups of a hub
    are one, so that a document's windows move and are hashed once for it; one of more than BLOCK documents is compared in
    pairs of blocks, without a cap.
    """
    opens = found.where(F.col("kind") == _OPEN).select("key", "doc", "start", "stop").distinct()
    if not opens.limit(1).count():
        return None
    spans, classes = stash(_spans(passages), "spans", compact=True), stash(_classes(passages), "classes", compact=True)
    inside = F.exists("spans", lambda x: (x["start"] <= F.col("start")) & (F.col("stop") + LEAST <= x["stop"]))
    asks = opens.join(spans, "doc", "left").groupBy("key", "doc").agg(F.bool_and(F.coalesce(inside, F.lit(False))).alias("inside"))
    group = among(met.where("doc <> hub").select("key", "hub", "doc"), stash(opens.select("key").distinct(), "keys", compact=True), "key").distinct()
    group = group.join(classes, F.col("doc") == classes["node"], "left").select("key", "hub", "doc", F.coalesce("component", "doc").alias("class")).join(asks, ["key", "doc"], "left")
    group = stash(group, "group", compact=True)
    shape = group.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.count("*").alias("docs"), F.count_if(~F.col("inside")).alias("out")).where("docs > 1 and (out > 0 or lo < hi)")
    # 2: an open window that no passage reaches, 1: one that may have links to other classes, 0: none that asks
    asking = F.when(~F.col("inside"), 2).when(F.col("inside") & (F.col("lo") < F.col("hi")), 1).otherwise(0)
    group = stash(group.join(shape, "key").select("key", "hub", "doc", "class", asking.alias("asks")), "asking", compact=True)
    if not group.limit(1).count():
        return None
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    sizes = group.groupBy("hub", "doc").agg(F.max("asks").alias("asks")).groupBy("hub").agg(blocks(F.count_if(F.col("asks") > 0)).alias("parts"), blocks(F.count("*")).alias("others"), F.count("*").alias("docs")).where("parts > 0 and docs > 1")
    sizes = stash(sizes, "sizes", compact=True)
    split = stash(sizes.where("others > 1").select("hub", "parts", "others"), "split", compact=True)
    # the second number of a run tells whether its window asks
    wanted = among(group, sizes.select("hub"), "hub").select("doc", "hub", F.col("class").alias("tag"), "asks", "key", F.col("asks").cast("long").alias("n"), F.lit(-1).cast("long").alias("s"), F.lit(-1).cast("long").alias("e"))
    cut = _cut(texts, wanted, 0).join(F.broadcast(split) if few(split) else split, "hub", "left")
    own, each = lambda n: F.pmod(F.xxhash64("doc", F.lit(7)), F.col(n)).cast("int"), lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    # many whole groups are one for the task that compares them
    total = sizes.agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0]
    bundle = F.when(F.col("others").isNull(), F.pmod(F.xxhash64("hub"), F.lit(-(-total // BUNDLE) or 1))).otherwise(F.col("hub"))
    # side 0: a whole group, 1: rows that ask in a pair of blocks, 2: its columns
    place = lambda side, r, c: F.struct(F.lit(side).alias("side"), r.cast("int").alias("r"), c.cast("int").alias("c"))
    as_row = F.when(F.col("asks") > 0, F.transform(each("others"), lambda c: place(1, own("parts"), c))).otherwise(F.array().cast("array<struct<side:int,r:int,c:int>>"))
    as_column = F.transform(each("parts"), lambda r: place(2, r, own("others")))
    at = F.when(F.col("others").isNull(), F.array(place(0, F.lit(-1), F.lit(-1)))).otherwise(F.concat(as_row, as_column))
    placed = cut.withColumn("at", F.explode(at)).select("hub", "doc", "tag", "asks", "runs", "starts", "texts", bundle.alias("bundle"), "at.*")
    return placed.groupBy("bundle", "r", "c").applyInArrow(_local, _FOUND)


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, n_dup_words, class_id, copy_of, spans) for each document of ``docs(doc_id, text)`` with a repeated passage.

    Words are those of op5's class. A passage is WORDS words or more that another document has too, exactly or with a
    similarity of its 5-word shingles of SIMILARITY or more. ``spans`` are the merged word ranges [start, stop) of the
    document, each with the smallest doc_id that it was found in; ``class_id`` is the smallest doc_id that is reached
    over shared passages. Documents without such a passage give no row.

    Documents with equal texts are one node: copies are returned with the smallest such doc_id in ``copy_of`` (null for
    that document itself) and their whole text as span, if it has WORDS words.

    1. The Cartesian trees of HASHES min-hash functions part each document's shingles into compact windows; the windows of
       BAND trees at a time are joined as intervals into runs of stretches that share all their minima (a signature).
    2. Documents with an equal signature are a group. Each is compared with the group's smallest document, the hub; only
       the words around the shared windows move. An exact repeat of WORDS words always meets, near ones mostly.
    3. A window that no passage reaches, or that stands among several classes, is compared with its whole group, unless each
       of its stretches has more shingles that nobody else in the group has than a near repeat may have. A window that a
       passage leaves at one side meets those that have the same next stretch (an exact repeat that is longer than what
       both share with the hub), round by round, until none is left. There is no cap.

    Null or short texts have no passages. Rows without a doc_id take no part. Rows of a repeated doc_id are one document,
    of which the texts count in turn; equal rows are one. Repeats within one document don't count. A very long text is
    cut like any other; what one repeats over and over is compared once for all equal surroundings.
    An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark, 250)
    own = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), F.col("text")).alias("t2"))
    each = stash(own.groupBy("doc_id", "t1", "t2").agg(F.count("*").alias("rows")), "each", compact=True)
    copies = stash(each.groupBy("t1", "t2").agg(F.min("doc_id").alias("doc"), F.count("*").alias("n")).where("n > 1"), "copies", compact=True)
    members = each.join(copies, ["t1", "t2"], "left").select("doc_id", "t1", "t2", F.coalesce("doc", "doc_id").alias("doc"), F.coalesce("n", F.lit(1)).alias("n"))
    members = stash(members, "members", compact=True)
    texts = apart(own, members.where("doc_id <> doc").select("doc_id", "t1", "t2"))
    if each.where("rows > 1").limit(1).count():
        texts = texts.dropDuplicates(["doc_id", "t1", "t2"])
    texts = texts.select(F.col("doc_id").alias("doc"), "text")

    rows, path = stash_at(texts.mapInArrow(_keys, "key long, doc long"), "rows")
    small_batches(spark, 50_000)
    met = stash(rows.repartition("key").sortWithinPartitions("key", "doc").mapInArrow(_shared_keys, "key long, doc long, n long, hub long"), "met", compact=True)
    unstash(spark, path)
    small_batches(spark, 250)
    found = _stars(texts, met.select("*", F.lit(-1).cast("long").alias("s"), F.lit(-1).cast("long").alias("e")))
    passages = found.where(F.col("kind") == _PASSAGE).select("doc", "other", "start", "stop")
    more = _rest(texts, met, found, passages)
    if more is not None:
        passages = passages.union(stash(more, "rest", compact=True).select("doc", "other", "start", "stop"))
    while found is not None:
        spans = stash(_spans(passages), "spans", compact=True)
        known = F.coalesce(F.exists("spans", lambda x: (x["start"] <= F.col("at")) & (F.col("at") + LEAST <= x["stop"])), F.lit(False))
        edges = found.where(F.col("kind") == _EDGE).join(spans, "doc", "left").where(~known).select("key", "doc", F.col("start").alias("s"), F.col("stop").alias("e")).distinct()
        edges = stash(edges, "edges", compact=True)
        met = stash(edges.join(_hubs(edges.select("key", "doc").distinct()), "key"), "met", compact=True)
        found = _stars(texts, met) if met.limit(1).count() else None
        if found is not None:
            passages = passages.union(found.where(F.col("kind") == _PASSAGE).select("doc", "other", "start", "stop"))

    small_batches(spark)
    classes = stash(_classes(passages), "classes", compact=True)
    per_doc = _spans(passages, SHINGLE - 1).join(classes, F.col("doc") == classes["node"], "left").select("doc", "spans", F.coalesce("component", "doc").alias("class_id"))
    copied = members.where("n > 1").select("doc").distinct()
    lengths = among(texts, stash(copied, "copied", compact=True), "doc").select("doc", F.regexp_count(F.lower("text"), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")).cast("long").alias("whole"))
    # filtered behind the aggregate, as Spark would count the words of all texts if it moved the filter before the join
    lengths = lengths.groupBy("doc").agg(F.max("whole").alias("whole")).where(F.col("whole") >= WORDS)
    joined = members.join(per_doc, "doc", "left").join(lengths.withColumnRenamed("doc", "d"), (F.col("doc") == F.col("d")) & (F.col("n") > 1), "left").where("spans is not null or whole is not null")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("whole").alias("stop"), F.col("doc").alias("other")))
    chosen = F.when(F.col("whole").isNotNull(), whole).otherwise(F.col("spans"))
    out = joined.select("doc_id", chosen.alias("spans"), F.coalesce("class_id", "doc").alias("class_id"), F.when(F.col("doc_id") != F.col("doc"), F.col("doc")).alias("copy_of"))
    words = F.expr("aggregate(spans, 0L, (n, x) -> n + x.stop - x.start)")
    out = out.groupBy("doc_id").agg(F.max_by("spans", F.struct(words, "class_id")).alias("spans"), F.min("class_id").alias("class_id"), F.min("copy_of").alias("copy_of"))
    return out.select("doc_id", words.alias("n_dup_words"), "class_id", "copy_of", "spans")
