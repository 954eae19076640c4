"""Benchmark decontamination by the q-gram lemma.

A benchmark item of m normalised characters is sought in each whole document
with up to k edits (k: ``rate`` of m).  Such an occurrence keeps at least
``m + 1 - q - k * q`` of the item's q-grams, on diagonals (document position
minus item position) that lie within k of each other.  Shared q-grams are
counted in diagonal bands of width 2 (k + 1) that overlap by half, so that one band
holds all of them; regions that reach the bound are verified by banded
alignment, many at a time, and given up once every diagonal has passed the budget.
Of two bands that overlap one is aligned, over the diagonals of both.  Nothing
within k edits is missed.  Items of fewer than q characters have no q-gram: they are sought
exactly, as whole words.

Normalised: lower case, runs of anything but letters and digits are one space.

The benchmark is the stated query set; it goes to the tasks in blocks of at
most ``block_chars`` characters, each block against all documents.  Very long texts are
searched in windows that overlap by more than an occurrence can take.  Defined
results: null and empty texts hold nothing; items without letters and digits hold
nothing to find; equal items are each reported; repeated rows are searched one by one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOUND = "array<struct<item_id:long,edits:int,shared:int>>"
_GAP = re.compile(r"[\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_TABLE_BITS = 22


def normalised(text: str) -> str:
    return _GAP.sub(" ", text.lower()).strip()


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(chars: np.ndarray, q: int) -> np.ndarray:
    """Polynomial hash of each q-gram, built by doubling its length."""
    one = chars.astype(np.uint64) + np.uint64(1)
    if len(one) < q:
        return np.zeros(0, np.uint64)
    h, n, power = one, 1, _BASE
    with np.errstate(over="ignore"):
        for bit in bin(q)[3:]:
            h, n, power = h[:-n] * power + h[n:], 2 * n, power * power
            if bit == "1":
                h, n, power = h[:-1] * _BASE + one[n:], n + 1, power * _BASE
        return h * _BASE


@dataclass(frozen=True)
class Profile:
    """The q-grams of a block of benchmark items, with their places."""
    q: int
    ids: np.ndarray          # by item
    chars: tuple             # code points by item
    budget: np.ndarray       # edits allowed
    need: np.ndarray         # q-grams that must be shared
    grams: np.ndarray        # sorted distinct hashes
    offsets: np.ndarray      # postings of each
    item: np.ndarray
    place: np.ndarray
    short: tuple = ()        # (normalised text, id) of items without a q-gram

    def table(self) -> np.ndarray:
        bits = np.zeros(1 << _TABLE_BITS, bool)
        bits[self.grams >> np.uint64(64 - _TABLE_BITS)] = True
        return bits


def profile(items: list[tuple[int, str]], q: int = 10, rate: float = 0.08) -> Profile:
    clean = [(i, normalised(t or "")) for i, t in items]
    known = [(i, codes(t)) for i, t in clean if len(t) >= q]
    size = np.array([len(c) for _, c in known], np.int64)
    budget = np.minimum((size * rate).astype(np.int64), (size - q) // q)
    hashes = [gram_hashes(c, q) for _, c in known]
    every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    item = np.repeat(np.arange(len(known)), [len(h) for h in hashes])
    place = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.zeros(0, np.int64)
    order = np.argsort(every, kind="stable")
    grams, first = np.unique(every[order], return_index=True)
    return Profile(q, np.array([i for i, _ in known], np.int64), tuple(c for _, c in known), budget,
                   size + 1 - q - budget * q, grams, np.append(first, len(every)), item[order], place[order],
                   tuple((t, i) for i, t in clean if 0 < len(t) < q))


def banded_edits(item: np.ndarray, chars: np.ndarray, begin: np.ndarray, size: np.ndarray, low: np.ndarray, width: int, most: int,
                 cells: int = 1 << 18) -> np.ndarray:
    """Fewest edits between the item and a piece of each text, over ``width`` diagonals (text - item position) from ``low`` on.

    A text is ``size`` characters of ``chars`` from ``begin``.  Texts that pass ``most`` edits on every diagonal are given up: they get ``most + 1``.
    """
    out = np.full(len(low), most + 1, np.int64)
    along = np.arange(width, dtype=np.int32)
    reach = np.arange(len(item) + width - 1)
    step = max(1, cells // len(reach))
    for at in range(0, len(low), step):
        rows = np.arange(at, min(at + step, len(low)))
        spot = low[rows, None] + reach
        inside = (spot >= 0) & (spot < size[rows, None])
        text = np.where(inside, chars[np.where(inside, begin[rows, None] + spot, 0)], np.uint32(0))     # no normalised text holds 0
        start = low[rows, None] + along
        best = np.where((start < 0) | (start > size[rows, None]), np.int32(len(item) + 1), np.int32(0)).astype(np.int32)
        for i, c in enumerate(item):
            cost = best + (text[:, i:i + width] != c)
            np.minimum(cost[:, :-1], best[:, 1:] + 1, out=cost[:, :-1])
            best = np.minimum.accumulate(cost - along, axis=1) + along
            if i % 16 == 15:
                alive = best.min(axis=1) <= most
                if not alive.all():
                    rows, text, best = rows[alive], text[alive], best[alive]
                    if not len(rows):
                        break
        if len(rows):
            out[rows] = np.minimum(best.min(axis=1), most + 1)
    return out


def _shares(p: Profile, count: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Ranges of items such that the hits (``count`` by q-gram) have at most ``limit`` postings in each, or the range is one item."""
    if not len(p.item):
        return []
    by_item = np.bincount(p.item, weights=np.repeat(count, np.diff(p.offsets)), minlength=len(p.ids))
    out, start, total = [], 0, 0.0
    for i, n in enumerate(by_item.tolist()):
        if i > start and total + n > limit:
            out.append((start, i))
            start, total = i, 0.0
        total += n
    return [*out, (start, len(by_item))]


def _regions(p: Profile, table: np.ndarray, chars: np.ndarray, starts: np.ndarray, piece: int = 1 << 20,
             limit: int = 1 << 18) -> np.ndarray:
    """Rows (document, item, band, shared q-grams) that reach the bound; documents lie behind each other in ``chars``.

    At most about ``limit`` postings are expanded at a time: those of several documents, of one document, or of a range
    of its items, so that many items or documents behind one frequent passage stay within memory.
    """
    spots, which = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if not len(p.grams):
        return np.zeros((0, 4), np.int64)
    for at in range(0, len(chars), piece):
        h = gram_hashes(chars[at:at + piece + p.q - 1], p.q)
        maybe = np.nonzero(table[h >> np.uint64(64 - _TABLE_BITS)])[0]
        slot = np.minimum(np.searchsorted(p.grams, h[maybe]), len(p.grams) - 1)
        hit = p.grams[slot] == h[maybe]
        spots.append(maybe[hit] + at)
        which.append(slot[hit])
    spot, gram = np.concatenate(spots), np.concatenate(which)
    count = p.offsets[gram + 1] - p.offsets[gram]
    doc = np.searchsorted(starts, spot, "right") - 1
    bounds = np.nonzero(np.concatenate(([True], doc[1:] != doc[:-1], [True])))[0] if len(doc) else np.zeros(1, np.int64)
    total = np.concatenate(([0], np.cumsum(count)))
    out, first = [np.zeros((0, 4), np.int64)], 0
    while first < len(bounds) - 1:
        last = max(first + 1, int(np.searchsorted(total[bounds], total[bounds[first]] + limit, "right")) - 1)
        here = slice(bounds[first], bounds[last])
        own = (p, starts, doc[here], spot[here], gram[here])
        out.append(_counted(*own, p.offsets[gram[here]], count[here]) if total[bounds[last]] - total[bounds[first]] <= limit else _by_items(*own, limit))
        first = last
    rows = np.concatenate(out)
    return rows[np.lexsort(rows[:, 2::-1].T)]


def _by_items(p: Profile, starts: np.ndarray, doc: np.ndarray, spot: np.ndarray, gram: np.ndarray, limit: int) -> np.ndarray:
    """``_counted`` of one document, for a range of items at a time."""
    out = [np.zeros((0, 4), np.int64)]
    owner = np.repeat(np.arange(len(p.grams)), np.diff(p.offsets))       # postings by q-gram, then by item
    key = owner * len(p.ids) + p.item
    for first, end in _shares(p, np.bincount(gram, minlength=len(p.grams)), limit):
        begin = np.searchsorted(key, gram * len(p.ids) + first)
        inside = np.searchsorted(key, gram * len(p.ids) + end) - begin
        some = inside > 0
        out.append(_counted(p, starts, doc[some], spot[some], gram[some], begin[some], inside[some]))
    return np.concatenate(out)


def _counted(p: Profile, starts: np.ndarray, doc: np.ndarray, spot: np.ndarray, gram: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The rows of ``_regions`` for hits at ``spot`` with ``count`` postings from ``begin`` on."""
    if not count.sum():
        return np.zeros((0, 4), np.int64)
    posting = np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())
    item, place = p.item[posting], p.place[posting]
    band = np.repeat(spot - starts[doc], count) - place
    band //= p.budget[item] + 1
    # one number a (document, item, band, place): pairs densely numbered, bands counted from the least one
    pairs, pair = np.unique(np.repeat(doc, count) * len(p.ids) + item, return_inverse=True)
    least, places = int(band.min()) - 1, int(place.max()) + 1
    bands = int(band.max()) - least + 1
    key = (pair * bands + (band - least)) * places + place
    key = np.concatenate((key, key - places))                            # each posting lies in two bands
    key.sort()
    key = key[np.concatenate(([True], key[1:] != key[:-1]))] // places   # a place counts once in a band
    first = np.nonzero(np.concatenate(([True], key[1:] != key[:-1])))[0]
    shared = np.diff(np.append(first, len(key)))
    of = pairs[key[first] // bands]
    keep = shared >= p.need[of % len(p.ids)]
    return np.stack((of // len(p.ids), of % len(p.ids), key[first] % bands + least, shared), axis=1)[keep]


def _covering(rows: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Stretches to align: up to three neighbouring bands of one document and item (first, number), with the most shared q-grams among them."""
    out, i, every = [], 0, rows.tolist()
    while i < len(every):
        doc, item, band, shared = every[i]
        n = 1
        while n < 3 and i + n < len(every) and every[i + n][:3] == [doc, item, band + n]:
            shared = max(shared, every[i + n][3])
            n += 1
        out.append((doc, item, band, n, shared))
        i += n
    return out


def _search(p: Profile, table: np.ndarray, texts: list[str], window: int = 1 << 16) -> list[list[dict]]:
    """Found items of each normalised text."""
    most = max((len(c) + int(k) for c, k in zip(p.chars, p.budget, strict=True)), default=0)
    window = max(window, 4 * most)
    parts = [(i, at) for i, t in enumerate(texts) for at in range(0, max(1, len(t) - most), window - most)]
    pieces = [texts[i][at:at + window] for i, at in parts]
    chars = codes("\0".join(pieces))
    sizes = np.array([len(t) for t in pieces], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    best: list[dict] = [{} for _ in texts]
    stretches: dict[tuple[int, int], list] = {}
    for doc, item, band, bands, shared in _covering(_regions(p, table, chars, starts)):
        stretches.setdefault((item, bands), []).append((doc, band, shared))
    for (item, bands), found in stretches.items():
        doc, band, shared = np.array(found, np.int64).T
        k = int(p.budget[item])
        edits = banded_edits(p.chars[item], chars, starts[doc], sizes[doc], band * (k + 1), (bands + 1) * (k + 1), k)
        for d, e, s in zip(doc[edits <= k].tolist(), edits[edits <= k].tolist(), shared[edits <= k].tolist(), strict=True):
            own = best[parts[d][0]]
            own[item] = min(own.get(item, (e, -s)), (e, -s))
    out = [[{"item_id": int(p.ids[i]), "edits": e, "shared": -s} for i, (e, s) in sorted(b.items())] for b in best]
    if p.short:
        automaton = ahocorasick.Automaton()
        for t, i in p.short:
            automaton.add_word(f" {t} ", [*automaton.get(f" {t} ", []), int(i)])
        automaton.make_automaton()
        for t, found in zip(texts, out, strict=True):
            hits = sorted({i for _, ids in automaton.iter(f" {t} ") for i in ids})
            found += [{"item_id": i, "edits": 0, "shared": 0} for i in hits]
    return out


def find(text: Column, p: Profile, slice_chars: int = 1 << 20) -> Column:
    """array of (item_id, edits, shared q-grams) of the items that each text holds."""
    shape = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32()), ("shared", pa.int32())]))

    @F.arrow_udf(FOUND)
    def run(texts: pa.Array) -> pa.Array:
        table, out, waiting, size = p.table(), [], [], 0
        for value in texts:
            waiting.append(normalised(value.as_py() or ""))
            size += len(waiting[-1])
            if size >= slice_chars:
                out += _search(p, table, waiting)
                waiting, size = [], 0
        if waiting:
            out += _search(p, table, waiting)
        return pa.array(out, shape)
    return run(text) if len(p.ids) or p.short else F.array().cast(FOUND)


def profiles(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", block_chars: int = 4_000_000, **settings) -> list[Profile]:
    """The benchmark in blocks, in order of id; null texts are left out."""
    out, block, size = [], [], 0
    for r in benchmark.select(item_id, text).dropna().orderBy(item_id, text).toLocalIterator():
        block.append((r[0], r[1]))
        size += len(r[1])
        if size >= block_chars:
            out.append(profile(block, **settings))
            block, size = [], 0
    return [*out, profile(block, **settings)] if block or not out else out


def contamination(text: Column, found_in: list[Profile]) -> Column:
    """All items that each text holds, over every block of the benchmark."""
    return F.concat(*[find(text, p) for p in found_in])
