"""SimHash near-duplicates with pivot distance tables.

A 64-bit fingerprint per text (word shingles, XXH64, majority per bit); texts
are linked when their fingerprints differ in at most ``distance`` bits, and a
component is the closure of links.  Equal fingerprints collapse first, so
groups of copies cost one row.

Linking: ``distance`` differing bits touch at most that many of
``blocks`` bit blocks, so linked fingerprints agree on some choice of
``blocks - distance`` of them: those choices are the buckets (exact, nothing
is missed).  Each distinct fingerprint has a table of Hamming distances
to reference fingerprints (pivots), computed once and carried to its buckets; a pair whose tables differ by more than
``distance`` in any coordinate is discarded, survivors are compared bit by bit.
Buckets over ``tile`` members are dealt into hashed tiles and pairs of tiles, so no
task holds an unbounded group, and each group returns a spanning star, not pairs.

Defined results: null and empty texts have fingerprint zero and link like any
other; fewer words than a shingle give one shingle; repeated rows and ids are
kept; a component of null ids only has a null id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopcast.llm.common import cut, fresh
from shopcast.llm.components import components

SEED = 42
PIVOTS = np.random.default_rng(7).integers(0, 2 ** 64, 24, dtype=np.uint64)


def fingerprint_of(raw: bytes, shingle: int = 3, piece: int = 65536) -> int:
    """Signed 64-bit SimHash of one UTF-8 text."""
    words = raw.lower().split()          # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    width = min(shingle, len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[:len(words) - width + 1]
    stops = ends[width - 1:]
    votes = np.zeros(64, np.int64)
    for at in range(0, len(starts), piece):
        spans = zip(starts[at:at + piece].tolist(), stops[at:at + piece].tolist(), strict=True)
        hashes = np.array([xxhash.xxh64_intdigest(joined[i:j], SEED) for i, j in spans], np.uint64)
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(starts), bitorder="little").view(np.int64)[0])


def fingerprint(text: Column, shingle: int = 3) -> Column:
    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint_of(x.as_buffer().to_pybytes(), shingle) for x in texts], pa.int64())
    return run(F.coalesce(text, F.lit("")))


def block_masks(blocks: int, kept: int) -> list[int]:
    """Signed masks of every choice of ``kept`` of the ``blocks`` bit blocks."""
    bounds = np.linspace(0, 64, blocks + 1).astype(int)
    single = [((1 << (b - a)) - 1) << a for a, b in zip(bounds, bounds[1:], strict=False)]
    masks = [sum(choice) for choice in combinations(single, kept)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def pivot_table(fp: Column) -> list[Column]:
    """Hamming distances to the pivots, eight to a long, one byte each."""
    signed = [int(p) - (1 << 64) if int(p) >> 63 else int(p) for p in PIVOTS]

    def packed(pivots: list[int]) -> Column:
        byte = [F.call_function("shiftleft", F.bit_count(fp.bitwiseXOR(F.lit(p))).cast("long"), F.lit(8 * i)) for i, p in enumerate(pivots)]
        return reduce(lambda x, y: x.bitwiseOR(y), byte)
    return [packed(signed[i:i + 8]).alias(f"pivots{i // 8}") for i in range(0, len(signed), 8)]


def _close(a: np.ndarray, b: np.ndarray, ta: np.ndarray, tb: np.ndarray, distance: int) -> np.ndarray:
    """Whether fingerprints (broadcast against each other) are linked: pivot tables (one more axis) first, then the bits."""
    shape = np.broadcast_shapes(a.shape, b.shape)
    left = np.ones(shape, bool)
    for i in range(6):                         # whole table rows while most pairs still fall
        left &= np.abs(ta[..., i] - tb[..., i]) <= distance
    at = np.nonzero(left)
    full = (*shape, ta.shape[-1])
    x, y = np.broadcast_to(ta, full)[at], np.broadcast_to(tb, full)[at]
    keep = (np.abs(x[:, 6:] - y[:, 6:]) <= distance).all(axis=1)
    at = tuple(i[keep] for i in at)
    near = np.bitwise_count(np.broadcast_to(a, shape)[at] ^ np.broadcast_to(b, shape)[at]) <= distance
    out = np.zeros(shape, bool)
    out[tuple(i[near] for i in at)] = True
    return out


def _star(members: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars (member, centre) of the links between positions i and j."""
    label = np.arange(len(members))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.nonzero(label != np.arange(len(members)))[0]
    return members[moved], members[label[moved]]


def _group_links(fp: np.ndarray, table: np.ndarray, side: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one group: among all members, or between the two tiles where there are two."""
    if side.min() == side.max():
        i, j = np.nonzero(np.triu(_close(fp[:, None], fp[None, :], table[:, None], table[None, :], distance), 1))
        return _star(fp, i, j)
    one, two = np.nonzero(side == side.min())[0], np.nonzero(side == side.max())[0]
    i, j = np.nonzero(_close(fp[one][:, None], fp[two][None, :], table[one][:, None], table[two][None, :], distance))
    return _star(fp, one[i], two[j])


def _links(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (bucket, tile): a group's rows are consecutive; the last group waits for more rows."""
    tables = tuple(f"pivots{i}" for i in range(len(PIVOTS) // 8))
    names = ("bucket", "tile", "side", "fp", *tables)
    rest = [np.zeros(0, np.int64)] * len(names)

    def found(cols: list[np.ndarray]) -> pa.RecordBatch:
        bucket, tile, side, fp = cols[:4]
        fp = fp.view(np.uint64)
        table = np.stack(cols[4:], axis=1).view(np.int8)                 # distances are at most 64
        bounds = np.nonzero(np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (tile[1:] != tile[:-1]), [True])))[0]
        starts, sizes = bounds[:-1], np.diff(bounds)
        a, b = [], []
        for size in np.unique(sizes[(sizes > 1) & (sizes <= 8)]):
            at = starts[sizes == size][:, None] + np.arange(size)
            rows, own = fp[at], table[at]
            i, j = np.triu_indices(size, 1)
            near = _close(rows[:, i], rows[:, j], own[:, i], own[:, j], distance)
            a.append(rows[:, i][near])
            b.append(rows[:, j][near])
        for s, n in zip(starts[sizes > 8], sizes[sizes > 8], strict=True):
            x, y = _group_links(fp[s:s + n], table[s:s + n], side[s:s + n], distance)
            a.append(x)
            b.append(y)
        cat = [np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for x in (a, b)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in cat], names=["a", "b"])

    for batch in batches:
        cols = [np.concatenate((r, batch.column(n).to_numpy(zero_copy_only=False))) for r, n in zip(rest, names, strict=True)]
        same = np.nonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))[0] if len(cols[0]) else []
        cutoff = int(same[-1]) + 1 if len(same) else 0
        rest = [c[cutoff:] for c in cols]
        if cutoff:
            yield found([c[:cutoff] for c in cols])
    if len(rest[0]):
        yield found(rest)


def links(fingerprints: DataFrame, distance: int = 3, blocks: int = 6, tile: int = 2048) -> DataFrame:
    """(a, b) pairs that span the linked distinct values of column ``fp``."""
    masks = block_masks(blocks, blocks - distance)
    tables = [f"pivots{i}" for i in range(len(PIVOTS) // 8)]
    told = fingerprints.select("fp", *pivot_table(F.col("fp")))
    keyed = told.select("fp", *tables, F.explode(F.array(*[
        F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)])).alias("bucket"))
    sizes = keyed.select("bucket").groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    tiles = F.ceil(F.col("n") / tile)
    members = (keyed.join(sizes, "bucket").select("bucket", "fp", *tables, tiles.alias("tiles"), F.pmod(F.xxhash64("fp", F.lit(1)), tiles).alias("side"))
               .select("bucket", "fp", *tables, "side", "tiles", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("other"))
               .select("bucket", (F.least("side", "other") * F.col("tiles") + F.greatest("side", "other")).alias("tile"), "side", "fp", *tables))
    dealt = members.repartition("bucket", "tile").sortWithinPartitions("bucket", "tile")
    return dealt.mapInArrow(lambda batches: _links(batches, distance), "a long, b long")


def grouped(docs: DataFrame, text: str, doc_id: str, shingle: int, distance: int, keep: tuple[Column, ...] = ()) -> DataFrame:
    """doc_id, fingerprint, label (of the component) and component_id for every row, and the columns ``keep``.

    The text is read once; ids, fingerprints and ``keep`` are materialised.
    """
    names = [doc_id, "fp", "label", "component_id"]
    rows = cut(docs.select(F.col(doc_id), fingerprint(F.col(text), shingle).alias("fp"), *keep))
    distinct = cut(rows.groupBy("fp").agg(F.min(doc_id).alias("first_id")))
    groups = components(links(distinct.select("fp"), distance))
    labelled = distinct.join(groups, distinct.fp == groups.v, "left").select("fp", "first_id", F.coalesce("label", "fp").alias("label"))
    smallest = labelled.groupBy("label").agg(F.min("first_id").alias("component_id"))
    of = labelled.join(smallest, "label").select("fp", "label", "component_id")
    return rows.join(of, "fp").select(*names, *[c for c in rows.columns if c not in names])


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3,
                    distance: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest id reachable) for every row."""
    rows = grouped(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", "doc_id", shingle, distance)
    return rows.select(F.col("doc_id").alias(doc_id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3, distance: int = 3) -> DataFrame:
    """One row of each component, with all its columns: the smallest id (null last), then the smallest text hash.

    Rows are told apart by id and text hash; rows equal in both are repeats, of
    which one stays.  The text goes through one shuffle, to meet the decisions.
    """
    th, key, none = (fresh(docs.columns, x) for x in ("_text_hash", "_key", "_no_id"))
    told = docs.withColumns({th: F.xxhash64(F.coalesce(text, F.lit(""))), key: F.coalesce(F.xxhash64(doc_id), F.lit(0)),
                             none: F.col(doc_id).isNull()})
    rows = grouped(told.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(th).alias("text_hash"),
                               F.col(key).alias("key"), F.col(none).alias("no_id")),
                   "text", "doc_id", shingle, distance, (F.col("text_hash"), F.col("key"), F.col("no_id")))
    first = rows.groupBy("label").agg(F.min(F.struct("no_id", "doc_id", "text_hash", "key")).alias("m"))
    kept = first.select(F.col("m.key").alias(key), F.col("m.no_id").alias(none), F.col("m.text_hash").alias(th))
    return told.join(kept, [key, none, th]).dropDuplicates([key, none, th]).select(*docs.columns)
