"""Trie of the shared prefixes of conversations, by a splitter skeleton.

A conversation is the sequence of its turns' digests.  Sampled splitters range
the conversations, in order of sequence and id, into shards, so every subtree of the
trie is one stretch of neighbouring rows.  The trie of the splitters' own paths, the
skeleton, is broadcast: only its nodes can reach into more than one shard.  Each
shard is sorted and walked once with a stack of open nodes.  It finishes all
nodes outside the skeleton by itself; for skeleton nodes it returns partial
aggregates, which a reduction combines, with subtree sums taken over the
skeleton's preorder numbers.

A group of equal conversations spans as many shards as its size needs.  What
lies in one place: the digests of one conversation (some 40 bytes a turn), the
path of open nodes and the finished children of open nodes of one shard, the
skeleton (splitters times their turns).  Texts are hashed where they are read.
The ids that end at a skeleton node pass through one digest as a stream of chunks.

Defined results: turns are ordered by turn number (null first), then role, then
digest, so tied and repeated rows are all turns; null roles and texts count as
empty; rows without a conversation id belong to none; no conversations give no nodes; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopcast.llm.common import cut
from shopcast.llm.ranges import default_shards, shard_of, splitters

KEY = "struct<path:array<binary>,conv_id:bigint>"
NODES = ("skel int, above int, conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
         "saved_tokens long, chars long, ends string, shard int, part int")
NOTHING = hashlib.sha256(b"").hexdigest()
CHUNK_IDS = 4096


def turn_sequences(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id and its turns in order, each with digest and code points of the text."""
    said = F.coalesce(F.col(role), F.lit(""))
    body = F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.char_length(said).cast("string"), F.lit(":"), said, body).cast("binary"), 256))
    one = F.struct(F.col(turn).alias("turn"), said.alias("role"), digest.alias("digest"), F.char_length(body).cast("long").alias("chars"))
    named = rows.filter(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv_id"), one.alias("one"))
    ordered = named.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns"))
    return ordered.select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["chars"].alias("chars"))).alias("turns"))


def rebuilt(sequences: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Every conversation c begins with the first h turns of conversation c - c % ``every``, then its own after its first h.

    h is crc32 of the decimal c, modulo ``most``.
    """
    c = F.col("conv_id")
    heads = sequences.filter(c % every == 0).select(c.alias("first"), F.slice("turns", 1, most - 1).alias("head"))
    given = sequences.withColumns({"h": (F.crc32(c.cast("string").cast("binary")) % most).cast("int"), "first": c - c % every})
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    begun = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    return given.join(heads, "first", "left").select("conv_id", F.concat(begun, own).alias("turns"))


class Skeleton:
    """Trie of the splitters' paths: nodes in preorder with parent, depth and end of their subtree."""

    def __init__(self, paths: list[list[bytes]]):
        self.root = (0, {})
        self.parent, self.depth, self.kids, self.end = [-1], [0], [0], [0]
        for path in sorted(paths):                     # in order, so new nodes come in preorder
            node = self.root
            for digest in path:
                if digest not in node[1]:
                    node[1][digest] = (len(self.parent), {})
                    self.parent.append(node[0])
                    self.depth.append(self.depth[node[0]] + 1)
                    self.kids.append(0)
                    self.end.append(0)
                    self.kids[node[0]] += 1
                node = node[1][digest]
        for i in range(len(self.parent) - 1, -1, -1):
            self.end[i] = max(self.end[i], i)
            if i:
                self.end[self.parent[i]] = max(self.end[self.parent[i]], self.end[i])


class _Node:
    """An open node of a shard's walk."""
    __slots__ = ("digest", "chars", "skel", "n", "least", "kids", "leaves", "saved", "ends", "waiting")

    def __init__(self, digest: bytes, chars: int, skel):
        self.digest, self.chars, self.skel = digest, chars, skel
        self.n, self.least, self.kids, self.leaves, self.saved = 0, None, 0, 0, 0
        self.ends, self.waiting = ([] if skel else None), []


def _walk(batches: Iterator[pa.RecordBatch], root: tuple) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (shard, path, conv_id) to rows of nodes: finished ones, partial ones of the skeleton, chunks of its ids."""
    names = [f.split(" ")[0] for f in NODES.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    shape = pa.schema([(f.split(" ")[0], kinds[f.split(" ")[1]]) for f in NODES.split(", ")])
    out: list[tuple] = []
    stack: list[_Node] = []
    shard, part = None, 0

    def chunk(node: _Node) -> None:
        nonlocal part
        out.append((node.skel[0], None, None, None, None, None, None, None, None, None, ",".join(map(str, node.ends)), shard, part))
        part += 1
        node.ends = []

    def close() -> None:
        node = stack.pop()
        above = stack[-1] if stack else None
        if node.skel:
            if node.ends:
                chunk(node)
            for row in node.waiting:                    # the smallest member may lie in another shard
                out.append((None, node.skel[0], *row, None, None))
            out.append((node.skel[0], None, node.least, None, None, node.n, node.kids, node.leaves, node.saved, node.chars, None, None, None))
        else:
            leaves, saved = node.leaves + (not node.kids), node.saved + (node.n - 1) * node.chars
            ends = node.ends.hexdigest() if node.ends else NOTHING
            out.extend((None, None, r[0], r[1], node.least, *r[3:], None, None) for r in node.waiting)
            above.waiting.append((node.least, len(stack), None, node.n, node.kids, leaves, saved, node.chars, ends))
            above.kids, above.leaves, above.saved = above.kids + 1, above.leaves + leaves, above.saved + saved
        if above:
            above.n += node.n
            above.least = node.least if above.least is None or node.least < above.least else above.least

    def finished(most: int) -> Iterator[pa.RecordBatch]:
        if len(out) > most:
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, shape.field(n).type) for c, n in zip(columns, names, strict=True)], schema=shape)
            out.clear()

    for batch in batches:
        rows = zip(*[batch.column(n).to_pylist() for n in ("shard", "path", "chars", "conv_id")], strict=True)
        for at, path, chars, conv in rows:
            if at != shard:
                while stack:
                    close()
                shard, part = at, 0
                stack.append(_Node(b"", 0, root))
            same = 0
            while same < len(path) and same + 1 < len(stack) and stack[same + 1].digest == path[same]:
                same += 1
            while len(stack) > same + 1:
                close()
            for i in range(same, len(path)):
                skel = stack[-1].skel
                stack.append(_Node(path[i], chars[i], skel and skel[1].get(path[i])))
            node = stack[-1]
            node.n += 1
            node.least = conv if node.least is None or conv < node.least else node.least
            if node.skel:
                node.ends.append(conv)
                if len(node.ends) >= CHUNK_IDS:
                    chunk(node)
                # children that a skeleton node has finished need not wait
                if len(node.waiting) > CHUNK_IDS:
                    out.extend((None, node.skel[0], *row, None, None) for row in node.waiting)
                    node.waiting = []
            elif node.ends is None:
                node.ends = hashlib.sha256(str(conv).encode())
            else:
                node.ends.update(b",%d" % conv)
            for open_node in stack[:same + 1]:
                if open_node.skel and len(open_node.waiting) > CHUNK_IDS:
                    out.extend((None, open_node.skel[0], *row, None, None) for row in open_node.waiting)
                    open_node.waiting = []
            yield from finished(20_000)
    while stack:
        close()
    yield from finished(0)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest a skeleton node from its chunks of ids, which come in order."""
    at, digest, done = None, None, []
    for batch in batches:
        for skel, ends in zip(batch.column("skel").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if skel == at:
                digest.update(b",")
            else:
                if digest:
                    done.append((at, digest.hexdigest()))
                at, digest = skel, hashlib.sha256()
            digest.update(ends.encode())
    if digest:
        done.append((at, digest.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int32()), pa.array([d[1] for d in done], pa.string())],
                                     names=["skel", "digest"])


def _combined(walked: DataFrame, skeleton: Skeleton) -> DataFrame:
    """The skeleton's nodes from the shards' partial aggregates; tables of one row a skeleton node."""
    spark = walked.sparkSession
    shape = spark.createDataFrame(list(zip(range(len(skeleton.parent)), skeleton.parent, skeleton.depth, skeleton.kids, skeleton.end, strict=True)),
                                  "skel int, parent int, depth int, skel_kids int, last int")
    partial = walked.filter("skel is not null and part is null").groupBy("skel").agg(
        F.min("conv_id").alias("conv_id"), F.max("chars").alias("chars"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    kids = F.col("n_children") + F.col("skel_kids")
    whole = cut(partial.join(shape, "skel").select(
        "skel", "parent", "depth", "last", "conv_id", "n_convs", kids.alias("n_children"),
        (F.col("n_leaves") + (kids == 0).cast("int")).alias("own_leaves"),
        (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("chars")).alias("own_saved")))
    upto = Window.orderBy("skel").rowsBetween(Window.unboundedPreceding, 0)
    summed = whole.withColumns({"leaves_to": F.sum("own_leaves").over(upto), "saved_to": F.sum("own_saved").over(upto)})
    at_last = summed.select(F.col("skel").alias("last"), F.col("leaves_to").alias("last_leaves"), F.col("saved_to").alias("last_saved"))
    parents = whole.select(F.col("skel").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    chunks = walked.filter("part is not null").select("skel", "shard", "part", "ends")
    digests = chunks.repartition("skel").sortWithinPartitions("skel", "shard", "part").mapInArrow(_digests, "skel int, digest string")
    return (summed.join(at_last, "last").join(parents, "parent", "left").join(digests, "skel", "left").select(
        "skel", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("last_leaves") - F.col("leaves_to") + F.col("own_leaves")).alias("n_leaves"),
        (F.col("last_saved") - F.col("saved_to") + F.col("own_saved")).alias("saved_tokens"),
        F.coalesce("digest", F.lit(NOTHING)).alias("ends_sha256")))


def prefix_trie(sequences: DataFrame, shards: int | None = None) -> DataFrame:
    """One row a node of the trie of ``sequences`` (conv_id, turns); see the module and ``turn_sequences``.

    conv_id (smallest member), depth, parent_conv_id (null: root), n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256.  ``shards`` is the session's number of shuffle partitions unless given.
    """
    spark = sequences.sparkSession
    shards = shards or default_shards(spark)
    rows = cut(sequences.select("conv_id", F.col("turns.digest").alias("path"), F.col("turns.chars").alias("chars")))
    key = F.struct("path", "conv_id")
    keys = splitters(rows, key, F.lit(1.0) + F.size("path"), shards)
    paths = [[base64.b64decode(d) for d in k.get("path", [])] for k in json.loads(keys)]
    skeleton = Skeleton(paths)
    shared = spark.sparkContext.broadcast(skeleton.root)
    dealt = rows.withColumn("shard", shard_of(key, KEY, keys, len(paths)).cast("int")).repartition(shards, "shard")
    ordered = dealt.sortWithinPartitions("shard", "path", "conv_id")
    walked = cut(ordered.mapInArrow(lambda batches: _walk(batches, shared.value), NODES))
    top = cut(_combined(walked, skeleton))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    above = top.select(F.col("skel").alias("above"), F.col("conv_id").alias("above_id"))
    inner = walked.filter("skel is null").withColumnRenamed("ends", "ends_sha256").join(above, "above", "left")
    inner = inner.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above_id"))
    return inner.select(*names).unionByName(top.select(*names)).withColumn("depth", F.col("depth").cast("long"))
