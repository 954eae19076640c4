"""SentencePiece encoding and decoding over a relational lattice.

Texts are escaped (space to U+2581, one in front) and split into words that no
piece of the table crosses: before a run of U+2581 and behind a run of letters.
For the words, Spark explodes all substrings up to the longest piece,
equi-joins them to the piece table (broadcast up to ``BROADCAST_PIECES``), groups the edges by word and folds them with ``aggregate``: the
Viterbi recursion over positions, then the way back.  Characters without a piece
become byte pieces.

The words of the code book are the most frequent ones, at most ``book_words``,
counted over the whole corpus.  Rarer words
and words over ``longest_word`` characters go through the same recursion inside
the task, so every text is encoded whole and alike.

Inside tasks words are cut in columns: the class of every character (letter,
space, other) from one table, a cut wherever the pattern ``WORD`` has one.  The
words stay slices of the text; only the different ones of some 4 MB of text are counted or looked up.

On ties the piece that starts first wins.  The segmentation is the one of
highest total score.  A table made by merges (its scores are ranks) has a
segmentation of its own, in merge order: ``fold="merges"`` folds the same
edges that way, best rank first, leftmost on ties.  Defined results: null and empty texts have no
pieces and decode to empty text; a literal U+2581 decodes as a space.
"""

from __future__ import annotations

import heapq
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopcast.llm.common import cut

SPACE = "▁"
WORD = SPACE + r"*[^\p{L}" + SPACE + r"]*\p{L}*"
UNKNOWN = -1
BROADCAST_PIECES = 1 << 18      # a larger piece table is joined as Spark chooses
SIDE_BY_SIDE = 64               # longer words are folded one by one


@dataclass(frozen=True)
class Vocabulary:
    """Piece table: text pieces with id and score, the ids of the 256 byte pieces, all pieces as UTF-8 hex."""
    pieces: dict[str, tuple[int, float]]
    byte_ids: tuple[int, ...]
    hexes: tuple[str, ...]

    @property
    def longest(self) -> int:
        return max(map(len, self.pieces), default=1)

    @property
    def unknown_score(self) -> float:
        return min((s for _, s in self.pieces.values()), default=0.0) - 10.0


@lru_cache(maxsize=4)
def vocabulary(model_file: str) -> Vocabulary:
    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces, byte_ids, hexes = {}, [0] * 256, []
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(p[3:5], 16)] = i
            hexes.append(p[3:5])
        elif sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i):
            hexes.append("")
        else:
            pieces[p] = (i, sp.get_score(i))
            hexes.append(p.encode().hex())
    crossing = regex.compile(r"\p{L}[^\p{L}" + SPACE + r"]|[^" + SPACE + r"]" + SPACE)
    if any(crossing.search(p) for p in pieces):
        raise ValueError("a piece crosses the word boundaries used here")
    return Vocabulary(pieces, tuple(byte_ids), tuple(hexes))


def lattice(words: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(word, edges): per distinct ``word`` its edges (end, start, id, score), sorted by end, then start."""
    spark = words.sparkSession
    table = spark.createDataFrame([(p, i, s) for p, (i, s) in vocab.pieces.items()], "piece string, id int, score double")
    at = words.repartition("word").select("word", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("start"))
    spans = at.select("word", "start", F.explode(F.sequence(
        F.lit(1), F.least(F.lit(vocab.longest), F.length("word") - F.col("start")))).alias("n"))
    parts = spans.withColumn("piece", F.substr("word", F.col("start") + 1, F.col("n")))
    small = len(vocab.pieces) <= BROADCAST_PIECES
    edges = parts.join(F.broadcast(table) if small else table, "piece", "left").filter("id is not null or n = 1")
    edge = F.struct((F.col("start") + F.col("n")).alias("end"), "start", F.coalesce("id", F.lit(UNKNOWN)).alias("id"),
                    F.coalesce("score", F.lit(vocab.unknown_score)).alias("score"))
    return edges.groupBy("word").agg(F.sort_array(F.collect_list(edge)).alias("edges"))


def viterbi(edges: Column) -> Column:
    """Nodes by position: the best score up to it, the start of its last edge and that edge's id."""
    kind = "struct<score:double,start:int,id:int>"

    def step(nodes: Column, e: Column) -> Column:
        reached = F.struct((F.get(nodes, e["start"])["score"] + e["score"]).alias("score"), e["start"].alias("start"), e["id"].alias("id"))
        better = reached["score"] > F.get(nodes, e["end"])["score"]
        return (F.when(F.size(nodes) == e["end"], F.concat(nodes, F.array(reached)))
                .when(better, F.concat(F.slice(nodes, F.lit(1), e["end"]), F.array(reached))).otherwise(nodes))
    return F.aggregate(edges, F.array(F.struct(F.lit(0.0), F.lit(-1), F.lit(UNKNOWN)).cast(kind)), step)


def bytes_of(char: Column, vocab: Vocabulary) -> Column:
    """Ids of the byte pieces of one character."""
    byte_ids = F.split(F.lit(",".join(map(str, vocab.byte_ids))), ",").cast("array<int>")
    raw = F.hex(F.encode(char, "UTF-8"))
    return F.transform(F.sequence(F.lit(0), (F.length(raw) / 2).cast("int") - 1), lambda i: F.get(
        byte_ids, F.conv(F.substr(raw, (2 * i + 1).cast("int"), F.lit(2)), 16, 10).cast("int")))


def best_ids(word: Column, nodes: Column, vocab: Vocabulary) -> Column:
    """Ids on the best path; characters without a piece as their bytes."""
    def back(state: Column, _: Column) -> Column:
        node = F.get(nodes, state["at"])
        as_bytes = bytes_of(F.substr(word, state["at"], F.lit(1)), vocab)
        ids = F.when(node["id"] == UNKNOWN, as_bytes).otherwise(F.array(node["id"]))
        return F.when(state["at"] <= 0, state).otherwise(
            F.struct(node["start"].alias("at"), F.concat(ids, state["ids"]).alias("ids")))
    start = F.struct((F.size(nodes) - 1).alias("at"), F.array().cast("array<int>").alias("ids"))
    return F.aggregate(nodes, start, back)["ids"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once: inside lambdas Spark repeats what is written twice."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def merged(word: Column, edges: Column) -> Column:
    """Bounds of the pieces left when neighbours are joined, best score first, until no joint piece is known."""
    scores = F.map_from_entries(F.transform(edges, lambda e: F.struct(e["start"] * 64 + e["end"], e["score"])))

    def joined(bounds: Column, scores: Column) -> Column:
        joint = F.transform(F.sequence(F.lit(0), F.size(bounds) - 3), lambda i: F.struct(
            F.element_at(scores, F.get(bounds, i) * 64 + F.get(bounds, i + 2)).alias("score"), (-i).alias("at")))
        return let(F.array_max(joint), lambda best: F.when(best["score"].isNull(), bounds).otherwise(
            F.concat(F.slice(bounds, F.lit(1), 1 - best["at"]), F.slice(bounds, 3 - best["at"], F.size(bounds)))))

    def step(state: Column, _: Column) -> Column:
        bounds = F.when(state["done"] | (F.size(state["bounds"]) < 3), state["bounds"]).otherwise(joined(state["bounds"], state["scores"]))
        return let(bounds, lambda b: F.struct(b.alias("bounds"), state["scores"].alias("scores"),
                                              (F.size(b) == F.size(state["bounds"])).alias("done")))
    start = F.struct(F.sequence(F.lit(0), F.length(word)).alias("bounds"), scores.alias("scores"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.length(word)), start, step)["bounds"]


def ids_between(word: Column, bounds: Column, edges: Column, vocab: Vocabulary) -> Column:
    """Ids of the pieces between bounds; characters without a piece as their bytes."""
    ids = F.map_from_entries(F.transform(edges, lambda e: F.struct(e["start"] * 64 + e["end"], e["id"])))

    def listed(both: Column) -> Column:
        def one(i: Column) -> Column:
            a, b = F.get(both["bounds"], i), F.get(both["bounds"], i + 1)
            return let(F.element_at(both["ids"], a * 64 + b), lambda known: F.when(
                known == UNKNOWN, bytes_of(F.substr(word, a + 1, F.lit(1)), vocab)).otherwise(F.array(known)))
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(both["bounds"]) - 2), one))
    return let(F.struct(bounds.alias("bounds"), ids.alias("ids")), listed)


OTHER, LETTER, BLANK = range(3)


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """Class of every code point: a letter, a space (or U+2581), or another."""
    found = np.full(0x110000, OTHER, np.uint8)
    for m in regex.finditer(r"\p{L}+", np.arange(len(found), dtype="<u4").tobytes().decode("utf-32-le", "surrogatepass")):
        found[m.start():m.end()] = LETTER
    found[[ord(" "), ord(SPACE)]] = BLANK
    return found


def _ends(words: pa.StringArray) -> np.ndarray:
    """Where each word begins in the array's bytes, and the end."""
    return np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1]


def cut_words(texts: pa.Array) -> tuple[pa.StringArray, np.ndarray]:
    """The words (``WORD``) of all texts behind each other, spaces as they stand, and the number of the first word of each text and of the end.

    Every text that is not empty gets a space in front; null and empty texts have no words.
    """
    given = pc.fill_null(texts.cast(pa.string()), "")
    joined = pc.if_else(pc.equal(pc.binary_length(given), 0), "", pc.binary_join_element_wise("", given, " "))
    _, ends, held = joined.buffers()
    borders = np.frombuffer(ends, np.int32)[:len(joined) + 1] if len(joined) else np.zeros(1, np.int32)
    if borders[-1] == 0:
        return pa.array([], pa.string()), np.zeros(len(joined) + 1, np.int64)
    raw, classes = np.frombuffer(held, np.uint8)[:borders[-1]], character_classes()
    kind = classes[:256][raw]
    leads = np.flatnonzero(raw >= 0xC0)
    for size, low, high in ((2, 0xC0, 0xE0), (3, 0xE0, 0xF0), (4, 0xF0, 0x100)):
        at = leads[(raw[leads] >= low) & (raw[leads] < high)]
        point = (raw[at] & (0x7F >> size)).astype(np.int32)
        for i in range(1, size):
            point = point << 6 | raw[at + i] & 0x3F
        for i in range(size):               # bytes that go on are of their character's class, so no cut parts them
            kind[at + i] = classes[point]
    cuts = np.zeros(len(raw) + 1, bool)
    cuts[1:-1] = (kind[1:] == BLANK) & (kind[:-1] != BLANK) | (kind[1:] == OTHER) & (kind[:-1] == LETTER)
    cuts[borders] = True
    starts = np.flatnonzero(cuts).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), held), np.searchsorted(starts, borders)


def portions(texts: pa.Array, size: int = 1 << 22) -> Iterator[pa.Array]:
    """The texts in order, some ``size`` bytes at a time; a longer one is whole, too."""
    before = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // size
    borders = [0, *(np.flatnonzero(np.diff(before)) + 1).tolist(), len(texts)]
    for i, j in zip(borders[:-1], borders[1:], strict=True):
        if j > i:
            yield texts.slice(i, j - i)


PACKED = "bucket int, words binary, ends binary, counts binary"


def _buckets(words: pa.StringArray, buckets: int) -> np.ndarray:
    """Bucket of each word, by a polynomial in its bytes."""
    ends = _ends(words)
    raw = np.frombuffer(words.buffers()[2], np.uint8)[ends[0]:ends[-1]].astype(np.uint64) + np.uint64(1)
    sizes = np.diff(ends)
    powers = np.cumprod(np.full(sizes.max(), 0x9E3779B97F4A7C15, np.uint64))
    raw *= powers[np.arange(len(raw), dtype=np.int32) - np.repeat(ends[:-1] - ends[0], sizes)]
    mixed = np.add.reduceat(raw, ends[:-1] - ends[0]) * np.uint64(0xD6E8FEB86659FD93)
    return ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _packed(words: Counter | pa.Table, longest_word: int, buckets: int) -> pa.RecordBatch:
    """Counted words, or a table of them (word, count), as one row a bucket: the words' bytes behind each other, where each ends, their counts."""
    if not isinstance(words, pa.Table):
        words = pa.table({"word": pa.array(list(words), pa.string()), "count": pa.array(list(words.values()), pa.int64())})
    size = pc.utf8_length(words["word"])
    words = words.filter(pc.and_(pc.greater(size, 0), pc.less_equal(size, longest_word))).combine_chunks()
    rows = []
    if len(words):
        bucket = _buckets(words["word"].chunk(0), buckets)
        order = np.argsort(bucket, kind="stable")
        bucket, words = bucket[order], words.take(order).combine_chunks()
        own, counts = words["word"].chunk(0), words["count"].to_numpy()
        offsets, joined = _ends(own), own.buffers()[2].to_pybytes()
        firsts = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
        for i, j in zip(firsts, [*firsts, len(own)][1:], strict=True):
            rows.append((int(bucket[i]), joined[offsets[i]:offsets[j]], (offsets[i + 1:j + 1] - offsets[i]).tobytes(), counts[i:j].tobytes()))
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["bucket", "words", "ends", "counts"])


def _added(tables: list[pa.Table]) -> pa.Table:
    """(word, count) with every word once."""
    summed = pa.concat_tables(tables).group_by("word", use_threads=False).aggregate([("count", "sum")])
    return summed.select(["word", "count_sum"]).rename_columns(["word", "count"])


def _summed(batches: Iterator[pa.RecordBatch], waiting_rows: int = 1 << 20, least_rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """(word, count) of packed rows sorted by bucket.

    Words are added up at the end of a bucket with which ``least_rows`` wait, and before whenever as many wait as would double
    them (``waiting_rows`` at least).
    """
    bucket, waiting, size, limit = None, [], 0, waiting_rows
    for batch in batches:
        of, *packed = batch.columns
        for row, b in enumerate(of.to_pylist()):
            if b != bucket and size >= least_rows:
                yield from _added(waiting).to_batches(max_chunksize=1 << 16)
                waiting, size, limit = [], 0, waiting_rows
            bucket = b
            words, ends, counts = (c[row].as_buffer() for c in packed)
            offsets = np.concatenate((np.zeros(1, np.int32), np.frombuffer(ends, np.int32)))
            word = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), words)
            waiting.append(pa.table({"word": word, "count": pa.array(np.frombuffer(counts, np.int64))}))
            size += len(word)
            if size >= limit:
                waiting = [_added(waiting)]
                size = len(waiting[0])
                limit = max(waiting_rows, 2 * size)
    if waiting:
        yield from _added(waiting).to_batches(max_chunksize=1 << 16)


def word_counts(docs: DataFrame, text: str, longest_word: int, held: int = 1 << 19, buckets: int = 4096) -> DataFrame:
    """(word, count) of the words of up to ``longest_word`` characters.

    Each portion of texts is counted as a column; a task adds the portions' counts up when over ``held`` wait, and sends them if
    over half as many are left.  Words travel packed, a row for each bucket, and a bucket's words are added up in one task.
    Spark hands rows to Python by number, so ``buckets`` is high enough for some 3 kB a row.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, rows = [], 0
        for batch in batches:
            for texts in portions(batch.column(0)):
                found = cut_words(texts)[0].value_counts()
                waiting.append(pa.table({"word": pc.replace_substring(found.field(0), " ", SPACE), "count": found.field(1)}))
                rows += len(found)
                if rows > held:
                    waiting = [_added(waiting)]
                    rows = len(waiting[0])
                    if rows > held // 2:
                        yield _packed(waiting[0], longest_word, buckets)
                        waiting, rows = [], 0
        if waiting:
            yield _packed(_added(waiting), longest_word, buckets)
    packed = docs.select(F.col(text).alias("text")).mapInArrow(run, PACKED)
    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_summed, "word string, count long")


def code_book(docs: DataFrame, text: str, vocab: Vocabulary, fold: str = "viterbi", book_words: int = 1 << 18,
              longest_word: int = 48) -> DataFrame:
    """(word, ids) of the most frequent words, at most ``book_words`` of them."""
    counts = cut(word_counts(docs, text, longest_word))
    bins = counts.groupBy(F.floor(F.log2("count") * 8).alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()
    lowest, total = None, 0
    for r in sorted(bins, key=lambda r: -r["bin"]):
        total += r["n"]
        if total > book_words:
            break
        lowest = r["bin"]
    chosen = counts.filter(F.lit(False) if lowest is None else F.floor(F.log2("count") * 8) >= lowest).select("word")
    edges = lattice(chosen, vocab)
    if fold == "merges":
        bounds = edges.select("word", "edges", merged(F.col("word"), F.col("edges")).alias("bounds"))
        return bounds.select("word", ids_between(F.col("word"), F.col("bounds"), F.col("edges"), vocab).alias("ids"))
    paths = edges.select("word", viterbi(F.col("edges")).alias("nodes"))
    return paths.select("word", best_ids(F.col("word"), F.col("nodes"), vocab).alias("ids"))


def beginnings(pieces: dict[str, tuple[int, float]]) -> dict[str, tuple[int, float, bool]]:
    """Every beginning of a piece with id and score (UNKNOWN if it is no piece) and whether a longer piece begins with it."""
    longer = {p[:i] for p in pieces for i in range(1, len(p))}
    return {b: (*pieces.get(b, (UNKNOWN, 0.0)), b in longer) for b in longer | pieces.keys()}


def fold_word(word: str, begun: dict[str, tuple[int, float, bool]], byte_ids: tuple[int, ...], unknown: float) -> list[int]:
    """The same recursion for one word: best score, start and id by position, then the way back.

    ``begun`` are the ``beginnings`` of the pieces, so a substring that begins none ends the search.
    """
    n, get = len(word), begun.get
    score, start, label = [0.0] + [-1e300] * n, [0] * (n + 1), [UNKNOWN] * (n + 1)
    for i in range(n):
        here, j = score[i], i + 1
        known = get(word[i])
        if (known is None or known[0] == UNKNOWN) and here + unknown > score[j]:
            score[j], start[j], label[j] = here + unknown, i, UNKNOWN
        while known is not None:
            piece, gain, more = known
            if piece != UNKNOWN and here + gain > score[j]:
                score[j], start[j], label[j] = here + gain, i, piece
            if not more or j == n:
                break
            j += 1
            known = get(word[i:j])
    out, at = [], n
    while at:
        if label[at] == UNKNOWN:
            out += [byte_ids[b] for b in reversed(word[start[at]:at].encode())]
        else:
            out.append(label[at])
        at = start[at]
    out.reverse()
    return out


class Beginnings:
    """The beginnings of all pieces as columns: each is reached from the one that is a character shorter."""

    def __init__(self, pieces: dict[str, tuple[int, float]]):
        begun = beginnings(pieces)
        number = {"": 0} | {b: i for i, b in enumerate(begun, 1)}
        keys = np.array([number[b[:-1]] * 0x110000 + ord(b[-1]) for b in begun], np.int64)
        order = np.argsort(keys)
        self.keys, self.reached = np.append(keys[order], np.iinfo(np.int64).max), np.append(order + 1, 0)
        self.ids = np.array([UNKNOWN, *(i for i, _, _ in begun.values())], np.int32)
        self.scores = np.array([0.0, *(s for _, s, _ in begun.values())])
        self.longer = np.array([True, *(more for _, _, more in begun.values())])

    def step(self, at: np.ndarray, points: np.ndarray) -> np.ndarray:
        """The beginnings one character on; 0 if there is none."""
        key = at * 0x110000 + points
        place = np.searchsorted(self.keys, key)
        return np.where(self.keys[place] == key, self.reached[place], 0)


def fold_words(words: pa.StringArray, begun: Beginnings, byte_ids: tuple[int, ...], unknown: float) -> pa.ListArray:
    """``fold_word`` for many words, none of them empty, side by side.

    Characters stand by position, then by word, longest word first, so those of a position are one stretch.  The node behind
    character c is ``n + c``, the n nodes before them are the words' beginnings.
    """
    if not len(words):
        return pa.array([], pa.list_(pa.int32()))
    n, ends = len(words), _ends(words)
    text = words.buffers()[2].to_pybytes()[ends[0]:ends[-1]].decode()
    points, sizes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64), pc.utf8_length(words).to_numpy()
    order = np.argsort(-sizes, kind="stable")
    first, size = (np.cumsum(sizes) - sizes)[order], sizes[order]
    live = np.searchsorted(-size, -np.arange(size[0] + 1), side="left")        # words with a character at each position
    base = np.concatenate(([0], np.cumsum(live[:-1])))
    chars = np.concatenate([points[first[:k] + i] for i, k in enumerate(live[:-1])])
    position = np.repeat(np.arange(size[0]), live[:-1])
    word = np.arange(len(chars)) - base[position]
    after = np.where(word < live[position + 1], base[position + 1] + word, -1)

    start = end = np.arange(len(chars))
    at, levels = np.zeros(len(chars), np.int64), []
    while len(start):
        at = begun.step(at, chars[end])
        known = begun.ids[at] != UNKNOWN
        if not levels:                          # a character that is no piece becomes its bytes
            levels.append((start, end + n, begun.ids[at], np.where(known, begun.scores[at], unknown)))
        else:
            levels.append((start[known], end[known] + n, begun.ids[at[known]], begun.scores[at[known]]))
        on = np.flatnonzero((at > 0) & begun.longer[at] & (after[end] >= 0))
        start, end, at = start[on], after[end[on]], at[on]

    score = np.full(n + len(chars), -1e300)
    score[:n] = 0.0
    origin, label = np.zeros(len(score), np.int64), np.full(len(score), UNKNOWN, np.int32)
    bounds = [np.searchsorted(level[0], base).tolist() for level in levels]
    for i in range(size[0]):
        before = n + base[i - 1] - base[i] if i else 0
        for level, bound in zip(levels, bounds, strict=True):
            a, b = bound[i], bound[i + 1]
            if a < b:
                start, end, ids, gains = (column[a:b] for column in level)
                reached = score[start + before] + gains
                better = np.flatnonzero(reached > score[end])
                end = end[better]
                score[end], origin[end], label[end] = reached[better], start[better] + before, ids[better]

    node, steps = n + base[size - 1] + np.arange(n), []
    word = order
    while len(node):
        steps.append((word, node))
        node = origin[node]
        on = node >= n
        node, word = node[on], word[on]
    word, node = (np.concatenate(column[::-1]) for column in zip(*steps, strict=True))
    node = node[np.argsort(word, kind="stable")]
    ids, point = label[node], chars[node - n]
    width = np.where(ids == UNKNOWN, 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000), 1)
    behind = np.cumsum(width)
    out, raw_ids = np.repeat(ids, width), np.array(byte_ids, np.int32)
    spelt = np.flatnonzero(ids == UNKNOWN)
    if len(spelt):
        raw = np.frombuffer(point[spelt].astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        out[out == UNKNOWN] = raw_ids[raw]
    firsts = np.concatenate(([0], np.cumsum(np.bincount(np.sort(word), minlength=n))))
    return pa.ListArray.from_arrays(pa.array(np.append(0, behind)[firsts], pa.int32()), pa.array(out, pa.int32()))


def merge_word(word: str, pieces: dict[str, tuple[int, float]], byte_ids: tuple[int, ...]) -> list[int]:
    """Merge order for one word: neighbours are joined, best score first, leftmost on ties.

    Joints wait in a heap by score and place; neighbours are linked, so a long word takes n log n steps.
    """
    parts: list[str | None] = list(word)
    n = len(parts)
    after, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []

    def joint(i: int, j: int) -> None:
        known = pieces.get(parts[i] + parts[j])
        if known is not None:
            heapq.heappush(heap, (-known[1], i, j, len(parts[i]), len(parts[j])))
    for i in range(n - 1):
        joint(i, i + 1)
    while heap:
        _, i, j, left, right = heapq.heappop(heap)
        if parts[i] is None or after[i] != j or len(parts[i]) != left or len(parts[j]) != right:
            continue                            # one of the two has been joined since
        parts[i], parts[j] = parts[i] + parts[j], None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            joint(i, after[i])
        if before[i] >= 0:
            joint(before[i], i)
    return [i for p in parts if p is not None for i in ((pieces[p][0],) if p in pieces else [byte_ids[b] for b in p.encode()])]


def coder(book: pa.Table, vocab: Vocabulary, fold: str = "viterbi", cached_words: int = 1 << 16) -> Callable[[pa.Array], pa.ListArray]:
    """The function from texts to their ids: the different words of a portion are looked up in the book (word, ids) or folded.

    Viterbi folds words of up to ``SIDE_BY_SIDE`` characters together; the others and merges go word by word.
    """
    begun, unknown, byte_ids = beginnings(vocab.pieces), vocab.unknown_score, vocab.byte_ids
    columns = Beginnings(vocab.pieces)
    cache: dict[str, bytes] = {}
    empty = pa.array([], pa.list_(pa.int32()))
    known = pa.concat_arrays([pa.array([], pa.string()), *book["word"].cast(pa.string()).chunks])
    lists = pa.concat_arrays([empty, *book["ids"].cast(empty.type).chunks])

    def folded(word: str) -> bytes:
        found = cache.get(word)
        if found is None:
            ids = merge_word(word, vocab.pieces, byte_ids) if fold == "merges" else fold_word(word, begun, byte_ids, unknown)
            found = array("i", ids).tobytes()
            if len(cache) >= cached_words:
                cache.clear()
            cache[word] = found
        return found

    def coded(texts: pa.Array) -> pa.ListArray:
        words, firsts = cut_words(texts)
        different = words.dictionary_encode()
        own = pc.replace_substring(different.dictionary, " ", SPACE)
        place = pc.index_in(own, value_set=known)
        missing, row = place.is_null().to_numpy(zero_copy_only=False), pc.fill_null(place, 0).to_numpy().copy()
        together = missing & (pc.utf8_length(own).to_numpy() <= SIDE_BY_SIDE) & (fold != "merges")
        alone, together = np.flatnonzero(missing & ~together), np.flatnonzero(together)
        blocks = [fold_words(own.take(pa.array(together[i:i + (1 << 14)])), columns, byte_ids, unknown) for i in range(0, len(together), 1 << 14)]
        bytes_alone = [folded(w) for w in own.take(pa.array(alone)).to_pylist()]
        ends = np.cumsum([0, *map(len, bytes_alone)]) // 4
        singles = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(bytes_alone), np.int32)))
        ids = pa.concat_arrays([lists, *blocks, singles])
        row[together] = len(known) + np.arange(len(together))
        row[alone] = len(known) + len(together) + np.arange(len(alone))
        at = row[different.indices.to_numpy()]
        ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.diff(ids.offsets.to_numpy())[at], dtype=np.int64)))
        return pa.ListArray.from_arrays(pa.array(ends[firsts], pa.int32()), ids.take(pa.array(at)).flatten())
    return lambda texts: pa.concat_arrays([empty, *map(coded, portions(texts))])


def encode(docs: DataFrame, model_file: str, text: str = "text", out: str = "ids", fold: str = "viterbi",
           cached_words: int = 1 << 16, **book) -> DataFrame:
    """Add the piece ids of a text column to every row; ``fold`` is ``viterbi`` or ``merges``.

    Words that are not in the book are folded in the task; of those folded one by one it remembers ``cached_words``.
    """
    vocab = vocabulary(model_file)
    shared = docs.sparkSession.sparkContext.broadcast(code_book(docs, text, vocab, fold, **book).toArrow().combine_chunks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(shared.value, vocab, fold, cached_words)
        for batch in batches:
            ids = code(batch.column(batch.schema.get_field_index(text)))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, out])
    shape = T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])
    return docs.mapInArrow(run, shape)


def decode(ids: Column, model_file: str) -> Column:
    """Text of piece ids: the pieces' bytes joined, U+2581 to space, without the one in front."""
    hexes = F.split(F.lit(",".join(vocabulary(model_file).hexes)), ",")
    raw = F.unhex(F.array_join(F.transform(ids, lambda i: F.get(hexes, i)), ""))
    return F.substr(F.replace(raw.cast("string"), F.lit(SPACE), F.lit(" ")), F.lit(2))
