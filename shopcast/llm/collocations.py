"""Phrase collocation mining over a prefix-free parse.

A text is a sequence of words with a mark between pieces.  Words whose hash is 0
modulo ``period`` are triggers: a chunk runs from one trigger to the next (or
the text's end) and on over the first words of what follows, one fewer than the
longest phrase has, at most to the next mark.  Where a chunk ends depends on its own words only,
so no chunk that a trigger ends is the beginning of another one, and repeated passages give the same chunks
wherever they stand.  The dictionary holds distinct chunks by language with their frequency.

N-grams are counted in the distinct chunks, weighted by frequency, where they
begin in the chunk's own words; those that begin in the overlap belong to the
next chunk, so each occurrence counts once.  A phrase of n words can only be frequent
if both its parts of n - 1 words are: each level leaves a bit table of fixed
size that has the hashes of its frequent phrases, and the next level counts what passes
it.  The table only spares work; a frequent phrase always passes, and what
passes by chance has its true count and falls below the bound.

Defined results: a null text is empty; a null language is ``und``, one with the
language of that name; empty pieces hold no words; ties are broken as stated in
``collocations``; no rows give no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopcast.llm.common import cut
from shopcast.session import scratch_dir

#: A-Z in lower case, every mark that ends a piece as MARK; what is left of white space is space and tab.
MARK = b"."
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + MARK * 9)
PERIOD = 32
COUNTS = "key string, n long"
#: Between phrase and language in the key that is shuffled: words hold no line feed.
KEY_END = "\n"
#: Fixed values of the public XXH64 definition, in its order.
XXH64_PRIMES = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)


class _Triggers(dict):
    """Whether a word is a trigger, computed once a word; forgets all when it has grown large."""

    def __init__(self, period: int):
        super().__init__({MARK: False})
        self.period = period

    def __missing__(self, word: bytes) -> bool:
        if len(self) > 1 << 19:
            self.clear()
            self[MARK] = False
        found = self[word] = xxhash.xxh64_intdigest(word) % self.period == 0
        return found


def parse(text: bytes, triggers: _Triggers, overlap: int) -> Iterator[tuple[bytes, int, int]]:
    """(chunk, own tokens, own words) of a text; tokens are words and marks, with a mark at the end."""
    tokens = (text.translate(FOLD) + MARK).replace(MARK, b" " + MARK + b" ").split()
    start, bounds = 0, [i for i, t in enumerate(tokens) if triggers[t] and i]
    for i in bounds:
        after = tokens[i:i + overlap]
        if MARK in after:
            del after[after.index(MARK) + 1:]
        own = tokens[start:i]
        yield b" ".join(own + after), i - start, i - start - own.count(MARK)
        start = i
    own = tokens[start:]
    yield b" ".join(own), len(own), len(own) - own.count(MARK)


def dictionary(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 4, period: int = PERIOD,
               held_bytes: int = 1 << 24) -> DataFrame:
    """lang, chunk, own, words, n: the distinct chunks with their own tokens and words and their frequency, as a written table.

    A task adds up to ``held_bytes`` of chunks before it sends them.
    """
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        triggers, seen, size = _Triggers(period), {}, 0

        def sent() -> Iterator[pa.RecordBatch]:
            keys = list(seen)
            for at in range(0, len(keys), 50_000):
                some = keys[at:at + 50_000]
                chunk = pa.array([k[1] for k in some], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in some], pa.string()), chunk, pa.array([k[2] for k in some], pa.int32()),
                                                  pa.array([k[3] for k in some], pa.int32()), pa.array([seen[k] for k in some], pa.int64())],
                                                 names=["lang", "chunk", "own", "words", "n"])
            seen.clear()
        for batch in batches:
            for of, body in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                for chunk, own, words in parse(body.as_buffer().to_pybytes(), triggers, longest - 1):
                    key = (of, chunk, own, words)
                    if key in seen:
                        seen[key] += 1
                    else:
                        seen[key] = 1
                        size += len(chunk) + 100
                if size > held_bytes:
                    yield from sent()
                    size = 0
        yield from sent()
    parsed = rows.mapInArrow(run, "lang string, chunk string, own int, words int, n long")
    path = scratch_dir(docs.sparkSession, "chunks")
    parsed.groupBy("lang", "chunk", "own").agg(F.first("words").alias("words"), F.sum("n").alias("n")).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def _hashes(values: pa.Array) -> np.ndarray:
    """XXH64 of strings with seed 42, as Spark's ``xxhash64``."""
    return np.array([xxhash.xxh64_intdigest(v.as_buffer(), 42) for v in values], np.uint64)


def _chained(seed: np.ndarray, value: np.ndarray) -> np.ndarray:
    """XXH64 of 64-bit values with the hash before as seed, as Spark's ``xxhash64`` chains columns and array elements."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in XXH64_PRIMES)

    def turned(x: np.ndarray, n: int) -> np.ndarray:
        return (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    h = (seed + p5 + np.uint64(8)) ^ (turned(value * p2, 31) * p1)
    h = turned(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


def phrase_code(lang: str = "lang", phrase: str = "phrase") -> Column:
    """The same hash of a language and a phrase as a Spark expression."""
    return F.xxhash64(F.xxhash64(lang), F.transform(F.split(phrase, " "), lambda w: F.xxhash64(w)))


def _count(table: pa.Table, size: int, passes: list[np.ndarray]) -> pa.RecordBatch:
    """Phrases of ``size`` words that begin in a chunk's own words, with counts; ``passes`` are the bit tables of shorter ones."""
    chunks, langs = table.column("chunk").combine_chunks(), table.column("lang").combine_chunks().dictionary_encode()
    split = pc.split_pattern(chunks, " ")
    ends = split.offsets.to_numpy().astype(np.int64)
    lengths = np.diff(ends)
    words = split.flatten().dictionary_encode()
    word = words.indices.to_numpy().astype(np.int64)
    chunk = np.repeat(np.arange(len(lengths)), lengths)
    within = np.arange(len(word)) - np.repeat(ends[:-1] - ends[0], lengths)
    lang = langs.indices.to_numpy().astype(np.int64)[chunk]
    weight, own = table.column("n").to_numpy().astype(np.float64), table.column("own").to_numpy()
    with np.errstate(over="ignore"):
        hashes, begun = _hashes(words.dictionary), _chained(np.uint64(42), _hashes(langs.dictionary))
        # positions at which a phrase of the level begins, and its hash
        at = np.nonzero(word != pc.index(words.dictionary, MARK.decode()).as_py())[0]
        code = _chained(begun[lang[at]], hashes[word[at]])
        for level in range(2, size + 1):
            bits = passes[level - 2]
            spot = code & np.uint64(len(bits) * 8 - 1)
            good = (bits[(spot >> np.uint64(3)).astype(np.int64)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1
            at, code = at[good.astype(bool)], code[good.astype(bool)]
            passed = np.zeros(len(word) + 1, bool)
            passed[at] = True
            on = passed[at + 1] & (within[at] + level <= lengths[chunk[at]])
            at = at[on]
            if level < size:
                code = _chained(code[on], hashes[word[at + level - 1]])
    at = at[within[at] < own[chunk[at]]]
    # dense numbers of the phrases, word by word: equal numbers are equal words of one language
    number = word[at] * len(langs.dictionary) + lang[at]
    for i in range(1, size):
        number = np.unique(number, return_inverse=True)[1] * len(words.dictionary) + word[at + i]
    _, first, group = np.unique(number, return_index=True, return_inverse=True)
    total = np.bincount(group, weights=weight[chunk[at]], minlength=len(first)).astype(np.int64)
    begin = at[first]
    parts = [words.dictionary.take(pa.array(word[begin + i])) for i in range(size)]
    phrase = parts[0] if size == 1 else pc.binary_join_element_wise(*parts, " ")
    key = pc.binary_join_element_wise(phrase, langs.dictionary.take(pa.array(lang[begin])), KEY_END)
    return pa.RecordBatch.from_arrays([key, pa.array(total)], names=["key", "n"])


def counted(chunks: DataFrame, size: int, passes: list, at_least: int, held_words: int = 1 << 21) -> DataFrame:
    """(lang, phrase, n) of phrases of ``size`` words that occur ``at_least`` times; exact.

    ``passes`` are broadcast bit tables, one for each shorter length.  A task counts ``held_words`` words at a time.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, held, words = [b.value for b in passes], [], 0

        def sent() -> Iterator[pa.RecordBatch]:
            found = _count(pa.Table.from_batches(held), size, tables)
            for i in range(0, len(found), 100_000):
                yield found.slice(i, 100_000)
        for batch in batches:
            if len(batch):
                held.append(batch)
                words += pc.sum(pc.count_substring(batch.column("chunk"), " ")).as_py() + len(batch)
            if words >= held_words:
                yield from sent()
                held, words = [], 0
        if held:
            yield from sent()
    found = chunks.select("lang", "chunk", "own", "n").mapInArrow(run, COUNTS)
    often = found.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= at_least)
    phrase = F.substring_index("key", KEY_END, 1)
    return cut(often.select(F.expr("substring(key, instr(key, '\n') + 1)").alias("lang"), phrase.alias("phrase"), "n"))


def bit_table(phrases: DataFrame, bits: int) -> np.ndarray:
    """Bytes of a table of 2 ** ``bits`` bits, one set for each phrase's hash: its size does not depend on the input."""
    spot = phrase_code().bitwiseAND(F.lit((1 << bits) - 1))
    bytes_set = phrases.select(F.shiftright(spot, 3).alias("at"), F.call_function("shiftleft", F.lit(1), spot.bitwiseAND(F.lit(7)).cast("int")).alias("bit"))
    found = bytes_set.groupBy("at").agg(F.bit_or("bit").cast("short").alias("bit")).toArrow()
    table = np.zeros(1 << (bits - 3), np.uint8)
    table[found.column("at").to_numpy()] = found.column("bit").to_numpy().astype(np.uint8)
    return table


def scored(levels: list[DataFrame]) -> DataFrame:
    """lang, phrase, a, l, r, score of every frequent phrase of two and more words; ``levels`` by length, from 1.

    Cutting after the first k words gives floor(2000000 a / (l + r)); the lowest score counts, ties go to the smallest k.
    """
    every = levels[0].select("lang", "phrase", "n")
    for level in levels[1:]:
        every = every.unionByName(level.select("lang", "phrase", "n"))
    several = levels[1].select("lang", "phrase", F.col("n").alias("a"), F.lit(2).alias("words"))
    for size, level in enumerate(levels[2:], 3):
        several = several.unionByName(level.select("lang", "phrase", F.col("n").alias("a"), F.lit(size).alias("words")))
    cuts = several.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumns({"left": F.expr("substring_index(phrase, ' ', k)"), "right": F.expr("substring_index(phrase, ' ', k - words)")})
    left = every.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    right = every.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    exact = "cast(cast({0} as decimal(20, 0)) {1} as {2})"
    score = F.expr(exact.format("a", "* cast(2000000 as decimal(7, 0)) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))", "long"))
    tried = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).withColumn("score", score)
    best = tried.groupBy("lang", "phrase", "words").agg(F.max("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "words", "a", "best.l", "best.r", "best.score")


def uncovered(phrases: DataFrame, percent: int = 80) -> DataFrame:
    """Phrases (lang, phrase, words, a, ..) without those inside a longer one that has at least ``percent`` % of their count."""
    longer = phrases.filter("words > 2").select("lang", "words", "a", F.split("phrase", " ").alias("parts"))
    inside = longer.select("lang", "a", "parts", "words", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    inside = inside.select("lang", "a", "parts", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("at"))
    covers = (inside.select("lang", F.array_join(F.slice("parts", F.col("at"), F.col("size")), " ").alias("phrase"), "a")
              .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    wide = "cast({0} as decimal(20, 0)) * {1}"
    dropped = F.expr(wide.format("longer", 100)) >= F.expr(wide.format("a", int(percent)))
    return phrases.join(covers, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | ~dropped).drop("longer")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 4, at_least: int = 30, first: int = 2000,
                 percent: int = 80, period: int = PERIOD, bits: int = 26) -> DataFrame:
    """The ``first`` phrases of 2 to ``longest`` words of each language, by score, then count (both descending), then phrase.

    lang, rank (from 1), phrase, a (its count), l and r (of the two parts of the cut that counts), n (words of the language), score.
    """
    chunks = dictionary(docs, text, lang, longest, period)
    levels, passes, sc = [], [], docs.sparkSession.sparkContext
    for size in range(1, longest + 1):
        levels.append(counted(chunks, size, passes, at_least))
        if size < longest:
            passes.append(sc.broadcast(bit_table(levels[-1], bits)))
    words = chunks.groupBy("lang").agg(F.sum(F.col("words") * F.col("n")).alias("n")).filter("n > 0")
    kept = uncovered(cut(scored(levels)), percent)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= first)
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
