"""Decontamination against brute-force alignment, planted edits and edge rows."""

import random

from pyspark.sql import functions as F

from shopcast.llm import decontam
from shopcast.llm.common import table

WORDS = "the of and stone river light over under quick seven garden window".split()


def plain_edits(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return min(row)


def search(texts, items, **kw):
    p = decontam.profile(items, **kw)
    return [{h["item_id"]: h["edits"] for h in found} for found in decontam._search(p, p.table(), [decontam.normalised(t) for t in texts])]


def test_nothing_within_the_budget_is_missed():
    rng = random.Random(5)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(6, 20)))) for i in range(12)]
    texts = []
    for n in range(60):
        planted = list(rng.choice(items)[1])
        for _ in range(rng.randint(0, 9)):
            at = rng.randrange(len(planted))
            planted[at:at + rng.randint(0, 1)] = rng.choice(["", "x", "q", " "])
        around = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 15))) for _ in range(2)]
        texts.append(f"{around[0]} {''.join(planted)} {around[1]}")
    got = search(texts, items)
    p = decontam.profile(items)
    for t, found in zip(texts, got, strict=True):
        plain = {i: plain_edits(decontam.normalised(s), decontam.normalised(t)) for i, s in items}
        want = {i for (i, e), k in zip(plain.items(), p.budget, strict=True) if e <= k}
        assert set(found) == want
        assert all(found[i] == plain[i] for i in found)


def test_documents_match_substring_search(spark):
    docs, bench = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "benchmark")
    found_in = decontam.profiles(bench)
    got = {(r[0], r[1]) for r in docs.select("doc_id", F.explode(decontam.contamination(F.col("text"), found_in)).alias("f"))
           .filter("f.edits = 0").select("doc_id", "f.item_id").collect()}
    items = [(r["item_id"], decontam.normalised(r["text"])) for r in bench.collect()]
    want = {(r["doc_id"], i) for r in docs.collect() for t in [decontam.normalised(r["text"])] for i, s in items if s in t}
    assert got == want and got


def test_blocks_and_windows(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon"), (2, "alpha beta gamma delta epsilon"), (3, "short"), (None, "one two three four five six"),
                                   (5, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x" * 70000 + " ALPHA, beta; gamma\ndelta epsilon!"), (2, None), (3, ""), (4, "clean text only"), (4, "short")],
                                 "doc_id long, text string").withColumn("found", F.lit(1))
    for size in (10, 10 ** 6):
        found_in = decontam.profiles(bench.filter("item_id is not null"), block_chars=size)
        rows = docs.select("doc_id", decontam.contamination(F.col("text"), found_in).alias("f")).collect()
        assert sorted((r["doc_id"], [(x["item_id"], x["edits"]) for x in r["f"]]) for r in rows)[0] == (1, [(1, 0), (2, 0)])
        assert sorted((r["doc_id"], x["item_id"]) for r in rows for x in r["f"]) == [(1, 1), (1, 2), (4, 3)]     # a short item, as a whole word
    none = decontam.profiles(bench.limit(0))
    assert docs.select(F.size(decontam.contamination(F.col("text"), none)).alias("n")).agg(F.sum("n")).first()[0] == 0
    p = decontam.profile([(1, "alpha beta gamma delta epsilon")])
    text = decontam.normalised("lorem " * 50 + "alpha beta gamma delta epsilon " + "dolor " * 50)
    import numpy as np
    for piece in (17, 64, 1000):
        assert len(decontam._regions(p, p.table(), decontam.codes(text), np.array([0]), piece)) == 2


def test_gram_hashes_tell_grams_apart():
    chars = decontam.codes("abcabcabdabc" * 3)
    for q in (1, 2, 3, 5, 8, 10):
        h = decontam.gram_hashes(chars, q).tolist()
        grams = [chars[i:i + q].tobytes() for i in range(len(chars) - q + 1)]
        assert len(h) == len(grams) and len(set(zip(h, grams, strict=True))) == len(set(h)) == len(set(grams))


def test_items_behind_one_frequent_passage_stay_within_memory():
    import tracemalloc

    import numpy as np
    preface = "answer the question below with one letter and give no reason for it"
    p = decontam.profile([(i, f"{preface} {i:04d} {'abcdefgh'[i % 8] * 3} {i * 7919 % 10007}") for i in range(2000)])
    texts = [decontam.normalised(f"{preface} and so on {n}") for n in range(100)] + [decontam.normalised(f"{preface} 0007 hhh 5412 end")]
    chars = decontam.codes("\0".join(texts))
    starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])[:-1]))
    whole = decontam._regions(p, p.table(), chars, starts, limit=1 << 60)
    tracemalloc.start()
    rows = decontam._regions(p, p.table(), chars, starts, limit=1 << 17)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(rows, whole) and len(rows)
    assert peak < 200_000_000
    found = decontam._search(p, p.table(), texts[-1:])
    assert 7 in {f["item_id"] for f in found[0]}


def test_short_items_are_whole_words():
    items = [(1, "A-b"), (2, "a b"), (3, "x"), (4, "?"), (5, "seven"), (6, "")]
    got = search(["xa b x y", "a, b seven", "x! x", "sevens", ""], items)
    assert [sorted(g) for g in got] == [[3], [1, 2, 5], [3], [], []]
    assert all(e == 0 for g in got for e in g.values())


def test_windows_of_long_texts_miss_nothing():
    rng = random.Random(8)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(14))) for i in range(4)]
    filler = [" ".join(rng.choice("zebra yodel xenon walrus".split()) for _ in range(n)) for n in (0, 3, 37, 150, 151, 152, 400)]
    text = decontam.normalised(" ".join(f"{f} {rng.choice(items)[1][:-1]}" for f in filler))
    p = decontam.profile(items)
    whole = decontam._search(p, p.table(), [text], window=1 << 20)
    for window in (1, 500, 901, 1024):
        assert decontam._search(p, p.table(), [text, "", text], window) == [whole[0], [], whole[0]] and whole[0]


def test_a_shared_passage_of_many_items_is_cheap():
    """One slice of copies of a passage that twelve items share: bounded memory at the production limit, and seconds, not minutes."""
    import time
    import tracemalloc
    rng = random.Random(9)
    passage = " ".join(rng.choice(WORDS) for _ in range(16))
    items = [(i, f"{passage} {' '.join(''.join(rng.choice('abcdefghij') for _ in range(6)) for _ in range(12))}") for i in range(12)]
    p = decontam.profile(items)
    texts = [decontam.normalised(f"{passage} " * 10)] * (1 << 20 >> 10)
    table = p.table()
    tracemalloc.start()
    began = time.process_time()
    found = decontam._search(p, table, [*texts, decontam.normalised(items[3][1])])
    assert time.process_time() - began < 60 and tracemalloc.get_traced_memory()[1] < 200_000_000
    tracemalloc.stop()
    assert [f["item_id"] for f in found[-1]] == [3] and not any(found[:-1])
