"""Collocations against plain counting over every piece; parse properties; edge rows."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from shopcast.llm import collocations as X


def pieces_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [[w for w in re.split("[ \t]+", p) if w] for p in re.split("[.,;:!?\n\x0b\x0c\r]", lowered)]


def plain(rows, at_least, first):
    f, n, out = defaultdict(Counter), Counter(), set()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for w in pieces_of(text):
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    for lang in n:
        c = {p: a for p, a in f[lang].items() if len(p) > 1 and a >= at_least}
        cover = Counter()
        for p, a in c.items():
            for s in range(2, len(p)):
                for i in range(len(p) - s + 1):
                    cover[p[i:i + s]] = max(cover[p[i:i + s]], a)
        kept = []
        for p, a in c.items():
            if p not in cover or 100 * cover[p] < 80 * a:
                s, k = min((2000000 * a // (f[lang][p[:k]] + f[lang][p[k:]]), k) for k in range(1, len(p)))
                kept.append((-s, -a, " ".join(p).encode(), f[lang][p[:k]], f[lang][p[k:]]))
        out |= {(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(kept)[:first], 1)}
    return out


@pytest.fixture(scope="module")
def rows():
    random.seed(2)
    vocab = ["a", "B", "the", "of", "Écho", "\x00z", "q\xa0r", "\t", ".", "!\n", ",", "  "]
    made = [(" ".join(random.choices(vocab, k=random.choice([0, 3, 200]))), random.choice(["en", "de", None, "und"])) for _ in range(200)]
    return made + [("one two three four five", "en")] * 50 + [(None, None), ("", "en"), ("  ", "fr"), ("word " * 30_000, "long")]


@pytest.mark.parametrize("settings", [{}, {"period": 1, "first": 5}, {"period": 2, "at_least": 3, "bits": 10}])
def test_matches_plain_counts(spark, rows, settings):
    df = spark.createDataFrame(rows, "text string, lang string").withColumns({c: F.lit(1) for c in ("n", "own", "phrase", "chunk")})
    got = [tuple(r) for r in X.collocations(df, **settings).collect()]
    want = plain(rows, settings.get("at_least", 30), settings.get("first", 2000))
    assert len(got) == len(want) and set(got) == want


def test_parse_is_prefix_free_and_covers_each_word_once():
    random.seed(3)
    words = [f"w{i}" for i in range(40)] + [".", "?"]
    triggers = X._Triggers(4)
    chunks = set()
    for _ in range(300):
        text = " ".join(random.choices(words, k=random.randint(0, 60)))
        parsed = list(X.parse(text.encode(), triggers, 3))
        own = [t for c, n, _ in parsed for t in c.decode().split(" ")[:n]]
        assert [w for w in own if w != "."] == [w for p in pieces_of(text) for w in p] and own[-1] == "."
        assert sum(n for _, _, n in parsed) == len([w for w in own if w != "."])
        chunks |= {(tuple(c.decode().split(" ")), n) for c, n, _ in parsed}
    every = sorted({c for c, _ in chunks})
    by_trigger = {c for c, n in chunks if n < len(c)}
    assert by_trigger and not [1 for a, b in zip(every, every[1:], strict=False) if a in by_trigger and b[:len(a)] == a]


def test_hash_of_a_phrase_is_the_same_in_spark(spark):
    import numpy as np
    import pyarrow as pa
    words, langs = X._hashes(pa.array(["the", "Écho"])), X._hashes(pa.array(["en"]))
    with np.errstate(over="ignore"):
        code = X._chained(X._chained(X._chained(np.uint64(42), langs[:1]), words[:1]), words[1:])
    got = spark.sql("select 'en' lang, 'the Écho' phrase").select(X.phrase_code()).first()[0]
    assert int(code.view(np.int64)[0]) == got


def test_small_tasks_add_up(spark, rows):
    df = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    chunks = X.dictionary(df, held_bytes=1000)
    assert chunks.count() == chunks.select("lang", "chunk", "own").distinct().count()
    words = Counter()
    for t, lang in rows:
        words.update({(lang or "und", w): 1 for w in ()})
        for w in pieces_of(t):
            words.update((lang or "und", x) for x in w)
    got = {(r["lang"], r["phrase"]): r["n"] for r in X.counted(chunks, 1, [], 1, held_words=100).collect()}
    assert got == dict(words)


def test_counts_past_64_bits_and_rounding(spark):
    big = 6 * 10 ** 18
    one = spark.createDataFrame([("x", "a", big), ("x", "b", big)], "lang string, phrase string, n long")
    two = spark.createDataFrame([("x", "a b", big - 1)], "lang string, phrase string, n long")
    got = X.scored([one, two]).first()
    assert got["score"] == 2000000 * (big - 1) // (2 * big) and (got["l"], got["r"]) == (big, big)


def test_no_rows(spark):
    assert X.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
