"""Quality scores against a plain discriminant, language ID against held-out rows, and edge rows of both."""

import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from shopcast.llm import langid, quality
from shopcast.llm.common import held_out, table

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string"


def test_held_out_is_crc32_of_the_id(spark):
    got = {r[0]: r[1] for r in spark.range(500).select("id", held_out(F.col("id"))).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(500)}


def test_scores_match_a_plain_discriminant(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = {r["doc_id"]: r["score"] for r in quality.classify(docs, labels, ~held_out(F.col("doc_id"))).collect()}
    codec = zstandard.ZstdCompressor(level=1)
    x = {r["doc_id"]: quality.statistics_of(r["text"].encode(), codec) for r in docs.collect()}
    y = {r["doc_id"]: r["quality"] for r in labels.collect()}
    train = [d for d in y if zlib.crc32(str(d).encode()) % 4 != 2]
    rows, marks = np.array([x[d] for d in train]), np.array([y[d] for d in train])
    cov = {k: np.cov(rows[marks == k].T, bias=True) for k in (0, 1)}
    pooled = sum(cov[k] * (marks == k).mean() for k in (0, 1))
    every = np.array([x[d] for d in got])
    density = []
    for k in (0, 1):
        s = 0.4 * cov[k] + 0.6 * pooled + 1e-3 * np.diag(np.diag(pooled) + 1e-6)
        z = every - rows[marks == k].mean(axis=0)
        density.append(np.log((marks == k).mean()) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(s), z))
    want = 1 / (1 + np.exp(-np.clip(density[1] - density[0], -700, 700)))
    assert np.allclose(want, list(got.values()), atol=1e-6)


def test_quality_on_held_out_rows(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    got = quality.classify(docs, labels, ~held_out(F.col("doc_id"))).filter(held_out(F.col("doc_id"))).join(labels, "doc_id")
    assert got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] >= 0.97


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (2, "", "y"), (None, "word " * 50000, None), (4, "Good text. " * 9, "")],
                                 "doc_id long, text string, _key string")
    labels = spark.createDataFrame([(4, 1, 7), (None, 0, 7), (1, None, 7)], "doc_id long, quality int, text int")
    rows = quality.classify(docs, labels, F.lit(True)).collect()
    assert len(rows) == 5 and all(r["score"] == 1.0 and r["predicted"] == 1 for r in rows)
    assert {r["score"] for r in quality.classify(docs, labels.limit(0), F.lit(True)).collect()} == {0.5}
    assert quality.classify(docs.limit(0), labels, F.lit(True)).count() == 0


def test_language_of_held_out_rows(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents").filter("doc_id < 4000")
    model = langid.learn(docs.filter(~held_out(F.col("doc_id"))), "text", "lang")
    got = docs.filter(held_out(F.col("doc_id"))).select("lang", langid.identify(F.col("text"), model).alias("f"))
    right, kept = got.agg(F.avg((F.col("f.lang_pred") == F.col("lang")).cast("int")), F.avg((~F.col("f.rejected")).cast("int"))).first()
    assert right >= 0.97 and kept >= 0.98


def test_smallest_encoding_wins(spark):
    model = langid.Model(("aa", "bb"), (b" lorem ipsum dolor " * 20, b" quick brown foxes " * 20), 64)
    text = "Lorem ipsum dolor! " * 30
    encoders = model.encoders()
    sizes = model.sizes(langid.letters_only(text), encoders)
    assert sizes[0] < sizes[1]
    f = spark.createDataFrame([(text,)], "t string").select(langid.identify(F.col("t"), model).alias("f")).first()["f"]
    assert f["lang_pred"] == "aa" and f["margin"] == pytest.approx(sizes[1] / sizes[0] - 1) and not f["rejected"]


def test_language_edges(spark):
    docs = spark.createDataFrame([(1, "hello there you", "en"), (2, None, "en"), (3, "12 34 !!", None), (4, "", "fr"), (5, "Zq", None), (6, "² ½ Ⅷ", None)], DOCS)
    model = langid.learn(docs, "text", "lang")
    assert model.languages == ("en", "fr") and len(model.dictionaries) == 2
    got = {r["doc_id"]: r["f"] for r in docs.select("doc_id", langid.identify(F.col("text"), model).alias("f")).collect()}
    assert [got[i]["lang_pred"] for i in (2, 3, 4, 6)] == ["und"] * 4 and got[2]["score"] == 0 and got[3]["rejected"]
    assert got[5]["margin"] == 0 and got[5]["rejected"] and got[5]["lang_pred"] == "en"     # a tie: more training rows first
    nothing = langid.learn(docs.limit(0), "text", "lang")
    assert docs.select(langid.identify(F.col("text"), nothing)["lang_pred"]).distinct().collect()[0][0] == "und"
    with pytest.raises(ValueError):
        langid.learn(docs, "text", "lang", max_languages=1)


def test_copies_do_not_void_the_sample(spark):
    texts = spark.range(60).select(F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text"))
    many = texts.crossJoin(spark.range(200)).select("text", F.lit("en").alias("lang"))
    other = texts.select(F.concat(F.lit("autre "), "text").alias("text"), F.lit("fr").alias("lang"))
    model = langid.learn(many.unionByName(other), "text", "lang", sample_docs=2)
    alone = langid.learn(many.distinct().unionByName(other), "text", "lang", sample_docs=2)
    assert model.languages == ("en", "fr") and dict(zip(model.languages, model.dictionaries)) == dict(zip(alone.languages, alone.dictionaries))
    whole = langid.learn(many, "text", "lang", sample_docs=60)
    assert len(set(whole.dictionaries[0].split(b"text number"))) == 2 and whole.dictionaries[0].count(b"text number") == 60


def test_languages_match_a_plain_loop(spark):
    """Samples, dictionaries, sizes, margins and scores again, one text after the other, on the sf0.01 documents."""
    import re
    import zlib

    import numpy as np
    import xxhash
    import zstandard

    docs = [(r["doc_id"], r["text"], r["lang"]) for r in table(spark, "/root/testdata/sf0.01", "documents").collect()]
    docs += docs[:50] + [(-1, "long text of many words and letters " * 20_000, None)]          # repeated rows, a very long text

    def letters(t):
        return (" " + re.sub(r"[\W\d_]+", " ", t.lower()).strip() + " ").encode()

    rows, texts = {}, {}
    for i, t, lang in docs:
        if lang is not None and t is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            rows[lang] = rows.get(lang, 0) + 1
            texts.setdefault(lang, set()).add(t)
    books = {}
    for lang, own in texts.items():
        drawn = set()
        for t in own:
            h = xxhash.xxh64_intdigest(t.encode(), 42)
            signed = h - (1 << 64) if h >> 63 else h
            at = signed % (1 << 40) / (1 << 40)
            if at < min(1.0, 1600 / len(own)):
                h = xxhash.xxh64_intdigest((1).to_bytes(4, "little"), h)
                signed = h - (1 << 64) if h >> 63 else h
                start = signed % (max(len(t) - 2000, 0) + 1)
                drawn.add((at, t[start:start + 2000]))
        books[lang] = b"".join(letters(t) for _, t in sorted(drawn)[:400])[:131072]
    order = sorted(rows, key=lambda x: (-rows[x], x))
    top = bytes(range(128, 256))
    params = zstandard.ZstdCompressionParameters(window_log=18, hash_log=17, chain_log=17, search_log=4, min_match=4, target_length=8,
                                                 strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False)
    made = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(books[x] + top, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
                                     compression_params=params) for x in order]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = langid.learn(df.filter(~held_out(F.col("doc_id"))), "text", "lang")
    got = df.select("doc_id", "text", langid.identify(F.col("text"), model).alias("f")).collect()
    assert len(got) == len(docs) and list(model.languages) == order
    for r in got:
        raw = letters(r["text"] or "")
        if not re.search(r"[^\W\d_]", r["text"] or ""):
            assert r["f"]["lang_pred"] == "und"
            continue
        sizes = [sum(len(c.compress(top + raw[i:i + 2048])) for i in range(0, len(raw), 2048)) for c in made]
        first, second = sorted(sizes)[:2]
        assert r["f"]["lang_pred"] == order[sizes.index(first)]
        assert r["f"]["margin"] == pytest.approx(second / first - 1) and r["f"]["rejected"] == (second / first - 1 < 0.002)
        assert r["f"]["score"] == pytest.approx(1 / sum(2.0 ** (-8 * (s - first) * min(1.0, 64 / first)) for s in sizes))
