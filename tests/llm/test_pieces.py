"""Piece encoding against the library's own Viterbi on the same table, the in-task fold, and exact round trips."""

import random
import time
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import regex
import sentencepiece
from pyspark.sql import functions as F

from shopcast.llm import pieces
from shopcast.llm.common import table
from shopcast.llm.queries import tokenizer_file

SF = "/root/testdata/sf0.001"


def as_unigram():
    """The given table read as a unigram model (the model type is one varint of the trainer settings)."""
    from sentencepiece import sentencepiece_model_pb2 as pb
    m = pb.ModelProto()
    m.ParseFromString(open(tokenizer_file(), "rb").read())
    m.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    for p in m.pieces:      # runs of spaces have a score out of single-precision reach; the words below have none
        p.score = max(p.score, -100000.0)
    return sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())


def test_words_match_the_library(spark):
    sp = as_unigram()
    words = table(spark, SF, "documents").select(F.explode(F.split("text", r"\s+")).alias("w")).filter("w <> ''").distinct().limit(3000)
    got = pieces.encode(words, tokenizer_file(), text="w").collect()
    assert len(got) > 2000
    assert all(sp.encode(r["w"]) == list(r["ids"]) for r in got)


def test_book_and_fold_agree_and_round_trip(spark):
    docs = table(spark, SF, "documents")
    whole = pieces.encode(docs, tokenizer_file())
    folded = {r["doc_id"]: r["ids"] for r in pieces.encode(docs, tokenizer_file(), book_words=0).collect()}
    rows = whole.withColumn("back", pieces.decode(F.col("ids"), tokenizer_file())).collect()
    assert all(r["ids"] == folded[r["doc_id"]] and r["back"] == r["text"] for r in rows)
    assert whole.columns == [*docs.columns, "ids"]


def test_edges(spark):
    texts = [None, "", " ", "  two  spaces ", "a\n\nb\t", "𐍈 日本 ﷽", "x" * 20000, "= " * 10000, "=" * 5000, "Ünïcödé ², 1.5!", "\\u2581"]
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, _escaped string")
    rows = pieces.encode(docs, tokenizer_file()).withColumn("back", pieces.decode(F.col("ids"), tokenizer_file())).collect()
    assert [r["back"] for r in sorted(rows)] == [t or "" for t in texts] and all(r["_escaped"] == "c" for r in rows)
    assert [len(r["ids"]) for r in sorted(rows)][:2] == [0, 0]
    mark = spark.createDataFrame([("a▁b",)], "text string")
    assert pieces.encode(mark, tokenizer_file()).select(pieces.decode(F.col("ids"), tokenizer_file())).first()[0] == "a b"
    assert pieces.encode(docs.limit(0), tokenizer_file()).count() == 0


def test_merges_match_the_library(spark):
    """In merge order the ids are the tokenizer's own, over whole texts, from the book and from the task's fold."""
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file())
    more = ["  a  b   c\n\n d\t\te  ", "x" * 300, "a--b==c!!  ", "١٢٣ हिन्दी ภาษาไทย 日本語", " lead", "trail ", "𐍈𐍈 ²."]
    docs = table(spark, SF, "documents").select("text").union(spark.createDataFrame([(t,) for t in more], "text string"))
    for words in (1 << 18, 0):
        got = pieces.encode(docs, tokenizer_file(), fold="merges", book_words=words).collect()
        assert all(sp.encode(r["text"]) == list(r["ids"]) for r in got)


def test_lattice_edges_are_all_known_substrings(spark):
    vocab = pieces.vocabulary(tokenizer_file())
    edges = pieces.lattice(spark.createDataFrame([("▁thẞe日",)], "word string"), vocab).first()["edges"]
    word, want = "▁thẞe日", set()
    for i in range(len(word)):
        for j in range(i + 1, len(word) + 1):
            if word[i:j] in vocab.pieces or j == i + 1:
                want.add((j, i, vocab.pieces.get(word[i:j], (-1, 0))[0]))
    assert {(e["end"], e["start"], e["id"]) for e in edges} == want


def test_very_long_words_fold_in_merge_order():
    """100,000 characters without a space, as the tokenizer itself encodes them."""
    import random
    import time
    vocab = pieces.vocabulary(tokenizer_file())
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file())
    rng = random.Random(4)
    for word in ("x" * 3000, "".join(rng.choice("abcdefgh日é") for _ in range(20_000)), "".join(rng.choice("0123456789") for _ in range(20_000))):
        assert pieces.merge_word("▁" + word, vocab.pieces, vocab.byte_ids) == sp.encode(word)
    began = time.process_time()
    assert len(pieces.merge_word("ab" * 50_000, vocab.pieces, vocab.byte_ids)) > 1000
    assert time.process_time() - began < 5


def test_words_are_counted_once_whatever_the_spaces(spark):
    import regex
    texts = ["one two, two", "one  two", "▁one", "x" * 60 + " y", None, ""]
    want = {}
    for t in texts:
        for w in regex.findall(pieces.WORD, "▁" + t.replace(" ", "▁")) if t else []:
            if 0 < len(w) <= 48:
                want[w] = want.get(w, 0) + 1
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for held in (1, 1 << 18):
        assert {r["word"]: r["count"] for r in pieces.word_counts(df, "t", 48, held).collect()} == want


def test_packed_words_add_up_bucket_by_bucket():
    """Packed rows of several tasks, sorted by bucket, against one counter; sums in between do not change them; long and empty words are left out."""
    parts = [Counter({"a": 2, "\n\0": 1, "日本": 4, "": 9, "x" * 60: 3}), Counter(), Counter({"a": 1, "b": 5}), Counter({f"w{i}": i + 1 for i in range(500)}),
             Counter({f"w{i}": 7 for i in range(250, 600)})]
    rows = [r for part in parts for r in pieces._packed(part, 48, 5).to_pylist()]
    packed = pa.RecordBatch.from_pylist(sorted(rows, key=lambda r: r["bucket"]), schema=pieces._packed(Counter(), 48, 5).schema)
    want = Counter({w: n for w, n in sum(parts, Counter()).items() if 0 < len(w) <= 48})
    for waiting in (1, 100, 1 << 20):
        found = pieces._summed(iter([packed.slice(0, 3), packed.slice(3)]), waiting)
        got = [(r["word"], r["count"]) for b in found for r in b.to_pylist()]
        assert len(got) == len(want) and dict(got) == dict(want)
    assert list(pieces._summed(iter([]))) == []


ODD = "▁▁    aeiouthndrsABé日本ß𐍈²،ภा.,!=-0123\n\t\0"


def test_words_are_cut_as_the_pattern_cuts():
    """Columns of odd texts, slices and nulls among them, against the pattern text by text, whatever the portions."""
    rng = random.Random(1)
    for _ in range(100):
        texts = [None if rng.random() < 0.1 else "".join(rng.choices(ODD, k=rng.randint(0, 30))) for _ in range(rng.randint(0, 20))]
        skip = rng.randint(0, len(texts))
        got = []
        for portion in pieces.portions(pa.array(texts, pa.string()).slice(skip), rng.choice((1, 50, 1 << 23))):
            words, firsts = pieces.cut_words(portion)
            got += [[w.replace(" ", "▁") for w in words[i:j].to_pylist()] for i, j in zip(firsts[:-1], firsts[1:], strict=True)]
        assert got == [[w for w in regex.findall(pieces.WORD, "▁" + t.replace(" ", "▁")) if w] if t else [] for t in texts[skip:]]


def test_words_folded_side_by_side_equal_single_folds():
    vocab = pieces.vocabulary(tokenizer_file())
    unknown = vocab.unknown_score
    rng, known = random.Random(1), list(vocab.pieces)
    words = ["".join(rng.choices(ODD, k=rng.randint(1, 20))) for _ in range(3000)] + ["".join(rng.choices(known, k=rng.randint(1, 4))) for _ in range(3000)] + ["a" * 64]
    begun, columns = pieces.beginnings(vocab.pieces), pieces.Beginnings(vocab.pieces)
    got = pieces.fold_words(pa.array(words)[1:], columns, vocab.byte_ids, unknown).to_pylist()
    assert got == [pieces.fold_word(w, begun, vocab.byte_ids, unknown) for w in words[1:]]
    assert len(pieces.fold_words(pa.array([], pa.string()), columns, vocab.byte_ids, unknown)) == 0


def test_coding_costs_less_than_a_lookup_word_by_word():
    """Most words in the book, others folded: under half the CPU of splitting, looking up and folding them one by one."""
    vocab = pieces.vocabulary(tokenizer_file())
    unknown = vocab.unknown_score
    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"])["text"].combine_chunks()[:1000]
    counts = pieces.cut_words(texts)[0].value_counts()
    begun, split = pieces.beginnings(vocab.pieces), regex.compile(pieces.WORD).findall
    ids = {w: pieces.fold_word(w, begun, vocab.byte_ids, unknown)
           for w, n in ((r["values"].replace(" ", "▁"), r["counts"]) for r in counts.to_pylist()) if n > 4}
    code = pieces.coder(pa.table({"word": pa.array(list(ids), pa.string()), "ids": pa.array(list(ids.values()), pa.list_(pa.int32()))}), vocab)
    pieces.character_classes()
    began = time.process_time()
    got = code(texts)
    took, began, want = time.process_time() - began, time.process_time(), []
    for t in texts.to_pylist():
        own = []
        for w in split("▁" + t.replace(" ", "▁")) if t else []:
            found = ids.get(w)
            own += found if found is not None else pieces.fold_word(w, begun, vocab.byte_ids, unknown)
        want.append(own)
    assert got.to_pylist() == want
    assert took < (time.process_time() - began) / 2, (took, time.process_time() - began)
