"""Language identification by compression.

Each language has a zstandard raw-content dictionary made of training text.
A text (all of it, letters lower-cased, everything else a space) is encoded in
blocks with every dictionary; the language with the smallest total wins.  The
margin is the second smallest size over the smallest, minus one; a text whose
margin is under ``min_margin`` is marked rejected.

Bound of the model: ``dictionary_bytes`` a language, gathered from
``sample_docs`` hash-chosen training texts each (all, if there are fewer);
copies of a text count once, so they neither crowd out nor void the sample.  A
region of ``excerpt`` characters at a hashed place is taken of each.  More than
``max_languages`` learned values are an error, not cut, and so is a language
of which no text was drawn.

Defined results: null texts and texts without a letter are ``und`` with score
0.0 and rejected; ties of size go to the language with more training rows,
then to the smaller name (and are rejected: margin 0); with nothing learned
all is ``und``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNDETERMINED = "und"
#: Ends every dictionary and starts every block: a block of few letters then still compresses, so sizes tell languages
#: apart where zstandard would store the block as it is.
PREAMBLE = bytes(range(128, 256))
RESULT = "struct<lang_pred:string,score:double,margin:double,rejected:boolean>"
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters_only(text: str) -> bytes:
    return f" {_NOT_LETTERS.sub(' ', text.lower()).strip()} ".encode()


@dataclass(frozen=True)
class Model:
    """Languages in tie order with their dictionaries."""
    languages: tuple[str, ...]
    dictionaries: tuple[bytes, ...]
    block: int = 2048

    def encoders(self) -> list[zstandard.ZstdCompressor]:
        params = zstandard.ZstdCompressionParameters(
            window_log=18, hash_log=17, chain_log=17, search_log=4, min_match=4, target_length=8,
            strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False)
        out = []
        for raw in self.dictionaries:
            known = zstandard.ZstdCompressionDict(raw + PREAMBLE, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(compression_params=params)
            out.append(zstandard.ZstdCompressor(dict_data=known, compression_params=params))
        return out

    def sizes(self, raw: bytes, encoders: list[zstandard.ZstdCompressor]) -> np.ndarray:
        blocks = [PREAMBLE + raw[i:i + self.block] for i in range(0, len(raw), self.block)]
        return np.array([sum(len(e.compress(b)) for b in blocks) for e in encoders], dtype=np.float64)


def learn(training: DataFrame, text: str, lang: str, dictionary_bytes: int = 131072, sample_docs: int = 400,
          excerpt: int = 2000, max_languages: int = 256) -> Model:
    """Dictionaries from hash-chosen distinct training texts; rows with null language or text are left out."""
    rows = training.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter("lang is not null and text is not null")
    copies = rows.groupBy("lang", F.xxhash64("text").alias("hash")).agg(F.count("*").alias("n"))
    counts = copies.groupBy("lang").agg(F.sum("n").alias("n"), F.count("*").alias("texts")).limit(max_languages + 1).collect()
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages to learn")
    if not counts:
        return Model((), ())
    share = {r["lang"]: min(1.0, 4.0 * sample_docs / r["texts"]) for r in counts}
    rate = F.element_at(F.create_map(*[F.lit(v) for kv in share.items() for v in kv]), F.col("lang"))
    order = F.pmod(F.xxhash64("text"), F.lit(1 << 40)).cast("double") / F.lit(float(1 << 40))
    start = (F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.length("text") - excerpt, F.lit(0)) + 1) + 1).cast("int")
    first = Window.partitionBy("lang").orderBy("order", "text")
    chosen = (rows.withColumn("order", order).filter(F.col("order") < rate)
              .select("lang", "order", F.substr("text", start, F.lit(excerpt)).alias("text")).distinct()
              .withColumn("n", F.row_number().over(first)).filter(F.col("n") <= sample_docs).collect())
    texts: dict[str, list] = {}
    for r in sorted(chosen, key=lambda r: (r["lang"], r["n"])):
        texts.setdefault(r["lang"], []).append(letters_only(r["text"]))
    if lacking := sorted(r["lang"] for r in counts if r["lang"] not in texts):
        raise RuntimeError(f"no training text was drawn of {lacking}")
    known = sorted(counts, key=lambda r: (-r["n"], r["lang"]))
    return Model(tuple(r["lang"] for r in known),
                 tuple(b"".join(texts[r["lang"]])[:dictionary_bytes] for r in known))


def identify(text: Column, model: Model, min_margin: float = 0.002) -> Column:
    """struct(lang_pred, score, margin, rejected) of a text column.

    The score is the winner's share of 2^-bits over the languages, with the
    sizes scaled to at most 64 bytes so that it stays within reach of 0 and 1.
    """
    @F.arrow_udf(RESULT)
    def run(texts: pa.Array) -> pa.Array:
        encoders, out = model.encoders(), []
        for value in texts:
            given = value.as_py() or ""
            raw = letters_only(given)
            if not encoders or not any(c.isalpha() for c in given):
                out.append({"lang_pred": UNDETERMINED, "score": 0.0, "margin": 0.0, "rejected": True})
                continue
            sizes = model.sizes(raw, encoders)
            order = np.argsort(sizes, kind="stable")
            margin = float(sizes[order[1]] / sizes[order[0]] - 1) if len(sizes) > 1 else 1.0
            bits = 8 * (sizes - sizes.min()) * min(1.0, 64 / sizes.min())
            out.append({"lang_pred": model.languages[order[0]], "score": float(1 / np.exp2(-bits).sum()),
                        "margin": margin, "rejected": margin < min_margin})
        return pa.array(out, pa.struct([("lang_pred", pa.string()), ("score", pa.float64()),
                                        ("margin", pa.float64()), ("rejected", pa.bool_())]))
    return run(text)
