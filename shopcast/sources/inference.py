"""Types and timestamp formats of text columns, found in one aggregation over all rows (IO2, C1).

Nothing is sampled: a type holds only if every value that is not missing
parses as it, so a late odd row widens the column instead of becoming null.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shopcast.functions.cleaning import NA_TOKENS, na_to_null

#: Candidate timestamp formats, the earlier one on equal counts: ISO first, then month-first, day-first and others.
FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd",
           "M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy", "d/M/yyyy H:mm:ss", "d/M/yyyy H:mm", "d/M/yyyy",
           "d.M.yyyy H:mm:ss", "d.M.yyyy H:mm", "d.M.yyyy", "d-M-yyyy H:mm:ss", "d-M-yyyy H:mm", "d-M-yyyy", "yyyyMMdd")


#: What the parser takes as a numeric field: the range of the field, zeros before it, and a sign only with the year.
FIELDS = {"M": r"0*(?:1[0-2]|[1-9])", "d": r"0*(?:3[01]|[12]\d|[1-9])", "H": r"0*(?:2[0-3]|1?\d)", "m": r"0*[0-5]?\d", "s": r"0*[0-5]?\d",
          "y": r"(?:\d{4}|[+-]\d{4,6})"}
#: Types whose tests share one number of a value.
WORD = 60


def _shape(fmt: str) -> tuple[str, list[str]] | None:
    """(pattern that every text of ``fmt`` matches, signs it holds); None for a format with other than the usual numeric fields."""
    out, signs = "", []
    for quoted, letters, sign in re.findall(r"'([^']+)'|([A-Za-z]+)|(.)", fmt):
        if letters:
            for field in re.findall(r"y+|M+|d+|H+|m+|s+|.", letters):
                if field != "yyyy" and field not in ("M", "MM", "d", "dd", "H", "HH", "m", "mm", "s", "ss"):
                    return None
                out += FIELDS[field[0]]
        elif quoted or sign not in "[]{}#'":
            out += "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else re.escape(c) for c in quoted or sign)
            signs += [c for c in quoted or sign if not c.isalnum()]
        else:
            return None
    return f"^{out}$", list(dict.fromkeys(signs))


def _parsed(value: Column, fmt: str) -> Column:
    """The timestamp of a text, null if it has another layout.

    A failing parse costs an exception, so only texts with the signs and digits of the format are parsed.
    """
    shape = _shape(fmt)
    parsed = F.try_to_timestamp(value, F.lit(fmt))
    if shape is None:
        return parsed
    may = value.rlike(shape[0])
    for sign in reversed(shape[1]):
        may = value.contains(sign) & may
    return F.when(may, parsed)


def timestamp_formats(df: DataFrame, columns: Sequence[str], formats: Sequence[str] = FORMATS) -> dict[str, tuple[str | None, int, int]]:
    """Per column (format, parsed rows, unparsed rows), all columns in one aggregation.

    The format that parses most values wins; between month-first and day-first that is
    decided by the values that only one of them can read, and where none
    tells, by the order of ``formats``.  Blank values count as neither; a column without any parsed value has no format.
    """
    if not columns:
        return {}
    texts = F.array(*[F.trim(F.col(c).cast("string")) for c in columns])
    given = F.transform(texts, lambda v: F.when(v != "", v))
    found = df.select(_of_each(given, lambda v: F.array(v.isNotNull(), *[_parsed(v, f).isNotNull() for f in formats])).alias("t"))
    sums = [F.count_if(F.col("t")[i][j]) for i in range(len(columns)) for j in range(len(formats) + 1)]
    row = found.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()
    out, width = {}, len(formats) + 1
    for i, c in enumerate(columns):
        n, counts = row[i * width], row[i * width + 1:(i + 1) * width]
        best = max(counts)
        out[c] = (formats[counts.index(best)] if best else None, best, n - best)
    return out


def parse_detected(df: DataFrame, columns: Sequence[str], formats: Sequence[str] = FORMATS) -> tuple[DataFrame, DataFrame]:
    """(``df`` with the columns as timestamps, report of column, format, parsed and unparsed rows)."""
    found = timestamp_formats(df, columns, formats)
    nothing = F.lit(None).cast("timestamp")
    typed = df.withColumns({c: _parsed(F.trim(F.col(c).cast("string")), f) if f else nothing for c, (f, _, _) in found.items()})
    report = df.sparkSession.createDataFrame([(c, f, p, u) for c, (f, p, u) in found.items()],
                                             "column_name string, format string, parsed long, unparsed long")
    return typed, report


def _of_each(values: Column, result: Callable[[Column], Column]) -> Column:
    """``result`` of each text of an array, its tests written once: generated code of every test of every column is too long to be compiled."""
    return F.transform(values, result)


def _types(value: Column, formats: Sequence[str]) -> list[tuple[str, Column]]:
    """Types from narrow to wide with the test that a text is one."""
    number = value.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    tests = [("boolean", F.lower(value).isin("true", "false")),
             ("bigint", value.rlike(r"^[+-]?\d+$") & value.try_cast("bigint").isNotNull()),
             ("double", number & value.try_cast("double").isNotNull())]
    return tests + [(f"timestamp {f}", _parsed(value, f).isNotNull()) for f in formats]


def infer_types(df: DataFrame, na_tokens: Sequence[str] = NA_TOKENS, formats: Sequence[str] = FORMATS) -> dict[str, str]:
    """Narrowest type of each text column: boolean, bigint, double, ``timestamp <format>`` or string.

    One aggregation for all columns: each value has a bit for every type it fits, and the bits that all values have in
    common are the column's types.  Missing-value tokens fit every type; a column of nothing else is a string.
    """
    names = [name for name, _ in _types(F.lit(""), formats)]
    words = [range(i, min(i + WORD, len(names))) for i in range(0, len(names), WORD)]

    none = F.lit(0).cast("long")

    def bits(value: Column) -> Column:
        groups: dict[tuple[int, str | None], list[Column]] = {}          # formats with a sign are tested only on texts that hold it
        for i, (name, test) in enumerate(_types(value, formats)):
            shape = _shape(name.split(" ", 1)[1]) if name.startswith("timestamp ") else None
            bit = F.when(test, F.lit(1 << i % WORD).cast("long")).otherwise(none)
            groups.setdefault((i // WORD, shape[1][0] if shape and shape[1] else None), []).append(bit)
        parts = [[] for _ in words]
        for (w, sign), tests in groups.items():
            both = reduce(Column.bitwiseOR, tests)
            parts[w].append(both if sign is None else F.when(value.contains(sign), both).otherwise(none))
        return F.when(value.isNotNull(), F.array(*[reduce(Column.bitwiseOR, p) for p in parts]))
    texts = F.array(*[F.trim(na_to_null(F.col(f"`{c}`"), na_tokens)) for c in df.columns])
    passed = [F.bit_and(F.col("t")[i][w]).alias(f"s{i}_{w}") for i in range(len(df.columns)) for w in range(len(words))]
    row = df.select(_of_each(texts, bits).alias("t")).agg(*passed).first() if passed else {}
    out = {}
    for i, c in enumerate(df.columns):
        held = [names[t] for w, word in enumerate(words) for k, t in enumerate(word) if (row[f"s{i}_{w}"] or 0) >> k & 1]
        out[c] = held[0] if held else "string"
    return out


def typed(df: DataFrame, types: dict[str, str], na_tokens: Sequence[str] = NA_TOKENS) -> DataFrame:
    """Text columns as the given types; timestamps without a zone."""
    columns = []
    for c, kind in types.items():
        value = na_to_null(F.col(f"`{c}`"), na_tokens)
        if kind.startswith("timestamp "):
            value = _parsed(F.trim(value), kind.split(" ", 1)[1]).cast("timestamp_ntz")
        elif kind != "string":
            value = F.trim(value).try_cast(kind)
        columns.append(value.alias(c))
    return df.select(columns)


def read_csv_inferred(spark: SparkSession, path: str, na_tokens: Sequence[str] = NA_TOKENS) -> DataFrame:
    """IO2: header CSV with the types its values have; one pass finds them, the result reads the file again."""
    text = spark.read.option("header", True).option("mode", "PERMISSIVE").option("inferSchema", False).csv(path)
    return typed(text, infer_types(text, na_tokens), na_tokens)
