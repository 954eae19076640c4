"""Dataset splits S1-S4 without a global row sort.

Cut keys are found with ``rows_at`` (brackets and counts, never all rows in one
task, all classes together) and keep their type; nulls sort last and count as
rows.  The split itself is one comparison on each row.  S1-S3 compare the first
key column itself with its cut; ``split_sides`` gives the two sides as frames of
their own, each a range on that column, so that a Parquet scan reads its part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopcast.operators.ordering import few_rows, order_key, rows_at


def _sides(df: DataFrame, keys: Sequence[str], frac: float, with_cut: bool) -> tuple[Column, Column]:
    """Conditions of the rows before the cut key at position int(frac * n), or up to it, and of the rest; without a cut key, all are before it."""
    cuts = rows_at(df, [], list(keys), frac, lambda n: F.floor(n * frac))
    state = cuts.select(F.col("first").isNull().alias("none"), F.col("first.n0").alias("null_key")).first()
    if state is None or state["none"]:
        return F.lit(True), F.lit(False)
    cut, key = cuts.select("first").scalar(), F.col(keys[0])
    inside = order_key(keys) <= cut if with_cut else order_key(keys) < cut
    if state["null_key"]:
        return inside, ~inside
    first = cuts.select("first.k0").scalar()
    if len(keys) == 1:
        return (key <= first, key.isNull() | (key > first)) if with_cut else (key < first, key.isNull() | (key >= first))
    return (key <= first) & inside, (key.isNull() | (key >= first)) & ~inside


def split_sides(df: DataFrame, order: Sequence[str], frac: float = 0.8, with_cut: bool = False) -> tuple[DataFrame, DataFrame]:
    """Train and test rows of S2/S3 (``with_cut``: rows of the cut key are train, as in S1) as two frames.

    Each is a filter on the first key column, which a Parquet scan takes over: one side is read without the other's row groups.
    """
    train, test = _sides(df, order, frac, with_cut)
    return df.filter(train), df.filter(test)


def temporal_split(df: DataFrame, time_col: str, frac: float = 0.8,
                   out: str = "split") -> DataFrame:
    """cutoff = value at sorted position int(frac * n); train <= cutoff < test."""
    return df.withColumn(out, F.when(_sides(df, [time_col], frac, with_cut=True)[0], "train").otherwise("test"))


def ordered_split(df: DataFrame, order: Sequence[str], frac: float = 0.8,
                  out: str = "split") -> DataFrame:
    """First int(frac * n) rows of a total order are train.

    ``order`` must be a total order (unique key tuple) of any orderable types.
    """
    return df.withColumn(out, F.when(_sides(df, order, frac, with_cut=False)[0], "train").otherwise("test"))


def hash_rank_keys(id_col: str, seed: int) -> dict[str, F.Column]:
    """Two 60-bit numbers from md5(id || seed): a shared random order for S4."""
    h = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(str(seed))))
    return {
        "_h1": F.conv(F.substring(h, 1, 15), 16, 10).cast("long"),
        "_h2": F.conv(F.substring(h, 16, 15), 16, 10).cast("long"),
    }


def hashed_split(df: DataFrame, id_col: str, test_frac: float = 0.2, seed: int = 42,
                 out: str = "split") -> DataFrame:
    """S4, approximate form: test when pmod(xxhash64(id, seed), 10000) < test_frac * 10000.

    One projection, no job and no ordering; every class gets ~test_frac of its
    rows (a hash is independent of the label), exact shares are not promised.
    """
    h = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(10000))
    return df.withColumn(out, F.when(h < F.lit(int(round(test_frac * 10000))), "test").otherwise("train"))


def stratified_split(df: DataFrame, label: str, id_col: str, test_frac: float = 0.2,
                     seed: int = 42, out: str = "split", exact: bool = True) -> DataFrame:
    """Per class, the round(test_frac * n_c) rows first in md5 order are test.

    Class shares are kept exactly; rows are chosen by a hash of the id, so the
    split is repeatable and engine-independent.  Any number of classes is cut
    together.  ``exact=False`` switches to the one-pass ``hashed_split``.
    """
    if not exact:
        return hashed_split(df, id_col, test_frac, seed, out)
    keyed = df.withColumns(hash_rank_keys(id_col, seed))
    order = ["_h1", "_h2", id_col]

    def size(n: Column) -> Column:
        return F.round(n * test_frac + 1e-12).cast("long")
    cuts = rows_at(keyed, [label], order, test_frac, size).select(
        F.col(label).alias("_label"), F.col("first").alias("_cut"), (size(F.col("n")) >= F.col("n")).alias("_all"))
    joined = keyed.join(few_rows(cuts), F.col(label).eqNullSafe(F.col("_label")))
    test = F.col("_all") | F.coalesce(order_key(order) < F.col("_cut"), F.lit(False))
    return joined.withColumn(out, F.when(test, "test").otherwise("train")).drop("_h1", "_h2", "_label", "_cut", "_all")
