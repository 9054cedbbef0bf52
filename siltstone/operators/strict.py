"""Joins of rows that belong together one by one, which account for every row that doesn't."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_left, n_right, status, left, right) of each key of either side, in one exchange. `matched`: one row of each, and only then the structs of their
    columns are there; `missing_right`, `missing_left`: the other side has none; `repeated`: a side has several. Null keys match nothing: they are
    `no_key`, together for each side."""
    def told(df: DataFrame, side: int) -> DataFrame:
        row = F.struct(*[c for c in df.columns if c not in keys]) if set(df.columns) - set(keys) else F.struct(F.lit(True).alias("there"))
        whole = F.lit(True)
        for k in keys:
            whole = whole & F.col(k).isNotNull()
        empty = F.lit(None)
        return df.select(*keys, F.when(whole, F.lit(0)).otherwise(F.lit(side)).alias("_odd"), *[(F.lit(1) if n == side else F.lit(0)).alias(f"_n{n}") for n in (1, 2)], *[(row if n == side else empty).alias(f"_r{n}") for n in (1, 2)])

    both = told(left, 1).unionByName(told(right, 2))
    got = both.groupBy(*keys, "_odd").agg(F.sum("_n1").alias("n_left"), F.sum("_n2").alias("n_right"), F.first("_r1", True).alias("left"), F.first("_r2", True).alias("right"))
    status = (
        F.when(F.col("_odd") > 0, "no_key").when((F.col("n_left") > 1) | (F.col("n_right") > 1), "repeated").when(F.col("n_right") == 0, "missing_right")
        .when(F.col("n_left") == 0, "missing_left").otherwise("matched")
    )
    good = status == "matched"
    return got.select(*keys, "n_left", "n_right", status.alias("status"), F.when(good, F.col("left")).alias("left"), F.when(good, F.col("right")).alias("right"))


def accounted(joined: DataFrame) -> DataFrame:
    """(status, n_keys, n_left, n_right): where all rows of both sides have gone."""
    return joined.groupBy("status").agg(F.count(F.lit(1)).alias("n_keys"), F.sum("n_left").alias("n_left"), F.sum("n_right").alias("n_right"))


def whole(joined: DataFrame) -> DataFrame:
    """The matched rows if nothing else came up; otherwise none, so that a strict run can't pass with a part."""
    odd = joined.where("status <> 'matched'").agg((F.count(F.lit(1)) == 0).alias("good")).where("good").select()
    return joined.where("status = 'matched'").join(F.broadcast(odd), F.lit(True), "left_semi")  # one row or none
