"""Joins between what is declared and what is there.

Every function takes DataFrames and column names, declares one plan and leaves its execution to Catalyst.
Null keys match nothing; an empty side gives the result that set logic gives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def without_partner(left: DataFrame, right: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Rows of left whose key no row of right has (declared but missing, or present but undeclared)."""
    r = right.select(*[F.col(b).alias(f"_k{i}") for i, b in enumerate(keys.values())])
    return left.join(r, [F.col(a) == F.col(f"_k{i}") for i, a in enumerate(keys)], "left_anti")


def with_partner(left: DataFrame, right: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Rows of left whose key some row of right has."""
    r = right.select(*[F.col(b).alias(f"_k{i}") for i, b in enumerate(keys.values())])
    return left.join(r, [F.col(a) == F.col(f"_k{i}") for i, a in enumerate(keys)], "left_semi")


def resolve(refs: DataFrame, members: DataFrame, scope: list[str], name: str, canonical: str, out: str = "member") -> DataFrame:
    """refs with the member that each names: the one of that exact name, else the only one of its canonical name.

    Both sides have the columns scope, name and canonical. Adds `out` (null if unresolved) and
    `candidates` (members of the canonical name).
    """
    exact = members.groupBy(*scope, name).agg(F.lit(True).alias("_exact"))
    loose = members.groupBy(*scope, canonical).agg(F.countDistinct(name).alias("candidates"), F.min(name).alias("_only"))
    r = refs.join(exact, [*scope, name], "left").join(loose, [*scope, canonical], "left")
    found = F.when(F.col("_exact"), F.col(name)).when(F.col("candidates") == 1, F.col("_only"))
    return r.withColumn(out, found).withColumn("candidates", F.coalesce("candidates", F.lit(0))).drop("_exact", "_only")


def not_in_vocabulary(rows: DataFrame, column: str, vocabulary: DataFrame, word: str) -> DataFrame:
    """Rows whose value is present and no word of a vocabulary; absent values are no violation, empty ones are."""
    return without_partner(rows.where(F.col(column).isNotNull()), vocabulary, {column: word})


def described_by(rows: DataFrame, table: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Rows with the columns of a fixed table that shares their key; Spark broadcasts it where its size allows."""
    return rows.join(table, key, how)


def only_self_declares(refs: DataFrame, declared: DataFrame, owner: str, identity: list[str]) -> DataFrame:
    """References whose identity no owner other than the one that refers declares.

    Counted, not compared: the owners of each identity are counted once and the referring one is
    subtracted, so that an identity of many owners costs one row. Identities that nothing refers to are left out first.
    """
    declared = declared.join(refs.select(*identity).distinct(), identity, "left_semi")
    own = declared.select(*identity, owner).distinct()
    count = own.groupBy(*identity).agg(F.count(F.lit(1)).alias("_owners"))
    mine = own.withColumn("_mine", F.lit(1))
    r = refs.join(count, identity, "left").join(mine, [*identity, owner], "left")
    return r.where(F.coalesce("_owners", F.lit(0)) - F.coalesce("_mine", F.lit(0)) <= 0).drop("_owners", "_mine")


def contradictions(claims: DataFrame, scope: list[str], identity: str, kind: str, register: str) -> DataFrame:
    """Claims that call an identity another kind than some claim in the same register, a blank register meeting all.

    The relation is not transitive, so it is no grouping; instead each (identity), (identity, register)
    and (identity, blank) carries the least and the greatest kind under it. A claim is contradicted where one of
    those differs from its own kind. No pair of claims is formed, and identities of one kind are left out first.
    """
    c = claims.where((F.col(identity) != "") & (F.col(kind) != ""))
    several = c.groupBy(*scope, identity).agg(F.min(kind).alias("_lo"), F.max(kind).alias("_hi")).where("_lo <> _hi").select(*scope, identity)
    c = c.join(several, [*scope, identity], "left_semi")
    blank = F.coalesce(F.col(register), F.lit("")) == ""
    c = c.withColumn("_r", F.coalesce(F.col(register), F.lit("")))
    by_register = c.groupBy(*scope, identity, "_r").agg(F.min(kind).alias("_lo"), F.max(kind).alias("_hi"))
    by_identity = by_register.groupBy(*scope, identity).agg(
        F.min("_lo").alias("_all_lo"), F.max("_hi").alias("_all_hi"),
        F.min(F.when(F.col("_r") == "", F.col("_lo"))).alias("_blank_lo"), F.max(F.when(F.col("_r") == "", F.col("_hi"))).alias("_blank_hi"),
    )
    j = c.join(by_register, [*scope, identity, "_r"]).join(by_identity, [*scope, identity])
    other = lambda lo, hi: (F.col(lo) != F.col(kind)) | (F.col(hi) != F.col(kind))
    hit = F.when(blank, other("_all_lo", "_all_hi")).otherwise(other("_lo", "_hi") | F.coalesce(other("_blank_lo", "_blank_hi"), F.lit(False)))
    return j.where(hit).select(*claims.columns)


def declared_state(rows: DataFrame, declared: DataFrame, keys: dict[str, str], flag: Column, out: str = "declared") -> DataFrame:
    """rows with a three-valued flag: that of the declaring row, null where nothing is known."""
    d = declared.groupBy(*[F.col(b).alias(f"_k{i}") for i, b in enumerate(keys.values())]).agg(F.bool_or(flag).alias(out))
    return rows.join(d, [F.col(a) == F.col(f"_k{i}") for i, a in enumerate(keys)], "left").drop(*[f"_k{i}" for i in range(len(keys))])


def inside_any(paths: DataFrame, path: str, folders: DataFrame, folder: str, scope: list[str] | None = None, most: int = 32) -> DataFrame:
    """Rows whose path lies in one of the folders, by exploding its ancestors (at most `most`)."""
    scope = scope or []
    segments = F.split(path, "/", -1)
    depth = F.least(F.size(segments) - 1, F.lit(most))
    ancestors = F.when(depth >= 1, F.transform(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), lambda i: F.array_join(F.slice(segments, 1, i), "/")))
    key = [*scope, path]
    hit = paths.select(*key, F.explode(ancestors).alias("_folder")).join(
        folders.select(*scope, F.col(folder).alias("_folder")).distinct(), [*scope, "_folder"], "left_semi"
    )
    return paths.join(hit.select(*key), key, "left_semi")
