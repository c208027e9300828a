"""Paths and the folders above them: joins by equality on ancestors, whatever the number of folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parent(path: Column) -> Column:
    """The folder of a path; the empty text for a path without one."""
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*\z", 1)


def ancestors(path: Column) -> Column:
    """A folder and all folders above it, the empty one among them."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return F.array_distinct(F.concat(F.array(F.lit("")), above))


def deepest(rows: DataFrame, path: str, folders: DataFrame, folder: str, within: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with the other columns of ``folders`` for the longest folder that is the path or above it, null where none is.

    within: columns that must be equal as well. A folder ends with no slash; the empty one is above all. Of equal folders the one whose other
    columns are least counts. Only distinct parents of paths are taken apart and joined with the folders, and their best is joined
    back: two joins by equality, each of which can be split or broadcast by Spark."""
    keys, other = list(within), [c for c in folders.columns if c not in (*within, folder)]
    one = folders.groupBy(*keys, F.col(folder).alias("_folder")).agg(F.min(F.struct(*other)).alias("_v"))
    up = rows.select(*keys, parent(F.col(path)).alias("_parent"), F.substring(path, 1, 1).alias("_first")).distinct()
    each = up.select(*keys, "_parent", "_first", F.explode(ancestors(F.col("_parent"))).alias("_folder"))
    best = each.join(one, [*keys, "_folder"]).groupBy(*keys, "_parent", "_first").agg(F.max_by("_v", F.length("_folder")).alias("_above"))
    own = one.select(*keys, F.col("_folder").alias("_at"), F.col("_v").alias("_own"))
    left = rows.withColumn("_parent", parent(F.col(path))).withColumn("_first", F.substring(path, 1, 1)).withColumn("_at", F.col(path))
    both = left.join(best, [*keys, "_parent", "_first"], "left").join(own, [*keys, "_at"], "left")
    v = F.coalesce("_own", "_above")
    kept = [c for c in rows.columns if c not in other]
    return both.select(*kept, *(v[c].alias(c) for c in other))


def under_any(rows: DataFrame, path: str, folders: DataFrame, folder: str, within: tuple[str, ...] = ()) -> DataFrame:
    """The rows whose path is one of the folders or lies below one."""
    marked = deepest(rows, path, folders.select(*within, folder).withColumn("_under", F.lit(True)), folder, within)
    return marked.where("_under").drop("_under")
