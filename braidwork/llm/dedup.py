"""Collapse records that differ only in formatting, and count their copies.

Each field is reduced to its content characters with labelled parts in order, the fields are hashed together to 128 bits,
and copies are counted per hash with partial sums before the shuffle. A second 64-bit hash of the same fields is part of
the grouping key, so two contents that share a 128-bit hash still form two groups, and are reported as a collision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Characters that carry no content: all but letters, digits and marks, save a point between digits and a minus sign.
DROPPED = r"(?!(?<=\p{Nd})\.(?=\p{Nd}))(?!(?<![\p{L}\p{N}])-(?=\$?\.?\p{Nd}))[^\p{L}\p{N}\p{M}|;]|[︀-️͏]"
#: A part "label: value" or "label=value", or a blank one.
PART = r"^\s*$|^[^:=]*[\p{L}\p{N}][^:=]*[:=]"
#: One group may hold so large a share of all rows before it is joined by broadcast; at most 1/HOT_SHARE such groups exist.
HOT_SHARE = 1 / 2000


def canonical(c: Column) -> Column:
    """Content of a string: no case, white space, punctuation, symbols or invisible characters, labelled parts in order.

    A point between two digits stays, and so does a minus sign: a "-" right before a number or its "$" and not right after
    a letter or digit. If every part between "|" or ";" has a label, the parts are sorted. Null stays null, and a string
    without content becomes the empty string.
    """
    kept = F.regexp_replace(F.lower(F.regexp_replace(c, r"\p{Cf}", "")), DROPPED, "")
    labelled = c.rlike("[|;]") & F.forall(F.split(c, "[|;]"), lambda p: p.rlike(PART))
    return F.when(labelled, F.array_join(F.array_sort(F.split(kept, "[|;]")), "")).otherwise(F.regexp_replace(kept, "[|;]", ""))


def keyed(df: DataFrame, fields: list[str], id_col: str) -> DataFrame:
    """(id, h, chk): 128-bit hash and a second 64-bit hash of the canonical fields. Null and empty fields differ."""
    parts = [F.coalesce(F.concat(F.lit("\u0001"), canonical(F.col(f))), F.lit("\u0002")) for f in fields]
    content = df.select(F.col(id_col).alias("id"), F.concat(*parts).alias("content"))
    return content.select("id", F.unhex(F.md5("content")).alias("h"), F.xxhash64("content").alias("chk"))


def copy_groups(keys: DataFrame) -> DataFrame:
    """(h, chk, keep, copies, collides): one row per distinct content. collides: another content has the same 128 bits."""
    groups = keys.groupBy("h", "chk").agg(F.min("id").alias("keep"), F.count(F.lit(1)).alias("copies"))
    clash = groups.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h", F.lit(True).alias("collides"))
    return groups.join(clash, "h", "left").withColumn("collides", F.coalesce("collides", F.lit(False)))


def collapse(df: DataFrame, fields: list[str], id_col: str) -> DataFrame:
    """The row with the smallest id of each group of copies, with ``copies``. Rows with a null id are left out.

    An input column called copies is replaced. An empty input gives an empty table.
    """
    keys = keyed(df.where(F.col(id_col).isNotNull()), fields, id_col)
    kept = keys.groupBy("h", "chk").agg(F.min("id").alias("_keep"), F.count(F.lit(1)).alias("copies")).select("_keep", "copies")
    return df.drop("copies").join(kept, F.col(id_col) == F.col("_keep")).drop("_keep")


def copy_pairs(df: DataFrame, fields: list[str], id_col: str) -> DataFrame:
    """(keep, dup): the smallest id of each group with each of its other ids; as many rows as there are extra copies.

    Groups that hold more than HOT_SHARE of all rows join by broadcast, and there are fewer than 1/HOT_SHARE of them; the
    rest join by a shuffle on the hash, in which no key has more rows than that.
    """
    keys = materialize(keyed(df.where(F.col(id_col).isNotNull()), fields, id_col), "content-keys")
    groups = keys.groupBy("h", "chk").agg(F.min("id").alias("keep"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    groups = materialize(groups, "content-groups")
    limit = max(1, int(keys.count() * HOT_SHARE))
    hot = F.broadcast(groups.where(F.col("copies") > limit).drop("copies"))
    large = keys.join(hot, ["h", "chk"])
    small = keys.join(hot, ["h", "chk"], "left_anti").join(groups.where(F.col("copies") <= limit).drop("copies"), ["h", "chk"])
    return large.unionByName(small).where("id <> keep").select("keep", F.col("id").alias("dup"))
