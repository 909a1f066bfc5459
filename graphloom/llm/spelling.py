"""Records that differ only in how they are written (problem 1).

Exact detection of hot canonical keys from partial counts; the records of hot
keys are salted and aggregated at two levels, all others meet their group in
one shuffle. The representative of a group is its smallest record id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.tables import shuffle_partitions, written

#: Everything that is no letter, mark of a letter, or digit. Variation selectors are invisible, though Unicode counts them as marks.
NOT_COUNTED = r"[^\p{L}\p{M}\p{Nd}]|[\x{FE00}-\x{FE0F}]"
#: A key is hot when it has more than a task's fair share of the records divided by this.
HOT_PER_TASK = 4


def canonical(name: Column) -> Column:
    """Letters and digits of ``name``, in order, without letter case; null stays null."""
    return F.lower(F.upper(F.regexp_replace(name.cast("string"), NOT_COUNTED, "")))


def unordered_key(begin: Column, end: Column) -> Column:
    """One key for the pair in either direction; null unless both names have a letter or digit.

    The separator can be in no canonical name, so different pairs get different keys.
    """
    a, b = canonical(begin), canonical(end)
    return F.when((F.length(a) > 0) & (F.length(b) > 0), F.concat_ws(" ", F.least(a, b), F.greatest(a, b)))


def _keyed(df: DataFrame, record_id: str, key: Column) -> DataFrame:
    keyed = df.select(F.col(record_id).cast("bigint").alias("_rec"), key.alias("_key"))
    return keyed.where(F.col("_key").isNotNull() & F.col("_rec").isNotNull()).withColumn("_hash", F.xxhash64("_key"))


def hot_hashes(keyed: DataFrame, rows: int, hot_keys: int) -> DataFrame | None:
    """``(_hash, _salts)`` of the keys that hold more than 1/``hot_keys`` of the ``rows`` records, with the number of such parts that they hold; None if there are none.

    Counted exactly, with partial counts before the shuffle. There are at most
    ``hot_keys`` of them, because their shares add up to no more than one. Two
    keys with one hash are counted together, which only sends a few more records
    the salted way.
    """
    hot = written(keyed.groupBy("_hash").count().where(F.col("count") * hot_keys > rows).select("_hash", F.ceil(F.col("count") * hot_keys / rows).cast("int").alias("_salts")))
    return None if hot.isEmpty() else hot


def _split(df: DataFrame, record_id: str, key: Column, hot_keys: int | None) -> tuple[DataFrame, DataFrame | None]:
    """The records of ordinary keys, and those of hot keys if there are any.

    With ``hot_keys`` unset a key is hot when a task that had to hold it would
    have more than a quarter of its fair share by this key alone, so there are at
    most four hot keys for each task; each is two numbers where they are broadcast.
    """
    hot_keys = hot_keys or HOT_PER_TASK * shuffle_partitions(df.sparkSession)
    # the key is by far the dearest part of a pass over the names, so it is made once
    keyed = written(_keyed(df, record_id, key))
    hot = hot_hashes(keyed, df.count(), hot_keys)
    if hot is None:
        return keyed, None
    return keyed.join(F.broadcast(hot), "_hash", "left_anti"), keyed.join(F.broadcast(hot), "_hash")


def _two_level(heavy: DataFrame) -> DataFrame:
    """``(_key, kept_id, copies)`` of the hot keys: per key and salt, with as many salts as the key has parts, then per key."""
    salt = F.pmod(F.xxhash64("_rec"), F.col("_salts")).alias("_salt")
    per_salt = heavy.groupBy("_key", salt).agg(F.min("_rec").alias("_min"), F.count("_rec").alias("_n"))
    return per_salt.groupBy("_key").agg(F.min("_min").alias("kept_id"), F.sum("_n").alias("copies"))


def group_copies(df: DataFrame, record_id: str, key: Column, hot_keys: int | None = None) -> DataFrame:
    """``(rec_id, kept_id, copies)`` of every record with a key.

    ``kept_id`` is the smallest ``record_id`` among the records of the same key,
    ``copies`` their number. Records whose key or id is null are left out. A
    record id that comes twice counts twice. An empty table gives no rows; other
    columns of ``df`` are not read, whatever their names.
    """
    light, heavy = _split(df, record_id, key, hot_keys)
    w = Window.partitionBy("_key")
    out = light.select(F.col("_rec").alias("rec_id"), F.min("_rec").over(w).alias("kept_id"), F.count("_rec").over(w).alias("copies"))
    if heavy is None:
        return out
    # one row per hot key, so at most hot_keys rows are broadcast
    return out.unionByName(heavy.join(F.broadcast(_two_level(heavy)), "_key").select(F.col("_rec").alias("rec_id"), "kept_id", "copies"))


def collapse_copies(df: DataFrame, record_id: str, key: Column, hot_keys: int | None = None) -> DataFrame:
    """``(rec_id, copies)``: of each group the smallest id and the number of its records."""
    light, heavy = _split(df, record_id, key, hot_keys)
    out = light.groupBy("_key").agg(F.min("_rec").alias("kept_id"), F.count("_rec").alias("copies"))
    if heavy is not None:
        out = out.unionByName(_two_level(heavy))
    return out.select(F.col("kept_id").alias("rec_id"), "copies")


def edge_key() -> Column:
    return unordered_key(F.col("begin_name"), F.col("end_name"))


def found_copies(edge_names: DataFrame, hot_keys: int | None = None) -> DataFrame:
    """``(kept_id, rec_id)``: each record that is a copy of one with a smaller id."""
    groups = group_copies(edge_names, "rec_id", edge_key(), hot_keys)
    return groups.where(F.col("rec_id") > F.col("kept_id")).select("kept_id", "rec_id")


def collapse(edge_names: DataFrame, hot_keys: int | None = None) -> DataFrame:
    """``(rec_id, copies)``: each edge once, with the number of its records."""
    return collapse_copies(edge_names, "rec_id", edge_key(), hot_keys)
