"""Keyed changes to tables of immutable files: each returns the table's new rows, and writers swap whole versions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import unused
from ..functions.semantics import differs


def keyed(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows whose keys are all there, and the others: a null key is no other row's."""
    there = reduce(lambda x, y: x & y, (F.col(k).isNotNull() for k in keys))
    return rows.filter(there), rows.filter(~there)


def first_of_each(rows: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """One row of each key: the first by order, and of equals the least by all other columns."""
    rest = [F.col(c) for c in rows.columns if c not in keys]
    by = W.partitionBy(*keys).orderBy(*(order or []), *rest) if order or rest else W.partitionBy(*keys).orderBy(*keys)
    (i,) = unused(rows.columns, "i")
    return rows.withColumn(i, F.row_number().over(by)).filter(F.col(i) == 1).drop(i)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Rows of both; of a key the one of the greatest version stays, of equal versions the new one. Rows with a null key all stay."""
    (a, a_rest), (b, b_rest) = keyed(old, keys), keyed(new.select(old.columns), keys)
    is_new, i = unused(old.columns, "new", "i")
    both = a.withColumn(is_new, F.lit(0)).unionByName(b.withColumn(is_new, F.lit(1)))
    rest = [F.col(c).desc_nulls_last() for c in old.columns if c not in {*keys, version}]
    order = W.partitionBy(*keys).orderBy(F.col(version).desc_nulls_last(), F.desc(is_new), *rest)
    kept = both.withColumn(i, F.row_number().over(order)).filter(F.col(i) == 1).drop(i, is_new)
    return kept.unionByName(a_rest).unionByName(b_rest)


def upsert_partly(old: DataFrame, new: DataFrame, keys: list[str], changes: list[str]) -> DataFrame:
    """On a known key only the columns in changes are taken from the new row; others keep what was first seen. Of new rows
    of one key the least counts (by the other columns in their order, nulls first); old rows of one key, which a keyed table should not
    have, all stay, each changed alike; rows with a null key all stay."""
    (held, held_rest), (came, came_rest) = keyed(old, keys), keyed(new.select(old.columns), keys)
    is_old, is_new = unused(old.columns, "known", "came")
    a, b = held.withColumn(is_old, F.lit(True)).alias("a"), first_of_each(came, keys).withColumn(is_new, F.lit(True)).alias("b")
    on = reduce(lambda x, y: x & y, (F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys))
    known, arrived = F.col(f"a.{is_old}").isNotNull(), F.col(f"b.{is_new}").isNotNull()
    pick = lambda c: F.when(known & (~arrived | F.lit(c not in changes)), F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c)
    return a.join(b, on, "full_outer").select(*(pick(c) for c in old.columns)).unionByName(held_rest).unionByName(came_rest)


def insert_if_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows stay; of new rows of one absent key the least comes in, and those with a null key all do."""
    came, rest = keyed(new.select(old.columns), keys)
    return old.unionByName(first_of_each(came, keys).join(old.select(*keys).distinct(), keys, "left_anti").select(old.columns)).unionByName(rest)


def update_from(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """old with columns from new where a key is there, and changed: whether any of them differs. Of new rows of one key the
    least counts, so each old row stays one row; a null key is no other row's."""
    (hit,) = unused([*old.columns, *new.columns], "hit")
    fresh = dict(zip(columns, unused([*old.columns, *new.columns, hit], *(f"new_{c}" for c in columns)), strict=True))
    came, _ = keyed(new.select(*keys, *columns), keys)
    values = first_of_each(came, keys).select(*keys, *(F.col(c).alias(n) for c, n in fresh.items()), F.lit(True).alias(hit))
    joined = old.join(values, keys, "left")
    found = F.col(hit).isNotNull()
    changed = found & reduce(lambda a, b: a | b, (differs(F.col(c), F.col(n)) for c, n in fresh.items()))
    return joined.select(*(F.when(found, F.col(fresh[c])).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns), changed.alias("changed"))


def update_where(rows: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """Columns set where the condition is true; unknown counts as false."""
    hit = F.coalesce(condition, F.lit(False))
    return rows.select(*(F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in rows.columns))


def retained(rows: DataFrame, at: str, since: Column) -> DataFrame:
    """Rows not older than a moment; rows without one stay."""
    return rows.filter(F.col(at).isNull() | (F.col(at) >= since))


def replace_part(old: DataFrame, new: DataFrame, part: str) -> DataFrame:
    """old with the values of a column that new has, null among them, replaced whole: rows that new no longer has go."""
    (own,) = unused(old.columns, part)
    parts = new.select(F.col(part).alias(own)).distinct()
    return old.join(parts, F.col(part).eqNullSafe(F.col(own)), "left_anti").unionByName(new)


def zipped(rows: DataFrame, arrays: list[str], keep: list[str]) -> DataFrame:
    """Parallel arrays as rows."""
    return rows.select(*keep, F.inline(F.arrays_zip(*arrays)))


def sync_plan(stored: DataFrame, feed: DataFrame, key: str) -> DataFrame:
    """Each key with create, update or delist. The caller refuses an empty feed."""
    held, fed = unused([key], "stored", "feed")
    a = stored.select(key).distinct().withColumn(held, F.lit(1))
    b = feed.select(key).distinct().withColumn(fed, F.lit(1))
    action = F.when(F.col(held).isNull(), "create").when(F.col(fed).isNull(), "delist").otherwise("update")
    return a.join(b, key, "full_outer").select(key, action.alias("action"))


def checked_sync(stored: DataFrame, feed: DataFrame, key: str) -> DataFrame:
    if feed.isEmpty():
        raise ValueError("an empty feed would delist everything")
    return sync_plan(stored, feed, key)


def fill_missing(rows: DataFrame, proposed: DataFrame, key: str, fields: dict[str, str], locks: str = "locks") -> DataFrame:
    """Empty fields are filled from proposed; a field whose lock (by form name) is in the row's locks is not.

    fields: column to form name.
    """
    came = dict(zip(fields, unused([*rows.columns, *proposed.columns], *(f"new_{c}" for c in fields)), strict=True))
    values = first_of_each(proposed.select(key, *fields), [key]).select(key, *(F.col(c).alias(n) for c, n in came.items()))
    held = F.coalesce(F.col(locks), F.array().cast("array<string>"))
    empty = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    pick = lambda c: F.when(empty(c) & ~F.array_contains(held, fields[c]) & F.col(came[c]).isNotNull(), F.col(came[c])).otherwise(F.col(c)).alias(c)
    return rows.join(values, key, "left").select(*(pick(c) if c in fields else F.col(c) for c in rows.columns))


def changed_fields(rows: DataFrame, old: str, new: str) -> Column:
    """The entries of one map that another map lacks or has otherwise."""
    return F.map_filter(F.col(new), lambda k, v: differs(F.element_at(F.col(old), k), v))


def write_version(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """A whole version of a table; with partitions, only those in rows are replaced."""
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if partition_by else "static")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def planned(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """What turns old into new, to be looked at before it is applied: action (insert, update, delete), the keys, and the new values."""
    values = [c for c in old.columns if c not in keys]
    was, held, comes, came = unused(old.columns, "old", "held", "new", "came")
    a = old.select(*keys, F.struct(*values).alias(was), F.lit(True).alias(held))
    b = new.select(*keys, F.struct(*values).alias(comes), F.lit(True).alias(came))
    action = F.when(F.col(held).isNull(), "insert").when(F.col(came).isNull(), "delete").when(differs(F.col(was), F.col(comes)), "update")
    return a.join(b, keys, "full_outer").withColumn("action", action).filter("action IS NOT NULL").select("action", *keys, f"{comes}.*")


def applied(old: DataFrame, plan: DataFrame, keys: list[str]) -> DataFrame:
    """old after a plan."""
    return old.join(plan.select(*keys), keys, "left_anti").select(old.columns).unionByName(plan.filter("action <> 'delete'").select(old.columns))


def replicated(tables: dict[str, DataFrame], links: list[tuple[str, str, str]], order: list[str]) -> dict[str, DataFrame]:
    """Tables in an order in which parents come first, each without the rows whose parent is not there. links: (child, column, parent);
    the parent's key has the column's name."""
    out: dict[str, DataFrame] = {}
    for name in order:
        rows = tables[name]
        for child, column, parent in links:
            if child == name:
                if parent not in out:
                    raise ValueError(f"{parent} has to come before {name}")
                rows = rows.filter(F.col(column).isNull()).unionByName(rows.join(out[parent].select(column).distinct(), column, "left_semi").select(rows.columns))
        out[name] = rows
    return out


def backed_up(rows: DataFrame, gone: Column, path: str) -> DataFrame:
    """The rows that stay, once those that go are in a backup table at path."""
    hit = F.coalesce(gone, F.lit(False))
    rows.filter(hit).write.mode("errorifexists").parquet(path)
    return rows.filter(~hit)
