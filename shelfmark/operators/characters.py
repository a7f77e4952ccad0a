"""Who a figure shows, derived from landed tables: the catalogue, casts, tags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import names
from ..functions.staging import staged
from ..functions.text import names_match, romaji_key, same_character, unicode_form


def keyed(rows: DataFrame, column: str, key: str = "key") -> DataFrame:
    return rows.withColumn(key, romaji_key(unicode_form(F.col(column), "NFKD")))


def candidates(figures: DataFrame) -> DataFrame:
    """(figure_id, series, guess, at, key): the names a figure's character may have, the likeliest first."""
    rows = figures.select("figure_id", "series", F.posexplode(names.character_candidates(F.col("name"), F.array("series"))).alias("at", "guess"))
    return keyed(rows, "guess")


def one_within_other(left: DataFrame, right: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """left and right joined by a group where the words of one key, left's a or right's b, are all among the other's: what names_match
    and same_character need. Keys are compared once each, and one is found by its rarest word among the others of its group."""
    words = lambda c: F.array_distinct(F.split(F.col(c), " +"))

    def within(small: DataFrame, large: DataFrame, x: str, y: str) -> DataFrame:
        of = lambda rows, key: rows.select(F.col(group), F.col(key), words(key).alias(f"{key}_words"), F.explode(words(key)).alias("word"))
        there = of(large, y)
        often = there.groupBy(group, "word").agg(F.count("*").alias("often"))
        # a word that no other key has rules its key out
        rarest = of(small, x).join(often, [group, "word"], "left").groupBy(group, x, f"{x}_words").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "word")).alias("r")).filter("r.often > 0")
        pairs = rarest.select(group, x, f"{x}_words", F.col("r.word").alias("word")).join(there, [group, "word"])
        return pairs.filter(F.size(F.array_except(f"{x}_words", f"{y}_words")) == 0).select(group, a, b)

    mine, theirs = left.select(group, a).distinct(), right.select(group, b).distinct()
    pairs = within(mine, theirs, a, b).unionByName(within(theirs, mine, b, a)).distinct()
    return left.join(pairs, [group, a]).join(right, [group, b])


def confirmed(guesses: DataFrame, known: DataFrame, source: str, within_series: bool = True) -> DataFrame:
    """(figure_id, character, source): the first guess that exactly one known character of the series bears out.

    known: series, character. The join is by series, and by the rarest word of a key inside it.
    """
    people = keyed(known.select("series", "character").distinct(), "character", "k")
    found = one_within_other(guesses, people, "series", "key", "k").filter(names_match(F.col("key"), F.col("k")) | same_character(F.col("key"), F.col("k"), within_series))
    one = found.groupBy("figure_id", "at").agg(F.count_distinct("character").alias("n"), F.min("character").alias("character")).filter("n = 1")
    return one.groupBy("figure_id").agg(F.min_by("character", "at").alias("character")).withColumn("source", F.lit(source))


def derived(figures: DataFrame, sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """Each figure's character from the first source that confirms one: figure_id, character, source."""
    guesses = staged(candidates(figures), "guesses")
    found = [confirmed(guesses, known, name).withColumn("place", F.lit(i)) for i, (name, known) in enumerate(sources)]
    rows = reduce(DataFrame.unionByName, found)
    best = rows.groupBy("figure_id").agg(F.min_by(F.struct("character", "source"), "place").alias("b")).select("figure_id", "b.*")
    return figures.select("figure_id").join(best, "figure_id", "left")


def confirmed_tags(tags: DataFrame, works: DataFrame) -> DataFrame:
    """(figure_id, tag): the most used tag if the confirmed ones all name one character.

    tags: figure_id, tag, name_matches, post_count. works: tag, series_matches.
    """
    rows = tags.filter("name_matches").join(works.filter("series_matches").select("tag").distinct(), "tag", "left_semi").withColumn("name", F.lower(names.parsed_tag(F.col("tag"))["name"]))
    return rows.groupBy("figure_id").agg(F.count_distinct("name").alias("n"), F.max_by("tag", F.struct("post_count", "tag")).alias("tag")).filter("n = 1").drop("n")


def widened(figures: DataFrame, people: DataFrame) -> DataFrame:
    """(figure_id, part, character): figures of several characters, where every part is one character of the franchise, its own series' first.

    figures: figure_id, name, series, franchise. people: franchise, series, character.
    """
    parts = figures.select("figure_id", "series", "franchise", F.explode(names.split_characters(F.col("name"), F.array("series"))).alias("part"))
    parts = staged(keyed(parts, "part"), "parts")
    n_parts = parts.groupBy("figure_id").agg(F.count("*").alias("n_parts"))
    pool = keyed(people.withColumnRenamed("series", "home"), "character", "k")
    hits = one_within_other(parts, pool, "franchise", "key", "k").filter(names_match(F.col("key"), F.col("k")) | same_character(F.col("key"), F.col("k"), True)).withColumn("own", F.col("series").eqNullSafe(F.col("home")))
    best = hits.withColumn("any_own", F.max("own").over(W.partitionBy("figure_id", "part"))).filter(F.col("own") == F.col("any_own"))
    one = best.groupBy("figure_id", "part").agg(F.count_distinct("character").alias("n"), F.min("character").alias("character")).filter("n = 1").drop("n")
    whole = one.join(n_parts, "figure_id").withColumn("found", F.count("*").over(W.partitionBy("figure_id"))).filter(F.col("found") == F.col("n_parts"))
    return whole.select("figure_id", "part", "character")


def best_series(found: DataFrame) -> DataFrame:
    """(figure_id, series): most hits, then most popular; a tie is none. found: figure_id, series, hits, popularity."""
    order = W.partitionBy("figure_id").orderBy(F.desc("hits"), F.desc("popularity"))
    best = found.withColumn("r", F.rank().over(order)).filter("r = 1")
    return best.groupBy("figure_id").agg(F.when(F.count("*") == 1, F.min("series")).alias("series"))


def merged(bridge: DataFrame, people: DataFrame, keep: str, drop: str) -> tuple[DataFrame, DataFrame]:
    """The bridge (figure_id, character) and people (character, aliases) with one character folded into another, its name an alias."""
    moved = bridge.withColumn("character", F.when(F.col("character") == drop, keep).otherwise(F.col("character"))).distinct()
    gone = people.filter(F.col("character") == drop).select(F.lit(keep).alias("character"), F.concat(F.array(F.lit(drop)), F.coalesce("aliases", F.array().cast("array<string>"))).alias("more"))
    rest = people.filter(F.col("character") != drop).join(gone, "character", "left")
    aliases = F.array_except(F.array_distinct(F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.coalesce("more", F.array().cast("array<string>")))), F.array("character"))
    return moved, rest.select(*(aliases.alias("aliases") if c == "aliases" else F.col(c) for c in people.columns))
