"""Keeping the catalogue clean: duplicates, folds, links, discoveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dates import month_key
from ..functions.staging import staged
from ..functions.text import series_name, unicode_form
from .tables import first_of_each


def unique_or_null(candidates: DataFrame, key: str, value: str, order: list[Column]) -> DataFrame:
    """Per key the best value, or null if several are best."""
    best = candidates.withColumn("r", F.rank().over(W.partitionBy(key).orderBy(*order))).filter("r = 1")
    return best.groupBy(key).agg(F.when(F.count("*") == 1, F.min(value)).alias(value))


def sole(candidates: DataFrame, key: str, value: str) -> DataFrame:
    """Per key its value if it has exactly one."""
    return candidates.groupBy(key).agg(F.count_distinct(value).alias("n"), F.min(value).alias(value)).filter("n = 1").drop("n")


def linked_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the least id reachable. Labels spread along edges and jump to their label's label, so long chains take few rounds."""
    both = staged(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = staged(nodes.select("id", F.col("id").alias("component")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        far = labels.select(F.col("id").alias("component"), F.col("component").alias("far"))
        new = labels.join(staged(near, "near"), "id", "left").join(far, "component", "left")
        new = staged(new.select("id", F.least("component", "near", "far").alias("component"), (F.least("component", "near", "far") < F.col("component")).alias("changed")), "labels")
        labels = new.select("id", "component")
        if new.filter("changed").isEmpty():
            return labels


# Words that name no series by themselves.
GENERIC_TITLE = ["original", "originals", "character", "characters", "series", "collection", "project", "works", "animation", "anime", "game", "the", "version", "ver"]


def series_keys(series: DataFrame) -> DataFrame:
    """(id, external_id, key, own): the compared forms of each series' name, Japanese title and synonyms."""
    names = F.concat(F.array(F.struct(F.col("name").alias("n"), F.lit(True).alias("own")), F.struct(F.col("title_ja").alias("n"), F.lit(False).alias("own"))), F.transform(F.coalesce("synonyms", F.array().cast("array<string>")), lambda s: F.struct(s.alias("n"), F.lit(False).alias("own"))))
    rows = series.select("id", "external_id", F.explode(names).alias("x")).select("id", "external_id", series_name(unicode_form(F.col("x.n"), "NFKC")).alias("key"), "x.own")
    return rows.filter("key IS NOT NULL AND key <> ''").groupBy("id", "external_id", "key").agg(F.max("own").alias("own"))


def duplicate_evidence(series: DataFrame) -> DataFrame:
    """Pairs (a, b, evidence), a < b: same entry, same name, known alias, or one contains the other.

    Two different external ids veto a pair. Containment is found by the rarest word of the
    shorter key, so no pairs are made that share only a common word.
    """
    keys = staged(series_keys(series), "series-keys")
    x, y = (keys.select(F.col("id").alias(s), F.col("external_id").alias(f"e{s}"), "key", F.col("own").alias(f"own_{s}")) for s in "ab")
    known = F.col("ea").isNotNull() & F.col("eb").isNotNull()
    named = x.join(y, "key").filter((F.col("a") < F.col("b")) & ~(known & (F.col("ea") != F.col("eb"))))
    named = named.filter(F.col("own_a") | F.col("own_b")).select("a", "b", F.when(known, 0).when(F.col("own_a") & F.col("own_b"), 1).otherwise(2).alias("rank"))
    ids = series.filter("external_id IS NOT NULL").select("id", "external_id")
    entry = ids.select(F.col("id").alias("a"), "external_id").join(ids.select(F.col("id").alias("b"), "external_id"), "external_id").filter("a < b").select("a", "b", F.lit(0).alias("rank"))
    words = keys.select("id", "external_id", "key", F.explode(F.array_distinct(F.split("key", " "))).alias("word"))
    often = words.groupBy("word").agg(F.count("*").alias("often"))
    size = F.size(F.array_distinct(F.split("key", " ")))
    short = words.join(often, "word").withColumn("i", F.row_number().over(W.partitionBy("id", "key").orderBy("often", "word"))).filter("i = 1")
    generic = F.array(*map(F.lit, GENERIC_TITLE))
    short = short.filter(~((F.size(F.split("key", " ")) == 1) & (F.length("key") < 6)) & (F.size(F.array_except(F.split("key", " "), generic)) > 0))
    s = short.select(F.col("id").alias("s"), F.col("external_id").alias("es"), F.col("key").alias("ks"), "word")
    long = words.select(F.col("id").alias("l"), F.col("external_id").alias("el"), F.col("key").alias("kl"), "word", size.alias("nl"))
    inside = s.join(long, "word").filter((F.col("s") != F.col("l")) & (F.size(F.split("ks", " ")) < F.col("nl")) & (F.size(F.array_except(F.split("ks", " "), F.split("kl", " "))) == 0) & ~(F.col("es").isNotNull() & F.col("el").isNotNull()))
    inside = inside.select(F.least("s", "l").alias("a"), F.greatest("s", "l").alias("b"), F.lit(3).alias("rank"))
    names = F.array(*map(F.lit, ["same entry", "same name", "known alias", "one contains the other"]))
    return named.unionByName(entry).unionByName(inside).groupBy("a", "b").agg(F.min("rank").alias("rank")).select("a", "b", F.get(names, F.col("rank")).alias("evidence"))


def duplicate_series(series: DataFrame, accept: tuple[str, ...] = ("same name", "known alias", "same entry")) -> DataFrame:
    """(id, component, canonical) of series in groups: canonical has an external entry, most figures, the shortest and plainest name."""
    pairs = duplicate_evidence(series).filter(F.col("evidence").isin(*accept))
    groups = linked_components(series.select("id"), pairs).join(series.select("id", "name", "external_id", "figure_count"), "id")
    order = W.partitionBy("component").orderBy(F.col("external_id").isNotNull().desc(), F.desc("figure_count"), F.length("name"), F.length(F.regexp_replace(unicode_form(F.col("name"), "NFKC"), "[^\\x{FF01}-\\x{FF5E}]", "")), "id")
    groups = groups.withColumn("size", F.count("*").over(W.partitionBy("component"))).filter("size > 1")
    return groups.select("id", "component", F.first("id").over(order).alias("canonical"))


def fold_survivors(figures: DataFrame, keys: list[str]) -> DataFrame:
    """Groups of figures of one identity with at most one number: (figure_id, survivor). The survivor has a number, most
    listings, the earliest release; a missing release counts as earliest."""
    group = W.partitionBy(*keys)
    order = group.orderBy(F.col("number").isNotNull().desc(), F.desc("listings"), F.col("release_date").asc_nulls_first(), "figure_id")
    rows = figures.filter(" AND ".join(f"{k} IS NOT NULL" for k in keys)).withColumn("n", F.count("*").over(group)).withColumn("low", F.min("number").over(group)).withColumn("high", F.max("number").over(group))
    rows = rows.filter((F.col("n") > 1) & (F.col("low").isNull() | (F.col("low") == F.col("high"))))
    return rows.select("figure_id", F.first("figure_id").over(order).alias("survivor"))


def rekeyed(children: DataFrame, folds: DataFrame, parent: str, child_key: str) -> DataFrame:
    """Children moved to the survivors; a row that a survivor has already of the same key goes, and of several that come the least stays."""
    moves = folds.filter("figure_id <> survivor")
    moved = children.join(moves.select(F.col("figure_id").alias(parent), "survivor"), parent)
    stay = children.join(moves.select(F.col("figure_id").alias(parent)), parent, "left_anti")
    moved = moved.withColumn(parent, F.col("survivor")).drop("survivor").join(stay.select(parent, child_key), [parent, child_key], "left_anti")
    return stay.unionByName(first_of_each(moved, [parent, child_key]).select(stay.columns))


def first_of_group(figures: DataFrame, keys: list[str]) -> DataFrame:
    """(figure_id, survivor): figures of one identity fold into that of the least id; a null in the identity folds nothing."""
    rows = figures.filter(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    return rows.select("figure_id", F.min("figure_id").over(W.partitionBy(*keys)).alias("survivor"))


def folded_tables(held: dict[str, DataFrame], folds: DataFrame, figures: str = "figures") -> dict[str, DataFrame]:
    """All tables after folds: rows of other tables move to the survivors, and the folded figures say what superseded them."""
    moves = folds.filter("figure_id <> survivor").select("figure_id", F.col("survivor").alias("__to"))

    def moved(rows: DataFrame) -> DataFrame:
        return rows.join(moves, "figure_id", "left").select(*(F.coalesce("__to", "figure_id").alias(c) if c == "figure_id" else F.col(c) for c in rows.columns))

    own = held[figures].join(moves, "figure_id", "left")
    own = own.select(*(F.coalesce("__to", "superseded_by").alias(c) if c == "superseded_by" else F.col(c) for c in held[figures].columns))
    return {name: own if name == figures else moved(rows) for name, rows in held.items()}


def discovered(titles: DataFrame, known: DataFrame, judged: DataFrame, least: int = 3, samples: int = 4) -> DataFrame:
    """Keys that enough different listings name and the catalogue lacks, without those already judged.

    titles: key, external_id, title. known, judged: key.
    """
    rows = titles.join(known.select("key").distinct(), "key", "left_anti").join(judged.select("key").distinct(), "key", "left_anti")
    found = rows.groupBy("key").agg(F.count_distinct("external_id").alias("listings"), F.slice(F.sort_array(F.collect_set("title")), 1, samples).alias("samples"))
    return found.filter(F.col("listings") >= least)


def linked_products(products: DataFrame, figures: DataFrame) -> DataFrame:
    """products with figure_id and by: by barcode, else by Japanese name and maker, else by maker, scale, height and
    month. Each needs exactly one figure; an ambiguous name stops the search."""
    squash = lambda c: F.lower(F.regexp_replace(unicode_form(F.col(c), "NFKC"), r"\s+", ""))
    spec = F.when(F.col("maker").isNotNull() & F.col("scale").isNotNull() & F.col("height_mm").isNotNull() & F.col("release_date").isNotNull(), F.concat_ws("|", F.lower(F.trim("maker")), "scale", F.col("height_mm").cast("string"), month_key(F.col("release_date"))))
    named = F.when(F.col("name_ja").isNotNull() & F.col("maker").isNotNull(), F.concat_ws("|", squash("name_ja"), squash("maker")))
    out = products.withColumn("__named", named).withColumn("__spec", spec).withColumn("__jan", F.col("jan"))
    keyed = figures.withColumn("__named", named).withColumn("__spec", spec).withColumn("__jan", F.col("jan"))
    for k in ("__jan", "__named", "__spec"):
        hits = keyed.filter(F.col(k).isNotNull()).groupBy(k).agg(F.count("*").alias(f"{k}_n"), F.min("figure_id").alias(f"{k}_id"))
        out = out.join(hits, k, "left")
    one = lambda k: F.col(f"{k}_n") == 1
    by = F.when(one("__jan"), "jan").when(one("__named"), "name").when(F.coalesce(F.col("__named_n"), F.lit(0)) > 1, None).when(one("__spec"), "specs")
    out = out.withColumn("by", by).withColumn("figure_id", F.when(by == "jan", F.col("__jan_id")).when(by == "name", F.col("__named_id")).when(by == "specs", F.col("__spec_id")))
    return out.select(*products.columns, "figure_id", "by")


def longest_prefix(names: DataFrame, prefixes: DataFrame) -> DataFrame:
    """names (id, name) with the longest prefix (prefix) that each begins with: an equi-join on its prefixes of the lengths there are."""
    lengths = prefixes.select(F.length("prefix").alias("n")).distinct()
    cut = names.join(lengths, F.length("name") >= F.col("n")).withColumn("prefix", F.expr("substring(name, 1, n)"))
    hits = cut.join(prefixes.select("prefix").distinct(), "prefix").groupBy("id").agg(F.max_by("prefix", "n").alias("prefix"))
    return names.join(hits, "id", "left")


#: A token of more rows than this is looked up in a small table, so its rows do not come together in one task.
HOT = 10_000


def leading_rows(held: DataFrame, rare: DataFrame, hot: DataFrame) -> DataFrame:
    """held without the rows of those hot tokens that are no name's rarest."""
    led = rare.join(F.broadcast(hot), "token", "left_semi").select("token").distinct()
    return held.join(F.broadcast(hot.join(F.broadcast(led), "token", "left_anti").select("token")), "token", "left_anti")


def titles_naming(titles: DataFrame, names: DataFrame) -> DataFrame:
    """(title_id, name_id): titles that hold all tokens of a name, found by the name's rarest token.

    titles: title_id, tokens. names: name_id, tokens. There are at most as many hot tokens as HOT goes into all rows of tokens.
    """
    held = titles.select("title_id", "tokens", F.explode("tokens").alias("token"))
    wanted = names.select("name_id", F.col("tokens").alias("wanted"), F.explode("tokens").alias("token"))
    both = held.select("token", F.lit(1).alias("title")).unionByName(wanted.select("token", F.lit(0).alias("title")))
    counts = staged(both.groupBy("token").agg(F.sum("title").alias("often"), F.count("*").alias("n")), "token-counts")
    hot, often = counts.filter(F.col("n") > HOT).select("token", "often"), counts.select("token", "often")
    rare = wanted.join(F.broadcast(hot), "token").unionByName(wanted.join(F.broadcast(hot), "token", "left_anti").join(often, "token", "left"))
    rare = rare.withColumn("i", F.row_number().over(W.partitionBy("name_id").orderBy(F.coalesce("often", F.lit(0)), "token"))).filter("i = 1")
    rare = staged(rare.select("name_id", "wanted", "token"), "rarest-tokens")
    return leading_rows(held, rare, hot).join(rare, "token").filter(F.size(F.array_except("wanted", "tokens")) == 0).select("title_id", "name_id")


def token_clusters(names: DataFrame, least: int = 2, most: int = 12) -> DataFrame:
    """Tokens that a few names share."""
    rows = names.select("name", F.explode(F.array_distinct(F.split(F.lower("name"), r"[^\p{L}\p{N}]+"))).alias("token")).filter(F.length("token") > 1)
    return rows.groupBy("token").agg(F.count_distinct("name").alias("n"), F.sort_array(F.collect_set("name")).alias("names")).filter(F.col("n").between(least, most))


def removals(figures: DataFrame, held: DataFrame, is_accessory: Column) -> DataFrame:
    """Accessories with why they may not be removed, or null: figures: figure_id, name, has_number; held: figure_id, kind."""
    kinds = held.groupBy("figure_id").agg(F.sort_array(F.collect_set("kind")).alias("kinds"))
    reason = F.when(F.col("has_number"), "has a number").when(F.size("kinds") > 0, F.concat(F.lit("held by "), F.array_join("kinds", ", ")))
    return figures.filter(is_accessory).join(kinds, "figure_id", "left").select("figure_id", "name", reason.alias("refused"))
