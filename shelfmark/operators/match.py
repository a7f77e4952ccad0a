"""Listing titles resolved to catalogue figures.

A pair is scored only if it can score at all. Without an equal number every descriptor
token of the figure must stand in the title, so a figure's rarest descriptor token leads to
its titles; without descriptor tokens a character's token or Japanese name must; and an equal
number leads by itself. The union of these joins holds every pair with a score above 0,
and no others are made.

titles: title_id, title, and optionally rejected (array of figure ids).
figures: figure_id, name, name_ja, scale, height_mm, category, maker, line_number, series,
series_aliases, characters, characters_ja. A null array is empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.staging import staged

ACCEPT = 0.6

# Words of the matching rules.
VARIANTS = [
    "swimsuit", "bikini", "bunny", "wedding", "dress", "cheongsam", "kimono", "yukata", "uniform", "cosplay", "maid", "santa", "christmas", "halloween",
    "nurse", "gothic", "lolita", "pajama", "pajamas", "sleepwear", "apron", "jersey", "sport", "sports", "summer", "winter", "spring", "autumn", "beach",
    "towel", "bath", "lingerie", "negligee", "tracksuit", "hoodie", "sweater", "casual", "school", "stage", "idol", "angel", "devil", "succubus", "armor",
    "armour", "battle", "party", "festival", "race", "queen", "cat", "bride", "racing", "police", "waitress", "cheerleader", "witch", "vampire",
    "kitsune", "miko",
]
GENERIC = ["scale", "figure", "statue", "model", "pvc", "complete", "series", "set", "deluxe", "standard", "normal", "regular", "base", "japan", "import"]
LINES = ["nendoroid", "figma", "parade", "maximatic", "grandista", "masterlise", "figuno", "ichibansho", "moderoid", "figuarts", "ichiban", "luminasta", "xstellar", "figurizm", "qyurume", "perching", "hikkake", "mdlx", "dlx", "plush", "spm"]
LINE_PHRASES = ["hello good smile", "hyper body", "trio try it", "super premium"]
CATEGORY_LINE = {"NENDOROID": "nendoroid", "FIGMA": "figma", "PLUSH": "plush"}
CATEGORY_PHRASE = {"HELLO_GOOD_SMILE": "hello good smile"}
KIT_LINES, KIT_CATEGORIES = ["moderoid"], ["MODEL_KIT", "OTHER"]
BANDAI_LINES, BANDAI = ["maximatic", "grandista", "masterlise", "figuno", "ichibansho", "figuarts", "ichiban"], "bandai|banpresto|tamashii"
SEGA_LINES, SEGA = ["luminasta", "xstellar", "figurizm", "qyurume", "perching"], "sega"
HOUSES = [["good smile company", "max factory", "freeing", "orange rouge", "phat!", "good smile arts shanghai", "goodsmile racing"], ["bandai spirits", "bandai", "bandai namco", "banpresto", "tamashii nations"]]
RIVALS = ["furyu", "banpresto", "taito", "megahouse", "kaiyodo", "aniplex", "union creative", "quesq", "emontoys", "pulchra", "estream", "hobby max", "funko", "bandai spirits", "yolopark"]
AMBIGUOUS_MAKERS = ["alter", "gift", "native", "plum", "wave", "wing", "other"]
MAKER_ALIASES = {"good smile company": ["gsc", "goodsmile", "good smile"], "max factory": ["maxfactory"], "bandai spirits": ["bandai", "banpresto"], "kotobukiya": ["kotobuki", "koto"], "ques q": ["quesq"], "aniplex": ["aniplex+", "aniplexplus"]}


def words(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def lookup(key: Column, table: dict) -> Column:
    """The array or string that a fixed table has for a key, else null."""
    out = F.lit(None)
    for k, v in table.items():
        out = F.when(key == k, words(v) if isinstance(v, list) else F.lit(v)).otherwise(out)
    return out


def within(part: Column, whole: Column) -> Column:
    return F.size(F.array_except(part, whole)) == 0


def title_features(titles: DataFrame) -> DataFrame:
    """What scoring needs of each title, once; titles that can match nothing have usable false."""
    rows = titles.withColumn("norm", T.normalized(F.col("title")))
    rows = rows.withColumn("tokens", T.tokens_of(F.col("norm")))
    strict = T.release_number(F.col("title"))["number"]
    phrase = F.regexp_replace(F.regexp_replace("norm", "-", " "), r"\s+", " ")
    refused = T.is_not_a_figure(F.col("title")) | T.is_unofficial(F.col("title")) | T.is_accessory_listing(F.col("title")) | T.is_not_a_single_figure(F.col("norm"), F.col("tokens"))
    number = T.canonical_number(T.line_number(F.col("norm")))
    return rows.select(
        "title_id", "title", "norm", "tokens", phrase.alias("phrase"), number.alias("number"), T.canonical_number(strict).alias("strict"), T.scale_of(T.unicode_form(F.col("title"), "NFKC")).alias("t_scale"),
        T.sizes_mm(F.col("norm")).alias("sizes"), ((F.size("tokens") > 0) & ~F.coalesce(refused, F.lit(False))).alias("usable"), (F.col("rejected") if "rejected" in titles.columns else F.lit(None).cast("array<string>")).alias("rejected"),
    )


def figure_features(figures: DataFrame) -> DataFrame:
    """What scoring needs of each figure, once."""
    none = F.array().cast("array<string>")
    listed = lambda c: F.coalesce(F.col(c), none)
    rows = figures.select("figure_id", "name", "name_ja", "scale", "height_mm", "category", F.lower("maker").alias("maker"), "line_number", "series", listed("series_aliases").alias("aliases"), listed("characters").alias("characters"), listed("characters_ja").alias("characters_ja"))
    # one row for each text, so that the Unicode function runs over plain columns
    forms = F.filter(F.concat(F.array("maker"), F.coalesce(lookup(F.col("maker"), MAKER_ALIASES), none)), lambda x: x.isNotNull())
    house = none
    for h in HOUSES:
        house = F.when(F.col("maker").isin(*h), words(h)).otherwise(house)
    house = F.when(F.size(house) > 0, house).otherwise(F.filter(F.array("maker"), lambda x: x.isNotNull()))
    house_forms = F.flatten(F.transform(house, lambda m: F.concat(F.array(m), F.coalesce(lookup(m, MAKER_ALIASES), none))))
    kinds = {"name": F.array("name"), "name_ja": F.array("name_ja"), "number": F.array("line_number"), "maker": forms, "house": house_forms, "series": F.concat(F.array("series"), F.col("aliases")), "first_series": F.array("series"), "own_maker": F.array("maker"), "character": F.col("characters")}
    tagged = lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("text"))
    texts = F.flatten(F.array(*(F.transform(v, tagged(k)) for k, v in kinds.items())))
    long = rows.select("figure_id", F.explode(texts).alias("x")).select("figure_id", "x.kind", "x.text").filter("text IS NOT NULL AND text <> ''")
    long = long.withColumn("norm", T.normalized(F.col("text")))
    long = long.withColumn("tokens", T.tokens_of(F.col("norm")))
    pick = lambda kind, what: F.collect_list(F.when(F.col("kind") == kind, F.col(what)))
    got = long.groupBy("figure_id").agg(
        F.max(F.when(F.col("kind") == "name", F.col("norm"))).alias("name_norm"), F.max(F.when(F.col("kind") == "name_ja", F.col("norm"))).alias("name_ja_norm"), F.max(F.when(F.col("kind") == "number", F.col("norm"))).alias("number_norm"),
        F.flatten(pick("name", "tokens")).alias("name_tokens"), pick("maker", "tokens").alias("maker_forms"), pick("house", "tokens").alias("house_forms"), pick("series", "tokens").alias("series_tokens"),
        F.flatten(pick("first_series", "tokens")).alias("first_series"), F.flatten(pick("own_maker", "tokens")).alias("own_maker"), F.flatten(pick("character", "tokens")).alias("character_tokens"),
    )
    out = rows.join(got, "figure_id", "left").withColumn("house", house)
    for c in ("name_tokens", "first_series", "own_maker", "character_tokens"):
        out = out.withColumn(c, F.coalesce(c, none))
    shared = F.concat("character_tokens", "first_series", "own_maker")
    return out.withColumn("f_number", T.canonical_number(F.col("number_norm"))).withColumn("descriptors", F.array_except("name_tokens", F.concat(shared, words(GENERIC)))).withColumn("explained", F.concat("name_tokens", shared)).withColumn("phrase_name", F.regexp_replace(F.regexp_replace("name_norm", "-", " "), r"\s+", " "))


def candidate_pairs(titles: DataFrame, figures: DataFrame) -> DataFrame:
    """(title_id, figure_id) of all pairs that can score above 0, and few others.

    A pair needs numbers that do not differ; an equal number or all descriptors in the title; and one of these: a character's
    token or Japanese name, an equal number that is marked as one (strict), or, with three descriptors or more, all tokens of the name. A
    figure is led by its rarest descriptor and its number, or by its characters' tokens and its rarest name token, whichever
    fewer titles hold.
    """
    t = titles.filter("usable")
    held = t.select("title_id", "number", F.explode("tokens").alias("token"))
    often = staged(held.groupBy("token").agg(F.count("*").alias("often")), "often")
    numbers = t.filter("number IS NOT NULL").select("title_id", "number", F.coalesce(F.col("strict") == F.col("number"), F.lit(False)).alias("strictly"))
    numbered = numbers.groupBy(F.col("number").alias("f_number")).agg(F.count("*").alias("same_number"))

    def counted(column: str) -> DataFrame:
        """figure_id with the tokens of a column, and how many titles hold each."""
        return figures.select("figure_id", F.explode(F.array_distinct(column)).alias("token")).join(often, "token", "left").select("figure_id", F.struct(F.coalesce("often", F.lit(0)).alias("often"), "token").alias("t"))

    rarest = lambda column, name: counted(column).groupBy("figure_id").agg(F.min("t").alias(name))
    japanese = F.exists("characters_ja", lambda ja: F.length(ja) > 1)
    alone = F.size("descriptors") >= 3
    led = figures.select("figure_id", "f_number", "descriptors", "character_tokens", "name_tokens", F.coalesce(japanese, F.lit(False)).alias("japanese"), alone.alias("alone"))
    led = led.join(rarest("descriptors", "by_descriptor"), "figure_id", "left").join(rarest("name_tokens", "by_name"), "figure_id", "left")
    led = led.join(counted("character_tokens").groupBy("figure_id").agg(F.sum("t.often").alias("by_character")), "figure_id", "left").join(numbered, "f_number", "left")
    descriptor_cost = F.col("by_descriptor.often") + F.coalesce("same_number", F.lit(0))
    character_cost = F.coalesce("by_character", F.lit(0)) + F.when(F.col("alone"), F.col("by_name.often")).otherwise(0)
    bare = F.size("descriptors") == 0
    led = staged(led.withColumn("by_words", bare | (~F.col("japanese") & (character_cost < descriptor_cost))), "led")

    # numbers that are both there must be equal; then, or if all descriptors are there, the pair stays
    gate = F.coalesce(F.col("f_number") == F.col("number"), F.col("descriptors_there"))
    joined = lambda by: held.join(by, "token").filter(F.coalesce(F.col("f_number") == F.col("number"), F.lit(True)))
    whole = lambda pairs: pairs.join(t.select("title_id", "tokens"), "title_id").withColumn("descriptors_there", within(F.col("descriptors"), F.col("tokens"))).filter(gate).select("title_id", "figure_id")
    keep = ["figure_id", "f_number", "descriptors"]
    by_number = numbers.join(led.withColumn("number", F.col("f_number")), "number").filter("strictly OR NOT by_words").select("title_id", "figure_id")
    leads = [
        led.filter("NOT by_words").select(*keep, F.col("by_descriptor.token").alias("token")),
        led.filter("by_words").select(*keep, F.explode(F.array_distinct("character_tokens")).alias("token")),
        led.filter("by_words AND alone").select(*keep, F.col("by_name.token").alias("token")),
    ]
    by_word = whole(joined(reduce(DataFrame.unionByName, leads).distinct()))
    # Japanese names are substrings: they are found by their first two characters among the title's pairs of characters
    grams = t.select("title_id", "title", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("title") - 1)), lambda i: F.col("title").substr(i, F.lit(2))))).alias("gram"))
    names = figures.filter(bare).select("figure_id", F.explode("characters_ja").alias("ja")).filter(F.length("ja") > 1).withColumn("gram", F.substring("ja", 1, 2))
    by_japanese = grams.join(names, "gram").filter(F.col("title").contains(F.col("ja"))).select("title_id", "figure_id")
    return reduce(DataFrame.union, [by_number, by_word, by_japanese]).distinct()


def score_of(pairs: DataFrame) -> DataFrame:
    """pairs of title and figure features with score, hits (name tokens found) and sized."""
    tk, c = F.col("tokens"), F.col
    has = lambda t: F.array_contains(tk, t)
    same_number = F.coalesce(c("f_number") == c("number"), F.lit(False))
    strictly = same_number & F.coalesce(c("strict") == c("f_number"), F.lit(False))
    named = F.arrays_overlap(c("character_tokens"), tk) | F.exists("characters_ja", lambda ja: (F.length(ja) > 1) & c("title").contains(ja)) | strictly
    alone = ~named & (F.size("descriptors") >= 3) & within(c("name_tokens"), tk)
    gate1 = named | alone

    line = lookup(c("category"), CATEGORY_LINE)
    foreign = F.filter(words(LINES), lambda x: has(x) & ~x.eqNullSafe(line) & ~F.array_contains(c("name_tokens"), x))
    house = lambda pattern: F.coalesce(c("maker").rlike(pattern), F.lit(False))
    excused = F.when(c("category").isin(*KIT_CATEGORIES), words(KIT_LINES)).otherwise(words([]))
    excused = F.concat(excused, F.when((c("category") == "OTHER") & house(BANDAI), words(BANDAI_LINES)).otherwise(words([])), F.when(c("category").isin("OTHER", "PRIZE") & house(SEGA), words(SEGA_LINES)).otherwise(words([])))
    gate3 = F.size(F.array_except(foreign, excused)) == 0
    phrase = lookup(c("category"), CATEGORY_PHRASE)
    for p in LINE_PHRASES:
        gate3 = gate3 & ~(c("phrase").contains(p) & ~F.lit(p).eqNullSafe(phrase) & ~F.coalesce(c("phrase_name").contains(p), F.lit(False)))
    own = F.exists("house_forms", lambda f: (F.size(f) > 0) & within(f, tk))
    rival = F.lit(False)
    for m in RIVALS:
        rival = rival | ((c("norm").contains(m) if " " in m else has(F.lit(m))) & ~F.array_contains("house", m))
    maker_ok = F.coalesce(own, F.lit(False)) | ~rival
    gate4 = same_number | within(c("descriptors"), tk)
    gate5 = ~F.coalesce(c("f_number") != c("number"), F.lit(False))
    gate6 = ~F.coalesce(c("scale") != c("t_scale"), F.lit(False))
    ratio = lambda low, high: F.exists("sizes", lambda mm: (mm / c("height_mm") >= low) & (mm / c("height_mm") <= high))
    tall = F.coalesce(c("height_mm") > 0, F.lit(False))
    gate7 = ~tall | (F.size("sizes") == 0) | ratio(0.5, 2.0)

    hits = F.size(F.array_intersect("name_tokens", "tokens"))
    strays = F.size(F.array_except(F.array_intersect(tk, words(VARIANTS)), c("explained")))
    maker_named = F.exists("maker_forms", lambda f: (F.size(f) > 0) & within(f, tk) & ~((F.size(f) == 1) & F.array_contains(words(AMBIGUOUS_MAKERS), f[0])))
    series_named = F.exists("series_tokens", lambda s: (F.size(s) > 0) & (F.size(F.array_intersect(s, tk)) / F.size(s) >= 0.5))
    add = lambda when, x: F.when(F.coalesce(when, F.lit(False)), F.lit(x)).otherwise(F.lit(0.0))
    score = F.when(F.size("name_tokens") > 0, hits / F.size("name_tokens") * 0.6).otherwise(0.0) - F.when(strays > 0, F.least(F.lit(0.6), 0.45 + (strays - 1) * 0.1)).otherwise(0.0)
    score = score + add(maker_named, 0.15) + add(series_named, 0.12) + add(c("scale") == c("t_scale"), 0.13) + add(same_number | has(c("line_number")), 0.2)
    score = score + add(c("norm").contains(c("name_ja_norm")), 0.25) - add(alone & (F.size("character_tokens") > 0), 0.02)
    passed = c("usable") & gate1 & gate3 & maker_ok & gate4 & gate5 & gate6 & gate7
    final = F.when(F.coalesce(passed, F.lit(False)), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).otherwise(0.0)
    return pairs.withColumn("score", final).withColumn("hits", hits).withColumn("sized", (tall & (F.size("sizes") > 0) & ratio(0.93, 1.07)).cast("int"))


def scored(titles: DataFrame, figures: DataFrame) -> DataFrame:
    """(title_id, figure_id, score, hits, sized) of all pairs that score above 0."""
    t, f = staged(title_features(titles), "titles"), staged(figure_features(figures), "figures")
    pairs = candidate_pairs(t, f).join(t, "title_id").join(f, "figure_id")
    return score_of(pairs).filter("score > 0").select("title_id", "figure_id", "score", "hits", "sized", "rejected")


def scored_naively(titles: DataFrame, figures: DataFrame) -> DataFrame:
    """The same from all pairs: for tests on a few rows."""
    return score_of(title_features(titles).crossJoin(figure_features(figures))).filter("score > 0").select("title_id", "figure_id", "score", "hits", "sized", "rejected")


def best_match(titles: DataFrame, figures: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Each title's figure and score: the best score of at least ACCEPT, then most name tokens, then a fitting size. A tie that remains is no match."""
    rows = (scored(titles, figures) if pairs is None else pairs).filter((F.col("score") >= ACCEPT) & ~F.coalesce(F.array_contains("rejected", F.col("figure_id").cast("string")), F.lit(False)))
    order = W.partitionBy("title_id").orderBy(F.round("score", 9).desc(), F.desc("hits"), F.desc("sized"))
    best = rows.withColumn("r", F.rank().over(order)).filter("r = 1").groupBy("title_id").agg(F.count("*").alias("n"), F.min("figure_id").alias("figure_id"), F.max("score").alias("score")).filter("n = 1")
    return titles.select("title_id").join(best.drop("n"), "title_id", "left")


def rematch(listings: DataFrame, matched: DataFrame) -> DataFrame:
    """listings (title_id, figure_id) against a new match: same, gained, lost or moved."""
    new = matched.select("title_id", F.col("figure_id").alias("new_id"), "score")
    old = F.col("figure_id")
    change = F.when(old.eqNullSafe(F.col("new_id")), "same").when(old.isNull(), "gained").when(F.col("new_id").isNull(), "lost").otherwise("moved")
    return listings.join(new, "title_id", "left").withColumn("change", change)


def applied_rematch(changes: DataFrame, moves: str = "all", only_unmatches: bool = False) -> DataFrame:
    """What rematch found, applied to listings: title_id, figure_id, applied.

    moves: all; none, which leaves moved listings where they are; or safe, which moves only those whose old and new figure differ in
    name and whose new one has no fewer tokens of the title: old_name, new_name, old_hits and new_hits, then columns of changes.
    only_unmatches: listings leave figures that they no longer match, and nothing else changes.
    """
    if moves not in ("all", "none", "safe"):
        raise ValueError("moves is all, none or safe")
    change = F.col("change")
    allowed = F.lit(moves == "all")
    if moves == "safe":
        allowed = F.coalesce((F.col("old_name") != F.col("new_name")) & (F.col("new_hits") >= F.col("old_hits")), F.lit(False))
    apply = (change == "lost") if only_unmatches else change.isin("lost", "gained") | ((change == "moved") & allowed)
    return changes.select("title_id", F.when(apply, F.col("new_id")).otherwise(F.col("figure_id")).alias("figure_id"), apply.alias("applied"))
