"""Names of characters and products: Japanese parts, readings, tags, and the names a title may hold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import let
from .text import B, extracted, replaced

KANA_OR_KANJI = r"[\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{4E00}-\x{9FFF}]"
WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
NARROW = "".join(chr(c) for c in range(0x21, 0x7F)) + " "
OPEN, CLOSE = r"[(（\[［〈＜【]", r"[)）\]］〉＞】]"


def half_width(text: Column) -> Column:
    return F.translate(text, WIDE, NARROW)


def plain(text: Column) -> Column:
    """Half width, a middle dot between Latin words as a blank, no signs at the end."""
    return F.trim(replaced(half_width(text), ("([A-Za-z0-9])・(?=[A-Za-z0-9])", "$1 "), (r"[\s:：\-–—]+$", "")))


def split_japanese(raw: Column) -> Column:
    """struct(name, name_ja): a Japanese name in brackets at the end, after a Latin one. A bracket cut off inside
    Japanese text goes; brackets may hold one more pair."""
    inner = rf"(?:[^()（）\[\]［］〈〉＜＞【】]|{OPEN}[^()（）\[\]［］〈〉＜＞【】]*{CLOSE})*"
    whole, cut = rf"(?s)^(.*?){OPEN}({inner}){CLOSE}\s*$", rf"(?s)^(.+){OPEN}([^)）\]］〉＞】]*)$"
    head, inside = F.regexp_extract(raw, whole, 1), F.trim(F.regexp_extract(raw, whole, 2))
    has = inside.rlike(KANA_OR_KANJI) & head.rlike("[A-Za-z0-9]")
    short = F.regexp_extract(raw, cut, 1)
    broken = F.regexp_extract(raw, cut, 2).rlike(KANA_OR_KANJI) & short.rlike("[A-Za-z0-9]")
    name = F.when(broken, plain(short)).when(has, plain(head)).otherwise(plain(raw))
    return F.when(raw.isNotNull(), F.struct(name.alias("name"), F.when(has & ~broken, inside).alias("name_ja")))


def split_reading(raw: Column) -> Column:
    """struct(name, reading): brackets at the end that hold hiragana, and neither katakana nor kanji."""
    pattern = r"^(.*?\S)\s*[（(]([^()（）]+)[)）]\s*$"
    inside = F.trim(F.regexp_extract(raw, pattern, 2))
    has = inside.rlike(r"[\x{3041}-\x{309F}]") & ~inside.rlike(r"[\x{4E00}-\x{9FFF}\x{30A1}-\x{30FA}\x{30FD}\x{30FE}]")
    return F.when(raw.isNotNull(), F.struct(F.when(has, F.trim(F.regexp_extract(raw, pattern, 1))).otherwise(F.trim(raw)).alias("name"), F.when(has, inside).alias("reading")))


def parsed_tag(raw: Column) -> Column:
    """struct(name, qualifiers) of a tag such as saber_(fate)_(alter)."""
    words = lambda t: F.initcap(F.trim(F.replace(t, F.lit("_"), F.lit(" "))))
    return F.struct(words(F.regexp_replace(raw, r"(_\([^()]+\))+$", "")).alias("name"), F.transform(F.regexp_extract_all(F.regexp_extract(raw, r"((?:_\([^()]+\))+)$", 1), F.lit(r"_\(([^()]+)\)"), F.lit(1)), words).alias("qualifiers"))


# Product lines that names begin with, and what may follow a name.
LINES = ["nendoroid doll", "nendoroid petite", "nendoroid petit", "nendoroid more", "nendoroid co-de", "nendoroid", "figma", "pop up parade l", "pop up parade", "medicchu", "parfom r!", "parfom", "act mode", "tenitol", "huggy good smile", "look up", "hello! good smile", "chibi kyun-chara", "super situation figure", "figure collection"]
QUALIFIERS = r"(?i)(?:(?:\s*[:\-–—]\s*[^:]*(?<![a-z])ver\.?|\s+ver\.?|\s+dx(?:\s+ver\.?)?|\s*\((?:reissue|rerelease)\)|\s+(?:\d+(?:st|nd|rd|th)|second)\s+ascension)\s*)+$"
SEVERAL = rf"(?i){B}(?:figure\s+(?:set|collection)|\d\s+figure\s+set|set\s+of\s+\d|vs\.?|diorama|village)(?![A-Za-z0-9_])|\s&\s"
JOINTS = r"\s*[:\-–—]\s*"


def without_line(name: Column) -> Column:
    pattern = "|".join(line.replace("!", r"\!").replace("-", r"\-") for line in LINES)
    return F.regexp_replace(name, rf"(?i)^(?:{pattern})[\s:]+", "")


def without_qualifiers(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(name), QUALIFIERS, ""))


def without_series(name: Column, series: Column) -> Column:
    """A name without its series' words, where these are long enough to be told."""
    words = F.filter(F.split(series, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    pattern = F.concat(F.lit("(?i)"), F.array_join(words, r"[^\p{L}\p{N}]{0,3}"))
    telling = (F.size(words) > 1) | (F.length(F.get(words, F.lit(0))) >= 6)
    return F.when(telling, replaced(F.regexp_replace(name, pattern, F.lit(" ")), (r"\s+", " "), (r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))).otherwise(name)


def distinct_names(names: Column) -> Column:
    """Names of two characters or more, each once whatever its case, in order."""
    first = lambda kept: lambda lower: F.filter(kept, lambda n, i: F.array_position(lower, F.lower(n)) == i + 1)
    return let(F.filter(names, lambda n: n.isNotNull() & (F.length(n) >= 2)), lambda kept: let(F.transform(kept, lambda n: F.lower(n)), first(kept)))


def character_candidates(name: Column, series: Column) -> Column:
    """The names by which a figure's one character may be known; none for sets."""
    none = F.array().cast("array<string>")

    def of(base: Column) -> Column:
        stripped = F.transform(F.coalesce(series, none), lambda s: without_qualifiers(without_line(without_series(base, s))))
        parts = F.transform(F.split(base, "/"), without_qualifiers)
        first = F.concat(F.array(base), stripped, F.array(F.get(F.split(base, JOINTS), F.lit(0)), F.trim(F.get(F.split(base, r"\s*[\[(（]"), F.lit(0)))), F.when(base.contains("/"), parts).otherwise(none))
        return let(first, lambda names: distinct_names(F.concat(names, F.transform(names, lambda c: F.trim(F.get(F.split(c, JOINTS), F.lit(0)))))))

    return F.when(name.rlike(SEVERAL), none).otherwise(let(without_qualifiers(without_line(name)), of))


def split_characters(name: Column, series: Column) -> Column:
    """The two to six names that a figure of several characters joins, else none."""
    base = F.aggregate(F.coalesce(series, F.array().cast("array<string>")), without_qualifiers(without_line(name)), lambda b, s: let(without_qualifiers(without_series(b, s)), lambda x: F.when(x != "", x).otherwise(b)))
    none = F.array().cast("array<string>")

    def of(head: Column) -> Column:
        joined, slashed = F.split(head, r"(?i)\s+(?:&|×|\+|and)\s+"), F.filter(F.split(F.regexp_replace(head, rf"{B}1\s*/\s*\d{{1,2}}{B}", " "), "/"), lambda p: F.trim(p) != "")
        return F.when(F.size(joined) >= 2, joined).when(F.size(slashed) >= 3, slashed).otherwise(none)

    listed = let(F.trim(F.get(F.split(F.get(F.split(base, JOINTS), F.lit(0)), r"\s*[\[(（]"), F.lit(0))), of)
    parts = F.filter(F.transform(listed, without_qualifiers), lambda p: F.length(p) >= 2)
    return let(parts, lambda p: F.when(F.size(p).between(2, 6), distinct_names(p)).otherwise(none))


def alternatives(title: Column) -> Column:
    """"A (B)" as [A, B]."""
    pattern = r"^(.+?)\s*\(([^()]+)\)\s*$"
    return F.when(title.rlike(pattern), F.array(F.regexp_extract(title, pattern, 1), F.regexp_extract(title, pattern, 2))).otherwise(F.array(title))


MAKERS_IN_TITLE = r"(?i)(?<![a-z])(good smile|max factory|alter|kotobukiya|banpresto|sega|taito|furyu|megahouse|bandai)(?![a-z])"


def maker_in(title: Column) -> Column:
    """The longest maker's name in a title."""
    found = F.transform(F.regexp_extract_all(title, F.lit(MAKERS_IN_TITLE), F.lit(1)), lambda m: F.struct(F.length(m).alias("n"), F.lower(m).alias("maker")))
    return F.array_max(found)["maker"]


def form_in(title: Column) -> Column:
    return F.when(title.rlike("(?i)nendoroid"), "nendoroid").when(title.rlike("(?i)figma"), "figma").when(title.rlike("(?i)plush"), "plush").when(title.rlike(r"1\s*/\s*[0-9]"), "scale").when(title.rlike("(?i)prize"), "prize").otherwise("unknown")


def search_query(parts: Column, most: int = 100) -> Column:
    return F.trim(F.substring(F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), " "), 1, most))


def own_shop_query(name: Column, nendoroid: Column, figma: Column, most: int = 100) -> Column:
    """What a maker's own shop is asked: the number of a line, without leading zeros, else the name without what stands in brackets."""
    plain_name = F.trim(F.regexp_replace(F.regexp_replace(name, r"\s*[（(][^)）]*[)）]\s*", " "), r"\s+", " "))
    number = lambda n: n.try_cast("long").cast("string")
    return F.coalesce(F.concat(F.lit("Nendoroid "), number(nendoroid)), F.concat(F.lit("figma "), number(figma)), F.substring(plain_name, 1, most))


def local_query(name: Column, name_ja: Column) -> Column:
    """What a Japanese marketplace is asked: the Japanese name where there is one."""
    return F.coalesce(F.nullif(F.trim(name_ja), F.lit("")), F.trim(name))


def search_url(query: Column, url: str, param: str, more: dict[str, Column] | None = None) -> Column:
    """The address of a search, null where nothing is asked for; a further parameter that is null is left out."""
    said = [F.concat(F.lit(f"{url}?{param}="), F.url_encode(query)), *(F.concat(F.lit(f"&{k}="), F.url_encode(v)) for k, v in (more or {}).items())]
    return F.when(F.trim(query) != "", F.array_join(F.array(*said), ""))


def release_in_slug(url: Column) -> Column:
    return extracted(url, r"(?:nendoroid|figma)-(?:no-)?([0-9]{2,4})(?![0-9])")
