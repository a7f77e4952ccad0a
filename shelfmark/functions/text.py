"""Text rules of titles and names, as columns.

Unicode normalisation has no built-in function, so it is one Arrow UDF (``unicode_form``); all
the rest is built-in expressions. ASCII word edges are written out, since those of Java
look at all letters.
"""

from __future__ import annotations

import unicodedata
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .columns import let

# Edges of ASCII words: any; and, in half the time, those before and behind what itself begins or ends with a character of words.
B = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
START, END = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
WHITE = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"

# Words that say nothing in titles, and words that mean others.
STOPWORDS = [
    "figure", "figures", "anime", "authentic", "genuine", "new", "sealed", "used", "japan", "japanese", "import", "from", "with", "and", "the", "for",
    "ver", "version", "official", "original", "pvc", "statue", "collection", "collectible", "us", "seller", "shipping", "free", "fs", "nib", "misb",
    "brand", "in", "box", "preorder", "pre", "order", "limited", "edition", "bonus", "tracking", "by", "action", "toy", "model", "scale", "stock", "ship",
    "ships", "item", "no",
]
SYNONYMS = {
    "swimwear": "swimsuit", "bathingsuit": "swimsuit", "nendo": "nendoroid", "bridal": "wedding", "xmas": "christmas",
    "qipao": "cheongsam", "chinadress": "cheongsam", "plushie": "plush", "plushies": "plush", "ichibankuji": "ichiban",
    "laminasta": "luminasta", "luminasuta": "luminasta", "figuart": "figuarts", "figurizmα": "figurizm", "figurisma": "figurizm", "shf": "figuarts",
}
UNITS = ["mm", "cm", "in", "inch", "inches"]


@F.pandas_udf(StringType())
def _nfd(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFD", t), na_action="ignore")


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


@F.pandas_udf(StringType())
def _nfkd(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKD", t), na_action="ignore")


def unicode_form(text: Column, form: str) -> Column:
    return {"NFD": _nfd, "NFKC": _nfkc, "NFKD": _nfkd}[form](text)


def replaced(text: Column, *pairs: tuple[str, str]) -> Column:
    for pattern, by in pairs:
        text = F.regexp_replace(text, pattern, by)
    return text


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, WHITE + "+", " "))


# What normalisation replaces: accents of Latin letters; then, in compatibility forms, digits by letters, and runs of signs and white space.
ACCENTS = (r"(\p{IsLatin})\p{Mn}+", "$1")
APART = [(r"([0-9])([a-z])", "$1 $2"), (r"([a-z])([0-9])", "$1 $2"), (r"[^\p{L}\p{N}/.-]+", " ")]
BETWEEN_WORDS = r"[\s/.-]+"


def normalized(text: Column) -> Column:
    """Lower case; accents of Latin letters dropped, compatibility forms joined; digits and letters set apart; signs to blanks."""
    return F.trim(replaced(unicode_form(replaced(unicode_form(F.lower(text), "NFD"), ACCENTS), "NFKC"), *APART))


def tokens_of(norm: Column) -> Column:
    """Distinct tokens of a normalised text: no sizes' units, single characters or stop words; synonyms joined."""
    words = F.split(norm, BETWEEN_WORDS)
    stop = F.array(*map(F.lit, STOPWORDS))
    unit = F.array(*map(F.lit, UNITS))
    kept = F.filter(words, lambda w, i: ~(F.array_contains(unit, w) & (i > 0) & F.get(words, i - 1).rlike("^[0-9]+$")))
    kept = F.filter(kept, lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w))
    same = F.create_map(*(F.lit(x) for pair in SYNONYMS.items() for x in pair))
    return F.array_distinct(F.transform(kept, lambda w: F.coalesce(same[w], w)))


def extracted(text: Column, pattern: str, group: int = 1) -> Column:
    got = F.regexp_extract(text, pattern, group)
    return F.when(got != "", got)


LINE_NUMBER = rf"{B}(?:nendoroid|figma)\s+(?:no\.?\s*)?((?:ex|sp|figfix)[\s-]?)?([0-9]{{1,4}})([\s-]?dx)?{B}"


def line_number(norm: Column) -> Column:
    """The loose product-line number of a normalised title, with its prefix and suffix."""
    return F.when(norm.rlike(LINE_NUMBER), F.trim(F.concat(*(F.regexp_extract(norm, LINE_NUMBER, i) for i in (1, 2, 3)))))


CANONICAL = r"^(?:(ex|sp|figfix)-?)?0*([0-9]{1,4})(-?dx)?[ab]?$"


def canonical_number(norm: Column) -> Column:
    """prefix:digits:suffix of a normalised number, or null."""
    bare = F.regexp_replace(norm, r"\s+", "")
    suffix = F.when(F.regexp_extract(bare, CANONICAL, 3) != "", "dx").otherwise("")
    return F.when(bare.rlike(CANONICAL), F.concat_ws(":", F.regexp_extract(bare, CANONICAL, 1), F.regexp_extract(bare, CANONICAL, 2), suffix))


SCALE = r"(?<![0-9.])1\s*[/:]\s*([0-9]{1,2}(?:\.[0-9]+)?)(?![0-9]|\.[0-9])"


def scale_of(text: Column) -> Column:
    """A scale such as 1/7; below one it turns round, as 1/0.5 to 2/1. Takes compatibility-composed text."""
    d = extracted(text, SCALE)
    number = d.try_cast("double")
    return F.when(number > 0, F.when(number < 1, F.concat(F.floor(1 / number + 0.5).cast("string"), F.lit("/1"))).otherwise(F.concat(F.lit("1/"), d)))


SIZE = rf"(?i)([0-9]{{1,3}}(?:\.[0-9])?)\s*-?\s*(mm|cm|inch|inches|in){B}"


def sizes_mm(norm: Column) -> Column:
    """All sizes of a normalised title between 20 and 2000 mm."""
    found = F.transform(F.arrays_zip(F.regexp_extract_all(norm, F.lit(SIZE), F.lit(1)).alias("n"), F.regexp_extract_all(norm, F.lit(SIZE), F.lit(2)).alias("u")), lambda z: z["n"].cast("double") * F.when(F.lower(z["u"]) == "mm", 1.0).when(F.lower(z["u"]) == "cm", 10.0).otherwise(25.4))
    return F.filter(found, lambda mm: (mm >= 20) & (mm <= 2000))


def release_number(title: Column) -> Column:
    """struct(line, number): marked numbers before bare ones, none that a unit follows, the greatest."""
    unit = r"(?!\s*(?:cm|mm|in(?![A-Za-z0-9_])|inch|[\"'”″]|(?:th|st|nd|rd)(?![A-Za-z0-9_])|\.[0-9]|\s*-\s*[0-9]+\s*(?:cm|mm)))"

    def best(pattern: str) -> Column:
        zipped = F.arrays_zip(F.regexp_extract_all(title, F.lit(pattern), F.lit(2)).alias("n"), F.regexp_extract_all(title, F.lit(pattern), F.lit(1)).alias("line"))
        found = F.transform(zipped, lambda z: F.struct(z["n"].cast("int").alias("number"), F.upper(z["line"]).alias("line")))
        return F.array_max(F.filter(found, lambda s: s["number"] > 0))

    marked = best(rf"(?i){B}(nendoroid|figma)\s*(?:no\.?|#)\s*([0-9]{{2,4}}){B}{unit}")
    bare = best(rf"(?i){B}(nendoroid|figma)\s+([0-9]{{3,4}}){B}{unit}")
    got = F.coalesce(marked, bare)
    return F.when(got.isNotNull(), F.struct(got["line"].alias("line"), got["number"].cast("string").alias("number")))


def product_name(nfkc: Column) -> Column:
    """A compared form of a compatibility-composed name."""
    return F.trim(replaced(F.lower(nfkc), (rf"{B}version{B}", "ver"), (r"[^\p{L}\p{N}]+", " ")))


def series_name(nfkc: Column) -> Column:
    return squeezed(replaced(F.lower(nfkc), ("[×✕╳]", " x "), ("['’‘`´\"“”]", ""), (r"[～〜:\-–—!?,./()\[\]{}★☆♪＊*_+|@#$%^&=;]", " ")))


def romaji_key(nfkd: Column) -> Column:
    """Letters and digits; long vowels shortened, so that spellings of one name meet."""
    return replaced(F.lower(nfkd), ("[^a-z0-9 ]", ""), ("ou", "o"), ("([aeiou])\\1+", "$1"))


def names_match(a: Column, b: Column) -> Column:
    """Equal keys, also as sorted words."""
    words = lambda c: F.array_sort(F.split(F.trim(c), " +"))
    return (a != "") & ((a == b) | (words(a) == words(b)))


def same_character(a: Column, b: Column, within_series: bool = False) -> Column:
    """One name's words are all among the other's: two words at least, or within a series one of three letters."""
    x, y = F.split(a, " +"), F.split(b, " +")
    small, large = F.when(F.size(x) <= F.size(y), x).otherwise(y), F.when(F.size(x) <= F.size(y), y).otherwise(x)
    enough = (F.size(small) >= 2) | (F.lit(within_series) & F.exists(small, lambda w: F.length(w) >= 3))
    return (a == b) | (enough & (F.size(F.array_except(small, large)) == 0))


GENERIC_WORDS = ["nendoroid", "figma", "pop", "parade", "scale", "figure", "ver", "version", "good", "smile", "company", "max", "factory", "doll", "plus", "series", "the", "and", "with", "set", "limited", "bonus", "edition", "anniversary"]


def prefilter_words(product: Column, count: int = 3) -> Column:
    """The longest distinct telling words of a compared name."""
    long = F.filter(F.array_distinct(F.split(product, " ")), lambda w: F.length(w) > 2)
    telling = F.filter(long, lambda w: ~F.array_contains(F.array(*map(F.lit, GENERIC_WORDS)), w))
    longest = F.array_sort(telling, lambda a, b: F.length(b) - F.length(a))
    return F.slice(F.when(F.size(telling) > 0, longest).otherwise(long), 1, count)


def slug(nfkd: Column) -> Column:
    return F.substring(replaced(F.lower(F.regexp_replace(nfkd, r"[\x{300}-\x{36F}]", "")), ("[^a-z0-9]+", "-"), ("^-+|-+$", "")), 1, 80)


def search_text(terms: Column, most: int = 2000) -> Column:
    """Distinct terms in lower case, in order, joined, cut at a joint."""
    clean = F.array_distinct(F.filter(F.transform(terms, lambda t: F.lower(F.trim(t))), lambda t: t.isNotNull() & (t != "")))
    joined = F.array_join(clean, " · ")
    cut = F.regexp_replace(F.substring(joined, 1, most + 3), r" · (?:(?! · )(?s:.))*$", "")
    return F.when(F.length(joined) <= most, joined).otherwise(F.substring(cut, 1, most))


def condition_of(text: Column) -> Column:
    """A stated condition by ordered rules. "Unopened" holds "open", and so counts as opened, as listings have always been read."""
    t = F.lower(text)
    return (
        F.when(t.isNull() | (t == ""), "UNKNOWN")
        .when(t.rlike(r"(^|[^A-Za-z0-9_])(new|brand new|nib|misb|sealed|unopened)"), F.when(t.contains("open"), "NEW_OPENED").otherwise("NEW_SEALED"))
        .when(t.rlike("damaged|broken|parts only|for parts|junk"), "DAMAGED").when(t.rlike("missing|incomplete|no box"), "USED_INCOMPLETE")
        .when(t.rlike("used|pre-owned|preowned|second hand|open box"), "USED_COMPLETE").otherwise("UNKNOWN")
    )


# Patterns that tell what a listing or product is.
ACCESSORY = [r"(eye\s+)?decal\s+set", r"(option(al)?\s+)?parts?\s+set", r"hand\s+set", r"expansion\s+parts", r"joint\s+set", r"chopstick\s+rests?", r"tapinui", r"dualsense|dualshock|wireless controller", r"fitbit|smart ?watch", r"keycaps?", r"wallet|slippers"]
ACCESSORY_ENDS = rf"(?i){START}(flocked\s+)?(earrings|necklace)\s*(\([^)]*\)\s*)?$|^\[(?:switch(?: 2)?|ps[45]|xbox[^\]]*|pc)\]"
MERCHANDISE = r"card sleeves?|sleeve collection|t[- ]?shirts?|parka|hoodie|sweatshirt|keychains?|key ?rings?|tote ?bags?|posters?|tapestr(?:y|ies)|badges?|pin ?backs?|stickers?|decals?|ac[ry][cy]lic (?:\w+ )?(?:stand|charm)|mouse ?pads?|towels?|mugs?|blankets?|cushions?|pillow ?cases?|dvds?|blu[- ]?rays?|\d+ disc|disc set|box ?set|complete (?:series|season|collection)|season \d|comics?|newsstand|graphic novel|manga vol|art ?book|light novel|paperback|trading cards?|tcg|booster (?:box|pack)|psa \d|nintendo switch|playstation|ps[45]|xbox|game cartridge|vol(?:ume)?s?|books?"
FIGURE_WORDS = r"nendoroid|figma|figure|figures|statue|bust|pop[- ]?up[- ]?parade|scale|prize|garage kit|model kit|doll|plushie|figurine|1\s*/\s*\d{1,2}(?:th)?"
UNOFFICIAL = r"3\s?d[-\s]?print(?:ed|ing)?|hand[-\s]?made|various\s+sizes|made[-\s]to[-\s]order|custom[-\s]made|bootleg|fan[-\s]?made|fan[-\s]?art|unofficial"
PARTS_ONLY = r"(?:replace?me?n?t|spare)\s+(?:parts?|weapons?|swords?|hands?|heads?|faces?)|parts?\s+only"
PARTS_WITH = r"(?:with|w\/|includes?|including|no|without)\s+(?:\w+\s+){0,3}(?:replace?me?n?t|spare)|(?:replace?me?n?t|spare)\s+(?:\w+\s+)?parts?\s+(?:included|incl)"
NSFW = {"cast-off": r"cast[- ]?off", "nude": "nude", "r18": "R-?18", "adult-only": "adult only", "b-style": "B-?style", "bunny": "bunny (?:ver|suit|girl)"}
NON_FIGURE = [
    "shirt", "tshirt", "tee", "hoodie", "keychain", "keyring", "poster", "standee", "badge", "mousepad", "tapestry", "wallscroll", "doujinshi", "artbook",
    "soundtrack", "dakimakura", "pillowcase", "mug", "tumbler", "coaster", "tote", "calendar", "lanyard",
]
BONUS_BEFORE = [
    "with", "includes", "including", "inc", "plus", "bonus", "free", "and", "w",
]
MULTIPACK = ["surprise", "blindbox", "gashapon", "bundle", "lot"]
MULTIPACK_PATTERN = rf"{START}(?:set|box|pack|lot)\s+of\s+[0-9]+{END}|{START}[0-9]+\s*(?:pcs|pieces){END}"
NON_FIGURE_PHRASES = ["nendoroid more", "exchange face", "face plate", "accessory set", "parts only", "for parts", "display case", "acrylic stand", "set or single", "or singles", "singles or set", "your choice", "pick one", "choose one"]


def word(pattern: str) -> str:
    """The pattern as whole words; each of its alternatives begins and ends with a character of ASCII words."""
    return rf"(?i){START}(?:{pattern}){END}"


def holds_any(text: Column, parts: list[str]) -> Column:
    return reduce(or_, (text.contains(p) for p in parts))


def is_accessory(name: Column) -> Column:
    return F.coalesce(name.rlike(word("|".join(ACCESSORY))) | name.rlike(ACCESSORY_ENDS), F.lit(False))


def is_not_a_figure(title: Column) -> Column:
    return title.rlike(word(MERCHANDISE)) & ~title.rlike(word(FIGURE_WORDS))


def is_unofficial(title: Column) -> Column:
    return title.rlike(word(UNOFFICIAL))


def is_accessory_listing(title: Column) -> Column:
    return (is_accessory(title) & ~title.rlike(word("bonus"))) | (title.rlike(word(PARTS_ONLY)) & ~title.rlike(word(PARTS_WITH)))


def names_other_goods(norm: Column) -> Column:
    """A word for other goods that no word for a bonus stands before, within two words. Only texts that hold such a word are split."""
    other, bonus = [*NON_FIGURE, *(w + "s" for w in NON_FIGURE)], F.array(*map(F.lit, BONUS_BEFORE))
    after_bonus = lambda words, i: F.coalesce(F.array_contains(bonus, F.get(words, i)), F.lit(False))
    hits = lambda words: F.exists(F.transform(words, lambda w, i: w.isin(other) & ~after_bonus(words, i - 1) & ~after_bonus(words, i - 2)), lambda h: h)
    return holds_any(norm, NON_FIGURE) & let(F.filter(F.split(norm, BETWEEN_WORDS), lambda w: w != ""), hits)


def is_several(norm: Column, tokens: Column) -> Column:
    """A multipack, or a phrase that no single figure has. The tokens are those of norm, and are looked at only if it holds one of a multipack."""
    pack = holds_any(norm, MULTIPACK) & F.arrays_overlap(tokens, F.array(*map(F.lit, MULTIPACK)))
    return pack | norm.rlike(MULTIPACK_PATTERN) | holds_any(norm, NON_FIGURE_PHRASES)


def is_not_a_single_figure(norm: Column, tokens: Column) -> Column:
    return names_other_goods(norm) | is_several(norm, tokens)


def nsfw(tags: Column, name: Column, retailer: str = "retailer") -> Column:
    """struct(nsfw, source) from a retailer's tags, else from key words of the name, else null."""
    lower = F.transform(tags, lambda t: F.lower(F.trim(t)))
    verdict = lambda flag, source: F.struct(F.lit(flag).alias("nsfw"), F.lit(source).alias("source"))
    by_tag = F.when(F.array_contains(lower, "nsfw"), verdict(True, retailer)).when(F.array_contains(lower, "sfw"), verdict(False, retailer))
    by_name = None
    for term, pattern in NSFW.items():
        hit = name.rlike(word(pattern))
        by_name = F.when(hit, verdict(True, f"keyword:{term}")) if by_name is None else by_name.when(hit, verdict(True, f"keyword:{term}"))
    return F.coalesce(by_tag, by_name)


# Entities of product pages; the ampersand comes last.
ENTITIES = [("&nbsp;", " "), ("&quot;", '"'), ("&#0*39;|&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&hellip;", "…"), ("&ndash;", "–"), ("&mdash;", "—"), ("&times;", "×"), ("&amp;", "&")]


def decoded_entities(text: Column) -> Column:
    return replaced(text, *ENTITIES)


def stripped_tags(html: Column) -> Column:
    return squeezed(decoded_entities(replaced(html, ("(?s)<!--.*?-->", " "), (r"(?is)<(script|style)\b.*?</\1>", " "), ("<[^>]*>", " "))))


def price_jpy(text: Column) -> Column:
    """A price in yen with any of its signs."""
    return F.regexp_replace(F.coalesce(extracted(text, r"[¥￥]\s*([0-9][0-9,]*)"), extracted(text, r"([0-9][0-9,]*)\s*(?:円|JPY|yen)")), ",", "").cast("int")


def height_mm(text: Column) -> Column:
    """A height in mm: one that is named so first, else any."""
    unit = lambda n, u: F.round(n.try_cast("double") * F.when(F.lower(u) == "cm", 10.0).otherwise(1.0)).cast("int")
    named, plain = r"(?i)(?:height|全高|H)\D{0,12}([0-9]+(?:\.[0-9]+)?)\s*(mm|cm)", r"(?i)([0-9]+(?:\.[0-9]+)?)\s*(mm|cm)"
    return F.coalesce(unit(extracted(text, named), extracted(text, named, 2)), unit(extracted(text, plain), extracted(text, plain, 2)))


def jan_code(text: Column) -> Column:
    return extracted(text, r"(?<![0-9])(4[59][0-9]{11})(?![0-9])")


def is_https(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("PROTOCOL")) == "https", F.lit(False))


def is_web(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("PROTOCOL")).isin("http", "https"), F.lit(False))


# Marks of automated readers.
BOTS = ["bot", "crawl", "spider", "slurp", "preview", "fetch", "monitor", "curl", "wget", "python-requests", "headless", "lighthouse", "facebookexternalhit", "scrapy", "axios"]


def looks_automated(agent: Column) -> Column:
    return agent.isNull() | F.lower(agent).rlike("|".join(BOTS))


def subject_hash(salt: str, subject: Column) -> Column:
    return F.sha2(F.concat(F.lit(salt), subject), 256)


def signed_header(header: Column) -> Column:
    """struct(kid, signature) of a notification's base 64 header; null if it holds no JSON with both."""
    got = F.from_json(F.try_to_binary(header, F.lit("base64")).cast("string"), "kid string, signature string")
    return F.when(got["kid"].isNotNull() & got["signature"].isNotNull(), got)


def challenge_answer(challenge: Column, token: str, endpoint: str) -> Column:
    """What a marketplace wants to hear before it sends notifications."""
    return F.sha2(F.concat(challenge, F.lit(token), F.lit(endpoint)), 256)
