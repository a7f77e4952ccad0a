import unicodedata

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import text as T


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(make(F.col("t")).alias("x")).first().x


def normed(spark, value, make):
    return spark.createDataFrame([(value,)], "t string").withColumn("norm", T.normalized(F.col("t"))).select(make(F.col("norm")).alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "want"),
    [("Pokémon ガール", "pokemon ガール"), ("Nendoroid1935 DX", "nendoroid 1935 dx"), ("ﾐｸ　Ver.", "ミク ver."), ("A & B/C-D!", "a b/c-d"), ("", "")],
)
def test_normalized(spark, text, want):
    assert one(spark, text, T.normalized) == unicodedata.normalize("NFKC", want)


@pytest.mark.parametrize(
    ("text", "want"),
    [("Nendo figure of Miku 15 cm", ["nendoroid", "of", "miku", "15"]), ("bridal Bridal wedding", ["wedding"]), ("the in cm", ["cm"]), ("", [])],
)
def test_tokens(spark, text, want):
    assert normed(spark, text, T.tokens_of) == want


@pytest.mark.parametrize(("text", "want"), [("1:1", "1/1"), ("1/0.5", "2/1"), ("1/144", None), ("scale 1 / 7", "1/7"), ("11/7", None), ("1/7.5", "1/7.5")])
def test_scales(spark, text, want):
    assert one(spark, text, T.scale_of) == want


@pytest.mark.parametrize(
    ("title", "want"),
    [("Nendoroid No.1935", ("NENDOROID", "1935")), ("figma #200 and figma 300", ("FIGMA", "200")), ("Nendoroid 150 cm", None), ("figma 1234", ("FIGMA", "1234")), ("Nendoroid 12", None), ("figmaガ 300", None)],
)
def test_release_numbers(spark, title, want):
    got = one(spark, title, T.release_number)
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(("text", "want"), [("nendoroid no. 012-dx", ":12:dx"), ("figma ex-034", "ex:34:"), ("nendoroid 300b", ":300:"), ("other 12", None)])
def test_line_numbers(spark, text, want):
    assert one(spark, text, lambda c: T.canonical_number(T.normalized(T.line_number(T.normalized(c))))) == want


@pytest.mark.parametrize(("text", "want"), [("15cm and 7 inch", [150.0, 177.8]), ("5 mm", []), ("20.5 cm", [205.0])])
def test_sizes(spark, text, want):
    assert one(spark, text, lambda c: T.sizes_mm(T.normalized(c))) == pytest.approx(want)


@pytest.mark.parametrize(
    ("text", "want"),
    [("Brand New", "NEW_SEALED"), ("New, opened box", "NEW_OPENED"), ("Unopened", "NEW_OPENED"), ("box damaged", "DAMAGED"), ("no box", "USED_INCOMPLETE"), ("pre-owned", "USED_COMPLETE"), (None, "UNKNOWN"), ("renewed", "UNKNOWN")],
)
def test_conditions(spark, text, want):
    assert one(spark, text, T.condition_of) == want


@pytest.mark.parametrize(
    ("title", "rule", "want"),
    [
        ("Miku T-shirt", T.is_not_a_figure, True), ("Miku figure with poster", T.is_not_a_figure, False), ("3D printed Miku", T.is_unofficial, True), ("decal set", T.is_accessory, True),
        ("spare hands", T.is_accessory_listing, True), ("figure with spare hands", T.is_accessory_listing, False), ("bonus decal set", T.is_accessory_listing, False), (None, T.is_accessory, False),
    ],
)
def test_rules(spark, title, rule, want):
    assert one(spark, title, rule) is want


def test_other_goods(spark):
    assert [normed(spark, t, T.names_other_goods) for t in ("Miku keychains", "Miku with a keychain", "Miku")] == [True, False, False]


def test_other_goods_are_whole_words(spark):
    assert [normed(spark, t, T.names_other_goods) for t in ("smug keychainss", "with a new mug", "mug with/mug mugs.", None)] == [False, True, True, None]


def test_tokens_are_made_only_where_a_multipack_may_be(spark):
    assert not set(T.MULTIPACK) & set(T.SYNONYMS.values())
    rows = spark.createDataFrame([("miku racing figure", False), ("miku slot", False), ("miku bundle", True), ("set of 3", True), ("acrylic stand", True), (None, None)], "norm string, want boolean")
    dear = F.when(F.col("norm").isNull() | F.col("norm").rlike("slot|bundle"), T.tokens_of(F.col("norm"))).otherwise(F.raise_error(F.lit("tokens made")).cast("array<string>"))
    assert all(r.got is r.want for r in rows.select("want", T.is_several(F.col("norm"), dear).alias("got")).collect())


def test_edges_of_words(spark):
    edged = lambda p: rf"(?i){T.B}(?:{p}){T.B}"
    lists = ["|".join(T.ACCESSORY), T.MERCHANDISE, T.FIGURE_WORDS, T.UNOFFICIAL, T.PARTS_ONLY, T.PARTS_WITH, "bonus", *T.NSFW.values()]
    hits = ["decal set", "T-Shirts", "1/7", "3D-print", "spare hands", "with a spare", "w/ spare", "bonus", "R-18", "psa 9", "slippers", "nude"]
    titles = [a + h + b for h in hits for a in ("", "x", "_", "9", "é", "ガ", " ", "-") for b in ("", "s", "_", "9", "é", "ガ", " x", ".")]
    rows = spark.createDataFrame([(t,) for t in titles], "t string")
    same = [F.min((F.col("t").rlike(T.word(p)) == F.col("t").rlike(edged(p))).cast("int")) for p in lists]
    some = [F.max(F.col("t").rlike(T.word(p)).cast("int")) for p in lists[:7]]
    assert set(rows.agg(*(c.alias(f"c{i}") for i, c in enumerate(same + some))).first()) == {1}


def test_names_and_search_text(spark):
    assert one(spark, "ＡＢＣ Version!", lambda c: T.product_name(T.unicode_form(c, "NFKC"))) == "abc ver"
    assert one(spark, "Fate×Zero: “X”", lambda c: T.series_name(T.unicode_form(c, "NFKC"))) == "fate x zero x"
    assert one(spark, "Crème brûlée!!", lambda c: T.slug(T.unicode_form(c, "NFKD"))) == "creme-brulee"
    assert one(spark, ["Miku", " miku ", None, "", "初音"], T.search_text, "array<string>") == "miku · 初音"
    long = one(spark, ["a" * 1500, "b" * 400, "c" * 400], T.search_text, "array<string>")
    assert long == "a" * 1500 + " · " + "b" * 400
    assert one(spark, "Nendoroid Hatsune Miku Racing", lambda c: T.prefilter_words(T.product_name(c))) == ["hatsune", "racing", "miku"]


def test_pages_fields(spark):
    assert one(spark, "&amp;lt; &quot;x&#39;", T.decoded_entities) == "&lt; \"x'"
    assert one(spark, "<p>a<br>b<script>c</script></p>", T.stripped_tags) == "a b"
    assert (one(spark, "¥12,800", T.price_jpy), one(spark, "5000円", T.price_jpy), one(spark, "free", T.price_jpy)) == (12800, 5000, None)
    assert (one(spark, "base 50mm, height: 23.5cm", T.height_mm), one(spark, "about 180mm", T.height_mm)) == (235, 180)
    assert (one(spark, "JAN 4580416941234.", T.jan_code), one(spark, "5580416941234", T.jan_code)) == ("4580416941234", None)
    verdict = one(spark, "Miku Bunny Ver.", lambda c: T.nsfw(F.array(F.lit(" SFW ")), c))
    assert (verdict.nsfw, verdict.source) == (False, "retailer")
    assert one(spark, "Miku bunny ver.", lambda c: T.nsfw(F.lit(None).cast("array<string>"), c)).source == "keyword:bunny"
