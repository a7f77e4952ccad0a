from pyspark.sql import functions as F

from shelfmark.functions import registered
from shelfmark.functions import text as T
from shelfmark.sources import pages

TITLES = ["Nendoroid 1234 Épée Miku ver. 1/7", "ＦＩＧＭＡ　ＳＰ－１２３", "12cm x 7 inches new SEALED", "ガンダム ｶﾞﾝﾀﾞﾑ qipao", "", "   ", None, "a.b/c-d & 'quotes' \"double\" \\back", "xmas nendo nendoroid swimwear", "ñandú Ångström ﬁgure"]


def test_functions_in_sql_are_those_of_columns(spark):
    registered.register(spark)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TITLES)], "id int, title string")
    columns = rows.select("id", T.normalized(F.col("title")).alias("norm")).select("id", "norm", T.tokens_of(F.col("norm")).alias("tokens"))
    sql = spark.sql("SELECT id, fi_normalize(title) AS norm, fi_tokens(title) AS tokens FROM {rows}", rows=rows)
    assert sorted(map(tuple, sql.collect()), key=repr) == sorted(map(tuple, columns.collect()), key=repr)


def test_table_functions_are_the_readers_of_pages(spark):
    registered.register(spark)
    held = [
        (1, '<a href="x">1</a> <a class="b" href="y">2</a><a href="x">3</a>'), (2, None), (3, '<script type="application/ld+json">{"@type": "Product", "name": "n", "offers": [{"price": "7", "availability": "InStock"}]}</script>'),
        (4, 'let variantItems = [{"code": "c", "name": "m", "price": 5, "available": true}, 7];'), (5, "let variantItems = [broken"),
    ]
    rows = spark.createDataFrame(held, "id int, html string")
    links = spark.sql("SELECT id, link FROM {rows}, LATERAL fi_links(html)", rows=rows)
    assert sorted(map(tuple, links.collect())) == sorted(map(tuple, pages.links(rows, "id", "html").collect())) == [(1, "x"), (1, "y")]
    products = spark.sql("SELECT id, p.* FROM {rows}, LATERAL fi_products(html) p", rows=rows)
    want = pages.json_ld_products(rows).filter("product.name IS NOT NULL").select("id", "product.*")
    assert list(map(tuple, products.collect())) == list(map(tuple, want.collect())) and products.count() == 1
    variants = spark.sql("SELECT id, v.* FROM {rows}, LATERAL fi_variants(html, 'let variantItems = ') v", rows=rows)
    assert list(map(tuple, variants.collect())) == [(4, "c", "m", 5.0, True)]
