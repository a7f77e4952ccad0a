import random

from shelfmark.operators import match as M

FIGURES = "figure_id string, name string, name_ja string, scale string, height_mm int, category string, maker string, line_number string, series string, series_aliases array<string>, characters array<string>, characters_ja array<string>"


def figure(id, name, **more):
    row = dict.fromkeys([c.strip().split(" ")[0] for c in FIGURES.split(",")]) | {"figure_id": id, "name": name, "category": "SCALE"} | more
    return tuple(row.values())


KNOWN = [
    figure("scale", "Marin Kitagawa Swimsuit Ver.", scale="1/7", maker="Good Smile Company", series="My Dress-Up Darling", characters=["Marin Kitagawa"]),
    figure("nendo", "Nendoroid Marin Kitagawa", category="NENDOROID", maker="Good Smile Company", line_number="1935", series="My Dress-Up Darling", characters=["Marin Kitagawa"]),
    figure("power", "Nendoroid Power", category="NENDOROID", maker="Good Smile Company", line_number="1580", series="Chainsaw Man", characters=["Power"], characters_ja=["パワー"]),
]


def test_best_matches(spark):
    titles = {
        "GSC Marin Kitagawa 1/7 Swimsuit Ver.": "scale", "Good Smile Company 1/7 Scale Figure My Dress-Up Darling": None, "GSC Marin Kitagawa 1/4 Swimsuit Ver.": None,
        "Nendoroid Marin Kitagawa Good Smile Company": "nendo", "": None, "Marin Kitagawa keychain": None, "Nendoroid Power Chainsaw Man GSC": "power", "FuRyu Marin Kitagawa Swimsuit 1/7": None,
    }
    got = M.best_match(spark.createDataFrame(list(enumerate(titles)), "title_id int, title string"), spark.createDataFrame(KNOWN, FIGURES)).collect()
    assert {r.title_id: r.figure_id for r in got} == dict(enumerate(titles.values()))


def test_ties_and_rejections(spark):
    twins = [KNOWN[1], ("twin", *KNOWN[1][1:])]
    title = spark.createDataFrame([(1, "Nendoroid Marin Kitagawa Good Smile Company")], "title_id int, title string")
    assert M.best_match(title, spark.createDataFrame(twins, FIGURES)).first().figure_id is None
    rejected = spark.createDataFrame([(1, "Nendoroid Marin Kitagawa Good Smile Company", ["twin"])], "title_id int, title string, rejected array<string>")
    assert M.best_match(rejected, spark.createDataFrame(twins, FIGURES)).first().figure_id == "nendo"


def test_blocked_join_loses_no_pair(spark):
    rng = random.Random(6)
    people, extra, makers, series = ["Marin Kitagawa", "Power", "Hatsune Miku", "Saber"], ["swimsuit", "racing", "wedding", "alter", "beauty", "moon"], ["Good Smile Company", "Alter", "SEGA", None, "Bandai Spirits"], ["Fate", "Vocaloid", None]
    figures = []
    for i in range(60):
        who = rng.sample(people, rng.randint(0, 2))
        name = " ".join([*rng.sample(["Nendoroid", "figma", "Luminasta"], rng.randint(0, 1)), *who, *rng.sample(extra, rng.randint(0, 3))]) or "Figure"
        figures.append(figure(f"f{i}", name, scale=rng.choice([None, "1/7", "1/8"]), height_mm=rng.choice([None, 100, 230]), category=rng.choice(["SCALE", "NENDOROID", "OTHER", "PRIZE"]), maker=rng.choice(makers), line_number=rng.choice([None, "12", "345"]), series=rng.choice(series), characters=who or None, characters_ja=rng.choice([None, ["初音ミク"], ["ミ"]]), name_ja=rng.choice([None, "初音ミク"])))
    titles = [(i, " ".join(rng.sample([*people, *extra, "Nendoroid 345", "figma 12", "1/7", "23cm", "GSC", "初音ミク", "Vocaloid", "SEGA Luminasta", "lot"], rng.randint(1, 6)))) for i in range(80)]
    t, f = spark.createDataFrame(titles, "title_id int, title string"), spark.createDataFrame(figures, FIGURES)
    key = lambda rows: sorted((r.title_id, r.figure_id, round(r.score, 9), r.hits, r.sized) for r in rows)
    naive = key(M.scored_naively(t, f).collect())
    assert naive and key(M.scored(t, f).collect()) == naive


def test_rematch_classes(spark):
    held = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, None), (5, "e")], "title_id int, figure_id string")
    new = spark.createDataFrame([(1, "a", 0.9), (2, "c", 0.8), (3, "d", 0.7)], "title_id int, figure_id string, score double")
    assert {r.title_id: r.change for r in M.rematch(held, new).collect()} == {1: "same", 2: "moved", 3: "gained", 4: "same", 5: "lost"}


def test_words_that_all_share_lead_to_no_pairs(spark):
    names = [a + b for a in "bdfgh" for b in "klmnp"]
    figures = spark.createDataFrame([figure(f"f{i}", f"Nendoroid Sora{n} blaze", category="NENDOROID", line_number=f"ex-{1000 + i % 7}", characters=[f"Sora{n}"]) for i, n in enumerate(names)], FIGURES)
    titles = spark.createDataFrame([(i, f"Nendoroid ex-{1000 + i % 7} Sora{n} blaze") for i, n in enumerate(names)], "title_id int, title string")
    t, f = M.title_features(titles), M.figure_features(figures)
    assert sorted((r.title_id, r.figure_id) for r in M.candidate_pairs(t, f).collect()) == sorted((i, f"f{i}") for i in range(len(names)))
