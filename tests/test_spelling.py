"""Pairs within a few edits against comparing all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from packwright.operators import spelling


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def words(rng, n, letters, longest):
    return ["".join(rng.choices(letters, k=rng.randint(0, longest))) for _ in range(n)]


def edited(rng, word, edits):
    for _ in range(edits):
        at = rng.randint(0, len(word))
        word = rng.choice([word[:at] + word[at + 1:], word[:at] + "xß"[rng.randint(0, 1)] + word[at:], word[:at] + "z" + word[at + 1:]])
    return word


@pytest.mark.parametrize("edits", [0, 1, 2, 3])
def test_pairs_are_those_of_brute_force(spark, edits):
    rng = random.Random(edits)
    right = words(rng, 150, "ab", 12) + words(rng, 100, "abcdeßé", 20) + ["", "a", "aaaaaaaaaaaa", "\U0001F600b"]
    left = [edited(rng, w, rng.randint(0, edits + 1)) for w in right] + words(rng, 60, "ab", 6) + ["", None, "a", "a"]
    got = spelling.near_pairs(spark.createDataFrame([(t,) for t in left], "text string"),
                              spark.createDataFrame([(t, 1) for t in right + [None]], "text string, gram int"), edits).collect()
    want = {(a, b, d) for a in set(left) - {None} for b in set(right) if (d := edit_distance(a, b)) <= edits}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_misspelt_names_find_their_concept(spark):
    concepts = spark.createDataFrame(
        [(f"u/{i}", "en", label) for i, label in enumerate(["Carbon Dioxide", "carbon dioxide", "Carbon Monoxide", "Water", "Metal"])]
        + [("u/de", "de", "Water")], "id string, lang string, label string")
    names = spark.createDataFrame([("carbon_dioxid",), ("Carbon  dioxide!",), ("watr",), ("nothing like it",), ("",), (None,)],
                                  "name string")
    got = {}
    for r in spelling.suggest_similar(names, concepts, "name", "en").orderBy("ordinal").collect():
        got.setdefault(r.column, []).append((r.id, r.distance))
    assert got == {"carbon_dioxid": [("u/0", 2), ("u/1", 2)], "Carbon  dioxide!": [("u/0", 0), ("u/1", 0)], "watr": [("u/3", 1)]}
    only = spelling.suggest_similar(names, concepts, "name", "en", limit=1).where("column = 'Carbon  dioxide!'").collect()
    assert [r.id for r in only] == ["u/0"]


def test_one_name_in_a_third_of_the_rows(spark):
    names = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "tempertaure").otherwise(
        F.concat(F.lit("column "), F.col("id").cast("string"))).alias("name"))
    concepts = spark.createDataFrame([("c", "en", "temperature")], "id string, lang string, label string")
    assert [tuple(r) for r in spelling.suggest_similar(names, concepts, "name", "en").collect()] == [
        ("tempertaure", 1, "c", "temperature", 2)]
    assert spelling.suggest_similar(names.limit(0), concepts, "name", "en").count() == 0
    assert spelling.suggest_similar(names, concepts.limit(0), "name", "en").count() == 0
