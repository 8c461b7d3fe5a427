import math
import random

from pyspark.sql import functions as F

from packwright.llm.toxicity import _buckets, fit, score, score_texts


def corpus(n, seed):
    """Toxic is an insult beside a group; either alone is not."""
    rnd = random.Random(seed)
    plain = ["".join(rnd.choices("bcdlmnrst", k=5)) for _ in range(200)]
    rows = []
    for i in range(n):
        insult, group = rnd.random() < 0.5, rnd.random() < 0.5
        words = rnd.choices(plain, k=20) + ["oaf"] * insult + ["marsians"] * group
        rnd.shuffle(words)
        rows.append((i, " ".join(words).capitalize(), int(insult and group)))
    return rows


def test_pairs_are_learned(spark):
    """Terms alone can't tell all four cases at 0.7 with these odds; pairs can."""
    rows = corpus(1600, 1)
    model = fit(spark.createDataFrame(rows[:1200], "doc_id long, text string, toxic int"))
    got = score_texts(model, [t for _, t, _ in rows[1200:]])
    right = [(s >= 0.7) == y for s, (_, _, y) in zip(got, rows[1200:])]
    assert sum(right) / len(right) > 0.98
    assert score_texts(model, ["Oaf marsians"])[0] > 0.7 > 0.5 > max(score_texts(model, ["oaf", "marsians", ""]))


def test_odd_rows(spark):
    rows = corpus(400, 2)
    train = spark.createDataFrame([*rows, (0, None, 1), (1, "x", None), (2, "x", 7)], "doc_id long, text string, toxic int")
    model = fit(train)
    df = spark.createDataFrame([(1, None), (2, ""), (None, "OAF, marsians!"), (3, "a"), (3, "a"), (4, "oaf " * 100000)],
                               "doc_id long, text string").withColumns({"score": F.lit("mine"), "toxic": F.lit(1)})
    got = score(df, model, "doc_id").collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[1] == by[2] == by[3] and by[None] > by[4]
    assert score(df.limit(0), model, "doc_id").count() == 0
    flat = fit(train.limit(0))
    assert {r.score for r in score(df, flat, "doc_id").collect()} == {0.5}


def test_what_only_pairs_tell_is_learned(spark):
    """Toxic is one of two words without the other; each word alone stands in as many toxic texts as others."""
    rows = [(i, t, int(("oaf" in t) != ("marsians" in t))) for i, t, _ in ((i, t.lower(), y) for i, t, y in corpus(3000, 7))]
    model = fit(spark.createDataFrame(rows[:2200], "doc_id long, text string, toxic int"))
    got = score_texts(model, [t for _, t, _ in rows[2200:]])
    right = [(s >= 0.5) == y for s, (_, _, y) in zip(got, rows[2200:])]
    assert sum(right) / len(right) >= 0.9


def test_scores_are_the_plain_sum_over_pairs(spark):
    model = fit(spark.createDataFrame(corpus(400, 3), "doc_id long, text string, toxic int"))
    for text in ("oaf marsians", "Oaf, oaf!", "", "bcdlm " * 9 + "marsians"):
        terms, _ = _buckets([text], model.terms)
        z = model.bias + sum(model.weights[t] for t in terms)
        z += sum(float(model.factors[s] @ model.factors[t]) for i, s in enumerate(terms) for t in terms[:i])
        assert abs(score_texts(model, [text])[0] - 1 / (1 + math.exp(-z))) < 1e-12
