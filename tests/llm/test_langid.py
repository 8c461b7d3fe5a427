import random

import numpy as np
from pyspark.sql import functions as F

from packwright.llm import langid
from packwright.llm.langid import LanguageModel, fit, identify, mixtures
from packwright.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_held_out_accuracy(spark):
    got = QUERIES["op1_language"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in got if r.held_out]
    assert len(got) == 200 and len(out) > 30
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.95
    assert all(0 <= r.score <= 1 and abs(sum(r.proportions.values()) - 1) < 1e-6 for r in got)


def test_mixture_of_two(spark):
    rnd = random.Random(3)
    words = {"aa": ["koto", "piri", "lamo"], "bb": ["strxz", "vbrmn", "ghtyw"], "cc": ["éàüö", "ßäñç", "øåæœ"]}
    say = lambda k, n: " ".join(rnd.choices(words[k], k=n))
    df = spark.createDataFrame([(say(k, 60), k) for k in words for _ in range(9)] + [("x", None), (None, "aa")], "text string, lang string")
    model = fit(df)
    assert model.languages == ["aa", "bb", "cc"]
    share = mixtures([say("aa", 90) + " " + say("bb", 30), say("cc", 50), "12 !", "", say("bb", 10) + " " + say("cc", 10)], model)
    assert np.allclose(share[0], [0.75, 0.25, 0], atol=0.03) and np.allclose(share[1], [0, 0, 1])
    assert not share[2].any() and not share[3].any() and share[4, 0] == 0 and abs(share[4, 1] - 0.5) < 0.1


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "?! 42"), (3, "der und die"), (3, "der und die"), (4, "und " * 100000), (5, "中文 \U00020000")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit("mine"), "lang_pred": F.lit(1), "__text": F.lit(2)})
    model = fit(spark.createDataFrame([("der und die " * 9, "de"), ("the and of " * 9, "en")], "text string, lang string"))
    got = {(r[0], r[2]) for r in identify(df, model, "doc_id", "score").select("doc_id", F.col("proportions"), "lang_pred").collect()}
    assert {(1, "und"), (2, "und"), (None, "und"), (3, "de"), (4, "de")} <= got
    assert identify(df, model, "doc_id").count() == 7 and identify(df.limit(0), model, "doc_id").count() == 0
    none = fit(df.select("text", F.lit(None).cast("string").alias("lang")))
    assert none.languages == [] and {r.lang_pred for r in identify(df, none).collect()} == {"und"}
    assert isinstance(model, LanguageModel)


def test_held_out_rule(spark):
    import zlib
    df = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long")
    for k, out in df.select("doc_id", langid.held_out(F.col("doc_id"), 4, 2)).collect():
        assert out == (zlib.crc32(("" if k is None else str(k)).encode()) % 4 == 2)
