"""Names within a few edits of each other, found by shared rare q-grams instead of comparing all pairs.

An edit changes at most q of the q-grams of a name. Of two names within d edits, the
d * q + 1 rarest grams of each therefore have one in common, if both have so many. Only names that share
such a gram and whose lengths differ by at most d are compared. Shorter names meet by what is left of
them after up to d deletions. Both filters are exact, so the result is that of comparing all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from packwright import standard as S
from packwright.functions.names import clean_query
from packwright.operators.joins import salted_join

GRAM = 2


def _grams(text: Column) -> Column:
    """All q-grams of a text, repeats included."""
    return F.when(F.length(text) >= GRAM, F.transform(
        F.sequence(F.lit(1), F.length(text) - (GRAM - 1)), lambda i: F.substring(text, i, GRAM))).otherwise(
        F.array().cast("array<string>"))


def _shortened(text: Column, edits: int) -> Column:
    """The text and what is left of it after up to so many deletions, each once."""
    def one_less(t: Column) -> Column:
        places = F.when(F.length(t) > 0, F.sequence(F.lit(1), F.length(t))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.concat(
            F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))

    found = last = F.array(text)
    for _ in range(edits):
        last = F.array_distinct(F.flatten(F.transform(last, one_less)))
        found = F.concat(found, last)
    return F.array_distinct(found)


def _rarest(texts: DataFrame, frequencies: DataFrame, many: int) -> DataFrame:
    """``text, gram``: the ``many`` rarest q-grams of every text, in one order for all texts."""
    # A gram of very many texts is met in 32 places.
    known = salted_join(texts.select("text", F.explode(_grams(F.col("text"))).alias("gram")), frequencies, ["gram"],
                        ["text"], "left")
    rare = F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))), 1, many)
    return known.groupBy("text").agg(F.array_distinct(F.transform(rare, lambda g: g["gram"])).alias("grams")).select(
        "text", F.explode("grams").alias("gram"))


def near_pairs(left: DataFrame, right: DataFrame, edits: int = 2) -> DataFrame:
    """``left, right, distance`` of all pairs of texts within ``edits`` edits (Levenshtein).

    Both tables have a column ``text``; repeated and missing texts are compared once and not at all.
    An empty text is within ``edits`` edits of texts of that length. Other columns are ignored.
    """
    if edits < 0:
        raise ValueError("edits must be 0 or more")
    texts = [df.select("text").where(F.col("text").isNotNull()).distinct() for df in (left, right)]
    many = edits * GRAM + 1
    # A text of fewer grams than that may share none with a neighbour.
    least = many + GRAM - 1
    long_ones = [t.where(F.length("text") >= least) for t in texts]
    frequencies = long_ones[1].select(F.explode(F.array_distinct(_grams(F.col("text")))).alias("gram")).groupBy("gram").agg(
        F.count(F.lit(1)).alias("n"))
    rare = [_rarest(t, frequencies, many).withColumn("size", F.length("text")) for t in long_ones]
    # The length is part of the key, which bounds the candidates and splits a frequent gram.
    sizes = F.explode(F.sequence(F.col("size") - edits, F.col("size") + edits))
    by_gram = rare[0].select(F.col("text").alias("left"), "gram", sizes.alias("size")).join(
        rare[1].select(F.col("text").alias("right"), "gram", "size"), ["gram", "size"]).select("left", "right")
    # A neighbour of a shorter text is at most so many letters longer than it.
    short = [t.where(F.length("text") < least + edits).select(
        F.col("text").alias(name), F.explode(_shortened(F.col("text"), edits)).alias("rest"))
        for t, name in zip(texts, ("left", "right"))]
    by_rest = short[0].join(short[1], "rest").where(F.least(F.length("left"), F.length("right")) < least).select("left", "right")
    distance = F.levenshtein("left", "right", edits)
    return by_gram.unionByName(by_rest).withColumn("distance", distance).where("distance >= 0").distinct()


def suggest_similar(queries: DataFrame, concepts: DataFrame, column: str, language: str, edits: int = 2,
                    limit: int = S.SUGGESTION_LIMIT) -> DataFrame:
    """Best concepts for misspelt names: ``column, ordinal, id, label, distance``.

    Names and labels are compared in lower case, cleaned like search queries. The nearest ``limit``
    concepts of each name are given, ties by label and id; a name without a concept so near has no row.
    ``concepts`` is ``id, lang, label``.
    """
    asked = queries.select(F.col(column).alias("column"), F.lower(clean_query(F.col(column))).alias("text")).where(
        F.col("text") != "").distinct()
    labels = concepts.where(F.col("lang") == language).select("id", "label", F.lower(clean_query(F.col("label"))).alias("text"))
    # Few labels read alike; the first ones of each text are enough, and are cut inside every task.
    first = W.partitionBy("text").orderBy("label", "id")
    labels = labels.distinct().withColumn("place", F.row_number().over(first)).where(F.col("place") <= limit).drop("place")
    pairs = near_pairs(asked, labels, edits)
    nearest = W.partitionBy("text").orderBy("distance", "label", "id")
    best = (
        pairs.join(labels.withColumnRenamed("text", "right"), "right").withColumnRenamed("left", "text")
        .withColumn("ordinal", F.row_number().over(nearest)).where(F.col("ordinal") <= limit)
    )
    # Names that read alike once cleaned share a few rows, repeated per salt.
    return salted_join(asked, best, ["text"], ["column"]).select("column", "ordinal", "id", "label", "distance")
