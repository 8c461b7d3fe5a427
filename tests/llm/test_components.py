import random

from packwright.llm.components import connected


def test_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 150)] + [(200, 200), (301, 300), (300, 301)]
    random.Random(1).shuffle(edges)
    got = {}
    for r in connected(spark.createDataFrame(edges, "a long, b long")).collect():
        got.setdefault(r.label, set()).add(r.id)
    assert sorted(map(sorted, got.values())) == [list(range(61)), list(range(100, 150)), [300, 301]]


def test_no_links(spark):
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0
