import random

import pytest

from figurant.llm import stages


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_components(spark, monkeypatch, most):
    monkeypatch.setattr(stages, "LINKS_OF_ONE_TASK", most)
    for seed in range(2):
        r = random.Random(seed)
        links = [(r.randrange(-200, 400), r.randrange(400)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, i) for i in range(2001, 2050)] + [(5, 5)]
        top = {}

        def find(x):
            while top.get(x, x) != x:
                x = top[x]
            return x

        for a, b in links:
            if a != b:
                a, b = sorted((find(a), find(b)))
                top[b] = a
        ends = {x for a, b in links if a != b for x in (a, b)}
        got = stages.components(spark.createDataFrame(links + links[:9], "a long, b long")).collect()
        assert sorted(map(tuple, got)) == sorted((x, find(x)) for x in ends)
    assert stages.components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")).count() == 0
