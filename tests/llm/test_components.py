import random

import pytest

from haze.llm import components as module
from haze.llm.components import components


@pytest.mark.parametrize("few", [3, 60, 100_000])
def test_few_links_are_contracted_without_steps(spark, monkeypatch, few):
    names = []
    monkeypatch.setattr(module, "FEW", few)
    monkeypatch.setattr(module, "written", lambda df, name, of=module.written: names.append(name) or of(df, name))
    rng = random.Random(few)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randrange(200, 290), rng.randrange(200, 290)) for _ in range(50)]
    links += [(None, 5), (7, None), (8, 8), *links[:9]]
    rng.shuffle(links)
    out = {r.node: r.root for r in components(spark.createDataFrame(links, "x bigint, y bigint")).collect()}
    want = {k: k for x, y in links if x is not None and y is not None and x != y for k in (x, y)}
    for _ in want:
        for x, y in links:
            if x in want and y in want:
                want[x] = want[y] = min(want[x], want[y])
    assert out == want
    assert ("stars" in names) == (few < 100)
