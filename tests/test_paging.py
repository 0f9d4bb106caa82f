"""Pages and jumps, and names matched with candidates, against plain versions."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from runweave.operators import aliases, paging


@pytest.mark.parametrize("kind", ["long", "string"])
def test_pages(spark, monkeypatch, kind):
    monkeypatch.setattr(paging, "SORTED", 40)
    monkeypatch.setattr(paging, "DRAWN", 30)
    monkeypatch.setattr(paging, "RANGES", 5)
    rng = np.random.default_rng(1)
    keys = [int(k) for k in rng.integers(0, 200, 300)] + [7] * 100
    rows = [(f"k{k:04d}" if kind == "string" else k, i) for i, k in enumerate(keys)] + [(None, -1)]
    df = spark.createDataFrame(rows, f"key {kind}, other int").repartition(3)
    order = sorted(r for r in rows if r[0] is not None)
    for number, size in ((1, 10), (7, 13), (40, 10), (41, 10), (999, 33), (0, 0), (None, None), (-3, -1), (2, 5_000)):
        p = paging.page_of(df, "key", number, size)
        n = min(size if size and size > 0 else 250, 1_000)
        pages = -(-len(order) // n)
        at = min(max(number or 1, 1), pages)
        assert [tuple(r) for r in p.rows.collect()] == order[(at - 1) * n : at * n]
        assert (p.mode, p.page, p.page_size, p.total, p.total_pages, p.has_previous, p.has_next) == ("page", at, n, len(order), pages, at > 1, at < pages)
    empty = paging.page_of(df.limit(0), "key", 5)
    assert empty.rows.count() == 0 and (empty.page, empty.total_pages, empty.has_next) == (1, 1, False)
    assert paging.whole(df).page_size == len(rows)


def test_jumps(spark):
    base = spark.createDataFrame([("f1", "b1"), ("f2", "b2")], "family_id string, run_id string")
    edges = spark.createDataFrame([("child", "b1", "c1"), ("time0", "c1", "z1"), ("child", "b2", "c2"), ("child", "gone", "c3")], "kind string, source string, target string")
    for asked, want in (({"family": "f2"}, ["b2"]), ({"run": "b1"}, ["b1"]), ({"run": "c1"}, ["b1"]), ({"run": "z1"}, ["b1"]), ({"run": "c3"}, []), ({"run": "no"}, []), ({"family": "no"}, [])):
        p = paging.jump_to(base, edges, **asked)
        assert [r.run_id for r in p.rows.collect()] == want
        assert (p.mode, p.page_size, p.total, p.total_pages, p.has_next, p.has_previous) == ("family", len(want), 2, 2, False, False)


def words(text):
    own = [w for w in re.split(r"\s+", re.sub("[_-]", " ", (text or "").lower())) if w]
    out = set(own) | {w[:-1] for w in own if w.endswith("s") and len(w) > 3}
    return out | {o for w in out for o in aliases.SYNONYMS.get(w, [])}


@pytest.mark.parametrize("part", [2, 1_000])
def test_alias_match(spark, monkeypatch, part):
    monkeypatch.setattr(aliases, "PART", part)
    rng = np.random.default_rng(4)
    pool = ["spring", "springs", "stiffness", "coefficient", "mass", "as", "Drag", "rate", "of"]
    text = lambda n: [" _-"[int(rng.integers(3))].join(rng.choice(pool, int(rng.integers(1, n)))) for _ in range(12)]
    names, candidates, want = [], [], {}
    for model in ("m", "n"):
        listed = list(dict.fromkeys(text(4)))
        more = text(3)
        candidates += [(model, c, k, more[k] if k % 3 else None) for k, c in enumerate(listed)]
        for name in {*text(5), *text(5), "nothing shared", "", listed[0]}:
            names += [(model, name)] * 2
            if name in listed or not words(name):
                continue
            best, score, size, ambiguous = None, 0, -1, False
            for k, c in enumerate(listed):
                own = words(c) | words(more[k] if k % 3 else None)
                n = len(own & words(name))
                if n > score or (n == score and n and len(own) > size):
                    best, score, size, ambiguous = c, n, len(own), False
                elif n == score and n:
                    ambiguous = True
            if score:
                want[model, name] = (None if ambiguous else best, score, ambiguous)
    found = aliases.alias_match(spark.createDataFrame(names, "model string, name string"), spark.createDataFrame(candidates, "model string, candidate string, place int, more string"), ["model"])
    rows = found.collect()
    assert {(r.model, r.name): (r.candidate, r.shared, r.ambiguous) for r in rows} == want and len(rows) == len(want)
    assert {v[2] for v in want.values()} == {True, False}
    assert sorted(spark.range(1).select(aliases.tokens(F.lit("Spring_stiffness of-cells"))).first()[0]) == sorted(words("Spring_stiffness of-cells"))
