"""Root ids and root matching against plain loops."""

import random

import pytest

from arborlake import schemas as S
from arborlake.operators import routing


def in_turn(raws):
    """Every row takes the first free one of base, base-2, base-3 …"""
    taken, reached, out = set(), {}, []
    for base in raws:
        n = reached.get(base, 1)
        while (name := base if n == 1 else f"{base}-{n}") in taken:
            n += 1
        reached[base] = n
        taken.add(name)
        out.append(name)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ids_are_taken_in_turn(spark, seed):
    rng = random.Random(seed)
    bases = ["a", "a-2", "a-3", "a-7", "a-2-2", "a-2-2-2", "a-02", "a-1", "b", "2-2", "2", "a-99999999999999999999"]
    raws = [rng.choice(bases) for _ in range(rng.choice([20, 90]))]
    rows = list(enumerate(raws))
    rng.shuffle(rows)
    got = routing.normalize_root_ids(spark.createDataFrame(rows, "n long, raw string"), "raw", "n").orderBy("n").collect()
    assert [r.id for r in got] == in_turn(raws)


def test_one_base_beside_thousands_that_are_spelled_like_its_ids(spark, monkeypatch):
    raws = ["a"] * 10_000 + [f"a-{i}" for i in range(2, 5_001)]
    random.Random(4).shuffle(raws)
    written = []
    real = routing.materialize
    monkeypatch.setattr(routing, "materialize", lambda df, label, **k: written.append(label) or real(df, label, **k))
    got = routing.normalize_root_ids(spark.createDataFrame(list(enumerate(raws)), "n long, raw string"), "raw", "n").orderBy("n").collect()
    assert [r.id for r in got] == in_turn(raws)
    assert len(written) == 2


def test_roots_match_on_all_their_fields(spark):
    rng = random.Random(5)
    value = lambda: rng.choice([None, "x", "y", ""])
    selectors = [tuple(value() for _ in range(5)) for _ in range(60)] + [(None, None, "nfs", f"10.0.0.{i}", None) for i in range(30)]
    roots = [(f"r{i}", s, "/", True, True, None) for i, s in enumerate(selectors)]
    grants = []
    for i in range(80):
        mount, source, kind, ip, host = (value() for _ in range(5))
        if i % 2:
            kind, ip = "nfs", f"10.0.0.{rng.randrange(40)}"
        grants.append((f"o{i}", host, ip, "h", None, None, None, mount, source, kind, None, None, True))
    got = routing.match_roots(spark.createDataFrame(roots, S.ROOTS), spark.createDataFrame(grants, S.GRANTS))
    fields = lambda g: (g[7], g[8], g[9], g[2], g[1])
    want = sorted(
        (r[0], g[0]) for r in roots for g in grants
        if any(v is not None for v in r[1]) and all(v is None or v == w for v, w in zip(r[1], fields(g)))
    )
    assert sorted((r.root_id, r.object_ref) for r in got.collect()) == want and want
    # the join is made of equalities: it gives the matches and no candidate besides
    joins = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]
    assert len(joins) == 1 and joins[0].count(" = ") == 6 and " OR " not in joins[0].upper().replace("ORDER", "")
    assert set(got.columns) == {"root_id", "subpath_scope", *S.GRANTS.fieldNames()}
