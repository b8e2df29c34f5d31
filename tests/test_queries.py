"""Every query of the fact layer against its DuckDB SQL, at the smallest scale."""

import datetime

import pytest

from factloom.plans import oracle
from factloom.plans.queries import QUERIES

from conftest import SMALL

SLOW = {"verdict_counts", "verdict_reasons", "verdicts_renewed", "entity_leaderboard"}


def plain(v):
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", [n for n in QUERIES if n in oracle.ORACLES and n not in SLOW])
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, SMALL)
    cols = sorted(frame.columns)
    got = [tuple(map(plain, r)) for r in frame.select(*cols).collect()]
    answer = duck.execute(oracle.ORACLES[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == cols
    want = [tuple(plain(r[names.index(c)]) for c in cols) for r in answer.fetchall()]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_registry_clusters(spark):
    rows = QUERIES["registry_clusters"](spark, SMALL).collect()
    assert rows and {r.canonical for r in rows} <= {r.form for r in rows}
