"""Bracketing of undated rows: pieces of an index against a walk through it."""

import random
import re
from collections import defaultdict
from datetime import datetime, timedelta

import pytest

from inkstream.functions import dates

COLUMNS = "source_id long, pos long, published_at timestamp_ntz"


def walked(rows, carry):
    """Each undated row looks back and ahead for itself."""
    by, out = defaultdict(list), {}
    for s, pos, at in rows:
        by[s].append((pos, at))
    for s, own in by.items():
        own.sort()
        seen = [at for _, at in own]
        for i, (pos, at) in enumerate(own):
            out[s, pos] = None
            newer = next((x for x in reversed(seen[:i]) if x), None)
            older = next((x for _, x in own[i + 1 :] if x), None)
            if at is None and newer and older and older <= newer and (newer.date() - older.date()).days <= 1464:
                out[s, pos] = (older + (newer - older) / 2).replace(hour=0, minute=0, second=0, microsecond=0)
                if carry:
                    seen[i] = out[s, pos]
    return out


def index(seed, hours):
    draw, rows = random.Random(seed), []
    for s in (1, 2, 3, None):
        at = datetime(2024, 1, 1, 15 if hours else 0)
        for pos in range(400 if s == 1 else 60):
            at += timedelta(days=draw.choice([-900, -300, -40, -7, -1, 0, 60]), hours=draw.randint(0, 23) if hours else 0)
            gap = draw.random() < 0.7 if s != 3 else pos not in (5, 55)  # of source 3 two dates are known
            rows.append((s, pos, None if gap else at))
    return rows


@pytest.mark.parametrize("hours", [False, True])
@pytest.mark.parametrize("piece", [7, 1000])
def test_pieces_of_an_index_give_what_a_walk_gives(spark, hours, piece):
    rows = index(piece, hours)
    df = spark.createDataFrame(rows, COLUMNS).repartition(3)
    for f, carry in ((dates.bracket_once, False), (dates.bracket_all, True)):
        got = {(r.source_id, r.pos): r.est for r in f(df, piece).collect()}
        want = walked(rows, carry)
        assert got == want
        assert sum(x is not None for x in want.values()) > 30


def test_one_long_index_is_many_tasks(spark):
    df = spark.range(3000).selectExpr("1L AS source_id", "id AS pos", "CASE WHEN id % 500 = 0 THEN timestamp_ntz'2020-01-01' - make_dt_interval(id) END AS published_at")
    plan = dates.bracket_all(df, 100)._jdf.queryExecution().executedPlan().toString()
    shuffles = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    rows = [x for x in shuffles if "piece" in x]
    assert rows and len(shuffles) - len(rows) <= 1 and "Python" not in plan and "Pandas" not in plan  # that one is the pieces' own table
    got = {r.pos: r.est for r in dates.bracket_all(df, 100).collect()}
    assert got[499] == datetime(2018, 8, 19) and got[1] == datetime(2019, 4, 26) and got[0] is None and got[2501] is None


def test_empty_index_ties_and_no_positions(spark):
    assert dates.bracket_all(spark.createDataFrame([], COLUMNS)).count() == 0
    d = lambda n: datetime(2020, 1, n)
    rows = [(1, 0, d(9)), (1, 1, None), (1, 1, None), (1, 1, d(5)), (1, None, None), (1, 2, None)]
    got = [(r.pos, r.est) for r in dates.bracket_all(spark.createDataFrame(rows, COLUMNS)).collect() if r.published_at is None]
    assert sorted(got, key=str) == sorted([(1, d(7)), (1, d(6)), (None, None), (2, None)], key=str)


def test_queries_agree_with_sql(spark, twin):
    import __spark_entry__ as entry

    for name in ("bracket_undated", "bracket_sequential"):
        for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
            twin(entry.queries()[name](spark, sf), entry.oracle_sql()[name], sf)


def test_no_frame_is_gone_through_anew_for_every_row(spark):
    df = spark.createDataFrame(index(1, False), COLUMNS)
    for f in (dates.bracket_once, dates.bracket_all):
        plan = f(df)._jdf.queryExecution().analyzed().toString().lower()
        assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan
