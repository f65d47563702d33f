"""The leaderboard feed against a replay of all lines in one process."""

import math
import random
import zlib
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from voxloom.llm import leaderboard as lb

EPOCH = datetime(1970, 1, 1)
LINES = "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, flag string, shipped_at timestamp_ntz, salt int, batch int, cents int"


def make(n=1500, seed=6):
    rnd = random.Random(seed)
    vendors = [(v, rnd.choice([0, 1, 2, 2, None])) for v in range(12)] + [(None, 1)]
    items = [(i, rnd.choice([None, 1.0, 2.005, 30.25])) for i in range(40)] + [(None, 5.0)]
    lines = []
    for k in range(n):
        hot = k % 3 == 0  # one item and vendor
        lines.append((
            rnd.choice([None, *range(300)]), rnd.randint(1, 9), 3 if hot else rnd.choice([None, *range(44)]), 2 if hot else rnd.choice([None, *range(14)]),
            rnd.choice([None, *range(9)]), rnd.choice([None, None, math.nan, math.inf, 0.005, 1.115, *(float(x) for x in range(20))]), rnd.choice(["kept", "swapped", "swapped", None]),
            None if rnd.random() < 0.05 else EPOCH + timedelta(days=19723 + int(rnd.triangular(0, 149, 40)), hours=rnd.randrange(24)), 1, 2, 3,
        ))
    return lines + lines[:40], vendors, items


def brute(lines, vendors, items, batches):
    nation, price = dict(vendors), dict(items)
    dealt = []
    for sale, line, item, vendor, quantity, amount, flag, shipped, *_ in lines:
        h = zlib.crc32(",".join("" if x is None else str(x) for x in (sale, item, vendor, line)).encode())
        s = (shipped - EPOCH).days if shipped else 19723 + h % 150
        a = s + h % 7 + (20 if h % 5 == 0 else 0)
        amount = None if amount is None or not math.isfinite(amount) else amount
        cents = math.floor(100 * amount + 0.5) if amount is not None else quantity * math.floor(100 * price[item] + 0.5) if quantity is not None and price.get(item) is not None else 0
        dealt.append((min(batches, 1 + (a - 19723) * batches // 180), a, s, nation.get(vendor) if vendor is not None else None, item if item in price else None, -cents if flag == "swapped" else cents))
    out, totals, boards, latest = [], {}, {}, -math.inf
    for batch in range(1, batches + 1):
        here = [x for x in dealt if x[0] == batch]
        used = [x for x in here if x[2] + 3 >= latest and x[3] is not None and x[4] is not None]
        for a in sorted({x[1] for x in used}):
            for _, _, _, n, i, c in (x for x in used if x[1] == a):
                totals[n, i] = totals.get((n, i), 0) + c
            for n in {x[3] for x in used if x[1] == a}:
                now = [i for _, i in sorted((-c, i) for (m, i), c in totals.items() if m == n and c > 0)[:10]]
                old = boards.get(n, [])
                for i in {*old, *now}:
                    o, k = (b.index(i) + 1 if i in b else None for b in (old, now))
                    if o != k:
                        out.append((n, a, i, batch, "enter" if o is None else "exit" if k is None else "move", o, k, totals[n, i]))
                boards[n] = now
        latest = max([latest, *(x[2] for x in here)])
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def tables(spark):
    def frames(lines, vendors, items):
        return spark.createDataFrame(lines, LINES), spark.createDataFrame(vendors, "vendor_id long, nation_id int"), spark.createDataFrame(items, "item_id long, price double")

    return frames


def test_a_tree_of_boards(spark, tables):
    """Five parts of the items, two levels of merging, late and hot lines, nulls, repeats, extra columns."""
    lines, vendors, items = make()
    got = lb.change_feed(*tables(lines, [v for v in vendors if v[0] is not None], items), batches=3, leaf_items=9, fan_in=2)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(lines, [v for v in vendors if v[0] is not None], items, 3)
    assert spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled") == "true"


def test_one_leaf_a_nation(tables):
    lines, vendors, items = make(700, seed=9)
    vendors = [v for v in vendors if v[0] is not None]
    got = lb.change_feed(*tables(lines, vendors, items), batches=2)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(lines, vendors, items, 2)


def test_no_lines(tables):
    lines, vendors, items = make(10)
    frames = tables(lines, vendors, items)
    assert lb.change_feed(frames[0].limit(0), *frames[1:], batches=1).collect() == []


def test_hot_lines_are_added_up(tables):
    lines, vendors, items = make(900)
    hot = [(x[0], x[1], 3, 2, 1, 1.0, "kept", EPOCH + timedelta(days=19730), 1, 2, 3) for x in lines] * 3
    fed = lb.feed(*tables(hot, [(2, 1)], [(3, 1.0)]))
    rows = fed.collect()
    assert sum(r.cents for r in rows) == 100 * len(hot) and len(rows) <= 14


def test_ranking_is_that_of_all_items():
    """Items above and below the floor, sums that fall, ties."""
    rnd = np.random.default_rng(7)
    items = np.arange(0, 6000, 2)
    ranking = lb.Ranking(items, rnd.integers(0, 400, len(items)).astype(float))
    for turn in range(120):
        at = np.sort(rnd.choice(len(items), 150, replace=False))
        if turn % 4 == 0:  # the best fall
            at = np.sort(np.searchsorted(items, [i for i, _ in zip((i for _, i in ranking.order), range(120))]))
        change = rnd.integers(-300, 200, len(at)).astype(float)
        ranking.add(at, change)
        want = sorted((-c, i) for c, i in zip(ranking.totals.tolist(), items.tolist()) if c > 0)[:10]
        assert list(ranking.best().items()) == [(i, -c) for c, i in want]


class _State:
    def __init__(self):
        self.kept = {}

    def exists(self):
        return bool(self.kept)

    def iterator(self):
        return iter(list(self.kept.items()))

    def updateValue(self, k, v):
        self.kept[k] = v

    def removeKey(self, k):
        self.kept.pop(k)


class _Time:
    def getCurrentWatermarkInMs(self):
        return 5 * lb.DAY_MS


def test_parcels_are_added_up():
    """State grows by what changed and is folded now and then; late rows change nothing."""
    leaf, state = lb.Leaf(), _State()
    leaf.parcels = state
    total = {}
    for turn in range(30):
        rows = pd.DataFrame({"item_id": np.array([turn % 7, 100], np.int64), "arrival_day": [20, 20], "shipped_day": [6, 5], "batch": [turn, turn], "cents": [5.0, 99.0]})
        list(leaf.handleInputRows((1, 0), iter([rows]), _Time()))
        total[turn % 7] = total.get(turn % 7, 0) + 5.0
        kept = {}
        for _, (i, c) in state.iterator():
            for item, cents in zip(np.frombuffer(i, np.int64), np.frombuffer(c)):
                kept[item] = kept.get(item, 0) + cents
        assert kept == total and len(state.kept) <= lb.PARCELS + 1
