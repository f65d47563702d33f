"""Nearest seeds against all distances."""

import random

from voxloom.operators.crops import nearest_seed


def test_every_cell_has_its_nearest_seed(spark):
    """Ties go to the least label; a seed outside counts for nothing; a time point without seeds has no rows."""
    rnd = random.Random(3)
    shape = (5, 9, 13)
    pick = lambda: tuple(rnd.randrange(n) for n in shape)
    seeds = [("a", *pick(), 100 - k) for k in range(7)] + [("b", 0, 0, 0, 4), ("b", 4, 8, 12, 3), ("c", 9, 0, 0, 1)]
    cells = [(tp, z, y, x) for tp in "abc" for z in range(5) for y in range(9) for x in range(13) if rnd.random() < 0.7]
    got = {(r.tp, r.z, r.y, r.x): (r.far, r.label) for r in nearest_seed(spark.createDataFrame(cells, "tp string, z int, y int, x int"), spark.createDataFrame(seeds, "tp string, z int, y int, x int, label int"), shape).collect()}
    want = {c: min((sum((p - q) ** 2 for p, q in zip(s[1:4], c[1:])), s[4]) for s in seeds if s[0] == c[0]) for c in cells if c[0] != "c"}
    assert got == want
