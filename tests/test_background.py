"""Matched background against a replay object by object."""

import hashlib
import random

import pytest

from voxloom.operators import objects


def replay(voxels, mask):
    value = {v[:4]: v[4] for v in voxels}
    out = {}
    for tp in {m[0] for m in mask}:
        ground = [value[m[:4]] for m in sorted(mask) if m[0] == tp and m[4] == 0 and m[:4] in value]
        start = 0
        for label in sorted({m[4] for m in mask if m[0] == tp and m[4]}):
            n = sum(m[0] == tp and m[4] == label for m in mask)
            fits = start + n <= len(ground)
            if fits:
                drawn, start = ground[start : start + n], start + n
            else:
                at = [int(hashlib.md5(f"background:{tp}:{label}:{j}".encode()).hexdigest()[:12], 16) for j in range(n)]
                drawn = [ground[a % len(ground)] for a in at] if ground else []
            out[tp, label] = (len(drawn), not fits and bool(ground), sum(drawn) / len(drawn) if drawn else None)
    return out


@pytest.mark.parametrize("block", [4096, 7])
def test_slices_and_redraws(spark, monkeypatch, block):
    """Objects that fit, one that doesn't, smaller ones after it, a volume without background, voxels that are missing."""
    monkeypatch.setattr(objects, "BLOCK", block)
    rnd = random.Random(2)
    mask = [("a", z, y, x, rnd.choice([0, 0, 1, 2, 3, 4, 4, 4, 4, 5])) for z in range(4) for y in range(5) for x in range(6)]
    mask += [("b", 0, 0, x, x % 2 + 1) for x in range(5)] + [("c", 0, 0, x, x // 9) for x in range(12)]
    voxels = [(*m[:4], rnd.random()) for m in mask if rnd.random() < 0.95 or m[0] == "b"]
    want = replay(voxels, mask)
    assert {r for _, r, _ in want.values()} == {True, False} and want["b", 1] == (0, False, None)
    got = objects.matched_background(spark.createDataFrame(voxels, "tp string, z int, y int, x int, v double"), spark.createDataFrame(mask, "tp string, z int, y int, x int, label int"))
    got = {(r.tp, r.label): (r.drawn, r.redrawn, r.background) for r in got.collect()}
    assert got == {k: (n, r, m if m is None else pytest.approx(m)) for k, (n, r, m) in want.items()}
