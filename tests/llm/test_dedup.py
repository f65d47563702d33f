import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from voxloom.llm import exact_dedup, near_dedup, substring_dedup
from voxloom.llm.graph import components

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_against_brute_force(table, corpus):
    got = {r["doc_id"]: r for r in exact_dedup.exact_groups(table(corpus)).collect()}
    assert len(got) == len(corpus)
    for i, t in corpus:
        same = [j for j, u in corpus if norm(u) == norm(t)]
        r = got[i]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (min(same), len(same), i == min(same))
        assert r["text_sha256"] == hashlib.sha256(norm(t).encode()).hexdigest()


def test_exact_collisions_stay_apart(table):
    docs = table([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "")])
    got = {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_groups(docs, content_hash=lambda c: F.lit("x")).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 4}


def test_exact_null_ids_repeated_rows_and_empty(table):
    docs = table([(None, "a"), (7, "a"), (7, "a"), (None, "z")])
    rows = sorted((r["doc_id"] or 0, r["keep_id"] or 0, r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(docs).collect())
    assert rows == [(0, 0, 1, True), (0, 7, 3, False), (7, 7, 3, True), (7, 7, 3, True)]
    assert exact_dedup.exact_groups(table([])).count() == 0
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns and kept.count() == 3


def shingles(text, n):
    w = SPLIT.findall((text or "").translate(LOWER))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute_components(rows, n, percent):
    sets = {i: shingles(t, n) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return {i: (len(sets[i]), find(i)) for i in sets}


def near(docs, **options):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs, **options).collect()}


def test_near_against_brute_force(table, corpus):
    assert near(table(corpus), words=2) == brute_components(corpus, 2, 80)


def test_near_long_lists_in_blocks(table, corpus, monkeypatch):
    monkeypatch.setattr(near_dedup, "SHORT_LIST", 2)
    monkeypatch.setattr(near_dedup, "LIST_BLOCK", 3)
    monkeypatch.setattr(near_dedup, "STAR_ROUNDS", 1)
    assert near(table(corpus), words=5) == brute_components(corpus, 5, 80)


def test_near_odd_rows(table):
    docs = table([(1, None), (2, ""), (3, "x"), (4, "X"), (4, "x"), (None, "x"), (5, "other words")])
    rows = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0, r["kept"]) for r in near_dedup.near_duplicates(docs, words=2).collect())
    assert rows == [(0, 1, 0, True), (1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (4, 1, 3, False), (4, 1, 3, False), (5, 1, 5, True)]
    assert near_dedup.near_duplicates(table([]), words=2).count() == 0


def test_sketch_bound():
    assert near_dedup.least_overlap(64, 0.8) < 0.8 * 64
    assert near_dedup.least_overlap(256, 0.8) / 256 > near_dedup.least_overlap(64, 0.8) / 64


def test_components_of_paths_and_stars(spark):
    links = [(k, k + 1) for k in range(20)] + [(50, k) for k in range(51, 60)] + [(70, 70), (None, 3)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(21)}, **{k: 50 for k in range(50, 60)}}


def brute_cut(rows, window):
    words = {i: SPLIT.findall(t or "") for i, t in rows}
    first = {}
    for i, w in words.items():
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def test_substring_against_brute_force(table, corpus):
    for window in (13, 5, 1):
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup.remove_repeats(table(corpus), window=window).collect()}
        assert got == brute_cut(corpus, window)


def test_substring_odd_rows(table):
    t = " ".join(map(str, range(20)))
    docs = table([(5, t), (5, t), (None, t), (3, "x " + t), (9, None), (8, "")])
    rows = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in substring_dedup.remove_repeats(docs, window=13).collect())
    assert rows == [(0, 20, 20), (3, 21, 0), (5, 20, 20), (5, 20, 20), (8, 0, 0), (9, 0, 0)]
    spans = substring_dedup.remove_repeats(table([(1, t), (2, "y " + t + " z")]), window=13).filter("doc_id = 2").first()
    assert list(spans["spans"]) == [1, 21] and spans["kept_text"] == "y z"
    assert substring_dedup.remove_repeats(table([]), window=13).count() == 0
    assert substring_dedup.levels(13) == [4, 8, 13] and substring_dedup.levels(3) == [3]


def test_windows_whose_hashes_agree_are_told_apart_by_their_tags():
    docs = pa.table({"id": [5], "text": ["a b c d"]})
    found = substring_dedup._level(docs, 0, 2, None, 2)
    found = found.set_column(1, "mark", pa.array(found["mark"].to_numpy().view(np.uint32)))
    order = np.argsort(found["h"].to_numpy().view(np.uint64))
    found = found.take(order)
    h, tag, n = found["h"].to_numpy().view(np.uint64), found["mark"].to_numpy() // 2, found.num_rows
    assert n == 3 and found["lo"].to_pylist() == [5] * 3 and not any(found["mark"].to_numpy() % 2)
    ones = np.ones(n, np.int64)
    assert substring_dedup._cut(docs, 2, h, tag, ones)["n_removed"].to_pylist() == [4]
    assert substring_dedup._cut(docs, 2, h, tag + 1, ones)["n_removed"].to_pylist() == [0]
    twice = np.repeat(h, 2), np.stack([tag + 1, tag], 1).ravel()
    assert substring_dedup._cut(docs, 2, *twice, np.tile([1, 9], n))["n_removed"].to_pylist() == [0]
    assert substring_dedup._cut(docs, 2, *twice, np.tile([9, 1], n))["n_removed"].to_pylist() == [4]


def test_values_that_agree_in_their_upper_bits_reject_no_pair(spark):
    """8 of 10 values shared, two of them with the same upper bits, is 80 %; 7 of 11 is not."""
    rows = [(9, [1, 1, 2, 3, 4, 5, 6, 7, 100], 9, [1, 1, 2, 3, 4, 5, 6, 7, 200]), (9, [1, 2, 3, 4, 5, 6, 7, 100, 101], 9, [1, 2, 3, 4, 5, 6, 7, 200, 201])]
    pairs = spark.createDataFrame(rows, "na int, ska array<int>, nb int, skb array<int>")
    assert [r[0] for r in pairs.select(near_dedup._estimate_passes(80)).collect()] == [True, False]


def test_runs_that_are_certain():
    """Whatever values are in one set only, the common ones have a run of this length in a row."""
    rnd = random.Random(6)
    for size in range(5, 60):
        odd = (100 - 80) * size // 100
        for _ in range(40):
            gone = set(rnd.sample(range(size), odd))
            longest = max(len(r) for r in "".join("x" if k in gone else "." for k in range(size)).split("x"))
            assert longest >= near_dedup.certain_run(size, 80)
    assert near_dedup.certain_run(1 << 20, 80) == 4


def test_similar_sets_share_a_key_and_few_others_do():
    rng = np.random.default_rng(1)
    for percent in (80, 60):
        runs = near_dedup.Runs(percent, near_dedup.SKETCH)
        for union in [*range(5, 40), 100, 127, 128, 129, 200, 300, 383, 384, 385, 400, 700, 1100, 3000, 9000]:
            values = rng.integers(0, 1 << 63, union, dtype=np.uint64)
            odd = rng.permutation(union)[: (100 - percent) * union // 100]
            cut = rng.integers(0, len(odd) + 1)
            a, b = np.sort(np.delete(values, odd[:cut])), np.sort(np.delete(values, odd[cut:]))
            if len(odd):
                assert set(runs.keys(a).tolist()) & set(runs.keys(b).tolist()), (percent, union)
        # half alike: as many keys as before, hardly one in common
        values = rng.integers(0, 1 << 63, 1500, dtype=np.uint64)
        a, b = np.sort(values[:1000]), np.sort(values[500:])
        assert 40 < len(runs.keys(a)) < 400 and len(set(runs.keys(a).tolist()) & set(runs.keys(b).tolist())) < 30


def test_missed_chance_by_simulation():
    rng = np.random.default_rng(2)
    share, density, run, size, tries = 0.8, 0.2, 5, 40, 4000
    lost = 0
    for _ in range(tries):
        common, begin = rng.random(size) < share, rng.random(size) < density
        lost += not any(begin[k] and common[k : k + run].all() for k in range(size - run + 1))
    assert abs(lost / tries - near_dedup.missed(size, density, run, share)) < 0.03
