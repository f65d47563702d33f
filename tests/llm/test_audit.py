"""The filter audit against a direct count of every order."""

import random
from itertools import permutations

import duckdb
import pandas as pd

from voxloom.llm import filter_audit
from voxloom.llm.oracles import ORACLES

SPACES = " \t\n\x0b\x0c\r"


def brute(docs, labels):
    """docs: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    rows = []
    for i, t, lang in docs:
        t = t or ""
        words = "".join(" " if c in SPACES else c for c in t).split(" ")
        words = [w for w in words if w]
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": i is not None and t in least and least[t] < i,
        }
        mine = [x for x in labels if i is not None and x[0] == i]
        rows.append((lang or "", fails, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out, removed = [], {}
    for part in {r[0] for r in rows}:
        for order in map("".join, permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                here = [r for r in left if r[1][f]]
                redundant = sum(r[1][f] for r in gone)
                left = [r for r in left if not r[1][f]]
                removed[part, f] = removed.get((part, f), 0) + len(here)
                alone = sum(r[0] == part and r[1][f] and sum(r[1].values()) == 1 for r in rows)
                out.append([part, order, step, len(left), len(here), redundant, alone, sum(r[2] for r in here), sum(r[3] for r in here)])
                gone += here
    return sorted((*r, removed[r[0], r[1][r[2] - 1]]) for r in out)


def make():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 4)))
    texts = [None, "", " \n ", "A B C", "é # ö", "x" * 70000, " ".join(word() for _ in range(9000)), " ".join(word() for _ in range(300)), "UPPER lower " * 150, "same words " * 120]
    docs = [(k, rnd.choice(texts), rnd.choice(["en", "de", None, ""])) for k in range(150)]
    docs += [(k, texts[7], "en") for k in range(150, 260)]  # a large group
    docs += [(None, texts[7], "en"), (None, None, None), (5, texts[7], "en"), (5, texts[7], "en"), (200, texts[7], "en")]
    labels = [(k, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for k in range(0, 260, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    return docs, labels


def test_every_order(spark):
    docs, labels = make()
    frame = spark.createDataFrame([(*d, 7, "x", 1, 2) for d in docs], "doc_id long, text string, lang string, mask int, body string, print int, part int")
    marks = spark.createDataFrame([(*x, 3, "y") for x in labels], "doc_id long, quality int, toxic int, good int, text string")
    got = filter_audit.audit(frame, marks).toPandas()
    assert sorted(got.itertuples(index=False, name=None)) == brute(docs, labels)
    assert list(got.columns) == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_the_sql_says_the_same():
    docs, labels = make()
    docs = [d for d in docs if d[0] is not None]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(docs, columns=["doc_id", "text", "lang"]))
    con.register("labels", pd.DataFrame(labels, columns=["doc_id", "quality", "toxic"]).astype("Int64"))
    assert sorted(con.execute(ORACLES["op12_filter_audit"]).fetchall()) == brute(docs, labels)


def test_groups_that_boundaries_cut(spark):
    """One text in nearly all rows and every partition; two texts of one fingerprint don't mix."""
    rows = [(k, "copy" if k % 5 else f"text {k}") for k in range(400)]
    frame = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    got = {r.doc_id: r.mask & filter_audit.COPY > 0 for r in filter_audit.failures(frame).collect()}
    assert got == {i: t == "copy" and i > 1 for i, t in rows}
    spread = frame.selectExpr("doc_id", "1L as print").repartitionByRange(4, "print", "doc_id").rdd.glom().map(len).collect()
    assert max(spread) < 200  # equal fingerprints are dealt by id


def test_empty(spark):
    frame = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert filter_audit.audit(frame, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []
