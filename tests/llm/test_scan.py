import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.llm import decontaminate, licenses, token_counts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_hits(docs, items, size):
    wins = {}
    for item, text in items:
        w = WORD.findall((text or "").translate(LOWER))
        for k in range(max(len(w) - size + 1, min(len(w), 1))):
            wins.setdefault(tuple(w[k : k + size]), set()).add(str(item))
    out = {}
    for i, text in docs:
        w = WORD.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for key, owners in wins.items():
            for k in range(len(w) - len(key) + 1):
                if tuple(w[k : k + len(key)]) == key:
                    hit.update(range(k, k + len(key)))
                    found |= owners
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


@pytest.fixture(scope="module")
def bench(spark, corpus):
    texts = [t for _, t in corpus if t and len(t.split()) > 12]
    items = [(1, " ".join(texts[0].split()[:14])), (2, "ONE, two!"), (10, None), (11, ""), (12, texts[3]), (13, "été"), (14, " ".join(texts[0].split()[2:13]))]
    return items, spark.createDataFrame(items, "item_id long, text string")


def contamination(docs, benchmark, **options):
    return {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontaminate.contamination(docs, benchmark, **options).collect()}


def test_decontamination_against_brute_force(table, corpus, bench):
    items, benchmark = bench
    want = brute_hits(corpus, items, 10)
    assert contamination(table(corpus), benchmark) == want
    assert contamination(table(corpus), benchmark, block_bytes=40) == want  # several automata
    clean = decontaminate.drop_contaminated(table(corpus), benchmark)
    assert {r["doc_id"] for r in clean.collect()} == {i for i, w in want.items() if not w[4]} and clean.columns == table(corpus).columns


def test_decontamination_odd_rows(spark, table, bench):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination(table([(1, "one two"), (2, None)]), none) == {1: (2, 0, 0, hashlib.sha256(b"").hexdigest(), False), 2: (0, 0, 0, hashlib.sha256(b"").hexdigest(), False)}
    assert contamination(table([]), bench[1]) == {}
    assert decontaminate.contamination(table([(None, "one two"), (3, "x"), (3, "x")]), bench[1]).count() == 3


tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")


def test_token_counts_against_library(table, corpus):
    rnd = random.Random(8)
    alphabet = [*"abcdefghijklmnopqrstuvwxyzSTRE''''   \n\n\t\r.,!?0123456789", "é", "ü", "İ", "中", "　", " ", "½", "٣", "\U0001f600", "́", "'re", "'ve", "'ll", " the", "<|endoftext|>", "<|", "'r", "'v", " '"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 50))) for _ in range(800)]
    rows = [*corpus, *((1000 + k, t) for k, t in enumerate(texts))]
    path = public_tokenizers.path("byte_bpe_50k.json")
    own = tokenizers.Tokenizer.from_file(path)
    got = {r["doc_id"]: r for r in token_counts.token_counts(table(rows), path, limit=20).collect()}
    for i, t in rows:
        n = len(own.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((t or "").encode()), n > 20)
    assert token_counts.token_counts(table([]), path).count() == 0


def test_transducer_is_rebuilt_within_its_bound():
    import numpy as np

    machine = token_counts.Compiled(public_tokenizers.path("byte_bpe_50k.json"))
    text = b"the thing is unbelievably interesting"
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    want = machine.count(data, offsets).tolist()
    machine.merges.MOST_STATES, machine.MOST_WORDS = 3, 2
    machine.forget()
    assert machine.count(data, offsets).tolist() == want and machine.count(data, offsets).tolist() == want


def test_licences_by_template():
    scan = licenses.Scanner()
    for name, text in licenses.TEMPLATES:
        assert list(scan.scan(f"Some words about nothing.\n{text}\nMore words follow here.")[0]) == [name], text
        assert list(scan.scan("\n".join(" * " + " ".join(text.split()[k : k + 9]) for k in range(0, len(text.split()), 9)))[0]) == [name], text
    assert scan.scan("of the and in by to a plain text about a file and its source")[0] == {}
    broken = "# Permission is hereby granted, free of charge, to any person\n# obtaining a copy of this software and associated documentation\n# files, to deal in the Software without restriction"
    assert list(scan.scan(broken)[0]) == ["MIT"]


def test_licences_told_apart():
    scan = licenses.Scanner()
    cases = {
        "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n": ["Apache-2.0"],
        "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n": ["GPL-3.0-only"],
        "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007": ["LGPL-3.0-only"],
        "Copyright (c) 2020 A B " + " ".join(licenses._MIT.split()): ["MIT"],
        "// SPDX-License-Identifier: MIT": ["MIT"],
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": ["CC-BY-SA-4.0"],
        "Licensed under CC BY-SA 4.0. Released under the MIT License.": ["CC-BY-SA-4.0", "MIT"],
        licenses._BSD_2 + licenses._BSD_DISCLAIMER: ["BSD-2-Clause"],
        licenses._BSD_2 + licenses._BSD_NAMES + licenses._BSD_DISCLAIMER: ["BSD-3-Clause"],
        "This text is not licensed under the Apache License, Version 2.0.": [],
    }
    for text, want in cases.items():
        assert sorted(scan.scan(text)[0]) == want, text


def test_cosines_against_brute_force():
    """Dense vectors over all words, as the sparse ones must be."""
    scan = licenses.Scanner()
    rnd = random.Random(4)
    vocabulary = sorted(scan.idf) + ["foo", "bar"]
    for _ in range(50):
        words = rnd.choices(vocabulary, k=rnd.randint(1, 30))
        weigh = lambda ws: np.array([(1 + math.log(ws.count(w))) * scan.idf.get(w, scan.unknown) if w in ws else 0.0 for w in vocabulary])
        x = weigh(words)
        for got, (_, text) in zip(scan.cosines(words), licenses.TEMPLATES):
            y = weigh(licenses._WORD.findall(text.lower()))
            assert abs(got - x @ y / math.sqrt((x @ x) * (y @ y))) < 1e-9


def test_licence_scan_odd_rows(spark):
    mit = "Released under the MIT License."
    rows = [("a/LICENSE", "all rights are with the owner"), ("a/x.py", "code"), ("x.py", "y" * 300_000), ("LICENSE", mit), ("b/c.py", None), ("b/c.py", None)]
    files = spark.createDataFrame([(p, t, *range(7)) for p, t in rows], "path string, text string, _d int, _dir int, _above int, _theirs int, _score int, _says int, `a.b` int")
    got = licenses.license_scan(files)
    assert got.columns == ["path", "_d", "_dir", "_above", "_theirs", "_score", "_says", "a.b", "declared", "score", "licenses", "inherited_from"]
    told = sorted((r["path"], r["licenses"], r["_d"], r["_says"]) for r in got.collect())
    assert told == [("LICENSE", ["MIT"], 0, 5), ("a/LICENSE", [licenses.UNKNOWN], 0, 5), ("a/x.py", [licenses.UNKNOWN], 0, 5), ("b/c.py", ["MIT"], 0, 5), ("b/c.py", ["MIT"], 0, 5), ("x.py", ["MIT"], 0, 5)]


def test_anchors_lose_nothing(corpus):
    scan = licenses.Scanner()
    rnd = random.Random(2)
    vocabulary = sorted(scan.idf) + ["foo", "bar", "baz"]
    for _ in range(3000):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randint(1, 12))]
        if max(scan.cosines(words)) >= scan.threshold:
            assert scan.hot(" ".join(words))


def test_licence_inheritance(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    long_text = "word " * 200
    rows = [
        ("a/LICENSE", mit + "\n" + long_text), ("a/b/x.py", "code"), ("a/b/c/LICENSE", apache), ("a/b/c/d/y.py", "code"), ("a/z.py", apache + "\n" + long_text), ("other/q.py", "code"),
        (None, "code"), ("a/b/e.py", None), ("a/b/e.py", None), ("root.py", ""), ("/abs/COPYING", mit), ("/abs/k/j.c", "x"),
    ]
    files = spark.createDataFrame([(p, t, "c") for p, t in rows], "path string, text string, declared string")
    got = sorted((r["path"] or "", r["licenses"], r["inherited_from"]) for r in licenses.license_scan(files).collect())
    assert got == [
        ("", [], None), ("/abs/COPYING", ["MIT"], None), ("/abs/k/j.c", ["MIT"], "/abs"), ("a/LICENSE", ["MIT"], None), ("a/b/c/LICENSE", ["Apache-2.0"], None), ("a/b/c/d/y.py", ["Apache-2.0"], "a/b/c"),
        ("a/b/e.py", ["MIT"], "a"), ("a/b/e.py", ["MIT"], "a"), ("a/b/x.py", ["MIT"], "a"), ("a/z.py", ["Apache-2.0"], None), ("other/q.py", [], None), ("root.py", [], None),
    ]
    assert licenses.license_scan(files.limit(0)).count() == 0
