import hashlib
import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_dedup import brute_components, norm  # noqa: E402
from test_models import poisson, uniform  # noqa: E402
from test_scan import brute_hits  # noqa: E402
from voxloom.llm import quality  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, words):
    rnd = random.Random(12)
    pick = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    texts = [pick(rnd.randint(8, 60)) for _ in range(80)] + [" ".join(w + "%%" for w in pick(20).split()) for _ in range(30)]
    texts += texts[:6] + [texts[7] + " tail", "lead " + texts[40], None, ""]
    item = pick(14)
    texts += [pick(10) + " " + item + " " + pick(5)]
    rows = [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    where = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(k, int("%%" not in (t or "")), 0) for k, t in enumerate(texts) if k % 2], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where, rows, [(1, item)]


def test_pipeline_against_brute_force(spark, folder):
    where, rows, items = folder
    predicted = {r["doc_id"]: r["predicted"] for r in quality.scores(spark.read.parquet(f"{where}/documents.parquet"), spark.read.parquet(f"{where}/labels.parquet")).collect()}
    kept = [r for r in rows if predicted[r[0]]]
    assert all("%%" not in (r[1] or "") for r in kept)
    first = {}
    for r in kept:
        first.setdefault(norm(r[1]), r[0])
    kept = [r for r in kept if first[norm(r[1])] == r[0]]
    groups = brute_components([(r[0], r[1]) for r in kept], 5, 80)
    kept = [r for r in kept if groups[r[0]][1] == r[0]]
    hit = brute_hits([(r[0], r[1]) for r in kept], items, 10)
    kept = [r for r in kept if not hit[r[0]][4]]
    sizes = {s: sum(r[3] == s for r in kept) for s in {r[3] for r in kept}}
    total = sum(n**0.5 for n in sizes.values())
    want = sorted((r[0], k) for r in kept for k in range(poisson(uniform("mix", r[0]), len(kept) * sizes[r[3]] ** 0.5 / total / sizes[r[3]])))
    assert sorted((r["doc_id"], r["copy"]) for r in corpus_pipeline.run(spark, where).collect()) == want


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder[0])
        assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), folder[0]).count() == 0


def test_digest_of_nothing():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
