import os
import random

import numpy as np
import pytest

from voxloom.llm import html_text, warc

ARTICLE = '<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><nav><a>menu</a></nav><div class="ad">buy</div><article><h1>Head &amp; line</h1><p><b>First<br>part<p>second  &lt;part&gt;</p><div class="comments"><p>me too</p></div></article><footer>foot</footer></body></html>'


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, row long, host string")


def text_of(spark, rows):
    return sorted(((r["page_id"] if r["page_id"] is not None else -1), r["text"]) for r in html_text.main_text(pages(spark, rows)).collect())


def test_article_only(spark):
    rows = [(1, "http://h/a", ARTICLE), (2, "http://h/b", None), (3, None, ""), (None, "http://h/a", ARTICLE), (1, "http://h/a", ARTICLE)]
    want = "Head & line\n\nFirst part\n\nsecond <part>"
    assert text_of(spark, rows) == [(-1, want), (1, want), (1, want), (2, ""), (3, "")]
    assert text_of(spark, []) == []


def test_boilerplate_of_a_host(spark):
    notice = "all our offers end soon so do not wait and call us on any day of the week"
    page = lambda body: f"<body><p>{body}</p><p>{notice}</p></body>"
    rows = [(k, f"https://shop.example/{k}", page(f"own text number {k} with words")) for k in range(5)] + [(9, "https://else.example/", page("alone here"))]
    got = dict(text_of(spark, rows))
    assert got[3] == "own text number 3 with words"
    assert got[9] == f"alone here\n\n{notice}"  # nothing on that host repeats it


def test_copies_of_a_page_keep_their_text(spark):
    body = "<body><p>" + " ".join(f"w{k}" for k in range(40)) + "</p></body>"
    got = dict(text_of(spark, [(1, "http://h/1", body), (2, "http://h/2", body)]))
    assert got[1] == got[2] == " ".join(f"w{k}" for k in range(40))


def test_shared_run_inside_a_block_goes_and_the_rest_stays(spark):
    shared = " ".join(f"s{k}" for k in range(12))
    got = dict(text_of(spark, [(k, "http://h/x", f"<p>a{k} b{k} {shared} c{k}</p>") for k in range(3)]))
    assert got == {k: f"a{k} b{k} c{k}" for k in range(3)}


def test_articles_stay_whole_and_open_text_in_them_is_judged(spark):
    """Prose of an article is its text whatever other pages have; a bare part of it that the host repeats goes."""
    line = "subscribe to our letter and read more of what we write every single day"
    own = lambda k: " ".join(f"w{k}x{j}" for j in range(30))
    page = lambda k: f"<nav>menu of all pages</nav><article><p>{own(k)}</p><div>{line}</div><p>{line}</p></article>"
    rows = [(k, f"http://h/{k}", page(k)) for k in range(3)] + [(7, "http://else/", page(7))]
    rows += [(k, f"http://h/{k}", f"<div class='ad'>ad {k}</div><article><p>{own(9)}</p></article>") for k in (10, 11)]
    got = dict(text_of(spark, rows))
    assert [got[k] for k in range(3)] == [f"{own(k)}\n\n{line}" for k in range(3)]
    assert got[7] == f"{own(7)}\n\n{line}\n\n{line}"
    assert got[10] == got[11] == own(9)


def test_chrome_of_one_page_tells_of_open_text_of_another(spark):
    menu = "home news contact jobs press blog shop help terms privacy"
    own = "this one page has its menu in a plain part"
    got = dict(text_of(spark, [(1, "http://h/1", f"<nav>{menu}</nav><article><p>text</p></article>"), (2, "http://h/2", f"<div>{menu}</div><div>{own}</div>")]))
    assert got == {1: "text", 2: own}


def test_an_article_that_two_open_pages_have_stays(spark):
    article = " ".join(f"w{k}" for k in range(40))
    got = dict(text_of(spark, [(k, f"http://h/{k}", f"<div>dated {k}</div><div>{article}</div>") for k in (1, 2)]))
    assert got == {k: f"dated {k}\n\n{article}" for k in (1, 2)}


def test_names_that_do_not_make_an_article_chrome():
    text = lambda page: html_text.unique_text(html_text.blocks(page), [], 10)
    assert text('<article class="post share">real text</article>') == "real text"
    assert text('<main><div class="banner-free layout">real text</div></main>') == "real text"
    assert text('<main><div class="share layout"><p>the whole article lies in it</p></div></main>') == "the whole article lies in it"
    assert text('<main><p>a b c</p><section id="discussion"><p>reader one</p></section><div class="share-buttons">tweet</div></main>') == "a b c"
    assert text('<div class="comments"><article class="comment">c</article></div><article><p>a</p></article>') == "a"
    assert text("<article><p>x <b title=it's>bold</b> y</p></article>") == "x bold y"
    assert text('<article><p>t</p><a href="cut') == "t"


def test_a_very_long_block_costs_in_proportion():
    page = "<div>" + " ".join(f"w{k % 5000}" for k in range(200_000)) + "</div>"
    pieces = html_text.evidence("h", html_text.blocks(page), 10)
    assert sum(len(text) for _, text, _ in pieces) < 5 * len(page)


def test_runs_across_short_blocks_go(spark):
    """Blocks under ten tokens go if together they repeat; the words where pages begin to differ stay."""
    menu = "".join(f"<div>{t}</div>" for t in ("Home", "All our news", "Contact us today", "Accept all", "By the staff"))
    rows = [(k, f"http://h/{k}", f"<body>{menu}<div>The text of page number {k} is here</div></body>") for k in range(4)]
    assert dict(text_of(spark, rows)) == {k: f"The text of page number {k} is here" for k in range(4)}


def test_repeats_are_those_of_brute_force(spark):
    """All pairs of windows, on hosts of pages with open, marked and kept parts."""
    rnd = random.Random(8)
    shared = [" ".join(rnd.choices("abcdefgh", k=14)) for _ in range(4)]
    part = lambda: rnd.choice(shared) if rnd.random() < 0.4 else " ".join(rnd.choices("abcdefgh", k=rnd.randint(1, 16)))
    tag = lambda: rnd.choice(["<div>{}</div>", "<nav>{}</nav>", "<section>{}</section>", "<article><p>{}</p></article>"] if rnd.random() < 0.3 else ["<p>{}</p>"])
    rows = [(k, f"http://h{k % 2}/", "".join(tag().format(part()) for _ in range(rnd.randint(1, 6)))) for k in range(60)]
    rows += [(60, "http://h0/", "<div>" + "a " * 40 + "</div>"), (61, "http://h0/", "<div>" + "a " * 25 + "b</div>")]
    windows, pages_of = {}, {}
    for k, url, page in rows:
        found = html_text.blocks(page)
        tokens = [t if b.kind != html_text.KEEP else None for b in found for t in b.text.split(" ")]
        pages_of[k] = (html_text.host_of(url), found, tokens)
        for j in range(len(tokens) - 9):
            if None not in tokens[j : j + 10]:
                windows.setdefault((pages_of[k][0], *tokens[j : j + 10]), set()).add("\n".join(b.text for b in found))
    want = {}
    for k, (host, found, tokens) in pages_of.items():
        want[k] = html_text.unique_text(found, [j for j in range(len(tokens) - 9) if len(windows.get((host, *tokens[j : j + 10]), ())) > 1], 10)
    assert dict(text_of(spark, rows)) == want
    assert sum(want[k] != html_text.unique_text(found, [], 10) for k, (_, found, _) in pages_of.items()) > 5


def test_suffix_array_against_sorting():
    rnd = random.Random(1)
    for size in (1, 2, 30, 200):
        ids = [rnd.randint(0, 3) for _ in range(size)]
        order, same = html_text.suffix_array(np.array(ids), 5)
        assert order.tolist() == sorted(range(size), key=lambda k: ids[k:])
        assert same.tolist() == [ids[a : a + 5] == ids[b : b + 5] and len(ids[a : a + 5]) == 5 for a, b in zip(order, order[1:])]


def test_unbalanced_markup():
    kept = lambda page: [t for t, kind in html_text.blocks(page) if kind != html_text.CHROME]
    assert kept("<p>a<p>b</i></div> c<nav>x") == ["a", "b", "c"]
    assert kept("<style>p{}</style>x < y &copy;") == ["x < y ©"]
    assert kept('<a title="a>b">t</a>') == ["t"]
    assert kept("<script>never closed") == []
    assert kept('<div class="page has-sidebar"><div id="sidebar">s</div><article><header class="entry-header"><h1>T</h1></header>x<aside>y</aside><p class="ad">z</p></article></div>') == ["T", "x"]
    assert kept('<header>h</header><main><p>a</p><section class="comments"><article>c</article></section></main>') == ["a"]


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "u1", "same"), (2, "u2\r\nX: y", "same"), (3, None, None), (4, "u4", ""), (5, "u5", "é" * 3000), (6, "u6", "é" * 3000), (7, "u7", "x\r\n\r\ny WARC/1.1\r\n0\r\n\r\n"), (7, "u7", "z" * 5000), (7, "u7", "z" * 5000), (None, "u0", "same"), (None, "u0", "null only")]
    path = str(tmp_path / "archives")
    warc.write_archives(pages(spark, rows), path, segment_bytes=700, chunk_bytes=97, records_per_file=5)
    records = warc.read_archives(spark, path)
    payloads = {}
    for r in records.filter("record_type = 'response'").collect():
        payloads.setdefault(r["page_id"], []).append(bytes(r["payload"]).decode())
    assert sorted(payloads[7]) == sorted(["x\r\n\r\ny WARC/1.1\r\n0\r\n\r\n", "z" * 5000, "z" * 5000])
    assert payloads[5] == ["é" * 3000] and payloads[1] == ["same"] and payloads[None] == ["null only"]
    told = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0, r["payload_bytes"]) for r in warc.resolved(records).collect())
    assert told == sorted([(1, "response", 0, 4), (2, "revisit", 1, 4), (3, "response", 0, 0), (4, "revisit", 3, 0), (5, "response", 0, 6000), (6, "revisit", 5, 6000), (7, "response", 0, 22), (7, "response", 0, 5000), (7, "response", 0, 5000), (0, "revisit", 1, 4), (0, "response", 0, 9)])
    assert warc.digest(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"


def test_warc_of_no_pages_and_of_a_very_long_one(spark, tmp_path):
    warc.write_archives(pages(spark, []), str(tmp_path / "none"))
    assert warc.resolved(warc.read_archives(spark, str(tmp_path / "none"))).count() == 0
    long = "x" * 3_000_000
    warc.write_archives(pages(spark, [(1, "u", long), (2, "v", "y")]), str(tmp_path / "long"))
    got = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read_archives(spark, str(tmp_path / "long")).collect()}
    assert got == {1: long, 2: "y"}


def test_warc_small_payloads_are_responses(spark, tmp_path):
    path = str(tmp_path / "small")
    warc.write_archives(pages(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")]), path, min_revisit_bytes=4)
    got = {r["page_id"]: r["record_type"] for r in warc.read_archives(spark, path).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_warc_damage_is_noticed():
    whole = b"\r\n\r\n".join(warc.response_records(1, "u", b"payload" * 100, "d", 300, 50)) + b"\r\n\r\n"
    assert len(list(warc.parse_archive(whole))) > 2
    with pytest.raises(ValueError):
        list(warc.parse_archive(whole[:-40]))
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")
    assert warc.unchunked(warc.chunked(os.urandom(999), 100)) is not None


def test_warc_missing_segment_fails(spark, tmp_path):
    import gzip

    parts = list(warc.response_records(1, "u", b"payload" * 100, "d", 300, 50))
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "a.warc.gz").write_bytes(gzip.compress(b"".join(p + b"\r\n\r\n" for k, p in enumerate(parts) if k != 1)))
    with pytest.raises(Exception, match="missing"):
        warc.read_archives(spark, str(tmp_path / "cut")).collect()
