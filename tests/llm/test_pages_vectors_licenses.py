"""Extraction on hand-made pages, vectors and license phrases against brute force."""

import math
import random
import re

import numpy as np
from pyspark.sql import Row

from quillspark.llm.embedding_dedup import near_vectors
from quillspark.llm.html_extraction import extract_pages
from quillspark.llm.license_scan import BASE, TEMPLATES, license_scan

PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>'
    '<header>Site</header><nav><ul><li><a href="/x">menu</a></li></ul></nav><!-- c --><div class="ad box-1">Buy &amp; save</div>'
    '<div class="main c12"><h1>Head &amp; <b>bo</b>ld</h1><p>One  two\n three<br>four&nbsp;<i>five</i><p>Six &lt;7&gt;</p>'
    '<div class="comments"><p>First!</p></div><form><input>Name</form></div><aside>More</aside><footer>&copy; me</footer></body></html>'
)
TEXT = "Head & bold One two three four five Six <7>"


def test_extraction(spark):
    stray = PAGE.replace("c12", "c7").replace("<aside>", "<div class='teaser'><p>short stray note</p></div><aside>")
    cut = PAGE[: PAGE.index("Six") + 3]
    rows = [(1, "http://a.example/1", PAGE), (2, "http://a.example/2", stray), (3, "https://b.example", cut), (4, None, None), (5, "x", ""), (6, "http://a.example/3", "plain words only"), (7, "http://a.example/1", PAGE)]
    pages = spark.createDataFrame([Row(page_id=a, url=b, html=c, text="t", host="h", own="o") for a, b, c in rows], "page_id long, url string, html string, text string, host string, own string")
    got = {r.page_id: r for r in extract_pages(pages).collect()}
    assert {k: v.text for k, v in got.items()} == {1: TEXT, 2: TEXT, 3: TEXT[: TEXT.index("Six") + 3], 4: "", 5: "", 6: "plain words only", 7: TEXT}
    assert all(v.n_chars == len(v.text) for v in got.values())
    assert extract_pages(pages.limit(0)).count() == 0


def test_extraction_keeps_whole_articles(spark):
    page = lambda body: f"<html><body><nav>menu</nav>{body}<footer>end</footer></body></html>"
    intro, long, short = "intro " * 30, "body " * 80, "short " * 20
    nested = page(f"<article><p>{intro}</p><div class=body><p>{long}</p></div></article>")
    sections = page(f"<article><section class=a><p>{long}</p></section><section class=b><p>{short}</p></section></article>")
    body_only = page(f"<article><div class=body><p>{long}</p></div></article>")
    other = page(f"<div class=story><p>{long}</p></div><article><div class=body><p>see also</p></div></article>")
    icons = page(f"<article><p>one <svg class='i'/> two <math/> three <svg/><svg title='/>'><text>no</text></svg> {short}</p></article>")
    rows = [(1, "http://n.example/1", nested), (2, "http://s.example/1", sections), (3, "http://n.example/2", body_only), (4, "http://n.example/3", body_only), (5, "http://n.example/4", other), (6, "http://i.example/1", icons)]
    # pages without a host don't vote for each other
    rows += [(7, None, body_only), (8, "odd", body_only), (9, None, page(f"<article><div class=body><p>{long}</p></div></article><div class=more>{short}</div>"))]
    got = {r.page_id: r.text.split() for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {1: intro + long, 2: long + short, 3: long, 4: long, 5: long + "see also", 6: "one two three " + short, 7: long, 8: long, 9: long + short}
    assert got == {k: v.split() for k, v in want.items()}


def test_extraction_by_names(spark):
    body = "body " * 40
    cases = {
        "<p>Before <a class='share'>Share</a> after text.</p>" + body: "Before after text. " + body,
        f"<p>One <span class='share'>no <span>no</span> no</span> two <b>three</b></b> four</p>{body}": "One two three four " + body,
        f"<div class='content has-sidebar'><article><p>{body}</p></article></div>": body,
        f"<div class='sidebar-layout'><div class='post'><p>{body}</p></div><div class='sidebar-right'>no</div></div>": body,
        f"<article><div class='article-header'><h1>Title</h1></div><p>{body}</p><div class='entry-footer'>no</div><div class='post-comments'><p>no</p></div></article>": "Title " + body,
        f"<article><p>{body}<math><mi>x</mi><mo>=</mo><mn>2</mn></math></p><object><p>kept</p></object></article>": body + "x=2 kept",
        f"<div class='sidebar'><article><p>{body}</p></article></div>": body,
        "<div class='ad'>buy</div><nav>menu</nav>": "",
        f"<article><p class='legal-notice'>{body}</p></article>": "",
        f"<article><p>{body * 3000}</p></article>": body * 3000,
    }
    rows = [(k, f"http://h{k}.example/", f"<html><body>{x}</body></html>") for k, x in enumerate(cases)]
    got = {r.page_id: r.text.split() for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: v.split() for k, v in enumerate(cases.values())}


def test_extraction_of_the_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    import html

    for r in extract_pages(pages).join(pages.select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)(?:</article>|<footer>|$)", r.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"</?[bi]>", "", re.sub(r"</?(?:p|h\d|br)\b[^>]*>", " ", article))).split())
        assert r.text == want


def brute_vectors(rows):
    ok = {i: (lab, np.array(v, float)) for i, v, lab in rows if lab is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    links = {i: set() for i, _, _ in rows}
    ids = sorted(ok)
    for a in ids:
        for b in ids:
            if a != b and ok[a][0] == ok[b][0] and ok[a][1] @ ok[b][1] / np.sqrt(ok[a][1] @ ok[a][1]) / np.sqrt(ok[b][1] @ ok[b][1]) >= 0.98:
                links[a].add(b)
    out = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (len(links[i]), min(seen))
    return out


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((30, 16))
    rows = []
    for i in range(400):
        v = base[rng.integers(30)] + rng.standard_normal(16) * rng.choice([0.0, 0.1, 0.15, 0.3])
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(2))))
    rows += [(400, None, 1), (401, [0.0] * 16, 1), (402, [float("nan")] * 16, 1), (403, [1.0] * 16, None), (404, [1.0] * 15 + [None], 1), (405, [], 0), (406, rows[0][1], rows[0][2])]
    frame = spark.createDataFrame([Row(vec_id=a, embedding=b, label=c, rep="r", size=1) for a, b, c in rows], "vec_id long, embedding array<float>, label int, rep string, size int")
    truth = brute_vectors(rows)
    # few rows a leaf and small blocks: deep trees, spill and block pairs all take part
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(frame, leaf_rows=64, block=16, spill=0.05, trees=5).collect()}
    assert got.keys() == truth.keys()
    found, there = sum(n for n, _ in got.values()), sum(n for n, _ in truth.values())
    assert 0.97 * there <= found <= there
    assert all(got[i][0] <= truth[i][0] for i in truth)
    exact = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(frame, leaf_rows=1000, block=16).collect()}
    assert exact == truth
    beyond = near_vectors(frame, leaf_rows=16, sample_rows=64, trees=8, spill=0.08)
    assert sum(r.n_links for r in beyond.collect()) >= 0.9 * there
    assert near_vectors(frame.limit(0)).count() == 0


def test_recall_at_the_defaults_on_given_vectors(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rng = np.random.default_rng(7)
    rows = [(r.vec_id, r.embedding, r.label) for r in vectors.collect()]
    near = [(10_000 + k, [float(np.float32(x)) for x in np.array(v) + rng.standard_normal(len(v)) * 0.02 * np.linalg.norm(v)], lab) for k, (_, v, lab) in enumerate(rows)]
    truth = brute_vectors(rows + near)
    got = {r.vec_id: r.n_links for r in near_vectors(spark.createDataFrame(rows + near, "vec_id long, embedding array<float>, label int"), leaf_rows=32).collect()}
    there = sum(n for n, _ in truth.values())
    assert there > 400 and there >= sum(got.values()) >= 0.99 * there


def test_vectors_of_every_dimension_and_every_row(spark):
    rng = np.random.default_rng(6)
    rows = []
    for dim, n in ((8, 120), (5, 90), (3, 6)):
        base = rng.standard_normal((n // 3, dim))
        rows += [(1000 * dim + k, [float(np.float32(x)) for x in base[k % (n // 3)] + rng.standard_normal(dim) * 0.03], k % 2) for k in range(n)]
    truth = {}
    for dim in (8, 5, 3):
        truth |= brute_vectors([r for r in rows if len(r[1]) == dim])
    again = [(rows[0][0], None, 1), (rows[0][0], [0.0] * 8, 1)]
    frame = spark.createDataFrame([Row(vec_id=a, embedding=b, label=c) for a, b, c in rows + again], "vec_id long, embedding array<float>, label int")
    got = near_vectors(frame, leaf_rows=1000, block=16).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted([(k, *v) for k, v in truth.items()] + [(rows[0][0], 0, rows[0][0])] * 2)
    # two dimensions with a forest each
    forests = near_vectors(frame, leaf_rows=64, block=16, spill=0.05, trees=5).collect()
    assert len(forests) == len(rows) + 2 and sum(r.n_links for r in forests) >= 0.97 * sum(n for n, _ in truth.values())


def brute_licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places = [(k, label) for phrase, label in BASE.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    starts = [k for k, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_licenses_match_brute_force(spark):
    rng = random.Random(4)
    bits = ["cc", "by", "CC-BY", "general", "public", "license", "All", "rights", "reserved.", "und", "ñ", "4.0", "GNU"]
    texts = [None, "", "cc", "CC BY", "cc by cc by", "all rights all rights reserved", "All Rights Reserved\nGeneral  PUBLIC license, cc-by"]
    texts += [" ".join(rng.choice(bits) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    rows = [Row(doc_id=i, text=t, words=1, label="l", spans="s") for i, t in enumerate(texts)] + [Row(doc_id=6, text=texts[6], words=1, label="l", spans="s")]
    got = license_scan(spark.createDataFrame(rows, "doc_id long, text string, words int, label string, spans string")).collect()
    assert {r.doc_id for r in got} == set(range(len(texts)))
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_licenses(texts[r.doc_id])
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)


def test_licenses_keep_repeated_rows(spark):
    rows = [(1, "CC BY, all rights reserved")] * 3 + [(1, "cc by"), (2, None), (2, None), (None, "cc by"), (None, "cc by"), (3, "none"), (3, "none")]
    got = sorted((r.doc_id or 0, r.n_words, r.n_base) for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got == sorted([(1, 5, 2)] * 3 + [(1, 2, 1)] + [(2, 0, 0)] * 2 + [(0, 2, 1)] * 2 + [(3, 1, 0)] * 2)


def test_merged_diagonals_find_changed_wordings(spark):
    texts = {
        1: "noise Permission is hereby kindly granted, free of charge, to any person obtaining a copy of this software and the associated documentation files (the Software), to deal in Software without restriction more",
        2: "Redistribution of words in source code is not the same thing", 3: "Licensed under CC BY-NC 4.0.",
    }
    rows = license_scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.labels for r in rows} == {1: "mit", 2: "", 3: "cc-by,cc-by-nc"}


def test_every_template_is_found_and_only_in_its_order(spark):
    rng = random.Random(3)
    wanted = [(label, phrase) for label, phrases in TEMPLATES.items() for phrase in phrases]
    noise = lambda n: " ".join(rng.choice(["und", "the", "of", "software", "license", "der"]) for _ in range(n))
    texts = [f"{noise(60)}. {phrase.upper()}! {noise(60)}" for _, phrase in wanted]
    backward = [" ".join(reversed(phrase.split())) for _, phrase in wanted if len(phrase.split()) > 9]
    halves = ["any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction " * 30 + "permission is hereby granted free of charge to"]
    long_text = noise(30_000) + " " + wanted[1][1]
    got = {r.doc_id: r for r in license_scan(spark.createDataFrame(list(enumerate([*texts, *backward, *halves, long_text])), "doc_id long, text string")).collect()}
    for k, (label, phrase) in enumerate(wanted):
        assert label in got[k].labels.split(","), (label, phrase)
        spans = [s for s in got[k].spans if s["label"] == label and abs(s["first"] - 60) <= 4]
        assert spans and any(abs(s["last"] - (60 + len(phrase.split()) - 1)) <= 5 for s in spans)
    assert all(not got[len(wanted) + k].labels for k in range(len(backward)))
    assert wanted[1][0] in got[len(texts) + len(backward) + 1].labels.split(",")
    assert license_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_boxes_with_unlisted_names_go_by_the_votes_of_their_host(spark):
    from quillspark.llm import html_extraction

    def page(k, box="<div class='zone'><p>Latest stories elsewhere</p><p>And one more to read</p></div>"):
        return f"<html><body><div class='c{k}'><h1>Title {k}</h1><p>Summary</p><p>The text of page {k} is about the number {k}.</p></div>{box}</body></html>"

    same = "<html><body><div class='text'><p>One text for all.</p></div><div class='more'><p>Short</p></div></body></html>"
    rows = [(k, f"http://host.example/{k}", page(k)) for k in range(20)] + [(100 + k, f"http://copies.example/{k}", same) for k in range(6)] + [(200, "http://alone.example/", page(200))]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in html_extraction.extract_pages(frame).collect()}
    # the box goes, what the article repeats stays, copies of a page and a page alone keep all
    assert all(got[k] == f"Title {k} Summary The text of page {k} is about the number {k}." for k in range(20))
    assert all(got[100 + k].startswith("One text for all.") for k in range(6)) and got[200].endswith("And one more to read")
    # without the votes, the box would stay
    blocks = html_extraction.blocks_of(page(4))
    assert html_extraction.without_furniture(blocks, set()) == blocks and any("elsewhere" in t for _, t in blocks)
