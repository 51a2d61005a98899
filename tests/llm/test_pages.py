"""Main text of pages."""

import time

import numpy as np
from conftest import SF_DIR

from normscope.llm import html_wrapper

KIND = "page_id long, url string, html string, text string, host string"


def page(title, paragraphs, extra=""):
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return f"""<!DOCTYPE html><html><head><title>{title}</title><style>p {{}}</style></head><body>
<nav><ul><li><a href="/">Home</a></li><li><a href="/a">All</a></li></ul></nav>{extra}
<div class="content"><h1>{title}</h1>{body}</div><div class="sidebar"><p>Read this too</p></div>
<section class="comments"><p>nice one</p></section><footer><p>All rights reserved</p></footer><script>var x = "<p>no</p>";</script></body></html>"""


def extract(spark, rows):
    frame = spark.createDataFrame([(i, u, h, "clash", "clash") for i, u, h in rows], KIND)
    return {r["page_id"]: (r["text"], r["n_chars"], r["url"]) for r in html_wrapper.extract_text(frame).collect()}


def test_article_without_its_surroundings(spark):
    rows = [(k, f"http://a.test/{k}", page(f"Title {k}", [f"First &amp; {k} <b>bold</b>\n  words", f"Second &#233; {k}"] + ["Third"] * (k % 3), '<div class="cookie-notice"><p>We use cookies</p></div>' if k % 2 else "")) for k in range(8)]
    got = extract(spark, rows)
    for k in range(8):
        want = "\n\n".join([f"Title {k}", f"First & {k} bold words", f"Second é {k}"] + ["Third"] * (k % 3))
        assert got[k] == (want, len(want), f"http://a.test/{k}")


def test_odd_pages_keep_their_rows(spark):
    broken = "<html><body><div class='content'><p>unclosed <b>text<p>next one <a href=x"
    rows = [(1, "http://a.test", None), (2, None, ""), (3, "no url", "plain words only"), (4, "http://b.test", broken), (4, "http://b.test", broken), (5, "http://c.test", "<p>" * 3_000 + "deep" + "<div>" * 300), (6, "http://d.test/x", page("Long", ["word " * 60_000]))]
    got = extract(spark, rows)
    assert set(got) == {1, 2, 3, 4, 5, 6}
    assert got[1][0] == got[2][0] == ""
    assert got[3][0] == "plain words only"
    assert got[4][0].startswith("unclosed text\n\nnext one")
    assert got[6][1] == len("Long") + 2 + 5 * 60_000 - 1


def test_wrapper_is_inferred_with_optional_and_repeated_parts():
    forms = [html_wrapper.fold(html_wrapper.read_page(h).names) for h in ("<div><h1>a</h1><p>b</p><p>c</p></div>", "<div><h1>a</h1><h2>s</h2><p>b</p></div>")]
    wrapper = html_wrapper.merge(forms[0], forms[1])
    assert html_wrapper.expression(wrapper) == "(div (h1 #)(h2 #)?(p #)+)"


def form_of(source):
    return html_wrapper.fold(html_wrapper.read_page(source).names)


def test_rows_of_blocks_repeat_as_one_group():
    def page(sections):
        return form_of("<div>" + "<h2>t</h2><p>a</p><p>b</p>" * sections + "<ul><li>x</li></ul></div>")

    three, five, one = page(3), page(5), page(1)
    assert html_wrapper.dump(three) == html_wrapper.dump(five)
    assert html_wrapper.expression(three) == "(div ((h2 #)(p #)+)+(ul (li #)))"
    for order in ((three, one), (one, three)):
        assert html_wrapper.expression(html_wrapper.merge(*order)) == "(div ((h2 #)(p #)+)+(ul (li #)))"
    wrapper = html_wrapper.merge(three, form_of("<div><ul><li>x</li><li>y</li></ul><pre>c</pre></div>"))
    assert html_wrapper.expression(wrapper) == "(div ((h2 #)(p #)+)*(ul (li #)+)(pre #)?)"
    found = list(html_wrapper.match(one, wrapper))
    assert sorted(len(k) for _, k in found) == [1, 1, 2] and all("(" in p for p, _ in found[:2])
    assert html_wrapper.load(html_wrapper.dump(wrapper)) == wrapper or html_wrapper.dump(html_wrapper.load(html_wrapper.dump(wrapper))) == html_wrapper.dump(wrapper)


def test_headlines_and_captions_of_an_article_stay(spark):
    def source(k):
        return f"""<html><body><header><p>Site {k % 2}</p></header><article><header class="entry-header"><h1>Head {k}</h1></header><p>Body {k}</p>
<figure><img src="x"><figcaption>Caption {k}</figcaption></figure><div class="share"><p>Share me</p></div><footer><p>filed {k}</p></footer></article></body></html>"""

    got = extract(spark, [(k, "http://head.test", source(k)) for k in range(5)])
    assert all(got[k][0] == f"Head {k}\n\nBody {k}\n\nCaption {k}" for k in range(5))


def test_pages_without_article_tags_by_several_templates(spark):
    """Made pages whose article is known: three templates of one host, none with article or main tags."""
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for k in range(60):
        words = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 900, n))
        title = f"Title {k} {words(4)}"
        parts = [f"{words(30)} {k}.{i}" for i in range(int(rng.integers(1, 6)))]
        menu = "<ul class='menu'>" + "".join(f"<li><a href='/{i}'>Item {i}</a></li>" for i in range(int(rng.integers(3, 9)))) + "</ul>"
        foot = "<div id='footer'><p>All rights reserved</p></div>"
        if k % 3 == 0:
            body = f"<div class='content'><h1>{title}</h1>" + "".join(f"<p>{p}</p>" for p in parts) + "</div><div class='comments'><p>First!</p></div>"
            blocks = [title, *parts]
        elif k % 3 == 1:
            heads = [f"Part {k} {i}" for i in range(len(parts))]
            body = f"<table><tr><td><h1>{title}</h1>" + "".join(f"<h2>{h}</h2><p>{p}</p>" for h, p in zip(heads, parts, strict=True)) + "</td></tr></table>"
            blocks = [title, *(x for pair in zip(heads, parts, strict=True) for x in pair)]
        else:
            body = f"<section><h1>{title}</h1><ol>" + "".join(f"<li>{p}</li>" for p in parts) + "</ol></section><div class='sidebar'><p>Read on</p></div>"
            blocks = [title, *parts]
        rows.append((k, "http://plain.test/x", f"<html><head><title>{title}</title></head><body>{menu}{body}{foot}</body></html>"))
        want[k] = "\n\n".join(blocks)
    got = extract(spark, rows)
    wrong = [k for k in want if got[k][0] != want[k]]
    assert not wrong, (wrong, got[wrong[0]][0][:300], want[wrong[0]][:300])


def test_deep_and_long_pages(spark):
    deep = "<body>" + "<div>" * 5_000 + "<p>bottom words</p>" + "</div>" * 5_000 + "<p>after all</p></body>"
    long = "<body><div>" + "".join(f"<h{k % 5 + 1}>t{k}</h{k % 5 + 1}><p>words {k}</p>" + ("<pre>c</pre>" if k % 7 == 0 else "") for k in range(2_000)) + "</div></body>"
    start = time.process_time()
    forms = [form_of(long), form_of(long.replace("<pre>", "<ul><li>").replace("</pre>", "</li></ul>"))]
    html_wrapper.merge(*forms)
    assert time.process_time() - start < 20
    got = extract(spark, [(1, "http://deep.test", deep), (2, "http://deep.test", deep.replace("bottom", "other")), (None, "http://deep.test", "<p>x</p>"), (3, "http://long.test", long)])
    assert "bottom words" in got[1][0] and "after all" in got[1][0] and "words 1999" in got[3][0] and got[None][0] == "x"


def test_each_page_of_the_table_gives_its_article(spark):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    got = html_wrapper.extract_text(pages).collect()
    assert len(got) == pages.count() and sum(r["n_chars"] > 0 for r in got) >= 0.9 * len(got)
    assert all("<" not in r["text"] or "&lt;" in "".join(p["html"] for p in pages.where(pages.page_id == r["page_id"]).collect()) for r in got[:20])


def plain(k):
    return f"<html><body><div class='text'><p>Long body of page {k} in plain blocks, with more words than any card has.</p></div></body></html>"


def tagged(k):
    return f"<html><body><article><h1>Head {k}</h1><p>Tagged body {k} of some length</p></article><div><p>Odd {k}</p></div></body></html>"


def test_templates_of_one_host_are_judged_apart(spark):
    for url in ("http://two.test/x", None, "no url"):
        got = extract(spark, [(k, url, plain(k) if k % 2 else tagged(k)) for k in range(8)])
        for k in range(8):
            assert got[k][0] == (f"Long body of page {k} in plain blocks, with more words than any card has." if k % 2 else f"Head {k}\n\nTagged body {k} of some length")


def test_article_tags_of_teasers_do_not_hide_the_text(spark):
    cards = "".join(f"<article><p>Card {c} of {{k}}</p></article>" for c in range(4))
    got = extract(spark, [(k, "http://cards.test", plain(k).replace("</body>", cards.format(k=k) + "</body>")) for k in range(6)])
    assert all(f"Long body of page {k} in plain blocks" in got[k][0] for k in range(6))


def test_class_names_of_the_whole_page_do_not_hide_it(spark):
    def body(k):
        return f"<p>Words of {k}</p><p>More words of {k}</p>"

    rows = [(k, "http://names.test", f"<body class='single-post no-sidebar'><div class='content with-sidebar'><article class='post-{k} hentry category-news tag-politics'>{body(k)}</article></div><div class='site-footer'><p>foot {k}</p></div></body>") for k in range(4)]
    rows += [(10 + k, "http://fall.test", f"<body><div class='legal'>{body(k)}</div><div class='sidebar'><p>s{k}</p></div></body>") for k in range(4)]
    got = extract(spark, rows)
    assert all(got[k][0] == got[10 + k][0] == f"Words of {k}\n\nMore words of {k}" for k in range(4))
    for token in ("site-header", "cookie-notice", "entry-meta", "comment-list", "widget-0", "side-bar"):
        assert html_wrapper._names_outside(token)


def test_copies_of_a_page_are_no_boilerplate(spark):
    copy = "<body><div><h1>Copied head</h1><p>Copied words</p></div></body>"
    own = "<body><table><tr><td>Own layout</td></tr></table></body>"
    rows = [(k, "http://copies.test", copy) for k in range(5)] + [(10 + k, "http://mixed.test", own) for k in range(3)]
    rows += [(20 + k, "http://mixed.test", f"<body><section><p>Story {k}</p></section><div><p>All rights are with us</p></div></body>") for k in range(6)]
    got = extract(spark, rows)
    assert all(got[k][0] == "Copied head\n\nCopied words" for k in range(5))
    assert all(got[10 + k][0] == "Own layout" for k in range(3))
    assert all(got[20 + k][0] == f"Story {k}" for k in range(6))


def test_many_forms_of_a_host_are_merged_in_small_groups(spark):
    kinds = ["h2", "h3", "ul", "table", "pre", "dl", "blockquote"]
    frame = spark.createDataFrame([(k, "http://many.test", "<body>" + "".join(f"<{t}>{t} {k}</{t}>" for i, t in enumerate(kinds) if k >> i & 1) + f"<div class='post-{k}'><p>Body {k}</p></div></body>", "", "") for k in range(128)], KIND)
    wrapper = html_wrapper.infer_wrappers(frame).collect()
    assert [(r["host"], r["pages"], r["forms"]) for r in wrapper] == [("many.test", 128, 128)]
    got = {r["page_id"]: r["text"] for r in html_wrapper.extract_text(frame).collect()}
    assert all(got[k].endswith(f"Body {k}") and got[k].count("\n\n") == k.bit_count() for k in range(128))
    same = frame.where("page_id in (0)").unionByName(frame.where("page_id in (0)").selectExpr("1L AS page_id", "url", "replace(html, 'post-0', 'post-77') AS html", "text", "host"))
    assert html_wrapper.infer_wrappers(same).first()["forms"] == 1


def test_a_page_of_very_many_blocks(spark):
    """Its rows grow with its blocks, and the other pages come out."""
    blocks = [f"block {k} says something of its own" for k in range(12_000)]
    letters = "abcdefghijklmnopqrstuvwxyz"
    body = "".join(f"<p class=k{letters[k % 26]}{letters[k // 26 % 26]}{letters[k // 676 % 26]}>{b}</p>" for k, b in enumerate(blocks))
    rows = [(1, "http://a.test/long", f"<html><body><nav><p>menu</p></nav><article>{body}</article></body></html>"), (2, "http://a.test/short", page("Title", ["one", "two"])), (3, "http://b.test/", page("Other", ["three"]))]
    got = extract(spark, rows)
    assert got[1][0] == "\n\n".join(blocks) and got[2][0] == "Title\n\none\n\ntwo" and got[3][0] == "Other\n\nthree"


def test_headings_and_paragraphs_of_an_article_that_link_stay(spark):
    def linked(k):
        return f"<html><body><nav><a href=/>home</a></nav><article><h2><a href=/{k}>Heading {k}</a></h2><p>Words of page {k} that say something.</p><p><a href=/s>Source of page {k}</a></p><ul><li><a href=/x>more</a></li></ul></article></body></html>"

    got = extract(spark, [(k, f"http://a.test/{k}", linked(k)) for k in range(6)])
    for k in range(6):
        assert got[k][0] == f"Heading {k}\n\nWords of page {k} that say something.\n\nSource of page {k}"
