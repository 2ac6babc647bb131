"""HTML extraction: block rules, host consensus, awkward pages."""

from __future__ import annotations

import html
import random
import re
import time

import pytest

from vaultline.llm import html_extract

from ..conftest import SF_SMALL

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>";</script></head><body><header><h1>Site</h1></header>
<nav><a href=/>Home</a></nav><div id=content class="post p12"><h1>Title</h1><p>One, two &amp three&nbsp;four<br>five <b>bold<p>Second
 para</p><ul><li>i1<li>i2</ul><div class="comments"><p>reader comment {0}</p></div><div class="adBox">buy {0}</div></div>
<aside>side {0}</aside><form><p>name</p></form><!-- <p>no --><footer>&copy; x</footer></body></html>""".format("long " * 40)


def test_blocks_and_boilerplate():
    assert html_extract.extract(PAGE, None) == "Title\n\nOne, two & three four five bold\n\nSecond para\n\ni1\n\ni2"
    assert html_extract.vote(PAGE)[0] == "html>body>div.p#.post"


def test_article_header_keeps_its_heading():
    page = "<body><article><header><h1>T</h1><span>by X</span></header><section><p>a b c</p></section><section><p>d</p></section></article>"
    assert html_extract.extract(page, None) == "T\n\na b c\n\nd"


def test_broken_pages():
    for page in ("", "<", "<p", "<!--", "<script>x", "</p></div>", "<a title=\"x", "<" * 50, "<div>" * 3000 + "deep"):
        html_extract.extract(page, [("html>body", 3.0)])
    assert html_extract.extract("<article><p>one<p>two &am", None) == "one\n\ntwo &am"
    assert html_extract.extract("<div>" * 3000 + "deep", None) == "deep"


def test_host_consensus_outvotes_one_page(spark):
    good = "<body><div class=main><p>{}</p></div><div class=extra><p>x</p></div>"
    odd = "<body><div class=main><p>short text</p></div><div class=extra><p>" + "much longer extra text " * 9 + "</p></div>"
    rows = [(i, "http://H.example:80/x", good.format("article text " * 20)) for i in range(20)]
    rows += [(20, "https://u@h.example", odd), (21, "no host", odd), (22, None, odd), (23, "http://h.example", None), (23, "http://h.example", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.main_texts(pages).collect()}
    assert got[20] == "short text" and got[21] == got[22] == ("much longer extra text " * 9).strip() and got[23] == ""
    assert html_extract.main_texts(pages).count() == len(rows)
    assert html_extract.main_texts(pages.limit(0)).count() == 0


def test_lists_tables_and_quotes_belong_to_their_section():
    """Pages without article or main: what is longer than the paragraphs does not drive them out."""
    items = "".join(f"<li>{i} {'item text ' * 5}</li>" for i in range(10))
    rows = "".join(f"<tr><td>cell {i}<td>{'value ' * 9}<td><p>{'one ' * 9}<p>two</tr>" for i in range(10))
    long = "<p>" + "quoted words " * 30 + "</p>"
    for inner in (f"<ul>{items}</ul>", f"<ol><li><ul>{items}</ul></ol>", f"<table><tbody>{rows}</tbody></table>",
                  f"<table><tr><td><ul>{items}</ul></td></tr></table>", f"<blockquote><div>{long}{long}</div></blockquote>",
                  f"<figure><div>{long}</div><figcaption>caption</figcaption></figure>", f"<dl><dt>term<dd><div>{long}{long}</div></dl>"):
        page = f"<body><div class=top><p>site</p></div><div class=post><h1>Title</h1><p>{'short ' * 16}</p>{inner}<p>The end</p></div>"
        got = html_extract.extract(page, None)
        assert html_extract.vote(page)[0] == "body>div.post"
        assert got.startswith("Title\n\nshort short") and got.endswith("\n\nThe end") and "site" not in got
        whole = html_extract.Page(inner)
        assert all(block in got for _, block, _ in whole.blocks)


def test_layout_table_cells_compete():
    page = ("<body><table><tr><td class=left><a href=/>Home</a><br>menu text</td><td class=mid><h1>Title</h1><p>{0}</p>"
            "<ul><li>{0}{0}</ul><p>end</p></td></tr></table>").format("main words " * 20)
    assert html_extract.vote(page)[0] == "body>table>td.mid"
    got = html_extract.extract(page, None)
    assert got.startswith("Title") and got.endswith("end") and "menu" not in got


def test_host_of_list_pages_keeps_paragraphs(spark):
    page = "<body><div class=post><h1>T{0}</h1><p>intro {0}</p><ul>" + "<li>item of the list" * 30 + "</ul><p>end</p></div>"
    pages = spark.createDataFrame([(i, "http://l.example/", page.format(i)) for i in range(12)], "page_id long, url string, html string")
    for r in html_extract.main_texts(pages).collect():
        i = r["page_id"]
        assert r["text"].startswith(f"T{i}\n\nintro {i}\n\nitem") and r["text"].endswith("\n\nend")


@pytest.mark.parametrize("names", ["content no-sidebar", "long-form-article", "site-main comments-open", "post has-share", "single with-ads",
                                   "entry search-result", "w-form", "article-share-wide", "form", "search"])
def test_names_alone_do_not_empty_an_article(names):
    """An element whose names speak of other text stays if it holds the page's text and heading; what lies in it is judged on its own."""
    page = (f'<body><nav><a href=/>Home</a></nav><div class="{names}"><h1>Title</h1><p>{"words of text " * 12}</p><div class="share-bar"><p>Share this</p></div>'
            f'<div class="no-ads"><p>a short part</p></div><div id="comments"><p>{"a comment " * 90}</p></div><p>The end</p></div>'
            '<div class="cookie-notice"><p>We use cookies</p></div></body>')
    assert html_extract.extract(page, None) == f"Title\n\n{('words of text ' * 12).strip()}\n\na short part\n\nThe end"


def test_marked_elements_go_however_long():
    for names in ("comments", "comment-list", "related-posts", "sidebar", "cookie-notice", "newsletter-signup"):
        page = f'<body><div class=post><h1>Title</h1><p>{"text " * 20}</p></div><div class="{names}"><p>{"other " * 300}</p></div></body>'
        assert html_extract.extract(page, None) == "Title\n\n" + ("text " * 20).strip()
    whole = f'<body><form id=aspnet><div class=post><h1>Title</h1><p>{"text " * 20}</p></div><select><option>x</select></form></body>'
    assert html_extract.extract(whole, None) == "Title\n\n" + ("text " * 20).strip()


def test_second_template_of_a_host_keeps_its_text(spark):
    """5 % of a host's pages have another template; a stub lies on the main template's path."""
    main = "<body><div class=main><p>{0}</p></div></body>"
    other = "<body><div class=main><p>short stub</p></div><div class=story><h1>T</h1><p>{0}</p></div></body>"
    rows = [(i, "http://h.example/", (other if i % 20 == 0 else main).format(f"{i} " + "article text " * 40)) for i in range(500)]
    rows += [(900 + i, "http://h.example/", "<body><div class=main><p>the article</p></div><div class=x><p>" + "wrong " * 60 + "</p></div></body>") for i in range(3)]
    got = {r["page_id"]: r["text"] for r in html_extract.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(500):
        assert got[i] == ("T\n\n" if i % 20 == 0 else "") + f"{i} " + ("article text " * 40).strip()
    assert {got[900 + i] for i in range(3)} == {"the article"}


def test_hostile_pages_take_linear_time():
    for page in ("<a" * 60_000, "<div>" * 5000 + "deep", "<div><p>x</p>" * 5000, "<a \"" * 30_000, "<p class=x" * 20_000):
        at = time.time()
        html_extract.extract(page, [("div>div", 2.0)])
        html_extract.vote(page)
        assert time.time() - at < 2


def test_empty_repeated_and_clashing_rows(spark):
    schema = "page_id long, url string, html string, text string, winners string"
    assert html_extract.main_texts(spark.createDataFrame([], schema)).collect() == []
    row = (1, "http://a.example/", "<article><p>one</p></article>", "clash", "clash")
    got = html_extract.main_texts(spark.createDataFrame([row, row, (None, None, None, None, None)], schema)).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in got) == [(0, "", 0), (1, "one", 3), (1, "one", 3)]


def test_scores_and_votes_against_a_plain_scorer():
    """Section scores by climbing from every block, on random pages without article elements."""
    rnd = random.Random(6)
    for _ in range(60):
        parts = []
        for _ in range(rnd.randint(1, 25)):
            parts.append(rnd.choice(["<div>", "</div>", "<section class=a>", "</section>", "<div class=b>", "</div>", "<ul><li>i", "</ul>",
                                     f"<p>{'w' * rnd.randint(1, 30)}</p>", "<a href=x>link</a>", "<main>" if rnd.random() < 0.2 else "t "]))
        page = html_extract.Page("<body>" + "".join(parts))
        competes, want = page.competing(), [0.0] * len(page.label)
        for node, text, links in page.blocks:
            share = 1.0
            while node >= 0:
                if competes[node]:
                    want[node] += (len(text) - links) * (page.weight[node] or share)
                    share = share / 2 if share > 0.3 else 0.0
                node = page.parent[node]
        assert page.scores() == pytest.approx(want)


def test_whole_table_against_plain_article_cut(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    got = {r["page_id"]: r for r in html_extract.main_texts(pages).collect()}
    for r in pages.collect():
        body = r["html"].split("<article>", 1)[1].split("</article>", 1)[0]
        body = re.sub(r"<[a-zA-Z/]*$", "", body)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        want = "\n\n".join(b for b in blocks if b)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)
