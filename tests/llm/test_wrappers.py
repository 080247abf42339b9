import random

import pytest
from fixtures import words

from plumbline.llm import wrappers as w

SCHEMA = "page_id long, url string, html string, host string, wrapper string, n int"


@pytest.mark.parametrize(
    "html, want",
    [
        (None, ""), ("", ""), ("just text &lt; x", "just text < x"), ("<p>a<p>b<br>c<!-- x", "a\n\nb c"), ("<ul><li>one<li>two</ul>", "one\n\ntwo"),
        ("<article><p>a&nbsp;&amp;amp; \n b</p><script>var t='</p>x'</script><style>p{}</style></article><footer>f</footer>", "a &amp; b"),
        ("<nav>menu</nav><main><h1>T</h1>text <b>bold</b><i>er</i></main><aside>s</aside>", "T\n\ntext bolder"),
        ("<article><header><h1>T</h1><p>by me</p></header><p>x</p><form><p>mail</p></form><div class='ad'>buy</div><div id=comments><p>nice</p></div></article>", "T\n\nx"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n\n2\n\n3"), ("<body class=has-sidebar><div class=sidebar>s</div><p>long text of the page</p></body>", "long text of the page"),
        ("<div>" * 5000 + "deep" + "</div>" * 5000, "deep"), ("<p>a</div></p>b</p>", "a\n\nb"), ("<p title='a>b'>x</p>", "x"), ("a < b and c > d", "a < b and c > d"),
    ],
)
def test_single_pages(html, want):
    assert w.extract(html) == want


def page(rng, i, paragraphs, comments=True):
    body = [words(rng, rng.randint(8, 30)) for _ in range(paragraphs)]
    promo = f"<div class=x{i}><p>{words(rng, 5)}</p></div>" if i % 2 else ""
    replies = "".join(f"<div class=comment><p>{words(rng, 10)}</p></div>" for _ in range(rng.randint(0, 3))) if comments else ""
    html = (
        f"<html><body><div class=top><a href=/>Home</a> <a href=/x>{words(rng, 2)}</a></div><div class=wrap><div class=post><h2>Title {i}</h2><p class=note>Read this in our app today.</p>"
        + "".join(f"<p>{p}</p>" for p in body)
        + f"<h3>More</h3><p>{words(rng, 9)} end{i}</p></div>{promo}<div id=comments>{replies}</div></div><footer>{words(rng, 6)}</footer></body></html>"
    )
    return html, body


def test_wrapper_of_a_host():
    rng = random.Random(0)
    pages = [page(rng, i, rng.randint(1, 6)) for i in range(8)]
    wrapper = w.infer([h for h, _ in pages])
    for html, body in pages + [page(rng, 50, 9)]:
        got = w.extract(html, wrapper).split("\n\n")
        assert got[0].startswith("Title") and got[1 : 1 + len(body)] == body  # the note stands unchanged in all pages
        assert got[1 + len(body)] == "More" or len(got) == 2 + len(body)
        assert not any("Home" in x for x in got)


def test_expression_has_repeats_and_options():
    pages = ["<div><p>a</p><p>b</p><hr></div>", "<div><p>c</p></div>", "<div><p>d</p><ul><li>x</ul></div>", "<dl><dt>a<dd>b<dt>c<dd>d</dl>"]
    root = w.infer(pages)
    div = next(s for g in root.groups for s in g.slots if s.key == "div")
    assert [(g.keys, g.repeated, g.optional) for g in div.groups] == [(("p",), True, False), (("ul",), False, True)]
    dl = next(s for g in root.groups for s in g.slots if s.key == "dl")
    assert [(g.keys, g.repeated) for g in dl.groups] == [(("dt", "dd"), True)]


def test_copies_are_not_template_text():
    rng = random.Random(1)
    html, body = page(rng, 1, 3)
    wrapper = w.infer([html] * 12)
    assert all(p in w.extract(html, wrapper) for p in body)


def test_awkward_rows(spark):
    rng = random.Random(2)
    rows = [(i, f"http://h{i % 3}.example/{i}", page(rng, i, 4)[0], "x", "y", 1) for i in range(40)]
    rows += [(100, None, "<p>no url</p>", "", "", 0), (101, "::bad url", "<p>bad</p>", "", "", 0), (102, "http://h0.example/e", None, "", "", 0), (103, "http://h0.example/f", "", "", "", 0), (None, "http://h1.example", "<p>x</p>", "", "", 0)]
    rows += [rows[0], (104, "http://h9.example/", "<article>" + "<p>long words here</p>" * 20_000 + "</article>", "", "", 0)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    found = w.main_text(table).collect()
    assert len(found) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in found)
    by_id = {r["page_id"]: r for r in found}
    assert by_id[100]["text"] == "no url" and by_id[101]["text"] == "bad" and by_id[102]["text"] == by_id[103]["text"] == ""
    assert by_id[104]["text"].count("long words here") == 20_000 and by_id[None]["text"] == "x"
    assert sum(r["page_id"] == 0 for r in found) == 2
    assert w.main_text(table.limit(0)).count() == 0


def test_every_page_of_a_host_counts(spark):
    """A rare layout, which also has the element that is the article elsewhere, and a notice of its own."""
    rng = random.Random(3)
    shell = "<html><body><div class=top><p>{}</p></div>{}</body></html>"
    usual = [shell.format(words(rng, 3), f"<div class=post><p>{words(rng, 60)}</p><p>{words(rng, 60)}</p></div>") for _ in range(120)]
    stories = [[words(rng, 40) + f" s{i}" for _ in range(3)] for i in range(5)]
    rare = [shell.format(words(rng, 3), f"<div class=post><p>short {i}</p></div><div class=story><p class=note>Read this in our app today.</p>" + "".join(f"<p>{t}</p>" for t in s) + "</div>") for i, s in enumerate(stories)]
    rows = [(i, f"http://big.example/{i}", h, "", "", 0) for i, h in enumerate(usual + rare)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for part in (200, 3):
        found = {r["page_id"]: r["text"].split("\n\n") for r in w.main_text(table, part).collect()}
        assert len(found) == 125 and all(len(found[i]) == 2 for i in range(120))
        assert [found[120 + i] for i in range(5)] == stories


def test_merged_parts_hold_all_pages():
    rng = random.Random(4)
    pages = [page(rng, i, rng.randint(1, 6))[0] for i in range(30)]
    whole, first, second = w.infer(pages), w.infer(pages[:15]), w.infer(pages[15:])
    w.merge(first, second)
    assert w._weight(first) == w._weight(whole)
    assert sorted(n for _, n in w._fixed(first)) == sorted(n for _, n in w._fixed(whole))


BODY = [f"Sentence number {i} of a body that goes on for quite a while here." for i in range(9)]


def _framed(frame, i):
    lead, end = f"A lead of page {i} in a line.", f"The end of page {i} in a line."
    body = [f"{x} ({i})" for x in BODY]
    html = frame.format(i=i, lead=lead, end=end, body="".join(f"<p>{x}</p>" for x in body))
    return f"<html><body><div class=top><a href=/>Home</a></div>{html}<footer>foot {i}</footer></body></html>", [f"Title {i}", lead, *body, end]


@pytest.mark.parametrize(
    "frame",
    [
        "<div id=content><h1>Title {i}</h1><p>{lead}</p><div class=body>{body}</div><p>{end}</p></div>",
        "<div class=elementor-widget-container><h1>Title {i}</h1><p>{lead}</p><div>{body}</div><p>{end}</p></div><div class=widget><p>Buy this thing now {i}</p></div>",
        "<div class='content-with-sidebar'><h1>Title {i}</h1><p>{lead}</p>{body}<p>{end}</p></div><div class=sidebar><p>short {i}</p></div>",
        "<article><h1>Title {i}</h1><p>{lead}</p>{body}<p>{end}</p><div class=related-posts><p>Read more of this {i}</p></div></article>",
    ],
)
def test_no_part_of_the_article_is_lost(frame):
    """Siblings of a body, and articles in frames whose names have a word of what is no article: alone and on a host."""
    pages = [_framed(frame, i) for i in range(6)]
    wrapper = w.infer([h for h, _ in pages])
    for html, want in pages:
        assert w.extract(html).split("\n\n") == want
        assert w.extract(html, wrapper).split("\n\n") == want


def test_what_an_article_shares_with_others_stays(spark):
    rng = random.Random(6)
    html = "<html><body><div class=top><p>Read our paper today.</p></div><article><h1>T{}</h1><p>{}</p><h2>Conclusion</h2><p>Thanks for reading.</p></article></body></html>"
    rows = [(i, f"http://one.example/{i}", html.format(i, words(rng, 30)), "", "", 0) for i in range(12)]
    for r in w.main_text(spark.createDataFrame(rows, SCHEMA)).collect():
        blocks = r["text"].split("\n\n")
        assert len(blocks) == 4 and blocks[2:] == ["Conclusion", "Thanks for reading."]
