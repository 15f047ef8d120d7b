import pytest

from seqloom.llm.html import PUNCTUATION, SHARE, blocks, content_paths, extract, main_text

P1 = "The first paragraph of the article, which is long enough to count; it has commas, and stops."
P2 = "A second one follows, with &amp; some <b>bold</b>&nbsp;text, links to <a href='/x'>one page</a>, and more."
P2T = "A second one follows, with & some bold text, links to one page, and more."
CHROME = "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>About us, and more</a></li></ul></nav>"


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{a:b}}</style>{head}</head><body>{body}</body></html>"


@pytest.mark.parametrize(
    "body",
    [
        f"{CHROME}<article><h1>Title</h1><p>{P1}</p><p>{P2}</p></article><footer>&copy; someone, 2020. All rights.</footer>",
        f"<header><h2>Site, the name of it.</h2></header><div class='sidebar'><p>{P1} {P1}</p></div><article><h1>Title</h1><p>{P1}<p>{P2}</article>",
        f"{CHROME}<main><h1>Title</h1><p>{P1}</p><form><p>Your name, please.</p></form><p>{P2}</p></main>",
        f"{CHROME}<div id=content><h1>Title</h1><div><p>{P1}</p><p>{P2}</p></div><div class='comments'><p>I liked this, a lot, really. {P1}</p></div></div>",
        f"<div class='cookie-notice'>We use cookies, you see. Many of them, in fact.</div><article><h1>Title</h1><!-- c > --><p>{P1}</p><script>var t='</p><p>x';</script><p>{P2}</p></article><div class='ad'>Buy, now. Cheap!</div>",
        f"<article><h1>Title</h1><p>{P1}</p><p>{P2}</p></article><article class='comment'><p>Reader says: {P1}</p></article>",
        f"<article><h1>Title</h1><p>{P1}</p><p>{P2}</p><aside>Related, things.</aside></article>",
    ],
)
def test_article_only(body):
    assert main_text(page(body)) == f"Title {P1} {P2T}"


def test_short_paragraphs_and_lists_stay():
    assert main_text(page(f"<article><p>{P1}</p><p>And.</p><ul><li>one<li>two, three</ul><p>{P2}</p></article>")) == f"{P1} And. one two, three {P2T}"


@pytest.mark.parametrize("text", [None, "", "   ", "<html></html>", "<script>x</script>", "<!-- only -->", "<nav>menu</nav>", "<p", "<"])
def test_no_text(text):
    assert main_text(text) in ("", "<p", "<")


def test_long_and_unclosed():
    assert main_text("<p>" + "word, " * 200000).count("word") == 200000
    assert main_text("<div>" * 3000 + P1) == P1
    assert main_text(f"<article><p title=\"a>b\">{P1}</p>") == P1
    assert main_text(f"<style>x{'<p>y</p>' * 10}") == ""


def test_table(spark):
    d = spark.createDataFrame([(1, "u", page(f"<p>{P1}</p>"), "x"), (1, "u", page(f"<p>{P1}</p>"), "x"), (None, None, None, None)], "page_id long, url string, html string, text string")
    rows = sorted((r.page_id or 0, r.text, r.n_chars) for r in extract(d).collect())
    assert rows == [(0, "", 0), (1, P1, len(P1)), (1, P1, len(P1))]
    assert extract(d.limit(0)).collect() == []


def test_nothing_else_is_dropped():
    """Cases in which names and attributes look like those of what isn't the article."""
    art = lambda x: page(f"{CHROME}<article><h1>Title</h1><p>{P1}</p>{x}<p>{P2}</p></article>")
    for inner, text in [
        ("<p title='a hidden gem'>Seen.</p>", "Seen."),
        ("<p class=search>Found, here.</p>", "Found, here."),
        ("<p class='tags-intro'>Of tags.</p>", "Of tags."),
        ("<ul><li><a href=/x>One link</a></li><li>text</li></ul>", "One link text"),
        ("<ul><li><a href=/x>One link</a></li></ul>", "One link"),
        ("<p>Sum: <math><mi>a</mi><mo>+</mo><mi>b</mi></math></p>", None),
        ("<script src=/a/>var x = 'not text';</script>", ""),
        ("<SCRIPT SRC=/a/>var x = 'not text';</SCRIPT >", ""),
        ("<p hidden>Not seen.</p><p style='display: none'>Nor this.</p>", ""),
    ]:
        got = main_text(art(inner))
        if text is None:
            assert "Sum:" in got and "b" in got.split("Sum:")[1]
        else:
            assert got == " ".join(x for x in ("Title", P1, text, P2T) if x), inner


@pytest.mark.parametrize("name", ["layout has-sidebar", "content with-sidebar", "site no-sidebar", "search-result-page", "page with-comments"])
def test_wrappers_are_not_dropped_for_their_names(name):
    assert main_text(page(f"{CHROME}<div class='{name}'><h1>Title</h1><p>{P1}</p><p>{P2}</p></div>")) == f"Title {P1} {P2T}"
    assert main_text(page(f"{CHROME}<div class='sidebar'><article><h1>Title</h1><p>{P1}</p><p>{P2}</p></article></div>")) == f"Title {P1} {P2T}"


def test_comments_without_a_name():
    body = f"{CHROME}<div class=post><h1>Title</h1><p>{P1}</p><p>{P2}</p><p>{P1}</p></div><div><p>I liked this, really.</p><p>So did I.</p></div>"
    assert main_text(page(body)) == f"Title {P1} {P2T} {P1}"


def test_ratios_by_hand():
    """Path ratios computed anew, plainly."""
    body = f"<div id=a><h1>Title, of it</h1><p>{P1}</p><p>Short.</p><p>{P2}</p><ul><li><a href=/x>link</a><li><a href=/y>two, links</a></ul></div><div><p>Else.</p></div>"
    found = [b for b in blocks(page(body)) if not b.unwanted]
    value = {}
    for path in {b.path for b in found}:
        own = [b for b in found if b.path == path]
        length = sum(len(b.text) for b in own) / len(own)
        stops = sum(len(PUNCTUATION.findall(b.text)) for b in own) / len(own)
        free = 1 - sum(b.linked for b in own) / sum(len(b.text) for b in own)
        fused = []
        for i, b in enumerate(found):
            if b.path == path:
                ratio = lambda j: sum(len(x.text) for x in found if x.path == found[j].path) / sum(x.path == found[j].path for x in found)  # noqa: B023, E731
                smooth = (ratio(max(0, i - 1)) + 2 * ratio(i) + ratio(min(len(found) - 1, i + 1))) / 4
                fused.append(min(smooth, 2 * length) * (1 + stops) * free**2)
        value[path] = sum(fused) / len(fused)
    top = max(value.values())
    assert content_paths(found) == {p for p, v in value.items() if v > 0 and v >= SHARE * top}
    assert any(p.endswith("/p") for p in content_paths(found)) and not any(p.endswith("li") for p in content_paths(found))
