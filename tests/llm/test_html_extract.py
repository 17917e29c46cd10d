import html
import random
import re

import pytest

from corvid.llm import html_extract
from corvid.llm.html_extract import Page, extract_text, templates, text_report

WORDS = "word été naïve & <b> x語 100% don't a".split()


def sentence(rng, n=8):
    return " ".join(rng.choices(WORDS, k=n)) + f" {rng.randrange(10**9)}."


def page(rng, article, template, broken):
    """A page around the blocks of an article; what it should give is the blocks."""
    esc = lambda s: html.escape(s)
    body = "".join(f"<{tag}{' id=x' if tag == 'p' else ''}>{esc(t)}{'' if broken and tag in ('p', 'li') else f'</{tag}>'}" for tag, t in article)
    menu = "".join(f"<li><a href='/{rng.randrange(99)}'>{sentence(rng, 1)}</a></li>" for _ in range(4))
    parts = [
        "<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var s='</p><article>';</script></head><body>",
        f"<header><h1>{sentence(rng, 2)}</h1></header><nav><ul>{menu}</ul></nav>",
        f"<div class='cookie-notice'>{sentence(rng)}</div><!-- <article>no</article> -->",
        f"<aside><p>{sentence(rng)}</p></aside><form><input value='a>b'><button>Go</button>{sentence(rng)}</form>",
        f"<article>{body}<div>{esc(template)}</div><div class='ad'><p>{sentence(rng)}</div></article>",
        f"<section id=comments><article class='comment'><p>{sentence(rng)}</p></article></section>",
        f"<div role='complementary'>{sentence(rng)}</div><footer>&copy; {sentence(rng)}</footer>",
        "" if broken else "</body></html>",
    ]
    return "".join(parts)


def site(rng, host, n):
    out = []
    shared = ("p", "A passage that all articles of the host share, which is no template.")
    for k in range(n):
        article = [("h1", sentence(rng, 3)), *[(rng.choice(["p", "h2", "blockquote", "li"]), sentence(rng)) for _ in range(rng.randrange(6))], shared]
        out.append((f"https://{host}/{k}", page(rng, article, f"Read more on {host} & subscribe", rng.random() < 0.3), "\n".join(" ".join(t.split()) for _, t in article)))
    return out


@pytest.mark.parametrize("broadcast_bytes", [html_extract.BROADCAST_BYTES, -1])
def test_articles_come_back_exactly(spark, monkeypatch, broadcast_bytes):
    monkeypatch.setattr(html_extract, "BROADCAST_BYTES", broadcast_bytes)
    rng = random.Random(4)
    rows = site(rng, "a.example", 30) + site(rng, "b.example", 4)
    rows += [(u + "?copy", h, w) for u, h, w in rows[:1] * 9]
    pages = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(rows)], "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r for r in text_report(pages).collect()}
    assert len(got) == len(rows)
    for i, (url, _, want) in enumerate(rows):
        assert (got[i].url, got[i].text, got[i].n_chars) == (url, want, len(want))


def test_template_is_what_different_articles_share(spark):
    div = "<div>shared by {}</div>"
    rows = [("http://h/" + str(k), f"<body><div>{div.format('all')}<div><p>own {k}</p></div>{div.format('some') if k < 2 else ''}</div></body>") for k in range(5)]
    rows += [("http://copies/" + str(k), "<body><div><div><p>one article</p></div></div></body>") for k in range(5)]
    pages = spark.createDataFrame(rows, "url string, html string")
    assert [(r.host, len(r.subtrees)) for r in templates(pages).collect()] == [("h", 1)]
    got = {r.url: r.text for r in extract_text(pages).collect()}
    assert got["http://h/0"] == "own 0\nshared by some" and got["http://h/4"] == "own 4" and got["http://copies/3"] == "one article"


def test_odd_rows_and_columns(spark):
    rows = [(1, None, None, "x"), (2, "no url", "", "x"), (3, "http://h/", "  plain &amp; simple\n text &nbsp; end", "x"), (3, "http://h/", "<p>again", "x"), (None, "http://h/", "<script>only", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, Text string")
    out = extract_text(pages)
    assert out.columns == ["page_id", "url", "html", "Text", "_text"]
    assert sorted((r._text for r in out.collect())) == ["", "", "", "again", "plain & simple text end"]
    assert text_report(pages.limit(0)).collect() == []
    assert sorted(r.n_chars for r in text_report(pages).collect()) == [0, 0, 0, 5, 23]


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<p>a<b>b<p>c</b>d<br>e", "ab\ncd e"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a\nb\nc\nd"),
        ("<table><tr><td>1<td>2<tr><th>3</table>", "1 2\n3"),
        ("<table><tr><td>x</div>y</td></tr></table>z", "x y\nz".replace(" ", "")),
        ("a<title>no</title><textarea><p>no</p></textarea>b", "ab"),
        ("<div class='no-sidebar has-ads'><article>kept<nav>no</nav></article></div>tail", "kept"),
        ("<form><main><p>in main</p><div class='share'>no</div></main></form>", "in main"),
        ("<article><header><h1>t</h1></header>x<footer>no</footer><article class=comment>no</article></article>", "t\nx"),
        ("<article>one</article><article>two</article><aside><article>no</article></aside>", "one\ntwo"),
        ("<p title='a > b'>x</p><p hidden>no</p><div style='display: none'>no</div>&lt;i&gt; &#x41;&copy &bogus;", "x\n<i> A© &bogus;"),
        ("a < b and c <d", "a < b and c"),
        ("<head><title>t</title>text", "text"),
        ("<article></article><p>fallback", "fallback"),
        ("<svg/><p>x<svg><path d=''/></svg>y", "xy"),
        ("<p>a&amp", "a&"),
    ],
)
def test_markup(source, want):
    assert Page(source).text() == want


def test_long_and_deep_pages():
    text = "w " * 200_000
    assert Page(f"<article>{'<div>' * 3000}{text}{'</div>' * 3000}</article>").text() == text.strip()
    assert re.fullmatch(r"(x\n)*x", Page("<p>x" * 20_000).text())
