"""Main text of plain pages without marks or classes, and time on hostile ones."""

import time

import pytest

from quire.llm.html_text import lines_of, main_text

BODY = [f"Sentence number {i} of an article that goes on for some time and says things." for i in range(12)]
TEXT = "".join(f"<p>{x}</p>" for x in BODY)
ALL = " ".join(BODY)


def links(n, tag="div", label="Category"):
    return "".join(f"<{tag}><a href='/{i}'>{label} {i}</a></{tag}>" for i in range(n))


@pytest.mark.parametrize("page, text", [
    # Unclassed footer links, category menus, link lists between parts and inside a marked article.
    (f"<body>{TEXT}<div><a href=t>Terms</a></div><div><a href=s>Sitemap</a></div><div><a href=c>Contact</a></div></body>", ALL),
    (f"<body>{links(20)}{TEXT}</body>", ALL),
    (f"<body><div>Home</div><div>News</div><div>Sport</div><div>Money</div><div>Weather</div>{TEXT}</body>", ALL),
    (f"<body>{TEXT}<ul>{links(30, 'li', 'Read also')}</ul>{TEXT}</body>", f"{ALL} {ALL}"),
    (f"<main>{TEXT}{links(8)}{TEXT}</main>", f"{ALL} {ALL}"),
    # Short leads, bylines and closing lines stay, whatever furniture lies between.
    (f"<p>Short lead.</p><ul class=share><li>Like</li><li>Send</li><li>Print</li></ul>{TEXT}", f"Short lead. {ALL}"),
    (f"{TEXT}<ul class=share><li>Like</li><li>Send</li><li>Print</li></ul><p>The end.</p>", f"{ALL} The end."),
    (f"{links(5)}<h1>Title</h1><div>By A. Writer</div><div>1 May</div>{TEXT}", f"Title By A. Writer 1 May {ALL}"),
    # Short items between two parts are text unless they are links.
    (f"{TEXT}<ul><li>One</li><li>Two</li><li>Three</li><li>Four</li></ul>{TEXT}", f"{ALL} One Two Three Four {ALL}"),
    # A linked word or a single linked line does not make a list.
    (f"{TEXT}<p>See <a href=x>this</a> too.</p><p><a href=y>A linked line</a></p>{TEXT}", f"{ALL} See this too. A linked line {ALL}"),
    ("<article><p><a href=x>Only a link</a></p></article>", "Only a link"),
])
def test_plain_pages(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("page", [
    "<b>" * 40_000 + "<p>x</p>" * 40_000,
    "<div><b><i>" * 60_000 + "<p>text</p>",
    "<p>" * 200_000,
    "<li><a href='x'>y" * 40_000,
    "</p></b></div>" * 40_000,
    '<a href="' * 100_001,
    "<a '" * 200_001,
    "<" * 700_000,
    "<!--" * 150_000,
    "&amp" * 150_000,
    "<p>" + "word " * 150_000,
    "<h2>t</h2><section>" * 30_000,
])
def test_time_is_linear(page):
    began = time.monotonic()
    main_text(page)
    assert time.monotonic() - began < 8


def test_counters_equal_a_search():
    """Furniture, headings and links by the counters are those of the elements around a line."""
    lines = lines_of("<h2>a<b>b</b></h2><nav><p>c<h3>d</h3></nav><p>e<a>f<i>g</i></a><h3><a>h</a></h3><form><article>i</article></form>"
                     "<div class=ad><article>j</article></div>")
    told = {line.text: (line.heading, line.furniture, line.article, line.links) for line in lines}
    assert told == {"ab": (True, False, False, 0), "c": (False, True, False, 0), "d": (True, True, False, 0),
                    "efg": (False, False, False, 2), "h": (True, False, False, 1), "i": (False, True, False, 0),
                    "j": (False, False, True, 0)}
