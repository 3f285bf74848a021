import random

import pytest

from webloom.operators import html_markdown as H
from webloom.operators.html_markdown import to_markdown

LONG = "A paragraph of the story, with a clause, and another one, that goes on for long enough to count as text."


def page(*parts):
    return "<html><body>" + "".join(parts) + "</body></html>"


def test_tables():
    html = "<table><caption>c</caption><tr><th>h1</th><th>h|2</th></tr><tr><td>a <b>b</b></td><td><p>x\n y</p></td><td>more</td></tr><tr><td colspan=2>wide</td></tr></table>"
    assert "| h1 | h\\|2 |  |\n| --- | --- | --- |\n| a **b** | x y | more |\n| wide |  |  |" in to_markdown(page("<p>", LONG, "</p>", html), raw=True)
    unclosed = "<table><tr><td>1<td>2<tr><td>3<td>4</table><p>after"
    assert to_markdown(unclosed, raw=True) == "| 1 | 2 |\n| --- | --- |\n| 3 | 4 |\n\nafter\n"
    layout = "<table><tr><td><h2>Head</h2><p>text</p></td><td><ul><li>x</li></ul></td></tr></table>"
    assert to_markdown(layout, raw=True) == "## Head\n\ntext\n\n* x\n"
    assert to_markdown("<table><tr><td>only</td></tr></table>", raw=True) == "only\n"
    assert to_markdown("<table><tr><td colspan=999999999>a</td><td>b</td></tr></table>", raw=True).startswith("| a | b |")


def test_nested_lists():
    html = "<ul><li>x<ul><li>y1</li><li>y2<ol><li>z1<li>z2</ol></li><li>y3</li></ul></li><li>w</li></ul>"
    assert to_markdown(html, raw=True) == "* x\n  * y1\n  * y2\n    1. z1\n    2. z2\n  * y3\n* w\n"
    assert to_markdown("<ul><li>a<li>b<ul><li>c<li>d</ul><li>e</ul>", raw=True) == "* a\n* b\n  * c\n  * d\n* e\n"
    assert to_markdown("<ol>\n<li><p>one</p><p>more</p></li>\n<li>two</li></ol>", raw=True) == "1. one\n  more\n2. two\n"
    assert to_markdown("<dl><dt>t<dd>d<dt>u<dd>e</dl>", raw=True) == "t\n\nd\n\nu\n\ne\n"


def test_main_content():
    menu = "<div>" + "".join(f"<p><a href=/{i}>a link, with a rather long text number {i}, and so on</a></p>" for i in range(9)) + "</div>"
    story = f"<div><p>{LONG}</p><p>{LONG} Two.</p></div>"
    got = to_markdown(page("<h1>Title</h1>", "<nav><p>", LONG, "</p></nav>", menu, story, "<p>A short end.</p>", "<p><a href=/x>more</a></p>"))
    assert got == f"# Title\n\n{LONG}\n\n{LONG} Two.\n\nA short end.\n"
    # an article around the best part is taken as a whole
    got = to_markdown(page("<article><h1>T</h1><div>", f"<p>{LONG}</p>" * 3, "</div><div><h2>End</h2><p>Short close.</p></div></article>", f"<div><p>{LONG}</p></div>"))
    assert got.startswith("# T\n") and got.endswith("## End\n\nShort close.\n") and got.count(LONG) == 3
    # parts that score like it belong to it
    got = to_markdown(page(*[f"<section><p>{LONG} {i}</p><p>{LONG}</p><p>{LONG}</p></section>" for i in range(3)]))
    assert [got.count(f"{LONG} {i}") for i in range(3)] == [1, 1, 1]
    assert to_markdown(page("<p>tiny</p>")) == "tiny\n" and to_markdown("") == "" and to_markdown(None) == ""


def brute(root):
    """Each element's score straight from its definition."""

    def text(e, linked=False):
        inside = []
        for c in e.inside:
            if isinstance(c, str):
                inside.append(len(" ".join(c.split())) if linked or not only[0] else 0)
            elif c.tag not in H.SKIPPED | H.BOILERPLATE:
                inside.append(text(c, linked or c.tag == "a"))
        return sum(inside)

    only = [False]

    def size(e):
        if e.tag in H.SKIPPED | H.BOILERPLATE:
            return 0, 0
        only[0] = False
        chars = text(e)
        only[0] = True
        return chars, text(e, e.tag == "a")

    found = {}
    every = list(H._all(root))
    for target in every:
        total = 0
        for e in every:
            up, above = [], e.parent
            while above is not None:
                up.append(above)
                above = above.parent
            if e.tag in ("p", "pre", "td", "blockquote") and size(e)[0] >= 25 and target in up[:3]:
                total += (1 + e.text().count(",") + min(size(e)[0] // 100, 3)) / (1, 2, 6)[up.index(target)]
        chars, linked = size(target)
        if total and chars:
            found[target] = total * (1 - linked / chars)
    return found


@pytest.mark.parametrize("seed", range(12))
def test_scores_equal_brute_force(seed):
    rng = random.Random(seed)

    def make(depth):
        tag = rng.choice(["div", "p", "td", "a", "span", "nav", "section", "pre", "script", "b"])
        inside = "".join(make(depth - 1) for _ in range(rng.randint(0, 3))) if depth else ""
        return f"<{tag}>{rng.choice(['', 'word, ', LONG, 'x ' * 40])}{inside}{rng.choice(['', ' tail, of text'])}</{tag}>"

    builder = H._Builder()
    builder.feed(page(*[make(4) for _ in range(4)]))
    builder.close()
    got = H.scores(builder.root, H.measured(builder.root))
    want = brute(builder.root)
    assert got.keys() == want.keys() and all(abs(got[e] - want[e]) < 1e-9 for e in want)


def test_deep_and_broken_pages():
    assert "x" in to_markdown("<div>" * 3000 + "x", raw=True)
    assert to_markdown("<div>" * 600 + f"<p>{LONG}</p>").strip() == LONG
    assert to_markdown("</li></ul><td>a</tr></table><p>" + LONG).strip().endswith(LONG)
