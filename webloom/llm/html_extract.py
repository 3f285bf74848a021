"""Main-text extraction by composite text density over a lenient DOM."""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import table

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br math mi mo mn ms mtext mrow mfrac msqrt mroot msup msub msubsup munder mover munderover semantics".split())
#: Elements whose text is never part of an article.
FURNITURE = frozenset(
    "script style noscript template iframe svg annotation object embed canvas video audio head title nav aside footer form button select option textarea input menu dialog datalist fieldset noembed noframes xmp".split()
)
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar tablist".split())
#: Words of class and id attributes that mark menus, headers, footers, sidebars, notices, adverts, forms and reader comments.
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies "
    "disclaimer discussion disqus footer gdpr login menu modal nav navbar navigation navigation newsletter notice notices notification overlay pager pagination paywall "
    "popup promo promoted promotion recommended related replies reply respond share sharing shoutbox sidebar sidenav signup skyscraper social sponsor sponsored subscribe subscription talkback thread toolbar widget".split()
)
#: Of these, words that a part of an article may be named by as well: inside an article they count for no section or running text.
TOPICS = frozenset("banner disclaimer discussion login menu notice notices notification overlay promotion recommended related reply respond share sharing social subscription thread toolbar widget".split())
#: Words that say nothing of what a part is: a name of furniture words and these alone marks furniture, one with any other word
#: ("related-work", "cookie-recipes") doesn't.
NEUTRAL = frozenset(
    "area areas articles bar bars block blocks body bottom box boxes btn button buttons card cards center col column container content count email fixed float form global group head header heading "
    "holder icon icons inner item items js layer left link links list main message mobile module new outer page panel policy post posts primary region right row secondary section sections "
    "site slot small sticky stories strip tags text the title top ui unit user users view wide with wp wrap wrapper zone".split()
)
#: Words that mark reader comments or talk only as a name of their own; of running text they mark nothing.
WEAK = frozenset("discussion thread disclaimer".split())
#: Who and what a name for reader comments speaks of ("reader-opinions").
COMMENTERS = frozenset("reader readers user users visitor visitors guest guests community".split())
SAYINGS = frozenset("comment comments opinion opinions reaction reactions voices feedback response responses remarks talk says letters".split())
#: Names of blocks that lead on to other pages, if they hold little but links.
ONWARD = frozenset("more stories story read also see next previous prev latest trending popular top most news headlines links articles posts teaser teasers".split()) | NEUTRAL
#: Names of what stands before or beside the text and belongs to it.
LEADS = frozenset("lead lede intro introduction summary standfirst deck dek subtitle subheading abstract excerpt hero headline caption byline kicker".split())
#: Elements of running text: named by a furniture word only if by nothing else. Headings never are.
TEXT = frozenset("p blockquote pre figure figcaption dl dt dd".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Beginnings and ends of words that were written together.
FURNITURE_STARTS = ("sidebar", "cookie", "advert", "newsletter", "breadcrumb", "comments", "commentlist")
FURNITURE_ENDS = ("comments", "sidebar", "cookies", "advert", "newsletter", "navbar", "footer", "breadcrumbs", "popup")
CONTENT_WORDS = frozenset("article content entry main post story body".split())
SECTIONS = frozenset("article main body html".split())
#: A start tag of the key closes an open element of the value, up to the scope's edge.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"},
}
SCOPE = frozenset("table ul ol dl article main section body html td th div nav aside footer header select".split())
HEAD_ONLY = frozenset("head title meta link base style script".split())

NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
QUOTE_OR_END = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SPACE = re.compile(r"\s+")
#: A comment may also end at once ("<!-->") or with "--!>".
COMMENT_END = re.compile(r"(?<=<!--)-?>|--!?>")


class Node:
    __slots__ = ("tag", "parent", "children", "skip", "names", "chars", "links", "tags", "link_tags", "density", "total", "hit")

    def __init__(self, tag: str, parent: Node | None, skip: bool, names: frozenset = frozenset()):
        self.tag, self.parent, self.skip, self.names, self.children = tag, parent, skip, names, []  # children: nodes and pieces of text
        self.chars = self.links = self.tags = self.link_tags = 0
        self.density = self.total = 0.0


def _tag_end(page: str, at: int, missing: set) -> int:
    """Position after the '>' of the tag that is open at `at`; quoted attribute values may hold '>'."""
    while m := QUOTE_OR_END.search(page, at):
        at, c = m.end(), m[0]
        if c == ">":
            return at
        if page[: m.start()].rstrip().endswith("=") if m.start() < 64 else page[m.start() - 64 : m.start()].rstrip().endswith("="):
            close = -1 if c in missing else page.find(c, at)
            if close < 0:
                missing.add(c)
            else:
                at = close + 1
    return len(page)


def _words(name: str) -> set[str]:
    return {w.lower() for w in WORDS.findall(name)}


def _named_content(others: list[str], marking: list[str]) -> bool:
    """Whether a name beside those that mark furniture is for content, and these don't mark what never is part of it."""
    never = {"comment", "comments", "ad", "ads", "advert", "sidebar", "related"}
    return any(_words(w) & CONTENT_WORDS for w in others) and not any(_words(w) & never for w in marking)


def _named_furniture(tag: str, name: str, inside_article: bool) -> bool:
    """Whether one class or id marks furniture: by all of its words, not by one word of a compound."""
    words = _words(name)
    if words & COMMENTERS and words & SAYINGS and words <= COMMENTERS | SAYINGS | NEUTRAL:
        return True
    found = {w for w in words if w in FURNITURE_WORDS or tag not in TEXT and (w.startswith(FURNITURE_STARTS) or w.endswith(FURNITURE_ENDS))}
    if not found and not inside_article and "header" in words and words <= NEUTRAL:
        return tag not in TEXT
    if not found or not words <= found | NEUTRAL | SAYINGS | CONTENT_WORDS:
        return False
    if tag in TEXT:
        return words <= FURNITURE_WORDS and bool(words - TOPICS or not inside_article and words - WEAK)
    strong = found - TOPICS
    if tag == "section" or words <= WEAK:
        return bool(strong) or not inside_article and not words <= WEAK
    return True


def _furniture(tag: str, attributes: str, inside_article: bool) -> bool:
    if tag in FURNITURE:
        return True
    if tag == "header" and not inside_article:
        return True
    if not attributes or "=" not in attributes:
        return bool(re.search(r"\bhidden\b", attributes)) if attributes else False
    for m in ATTRIBUTE.finditer(attributes):
        name, written = m[1].lower(), m[2] or m[3] or m[4] or ""
        value = written.lower()
        if name in ("class", "id") and tag == "article" and re.search(r"(?:^|\s)(?:comment|reply)", value):
            return True
        if name in ("class", "id") and tag not in SECTIONS and tag not in HEADINGS:
            names = written.split()
            marking = [w for w in names if _named_furniture(tag, w, inside_article)]
            if marking and not _named_content([w for w in names if w not in marking], marking):
                return True
        elif name == "role" and value.strip() in FURNITURE_ROLES:
            return True
        elif name == "aria-hidden" and value.strip() == "true":
            return True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|$)", ATTRIBUTE.sub(" ", attributes)))


def parse(page: str) -> Node:
    """A lenient DOM: unclosed and stray tags are repaired, raw-text elements and comments are skipped as wholes."""
    root = Node("html", None, False)
    node, at, missing, in_article = root, 0, set(), 0
    opened: dict[str, int] = {}  # open elements by tag: a stray end tag needs no walk

    def close(last: Node) -> None:
        """Ends the open elements up to `last`."""
        nonlocal node, in_article
        while True:
            done, node = node, node.parent
            opened[done.tag] -= 1
            in_article -= done.tag in ("article", "main")
            if done is last:
                return

    while at < len(page):
        lt = page.find("<", at)
        if lt < 0:
            lt = len(page)
        if lt > at:
            node.children.append(page[at:lt])
        if lt == len(page):
            break
        if page.startswith("<!--", lt):
            end = COMMENT_END.search(page, lt + 4)
            at = len(page) if end is None else end.end()
            continue
        if page.startswith("<![CDATA[", lt):
            end = page.find("]]>", lt)
            at = len(page) if end < 0 else end + 3
            continue
        if lt + 1 < len(page) and page[lt + 1] in "!?":
            end = page.find(">", lt)
            at = len(page) if end < 0 else end + 1
            continue
        m = NAME.match(page, lt + 1)
        if not m:
            node.children.append("<")
            at = lt + 1
            continue
        tag, at = m[1].lower(), _tag_end(page, m.end(), missing)
        if page[lt + 1] == "/":
            up = node if opened.get(tag) else root
            while up is not root and up.tag != tag:
                if tag in INLINE and up.tag not in INLINE:
                    up = root  # an inline end tag doesn't close a block
                    break
                up = up.parent
            if up is not root:
                close(up)
            elif tag == "p":
                node.children.append(Node("p", node, False))
            continue
        if tag in ("html", "body"):
            if tag == "body" and node.tag in ("head", "html"):
                while node is not root and node.tag != "html":
                    close(node)
                node.children.append(body := Node("body", node, False))
                node = body
                opened["body"] = opened.get("body", 0) + 1
            continue
        if tag not in INLINE:
            if node.tag == "head" and tag not in HEAD_ONLY:
                close(node)
            ends, last = CLOSES.get(tag), None
            if opened.get("p") or ends:
                up = node
                while up is not root:
                    if up.tag == "p" or ends and up.tag in ends:
                        last = up
                        if up.tag == "p":
                            break
                    elif up.tag in SCOPE:
                        break
                    up = up.parent
            if last is not None:
                close(last)
        attributes = page[m.end() : at - 1]
        skip = node.skip or _furniture(tag, attributes, in_article > 0)
        named = {w for m_ in ATTRIBUTE.finditer(attributes) if m_[1].lower() in ("class", "id") for w in _words(m_[2] or m_[3] or m_[4] or "")} if "=" in attributes else ()
        child = Node(tag, node, skip, frozenset(named))
        node.children.append(child)
        if tag in VOID or attributes.endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            if end is None:
                at = len(page)
            else:
                if tag == "textarea" or tag == "title":
                    child.children.append(page[at : end.start()])
                at = page.find(">", end.start()) + 1 or len(page)
            continue
        in_article += tag in ("article", "main")
        opened[tag] = opened.get(tag, 0) + 1
        node = child
    return root


def _walk(root: Node) -> list[Node]:
    """All nodes, parents first."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return out


def measure(root: Node) -> list[Node]:
    """Counts characters, tags and those of links below each node, then its composite density and the sum of its blocks'."""
    nodes = _walk(root)
    for node in reversed(nodes):
        for c in node.children:
            if isinstance(c, Node):
                if not c.skip:
                    node.chars, node.links = node.chars + c.chars, node.links + c.links
                    node.tags, node.link_tags = node.tags + c.tags + 1, node.link_tags + c.link_tags + (c.tag == "a")
            else:
                node.chars += len(SPACE.sub("", c))
        if node.tag == "a":
            node.links = node.chars
    body = root
    link_rate = body.links / max(1, body.chars)
    for node in nodes:
        c, lc, t, lt = node.chars, max(1, node.links), max(1, node.tags), max(1, node.link_tags)
        if not node.skip and c:
            base = math.log(c / max(1, c - node.links) * lc + link_rate * c + math.e)
            node.density = c / t * (math.log(max(c / lc * t / lt, 1.0 + 1e-9)) / base)
    for node in nodes:
        node.total = sum(c.density for c in node.children if isinstance(c, Node) and not c.skip and c.tag not in INLINE)
    return nodes


def main_node(root: Node) -> Node | None:
    """The subtree with the largest sum of its blocks' densities, widened while siblings are as dense as the path to the body."""
    nodes = [n for n in measure(root) if not n.skip and n.chars and n.tag not in INLINE and n.tag != "html"]
    if not nodes:
        return root if root.chars else None
    best = max(nodes, key=lambda n: (n.total, n.density))
    path = [best, *(n for n in _above(best))]
    threshold = min((n.density for n in path if n.density), default=0.0)
    chosen = best
    for below, node in zip(path, path[1:], strict=False):
        others = [c for c in node.children if isinstance(c, Node) and c is not below and not c.skip and c.chars and c.tag not in INLINE]
        dense = any(c.density >= threshold and not _menu(c) for c in others)
        if dense or any(isinstance(c, str) and len(SPACE.sub("", c)) > 20 for c in node.children) or below is chosen and any(map(_belongs, others)):
            chosen = node
    # the article around it is one whole, whatever the density of its parts
    around = [n for n in (chosen, *_above(chosen)) if n.tag in ("article", "main")]
    return next((n for n in around if n.tag == "article"), around[0] if around else chosen)


def _belongs(node: Node) -> bool:
    """Whether a block beside the chosen one is part of its text though short: named as a lead, or running text of whole sentences."""
    if node.links > 0.25 * node.chars or _repeats(node):
        return False
    if node.names & LEADS:
        return True
    inner = [node, *(n for n in _walk(node) if not n.skip)]
    if not any(n.tag == "p" for n in inner) or node.tag in ("article", "main"):
        return False
    text = SPACE.sub(" ", html.unescape(" ".join(c for n in inner[1:] or inner for c in n.children if isinstance(c, str)))).strip()
    return len(text.split()) >= 5 and text[-1] in ".!?…\"”»)" and not text.lower().startswith(("©", "copyright", "(c)"))


def _repeats(node: Node) -> bool:
    """A row of like-named parts, as comments and teasers are."""
    parts = [c for c in node.children if isinstance(c, Node) and not c.skip and c.names and c.tag not in TEXT | HEADINGS | INLINE]
    return any(sum(p.tag == q.tag and p.names == q.names for q in parts) > 1 for p in parts[:3])


def _above(node: Node):
    while node.parent is not None:
        node = node.parent
        yield node


def _menu(node: Node) -> bool:
    """A block of links without text of its own."""
    return node.link_tags >= 3 and node.links > 0.8 * node.chars and node.tag not in SECTIONS


def _cut(node: Node, in_article: bool) -> bool:
    """Whether a block in the chosen part leads elsewhere: a menu, but for one in an article without a name that says so, and for a
    list of links in the middle of running text. Talk under a weak name goes if it is a row of parts."""
    if node.names and node.names <= WEAK | NEUTRAL and node.names & WEAK and (_repeats(node) or node.links > 0.5 * node.chars):
        return True
    if not _menu(node):
        return False
    if in_article:
        return bool(node.names - NEUTRAL) and node.names <= ONWARD
    if node.tag not in ("ul", "ol", "dl"):
        return True
    beside = [c for c in node.parent.children if isinstance(c, Node) and c.chars and not c.skip]
    at = beside.index(node)
    running = lambda c: c.tag == "p" and c.chars - c.links > 20
    return not (any(map(running, beside[:at])) and any(map(running, beside[at + 1 :])))


def headline(chosen: Node) -> list[Node]:
    """Headings h1 that stand before the chosen node beside it or what holds it, where it has none itself."""
    if any(n.tag == "h1" and not n.skip for n in _walk(chosen)):
        return []
    below, found = chosen, []
    for node in _above(chosen):
        before = []
        for c in node.children:
            if c is below:
                break
            if isinstance(c, Node) and c.tag not in INLINE and not c.skip and not _menu(c):
                before += [n for n in _walk(c) if n.tag == "h1" and not n.skip and n.chars]
        found, below = before + found, node
    return found


def blocks(root: Node) -> list[str]:
    """The texts of the blocks below `root` in page order: references decoded, white space turned into single spaces.

    Blocks of nothing but links are left out, except where they belong to an article (see _cut).
    """
    in_article = any(n.tag == "article" for n in (root, *_above(root)))
    out, buffer = [], []

    def flush() -> None:
        text = SPACE.sub(" ", html.unescape("".join(buffer))).strip()
        buffer.clear()
        if text:
            out.append(text)

    stack: list = [iter(root.children)]
    blocky = [True]
    while stack:
        c = next(stack[-1], None)
        if c is None:
            stack.pop()
            if blocky.pop():
                flush()
        elif isinstance(c, str):
            buffer.append(c)
        elif c.skip:
            if c.tag not in INLINE:
                flush()
        elif c.tag in ("br", "wbr", "img"):
            buffer.append("" if c.tag == "wbr" else " ")
        elif c.tag in INLINE or not _cut(c, in_article):
            block = c.tag not in INLINE
            if block:
                flush()
            stack.append(iter(c.children))
            blocky.append(block)
    return out


def extract(page: str | None) -> str:
    """The main text of a page; null or a page without text: empty."""
    if not page:
        return ""
    node = main_node(parse(page))
    return "\n\n".join([b for n in [*headline(node), node] for b in blocks(n)]) if node else ""


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars (code points of the text).

    Blocks are joined in page order by two line ends. A null, empty or textless page has an empty text; nulls in id and
    url stay; repeated rows are returned each; an empty table gives an empty result; other columns are not read. Narrow
    in and out: one pass over the input, no shuffle.
    """
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]

    def run(batches):
        for batch in batches:
            texts = [extract(x.as_py()) for x in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "url", "text", "n_chars"])

    chosen = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    out = chosen.mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})


def op1_html_extract(spark, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


SQL: dict[str, str] = {}
