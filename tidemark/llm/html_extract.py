"""Main text of web pages by a tree-structured graphical model.

The block elements of a page (and inline ones that carry a class, id or role) form a tree of
two-state nodes: content or not.  A node's potential comes from its features, an edge's from the
labels of parent and child; both are rates counted on labelled pages (LABELLED) and smoothed.
Sum-product message passing, once from the leaves up and once from the root down, gives each
node's marginal; text whose node is content with at least even odds is kept.

A block ends where a block element begins or ends; its white space becomes one space, character
references are decoded, and blocks are joined in page order by a newline.  Scripts, styles,
comments of the markup and heads are no text.  Null and empty pages give an empty text.  Repeated
rows are extracted each.  Unclosed, unopened and misnested tags are mended as browsers do for
paragraphs, list items and table cells; other end tags close the nearest open element of the name.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import over_texts

#: Element names of HTML by their role.
RAW = "script style iframe title textarea"
HIDDEN = frozenset("noscript template svg math object canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that an opening tag closes first, up to the element that bounds the search.
CLOSES = {
    **{t: ("p",) for t in BLOCK - {"button", "option", "optgroup", "html", "body", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}},
    "li": ("p", "li"), "dt": ("p", "dt", "dd"), "dd": ("p", "dt", "dd"), "option": ("option",), "tr": ("p", "td", "th", "tr"), "td": ("p", "td", "th"), "th": ("p", "td", "th"), "body": ("head",),
}
BOUNDS = frozenset("article aside body button div dl fieldset footer form header html main menu nav ol section select table td th ul".split())
#: Words of class, id and role that name what a part of a page is for.
ASIDE = frozenset(
    "ad ads adv advert advertisement adverts adbox adsense alert banner breadcrumb breadcrumbs byline-share comment comments commentlist consent contentinfo cookie cookies copyright "
    "dialog discussion disqus disclaimer footer footnav form gdpr header login masthead menu modal nav navbar navigation newsletter notice notification pager pagination paywall popup promo promoted "
    "recommended related replies reply respond search share sharing sidebar side signup skip social sponsor sponsored subscribe tags toolbar topbar widget".split()
)
MAIN = frozenset("article body content entry main maintext post prose story text".split())
TAGS = {"h1": "h", "h2": "h", "h3": "h", "h4": "h", "h5": "h", "h6": "h", "ul": "list", "ol": "list", "dl": "list", "menu": "menu", "button": "control", "select": "control", "option": "control", "optgroup": "control", "fieldset": "control", "legend": "control", "dialog": "dialog", "search": "form", "p": "p", "li": "li", "dd": "li", "dt": "li"}
KNOWN = frozenset("h list menu control dialog form p li article main nav header footer aside div section body html table td blockquote pre figure".split())

#: A value after "=" is quoted, or runs to the next blank or the tag's end, quotes inside included.
ATTRS = r"(?:=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*)|[^>=]|=)*+"


def _tokens(attrs: str) -> re.Pattern:
    return re.compile(
        rf"<!--.*?(?:-->|\Z)|<({'|'.join(RAW.split())})(?=[\s/>]){attrs}>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)({attrs})>|<[!?/][^>]*(?:>|\Z)|([^<]++|<)",
        re.DOTALL | re.IGNORECASE,
    )


#: After a tag whose attributes run to the page's end, tags end with the next ">"; after the last one there are none.
TOKEN, PLAIN, REST = _tokens(ATTRS), _tokens("[^>]*+"), re.compile(r"<!--.*?(?:-->|\Z)|<[!?/][^>]*(?:>|\Z)|([^<]++|<)", re.DOTALL)


def tokens(source: str) -> Iterator[tuple[str | None, bool, str | None, str]]:
    """(text, closing, name, attributes) of each piece of text or tag, in time linear in the page."""
    at, last, pattern = 0, source.rfind(">"), TOKEN
    while at < len(source):
        if at > last:
            yield from ((m[1], False, None, "") for m in REST.finditer(source, at))
            return
        m = pattern.match(source, at)
        at = m.end()
        yield m[5], bool(m[2]), m[3], m[4]
        if m[5] == "<" and pattern is TOKEN and source[at : at + 1].isalpha():
            pattern = PLAIN


NAMED = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
WORDS = re.compile(r"[a-z]+")

#: Features of a node: element, use by its names, place by the core of the page, links, share of the page's text.
FEATURES = 5
#: Labelled pages: data-l="1" opens a content part, data-l="0" one that is not; a part's label holds until the next one inside.
TEXT = "<p>A paragraph of running text, as pages have many of them, one after another.</p>" * 8
BARE = f'<div><p>Opening words, with <a>a link</a> in them.</p>{TEXT}<ul><li>One</li><li>Two</li></ul><h2>Part</h2>{TEXT}</div>'
LABELLED = (
    '<html data-l="1"><body><nav data-l="0"><ul><li><a>Home</a></li><li><a>News</a></li></ul></nav><div class="ad" data-l="0">Buy now and save a lot today.</div><article><h1>A title of the page</h1><p>The first paragraph of the article is of some length and holds no link at all.</p><p>Another one, with <a>one link</a> inside of its running text, goes on for a while.</p><ul><li>First point made</li><li>Second point made</li></ul><blockquote>A quotation in the article.</blockquote></article><footer data-l="0">&copy; Example Publishing</footer></body></html>',
    '<html data-l="1"><body><header data-l="0"><a>Logo</a><p>The best site there is</p></header><main><h1>Title</h1><div class="content"><p>Text of the page that runs on for a good many words, so that it counts as long.</p><pre>some code</pre><table><tr><td>cell of a table</td></tr></table></div></main><aside data-l="0"><h3>Related</h3><p>Read this other story too, it is long enough to look like text.</p></aside><footer data-l="0"><p>All rights reserved, no part of this may be copied.</p></footer></body></html>',
    '<html data-l="1"><body><div id="header" data-l="0"><h1>Site name</h1></div><div id="menu" data-l="0"><a>One</a> <a>Two</a></div><div id="content"><h2>A heading</h2><p>Long running text of the page which holds all the words that one came here to read.</p><p>Short end.</p></div><div id="sidebar" data-l="0"><p>About the author: a person who writes much and often on many things.</p></div><div id="footer" data-l="0">Imprint</div></body></html>',
    '<html data-l="1"><body><div class="cookie-notice" data-l="0"><p>We use cookies to give you the best experience on our site.</p><button>Accept</button></div><article class="post"><h1>News</h1><p>Something happened in a town last week, and people are still talking about it.</p><div class="advert" data-l="0"><p>Sponsored: the best shoes in town for half the price.</p></div><p>They say it could happen again, and nobody knows when.</p></article><section class="comments" data-l="0"><h2>Comments</h2><div class="comment"><p>I think that this is a really good article, thank you.</p></div><form><label>Name</label><p>Leave a reply here</p></form></section></body></html>',
    '<html data-l="1"><body><div><div><p>A bare page whose text has no article around it, only plain blocks.</p><p>It still has a second paragraph.</p></div></div><form data-l="0"><p>Sign up for our letter</p><select><option>Daily</option></select><button>Go</button></form></body></html>',
    '<html data-l="1"><body><div role="navigation" data-l="0"><a>Start</a></div><div role="main"><section><h2>Part</h2><p>Running text in a section of the main part of the page.</p></section><section><h2>Part two</h2><p>More of it, long enough to be counted as running text.</p><figure><figcaption>A caption</figcaption></figure></section></div><div class="newsletter signup" data-l="0"><p>Get our stories by mail each morning.</p></div><div role="contentinfo" data-l="0">Contact</div></body></html>',
    '<html data-l="1"><body><div class="wrapper"><div class="story-body"><p>Words and more words that make up the story, and then some more of them.</p><aside data-l="0"><p>Box beside the story with facts.</p></aside><p>The story goes on here.</p></div><div class="related-links" data-l="0"><ul><li><a>Other story</a></li><li><a>And another</a></li></ul></div><div class="share" data-l="0"><a>Post</a><a>Mail</a></div></div></body></html>',
    '<html data-l="1"><body><article><header data-l="0"><p>By a writer, on a Monday</p></header><p>The text itself is here and it is what counts on this page.</p><footer data-l="0"><p>Filed under: things</p></footer></article><div data-l="0"><p>Text beside the article that belongs to the frame of the page.</p></div><p data-l="0">Another stray line of the frame.</p></body></html>',
    '<html data-l="1"><body><menu data-l="0"><li>Entry</li></menu><dialog data-l="0"><p>Please confirm that you are not a robot.</p></dialog><div class="banner" data-l="0"><p>Sale ends soon, hurry up.</p></div><main><article><h1>Head</h1><p>Body of the page.</p><p>End.</p></article><div class="disqus" data-l="0"><p>Reader says no to all of this and more.</p></div></main></body></html>',
    f'<html data-l="1"><body><div id="nav" data-l="0"><a>Home</a></div>{BARE}<div class="footer" data-l="0"><p>Imprint of the site</p></div></body></html>',
    f'<html data-l="1"><body>{BARE}</body></html>',
    f'<html data-l="1"><body><div class="page">{BARE}<div class="comments" data-l="0"><p>What a page this is</p></div></div><form data-l="0"><p>Write to us</p></form></body></html>',
    f'<html data-l="1"><body><article><header data-l="0"><h2>Section of the paper</h2><p>By a writer</p></header>{TEXT}<aside data-l="0"><p>A box of facts</p></aside>{TEXT}<footer data-l="0"><p>Filed under things</p></footer></article></body></html>',
    f'<html data-l="1"><body><main><header data-l="0"><p>Our site</p></header><nav data-l="0"><ul><li>On this page</li></ul></nav>{TEXT}<section>{TEXT}<div class="ad" data-l="0"><p>Buy this thing</p></div></section><form data-l="0"><p>Search here</p></form><aside data-l="0"><p>More on it</p></aside><footer data-l="0"><p>Last changed on a Monday</p></footer></main></body></html>',
    f'<html data-l="1"><body class="page with-sidebar menu-closed"><div class="header-fixed wrapper"><div class="share-story"><h1>Title</h1>{TEXT}</div></div></body></html>',
    f'<html data-l="1"><body class="has-cookie-banner"><div id="page-ad-free"><article class="article-share-body">{TEXT}<p>And an end.</p></article><div class="share-bar" data-l="0"><a>Post it</a></div></div></body></html>',
    '<html data-l="1"><body><div class="post-share-text"><p>The only text of a page, in a part whose name also has a word of frames.</p></div></body></html>',
    '<html data-l="1"><body><nav data-l="0"><ul><li><a>Home</a></li><li><a>About us</a></li></ul></nav></body></html>',
    f'<html data-l="1"><body><article><h2>How to do it</h2>{TEXT}<ol><li>Take it</li><li>Turn it around</li><li>Put it back</li></ol><p>Then go on.</p><ul><li>That</li></ul></article></body></html>',
    f'<html data-l="1"><body><nav data-l="0"><ul><li><a>Home</a></li></ul></nav><article><p>What it takes:</p><ul><li>an egg</li><li>some flour, and <a>salt</a></li></ul><p>Mix it.</p></article><footer data-l="0"><ul><li><a>Imprint</a></li></ul></footer></body></html>',
    '<html data-l="1"><body><div class="login" data-l="0"><form><label>Name</label><p>Please log in to read on.</p><button>Go</button></form></div></body></html>',
    '<html data-l="1"><body><div id="cookie-consent" data-l="0"><p>This site keeps cookies. By going on you agree to them.</p></div></body></html>',
)


class Page:
    """Nodes of a page (parents before children) with their features, and its text in pieces."""

    def __init__(self, source: str):
        self.parent, self.tag, self.attrs = [-1], ["html"], [""]
        own, linked = [0], [0]
        self.pieces: list[tuple[int, int, str]] = []
        stack: list[tuple[str, int]] = [("html", 0)]
        places: defaultdict[str, list[int]] = defaultdict(list)  # of the open elements of a name in the stack
        bounds = [0]
        block, links, hidden = 0, 0, 0

        def close(i: int) -> None:
            nonlocal links, hidden
            while len(stack) > i:
                t, _ = stack.pop()
                places[t].pop()
                links -= t == "a"
                hidden -= t in HIDDEN
                if t in BOUNDS:
                    bounds.pop()

        def lowest(names: tuple[str, ...]) -> int:
            """The place of the innermost open element of these names, or 0."""
            return max((places[t][-1] for t in names if places[t]), default=0)

        for text, closing, name, attrs in tokens(source):
            if text is not None:
                if hidden:
                    continue
                node = stack[-1][1]
                self.pieces.append((node, block, text))
                size = len(text.strip())
                own[node] += size
                linked[node] += size if links else 0
                continue
            if name is None:
                continue
            name = name.lower()
            if closing:
                block += name in BLOCK
                if places[name]:
                    close(places[name][-1])
                continue
            if name in VOID:
                block += name == "hr"
                if name == "br" and not hidden:
                    self.pieces.append((stack[-1][1], block, " "))
                continue
            if name == "html":
                self.attrs[0] = attrs
                continue
            block += name in BLOCK
            if name in BLOCK and hidden and (drawing := lowest(("svg", "math"))):
                # a block element ends a drawing or formula that it stands in
                close(drawing)
            if ends := CLOSES.get(name):
                while (i := lowest(ends)) and i >= bounds[-1]:
                    close(i)
            node = stack[-1][1]
            if name in BLOCK or NAMED.search(attrs):
                self.parent.append(node)
                self.tag.append(name)
                self.attrs.append(attrs)
                own.append(0)
                linked.append(0)
                node = len(self.parent) - 1
            if attrs.endswith("/") and name not in BLOCK:
                continue
            links += name == "a"
            hidden += name in HIDDEN
            places[name].append(len(stack))
            if name in BOUNDS:
                bounds.append(len(stack))
            stack.append((name, node))
        self._features(own, linked)

    def _features(self, own: list[int], linked: list[int]) -> None:
        n = len(self.parent)
        core = [t in ("article", "main") or "main" in a.lower() and "main" in _names(a) for t, a in zip(self.tag, self.attrs, strict=True)]
        inside, above = core[:], core[:]
        for i in range(1, n):
            inside[i] = inside[i] or inside[self.parent[i]]
        total, links = own[:], linked[:]
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            total[p] += total[i]
            links[p] += links[i]
            above[p] = above[p] or above[i]
        some = above[0]
        self.features = []
        for i in range(n):
            names = _names(self.attrs[i])
            use = "both" if names & ASIDE and names & MAIN else "aside" if names & ASIDE else "main" if names & MAIN else "none"
            size = "all" if total[0] and total[i] >= 0.9 * total[0] else "part" if total[i] else "empty"
            place = "no core" if not some else "inside" if inside[i] else "above" if above[i] else "outside"
            tag = TAGS.get(self.tag[i], self.tag[i])
            share = links[i] / total[i] if total[i] else 0
            self.features.append((tag if tag in KNOWN else "other", use, place, "links" if share > 0.5 else "some" if share > 0 else "no", size))


def _names(attrs: str) -> set[str]:
    if not attrs:
        return set()
    return {w for m in NAMED.findall(attrs) for w in WORDS.findall("".join(m).lower())}


class Model:
    """Potentials of nodes and edges as smoothed rates on labelled pages."""

    def __init__(self, pages: tuple[str, ...] = LABELLED, smooth: float = 0.2):
        counts, edges, labels = [defaultdict(Counter), defaultdict(Counter)], [Counter(), Counter()], Counter()
        for source in pages:
            page = Page(source)
            label: list[int] = []
            for i, attrs in enumerate(page.attrs):
                m = re.search(r'data-l="([01])"', attrs)
                label.append(int(m[1]) if m else label[page.parent[i]])
                labels[label[i]] += 1
                if i:
                    edges[label[page.parent[i]]][label[i]] += 1
                for k, f in enumerate(page.features[i]):
                    counts[label[i]][k][f] += 1
        values = [{f for c in counts for f in c[k]} for k in range(FEATURES)]
        self.node = [[{f: (counts[b][k][f] + smooth) / (labels[b] + smooth * (len(values[k]) + 1)) for f in values[k]} for k in range(FEATURES)] for b in (0, 1)]
        self.unseen = [[smooth / (labels[b] + smooth * (len(values[k]) + 1)) for k in range(FEATURES)] for b in (0, 1)]
        self.edge = [[(edges[a][b] + smooth * 0.1) / (sum(edges[a].values()) + smooth * 0.2) for b in (0, 1)] for a in (0, 1)]
        self.cache: dict[tuple, tuple[float, float]] = {}

    def potential(self, features: tuple) -> tuple[float, float]:
        """Likelihoods of a node's features, of not content and of content, scaled to 1 together."""
        if (found := self.cache.get(features)) is None:
            pair = [1.0, 1.0]
            for b in (0, 1):
                for k, f in enumerate(features):
                    pair[b] *= self.node[b][k].get(f, self.unseen[b][k])
            total = sum(pair)
            found = self.cache[features] = (pair[0] / total, pair[1] / total)
        return found

    def marginals(self, page: Page) -> list[float]:
        """Probability of content of each node, by sum-product."""
        (e00, e01), (e10, e11) = self.edge
        n = len(page.parent)
        local = [self.potential(f) for f in page.features]
        down0, down1 = [p[0] for p in local], [p[1] for p in local]
        message: list[tuple[float, float]] = [(1.0, 1.0)] * n
        for i in range(n - 1, 0, -1):
            a, b = down0[i], down1[i]
            m0, m1 = e00 * a + e01 * b, e10 * a + e11 * b
            total = m0 + m1
            message[i] = (m0, m1) = (m0 / total, m1 / total)
            p = page.parent[i]
            x, y = down0[p] * m0, down1[p] * m1
            down0[p], down1[p] = x / (x + y), y / (x + y)
        belief = [(down0[0] * 0.02, down1[0] * 0.98)] + [(0.0, 0.0)] * (n - 1)
        for i in range(1, n):
            b0, b1 = belief[page.parent[i]]
            b0, b1 = b0 / max(message[i][0], 1e-300), b1 / max(message[i][1], 1e-300)
            x, y = down0[i] * (b0 * e00 + b1 * e10), down1[i] * (b0 * e01 + b1 * e11)
            belief[i] = (x / (x + y), y / (x + y))
        return [b / (a + b) for a, b in belief]


def extract(source: str | None, model: Model) -> str:
    if not source:
        return ""
    page = Page(source)
    content = [p >= 0.5 for p in model.marginals(page)]
    blocks: list[str] = []
    last, parts = -1, []
    for node, block, text in page.pieces:
        if not content[node] or page.tag[node] == "head":
            continue
        if block != last and parts:
            blocks.append("".join(parts))
            parts = []
        last = block
        parts.append(text)
    blocks.append("".join(parts))
    clean = (" ".join((entities.unescape(b) if "&" in b else b).split()) for b in blocks)
    return "\n".join(b for b in clean if b)


def main_text(html: str = "html"):
    """Column of the main text of a page's source."""
    model = Model()
    return over_texts(lambda pages: [extract(p, model) for p in pages], "string", pa.string())(F.col(html))


def report(pages: DataFrame) -> DataFrame:
    out = pages.select("page_id", "url", main_text().alias("text"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
