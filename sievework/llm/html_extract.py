"""Main text of web pages by smoothed text-to-tag ratios.

Parser events of the standard library are taken as they come. Every block (text
between two block-level tags) is a line with its characters, its tags and the
chain of elements that hold it. The ratio of characters to tags is smoothed along
the page by a Gaussian, and the lines are clustered in two around a threshold
that is moved to the middle of both clusters' means until it rests. The content
cluster votes, by its characters, for the innermost element that holds at least
`cover` of them, nearly all; lines of <article> vote alone only when they hold
more of the cluster than what is in neither an article nor a thread (siblings of one
kind, such as comments), those of <main> from a quarter of it on. A container that holds text but no blocks is a
paragraph by another name, so the region is what holds it, and the region grows
to its parents as long as that adds lines of the cluster or other prose. Every line of the region
is content, so that a one-word paragraph between long ones stays. Lines under
elements that are furniture by their tag or role never count and never vote.
Forms and elements with a furniture word in their class or id are only suspects:
what they are is settled when the page is parsed, see _settle.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

SIGMA = 1.0
COVER = 0.95
#: Characters for each tag from which a line counts as prose, whatever the cluster.
PROSE = 25
#: Characters from which a block counts as prose where suspects are settled.
PROSE_LINE = 40

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements whose text is never content.
FURNITURE_TAGS = frozenset(
    "head title nav footer aside button select option optgroup textarea input script style noscript template iframe object svg canvas audio video dialog menu".split()
)
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar".split())
#: Words that mark furniture where they are a whole word of a class or id.
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside "
    "footer header masthead topbar toolbar cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations comment comments commentlist respond reply replies disqus widget pagination pager skip copyright legal disclaimer "
    "search searchform form tags taglist hidden paywall".split()
)
#: Furniture words of text that can be longer than the article.
BESIDES = frozenset("comment comments commentlist respond reply replies disqus cookie cookies consent gdpr related recommended recommendations".split())
#: Beginnings and ends of class names that tell of a page's layout: no-sidebar.
LAYOUT = re.compile(r"(no|non|not|has|have|with|without)[-_]|.*[-_](enabled|disabled)$", re.I)
ARTICLE_TAGS = frozenset(("article", "main"))
#: Elements that threads and listings are made of, and how many of one kind and place
#: make one; div and section count where they have a class.
REPEATED, THREAD = frozenset("li article tr dd".split()), 3
#: Elements that can be a content region.
CONTAINERS = frozenset("article main section div body html td center".split())
#: Elements whose end tag may be missing, and the tags that end them.
CLOSED_BY = {
    "p": frozenset(
        "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
    ),
    "li": frozenset(("li",)),
    "dt": frozenset(("dt", "dd")),
    "dd": frozenset(("dt", "dd")),
    "tr": frozenset(("tr",)),
    "td": frozenset(("td", "th", "tr")),
    "th": frozenset(("td", "th", "tr")),
    "option": frozenset(("option", "optgroup")),
}
_WORDS = re.compile(r"[A-Za-z][a-z]+|[A-Z]+|[a-z]+")
_SPACES = re.compile(r"\s+")


class _Node:
    """An element. suspect: 0, or 1 to 3, the later the surer it is furniture.

    block is the innermost element around it, itself included, that is not inline;
    doubt the outermost suspect of the inline elements between.
    """

    __slots__ = ("tag", "parent", "furniture", "suspect", "chars", "article", "main", "block", "doubt", "kind")

    def __init__(self, tag, parent, furniture, suspect, article, kind=None):
        self.kind = kind  # tag and class, of blocks that pages repeat
        self.tag, self.parent, self.furniture, self.suspect, self.article = tag, parent, furniture, suspect, article
        self.chars = 0
        self.main = tag == "main" or (parent is not None and parent.main)
        inline = tag in INLINE
        self.block = parent.block if inline else self
        self.doubt = (parent.doubt or (self if suspect else None)) if inline else None


def _is_furniture(tag: str, attrs: list, in_article: bool) -> bool:
    if tag in FURNITURE_TAGS or (tag == "header" and not in_article):
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    for name, value in attrs:
        if name in ("hidden",) or (name == "aria-hidden" and value == "true"):
            return True
        if not value:
            continue
        if name == "role" and value.strip().lower() in FURNITURE_ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def _suspicion(tag: str, attrs: list) -> int:
    """3 for a class name or id that is a word of BESIDES or, but for articles, has one
    in it; 2 for one that is another furniture word; 1 for one that only has another
    one in it, and for forms."""
    if tag in ("html", "body", "main"):
        return 0
    most = 1 if tag == "form" else 0
    for name, value in attrs:
        if name == "role" and value and value.strip().lower() == "form":
            most = max(most, 1)
        if name not in ("class", "id") or not value:
            continue
        for token in value.split():
            whole = re.sub("[^a-z]", "", token.lower())
            if whole in BESIDES:
                return 3
            if whole in FURNITURE_WORDS:
                most = max(most, 2)
            elif not LAYOUT.match(token):
                words = {w.lower() for w in _WORDS.findall(token)}
                # Articles are often named after their tags and categories.
                if words & BESIDES:
                    most = max(most, 2 if tag == "article" else 3)
                elif words & FURNITURE_WORDS and tag != "article":
                    most = max(most, 1)
    return most


def _settle(lines: list[tuple[str, int, _Node]], nodes: list[_Node]) -> None:
    """Decide which suspects are furniture, and mark it on all nodes.

    A suspect that holds <main> is none. Another one is cleared if it holds most of
    the page's prose (long blocks and all text of articles) and what stays outside of it, in no suspect, is less than a
    quarter of its own prose without that of suspects inside it. Slight suspects
    are judged first, without the text of graver ones; those are judged only if no
    prose is clear without them. The gravest, such as reader comments, are furniture
    even on a page without other text, unless one article, itself no suspect, is in
    them. nodes are in page order, parents first.
    """
    holds = set()
    for x in reversed(nodes):
        if id(x) in holds or (x.tag == "main" and not x.furniture):
            x.suspect = 0
            holds.add(id(x.parent))
    if any(x.suspect == 3 for x in nodes):
        inside: dict[int, int] = {}  # articles below a node
        for x in reversed(nodes):
            own = 1 if x.tag == "article" and not x.suspect and not x.furniture else inside.get(id(x), 0)
            if x.suspect == 3 and own != 1:
                x.furniture = True
            inside[id(x.parent)] = inside.get(id(x.parent), 0) + own
        for x in nodes:
            x.furniture = x.furniture or x.parent.furniture
    if any(x.suspect for x in nodes):
        articles: dict[int, bool] = {}
        for x in nodes:
            articles[id(x)] = (x.tag in ARTICLE_TAGS and not x.suspect) or articles.get(id(x.parent), False)
        clean = [(len(t), node) for t, _, node in lines if t and not node.furniture]
        prose = [(n, node) for n, node in clean if n >= PROSE_LINE or articles.get(id(node))] or clean
        for grade in (1, 2, 3):
            _clear(prose, nodes, grade)
            if _clear_chars(prose, nodes):
                break
    for x in nodes:
        up = x.parent
        x.furniture = x.furniture or x.suspect > 0 or up.furniture
        x.article = not x.furniture and (up.article or x.tag in ARTICLE_TAGS)


def _clear_chars(prose, nodes) -> int:
    under = {}
    for x in nodes:
        under[id(x)] = x.suspect > 0 or under.get(id(x.parent), False)
    return sum(n for n, node in prose if not under.get(id(node), False))


def _clear(prose, nodes, grade) -> None:
    graver: dict[int, bool] = {}
    for x in nodes:
        graver[id(x)] = x.suspect > grade or graver.get(id(x.parent), False)
    base = [(n, node) for n, node in prose if not graver.get(id(node), False)]
    sums: dict[int, int] = {}
    for n, node in base:
        sums[id(node)] = sums.get(id(node), 0) + n
    total = sum(n for n, _ in base)
    for x in reversed(nodes):
        if id(x) in sums:
            sums[id(x.parent)] = sums.get(id(x.parent), 0) + sums[id(x)]
    # Any two of these overlap, so one holds the other: they are a chain.
    chain = [x for x in nodes if x.suspect and not graver[id(x)] and 2 * sums.get(id(x), 0) > total]
    if not chain:
        return
    place = {id(x): k for k, x in enumerate(chain, 1)}
    depth: dict[int, int] = {}  # the innermost of the chain around a node; -1 below a suspect beside the chain
    for x in nodes:
        up = depth.get(id(x.parent), 0)
        depth[id(x)] = up if up < 0 else place.get(id(x), -1 if x.suspect else up)
    own = [0] * (len(chain) + 1)
    for n, node in base:
        k = depth.get(id(node), 0)
        if k >= 0:
            own[k] += n
    inside, outside = 0, sum(own)
    for k in range(len(chain), 0, -1):
        outside -= own[k]
        if 4 * outside < inside + own[k]:
            inside += own[k]
            chain[k - 1].suspect = 0
        else:
            inside = 0


class _Lines(HTMLParser):
    """Turns parser events into lines: (text, tags, node)."""

    CDATA_CONTENT_ELEMENTS = ("script", "style")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", None, False, 0, False)
        self.nodes: list[_Node] = []
        self.lines: list[tuple[str, int, _Node]] = []
        self.text: list[tuple[str, _Node]] = []
        self.tags = 0
        self.open: dict[str, int] = {}

    def flush(self):
        """End the line. Hidden inline elements give no words to it. Suspect ones do,
        and are its place only where all of its words are theirs."""
        place = self.at.block
        if any(node.tag in INLINE for _, node in self.text):
            kept = [(s, node) for s, node in self.text if node.tag not in INLINE or not node.furniture or place.furniture]
            worded = [node for s, node in kept if s.strip()]
            suspects = [node.doubt for node in worded]
            if worded and all(suspects):
                place = suspects[0]
        else:
            kept = self.text
        text = _SPACES.sub(" ", "".join(s for s, _ in kept)).strip()
        if text or self.tags:
            self.lines.append((text, self.tags, place))
        self.text, self.tags = [], 0

    def handle_starttag(self, tag, attrs):
        if tag not in INLINE:
            self.flush()
            while self.at.parent is not None and tag in CLOSED_BY.get(self.at.block.tag, ()):
                while self.at.tag in INLINE:
                    self._pop()
                self._pop()
        self.tags += 1
        if tag == "br":
            self.text.append(("\n", self.at))
        if tag in VOID:
            return
        furniture = _is_furniture(tag, attrs, self.at.article)
        suspect = _suspicion(tag, attrs)
        # Inline elements need no node, unless they hide something or lie in one that may.
        if tag in INLINE and not furniture and not suspect and not (self.open.get(tag) and self.at.tag in INLINE):
            return
        kind = (tag, dict(attrs).get("class")) if tag in REPEATED or tag in ("div", "section") and dict(attrs).get("class") else None
        self.at = _Node(tag, self.at, self.at.furniture or furniture, suspect, self.at.article or tag in ARTICLE_TAGS, kind)
        self.nodes.append(self.at)
        self.open[tag] = self.open.get(tag, 0) + 1

    def _pop(self):
        self.open[self.at.tag] -= 1
        self.at = self.at.parent

    def handle_endtag(self, tag):
        if tag in VOID:
            if tag == "br":
                self.text.append(("\n", self.at))
            return
        self.tags += 1
        if tag in INLINE:
            if not self.open.get(tag):
                return
            # An inline end tag ends no block.
            node = self.at
            while node.tag in INLINE and node.tag != tag:
                node = node.parent
            if node.tag == tag:
                while self.at is not node:
                    self._pop()
                self._pop()
            else:
                self._end(tag)
            return
        if not self.open.get(tag):
            self.flush()
            return
        self._end(tag)

    def _end(self, tag):
        self.flush()
        while self.at.tag != tag:
            self._pop()
        self._pop()

    def handle_data(self, data):
        self.text.append((data, self.at))


def _threads(nodes: list[_Node]) -> dict[int, bool]:
    """Whether a node lies in one of several siblings of one tag and class."""
    alike: dict[tuple, int] = {}
    for x in nodes:
        if x.kind is not None:
            key = (id(x.parent), x.kind)
            alike[key] = alike.get(key, 0) + 1
    found: dict[int, bool] = {}
    for x in nodes:
        found[id(x)] = found.get(id(x.parent), False) or (x.kind is not None and alike[id(x.parent), x.kind] >= THREAD)
    return found


def _smoothed(values: list[float], sigma: float) -> list[float]:
    reach = max(1, math.ceil(3 * sigma))
    weights = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    n, out = len(values), []
    for i in range(n):
        lo, hi = max(0, i - reach), min(n, i + reach + 1)
        w = weights[lo - i + reach : hi - i + reach]
        out.append(sum(a * b for a, b in zip(w, values[lo:hi])) / sum(w))
    return out


def _threshold(values: list[float]) -> float:
    """The resting threshold of two clusters of ratios, on a logarithmic scale so
    that one very long line does not push ordinary lines down."""
    logs = [math.log1p(v) for v in values]
    t = sum(logs) / len(logs)
    for _ in range(50):
        high = [v for v in logs if v > t]
        low = [v for v in logs if v <= t]
        if not high or not low:
            break
        moved = (sum(high) / len(high) + sum(low) / len(low)) / 2
        if abs(moved - t) < 1e-9:
            break
        t = moved
    return t


def content_lines(html: str, sigma: float = SIGMA, cover: float = COVER) -> list[str]:
    """The page's content, a string for each block, in page order."""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    lines = [x for x in parser.lines if x[0] or x[1]]
    if not lines:
        return []
    _settle(lines, parser.nodes)
    ratios = [0.0 if node.furniture else len(text) / max(1, tags) for text, tags, node in lines]
    if not any(ratios):
        return []
    smooth = _smoothed(ratios, sigma)
    limit = _threshold(smooth)
    clear = [(t, node) for (t, _, node) in lines if t and not node.furniture]
    clear_prose = [(t, node, math.log1p(s) > limit or len(t) >= PROSE * max(1, tags)) for (t, tags, node), s in zip(lines, smooth) if t and not node.furniture]
    chosen = [(t, node) for (t, _, node), s in zip(lines, smooth) if t and not node.furniture and math.log1p(s) > limit] or clear
    # Threads beside an article, such as comments by another name, are not weighed
    # against it, even where their lines push its own below the threshold.
    named = [(t, node) for t, node in chosen if node.article] or [(t, node) for t, node, prose in clear_prose if (prose or len(t) >= PROSE_LINE) and node.article]
    threads = _threads(parser.nodes) if named else {}
    beside = sum(len(t) for t, node in chosen if not node.article and not threads.get(id(node)))
    most = sum(len(t) for t, _ in chosen)
    inner = [(t, node) for t, node in named if node.main]
    if 4 * sum(len(t) for t, _ in inner) >= most:
        voters = inner
    else:
        voters = named if sum(len(t) for t, _ in named) > beside else chosen
    total = 0
    for t, node in voters:
        total += len(t)
        node.chars += len(t)
    for x in reversed(parser.nodes):
        x.parent.chars += x.chars
    region = max((node for _, node in voters), key=lambda x: x.chars)
    while region.parent is not None and region.chars < cover * total:
        region = region.parent
    # A paragraph, a list or a block of bare text is no region: take what holds it.
    blocks = {id(node.parent) for _, node in clear}
    while region.parent is not None and (region.tag not in CONTAINERS or (id(region) not in blocks and region.tag not in ARTICLE_TAGS)):
        region = region.parent
    if region.article:
        while region.parent is not None and region.parent.article:
            region = region.parent
    held_chars = {id(x): [0, 0] for x in (parser.root, *parser.nodes)}
    for t, node, prose in clear_prose:
        sums = held_chars[id(node)]
        sums[0] += len(t)
        sums[1] += prose * len(t)
    for x in reversed(parser.nodes):
        sums, up = held_chars[id(x)], held_chars[id(x.parent)]
        up[0] += sums[0]
        up[1] += sums[1]
    at = region
    while at.parent is not None and not region.article:
        at = at.parent
        if at.tag in CONTAINERS and held_chars[id(at)][1] > held_chars[id(region)][1]:
            region = at
        elif at.tag in CONTAINERS and held_chars[id(at)][0] > held_chars[id(region)][0]:
            break
    inside: dict[int, bool] = {}

    def held(node):
        chain = []
        while node is not None and id(node) not in inside:
            if node is region:
                inside[id(node)] = True
                break
            chain.append(node)
            node = node.parent
        answer = inside[id(node)] if node is not None else False
        for x in chain:
            inside[id(x)] = answer
        return answer

    return [t for t, node in clear if held(node)]


def extract_text(html: str | None, sigma: float = SIGMA, cover: float = COVER) -> str:
    """Main text of one page: its content blocks joined by one space."""
    return " ".join(content_lines(html, sigma, cover)) if html else ""


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text", sigma: float = SIGMA, cover: float = COVER) -> DataFrame:
    """Add the main text of every page as out_col.

    Null and empty html give the empty text, as does a page of nothing but reader
    comments or elements that are furniture by their tag or role. Pages are independent: one row in, one row out, no shuffle;
    repeated rows stay repeated and an empty table gives an empty one. The time is
    linear in the page's length, however deep its elements nest. Other columns stay;
    a column already named out_col is replaced.
    """

    @F.arrow_udf("string")
    def text(html: pa.Array) -> pa.Array:
        return pa.array((extract_text(h.as_py(), sigma, cover) for h in html), pa.string())

    return pages.withColumn(out_col, text(F.col(html_col)))


def op3_html_extraction(spark, sf_dir):
    pages = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
