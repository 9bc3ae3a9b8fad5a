"""Main text of HTML pages: site templates and page furniture go, the article stays.

Every element subtree is hashed. Spark counts, per host, on how many different pages each hash occurs outside the article,
and in how many different articles within it. A subtree outside, or a list of links inside, is template from LEAST_PAGES
pages of its host on, however many pages the host has. Another subtree inside an article is template when it recurs in
LEAST_ARTICLES different articles and in SHARE of all different articles of the host: a notice that every article
carries goes on hosts of every size, while a passage that many articles share stays, as does an article that a host
serves on many pages, which counts once.

Elements that are furniture by tag, role or the whole of a class or id (menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles, reader comments) go as well. Inside an article only containers go by name: its headings,
paragraphs and asides without such a name stay unless the counts call them template. Parts of names are a hint on pages
without an article only.

Null html counts as empty and gives an empty text; a null url counts as a host without a name. Pages that repeat are
counted once per distinct html and host, and get equal texts. Broken markup never fails: unclosed elements end with
their parents, stray end tags are passed over, a tag that never ends ends at the next >. Time is linear in the page.
Extra columns stay out of the result.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored

#: Outside the article: a subtree is template from so many different pages of its host on.
LEAST_PAGES = 5
#: Within it: from so many different articles on, if they are this share of the host's.
LEAST_ARTICLES, SHARE = 10, 0.5
#: A list of links is a subtree with at least this share of its text in links.
LINK_SHARE = 0.5

#: A comment, an end or start tag's name, and the rest of a tag.
COMMENT = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))", re.S)
NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
ATTRIBUTE = re.compile(r"([^\s=\"'/>]++)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option optgroup p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag that ends an open element of these kinds, up to the nearest of the second set.
ENDS = (
    {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "option": ({"option"}, {"select"})}
    | dict.fromkeys(("dt", "dd"), ({"dt", "dd"}, {"dl"}))
    | {"tr": ({"tr", "td", "th"}, {"table"})}
    | dict.fromkeys(("td", "th"), ({"td", "th"}, {"tr", "table"}))
    | dict.fromkeys(("thead", "tbody", "tfoot"), ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}))
)
ENDS_P = BLOCK - {"body", "br", "html", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend"}
FURNITURE_TAGS = frozenset("head nav aside footer form script style noscript template iframe noembed noframes svg math canvas object button select textarea input dialog menu search audio video map".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
#: Whole classes and ids of furniture, and words that are a part of one.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsors sponsored promo promos promotion banner cookie cookies cookie-notice cookie-banner consent gdpr notice notices "
    "sidebar menu menus nav navbar navigation topbar breadcrumb breadcrumbs footer masthead comment comments comment-list comments-area disqus disqus_thread respond share sharing social "
    "newsletter subscribe subscription related related-posts recommended popup modal overlay widget widgets pagination pager toolbar login signup search skip-link".split()
)
NAME_PART = re.compile(
    r"(?:^|[-_])(?:ads?|advert(?:s|isements?|ising)?|sponsor(?:s|ed)?|promo(?:s|tion|tions)?|banner|cookies?|consent|gdpr|notices?|sidebar|menus?|nav|navbar|navigations?|topbar|breadcrumbs?|"
    r"footer|masthead|comments?|disqus|respond|share|sharing|social|newsletter|subscribe|subscription|related|recommended|popup|modal|overlay|widgets?|pagination|pager|skip|toolbar|login|signup|search|header)(?:$|[-_])",
    re.I,
)
#: Only these go by a part of their name.
CONTAINERS = frozenset("div section ul ol dl table fieldset details".split())
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
P_BOUNDS = ENDS_P | {"td", "th", "li", "dd", "dt", "button"}
CELLS = frozenset(("td", "th", "table"))


class Node:
    __slots__ = ("tag", "attributes", "children", "hash", "chars", "linked")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []
        self.hash = self.chars = self.linked = 0


class Open:
    """The stack of open elements, with the places of each tag and of the bounds in it."""

    def __init__(self, root: Node):
        self.stack, self.places = [root], defaultdict(list)
        self.p_bounds, self.cells = [0], [0]

    def push(self, node: Node) -> None:
        k = len(self.stack)
        self.stack.append(node)
        self.places[node.tag].append(k)
        if node.tag in P_BOUNDS:
            self.p_bounds.append(k)
        if node.tag in CELLS:
            self.cells.append(k)

    def cut(self, k: int) -> None:
        """Closes the element at k and all within it."""
        for node in self.stack[k:]:
            self.places[node.tag].pop()
        del self.stack[k:]
        for bounds in (self.p_bounds, self.cells):
            while bounds[-1] >= k:
                bounds.pop()

    def last(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def end(self, tag: str) -> None:
        k = self.last((tag,))
        if k and (tag in BLOCK or tag in CELLS or k > self.cells[-1]):
            self.cut(k)

    def make_room(self, tag: str) -> None:
        """Closes what the start of `tag` ends."""
        if tag in ENDS:
            kinds, until = ENDS[tag]
            bound = self.last(until)
            found = [own[k] for t in kinds if (own := self.places.get(t)) and (k := bisect_right(own, bound)) < len(own)]
            if found:
                self.cut(min(found))
        if tag in ENDS_P:
            k = self.last("p")
            # a p is a bound itself, and none but it may stand at or above its place
            if k and self.p_bounds[-1] <= k:
                self.cut(k)


def parse(page: str) -> Node:
    """A tree of nodes and decoded text; lenient, linear, and without recursion."""
    root = Node("html", {})
    open_, begin, look, n, quotes = Open(root), 0, 0, len(page), True

    def text(end: int) -> None:
        if end > begin:
            open_.stack[-1].children.append(entities.unescape(page[begin:end]))

    while (at := page.find("<", look)) >= 0:
        if page.startswith(("<!", "<?"), at):
            text(at)
            if comment := COMMENT.match(page, at):
                begin = look = comment.end()
            else:
                begin = look = (page.find(">", at) + 1) or n
            continue
        m = NAME.match(page, at)
        if not m:
            look = at + 1
            continue
        rest = REST.match(page, m.end()) if quotes else None
        if not rest:  # from here on quotes are not trusted
            quotes = False
        end = rest.end() if rest else page.find(">", m.end()) + 1
        text(at)
        begin = look = end or n
        if not end:
            break
        tag = m[1].lower()
        if page[at + 1] == "/":
            open_.end(tag)
            continue
        if tag == "html":
            continue
        open_.make_room(tag)
        raw = page[m.end() : end - 1]
        found = {a[0].lower(): entities.unescape(a[1] or a[2] or a[3]) for a in ATTRIBUTE.findall(raw)} if raw and not raw.isspace() else {}
        node = Node(tag, found)
        open_.stack[-1].children.append(node)
        if tag in VOID or raw.endswith("/") and tag in ("svg", "path", "use"):
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*+>", re.I).search(page, end)
            node.children.append(page[end : close.start() if close else n])
            begin = look = close.end() if close else n
            continue
        open_.push(node)
    text(n)
    return root


def nodes(root: Node) -> list[Node]:
    """All nodes, parents first."""
    out = [root]
    for node in out:
        out += [c for c in node.children if isinstance(c, Node)]
    return out


def hash_subtrees(order: list[Node]) -> None:
    """Sets hash, chars and linked (text in links) of each node; order has parents first."""
    for node in reversed(order):
        parts, chars, linked = [node.tag, node.attributes.get("class", ""), node.attributes.get("id", "")], 0, 0
        for c in node.children:
            if isinstance(c, Node):
                parts.append(f"\x01{c.hash:x}")
                chars += c.chars
                linked += c.linked
            else:
                text = " ".join(c.split())
                parts.append(text)
                chars += len(text)
        if node.tag in ("script", "style"):
            parts[3:] = []  # their contents often carry the page's own numbers
        node.hash = xxhash.xxh3_64_intdigest("\x00".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)
        node.chars, node.linked = chars, chars if node.tag == "a" else linked


def is_main(node: Node) -> bool:
    return node.tag in ("article", "main") or node.attributes.get("role", "").lower() == "main"


def is_furniture(node: Node, in_article: bool, hints: bool) -> bool:
    """hints: whether a part of a name counts."""
    tag, a = node.tag, node.attributes
    if tag in FURNITURE_TAGS and not (in_article and tag == "aside") or tag == "header" and not in_article:
        return True
    names = [x.lower() for x in (*a.get("class", "").split(), *a.get("id", "").split())] if a else []
    if tag == "article":
        return not NAMES.isdisjoint(names)  # a reader's comment is often marked so
    if tag in ("main", "body", "html", "h1") or not a:
        return False
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or HIDDEN_STYLE.search(a.get("style", "")):
        return True
    if a.get("role", "").lower() in FURNITURE_ROLES:
        return True
    if not NAMES.isdisjoint(names):
        return not in_article or tag in CONTAINERS or tag == "aside"  # a heading or paragraph of the article stays
    return hints and tag in CONTAINERS and any(NAME_PART.search(x) for x in names)


def mains(root: Node) -> list[Node]:
    """The outermost articles that are no furniture, else the first main element."""
    found, first, work = [], None, [root]
    while work:
        node = work.pop()
        if is_furniture(node, False, False):
            continue
        if node.tag == "article":
            found.append(node)
            continue
        first = node if first is None and is_main(node) else first
        work += [c for c in reversed(node.children) if isinstance(c, Node)]
    return found or ([first] if first else [])


def main_text(root: Node, template: frozenset | set) -> str:
    """The text of the articles (else of main, else of the body) without furniture and template subtrees."""
    tops = mains(root)

    def walk(top: Node, drop: frozenset | set) -> list[str]:
        out: list[str] = []
        work: list = [top]
        while work:
            node = work.pop()
            if isinstance(node, str):
                out.append(node)
            elif node is not top and (is_furniture(node, bool(tops), not tops) or node.hash in drop and not is_main(node) and node.tag not in ("html", "body")):
                out.append(" ")
            else:
                inner = list(reversed(node.children))
                if node.tag in BLOCK:
                    out.append(" ")
                    inner = [" ", *inner]
                work += inner
        return out

    def text(drop: frozenset | set) -> str:
        return " ".join("".join(x for top in tops or [root] for x in (*walk(top, drop), " ")).split())

    # a page of which all recurs is a copied page
    return text(template) or (text(frozenset()) if template else "")


def _rows(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    html = F.coalesce(F.col(html_col), F.lit(""))
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), host.alias("host"), F.xxhash64(host, html).alias("page"))


def subtree_hashes(root: Node) -> tuple[list[int], list[int], list[int], int | None]:
    """Hashes of the subtrees with text: those outside the article, link lists inside it, others inside; and the article's."""
    tops = mains(root)
    found: list[set[int]] = [set(), set(), set()]
    inner = {id(t) for t in tops}
    work = [(root, False)]
    while work:
        node, inside = work.pop()
        inside = inside or id(node) in inner
        if node.chars and not is_main(node) and node.tag not in ("html", "head", "title", "body"):
            found[(1 if node.linked >= LINK_SHARE * node.chars else 2) if inside else 0].add(node.hash)
        work += [(c, inside) for c in node.children if isinstance(c, Node)]
    article = xxhash.xxh3_64_intdigest(repr([t.hash for t in tops]).encode()) - (1 << 63) if tops else None
    return *map(list, found), article


def host_mask(host: str) -> int:
    """Makes a subtree's hash one of its host's."""
    return xxhash.xxh3_64_intdigest(host.encode()) - (1 << 63)


def subtrees(rows: DataFrame) -> DataFrame:
    """host, page, article, and the distinct subtrees of each page as arrays: outer, lists, inner."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                found, articles = [], []
                for host, text in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True):
                    root, mask = parse(text), host_mask(host)
                    hash_subtrees(nodes(root))
                    *own, article = subtree_hashes(root)
                    found.append([[h ^ mask for h in x] for x in own])
                    articles.append(article)
                cols = {name: pa.array([x[k] for x in found], pa.list_(pa.int64())) for k, name in enumerate(("outer", "lists", "inner"))}
                yield pa.record_batch({"host": part.column("host"), "page": part.column("page"), "article": pa.array(articles, pa.int64()), **cols})

    return rows.select("host", "page", "html").mapInArrow(work, "host string, page long, article long, outer array<long>, lists array<long>, inner array<long>")


def templates(found: DataFrame, least_pages: int, least_articles: int, share: float) -> tuple[DataFrame, DataFrame]:
    """The template hashes by pages (outside, and link lists) and by articles. A hash belongs to one host."""

    def counted(rows: DataFrame, hashes) -> DataFrame:
        return rows.select("host", F.explode(hashes).alias("hash")).groupBy("host", "hash").agg(F.count("*").alias("n"))

    by_page = counted(found, F.concat("outer", "lists")).filter(F.col("n") >= least_pages).select("hash")
    once = found.filter(F.col("article").isNotNull()).dropDuplicates(["host", "article"])
    of_host = once.groupBy("host").agg(F.count("*").alias("articles"))
    often = counted(once, F.col("inner")).filter(F.col("n") >= least_articles)
    return by_page, often.join(of_host, "host").filter(F.col("n") >= share * F.col("articles")).select("hash")


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_pages: int = LEAST_PAGES, least_articles: int = LEAST_ARTICLES, share: float = SHARE
) -> DataFrame:
    """id, url, text, n_chars of every row of pages.

    Hashes are counted per host with map-side sums, so a hot host's menu is one counter per task. A page meets only those
    of its template hashes that its text depends on: of an article those inside it, of a page without one all. They are
    a stored table, which Spark broadcasts if it is small; else html is shuffled once, by page."""
    rows = _rows(pages, id_col, url_col, html_col)
    found = stored(subtrees(rows).dropDuplicates(["page"]), "subtrees")
    by_page, by_article = templates(found, least_pages, least_articles, share)
    bare = F.col("article").isNull()
    met = found.select("page", F.explode(F.when(bare, F.col("outer")).otherwise(F.col("lists"))).alias("hash")).join(by_page, "hash")
    met = met.unionByName(found.filter(~bare).select("page", F.explode("inner").alias("hash")).join(by_article, "hash"))
    lists = stored(met.groupBy("page").agg(F.collect_set("hash").alias("template")), "templates", drop=(found,))  # at most a page's subtrees

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = []
                for host, page, template in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), part.column("template").to_pylist(), strict=True):
                    root = parse(page)
                    if template:
                        hash_subtrees(nodes(root))
                        mask = host_mask(host)
                    texts.append(main_text(root, frozenset(h ^ mask for h in template or ())))
                yield pa.record_batch([part.column("id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    joined = rows.join(lists, "page", "left").select(F.col("page_id").alias("id"), "url", "host", "html", "template")
    return joined.mapInArrow(work, f"id {kind}, url string, text string, n_chars long").withColumnRenamed("id", id_col)
