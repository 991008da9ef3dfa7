"""Main text of web pages, with site templates removed.

A page is read into a tree. Subtrees of the outer page (and, within the article, containers) are hashed; Spark counts on how many
different pages of its host each hash stands, and subtrees that recur on MIN_PAGES of them (more, by a Poisson bound, only where so
many pages would repeat by chance) are the site's template. Templates are joined to the pages by host and hash, so a host may have
any number of them, and are deleted first, whatever they are called. Rules by element, role and class come after that, for what
stands on too few pages of its host to be told by counting: menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles and reader comments. The text of all articles in page order (else of the main element, else of the body; also where the former
hold only a small share of what is left of the page's running text) is collected by blocks: character references decoded, white
space made one space, blocks joined by one space. template_chars and rule_chars say how much text of the page went either way.

Equal pages count once, so that copies of a page don't make its article a template. Paragraphs, headings and lists' items of an
article are never templates: documents do share passages. All work on a page is linear in its length, whatever its tags.

Defined cases: null html is an empty page with an empty text; pages with null or odd urls share the empty host; unclosed and
stray tags are repaired; a tag that the page's end cuts off is text; text without any tags is body text; a very long page is read
whole in one task; repeated rows give repeated results; an empty table gives an empty table; other columns are ignored, so their
names can't clash.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WIDE_ROWS, lookup, materialise
from tessera.llm.url_filters import split_url

#: A subtree is a template if it stands on at least MIN_PAGES different pages of its host, however many pages the host has, and on
#: significantly more than chance repeats explain: CHANCE is the rate at which a page happens to hold any given subtree, Z the
#: deviations above the expected count.
MIN_PAGES, CHANCE, Z = 5, 1e-5, 3.0

#: Articles (or main elements) with less than this share of the page's running text are teasers, and the next wider kind is taken.
SMALL_SHARE = 0.3

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: Elements that are never main text.
_DROPPED = {"nav", "header", "footer", "aside", "form", "script", "style", "noscript", "template", "iframe", "object", "embed", "svg", "math", "canvas", "audio", "video", "button", "select", "textarea", "input", "dialog", "menu", "head", "title"}
_DROPPED_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
#: Words of class and id (split at punctuation) that mark such parts.
_DROPPED_NAMES = set(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "header masthead footer sidebar aside notice notices cookie cookies consent gdpr popup modal overlay alert newsletter subscribe subscription signup login "
    "share sharing social related recommended comment comments commentlist disqus respond reply replies form search pagination pager toolbar widget".split()
)
#: These stay whatever they are called, but for an article of a reader (a comment).
_KEPT = {"html", "body", "main", "article"}
_COMMENT_NAMES = {"comment", "comments", "reply", "replies"}
#: Within an article only these can be a template.
_CONTAINERS = {"div", "section", "ul", "ol", "dl", "table", "figure", "details", "center"}
#: An open element of the first set is closed by a start tag of the second.
_BLOCK = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}

_START = re.compile(r"<(?=[a-zA-Z!?/])")
_TAG = re.compile(r"""<!--(?:>|->|.*?(?:-->|--!>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+)>|<[!?/][^>]*+>""", re.S)
#: From the first tag on whose quotes never close, quotes mean nothing.
_PLAIN_TAG = re.compile(r"<!--(?:>|->|.*?(?:-->|--!>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_SPLIT = re.compile(r"[^a-z0-9]+")


class Node:
    __slots__ = ("tag", "attrs", "children", "_names")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children, self._names = tag, attrs, [], None

    def names(self) -> tuple[str, str]:
        """Class and id, and the role."""
        if "=" not in self.attrs:
            return "", ""
        if self._names is None:
            found = {}
            for m in _ATTR.finditer(self.attrs):
                found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
            self._names = f"{found.get('class', '')} {found.get('id', '')}".lower(), found.get("role", "").strip().lower()
        return self._names


class _Open:
    """The open elements, with the places of each name, so that no search walks the stack."""

    def __init__(self, root: Node):
        self.stack, self.places, self.blocks, self.others = [root], {}, [], [0]

    def push(self, node: Node) -> None:
        at = len(self.stack)
        self.stack.append(node)
        self.places.setdefault(node.tag, []).append(at)
        if node.tag in _BLOCK and node.tag != "p":
            self.blocks.append(at)
        if node.tag not in _INLINE:
            self.others.append(at)

    def cut(self, at: int) -> None:
        """Close the element at this place and all within it."""
        for node in self.stack[at:]:
            self.places[node.tag].pop()
        del self.stack[at:]
        for places in (self.blocks, self.others):
            while places and places[-1] >= at:
                places.pop()

    def last(self, names) -> int:
        return max([self.places[x][-1] for x in names if self.places.get(x)], default=-1)

    def end(self, tag: str) -> None:
        at = self.last((tag,))
        # a stray end of an inline element closes no block
        if at > 0 and (tag not in _INLINE or self.others[-1] < at):
            self.cut(at)

    def begin(self, tag: str) -> None:
        """Close what a start tag closes, down to the element that bounds it."""
        closes = _CLOSES.get(tag) or ({"p"} if tag in _BLOCK else None)
        if not closes:
            return
        bound = self.last(_SCOPE[tag]) if tag in _SCOPE else self.blocks[-1] if self.blocks else -1
        while (at := self.last(closes)) > bound:
            self.cut(at)
            if tag not in _SCOPE or tag in ("li", "dt", "dd", "option"):
                break


def parse(page: str) -> Node:
    """The tree of a page; text nodes are strings with references decoded."""
    root = Node("#root")
    tree, at, n, tags, ends = _Open(root), 0, len(page), _TAG, {}
    while at < n:
        m, begin = None, _START.search(page, at)
        if begin:
            m = tags.match(page, begin.start())
            if not m and tags is _TAG:
                tags = _PLAIN_TAG
                m = tags.match(page, begin.start())
        stop = m.start() if m else n  # a tag without an end: all that is left is text
        if stop > at:
            tree.stack[-1].children.append(html.unescape(page[at:stop]))
        if not m:
            break
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            tree.end(tag)
            continue
        tree.begin(tag)
        node = Node(tag, m[3])
        tree.stack[-1].children.append(node)
        if tag in _RAW:
            if ends.get(tag, 0) is not None:
                ends[tag] = re.compile(f"</{tag}[\\s/>]", re.I).search(page, at)
            end = ends[tag]
            stop = end.start() if end else n
            node.children.append(page[at:stop])
            at = page.find(">", stop) + 1 if end and page.find(">", stop) >= 0 else n
        elif tag not in _VOID and (not m[3].rstrip().endswith("/") or tag in _BLOCK or tag in _INLINE):
            tree.push(node)  # a self-closing mark means nothing on such elements
    return root


def _by_rule(node: Node) -> bool:
    """Whether element, role or class tell that a subtree is no main text."""
    if node.tag in _DROPPED:
        return True
    names, role = node.names()
    if node.tag in _KEPT:
        return node.tag == "article" and not _COMMENT_NAMES.isdisjoint(names.split())
    return role in _DROPPED_ROLES or bool(names.strip()) and not _DROPPED_NAMES.isdisjoint(_SPLIT.split(names))


def _subtrees(root: Node) -> list[tuple[Node, bytes]]:
    """Subtrees that may be templates, with their hash: outside articles and main elements all but inline ones, inside containers only;
    none that holds an article or main element. One pass from the leaves up, without recursion: pages can nest without limit."""
    out, done = [], {}
    work = [(root, False, False)]
    while work:
        node, inner, ready = work.pop()
        if not ready:
            work.append((node, inner, True))
            inside = inner or node.tag in ("article", "main")
            work += [(x, inside, False) for x in node.children if isinstance(x, Node)]
            continue
        holds = node.tag in ("article", "main")
        h = xxhash.xxh3_128(node.tag + "\0" + " ".join(node.attrs.split()) + "\0")
        for x in node.children:
            if isinstance(x, Node):
                digest, held = done.pop(x)
                h.update(digest)
                holds |= held
            else:
                h.update(" ".join(x.split()).encode("utf-8", "surrogatepass") + b"\0")
        done[node] = h.digest(), holds
        if not holds and node.tag not in ("#root", "html", "head", "body") and node.tag not in _INLINE and (not inner or node.tag in _CONTAINERS):
            out.append((node, done[node][0]))
    return out


def _page_hash(page: str | None) -> int:
    return xxhash.xxh3_64_intdigest((page or "").encode("utf-8", "surrogatepass")) - (1 << 63)


#: Never text, so neither counted nor reported.
_NO_TEXT = {"script", "style", "noscript", "template", "iframe", "svg", "math", "canvas", "audio", "video", "object", "embed", "head", "title"}


def template_hashes(page: str | None) -> list[bytes]:
    return list({h for node, h in _subtrees(parse(page or "")) if node.tag not in _NO_TEXT})


def _text_of(node: Node, dropped: dict[int, str]) -> str:
    parts, work = [], [node]
    while work:
        x = work.pop()
        if isinstance(x, str):
            parts.append(x)
        elif x is not node and id(x) in dropped:
            parts.append(" ")
        elif x.tag in _INLINE:
            work += x.children[::-1]
        else:
            work += [" ", *x.children[::-1], " "]
    return " ".join("".join(parts).split())


def extracted(page: str | None, templates: set[bytes] = frozenset()) -> tuple[str, int, int]:
    """The main text, and the code points of text that went as templates and by rules."""
    root = parse(page or "")
    dropped: dict[int, str] = {}
    if templates:
        dropped = {id(node): "template" for node, h in _subtrees(root) if h in templates}
    gone, work = [], [root]
    while work:  # templates first, then the rules for what is left; nothing is looked at within what has gone
        x = work.pop()
        if id(x) in dropped or x is not root and _by_rule(x):
            dropped.setdefault(id(x), "rule")
            if x.tag not in _NO_TEXT:
                gone.append(x)
            continue
        work += [c for c in x.children if isinstance(c, Node)]
    lost = {"template": 0, "rule": 0}
    for x in gone:
        inside, work = {}, list(x.children)
        while work:
            c = work.pop()
            if isinstance(c, Node):
                if c.tag in _NO_TEXT:
                    inside[id(c)] = "rule"
                else:
                    work += c.children
        lost[dropped[id(x)]] += len(_text_of(x, inside))
    texts = {}
    for kind in ("article", "main", "body", "#root"):
        found, work = [], [root]
        while work:  # the outermost ones that are left
            x = work.pop()
            if id(x) in dropped:
                continue
            if x.tag == kind:
                found.append(x)
            else:
                work += [c for c in x.children[::-1] if isinstance(c, Node)]
        if found:
            texts[kind] = " ".join(t for x in found if (t := _text_of(x, dropped)))
        if "body" in texts:
            break
    whole = texts.get("body", texts.get("#root", ""))
    return next((t for t in texts.values() if len(t) >= SMALL_SHARE * len(whole)), whole), lost["template"], lost["rule"]


def main_text(page: str | None, templates: set[bytes] = frozenset()) -> str:
    return extracted(page, templates)[0]


def _hashed(batches):
    for b in batches:
        pages, hosts, hashes = [], [], []
        for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            hosts.append(host)
            pages.append(_page_hash(page))
            hashes.append(template_hashes(page))
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(pages, pa.int64()), pa.array(hashes, pa.list_(pa.binary()))], names=["host", "page", "hashes"])


def page_templates(pages: DataFrame) -> DataFrame:
    """host, page (hash), n (rows) and templates: those of the page's own subtrees that are templates of its host."""
    hashed = materialise(pages.select("host", "html").mapInArrow(_hashed, "host string, page long, hashes array<binary>"), "subtrees")
    distinct = materialise(hashed.groupBy("host", "page").agg(F.count("*").alias("n"), F.first("hashes").alias("hashes")), "pages")
    hosts = materialise(distinct.groupBy("host").agg(F.count("*").alias("pages")), "hosts")
    held = distinct.select("host", "page", F.explode("hashes").alias("hash"))
    seen = held.groupBy("host", "hash").agg(F.count("*").alias("on")).filter(F.col("on") >= MIN_PAGES)
    # hosts are joined to counts of subtrees, of which a hot host may have many
    known = lookup(seen, hosts.select("host", F.col("pages").alias("of"), F.col("pages").alias("n")), "host", "n")
    chance = CHANCE * F.col("of")
    often = materialise(known.filter(F.col("on") > chance + Z * F.sqrt(chance)).select(F.struct("host", "hash").alias("key"), F.col("on").alias("n"), F.lit(True).alias("is_template")), "templates")
    keyed = held.select("page", "host", F.struct("host", "hash").alias("key"))
    found = lookup(keyed, often, "key", "n").filter("is_template").groupBy("host", "page").agg(F.collect_list("key.hash").alias("templates"))
    return distinct.select("host", "page", "n").join(found, ["host", "page"], "left")


_OUT = "page_id long, url string, text string, n_chars long, template_chars long, rule_chars long"


def _extracted(batches):
    for b in batches:
        rows = [extracted(page, set(templates or ())) for page, templates in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
        texts, by_template, by_rule = zip(*rows) if rows else ((), (), ())
        cols = [b.column(0), b.column(1), pa.array(texts, pa.string()), *(pa.array(x, pa.int64()) for x in (map(len, texts), by_template, by_rule))]
        yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in _OUT.split(", ")])


def _with_page(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(map(_page_hash, b.column(2).to_pylist()), pa.int64())], names=["page_id", "url", "html", "host", "page"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, template_chars and rule_chars of each row."""
    known = pages.select("page_id", "url", "html", split_url(F.col("url"))[0].alias("host"))
    paged = known.mapInArrow(_with_page, "page_id long, url string, html string, host string, page long")
    keyed = paged.select("page_id", "url", "html", F.struct("host", "page").alias("key"))
    found = materialise(page_templates(known).select(F.struct("host", "page").alias("key"), "n", "templates"), "page-templates")
    return lookup(keyed, found, "key", "n", WIDE_ROWS).select("page_id", "url", "html", "templates").mapInArrow(_extracted, _OUT)
