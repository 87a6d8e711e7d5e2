"""HTML extraction with site template removal.

Each page is parsed once per pass. Pass one hashes the element subtrees of the text to be extracted that could be of the site and counts, per host in
Spark, in how many different content roots each occurs; subtrees that recur in many of a host are templates. Pass two takes the
main content (article or main, else the whole page), leaves out what is furniture by its tag, role or class and every template, and
joins what remains, block by block. Roots are told apart by their text without furniture, so that the copies of an article on many
pages of a host count once and stay; the root and its ancestors are never templates. A paragraph, heading or list item inside an
article is a template only if it stands in MIN_PROSE different articles and in PROSE_SHARE of all that the host has: articles on one host also
share titles, sentences and license lines, which are their own text. Other subtrees need MIN_PAGES, on a host of any size.

With rules=False nothing is furniture by its tag, role or class (scripts, styles and other elements without readable text
aside), so that counting alone decides.

Edge cases: null or empty html gives an empty text; unclosed and stray tags are tolerated, as browsers do; text without
any element is one block; a null url has the empty host; repeated pages count once; columns
that a caller's table has besides are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from orebody.llm.common import materialize, salted_join, text_chunks
from orebody.llm.url_graph import url_host

MIN_PAGES = 3
MIN_PROSE = 10
PROSE_SHARE = 0.25
LISTED = 200_000  # templates that are sent to the tasks; more are joined
_EVERY_ROOT = 0  # stands for a hash in the rows that count a host's roots

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+|[^>]*)>""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_RAW = {"script", "style", "template", "noscript", "textarea", "iframe", "title", "xmp", "noembed", "noframes"}
_RAW_END = {t: re.compile(rf"</{t}[\s/>]", re.I) for t in _RAW}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td",
    "tfoot", "th", "thead", "tr", "ul",
}
_TEXTUAL = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre"}
_PROSE = {"ul", "ol", "dl", "table", "p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "figcaption", "caption"}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "dfn", "em", "font", "i", "kbd", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var", "label", "ins", "del"}
_FURNITURE_TAGS = {"nav", "footer", "aside", "form", "script", "style", "template", "noscript", "textarea", "iframe", "title", "head", "button", "select", "option", "object", "embed", "applet", "canvas", "svg", "audio", "video", "map", "dialog", "menu", "xmp", "noembed", "noframes", "input"}
_NEVER = _INLINE | {"html", "body", "head", "#root", "br", "wbr", "img"}
_FURNITURE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "menu", "menubar", "toolbar", "alert"}
_FURNITURE_WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices",
    "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "login", "social", "share", "sharing", "sidebar", "rail", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs",
    "footer", "masthead", "comment", "comments", "respond", "disqus", "reply", "replies", "related", "recommended", "widget", "pagination", "pager", "toolbar", "skip", "copyright", "disclaimer",
}
#: Parts that may stand beside a furniture word in a class or id inside an article: "ad-box" is furniture there, "ad-hoc" isn't.
_STRUCTURE_WORDS = {
    "area", "bar", "block", "body", "bottom", "box", "button", "buttons", "column", "container", "content", "footer", "form", "frame", "group", "header", "icon", "icons", "inner", "item", "items", "left", "link",
    "links", "list", "main", "outer", "page", "panel", "reader", "right", "row", "section", "site", "slot", "text", "thread", "top", "unit", "user", "wrap", "wrapper", "",
}
_ALWAYS = _RAW | {"head", "select", "option", "object", "embed", "applet", "canvas", "svg", "audio", "video", "map", "input"}
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tr", "td", "th", "tbody", "thead", "tfoot"}, {"table"}), "option": ({"option"}, {"select"}),
}


@dataclass(slots=True)
class Element:
    tag: str
    parent: Element | None
    names: str
    furniture: bool
    children: list = field(default_factory=list)
    digest: bytes = b""
    words: int = 0
    textual: bool = False  # it is or holds a paragraph, heading or quote


def _parts(name: str) -> list[str]:
    """The words of one class or id: "adBox" and "ad-box" have two."""
    return re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())


def _named_furniture(name: str, inside: bool) -> bool:
    parts = _parts(name)
    if not inside:
        return not _FURNITURE_WORDS.isdisjoint(parts)
    return not _FURNITURE_WORDS.isdisjoint(parts) and all(p in _FURNITURE_WORDS or p in _STRUCTURE_WORDS for p in parts)


def _is_furniture(tag: str, attrs: str, inside: bool, rules: bool = True) -> tuple[bool, str]:
    """Whether an element is furniture by its own tag, role, class or id; and its names for the hash."""
    if not attrs:
        return (tag in _FURNITURE_TAGS or (tag == "header" and not inside)) if rules else tag in _ALWAYS, ""
    found: dict[str, str] = {}
    for m in _ATTR.findall(attrs):
        found.setdefault(m[0].lower(), m[1] or m[2] or m[3])
    named = f"{found.get('class', '')} {found.get('id', '')}".strip()
    if not rules:
        return tag in _ALWAYS, named.lower()
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    hit = tag in _FURNITURE_TAGS or found.get("role", "").lower() in _FURNITURE_ROLES or any(_named_furniture(n, inside) for n in named.split()) or hidden or (tag == "header" and not inside)
    return hit and tag not in ("html", "body"), named.lower()


def parse(source: str, rules: bool = True) -> Element:
    """The element tree; children are elements or text. Never fails."""
    top = Element("#root", None, "", False)
    node, at, inside = top, 0, 0
    while True:
        m = _TOKEN.search(source, at)
        if m is None:
            break
        if m.start() > at:
            node.children.append(source[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            if m[0].startswith("<![CDATA["):
                node.children.append(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        tag = name.lower()
        if m[1]:  # an end tag closes the nearest open element of its name, unless inline would close block
            up = node
            while up is not top and up.tag != tag:
                if tag in _INLINE and up.tag not in _INLINE:
                    up = top
                    break
                up = up.parent
            if up is not top:
                while node is not up:
                    inside -= node.tag in ("article", "main")
                    node = node.parent
                inside -= node.tag in ("article", "main")
                node = node.parent
            elif tag == "p":  # a stray end makes an empty paragraph, which parts what stands around it
                node.children.append(Element("p", node, "", False))
            continue
        shut, within = _CLOSES.get(tag, (None, None))
        if shut is None and tag in _BLOCK:
            shut, within = {"p"}, {"button", "table", "td", "th", "caption", "object", "article", "main", "section", "div", "blockquote"}
        if shut:
            up, last = node, None
            while up is not top and up.tag not in within:
                if up.tag in shut:
                    last = up
                up = up.parent
            if last is not None:
                node = last.parent
        furniture, names = _is_furniture(tag, m[3], inside > 0, rules)
        child = Element(tag, node, names, furniture)
        node.children.append(child)
        if tag in _RAW:
            end = _RAW_END[tag].search(source, at)
            child.children.append(source[at : end.start() if end else len(source)])
            at = len(source) if end is None else (source.find(">", end.start()) + 1 or len(source))
        elif tag not in _VOID and not m[3].endswith("/"):
            node = child
            inside += tag in ("article", "main")
    if at < len(source):
        node.children.append(source[at:])
    return top


def _in_order(top: Element) -> list[Element]:
    """Parents before their children."""
    out, stack = [], [top]
    while stack:
        e = stack.pop()
        out.append(e)
        stack.extend(c for c in reversed(e.children) if type(c) is Element)
    return out


def _hash_all(elements: list[Element]) -> None:
    for e in reversed(elements):
        h = hashlib.blake2b(f"{e.tag} {e.names}>".encode(), digest_size=8)
        e.textual = e.tag in _TEXTUAL
        for c in e.children:
            if type(c) is Element:
                h.update(c.digest)
                e.words += c.words
                e.textual |= c.textual
            elif words := c.split():
                h.update(" ".join(words).encode("utf-8", "surrogatepass"))
                e.words += len(words)
        e.digest = h.digest()


def content_roots(elements: list[Element]) -> list[Element]:
    """The outermost articles (or else mains) that stand in no furniture; else the whole page."""
    for tag in ("article", "main"):
        found = [e for e in elements if e.tag == tag and not e.furniture]
        out = []
        for e in found:
            up = e.parent
            while up is not None and not up.furniture and up.tag != tag:
                up = up.parent
            if up is None:
                out.append(e)
        if out:
            return out
    return elements[:1]


def _candidates(elements: list[Element], roots: list[Element]) -> tuple[list[Element], set[int], set[int]]:
    """Elements that may be templates, the ids of those that stand in a root's own text, and of those that are or hold prose there."""
    root_ids = {id(r) for r in roots if r.tag != "#root"}
    kept, state, own, written = [], {}, set(), set()
    above: set[int] = set()
    for r in roots:
        up = r
        while up is not None:
            above.add(id(up))
            up = up.parent
    for e in elements:
        parent = state.get(id(e.parent), (False, False, False))
        in_root = id(e) in root_ids or parent[0]
        prose = parent[1] or (in_root and e.tag in _PROSE)
        dropped = parent[2] or e.furniture
        state[id(e)] = (in_root, prose and not dropped, dropped)
        if id(e) in above or e.tag in _NEVER or not e.words:
            continue
        if in_root and (prose or e.textual) and not dropped:
            if e.tag not in _BLOCK:  # a mark would cut the prose at it
                continue
            written.add(id(e))
        kept.append(e)
        if not dropped and (in_root or not root_ids):
            own.add(id(e))
    return kept, own, written


def blocks_of(roots: list[Element], marks: set[int]) -> list[tuple[str, list[int]]]:
    """Text blocks in page order with the digests (as signed 64-bit numbers) of the marked elements around each."""
    out: list[tuple[str, list[int]]] = []
    buffer: list[str] = []
    around: list[int] = []

    def flush() -> None:
        text = " ".join(entities.unescape("".join(buffer)).split())
        buffer.clear()
        if text:
            out.append((text, list(around)))

    for root in roots:
        stack: list = [root]
        while stack:
            e = stack.pop()
            if type(e) is str:
                buffer.append(e)
            elif type(e) is tuple:
                flush()
                if e[1]:
                    around.pop()
            elif e is None:
                continue
            elif e.furniture:
                if e.tag in _BLOCK:
                    flush()
            elif e.tag in ("br", "wbr", "img"):
                buffer.append("" if e.tag == "wbr" else " ")
            else:
                marked = id(e) in marks
                if marked or e.tag in _BLOCK or e is root:
                    flush()
                    stack.append((e, marked))
                    if marked:
                        around.append(_number(e.digest))
                stack.extend(reversed(e.children))
    flush()
    return out


def _number(digest: bytes) -> int:
    return int.from_bytes(digest, "big", signed=True)


def root_texts(elements: list[Element], roots: list[Element]) -> dict[int, int]:
    """By the id of each element: the hash of the text, without furniture, of the root that it stands in, or of all roots together."""
    texts = ["\n".join(t for t, _ in blocks_of([r], set())) for r in roots]
    hashed = [_number(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest()) for t in [*texts, "\n".join(texts)]]
    own = {id(r): h for r, h in zip(roots, hashed[:-1], strict=True)}
    out: dict[int, int] = {}
    for e in elements:
        out[id(e)] = own.get(id(e), out.get(id(e.parent), hashed[-1]))
    return out


def _analysed(source: str | None, rules: bool = True) -> tuple[list[Element], list[Element], set[int], list[Element], set[int]]:
    elements = _in_order(parse(source or "", rules))
    _hash_all(elements)
    roots = content_roots(elements)
    kept, own, written = _candidates(elements, roots)
    return elements, roots, own, kept, written


def subtree_hashes(pages: DataFrame, url: str = "url", html: str = "html", rules: bool = True, only_text: bool = False) -> DataFrame:
    """One row per page and different candidate subtree and root: host, hash, root, in_text (it stands in the text to be extracted),
    prose (it is or holds prose there); and one per page and root with the hash _EVERY_ROOT. only_text: rows that are in_text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, "_html"):
                hosts, hashes, within, inner, prose = [], [], [], [], []
                for host, source in zip(part.column("host").to_pylist(), part.column("_html").to_pylist(), strict=True):
                    elements, roots, own, kept, written = _analysed(source, rules)
                    texts = root_texts(elements, roots)
                    found: dict[tuple[int, int], tuple[bool, bool]] = {(_EVERY_ROOT, texts[id(r)]): (True, True) for r in roots}
                    for e in kept:
                        if only_text and id(e) not in own:
                            continue
                        at = (_number(e.digest), texts[id(e)])
                        was = found.get(at, (False, False))
                        found[at] = (was[0] or id(e) in own, was[1] or id(e) in written)
                    hosts += [host] * len(found)
                    hashes += [h for h, _ in found]
                    within += [r for _, r in found]
                    inner += [i for i, _ in found.values()]
                    prose += [p for _, p in found.values()]
                yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(hashes, pa.int64()), pa.array(within, pa.int64()), pa.array(inner, pa.bool_()), pa.array(prose, pa.bool_())], ["host", "hash", "root", "in_text", "prose"])

    return pages.select(url_host(F.col(url)).alias("host"), F.col(html).alias("_html")).mapInArrow(run, "host string, hash long, root long, in_text boolean, prose boolean")


def host_templates(pages: DataFrame, url: str = "url", html: str = "html", min_pages: int = MIN_PAGES, rules: bool = True, only_text: bool = False) -> DataFrame:
    """host, hash, n_pages, in_text: subtrees in at least `min_pages` different roots, however many pages the host has; prose in at least
    MIN_PROSE of them and in PROSE_SHARE of the host's."""
    flags = [F.max("in_text").alias("in_text"), F.max("prose").alias("prose")]
    single = subtree_hashes(pages, url, html, rules, only_text).groupBy("host", "hash", "root").agg(*flags)
    counted = single.groupBy("host", "hash").agg(F.count("*").alias("n_pages"), *flags).filter((F.col("n_pages") >= min_pages) | (F.col("hash") == _EVERY_ROOT))
    counted = materialize(counted, "counted")
    sizes = counted.filter(F.col("hash") == _EVERY_ROOT).select("host", F.col("n_pages").alias("roots"))
    found = salted_join(counted.filter(F.col("hash") != _EVERY_ROOT), sizes, ["host"], "left", by=["hash"])
    return found.filter(~F.col("prose") | ((F.col("n_pages") >= max(min_pages, MIN_PROSE)) & (F.col("n_pages") >= PROSE_SHARE * F.col("roots")))).select("host", "hash", "n_pages", "in_text")


def extract_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", min_pages: int = MIN_PAGES, rules: bool = True) -> DataFrame:
    """Columns: key, url, text, n_chars (code points)."""
    found = materialize(host_templates(pages, url, html, min_pages, rules, only_text=True).select("host", "hash"), "templates")
    few = found.limit(LISTED + 1).count() <= LISTED
    listed: dict[str, set[int]] = {}
    for r in found.toLocalIterator() if few else ():
        listed.setdefault(r.host, set()).add(r.hash)
    shared = pages.sparkSession.sparkContext.broadcast(listed)  # LISTED at most
    kind = StructType(list(pages.select(key, url).schema.fields)).add("_blocks", ArrayType(StringType())).add("_around", ArrayType(ArrayType(LongType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = shared.value
        for batch in batches:
            for part in text_chunks(batch, html):
                texts, around = [], []
                for host, source in zip(part.column("_host").to_pylist(), part.column(html).to_pylist(), strict=True):
                    gone = listed.get(host, ())
                    _, roots, own, _, _ = _analysed(source, rules)
                    blocks = [b for b in blocks_of(roots, own) if not any(a in gone for a in b[1])]
                    texts.append([t for t, _ in blocks])
                    around.append([[] if few else a for _, a in blocks])
                yield pa.RecordBatch.from_arrays([part.column(key), part.column(url), pa.array(texts, pa.list_(pa.string())), pa.array(around, pa.list_(pa.list_(pa.int64())))], [key, url, "_blocks", "_around"])

    blocks = pages.select(key, url, html, url_host(F.col(url)).alias("_host")).mapInArrow(run, kind)
    if not few:  # too many templates for the tasks: look each page's subtrees up among them
        blocks = materialize(blocks.withColumn("_id", F.xxhash64(key, url, "_blocks", "_around")), "blocks")
        held = blocks.filter(F.exists("_around", lambda a: F.size(a) > 0)).select("_id", url_host(F.col(url)).alias("host"), F.explode(F.array_distinct(F.flatten("_around"))).alias("hash")).distinct()
        hits = salted_join(held, found, ["host", "hash"]).groupBy("_id").agg(F.collect_set("hash").alias("_gone"))  # at most one page's own subtrees
        blocks = salted_join(blocks, hits, ["_id"], "left", by=[key])
        gone = F.coalesce("_gone", F.array().cast("array<long>"))
        left = F.filter(F.arrays_zip("_blocks", "_around"), lambda b: ~F.arrays_overlap(b["_around"], gone))
        blocks = blocks.withColumn("_blocks", F.transform(left, lambda b: b["_blocks"]))
    text = F.array_join("_blocks", "\n")
    return blocks.select(key, url, text.alias("text")).select(key, url, "text", F.char_length("text").cast("long").alias("n_chars"))


def op3_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
