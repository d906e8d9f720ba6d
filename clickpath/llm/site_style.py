"""Main text of web pages by site style trees.

The pages of a host are merged into one tree: an element node stands for a
place in the layout, a style node for one sequence of children seen there.
Places whose children and texts are much the same from page to page carry
little, and are cut from every page before its text is taken.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from clickpath.llm.common import ddl, whole_text, widened
from clickpath.runtime import stored

# What HTML itself says about its elements
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noframes".split())
BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th
thead tr ul""".split())
CLOSES_P = BLOCK - frozenset("html body td th tr tbody thead tfoot li dt dd".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
             "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"},
         "th": {"table", "tr"}, "option": {"select"}}
# Elements and names that never hold an article's own text
SKIPPED = RAW | frozenset("""head nav footer aside form button select option input svg math canvas template object
embed audio video dialog menu""".split())
SKIPPED_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|notice|alert|popup|modal|nav\w*|menu|"
    r"breadcrumbs?|sidebar|aside|widget|footer|masthead|comments?|disqus|replies|respond|share|social|newsletter|"
    r"subscribe|related|pagination|pager|login|signup|search)(?:$|[\s_-])", re.I)
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
ARTICLE = frozenset(("article", "main"))

_TAG = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")
#: Levels of a site's tree, each a round over all pages; what lies deeper shares the fate of its ancestor there.
STYLE_DEPTH = 40
# Elements that may stand in head, and those of tables, whose end tags leave a cell
IN_HEAD = RAW | frozenset("base basefont bgsound link meta noscript noframes template title".split())
TABLE = frozenset("table tr tbody thead tfoot td th caption".split())
CELL = frozenset(("td", "th"))


class Node:
    __slots__ = ("tag", "look", "items", "skipped", "number")

    def __init__(self, tag: str, look: str = "", skipped: bool = False):
        self.tag, self.look, self.skipped = tag, look, skipped
        self.items: list[Node | str] = []  # children and texts in page order
        self.number = 0


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)} if raw.strip() else {}


def _skipped(tag: str, attributes: dict[str, str]) -> bool:
    if tag in SKIPPED or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    if attributes.get("role", "").lower() in SKIPPED_ROLES:
        return True
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    return bool(names.strip() and tag not in ("html", "body") and SKIPPED_NAMES.search(names))


def parse(page: str) -> Node:
    """A tolerant tree of the page: unclosed and misnested tags are mended as browsers mostly do."""
    root = Node("html")
    stack = [root]
    open_: Counter[str] = Counter()  # elements on the stack, so that a long stack is not searched in vain

    def close_to(depth: int) -> None:
        open_.subtract(n.tag for n in stack[depth:])
        del stack[depth:]

    def find(tags: set[str], stop: set[str] = frozenset()) -> int:
        if not any(open_[t] > 0 for t in tags):
            return 0
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag in tags:
                return depth
            if stack[depth].tag in stop:
                break
        return 0

    def add_text(text: str) -> None:
        if stack[-1].tag == "head" and text.strip():
            close_to(len(stack) - 1)
        stack[-1].items.append(html.unescape(text))

    at, end = 0, len(page)
    last = page.rfind(">")
    while at < end:
        m = _TAG.search(page, at) if at <= last else None
        if m is None:
            tail = page[at:]
            # a page cut inside a tag: what follows the last < is no text
            cut = re.search(r"<[/!?a-zA-Z][^>]*$", tail)
            add_text(tail[:cut.start()] if cut else tail)
            break
        if m.start() > at:
            add_text(page[at:m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag or tag == "html":
            continue
        if m[1]:
            depth = find({tag}, CELL if tag not in TABLE else frozenset())
            if depth:
                close_to(depth)
            continue
        if tag in CLOSES_P and (depth := find({"p"}, {"table", "td", "th", "button"})):
            close_to(depth)
        if tag in CLOSED_BY and (depth := find(CLOSED_BY[tag], SCOPE[tag])):
            close_to(depth)
        if tag not in IN_HEAD and (depth := find({"head"})):  # body and head need no tags of their own
            close_to(depth)
        attributes = _attributes(m[3])
        node = Node(tag, f"{tag} {attributes.get('class', '')}".strip(), _skipped(tag, attributes))
        parent = stack[-1]
        if tag == "header":  # the page's own, not that of an article
            node.skipped = node.skipped or not any(open_[t] > 0 for t in ARTICLE)
        parent.items.append(node)
        if tag in VOID or m[3].rstrip().endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            closing = re.compile(f"</{re.escape(tag)}\\b", re.I).search(page, at)
            at = page.find(">", closing.end()) + 1 or end if closing else end
            continue
        stack.append(node)
        open_[tag] += 1
    return root


def _clean(text: str) -> str:
    return _SPACE.sub(" ", text).strip()


def blocks_of(node: Node, cut: set[int] | frozenset = frozenset()) -> list[str]:
    """The text blocks under a node in page order, without skipped and cut branches."""
    out: list[str] = []
    inline: list[str] = []

    def flush() -> None:
        block = _clean("".join(inline))
        if block:
            out.append(block)
        inline.clear()

    # an entry is an iterator over a node's items and whether the node is a block of its own
    stack = [(iter(node.items), False)]
    while stack:
        items, own_block = stack[-1]
        item = next(items, None)
        if item is None:
            stack.pop()
            if own_block:
                flush()
        elif isinstance(item, str):
            inline.append(item)
        elif item.skipped or item.number in cut:
            if item.tag in BLOCK:
                flush()
        elif item.tag == "br":
            inline.append(" ")
        else:
            if item.tag in BLOCK:
                flush()
            stack.append((iter(item.items), item.tag in BLOCK))
    flush()
    return out


def _number(*parts: object) -> int:
    return xxhash.xxh3_64_intdigest(repr(parts)) - (1 << 63)


def style_nodes(root: Node) -> Iterator[tuple[int, int, int, str, int]]:
    """(node, parent, depth, what, value) of the page's place in its site's tree.

    ``what`` is "page" for the place itself, "style" with a hash of its
    sequence of children, or "text" with a hash of a text directly in it. A run of like children is one
    place: pages differ in how many paragraphs they have. Sets the nodes'
    numbers. The html element itself is the root of every site.
    """
    root.number = _number("html")
    level = [(root, 0, 0)]
    while level:
        following = []
        for node, parent, depth in level:
            yield node.number, parent, depth, "page", 0
            looks: list[str] = []
            for item in node.items:
                if isinstance(item, Node) and not item.skipped and (not looks or looks[-1] != item.look):
                    looks.append(item.look)
            style = _number(node.number, looks)
            if looks:
                yield node.number, parent, depth, "style", style
            place, last = -1, None
            for item in node.items:
                if isinstance(item, str):
                    text = _clean(item)
                    if text:
                        yield node.number, parent, depth, "text", _number(text)
                elif not item.skipped:
                    if item.look != last:
                        place, last = place + 1, item.look
                    item.number = _number(node.number, item.look) if depth == 0 else _number(style, place, item.look)
                    if depth + 1 < STYLE_DEPTH:
                        following.append((item, node.number, depth + 1))
        level = following


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][\w+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def importance(observed: DataFrame, damping: float = 0.9) -> DataFrame:
    """(host, node, pages, importance, most) of each place of each site's tree.

    observed: (host, node, parent, depth, what, value, body), where pages with
    the same ``body`` count as one, so that copies of an article don't make it
    look like layout. With m pages at a place:

    - presentation: entropy of its child sequences to base m, 1 if m is 1;
    - content: 1 - the mean over its distinct texts of the entropy of the pages
      that show it, log(pages) / log(m);
    - a place with children: (1 - d^l) * presentation + d^l * the mean over its
      children, l the number of child sequences; texts between the children
      count as one child.

    ``most`` is the largest importance at or under the place. Works level by
    level from the deepest, on rows per place and not per page; there are at
    most STYLE_DEPTH levels.
    """
    values = (observed.groupBy("host", "node", "parent", "depth", "what", "value")
              .agg(F.count_distinct("body").alias("c")))
    log = F.log(F.col("c").cast("double"))
    places = stored(
        values.groupBy("host", "node", "parent", "depth").agg(
            F.sum(F.when(F.col("what") == "style", F.col("c"))).alias("m"),
            F.sum(F.when(F.col("what") == "style", F.col("c") * log)).alias("c_log_c"),
            F.sum(F.when(F.col("what") == "style", 1)).alias("styles"),
            F.sum(F.when(F.col("what") == "text", 1)).alias("texts"),
            F.sum(F.when(F.col("what") == "text", log)).alias("text_log"),
            F.max(F.when(F.col("what") == "page", F.col("c"))).alias("pages")), "places")
    base = F.log(F.col("pages").cast("double"))
    places = (
        places
        .withColumn("own", F.when(F.col("pages") <= 1, F.lit(1.0))
                    .otherwise((F.log(F.col("m").cast("double")) - F.col("c_log_c") / F.col("m")) / base))
        .withColumn("content", F.when(F.col("pages") <= 1, F.lit(1.0))
                    .otherwise(1 - F.col("text_log") / F.col("texts") / base))
        .select("host", "node", "parent", "depth", "pages", "styles", "own", "content"))
    deepest = places.agg(F.max("depth")).collect()[0][0]
    done, below = [], None
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        level = places.where(F.col("depth") == depth)
        if below is None:
            level = level.withColumn("kids", F.lit(None).cast("double")).withColumn("under", F.lit(None).cast("double"))
        else:
            kids = (below.groupBy("host", F.col("parent").alias("node"))
                    .agg((F.sum(F.col("importance") * F.col("pages")) / F.sum("pages")).alias("kids"),
                         F.max("most").alias("under")))
            level = level.join(kids, ["host", "node"], "left")
        mean = F.when(F.col("kids").isNull(), F.col("content")).when(
            F.col("content").isNull(), F.col("kids")).otherwise((F.col("kids") + F.col("content")) / 2)
        weight = F.pow(F.lit(damping), F.coalesce(F.col("styles"), F.lit(0)))
        value = F.when(F.col("own").isNull(), mean).when(mean.isNull(), F.col("own")).otherwise(
            (1 - weight) * F.col("own") + weight * mean)
        below = stored(level.withColumn("importance", F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)))
                       .withColumn("most", F.greatest("importance", F.coalesce("under", F.lit(0.0))))
                       .select("host", "node", "parent", "pages", "importance", "most"), "level")
        done.append(below)
    if not done:
        return places.select("host", "node", "pages", F.col("own").alias("importance"), F.col("own").alias("most"))
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    return whole.drop("parent")


OBSERVED = "node long, parent long, depth int, what string, value long, body long"


def observe(pages: DataFrame) -> DataFrame:
    """(host, node, parent, depth, what, value, body): each page's nodes and texts as hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            hosts: list[str] = []
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                root = parse(page)
                body = _number(article_text(root))
                rows = [(*row, body) for row in style_nodes(root)]
                out += rows
                hosts += [host] * len(rows)
            yield pa.RecordBatch.from_pydict({"host": pa.array(hosts, pa.string())} | {
                name: pa.array([row[i] for row in out], kind) for i, (name, kind) in enumerate(
                    (("node", pa.int64()), ("parent", pa.int64()), ("depth", pa.int32()), ("what", pa.string()),
                     ("value", pa.int64()), ("body", pa.int64())))})

    return (pages.select(host_of(F.col("url")).alias("host"), whole_text("html").alias("html"))
            .mapInArrow(run, f"host string, {OBSERVED}"))


def article_text(root: Node, cut: set[int] | frozenset = frozenset()) -> str:
    """Blocks joined by an empty line; where the page marks an article, only what it marks."""
    marked: list[Node] = []

    def find(node: Node) -> None:
        for item in node.items:
            if isinstance(item, Node) and not item.skipped and item.number not in cut:
                if item.tag in ARTICLE:
                    marked.append(item)
                else:
                    find(item)

    find(root)
    blocks = [b for node in marked for b in blocks_of(node, cut)]
    return "\n\n".join(blocks or blocks_of(root, cut))


def extract(pages: DataFrame, keep: list[str], least: float = 0.35, min_pages: int = 8) -> DataFrame:
    """``keep`` columns, text and n_chars of each page, a row per row.

    Reads url and html. A branch is cut if no place in it reaches ``least``
    importance and its root was seen on ``min_pages`` different pages; smaller
    sites are judged by their elements alone. Scripts, forms, menus and other
    elements that cannot hold an article never count. Null html gives an empty
    text; a null url is a site of its own, like any url without a host.
    Repeated rows get the same text. All pages of a host are counted, wherever
    they lie: counts are added up before the shuffle, so a host with most pages
    is one row per place, text and task.
    """
    noise = (importance(observe(pages))
             .where((F.col("most") < least) & (F.col("pages") >= min_pages))
             .groupBy("host").agg(F.collect_set("node").alias("_cut")))
    noise = stored(noise, "noise")
    rows = (pages.select(*keep, host_of(F.col("url")).alias("_host"), whole_text("html").alias("_html"))
            .join(noise.withColumnRenamed("host", "_host"), "_host", "left"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[list | None, set] = (None, set())
        for batch in batches:
            texts = []
            for page, cut in zip(batch.column("_html").to_pylist(), batch.column("_cut")):
                numbers = cut.as_py()
                if numbers != last[0]:
                    last = numbers, set(numbers or ())
                root = parse(page)
                if last[1]:
                    for _ in style_nodes(root):
                        pass
                texts.append(article_text(root, last[1]))
            yield widened(batch, keep, {"text": texts, "n_chars": list(map(len, texts))})

    return (rows.select(*keep, "_html", "_cut")
            .mapInArrow(run, f"{ddl(pages, keep)}, text string, n_chars long"))
