"""HTML extraction with a site style tree: pages of a host are merged, entropy tells template from content."""

from __future__ import annotations

import heapq
import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Scratch, read_table

#: Weight of presentation against content falls with a node's number of children; pages of a host that carry a node
#: from which on it can be judged; importance under which a branch is template.
GAMMA, LEAST_PAGES, TEMPLATE = 0.9, 5, 0.3
#: Rows of the importance table up to which it is broadcast (some 40 bytes each); beyond, pages are joined by host, those
#: of a host in parts of about PART_PAGES.
BROADCAST_ROWS, PART_PAGES = 200_000, 20_000

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label map mark q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr".split()
)
#: An opening tag ends an open element of these tags, up to the nearest container that holds such elements.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr",), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
SCOPES = frozenset("ul ol dl table select div article section main aside nav footer header body".split())
#: What the main text leaves out, by element, by role attribute, and by a part of the class or id.
NOISE_TAGS = frozenset("head script style noscript template nav aside footer form button select textarea iframe object dialog menu svg canvas audio video".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsored sponsor promo promotion banner nav navbar navigation menu menus breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent notice popup modal newsletter subscribe signup social share sharing related recommended comment comments disqus widget widgets".split()
)
#: What such a name may say besides: where the part is, or that it is one.
PLAIN_WORDS = frozenset("site page the main primary secondary global top bottom left right upper lower inner outer list lists area bar box wrap wrapper container block section panel module unit slot item items row column group header body content form links link buttons button icons post posts article articles entry js".split())
#: Elements that a name can make noise: parts of the page, not its headings, paragraphs and words.
NAMED = frozenset("div section ul ol dl li table td tr figure details fieldset center header".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN = frozenset(("article", "main"))
#: Parts of an article that may repeat from page to page and still be its own: they go with a template branch around them only.
FIXED = HEADINGS | frozenset("ul ol dl li dt dd table caption thead tbody tfoot tr td th figcaption pre".split())
#: What is not rendered at all, and so does not part the text around it.
UNSEEN = frozenset("script style noscript template".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[^\W_]+")


@dataclass(slots=True, eq=False)
class Node:
    """An element: its part (tag with classes and id), children, and pieces of own text between them."""

    tag: str
    part: str
    noise: bool
    parent: Node | None
    items: list = field(default_factory=list)  # Node or str, in page order
    weak: bool = False  # noise by a part of class or id, or as a form, alone


@dataclass(slots=True, eq=False)
class Block:
    """A block element without noise: blocks and runs of text (finished: decoded, white space made one), in page order."""

    tag: str
    part: str
    parent: Block | None
    items: list = field(default_factory=list)


def hashed(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def path_of(parent: int, part: str, place: str = "") -> int:
    """The key of the child at a place among its parent's children of the same part: of fixed size however deep the page is."""
    return hashed(f"{parent}/{part}/{place}")


def says_noise(names: list[str]) -> bool:
    """Whether one of some classes and ids is made of noise words, and words that only say where or that it is a part."""
    for name in names:
        words = _PART.findall(name)
        if any(w in NOISE_WORDS for w in words) and all(w in NOISE_WORDS or w in PLAIN_WORDS or w.isdigit() for w in words):
            return True
    return False


def parse(page: str | None) -> Node:
    """The element tree. Unclosed and misplaced tags are mended as far as block structure needs; nothing raises."""
    root = Node("", "", False, None)
    page, here, at = page or "", root, 0
    opened: Counter = Counter()  # open elements by tag: looking for one that is not open would walk up the whole page

    def leave(node: Node) -> None:
        nonlocal here
        while here is not node:
            opened[here.tag] -= 1
            here = here.parent

    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None:
            here.items.append(page[at:])
            break
        if m.start() > at:
            here.items.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            node = here if opened[tag] else root
            while node is not root and node.tag != tag:
                # An inline end tag does not end blocks that it stands in.
                if tag in INLINE and node.tag not in INLINE:
                    node = root
                    break
                node = node.parent
            if node is not root:
                leave(node.parent)
            continue
        if tag not in INLINE:
            ends = ("p", *CLOSES.get(tag, ()))
            node = here
            while node is not root and (node.tag in INLINE or node.tag in ends) and any(opened[t] for t in ends):
                above = node.parent
                if node.tag in ends:
                    leave(above)
                node = above
        names, role = "", ""
        if m[3] and "=" in m[3]:
            for a in _ATTRIBUTE.finditer(m[3]):
                value = (a[2] or a[3] or a[4] or "").lower()
                if a[1].lower() == "role":
                    role = value
                else:
                    names += " " + value
        strong = tag in NOISE_TAGS and tag != "form" or role in NOISE_ROLES or tag == "header"
        weak = not strong and (tag == "form" or tag in NAMED and says_noise(names.split()))
        node = Node(tag, ".".join((tag, *names.split())), strong or weak, here, weak=weak)
        here.items.append(node)
        if tag in VOID or m[3].endswith("/") and tag in ("svg", "path"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            at = page.find(">", end.start()) + 1 or len(page) if end else len(page)
            continue
        opened[tag] += 1
        here = node
    _spare(root)
    return root


def _spare(root: Node) -> None:
    """Noise by a class part or as a form alone is none around the main text; what is left is for the style tree to judge.

    That is, if it holds most of the text of all article and main elements, or any while none is outside noise; on a page
    without such elements, if it holds most of the page's text. Comments that are articles stay noise beside a longer
    story. Text inside what is noise for a better reason counts for nothing.
    """
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.noise and not node.weak:
            continue
        order.append(node)
        stack += [x for x in node.items if isinstance(x, Node)]
    if not any(node.weak for node in order):
        return
    size: dict[int, int] = {}
    main: dict[int, int] = {}
    for node in reversed(order):
        size[id(node)] = sum(len("".join(x.split())) if isinstance(x, str) else size.get(id(x), 0) for x in node.items)
        main[id(node)] = size[id(node)] if node.tag in MAIN else sum(main.get(id(x), 0) for x in node.items if isinstance(x, Node))
    held = main if main[id(root)] else size
    holds = {id(node) for node in order if any(isinstance(x, Node) and (x.tag in MAIN or id(x) in main and main[id(x)]) for x in node.items)}
    for node in order:
        if node.weak and (held is size or id(node) in holds) and 2 * held[id(node)] > held[id(root)]:
            node.noise = False
    if held is main and not any(size.get(id(x)) for x in main_parts(root)):
        for node in order:
            if node.weak and node.tag not in MAIN and not _inside_main(node) and main[id(node)]:
                node.noise = False


def _inside_main(node: Node | None) -> bool:
    while node is not None:
        if node.tag in MAIN:
            return True
        node = node.parent
    return False


def main_parts(root: Node) -> list[Node]:
    """The outermost article and main elements outside noise, in page order."""
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.noise:
            continue
        if node.tag in MAIN:
            found.append(node)
        else:
            stack += [x for x in reversed(node.items) if isinstance(x, Node)]
    return found


def outline(nodes: list[Node]) -> Block:
    """The blocks below the nodes, without noise and without blocks that hold no text."""
    whole = here = Block("", "", None)
    piece: list[str] = []

    def end() -> None:
        if text := " ".join(html.unescape("".join(piece)).split()):
            here.items.append(text)
        piece.clear()

    for top in nodes:
        stack: list = [top]
        while stack:
            x = stack.pop()
            if x is None:
                end()
                here = here.parent
                if not here.items[-1].items:
                    here.items.pop()
            elif isinstance(x, str):
                piece.append(x)
            elif x.noise:
                if x.tag not in INLINE and x.tag not in UNSEEN:
                    end()
                if x.tag == "header" and _inside_main(x):
                    stack += reversed(_headings(x))
            elif x.tag == "br":
                piece.append(" ")
            elif x.tag in INLINE:
                stack += reversed(x.items)
            else:
                end()
                inner = Block(x.tag, x.part, here)
                here.items.append(inner)
                here = inner
                stack.append(None)
                stack += reversed(x.items)
        end()
    return whole


def _headings(header: Node) -> list[Node]:
    """The headings of an article's header, in page order: its title stays, bylines and bars go."""
    found, stack = [], list(reversed(header.items))
    while stack:
        node = stack.pop()
        if not isinstance(node, str) and node.tag in HEADINGS:
            found.append(node)
        elif not isinstance(node, str) and not (node.noise and node.tag != "header"):
            stack += reversed(node.items)
    return found


def places(whole: Block) -> Iterator[tuple[Block, tuple[int, int], list[tuple[int, int]]]]:
    """Every block with its two keys and those of its items, parents first.

    A style node is a child at a place in its parent's sequence of children, below the parent's own place: one key counts
    places from the front at every level, the other from the back, so pages of different length agree on what stands
    at either end. Siblings of the same tag and names are different nodes.
    """
    stack = [(whole, (0, 0))]
    while stack:
        block, (front, back) = stack.pop()
        parts = [x.part if isinstance(x, Block) else "#text" for x in block.items]
        left, seen, keys = Counter(parts), Counter(), []
        for part in parts:
            keys.append((path_of(front, part, str(seen[part])), path_of(back, part, str(-left[part]))))
            seen[part] += 1
            left[part] -= 1
        yield block, (front, back), keys
        stack += [(x, k) for x, k in zip(block.items, keys) if isinstance(x, Block)]


def style_rows(whole: Block) -> set[tuple[int, int, int, int]]:
    """(key, kind, value, page) for the style tree: kind 0 a block's sequence of children, kind 1 a run of text, by both keys.

    `page` tells pages apart by the longest other run of text: copies and near copies of a page count once, so what they
    share is not taken for what a host repeats. A page whose own words are all shorter than two of its template's runs is
    not told from its fellows, and keeps them.
    """
    found, texts = [], set()
    for block, own, keys in places(whole):
        if any(isinstance(x, Block) for x in block.items):
            sequence = hashed(",".join(x.part if isinstance(x, Block) else "#text" for x in block.items))
            found += [(key, 0, sequence, None) for key in own]
        for x, both in zip(block.items, keys):
            if isinstance(x, str):
                texts.add(x)
                found += [(key, 1, hashed(x), x) for key in both]
    longest = heapq.nlargest(2, texts, key=lambda t: (len(t), t)) + [""] * 2
    first, second = hashed(longest[0]), hashed(longest[1])
    return {(key, kind, value, second if text == longest[0] else first) for key, kind, value, text in found}


def without_template(whole: Block, table: dict[tuple[int, int], float], inside: bool) -> list[str]:
    """The runs of text that are left when the highest branches of low importance are gone.

    A run's importance is what the table says of its words at its place (the lower of both keys; 1 if nothing), a block's
    (1 - GAMMA^l) times its presentation's plus GAMMA^l times the mean of its items', l its child blocks. A branch goes
    if its importance and that of each of its runs are under TEMPLATE, so nothing of a page's own goes with it. Headings
    alone never go, and of an article or main element (`inside`) no lists, table parts and preformatted text alone.
    """
    order = list(places(whole))
    state: dict[int, tuple[float, bool, bool]] = {}  # importance, whether every run is template, whether it may go
    runs: dict[int, list[float]] = {}
    stays = FIXED if inside else HEADINGS
    for block, own, keys in reversed(order):
        worth, solid, free, inner = [], True, False, 0
        mine = runs[id(block)] = []
        for x, both in zip(block.items, keys):
            if isinstance(x, str):
                value = hashed(x)
                mine.append(min(table.get((key, value), 1.0) for key in both))
                w, s, f = mine[-1], mine[-1] < TEMPLATE, True
            else:
                w, s, f = state[id(x)]
                inner += 1
            worth.append(w)
            solid, free = solid and s, free or f
        g = GAMMA**inner
        shape = min(table.get((key, 0), 1.0) for key in own)
        state[id(block)] = ((1 - g) * shape + g * (sum(worth) / len(worth) if worth else shape), solid, free and block.tag not in stays)
    out: list[str] = []
    stack: list = [(whole, False, True)]
    while stack:
        x, fixed, keep = stack.pop()
        if isinstance(x, str):
            if keep:
                out.append(x)
            continue
        worth, solid, free = state[id(x)]
        if x.parent is not None and x.tag not in MAIN and x.tag not in ("", "html", "body") and not fixed and solid and free and worth < TEMPLATE:
            continue
        fixed = fixed or x.tag in stays
        own = iter(runs[id(x)])
        stack += reversed([(y, fixed, True) if isinstance(y, Block) else (y, fixed, next(own) >= TEMPLATE or fixed) for y in x.items])
    return out


def main_blocks(page: str | None) -> tuple[Block, bool]:
    """What is not noise of the article or main elements if there are any, else of the page; and whether there are."""
    root = parse(page)
    parts = main_parts(root)
    return outline(parts or [root]), bool(parts)


def main_text(page: str | None, table: dict[tuple[int, int], float] | None = None) -> str:
    """The main text: what is neither noise nor template of the article or main elements if there are any, else of the page.

    If the template's removal would leave nothing, its branches are kept.
    """
    whole, inside = main_blocks(page)
    return "\n".join(table and without_template(whole, table, inside) or without_template(whole, {}, inside))


def site_style_tree(scratch: Scratch, pages: DataFrame, host: str = "host", html_col: str = "html") -> DataFrame:
    """The importance table: host, key, value, worth, pages. A row without an entry is of importance 1.

    With m the pages of a host that have a node: presentation (value 0) is the entropy of the node's sequences of children over
    these pages to the base m, so one sequence everywhere gives 0. A run of text (value: its hash) at a node is a feature
    spread evenly over the n pages that have it there: 1 less that entropy, 1 - log_m n, so the same words everywhere give 0.
    Only nodes of LEAST_PAGES pages or more, and of texts those under TEMPLATE, are rows. All are sums over distinct values,
    counted map-side first, so a host with a third of all pages is no larger task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out += [(name, *row) for row in style_rows(main_blocks(page)[0])]
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int8(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["host", "key", "kind", "value", "page"])

    rows = pages.select(F.xxhash64(host).alias("host"), html_col).mapInArrow(run, "host long, key long, kind byte, value long, page long")
    counts = scratch.cut(rows.groupBy("host", "key", "kind", "value").agg(F.count_distinct("page").alias("n")), "style")
    nodes = counts.groupBy("host", "key", "kind").agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("n_log_n")).filter(F.col("pages") >= LEAST_PAGES)
    m = F.log("pages")
    shapes = nodes.filter("kind = 0").select("host", "key", F.lit(0).cast("long").alias("value"), (1 - F.col("n_log_n") / F.col("pages") / m).alias("worth"), "pages").filter("worth < 1")
    # Under TEMPLATE are values on more than m^(1 - TEMPLATE) pages: for the fewest pages that are judged, and so for all, on some.
    some = counts.filter((F.col("kind") == 1) & (F.col("n") > LEAST_PAGES ** (1 - TEMPLATE)))
    texts = some.join(nodes.filter("kind = 1").select("host", "key", "pages"), ["host", "key"])
    return shapes.unionByName(texts.select("host", "key", "value", (1 - F.log("n") / m).alias("worth"), "pages").filter(F.col("worth") < TEMPLATE))


def host_of(url):
    """A URL column's host, lower-cased, without user and port; the empty text where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def extract(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every page, the main text extracted with its host's style tree.

    Null, empty and text-free html gives the empty text. Pages without a host (null or odd URLs) are merged as one. A
    page of few fellows, or of a host with one page, is judged by its elements alone. Copies and near copies count as one
    page. Repeated rows stay rows. An empty
    table gives no rows. Other columns of `pages` are not read.
    """
    scratch = Scratch(spark, "html")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    table = scratch.cut(site_style_tree(scratch, rows), "importance")
    # A host's distinct template nodes, not its pages. Hosts without template texts have nothing that could go.
    entries = table.groupBy("host").agg(F.collect_list(F.struct("key", "value", "worth")).alias("nodes"), F.max("pages").alias("pages"), F.count_if(F.col("value") != 0).alias("texts")).filter("texts > 0")
    rows = rows.withColumn("host", F.xxhash64("host"))
    if table.count() <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(entries.select("host", "nodes")), "host", "left")
    else:
        # By host, large hosts in parts: their number is at most that of all pages by PART_PAGES.
        parted = entries.select("host", "nodes", F.ceil(F.col("pages") / PART_PAGES).alias("parts"))
        large = F.broadcast(parted.filter("parts > 1").select("host", "parts"))
        mine = rows.join(large, "host", "left").withColumn("part", F.pmod(F.xxhash64("url"), F.coalesce("parts", F.lit(1)))).drop("parts")
        joined = mine.join(parted.select("host", "nodes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")), ["host", "part"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, hosts, known = [], batch.column("host").to_pylist(), {}
            for i, (name, page) in enumerate(zip(hosts, batch.column("html").to_pylist())):
                if name not in known:
                    nodes = batch.column("nodes")[i].as_py() or []
                    known[name] = {(x["key"], x["value"]): x["worth"] for x in nodes}
                texts.append(main_text(page, known[name]))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = dict(rows.dtypes)
    return joined.select("page_id", "url", "html", "host", "nodes").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark, read_table(spark, sf_dir, "pages"))
