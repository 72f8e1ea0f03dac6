"""Main text of web pages by a site style tree.

First pass: the DOMs of all different pages of a host are merged; copies of a page, by a
digest of its html, are one page of the tree, and its verdicts hold for all of them. A node of the merged tree is a
path of block elements with their classes; it holds the presentation styles (sequences
of child elements) and the contents (texts) that pages show there, with their numbers
of pages. From their entropies follows a node's importance: a content that most pages
repeat tells little, as does a node that always looks the same. Counts are combined per
batch and per task before they are shuffled, so a host with a third of all pages sends
one row per distinct style or content and task.

Second pass: branches of low importance are removed from each page, as are elements
whose name, role or class says that they are menus, adverts, forms and the like. Pages
with an article or main element keep what stands in it. Only whole words of a class, id
or role decide, and never for an article, a main element or what encloses one, unless the
page has another that nothing of the kind encloses. Words that articles also use, and
words that are part of a longer name, decide nothing by themselves: the tree does, by the
threshold that holds outside articles.

A node is judged only on hosts with `LEAST_PAGES` different pages or more that show it,
and not on hosts where all contents repeat.

Defined cases: null or empty html has an empty text; pages without a host form one
site; broken markup is read leniently; repeated rows get equal texts; an empty table
gives an empty result; only the id, url and html columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from zlib import crc32

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgrain.llm.common import ship_package, small_side, stored

LEAST_PAGES = 10
#: Importance below which a branch goes: outside an article, and inside one.
LOW_OUTSIDE, LOW_INSIDE = 0.35, 0.1
#: Weight of contents against presentation.
GAMMA = 0.9

# Element names by what they mean for the text.
SILENT = frozenset("script style noscript template svg math head title iframe object embed canvas audio video select option datalist textarea".split())
NOISE = frozenset("nav footer aside form menu dialog button input label fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr br".split()
)
CLOSES = {
    "p": frozenset("p".split()), "li": frozenset("li p".split()), "dt": frozenset("dt dd p".split()), "dd": frozenset("dt dd p".split()),
    "tr": frozenset("tr td th p".split()), "td": frozenset("td th p".split()), "th": frozenset("td th p".split()),
}
#: Elements before which an open paragraph ends.
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul figure figcaption".split()
)
CONTAINERS = frozenset("ul ol dl table tbody thead tfoot article section div main body html blockquote".split())
# Words in class, id and role that name what is no article.
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb "
    "breadcrumbs sidebar footer masthead cookie cookies consent gdpr notice popup modal newsletter subscribe signup "
    "social share sharing related recommended comment comments disqus respond pager pagination toolbar login search "
    "complementary contentinfo alert dialog".split()
)
#: Of these, words that parts of an article also have.
AMBIGUOUS = frozenset("banner promo promotion notice alert dialog social search consent comment respond".split())
NAMED = NOISE_WORDS - AMBIGUOUS
_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<(?P<raw>script|style|noscript|template|textarea|title)\b[^>]*>.*?(?:</(?P=raw)\s*>|$)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*>",
    re.S | re.I,
)
_ATTRS = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile(r"\s+")
_PARTS = re.compile(r"[^a-z0-9]+")


class Block:
    """A block of text, the path it stands at and where that is.

    `doubtful` blocks stand in an element whose name may mean noise.
    """

    __slots__ = ("path", "parent", "noise", "inside", "doubtful", "text")

    def __init__(self, path: str, parent: str, noise: bool, inside: bool, doubtful: bool, text: str):
        self.path, self.parent, self.noise, self.inside, self.doubtful, self.text = path, parent, noise, inside, doubtful, text


class Place:
    """An open element.

    `named` numbers the elements around it, itself included, whose words mean noise;
    `root` is what `named` was for the outermost article or main element, and `within`
    says whether an article is among those.
    """

    __slots__ = ("name", "path", "noise", "named", "root", "within", "doubtful")

    def __init__(self, name: str, path: str, noise: bool, named: frozenset[int], root: frozenset[int] | None, within: bool, doubtful: bool):
        self.name, self.path, self.noise, self.named, self.root, self.within, self.doubtful = name, path, noise, named, root, within, doubtful


def parse(page: str) -> tuple[list[Block], dict[str, list[str]]]:
    """Blocks of a page in order, and the child elements of each block element."""
    found: list[tuple[Place, str]] = []
    children: dict[str, list[str]] = {}
    stack = [Place("", "", False, frozenset(), None, False, False)]
    # what names noise around each main element, and around each article that is in no other
    mains: list[frozenset[int]] = []
    articles: list[frozenset[int]] = []
    pending: list[str] = []

    def flush() -> None:
        if pending:
            text = _SPACE.sub(" ", unescape("".join(pending))).strip()
            pending.clear()
            if text:
                found.append((stack[-1], text))

    def spill(text: str) -> None:
        if text and stack[-1].name not in SILENT:
            pending.append(text)

    def pop(depth: int) -> None:
        if any(e.name not in INLINE for e in stack[depth:]):
            flush()
        del stack[depth:]

    last = 0
    for m in _TOKEN.finditer(page):
        if m.start() > last:
            spill(page[last : m.start()])
        last = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["end"]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].name == name:
                    pop(depth)
                    break
            continue
        if name in ("br", "hr"):
            pending.append(" ")
        if name not in INLINE:
            closes = CLOSES.get(name, frozenset()) | ({"p"} if name in ENDS_PARAGRAPH else frozenset())
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].name in closes:
                    pop(depth)
                elif stack[depth].name in CONTAINERS:
                    break
            flush()
        if name in VOID:
            continue
        top = stack[-1]
        path, noise, named, root, within, doubtful = top.path, top.noise, top.named, top.root, top.within, top.doubtful
        marks = ""
        if m["attrs"]:
            marks = " ".join(a or b or c for _, a, b, c in _ATTRS.findall(m["attrs"])).lower()
        if not noise:
            noise = name in NOISE or name in SILENT or (name == "header" and root is None)
            if name in ("article", "main"):
                if not noise:
                    if name == "main":
                        mains.append(named)
                    elif not within:
                        articles.append(named)
                    root = named if root is None else root
                    doubtful = doubtful and within
                    within = within or name == "article"
            elif marks and not noise and name not in ("html", "body"):
                if not NAMED.isdisjoint(marks.split()):
                    named = named | {m.start()}
                elif not NOISE_WORDS.isdisjoint(_PARTS.split(marks)):
                    doubtful = True
        if name not in INLINE:
            step = f"{name}.{marks}" if marks and name not in ("html", "body") else name
            children.setdefault(path, []).append(step)
            path = f"{path}/{step}"
        stack.append(Place(name, path, noise, named, root, within, doubtful))
        if m["attrs"].endswith("/") and name in ("svg", "path"):
            stack.pop()
    if last < len(page):
        spill(page[last:])
    flush()
    around_main = frozenset().union(*mains)
    forgiven = around_main
    if all(a - around_main for a in articles):
        forgiven = forgiven.union(*articles)
    blocks = [
        Block(p.path, p.path.rpartition("/")[0], p.noise or bool(p.named - forgiven), p.root is not None and p.root <= around_main, p.doubtful, text)
        for p, text in found
    ]
    return blocks, children


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^\s*[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def _key(text: str) -> int:
    data = text.encode("utf-8", "surrogatepass")
    return crc32(data) << 32 | crc32(data[::-1])


PAGE, STYLE, CONTENT = 0, 1, 2


def site_counts(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, node, kind, feature, n): in how many different pages of a host a node shows a feature."""
    ship_package(pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts: Counter = Counter()
            for host, page in zip(batch["host"], batch["html"], strict=True):
                seen = set()
                blocks, children = parse(page or "")
                for b in blocks:
                    node = _key(b.path)
                    seen.add((node, PAGE, 0))
                    seen.add((node, CONTENT, _key(b.text)))
                    style = children.get(b.parent, ())
                    # runs of one element count once, so a list's length is no style
                    shape = [s for k, s in enumerate(style) if not k or style[k - 1] != s]
                    seen.add((node, STYLE, _key("|".join(shape))))
                counts.update((host, *s) for s in seen)
            rows = list(zip(*[(*k, n) for k, n in counts.items()], strict=True)) or [[]] * 5
            yield pd.DataFrame(dict(zip(("host", "node", "kind", "feature", "n"), rows, strict=True))).astype({"node": "uint64", "feature": "uint64"}).astype({"node": "int64", "feature": "int64"})

    slim = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    # copies meet by their digest and are combined per task before they are shuffled
    distinct = slim.withColumn("digest", F.sha2("html", 256)).dropDuplicates(["host", "digest"]).select("host", "html")
    rows = distinct.mapInPandas(run, "host string, node bigint, kind int, feature bigint, n bigint")
    return rows.groupBy("host", "node", "kind", "feature").agg(F.sum("n").alias("n"))


def importance(counts: DataFrame) -> DataFrame:
    """(host, node, pages, importance): contents and presentation weighed by GAMMA.

    A content on k of m pages has the entropy log k / log m; the contents of a node
    count alike. The presentation's entropy is that of its styles.
    """
    features = counts.where(F.col("kind") != PAGE)
    sizes = counts.where(F.col("kind") == PAGE).select("host", "node", F.col("n").alias("pages"))
    parts = features.groupBy("host", "node").agg(
        F.sum(F.when(F.col("kind") == CONTENT, F.log("n"))).alias("log_content"),
        F.count_if(F.col("kind") == CONTENT).alias("contents"),
        F.sum(F.when(F.col("kind") == STYLE, F.col("n") * F.log("n"))).alias("log_style"),
    )
    log_m = F.log("pages")
    content = 1 - F.col("log_content") / F.col("contents") / log_m
    # - sum p log p with p = n / m is log m - sum n log n / m
    style = F.greatest(F.lit(0.0), (log_m - F.col("log_style") / F.col("pages")) / log_m)
    return parts.join(sizes, ["host", "node"]).select(
        "host", "node", "pages", F.when(F.col("pages") > 1, GAMMA * content + (1 - GAMMA) * style).otherwise(F.lit(1.0)).alias("importance")
    )


def low_nodes(nodes: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, low, lowest): nodes below LOW_OUTSIDE and below LOW_INSIDE, one stored row per host.

    A row holds nodes of templates, not of pages: a node counts from `least_pages` on.
    """
    best = nodes.where(F.col("pages") >= least_pages).groupBy("host").agg(
        F.collect_set(F.when(F.col("importance") < LOW_OUTSIDE, F.col("node"))).alias("low"),
        F.collect_set(F.when(F.col("importance") < LOW_INSIDE, F.col("node"))).alias("lowest"),
        F.max("importance").alias("best"),
    )
    return stored(best.where((F.col("best") >= 0.5) & (F.size("low") > 0)).select("host", "low", "lowest"), "style-tree")


def main_text(page: str | None, low: frozenset[int], lowest: frozenset[int]) -> str:
    """Text of the blocks that stay, one per line."""
    blocks = [b for b in parse(page or "")[0] if not b.noise]
    article = any(b.inside for b in blocks)
    if article:
        blocks = [b for b in blocks if b.inside]
    out = ((b, lowest if article and not b.doubtful else low) for b in blocks)
    return "\n".join(b.text for b, cut in out if not (cut and _signed(b.path) in cut))


def _signed(path: str) -> int:
    key = _key(path)
    return key - (1 << 64) if key >> 63 else key


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    tree = low_nodes(importance(site_counts(pages, url_col, html_col)))
    slim = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    known = small_side(tree.withColumnRenamed("host", "site"), 4000)
    joined = slim.withColumn("host", host_of(F.col("url"))).join(known, F.col("host") == F.col("site"), "left").select("page_id", "url", "html", "low", "lowest")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            for page, low, lowest in zip(batch["html"], batch["low"], batch["lowest"], strict=True):
                texts.append(main_text(page, frozenset(low if low is not None else ()), frozenset(lowest if lowest is not None else ())))
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    kinds = dict(slim.dtypes)
    return joined.mapInPandas(run, f"page_id {kinds['page_id']}, url string, text string, n_chars bigint")
