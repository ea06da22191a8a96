"""Main text of web pages by site style trees.

The pages of a host are merged into one style tree. A node of it is a path of
elements (names with class and id); it knows in how many ways its children are
arranged (presentation) and how its texts spread over the pages (content).
Following the entropy measure, a node that looks and reads the same on every
page is of low importance and one that varies is of high; the composite
importance of a branch mixes that of its top and its texts. Branches of low
importance are removed from each page of the host.

Importance is smoothed: a node counts as important until the pages it is on
outweigh that, so a host of any size is judged, and what is the same on three
different pages goes.

Importance cannot tell a menu or an advert that varies from page to page from
text. So branches whose element name, class, id or role says what they are go
whatever their importance, and where a page marks its article, text outside of
it goes. Neither rule may empty a page: words that also name what a page is
about count only where there is other text, and an article that is the smaller
part of the page's main element is a teaser beside the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.tables import fresh, read_table, without
from pairloom.llm.url_templates import url_host
from pairloom.workspace import materialize

MIN_IMPORTANCE = 0.2
PRIOR_PAGES = 0.7  # pages of full importance that every node is taken to have been on before
MOST = 0.8  # share of a page's text that is on other pages too if the page is a copy of them
DAMPING = 0.9  # weight of what lies below a node, to the power of its depth
MAX_DEPTH = 64  # elements below this depth count as part of that at it

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select "
    "summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("br body caption dd dt head html legend li option summary tbody td tfoot th thead tr".split())
# An element that ends open ones of these names, unless one of the second names lies between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}), "option": ({"option"}, {"select", "datalist"}),
    "tfoot": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}), "body": ({"head"}, {"html"}),
}

# Elements that are never main text.
NOISE_TAGS = frozenset(
    "head script style title noscript template nav aside footer form button select option input textarea iframe object "
    "embed svg canvas math audio video map dialog menu datalist xmp noembed noframes".split()
)
NOISE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status".split()
)
# Words of a class or id that say what a branch is: these also if it holds an article element, ...
HARD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot sponsor sponsored promo promotion comment "
    "comments commentlist disqus respond replies reply discussion related recommended popup modal overlay".split()
)
# ... these only if it doesn't, as they are also used of a page's layout, ...
SOFT_WORDS = frozenset(
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars widget widgets footer cookie cookies consent "
    "gdpr notice notices notification alert newsletter subscribe subscription signup login share sharing social pagination "
    "pager copyright legal disclaimer skip hidden".split()
)
# ... these of both kinds only on pages that have other text, as they also name what a page is about, ...
TOPIC_WORDS = frozenset("legal disclaimer copyright notice notices alert newsletter discussion promotion".split())
# ... and these only outside of articles, which have headings of their own.
OUTER_WORDS = frozenset("header masthead topbar toolbar banner banners".split())
NONE, SOFT, HARD = 0, 1, 2

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?>[\s/]+|=|[^\s/>=]++(?>\s*=\s*(?>\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*+)?)?)*+)>"
    r"|<[!?/][^>]*>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s/>=\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORD = re.compile(r"[A-Za-z][a-z]+|[A-Z]+(?![a-z])|[a-z]+")
_DIGITS = re.compile("[0-9]+")  # of a class or id, as they may number the pages
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class Block:
    """A stretch of text that no block element interrupts.

    ``article``: 2 in an article, 1 in the main part, else 0. ``doubt``: in a
    branch that only a word of ``TOPIC_WORDS`` calls noise.
    """

    __slots__ = ("path", "text", "article", "doubt")

    def __init__(self, path: tuple[str, ...], text: str, article: int, doubt: bool):
        self.path, self.text, self.article, self.doubt = path, text, article, doubt


def _noise(name: str, attributes: dict[str, str], in_article: bool) -> tuple[int, bool]:
    """Whether an element is noise by itself, and if so, whether that is in doubt."""
    if name in NOISE_TAGS or name == "header" and not in_article:
        return HARD, False
    if not attributes:
        return NONE, False
    hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true"
    if hidden or _HIDDEN.search(attributes.get("style", "").lower()) or attributes.get("role", "").lower() in NOISE_ROLES:
        return HARD, False
    if name in ("html", "body"):
        return NONE, False
    words = {w.lower() for w in _WORD.findall(attributes.get("class", "") + " " + attributes.get("id", ""))}
    doubt = name in BLOCK and not words & ((HARD_WORDS | SOFT_WORDS | OUTER_WORDS) - TOPIC_WORDS)
    if words & HARD_WORDS:
        return HARD, doubt
    soft = name not in ("article", "main") and (words & SOFT_WORDS or not in_article and words & OUTER_WORDS)
    return (SOFT, doubt) if soft else (NONE, False)


def parse(html: str) -> tuple[list[Block], dict[tuple[str, ...], set[str]]]:
    """The text blocks of a page in order, and the names of the children below each path of elements."""
    blocks: list[Block] = []
    children: dict[tuple[str, ...], set[str]] = {}
    # name, path, noise, article, whether the noise is in doubt
    stack: list[tuple[str, tuple[str, ...], int, int, bool]] = [("", (), NONE, 0, False)]
    parts: list[str] = []
    start = stack[0]  # where the block began

    def flush() -> None:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                blocks.append(Block(start[1], text, start[3], start[4]))
            parts.clear()

    def add(text: str) -> None:
        nonlocal start
        top = stack[-1]
        if top[2] and not top[4] or not parts and not text.strip():
            return
        if not parts:
            start = stack[-1]
        parts.append(text)

    def pop_to(depth: int) -> None:
        if any(entry[0] in BLOCK for entry in stack[depth:]):
            flush()
        del stack[depth:]

    position, size = 0, len(html)
    while position < size:
        found = _TOKEN.search(html, position)
        if not found:
            add(html[position:])
            break
        if found.start() > position:
            add(html[position : found.start()])
        position = found.end()
        name = found["name"]
        if name is None:
            continue
        name = name.lower()
        if found["end"]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == name:
                    pop_to(depth)
                    break
            else:
                if name in ("p", "br"):
                    flush()
            continue
        if name in CLOSES_P:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == "p":
                    pop_to(depth)
                    break
                if stack[depth][0] in ("td", "th", "table", "button", "caption"):
                    break
        ended, kept = ENDS.get(name, ((), ()))
        if ended:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] in kept:
                    break
                if stack[depth][0] in ended:
                    pop_to(depth)
        if name in BLOCK:
            flush()
        _, path, noise, article, doubt = stack[-1]
        rest = found["rest"]
        attributes = {}
        if rest and not rest.isspace():
            for key, a, b, c in _ATTRIBUTE.findall(rest):
                attributes.setdefault(key.lower(), unescape(a or b or c))
        label = name
        if "class" in attributes or "id" in attributes:
            label = f"{name}.{_DIGITS.sub('', attributes.get('class', ''))}#{_DIGITS.sub('', attributes.get('id', ''))}"
        children.setdefault(path, set()).add(label)
        if name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(html, position)
            position = close.end() if close else size
            continue
        if name in VOID:
            continue
        path = path + (label,) if len(path) < MAX_DEPTH else path
        children.setdefault(path, set())
        inner = max(article, 2 if name == "article" else name == "main")
        if inner > article and noise == SOFT:
            noise = NONE
        own, own_doubt = _noise(name, attributes, article > 0)
        doubt = (noise == NONE or doubt) and (own == NONE or own_doubt) and max(noise, own) > NONE
        stack.append((name, path, max(noise, own), int(inner), doubt))
    flush()
    return blocks, children


def _join(path: tuple[str, ...]) -> str:
    return "\x1f".join(path)


def _size(blocks: list[Block]) -> int:
    return sum(len(b.text) for b in blocks)


def _marked(blocks: list[Block]) -> list[Block]:
    """The blocks of a page that its marks leave: the article, else the main part, else all.

    Where the article is less than half of the main part, the whole main part
    stays. Blocks in doubt stay if there are no others.
    """
    sure = [b for b in blocks if not b.doubt] or blocks
    inmost = max((b.article for b in sure), default=0)
    kept = [b for b in sure if b.article == inmost]
    main = [b for b in sure if b.article]
    return main if 2 * _size(kept) < _size(main) else kept


def main_text(html: str | None, noisy: frozenset[str]) -> str:
    """The blocks of a page that are main text, joined by line breaks; ``noisy`` are paths of low importance.

    If these would take more than ``MOST`` of the text, the tree has judged copies of one page, and all of it stays.
    """
    kept = _marked(parse(html or "")[0])
    important = [b for b in kept if _join(b.path) not in noisy] if noisy else kept
    return "\n".join(b.text for b in (important if _size(important) >= (1 - MOST) * _size(kept) else kept))


def _short(text: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _tree_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for host, html in zip(batch["host"], batch["html"]):
            blocks, children = parse(html or "")
            blocks = [b for b in blocks if not b.doubt] or blocks
            page = _short("\n".join(b.text for b in blocks))
            for path, names in children.items():
                rows.append((host, page, _join(path), "style", _short("\n".join(sorted(names)))))
            for path, text in {(b.path, b.text) for b in blocks}:
                rows.append((host, page, _join(path), "text", _short(text)))
        yield pd.DataFrame(rows, columns=["host", "page", "path", "kind", "feature"])


def node_importance(pages: DataFrame) -> DataFrame:
    """(host, path, n_pages, importance): the composite importance of each node of each host's style tree.

    ``pages`` has host and html. Equal pages count once. With m pages that have
    the node, all logarithms to the base m: presentation importance is the
    entropy of the sets of children found there; content importance is one less
    the mean entropy of the node's texts over the pages (0 for a text of one
    page, 1 for one of all). The composite importance of a node with children
    mixes its presentation with the contents of the whole branch by ``DAMPING``
    to the power of its depth; a node without children has its contents only.
    """
    rows = pages.mapInPandas(_tree_rows, "host string, page bigint, path string, kind string, feature bigint").distinct()
    # Summed where they are made: per host and path there remain as many rows as different features.
    spread = rows.groupBy("host", "path", "kind", "feature").agg(F.count("*").alias("n"))
    nodes = spread.groupBy("host", "path").agg(
        F.sum(F.when(F.col("kind") == "style", F.col("n"))).alias("n_pages"),
        F.sum(F.when(F.col("kind") == "style", F.col("n") * F.log("n"))).alias("styles"),
        F.max((F.col("kind") == "style") & (F.col("feature") != _short(""))).alias("inner"),
        F.count(F.when(F.col("kind") == "text", 1)).alias("texts"),
        F.sum(F.when(F.col("kind") == "text", F.log("n"))).alias("logs"),
    )
    shared = F.col("n_pages") > 1
    log_m = F.log(F.greatest("n_pages", F.lit(2)))
    nodes = nodes.withColumns(
        {
            "presentation": F.when(shared, 1 - F.col("styles") / (F.col("n_pages") * log_m)).otherwise(1.0),
            "content": F.when(F.col("texts") > 0, F.when(shared, F.col("texts") - F.col("logs") / log_m).otherwise(F.col("texts"))),
        }
    )
    steps = F.split("path", "\x1f")
    branch = (
        nodes.where("texts > 0")
        .select("host", "texts", "content", steps.alias("steps"), F.explode(F.sequence(F.lit(1), F.size(steps))).alias("depth"))
        .groupBy("host", F.array_join(F.slice("steps", 1, F.col("depth")), "\x1f").alias("path"), "depth")
        .agg((F.sum("content") / F.sum("texts")).alias("contents"))
    )
    share = F.pow(F.lit(DAMPING), F.col("depth"))
    mixed = (1 - share) * F.col("presentation") + share * F.col("contents")
    return nodes.select("host", "path", "n_pages", "presentation", "inner").join(branch, ["host", "path"]).select(
        "host", "path", "n_pages", F.when(F.col("inner"), mixed).otherwise(F.col("contents")).alias("importance")
    )


def noisy_branches(importance: DataFrame, min_importance: float = MIN_IMPORTANCE, prior_pages: float = PRIOR_PAGES) -> DataFrame:
    """(host, noisy): the paths of each host that are of low importance together with all below them.

    The importance of a node is smoothed as if it had also been on ``prior_pages`` pages of importance 1.
    """
    smoothed = (F.col("importance") * F.col("n_pages") + prior_pages) / (F.col("n_pages") + prior_pages)
    steps = F.split("path", "\x1f")
    above = importance.select(
        "host", smoothed.alias("importance"), steps.alias("steps"), F.explode(F.sequence(F.lit(1), F.size(steps))).alias("depth")
    )
    branches = above.groupBy("host", F.array_join(F.slice("steps", 1, F.col("depth")), "\x1f").alias("path")).agg(
        F.max("importance").alias("most")
    )
    low = branches.where(F.col("most") < min_importance)
    return low.groupBy("host").agg(F.collect_list("path").alias("noisy"))


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", prior_pages: float = PRIOR_PAGES) -> DataFrame:
    """Adds ``main_text`` to ``pages``, in place of a column of this name: the blocks of main text joined by line breaks, empty if there is none.

    Null html is empty; pages without a host share one style tree. Each page is
    parsed once for the trees, of which only counts are shuffled, and once for
    its text. Text that follows unclosed elements belongs to them; a page may
    end anywhere. Repeated rows stay repeated.
    """
    host = url_host(F.col(url_col))
    trees = node_importance(pages.select(host.alias("host"), F.col(html_col).alias("html")))
    noisy = materialize(noisy_branches(trees, prior_pages=prior_pages), "noisy-branches")
    site, low = fresh(pages, "tree_host"), fresh(pages, "noisy_paths")
    noisy = noisy.select(F.col("host").alias(site), F.col("noisy").alias(low))
    joined = without(pages, ["main_text"]).join(noisy, host == F.col(site), "left")

    @F.pandas_udf("string")
    def text_of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for htmls, lows in batches:
            yield pd.Series(
                [main_text(h, frozenset(low) if low is not None else frozenset()) for h, low in zip(htmls, lows)], dtype=object
            )

    return joined.withColumn("main_text", text_of(F.col(html_col), F.col(low))).drop(site, low)


def op1_main_text(spark, sf_dir):
    pages = extract(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select(
        "page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("bigint").alias("n_chars")
    )
