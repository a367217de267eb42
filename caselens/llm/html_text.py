"""Main text of raw web pages: flat text blocks, classified by a small decision tree."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = (
    "words", "link_density", "prev_words", "prev_link_density", "next_words", "next_link_density",
    "region", "heading",
)

#: Where a block is: in a menu, footer, notice or the like; beside the article; on a page without an article element; in the article.
FURNITURE, BESIDE, PLAIN, ARTICLE = range(4)

#: Labelled blocks, fixed values: the features above, then 1 for main text. Regions as above. Judged by hand on typical page layouts:
#: articles with and without an <article> element, menus, footers, sidebars, notices, adverts, forms, comments.
LABELLED = (
    # paragraphs and headings inside an article element, long and short, with and without links
    (120, 0.00, 80, 0.00, 95, 0.00, 3, 0, 1),
    (60, 0.05, 9, 0.00, 120, 0.00, 3, 0, 1),
    (45, 0.10, 60, 0.05, 3, 0.00, 3, 0, 1),
    (18, 0.00, 45, 0.10, 70, 0.00, 3, 0, 1),
    (1, 0.00, 60, 0.00, 44, 0.00, 3, 0, 1),
    (2, 0.00, 10, 0.00, 12, 0.20, 3, 0, 1),
    (6, 0.00, 75, 0.00, 20, 1.00, 3, 0, 1),
    (9, 0.00, 6, 0.00, 10, 1.00, 3, 0, 1),
    (4, 1.00, 50, 0.00, 60, 0.00, 3, 0, 1),
    (25, 0.60, 40, 0.10, 35, 0.00, 3, 0, 1),
    (7, 0.00, 12, 0.00, 60, 0.00, 3, 1, 1),
    (3, 0.00, 1, 1.00, 90, 0.05, 3, 1, 1),
    (5, 0.00, 6, 1.00, 1, 0.00, 3, 1, 1),
    (11, 0.00, 100, 0.00, 80, 0.00, 3, 1, 1),
    (8, 1.00, 4, 1.00, 70, 0.00, 3, 1, 1),
    # lists of links, share bars and linked adverts inside an article element
    (1, 1.00, 1, 1.00, 1, 1.00, 3, 0, 0),
    (2, 1.00, 80, 0.00, 2, 1.00, 3, 0, 0),
    (3, 1.00, 3, 1.00, 60, 0.00, 3, 0, 0),
    (5, 1.00, 6, 1.00, 5, 1.00, 3, 0, 0),
    (7, 1.00, 8, 1.00, 40, 0.00, 3, 0, 0),
    (9, 1.00, 50, 0.00, 8, 1.00, 3, 0, 0),
    (14, 0.95, 12, 1.00, 10, 0.90, 3, 0, 0),
    (6, 1.00, 2, 0.00, 7, 1.00, 3, 0, 0),
    (5, 1.00, 5, 1.00, 0, 0.00, 3, 0, 0),
    (4, 1.00, 31, 0.00, 4, 1.00, 3, 0, 0),
    (4, 1.00, 4, 1.00, 4, 1.00, 3, 0, 0),
    (4, 1.00, 4, 1.00, 31, 0.00, 3, 0, 0),
    # what stands around them
    (31, 0.00, 4, 1.00, 0, 0.00, 3, 0, 1),
    (30, 0.00, 31, 0.00, 4, 1.00, 3, 0, 1),
    (40, 0.00, 4, 1.00, 35, 0.00, 3, 0, 1),
    (12, 0.00, 13, 0.00, 32, 0.00, 3, 0, 1),
    (15, 0.00, 51, 0.00, 0, 0.00, 3, 0, 1),
    (56, 0.00, 10, 0.00, 13, 0.00, 3, 0, 1),
    (10, 0.00, 23, 0.00, 56, 0.00, 3, 0, 1),
    (5, 0.00, 0, 0.00, 31, 0.00, 3, 1, 1),
    # outside the article of a page that has one
    (1, 1.00, 1, 1.00, 1, 1.00, 1, 0, 0),
    (8, 0.00, 1, 1.00, 6, 0.00, 1, 0, 0),
    (40, 0.00, 5, 0.00, 9, 0.00, 1, 0, 0),
    (90, 0.05, 30, 0.00, 12, 0.00, 1, 0, 0),
    (6, 0.00, 80, 0.00, 2, 1.00, 1, 1, 0),
    (3, 0.00, 1, 1.00, 5, 0.50, 1, 1, 0),
    (15, 0.40, 9, 0.00, 1, 1.00, 1, 0, 0),
    (20, 0.00, 90, 0.00, 45, 0.00, 1, 0, 0),
    (50, 0.00, 60, 0.00, 70, 0.00, 1, 0, 0),
    (3, 1.00, 1, 1.00, 60, 0.00, 1, 0, 0),
    (8, 0.00, 0, 0.00, 100, 0.00, 1, 0, 0),
    (30, 0.00, 40, 0.00, 35, 0.00, 1, 0, 0),
    # page furniture: menus, headers, footers, sidebars, notices, adverts, forms, comments
    (1, 1.00, 1, 1.00, 1, 1.00, 0, 0, 0),
    (2, 1.00, 0, 0.00, 2, 1.00, 0, 0, 0),
    (12, 0.10, 60, 0.00, 0, 0.00, 0, 0, 0),
    (30, 0.00, 70, 0.00, 0, 0.00, 0, 0, 0),
    (45, 0.00, 40, 0.00, 50, 0.00, 0, 0, 0),
    (80, 0.00, 60, 0.00, 70, 0.00, 0, 0, 0),
    (110, 0.02, 20, 0.00, 90, 0.00, 0, 0, 0),
    (35, 0.00, 50, 0.00, 45, 0.00, 0, 0, 0),
    (6, 0.00, 45, 0.00, 30, 0.00, 0, 0, 0),
    (2, 0.00, 80, 0.00, 35, 0.00, 0, 1, 0),
    (4, 0.00, 1, 1.00, 6, 1.00, 0, 1, 0),
    (3, 0.00, 90, 0.00, 25, 0.00, 0, 1, 0),
    (20, 1.00, 15, 1.00, 18, 1.00, 0, 0, 0),
    (15, 0.00, 51, 0.00, 0, 0.00, 0, 0, 0),
    (13, 0.00, 56, 0.00, 0, 0.00, 0, 0, 0),
    (25, 0.00, 30, 0.00, 0, 0.00, 0, 0, 0),
    (9, 0.30, 120, 0.00, 0, 0.00, 0, 0, 0),
    (60, 0.00, 90, 0.00, 40, 0.00, 0, 0, 0),
    (50, 0.00, 35, 0.00, 60, 0.00, 0, 0, 0),
    (8, 0.00, 40, 0.00, 45, 0.00, 0, 0, 0),
    (3, 1.00, 2, 1.00, 50, 0.00, 0, 0, 0),
    (7, 0.00, 0, 0.00, 80, 0.00, 0, 0, 0),
    # pages without an article element: running text against short and linked blocks
    (140, 0.00, 90, 0.00, 100, 0.02, 2, 0, 1),
    (70, 0.05, 8, 0.00, 55, 0.00, 2, 0, 1),
    (32, 0.00, 70, 0.05, 40, 0.10, 2, 0, 1),
    (22, 0.10, 60, 0.00, 48, 0.00, 2, 0, 1),
    (16, 0.00, 55, 0.00, 3, 1.00, 2, 0, 1),
    (14, 0.00, 30, 0.00, 60, 0.00, 2, 0, 1),
    (4, 0.00, 65, 0.00, 80, 0.00, 2, 0, 1),
    (9, 0.00, 40, 0.00, 33, 0.00, 2, 0, 1),
    (6, 0.00, 2, 1.00, 85, 0.00, 2, 1, 1),
    (4, 0.00, 75, 0.00, 66, 0.00, 2, 1, 1),
    (9, 0.00, 7, 0.00, 45, 0.05, 2, 1, 1),
    (5, 0.00, 0, 0.00, 38, 0.00, 2, 1, 1),
    (31, 0.00, 0, 0.00, 31, 0.00, 2, 0, 1),
    (30, 0.00, 31, 0.00, 4, 1.00, 2, 0, 1),
    (45, 0.00, 0, 0.00, 20, 0.00, 2, 0, 1),
    (25, 0.00, 3, 1.00, 30, 0.00, 2, 0, 1),
    (60, 0.00, 40, 0.00, 0, 0.00, 2, 0, 1),
    (90, 0.00, 100, 0.00, 0, 0.00, 2, 0, 1),
    (50, 0.02, 45, 0.00, 2, 1.00, 2, 0, 1),
    (28, 0.00, 12, 0.00, 26, 0.00, 2, 0, 1),
    (35, 0.10, 5, 0.00, 3, 1.00, 2, 0, 1),
    (55, 0.00, 4, 1.00, 2, 1.00, 2, 0, 1),
    (1, 1.00, 2, 1.00, 1, 1.00, 2, 0, 0),
    (4, 1.00, 30, 0.00, 4, 1.00, 2, 0, 0),
    (4, 1.00, 4, 1.00, 4, 1.00, 2, 0, 0),
    (4, 1.00, 4, 1.00, 0, 0.00, 2, 0, 0),
    (4, 1.00, 0, 0.00, 30, 0.00, 2, 0, 0),
    (6, 1.00, 60, 0.00, 5, 1.00, 2, 0, 0),
    (10, 1.00, 8, 1.00, 40, 0.00, 2, 0, 0),
    (6, 0.00, 3, 1.00, 4, 1.00, 2, 0, 0),
    (3, 1.00, 1, 1.00, 90, 0.00, 2, 0, 0),
    (12, 0.90, 10, 0.80, 14, 1.00, 2, 0, 0),
    (40, 0.80, 3, 1.00, 30, 0.90, 2, 0, 0),
    (25, 0.55, 60, 0.00, 6, 1.00, 2, 0, 0),
    (5, 0.00, 3, 1.00, 2, 1.00, 2, 0, 0),
    (8, 0.00, 4, 1.00, 0, 0.00, 2, 0, 0),
    (7, 0.00, 5, 0.00, 4, 0.00, 2, 0, 0),
    (4, 0.00, 2, 1.00, 3, 1.00, 2, 1, 0),
    (3, 0.00, 6, 0.00, 5, 1.00, 2, 1, 0),
)

#: Elements that begin and end a text block. Fixed values.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot "
    "th thead title tr ul".split()
)
#: Elements whose text is never part of a page's prose. Fixed values.
SILENT_TAGS = frozenset("audio button canvas datalist head iframe map math noframes noscript object option select svg template textarea title video".split())
#: Elements whose content is not markup. Fixed values.
RAW_TAGS = frozenset("iframe noembed noframes script style textarea title xmp".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FURNITURE_TAGS = frozenset("aside dialog footer form menu nav search".split())
FURNITURE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
#: Words of a class or id that mark furniture. Fixed values.
FURNITURE_NAMES = frozenset(
    "ad ads advert advertisement adverts alert banner breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright "
    "disqus feedback footer gdpr header login masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo "
    "promoted promotion recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe "
    "subscription toolbar widget".split()
)

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>?|<[!?/][^>]*+>?""", re.S
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: In any attribute: the bare hidden attribute, or a style that shows nothing.
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=\s|=|/?$)|(?:^|\s)aria-hidden\s*=\s*["']?true|(?:^|\s)style\s*=\s*(?:"[^"]*?|'[^']*?|[^\s"']*?)\bdisplay\s*:\s*none""", re.I)
_QUOTED = re.compile(r""""[^"]*"|'[^']*'""")
#: A class with one of these words first, or one of those last, says how a page is laid out. Fixed values.
STATE_FIRST = frozenset("can has hide is js no not show with without".split())
STATE_LAST = frozenset("active closed collapsed disabled enabled expanded fixed free hidden layout open opened page sticky visible".split())


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    words: int = 0
    linked: int = 0
    in_article: bool = False
    furniture: bool = False
    heading: bool = False


def _hidden(attributes: str) -> bool:
    found = _HIDDEN.search(attributes)
    # the word hidden inside a value is not the attribute
    return bool(found) and (found.group().strip().lower() != "hidden" or bool(_HIDDEN.search(_QUOTED.sub('""', attributes))))


def _role(attributes: str) -> bool:
    return any(n.lower() == "role" and set("".join(v).lower().split()) & FURNITURE_ROLES for n, *v in _ATTRIBUTE.findall(attributes))


def _named(attributes: str) -> bool:
    for name, *values in _ATTRIBUTE.findall(attributes):
        for token in "".join(values).split() if name.lower() != "role" else ():
            words = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower())
            if set(words) & FURNITURE_NAMES and words[0] not in STATE_FIRST and words[-1] not in STATE_LAST:
                return True
    return False


def text_blocks(page: str) -> list[Block]:
    """The text blocks of a page in order, without silent elements."""
    found: list[Block] = []
    block = Block()
    # tag, silent, furniture, article: each with what encloses it. Furniture is 2 by what an element is, 1 by its name,
    # as names are also given to wrappers of whole pages: an article or main element in one is not furniture.
    stack: list[tuple[str, bool, int, bool]] = []
    linked = False

    def close() -> None:
        nonlocal block
        if block.words:
            found.append(block)
        block = Block()

    def say(raw: str) -> None:
        _, silent, furniture, article = stack[-1] if stack else ("", False, 0, False)
        if silent or not raw:
            return
        text = html.unescape(raw)
        words = len(text.split())
        if words and not block.words:
            block.in_article, block.furniture = article, furniture > 0
            block.heading = any(tag in HEADINGS for tag, *_ in stack[-4:])
        block.parts.append(text)
        block.words += words
        block.linked += words * linked

    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        slash, tag, attributes = m.group(1), (m.group(2) or "").lower(), m.group(3) or ""
        if not tag:
            continue
        if tag in RAW_TAGS and not slash:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else len(page)
            continue
        if tag == "br":
            block.parts.append(" ")
            continue
        if tag == "a":
            linked = not slash
            continue
        if tag in BLOCK_TAGS:
            close()
            linked = False
        if tag in VOID_TAGS or (tag not in BLOCK_TAGS and tag not in SILENT_TAGS and not attributes):
            continue
        if slash:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
        elif not attributes.endswith("/"):
            if tag in ("p", "li", "td", "tr", "dt", "dd") and stack and stack[-1][0] == tag:
                stack.pop()
            elif tag in BLOCK_TAGS and stack and stack[-1][0] == "p":
                stack.pop()
            _, silent, furniture, article = stack[-1] if stack else ("", False, 0, False)
            page_level = tag in ("html", "body", "article", "main")
            if tag in ("article", "main") and furniture == 1:
                furniture = 0
            if tag in FURNITURE_TAGS - {"form"} or (not page_level and (_hidden(attributes) or _role(attributes))):
                furniture = 2
            elif tag == "form" or (tag == "header" and not article) or (tag not in ("html", "body", "main") and _named(attributes)):
                furniture = max(furniture, 1)
            stack.append((tag, silent or tag in SILENT_TAGS, furniture, article or tag in ("article", "main")))
    close()
    return found


def block_features(blocks: list[Block]) -> np.ndarray:
    out = np.zeros((len(blocks), len(FEATURES)))
    has_article = any(b.in_article for b in blocks)
    for i, b in enumerate(blocks):
        out[i, :2] = b.words, b.linked / b.words
        out[i, 6:] = FURNITURE if b.furniture else ARTICLE if b.in_article else BESIDE if has_article else PLAIN, b.heading
    if len(blocks) > 1:
        out[1:, 2:4] = out[:-1, :2]
        out[:-1, 4:6] = out[1:, :2]
    return out


@dataclass(frozen=True)
class Tree:
    """A binary tree in arrays: go left while the feature is at most the threshold; leaves have feature -1."""

    feature: tuple[int, ...]
    threshold: tuple[float, ...]
    left: tuple[int, ...]
    right: tuple[int, ...]
    label: tuple[bool, ...]

    def predict(self, features: np.ndarray) -> np.ndarray:
        feature, threshold = np.array(self.feature), np.array(self.threshold)
        left, right = np.array(self.left), np.array(self.right)
        node = np.zeros(len(features), np.int64)
        while (inner := feature[node] >= 0).any():
            rows = np.flatnonzero(inner)
            here = node[rows]
            node[rows] = np.where(features[rows, feature[here]] <= threshold[here], left[here], right[here])
        return np.array(self.label)[node]


def train_tree(spark: SparkSession, labelled: tuple[tuple[float, ...], ...] = LABELLED, depth: int = 6) -> Tree:
    """Fit a decision tree to the labelled blocks."""
    rows = [(float(r[-1]), Vectors.dense([float(x) for x in r[:-1]])) for r in labelled]
    table = spark.createDataFrame(rows, ["label", "features"]).coalesce(1)
    model = DecisionTreeClassifier(maxDepth=depth, maxBins=64, minInstancesPerNode=1, seed=7).fit(table)
    nodes: list[list] = []

    def walk(node) -> int:
        me = len(nodes)
        nodes.append([-1, 0.0, -1, -1, node.prediction() == 1.0])
        if node.subtreeDepth() > 0:
            nodes[me][:2] = node.split().featureIndex(), node.split().threshold()
            nodes[me][2] = walk(node.leftChild())
            nodes[me][3] = walk(node.rightChild())
        return me

    walk(model._call_java("rootNode"))  # noqa: SLF001
    return Tree(*map(tuple, zip(*nodes, strict=True)))


def main_text(page: str, tree: Tree) -> str:
    blocks = text_blocks(page)
    if not blocks:
        return ""
    keep = tree.predict(block_features(blocks))
    return "\n\n".join(" ".join("".join(b.parts).split()) for b, kept in zip(blocks, keep, strict=True) if kept)


def extract_pages(pages: DataFrame, tree: Tree, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page: id, url, text, n_chars (code points).

    Null html, a page without blocks and one without main text give an empty text. Truncated
    or badly nested markup is read as far as it goes. Null or repeated ids and null urls stay
    as they are, an empty table gives an empty one, other columns are left out.
    """
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                rows = batch.slice(lo, 500)
                texts = [main_text(v.as_py() or "", tree) for v in rows.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["id", "url", "text", "n_chars"],
                )

    read = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    out = read.mapInArrow(run, f"id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
