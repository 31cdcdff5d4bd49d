"""Main text of HTML pages by wrapper induction.

Every page is parsed into a tree whose runs of equal siblings are one slot (a path of tag and class labels). Over all
pages, each host's slots are counted: how often they hold text, how often their most frequent text, and how many
characters. Per host the distinct page skeletons are aligned by simple tree matching into one wrapper tree, so that
a slot is the same on pages of unlike shape. Equal pages of a host count once. A slot whose text is constant on most of the
host's pages is template, inside an article only if it has a class or id and is no heading; slots that vary are content,
and the host's content region is its article element or, where it has none, the wrapper node that holds most of the
varying text outside menus, headers, footers, sidebars, notices, adverts, forms and reader comments. Each page is
then cut by its host's wrapper, a row at a time.

Pages are shuffled by host and hash, to find the distinct ones, then only counts per (host, slot, text hash), summed before
the shuffle, so a host that holds a third of all pages is no hot key; the wrappers (a few paths a host) go to the pages by a broadcast while they are below
``WRAPPER_BYTES``, and by a join on the host beyond that, with equal results.

A block is the text between the tags of block elements; a br is white space. Text of a varying slot is never
dropped, whatever its length and however often it repeats.

Edge cases: null, empty and text-free pages give an empty string; a page without a host belongs to the host "";
a host of one page has no constant slots; a page that lacks its host's region falls back to its own article or main
element, or else its largest region; cut-off tags are dropped, unclosed elements end with the page.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

WRAPPER_BYTES = 32 << 20
#: A slot is template when its most frequent text fills this share of at least CONSTANT_PAGES occurrences, which are at least
#: as many as CONSTANT_OF_HOST of the host's distinct pages.
CONSTANT_SHARE, CONSTANT_PAGES, CONSTANT_OF_HOST = 0.9, 5, 0.5
#: The content region's share of its parent's varying text.
REGION_SHARE = 0.6
#: Levels that are aligned; deeper slots keep their page's path.
DEPTH = 64

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)(>|\Z)|<[!?/][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(>|\Z)", re.S)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe svg math select object xmp noembed".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that an opening tag ends, up to the nearest of the second set.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "body": ({"head"}, {"html"}),
}
_NOT_CONTENT = frozenset("nav footer aside form button dialog menu head script style noscript template iframe svg select input textarea object".split())
_NOT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
_NOT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu navbar nav navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login comment comments respond replies disqus share sharing social related recommended recommendations widget pagination pager toolbar skip".split()
)
_NUMBER = re.compile(r"\d{3,}")
_WORDS = re.compile(r"[a-z]+|\d+")


class Node:
    __slots__ = ("tag", "label", "children", "parent", "out", "inside", "blocks")

    def __init__(self, tag: str, label: str, parent: Node | None, out: bool, inside: bool):
        self.tag, self.label, self.parent, self.out, self.inside = tag, label, parent, out, inside
        self.children: list[Node] = []
        self.blocks: list[tuple[int, str]] = []


def _element(tag: str, attrs: str, parent: Node) -> Node:
    given = {a[0].lower(): a[1] or a[2] or a[3] for a in _ATTR.findall(attrs)} if "=" in attrs or "hidden" in attrs else {}
    names = given.get("class", "").split()
    inside = parent.inside or tag in ("article", "main") or given.get("role") in ("main", "article")
    tokens = set(_WORDS.findall(f"{given.get('class', '')} {given.get('id', '')}".lower()))
    out = parent.out or tag in _NOT_CONTENT or (tag == "header" and not inside) or given.get("role") in _NOT_ROLES
    if not out and given and tag not in ("html", "body", "article", "main"):
        out = bool(tokens & _NOT_NAMES) or ("header" in tokens and not inside) or "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", "")
    # Long numbers tell pages apart, not slots: post-1123 and post-1124 are one, col-4 and col-8 are not.
    label = f"{tag}.{names[0]}" if names else f"{tag}#{given['id']}" if given.get("id") else tag
    return Node(tag, _NUMBER.sub("0", label.replace("/", "_")) if label != tag else tag, parent, out, inside)


def parse(source: str | None) -> Node:
    """The page's tree; blocks (order, text) hang on the element that holds them."""
    root = node = Node("", "", None, False, False)
    text: list[str] = []
    holder: Node = root
    order = 0

    def flush() -> None:
        nonlocal order, holder
        if text:
            block = " ".join(htmllib.unescape("".join(text)).split())
            text.clear()
            if block:
                holder.blocks.append((order, block))
                order += 1

    def close_to(stop: Node) -> None:
        nonlocal node
        node = stop

    source, pos, n = source or "", 0, len(source or "")
    while pos < n:
        m = _TAG.search(source, pos)
        end = m.start() if m else n
        if end > pos:
            if not text or not text[-1]:
                holder = next(x for x in _up(node) if x.tag in _BLOCK or x.parent is None)
                if any(x.out for x in (node,)) and not holder.out:
                    holder = node  # an inline element that isn't content
            piece = source[pos:end]
            if not node.out or holder.out:
                text.append(piece)
        if not m:
            break
        pos = m.end()
        slash, name, attrs, closed = (m[1], m[2], m[3], m[4]) if m[2] else (m[5], m[6], m[7], m[8])
        if not name or not closed:  # a comment, a declaration, or a tag that the page's end cuts off
            continue
        tag = name.lower()
        if slash:
            target = next((x for x in _up(node) if x.tag == tag), None)
            if tag in _BLOCK:
                flush()
            if target is not None and target.parent is not None:
                close_to(target.parent)
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in _RAW:
            shut = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*(?:>|\\Z)", re.I).search(source, pos)
            pos = shut.end() if shut else n
            continue
        if tag in _BLOCK:
            flush()
            p = next((x for x in _up(node) if x.tag in ("p", "td", "th", "li", "div", "article", "section", "button", "table")), None)
            if p is not None and p.tag == "p":
                close_to(p.parent)
        if tag in _ENDS:
            ends, limits = _ENDS[tag]
            for x in _up(node):
                if x.tag in limits:
                    break
                if x.tag in ends:
                    close_to(x.parent)
                    break
        child = _element(tag, attrs, node)
        node.children.append(child)
        if tag not in _VOID and not attrs.endswith("/"):
            node = child
    flush()
    return root


def _up(node: Node | None) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def slots(root: Node) -> Iterator[tuple[str, Node]]:
    """Every element with its path of labels, in page order."""
    stack = [(c, c.label) for c in reversed(root.children)]
    while stack:
        node, path = stack.pop()
        yield path, node
        stack += [(c, f"{path}/{c.label}") for c in reversed(node.children)]


def skeleton(root: Node) -> str:
    """The distinct paths of a page in order of first sight: its tree with equal siblings merged."""
    return "\n".join(dict.fromkeys(p for p, x in slots(root) if not x.out))


Tree = dict[str, "Tree"]


def tree_of(paths: str) -> Tree:
    top: Tree = {}
    for path in paths.split("\n") if paths else ():
        at = top
        for label in path.split("/")[:DEPTH]:
            at = at.setdefault(label, {})
    return top


def match(a: Tree, b: Tree) -> tuple[int, list[tuple[str, str]]]:
    """Simple tree matching of two forests: the most nodes of equal tags, ancestors and order, and the pairs of children so matched."""
    left, right = list(a), list(b)
    w = {(x, y): 1 + match(a[x], b[y])[0] for x in left for y in right if _tag(x) == _tag(y)}
    best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    same = {k: v + 0.5 * (k[0] == k[1]) for k, v in w.items()}
    for i, x in enumerate(left):
        for j, y in enumerate(right):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + same.get((x, y), -1))
    pairs, i, j = [], len(left), len(right)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            pairs.append((left[i - 1], right[j - 1]))
            i, j = i - 1, j - 1
    return sum(w[p] for p in pairs), pairs[::-1]


def _tag(label: str) -> str:
    return re.split(r"[.#]", label, maxsplit=1)[0]


def _named(label: str) -> bool:
    """Whether an element has a class or id and is no heading, article or main: inside an article only such a slot can be template."""
    return label != _tag(label) and _tag(label) not in ("h1", "h2", "h3", "h4", "h5", "h6", "article", "main")


def align(wrapper: Tree, page: Tree, at: str, at_page: str, names: dict[str, str]) -> None:
    """Merge a page's tree into the wrapper; ``names`` gets the wrapper's path for each path of the page."""
    pairs = {y: x for x, y in match(wrapper, page)[1]}
    for y, below in page.items():
        x = pairs.get(y, y)
        names[f"{at_page}{y}"] = f"{at}{x}"
        align(wrapper.setdefault(x, {}), below, f"{at}{x}/", f"{at_page}{y}/", names)


def induce(rows: pd.DataFrame) -> pd.DataFrame:
    """One host's wrapper from its skeletons (kind `s`: path, n) and its slots' sums (kind `t`: path, n, top, chars)."""
    wrapper: Tree = {}
    names: dict[str, str] = {}
    for s in rows[rows["kind"] == "s"].sort_values(["n", "path"], ascending=[False, True])["path"]:
        align(wrapper, tree_of(s), "", "", names)
    sums: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0])
    for path, n, top, chars in rows.loc[rows["kind"] == "t", ["path", "n", "top", "chars"]].itertuples(index=False):
        x = sums[names.get(path, path)]
        x[0], x[1], x[2] = x[0] + n, max(x[1], top), x[2] + chars
    pages = rows.loc[rows["kind"] == "s", "n"].sum()
    constant = {p for p, (n, top, _) in sums.items() if n >= max(CONSTANT_PAGES, CONSTANT_OF_HOST * pages) and top >= CONSTANT_SHARE * n}
    # The headline of pages that have no article element may be the same on all.
    constant = {p for p in constant if _tag(p.rsplit("/", 1)[-1]) != "h1"}
    constant = {p for p in constant if _named(p.rsplit("/", 1)[-1]) or not any(_tag(x) in ("article", "main") for x in p.split("/"))}
    mass: dict[str, int] = defaultdict(int)
    for p, (_, _, chars) in sums.items():
        if p not in constant:
            labels = p.split("/")
            for i in range(1, len(labels) + 1):
                mass["/".join(labels[:i])] += chars
    named = [p for p in mass if _tag(p.rsplit("/", 1)[-1]) in ("article", "main")]
    region = ""
    if named:
        region = max(named, key=lambda p: (mass[p], -len(p), p))
    else:
        below = wrapper
        while below:
            label = max(below, key=lambda x: (mass.get(f"{region}{x}", 0), x))
            whole = sum(mass.get(f"{region}{x}", 0) for x in below)
            if whole == 0 or mass.get(f"{region}{label}", 0) < REGION_SHARE * whole or _tag(label) in ("p", "h1", "h2", "h3", "li", "span", "td", "tr", "tbody"):
                break
            region, below = f"{region}{label}/", below[label]
        region = region.rstrip("/")
    own = lambda found: [p for p, x in names.items() if x in found] + [p for p in found if p not in names]
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "region": ["\n".join(sorted(own({region} if region else set())))], "constant": ["\n".join(sorted(own(constant)))]})


def main_text(root: Node, region: frozenset[str], constant: frozenset[str]) -> str:
    found = list(slots(root))
    inside: list[tuple[int, str]] = []

    def gather(node: Node, path: str) -> None:
        stack = [(node, path)]
        while stack:
            x, p = stack.pop()
            if x.out:
                continue
            if p not in constant or (x.inside and not _named(x.label)):
                inside.extend(x.blocks)
            stack += [(c, f"{p}/{c.label}") for c in x.children]

    tops = [(p, x) for p, x in found if p in region and not x.out]
    if not tops:
        tops = [(p, x) for p, x in found if x.tag in ("article", "main") and not x.out and not x.parent.inside]
    if not tops:
        tops = [(p, x) for p, x in found if x.tag == "body" and not x.out]
    if not tops:
        tops = [(c.label, c) for c in root.children]
        inside.extend(root.blocks)
    seen: set[int] = set()
    for p, x in tops:
        if not any(id(y) in seen for y in _up(x)):
            seen.add(id(x))
            gather(x, p)
    return "\n".join(t for _, t in sorted(inside))


def _host():
    return F.lower(F.coalesce(F.regexp_extract(F.col("url").cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def wrappers(pages: DataFrame) -> DataFrame:
    """host, region, constant: every host's wrapper, from all of its distinct pages."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums: dict[tuple, list[int]] = defaultdict(lambda: [0, 0])
            for host, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                root = parse(source)
                sums[host, "s", skeleton(root), 0][0] += 1
                for path, node in slots(root):
                    if node.blocks and not node.out:
                        text = "\n".join(t for _, t in node.blocks)
                        x = sums[host, "t", path, hash_text(text)]
                        x[0], x[1] = x[0] + 1, x[1] + len(text)
            keys = list(zip(*sums)) or [[]] * 4
            n, chars = list(zip(*sums.values())) or [[]] * 2
            yield pa.RecordBatch.from_arrays([*(pa.array(k, pa.string()) for k in keys[:3]), pa.array(keys[3], pa.int64()), pa.array(n, pa.int64()), pa.array(chars, pa.int64())], ["host", "kind", "path", "h", "n", "chars"])

    rows = pages.select(_host().alias("host"), F.col("html").cast("string").alias("html"))
    # Copies of a page count once in its host.
    rows = rows.groupBy("host", F.md5(F.col("html").cast("binary")).alias("md5")).agg(F.any_value("html").alias("html")).select("host", "html")
    rows = rows.mapInArrow(count, "host string, kind string, path string, h long, n long, chars long")
    texts = rows.groupBy("host", "kind", "path", "h").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"))
    sums = texts.groupBy("host", "kind", "path").agg(F.sum("n").alias("n"), F.max("n").alias("top"), F.sum("chars").alias("chars"))
    return sums.groupBy("host").applyInPandas(induce, "host string, region string, constant string")


def hash_text(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def extract(pages: DataFrame, wrapper_bytes: int = WRAPPER_BYTES) -> DataFrame:
    """page_id, url, text of every row of ``pages`` (page_id, url, html)."""
    found = materialize(wrappers(pages), "wrappers")
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), _host().alias("host"))
    kinds = {f: rows.schema[f].dataType.simpleString() for f in ("page_id", "url")}
    size = found.agg(F.coalesce(F.sum(F.length("region") + F.length("constant") + F.length("host") + 64), F.lit(0))).first()[0]
    if size <= wrapper_bytes:
        small = found.sparkSession.sparkContext.broadcast({r["host"]: (r["region"], r["constant"]) for r in found.toLocalIterator()})
    else:
        small = None
        rows = rows.join(found, "host", "left")
    rows = rows.select("page_id", "url", "html", "host", *([] if small else ["region", "constant"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple] = {}
        for b in batches:
            cols = [c.to_pylist() for c in b.columns[2:]]
            texts = []
            for source, host, *own in zip(*cols):
                if host not in memo:
                    pair = small.value.get(host, ("", "")) if small else own
                    memo[host] = tuple(frozenset((x or "").split("\n")) - {""} for x in pair)
                texts.append(main_text(parse(source), *memo[host]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text. Edge cases: see :mod:`html`."""
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
