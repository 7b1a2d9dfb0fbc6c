"""HTML extraction by wrapper induction: pages of a host are aligned with a reference page by simple
tree matching, chrome included. Nodes with the same text on most of the host's different pages are template, slots that vary
are content; names of elements decide about what varies without being the article.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientela.llm.shared import slices, stored
from clientela.llm.url_filter import host_of
from clientela.llm.words import batch

# reference pages sent to every task while they have at most so many bytes in all; beyond, pages are
# joined with them by host
BROADCAST_BYTES = 16 << 20

# no part can run past the next "<" in vain, so that broken markup is read in one pass
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']++|\"[^\"]*\"|'[^']*')*+)>|<[!?][^<>]*>|([^<]+|<)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_SPACE = re.compile(r"\s+")
# fixed values: parts of HTML
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe svg math xmp".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSED_BY_BLOCK = {"p"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPES = {"table", "ul", "ol", "dl", "body", "article", "div", "section", "td", "th", "select"}
BOILERPLATE = set("nav aside footer form button select input dialog menu head".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
NAMES = set(
    "ad ads adv advert adverts advertisement adsense adslot sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notices alert popup modal overlay newsletter subscribe subscription signup login sidebar rail menu nav navbar navigation breadcrumb "
    "breadcrumbs header masthead footer comment comments respond reply replies disqus share sharing social related recommended pagination "
    "pager toolbar widget widgets skip toc".split()
)


class Node:
    """An element: label (tag and first class), children (nodes and strings of text)."""

    __slots__ = ("tag", "label", "skip", "children", "groups", "index")

    def __init__(self, tag: str, label: str, skip: bool):
        self.tag, self.label, self.skip = tag, label, skip
        self.children: list[Node | str] = []
        self.groups: list[tuple[str, list[Node]]] = []
        self.index = -1


def _is_boilerplate(tag: str, attributes: dict[str, str]) -> bool:
    if tag in BOILERPLATE or attributes.get("role", "").lower() in ROLES or "hidden" in attributes:
        return True
    if tag in ("html", "body", "main", "article") and "comment" not in attributes.get("class", "").lower():
        return False
    for name in (attributes.get("class", "") + " " + attributes.get("id", "")).lower().split():
        parts = re.split(r"[-_]+", name)
        if parts[0] not in ("has", "with", "no", "not", "is") and (parts[0] in NAMES or parts[-1] in NAMES):
            return True
    return False


def parse(source: str) -> Node:
    """A tree of whatever markup there is: open elements end with their parent or where HTML says."""
    root = Node("#root", "#root", False)
    stack, at = [root], 0
    # numbers of open elements by tag: what is not open need not be looked for
    opened: Counter[str] = Counter()

    def close(i: int) -> None:
        opened.subtract(n.tag for n in stack[i:])
        del stack[i:]

    while at < len(source):
        found = _TOKEN.match(source, at)
        if found is None:  # a broken tag: its < is text
            stack[-1].children.append("<")
            at += 1
            continue
        at = found.end()
        closing, tag, rest, text = found.groups()
        if text is not None:
            stack[-1].children.append(text)
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if closing:
            if opened[tag] > 0:
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            continue
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}", re.I).search(source, at)
            at = end.start() if end else len(source)
            continue
        if tag in BLOCK or tag in SIBLINGS:
            ends = SIBLINGS.get(tag, set()) | (CLOSED_BY_BLOCK if tag in BLOCK else set())
            for i in range(len(stack) - 1, 0, -1) if any(opened[t] > 0 for t in ends) else ():
                if stack[i].tag in ends:
                    close(i)
                    if tag not in SIBLINGS:
                        break
                elif stack[i].tag in SCOPES or stack[i].tag in SIBLINGS:
                    break
        attributes = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(rest)} if "=" in rest else {}
        if rest and re.search(r"(?:^|\s)hidden(?:\s|/|$)", rest):
            attributes["hidden"] = ""
        if tag == "br" or tag == "hr":
            stack[-1].children.append(Node(tag, tag, False))
            continue
        names = attributes.get("class", "").split()
        header = tag == "header" and opened["article"] + opened["main"] == 0
        node = Node(tag, f"{tag}.{names[0].lower()}" if names else tag, header or _is_boilerplate(tag, attributes))
        stack[-1].children.append(node)
        if tag not in VOID and not rest.endswith("/"):
            stack.append(node)
            opened[tag] += 1
    return root


def content_roots(root: Node) -> list[Node]:
    """Elements that hold the article: articles, unless main or the body holds far more text, else main, else the body.

    Elements of boilerplate do not count.
    """
    found: dict[str, list[tuple[Node, int]]] = {"article": [], "main": [], "body": []}
    # text so far in page order, at the begin and the end of each candidate
    total, inside, work = 0, Counter(), [("in", root)]
    while work:
        step, item = work.pop()
        if step != "in":
            found[step][-1] = (item, total - found[step][-1][1])
            inside[step] -= 1
        elif isinstance(item, str):
            total += len(item.strip())
        elif not item.skip or item is root:
            if item.tag in found and not inside[item.tag]:
                found[item.tag].append((item, total))
                inside[item.tag] += 1
                work.append((item.tag, item))
            work.extend(("in", c) for c in reversed(item.children))
    held = {tag: sum(n for _, n in nodes) for tag, nodes in found.items()}
    wider = held["main"] if found["main"] else held["body"] or total
    for tag, least in (("article", wider / 3), ("main", (held["body"] or total) / 3), ("body", 0)):
        if found[tag] and held[tag] >= least:
            return [node for node, _ in found[tag]]
    return [root]


class Block:
    """Text of a block and the element it stands in; whether that is named as boilerplate, and inside the content."""

    __slots__ = ("text", "node", "named", "inside")

    def __init__(self, text: str, node: Node, named: bool, inside: bool):
        self.text, self.node, self.named, self.inside = text, node, named, inside


def blocks(root: Node, content: list[Node]) -> list[Block]:
    """Blocks of text in page order; those of elements named as boilerplate come behind the others."""
    out: list[Block] = []
    inner, named = {id(n) for n in content}, [root]
    for top in named:  # grows: what is named inside is looked at on its own
        held: list[str] = []

        def end(owner: Node, inside: bool) -> None:
            if held:
                text = _SPACE.sub(" ", entities.unescape("".join(held))).strip()
                held.clear()
                if text:
                    out.append(Block(text, owner, top is not root, inside))

        # an explicit stack: markup may be nested deeper than Python recurses
        work: list[tuple[str, object, Node, bool]] = [("in", top, top, id(top) in inner)]
        while work:
            step, item, owner, inside = work.pop()
            if step == "end":
                end(owner, inside)
            elif isinstance(item, str):
                held.append(item)
            elif item.skip and item is not top:
                named.append(item)
                if item.tag in BLOCK:
                    end(owner, inside)
            elif item.tag in ("br", "hr"):
                held.append(" ")
                if item.tag == "hr":
                    end(owner, inside)
            else:
                holder, within = owner, inside or id(item) in inner
                if item.tag in BLOCK or item is top:
                    end(owner, inside)
                    holder = item
                    work.append(("end", None, holder, within))
                work.extend(("in", c, holder, within) for c in reversed(item.children))
    return out


def group(root: Node) -> int:
    """Number the elements in page order and join neighbours of one label into one repeating slot."""
    count, work = 0, [root]
    while work:
        node = work.pop()
        node.index = count
        count += 1
        node.groups = []
        for child in node.children:
            if isinstance(child, Node) and child.tag in BLOCK:
                if node.groups and node.groups[-1][0] == child.label:
                    node.groups[-1][1].append(child)
                else:
                    node.groups.append((child.label, [child]))
        work.extend(n for _, members in reversed(node.groups) for n in members)
    return count


def _begins(node: Node) -> str:
    return node.groups[0][0] if node.groups else ""


# branchings above one another that are aligned; elements with one child are not counted
BRANCHINGS = 200


def match(a: Node, b: Node, depth: int = 0) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching of two grouped trees of one label: size and pairs of the best alignment.

    Repeating slots are aligned as one: every member with the first of the other side that begins alike, or else the
    first. Below ``BRANCHINGS`` branchings nothing is aligned, and so nothing taken for template.
    """
    chain: list[tuple[Node, Node]] = []
    while len(a.groups) == len(b.groups) == 1 and a.groups[0][0] == b.groups[0][0] and len(a.groups[0][1]) == 1:
        chain.append((a, b))
        a, b = a.groups[0][1][0], b.groups[0][1][0]
    x, y = a.groups, b.groups
    if not x or not y or depth > BRANCHINGS:
        return 1 + len(chain), [*chain, (a, b)]
    weights: dict[tuple[int, int], tuple[int, list]] = {}
    table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, (label, members) in enumerate(x):
        for j, (other, others) in enumerate(y):
            w = 0
            if label == other:
                weights[i, j] = match(members[0], others[0], depth + 1)
                w = weights[i, j][0]
            table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + w)
    pairs, i, j = [*chain, (a, b)], len(x), len(y)
    while i and j:
        if (i - 1, j - 1) in weights and table[i][j] == table[i - 1][j - 1] + weights[i - 1, j - 1][0]:
            members, others = x[i - 1][1], y[j - 1][1]
            alike = {_begins(o): o for o in reversed(others)}
            for k, member in enumerate(members):
                other = alike.get(_begins(member), others[0])
                pairs.extend(weights[i - 1, j - 1][1] if k == 0 and other is others[0] else match(member, other, depth + 1)[1])
            i, j = i - 1, j - 1
        elif table[i][j] == table[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return 1 + len(chain) + table[len(x)][len(y)], pairs


@lru_cache(maxsize=256)
def _reference(source: str) -> Node:
    root = parse(source)
    group(root)
    return root


class Placed:
    """A block's node of the reference page (-1 for none) and what is known of it without other pages."""

    __slots__ = ("node", "text", "named", "inside", "guarded")

    def __init__(self, node: int, block: Block, guarded: bool):
        self.node, self.text, self.named, self.inside, self.guarded = node, block.text, block.named, block.inside, guarded


def placed_blocks(source: str, reference: str | None) -> list[Placed]:
    """Every block of a page, in page order, those named as boilerplate last."""
    root = parse(source)
    content = content_roots(root)
    found = blocks(root, content)
    guarded = all(n.tag in ("article", "main") for n in content)
    places: dict[int, int] = {}
    if found and reference is not None:
        group(root)
        places = {id(p): r.index for p, r in match(root, _reference(reference))[1]}
    return [Placed(places.get(id(b.node), -1), b, guarded) for b in found]


# least share of a page's text that varies where its constant blocks are template, inside an article and elsewhere: pages that
# agree in nearly everything are near copies, and what they share is their content
_VARYING = {True: 2 / 3, False: 1 / 4}


def verdicts(placed: list[Placed], constant: set[tuple[int, int]]) -> list[str]:
    """What each block is: ``template``, ``name`` or ``outside`` (left out), or ``content``."""
    fixed = [(b.node, _digest(b.text)) in constant for b in placed]
    body = [(len(b.text), f) for b, f in zip(placed, fixed) if b.inside and not b.named]
    whole, varying = sum(n for n, _ in body), sum(n for n, f in body if not f)
    near_copy = bool(placed) and varying < _VARYING[placed[0].guarded] * whole
    out = []
    for b, f in zip(placed, fixed):
        if f and not (near_copy and b.inside and not b.named):
            out.append("template")
        else:
            out.append("name" if b.named else "content" if b.inside else "outside")
    return out


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


_SEEN = pa.schema([("host", pa.string()), ("node", pa.int32()), ("block", pa.int64()), ("page", pa.int64())])


_TEXT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_template", pa.int64())])


def _page_key(placed: list[Placed]) -> int:
    """The least hash of the article's blocks: near copies mostly share it, and count as one page then."""
    return min((_digest(b.text) for b in placed if b.inside and not b.named), default=0)


def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "html"):
        seen: set[tuple[str, int, int, int]] = set()
        for host, source, reference in zip(*(part.column(c).to_pylist() for c in ("host", "html", "reference"))):
            placed = placed_blocks(source, reference)
            page = _page_key(placed)
            seen.update((host, b.node, _digest(b.text), page) for b in placed if b.node >= 0)
        if seen:
            yield batch(_SEEN, *zip(*sorted(seen)))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "html"):
        texts, counts = [], []
        for source, reference, template in zip(*(part.column(c).to_pylist() for c in ("html", "reference", "template"))):
            constant = {(t["node"], t["block"]) for t in template or ()}
            placed = placed_blocks(source, reference if constant else None)
            judged = verdicts(placed, constant)
            texts.append("\n\n".join(b.text for b, v in zip(placed, judged) if v == "content"))
            counts.append(judged.count("template"))
        yield batch(_TEXT, part.column("page_id"), part.column("url"), texts, counts)


def extract(pages: DataFrame, share: float = 0.6, least_pages: int = 3) -> DataFrame:
    """(page_id, url, text, n_template) of every row of ``pages`` (page_id, url, html): the main text of each page.

    A block is template where its aligned place has the same text on ``share`` or more of the host's different pages, on
    ``least_pages`` at least; pages that share the least hash of their blocks, as copies and most near copies do,
    count as one. Inside the article constant blocks stay where they make up most of the page, which is then a near copy.
    ``n_template`` counts the blocks that are template. Of the rest, elements and names of menus, headers, footers,
    sidebars, notices, adverts, forms and comments are left out, and what is outside the article; scripts and styles are
    never text. Everything else is content, whole. The reference of a host is its page of smallest page_id. Null and
    empty html has empty text; rows that repeat come out as often; pages without a host, and hosts of
    fewer pages, have no template; an empty table gives no rows. Markup may be broken, and nested as deep as it likes.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("host", host_of(F.col("url")))
    first = rows.filter("host <> '' AND html <> ''").groupBy("host").agg(F.min_by("html", F.struct(F.coalesce("page_id", F.lit(2**63 - 1)), F.md5("html"))).alias("reference"))
    first = stored(first)

    def with_small(df: DataFrame, small: DataFrame) -> DataFrame:
        """References, and templates at 20 bytes a block, are sent to the pages only while they are small."""
        width = F.octet_length("reference") + (20 * F.coalesce(F.size("template"), F.lit(0)) if "template" in small.columns else 0)
        size = small.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0]
        return df.join(F.broadcast(small) if size <= BROADCAST_BYTES else small, "host", "left")

    seen = with_small(rows, first).filter("reference IS NOT NULL").select("host", "html", "reference").mapInArrow(_observe, "host string, node int, block long, page long")
    seen = stored(seen.distinct())
    by_block = seen.groupBy("host", "node", "block").agg(F.count("*").alias("n"))
    by_host = seen.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    constant = by_block.join(by_host, "host").filter((F.col("n") >= share * F.col("pages")) & (F.col("n") >= least_pages))
    template = constant.groupBy("host").agg(F.collect_list(F.struct("node", "block")).alias("template"))
    known = stored(first.join(template, "host", "left"))
    return with_small(rows, known).select("page_id", "url", "html", "reference", "template").mapInArrow(_extract, "page_id long, url string, text string, n_template long")
