"""Main text of web pages, by wrappers inferred from the pages of a host.

A page is a tree of its block elements. A wrapper is a regular expression without
unions over such trees: elements that occur once, optional ones, repeated ones,
and texts that are fixed or a slot. Pages are aligned with the wrapper so far, one
after another: what only one of them has becomes optional, neighbours of one kind a
repeated group, texts that differ a slot. Tasks align what they read, and the
wrappers of a host are aligned with each other in groups, level by level.

The wrapper of its host tells where a page has its article; menus, notices and
the like are left out by their elements and class names, and, where the page has
no element for the article, the texts that the wrapper has as fixed. A text in a
repeated group is never fixed, and nothing inside an article element is left out
for being alike on all pages.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from siftlog.llm.common import ready
from siftlog.session import stage

# Elements and words of class names.
SKIPPED = frozenset("script style noscript template iframe object svg canvas head title select option textarea button datalist audio video map".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow mstyle mspace mfrac msqrt mroot msub msup msubsup munder mover munderover semantics".split())
ASIDE = frozenset("nav aside footer form dialog menu fieldset".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors banner promo promotion cookie cookies consent gdpr notice notices notification popup modal overlay "
    "sidebar sidenav menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead topbar comment comments commentlist disqus respond reply replies share sharing social "
    "related recommended recommendations newsletter subscribe subscription signup login widget widgets pagination pager toolbar skip".split()
)
# Of those, the ones that name what others wrote or notices of law; the rest may also describe the element around an article.
FOREIGN_WORDS = frozenset("comment comments commentlist disqus respond reply replies related recommended recommendations cookie cookies consent gdpr".split())
# Words that may stand beside those in one name; a name with any other word says what its element is about.
NEUTRAL_WORDS = frozenset(
    "site main page post article entry blog news top bottom left right inner outer upper lower primary secondary global mobile desktop sticky fixed inline js my the all more box block container wrapper wrap "
    "section list item items area bar button buttons link links icon icons group row column col content body header title label text form field form posts articles stories story unit slot space zone panel tools row media".split()
)
ARTICLE_WORDS = frozenset("articlebody article-body article-content entry-content post-content post-body story-body".split())
# Closed by a new block: a paragraph; by one of the same kind: rows and items.
SELF_CLOSING = {"li": ("ul", "ol", "menu"), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "dt": ("dl",), "dd": ("dl",)}
# Pages of a host with different texts, at least, for its fixed texts to count as its own.
TEMPLATE_PAGES = 3
# Wrappers that are aligned in one group, and hosts that a task holds at once.
GROUP, HOSTS_AT_ONCE = 32, 2_000
SLOT = "*"
# Nodes below one another; elements that lie deeper are put side by side, with all their texts in order.
MOST_DEPTH = 100
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>\"']*)([^<>\"']*(?:\"[^<>\"]*\"[^<>\"']*|'[^<>']*'[^<>\"']*)*)>")
_TAG_START = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_SIGNS = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|itemprop|aria-hidden|hidden)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


@dataclass
class Node:
    """A block element of a page: `parts` are texts and elements in order.

    `marks` are the words that alone make it one beside the article.
    """

    label: str
    aside: bool = False
    marks: frozenset[str] = frozenset()
    parts: list = field(default_factory=list)


def _marks(names: str) -> set[str]:
    """The words of names made of ASIDE_WORDS, and words that say nothing else."""
    out: set[str] = set()
    for name in names.split():
        words = [word for word in re.split(r"[^a-z]+", name) if word]
        if all(word in ASIDE_WORDS or word in NEUTRAL_WORDS for word in words):
            out.update(word for word in words if word in ASIDE_WORDS)
    return out


def _label(tag: str, attributes: str) -> tuple[str, bool, frozenset[str]]:
    """Tag with class and role, whether it is beside the article, and the words of names if only they (or a form) say so."""
    found = {name.lower(): (a or b or c) for name, a, b, c in _ATTRIBUTE.findall(attributes)} if "=" in attributes else {}
    names = " ".join(found[name] for name in ("class", "id") if name in found).lower()
    marks = _marks(names) if tag not in ("body", "html", "main") else set()
    role = found.get("role", "").lower()
    sure = (tag in ASIDE and tag != "form") or role in ASIDE_ROLES
    if tag == "form":
        marks.add(tag)
    # Numbers in names tell pages or places apart, not kinds.
    kind = ".".join([tag, *sorted(set(re.sub("[0-9]+", "", found.get("class", "").lower()).split()))])
    if role == "main" or found.get("itemprop", "").lower() == "articlebody" or any(name in ARTICLE_WORDS for name in names.split()):
        kind = f"article!{kind}"
    return kind, sure or bool(marks), frozenset() if sure else frozenset(marks)


def _said(label: str) -> int:
    """2 for an article element, 1 for the main element."""
    name = label.split("!")[-1].split(".")[0]
    return 2 if name == "article" or label.startswith("article!") else 1 if name == "main" else 0


def _open_asides(root: Node) -> None:
    """Elements that only their names or a form put beside the article are no asides if the article lies in them.

    That is so where they are or hold the article or main element with most text
    (within comments and the like only if there is no other), and where they hold
    most of the text in paragraphs and more than what is left of the page.
    """
    articles: list[tuple[int, list[Node]]] = []
    marked: list[tuple[Node, int, int, bool]] = []

    def visit(node: Node, chain: list[Node], paragraph: bool) -> tuple[int, int, int]:
        """Characters of text: all, in paragraphs, outside marked elements."""
        chain = [*chain, node] if node.marks else chain
        paragraph = paragraph or re.match(r"(?:article!)?(p|blockquote|pre)(\.|$)", node.label) is not None
        text = sum(len(word) for part in node.parts if isinstance(part, str) for word in part.split())
        size, told, own = text, text if paragraph else 0, text
        for part in node.parts:
            if isinstance(part, Node) and (part.marks or not part.aside):
                more = visit(part, chain, paragraph)
                size, told, own = size + more[0], told + more[1], own + (0 if part.marks else more[2])
        if own and _said(node.label):
            articles.append((own, chain))
        if node.marks:
            marked.append((node, size, told, any(held.marks & FOREIGN_WORDS for held in chain)))
        return size, told, own

    _, told, seen = visit(root, [], False)
    if not marked:
        return
    opened = {(node.label, node.marks) for node, size, own_told, foreign in marked if not foreign and 2 * own_told > told and size > seen}
    if articles:
        fit = [found for found in articles if not any(node.marks & FOREIGN_WORDS for node in found[1])]
        opened |= {(node.label, node.marks) for node in max(fit or articles, key=lambda found: found[0])[1]}
    for node, *_ in marked:
        # Elements named alike are of one kind.
        if (node.label, node.marks) in opened:
            node.aside = False


class _Tokens:
    """The tags of a page, comments and declarations left out; no part of the page is read again and again."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.last = page.rfind(">")
        self.signs: list[int] | None = None

    def _end_of_tag(self, at: int) -> int:
        """The next ">" outside quotes, or -1; what is found once holds for all signs on the way."""
        if self.signs is None:
            self.signs = [found.start() for found in _SIGNS.finditer(self.page)]
            self.ends: list[int | None] = [None] * len(self.signs)
            self.partner, later = [-1] * len(self.signs), {}
            for i in range(len(self.signs) - 1, -1, -1):
                sign = self.page[self.signs[i]]
                self.partner[i] = later.get(sign, -1)
                later[sign] = i
        i, way, end = bisect_left(self.signs, at), [], -1
        while i < len(self.signs):
            if self.ends[i] is not None:
                end = self.ends[i]
                break
            if self.page[self.signs[i]] == ">":
                end = self.signs[i]
                break
            way.append(i)
            if self.partner[i] < 0:
                break
            i = self.partner[i] + 1
        for i in way:
            self.ends[i] = end
        return end

    def after(self, at: int) -> tuple[int, int, str, str, bool] | None:
        """The next token from a place on: start, end, tag ("" for none), attributes, and whether it ends an element."""
        page = self.page
        start = page.find("<", at)
        while start >= 0:
            sign = page[start + 1 : start + 2]
            if sign == "!" and page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, len(page) if end < 0 else end + 3, "", "", False
            if sign in ("!", "?") and sign:
                end = page.find(">", start)
                return start, len(page) if end < 0 else end + 1, "", "", False
            if found := _TAG.match(page, start):
                return start, found.end(), found[2].lower(), found[3], bool(found[1])
            if found := _TAG_START.match(page, start):
                end = self._end_of_tag(found.end())
                if end >= 0:
                    return start, end + 1, found[2].lower(), page[found.end() : end], bool(found[1])
                if self.last < start:
                    return start, len(page), "", "", False
            start = page.find("<", start + 1)
        return None


class _Open:
    """The open elements of a page: tags, nodes, and where each tag is open."""

    def __init__(self, root: Node) -> None:
        self.tags, self.nodes = [""], [root]
        self.places: dict[str, list[int]] = {}

    def add(self, tag: str, node: Node, stays: bool) -> None:
        if len(self.nodes) > MOST_DEPTH:
            node.aside |= self.nodes[-1].aside
            self.nodes[MOST_DEPTH - 1].parts.append(node)
        else:
            self.nodes[-1].parts.append(node)
        if stays:
            self.places.setdefault(tag, []).append(len(self.tags))
            self.tags.append(tag)
            self.nodes.append(node)
        else:
            self._go_on()

    def _go_on(self) -> None:
        """What follows in an element that lies too deep goes into a node behind those in it."""
        if len(self.nodes) > MOST_DEPTH:
            last = self.nodes[-1]
            self.nodes[-1] = Node(last.label, last.aside, last.marks)
            self.nodes[MOST_DEPTH - 1].parts.append(self.nodes[-1])

    def close(self, depth: int) -> None:
        while len(self.tags) > depth:
            self.places[self.tags.pop()].pop()
            self.nodes.pop()
        self._go_on()

    def last(self, tags: tuple[str, ...]) -> int:
        """Where one of the tags was opened last; 0 if none is open."""
        return max((self.places[tag][-1] for tag in tags if self.places.get(tag)), default=0)


def tree(page: str) -> Node:
    """The block elements of a page; inline ones are part of the text around them, a line break is white space."""
    root = Node("")
    opened = _Open(root)
    tokens = _Tokens(page)
    skip = ""
    at = 0
    some = False
    while token := tokens.after(at):
        start, end, tag, attributes, closes = token
        if start > at and not skip:
            opened.nodes[-1].parts.append(page[at:start])
        at = end
        if not tag:
            continue
        if closes:
            if skip:
                skip = "" if tag == skip else skip
                continue
            if tag in INLINE:
                continue
            if depth := opened.last((tag,)):
                opened.close(depth)
            # A stray end of a block still parts texts.
            opened.nodes[-1].parts.append(None)
            continue
        if tag in RAW and not (skip and attributes.endswith("/")):
            # Its content has no tokens: go on behind its end.
            over = re.compile(rf"</{re.escape(tag)}(?:[\s/][^>]*)?(?:>|\Z)", re.I).search(page, at)
            at = over.end() if over else len(page)
            continue
        if skip:
            continue
        if tag in SKIPPED and tag != "head":
            if not attributes.endswith("/") and tag not in VOID:
                skip = tag
            continue
        if tag in INLINE:
            if tag == "br":
                opened.nodes[-1].parts.append(" ")
            continue
        if opened.tags[-1] == "p":
            opened.close(len(opened.tags) - 1)
        if tag in SELF_CLOSING:
            alike = ("td", "th") if tag in ("td", "th") else ("dt", "dd") if tag in ("dt", "dd") else (tag,)
            depth = opened.last(alike)
            if depth > opened.last(SELF_CLOSING[tag]):
                opened.close(depth)
        if tag == "body" and (depth := opened.last(("head",))):
            # A head that was left open.
            opened.close(depth)
        if tag in VOID:
            opened.nodes[-1].parts.append(None)
            continue
        label, aside, marks = _label(tag, attributes)
        some |= bool(marks)
        opened.add(tag, Node(label, aside or tag == "head", marks), not attributes.endswith("/"))
    if at < len(page) and not skip:
        opened.nodes[-1].parts.append(page[at:])
    if some:
        _open_asides(root)
    return root


def clean(text: str) -> str:
    return " ".join(html.unescape(text).split())


def _digest(text: str) -> str:
    return hashlib.blake2b(text.encode(), digest_size=6).hexdigest()


def blocks(node: Node) -> Iterator[str]:
    """The texts of an element in order, what is beside the article left out."""
    run: list[str] = []
    for part in node.parts:
        if isinstance(part, str):
            run.append(part)
            continue
        if run and (text := clean("".join(run))):
            yield text
        run = []
        if part is not None and not part.aside:
            yield from blocks(part)
    if run and (text := clean("".join(run))):
        yield text


# A wrapper is a list: label, text (SLOT, a digest, or "" for none), characters of text, whether optional, whether repeated, and the parts.
LABEL, TEXT, CHARS, OPTIONAL, REPEATED, PARTS = range(6)


def page_wrapper(node: Node) -> list:
    """The expression of one page: neighbours of one kind form a repeated group."""
    texts, parts = [], []
    for part in node.parts:
        if isinstance(part, str):
            texts.append(part)
        elif part is not None and not part.aside:
            parts.append(page_wrapper(part))
    text = clean(" ".join(texts))
    digest = _digest(text) if text else ""
    return [node.label, digest, len(text), False, False, _fold(parts)]


def _fold(parts: list[list]) -> list[list]:
    """Put neighbours of one label into one repeated group."""
    out: list[list] = []
    for part in parts:
        if out and out[-1][LABEL] == part[LABEL]:
            merged = align(out[-1], part)
            merged[REPEATED] = True
            merged[CHARS] = out[-1][CHARS] + part[CHARS]
            out[-1] = merged
        else:
            out.append(part)
    return out


def align(one: list, two: list) -> list:
    """The expression of all that either of two with one label stands for."""
    text = one[TEXT] if one[TEXT] == two[TEXT] else SLOT
    parts = _fold(_align_parts(one[PARTS], two[PARTS]))
    return [one[LABEL], text, max(one[CHARS], two[CHARS]), one[OPTIONAL] or two[OPTIONAL], one[REPEATED] or two[REPEATED], parts]


def _align_parts(one: list[list], two: list[list]) -> list[list]:
    """Align two sequences by their labels in one pass; what only one of them has becomes optional."""
    if [part[LABEL] for part in one] == [part[LABEL] for part in two]:
        return [align(a, b) for a, b in zip(one, two)]
    ahead = [_places(one), _places(two)]
    out, i, j = [], 0, 0
    while i < len(one) and j < len(two):
        if one[i][LABEL] == two[j][LABEL]:
            out.append(align(one[i], two[j]))
            i, j = i + 1, j + 1
            continue
        # Where each side's element comes next on the other side; the nearer one is waited for.
        in_one, in_two = _next(ahead[0], two[j][LABEL], i, len(one)), _next(ahead[1], one[i][LABEL], j, len(two))
        if in_two is not None and (in_one is None or in_two - j <= in_one - i):
            out.extend(map(_optional, two[j:in_two]))
            j = in_two
        elif in_one is not None:
            out.extend(map(_optional, one[i:in_one]))
            i = in_one
        else:
            out += [_optional(one[i]), _optional(two[j])]
            i, j = i + 1, j + 1
    return out + list(map(_optional, one[i:])) + list(map(_optional, two[j:]))


def _optional(part: list) -> list:
    return [*part[:OPTIONAL], True, *part[REPEATED:]]


def _places(parts: list[list]) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {}
    for i, part in enumerate(parts):
        out.setdefault(part[LABEL], []).append(i)
    return out


def _next(places: dict[str, list[int]], label: str, at: int, end: int) -> int | None:
    own = places.get(label, [])
    k = bisect_left(own, at)
    return own[k] if k < len(own) and own[k] < end else None


def _chars(part: list) -> int:
    return part[CHARS] + sum(map(_chars, part[PARTS]))


def _texts(part: list, path: tuple[str, ...] = (), loose: bool = False) -> Iterator[tuple[tuple[str, ...], bool]]:
    """Labels from the root to every element with own text, and whether pages may differ in it."""
    loose = loose or part[OPTIONAL] or part[REPEATED]
    if part[TEXT]:
        yield path, loose or part[TEXT] == SLOT
    for child in part[PARTS]:
        yield from _texts(child, (*path, child[LABEL]), loose)


def article_paths(wrapper: list, template: bool) -> tuple[list[tuple[str, ...]], bool]:
    """Labels from the root to the article, and whether elements say that they are one.

    All outermost article elements; else the main elements; else the lowest element
    that holds all texts in which pages differ (all texts if there is no `template`).
    """
    said: dict[int, list[tuple[str, ...]]] = {1: [], 2: []}

    def visit(part: list, path: tuple[str, ...], inside: int) -> None:
        level = _said(part[LABEL])
        if level > inside and _chars(part):
            said[level].append(path)
        for child in part[PARTS]:
            visit(child, (*path, child[LABEL]), max(inside, level))

    visit(wrapper, (), 0)
    for level in (2, 1):
        if said[level]:
            return said[level], True
    texts = list(_texts(wrapper))
    held = [path for path, loose in texts if loose or not template] or [path for path, _ in texts]
    common = held[0] if held else ()
    for path in held:
        n = next((i for i, (a, b) in enumerate(zip(common, path)) if a != b), min(len(common), len(path)))
        common = common[:n]
    return [common], False


def elements(root: Node, paths: list[tuple[str, ...]]) -> Iterator[Node]:
    """The elements at the paths in the order of the page."""
    if () in paths:
        yield root
        return
    for part in root.parts:
        if isinstance(part, Node) and not part.aside and (rest := [path[1:] for path in paths if path[0] == part.label]):
            yield from elements(part, rest)


def fixed_texts(wrapper: list) -> list[str]:
    """Digests of the texts that all pages have: no slots, nor anything optional or repeated."""
    if wrapper[OPTIONAL] or wrapper[REPEATED]:
        return []
    own = [wrapper[TEXT]] if wrapper[TEXT] not in ("", SLOT) else []
    return own + [digest for part in wrapper[PARTS] for digest in fixed_texts(part)]


def main_text(page: str, paths: list[tuple[str, ...]] | None, said: bool, fixed: frozenset[str]) -> str:
    """The text of the article: of all elements at the paths of the wrapper, else of what the page itself suggests."""
    root = tree(page)
    found = list(elements(root, paths)) if paths else []
    if not found or not said:
        own_paths, own_said = article_paths(page_wrapper(root), False)
        if not found or own_said:
            found, said, fixed = list(elements(root, own_paths)), own_said, frozenset()
    texts = [text for node in found for text in blocks(node)]
    if not said and fixed:
        texts = [text for text in texts if _digest(text) not in fixed]
    return "\n".join(texts)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


_PARTIAL = "host string, wrapper string, pages long, seen array<string>"


def wrappers(pages: DataFrame) -> DataFrame:
    """`host`, `wrapper` (JSON), the number of `pages` with text behind it, and digests of TEMPLATE_PAGES texts `seen`, if there are as many: one row per host."""
    narrow = pages.select(host_of(F.col("url")).alias("host"), "html").filter(F.col("html").isNotNull())

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[list, int, set[str]]] = {}

        def emit() -> pa.RecordBatch:
            rows = [(host, json.dumps(wrapper), n, sorted(seen)) for host, (wrapper, n, seen) in held.items()]
            held.clear()
            columns = list(zip(*rows)) if rows else [(), (), (), ()]
            kinds = (pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()))
            return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(columns, kinds)], ["host", "wrapper", "pages", "seen"])

        for batch in batches:
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html")):
                root = tree(page.as_py())
                new, old = page_wrapper(root), held.get(host)
                if not _chars(new):
                    continue
                seen = old[2] if old else set()
                if len(seen) < TEMPLATE_PAGES:
                    seen.add(_digest("\n".join(blocks(root))))
                held[host] = (new, 1, seen) if old is None else (align(old[0], new), old[1] + 1, seen)
                if len(held) > HOSTS_AT_ONCE:
                    yield emit()
        yield emit()

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        made = [json.loads(text) for text in sorted(group["wrapper"])]
        whole = made[0]
        for other in made[1:]:
            whole = align(whole, other)
        seen = sorted({digest for part in group["seen"] for digest in part})[:TEMPLATE_PAGES]
        return pd.DataFrame({"host": group["host"].iloc[:1].tolist(), "wrapper": [json.dumps(whole)], "pages": [int(group["pages"].sum())], "seen": [seen]})

    level = stage(narrow.mapInArrow(infer, _PARTIAL), "wrappers")
    while True:
        sizes = level.groupBy("host").agg(F.count("*").alias("n"))
        most = sizes.agg(F.max("n")).first()[0] or 0
        if most <= 1:
            return level
        # Equal wrappers count once; groups of a host stay small whatever its pages.
        parts = max(1, -(-most // GROUP))
        member = F.pmod(F.xxhash64("wrapper", "pages"), F.lit(parts))
        equal = level.groupBy("host", "wrapper").agg(F.sum("pages").alias("pages"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_set("seen")))), 1, TEMPLATE_PAGES).alias("seen"))
        level = stage(equal.groupBy("host", member.alias("member")).applyInPandas(merge, _PARTIAL), "wrappers")


def extract(pages: DataFrame) -> DataFrame:
    """`page_id`, `url` and `text` of every page.

    A block's white space, after character references are decoded, is one space;
    blocks are joined by line ends in the order of the page. A null or empty html
    gives an empty text; a null url stands for a host of its own; repeated rows
    give equal results. Of several article elements all count. Pages
    cut off anywhere are read as far as they go. Other columns are not read. An
    empty table gives none.
    """
    ready(pages.sparkSession)
    known = wrappers(pages).select(F.col("host").alias("_host"), "wrapper", F.size("seen").alias("_pages"))
    narrow = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    joined = narrow.join(known, F.col("host") == F.col("_host"), "left").select("page_id", "url", "html", "wrapper", "_pages")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, paths, said, fixed = None, None, False, frozenset()
        for batch in batches:
            texts = []
            for page, wrapper, n in zip(batch.column("html"), batch.column("wrapper").to_pylist(), batch.column("_pages").to_pylist()):
                if wrapper != last:
                    last, made = wrapper, json.loads(wrapper) if wrapper else None
                    paths, said = article_paths(made, n >= TEMPLATE_PAGES) if made else (None, False)
                    fixed = frozenset(fixed_texts(made)) if made and n >= TEMPLATE_PAGES and not said else frozenset()
                texts.append(main_text(page.as_py() or "", paths, said, fixed))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = StructType([narrow.schema["page_id"], narrow.schema["url"], StructField("text", StringType()), StructField("n_chars", LongType())])
    return joined.mapInArrow(read, kinds)
