"""HTML extraction by union-free regular-expression inference over the pages of a host.

A page's token stream is read as a sequence of elements; streams of one host are aligned one after the other:
equal tokens stay, differing texts become text slots, neighbours of one kind become a repeated group (...)+ and what
only some pages have becomes an optional group (...)?. The result is the host's wrapper. Its slots say which texts of
a page are the article; the page is then read along the wrapper. A label keeps only what recurs on a share of the host's
pages (counted first), so the labels that a wrapper can have are bounded by the template, not by the number of pages. Pages
are aligned inside tasks, host by host, and the tasks' wrappers are aligned with each other in two rounds.
"""

from __future__ import annotations

import functools
import html
import json
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelens.llm.common import slices
from gatelens.session import cut_lineage

MAX_DEPTH = 48            # deeper elements count as children of their ancestor at this depth
HOSTS_IN_MEMORY = 2_000   # wrappers that a task holds before it hands them on
SALTS = 32
RECURS = 50               # a word or label recurs if one page in so many of the host has it, and two pages at least
COUNTS_IN_MEMORY = 200_000

# fixed values: HTML element kinds
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea".split())
BLOCK = frozenset("""address article aside blockquote body button caption center dd details dialog div dl dt fieldset
    figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol
    option p pre section select summary table tbody td template tfoot th thead title tr ul""".split())
CLOSES = {"p": frozenset(BLOCK), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
          "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]),
          "option": frozenset(["option"]), "head": frozenset(["body"])}     # an open element and what ends it unsaid
ASIDE_TAGS = frozenset("""head title nav header footer aside form noscript template button select option textarea menu
    dialog iframe object audio video canvas svg fieldset""".split())
ASIDE_WORDS = frozenset("""ad ads advert adverts advertisement banner sponsor sponsored promo sidebar side menu nav navbar
    navigation breadcrumb breadcrumbs header masthead footer cookie cookies consent notice notices alert popup modal
    overlay comment comments disqus replies reply respond share sharing social related recommended newsletter subscribe
    signup login search widget widgets toolbar pagination pager skip complementary contentinfo""".split())
ASIDE_BEFORE = frozenset("""site page global main top bottom left right upper lower primary secondary sub mobile desktop
    sticky fixed floating user reader blog""".split())       # main-menu, left-sidebar
ASIDE_AFTER = frozenset("""wrapper wrap container box list area section block bar item items inner outer link links panel
    slot unit group row col column content form button buttons icon icons post posts article articles story stories text
    body zone space thread left right top bottom main primary secondary""".split())    # ad-slot, comments-area
NOT_ASIDE = frozenset("no not non without with has have is hide show".split())           # has-sidebar, no-sidebar
HIDDEN = "!hidden"        # the word that a label has for an element hidden by an attribute
LANDMARK_TAGS = ("article", "main")
LANDMARK_WORDS = frozenset("article main content post entry story body".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*(?:"|\Z)|=\s*'[^']*(?:'|\Z)|[^>])*)>?""", re.S)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"?|'[^']*'?|[^\s>]+))?""")
_PARTS = re.compile(r"[-_]+")
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>?", re.I) for t in RAW}
_DIGITS = re.compile(r"\d+")


def _hidden(attributes: str) -> bool:
    """True for the attributes hidden, aria-hidden=true and a style with display:none, whatever other values say."""
    low = attributes.lower()
    if "hidden" not in low and "display" not in low:
        return False
    values = {name: value.strip("\"' ") for name, value in _ATTRIBUTE.findall(low)}
    return "hidden" in values or values.get("aria-hidden") == "true" or "display:none" in "".join(values.get("style", "").split())


def tokens(page: str) -> Iterator[tuple[str, str]]:
    """('text', decoded), ('open', label), ('close', tag) and ('break', '') in page order; a label is the tag with the
    words of class, id and role. Inline elements leave only their text; scripts, styles and comments leave nothing."""
    at, open_tags = 0, []
    text: list[str] = []
    end = len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at:m.start()])
        at = max(m.end(), at + 1)
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in BLOCK and tag in open_tags:
                if text:
                    yield "text", html.unescape("".join(text))
                    text = []
                while True:
                    top = open_tags.pop()
                    yield "close", top
                    if top == tag:
                        break
            continue
        if tag in RAW:
            stop = _RAW_END[tag].search(page, at)
            at = stop.end() if stop else end
            continue
        if tag not in BLOCK:
            if tag == "br":
                text.append(" ")
            continue
        if text:
            yield "text", html.unescape("".join(text))
            text = []
        while open_tags and tag in CLOSES.get(open_tags[-1], ()):
            yield "close", open_tags.pop()
        if tag in VOID:
            yield "break", ""
            continue
        label = tag
        if "=" in m[3]:
            names = " ".join(n.strip("\"'") for n in _NAMED.findall(m[3])).lower()
            label += "." + " ".join(_DIGITS.sub("0", names).split()) if names else ""
            if _hidden(m[3]):
                label += " " + HIDDEN if "." in label else f". {HIDDEN}"
        elif _hidden(m[3]):
            label += f". {HIDDEN}"
        open_tags.append(tag)
        yield "open", label
    if text:
        yield "text", html.unescape("".join(text))
    while open_tags:
        yield "close", open_tags.pop()


# A wrapper node is [label, repeated, optional, children, text]: label "#" is a text slot, whose text is a checksum
# while all pages agree and None when they differ. The root's text is the number of pages (2 stands for more).

def _append(children: list, node: list) -> None:
    """Add a node after its siblings; a neighbour of the same label makes the two a repeated group."""
    if children and children[-1][0] == node[0]:
        children[-1] = merge(children[-1], node)
        children[-1][1] = True
    else:
        children.append(node)


def merge(a: list, b: list) -> list:
    """Align two nodes of one label."""
    return [a[0], a[1] or b[1], a[2] or b[2], align(a[3], b[3]), a[4] if a[4] == b[4] else None]


def align(a: list, b: list) -> list:
    """Align two sequences: a longest common subsequence of labels stays, the rest becomes optional."""
    if [x[0] for x in a] == [x[0] for x in b]:
        return [merge(x, y) for x, y in zip(a, b)]
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i][0] == b[j][0] else max(best[i + 1][j], best[i][j + 1])
    out: list = []
    i = j = 0
    while i < n or j < m:
        if i < n and j < m and a[i][0] == b[j][0]:
            node, i, j = merge(a[i], b[j]), i + 1, j + 1
        elif j == m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            node, i = [a[i][0], a[i][1], True, a[i][3], a[i][4]], i + 1
        else:
            node, j = [b[j][0], b[j][1], True, b[j][3], b[j][4]], j + 1
        _append(out, node)
    return out


def page_wrapper(page: str) -> list:
    """The token stream of one page as a wrapper: repeated neighbours are folded already."""
    root = ["", False, False, [], 1]
    stack = [root]
    depth = 0
    for kind, value in tokens(page):
        if kind == "open":
            depth += 1
            if depth <= MAX_DEPTH:
                stack.append([value, False, False, [], 0])
        elif kind == "close":
            if depth <= MAX_DEPTH:
                node = stack.pop()
                _append(stack[-1][3], node)
            depth -= 1
        elif kind == "text" and (plain := " ".join(value.split())):
            _append(stack[-1][3], ["#", False, False, [], zlib.crc32(plain.encode())])
    return root


def add_pages(a: list, b: list) -> list:
    both = merge(a, b)
    both[4] = 2
    return both


def expression(node: list) -> str:
    """The wrapper as a union-free regular expression over tags and text slots."""
    inner = "".join(expression(c) for c in node[3])
    if node[0] == "#":
        text = "#" if node[4] is None else f"[{node[4]:x}]"
    else:
        text = f"<{node[0]}>{inner}</{node[0].split('.')[0]}>" if node[0] else inner
    return f"({text})" + "+" * node[1] + "?" * node[2] if node[1] or node[2] else text


def aside_word(word: str) -> bool:
    """True if a class, id or role names an aside: an aside word, alone or with parts that say where it is or what it
    holds. A part that negates or tells of a state (no-sidebar, has-sidebar), a utility class (overflow-hidden, md:nav) or
    the head of the content (content-header) names none."""
    parts = [p for p in _PARTS.split(word) if p and p != "0"]
    if ":" in word or not NOT_ASIDE.isdisjoint(parts) or ASIDE_WORDS.isdisjoint(parts):
        return False
    n = next(n for n, p in enumerate(parts) if p in ASIDE_WORDS)
    before = ASIDE_BEFORE if parts[n] in ("header", "masthead") else ASIDE_BEFORE | LANDMARK_WORDS
    return all(p in before for p in parts[:n]) and all(p in ASIDE_WORDS or p in ASIDE_AFTER for p in parts[n + 1:])


def landmark_word(word: str) -> bool:
    parts = _PARTS.split(word)
    return not LANDMARK_WORDS.isdisjoint(parts) and ASIDE_WORDS.isdisjoint(parts)


def _aside(label: str) -> bool:
    """True if the element is an aside whatever it holds."""
    tag, _, names = label.partition(".")
    return tag in ASIDE_TAGS or tag not in ("html", "body", "main", "article") and HIDDEN in names.split()


def _named_aside(label: str) -> bool:
    tag, _, names = label.partition(".")
    return tag not in ("html", "body", "main", "article") and any(map(aside_word, names.split()))


def content_paths(wrapper: list) -> tuple[list[str], list[str]]:
    """Label paths of the wrapper's content slots: those to read, and those to read in pages that have none of them.

    Slots under an aside element (by tag or name) are none. An element named like an aside is none if it holds the
    host's landmark (its main; its article, if none is elsewhere) or, without a landmark, most of the differing slots. Of
    the rest, those under a landmark (article, main, or failing that an element named like one) are read first; otherwise
    all whose text differs between pages, and all of them if the wrapper stems from a single page or no text differs.
    """
    found: list[tuple[tuple[str, ...], object, tuple[int, ...]]] = []      # path, text, places of the named asides above
    stack = [((), child, ()) for child in wrapper[3]]
    while stack:
        path, node, named_above = stack.pop()
        if node[0] == "#":
            found.append((path, node[4], named_above))
        elif not _aside(node[0]):
            above = (*named_above, len(path)) if _named_aside(node[0]) else named_above
            stack += [(path + (node[0],), child, above) for child in node[3]]

    def tagged(tag: str):
        return lambda label: label.partition(".")[0] == tag

    def named(label: str) -> bool:
        return any(map(landmark_word, label.partition(".")[2].split()))

    def first_place(path: tuple[str, ...], test) -> int:
        return next((n for n, x in enumerate(path) if test(x)), -1)
    kept: set[tuple[str, ...]] = set()      # elements named like an aside that are none
    open_article = any(first_place(p, tagged("article")) >= 0 for p, _, above in found if not above)
    open_main = any(first_place(p, tagged("main")) >= 0 for p, _, above in found if not above)
    for tag, needed in (("main", True), ("article", not open_article and not open_main)):
        for p, _, above in found if needed else ():
            at = first_place(p, tagged(tag))
            kept |= {p[:n + 1] for n in above if n < at}
    if not kept and not open_article and not open_main:
        telling = [x for x in found if x[1] is None] if wrapper[4] > 1 else []
        under: dict[tuple[str, ...], int] = {}
        for p, _, above in telling or found:
            for n in above:
                under[p[:n + 1]] = under.get(p[:n + 1], 0) + 1
        share = 0.75 if any(not above for _, _, above in telling or found) else 0.5      # half if all are under such names
        kept = {p for p, n in under.items() if n > share * len(telling or found)}
    slots = [(p, text) for p, text, above in found if all(p[:n + 1] in kept for n in above)]
    differing = [s for s in slots if s[1] is None] if wrapper[4] > 1 else []
    other = sorted({"/".join(p) for p, _ in differing or slots})
    for test in (tagged("article"), tagged("main"), named):
        inside = [s for s in slots if any(test(x) for x in s[0])]
        if inside:
            return sorted({"/".join(p) for p, _ in inside}), other
    return other, other


def extract(page: str, paths: frozenset[str], labels: Labels | None = None) -> str:
    """The texts of the content slots, one line per block; ``labels`` folds the page's labels as the wrapper's were."""
    blocks: list[str] = []
    stack = [""]
    depth = 0
    run: list[str] = []

    def close() -> None:
        plain = " ".join(" ".join(run).split()) if run else ""
        if plain:
            blocks.append(plain)
        run.clear()

    for kind, value in tokens(page):
        if kind == "text":
            if stack[-1] in paths:
                run.append(value)
            continue
        close()
        if kind == "open":
            depth += 1
            if depth <= MAX_DEPTH:
                value = value if labels is None else labels[value]
                stack.append(f"{stack[-1]}/{value}" if stack[-1] else value)
        elif kind == "close":
            if depth <= MAX_DEPTH:
                stack.pop()
            depth -= 1
    close()
    return "\n".join(blocks)


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)), F.lit(""))


def _items(node: list, out: set) -> set:
    """The labels with words of a page's wrapper, and their words."""
    for child in node[3]:
        _, dot, names = child[0].partition(".")
        if dot and child[0] not in out:
            out.add(child[0])
            out.update("." + n for n in names.split())
        _items(child, out)
    return out


class Labels(dict):
    """Labels as a host's wrapper has them, from the recurring labels and words with their numbers of pages.

    A label that recurs stays. Of another one stay its most frequent recurring word, and one word for each role that its
    words name (aside, landmark, hidden); without ``recurring`` (a host of one page) all labels stay.
    """

    def __init__(self, recurring: str | None):
        super().__init__()
        self.pages = json.loads(recurring) if recurring else None

    def __missing__(self, label: str) -> str:
        tag, dot, names = label.partition(".")
        folded = label
        if dot and self.pages is not None and label not in self.pages:
            words = names.split()
            best = min((w for w in words if "." + w in self.pages), key=lambda w: (-self.pages["." + w], w), default=None)
            kept = [best] if best else []
            kept += [role for role, test in (("sidebar", aside_word), ("content", landmark_word), (HIDDEN, HIDDEN.__eq__))
                     if any(map(test, words)) and not any(map(test, kept))]
            folded = ".".join([tag, " ".join(kept)]) if kept else tag
        if len(self) >= COUNTS_IN_MEMORY:
            self.clear()
        self[label] = folded
        return folded


@functools.lru_cache(256)
def _labels(recurring: str | None) -> Labels:
    return Labels(recurring)


def fold(node: list, labels: Labels) -> list:
    """A page's wrapper with folded labels; neighbours that became alike are a repeated group."""
    children: list = []
    for child in node[3]:
        _append(children, fold(child, labels))
    return [labels[node[0]], node[1], node[2], children, node[4]]


def _wrap_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        wrapped = [json.dumps(page_wrapper(page or ""), separators=(",", ":")) for page in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(wrapped, pa.string())], names=["host", "wrapper"])


def _count_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, item, pages) of the task; the item '' counts the host's pages."""
    own: dict[tuple[str, str], int] = {}

    def hand_on() -> pa.RecordBatch:
        host, item = list(zip(*own)) or [()] * 2
        out = pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(item, pa.string()), pa.array(own.values(), pa.int64())],
                                         names=["host", "item", "pages"])
        own.clear()
        return out
    for b in slices(batches):
        for host, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for item in _items(json.loads(w), {""}):
                own[host, item] = own.get((host, item), 0) + 1
        if len(own) > COUNTS_IN_MEMORY:
            yield hand_on()
    yield hand_on()


def recurring_labels(wrapped: DataFrame) -> DataFrame:
    """(label_host, recurring): JSON of a host's recurring labels and words with their pages; null for one page alone."""
    counts = wrapped.mapInArrow(_count_items, "host string, item string, pages long") \
        .groupBy("host", "item").agg(F.sum("pages").alias("pages"))
    counts = cut_lineage(counts)
    totals = counts.where("item = ''").select(F.col("host").alias("label_host"), F.col("pages").alias("total"))
    often = counts.join(totals, F.col("host") == F.col("label_host")).where(f"item = '' OR pages >= 2 AND pages * {RECURS} >= total")
    return often.groupBy("label_host").agg(F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("item", "pages"))).alias("found")) \
        .select("label_host", F.when(F.col("total") > 1, F.to_json(F.map_from_entries("found"))).alias("recurring"))


def _wrap_in_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own: dict[str, list] = {}

    def hand_on() -> pa.RecordBatch:
        rows = [(h, zlib.crc32(w.encode()) % SALTS, w) for h, w in ((h, json.dumps(w)) for h, w in own.items())]
        own.clear()
        host, salt, w = list(zip(*rows)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(salt, pa.int32()), pa.array(w, pa.string())],
                                          names=["host", "salt", "wrapper"])
    for b in slices(batches):
        for host, w, recurring in zip(*(b.column(i).to_pylist() for i in range(3))):
            w = fold(json.loads(w), _labels(recurring))
            own[host] = add_pages(own[host], w) if host in own else w
        if len(own) > HOSTS_IN_MEMORY:
            yield hand_on()
    yield hand_on()


def _wrap_together(frame: pd.DataFrame) -> pd.DataFrame:
    wrapper = None
    for w in sorted(frame["wrapper"]):
        wrapper = json.loads(w) if wrapper is None else add_pages(wrapper, json.loads(w))
    return pd.DataFrame({"host": frame["host"].iloc[:1], "salt": [0], "wrapper": [json.dumps(wrapper)]})


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper, recurring): the wrapper of every host as JSON, from all its pages, and its recurring labels."""
    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html"))
    schema = "host string, salt int, wrapper string"
    wrapped = cut_lineage(rows.mapInArrow(_wrap_pages, "host string, wrapper string"))
    recurring = cut_lineage(recurring_labels(wrapped))
    return wrapped.join(recurring, F.col("host") == F.col("label_host")).select("host", "wrapper", "recurring") \
        .mapInArrow(_wrap_in_tasks, schema) \
        .groupBy("host", "salt").applyInPandas(_wrap_together, schema) \
        .groupBy("host").applyInPandas(_wrap_together, schema).join(recurring, F.col("host") == F.col("label_host")) \
        .select("host", "wrapper", "recurring")


def extract_articles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every page, read along its host's wrapper.

    White space inside a block becomes one space, blocks are joined by line feeds in page order, character references
    are decoded. A null or empty html, or one without content, gives the empty string. A url without host is of the
    host ''. Repeated rows are pages of their own and give equal rows; null ids and urls stay null. Only the three
    named columns are read. Elements nested deeper than MAX_DEPTH count as part of their ancestor at that depth.
    """
    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            first, other = zip(*(content_paths(json.loads(w)) for w in b.column(1).to_pylist()))
            kind = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(first, kind), pa.array(other, kind), b.column(2)],
                                             names=["wrapped_host", "first", "other", "recurring"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [extract(page or "", frozenset(p), _labels(r)) or extract(page or "", frozenset(q), _labels(r))
                     for page, p, q, r in zip(*(b.column(i).to_pylist() for i in (2, 3, 4, 5)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html"))
    # a table of its own: the join shuffles both sides itself and can split the pages of a hot host
    slots = cut_lineage(infer_wrappers(rows).mapInArrow(paths, "wrapped_host string, first array<string>, other array<string>, recurring string"))
    return rows.withColumn("host", host_of(F.col("url"))).join(slots, F.col("host") == F.col("wrapped_host")) \
        .select("page_id", "url", "html", "first", "other", "recurring").mapInArrow(read, "page_id long, url string, text string, n_chars long")
