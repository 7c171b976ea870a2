"""Main text of web pages, with the help of a style tree per site.

A page's elements are named by their path of tags, classes and roles. For every
site the pages' trees are merged: per path, how many pages have it, with which
sequences of children (its styles), and with which texts. The importance of an
element is the entropy of its styles together with the importance of what is
below it, from the leaves up; that of a leaf says how much its texts vary. A
branch in which nothing is important is removed from the pages as a whole.

The merged tree is a table keyed by (host, path). It is made by counting rows,
so a site with a third of all pages is no single task's work, and importance goes
up it in as many rounds as the logarithm of its depth. Pages get the paths to
remove by a join on their sets of paths; they are parsed once.

Entropy cannot tell the article where menus, adverts and footers vary from page
to page. What it leaves open is decided in the tree by the elements' roles, as
HTML states them: a branch with a role like navigation has weight zero, and one
inside an article, which is never cut, has full weight.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html import unescape

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from admitflow.llm.common import by_batch
from admitflow.session import cut_lineage

# HTML's void, raw-text and block elements, and which elements a start tag ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements without main text, dropped with all that is in them. Those of the first
# group hold raw text: without an end tag they reach to the end of the page.
RAW = frozenset("script style textarea title iframe noscript".split())
DROPPED = RAW | frozenset("template svg select".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
ENDED_BY = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
}
# An element that keeps what is inside it from ending what is outside.
SCOPES = frozenset("article aside body div footer header html main nav ol section table td th ul dl".split())
# Roles without main text: by element, by word of a class or id, by role attribute.
NOISE_TAGS = frozenset("nav footer aside form header dialog menu button head".split())
NOISE_WORDS = frozenset(
    "ad ads advert advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice alert popup modal newsletter "
    "subscribe subscription nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header comment comments respond disqus share "
    "sharing social related recommended pagination pager widget login signup search toolbar masthead copyright".split()
)
# Words that may stand beside them in a class name ("site-footer") without changing what it means.
QUALIFIERS = frozenset(
    "site page main top bottom left right box block wrapper wrap container section area list bar inner outer item items posts links buttons icons content row col primary secondary global".split()
)
# Elements whose classes tell of the page as a whole, not of what they are.
WHOLES = frozenset(["html", "body", "main", "article"])
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
ARTICLES = frozenset(["article", "main"])
# Readers' comments stay noise even if each is an article.
STICKY = frozenset(["comment", "comments", "respond", "disqus"])
# An article has a header of its own.
OWN_HEADER = frozenset(["header"])

QUOTED = r"""(?:[^<>"']|"[^"<]*"|'[^'<]*')*+"""
MARKUP = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)({QUOTED}|[^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I)
ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in DROPPED}
SELF_CLOSED = re.compile(r"(?:^|[\s\"'])/\s*$")
WORD = re.compile(r"[a-z]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")

# The paper's damping of a node's own styles against what is below, by the number of styles.
GAMMA = 0.9
# A path on fewer pages says nothing; one of lower importance is removed.
LEAST_PAGES, LEAST_IMPORTANCE = 5, 0.35
# A block outside articles of which more than this is links is a list of links.
MOST_LINKS = 0.6
NEUTRAL, NOISE, ARTICLE = 0, 1, 2


@dataclass
class Element:
    tag: str
    path: int
    role: int
    sticky: bool = False
    children: list[int] = field(default_factory=list)


@dataclass
class Block:
    text: str
    path: int
    role: int
    links: float


def path_of(parent: int, name: str) -> int:
    return xxhash.xxh64_intdigest(f"{parent}>{name}") >> 1


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(source)} if source else {}


def noise_words(names: str) -> set[str]:
    """The noise words among class names and ids that consist of such words and qualifiers only: of ``sidebar-left``, not of ``has-sidebar``."""
    found: set[str] = set()
    for name in names.lower().split():
        words = set(WORD.findall(name))
        if words <= NOISE_WORDS | QUALIFIERS:
            found |= words & NOISE_WORDS
    return found


def _role(tag: str, attributes: dict[str, str], parent: Element) -> tuple[int, bool]:
    """The role of a new element, and whether it holds readers' comments."""
    words = set() if tag in WHOLES else noise_words(f"{attributes.get('class', '')} {attributes.get('id', '')}")
    sticky = parent.sticky or bool(words & STICKY)
    if sticky:
        return NOISE, True
    hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or bool(HIDDEN.search(attributes.get("style", "")))
    own = OWN_HEADER if parent.role == ARTICLE else frozenset()
    noise = tag in NOISE_TAGS - own or words & (NOISE_WORDS - own)
    if hidden or noise or attributes.get("role", "").lower() in NOISE_ROLES:
        return NOISE, False
    if tag in ARTICLES or attributes.get("role", "").lower() in ("main", "article"):
        return ARTICLE, False
    return parent.role, False


class Page:
    """The blocks and elements of one page, however broken its markup is."""

    def __init__(self, html: str):
        self.blocks: list[Block] = []
        self.styles: list[tuple[int, int]] = []  # path, hash of its children
        self.below: dict[int, list[int]] = {}  # path: its children, of all elements of that path
        self.roles: dict[int, int] = {}
        self.shown: set[int] = set()  # paths of elements with text in them
        self.stack = [Element("", 0, NEUTRAL)]
        self.open_tags: Counter = Counter()
        self.parts: list[str] = []
        self.linked = 0
        self.read(html)
        while len(self.stack) > 1:
            self.pop()
        self.flush()
        self.below[0] = self.stack[0].children

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                top = next(e for e in reversed(self.stack) if not e.tag or e.tag in BLOCKS)
                # Text of an inline element whose role is its own, such as a hidden one, is a branch of its own.
                own = self.stack[-1]
                path = top.path if own.role == top.role else path_of(top.path, f"#{own.role}")
                if path != top.path:
                    self.below.setdefault(top.path, []).append(path)
                    self.roles[path] = own.role
                self.blocks.append(Block(text, path, own.role, self.linked / len(text)))
                self.shown |= {path, top.path}
            self.parts, self.linked = [], 0

    def pop(self) -> None:
        if self.stack[-1].tag in BLOCKS:
            self.flush()
        top = self.stack.pop()
        self.open_tags[top.tag] -= 1
        kinds = [c for c, before in zip(top.children, [None, *top.children]) if c != before]
        self.styles.append((top.path, xxhash.xxh64_intdigest(repr(kinds)) >> 1))
        self.below.setdefault(top.path, []).extend(kinds)
        if top.path in self.shown:
            self.shown.add(self.stack[-1].path)

    def close(self, tag: str) -> None:
        """Close the nearest open element of that name; without one, the end tag says nothing."""
        if self.open_tags[tag]:
            while self.stack[-1].tag != tag:
                self.pop()
            self.pop()

    def end_implied(self, tags: frozenset[str]) -> None:
        if not any(self.open_tags[t] for t in tags):
            return
        for at in range(len(self.stack) - 1, 0, -1):
            if self.stack[at].tag in tags:
                while len(self.stack) > at:
                    self.pop()
                return
            if self.stack[at].tag in SCOPES:
                return

    def add_text(self, raw: str) -> None:
        if self.stack[-1].role != NOISE or self.stack[-1].tag in BLOCKS:
            text = unescape(raw) if "&" in raw else raw
            self.parts.append(text)
            if any(e.tag == "a" for e in self.stack[-3:]):
                self.linked += len(text.strip())

    def read(self, html: str) -> None:
        at = 0
        for m in iter(lambda: MARKUP.search(html, at), None):
            if m.start() > at:
                self.add_text(html[at : m.start()])
            at = m.end()
            tag = m[2].lower() if m[2] else None
            if tag is None:
                continue
            if m[1]:
                if tag == "br":
                    self.parts.append(" ")
                elif tag == "p" and not self.open_tags["p"]:
                    self.flush()
                else:
                    self.close(tag)
                continue
            if tag in DROPPED:
                end = None if SELF_CLOSED.search(m[3] or "") else ENDS[tag].search(html, at)
                if end:
                    at = end.end()
                elif tag in RAW and not SELF_CLOSED.search(m[3] or ""):
                    return
                continue
            if tag in VOID:
                if tag == "hr":
                    self.flush()
                elif tag in ("br", "wbr"):
                    self.parts.append(" " if tag == "br" else "")
                continue
            self.open(tag, m[3] or "")
        if at < len(html):
            self.add_text(html[at:])

    def open(self, tag: str, source: str) -> None:
        if tag in ENDED_BY:
            self.end_implied(ENDED_BY[tag])
        if tag in BLOCKS:
            self.end_implied(frozenset(["p"]))
            self.flush()
        if tag == "body":
            self.close("head")
        attributes = _attributes(source)
        parent = self.stack[-1]
        if tag in ARTICLES and parent.role == NOISE and not parent.sticky:
            # No menu holds an article: the elements around it were not closed.
            parent = next(e for e in reversed(self.stack) if e.role != NOISE)
        name = tag + "".join(f".{w}" for w in sorted(set(WORD.findall(attributes.get("class", "").lower()))))
        role, sticky = _role(tag, attributes, parent)
        path = path_of(parent.path, name if role == NEUTRAL else f"{name}#{role}")
        self.roles[path] = role
        parent.children.append(path)
        self.stack.append(Element(tag, path, role, sticky))
        self.open_tags[tag] += 1


def host_of(url: str | None) -> str:
    found = HOST.match(url or "")
    return found[1].lower() if found else ""


STYLE, TEXT, SHARE, OWN, ROLE = range(5)  # kinds of facts
WHOLE = 1 << 20  # shares are whole numbers of this, so that their sums do not depend on an order


def facts_of(page: Page) -> list[tuple[int, int, int, int]]:
    """(path, kind, value, n) of one page: an element's style; its texts; as a child with text, its
    parent and its share of it; the share of its own text in it; its role. The shares of an element add up to 1."""
    own = {b.path for b in page.blocks}
    facts = {(path, STYLE, style): 1 for path, style in dict(page.styles).items()}
    facts |= {(b.path, TEXT, xxhash.xxh64_intdigest(b.text) >> 1): 1 for b in page.blocks}
    facts |= {(path, ROLE, page.roles.get(path, NEUTRAL)): 1 for path in page.shown}
    for path in page.shown:
        shown = [p for p in page.below.get(path, ()) if p in page.shown]
        parts = Counter(shown)
        k = len(shown) + (path in own)
        for child, n in parts.items():
            facts[child, SHARE, path] = WHOLE * n // k
        if path in own:
            facts[path, OWN, 0] = WHOLE // k
    return [(*key, n) for key, n in facts.items()]


def parse(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, blocks, facts) of each page."""

    def make():
        def step(c):
            read = [Page(h or "") for h in c["html"]]
            blocks = [{"text": [b.text for b in p.blocks], "path": [b.path for b in p.blocks], "role": [b.role for b in p.blocks], "links": [b.links for b in p.blocks]} for p in read]
            facts = [[dict(zip(("path", "kind", "value", "n"), f)) for f in facts_of(p)] for p in read]
            return {"page_id": c["page_id"], "url": c["url"], "host": [host_of(u) for u in c["url"]], "blocks": blocks, "facts": facts}

        return step

    key = pages.schema["page_id"].dataType.simpleString()
    kinds = "struct<`text`: array<string>, path: array<long>, role: array<int>, links: array<double>>"
    facts = "array<struct<path: long, kind: int, value: long, n: long>>"
    return by_batch(pages.select("page_id", "url", "html"), f"page_id {key}, url string, host string, blocks {kinds}, facts {facts}", make)


def counts_of(parsed: DataFrame) -> DataFrame:
    """(host, path, kind, value, n): the facts of a site's pages, added up. For styles, texts and roles ``n`` counts pages."""
    facts = parsed.select("host", F.explode("facts").alias("f")).select("host", "f.*")
    return facts.groupBy("host", "path", "kind", "value").agg(F.sum("n").alias("n"))


def site_counts(pages: DataFrame) -> DataFrame:
    return counts_of(parse(pages))


def importance(counts: DataFrame) -> DataFrame:
    """(host, path, pages, styles, node, content, importance) of the merged tree.

    With m pages, ``node`` is the entropy to base m of the styles' shares: 0 if
    all pages show the same. A text on c pages has importance 1 - log_m c, and
    ``content`` is their mean by occurrence. The more styles, the more ``node`` counts.
    """
    styles = counts.where("kind = 0").groupBy("host", "path").agg(
        F.sum("n").alias("pages"), F.count(F.lit(1)).alias("styles"), F.sum(F.col("n") * F.log("n")).alias("s")
    )
    several = F.when(F.col("pages") > 1, F.log("pages"))
    # -sum p log p = log m - sum(n log n) / m
    node = F.coalesce((F.log("pages") - F.col("s") / F.col("pages")) / several, F.lit(1.0))
    texts = counts.where("kind = 1").groupBy("host", "path").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log("n")).alias("ts"))
    content = F.greatest(F.lit(0.0), F.coalesce(1 - F.col("ts") / F.col("t") / several, F.lit(1.0)))
    own = F.pow(F.lit(GAMMA), F.col("styles"))
    tree = styles.join(texts, ["host", "path"], "left").withColumn("node", node).withColumn("content", content)
    return tree.select("host", "path", "pages", "styles", "node", "content", ((1 - own) * F.col("node") + own * F.col("content")).alias("importance"))


def branches(counts: DataFrame) -> DataFrame:
    """(host, path, role, up, pages, composite, most) of the elements with text.

    ``composite`` is the importance of an element and of what is below it: in place
    of its own texts alone stands the mean, by their shares, of its children's
    composites and its own texts. It is a sum over all below, with the product of the
    shares in between as weights, so it is found by doubling the distance that a sum
    reaches. ``most`` is the highest composite in the branch, found likewise; an
    element on too few pages counts as important.
    """
    role = counts.where(F.col("kind") == ROLE).groupBy("host", "path").agg(F.max("value").cast("int").alias("role"))
    up = counts.where(F.col("kind") == SHARE).select("host", "path", F.col("value").alias("up"), F.col("n").alias("share"))
    mine = counts.where(F.col("kind") == OWN).select("host", "path", F.col("n").alias("mine"))
    children = up.groupBy("host", F.col("up").alias("path")).agg(F.sum("share").alias("shared"))
    tree = importance(counts).join(role, ["host", "path"], "right").join(up, ["host", "path"], "left").join(mine, ["host", "path"], "left")
    tree = tree.join(children, ["host", "path"], "left").fillna({"mine": 0, "shared": 0})
    # Text with a role of its own is an element without a style.
    own, node, content = F.pow(F.lit(GAMMA), F.coalesce("styles", F.lit(1))), F.coalesce("node", F.lit(0.0)), F.coalesce("content", F.lit(1.0))
    total = F.col("mine") + F.col("shared")
    first = (1 - own) * node + own * F.coalesce(F.try_divide(F.col("mine") * content, total), content)
    tree = tree.select(
        "host", "path", "role", "up", F.coalesce("pages", F.lit(0)).alias("pages"), "share", total.alias("total"), first.alias("composite"), own.alias("own")
    )
    above = tree.select("host", F.col("path").alias("up"), F.try_divide("own", "total").alias("_rate"))
    tree = tree.drop("own", "total").join(above, ["host", "up"], "left").withColumn("weight", F.coalesce(F.col("share") * F.col("_rate"), F.lit(0.0)))
    tree = cut_lineage(tree.select("host", "path", "role", "up", "pages", "weight", "composite"), "site-tree")
    tree = cut_lineage(_upward(tree, "composite", F.sum(F.col("weight") * F.col("composite")), F.col("composite") + F.coalesce("_sum", F.lit(0.0))), "composites")
    most = F.when(F.col("pages") < LEAST_PAGES, F.lit(1.0)).otherwise(F.col("composite"))
    return _upward(tree.withColumn("most", most), "most", F.max("most"), F.greatest("most", "_sum"))


def _upward(tree: DataFrame, name: str, gather, put) -> DataFrame:
    """Carry the numbers of ``name`` from every element to all above it, over twice the distance each round."""
    ends = tree.withColumns({"_far": F.col("up"), "_weight": F.col("weight")})
    while True:
        sums = ends.where(F.col("_far").isNotNull()).drop("weight").withColumnRenamed("_weight", "weight")
        sums = sums.groupBy("host", F.col("_far").alias("path")).agg(gather.alias("_sum"))
        far = ends.select("host", F.col("path").alias("_far"), F.col("_far").alias("_next"), F.col("_weight").alias("_times"))
        ends = ends.join(sums, ["host", "path"], "left").withColumn(name, put).drop("_sum").join(far, ["host", "_far"], "left")
        ends = ends.withColumns({"_far": F.col("_next"), "_weight": F.col("_weight") * F.coalesce("_times", F.lit(0.0))}).drop("_next", "_times")
        ends = cut_lineage(ends, "site-tree")
        if ends.where(F.col("_far").isNotNull()).isEmpty():
            return ends.select(*tree.columns)


def unimportant(tree: DataFrame) -> DataFrame:
    """(host, path, entropy) of the branches to remove: those in which nothing is important, and what entropy leaves of the noise. No part of an article is."""
    low = (F.col("pages") >= LEAST_PAGES) & (F.col("most") < LEAST_IMPORTANCE)
    cut = tree.where((F.col("role") == NOISE) | ((F.col("role") == NEUTRAL) & low))
    return cut.select("host", "path", low.alias("entropy"))


def removals(parsed: DataFrame, low: DataFrame) -> DataFrame:
    """(host, paths, removed array<long>): for every set of paths that the blocks of a site's pages lie on, those to remove. Sets without any are left out.

    Pages of a site are made alike, so there are far fewer such sets than pages.
    """
    sets = parsed.select("host", _paths()).distinct()
    shown = sets.select("host", "paths", F.explode("paths").alias("path"))
    return shown.join(low.select("host", "path"), ["host", "path"]).groupBy("host", "paths").agg(F.collect_list("path").alias("removed"))


def _paths():
    return F.array_sort(F.array_distinct("blocks.path")).alias("paths")


def kept_text(blocks: list[Block], removed: frozenset[int]) -> str:
    """What the tree leaves of a page: its article if there is one, else all but lists of links."""
    left = [b for b in blocks if b.path not in removed]
    kept = [b for b in left if b.role == ARTICLE] or [b for b in left if b.links <= MOST_LINKS]
    return "\n\n".join(b.text for b in kept)


def main_text(html: str | None, removed: frozenset[int] | None = None) -> str:
    """The text of a page, given the paths its site's tree removes; alone, a page is a site on whose tree entropy says nothing."""
    blocks = Page(html or "").blocks
    return kept_text(blocks, frozenset(b.path for b in blocks if b.role == NOISE) if removed is None else removed)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html).

    A page's text is what its site's tree leaves; where that has an article, the
    article. White space in a block is one space; blocks are joined by two line
    breaks. Null and empty pages have the empty text, rows that repeat are
    extracted each, and a null or strange url belongs to a site of its own kind.
    Other columns are not read.
    """
    parsed = cut_lineage(parse(pages), "parsed-pages")
    counts = cut_lineage(counts_of(parsed), "site-counts")
    low = cut_lineage(unimportant(branches(counts)), "low-branches")
    removed = cut_lineage(removals(parsed, low), "removals")
    sourced = parsed.select("page_id", "url", "host", "blocks", _paths()).join(removed, ["host", "paths"], "left").drop("host", "paths")

    def make():
        def step(c):
            texts = []
            for found, removed in zip(c["blocks"], c["removed"]):
                blocks = [Block(*b) for b in zip(found["text"], found["path"], found["role"], found["links"])]
                texts.append(kept_text(blocks, frozenset(removed or ())))
            return {"page_id": c["page_id"], "url": c["url"], "text": texts, "n_chars": list(map(len, texts))}

        return step

    key = pages.schema["page_id"].dataType.simpleString()
    return by_batch(sourced, f"page_id {key}, url string, text string, n_chars long", make)
