"""Main text of web pages by deducing the templates they share.

Tokens of a page are its element roles (a tag with the path that leads to it) and its
whole blocks of text, in articles as well. Tokens that occur equally often in the same
pages of a host form an equivalence class; classes that are seen often enough, keep one
order and lie in the same slots of the class that all pages have are the template. What lies between a
page's template tokens are its slots; the article's are the text, those of menus, adverts
and the like are not.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settle

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea iframe svg canvas audio video select option button annotation annotation-xml".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr math semantics mrow mi mn mo ms mtext mspace msup msub msubsup mfrac msqrt mroot "
    "mover munder munderover mstyle mpadded mphantom menclose".split())
#: Elements that end an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav "
    "ol p pre section table ul".split())
#: Elements that are closed by another of the same family.
SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
           "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"},
         "td": {"tr", "table"}, "th": {"tr", "table"}, "p": {"td", "th", "table", "button", "article", "div", "section", "body"}}

#: Elements whose slots never belong to the article.
BOILERPLATE = frozenset("nav footer aside form head menu dialog".split())
#: Roles and words in classes and ids that mean the same.
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu form".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disqus footer menu nav navbar navigation newsletter notice notices pager pagination popup promo promoted recommended "
    "related share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
#: Words that may stand beside these in a class or an id without changing what it says.
NEUTRAL = frozenset(
    "area article articles bar block body bottom box button buttons container content entry footer form group header inner item "
    "items js left link links list main module outer page panel post posts row section signup site slot stories story text thread "
    "title top right unit wrap wrapper".split())
ARTICLE = frozenset("article main".split())
ARTICLE_MARKS = frozenset("article content main post entry story".split())

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_WORD = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class Settings:
    """How pages of a host are grouped, and when a class counts as template."""

    #: Pages of one host that deduce a template together; larger hosts are several groups.
    group_pages: int = 256
    #: A class is valid if it lies in this share of its group's pages, and its tokens keep one order.
    support: float = 0.5
    #: A constant block needs this many pages of different content.
    least_pages: int = 4
    #: Bytes of pages that deduce a template together; groups of larger pages hold fewer.
    group_bytes: int = 64 << 20


SETTINGS = Settings()


@dataclass
class Slot:
    """A block of text: the role it lies in, and what its elements say about it."""

    #: The hash of the tags and names from the page's root on.
    role: int
    text: str
    boilerplate: bool
    article: int
    #: Elements that begin before it.
    before: int = 0


def marked_words(value: str) -> bool:
    """Whether a class or an id names boilerplate: by such words alone, neutral ones and numbers aside.

    ``share-links`` and ``cookie notice`` do; ``share price`` and ``related-work`` name something of their own.
    """
    words = set(_WORD.findall(value.lower()))
    return bool(words & MARKS) and all(w in MARKS or w in NEUTRAL or w.isdigit() for w in words)


class Parser:
    """Reads a page into roles and blocks, forgiving about unclosed elements.

    A role is a hash of its parent's and its own name, so a page takes memory by its elements, however deep they nest.
    """

    def __init__(self, page: str):
        self.roles: list[int] = []
        self.slots: list[Slot] = []
        # An open element: tag, number. By number: parent, whether its tag or role makes it
        # boilerplate, whether it is a header, whether its class words do, whether it marks an article.
        self.open: list[tuple[str, int]] = [("", 0)]
        self.open_tags: Counter[str] = Counter()
        self.elements: list[tuple[int, bool, bool, bool, bool]] = [(0, False, False, False, False)]
        self.keys: list[int] = [0]  # the role of each element
        self.names: list[tuple[str, bool]] = [("", False)]  # its tag, and whether it is named like an article
        self.holders: list[int] = []  # the element of each slot
        self.parts: list[str] = []
        self.articles = 0
        self.unclosed: dict[str, int] = {}  # of an embedded tag: up to where it has no end
        self._read(page)
        self._judge()

    def _read(self, page: str) -> None:
        at, length = 0, len(page)
        while at < length:
            m = _MARKUP.search(page, at)
            if m is None:
                self.parts.append(page[at:])
                break
            if m.start() > at:
                self.parts.append(page[at:m.start()])
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                continue
            if m[1]:
                self._close(tag)
            elif tag in ("script", "style"):
                # Their text is not markup: go on behind the end tag.
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = end.end() if end else length
            elif tag in RAW:
                if not m[3].rstrip().endswith("/"):
                    at = self._end_of(page, tag, at)
            else:
                self._start(tag, m[3])
        self._flush()

    def _end_of(self, page: str, tag: str, at: int) -> int:
        """Behind the end tag of an embedded element that begins at ``at``.

        One that is still open where an element around it ends, or the page, has no content:
        what follows is the page's.
        """
        if at < self.unclosed.get(tag, 0):
            return at
        inside: Counter[str] = Counter()
        stop = len(page)
        for m in _MARKUP.finditer(page, at):
            other = (m[2] or "").lower()
            if not other or other in VOID:
                continue
            if not m[1]:
                inside[other] += not m[3].rstrip().endswith("/")
            elif other == tag:
                return m.end()
            elif inside[other]:
                inside[other] -= 1
            elif other not in INLINE and self.open_tags[other]:
                stop = m.start()
                break
        self.unclosed[tag] = stop
        return at

    def _flush(self) -> None:
        text = " ".join(entities.unescape("".join(self.parts)).split()) if self.parts else ""
        self.parts = []
        if text:
            number = self.open[-1][1]
            self.slots.append(Slot(self.keys[number], text, False, 0, len(self.roles)))
            self.holders.append(number)

    def _start(self, tag: str, attributes: str) -> None:
        if tag not in INLINE:
            self._flush()
        if tag in VOID:
            return
        if tag in ENDS_P:
            self._pop_until({"p"}, SCOPE["p"])
        if tag in SIBLING:
            self._pop_until(SIBLING[tag], SCOPE[tag])
        parent = self.open[-1][1]
        label, mark, named, roles = tag, False, False, set()
        if attributes:
            found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
            name = found.get("class") or found.get("id") or ""
            mark = marked_words(found.get("class", "")) or marked_words(found.get("id", ""))
            named = bool(ARTICLE_MARKS & set(_WORD.findall(name.lower())))
            roles = set(found.get("role", "").lower().split())
            if name:
                label += "." + name
            if "hidden" in found or found.get("aria-hidden") == "true":
                roles.add("alert")
        starts = tag in ARTICLE or "main" in roles or "article" in roles
        self.elements.append((parent, tag in BOILERPLATE or bool(roles & ROLES), tag == "header", tag != "body" and mark, starts))
        self.keys.append(token_hash(f"{self.keys[parent]}/{label}"))
        self.names.append((tag, named))
        self.roles.append(self.keys[-1])
        self.open.append((tag, len(self.elements) - 1))
        self.open_tags[tag] += 1

    def _judge(self) -> None:
        """Say of each slot whether it is boilerplate and which article it lies in.

        A class mark does not hold for an element around the page's article or, without one
        outside of marks, around most of its text.
        """
        many = len(self.elements)
        hard, marked, inside = [False] * many, [False] * many, [0] * many
        for i, (parent, element, header, mark, starts) in enumerate(self.elements):
            hard[i] = hard[parent] or element or (header and not inside[parent])
            marked[i] = marked[parent] or mark
            inside[i] = inside[parent] or (i if starts and not hard[i] else 0)
        lifted: set[int] = set()
        if any(marked) and not any(a == i and i and not marked[i] for i, a in enumerate(inside)):
            mass, free = [0] * many, 0
            for s, i in zip(self.slots, self.holders):
                if not hard[i]:
                    mass[i] += len(s.text)
                    free += 0 if marked[i] else len(s.text)
            for i in range(many - 1, 0, -1):
                mass[self.elements[i][0]] += mass[i]
            # The page's article: the fullest one without a mark of its own.
            fullest = max((i for i, e in enumerate(self.elements) if e[4] and not e[3] and not hard[i]), key=lambda i: mass[i], default=0)
            if fullest and mass[fullest] >= free:
                while fullest:
                    lifted.add(fullest)
                    fullest = self.elements[fullest][0]
            else:
                lifted = {i for i in range(many) if 2 * mass[i] > mass[0]}
        boilerplate, article = [False] * many, [0] * many
        for i, (parent, element, header, mark, starts) in enumerate(self.elements):
            boilerplate[i] = boilerplate[parent] or element or (header and not article[parent]) or (mark and i not in lifted)
            article[i] = article[parent]
            if starts and not boilerplate[i] and not article[i]:
                self.articles += 1
                article[i] = self.articles
        for s, i in zip(self.slots, self.holders):
            s.boilerplate, s.article = boilerplate[i], article[i]

    def _cut(self, i: int) -> None:
        for tag, _ in self.open[i:]:
            self.open_tags[tag] -= 1
        del self.open[i:]

    def _pop_until(self, tags: set[str], stop: set[str]) -> None:
        if not any(self.open_tags[t] for t in tags):
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] in tags:
                self._flush()
                self._cut(i)
                return
            if self.open[i][0] in stop:
                return

    def _close(self, tag: str) -> None:
        if tag not in INLINE:
            self._flush()
        if not self.open_tags[tag]:
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                self._cut(i)
                return
            if tag in INLINE and self.open[i][0] not in INLINE:
                return  # an inline end tag does not close blocks


def tokens_of(page: Parser) -> tuple[list[int], set[int]]:
    """The hashes of a page's element roles and blocks of text, as they follow; and which are blocks."""
    out, blocks, at = [], set(), 0
    for s in page.slots:
        out += page.roles[at:s.before]
        at = s.before
        key = block_hash(s)
        out.append(key)
        blocks.add(key)
    return out + page.roles[at:], blocks


def token_hash(name: str) -> int:
    return xxhash.xxh3_64_intdigest(name.encode("utf-8", "surrogatepass")) - (1 << 63)


def block_hash(slot: Slot) -> int:
    return token_hash(f"t{slot.role}\0{slot.text}")


def main_text(page: Parser, template: frozenset[int]) -> str:
    """The article's slots of a page, joined.

    The changing slots are the blocks that neither are boilerplate nor part of the
    template. If elements mark an article, its own are the text. Otherwise those of the
    largest region are: the deepest element with most of the changing text.
    """
    free = [(s, i) for s, i in zip(page.slots, page.holders) if not s.boilerplate and block_hash(s) not in template]
    if page.articles:
        return " ".join(s.text for s, _ in free if s.article)
    many = len(page.elements)
    held, depth = [0] * many, [0] * many
    for s, i in free:
        held[i] += len(s.text)
    total = sum(held)
    for i in range(many - 1, 0, -1):
        held[page.elements[i][0]] += held[i]
    mass: Counter[int] = Counter()
    for i in range(many):
        mass[page.keys[i]] += held[i]
        depth[i] = depth[page.elements[i][0]] + 1 if i else 0
    regions = [i for i, (tag, _) in enumerate(page.names) if 10 * mass[page.keys[i]] >= 6 * total and tag not in INLINE and tag != "p"]
    named = [i for i in regions if page.names[i][1]]
    region = page.keys[max(named or regions, key=lambda i: depth[i], default=0)]
    inside = [False] * many
    for i in range(many):
        inside[i] = page.keys[i] == region or (i > 0 and inside[page.elements[i][0]])
    return " ".join(s.text for s, i in free if inside[i])


def in_order(base: list[int], places: dict[int, int]) -> list[int]:
    """The most tokens of ``base`` whose places ascend."""
    tails, at, back = [], [], {}
    for token in base:
        i = bisect_left(tails, places[token])
        back[token] = at[i - 1] if i else None
        tails[i:i + 1], at[i:i + 1] = [places[token]], [token]
    out, token = [], at[-1] if at else None
    while token is not None:
        out.append(token)
        token = back[token]
    return out[::-1]


def deduce_template(pages: list[Parser], s: Settings) -> frozenset[int]:
    """The tokens of the valid classes of a group of pages.

    Pages with the same changing text (their article's, or all of it) are one page that
    is copied, and count once. The root is the class of what stands once on all pages, as far
    as it keeps one order. Other tokens are valid if they lie in the same slots of the root,
    the gaps between two neighbours of it, on all their pages.
    """
    distinct: dict[str, Parser] = {}
    for page in pages:
        own = [x for x in page.slots if not x.boilerplate and (x.article or not page.articles)]
        distinct.setdefault(" ".join(x.text for x in own), page)
    read = [tokens_of(page) for page in distinct.values()]
    places: list[dict[int, list[int]]] = []
    for tokens, _ in read:
        own: dict[int, list[int]] = {}
        for at, token in enumerate(tokens):
            own.setdefault(token, []).append(at)
        places.append(own)
    seen = Counter(token for own in places for token in own)
    blocks = set().union(*(b for _, b in read)) if read else set()
    in_article = {block_hash(x) for page in distinct.values() for x in page.slots if x.article}
    outside = max(2, min(s.least_pages, len(read)))
    least = {token: s.least_pages if token in in_article else outside for token in blocks}
    frequent = {t for t, n in seen.items() if n >= s.support * len(read) and n >= least.get(t, outside)}
    classes: dict[tuple, list[int]] = {}
    for token in dict.fromkeys(t for tokens, _ in read for t in tokens if t in frequent):
        vector = tuple((i, len(own[token])) for i, own in enumerate(places) if token in own)
        classes.setdefault(vector, []).append(token)
    root: list[int] = []
    loose: list[int] = []
    for vector, tokens in sorted(classes.items(), key=lambda x: (-len(x[0]), sum(n for _, n in x[0]), x[1])):
        if not root and len(vector) == len(read) and all(n == 1 for _, n in vector):
            root = sorted(tokens, key=lambda x: places[0][x][0])
            for own in places[1:]:
                root = in_order(root, {x: own[x][0] for x in root})
            loose += [x for x in tokens if x not in set(root)]
        else:
            loose += tokens
    valid = set(root)
    edges = [[own[x][0] for x in root] for own in places]
    for token in loose:
        lies = {tuple(bisect_left(edge, at) for at in own[token]) for own, edge in zip(places, edges) if token in own}
        if len(lies) == 1 or len(set().union(*lies)) == 1:
            valid.add(token)
    return frozenset(valid & blocks)


def extract_text(pages: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """``pages`` (with url and html) with ``text``, the main text of each whole page.

    Pages of a host deduce their template in groups of bounded size, by a hash of the
    page; all pages of a group meet in one task, which reads each once. Null or empty pages have
    an empty text; a page without a host or alone on its host is judged by its elements only. Repeated rows are pages of their own; an
    empty table gives no rows. A page is read in time and memory by its length, however deep its elements nest. Other columns
    pass through, whatever their names; one named ``text`` is replaced.
    """
    names = [c for c in pages.columns if c.lower() != "text"]
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), host.alias("host"), F.xxhash64("url", "html").alias("key"),
                        F.octet_length("html").alias("size"))
    hosts = rows.groupBy("host").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / s.group_pages), F.ceil(F.sum("size") / s.group_bytes)).cast("int").alias("groups"))
    plan = settle(hosts.where("groups > 1"), "large-hosts")
    rows = rows.join(plan, "host", "left").select(
        "row", "host", F.pmod("key", F.coalesce("groups", F.lit(1))).cast("int").alias("group"))
    schema = T.StructType([rows.schema["row"], T.StructField("text", T.StringType())])

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        own = table.column("row")
        read = [Parser(page or "") for page in pc.struct_field(own, "html").to_pylist()]
        template = deduce_template(read, s) if table.column("host")[0].as_py() else frozenset()
        return pa.table({"row": own, "text": pa.array([main_text(page, template) for page in read], pa.string())})

    done = rows.groupBy("host", "group").applyInArrow(run, schema)
    return done.select(*[F.col(f"row.`{c}`").alias(c) for c in names], "text")


def text_digest(pages: DataFrame) -> DataFrame:
    """One row per page."""
    return extract_text(pages.select("page_id", "url", "html")).select(
        "page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


#: Holds for pages whose article is one element without boilerplate inside.
TEXT_SQL = r"""
WITH a AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*?)</article>', 1) AS t FROM pages
), b AS (
  SELECT page_id, url, regexp_replace(t, '(?s)<!--.*?-->|</?(?:b|i|em|strong|a|span)(?:\s[^>]*)?>', '', 'g') AS t FROM a
), c AS (
  SELECT page_id, url, replace(replace(replace(replace(replace(replace(
    regexp_replace(t, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&#x27;', ''''), '&amp;', '&') AS t FROM b
)
SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text,
  CAST(length(trim(regexp_replace(t, '\s+', ' ', 'g'))) AS BIGINT) AS n_chars
FROM c
"""
