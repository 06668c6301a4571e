"""HTML extraction by site template removal.

A page is read into a stream of elements, leniently: paragraphs, list items and cells end where the next one begins,
unclosed elements end with their parent, scripts and styles are not markup.  Every subtree has a digest of its tag names and
words; attributes do not count, so links and counters that differ do not hide a template.  Spark counts, per host, on how
many different pages a subtree occurs.  Subtrees on at least ``LEAST_PAGES`` pages and a share ``SHARE`` of the host's
pages are its template and are deleted from its pages.  Equal pages count once, so a copied page makes no template.

Prose (paragraphs, headings, list items, cells) recurs by chance and in copies, so it is template only outside an
``article`` or ``main`` element and on a share ``PROSE_SHARE`` of the pages; within an article, a container holding more
than half of the text is the text itself and is never template.  If nothing were left of a page, its template is kept.

What a count cannot see, such as the menu of a host's only page, goes by kind: elements that are never text, page
furniture by element, role or class name, and, if a page marks its ``article`` or ``main`` part, all outside.

Two passes over the pages: digests only, then the extraction.  Digests move, pages are joined with the digests to delete;
a host that holds most pages is a sum with partial sums, then a skewed join key.

Odd tables: null html has an empty text; pages without host have no template counted; repeated rows give repeated rows; an
empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blotter.llm.common import map_slices, pick, step

LEAST_PAGES, SHARE, PROSE_SHARE = 3, 0.001, 0.2

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=/\"'>]+)")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is characters up to their end tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th caption figcaption tr summary legend".split())
CONTAINER = frozenset("address article aside body center dialog details dir div dl fieldset figure footer form header hgroup html main "
                      "menu nav ol section search table tbody tfoot thead ul head".split())
BLOCK = PROSE | CONTAINER | {"hr", "option"}
MAIN = frozenset(("article", "main"))
#: An open element of these names ends where one of the others begins.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
        "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody")}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "option": ("select",)}

#: Furniture by element, role and word of a class or id.
NEVER = RAW | frozenset("head nav aside footer form template svg math canvas object embed audio video button select dialog menu search datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar footer masthead comment comments respond disqus reply replies cookie cookies consent gdpr notice notices alert popup modal "
    "overlay newsletter subscribe signup login share sharing social related recommended widget pager pagination toolbar skip".split())
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _attributes(source: str) -> tuple[bool, bool]:
    """(furniture by role or hidden, furniture by class or id)."""
    role = name = False
    for key, a, b, c, bare in ATTRIBUTE.findall(source):
        key, value = (key or bare).lower(), a or b or c
        if key == "role":
            role |= value.strip().lower() in ROLES
        elif key in ("class", "id"):
            name |= any(w.lower() in NAMES for w in WORD.findall(value))
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            role = True
    return role, name


class Page:
    """A page as events in order: a number opens that element, its complement closes it, a string is text."""

    def __init__(self, source: str):
        self.names, self.role, self.named, self.events = [], [], [], []
        self.known: tuple = ()
        self.stack: list[int] = []
        self.open: dict[str, int] = {}
        at, n = 0, len(source)
        while at < n:
            m = TAG.search(source, at)
            if m is None:
                self.text(source[at:])
                break
            if m.start() > at:
                self.text(source[at:m.start()])
            at = m.end()
            slash, name, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if name is None:
                continue
            name = name.lower()
            if slash:
                self.end(name)
                continue
            self.start(name, rest)
            if name in RAW:
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>|\Z", re.I).search(source, at)
                at = close.end()
                self.close()
            elif name in VOID or rest.endswith("/") and name not in BLOCK:
                self.close()
        while self.stack:
            self.close()

    def text(self, s: str) -> None:
        self.events.append(entities.unescape(s) if "&" in s else s)

    def start(self, name: str, rest: str) -> None:
        if name in ("html", "body") and self.open.get(name):
            return
        if name in BLOCK and self.open.get("p"):
            self.until(("p",), CONTAINER | PROSE - {"p"})
        if name in ENDS and any(self.open.get(x) for x in ENDS[name]):
            self.until(ENDS[name], SCOPE.get(name, ("table",)))
        self.names.append(name)
        role, named = _attributes(rest) if "=" in rest or "hidden" in rest else (False, False)
        self.role.append(role)
        self.named.append(named)
        self.stack.append(len(self.names) - 1)
        self.open[name] = self.open.get(name, 0) + 1
        self.events.append(len(self.names) - 1)

    def close(self) -> None:
        i = self.stack.pop()
        self.open[self.names[i]] -= 1
        self.events.append(~i)

    def until(self, names, scope) -> None:
        """Close the outermost open element of these names that no element of ``scope`` hides."""
        last = None
        for k in range(len(self.stack) - 1, -1, -1):
            name = self.names[self.stack[k]]
            if name in names:
                last = k
            elif name in scope:
                break
        if last is not None:
            while len(self.stack) > last:
                self.close()

    def end(self, name: str) -> None:
        if not self.open.get(name):
            return
        if name not in BLOCK:  # an inline element does not end the block around it
            for i in reversed(self.stack):
                if self.names[i] == name:
                    break
                if self.names[i] in BLOCK:
                    return
        while self.names[self.stack[-1]] != name:
            self.close()
        self.close()

    def digests(self) -> tuple[list[int], list[int], list[bool]]:
        """Digest of every element's tags and words, its words' length, and whether it holds an article or main element."""
        n = len(self.names)
        if self.known:
            return self.known
        digest, size, holds = [0] * n, [0] * n, [False] * n
        parts, sizes = [[]], [0]
        for e in self.events:
            if isinstance(e, str):
                words = " ".join(e.split())
                if words:
                    parts[-1].append(words)
                    sizes[-1] += len(words)
            elif e >= 0:
                parts.append([self.names[e]])
                sizes.append(0)
            else:
                i = ~e
                digest[i] = xxhash.xxh3_64_intdigest("\x1f".join(parts.pop()))
                size[i] = sizes.pop()
                parts[-1].append(f"<{digest[i]:x}>")
                sizes[-1] += size[i]
        inside: list[int] = []
        for e in self.events:
            if not isinstance(e, str):
                if e >= 0:
                    if self.names[e] in MAIN:
                        for i in inside:
                            holds[i] = True
                    inside.append(e)
                else:
                    inside.pop()
        self.known = digest, size, holds
        return self.known

    def candidates(self) -> dict[int, tuple[int, bool]]:
        """Elements that may be template: {number: (digest, whether it is prose)}."""
        digest, size, holds = self.digests()
        out, main = {}, []
        for e in self.events:
            if isinstance(e, str):
                continue
            if e < 0:
                if main and main[-1] == ~e:
                    main.pop()
                continue
            name = self.names[e]
            if name in MAIN:
                main.append(e)
            elif size[e] and not holds[e] and name not in ("html", "body"):
                if name in CONTAINER and (not main or 2 * size[e] <= size[main[0]]):
                    out[e] = digest[e], False
                elif name in PROSE and not main:
                    out[e] = digest[e], True
        return out

    def blocks(self, template: frozenset | set = frozenset(), rules: bool = True) -> list[str]:
        """The text's blocks in order, without the elements numbered in ``template`` and, with ``rules``, page furniture."""
        drop = set(template)
        root = None
        if rules:
            *_, holds = self.digests()
            articles = [i for i, x in enumerate(self.names) if x == "article" and not self.named[i] and not self.role[i]]
            root = "article" if articles else "main" if "main" in self.names else None
            for i, name in enumerate(self.names):
                if name in NEVER or self.role[i] or name == "header" and not root:
                    drop.add(i)
                elif self.named[i] and not holds[i] and name not in ("html", "body") and (name not in MAIN or articles and name == "article"):
                    drop.add(i)
        out, words, skip, within = [], [], None, 0
        for e in self.events:
            if isinstance(e, str):
                if skip is None and (within or root is None):
                    words.append(e)
                continue
            i, name = (e if e >= 0 else ~e), self.names[e if e >= 0 else ~e]
            if name in BLOCK and words:
                out.append("".join(words))
                words = []
            elif name == "br":
                words.append(" ")
            if e >= 0:
                if skip is None and i in drop:
                    skip = i
                within += name == root
            else:
                if skip == i:
                    skip = None
                within -= name == root
        out.append("".join(words))
        return [t for b in out if (t := " ".join(b.split()))]


def extract(source: str, marked=frozenset(), rules: bool = True) -> tuple[str, int]:
    """(text, number of template subtrees deleted) of a page whose host's template digests are ``marked``."""
    page = Page(source)
    template = {i for i, (d, _) in page.candidates().items() if d in marked} if marked else set()
    blocks = page.blocks(template, rules)
    if template and not blocks:
        template, blocks = set(), page.blocks(rules=rules)
    return "\n".join(blocks), len(template)


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def keyed(pages: DataFrame) -> DataFrame:
    """page_id, url, html, host and a 128-bit key (k1, k2) of host and html."""
    p = pick(pages, "page_id", "url", "html").select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[^:]*(?::(?!//)[^:]*)*://([^/?#]*)", 1))
    return p.withColumn("host", F.xxhash64(F.when(host != "", host))).withColumn("sited", host != "").withColumn(
        "k1", F.xxhash64("host", "html")).withColumn("k2", F.xxhash64("html", "host", F.lit(1)))


def subtrees(pages: DataFrame) -> DataFrame:
    """(k1, k2, host, subtrees array<struct<digest, prose>>), a row per distinct page of a host, written."""
    kind = pa.list_(pa.struct([("digest", pa.int64()), ("prose", pa.bool_())]))

    def make():
        def work(batch):
            found = [[{"digest": d, "prose": p} for d, p in sorted({(_signed(d), p) for d, p in Page(t).candidates().values()})]
                     for t in batch.column(3).to_pylist()]
            return {"k1": batch.column(0), "k2": batch.column(1), "host": batch.column(2), "subtrees": pa.array(found, kind)}
        return work

    rows = map_slices(pages.filter("sited").select("k1", "k2", "host", "html"), make,
                      "k1 long, k2 long, host long, subtrees array<struct<digest: long, prose: boolean>>", "html")
    return step(rows.groupBy("k1", "k2").agg(F.min(F.struct("host", "subtrees")).alias("s")).select("k1", "k2", "s.host", "s.subtrees"), "subtrees")


def templates(pages: DataFrame, least: int = LEAST_PAGES, share: float = SHARE, prose_share: float = PROSE_SHARE) -> DataFrame:
    """(k1, k2, marked array<long>): the template digests of each distinct page that has any; ``pages`` as from ``subtrees``."""
    sizes = pages.groupBy("host").agg(F.count("*").alias("pages"))
    each = pages.select("k1", "k2", "host", F.explode("subtrees").alias("s")).select("k1", "k2", "host", "s.digest", "s.prose")
    counts = each.groupBy("host", "digest", "prose").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    often = counts.join(sizes, "host").filter(F.col("n") >= F.col("pages") * F.when(F.col("prose"), prose_share).otherwise(share)).select("host", "digest", "prose")
    often = step(often, "templates")
    return each.join(often, ["host", "digest", "prose"]).groupBy("k1", "k2").agg(F.collect_set("digest").alias("marked"))


def extract_pages(pages: DataFrame, rules: bool = True, **limits) -> DataFrame:
    """page_id, url, text, n_chars, n_template (template subtrees deleted); a row per input row."""
    rows = keyed(pages)
    marked = templates(subtrees(rows), **limits)
    joined = rows.select("page_id", "url", "html", "k1", "k2").join(marked, ["k1", "k2"], "left").select("page_id", "url", "html", "marked")

    def make():
        def work(batch):
            texts, counts = [], []
            for source, marks in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                text, n = extract(source, {m % 2**64 for m in marks or ()}, rules)
                texts.append(text)
                counts.append(n)
            return {"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": [len(t) for t in texts], "n_template": counts}
        return work

    kind = {f.name: f.dataType.simpleString() for f in joined.schema}
    return map_slices(joined, make, f"page_id {kind['page_id']}, url string, text string, n_chars long, n_template long", "html")
