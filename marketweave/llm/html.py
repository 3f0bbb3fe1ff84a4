"""Main text of pages: equivalence classes of tokens give every host a template, and what is left in its slots is the text; fixed names tell which elements are no article."""

from __future__ import annotations

import html
import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketweave.llm.common import materialise, slices

#: A class is part of its host's template if its tokens are on this share of the host's pages, all equally often,
#: there are this many of them and of the pages.
SHARE, LEAST_TOKENS, LEAST_PAGES = 0.9, 2, 4
#: Size of all templates up to which they are broadcast; beyond it pages are joined by host, where Spark splits a hot one.
BROADCAST_BYTES = 8_000_000

# Elements whose content is never text, and elements and names that are not the article.
HIDDEN = frozenset("head title script style noscript template svg iframe object canvas select option textarea button".split())
ASIDE = frozenset("nav header footer aside form menu dialog".split())
ASIDE_NAMES = frozenset(
    "ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header login menu modal nav navbar navigation newsletter notice pagination popup promo promoted related replies share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu".split())
#: Hidden elements whose content is a tree of its own: while they are open nothing in it closes what is outside.
TIGHT = frozenset("noscript template svg".split())
#: A form that holds one of these goes round a page.
ROUND = frozenset("article main nav header footer aside h1".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SPACE = frozenset("br td th".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(script|style|textarea|title)\b[^>]*>.*?(?:</\1\s*>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+|[^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|[^<]+|<""", re.S | re.I)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


_LOWER = {c: c + 32 for c in range(65, 91)}

# Words that make a name of several parts an aside's if all its other parts are plain ones, those that do so for a block of text inside an article, and the plain ones.
ASIDE_PARTS = frozenset(
    "ad ads advert advertisement advertising sponsored promo promoted comment comments disqus related sidebar cookie cookies consent newsletter share sharing social nav navbar navigation menu header footer breadcrumb breadcrumbs popup modal banner pagination subscribe signup login widget toolbar".split()
)
BESIDE_TEXT = frozenset("ad ads adv advert advertisement advertising sponsor sponsored promo promoted comment comments disqus related newsletter share sharing".split())
PLAIN_PARTS = frozenset(
    "site main top bottom left right global primary secondary user users reader readers list section box block area container wrapper wrap bar slot unit posts post articles stories links items item buttons button icons tools form thread inner outer col column panel row strip group".split()
)
#: Elements that hold text and no further blocks.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption caption".split())
_INSIDE = (ASIDE_NAMES - {"header"}, ASIDE_PARTS - {"header"})
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


def _names_aside(name: str, among: frozenset[str], parts: frozenset[str]) -> bool:
    """Whether a class or id is an aside's: a word of the list, or made of its parts and plain ones."""
    if name.lower() in among:
        return True
    if name.isalpha() and (name.islower() or name.isupper()):
        return False
    found = [p.lower() for p in _PARTS.findall(name)]
    return any(p in parts for p in found) and all(p in parts or p in PLAIN_PARTS or p.isdigit() for p in found)


def _is_aside(name: str, attributes: str, in_article: bool) -> bool:
    """Whether the element is named as something beside the article: by its tag, its role, or a class or id. Inside an article a header is not, and text is only as an advert or a comment."""
    if name in ASIDE:
        return not (name == "header" and in_article)
    if attributes and name not in ("html", "body", "article", "main"):
        textual = in_article and name in TEXTUAL
        among, parts = (BESIDE_TEXT, BESIDE_TEXT) if textual else _INSIDE if in_article else (ASIDE_NAMES, ASIDE_PARTS)
        for kind, *values in _NAMES.findall(attributes):
            words = "".join(values)
            if not textual and words.lower() in ASIDE_ROLES if kind.lower() == "role" else any(_names_aside(w, among, parts) for w in words.split()):
                return True
    return False


class _Element:
    """An element: its place in the tree, and whether it is named as no article, hides its text, is never closed, or goes round the page."""

    __slots__ = ("name", "parent", "path", "in_article", "aside", "hides", "endless", "wraps", "beside", "beside_in")

    def __init__(self, name: str, parent: _Element | None, aside: bool = False, hides: bool = False, endless: bool = False) -> None:
        self.name, self.parent, self.aside, self.hides, self.endless, self.wraps = name, parent, aside, hides, endless, False
        above = parent.path if parent else 0
        self.path = above if hides else hash((above, zlib.crc32(name.encode())))  # of numbers, so alike in all workers
        self.in_article = name in ("article", "main") or parent is not None and parent.in_article
        self.beside = self.beside_in = False

    def settle(self) -> None:
        """Whether it lies in an aside, and in one inside its article; known once all that it lies in is."""
        aside, up = self.aside and not self.wraps, self.parent
        self.beside = aside or up is not None and up.beside
        self.beside_in = up is not None and (up.beside_in or up.in_article and aside)


class Block(NamedTuple):
    """A block of text: hash of its path, text, whether aside, in an article, share of it inside links, name of its element, and the number of the element that holds that one."""

    path: int
    text: str
    aside: bool
    in_article: bool
    linked: float
    name: str
    holder: int
    holder_name: str


def blocks_of(page: str | None) -> list[Block]:
    """Blocks of text in page order, in time that grows with the page however deep its elements nest.

    A hidden element ends with its end tag or an ancestor's; one that is never closed ends at the next block,
    and all but TIGHT ones at an article. A form round the page is no aside, and where every
    article lies in an aside, what it holds is not aside on that account.
    """
    page = page or ""
    found: list[tuple[_Element | None, str, float]] = []
    every: list[_Element] = []
    stack: list[_Element] = []
    where: dict[str, list[int]] = defaultdict(list)  # places of the open elements of a name
    soft, hard, endless, forms = [], [], [], []  # places of open ones: hidden that an article ends, hidden that it does not, hidden and never closed, forms that go round nothing yet
    text: list[str] = []
    links = linked = 0
    last: dict[str, int] = {}

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                top = stack[-1] if stack else None
                while top is not None and top.hides:
                    top = top.parent
                found.append((top, joined, min(1.0, linked / len(joined))))
            text.clear()
        linked = 0

    def push(element: _Element) -> None:
        at = len(stack)
        stack.append(element), every.append(element), where[element.name].append(at)
        if element.hides:
            (hard if element.name in TIGHT and not element.endless else soft).append(at)
            if element.endless:
                endless.append(at)
        elif element.name == "form":
            forms.append(at)

    def cut(at: int) -> None:
        while len(stack) > at:
            where[stack.pop().name].pop()
        for places in (soft, hard, endless, forms):
            while places and places[-1] >= at:
                places.pop()

    def never_closed(name: str, at: int) -> bool:
        if name not in last:
            last[name] = max((m.start() for m in re.finditer(f"</{re.escape(name)}(?![^\\s/>])", page, re.I)), default=-1)
        return last[name] < at

    for m in _TOKEN.finditer(page):
        token = m.group()
        name = m.group(3)
        if name is None:
            if token[0] != "<" or token == "<":
                if not (soft or hard):
                    text.append(token)
                    linked += len(token.strip()) if links else 0
            continue
        name, closing = name.lower(), bool(m.group(2))
        if (soft or hard) and (name in BLOCK or name == "body"):
            if name == "body":
                cut(min(p[0] for p in (soft, hard) if p))
            elif name in ("article", "main") and not closing:
                if soft and not (hard and hard[0] < soft[0]):
                    cut(soft[0])
            elif endless:
                cut(endless[0])
        if name in HIDDEN:
            if (closing or name in ("option", "select", "button")) and where[name]:  # none of these three holds another of its kind
                cut(where[name][-1])
            if not closing and not m.group(4).endswith("/"):
                push(_Element(name, stack[-1] if stack else None, hides=True, endless=name != "option" and never_closed(name, m.end())))
        elif name == "a":
            links = max(0, links - 1) if closing else links + 1
        elif name in SPACE:
            text.append(" ")
        elif name in BLOCK:
            flush()
            if closing:
                if where[name] and not (hard and hard[-1] > where[name][-1]):  # what a TIGHT one holds closes nothing outside
                    cut(where[name][-1])
                    links = 0
            elif name not in VOID and not m.group(4).endswith("/"):
                if stack and stack[-1].name == "p" or stack and name in ("li", "tr", "dt", "dd") and stack[-1].name == name:
                    cut(len(stack) - 1)  # these end where the next begins
                if name in ROUND and not (soft or hard):
                    for at in forms:
                        stack[at].wraps = True
                    forms.clear()
                up = stack[-1] if stack else None
                push(_Element(name, up, _is_aside(name, m.group(4), up is not None and up.in_article)))
    flush()

    for element in every:
        element.settle()
    number = {id(e): i for i, e in enumerate(every)}
    free = not any(e is not None and e.in_article and not e.beside for e, _, _ in found)  # every article lies in an aside
    out = []
    for e, joined, share in found:
        up = e.parent if e is not None else None
        aside = e is not None and (e.beside_in if free and e.in_article else e.beside)
        out.append(Block(e.path if e else 0, joined, aside, e is not None and e.in_article, share, e.name if e else "", number[id(up)] if up is not None else -1, up.name if up is not None else ""))
    return out


def host_of(url: str | None) -> str:
    m = re.match(r"(?s).*?://([^/?#]*)", url or "")
    return m[1].translate(_LOWER) if m else ""


def _print(path: int, text: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{path}\x00{text}") - 2**63


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, token, is_text, pages, high, low, places) over the batch's pages: high and low sum the halves of a hash of page and count, places the first place on each page."""
    for batch in slices(batches):
        seen: dict[tuple[str, int, bool], list[int]] = {}
        for page, url, source in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            host, found, first = host_of(url), Counter(), {}
            for place, block in enumerate(blocks_of(source)):
                path, text = block.path, block.text
                for token in ((_print(path, text), True), (_print(path, ""), False)):
                    found[token] += 1
                    first.setdefault(token, place)
            found[(0, False)] = 1  # the page itself
            for (token, is_text), n in found.items():
                entry = seen.setdefault((host, token, is_text), [0, 0, 0, 0])
                h = xxhash.xxh3_64_intdigest(f"{page}\x00{n}")
                for i, v in enumerate((1, h >> 32, h & 0xFFFFFFFF, first.get((token, is_text), 0))):
                    entry[i] += v
        keys = list(seen)
        cols = [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.string(), pa.int64(), pa.bool_()))]
        cols += [pa.array([v[i] for v in seen.values()], pa.int64()) for i in range(4)]
        yield pa.RecordBatch.from_arrays(cols, ["host", "token", "is_text", "pages", "high", "low", "places"])


def templates(pages: DataFrame) -> DataFrame:
    """(host, template): of each host, the tokens of text that its pages share, in the order in which they stand, from pages(page_id, url, html).

    Tokens with one occurrence vector over all pages of the host form an equivalence class; a class is
    valid if it is large and on nearly all pages. A token is a text at its path, so that classes nest by the tree; the template is their tokens in the order of their mean places, and
    what stands between two of them is a slot. A vector is known by sums of its entries' hashes, so classes come from one aggregation over all pages,
    and a page that is there twice counts twice for all its tokens alike. A host with few pages has no template.
    """
    counts = pages.mapInArrow(_occurrences, "host string, token long, is_text boolean, pages long, high long, low long, places long")
    counts = counts.groupBy("host", "token", "is_text").agg(*(F.sum(c).alias(c) for c in ("pages", "high", "low", "places")))
    counts = materialise(counts.where("pages > 1"), "tokens")
    size = counts.where("token = 0").select("host", F.col("pages").alias("of"))
    often = counts.where("token <> 0").join(size, "host").where((F.col("of") >= LEAST_PAGES) & (F.col("pages") >= SHARE * F.col("of")))
    placed = F.struct((F.col("places") / F.col("pages")).alias("place"), "token")
    valid = often.groupBy("host", "high", "low").agg(F.count("*").alias("tokens"), F.collect_list(F.when(F.col("is_text"), placed)).alias("texts")).where(F.col("tokens") >= LEAST_TOKENS)
    ordered = valid.select("host", F.explode("texts").alias("t")).groupBy("host").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return ordered.select("host", F.transform("t", lambda t: t["token"]).alias("template"))


def in_order(ranks: list[int | None]) -> set[int]:
    """Places of the longest run of growing ranks: the template's tokens that a page has where the template has them."""
    best: list[int] = []  # best[k]: place that ends the run of k + 1 ranks with the least last rank
    before: dict[int, int | None] = {}
    for i, r in enumerate(ranks):
        if r is None:
            continue
        k = bisect_left(best, r, key=lambda j: ranks[j])
        before[i] = best[k - 1] if k else None
        best[k : k + 1] = [i]
    run, at = set(), best[-1] if best else None
    while at is not None:
        run.add(at)
        at = before[at]
    return run


def _without_menus(blocks: list[Block]) -> list[Block]:
    """The blocks without runs of list items that are links and nothing else, outside an article."""
    out: list[Block] = []
    for (item, _), run in groupby(blocks, lambda b: (b.name == "li" and not b.in_article, b.path if b.name == "li" else 0)):
        run = list(run)
        if not item or any(b.linked < 1 for b in run):
            out += run
    return out


def _article(blocks: list[Block], template: dict[int, int]) -> list[str]:
    """The texts of the slots: blocks that are neither the template's nor aside, and all of an article element.

    Tokens of the template count only in its order. Without an article or main, the template's own text stays where it shares its element with text of a slot,
    as heading and body of near-equal pages do; in body itself, where everything meets, what lies between two slots does.
    """
    slots = [b for b in blocks if not b.aside]
    if any(b.in_article for b in slots):
        return [b.text for b in slots if b.in_article]
    slots = _without_menus(slots)
    fixed = in_order([template.get(_print(b.path, b.text)) for b in slots])
    first: dict[int, int] = {}
    last: dict[int, int] = {}
    for i, b in enumerate(slots):
        if i not in fixed:
            first.setdefault(b.holder, i)
            last[b.holder] = i
    shared = {b.holder for b in slots if b.holder in first and b.holder_name not in ("", "html", "body")}
    kept = [b.text for i, b in enumerate(slots) if i not in fixed or b.holder in shared or first.get(b.holder, i) < i < last.get(b.holder, i)]
    return kept or [b.text for b in slots]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = []
        for source, template in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            texts.append("\n\n".join(_article(blocks_of(source), {token: i for i, token in enumerate(template or ())})))
        texts = pa.array(texts, pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts, pc.utf8_length(texts).cast(pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    The text is the article's blocks in page order between blank lines: all that article or main hold, or else
    the page, without menus, headers, footers, sidebars, notices, adverts, forms, hidden elements and reader
    comments, which are known by fixed names and their parts. On pages without article or main, text of the host's template, the same and in the same order on
    nearly all its pages, is left out unless it shares its element with other text. A page that would be left
    without any block keeps the constant ones. Null or empty html gives an empty text; a null url is the
    host "". Unclosed and cut-off markup is read as far as it goes. Repeated rows are extracted each; an
    empty table gives an empty result; other columns are ignored.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    host = F.translate(F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    known = materialise(templates(rows), "templates")
    size = known.agg(F.sum(F.size("template") * 8 + 64)).first()[0] or 0
    rows = rows.withColumn("host", host).join(F.broadcast(known) if size <= BROADCAST_BYTES else known, "host", "left")
    return rows.select("page_id", "url", "html", "template").mapInArrow(_texts, "page_id long, url string, text string, n_chars long")
