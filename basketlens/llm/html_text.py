"""Main text of HTML pages by consensus host paths.

1. Each page's containers are scored: text outside menus, headers, notices and
   the like, without link text. The page votes for its only article or main, or
   for the smallest container that holds nearly all of it, by its generalised
   path (tags and classes, digits folded), and notes what lies beside it.
2. Votes are summed by host and path in Spark; a host's winners are the paths
   with at least MIN_SHARE of its votes, so 1 / MIN_SHARE of them at most. Paths
   with one and the same text beside the main container on most of its pages
   are the host's frame.
3. Each page is read again with its host's winners: the first that holds nearly
   all text but the frame gives the text; a page without any uses its own best
   container. What lies beside a container other than article or main stays,
   but for junk and the frame. Inside an article only a whole class or id name
   marks junk, and most such names only with evidence: links, form controls,
   articles within, or the same text on the host's pages (a frame path).
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DOUBLE, LONG, STRING, Scratch, read_table, schema

MIN_SHARE = 0.05
#: A winner must hold this share of the text of the page's own best container,
MIN_TEXT = 0.3
#: and this share without the host's frame; so must a container without a tag that says so.
NEARLY = 0.9
#: The only article or main of a page must hold this share.
ONLY = 0.5
#: A frame path has the same text on this many and this share of the host's pages.
FRAME_PAGES, FRAME_SHARE = 3, 0.5

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:_-]*)((?>[^>"']+|"[^"]*"|'[^']*')*+|[^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([A-Za-z_:-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_DIGITS = re.compile(r"\d+|>")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
_GONE = frozenset("head nav footer aside form script style noscript template iframe svg annotation annotation-xml canvas object audio video select button textarea dialog menu title label fieldset search".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
_JUNK = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar aside comment comments commentlist reply replies respond disqus nav navbar navigation menu breadcrumb breadcrumbs footer header masthead topbar cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup social share sharing related recommended recommendations widget toolbar pagination pager login skip copyright outbrain taboola".split())
#: A whole class or id name made of these alone (and of words that say nothing) is junk anywhere,
_SURE = frozenset("ad ads adv advert adverts advertisement advertising sponsored sidebar cookie cookies gdpr newsletter comment comments commentlist disqus breadcrumb breadcrumbs navbar pagination pager popup outbrain taboola".split())
#: these only with evidence, as any other word of _JUNK inside an article.
_TALK = frozenset("discussion responses thread feedback".split())
_PLAIN = frozenset("box bar wrapper wrap container block list section area slot unit button buttons link links form inner outer top bottom left right item items text title post posts page site entry article content module panel group global sticky row col column".split())
_LISTS = frozenset("ul ol dl div section table td".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CONTROLS = frozenset("form input select textarea button".split())
#: Evidence against a container that is junk by its name only: this share of link text, form
#: controls, articles inside it, or the same text on the host's pages.
LINKS = 0.5


def _sort_of(names: dict[str, str]) -> tuple[bool, int]:
    """Of a tag's class and id names: whether any word of them is one of junk;
    2 if a whole name is surely junk, 1 if a whole name may be, else 0."""
    some, sure = False, 0
    for name in f"{names.get('class') or ''} {names.get('id') or ''}".split():
        words = {w.lower() for w in _TOKEN.findall(name)}
        if words & {"with", "has", "no"}:
            return False, 0
        some = some or bool(words & _JUNK)
        if words & (_JUNK | _TALK) and all(w in _JUNK or w in _TALK or w in _PLAIN or w.isdigit() for w in words):
            sure = max(sure, 2 if words & _SURE else 1)
    return some, sure


class _Page:
    """Blocks and containers of one page. Containers are numbered in page
    order, so what one contains follows it without a gap; sums run up the tree
    once, so time is linear however deep the nesting."""

    def __init__(self, source: str):
        self.parent, self.key, self.label, self.tag, self.depth = [-1], [0], [""], ["#root"], [0]
        self.article, self.controls, self.first = [False], [0], [0]
        self.maybe: list[int] = []  # containers that are junk if the evidence says so
        self.blocks: list[tuple[int, str, int, int, bool]] = []  # container, text, link characters, junk (1 by a word, 2 surely), is an h1
        self._read(source)
        self.last = list(range(len(self.parent)))
        self.stop = list(self.first)
        for i, block in enumerate(self.blocks):
            self.stop[block[0]] = i + 1
        for n in range(len(self.parent) - 1, 0, -1):
            p = self.parent[n]
            self.last[p] = max(self.last[p], self.last[n])
            self.stop[p] = max(self.stop[p], self.stop[n])

    def _read(self, source: str) -> None:
        # tag, container, gone, junk, in a link, in an article, in an h1, in a header
        stack: list[tuple[str, int, bool, int, bool, bool, bool, bool]] = [("#root", 0, False, 0, False, False, False, False)]
        opened: Counter = Counter()
        keys: dict[tuple[int, str], int] = {}
        parts: list[str] = []
        links = 0

        def flush():
            nonlocal parts, links
            if parts:
                text = " ".join(html.unescape("".join(parts)).split())
                if text:
                    _, node, _, soft, _, _, h1, _ = stack[-1]
                    self.blocks.append((node, text, links, soft, h1))
                parts, links = [], 0

        def hear(text: str):
            nonlocal links
            if text and not stack[-1][2]:
                parts.append(text)
                if stack[-1][4]:
                    links += len(text.strip())

        def cut(i: int):
            opened.subtract(s[0] for s in stack[i:])
            del stack[i:]

        at, end = 0, len(source)
        while at < end:
            m = _TAG.search(source, at)
            if m is None:
                hear(source[at:])
                break
            hear(source[at:m.start()])
            at = m.end()
            tag = m.group(2)
            if tag is None:
                continue
            tag = tag.lower()
            if m.group(1):
                if tag in _BLOCK:
                    flush()
                for i in range(len(stack) - 1 if opened[tag] else 0, 0, -1):
                    if stack[i][0] == tag:
                        cut(i)
                        break
                    if stack[i][0] in _BLOCK and (tag not in _BLOCK or tag == "p"):
                        break
                continue
            if tag in _BLOCK:
                flush()
                for i in range(len(stack) - 1 if opened["p"] or any(opened[t] for t in _CLOSES.get(tag, ())) else 0, 0, -1):
                    if stack[i][0] in _CLOSES.get(tag, ()) or stack[i][0] == "p":
                        cut(i)
                        if tag not in _CLOSES:
                            break
                    elif stack[i][0] in _BLOCK and stack[i][0] not in ("tr", "td", "th", "tbody", "thead") and stack[i][0] not in _HEADINGS:
                        break
            _, node, lost, soft, link, article, h1, header = stack[-1]
            if tag in _CONTROLS:
                self.controls[node] += 1
            if tag in _VOID:
                if tag == "br":
                    hear(" ")
                continue
            names = dict((k.lower(), a or b or c) for k, a, b, c in _ATTRIBUTE.findall(m.group(3))) if m.group(3) else {}
            role = (names.get("role") or "").lower()
            gone = lost or tag in _GONE or (tag == "header" and not article) or "hidden" in names or names.get("aria-hidden") == "true" \
                or "display:none" in (names.get("style") or "").replace(" ", "").lower() or role in _ROLES
            some, sure = _sort_of(names) if names and tag not in ("html", "body", "main", "article") else (False, 0)
            if sure == 2:
                soft = 2
            elif some and not article:
                soft = max(soft, 1)
            if tag == "header" and article:
                soft = max(soft, 1)
            if tag in _HEADINGS and soft == 1 and article and header and not lost:
                soft = 0  # the heading inside an article's own header
            if tag in _BLOCK and not gone:
                label = tag + "".join("." + c for c in sorted(_DIGITS.sub("#", c) for c in (names.get("class") or "").split()))
                known = self.key[node], label
                if known not in keys:
                    keys[known] = _digest(f"{known[0]}>{label}")
                self.parent.append(node)
                self.depth.append(self.depth[node] + 1)
                self.key.append(keys[known])
                self.label.append(label)
                self.tag.append("main" if role == "main" else tag)
                self.article.append(self.article[node] or self.tag[-1] in ("article", "main"))
                self.controls.append(0)
                self.first.append(len(self.blocks))
                node = len(self.parent) - 1
                if sure == 1:
                    self.maybe.append(node)
            if tag in _RAW:
                close = re.compile(f"</{tag}(?=[\\s>/])", re.I).search(source, at)
                at = close.start() if close else end
            opened[tag] += 1
            stack.append((tag, node, gone, soft, link or tag == "a", article or tag in ("article", "main") or role == "main", h1 or tag == "h1", header or tag == "header"))
        flush()

    def _up(self, values: list[int]) -> list[int]:
        """Each container's value with those of all that it contains."""
        for n in range(len(values) - 1, 0, -1):
            values[self.parent[n]] += values[n]
        return values

    def totals(self, frame: frozenset = frozenset()) -> list[int]:
        """Text of each container that counts as content: neither junk nor
        link text, with all that it contains."""
        size = len(self.parent)
        text, linked, items = [0] * size, [0] * size, [0] * size
        for node, t, links, _, _ in self.blocks:
            text[node] += len(t)
            linked[node] += links
            items[node] += 1
        text, linked, items, controls = self._up(text), self._up(linked), self._up(items), self._up(list(self.controls))
        inner = self._up([int(t == "article") for t in self.tag])
        self.menu = menu = [self.tag[n] in _LISTS and not self.article[n] and items[n] >= 3 and linked[n] >= 0.8 * text[n] for n in range(size)]
        junk = [False] * size
        for n in self.maybe:
            junk[n] = linked[n] >= LINKS * text[n] or controls[n] > 0 or inner[n] > 0 or self.key[n] in frame
        for n in range(1, size):
            menu[n] = menu[n] or menu[self.parent[n]]
            junk[n] = junk[n] or junk[self.parent[n]]
        self.soft = [2 if junk[b[0]] else b[3] for b in self.blocks]
        out = [0] * size
        for (node, t, links, _, _), soft in zip(self.blocks, self.soft):
            if not soft and not menu[node]:
                out[node] += max(0, len(t) - links)
        return self._up(out)

    def above(self, node: int) -> list[int]:
        """A container and all that contain it."""
        out = []
        while node >= 0:
            out.append(node)
            node = self.parent[node]
        return out

    def path(self, node: int) -> str:
        return ">".join(self.label[n] for n in reversed(self.above(node)))

    def best(self, content: list[int]) -> int:
        """The page's only article or main, or the smallest container that
        holds nearly all of the page's content. Articles deeper than the first
        one and all of one path are what readers say to it."""
        children = defaultdict(list)
        for n in range(1, len(self.parent)):
            children[self.parent[n]].append(n)
        named = [self.tag[n] in ("article", "main") and content[n] > 0 for n in range(len(self.parent))]
        under = [False] * len(named)
        for n in range(1, len(named)):
            under[n] = under[self.parent[n]] or named[self.parent[n]]
        outer = [n for n in range(len(named)) if named[n] and not under[n]]
        node = outer[0] if len(outer) == 1 and content[outer[0]] >= ONLY * content[0] else 0
        if len(outer) > 2 and self.tag[outer[0]] == "article" and len({self.key[n] for n in outer[1:]}) == 1 and self.depth[outer[1]] > self.depth[outer[0]]:
            node = outer[0]
        while self.tag[node] != "article":
            inner = [c for c in children[node] if self.tag[c] not in ("p", "ul", "ol", "dl", "pre", "blockquote", "table", "h1", "h2", "h3", "h4", "h5", "h6", "figure") and content[c]]
            top = max(inner, key=lambda c: content[c], default=None)
            if top is None or content[top] < NEARLY * content[node]:
                break
            node = top
        # Inside a main or article, nothing but an article with all of it is smaller.
        found, most = node, 0
        for n in reversed(self.above(node)):
            if self.tag[n] == "main":
                found, most = n, max(most, content[n])
            elif self.tag[n] == "article" and content[n] >= most:
                found = n
        return found

    def beside(self, node: int, content: list[int]) -> list[int]:
        """The containers with content right beside a container and beside
        those that contain it, without headings of the page."""
        above = set(self.above(node))
        return [n for n in range(1, len(self.parent)) if content[n] and n not in above and self.parent[n] in above and self.parent[n] != node and self.tag[n] != "h1"]

    def said(self, node: int) -> int:
        """Digest of the text of a container."""
        return _digest("\n".join(b[1] for b in self.blocks[self.first[node]:self.stop[node]]))

    def doubtful(self) -> list[int]:
        """The containers that the page alone does not show to be junk,
        without those inside others of them."""
        out: list[int] = []
        for n in self.maybe:
            if not out or n > self.last[out[-1]]:
                out.append(n)
        return out

    def text(self, winners: list[int] = (), frame: list[int] = ()) -> tuple[str, str]:
        """(main text, path used)."""
        frame = frozenset(frame)
        content = self.totals(frame)
        own = self.best(content)
        chosen = [own]
        places = defaultdict(list)
        for n, k in enumerate(self.key):
            if content[n]:
                places[k].append(n)
        for p in winners:
            at = places.get(p, [])
            held = sum(content[n] for n in at)
            if at and held >= MIN_TEXT * content[own]:
                around = sum(content[n] for n in self.beside(at[0], content) if self.key[n] in frame and own <= n <= self.last[own])
                if held + around >= NEARLY * content[own]:
                    chosen = at
                    break
        path = self.path(chosen[0])
        if not any(self.article[n] for n in chosen):
            chosen = sorted({*chosen, *(n for n in self.beside(chosen[0], content) if self.key[n] not in frame)})
        inside, taken = [False] * len(self.parent), set(chosen)
        for n in range(len(self.parent)):
            inside[n] = n in taken or (n > 0 and inside[self.parent[n]])
        judged = [(node, t, soft, h1) for (node, t, _, _, h1), soft in zip(self.blocks, self.soft)]
        keep = [(t, h1) for node, t, soft, h1 in judged if inside[node] and not soft and not self.menu[node]]
        if not any(h1 for _, h1 in keep):  # the title right before its article
            above = set(self.above(chosen[0])[1:])
            before = [t for node, t, soft, h1 in judged if h1 and not soft and node < chosen[0] and not inside[node] and self.parent[node] in above]
            keep = [(t, True) for t in before[-1:]] + keep if keep else keep
        if not keep:  # nothing but what one word of a name made look like junk
            keep = [(t, False) for node, t, soft, _ in judged if soft < 2 and not self.menu[node]]
        return "\n".join(t for t, _ in keep), path


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        votes: dict[tuple, list] = defaultdict(lambda: [0.0, 0, 0])  # votes, pages, pages beside
        for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            if source:
                page = _Page(source)
                content = page.totals()
                if content[0]:
                    best = page.best(content)
                    own = votes[host, page.key[best], None]
                    own[0] += content[best] / content[0]
                    own[1] += 1
                    for key, said in {(page.key[n], page.said(n)) for n in [*page.beside(best, content), *page.doubtful()]}:
                        votes[host, key, said][2] += 1
        yield pa.RecordBatch.from_arrays([*(pa.array([v[i] for v in votes], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))),
                                          *(pa.array([v[i] for v in votes.values()], t) for i, t in enumerate((pa.float64(), pa.int64(), pa.int64())))], ["host", "path", "said", "votes", "pages", "beside"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_Page(source).text(winners or [], frame or []) if source else ("", "") for source, winners, frame in zip(*(batch.column(c).to_pylist() for c in ("html", "winners", "frame")))]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array([t for t, _ in found], pa.string()), pa.array([len(t) for t, _ in found], pa.int64()), pa.array([p for _, p in found], pa.string())],
                                         ["page_id", "url", "text", "n_chars", "path"])


def main_text(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html, any further columns) -> page_id, url,
    text, n_chars, path of the container used.

    Null and empty html give an empty text. A null url, or one without a host,
    counts as a host of its own (the empty name). Repeated rows are each
    extracted and each vote. Broken markup (open tags, cut-off tags, stray
    ends) is read as browsers do, roughly. Very long and very deep pages are
    read whole, in linear time. Extra columns are left out, whatever their
    names. A page of nothing but notices gives an empty text. Empty input gives
    no rows."""
    scratch = Scratch(pages.sparkSession, "html")
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))
    votes = scratch.table("votes", rows.select("host", "html").mapInArrow(_votes, schema(host=STRING, path=LONG, said=LONG, votes=DOUBLE, pages=LONG, beside=LONG))
                          .groupBy("host", "path", "said").agg(F.round(F.sum("votes"), 6).alias("votes"), F.sum("pages").alias("pages"), F.sum("beside").alias("beside")))
    all_votes = votes.groupBy("host").agg(F.sum("votes").alias("all"), F.sum("pages").alias("of"))
    won = (F.col("votes") > 0) & (F.col("votes") >= MIN_SHARE * F.col("all"))
    framed = (F.col("beside") >= FRAME_PAGES) & (F.col("beside") >= FRAME_SHARE * F.col("of"))
    winners = (votes.join(all_votes, "host").filter(won | framed)
               .groupBy("host").agg(F.transform(F.sort_array(F.collect_list(F.when(won, F.struct(-F.col("votes"), "path")))), lambda x: x["path"]).alias("winners"),
                                    F.collect_set(F.when(framed, F.col("path"))).alias("frame")))
    winners = scratch.table("winners", winners)
    scratch.drop("votes")
    return rows.join(winners, "host", "left").select("page_id", "url", "html", "winners", "frame").mapInArrow(_extract, schema(page_id=LONG, url=STRING, text=STRING, n_chars=LONG, path=STRING))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read_table(spark, sf_dir, "pages"))
