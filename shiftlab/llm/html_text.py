"""Main text of web pages with the help of a suffix array for each host.

The token streams of a host's pages (words, and tags with their classes) are concatenated, and
a suffix array to a depth of `DEPTH` tokens, built by prefix doubling, shows the runs of at least that many tokens
that occur on distinct pages. Blocks covered by them are boilerplate, the other runs stay.

The repeats of a host aren't all there is to boilerplate: menus and adverts may be new on each page,
and articles may be printed twice. So elements whose kind, class or role says that they are
not the article are left out. On pages with an `article` or `main` element nothing else stays, and in it the suffix array decides about
what isn't in an element of prose (`LAYOUT`), as sentences of articles repeat too. On other pages the suffix array decides about all blocks.

Hosts with more than `GROUP` pages or `GROUP_BYTES` are looked at in groups of about that many, so that no task holds all pages of a host.
Runs that occur in several groups of a host are found by a shuffle of their hashes and sent back to the groups, so that the
result doesn't depend on them. Elements nested deeper than `NESTED` are taken for part of the one there, as browsers do.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, texts

DEPTH, GROUP, GROUP_BYTES, NESTED = 16, 256, 16 << 20, 512
#: Hosts whose numbers of pages are broadcast, of a few dozen bytes each.
MAX_HOSTS = 100_000

# Kinds of elements, and words in class, id and role that tell what isn't the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math object canvas textarea select option button title".split())
APART = frozenset("nav footer aside form dialog menu head".split()) | RAW
BLOCKS = frozenset("address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
MAIN = frozenset("article main".split())
LAYOUT = frozenset("a center details div fieldset label section small span summary table tbody tr".split())
HINTS = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent contentinfo complementary cookie cookies dialog disqus footer form gdpr login menu modal nav navbar navigation newsletter notice notices notification pagination popup promo promoted promotion related reply respond search share sharing sidebar sidebars signup social sponsor sponsored subscribe toolbar widget alert".split())
HINTS_OUTSIDE = frozenset("header masthead".split())
CLOSES = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CLOSE_P = BLOCKS - {"br", "caption", "dd", "dt", "li", "body", "html", "head", "summary", "figcaption", "tbody", "thead", "tfoot", "tr", "td", "th"} | {"li"}

_NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_MARKS = re.compile(r"""[>"']""")
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_PARTS = re.compile(r"[^a-z0-9]+")


def _apart(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element isn't of the article, by its kind and attributes; `inside`: it stands in one."""
    if name in APART or name == "header" and not inside:
        return True
    if name in MAIN | {"body", "html"} and "comment" not in attributes or not attributes.strip():
        return False
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if key in ("class", "id", "role"):
            words = set(_PARTS.split(value))
            if words & HINTS or not inside and words & HINTS_OUTSIDE:
                return True
    return False


class _Ends:
    """For pages with quotes that don't close: the first `>` outside quotes after any place, found by one pass from the end."""

    def __init__(self, page: str):
        self.at = [m.start() for m in _MARKS.finditer(page)]
        plain, double, single = -1, -1, -1
        self.first = [-1] * len(self.at)
        for k in range(len(self.at) - 1, -1, -1):
            c = page[self.at[k]]
            now = self.at[k] if c == ">" else double if c == '"' else single
            double, single = plain if c == '"' else double, plain if c == "'" else single
            self.first[k] = plain = now

    def after(self, place: int) -> int:
        k = bisect_left(self.at, place)
        return self.first[k] if k < len(self.at) else -1


def tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, whether it closes, attributes) of each tag in order; of comments and the like the name is empty, of marked sections it is `[`. Takes time in proportion to the page.

    The sender tells where to go on if that isn't the end (behind an element without markup inside).
    """
    last, sections, ends, at = page.rfind(">"), page.rfind("]]>"), None, 0
    while (start := page.find("<" if at <= last else "<!--", at)) >= 0:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else len(page)
            found = (start, at, "", False, "")
        elif start > last:
            at = start + 1
            continue
        elif page.startswith("<![CDATA[", start) and start < sections:
            end = page.find("]]>", start)
            at = end + 3
            found = (start, at, "[", False, page[start + 9 : end])
        elif page.startswith(("<!", "<?"), start):
            at = page.find(">", start) + 1
            found = (start, at, "", False, "")
        elif m := _NAME.match(page, start):
            if ends is None:
                rest = _REST.match(page, m.end())
                if rest is None:
                    ends = _Ends(page)
            end = rest.end() - 1 if ends is None else ends.after(m.end())
            if end < 0:  # a quote that doesn't close counts as any other character
                end = page.find(">", m.end())
            at = end + 1
            found = (start, at, m[2].lower(), bool(m[1]), page[m.end() : end])
        else:
            at = start + 1
            continue
        at = (yield found) or at


def blocks(page: str) -> list[tuple[str, str, bool, bool]]:
    """(text, path, main, apart) of the blocks of a page in order; path: the tag and classes of the element that holds it."""
    out: list[tuple[str, str, bool, bool]] = []
    held: list[str] = []
    stack: list[tuple[str, str, bool, bool]] = []  # name, label, in the article, apart
    opened: Counter[str] = Counter()
    state, at, onward = ("", "", False, False), 0, None

    def flush() -> None:
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.append((text, state[1], state[2], state[3]))
            held.clear()

    def close(k: int) -> None:
        nonlocal state
        opened.subtract(x[0] for x in stack[k:])
        del stack[k:]
        state = stack[-1] if stack else ("", "", False, False)

    def innermost(*names: str) -> int:
        return next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in names), -1)

    found = tags(page)
    while True:
        try:
            start, end, name, closes, attributes = found.send(onward)
        except StopIteration:
            break
        onward = None
        if start > at:
            held.append(html.unescape(page[at:start]))
        at = end
        if name in ("", "["):
            held.append(attributes)
            continue
        if closes:
            k = innermost(name) if opened[name] else -1
            if name in BLOCKS:
                flush()
            if k >= 0:
                if any(stack[i][2] != state[2] or stack[i][3] != state[3] for i in range(max(0, k - 1), len(stack))):
                    flush()
                close(k)
            continue
        empty = attributes.rstrip().endswith("/")
        if name in RAW and not empty:  # no markup inside
            behind = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = onward = behind.end() if behind else len(page)
            continue
        if name in BLOCKS:
            flush()
            if name in CLOSE_P and opened["p"]:
                close(innermost("p"))
            for other in CLOSES.get(name, ()):
                k = innermost(other, "ul", "ol", "dl", "table") if opened[other] else -1
                if k >= 0 and stack[k][0] == other:
                    close(k)
        if name in VOID or empty or len(stack) >= NESTED:
            continue
        apart = state[3] or _apart(name, attributes, state[2])
        if apart != state[3]:
            flush()
        marks = "".join(f" {v.strip(chr(34) + chr(39)).lower()}" for k, v in _ATTRIBUTE.findall(attributes) if k.lower() in ("class", "role")) if attributes else ""
        state = (name, name + marks, state[2] or name in MAIN and not apart, apart)
        stack.append(state)
        opened[name] += 1
    if at < len(page):
        held.append(html.unescape(page[at:]))
    flush()
    return out


def repeated(streams: list[list[str]], depth: int = DEPTH) -> list[np.ndarray]:
    """For each token of each stream, whether it lies in a run of `depth` tokens that occurs in another stream too."""
    size = np.array([len(s) for s in streams])
    owner = np.repeat(np.arange(len(streams)), size + 1)
    index: dict[str, int] = {}
    tokens = np.fromiter((t for s in streams for t in (*(index.setdefault(w, len(index)) for w in s), -1)), np.int64, int(size.sum()) + len(streams))
    ends = np.flatnonzero(tokens < 0)
    tokens[ends] = len(index) + np.arange(len(ends))  # no run goes on into the next page
    rank = tokens
    reach = 1
    while reach < depth:  # ranks of the suffixes by their first `reach` tokens, doubled
        step = min(reach, depth - reach)
        later = np.append(rank[step:], np.full(min(step, len(rank)), -1))
        rank = np.unique(rank * (len(rank) + len(index) + 1) + later + 1, return_inverse=True)[1]
        reach += step
    order = np.argsort(rank, kind="stable")  # the suffix array
    new = np.flatnonzero(np.append(True, rank[order][1:] != rank[order][:-1]))
    several = np.minimum.reduceat(owner[order], new) != np.maximum.reduceat(owner[order], new)
    begins = several[rank]  # ranks are dense, so they number the groups of equal suffixes
    cover = np.cumsum(begins) - np.append(np.zeros(min(depth, len(begins)), int), np.cumsum(begins)[: max(0, len(begins) - depth)])
    flags = cover > 0
    place = np.append(0, np.cumsum(size + 1))
    return [flags[a : a + n] for a, n in zip(place, size)]


def runs(stream: list[str], depth: int = DEPTH) -> np.ndarray:
    """A hash of the run of `depth` tokens at each place of a stream that has one."""
    h = np.fromiter(map(xxhash.xxh64_intdigest, stream), np.uint64, len(stream))
    n = max(0, len(h) - depth + 1)
    out = np.zeros(n, np.uint64)
    for k in range(depth):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    return out.view(np.int64)


def streamed(found: list[tuple[str, str, bool, bool]]) -> tuple[list[str], list[tuple[int, int]]]:
    """The token stream of a page's blocks, and the span of each block's words in it."""
    stream: list[str] = []
    own = []
    for text, path, _, _ in found:
        words = text.split(" ")
        stream.append("<" + path)
        own.append((len(stream), len(stream) + len(words)))
        stream += words
    return stream, own


def bare(found: list[tuple[str, str, bool, bool]]) -> bool:
    """Whether a page has no article or main element."""
    return not any(main and not apart for _, _, main, apart in found)


def verdicts(found: list[tuple[str, str, bool, bool]]) -> list[bool | None]:
    """Of each block whether it stays, None where repeats decide."""
    if bare(found):
        return [False if apart else None for _, _, _, apart in found]
    return [False if apart or not main else None if path.split(" ", 1)[0] in LAYOUT else True for _, path, main, apart in found]


def main_texts(pages: list[str], elsewhere: np.ndarray | None = None) -> list[str]:
    """The main text of each of some pages of one host; `elsewhere`: hashes of runs that its other pages have too."""
    parsed = [blocks(p) for p in pages]
    streams, spans = [], []
    for found in parsed:
        stream, own = streamed(found)
        streams.append(stream)
        spans.append(own)
    out = []
    for found, own, stream, cover in zip(parsed, spans, streams, repeated(streams) if streams else [], strict=True):
        stays = verdicts(found)
        if None in stays and elsewhere is not None and len(elsewhere):
            cover = cover.copy()
            for i in np.flatnonzero(np.isin(runs(stream), elsewhere)):
                cover[i : i + DEPTH] = True
        out.append(" ".join(x[0] for x, k, (a, b) in zip(found, stays, own, strict=True) if k or k is None and 2 * int(cover[a:b].sum()) <= b - a))
    return out


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        press = zstandard.ZstdCompressor(level=3)
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([press.compress(t or b"") for t in texts(b.columns[-1])], pa.binary())], names=b.schema.names)


def _pages(table: pa.Table | pa.RecordBatch) -> list[str]:
    unpack = zstandard.ZstdDecompressor()
    return [unpack.decompress(x).decode() for x in table.column("html").to_pylist()]


def _extracted(table: pa.Table, elsewhere: pa.Table) -> pa.Table:
    found = main_texts(_pages(table), elsewhere.column("run").to_numpy())
    return pa.table({"page_id": table.column("page_id"), "url": table.column("url"), "text": pa.array(found, pa.string()), "n_chars": pa.array([len(x) for x in found], pa.int64())})


def _asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hosts of pages about which repeats decide."""
    for b in batches:
        hosts = {h for h, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if None in verdicts(blocks(page or ""))}
        yield pa.RecordBatch.from_arrays([pa.array(sorted(hosts), pa.string())], names=["host"])


def _runs(table: pa.Table) -> pa.Table:
    """The distinct runs of a group of pages, and whether a page on which repeats decide has them."""
    parsed = [blocks(p) for p in _pages(table)]
    own = [runs(streamed(found)[0]) for found in parsed]
    every = np.unique(np.concatenate(own))
    asked = np.isin(every, np.concatenate([np.empty(0, np.int64), *(r for r, found in zip(own, parsed, strict=True) if None in verdicts(found))]))
    same = lambda name: pa.array([table.column(name)[0].as_py()] * len(every), table.schema.field(name).type)
    return pa.table({"host": same("host"), "part": same("part"), "run": pa.array(every), "asked": pa.array(asked)})


def extracted(pages: DataFrame, group: int = GROUP, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of `pages` (page_id, url, html).

    A null or empty page has an empty text. A url that is null or names no host counts as one
    host of that kind. Rows that repeat a page are pages of their own. An empty table gives no rows.
    """
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", host)
    groups = cut(rows.groupBy("host").agg(F.ceil(F.greatest(F.lit(1), F.count(F.lit(1)) / F.lit(group), F.coalesce(F.sum(F.octet_length("html")), F.lit(0)) / F.lit(group_bytes))).cast("int").alias("groups")))
    if groups.count() <= MAX_HOSTS:  # beyond, pages and counts meet by a shuffle
        groups = F.broadcast(groups)
    packed = rows.select("host", "page_id", "url", "html").mapInArrow(_packed, "host string, page_id long, url string, html binary")
    dealt = packed.join(groups, "host").withColumn("part", F.pmod(F.xxhash64("page_id", "url"), F.col("groups")).cast("int"))
    dealt = dealt.select("host", "part", "page_id", "url", "html", "groups")
    # only hosts of several groups that have a page about which repeats decide
    wanted = cut(rows.join(groups.where("groups > 1"), "host").select("host", "html").mapInArrow(_asking, "host string").distinct())
    found = dealt.where("groups > 1").join(wanted, "host", "left_semi").drop("groups").repartition("host", "part").groupBy("host", "part").applyInArrow(_runs, "host string, part int, run long, asked boolean")
    several = found.groupBy("host", "run").agg(F.count(F.lit(1)).alias("parts"), F.collect_list(F.when(F.col("asked"), F.col("part"))).alias("asking")).where("parts > 1")
    elsewhere = several.select("host", F.explode("asking").alias("part"), "run")
    return dealt.drop("groups").groupBy("host", "part").cogroup(elsewhere.groupBy("host", "part")).applyInArrow(_extracted, "page_id long, url string, text string, n_chars long")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
