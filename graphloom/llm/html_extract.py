"""Main text of web pages: host suffix arrays over every page, then markup as the check of what they cut.

A page is cut into blocks by a tolerant tag scanner.  Subtrees that are chrome by their
element, role, class or id (menus, headers, footers, sidebars, notices, adverts, forms,
comments, scripts, styles) are never main text.  If an <article> (or else <main>, or else an element whose
class or id names the content) holds text, its blocks are the main text as they are:
passages and whole articles that several pages share are content there, so repetition must
not remove them.

Pages without such an element stay open.  Each distinct page, settled or open, is put with all its
blocks, chrome included, into the token stream of its host.  On settled pages markup then restores what
the arrays cut of the content; on open ones the cuts hold, and what settled pages mark as menus is counted.  A suffix array sorted to RUN_TOKENS tokens by prefix doubling
brings together the places whose next RUN_TOKENS tokens agree.  A longer repeated substring
is made of such runs, each on as many pages, so deeper sorting would decide nothing.  Runs
on at least MIN_PAGES and MIN_SHARE of the host's distinct pages are boilerplate.  Tokens
covered by a run within their own block go; a run that reaches over block ends (a menu of
short blocks) only removes blocks that are covered as a whole, so it never eats into a
block that goes on differently.  Unique runs stay.

Streams are bounded: a host with more than PART_CHARS characters of distinct html is dealt into parts
by a hash of the page's blocks, each of about LEAST_PAGES pages at least.  Each part has its own array, and the
result is that of one array over the whole host: a run on MIN_SHARE of a host's pages is on that share of
some part's pages, so only runs that are go out of the parts as candidates, as their tokens; these are then
counted in all parts of the host and judged by the whole.  Pages are moved once, to their parts; copies bring
their ids only to the part's record, in further records of COPIES ids if they are many.

Defined edge cases: null or empty html gives an empty text; a null url belongs to the host
``''``; repeated pages are repeated and count as one page; an empty table gives no rows;
columns other than page_id, url and html are ignored; unclosed elements end with their parent.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import partial
from html import unescape
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import small_batches, utf8
from graphloom.plans.scratch import Scratch

RUN_TOKENS = 8
MIN_PAGES = 3
MIN_SHARE = 0.1
PART_CHARS = 1_000_000
LEAST_PAGES = 40
COPIES = 1000
#: Characters of text in a batch of results.
OUT_CHARS = 4_000_000

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^<>]*+>|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/<>]*+)(?P<attr>[^<>\"']*+(?:\"[^\"]*\"[^<>\"']*+|'[^']*'[^<>\"']*+)*+)>",
    re.S,
)
_ATTR = re.compile(r"([a-zA-Z_:-]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_NAME = re.compile(r"[a-z]+")
_MAIN_ROLE = re.compile(r"role\s*=\s*[\"']?main\b")

_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr caption ul".split()
)
_CHROME = frozenset(
    "head script style textarea title iframe noembed noframes noscript template nav footer aside form button select datalist dialog menu object svg canvas "
    "audio video map search fieldset".split()
)
_CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status tooltip".split())
_CHROME_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs "
    "sidebar aside widget footer masthead cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe signup login share sharing social "
    "related recommended comment comments reply replies discussion respond disqus warning announcement paywall topbar navmenu adbox adslot adunit promoted pagination pager toolbar copyright disclaimer hidden".split()
)
_KEEP_NAMES = frozenset("html body article main".split())
_CONTENT_NAMES = frozenset("article content post entry story".split())


def _is_chrome(name: str, attr: str, inside: bool) -> bool:
    """Whether an element and all within it is no main text; inside: within an article or main element."""
    if name in _CHROME or (name == "header" and not inside):
        return True
    if not attr or attr.isspace():
        return False
    seen = {k.lower(): v.strip("\"'").lower() for k, v in _ATTR.findall(attr)}
    if "hidden" in seen or seen.get("aria-hidden") == "true" or "display:none" in seen.get("style", "").replace(" ", ""):
        return True
    if seen.get("role") in _CHROME_ROLES:
        return True
    if name in _KEEP_NAMES:
        return False
    names = set(_NAME.findall(seen.get("class", ""))) | set(_NAME.findall(seen.get("id", "")))
    return bool(names & _CHROME_NAMES) or (name in ("div", "section") and not inside and "header" in names)


def _is_content(attr: str) -> bool:
    """Whether a container's class or id names the content."""
    return any(k.lower() in ("class", "id") and not _CONTENT_NAMES.isdisjoint(_NAME.findall(v.lower())) for k, v in _ATTR.findall(attr))


def blocks_of(html: str | None) -> tuple[list[tuple[str, str]], set[str]]:
    """Blocks of text in page order, each with its zone (article, main, named, open or chrome); zones other than chrome with text."""
    out: list[tuple[str, str]] = []
    zones: set[str] = set()
    if not html:
        return out, zones
    stack: list[tuple[str, int, int, int, int]] = []  # name, and chrome, article, main, named depth before it
    opened: dict[str, int] = {}
    chrome = article = main = named = 0
    held: list[str] = []
    aside: list[str] = []  # text of chrome

    def flush_aside() -> None:
        text = " ".join("".join(aside).split())
        aside.clear()
        if text:
            out.append((text, "chrome"))

    def flush() -> None:
        flush_aside()
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                zone = "article" if article else "main" if main else "named" if named else "open"
                zones.add(zone)
                out.append((text, zone))

    def close(name: str) -> None:
        nonlocal chrome, article, main, named
        while stack:
            top, chrome, article, main, named = stack.pop()
            opened[top] -= 1
            if top == name:
                return

    at, size = 0, len(html)
    while at < size:
        m = _TAG.search(html, at)
        start = m.start() if m else size
        if start > at:
            (aside if chrome else held).append(unescape(html[at:start]))
        if not m:
            break
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["end"]:
            if name in _BLOCK:
                flush_aside() if chrome else flush()
            if opened.get(name):
                close(name)
            continue
        if name in _BLOCK:
            flush_aside() if chrome else flush()
            if opened.get("p"):  # a paragraph ends where a block begins, unless a container stands between
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        close("p")
                        break
                    if stack[k][0] in _BLOCK:
                        break
        elif name in ("br", "td", "th", "img", "option"):
            (aside if chrome else held).append(" ")
        if name in _VOID or m["attr"].endswith("/") and name not in _BLOCK:
            continue
        if name in _RAW:
            end = re.compile(f"</{name}(?=[\\s/>])[^>]*>", re.I).search(html, at)
            at = end.end() if end else size
            continue
        stack.append((name, chrome, article, main, named))
        opened[name] = opened.get(name, 0) + 1
        if _is_chrome(name, m["attr"], bool(article or main)):
            if not chrome:
                flush_aside()
            chrome += 1
        elif not chrome:
            article += name == "article"
            main += name == "main" or bool(_MAIN_ROLE.search(m["attr"]))
            named += name in ("div", "section") and _is_content(m["attr"])
    flush()
    return out, zones


def _content(zones: set[str]) -> str | None:
    """The zone that markup names as the main text, if any."""
    return next((z for z in ("article", "main", "named") if z in zones), None)


def parse(html: str | None) -> tuple[str | None, list[str] | None]:
    """(main text, None) where markup settles it, else (None, open blocks)."""
    blocks, zones = blocks_of(html)
    if zone := _content(zones):
        return "\n".join(t for t, z in blocks if z == zone), None
    return (None, [t for t, z in blocks if z != "chrome"]) if zones else ("", None)


#: The end of a block in the text of a run; no token has it.
MARK = "\n"
#: What the check makes of a block: none of the text, all of it, or what the arrays left.
DROP, WHOLE, LEFT = 0, 1, 2
_PARSED = T.StructType([T.StructField("twin", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("page", T.BinaryType())])


@F.pandas_udf(_PARSED)
def _parse(html: pd.Series) -> pd.DataFrame:
    """A hash of the blocks, and what is made of each (a digit) before the blocks, by lines, compressed."""
    twins, pages = [], []
    for blocks, zones in map(blocks_of, html):
        zone = _content(zones)
        take = "".join(str(DROP if z == "chrome" or zone and z != zone else WHOLE if zone else LEFT) for _, z in blocks)
        text = "\n".join(t for t, _ in blocks)
        twins.append(int(np.uint64(xxhash.xxh64_intdigest(utf8(text))).view(np.int64)))
        pages.append(utf8(f"{take}\n{text}"))
    packed = [pa.compress(x, codec="zstd", asbytes=True) for x in pages]
    return pd.DataFrame({"twin": pd.Series(twins, dtype="int64"), "size": pd.Series([len(x) for x in pages], dtype="int32"), "page": pd.Series(packed, dtype=object)})


def _blocks(page: str) -> list[str]:
    return page.split("\n")[1:] if page[0] != "\n" else []


def _text(page: str, left: list[str]) -> str:
    """The main text of a page of whose blocks the arrays left this."""
    take = page.split("\n", 1)[0]
    found = (b if int(t) == WHOLE else x if int(t) == LEFT else "" for t, b, x in zip(take, _blocks(page), left, strict=True))
    return "\n".join(x for x in found if x)


def run_ranks(stream: np.ndarray, length: int) -> np.ndarray:
    """Rank of the run of ``length`` tokens at each place in the suffix array sorted to that depth.

    Prefix doubling: the order of runs of 2w tokens is that of pairs of ranks of runs of w tokens.
    """
    rank = np.unique(stream, return_inverse=True)[1].astype(np.int64)
    width = 1
    while width < length:
        step = min(width, length - width)
        after = np.append(rank[step:], np.zeros(min(step, len(rank)), dtype=np.int64) - 1)[: len(rank)] + 1
        rank = np.unique(rank * (int(rank.max(initial=0)) + 2) + after, return_inverse=True)[1].astype(np.int64)
        width += step
    return rank


class Stream:
    """Blocks of distinct pages of one host, one after another, and the runs of tokens in them.

    Blocks end with a mark that takes part in the runs, so rows of short blocks are found too; no run
    reaches over a page's end.
    """

    def __init__(self, pages: list[list[str]], run: int = RUN_TOKENS):
        self.pages, self.run = pages, run
        number: dict[str, int] = defaultdict(count(1).__next__)
        stream: list[int] = []
        ends: list[int] = []  # of blocks, and of what stands behind a page
        blocks: list[int] = []
        sizes: list[int] = []
        for k, texts in enumerate(pages):
            begin = len(stream)
            for b in texts:
                stream.extend(map(number.__getitem__, b.split(" ")))
                stream.append(0)
                ends.append(len(stream))
                blocks.append(len(blocks) - k)
            stream.extend([-1 - k] * run)
            ends.append(len(stream))
            blocks.append(-1)
            sizes.append(len(stream) - begin)
        self.number, self.words = number, [MARK, *number]
        self.tokens = np.array(stream, dtype=np.int64)
        self.page = np.repeat(np.arange(len(pages)), np.array(sizes, dtype=np.int64))
        self.block = np.repeat(np.array(blocks, dtype=np.int64), np.diff(np.array(ends, dtype=np.int64), prepend=0))
        self.blocks = len(blocks) - len(pages)
        self.rank = run_ranks(self.tokens, run)
        whole = np.append(self.tokens >= 0, np.zeros(run, dtype=bool))
        ok = np.cumsum(np.append(0, whole))
        self.begins = np.flatnonzero(ok[run:][: len(self.tokens)] - ok[: len(self.tokens)] == run)  # places of runs within a page

    def counts(self, least: float = 1) -> tuple[list[str], list[int]]:
        """The distinct runs on so many pages or more, as text, and the pages that have each."""
        ranks = self.rank[self.begins]
        rank, first = np.unique(ranks, return_index=True)
        pairs = np.unique(ranks * max(1, len(self.pages)) + self.page[self.begins])
        pages = np.bincount(np.searchsorted(rank, pairs // max(1, len(self.pages))), minlength=len(rank))
        often = np.flatnonzero(pages >= least)
        return [self._run(i) for i in self.begins[first[often]].tolist()], pages[often].tolist()

    def _run(self, at: int) -> str:
        return " ".join(self.words[t] for t in self.tokens[at : at + self.run].tolist())

    def _places(self, runs: Iterable[str]) -> np.ndarray:
        """The places at which one of these runs begins."""
        known = [[0 if w == MARK else self.number.get(w, -1) for w in r.split(" ")] for r in runs]
        wanted = {tuple(k) for k in known if min(k) >= 0}
        ranks = self.rank[self.begins]
        rank, first = np.unique(ranks, return_index=True)
        at, by_column = np.arange(len(rank)), np.array(sorted(wanted), dtype=np.int64).reshape(-1, self.run)
        for j in range(self.run):
            at = at[np.isin(self.tokens[self.begins[first[at]] + j], by_column[:, j])]
        same = [i for i in at.tolist() if tuple(self.tokens[(p := self.begins[first[i]]) : p + self.run].tolist()) in wanted]
        return self.begins[np.isin(ranks, rank[same])]

    def counts_of(self, runs: Iterable[str]) -> tuple[list[str], list[int]]:
        """Those of these runs that the pages have, and the pages that have each."""
        places = self._places(runs)
        rank, first = np.unique(self.rank[places], return_index=True)
        pairs = np.unique(self.rank[places] * max(1, len(self.pages)) + self.page[places])
        pages = np.bincount(np.searchsorted(rank, pairs // max(1, len(self.pages))), minlength=len(rank))
        return [self._run(i) for i in places[first].tolist()], pages.tolist()

    def without(self, boilerplate: set[str]) -> list[str]:
        """Texts of the pages without these runs."""
        return ["\n".join(b for b in page if b) for page in self.left(boilerplate)]

    def left(self, boilerplate: set[str]) -> list[list[str]]:
        """What is left of every block of the pages without these runs."""
        begin = self._places(boilerplate)
        inside = begin[self.block[begin] == self.block[begin + self.run - 1]]
        inside = inside[self.tokens[inside + self.run - 1] > 0]  # not over the block's mark
        own, any_run = self._covered(inside), self._covered(begin)
        word = self.tokens > 0
        open_words = np.bincount(self.block[word & ~any_run], minlength=int(self.blocks) + 1)
        gone = own | (word & (open_words[self.block] == 0))
        out, at = [], 0
        for texts in self.pages:
            kept = []
            for b in texts:
                words = b.split(" ")
                kept.append(" ".join(w for w, g in zip(words, gone[at : at + len(words)].tolist(), strict=True) if not g))
                at += len(words) + 1
            at += self.run
            out.append(kept)
        return out

    def _covered(self, begin: np.ndarray) -> np.ndarray:
        edge = np.zeros(len(self.tokens) + self.run + 1, dtype=np.int64)
        np.add.at(edge, begin, 1)
        np.add.at(edge, begin + self.run, -1)
        return np.cumsum(edge)[: len(self.tokens)] > 0


#: A part's record: its pages, which of them are the first with their blocks, and the ids and urls of the rows, each with its page.
_PACK = "host string, part long, n long, pages array<string>, fresh array<boolean>, at array<int>, urls array<string>, runs array<string>, counts array<long>"


def _packs(batches: Iterator[pa.RecordBatch], copies: int) -> Iterator[pa.RecordBatch]:
    """Records of the parts, each part's rows in one piece and the rows of a twin together."""
    key, twin, last, pages, fresh, at, ids, urls = None, None, None, [], [], [], [], []
    kind = None

    def record(n: int, pages: list, fresh: list, at: list, ids: list, urls: list, found: tuple) -> pa.RecordBatch:
        one = {"host": [key[0]], "part": [key[1]], "n": [n], "pages": [pages], "fresh": [fresh], "at": pa.array([at], pa.list_(pa.int32())), "urls": pa.array([urls], pa.list_(pa.string()))}
        one |= {"runs": pa.array([found[0]], pa.list_(pa.string())), "counts": pa.array([found[1]], pa.list_(pa.int64())), "ids": pa.array([ids], pa.list_(kind))}
        return pa.RecordBatch.from_pydict(one)

    def part() -> pa.RecordBatch:
        own = [_blocks(p) for p, f in zip(pages, fresh, strict=True) if f]
        found = Stream(own).counts(max(1 if key[2] > 1 else MIN_PAGES, MIN_SHARE * len(own) * (1 - 1e-9)))
        return record(len(own), pages, fresh, at, ids, urls, found)

    for batch in batches:
        kind = batch.schema.field("page_id").type
        for host, p, parts, t, size, packed, page_id, url in zip(*(batch.column(c).to_pylist() for c in ("host", "part", "parts", "twin", "size", "page", "page_id", "url")), strict=True):
            if (host, p, parts) != key:
                if key:
                    yield part()
                key, twin, last, pages, fresh, at, ids, urls = (host, p, parts), None, None, [], [], [], [], []
            if t != twin or packed != last:
                pages.append(pa.decompress(packed, size, "zstd", asbytes=True).decode("utf-8", "surrogatepass"))
                fresh.append(t != twin)
                twin, last, begun = t, packed, len(ids)
            at.append(len(pages) - 1)
            ids.append(page_id)
            urls.append(url)
            if len(ids) - begun >= copies:
                yield record(0, pages[-1:], [False], [0] * (len(ids) - begun), ids[begun:], urls[begun:], ([], []))
                del at[begun:], ids[begun:], urls[begun:]
    if key:
        yield part()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pages of a part that have each of the host's candidates."""
    for batch in batches:
        for host, pages, fresh, wanted in zip(*(batch.column(c).to_pylist() for c in ("host", "pages", "fresh", "wanted")), strict=True):
            runs, on = Stream([_blocks(p) for p, f in zip(pages, fresh, strict=True) if f]).counts_of(wanted)
            yield pa.RecordBatch.from_pydict({"host": pa.array([host] * len(runs), pa.string()), "run": pa.array(runs, pa.string()), "pages": pa.array(on, pa.int64())})


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a record, with what markup makes of the blocks that the arrays left."""
    for batch in batches:
        kind = batch.schema.field("ids").type.value_type
        for pages, bad, at, ids, urls in zip(*(batch.column(c).to_pylist() for c in ("pages", "bad", "at", "ids", "urls")), strict=True):
            blocks = [_blocks(p) for p in pages]
            texts = [_text(p, x) for p, x in zip(pages, Stream(blocks).left(set(bad)) if bad else blocks, strict=True)]
            begin = chars = 0
            for end in range(1, len(ids) + 1):
                chars += len(texts[at[end - 1]])
                if end == len(ids) or chars > OUT_CHARS:
                    yield pa.RecordBatch.from_pydict({"page_id": pa.array(ids[begin:end], kind), "url": pa.array(urls[begin:end], pa.string()), "text": pa.array([texts[k] for k in at[begin:end]], pa.string())})
                    begin, chars = end, 0


def boilerplate(packs: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, bad) of hosts with boilerplate: its runs."""
    own = packs.where("n > 0")
    hosts = scratch.save(own.groupBy("host").agg(F.count("*").alias("parts"), F.sum("n").alias("all_pages")))
    found = own.select("host", F.explode(F.arrays_zip("runs", "counts")).alias("r")).select("host", F.col("r.runs").alias("run"), F.col("r.counts").alias("pages"))
    found = scratch.save(found.join(hosts, "host"))
    wanted = scratch.save(found.where("parts > 1").groupBy("host").agg(F.collect_set("run").alias("wanted")))
    counted = own.select("host", "pages", "fresh").join(wanted, "host").mapInArrow(_counted, "host string, run string, pages long")
    counted = scratch.save(counted.groupBy("host", "run").agg(F.sum("pages").alias("pages"))).join(hosts, "host")
    judged = found.where("parts = 1").select("host", "run", "pages", "all_pages").unionByName(counted.select("host", "run", "pages", "all_pages"))
    bad = judged.where(F.col("pages") >= MIN_PAGES).where(F.col("pages") >= MIN_SHARE * F.col("all_pages"))
    return scratch.save(bad.groupBy("host").agg(F.collect_list("run").alias("bad")))


def extract(pages: DataFrame, part_chars: int = PART_CHARS, least_pages: int = LEAST_PAGES, copies: int = COPIES) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    spark = pages.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "html")
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[^/?#]*//([^/?#]*)", 1)), F.lit(""))
    own = pages.select("page_id", "url", "html", host.alias("host"))
    # Only hosts of several parts are listed: at most one for each PART_CHARS of the input.
    sizes = own.groupBy("host", F.xxhash64("html").alias("h")).agg(F.max(F.length("html")).alias("chars")).groupBy("host")
    parts = F.least(F.ceil(F.sum("chars") / part_chars), F.floor(F.count("*") / least_pages))
    hosts = scratch.save(sizes.agg(parts.alias("parts")).where("parts > 1"))
    parsed = own.join(hosts, "host", "left").select("page_id", "url", "host", F.coalesce("parts", F.lit(1)).alias("parts"), _parse(F.col("html")).alias("p"))
    dealt = parsed.select("host", F.pmod("p.twin", "parts").alias("part"), "parts", "p.*", "page_id", "url")
    dealt = dealt.repartition("host", "part").sortWithinPartitions("host", "part", "twin", "page")
    kind = pages.schema["page_id"].dataType.simpleString()
    packs = scratch.save(dealt.mapInArrow(partial(_packs, copies=copies), f"{_PACK}, ids array<{kind}>"), compression="zstd")
    scratch.release()
    bad = boilerplate(packs, scratch)
    found = packs.join(bad, "host", "left").select("pages", "bad", "at", "ids", "urls").mapInArrow(_rows, f"page_id {kind}, url string, text string")
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
