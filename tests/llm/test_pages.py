"""Page operators: extraction and URL rules."""

import random
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import html_extract, url_filter
from tests.llm import messy

SHELL = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">'
    '<header>Site head</header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- <p>hidden</p> -->'
    '<div class="ad">Buy</div>%s<div id="comments"><p>First!</p></div><aside>Side</aside><form>Go</form><footer>&copy; x</footer></body></html>'
)


@pytest.mark.parametrize(
    ("body", "text"),
    [
        ("<article><h1>Head</h1><p>One &amp; two<br>three</p><p>Four</p></article>", "Head\nOne & two three\nFour"),
        ("<article><p><b>Unclosed<br><p>  next \n line</article>", "Unclosed\nnext line"),
        ("<article><header><h1>Kept head</h1></header><p>x</p><div class='share-buttons'>Share</div><footer>by me</footer></article>", "Kept head\nx"),
        ("<main><p>a</p><section class='comments'>no</section><p>b</p></main>", "a\nb"),
        ("<article><p>5 < 6 &lt;b&gt; &#233;&eacute; &nbsp;z</p><ul><li>i<li>j</ul></article>", "5 < 6 <b> éé z\ni\nj"),
        ("<ARTICLE><P HIDDEN>no</P><P STYLE='display: none'>no</P><P DATA-X='a>b'>yes</P></ARTICLE>", "yes"),
        ("<article><p>a</p><script>if (1 < 2) '<p>bad</p>'</script><noscript>n</noscript><p>b</p></article>", "a\nb"),
        ("<div class='post-content'><p>a</p><div class='sidebar'>no</div></div><div>other</div>", "a"),
        ("<article><table><tr><td>1</td><td>2</td></tr></table></article>", "1 2"),
    ],
)
def test_markup(body, text):
    assert html_extract.parse(SHELL % body) == (text, None)


def test_odd_pages():
    assert html_extract.parse(None) == ("", None) and html_extract.parse("") == ("", None)
    assert html_extract.parse("plain text") == (None, ["plain text"])
    assert html_extract.parse("<article><p>never closed") == ("never closed", None)
    assert html_extract.parse("<article>x</article><!-- open <p>y") == ("x", None)
    assert html_extract.parse("<" * 5000)[1] == ["<" * 5000]


def test_run_ranks_are_runs():
    r = random.Random(1)
    s = np.array([r.randrange(3) for _ in range(300)])
    for length in (1, 3, 8):
        rank = html_extract.run_ranks(s, length)
        for _ in range(400):
            i, j = r.randrange(300 - length), r.randrange(300 - length)
            assert (rank[i] == rank[j]) == (s[i : i + length].tolist() == s[j : j + length].tolist())
            if s[i : i + length].tolist() < s[j : j + length].tolist():
                assert rank[i] < rank[j]


def plain_boilerplate(pages, run, least):
    """Runs counted in a dictionary; a run over block ends only removes whole blocks."""
    streams = [[w for b in p for w in [*b.split(" "), "\0"]] for p in pages]
    on = Counter(g for s in streams for g in {tuple(s[i : i + run]) for i in range(len(s) - run + 1)})
    out = []
    for s in streams:
        own, over = set(), set()
        for i in range(len(s) - run + 1):
            if on[tuple(s[i : i + run])] >= least:
                (over if "\0" in s[i : i + run] else own).update(range(i, i + run))
        kept, begin = [], 0
        for end in (i for i, w in enumerate(s) if w == "\0"):
            words = range(begin, end)
            if not all(i in own or i in over for i in words):
                kept.append(" ".join(s[i] for i in words if i not in own))
            begin = end + 1
        out.append("\n".join(k for k in kept if k))
    return out


def cleaned(pages, run=8, least=3):
    s = html_extract.Stream(pages, run)
    return s.without({h for h, n in zip(*s.counts(), strict=True) if n >= least})


def test_boilerplate():
    r = random.Random(2)
    menu, foot = ["Home About Us", "News Shop Contact Help"], ["All rights are reserved by the owner of this site"]
    pages = [[*menu, " ".join(f"w{r.randrange(500)}" for _ in range(40)), *foot] for _ in range(9)]
    pages.append([*menu, pages[0][2], *foot])  # an article on two pages is no boilerplate
    got = cleaned(pages)
    assert got == plain_boilerplate(pages, 8, 3)
    assert all(g == p[2] for g, p in zip(got, pages, strict=True))
    noise = [[" ".join(r.choices("a b c".split(), k=r.randint(1, 12))) for _ in range(4)] for _ in range(7)]
    for run in (1, 2, 3, 4):
        assert cleaned(noise, run, 2) == plain_boilerplate(noise, run, 2)
    assert cleaned([]) == [] and cleaned([[]]) == [""]


def test_boilerplate_leaves_the_next_block_whole():
    """A menu that runs on into the body's first word takes nothing from the body."""
    menu = "Home News Shop Help About Us Now"
    pages = [[menu, f"Body of page {n} here only"] for n in ("one", "two", "three")]
    assert cleaned(pages) == [p[1] for p in pages] == plain_boilerplate(pages, 8, 3)


def open_table(spark, pages):
    rows = [(i, f"https://{h}/x", "<body>" + "".join(f"<div>{b}</div>" for b in blocks) + "</body>") for i, (h, blocks) in enumerate(pages)]
    return messy.pages(spark, rows)


@pytest.mark.parametrize("part_tokens", [200_000, 60])
def test_host_in_parts(spark, part_tokens):
    """Runs are counted over the whole host, however many arrays it is cut into; copies of a page count once."""
    r = random.Random(4)
    foot = "All rights are reserved by the owner of this site"
    promo = "Subscribe today and read all of our stories for free"
    words = lambda n: " ".join(f"w{r.randrange(900)}" for _ in range(n))
    pages = [("a", [words(12), *([promo] if i < 6 else []), foot]) for i in range(30)] + [("b", [words(12), foot]) for _ in range(2)]
    pages += [pages[7]] * 9 + [("a", ["one copied story about many things of the same day", words(3)])]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(open_table(spark, pages), part_tokens).collect()}
    want = [b[0] if h == "a" and b[-1] == foot else "\n".join(b) for h, b in pages]
    assert [got[i] for i in range(len(pages))] == want


@pytest.mark.parametrize("least_pages", [90, 30, 1])
def test_parts_send_candidates_only(spark, monkeypatch, least_pages):
    """However a host is dealt, the texts are those of one array, and unique runs never leave their part."""
    r = random.Random(7)
    foot, rare = "All rights are reserved by the owner of this site", "a line that only few of the many pages have at all"
    pages = [("a", [" ".join(f"w{r.randrange(9000)}" for _ in range(60)), *([rare] if i % 12 == 0 else []), foot]) for i in range(120)]
    pages += [pages[3]] * 25
    written = {}
    save = html_extract.Scratch.save
    monkeypatch.setattr(html_extract.Scratch, "save", lambda self, df, **kw: written.setdefault(tuple(df.columns), save(self, df, **kw)))
    got = {x["page_id"]: x["text"] for x in html_extract.extract(open_table(spark, pages), 300, least_pages, 4).collect()}
    assert [got[i] for i in range(len(pages))] == ["\n".join(b[:-1]) for _, b in pages]
    packs = next(df for c, df in written.items() if "runs" in c).collect()
    assert (len({p["part"] for p in packs}) > 1) == (least_pages < 90)
    assert sum(p["n"] for p in packs) == 120 and max(len(p["ids"]) - len(p["pages"]) for p in packs) <= 4
    if least_pages > 1:
        assert sum(len(p["runs"]) for p in packs) < 2000 < 120 * 60


def test_markup_of_equal_blocks(spark):
    """Pages of the same blocks are one page to the arrays, each with its own markup."""
    rows = [(1, "https://h/x", "<article><p>told</p></article><p>more</p>"), (2, "https://h/x", "<p>told</p><p>more</p>"), (2**60 + 1, "https://h/x", "<p>told</p><p>more</p>"), (None, None, "<p>told</p>")]
    got = [tuple(r) for r in html_extract.extract(messy.pages(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(1, "https://h/x", "told", 4), (2, "https://h/x", "told\nmore", 9), (2**60 + 1, "https://h/x", "told\nmore", 9), (None, None, "told", 4)], key=str)


def test_hostile_html():
    """Time grows with the page's length, not with its square."""
    import time

    for bad in ("<!", "<a ", "<a '", '<a b="', "<p", "</", "<!--", "&", "<script>", "<p>", "<div class='x'>", "<p><b>"):
        began = time.time()
        html_extract.parse(bad * 40_000)
        assert time.time() - began < 10, bad


def test_extract_rows(spark):
    open_page = "<body><div>Home About Us Now And Then Again Today</div><div>%d story number told once</div></body>"
    rows = [(i, "https://h.example/x", open_page % i) for i in range(5)] + [(9, None, SHELL % "<article><p>x</p></article>"), (9, None, SHELL % "<article><p>x</p></article>"), (None, "u", None)]
    got = sorted((r["page_id"] or -1, r["text"], r["n_chars"]) for r in html_extract.extract(messy.pages(spark, rows)).collect())
    want = [(i or -1, f"{i} story number told once", 24 + 0) for i in range(5)] + [(9, "x", 1), (9, "x", 1), (-1, "", 0)]
    assert [(a, b) for a, b, _ in got] == sorted((a, b) for a, b, _ in want) and all(n == len(t) for _, t, n in got)
    assert html_extract.extract(messy.pages(spark, [])).count() == 0


def test_arrays_see_every_page(spark):
    """What settled pages mark as a menu is cut from an open page of the host; what they name as content stays whole, also if it is repeated."""
    menu, told = "Home About Us Now And Then Again Today", "a passage of ten words that all of these pages share"
    rows = [(i, "https://h.example/x", f"<nav>{menu}</nav><article><p>{told} {i}</p></article>") for i in range(4)]
    rows.append((4, "https://h.example/y", f"<div>{menu}</div><div>only here</div>"))
    got = {r["page_id"]: r["text"] for r in html_extract.extract(messy.pages(spark, rows)).collect()}
    assert got == {i: f"{told} {i}" for i in range(4)} | {4: "only here"}


URLS = [
    "https://WWW.Example.com/en/25#top", "http://a.example.com/en/x?y", "http://example.com/fr/", "http://b.net/es/1", "http://net/fr/", "http://b.net/espana", "http://x.org/",
    "http://notexample.com/en/", "http://example.com", "http://example.com?q=/en/", "no scheme", None, "://com/", "http://user@com:80/", "a://b.com/c://d.net/es/", "http://.com//en/",
]


def plain_verdict(url):
    if not url or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        tail = rest[cut:]
        path = tail[: min([i for i in map(tail.find, "?#") if i >= 0], default=len(tail))]
    fits = [(h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda f: len(f[0]), default=(None, "allow"))
    return host, path, rule, verdict


def test_url_rules(spark):
    rows = [(i, u, "x") for i, u in enumerate(URLS)] + [(0, URLS[0], "x")]
    got = Counter(tuple(r) for r in url_filter.judge(messy.pages(spark, rows)).collect())
    assert got == Counter((i, *plain_verdict(u)) for i, u, _ in rows)
    assert url_filter.judge(messy.pages(spark, [])).count() == 0


@pytest.mark.parametrize("most", [1 << 12, 4])
def test_url_many_rules(spark, monkeypatch, most):
    monkeypatch.setattr(url_filter, "MAX_BLOCKS", most)
    r = random.Random(3)
    rules = [(r.choice(["allow", "block"]), f"s{i}.example", r.choice(["/", "/a/", "/a/b"])) for i in range(200)]
    pages = messy.pages(spark, [(i, f"http://{r.choice(['', 'm.'])}s{r.randrange(400)}.example/a/{r.choice('bc')}", "x") for i in range(300)])
    monkeypatch.setattr(url_filter, "RULES", rules)
    got = url_filter.judge(pages, url_filter.rule_table(spark, rules)).collect()
    urls = {p["page_id"]: p["url"] for p in pages.collect()}
    assert len(got) == 300 and all(tuple(g)[1:] == plain_verdict(urls[g["page_id"]]) for g in got)
