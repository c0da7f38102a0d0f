import random
import re
import time
from collections import Counter

from trawl.llm import extraction as X
from trawl.llm.extraction import align, infer, main_text, matches, read, stream
from trawl.llm.licenses import TEMPLATES, license_scan


def shingles(text):
    w = [x for x in re.split(r"[\W_]+", text.lower()) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_license_scan(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    r = random.Random(7)
    filler = lambda n: " ".join(f"z{r.randrange(10**6)}" for _ in range(n))
    rows = [(9000 + i, f"{filler(i)} {t.upper() if i % 2 else t} {filler(40)}") for i, t in enumerate(x for v in TEMPLATES.values() for x in v)]
    longest = max((x for v in TEMPLATES.values() for x in v), key=len).split()
    rows += [(9500, filler(33) + " " + " ".join([*longest[:20], "altered", *longest[21:]])), (9501, " ".join(longest[: len(longest) // 2])), (9502, None), (9503, ""), (9504, "... !"), (None, "Released under the MIT License."), (9505, "one two three")]
    rows += [rows[0]]
    df = docs.union(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("license", docs.doc_id.isNull())
    want = Counter()
    for d in df.collect():
        have = shingles(d.text or "")
        for name, texts in TEMPLATES.items():
            for k, t in enumerate(texts):
                share = len(have & shingles(t)) / len(shingles(t))
                if share >= 0.8:
                    want[d.doc_id, name, k, len(shingles(t)), round(share, 9)] += 1
    got = Counter((g.doc_id, g.license, g.passage, g.n_shingles, round(g.containment, 9)) for g in license_scan(df).collect())
    assert not got - want
    assert sum((got & want).values()) >= 0.97 * sum(want.values())  # short passages are missed now and then
    assert {k: v for k, v in want.items() if k[3] > 5} == {k: v for k, v in got.items() if k[3] > 5}
    assert license_scan(df.limit(0)).count() == 0 and license_scan(df, {}).count() == 0


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><header><h2>Site</h2></header><nav><ul><li><a href=x>Home</a><li><a>B</a></ul></nav>
<div class="cookie-notice">We use cookies</div><article><h1>A &amp; B</h1><p>One <b>two</b><i>three</i>
 four&nbsp;five<br>six<p>Seven <script>var x = "<p>no</p>";</script>eight<!-- no --></p><ul><li>l1<li>l2</ul><form><input>no</form>
<section id="comments"><p>no!</p></section><div hidden>no</div></article><aside>no</aside><div class="ad box">no</div><footer>&copy; no</footer>"""


def test_read_one_page():
    assert read(PAGE, {}) == "A & B\nOne twothree four five six\nSeven eight\nl1\nl2"
    assert read("", {}) == "" and read("plain & text < 3", {}) == "plain & text < 3"
    assert read("<div>kept</div><div class=sidebar>no</div><p>too", {}) == "kept\ntoo"
    assert read("<p>a<<b>b</b", {}).startswith("a")
    assert read("<div>no</div><div class='content has-sidebar'><p>yes</p><div class=sidebar>no</div></div>", {}) == "yes"
    assert read("<main><h1>T</h1><article class=comment>no</article><aside><article>no</article></aside><p>yes</main>", {}) == "T\nyes"


def test_hostile_pages_take_linear_time():
    big = 1 << 20
    cases = ['<a "', "<a '", "<", "</p>", "<div>", "<!", "<p a=", "<script", "</script ", "<div><p>x", '<a b="c', "<b " + " " * 50, "<!-- ", "<x><y>text</z>"]
    for c in cases:
        for page in (c * (big // len(c)), c * (big // len(c)) + ">end"):
            began = time.process_time()
            read(page, {})
            assert time.process_time() - began < 20, c
    assert read('<p class="a>b">one</p><p>two <i x="y>z</i></p><p>three</p>', {}) == "one\ntwo z\nthree"


def test_alignment_finds_slots_repeats_and_options():
    page = lambda n, extra="": f"<body><div>Fixed</div><ul>{''.join(f'<li>i{k}{n}</li>' for k in range(n))}</ul>{extra}<p>text {n}</p></body>"
    streams = [stream(page(2)), stream(page(4)), stream(page(3, "<div class=x>opt</div>"))]
    w = streams[0]
    for s in streams[1:]:
        w = align(w, s)
    kinds = [x[0] for x in w]
    assert "plus" in kinds and "opt" in kinds and ("text", "Fixed") in w
    assert all(matches(w, s, 0) == len(s) for s in streams)
    rules = infer([page(2), page(4), page(3)])
    assert "Fixed" in sum(rules.values(), []) and not any("text" in t for v in rules.values() for t in v)
    assert read(page(5), rules).split("\n")[-1] == "text 5" and "Fixed" not in read(page(5), rules)


def brute(row):
    h = row.html or ""
    m = re.search(r"<article>(.*)</article>", h, re.S)
    if not m:
        return None
    import html

    blocks = (" ".join(html.unescape(re.sub(r"</?(?:b|br)>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", m[1]))
    return "\n".join(b for b in blocks if b)


def test_main_text_of_the_table(spark, sf):
    df = spark.read.parquet(f"{sf}/pages.parquet")
    odd = spark.createDataFrame([(90001, None, None, 1), (90002, "no host", "", 1), (None, "http://a.b/c", PAGE, 1), (90003, "http://a.b/c", "<p>" + "long " * 100_000, 1), (90003, "http://a.b/c", "<p>" + "long " * 100_000, 1), (90004, "http://a.b/c", "<" * 3000 + ">", 1)], "page_id long, url string, html string, n_chars int")
    rows = {r.page_id: r for r in df.collect()}
    got = main_text(df.withColumn("n_chars", df.page_id).unionByName(odd)).collect()
    assert len(got) == len(rows) + 6
    for g in got:
        assert g.n_chars == len(g.text)
        if g.page_id in rows and (want := brute(rows[g.page_id])) is not None:
            assert g.text == want and g.url == rows[g.page_id].url
    by = {g.page_id: g.text for g in got}
    assert by[90001] == by[90002] == "" and by[90003] == ("long " * 100_000).strip() and by[None].startswith("A & B\n")
    assert main_text(df.limit(0)).count() == 0


def test_sample_is_bounded():
    assert len(stream("<p>x</p>" * 10_000)) <= X.ALIGNED + 1


def test_fixed_text_goes_by_its_place_inside_articles_too():
    """A host-wide notice of neutral class or none goes wherever it stands; the same words at another place stay."""
    own = lambda n: " ".join(f"w{n}x{k}" for k in range(30))
    page = lambda n, more="": f"<body><article><div class=k7>All prices <b>may</b> change.</div><h1>Title {n}</h1><p>{own(n)}<p>Read on at our shop.</p>{more}</article></body>"
    rules = infer([page(n) for n in range(4)])
    got = read(page(9, "<blockquote>All prices may change.</blockquote>"), rules)
    assert got == f"Title 9\n{own(9)}\nAll prices may change."
    # near copies are no evidence of a host's own text
    assert infer([page(1).replace("w1x3 ", f"v{n} ") for n in range(6)]) == {}
    # an article with nothing but fixed text doesn't hide what varies beside it
    other = lambda n: f"<body><main><p>Please allow scripts.</p></main><div class=z>{own(n)}</div></body>"
    assert read(other(8), {"body/main/p": ["Please allow scripts."]}) == own(8)


def test_copies_and_long_pages_hide_no_fixed_text(spark):
    """Nine copies of a page don't fill the sample; a footer after more than ALIGNED tokens is learned; other pages' own text stays."""
    own = lambda n: " ".join(f"w{n}x{k}" for k in range(30))
    page = lambda n, many=1: f"<body><div class=k>Fixed host line.</div>{''.join(f'<p>{own(n * 5000 + i)}</p>' for i in range(many))}<div class=z>Last host line.</div></body>"
    rows = [(i, "http://copies.example/1", page(1)) for i in range(40)] + [(100 + n, "http://copies.example/2", page(n)) for n in range(2, 6)]
    rows += [(200 + n, "http://long.example/1", page(n, X.ALIGNED // 2)) for n in range(4)]
    got = {g.page_id: g.text for g in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows)
    for i, _, h in rows:
        assert got[i] == "\n".join(re.findall("<p>(.*?)</p>", h))


def test_all_pages_are_aligned_not_the_first_few(spark):
    """A text on 24 of 40 pages, those that come first in any order by content among them, is no text of the host's wrapper."""
    own = lambda n: " ".join(f"w{n}x{k}" for k in range(30))
    page = lambda n, told: f"<body><div class=k>{told}</div><p>{own(n)}</p><p>More {n}.</p></body>"
    key = lambda h: X.content_key(X.blocks_of(h))
    with_it = sorted(range(40), key=lambda n: key(page(n, "Shared line.")))[:24]
    html = {n: page(n, "Shared line." if n in with_it else f"Line of {n}.") for n in range(40)}
    assert set(sorted(html, key=lambda n: key(html[n]))[:8]) <= set(with_it)
    got = main_text(spark.createDataFrame([(n, "http://many.example/1", h) for n, h in html.items()], "page_id long, url string, html string")).collect()
    assert sum(g.text.startswith("Shared line.") for g in got) == 24
    assert sum(g.text.startswith("Line of") for g in got) == 16


def test_long_streams_are_aligned_to_their_end():
    own = lambda n, i: f"{n} text {i}"
    page = lambda n: f"<body>{''.join(f'<p>{own(n, i)}</p>' for i in range(X.ALIGNED))}<div class=z>Last line.</div></body>"
    assert infer([page(n) for n in range(4)]) == {"body/div.z": ["Last line."]}


def test_pages_with_their_least_hash_in_a_shared_text_are_all_aligned(spark):
    """Ten pages whose own words are the most of them aren't one page; one article with ten dates is."""
    own = lambda n: " ".join(f"w{n}x{k}" for k in range(30))
    notice = " ".join(f"shared{k}" for k in range(25))
    page = lambda n: f"<body><article><h1>Title {n}</h1><div class=k7>{notice}</div><p>{own(n)}</p></article></body>"
    key = lambda h: X.content_key(X.blocks_of(h))
    common = Counter(key(page(n)) for n in range(200)).most_common(1)[0][0]
    some = [n for n in range(200) if key(page(n)) == common][:10]
    assert len(some) == 10
    dated = lambda n: f"<body><article><h1>Title</h1><p>{own(0)}</p><div class=z>Seen on day {n}.</div></article></body>"
    rows = [(n, "http://same.example/1", page(n)) for n in some] + [(500 + n, "http://dated.example/1", dated(n)) for n in range(10)]
    got = {g.page_id: g.text for g in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {n: f"Title {n}\n{own(n)}" for n in some} | {500 + n: f"Title\n{own(0)}\nSeen on day {n}." for n in range(10)}
    assert infer([page(n) for n in some]) == {"body/article/div.k7": [notice]}
    assert infer([dated(n) for n in range(10)]) == {}
