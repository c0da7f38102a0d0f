"""Operator 9: main text of HTML by union-free regular-expression inference.

Pages of a host are token streams of tags and text. The wrapper begins as one
page and is aligned with others, one by one: where texts differ it gets a slot,
where tags differ the difference becomes a repeated group (if a square of the
stream, ended by the same tag, repeats before it) or an optional group (if the
other stream has the tag further on). What results is a regular expression
without unions. Its fixed texts become rules by place: fixed text is the host's
own wherever it stands, inside an article as well as outside. All different pages
of a host are aligned, in groups that each give a wrapper and vote; texts are
counted by place over all pages of a host too. Every page is read by its host's
rules. What is left are slots and repeats; a wrapper can't tell those of an
article from those of menus, adverts and comments, which change from page to page
too, so among them the names of elements decide.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import cut, join_hot, parts

#: Different pages of a group that is aligned, at least on average, and tokens of each that are aligned at a time; no page and no token is left out.
GROUP, ALIGNED = 8, 4000
#: Different pages that show a text to be fixed, and the share of those with its place that must have it.
LEAST, MOST = 3, 0.9

OPAQUE = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)", re.S)
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
#: What stands in a tag after its name, quoted parts whole; it never gives back what it took, so a failure costs one pass.
INSIDE = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
SPACE = re.compile(r"\s+")
#: What an element must have to be named or hidden, and the longest attributes that are kept for elements that have them again.
TOLD, KEPT = re.compile(r"class|id|role|hidden|style", re.I), 200
NAME = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")

#: Elements without an end tag, elements whose content is no markup, and elements that stay inside a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that never hold main text, and words of class, id and role that say so.
OUTSIDE = frozenset("nav aside footer form button select option fieldset dialog menu noscript template svg canvas object audio video head script style textarea title iframe".split())
OUTSIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted nav navbar navigation menu breadcrumb breadcrumbs pager pagination header masthead topbar footer bottombar sidebar side aside rail widget "
    "widgets related recommended recommendations trending popular notice notices cookie cookies consent gdpr privacy alert warning popup modal overlay newsletter subscribe subscription signup login paywall share sharing social comment comments "
    "commentlist disqus respond reply replies discussion feedback reactions form search toolbar skip toc copyright disclaimer contentinfo complementary hidden".split()
)
MAIN_WORDS = frozenset("article main content post entry story".split())
CLOSED_BY = {"li": {"li"}, "p": {"p"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}


NAMELESS = frozenset(), False


def names_of(attributes: str) -> tuple[frozenset[str], bool]:
    """Words of an element's class, id and role, and whether it is hidden."""
    if not attributes or not TOLD.search(attributes):
        return NAMELESS
    return _kept_names(attributes) if len(attributes) <= KEPT else _names(attributes)


def _names(attributes: str) -> tuple[frozenset[str], bool]:
    words, hidden = set(), False
    for k, v in ATTRIBUTE.findall(attributes):
        k, v = k.lower(), v.strip("\"'")
        if k in ("class", "id", "role"):
            told = (t for t in v.lower().split() if not t.startswith(("has-", "with-", "no-")))  # those say what is beside an element
            words.update(x for t in told for x in NAME.split(t) if x)
        hidden |= k == "hidden" or (k == "aria-hidden" and v.lower() == "true") or (k == "style" and re.search(r"display\s*:\s*none", v, re.I) is not None)
    return frozenset(words), hidden


_kept_names = lru_cache(1 << 14)(_names)


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes): kinds are open, close and text. Comments and what raw elements hold are left out.

    Time grows with the page's length, whatever stands in it: what is found to
    be missing in the rest of a page isn't searched again. After the first tag
    with a quote that nothing closes, tags end at the next > whatever is quoted;
    after the last > all is text.
    """
    at, n, last, quotes = 0, len(page), page.rfind(">"), True
    while at < n:
        if page[at] != "<":
            end = page.find("<", at)
            end = n if end < 0 else end
            yield "text", page[at:end], ""
            at = end
        elif page.startswith(("<!--", "<![CDATA["), at):
            at = OPAQUE.match(page, at).end()
        elif at < last and page.startswith(("<!", "<?"), at):
            at = page.index(">", at) + 1
        elif at < last and (m := TAG.match(page, at)):
            end = INSIDE.match(page, m.end()) if quotes else None
            quotes = end is not None
            stop = end.end() if end else page.find(">", m.end()) + 1
            if not stop:
                yield "text", "<", ""
                at += 1
                continue
            name, at = m[2].lower(), stop
            if m[1]:
                yield "close", name, ""
                continue
            yield "open", name, page[m.end() : stop - 1]
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}\s*+>", re.I).search(page, at)
                at = end.end() if end else n
                yield "close", name, ""
        else:
            yield "text", "<", ""
            at += 1


def label(name: str, attributes: str) -> str:
    words, _ = names_of(attributes)
    return name + "".join("." + w for w in sorted(words) if not w.isdigit())


class Node(NamedTuple):
    """An open element and the one above it. place: a number for the labels down to it."""

    name: str
    outside: bool
    main: bool
    perhaps: bool
    place: int
    above: Node | None


ROOT = Node("", False, False, False, 0, None)


def place_of(labels: str) -> int:
    """The number of a place that is written as labels with / between them."""
    at = 0
    for x in labels.split("/") if labels else ():
        at = code(at, x)
    return at


def under(above: Node, name: str, attributes: str) -> Node:
    words, hidden = names_of(attributes)
    main = above.main or name in ("article", "main") or "main" in words
    outside = above.outside or hidden or name in OUTSIDE or (name == "header" and not above.main) or (bool(words & OUTSIDE_WORDS) and not (name in ("article", "main", "body", "html") and not words & {"comment", "comments", "reply"}))
    return Node(name, outside, main, above.perhaps or bool(words & MAIN_WORDS), code(above.place, label(name, attributes)), above)


def walk(page: str, also: Callable[[str, str, str], None] | None = None) -> Iterator[tuple[str, Node, str]]:
    """(kind, node, text) of block edges and texts; the node is the innermost open element, those inside a line left out. also: gets the page's tokens."""
    top, depth = ROOT, Counter()
    hidden_inline = 0
    for kind, name, attributes in tokens(page):
        if also is not None:
            also(kind, name, attributes)
        if kind == "text":
            if not hidden_inline:
                yield "text", top, name
        elif name in ("script", "style"):
            continue  # they stand inside lines, and tokens() has left out what they hold
        elif name == "br":
            yield "text", top, " "
        elif name in INLINE:
            if kind == "open" and (hidden_inline or names_of(attributes)[1]):
                hidden_inline += 1
            elif kind == "close" and hidden_inline:
                hidden_inline -= 1
        elif kind == "open":
            hidden_inline = 0
            if top.name in CLOSED_BY.get(name, {"p"}):
                depth[top.name] -= 1
                top = top.above
            if name not in VOID:
                top = under(top, name, attributes)
                depth[name] += 1
            yield "block", top, ""
        else:
            hidden_inline = 0
            if depth[name]:
                while top.name != name:
                    depth[top.name] -= 1
                    top = top.above
                depth[name] -= 1
                top = top.above
            yield "block", top, ""


def clean(text: str) -> str:
    return SPACE.sub(" ", entities.unescape(text)).strip()


# --- inference ---------------------------------------------------------------


class Stream:
    """A page as ("tag", label), ("end", name) and ("text", text), without elements that never hold main text, from tokens that are put in one by one."""

    def __init__(self) -> None:
        self.out: list[tuple[str, str]] = []
        self.text: list[str] = []
        self.skip = 0

    def put(self, kind: str, name: str, attributes: str) -> None:
        if kind == "text":
            if not self.skip:
                self.text.append(name)
        elif name in ("head", "script", "style", "noscript", "template"):
            self.skip = max(0, self.skip + (1 if kind == "open" else -1))
        elif name == "br":
            self.text.append(" ")
        elif not self.skip and name not in INLINE:
            self.close()
            if name not in VOID:
                self.out.append(("tag", label(name, attributes)) if kind == "open" else ("end", name))

    def close(self) -> list[tuple[str, str]]:
        if self.text and (t := clean("".join(self.text))):
            self.out.append(("text", t))
        self.text.clear()
        return self.out


def stream(page: str, most: int | None = ALIGNED) -> list[tuple[str, str]]:
    """The first `most` tokens of a page's stream, or a few more, all for None."""
    s = Stream()
    for t in tokens(page):
        s.put(*t)
        if most is not None and len(s.out) >= most:
            return s.out
    return s.close()


SLOT = ("slot", "")


def same(a: tuple, b: tuple) -> bool:
    return a == b or (a[0] in ("text", "slot") and b[0] in ("text", "slot"))


def matches(group: list, page: list, at: int) -> int | None:
    """Where the page goes on after a group that matches at a place."""
    for x in group:
        if x[0] in ("opt", "plus"):
            end = matches(x[1], page, at)
            if end is None and x[0] == "plus":
                return None
            while end is not None and end > at:
                at, end = end, matches(x[1], page, end) if x[0] == "plus" else None
        elif at < len(page) and same(x, page[at]):
            at += 1
        else:
            return None
    return at


def align(wrapper: list, page: list) -> list:
    """The wrapper generalised so that it matches the page too."""
    out: list = []
    i = j = 0
    while i < len(wrapper) and j < len(page):
        w, p = wrapper[i], page[j]
        if w[0] in ("opt", "plus"):
            end = matches(w[1], page, j)
            if w[0] == "plus":
                while end is not None and end > j:
                    j, end = end, matches(w[1], page, end)
            elif end is not None:
                j = end
            out.append(w)
            i += 1
        elif same(w, p):
            out.append(w if w == p else SLOT)
            i, j = i + 1, j + 1
        elif p[0] in ("text", "slot"):
            out.append(("opt", [SLOT]))
            j += 1
        elif w[0] in ("text", "slot"):
            out.append(("opt", [w]))
            i += 1
        else:
            # a repeated group: the side that goes on repeats what stands right before
            done = False
            for size in range(1, min(60, len(out)) + 1):
                piece = out[-size:]
                if piece[0][0] != "tag" or piece[-1][0] not in ("end", "text", "slot"):
                    continue
                a, b = matches(piece, page, j), matches(piece, wrapper, i) if all(x[0] not in ("opt", "plus") for x in wrapper[i : i + size]) else None
                if (a is not None and a > j) or (b is not None and b > i):
                    general = [SLOT if x[0] in ("text", "slot") else x for x in piece]
                    while len(out) >= 2 * size and matches(general, out[-2 * size : -size], 0) == size:
                        del out[-size:]
                    out[-size:] = [("plus", general)]
                    while a is not None and a > j:
                        j, a = a, matches(general, page, a)
                    while b is not None and b > i:
                        i, b = b, matches(general, wrapper, b)
                    done = True
                    break
            if done:
                continue
            # an optional group: whichever side has the other's tag sooner
            a = next((k for k in range(j + 1, len(page)) if same(page[k], w)), None)
            b = next((k for k in range(i + 1, len(wrapper)) if same(wrapper[k], p)), None)
            if a is not None and (b is None or a - j <= b - i):
                out.append(("opt", page[j:a]))
                j = a
            elif b is not None:
                out.append(("opt", wrapper[i:b]))
                i = b
            else:
                out += [("opt", [w]), ("opt", [p])]
                i, j = i + 1, j + 1
    out += [x if x[0] == "opt" else ("opt", [x]) for x in wrapper[i:]]
    return out + ([("opt", page[j:])] if j < len(page) else [])


def infer(pages: list[str]) -> dict[str, list[str]]:
    """The wrapper of a host's pages as rules: for each place (labels of the open elements) the fixed texts that all pages have there. Near copies of a page are one page, else what they share would look fixed."""
    alike: dict[int, dict[str, dict]] = {}
    for p, b in zip(pages, map(blocks_of, pages), strict=True):
        if b:
            alike.setdefault(content_key(b), {})[p] = told_of(b)
    different = {}
    for key, group in alike.items():
        n = Counter(c for told in group.values() for c, (_, w, _) in told.items() if w)
        for p, told in group.items():
            own = [(w, m) for c, (_, w, m) in told.items() if w and n[c] < max(2, MOST * len(group))]
            mine = 2 * sum(w for w, _ in own) > sum(w for _, w, _ in told.values())
            different[key, min(m for _, m in own) if mine else None] = p
    return rules_of([stream(p, None) for p in different.values()]) or {}


def rules_of(streams: list[list[tuple[str, str]]]) -> dict[str, list[str]] | None:
    """The rules of the wrapper of different pages; fewer than LEAST prove nothing. Streams are aligned ALIGNED tokens at a time, as far as LEAST pages go."""
    streams = [s for s in streams if s]
    if len(streams) < LEAST:
        return None
    wrapper: list = []
    for at in range(0, max(map(len, streams)), ALIGNED):
        pieces = [s[at : at + ALIGNED] for s in streams if len(s) > at]
        if len(pieces) < LEAST:
            break
        piece = pieces[0]
        for s in pieces[1:]:
            piece = align(piece, s)
        wrapper += piece
    rules: dict[str, list[str]] = {}

    def visit(items: list, place: list[str], optional: bool) -> None:
        for x in items:
            if x[0] in ("opt", "plus"):
                visit(x[1], place, optional or x[0] == "opt")
            elif x[0] == "tag":
                # what walk() closes is closed here too, so that places are the same
                name, above = x[1].split(".")[0], place[-1].split(".")[0] if place else ""
                if above in CLOSED_BY.get(name, {"p"}):
                    place.pop()
                place.append(x[1])
            elif x[0] == "end":
                if any(p.split(".")[0] == x[1] for p in place):
                    while place.pop().split(".")[0] != x[1]:
                        pass
            elif x[0] == "text" and not optional:
                rules.setdefault("/".join(place), []).append(x[1])

    visit(wrapper, [], False)
    return rules


# --- reading -----------------------------------------------------------------


class Block(NamedTuple):
    place: int
    text: str
    main: bool
    named: bool


def blocks_of(page: str, also: Callable[[str, str, str], None] | None = None) -> list[Block]:
    """The texts between block edges with their places (labels of the open elements), without those that names put outside."""
    blocks: list[Block] = []
    text: list[str] = []
    where = ROOT

    def close() -> None:
        if text:
            if not where.outside and (t := clean("".join(text))):
                blocks.append(Block(where.place, t, where.main, where.perhaps))
            text.clear()

    for kind, node, t in walk(page, also):
        if kind == "block":
            close()
        else:
            where = node
            text.append(t)
    close()
    return blocks


def preferred(blocks: list[Block]) -> list[Block]:
    """Those of articles if there are any, else those named like one, else all."""
    return [b for b in blocks if b.main] or [b for b in blocks if b.named] or blocks


def content_key(blocks: list[Block]) -> int:
    """Least hash of five words in a row of what names prefer; near copies mostly have the same."""
    return least_hash(" ".join(b.text for b in preferred(blocks)))


def least_hash(text: str) -> int:
    words = [w.encode("utf-8", "surrogatepass") for w in text.split()]
    whole, ends = b" ".join(words), list(accumulate(len(w) + 1 for w in words))
    return min(map(xxhash.xxh64_intdigest, (whole[a : b - 1] for a, b in zip([0, *ends], ends[4:] or [len(whole) + 1], strict=False))))


def told_of(blocks: list[Block]) -> dict[int, tuple[int, int, int]]:
    """By code (place and text) of a page's different blocks the place, and of those that names prefer how many words they have and their least hash."""
    chosen = set(preferred(blocks))
    return {code(x.place, digest(x.text)): (x.place, len(x.text.split()), least_hash(x.text) - (1 << 63)) if x in chosen else (x.place, 0, 0) for x in set(blocks)}


def read(page: str, rules: dict[str, list[str]]) -> str:
    """The main text: of all that isn't fixed at its place what lies in articles, else what is named like one, else the whole."""
    fixed = {(place_of(place), t) for place, v in rules.items() for t in v}
    return "\n".join(b.text for b in preferred([b for b in blocks_of(page) if (b.place, b.text) not in fixed]))


def code(place: int, text: str) -> int:
    """A hash of a place and a text or label there, as a signed 64-bit number."""
    return xxhash.xxh64_intdigest(f"{place}\n{text}".encode("utf-8", "surrogatepass")) - (1 << 63)


def digest(text: str) -> str:
    return xxhash.xxh64_hexdigest(text.encode("utf-8", "surrogatepass"))


def written(stream: list[tuple[str, str]]) -> list[str]:
    """A stream as strings, its texts as digests."""
    return ["=" + digest(x) if kind == "text" else ("<" if kind == "tag" else "/") + x for kind, x in stream]


def parsed(stream: list[str]) -> list[tuple[str, str]]:
    return [({"=": "text", "<": "tag"}.get(x[0], "end"), x[1:]) for x in stream]


def host_of(url_col: str):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of each row, from its whole html.

    A text is fixed at a place if at least MOST of the host's different pages
    that have the place have it there, or more than half of them if aligned
    wrappers have it too. All pages of a host are counted, from their whole html;
    near copies count as one: pages that have their least hash in common, unless
    more than half of a page's words are in blocks that fewer than MOST of them
    have, with another least hash. Fewer than LEAST pages prove nothing. All different
    pages of a host are aligned, in groups of GROUP or more by hash: a wrapper for
    each group, and more than half of a host's wrappers must have a text.
    A null or empty html gives an empty text; a URL
    without a host belongs to a host of its own. Broken markup is read as far
    as it goes. Rows that repeat each get a row; a null id stays null.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html")).withColumn("host", host_of("url"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, pages in (x for whole in batches for x in parts(whole, whole.column(2))):
            keys, texts, streams = [], [], []
            for p in pages:
                s = Stream()
                blocks = blocks_of(p, s.put)
                keys.append(content_key(blocks) - (1 << 63) if blocks else None)
                texts.append([{"p": p, "c": c, "w": w, "m": m} for c, (p, w, m) in told_of(blocks).items()])
                streams.append(written(s.close()) if blocks else [])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.int64()), pa.array(texts, pa.list_(pa.struct([(x, pa.int64()) for x in "pcwm"]))), pa.array(streams, pa.list_(pa.string()))], ["host", "mark", "key", "texts", "stream"])

    marked = rows.withColumn("mark", F.xxhash64("html"))
    seen = cut(marked.select("host", "mark", "html").mapInArrow(scan, "host string, mark long, key long, texts array<struct<p:long,c:long,w:long,m:long>>, stream array<string>"))
    # different pages may have their least hash in a text that all of them have: then that of their own blocks tells them apart
    alike = seen.where("key is not null").select("host", "key", "mark").distinct().groupBy(F.col("host").alias("_h"), F.col("key").alias("_k")).agg(F.count("*").alias("marks")).where("marks > 1")
    told = seen.join(cut(alike), (F.col("host") == F.col("_h")) & (F.col("key") == F.col("_k"))).select("host", "key", "mark", "marks", F.explode("texts").alias("x")).select("host", "key", "mark", "marks", "x.c", "x.w", "x.m").where("w > 0")
    told = cut(told.distinct())
    common = told.groupBy(F.col("host").alias("_h"), F.col("key").alias("_k"), F.col("c").alias("_c")).agg(F.count("*").alias("n"), F.max("marks").alias("of")).where((F.col("n") >= 2) & (F.col("n") >= MOST * F.col("of")))
    told = told.join(common, (F.col("host") == F.col("_h")) & (F.col("key") == F.col("_k")) & (F.col("c") == F.col("_c")), "left")
    own = told.groupBy(F.col("host").alias("_h"), F.col("key").alias("_k"), F.col("mark").alias("_m")).agg(F.sum("w").alias("w"), F.sum(F.when(F.col("_c").isNull(), F.col("w")).otherwise(0)).alias("own"), F.min(F.when(F.col("_c").isNull(), F.col("m"))).alias("least"))
    own = cut(own.where(2 * F.col("own") > F.col("w")).select("_h", "_k", "_m", "least"))
    seen = seen.join(own, (F.col("host") == F.col("_h")) & (F.col("key") == F.col("_k")) & (F.col("mark") == F.col("_m")), "left")
    seen = seen.select("host", "mark", F.when(F.col("least").isNull(), F.col("key")).otherwise(F.xxhash64("key", "least")).alias("key"), "texts", "stream")
    # a page for each key, and groups of a host's pages
    one = cut(seen.where("key is not null").groupBy("host", "key").agg(F.min_by("stream", "mark").alias("stream")))
    sizes = cut(one.groupBy("host").agg(F.count("*").alias("n")).withColumn("groups", F.greatest(F.lit(1), F.floor(F.col("n") / GROUP))))
    different = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    dealt = join_hot(one, sizes, "host", "n", different).withColumn("grp", F.pmod(F.xxhash64("key"), F.col("groups")))
    gathered = dealt.groupBy("host", "grp").agg(F.sort_array(F.collect_list(F.struct("key", "stream"))).alias("pages"))

    def induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                rules = rules_of([parsed(p["stream"]) for p in b.column(1)[i].as_py()])
                if rules is not None:
                    codes = sorted({code(place_of(place), t) for place, v in rules.items() for t in v})
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([codes], pa.list_(pa.int64()))], ["host", "codes"])

    votes = cut(gathered.select("host", "pages").mapInArrow(induce, "host string, codes array<long>"))
    voters = votes.groupBy(F.col("host").alias("_v")).agg(F.count("*").alias("all"))
    aligned = votes.select("host", F.explode("codes").alias("c")).groupBy("host", "c").agg(F.count("*").alias("votes"))
    aligned = aligned.join(voters, F.col("host") == F.col("_v")).where(2 * F.col("votes") > F.col("all"))
    aligned = aligned.select(F.col("host").alias("_a"), F.col("c").alias("_c"))
    each = seen.where("key is not null").select("host", "key", F.explode("texts").alias("x")).select("host", "key", "x.p", "x.c")
    by_text = each.distinct().groupBy("host", "p", "c").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST)
    by_place = each.select("host", "p", "key").distinct().groupBy(F.col("host").alias("_h"), F.col("p").alias("_q")).agg(F.count("*").alias("pages")).where(F.col("pages") >= LEAST)
    support = by_text.join(by_place, (F.col("host") == F.col("_h")) & (F.col("p") == F.col("_q"))).where(F.col("n") > 0.5 * F.col("pages")).select("host", "c", "n", "pages")
    support = support.join(aligned, (F.col("host") == F.col("_a")) & (F.col("c") == F.col("_c")), "left")
    fixed = support.where((F.col("n") >= MOST * F.col("pages")) | F.col("_c").isNotNull()).groupBy(F.col("host").alias("_f")).agg(F.collect_set("c").alias("rules"))
    wrappers = cut(seen.groupBy("host").agg(F.count("*").alias("n")).join(fixed, F.col("host") == F.col("_f"), "left").select("host", "rules", "n"))
    total = wrappers.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    joined = join_hot(rows, wrappers, "host", "n", total).select("page_id", "url", "html", "rules")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, pages in (x for whole in batches for x in parts(whole, whole.column(2))):
            out = []
            for p, r in zip(pages, b.column(3).to_pylist(), strict=True):
                fixed = frozenset(r or ())
                out.append("\n".join(x.text for x in preferred([x for x in blocks_of(p) if not fixed or code(x.place, digest(x.text)) not in fixed])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(extract, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
