"""Main texts of pages, by wrappers inferred from the pages of each host.

A page is a stream of start tags, end tags and texts, nested by element. A wrapper is a union-free
regular expression over such streams: elements in a fixed order, each once, optional (?), repeated (+) or both (*),
and slots for texts. It grows by alignment: what two streams share stays, tags that only one has become
optional, neighbours that repeat become one repeated element or group, and texts become slots.

Tasks fold the shapes of their own pages into one wrapper per host, and these are folded further, a bounded
number at a time, so no task sees all pages of a host. A page is then read along its host's wrapper, which says
what belongs to the article.
"""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crewmetrics.llm.common import Scratch

# How HTML's elements behave, and what names the parts of a page that are no article.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe xmp noembed noframes".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = set("ul ol dl table article section main body nav aside div select thead tbody tfoot".split())
NO_TEXT = set("head script style template noscript svg math canvas object iframe button select textarea form dialog menu title video audio".split())
ASIDE = set("nav footer aside".split())
WORDS = set(
    "ad ads advert advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert "
    "newsletter subscribe subscription signup login sidebar comment comments disqus respond reply replies menu nav navbar navigation "
    "breadcrumb breadcrumbs footer masthead share sharing social related recommended popup modal overlay widget pagination pager toolbar "
    "complementary contentinfo search dialog hidden".split()
)
#: What boxes are called, beside what is in them (``ad-slot``), and what a layout or topic is named after (``no-sidebar``).
BOXES = set("area bar block body box button card container content form frame group holder inner item items list panel row section slot text thread unit wrap wrapper".split())
STATES = set("category both format has hide is layout left no not right tag type with without".split())
#: Elements that hold a text rather than a part of the page, and words that in their classes may be what the text is about.
TEXTS = set("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption caption".split())
TOPICS = set("search related recommended social navigation menu dialog reply replies respond promotion toolbar pager".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6 header hgroup".split())
#: Elements whose ids name what they are about.
NAMED = set("h1 h2 h3 h4 h5 h6 section".split())
HEAD_WORDS = {"header", "topbar"}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^>\"'])*+)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
PERIOD = 4
#: Elements within each other; deeper ones count as part of the last, as browsers have it at a similar depth.
DEPTH = 200


class Node:
    """An element of a page: its name, and in order the elements and texts (text, characters in links) inside."""

    __slots__ = ("name", "kids")

    def __init__(self, name: str):
        self.name, self.kids = name, []


def _name(tag: str, attributes: str) -> str:
    """The tag with class, id (with a #) and role; numbers in them are all alike."""
    if not attributes or attributes.isspace():
        return tag
    words = []
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        key = key.lower()
        if key in ("class", "id", "role"):
            words += [("#" if key == "id" else "") + w for w in entities.unescape(a or b or c).split()]
        elif key == "hidden" or key == "aria-hidden" and (a or b or c) == "true":
            words.append("hidden")
    return " ".join([tag, *sorted({re.sub(r"\d+", "0", w) for w in words})])


def parse(html: str | None) -> Node:
    """The tree of a page; end tags that are missing or misplaced are dealt with as browsers do, roughly."""
    html = html or ""
    root = Node("#root")
    stack, tags, run, links, in_link, deeper = [root], ["#root"], [], 0, 0, 0

    def flush():
        nonlocal links
        text = " ".join("".join(run).split())
        if text:
            stack[-1].kids.append((text, links))
        run.clear()
        links = 0

    at, size = 0, len(html)
    while at < size:
        m = TOKEN.search(html, at)
        end = m.start() if m else size
        if end > at:
            text = entities.unescape(html[at:end])
            run.append(text)
            if in_link:
                links += len(text.strip())
        if not m:
            break
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                run.append(m[0][9:].removesuffix("]]>"))
            continue
        tag, closing, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if tag in INLINE or tag == "br":
            if tag == "a":
                in_link = 0 if closing else 1
            elif tag == "br":
                run.append(" ")
            continue
        flush()
        if len(stack) >= DEPTH and tag not in VOID and tag not in RAW:
            if not closing:
                deeper += 1
                continue
            if deeper:
                deeper -= 1
                continue
        if closing:
            if tag == "p":
                if tags[-1] == "p":
                    stack.pop(), tags.pop()
            elif tag in tags:
                in_link = 0
                while tags[-1] != tag:
                    stack.pop(), tags.pop()
                stack.pop(), tags.pop()
            continue
        if tags[-1] == "p":
            stack.pop(), tags.pop()
        if tag in CLOSES:
            k = len(tags) - 1
            while k > 0 and tags[k] not in HOLDS and tags[k] not in CLOSES[tag]:
                k -= 1
            if tags[k] in CLOSES[tag]:
                del stack[k:], tags[k:]
        node = Node(_name(tag, attributes))
        stack[-1].kids.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}\b", re.I).search(html, at)
            at = close.start() if close else size
            if not close:
                break
        if tag not in VOID and not attributes.rstrip().endswith("/"):
            stack.append(node)
            tags.append(tag)
    flush()
    return root


# A wrapper is [name, quantifier, kids]; texts are "#", groups "()".


def _both(q: str, r: str) -> str:
    many, none = q in "+*" or r in "+*", q in "?*" or r in "?*"
    return "*" if many and none else "+" if many else "?" if none else "1"


def _maybe(kid: list) -> list:
    return [kid[0], "*" if kid[1] in "+*" else "?", kid[2]]


def _key(kid: list) -> str:
    return kid[0] if kid[0] != "()" else "(" + " ".join(_key(k) for k in kid[2]) + ")"


def fold(kids: list[list]) -> list[list]:
    """Neighbours that repeat, of up to PERIOD elements, become one repeated element or group."""
    made: list[list] = []
    for kid in kids:
        made.append(kid)
        while True:
            for n in range(1, PERIOD + 1):
                if len(made) < 2 * n:
                    continue
                a, b = made[-2 * n : -n], made[-n:]
                if [_key(k) for k in a] == [_key(k) for k in b]:
                    both = [merge(x, y) for x, y in zip(a, b)]
                    made[-2 * n :] = [[*both[0][:1], "+" if both[0][1] in "1+" else "*", both[0][2]]] if n == 1 else [["()", "+", both]]
                    break
                if n > 1 and len(made) > n and made[-n - 1][0] == "()" and [_key(k) for k in made[-n - 1][2]] == [_key(k) for k in b]:
                    group = made[-n - 1]
                    made[-n - 1 :] = [["()", _both(group[1], "+"), [merge(x, y) for x, y in zip(group[2], b)]]]
                    break
            else:
                break
    return made


def _grouped(kids: list[list], groups: list[list]) -> list[list]:
    """``kids`` with each run that is one turn of a group put into such a group, inner groups before outer ones."""
    turns = {tuple(_key(k) for k in group[2]) for group in groups}
    sizes = sorted({len(turn) for turn in turns}, reverse=True)
    names, before = [_key(k) for k in kids], None
    while before != len(kids):
        before, made, called, i = len(kids), [], [], 0
        while i < len(kids):
            n = next((n for n in sizes if i + n <= len(kids) and tuple(names[i : i + n]) in turns), 0)
            made.append(["()", "1", kids[i : i + n]] if n else kids[i])
            called.append("(" + " ".join(names[i : i + n]) + ")" if n else names[i])
            i += n or 1
        kids, names = made, called
    return kids


def pairs(a: list[str], b: list[str]) -> list[tuple[int | None, int | None]]:
    """An alignment with as many equal names as can be; the first such one from the left.

    Rows of the table of common lengths are numbers with a bit for each of ``b``, 0 where the length grows. A row in
    ``isqrt(len(a))`` is kept and those after it are computed again when the way through the table gets there, so long
    lists take memory in proportion to len(b) * sqrt(len(a)) bits.
    """
    same = 0
    while same < len(a) and same < len(b) and a[same] == b[same]:
        same += 1
    made = [(i, i) for i in range(same)]
    n, m = len(a) - same, len(b) - same
    if not n or not m:
        return made + [(i, None) for i in range(same, len(a))] + [(None, j) for j in range(same, len(b))]
    ones, at = (1 << m) - 1, {}
    for j in range(m):
        at.setdefault(b[same + j], []).append(m - 1 - j)
    holds = {}
    for name, places in at.items():
        bits = bytearray((m + 7) // 8)
        for place in places:
            bits[place >> 3] |= 1 << (place & 7)
        holds[name] = int.from_bytes(bits, "little")

    def after(row: int, i: int) -> int:
        """The row for ``a`` from its i-th on, from that for ``a`` behind it."""
        common = row & holds.get(a[same + i], 0)
        return (row + common | row - common) & ones

    step = isqrt(n) + 1
    kept, row = {n: ones}, ones
    for i in range(n - 1, -1, -1):
        row = after(row, i)
        if i % step == 0:
            kept[i] = row
    rows: dict[int, int] = {}

    def length(i: int, j: int) -> int:
        if i not in rows:
            rows.clear()
            top = min((i // step + 1) * step, n)
            rows[top] = kept[top]
            for k in range(top - 1, i // step * step - 1, -1):
                rows[k] = after(rows[k + 1], k)
        return m - j - (rows[i] & (1 << m - j) - 1).bit_count()

    i = j = 0
    while i < n or j < m:
        if i < n and j < m and a[same + i] == b[same + j]:
            made.append((same + i, same + j))
            i, j = i + 1, j + 1
        elif j == m or i < n and length(i, j) == length(i + 1, j):
            made.append((same + i, None))
            i += 1
        else:
            made.append((None, same + j))
            j += 1
    return made


def merge(a: list, b: list) -> list:
    """The wrapper of what either ``a`` or ``b``, of one name, describes."""
    if a[2] == b[2]:
        return [a[0], _both(a[1], b[1]), a[2]]
    left = _grouped(a[2], [k for k in b[2] if k[0] == "()"])
    right = _grouped(b[2], [k for k in a[2] if k[0] == "()"])
    kids = []
    for i, j in pairs([_key(k) for k in left], [_key(k) for k in right]):
        kids.append(merge(left[i], right[j]) if i is not None and j is not None else _maybe(left[i] if j is None else right[j]))
    return [a[0], _both(a[1], b[1]), fold(kids)]


def shape(node: Node) -> list:
    return [node.name, "1", fold([["#", "1", []] if isinstance(k, tuple) else shape(k) for k in node.kids])]


# What a wrapper says of its elements.


def _words(name: str) -> set[str]:
    return {w for part in name.split(" ")[1:] for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", part).lower())}


def _tag(name: str) -> str:
    return name.partition(" ")[0]


def _tokens(name: str) -> set[str]:
    """Whole words of class, id and role; headings and sections go by what they are, not by their ids."""
    tag, *parts = name.lower().split()
    return {w.removeprefix("#") for w in parts if w[0] != "#" or tag not in NAMED}


def _furniture(name: str) -> bool:
    """Whether a class, id or role says that this is no part of an article: the word itself, or a compound that ends in one
    (``post-comments``), boxes left aside (``ad-slot``). In elements of text, words that may be its topic don't count.
    """
    known = WORDS - TOPICS if _tag(name) in TEXTS else WORDS
    if _tokens(name) & known:
        return True
    for part in name.split()[1:]:
        if part[0] == "#" and _tag(name) in NAMED:
            continue
        words = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", part).lower()) if w]
        while len(words) > 1 and words[-1] in BOXES:
            words.pop()
        if words and words[-1] in known and words[0] not in STATES:
            return True
    return False


def _is_main(name: str) -> bool:
    return _tag(name) in ("article", "main") or bool({"main", "#main"} & set(name.split()[1:]))


def _has_main(kid: list) -> bool:
    """Whether the article may be in here; in what looks like no article, articles that do so too don't count."""
    return _is_main(kid[0]) and not _furniture(kid[0]) or any(_has_main(k) for k in kid[2] if not _dropped(k, False))


def _holds(kid: list, tags: set[str]) -> bool:
    return any(_tag(k[0]) in tags or _holds(k, tags) for k in kid[2])


def _bodied(article: list) -> bool:
    """Whether an article has texts, beside headings, that are in none of the articles inside."""
    for kid in article[2]:
        if kid[0] == "#":
            return True
        if _tag(kid[0]) not in HEADINGS and _tag(kid[0]) != "article" and not _dropped(kid, True) and _bodied(kid):
            return True
    return False


def _dropped(kid: list, inside: int) -> bool:
    """Whether an element is no part of an article; ``inside``: it stands in one."""
    tag = _tag(kid[0])
    if tag == "form":  # some servers put the whole page into one
        return not (any(_has_main(k) for k in kid[2]) or not inside and _holds(kid, {"h1", "nav", "header", "footer"}))
    if tag in NO_TEXT:
        return True
    if tag in ("#root", "html", "body") or _is_main(kid[0]):
        return False
    if inside:
        return tag in ASIDE or _furniture(kid[0])
    words = _words(kid[0])
    if tag in ASIDE or tag == "header" or words & HEAD_WORDS or _furniture(kid[0]):
        return not any(_has_main(k) for k in kid[2])
    return bool(words & WORDS) and not _holds(kid, {"h1"}) and not any(_has_main(k) for k in kid[2])


def _doubtful(name: str) -> bool:
    """Whether parts of class words say that an element of an article is none of it."""
    parts = [w for w in name.split()[1:] if w[0] != "#" or _tag(name) not in NAMED]
    return not _is_main(name) and bool(_words(" ".join(["", *parts])) & WORDS)


def _teasers(elements: list[list]) -> set[str]:
    """Names of the articles that a wrapper repeats beside another that it has once."""
    once, many = set(), set()

    def see(kids: list[list], repeated: bool) -> None:
        for kid in kids:
            if kid[0] == "()":
                see(kid[2], repeated or kid[1] in "+*")
            elif _tag(kid[0]) == "article":
                (many if repeated or kid[1] in "+*" else once).add(kid[0])

    see(elements, False)
    return many if once - many else set()


def read(
    node: Node, wrapper: list, grade: int = 0, doubtful: bool = False, path: str = "", lower: bool = False, bodied: bool = False
) -> Iterator[tuple[str, str, int, int, bool]]:
    """(slot, text, characters in links, grade, doubtful) of what the wrapper doesn't drop, in the page's order.

    The grade is 3 in a page's main element, else 2 in an article, else 0; it is one less in an article that stands in
    the body of another (a reader's comment), that the wrapper repeats beside one it has once (a teaser), or whose class says that it is
    no article. The best grade of a page is its article, so a page that holds nothing better keeps these.
    """
    names = ["#" if isinstance(kid, tuple) else kid.name for kid in node.kids]
    teasers = _teasers(wrapper[2])
    for kid, (position, element) in zip(node.kids, _along(names, wrapper[2])):
        slot = f"{path}/{position}"
        if isinstance(kid, tuple):
            yield slot, *kid, grade, doubtful
            continue
        if element is None:  # read by its own shape
            element = shape(kid)
        name = element[0]
        if _dropped(element, grade):
            continue
        within, below, body, doubt = grade, lower, bodied, doubtful
        if _is_main(name):
            article = _tag(name) == "article"
            within = within or (2 if article else 3)
            if article and not lower and (bodied or name in teasers or _furniture(name)):
                within, below = within - 1, True
            if article:
                body = _bodied(element)
        elif grade:
            doubt = doubtful or _doubtful(name)
        yield from read(kid, element, within, doubt, slot, below, body)


def _along(names: list[str], elements: list[list]) -> Iterator[tuple[str, list | None]]:
    """For each name of a page the place and element of the wrapper that it is read by, from left to right.

    An element may be followed by itself if it is repeated, and a group by its next turn.
    """
    flat: list[tuple[str, str, list]] = []
    back: list[tuple[int, int]] = []  # last and first place of what is repeated, inner groups before outer ones

    def lay(kids: list[list], prefix: str) -> None:
        for p, kid in enumerate(kids):
            begin = len(flat)
            if kid[0] == "()":
                lay(kid[2], f"{prefix}{p}.")
            else:
                flat.append((_key(kid), f"{prefix}{p}", kid))
            if kid[1] in "+*":
                back.append((len(flat) - 1, begin))

    lay(elements, "")
    places: dict[str, list[int]] = {}
    for i, (key, *_) in enumerate(flat):
        places.setdefault(key, []).append(i)
    turns: dict[int, list[int]] = {}  # where what is repeated around a place begins, inner groups before outer ones
    for end, begin in back:
        for i in range(begin, end + 1):
            turns.setdefault(i, []).append(begin)
    at = 0
    for key in names:
        held = places.get(key)
        if held is None:
            yield "?", None
            continue
        i = bisect_left(held, at)
        place = held[i] if i < len(held) else held[0]
        if place != at:
            for begin in turns.get(at - 1, ()):
                i = bisect_left(held, begin)
                if i < len(held) and held[i] < at:
                    place = held[i]
                    break
        at = place + 1
        yield flat[place][1], flat[place][2]


def _repeats(text: str, links: int) -> bool:
    """Whether a text is mostly links, so that it goes where other pages have it too."""
    return 2 * links > len(text)


def extract(html: str | None, wrapper: list, constant: set[str] = frozenset(), shared: set[int] = frozenset()) -> str:
    """The blocks of the page's article but constant ones in doubtful parts; without one, all texts that are neither
    in ``constant`` slots nor links whose marks are ``shared`` with other pages."""
    found = list(read(parse(html), wrapper))
    best = max((grade for *_, grade, _ in found), default=0)
    if best:
        blocks = [text for slot, text, _, grade, doubtful in found if grade == best and not (doubtful and slot in constant)]
    else:
        blocks = [text for slot, text, links, *_ in found if slot not in constant and not (_repeats(text, links) and _mark(text) in shared)]
    return "\n\n".join(blocks)


# Over all pages.


def _fold_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[str, list] = {}
    seen: dict[str, set[int]] = {}
    for batch in batches:
        for row in range(batch.num_rows):
            host, html = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
            made = shape(parse(html))
            mark = xxhash.xxh64_intdigest(json.dumps(made))
            if mark not in seen.setdefault(host, set()):
                seen[host].add(mark)
                found[host] = merge(found[host], made) if host in found else made
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(found), pa.string()), pa.array([json.dumps(w) for w in found.values()], pa.string())],
        names=["host", "wrapper"],
    )


def _fold_wrappers(rows: pd.DataFrame) -> pd.DataFrame:
    made = None
    for text in sorted(set(rows["wrapper"])):
        made = json.loads(text) if made is None else merge(made, json.loads(text))
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "wrapper": [json.dumps(made)]})


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def wrappers(pages: DataFrame, levels: tuple[int, ...] = (64, 1)) -> DataFrame:
    """host, wrapper (JSON) for ``pages`` (host, html); a host's partial wrappers meet in ``levels`` of so many groups."""
    found = pages.select("host", "html").mapInArrow(_fold_pages, "host string, wrapper string").distinct()
    for n in levels:
        salt = F.pmod(F.xxhash64("wrapper"), F.lit(n))
        found = found.groupBy("host", salt.alias("salt")).applyInPandas(_fold_wrappers, "host string, wrapper string")
    return found


def _mark(text: str) -> int:
    return xxhash.xxh64_intdigest(text) >> 1


@lru_cache(maxsize=256)
def _loaded(wrapper: str) -> list:
    """A wrapper as a list; a task keeps those of the hosts it met last."""
    return json.loads(wrapper)


def _votes(pages: DataFrame) -> DataFrame:
    """host, page, whole, held (slot, mark of its text), links (marks of texts that are mostly links) of ``pages`` (host, page, html, wrapper)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in range(batch.num_rows):
                host, page, html, wrapper = (batch.column(c)[row].as_py() for c in range(4))
                rows = list(read(parse(html), _loaded(wrapper)))
                if rows:
                    whole = xxhash.xxh128_hexdigest(json.dumps([text for _, text, *_ in rows]))
                    held = sorted({(slot, _mark(text)) for slot, text, *_ in rows})
                    found.append((host, page, whole, [{"slot": s, "mark": m} for s, m in held], sorted({_mark(t) for _, t, n, *_ in rows if _repeats(t, n)})))
            columns = list(zip(*found)) or [[]] * 5
            kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.struct([("slot", pa.string()), ("mark", pa.int64())])), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["host", "page", "whole", "held", "links"])

    made = "host string, page string, whole string, held array<struct<slot string, mark long>>, links array<long>"
    return pages.select("host", "page", "html", "wrapper").mapInArrow(count, made)


def _constants(votes: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """host, constant: the host's slots that hold one text on all of its pages, at least ``least``, a list no longer than its
    wrapper; and host, page, shared: the marks of those texts of links on a page that ``least`` pages of its host have. Pages with
    the same texts are one page.
    """
    different = votes.dropDuplicates(["host", "whole"])
    total = different.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    same = different.select("host", F.inline("held")).groupBy("host", "slot").agg(
        F.min("mark").alias("low"), F.max("mark").alias("high"), F.count(F.lit(1)).alias("n")
    )
    same = same.where((F.col("low") == F.col("high")) & (F.col("n") >= least)).join(total, "host").where(F.col("n") == F.col("pages"))
    constant = same.groupBy("host").agg(F.concat_ws(" ", F.sort_array(F.collect_list("slot"))).alias("constant"))
    often = different.select("host", F.explode("links").alias("mark")).groupBy("host", "mark").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    marks = votes.select("host", "page", F.explode("links").alias("mark")).distinct()
    shared = marks.join(often.select("host", "mark"), ["host", "mark"]).groupBy("host", "page").agg(F.collect_list("mark").alias("shared"))
    return constant, shared


def main_texts(pages: DataFrame, least: int = 3) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html).

    Character references are decoded, white space inside a block is one space, blocks are joined by an empty line. A null
    html or one without an article's text has an empty text. Pages without a host are one host's. A page of its
    own host is read by the wrapper of that page alone. Repeated rows and null ids are returned as they are, no
    pages give no rows; other columns are not read. A host's constant slots are those of its wrapper, a bounded list.
    Texts of links that several of its pages share are a table by host and mark, which meets each page's own marks.
    """
    scratch = Scratch(pages.sparkSession)
    pages = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), "html").withColumn("page", F.md5(F.coalesce("html", F.lit(""))))
    learnt = scratch.save(wrappers(pages))
    unsure = F.udf(lambda w: not _sure(json.loads(w)) or _doubts(json.loads(w)), "boolean")
    loose = scratch.save(learnt.where(unsure("wrapper")))
    constant, shared = _constants(scratch.save(_votes(pages.join(loose, "host"))), least)
    # Written, so that the joins with the pages know their sizes: pages move only if a side is too large to broadcast.
    learnt = scratch.save(learnt.join(constant, "host", "left"))
    shared = scratch.save(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for row in range(batch.num_rows):
                html, wrapper, slots, marks = (batch.column(c)[row].as_py() for c in range(2, 6))
                texts.append(extract(html, _loaded(wrapper), set((slots or "").split()), set(marks or ())))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pages.join(learnt, "host").join(shared, ["host", "page"], "left").select("page_id", "url", "html", "wrapper", "constant", "shared")
    return rows.mapInArrow(run, rows.select("page_id", "url").schema.add("text", "string").add("n_chars", "long"))


def _sure(wrapper: list) -> bool:
    """Whether each page of the wrapper has an article."""
    if _is_main(wrapper[0]):
        return wrapper[1] in "1+"
    return wrapper[1] in "1+" and any(_sure(k) for k in wrapper[2] if not _dropped(k, False))


def _doubts(wrapper: list, inside: bool = False) -> bool:
    """Whether an article of the wrapper has doubtful parts."""
    if _dropped(wrapper, inside):
        return False
    within = inside or _is_main(wrapper[0])
    return inside and _doubtful(wrapper[0]) or any(_doubts(k, within) for k in wrapper[2])
