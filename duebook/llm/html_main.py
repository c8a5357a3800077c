"""Main text of web pages by consensus host paths.

First pass: every page's containers are scored - text outside links in the blocks they hold, half of it for the container around
them - and the scores are summed per host and generalised path (tags and classes from the root, digits as #). From the path with the most
the host climbs to the highest ancestor whose other text is rather the page's own than links or text that the host repeats on unlike pages,
so titles, leads and further sections around the largest container stay. A host with one page knows no repeats and climbs within an
article or main element, or where what a step adds is blocks of prose. Second pass: each page is read again and gives the text of the elements at its
host's path, without what is never article text (menus, footers, sidebars, notices, adverts, scripts, styles, comments). A page without that
path, or without a host, gives the text at its own best path.

Classes and ids that name such a kind as a whole ("cookie-notice", "site-header") drop their element, as do form and header elements; those that
only hold such a word ("related-work", "entry-header") count like links when containers are scored and stay where the chosen container holds
them. Names lie, so an element of a kind that articles have parts of as well (``GENERIC``: a form around the page, a widget that is the article, a
post's header) is judged by what it holds: it stays if most of the page's text is in it, if it holds the page's only first heading and no menu, or,
being a block of prose (inside article or main of any length) or named there by its id alone, if it is not mostly links. A heading's id drops nothing.

Null or empty html: empty text. Null url: no host. Unclosed tags, broken references and cut pages are read as browsers would. Pages of any
length and depth are read whole; a long path goes by a hash of its upper part. Repeated pages vote as often as they occur, but their copies
are no repeats. Ties: the first path in order. Other columns are not read. An empty table gives no rows. Scores are combined per batch
before the shuffle; the texts of a path, a hash each, are compared per host, path and hash, so a host with a third of all pages is spread;
what meets in one task are sums for a winner's ancestors, at most DEEPEST of a host. The winners are one row per host, broadcast up to ``MOST_HOSTS`` and joined by
shuffle beyond.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duebook.llm.common import bounded_broadcast, cut, map_rows, small_batches, staged

MOST_HOSTS = 200_000
#: Characters of a path from which on its upper part is a hash.
LONG_PATH = 400
#: Levels of a page that the climb tells apart; what lies deeper counts as at the last of them.
DEEPEST = 256

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
NEVER = frozenset("nav footer aside menu dialog noscript template iframe svg math button select option object canvas audio video head".split())
BLOCK = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote figcaption caption summary tr td th".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ALIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table".split())
_KIND = (
    "ads?#*|adverts?|advertisement|advertising|banners?|breadcrumbs?|comments?|cookies?|consent|copyright|disqus|footers?|forms?|headers?|masthead|menus?|modal|nav|navbar|"
    "navigation|newsletter|notices?|notifications?|pagination|popups?|promos?|promoted|related|replies|respond|share|sharing|sidebars?|social|sponsor(?:ed|s)?|subscribe|widgets?")
_WHERE = "site|page|global|top|bottom|left|right|main|primary|secondary|mobile|cookie|side|user|reader|ad|share|social|menu|nav"
_PART = "slot|unit|box|bar|block|area|list|container|wrapper|wrap|item|items|links?|section|banner|notice|form|menu|widget|button|buttons|popup|modal|overlay|label|posts|articles|stories|thread|content|inner|#+"
#: The word in a class, and a class that is the word with where it is and what part of it.
UNWANTED = re.compile(rf"(?:^|[\s_-])(?:{_KIND})(?=$|[\s_-])".replace("#", r"\d"), re.I)
SURELY = re.compile(rf"(?P<where>(?:(?:{_WHERE})[_-]+)*)(?P<kind>{_KIND})(?:[_-]+(?:{_PART}|{_WHERE}))*".replace("#", r"\d"), re.I)
#: Characters from which on a block outside article and main is prose whatever it is called.
PROSE = 80
#: Kinds that articles have parts of as well.
GENERIC = frozenset("banner banners form forms header headers masthead related share sharing social widget widgets".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ROLES = frozenset(("navigation", "contentinfo", "complementary", "search", "dialog", "alert", "menu"))
_SOFT_ROLES = {"banner": "banner", "form": "form"}
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<raw>script|style|title|textarea|xmp|noembed|noframes)\b[^>]*+(?:>.*?(?:</(?P=raw)\s*+>|\Z)|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*+)(?P<attrs>(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^'\">])*+)(?:>|\Z)", re.I | re.S)
_ATTR = re.compile(r"(?:^|\s|/)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class _Element:
    __slots__ = ("tag", "path", "parent", "drop", "link", "within", "up", "doubt", "kinds", "chars", "links", "head", "menus", "named", "block", "level", "anchor")

    def __init__(self, tag, path, parent, drop, link, doubt=False, kinds=()):
        self.tag, self.path, self.parent, self.drop, self.link, self.doubt = tag, path, parent, drop, link, doubt
        self.kinds = kinds  # (what names it, where it says it is, kind) for each name that may drop it
        self.chars = self.links = self.menus = 0
        self.head = tag == "h1" and not drop
        self.named = bool(kinds) or parent is not None and parent.named
        self.level = 1 if parent is None else parent.level + 1
        self.anchor = self if self.level <= DEEPEST else parent.anchor
        self.block = tag in BLOCK or tag in INLINE and parent is not None and parent.block
        self.within = parent is not None and parent.within or tag in ("article", "main")
        # the nearest element that can be a container: itself, or what holds its block
        self.up = parent.up if parent is not None and (tag in BLOCK or tag in INLINE) else self


def _path(above: str, segment: str) -> str:
    path = f"{above}/{segment}"
    return path if len(path) <= LONG_PATH else f"~{hashlib.blake2b(path.encode('utf-8', 'replace'), digest_size=16).hexdigest()}/{segment[:40]}"


def read(page: str) -> list[tuple[_Element, str]]:
    """The page's texts in order with the elements that hold them; a text of "\\n" stands for a block's edge. Dropped parts are left out."""
    stack = [_Element("", "", None, False, False)]
    elements, out, at = list(stack), [], 0

    def pop_to(tags, stop):
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                del stack[k:]
                return
            if stack[k].tag in stop:
                return

    for m in _TOKEN.finditer(page):
        top = stack[-1]
        if m.start() > at and not top.drop:
            out.append((top, html.unescape(page[at : m.start()])))
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        edge = tag not in INLINE
        if edge and not top.drop:
            out.append((top, "\n"))
        if m["end"]:
            if tag == "p" or tag in INLINE:
                pop_to({tag}, SCOPE | CLOSES_P - {"p"})
            else:
                pop_to({tag}, ())
        elif tag in VOID:
            continue
        else:
            if tag in CLOSES_P:
                pop_to({"p"}, SCOPE | {"div", "article", "section", "main", "td", "li", "blockquote"})
            if tag in ALIKE:
                pop_to(ALIKE[tag], SCOPE)
            if tag == "body":
                pop_to({"head"}, ())
            top = stack[-1]
            classes, drop, doubt, kinds = "", top.drop or tag in NEVER, False, []
            if tag == "form" or tag == "header" and not top.within:
                kinds.append(("tag", "", tag))
            if m["attrs"].strip("/ \t\n\r\f"):
                for a in _ATTR.finditer(m["attrs"]):
                    name, value = a[1].lower(), a[2] or a[3] or a[4] or ""
                    if name == "class":
                        classes = ".".join(sorted(set(re.sub(r"\d+", "#", html.unescape(value)).split()))).replace("/", "%2f")
                    if name == "class" or name == "id" and tag not in _HEADINGS:
                        if tag not in ("html", "body", "article", "main") and UNWANTED.search(value):
                            kinds += [(name, k["where"], k["kind"].lower()) for k in map(SURELY.fullmatch, value.split()) if k]
                            doubt = True
                    elif name == "role":
                        drop |= value.lower() in _ROLES
                        if value.lower() in _SOFT_ROLES:
                            kinds.append((name, "", _SOFT_ROLES[value.lower()]))
                    elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN.search(value):
                        drop = True
            stack.append(_Element(tag, _path(top.path, tag + ("." + classes if classes else "")), top, drop, top.link or tag == "a", doubt, kinds))
            elements.append(stack[-1])
        if edge and not stack[-1].drop:
            out.append((stack[-1], "\n"))
    if at < len(page) and not stack[-1].drop:
        out.append((stack[-1], html.unescape(page[at:])))
    _judge(elements, out)
    return [x for x in out if not x[0].drop]


def _judge(elements: list[_Element], parts: list[tuple[_Element, str]]) -> None:
    """Drop the elements whose names say so, unless what they hold says otherwise."""
    for element, text in parts:
        n = len(text.strip())
        element.chars += n
        element.links += n * element.link
    for e in reversed(elements[1:]):  # an element comes after what holds it
        up = e.parent
        up.chars, up.links, up.head, up.menus = up.chars + e.chars, up.links + e.links, up.head + e.head, up.menus + e.menus + (e.tag in ("nav", "menu"))
    page = elements[0]
    outside = sum(e.tag == "h1" and not e.drop and not e.named for e in elements)
    for e in elements[1:]:
        e.drop |= e.parent.drop
        stays = bool(e.kinds) and not e.drop and _stays(e, page, outside)
        e.drop |= bool(e.kinds) and not stays
        e.link |= e.parent.link or e.doubt and not stays


def _stays(e: _Element, page: _Element, outside: int) -> bool:
    if not all(kind in GENERIC for _, _, kind in e.kinds) or 2 * e.links > e.chars:
        return False
    if 2 * e.chars > page.chars:
        return True
    if e.tag in BLOCK and (e.within or e.chars >= PROSE):
        return True
    if e.within and all(by == "id" for by, _, _ in e.kinds):
        return True
    sited = any(where for _, where, _ in e.kinds) or e.parent.tag in ("", "html", "body") and not e.within
    return e.head > 0 and not e.menus and (e.within or not outside and not sited)




def scores(parts: list[tuple[_Element, str]]) -> dict[str, int]:
    """Score by path: a container has the characters outside links of its blocks, less those inside, and half of its children's."""
    found: Counter = Counter()
    for element, text in parts:
        n = len(text.strip())
        if n:
            box = element.up
            n = -n if element.link else n
            found[box.path] += 2 * n
            if box.parent is not None:
                found[box.parent.up.path] += n
    return found


def best(found: dict[str, int]) -> str:
    return min(found, key=lambda p: (-found[p], p), default="")


def own(parts: list[tuple[_Element, str]]) -> dict[str, tuple[int, int, int, int]]:
    """By path of a container: characters outside links and within links of its own blocks, those outside both, and a hash of the text outside links."""
    texts: dict[str, list[str]] = {}
    links: Counter = Counter()
    loose: Counter = Counter()
    for element, text in parts:
        if text := text.strip():
            held = texts.setdefault(element.up.path, [])
            if element.link:
                links[element.up.path] += len(text)
            else:
                held.append(text)
                if not element.block:
                    loose[element.up.path] += len(text)
    return {p: (sum(map(len, t)), links[p], loose[p], _hash("\n".join(t))) for p, t in texts.items()}


def above(parts: list[tuple[_Element, str]]) -> dict[str, tuple[str, bool]]:
    """By path of a container and of all around it: the path above, and whether it lies in an article or main element."""
    found: dict[str, tuple[str, bool]] = {}
    for element, _ in parts:
        e = element.up
        while e is not None and e.path not in found:
            found[e.path] = (e.parent.path if e.parent is not None else "", e.within)
            e = e.parent
    return found


def chain(e: _Element, hashes: dict[str, int]) -> list[int]:
    """Hashes of the paths from the root to an element (to its anchor, if it lies deeper than DEEPEST)."""
    found, e = [], e.anchor
    while e is not None:
        if e.path not in hashes:
            hashes[e.path] = _hash(e.path)
        found.append(hashes[e.path])
        e = e.parent
    return found[::-1]


def add_chains(found: dict, where: str, parts: list[tuple[_Element, str]], hashes: dict[str, int]) -> None:
    """By host and path of a container and of all around it: its chain, and whether it lies in an article or main element."""
    for element, _ in parts:
        e = element.up
        while e is not None and (where, e.path) not in found:  # what lies above a known path is known
            found[where, e.path] = (chain(e, hashes), e.within)
            e = e.parent


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def climb(found: dict[str, tuple[int, int]], up: dict[str, tuple[str, bool]], winner: str) -> str:
    """The highest ancestor of ``winner`` up to which the text that each step adds is mostly neither links nor repeated.

    ``found``: by path, characters of the pages' own text and of links and repeated text. ``up``: by path, the path above and whether it is
    within article or main. Not ``several``: within those only.
    """
    line, at = {winner: 0}, winner
    while at:
        at = up[at][0]
        line[at] = len(line)
    steps = [[0, 0] for _ in line]  # what each ancestor adds to the one below it
    reach: dict[str, int] = dict(line)
    for p, (f, o) in found.items():
        chain = []
        while p not in reach:
            chain.append(p)
            p = up[p][0]
        for c in chain:
            reach[c] = reach[p]
        steps[reach[p]][0] += f
        steps[reach[p]][1] += o
    highest = winner
    for p, k in line.items():
        if not k:
            continue
        fresh, other = steps[k]
        if fresh > other:
            highest = p
        elif other:
            break
    return highest


def text_at(parts: list[tuple[_Element, str]], path: str) -> str | None:
    """The text of the elements at a path, white space as single spaces; None if the page has no such element."""
    under: dict[int, bool] = {}

    def inside(e):
        chain = []
        while e is not None and id(e) not in under and e.path != path:
            chain.append(e)
            e = e.parent
        known = e is not None and under.get(id(e), True)
        for c in chain:
            under[id(c)] = known
        return known

    hits = [text for element, text in parts if inside(element)]
    return " ".join("".join(hits).split()) if hits else None


def host(url: Column) -> Column:
    """Scheme, user and port off, lower case; empty without a host."""
    return F.lower(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:@\s]*)", 1))


def _votes(batches):
    import pandas as pd

    for pdf in batches:
        summed: Counter = Counter()
        texts: dict = {}
        lines: dict = {}
        hashes: dict[str, int] = {}
        for where, page in zip(pdf["x__host"], pdf["html"], strict=True):
            if where and page:
                parts, whole = read(page), _hash(page)
                for path, n in scores(parts).items():
                    summed[where, path] += n
                for path, (chars, links, loose, key) in own(parts).items():
                    c, n, x, low, high = texts.get((where, path, key), (0, 0, 0, whole, whole))
                    texts[where, path, key] = c + chars, n + links, x + loose, min(low, whole), max(high, whole)
                add_chains(lines, where, parts, hashes)
        rows = [(h, p, *lines[h, p], None, n, 0, 0, 0, None, None) for (h, p), n in summed.items()]
        rows += [(h, p, *lines[h, p], key, 0, *x) for (h, p, key), x in texts.items()]
        rows += [(h, p, *line, None, 0, 0, 0, 0, None, None) for (h, p), line in lines.items() if (h, p) not in summed]
        columns = ["host", "path", "chain", "within", "key", "score", "chars", "links", "loose", "low", "high"]
        yield pd.DataFrame(rows, columns=columns).astype({c: "Int64" for c in columns[4:]})


def consensus(pages: DataFrame) -> DataFrame:
    """(host, path): the ancestor climbed to from the path with the highest summed score on each host; of equals, the first in order.

    As ``climb`` does it for a page. The sums of all paths go to the winner's ancestors first, so of a host no more than DEEPEST rows meet.
    """
    small_batches(pages.sparkSession)
    added = "host string, path string, chain array<long>, within boolean, key long, score long, chars long, links long, loose long, low long, high long"
    votes = pages.select(host(F.col("url")).alias("x__host"), "html").mapInPandas(_votes, added)
    at = ["host", "path", "chain", "within"]  # the same path has the same ones above it
    sums = [F.sum(c).alias(c) for c in ("score", "chars", "links", "loose")]
    summed = votes.groupBy(*at, "key").agg(*sums, F.min("low").alias("low"), F.max("high").alias("high"))
    # a text on unlike pages is repeated; what is not is the pages' own
    repeated = F.when(F.col("low") != F.col("high"), F.col("chars")).otherwise(0)
    paths = staged(summed.groupBy(*at).agg(
        F.sum("score").alias("score"), F.sum(F.col("chars") - repeated).alias("fresh"), F.sum(F.col("links") + repeated).alias("other"), F.sum("loose").alias("loose"),
        F.min("low").alias("low"), F.max("high").alias("high")))
    first = F.min(F.when(F.col("score") > 0, F.struct(-F.col("score"), "path", "chain")))
    # with one page nothing can be repeated, and text outside blocks and articles counts as such
    hosts = cut(paths.groupBy("host").agg(first.alias("first"), (F.min("low") != F.max("high")).alias("several")).where("first IS NOT NULL"))
    hosts = hosts.select("host", F.col("first.path").alias("winner"), F.col("first.chain").alias("line"), "several")
    joined = paths.join(bounded_broadcast(hosts, hosts.count(), MOST_HOSTS), "host")
    shared = F.size(F.array_intersect("chain", "line"))  # how far down the winner's line a path lies
    loose = F.when(F.col("several") | F.col("within"), 0).otherwise(F.col("loose"))
    steps = joined.select("host", shared.alias("k"), (F.col("fresh") - loose).alias("fresh"), (F.col("other") + loose).alias("other"), F.size("line").alias("n")).where("k < n")
    steps = steps.groupBy("host", "k").agg(F.sum("fresh").alias("fresh"), F.sum("other").alias("other"))
    steps = steps.groupBy("host").agg(F.reverse(F.array_sort(F.collect_list(F.struct("k", "fresh", "other")))).alias("steps"))
    start = F.struct(F.lit(0).alias("top"), F.lit(False).alias("ended"))

    def up(state, x):
        goes = ~state["ended"] & (x["fresh"] > x["other"])
        return F.struct(F.when(goes, x["k"]).otherwise(state["top"]).alias("top"), (state["ended"] | (~goes & (x["other"] > 0))).alias("ended"))

    top = F.coalesce(F.aggregate("steps", start, up)["top"], F.lit(0))
    found = hosts.join(steps, "host", "left").select("host", "winner", F.when(top > 0, F.element_at("line", top)).alias("id"))
    named = paths.select("host", F.element_at("chain", -1).alias("id"), "path", F.size("chain").alias("n"))
    named = named.groupBy("host", "id").agg(F.min(F.struct(F.length("path"), "path")).alias("named"))  # what lies deeper than DEEPEST has longer paths
    return found.join(named, ["host", "id"], "left").select("host", F.coalesce("named.path", "winner").alias("path"))


def _extract(batch):
    texts, used = [], []
    for page, path in zip(batch.column("html").to_pylist(), batch.column("x__path").to_pylist(), strict=True):
        parts = read(page or "")
        text = text_at(parts, path) if path is not None else None
        if not text:
            up = above(parts)
            found = {p: (f, o) if up[p][1] else (f - x, o + x) for p, (f, o, x, _) in own(parts).items()}
            path = climb(found, up, best(scores(parts))) if found else ""
            text = text_at(parts, path)
        texts.append(text or "")
        used.append(path)
    return [texts, list(map(len, texts)), used]


def extract(pages: DataFrame, *keep: str) -> DataFrame:
    """``keep``, text, n_chars and the path that gave the text."""
    paths = cut(consensus(pages.select("url", "html"))).select(F.col("host").alias("x__host"), F.col("path").alias("x__path"))
    pages = pages.select(*dict.fromkeys([*keep, "url", "html"]))
    joined = pages.withColumn("x__host", host(F.col("url"))).join(bounded_broadcast(paths, paths.count(), MOST_HOSTS), "x__host", "left")
    return map_rows(joined.select(*keep, "html", "x__path"), _extract, "text string, n_chars long, path string", list(keep))


def op4(pages: DataFrame) -> DataFrame:
    return extract(pages, "page_id", "url")
