"""Main text of web pages by equivalence-class template deduction.

Each page is read into tokens: block elements and text blocks, told apart by the path of block elements above them. Tokens
of a host whose occurrence vectors over its pages are equal form an equivalence class; the vector is held as an exclusive-or
of hashes of (page, count), so that a class is found by a grouped aggregate and no host meets in one task. (An element's end
has the vector of its beginning and is not held beside it.) Classes that are large and frequent enough, hold an element,
keep their order on the page and nest without crossing make up the host's template.

What the template leaves open are its slots: the text inside a template element that is no template text itself. Over all
pages of the host the slots' characters are counted, those in links, in headings and in what names call no article apart. From
the top of the template down, the element that holds nearly all of the running text of the one above is followed, unless an
article element lies beside it; where no element does, the article is found, and slots above are added while they hold
headings only. Left out of it is what names and kinds call a menu, an advert, a form, a comment and so on. Inside an article or
body element all else is its text, a list of links and a heading that every page of the host has too; where no such element
tells, lists of links and template text are left out.

A host of few pages has no template: there names and element kinds choose (`by_roles`), as they do for a page that lacks
its host's article. A page whose article is template text for the most part, as of a repeated page, keeps that text.

A null or empty page gives an empty text. A null url is a host of its own. Repeated pages are returned as often as they
stand. Only the three columns named are read and returned, so that no further column can clash.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .pytext import tidied

# Element names and the words of class, id and role that say what an element is for.
BLOCK_TAGS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav object ol optgroup option p pre section select summary svg table tbody td tfoot th thead tr ul video audio canvas".split())
RAW_TAGS = frozenset("script style noscript template textarea title xmp noframes".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILER_TAGS = frozenset("head nav header footer aside form button select menu dialog iframe svg object video audio canvas fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements that hold running text: names do not make them an advert, and they are no article by themselves.
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 hgroup blockquote pre dd dt li td th tr tbody thead tfoot figure figcaption caption summary address".split())
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promoted promotion outbrain taboola "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs crumbs pagination pager toc skip skiplink toolbar tabs "
    "header masthead topbar head footer foot bottombar copyright legal disclaimer sidebar aside rail widget widgets "
    "notice notices cookie cookies consent gdpr alert popup modal overlay paywall subscribe subscription newsletter signup login signin "
    "comment comments commentlist respond replies reply disqus discussion feedback reviews "
    "share sharing social follow related recommended recommendations more teaser teasers trending popular search form contentinfo complementary".split())
BODY_WORDS = frozenset("article articlebody post entry story content main maincontent body text prose".split())
#: Of these, the words that inside an article may as well name a part of it.
AMBIGUOUS = frozenset("more social discussion reviews feedback legal disclaimer popular tabs header head".split())
#: Those that also say it of a paragraph or a list's item.
ADVERT_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promoted promotion outbrain taboola".split())
# First words of a name that says what an element has, not what it is.
HAVING = frozenset("with has no without not".split())

QUOTED = re.compile(r"(?:[^\"'>]+|\"[^\"]*\"|'[^']*')*+>")
TAG_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|itemprop|style|hidden|aria-hidden)(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW_TAGS}
NOT_WORD = re.compile(r"[^a-z]+")
#: What of a name differs from page to page: numbers of three digits or more.
NUMBERED = re.compile(r"\d{3,}")

#: Least pages of a host, share of them and tokens of a class, for the class to be part of the template.
LEAST_PAGES, LEAST_SHARE, LEAST_TOKENS = 3, 0.8, 3
#: Share of the running text above it that an element must hold to be followed; share of links that makes a list of links.
DOMINANT, LINKED = 0.8, 0.5
#: A style by which an element is not shown.
UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b")
#: Share of template text beyond which an article keeps it, as its page is a copy.
FIXED = 0.8
#: Template tokens of all hosts up to which they go to the workers at once; beyond it pages are dealt out to their hosts' templates.
SENT_TOKENS, PAGES_A_TASK = 100_000, 5000


def says_boiler(name: str, inside: int = 0, of: frozenset[str] = BOILER_WORDS) -> bool:
    """Whether a class, id or role names something that is not the article. The header of an article is part of it, as may be what ambiguous words name inside one."""
    words = [w for w in NOT_WORD.split(name) if w]
    if not words or words[0] in HAVING:
        return False
    found = of.intersection(words)
    return bool(found) and not (found <= {"header", "head"} and BODY_WORDS.intersection(words)) and not (inside and found <= AMBIGUOUS)


class Element:
    """tag, above, path (a hash of the tags and names from the top); other: itself no part of an article; boiler: that or inside of such; article, body: the number of the outermost one around it, else 0; heading: is or is in one."""

    __slots__ = ("tag", "above", "path", "other", "boiler", "article", "body", "heading")

    def __init__(self, tag: str, attributes: str, above: Element | None, number: int):
        names, exact, hidden, boiler = [], [], False, False
        inside = above.article if above else 0
        words = ADVERT_WORDS if tag in TEXT_TAGS else BOILER_WORDS
        if attributes:
            for m in ATTRIBUTE.finditer(attributes):
                kind, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
                if kind in ("hidden", "aria-hidden"):
                    hidden |= kind == "hidden" or value == "true"
                elif kind == "style":
                    hidden |= bool(UNSEEN.search(value))
                else:
                    names += [w for w in NOT_WORD.split(value) if w]
                    exact.append(NUMBERED.sub("", value))
                    boiler = boiler or any(says_boiler(x, inside, words) for x in value.split())
        said = set(names)
        self.tag, self.above = tag, above
        self.path = xxhash.xxh64_intdigest(f"{tag}.{'.'.join(exact)}", above.path if above else 0)
        marked = tag in BOILER_TAGS and not (tag == "header" and inside) or hidden
        named = boiler and tag not in ("html", "body", "main") and not (tag == "article" and not said & {"comment", "comments", "ad", "promo", "teaser", "related", "sponsored"})
        self.other = marked or named
        self.boiler = bool(above and above.boiler) or self.other
        self.heading = tag in HEADINGS or bool(above and above.heading)
        self.article = number if tag == "article" and not self.boiler and not inside else inside
        own = not self.boiler and tag not in TEXT_TAGS and (tag == "main" or tag not in ("html", "body", "head") and bool(said & BODY_WORDS))
        self.body = above.body if above and above.body else number if own else 0


def tags(page: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, name, attributes) of each tag, comment or declaration ("" as name), in one pass over the page.

    A tag ends at the first > outside quotes; once quotes do not close, they are not heeded on the rest of the page. Without
    any further > the rest is an unclosed tag.
    """
    at, size, quotes, last = 0, len(page), True, page.rfind(">")
    while True:
        start = page.find("<", at)
        if start < 0:
            return
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else size
            yield start, at, "", ""
            continue
        m = TAG_NAME.match(page, start + 1)
        if not m and not page.startswith(("<!", "<?", "</"), start):
            at = start + 1  # a bare < is text
            continue
        if last < start:
            yield start, size, "", ""
            return
        if not m:
            at = page.find(">", start) + 1
            yield start, at, "", ""
            continue
        whole = QUOTED.match(page, m.end()) if quotes else None
        if not whole:
            quotes = False
        at = whole.end() if whole else page.find(">", m.end()) + 1
        name = m[0].lower()
        yield start, at, name, page[m.end() : at - 1]
        if name in RAW_TAGS and page[at - 2] != "/":
            end = RAW_END[name].search(page, at)
            skip = end.end() if end else size
            yield at, skip, "", ""
            at = skip


def tokens(page: str) -> list[tuple]:
    """The page as (kind, hash, text, element, linked): kind 0 a block element's beginning, kind 1 a text block, its white space made single, with the characters of it that stand in links."""
    root = Element("", "", None, 0)
    found, stack, opened, parts = [], [root], Counter(), []
    at, number, link, linked = 0, 0, False, 0

    def flush():
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                top = stack[-1]
                found.append((1, signed(xxhash.xxh64_intdigest(text, top.path ^ 1)), text, top, min(linked, len(text))))
            parts.clear()
        linked = 0

    for start, end, name, attributes in tags(page):
        if start > at:
            part = page[at:start]
            parts.append(html.unescape(part) if "&" in part else part)  # a reference ends with its text
            linked += (start - at) * link
        at = end
        closing = name.startswith("/")
        tag = name[1:] if closing else name
        if tag == "a":
            link = not closing
        elif tag == "br":
            parts.append(" ")
        if tag not in BLOCK_TAGS:
            continue
        flush()
        if closing:
            if opened[tag]:
                while True:
                    top = stack.pop().tag
                    opened[top] -= 1
                    if top == tag:
                        break
            continue
        top = stack[-1].tag
        if top == "p" or tag in ("li", "td", "th", "tr", "dd", "dt", "option") and top == tag:
            opened[stack.pop().tag] -= 1
        number += 1
        element = Element(tag, attributes, stack[-1], number)
        found.append((0, signed(element.path), "", element, 0))
        if tag not in VOID_TAGS and not attributes.endswith("/"):
            stack.append(element)
            opened[tag] += 1
    if at < len(page):
        parts.append(html.unescape(page[at:]))
        linked += (len(page) - at) * link
    flush()
    return found


def signed(h: int) -> int:
    return h - 2**64 if h >= 2**63 else h


def valid(sequence: list[int], classes: dict[int, tuple[int, int]]) -> set[int]:
    """Places of the tokens that belong to classes which keep their order on this page and do not cross a larger class."""
    spans: dict[int, list[int]] = {}
    for place, h in enumerate(sequence):
        if h in classes:
            spans.setdefault(classes[h][0], []).append(place)
    kept: list[tuple[int, int, list[int]]] = []
    whole: set[int] = set()
    for own in sorted(spans.values(), key=len, reverse=True):
        rank, ordered = -1, []
        for place in own:
            if classes[sequence[place]][1] > rank:
                rank = classes[sequence[place]][1]
                ordered.append(place)
        low, high = ordered[0], ordered[-1]
        if all(high < a or low > b or any(low > x and high < y for x, y in zip(own2, own2[1:], strict=False)) or low <= a and high >= b for a, b, own2 in kept):
            kept.append((low, high, ordered))
            seen = {sequence[place] for place in ordered}
            whole |= {place for place in own if sequence[place] in seen}  # the same token again, as an element that every page has twice
    return whole


def owners(found: list[tuple], fixed: set[int]) -> dict[int, int]:
    """For each element, by id(), the path of the template element that it is or is in; 0 at the top."""
    held = {0: 0}
    for place, t in enumerate(found):
        e = t[3]
        if t[0] == 0:
            held[id(e)] = e.path if place in fixed and e.tag not in TEXT_TAGS else held.get(id(e.above), 0)
    return held


def slots(found: list[tuple], fixed: set[int], roles: bool = True) -> dict[int, list]:
    """path of a template element: [path of the one above it, whether it is an article or main element, characters of its slots, those in links (but for what follows), in headings, in what names call no article, and of template text]. Elements above those with text are listed too."""
    held, out = owners(found, fixed), {}

    def entry(path: int, e: Element) -> list:
        if path not in out:
            while e.above is not None and e.path != path:
                e = e.above
            over = held.get(id(e.above), 0) if path else 0
            out[path] = [over, int(roles and e.tag in ("article", "main")), 0, 0, 0, 0, 0]
            if path:
                entry(over, e.above)
        return out[path]

    for place, t in enumerate(found):
        if t[0] == 1:
            own, n = entry(held.get(id(t[3]), 0), t[3]), len(t[2])
            if place in fixed:
                own[6] += n
            else:
                own[2] += n
                other = roles and t[3].boiler
                own[3] += t[4] * (not other)
                own[4] += n * t[3].heading
                own[5] += n * other
    return out


def choose(nodes: dict[int, list]) -> tuple[set[int], set[int]]:
    """(the paths that the article begins at, the paths inside that are lists of links), from `slots` summed over a host."""
    total, below = {p: list(x[2:6]) for p, x in nodes.items()}, {}
    for p, x in nodes.items():
        if p:
            below.setdefault(x[0], []).append(p)
    order, line = [], [0]
    while line:
        p = line.pop()
        order.append(p)
        line += below.get(p, [])
    for p in reversed(order):
        for c in below.get(p, []):
            total[p] = [a + b for a, b in zip(total[p], total[c], strict=True)]
    running = {p: x[0] - x[1] - x[3] for p, x in total.items()}
    chain = [0]
    while True:
        best = max(below.get(chain[-1], []), key=lambda c: (running[c], c), default=None)
        if best is None or not running[best] or running[best] < DOMINANT * running[chain[-1]]:
            break
        if any(nodes[c][1] and running[c] for c in below[chain[-1]] if c != best):
            break
        chain.append(best)
    lists = {p for p, x in total.items() if p and x[1] > LINKED * x[0] and p not in chain}
    at = top = len(chain) - 1
    while top > 1 and not nodes[chain[top]][1]:  # above an article element there is no more of it
        over = chain[top - 1]
        beside = [x for x in [total[c] for c in below[over] if c != chain[top] and c not in lists] + [nodes[over][2:6]] if 2 * x[3] <= x[0]]
        if any(chars > heads for chars, _, heads, _ in beside):
            break
        top -= 1
        if any(heads for _, _, heads, _ in beside):
            at = top
    return {chain[at]}, lists


def by_roles(found: list[tuple], kept: set[int]) -> list[str]:
    """Of the text blocks at the places kept: those of articles if these hold most of the text of marked regions, else those of all regions, with the running text beside them unless one is the main element, else all; never those of other elements."""
    texts = [t for place, t in enumerate(found) if t[0] == 1 and place in kept and not t[3].boiler]
    regions = [t for t in texts if t[3].article or t[3].body]
    if not regions:
        return [t[2] for t in texts]
    articles = [t for t in texts if t[3].article]
    if 2 * sum(len(t[2]) for t in articles) > sum(len(t[2]) for t in regions):
        return [t[2] for t in articles]
    around: set[int] = set()
    seen: set[int] = set()
    for t in regions:
        e = t[3]
        while e is not None and id(e) not in seen:
            seen.add(id(e))
            if e.tag == "main":
                return [x[2] for x in regions]
            if not (e.body or e.article):
                around.add(id(e))
            e = e.above

    def beside(e: Element) -> bool:
        while e.tag in TEXT_TAGS or e.tag in ("ul", "ol", "dl", "table"):
            e = e.above
        return id(e) in around

    return [t[2] for t in texts if t[3].article or t[3].body or beside(t[3])]


def main_text(page: str | None, template: dict[int, tuple[int, int]] | None, article: set[int] = frozenset(), lists: set[int] = frozenset(), roles: bool = True) -> str:
    """The text of the article. template: (class, rank) of each token hash; article, lists: what `choose` found. roles=False heeds no names and kinds of elements: what the template alone makes of a page."""
    if not page:
        return ""
    found = tokens(page)
    fixed = valid([t[1] for t in found], template) if template else set()
    if article:
        inside: dict[int, bool | None] = {}
        out, same, most = [], 0, 0
        for place, t in enumerate(found):
            e = t[3]
            if t[0] == 0:
                over = inside.get(id(e.above))
                if over is None:
                    inside[id(e)] = True if e.path in article else None
                else:
                    links = e.path in lists and not (roles and (e.article or e.body))
                    inside[id(e)] = over and not (links or roles and e.other and not (e.tag == "header" and not e.above.boiler))
            elif inside.get(id(e), 0 in article and e.above is None or None):
                own = place in fixed
                out.append((own and not (roles and (e.article or e.body)), t[2]))
                most += len(t[2])
                same += len(t[2]) * own
        if most:
            return "\n".join(x for is_fixed, x in out if not is_fixed or same > FIXED * most)
    if not roles:
        return "\n".join(t[2] for place, t in enumerate(found) if t[0] == 1 and place not in fixed)
    return "\n".join(by_roles(found, set(range(len(found))) - fixed) or by_roles(found, set(range(len(found)))))


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rid, host, token, times, place, tag = [], [], [], [], [], []
        for r, h, page in zip(*(batch.column(c).to_pylist() for c in ("rid", "host", "html")), strict=True):
            seen: dict[int, list] = {}
            for i, t in enumerate(tokens(page or "")):
                own = seen.setdefault(t[1], [0, i, t[0] == 0])
                own[0] += 1
            for x, (n, i, is_tag) in seen.items():
                rid.append(r), host.append(h), token.append(x), times.append(n), place.append(i), tag.append(is_tag)
        yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(host, pa.string()), pa.array(token, pa.int64()), pa.array(times, pa.int32()), pa.array(place, pa.int32()), pa.array(tag, pa.bool_())], names=["rid", "host", "token", "n", "place", "tag"])


def templates(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE, least_tokens: int = LEAST_TOKENS) -> DataFrame:
    """(host, template): the tokens of each host's large and frequent classes as (token, class, rank). pages: host, html."""
    given = pages.select(F.monotonically_increasing_id().alias("rid"), "host", "html")
    seen = given.mapInArrow(tidied(_occurrences), "rid long, host string, token long, n int, place int, tag boolean")
    vector = [F.bit_xor(F.xxhash64(F.lit(k), "rid", "n")).alias(f"vector{k}") for k in (1, 2)]
    each = seen.groupBy("host", "token").agg(F.count("*").alias("support"), F.avg("place").alias("place"), F.max("tag").alias("tag"), *vector)
    each = stored(each.where(F.col("support") >= least_pages * least_share), "tokens")
    counts = pages.groupBy("host").agg(F.count("*").alias("pages"))
    same = ["host", "vector1", "vector2"]
    large = each.groupBy(*same, "support").agg(F.count("*").alias("size"), F.max("tag").alias("anchored")).where((F.col("size") >= least_tokens) & F.col("anchored"))
    large = large.join(counts, "host").where((F.col("pages") >= least_pages) & (F.col("support") >= least_share * F.col("pages")))
    parts = each.join(large.select(*same), same).select("host", F.struct("place", "token", F.xxhash64("vector1", "vector2").alias("of")).alias("part"))
    ranked = parts.groupBy("host").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    return ranked.select("host", F.transform("parts", lambda x, i: F.struct(x["token"].alias("token"), x["of"].alias("of"), i.alias("rank"))).alias("template"))


class Known:
    """What is known of a host, made ready once: the template, and what `choose` found."""

    def __init__(self, row: dict | None):
        self.template = {x["token"]: (x["of"], x["rank"]) for x in row["template"]} if row else None
        self.article, self.lists = ({x % 2**64 for x in row.get(c) or []} for c in ("article", "lists")) if row else (set(), set())


def with_templates(pages: DataFrame, marked: DataFrame, each: Callable, columns: list[str], schema: str, sent: int = SENT_TOKENS, a_task: int = PAGES_A_TASK) -> DataFrame:
    """each(pairs of Known and the page's `columns`) -> batches, over all pages; marked: a row for each host that has a template.

    Few templates go to the workers as they are. Of many, a host's pages are dealt out in groups of about `a_task`, each
    behind a row with the host's template, so that it is sent once a group, and a large host is not one task.
    """
    spark = pages.sparkSession
    if (marked.agg(F.sum(F.size("template"))).first()[0] or 0) <= sent:
        shared = spark.sparkContext.broadcast(marked.toArrow())  # `sent` tokens at most

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = shared.value
            place, known = {h: i for i, h in enumerate(rows.column("host").to_pylist())}, {}

            def pairs():
                for batch in batches:
                    hosts = batch.column("host").to_pylist()
                    for i, values in enumerate(zip(*(batch.column(c) for c in columns), strict=True)):
                        at = place.get(hosts[i], -1)
                        if at not in known:
                            known[at] = Known(rows.slice(at, 1).to_pylist()[0] if at >= 0 else None)
                        yield known[at], [v.as_py() for v in values]

            yield from each(pairs())

        return pages.select(*dict.fromkeys(["host", *columns])).mapInArrow(tidied(whole), schema)

    groups = pages.groupBy("host").agg(F.count("*").alias("n")).join(marked, "host", "left").withColumn("n", F.ceil(F.col("n") / a_task).cast("int"))
    heads = groups.where("template is not null").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n").withColumn("kind", F.lit(0))
    sizes = groups.where("n > 1").select("host", "n")
    rows = pages.join(sizes, "host", "left").withColumn("part", F.pmod(F.xxhash64(F.lit(9), "html"), F.coalesce("n", F.lit(1))).cast("int")).select(*dict.fromkeys(["host", "part", *columns])).withColumn("kind", F.lit(1))
    dealt = heads.unionByName(rows, allowMissingColumns=True).repartition("host", "part").sortWithinPartitions("host", "part", "kind")

    def in_turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs():
            own, known = None, Known(None)
            for batch in batches:
                hosts, parts, kinds = (batch.column(c).to_pylist() for c in ("host", "part", "kind"))
                for i, key in enumerate(zip(hosts, parts, strict=True)):
                    if kinds[i] == 0:
                        own, known = key, Known(batch.slice(i, 1).to_pylist()[0])
                        continue
                    if key != own:
                        own, known = key, Known(None)
                    yield known, [batch.column(c)[i].as_py() for c in columns]

        yield from each(pairs())

    return dealt.mapInArrow(tidied(in_turn), schema)


COUNTS = ("chars", "linked", "heads", "named", "fixed")


def _slots(roles: bool) -> Callable:
    def out(sums: dict) -> pa.RecordBatch:
        names = [pa.array([h for h, _, _, _ in sums], pa.string()), *(pa.array([signed(key[k]) for key in sums], pa.int64()) for k in (1, 2, 3))]
        return pa.RecordBatch.from_arrays([*names, *(pa.array([x[k] for x in sums.values()], pa.int64()) for k in range(len(COUNTS)))], names=["host", "path", "above", "marked", *COUNTS])

    def each(pairs: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        """The slots of the pages, summed over a few thousand at a time."""
        sums: dict[tuple, list] = {}
        for known, (host, page) in pairs:
            if not known.template or not page:
                continue
            found = tokens(page)
            for path, (over, is_marked, *counts) in slots(found, valid([t[1] for t in found], known.template), roles).items():
                own = sums.setdefault((host, path, over, is_marked), [0] * len(COUNTS))
                for k, n in enumerate(counts):
                    own[k] += n
            if len(sums) >= 5000:
                yield out(sums)
                sums = {}
        yield out(sums)

    return each


def gathered(rows: list[dict]) -> dict[int, list]:
    """The nodes of a host by path. A path that stands under different template elements on different pages is under the one with most of its text."""
    out: dict[int, list] = {}
    for x in sorted(rows, key=lambda x: (-x["chars"], x["above"])):
        own = out.setdefault(x["path"] % 2**64, [x["above"] % 2**64, x["marked"], *[0] * len(COUNTS)])
        for k, c in enumerate(COUNTS):
            own[2 + k] += x[c]
    return out


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [choose(gathered(nodes)) for nodes in batch.column("nodes").to_pylist()]
        paths = [pa.array([[signed(p) for p in sorted(x[k])] for x in found], pa.list_(pa.int64())) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("template"), *paths], names=["host", "template", "article", "lists"])


def articles(pages: DataFrame, marked: DataFrame, roles: bool = True, **dealing) -> DataFrame:
    """(host, template, article, lists): `marked` with the element that holds each host's article and the lists of links in it."""
    columns = ["path", "above", "marked", *COUNTS]
    sums = with_templates(pages, marked, _slots(roles), ["host", "html"], ", ".join(["host string", *(f"{c} long" for c in columns)]), **dealing)
    each = sums.groupBy("host", "path", "above", "marked").agg(*[F.sum(c).alias(c) for c in COUNTS])
    nodes = each.groupBy("host").agg(F.collect_list(F.struct(*columns)).alias("nodes"))  # a node for each template element of the host
    kind = "array<struct<token: long, of: long, rank: int>>"
    return nodes.join(marked, "host").mapInArrow(tidied(_chosen), f"host string, template {kind}, article array<long>, lists array<long>")


def hosts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """The pages with their `host`; one without a url has the empty one."""
    return pages.withColumn("host", F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", deduce: bool = True, roles: bool = True, **dealing) -> DataFrame:
    """page_id, url and the main text of each page. deduce, roles: whether templates are deduced and whether names of elements count (both do)."""
    rows = hosts(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")))
    marked = stored(templates(rows) if deduce else templates(rows.limit(0)), "templates")
    marked = stored(articles(rows, marked, roles, **dealing), "articles")

    def extract(pairs: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for known, (page_id, url, page) in pairs:
            held.append((page_id, url, main_text(page, known.template, known.article, known.lists, roles)))
            if len(held) >= 500:
                yield out(held)
                held = []
        yield out(held)

    def out(held: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*held, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()), strict=True)], names=["page_id", "url", "text"])

    return with_templates(rows, marked, extract, ["page_id", "url", "html"], "page_id long, url string, text string", **dealing)
