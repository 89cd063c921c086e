"""HTML extraction by consensus host paths: score containers, vote per host, extract again by the winning path."""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

NAME = re.compile(r"[a-zA-Z][\w:-]*")
MARK = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea svg math iframe object canvas select xmp title".split())
#: Those whose content is no markup at all: without an end tag they take the rest of the page, as in a browser.
OPAQUE = frozenset("script style textarea iframe xmp title".split())
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
#: Elements whose text is never main text.
CHROME = frozenset("head nav header footer aside form button dialog menu script style noscript template textarea svg math iframe object canvas select option label input fieldset".split()) | {"xmp", "title"}
BLOCK = frozenset("address article blockquote body center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINER = frozenset("article main section div td body".split())
CLOSES_P = BLOCK
NOISE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|notices?|alerts?|popup|modal|newsletter|subscribe|sidebar|side|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|toolbar|pagination|pager|share|sharing|social|related|recommend\w*|comments?|comment-\w+|disqus|replies|respond|responses|discussion|reactions|talkback|login|signup|search|widget|meta-?nav|skip|legal|copyright)(?:$|[\s_-])", re.I)
#: Of these, what readers wrote: never taken for the article, whatever else a page lacks.
READERS = re.compile(r"(?:^|[\s_-])(?:comments?|comment-\w+|disqus|replies|respond|responses|discussion|reactions|talkback)(?:$|[\s_-])", re.I)
NOISY_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
LINK_WEIGHT = 2.0
#: Winners (one row a host) are broadcast up to this many rows and bytes of path; beyond, pages meet theirs in a join.
MAX_HOSTS, MAX_PATH_BYTES = 200_000, 32 << 20


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(raw)} if raw else {}


#: What stands above a block: nothing but text, chrome, or (from SOFT on) a container with a noise word, by number.
CLEAN, HARD, SOFT = 0, 1, 2


def is_chrome(tag: str, attrs: dict[str, str]) -> bool:
    """Whether an element is chrome by its tag or its role, or hidden."""
    if tag in CHROME:
        return True
    if not attrs or tag in ("html", "body", "article", "main"):
        return False
    hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attrs.get("style", ""))
    return bool(hidden or attrs.get("role", "").lower() in NOISY_ROLES)


def noise_name(tag: str, attrs: dict[str, str]) -> str:
    """The class and id of an element if a word of them is noise, else nothing."""
    if not attrs or tag in ("html", "body", "article", "main"):
        return ""
    named = " ".join(attrs.get(k, "") for k in ("class", "id")).strip()
    return named if named and NOISE.search(named) else ""


def is_prose(text: str, weight: float) -> bool:
    """Mostly no links, and long or ending as a sentence does."""
    return 2 * weight >= len(text) and (len(text) >= 80 or (len(text) >= 25 and text[-1] in ".!?…"))


def settle_noise(found: list[tuple[int, str, float, int]], readers: set[int]) -> list[tuple[int, str, float, bool]]:
    """found with noise decided: a container with a noise word is noise, unless the page has no clean prose without it and
    it holds most of what such containers hold; what readers wrote stays noise."""
    weights: dict[int, float] = defaultdict(float)
    for _, _, weight, above in found:
        weights[above] += weight
    kept = CLEAN
    if not any(above == CLEAN and is_prose(text, weight) for _, text, weight, above in found):
        mass = [(w, -k) for k, w in weights.items() if k >= SOFT and k not in readers and w > weights.get(CLEAN, 0.0)]
        kept = -max(mass)[1] if mass else CLEAN
    return [(path, text, weight, above not in (CLEAN, kept)) for path, text, weight, above in found]


def generalise(tag: str, attrs: dict[str, str]) -> str:
    """tag.class with digits generalised, so that post-17 and post-18 vote together."""
    first = (attrs.get("class") or "").split()
    return tag + ("." + re.sub(r"\d+", "#", first[0].lower()) if first else "")


class Tags:
    """The tags of a page, one after another, in time that grows with the page: what is known to be missing ahead (a
    closing quote, a comment's end, any further tag end) is not looked for again."""

    def __init__(self, page: str):
        self.page, self.missing = page, {}
        self.dead: set[int] = set()  # quotes from which no tag end outside quotes follows

    def ahead(self, what: str, at: int) -> int:
        """Where what next begins, -1 if nowhere."""
        if at >= self.missing.get(what, len(self.page) + 1):
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.missing[what] = min(at, self.missing.get(what, at))
        return found

    def tag_end(self, at: int) -> int:
        """The first > from at on that no quotes enclose; where there is none, the first > at all; -1 without any."""
        first, here, met = self.ahead(">", at), at, []
        while first >= 0:
            m = MARK.search(self.page, here)
            if not m or m.start() in self.dead:
                break
            if m[0] == ">":
                return m.start()
            met.append(m.start())
            close = self.ahead(m[0], m.end())
            if close < 0:
                break
            here = close + 1
        self.dead.update(met)
        return first

    def next(self, at: int):
        """(start, end, closing, name, attributes) of the next markup from at on; name '' for comments and the like; None
        where only text is left."""
        page = self.page
        while True:
            start = self.ahead("<", at)
            if start < 0:
                return None
            if page.startswith("<!--", start):
                end = self.ahead("-->", start + 4)
                return start, len(page) if end < 0 else end + 3, False, "", ""
            if page.startswith("<![CDATA[", start):
                end = self.ahead("]]>", start + 9)
                return start, len(page) if end < 0 else end + 3, False, "", ""
            if page[start + 1 : start + 2] in ("!", "?"):
                end = self.ahead(">", start)
                if end >= 0:
                    return start, end + 1, False, "", ""
            closing = page.startswith("/", start + 1)
            name = NAME.match(page, start + 1 + closing)
            if name:
                end = self.tag_end(name.end())
                if end >= 0:
                    return start, end + 1, closing, name[0].lower(), page[name.end() : end]
            at = start + 1


class Blocks:
    """The text blocks of a page in order, and its container paths as a tree: path i ends in steps[i] under parents[i]."""

    def __init__(self):
        self.parents, self.steps, self.known = [-1], ["page"], {}
        self.found: list[tuple[int, str, float, int]] = []  # path, text, weight without links, noise

    def path(self, parent: int, step: str) -> int:
        if (parent, step) not in self.known:
            self.known[parent, step] = len(self.steps)
            self.parents.append(parent)
            self.steps.append(step)
        return self.known[parent, step]

    def name(self, i: int) -> str:
        out = []
        while i >= 0:
            out.append(self.steps[i])
            i = self.parents[i]
        return "/".join(reversed(out))

    def find(self, name: str) -> int | None:
        """The path of that name, if the page has it."""
        first, *rest = name.split("/")
        at: int | None = 0 if first == self.steps[0] else None
        for step in rest:
            at = self.known.get((at, step)) if at is not None else None
        return at

    def inside(self, top: int) -> list[bool]:
        """For each path whether it is top or below it; a path comes after its parent."""
        out = [False] * len(self.steps)
        for i in range(top, len(self.steps)):
            out[i] = i == top or (self.parents[i] >= 0 and out[self.parents[i]])
        return out


def blocks(page: str) -> Blocks:
    """The text blocks of a page.

    One forgiving pass over the tags: unclosed elements end with their parent, stray end tags are ignored, raw-text
    elements are skipped whole, straight to their own end tag, character references are decoded outside them, blanks
    collapse and blocks are trimmed. Time and memory grow with the page, however deep it is nested.
    """
    out, tags = Blocks(), Tags(page)
    stack: list[tuple[str, int, int]] = []  # tag, container path, what stands above
    readers: set[int] = set()
    soft = SOFT
    where: dict[str, list[int]] = defaultdict(list)  # places of each open tag in the stack
    firm: list[int] = []  # places of blocks and chrome
    walls: list[int] = []  # places of containers
    buffer: list[str] = []
    linked, in_link, at = 0, 0, 0
    endless: set[str] = set()  # raw elements that no end tag follows any more

    def flush():
        nonlocal linked
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                out.found.append((stack[-1][1] if stack else 0, text, max(0.0, len(text) - LINK_WEIGHT * linked), stack[-1][2] if stack else CLEAN))
            buffer.clear()
        linked = 0

    def cut_to(i: int):
        nonlocal in_link
        while len(stack) > i:
            tag = stack.pop()[0]
            where[tag].pop()
            in_link -= tag == "a"
        for places in (firm, walls):
            while places and places[-1] >= i:
                places.pop()

    def last(*names: str) -> int:
        return max((where[n][-1] for n in names if where[n]), default=-1)

    while (m := tags.next(at)) is not None:
        start, end, closing, tag, raw = m
        if start > at:
            piece = entities.unescape(page[at:start])
            buffer.append(piece)
            if in_link > 0:
                linked += len(piece.strip())
        at = end
        if not tag:
            continue
        solid = tag in BLOCK or tag in CHROME
        if closing:
            i = last(tag)
            if i >= 0 and solid:
                flush()
                cut_to(i)
            elif i >= 0 and (not firm or firm[-1] < i):
                cut_to(i)
            continue
        if tag == "br":
            buffer.append(" ")
            continue
        if tag in RAW:
            if not raw.rstrip().endswith("/"):
                stop = None if tag in endless else RAW_END[tag].search(page, at)
                close = tags.ahead(">", stop.end()) if stop else -1
                if close >= 0:
                    at = close + 1
                else:
                    endless.add(tag)
                    at = len(page) if tag in OPAQUE else at
            continue
        if solid:
            flush()
            if tag in CLOSES_P and (p := last("p")) >= 0 and (not walls or walls[-1] < p):
                cut_to(p)
            if tag == "li" and (i := last("li")) > last("ul", "ol"):
                cut_to(i)
        if tag in VOID:
            continue
        attrs = _attributes(raw)
        above = stack[-1] if stack else ("", 0, CLEAN)
        path = out.path(above[1], generalise(tag, attrs)) if tag in CONTAINER or tag == "html" else above[1]
        where[tag].append(len(stack))
        if solid:
            firm.append(len(stack))
        if tag in CONTAINER:
            walls.append(len(stack))
        state, named = above[2], noise_name(tag, attrs)
        if is_chrome(tag, attrs) or (named and state != CLEAN):  # noise within noise is never article
            state = HARD
        elif named:
            state, soft = soft, soft + 1
            if READERS.search(named):
                readers.add(state)
        stack.append((tag, path, state))
        in_link += tag == "a"
    if at < len(page):
        tail = page.rfind(">", at)
        cut = re.compile("<[a-zA-Z/!]").search(page, max(at, tail + 1))  # a tag that the page's end cuts off
        buffer.append(entities.unescape(page[at : cut.start()] if cut else page[at:]))
    flush()
    out.found = settle_noise(out.found, readers)
    return out


def score_paths(page: Blocks) -> dict[int, float]:
    """Score of each container path of a page: text without links of the clean blocks right in it, and a share of what
    lies deeper; the semantic containers count more."""
    score: dict[int, float] = defaultdict(float)
    for path, _, weight, noise in page.found:
        share = 1.0
        while not noise and path >= 0 and share > 0.1:
            score[path] += weight * share
            path, share = page.parents[path], share / 2
    return {p: s * (3.0 if page.steps[p].split(".")[0] in ("article", "main") else 1.0) for p, s in score.items()}


def best_path(page: Blocks, own: dict[int, float]) -> int | None:
    """The container path of the greatest score, widened to each ancestor that also holds clean text beside it.

    An article or main stays as it is. Up to the body any text that is not all links counts; to the body or above it
    climbs only for prose: blocks, mostly not links, that are long or end as a sentence does.
    """
    if not own:
        return None
    most = max(own.values())
    best = min((p for p, s in own.items() if s == most), key=lambda p: (-p,))
    if page.steps[best].split(".")[0] in ("article", "main"):
        return best
    chain, at = {}, best
    while at >= 0:
        chain[at] = len(chain)
        at = page.parents[at]
    # for each path the nearest of best and its ancestors that it lies in, and what clean text each of those holds beside
    joins = [0] * len(page.steps)
    for i in range(len(page.steps)):
        joins[i] = i if i in chain else joins[page.parents[i]]
    any_text, prose = set(), set()
    for path, text, weight, noise in page.found:
        if not noise and weight > 0:
            any_text.add(joins[path])
            if is_prose(text, weight):
                prose.add(joins[path])
    up, passed = page.parents[best], False
    while up >= 0:
        outer = page.steps[up].split(".")[0] in ("page", "html", "body")
        passed = passed or (up in prose if outer else False)
        if passed or (not outer and up in any_text):
            best, passed = up, False
        up = page.parents[up]
    return best


def extract(page: Blocks, name: str | None) -> str:
    """Clean blocks under the path of that name, joined by a blank line; if the page has none there, those under its own
    best path."""
    own = score_paths(page)
    top = page.find(name) if name is not None else None
    within = page.inside(top) if top is not None else []
    if top is None or not any(within[p] for p in own):
        top = best_path(page, own)
        within = page.inside(top) if top is not None else []
    return "\n\n".join(t for p, t, _, noise in page.found if not noise and top is not None and within[p])


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, host, path) for each row: the main text by its host's consensus path.

    Every page votes, with 1 + score^0.1 in thousandths, for its own best container path; a host's path is that of the
    greatest sum (the smaller path on ties). Pages on which the winning path is missing keep their own best path. Null
    html is empty text, null url is a host of its own, repeated rows vote and are extracted like any other, very long and
    deeply nested pages take time in proportion, an empty table gives none.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("u"), F.col(html_col).alias("h"), host_of(F.col(url_col)).alias("host"))
    id_kind, url_kind = rows.schema["id"].dataType.simpleString(), rows.schema["u"].dataType.simpleString()

    def vote(batches):
        for b in batches:
            total: dict[tuple[str, str], int] = defaultdict(int)
            for host, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                page = blocks(html or "")
                own = score_paths(page)
                best = best_path(page, own)
                if best is not None:
                    total[host, page.name(best)] += int(1000 * (1 + max(own.values()) ** 0.1))
            keys = list(total)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([total[k] for k in keys], pa.int64())], ["host", "path", "votes"])

    votes = rows.select("host", "h").mapInArrow(vote, "host string, path string, votes long").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    # the greatest sum by a plain aggregate: partial before its shuffle, so a host with many paths is no hot group
    best = F.min_by("path", F.struct((-F.col("votes")).alias("v"), "path"))
    winners = settle(votes.groupBy("host").agg(best.alias("winner")), "winners")
    hosts, size = winners.agg(F.count("*"), F.sum(F.octet_length("winner") + F.octet_length("host"))).first()
    small = hosts <= MAX_HOSTS and (size or 0) <= MAX_PATH_BYTES
    joined = rows.join(F.broadcast(winners) if small else winners, "host", "left").select("id", "u", "h", "host", "winner")

    def again(batches):
        for b in batches:
            texts = [extract(blocks(html or ""), path) for html, path in zip(b.column(2).to_pylist(), b.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), b.column(3), b.column(4)], [id_col, url_col, "text", "host", "path"])

    return joined.mapInArrow(again, f"`{id_col}` {id_kind}, `{url_col}` {url_kind}, text string, host string, path string")
