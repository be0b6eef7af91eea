"""Main text of web pages by deducing the template of each host.

A page is read as tokens: opening and closing tags with the path of elements
above them, and texts with theirs. Over the pages of a host every token has an
occurrence vector (how often it occurs in each page). Tokens with equal vectors
form an equivalence class; classes in at least half of the host's pages (a text:
and in `TEXT_PAGES`) with two tokens or more are candidates for its template. A
class is valid in a page if its tokens occur there in turn, every one as often, in
one order. The tags of valid classes that occur once divide a page into slots; of
other valid classes every round must lie inside one slot. Texts of valid classes
are template text, and blocks of nothing else are dropped wherever they stand. That
is decided per host: where less than half a text per page is its own, the pages
are copies of each other, and their texts stay. Menus, headers, footers and the like are dropped, and all other blocks
remain: those inside <article> or <main> where there are any, and else those of
all slots.

Vectors are never gathered: a vector is known by its page count, its total and a
linear sketch (the sum over pages of count times a hash of the page), so the
pages of one host may be spread over all tasks, and partial sums are formed in
each. A host's template has at most twice the tokens of an average page.

Edge cases: a null or empty html gives an empty text. A host of
fewer than five pages has no template text. A page without a usable host is grouped under the empty host.
Repeated rows give equal rows, and an empty table none. Unclosed elements end with
their parents, an unclosed head with the first element or text that cannot be in
it, unclosed scripts with the page. From a quote on that is never closed, quotes
in tags count for nothing. Long pages and deep ones are read whole, in linear
time. Extra columns are ignored.
"""

import html as markup
import re
from bisect import bisect_left
from collections import Counter, deque
from functools import lru_cache
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

# Pages that a text has to be on to be template text: fewer do not tell a template from copies of a page.
TEXT_PAGES = 5

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title template noscript iframe svg math".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset(
    "nav header footer aside form script style textarea title template noscript iframe svg math button select head menu dialog label input".split()
)
ARTICLE = frozenset(("article", "main"))
DROPPED_NAME = re.compile(
    r"ads?|adverts?|advertisements?|banner|sponsor(ed)?|promo(tion)?|comments?|disqus|replies|respond|sidebar|sidenav|nav(bar|igation)?|menu|"
    r"breadcrumbs?|cookies?|consent|notice|notification|alert|popup|modal|newsletter|subscribe|share|sharing|social|related|recommended|"
    r"footer|header|masthead|copyright|login|search|toolbar|pagination|pager"
)
# Words that say no more than where or how a named part stands.
PLACES = frozenset(
    "area bar block bottom box button buttons container global inner items left link links list main outer primary right secondary side site slot "
    "top unit widget wrap wrapper".split()
)
DROPPED_ROLE = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())

HEAD = frozenset("base basefont bgsound head html link meta noscript script style template title".split())

_START = re.compile(r"<(?:!|\?|/?[a-zA-Z])")
_PART = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.S)
_PLAIN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>", re.S)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)


def host_of(url) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _parts(page: str):
    """The tags and comments of a page, as matches; a tag that never ends is text.

    A tag in which a quote is never closed costs one walk to the end of the page; from there on quotes are not looked at.
    """
    pattern, at, last = _PART, 0, page.rfind(">")
    while start := _START.search(page, at):
        part = pattern.match(page, start.start())
        if part is None and start.start() < last:
            pattern = _PLAIN
            part = pattern.match(page, start.start())
        if part is None:
            if start.start() > last:
                return
            at = start.end()
            continue
        skip = yield part
        at = part.end() if skip is None else skip


class _Open:
    """The open elements of a page: their names, a hash of the path to each, and what is asked about them."""

    def __init__(self):
        self.names, self.hashes, self.count, self.blocks, self.dropped = [], [0], Counter(), [], 0

    def push(self, name):
        self.names.append(name)
        self.hashes.append(self.below(name))
        self.count[name] += 1
        self.dropped += name in DROPPED
        if name in BLOCKS:
            self.blocks.append(name)

    def below(self, name) -> int:
        return hash((self.hashes[-1], _name_hash(name)))

    def pop(self):
        name = self.names.pop()
        self.hashes.pop()
        self.count[name] -= 1
        self.dropped -= name in DROPPED
        if name in BLOCKS:
            self.blocks.pop()
        return name


def read(page: str):
    """Yield (kind, name, path, names) for tags, kind `open` or `close`, and ("text", text, path, dropped).

    `path` is a number for the open elements, the tag's own included; `dropped` says whether
    a text is inside an element that is always dropped.
    """
    above = _Open()

    def close_to(name):
        while above.names:
            top, path = above.names[-1], above.hashes[-1]
            yield "close", top, path, None
            above.pop()
            if top == name:
                return

    def text_to(end):
        if end > at:
            text = page[at:end]
            if above.names and above.names[-1] == "head" and text.strip():
                yield from close_to("head")
            yield "text", text, above.hashes[-1], above.dropped > 0

    at, parts, skip = 0, _parts(page), None
    while True:
        try:
            part = parts.send(skip)
        except StopIteration:
            yield from text_to(len(page))
            return
        skip = None
        yield from text_to(part.start())
        at = part.end()
        if not part[2]:
            continue
        name = part[2].lower()
        if part[1]:
            if above.count[name]:
                yield from close_to(name)
            continue
        if above.count["head"] and name not in HEAD:
            yield from close_to("head")
        if above.names and (
                name in BLOCKS and above.names[-1] == "p" or name in ("li", "option", "dd", "dt", "tr", "td", "th") and above.names[-1] == name):
            yield from close_to(above.names[-1])
        elif name in BLOCKS and above.blocks and above.blocks[-1] == "p":
            yield from close_to("p")
        names = " ".join(f"{k.lower()}={a or b or c}" for k, a, b, c in _NAMES.findall(part[3])).lower()
        yield "open", name, above.below(name), names
        if name in VOID:
            continue
        above.push(name)
        if name in RAW:
            close = re.compile(f"</{name}", re.I).search(page, at)
            end = close.start() if close else len(page)
            yield from text_to(end)
            at = skip = end


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


@lru_cache(1 << 12)
def _name_hash(name: str) -> int:
    return _hash(name)


def token(kind, path: int, names) -> int:
    return _hash(f"{kind} {path} {names or ''}")


def _token(part) -> int | None:
    """The token of a part of a page. A text is one by its words and path; a blank text is none."""
    kind, name, path, names = part
    if kind != "text":
        return token(kind, path, names)
    words = name.split()
    return token(kind, path, " ".join(words)) if words else None


def _tokens(page: str) -> Counter:
    """How often each token occurs, by (token, whether it is a text, whether that is outside dropped elements)."""
    found = Counter((_token(part), part[0] == "text", part[0] == "text" and not part[3]) for part in read(page))
    return Counter({t: n for t, n in found.items() if t[0] is not None})


def occurrences(pages: DataFrame) -> DataFrame:
    """host, token, text (whether it is one), body (and outside dropped elements), pages, total and the sketch of its
    occurrence vector, summed over the pages of the host."""
    def run(batches):
        sums: dict[tuple[str, int, bool, bool], list[int]] = {}

        def flush():
            rows = [(*key, *v) for key, v in sums.items()]
            sums.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 8, (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), *[pa.int64()] * 4))],
                ["host", "token", "text", "body", "pages", "total", "low", "high"],
            )

        for batch in batches:
            for page_id, url, page in zip(*(batch.column(c) for c in ("page_id", "url", "html"))):
                host, text = host_of(url.as_py()), page.as_py() or ""
                own = _hash(f"{page_id.as_py()} {url.as_py()} {text}") + (1 << 63)
                low, high = own & 0x3FFFFFFF, own >> 34
                for key, n in _tokens(text).items():
                    v = sums.setdefault((host, *key), [0] * 4)
                    for i, x in enumerate((1, n, n * low, n * high)):
                        v[i] += x
                if len(sums) > 50_000:
                    yield flush()
        yield flush()

    rows = pages.select("page_id", "url", "html").mapInArrow(run, "host string, token long, text boolean, body boolean, pages long, total long, low long, high long")
    return rows.groupBy("host", "token", "text", "body").agg(*(F.sum(c).alias(c) for c in ("pages", "total", "low", "high")))


def templates(counted: DataFrame) -> DataFrame:
    """One row per host: its template as an array of (token, class), and whether its pages are copies of each other.

    They are where less than half a text per page, outside dropped elements, is of no template.
    """
    bodies = F.coalesce(F.sum(F.when(F.col("body"), F.col("total"))), F.lit(0))
    host_pages = counted.groupBy("host").agg(F.max("pages").alias("host_pages"), bodies.alias("texts"))
    often = counted.join(host_pages, "host").filter("2 * pages >= host_pages").filter(~F.col("text") | (F.col("pages") >= TEXT_PAGES))
    same = often.groupBy("host", "host_pages", "texts", "pages", "total", "low", "high").agg(
        F.collect_set("token").alias("tokens"), bodies.alias("shared"))
    large = same.filter(F.size("tokens") > 1).withColumn("class", F.xxhash64("pages", "total", "low", "high"))
    pairs = F.transform("tokens", lambda t: F.struct(t.alias("token"), F.col("class").alias("class")))
    members = large.select("host", "host_pages", "texts", "shared", pairs.alias("m"))
    return members.groupBy("host", "host_pages", "texts").agg(
        F.flatten(F.collect_list("m")).alias("template"), F.sum("shared").alias("shared"),
    ).select("host", "template", (2 * (F.col("texts") - F.col("shared")) < F.col("host_pages")).alias("copies"))


def _valid(sequence: list[tuple[int, int]]) -> bool:
    """Whether the tokens of a class, in page order, occur in turn in one order."""
    tokens = [t for t, _ in sequence]
    size = len(set(tokens))
    return len(tokens) % size == 0 and all(t == tokens[i % size] for i, t in enumerate(tokens))


def _in_slots(sequence: list[tuple[int, int]], bounds: list[int]) -> bool:
    """Whether every round of a repeated class lies between two neighbouring bounds."""
    size = len({t for t, _ in sequence})
    return all(
        bisect_left(bounds, sequence[start][1]) == bisect_left(bounds, sequence[start + size - 1][1])
        for start in range(0, len(sequence), size)
    )


def _names_a_part(token: str) -> bool:
    """Whether a class or id is a listed name: all its words are listed or say a place, and one is listed."""
    words = [w for w in re.split(r"[^a-z]+", token) if w]
    listed = [bool(DROPPED_NAME.fullmatch(w)) for w in words]
    return any(listed) and all(known or w in PLACES for known, w in zip(listed, words))


def _named(name: str, names: str | None) -> bool:
    """Whether a class, id or role says that the element is a part to be dropped."""
    if not names or name in ("html", "body"):
        return False
    tokens = re.sub(r"\b(?:class|id)=", "", names).split()
    return any(map(_names_a_part, tokens)) or any(f"role={r}" in tokens for r in DROPPED_ROLE)


def _encloses(lo: int, hi: int, places: list[int]) -> bool:
    at = bisect_left(places, lo)
    return at < len(places) and places[at] <= hi


def _outside(places: list[int], spans: list[tuple[int, int]]) -> list[int]:
    """Those of the ascending places that are in none of the spans."""
    left, reached, rest = [], -1, deque(sorted(spans))
    for place in places:
        while rest and rest[0][0] <= place:
            reached = max(reached, rest.popleft()[1])
        if place > reached:
            left.append(place)
    return left


def _dropped(parts: list) -> set[int]:
    """The places of the opening tags whose elements are dropped.

    A name or a form is a hint: it does not drop the page's <main>, nor its last <article>, nor what encloses them.
    """
    opened, ends, articles = [], {}, []
    within, hinted, dropped = 0, [], set()
    for i, (kind, name, _, names) in enumerate(parts):
        if kind == "open":
            if name in DROPPED and name != "form":
                dropped.add(i)
            elif name == "form" or _named(name, names):
                (dropped.add if within else hinted.append)(i)
            if name in ARTICLE:
                if not within:
                    articles.append(i)
                within += 1
            if name not in VOID:
                opened.append(i)
        elif kind == "close" and opened:
            ends[opened.pop()] = i
            within -= name in ARTICLE
    end = lambda i: i if parts[i][1] in VOID else ends.get(i, len(parts))
    articles = _outside(articles, [(i, end(i)) for i in dropped])
    mains = [a for a in articles if parts[a][1] == "main"]
    hinted = [i for i in hinted if not _encloses(i, end(i), mains)]
    if not _outside(articles, [(i, end(i)) for i in hinted]):
        hinted = [i for i in hinted if not _encloses(i, end(i), articles)]
    return dropped.union(hinted)


def extract(page: str, template: dict[int, int], copies=False) -> str:
    """Blocks of the article's slots, each on one line, joined by an empty line; of copies, template text as well."""
    parts = list(read(page))
    places: dict[int, list[tuple[int, int]]] = {}
    for i, part in enumerate(parts):
        t = _token(part)
        if t in template:
            places.setdefault(template[t], []).append((t, i))
    valid = {c: s for c, s in places.items() if _valid(s)}
    once = {c for c, s in valid.items() if len({t for t, _ in s}) == len(s)}
    bounds = sorted(i for c in once for _, i in valid[c] if parts[i][0] != "text")
    furniture = {i for c, s in valid.items() if c in once or _in_slots(s, bounds) for _, i in s if parts[i][0] == "text"}

    gone = _dropped(parts)
    blocks, current, made = [], [], []
    state: list[tuple[bool, bool]] = [(False, False)]  # dropped, in article

    def close_block():
        text = " ".join(markup.unescape("".join(current)).split())
        if text:
            blocks.append((text, *state[-1], all(i in furniture for i in made)))
        current.clear()
        made.clear()

    for i, (kind, name, _, names) in enumerate(parts):
        if kind == "text":
            current.append(name)
            if name.strip():
                made.append(i)
            continue
        if name in BLOCKS or name in DROPPED:
            close_block()
        elif name == "br":
            current.append(" ")
        if kind == "open":
            dropped, article = state[-1]
            own = (dropped or i in gone, article or name in ARTICLE)
            if name not in VOID:
                state.append(own)
        elif len(state) > 1:
            state.pop()
    close_block()

    kept = [b for b in blocks if not b[1]]
    inside = [b for b in kept if b[2]] or kept
    return "\n\n".join(b[0] for b in inside if copies or not b[3])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    found = stored(templates(stored(occurrences(pages), "tokens")), "templates")

    def run(batches):
        for batch in batches:
            rows = []
            for page_id, url, page, template, copies in zip(*(batch.column(c) for c in ("page_id", "url", "html", "template", "copies"))):
                known = {m["token"]: m["class"] for m in template.as_py() or ()}
                text = extract(page.as_py() or "", known, bool(copies.as_py()))
                rows.append((page_id.as_py(), url.as_py(), text, len(text)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, (pa.int64(), pa.string(), pa.string(), pa.int64()))],
                ["page_id", "url", "text", "n_chars"],
            )

    def hosts(batches):
        for batch in batches:
            yield batch.append_column("host", pa.array([host_of(u.as_py()) for u in batch.column("url")], pa.string()))

    narrow = pages.select(F.col("page_id").cast("long"), "url", "html")
    hosted = narrow.mapInArrow(hosts, "page_id long, url string, html string, host string")
    joined = hosted.join(found, "host", "left").select("page_id", "url", "html", "template", "copies")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
