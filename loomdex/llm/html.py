"""Main text of web pages by the maximum-scoring subsequence of their tokens.

A page is read as a run of tokens: text pieces and tags. A text piece scores its number of words times the weight of
the place it stands in, a tag scores its own weight. Weights are log-odds that such a token lies in the content,
counted over labelled pages; tags never score above a small negative value. One linear scan finds the contiguous run
with the largest sum. It is extended to the bounds of the ``article`` and ``main`` elements that it meets, and elsewhere to
the bounds of the blocks in which it begins and ends, so links at the edges stay. Of that run the words in places that are
never content are left out; what remains is joined block by block.

Names tell by whole words of the class, and of the id of a container whose id is not the slug of its own heading.
Places that are never content (menus, page headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader
comments, hidden parts) count as one token each, however long they are, so an advert in the middle costs little.

Cases: a null or empty page has an empty text, also a page without content words; tags and comments that are not
closed reach to the end of the page; end tags without start are ignored; repeated pages are read each; pages of any
length are read whole, in time linear in their length.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Element names of HTML by their use.
RAW_TEXT = frozenset("script style noscript template iframe textarea title svg math object audio video canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER_CONTENT = frozenset("head nav footer aside form select button dialog menu label fieldset".split())
CONTENT = frozenset("article main".split())
CONTAINERS = frozenset("div section ul ol table".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike"
    " strong sub sup time tt u var wbr".split()
)
#: Parts of class names and ids that tell what is never content.
NEVER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb"
    " breadcrumbs sidebar footer masthead cookie cookies consent gdpr notice popup modal overlay newsletter subscribe"
    " signup login comment comments disqus respond reply replies share sharing social related recommended pagination"
    " pager widget toolbar skip".split()
)
#: Words that go with those in names of page furniture and tell nothing of a subject.
COMPANIONS = frozenset(
    "area articles bar block bottom box button buttons container content form group icon icons inner item items left link links list"
    " media news panel posts right section side slot stories top unit wrap wrapper".split()
)
#: Words of reader comments, which articles of their own may hold.
COMMENT_WORDS = frozenset("comment comments disqus respond reply replies".split())
#: Words of teasers; with ``more`` also those of what is read next.
TEASER_WORDS = frozenset("teaser teasers card cards".split())
NEXT_WORDS = frozenset("stories news articles posts reading".split())
#: Elements that hold one piece of text: names of several words, such as slugs, say nothing against it.
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li td th dt dd blockquote pre figcaption caption".split())
NEVER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

#: Pages that the weights are counted over; the content stands between ``[[`` and ``]]``.
LABELLED_PAGES = (
    "<html><head><title>T one</title></head><body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul>"
    "</nav><div class=ad>Buy now and save a lot today</div><article>[[<h1>T one</h1><p>The river rose over night and the"
    " old bridge was closed.</p><p>By noon <b>three</b> roads were under water.<br>People waited for help.</p>"
    "<ul><li>first road</li><li>second road</li></ul>]]</article><footer>&copy; Paper, all rights reserved</footer></body></html>",
    "<html><body><header><a href=/>Site</a> All the best stories</header><main>[[<h2>On bread</h2><p>Mix flour and water,"
    " then wait for an hour.</p>]]<aside>More recipes for you</aside>[[<p>Bake it until it is brown and let it cool.</p>]]"
    "</main><section id=comments><p>Great post, thanks a lot for it!</p></section></body></html>",
    "<html><body><div><a href=/1>one</a> <a href=/2>two</a> <a href=/3>three</a></div><div>[[<h1>Walls</h1><p>A wall of"
    " stone lasts longer than its builder.</p><p>It needs no roof, but it needs a good base.</p>]]</div><div>Contact"
    " <a href=/c>us</a> | <a href=/p>privacy</a></div></body></html>",
    "<body><table><tr><td><a href=/x>Index</a></td><td><a href=/y>Next</a></td></tr></table>[[<p>Long ago ships of wood"
    " sailed along this coast, and few came back.</p><p>The harbour is a museum today.</p>]]<table><tr><td><a"
    " href=/z>Top</a></td></tr></table></body>",
    "<body><div class=cookie-notice>We use cookies to make this better</div><article>[[<p>Short note.</p>]]</article>"
    "<div><p>You may also like these other pages of ours</p></div></body>",
    "<body><div class=menu><a href=/a>Start</a></div><article>[[<h1><a href=/p>A mill on the river</a></h1><p>The <a href=/m>old mill"
    "</a> was built by <a href=/w>two brothers</a> and burnt down twice.</p><ul><li><a href=/1>The first fire</a></li><li><a href=/2>The"
    " second fire</a></li></ul><p>Source: <a href=/s>City archive</a></p>]]</article><div>More to read</div></body>",
    "<body><div>Our other stories</div><main>[[<h2><a href=/q>Night trains</a></h2><p>They are back, says <a href=/r>the railway"
    "</a>.</p><ol><li><a href=/3>Timetable of the north</a></li><li><a href=/4>Fares</a></li><li><a href=/5>Sleeping cars</a></li>"
    "</ol>]]</main></body>",
)

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^>\"']|[\"'])*?)(?:>|\Z)"
    r"|[^<]++|<",
    re.DOTALL,
)
#: Every attribute with its value, so that nothing inside a value is taken for a name.
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]++)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_HEADING = re.compile(r"\s*<h[1-6]\b[^>]*>(.{0,1000}?)</h[1-6]", re.IGNORECASE | re.DOTALL)
_PART = re.compile(r"[A-Za-z]+?(?=[A-Z][a-z]|[^A-Za-z]|\Z)")
#: Tokens: ("text", place, words or text), ("tag", weight name, is a block) and ("skip", name, True).
Token = tuple[str, str, object]


def _is_slug(parts: list[str], page: str, at: int) -> bool:
    """Whether the parts of an id are the words of the heading that begins at ``at``: then it names the section's subject."""
    m = _HEADING.match(page, at) if len(parts) > 1 else None
    return m is not None and re.findall(r"[a-z]+", entities.unescape(re.sub("<[^>]*>", "", m[1])).lower()) == parts


#: What the names of an element tell: content, never content, or no content unless it holds most of the words.
FINE, NEVER, DOUBT = range(3)


def _tokens(value: str) -> list[tuple[str, list[str]]]:
    """The names in a class or id, each with its words."""
    return [(x, [p.lower() for p in _PART.findall(x)]) for x in value.split()]


def _names_say(name: str, value: str) -> int:
    """What the words of a class or id tell."""
    parts = [p.lower() for p in _PART.findall(value)]
    if name in ("article", "main"):
        return NEVER if not COMMENT_WORDS.isdisjoint(parts) else DOUBT if not TEASER_WORDS.isdisjoint(parts) else FINE
    if name in TEXT_BLOCKS or name in INLINE:  # one word says it, a name made of several may be about the text
        return FINE if NEVER_WORDS.isdisjoint(x.lower() for x in value.split()) else NEVER
    if not NEVER_WORDS.isdisjoint(parts):
        furniture = any(x.lower() in NEVER_WORDS or not NEVER_WORDS.isdisjoint(own) and set(own) <= NEVER_WORDS | COMPANIONS for x, own in _tokens(value))
        return NEVER if furniture else DOUBT
    return DOUBT if not TEASER_WORDS.isdisjoint(parts) or ("more" in parts and not NEXT_WORDS.isdisjoint(parts)) else FINE


def _never(name: str, attributes: str, in_content: bool, in_text: bool, page: str, at: int) -> int:
    """Whether an element holds no content; the header of an article is content, and so is a key or label named in a sentence.

    Ids of headings, paragraphs and inline elements are made from their words, so only those of containers count.
    """
    if name in ("button", "label") and in_content and in_text:
        return FINE
    if name in NEVER_CONTENT or (name == "header" and not in_content):
        return NEVER
    if not attributes:
        return FINE
    said = FINE
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "class" or (key == "id" and name in CONTAINERS):
            named = FINE if name in ("html", "body") else _names_say(name, value)
            slug = key == "id" and in_content and named and _is_slug([p.lower() for p in _PART.findall(value)], page, at)
            if named == NEVER and not slug:
                return NEVER
            said = said if slug else max(said, named)
        if key == "role" and value.lower() in NEVER_ROLES:
            return NEVER
        if (key == "aria-hidden" and value.lower() == "true") or (key == "hidden" and value.lower() != "until-found"):
            return NEVER
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
            return NEVER
    return said


def tokens_of(page: str) -> tuple[list[Token], list[tuple[int, int]]]:
    """The page's tokens, and where the outermost elements of content lie in them, without the tags of their own; elements
    that are never content are one ``skip`` token each."""
    out: list[Token] = []
    bounds: list[tuple[int, int]] = []
    begun = 0
    open_names: list[str] = []
    links = content = 0
    skip_from: int | None = None  # depth of the element that is skipped
    has_content = False  # whether any content element was opened, in the markup and not in a comment or script
    doubted: list[tuple[int, int]] = []  # where elements lie that are no content unless they hold most of the words
    doubt_from: tuple[int, int] | None = None  # depth and first token of the outermost of them that is open
    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end()
        name = m[2]
        if name is None:
            piece = m[0]
            if piece.startswith(("<!", "<?")):
                continue
            if skip_from is None and piece:
                out.append(("text", ("article" if content else "free") + ("-link" if links else ""), piece))
            continue
        name = name.lower()
        if m[1]:
            if name in open_names:
                while True:
                    last = open_names.pop()
                    links -= last == "a"
                    if last in CONTENT:
                        content -= 1
                        if not content:
                            bounds.append((begun, len(out)))
                    if last == name:
                        break
                if doubt_from and len(open_names) <= doubt_from[0]:
                    doubted.append((doubt_from[1], len(out)))
                    doubt_from = None
                if skip_from is not None and len(open_names) <= skip_from:
                    skip_from = None
                    continue
            if skip_from is None:
                out.append(("tag", "/" + name, name not in INLINE))
            continue
        if name in RAW_TEXT and not m[3].endswith("/"):
            close = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            at = close.end() if close else end
            if skip_from is None:
                out.append(("skip", "raw", False))
            continue
        if name == "p" and "p" in open_names:  # a paragraph ends where the next one begins
            while open_names and open_names[-1] in INLINE:
                links -= open_names.pop() == "a"
            if open_names and open_names[-1] == "p":
                open_names.pop()
                if skip_from is not None and len(open_names) <= skip_from:
                    skip_from = None
        if name in VOID:
            if skip_from is None:
                out.append(("tag", name, name not in INLINE))
            continue
        said = FINE if skip_from is not None else _never(name, m[3], content > 0, not TEXT_BLOCKS.isdisjoint(open_names), page, at)
        if said == NEVER:
            skip_from = len(open_names)
            out.append(("skip", "never", True))
        elif skip_from is None:
            if said == DOUBT and not doubt_from and not m[3].endswith("/"):
                doubt_from = (len(open_names), len(out))
            out.append(("tag", name, name not in INLINE))
        if not m[3].endswith("/"):
            open_names.append(name)
            links += name == "a"
            if name in CONTENT:
                begun = begun if content else len(out)
                content += 1
                has_content = has_content or skip_from is None
        elif skip_from == len(open_names):
            skip_from = None
    if content:
        bounds.append((begun, len(out)))
    if doubt_from:
        doubted.append((doubt_from[1], len(out)))
    rest = "outside" if has_content else "plain"
    out = [(k, place.replace("free", rest), v) if k == "text" else (k, place, v) for k, place, v in out]
    return _without_doubted(out, bounds, doubted)


def _without_doubted(out: list[Token], bounds: list[tuple[int, int]], doubted: list[tuple[int, int]]) -> tuple[list[Token], list[tuple[int, int]]]:
    """Doubted elements as one ``skip`` token each, but for one that holds more than half of the words of the content (or of a page without it)."""
    if not doubted:
        return out, bounds
    words = [len(t[2].split()) if t[0] == "text" and not t[1].startswith("outside") else 0 for t in out]
    half = sum(words) / 2
    gone = [(a, b) for a, b in doubted if sum(words[a:b]) <= half]
    kept, place, at = [], [0] * (len(out) + 1), 0
    for a, b in [*gone, (len(out), len(out))]:
        for i in range(at, a):
            place[i] = len(kept)
            kept.append(out[i])
        place[a : b + 1] = [len(kept)] * (b + 1 - a)
        if a < b:
            kept.append(("skip", "never", True))
            place[b] = len(kept)
        at = b
    place[len(out)] = len(kept)
    return kept, [(place[a], place[b]) for a, b in bounds]


def _class_of(token: Token) -> str:
    return f"word@{token[1]}" if token[0] == "text" else f"{token[0]}:{token[1]}"


def learn_weights(pages: tuple[str, ...] = LABELLED_PAGES) -> dict[str, float]:
    """Log-odds of lying in the content by class of token; ``tag`` is for tags that the pages do not have
    (counted over all but links and list items, which lists repeat)."""
    inside, outside = Counter(), Counter()
    for page in pages:
        within = False
        for token in tokens_of(page.replace("[[", "\0[").replace("]]", "]\0"))[0]:
            if token[0] != "text":
                (inside if within else outside)[_class_of(token)] += 1
                continue
            for piece in re.split(r"(\0\[|\]\0)", token[2]):
                if piece in ("\0[", "]\0"):
                    within = piece == "\0["
                elif n := len(piece.split()):
                    (inside if within else outside)[_class_of(token)] += n
    odds = lambda a, b: math.log((a + 0.5) / (b + 0.5))
    weights = {k: odds(inside[k], outside[k]) for k in {*inside, *outside}}
    tags = [k for k in weights if not k.startswith("word@") and k not in ("tag:a", "tag:/a", "tag:li", "tag:/li")]
    pooled = odds(sum(inside[k] for k in tags), sum(outside[k] for k in tags))
    weights["tag"] = pooled
    return {k: v if k.startswith("word@") else min(v, -0.05) for k, v in weights.items()}


def best_region(scores: list[float]) -> tuple[int, int]:
    """The first longest run ``[start, end)`` with the largest positive sum; empty if there is none."""
    best, best_run, total, start = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        total += score
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, best_run = total, (start, i + 1)
    return best_run


def whole_blocks(tokens: list[Token], bounds: list[tuple[int, int]], start: int, end: int) -> tuple[int, int]:
    """The run ``[start, end)`` extended to the bounds of the content and of the blocks that it cuts."""
    if start == end:
        return start, end
    while start and (tokens[start - 1][0] == "text" or not tokens[start - 1][2]):
        start -= 1
    while end < len(tokens) and (tokens[end][0] == "text" or not tokens[end][2]):
        end += 1
    met = [(a, b) for a, b in bounds if a < end and start < b]
    return min([start, *(a for a, _ in met)]), max([end, *(b for _, b in met)])


def main_text(page: str | None, weights: dict[str, float]) -> str:
    if not page:
        return ""
    tokens, bounds = tokens_of(page)
    fallback = weights["tag"]
    scores = [
        len(t[2].split()) * weights.get(_class_of(t), 0.0) if t[0] == "text" else weights.get(_class_of(t), fallback) for t in tokens
    ]
    start, end = whole_blocks(tokens, bounds, *best_region(scores))
    blocks, held = [], []
    for kind, place, value in tokens[start:end]:
        if kind == "text":
            if weights.get(f"word@{place}", 0.0) > 0 or place.startswith("article") or place == "plain-link":
                held.append(value)
        elif value:
            blocks.append("".join(held))
            held = []
    blocks.append("".join(held))
    joined = (" ".join(entities.unescape(b).split()) for b in blocks)
    return " ".join(b for b in joined if b)


def extract(pages: DataFrame, html: str, into: str = "main_text", weights: dict[str, float] | None = None) -> DataFrame:
    """``pages`` with the main text of the whole ``html`` in ``into``."""
    weights = weights or learn_weights()

    @F.arrow_udf(T.StringType())
    def text_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([main_text(page.as_py(), weights) for page in batch], pa.string())

    return pages.withColumn(into, text_of(F.col(html)))
