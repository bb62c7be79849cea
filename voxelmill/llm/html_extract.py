"""Main text of web pages by block rules in two passes.

Pass one splits a page at block tags and classifies each block by stop-word density, length and link density as
good, bad, or, where it is short or in between, undecided. Pass two gives an undecided block the label of its
nearest decided neighbour (good when the nearest on either side differ and one of them, as near, is good); inside
an article or main element that neighbour is sought in the element alone. What stands outside a page's main
element is bad, as is what stands outside its articles where these hold at least half of its good text; elsewhere
articles are blocks like any other, as they are inside parts without main text. Blocks inside elements that hold no
main text (navigation, forms, scripts, asides, footers and the like), or of which a whole token of class, id or role
names such a part, are bad whatever their words; only a form or a layout part that holds most of the good text of its
page is a wrapper like any other. On a page whose long blocks hold almost no stop words (a language without a list, or
lists, tables and code) long blocks with few links are good by length and links alone; on others such a block without
stop words is undecided. Where no block is good, undecided blocks stay whose decided neighbours are all in such parts.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import slices

#: What follows a tag's name. A quote that closes neither before the next tag nor soon is a character like any other.
_REST = r"(?>[^<>\"']+|\"[^\"<]*\"|\"[^\"]{0,4000}\"|'[^'<]*'|'[^']{0,4000}'|[\"'])*+"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|iframe|svg|title)\b" + _REST + r">.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)(" + _REST + r")>|<[!?][^<>]*+>",
    re.S | re.I,
)
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
_NEVER = frozenset("nav footer aside form menu head select button dialog header fieldset".split())
_WRAPPING = frozenset(("form", "fieldset"))
_VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
_ROLE = re.compile(r"(?<![\w-])role\s*=\s*[\"']?\s*main\b", re.I)
_NAMED = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|notice|menu|nav|navbar|navi|navigation|breadcrumbs?|sidebar|footer|header|masthead|comments?|replies|respond|disqus|share|social|related|newsletter|subscribe|popup|modal|widget|toolbar|pagination|copyright|complementary|contentinfo", re.I)
#: Parts that are text of their own, however much of it: never wrappers.
_READERS = re.compile(r"comments?|replies|respond|disqus", re.I)
_OWN = re.compile(_READERS.pattern + r"|ads?|advert\w*|sponsor\w*|cookies?|consent", re.I)
#: Words beside a part's name in a token that leave it one (site-footer, comment-list, nav-2).
_BESIDE = frozenset("site page global main primary secondary top bottom left right upper lower inner outer mobile desktop sticky fixed user post article entry story blog container wrapper wrap box area section block bar list item items link links button buttons btn icon icons posts articles stories thread form text title signup content body overlay slot unit row col column group panel".split())
_HEADS = frozenset(("header", "masthead", "banner"))
_OF_TEXT = frozenset("page post article entry story".split())
_SPACE = re.compile(r"\s+")
#: Function words of the languages the rules know.
STOP_WORDS = frozenset(
    "a an and are as at be by for from has he her his in is it its not of on or she that the their they this to was we were which will with you but have had one all can who "
    "der die das und in zu den von mit sich des auf für ist im dem nicht ein eine als auch es an er hat aus bei wie nach wird war noch "
    "le la les de des du et en un une est que qui dans pour pas sur au avec ce il elle ne se plus par son sont aux ou mais "
    "el los las y del por con para su al lo como más pero sus no una o este sí porque está entre cuando muy sin sobre".split()
)


def blocks(page: str, wrappers: frozenset[int] = frozenset()) -> tuple[list[tuple[str, int, bool, int]], set[int], list[tuple[int, ...]]]:
    """(text, characters of it inside links, inside a part without main text, number of its article or 0), which of
    these numbers are main elements, and by block the parts it is in: where each begins, negative if that can't be a
    wrapper. Parts that begin at ``wrappers`` are none."""
    out, text, linked, links = [], [], 0, 0
    stack: list[tuple[str, bool, int]] = []
    inside: list[int] = []
    within: list[tuple[int, ...]] = []
    never, main, mains, firm = 0, 0, 0, set()
    opened: Counter = Counter()

    def close():
        nonlocal text, linked
        body = _SPACE.sub(" ", html.unescape("".join(text))).strip()
        if body:
            out.append((body, linked, never > 0, main))
            within.append(tuple(inside))
        text, linked = [], 0

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            text.append(piece)
            if links:
                linked += len(html.unescape(piece).strip())
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            if m[0].startswith("<!--") is False and m[1] and m[1].lower() == "title":
                close()
            continue
        if name == "br":
            text.append(" ")
            continue
        if name == "a":
            links = max(0, links + (-1 if m[2] else 1))
            continue
        if name in _BLOCK or name in _NEVER:
            close()
            links = 0
        if name in _VOID or m[4].endswith("/"):
            continue
        if not m[2]:
            only = name == "main" or bool(_ROLE.search(m[4]))
            kind = OTHER if name in _NEVER and name not in _WRAPPING else LAYOUT if name in _WRAPPING else PLAIN
            if name == "header" and main:
                kind = PLAIN
            elif name == "article":
                kind = READERS if _part(m[4]) == READERS else PLAIN
            elif not only and name not in ("html", "body"):
                kind = max(kind, _part(m[4]))
            bad = kind != PLAIN and m.start() not in wrappers
            if name in _BLOCK or name in _NEVER or bad or only:
                if name == "p" and stack and stack[-1][0] == "p":  # an open paragraph ends at the next
                    opened["p"] -= 1
                    if stack.pop()[1]:
                        never -= 1
                        inside.pop()
                if (bad or only) and name not in _BLOCK:
                    close()
                stack.append((name, bad, main))
                opened[name] += 1
                if bad:
                    never += 1
                    inside.append(m.start() + 1 if kind == LAYOUT else -m.start() - 1)
                if (only or name == "article") and not main and not never:
                    mains += 1
                    main = mains
                    if only:
                        firm.add(main)
        elif opened[name]:
            if name not in _BLOCK and name not in _NEVER:
                close()
            while stack:
                x, bad, before = stack.pop()
                opened[x] -= 1
                if bad:
                    never -= 1
                    inside.pop()
                main = before
                if x == name:
                    break
    text.append(page[at:])
    close()
    return out, firm, within


PLAIN, LAYOUT, OTHER, READERS = 0, 1, 2, 3


@functools.lru_cache(10_000)
def _part(attributes: str) -> int:
    """What class, id and role name: no part, a layout part, a text other than the main one, readers' comments."""
    kind = PLAIN
    for m in _NAMED.finditer(attributes):
        for token in (m[2] or m[3] or m[4] or "").split():
            words = [w for w in re.split(r"[_-]+", re.sub(r"side[_-]bar", "sidebar", token.lower())) if w]
            parts = [w for w in words if _PART.fullmatch(w)]
            if not parts or not all(w in _BESIDE or w.isdigit() for w in words if w not in parts):
                continue
            if _HEADS.issuperset(parts) and not _OF_TEXT.isdisjoint(words):  # a page-header holds the text's title
                continue
            readers, own = (any(p.fullmatch(w) for w in parts) for p in (_READERS, _OWN))
            kind = max(kind, READERS if readers else OTHER if own or m[1].lower() == "role" else LAYOUT)
    return kind


GOOD, BAD, OPEN = 1, 0, 2


#: Blocks of fewer characters are short.
SHORT = 70


def stop_words(text: str) -> tuple[int, int]:
    """(stop words, words) of a text."""
    words = text.lower().split()
    return sum(w.strip(".,;:!?#$%&*|\"'()") in STOP_WORDS for w in words), len(words)


def first_pass(found: list, long: int = 200, links: float = 0.33, dense: float = 0.3, thin: float = 0.1, listed: float = 0.2) -> list[int]:
    """The labels of a page's blocks. Below a share ``listed`` of stop words in all its long, link-poor blocks they
    say nothing about the page."""
    label, counts = [], {}
    for i, (text, linked, never, _) in enumerate(found):
        label.append(BAD if never or linked / max(1, len(text)) > links else OPEN)
        if label[i] == OPEN and len(text) >= SHORT:
            counts[i] = stop_words(text)
    unlisted = sum(n for n, _ in counts.values()) < listed * sum(n for _, n in counts.values())
    for i, (n, words) in counts.items():
        if unlisted or n >= dense * words or n >= thin * words and (len(found[i][0]) > long or found[i][3]):
            label[i] = GOOD
    return label


def _wrappers(found: list, within: list[tuple[int, ...]]) -> frozenset[int]:
    """Where the layout parts begin that hold more than half of the page's good text, other parts' not counted."""
    rows = [i for i, x in enumerate(within) if all(at > 0 for at in x)]
    if not any(within[i] for i in rows):
        return frozenset()
    good, held = 0, {}
    for i, x in zip(rows, first_pass([(*found[i][:2], False, found[i][3]) for i in rows]), strict=True):
        if x == GOOD:
            good += len(found[i][0])
            for at in within[i]:
                held[at - 1] = held.get(at - 1, 0) + len(found[i][0])
    return frozenset(at for at, n in held.items() if 2 * n > good)


def extract(page: str | None) -> str:
    """Main text: its blocks in page order, one a line."""
    if not page:
        return ""
    found, firm, within = blocks(page)
    if wrappers := _wrappers(found, within):
        found, firm, _ = blocks(page, wrappers)
    label = first_pass(found)
    if any(b[3] for b in found):
        good = [0, 0]
        for (body, _, _, main), x in zip(found, label, strict=True):
            good[main > 0] += len(body) * (x == GOOD)
        if good[1] >= good[0] or any(b[3] in firm and not b[2] for b in found):  # what stands outside is not the article
            label = [x if b[3] else BAD for x, b in zip(label, found, strict=True)]
        else:  # these are teasers or the like
            found = [(*b[:3], 0) for b in found]
            label = first_pass(found)
    filled = {b[3] for b, x in zip(found, label, strict=True) if x == GOOD}
    before, after = ({}, {})  # by undecided block: the nearest decided one of its element on either side
    for side, order in ((before, range(len(found))), (after, range(len(found) - 1, -1, -1))):
        last: dict[int, int] = {}
        for i in order:
            main = found[i][3]
            if label[i] != OPEN:
                if not (main and found[i][2]):
                    last[main] = i
            elif main in last:
                side[i] = last[main]
    out, bare = [], GOOD not in label
    for i, (body, _, _, main) in enumerate(found):
        kind = label[i]
        if kind == OPEN:
            if bare and all(found[side[i]][2] for side in (before, after) if i in side):
                out.append(body)  # nothing is good, and only menus and the like stand beside it: a short text is the text
                continue
            near = [(abs(side[i] - i), label[side[i]]) for side in (before, after) if i in side]
            if near:
                least = min(x[0] for x in near)
                kind = GOOD if any(x == (least, GOOD) for x in near) else BAD
            else:  # nothing decided: an article's own words stay
                kind = GOOD if main else BAD
            if main and main not in filled and len(body) >= SHORT:  # links beside an article's words don't decide them
                kind = GOOD
        if kind == GOOD:
            out.append(body)
    return "\n".join(out)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row. Null or empty html, and pages without main text: '' and 0.
    Other columns are ignored; repeated rows are kept; no rows give no rows."""
    kind, url = (pages.schema[c].dataType.simpleString() for c in (id_col, url_col))

    def run(batches):
        for batch in batches:
            for part in slices(batch, 500, 8 << 20):
                text = [extract(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(id_col, url_col, F.col(html_col).cast("string")).mapInArrow(run, f"page_id {kind}, url {url}, text string, n_chars long")
