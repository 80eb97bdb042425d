"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass classifies each by itself: by its length, the share of its
words that are stop words, and the share of its text inside links. Long blocks rich in stop words are good, blocks of
links and blocks of menus, forms, adverts and the like are bad, and the rest is undecided. In the second pass undecided
blocks take the label of the nearest decided neighbour in the same region of the page. Menus, adverts and the like are
regions of their own; what follows one belongs to the region that it interrupts.

Stop words are of seven languages. Where they can't tell, length and links alone decide: in blocks that aren't in Latin
letters, and on pages of which they recognise less than a quarter of the text.

Inside an article a linked heading is undecided, and a linked block that stands alone is good between good neighbours;
runs of linked blocks are lists of links and bad. Preformatted blocks are undecided: code has no stop words.

A container whose class or id names a menu, an advert or the like is bad, unless the page shows that the name says
something else: names such as ``has-sidebar`` are of a layout, a container around the page's first article or around most
of a page without an article is the page, and names that articles use for parts of their own (header, legal, ...) only
vote: inside an article a block under one is good if its words are an article's.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ship, without

# Common words of some languages.
STOP_WORDS = {
    "en": "the of and to a in is it that for was on are as with his they at be this have from or had by but not what all were we when your can said there an each which she do how their if will up about out many then them these so some her would him into has more no than been its who did get may",
    "fr": "le la les de des du un une et est en que qui dans pour pas sur au aux avec ce il elle se ne par plus sont ou son sa ses mais nous vous ils été cette comme on tout leur être fait était même si entre sans",
    "de": "der die das und ist in zu den von mit sich des auf für nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde",
    "es": "el la los las de y que en un una por con no se su para es al lo como más pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está",
    "it": "il lo la i gli le di e che è un una in per non con si da come del della dei delle al alla sono ma anche più nel nella questo ha suo sua o se",
    "pt": "o a os as de e que do da em um uma para com não por mais dos das como mas foi ao ele tem seu sua ou quando muito nos já também só pelo pela até isso",
    "nl": "de het een en van is in te dat op voor met zijn niet aan er om als ook maar door over bij uit nog naar heeft hij ze wordt deze of werd",
}
#: Shares and lengths (characters) of the first pass.
STOP_HIGH, STOP_LOW, LINKS, SHORT, LONG = 0.30, 0.12, 0.4, 70, 160

#: Stop words judge the language of a page of which they recognise so large a part of the text.
KNOWN = 0.25

_STOP = [frozenset(w.split()) for w in STOP_WORDS.values()]
_LETTERS, _NOT_LATIN = re.compile(r"[^\W\d_]"), re.compile(r"[^\W\d_\x00-\u024f\u1e00-\u1eff]")
#: Letters of scripts without spaces, which say as much as two or more of others.
_DENSE = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\uf900-\ufaff\U00020000-\U0003ffff]")
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<[!?/][^>]*>|<([a-zA-Z][a-zA-Z0-9:-]*)[^>]*>""", re.S)
_RAW = frozenset("script style template noscript svg math iframe object canvas audio video textarea select title".split())
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CONTAINER = frozenset("article aside blockquote body center details dialog div dl fieldset figure footer form head header main menu nav ol section table ul button".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_BAD = frozenset("nav header footer aside form menu dialog fieldset head button".split())
_NAMED = re.compile(
    r"""(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I
)
_BAD_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|side-?bar|menu|nav|navbar|navigation|bread-?crumbs?|footer|header|masthead|comments?|comment-?list|respond|disqus|replies|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscri\w+|share|sharing|social|related|recommended|widget|login|search|contentinfo|complementary|pagination|pager|tags?|toolbar|legal|copyright)(?:$|[\s_-])", re.I
)


#: Names that parts of an article have too.
_WEAK = re.compile(r"^(?:header|masthead|legal|copyright|widget|tags?|toolbar|login|search|banner|notice)$", re.I)
#: Names of what readers write, which may be longer than the article and have articles of its own.
_TALK = re.compile(r"^(?:comments?|comment-?list|respond|disqus|replies|related|recommended)$", re.I)
#: A name that starts so says what a page or its layout has.
_LAYOUT = re.compile(r"^(?:has|with|without|no|not|is|hide|show|layout|page|theme|js)[-_]", re.I)

_LOWER = {c: c + 32 for c in range(65, 91)}


class _Named:
    """A container with a bad name: whether it is about readers' words, whether its name only votes inside an article, how
    much text it holds, and whether the name holds."""

    __slots__ = ("held", "holds", "talk", "weak")

    def __init__(self, talk: bool, weak: bool):
        self.talk, self.weak, self.held, self.holds = talk, weak, 0, True


class _Block:
    __slots__ = ("bad", "code", "doubt", "heading", "label", "links", "main", "named", "region", "text")

    def __init__(self, text: str, links: int, bad: bool, main: bool, region: int, heading: bool, code: bool, named: tuple[_Named, ...]):
        self.text, self.links, self.bad, self.main, self.region, self.heading, self.code, self.named = text, links, bad, main, region, heading, code, named
        self.doubt, self.label = False, None


def _name(attributes: str) -> _Named | None:
    """What the names of a container say against it."""
    words = [w.group(0).strip(" _-\t\n\r\f") for m in _NAMED.finditer(attributes) for name in (m[1] or m[2] or m[3] or "").split() if not _LAYOUT.match(name) for w in _BAD_NAME.finditer(name)]
    if not words:
        return None
    return _Named(any(map(_TALK.match, words)), all(map(_WEAK.match, words)))


def blocks(page: str) -> list[_Block]:
    """Blocks of a page in order, with the links' part of their text (characters) and where they stand."""
    out: list[_Block] = []
    n = len(page)
    # tag, bad and main, each including what is above, the region that it interrupts if it is bad by itself, and names
    stack: list[tuple[str, bool, bool, int | None, tuple[_Named, ...]]] = []
    low = page.lower()
    if len(low) != n:  # some letters are longer in lower case
        low = page.translate(_LOWER)
    closes: dict[str, int] = {}  # last closing tag of each kind

    def closed(tag: str) -> bool:
        if tag not in closes:
            closes[tag] = low.rfind(f"</{tag}")
        return closes[tag] >= at

    parts: list[str] = []
    linked: list[str] = []
    in_link, region, regions, at = False, 0, 0, 0
    bad = main = heading = code = seen = False
    named: tuple[_Named, ...] = ()

    def flush() -> None:
        nonlocal in_link
        if parts:
            text = " ".join(html_lib.unescape("".join(parts)).split())
            if text:
                links = len(" ".join(html_lib.unescape("".join(linked)).split())) if linked else 0
                out.append(_Block(text, links, bad, main, region, heading, code, named))
            parts.clear()
            linked.clear()

    while at < n:
        m = _TAG.search(page, at)
        end = m.start() if m else n
        if end > at:
            parts.append(page[at:end])
            if in_link:
                linked.append(page[at:end])
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[4] or "").lower()
        if not tag:
            continue
        if m[1]:  # closing
            if tag == "a":
                in_link = False
            if tag in _BLOCK:
                flush()
                heading = code = False
            if tag in _CONTAINER and any(t[0] == tag for t in stack):
                top, back = "", None
                while top != tag:
                    top, _, _, outer, _ = stack.pop()
                    back = back if outer is None else outer
                bad, main, named = (stack[-1][1], stack[-1][2], stack[-1][4]) if stack else (False, False, ())
                if tag in ("article", "main") or (tag in _BAD and outer is None):
                    regions += 1
                    region = regions
                elif back is not None:
                    region = back
            continue
        if tag in _RAW:
            if not (m[3] or "").rstrip().endswith("/"):
                close = low.find(f"</{tag}", at) if closed(tag) else -1
                stop = page.find(">", close) if close >= 0 else -1
                at = stop + 1 if stop >= 0 else (n if tag in ("script", "style") else at)
            parts.append(" ")
        elif tag == "br":
            parts.append(" ")
        elif tag == "a":
            in_link = True
        elif tag in _BLOCK:
            flush()
            heading, code = tag in _HEADINGS, tag == "pre"
            if tag in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "div"):
                in_link = False
            if tag in _CONTAINER and closed(tag):
                whole = tag in ("article", "main")
                if whole and not seen:
                    seen = not any(x.talk for x in named)
                    for x in named:
                        x.holds = x.holds and x.talk
                by_tag = tag in _BAD and not (tag == "header" and main)
                name = _name(m[3]) if m[3] and not by_tag and tag not in ("body", "html", "article", "main", "header") else None
                worse = by_tag or name is not None
                interrupted = region if worse else None
                if worse or whole:
                    regions += 1
                    region = regions
                stack.append((tag, bad or by_tag, main or whole, interrupted, (*named, name) if name else named))
                _, bad, main, _, named = stack[-1]
    flush()
    _judge_names(out)
    return out


def _judge_names(found: list[_Block]) -> None:
    """Whether names hold for the blocks under them."""
    if not any(b.named for b in found):
        return
    for b in found:
        for x in b.named:
            x.held += len(b.text)
    total = sum(len(b.text) for b in found)
    against = lambda b: [x for x in b.named if x.holds]
    if not any(b.main and not b.bad and not against(b) for b in found):
        for b in found:
            for x in b.named:
                x.holds = x.holds and (x.talk or 2 * x.held <= total)
    for b in found:
        if not b.bad and (names := against(b)):
            b.doubt = b.main and all(x.weak for x in names)
            b.bad = not b.doubt


def _stop_share(text: str) -> float:
    words = [w.strip(".,;:!?()[]\"'%*#$&|«»-").lower() for w in text.split()]
    return max(sum(w in s for w in words) for s in _STOP) / max(1, len(words))


def _size(text: str) -> int:
    """Characters, those of scripts without spaces twice."""
    return len(text) if text.isascii() else len(text) + len(_DENSE.findall(text))


def _is_latin(text: str) -> bool:
    return text.isascii() or 2 * len(_NOT_LATIN.findall(text)) <= len(_LETTERS.findall(text))


def classify(found: list[_Block]) -> list[_Block]:
    """Both passes; every block ends with the label good or bad."""
    stops: dict[int, float] = {}  # of the blocks that are long enough
    runs: dict[int, _Block] = {}  # the last block of each region
    for i, b in enumerate(found):
        share = b.links / max(1, len(b.text))
        last, runs[b.region] = runs.get(b.region), b
        if b.main and not b.bad and share > 0.9:
            b.label = "short" if b.heading else "linked"
            if last and b.label == "linked" and last.label in ("linked", "bad"):
                last.label = b.label = "bad"
        elif b.bad or share > (0.9 if b.main else LINKS):
            b.label = "bad"
        elif b.doubt and not b.heading and (_size(b.text) < SHORT or (_is_latin(b.text) and _stop_share(b.text) < STOP_LOW)):
            b.label = "bad"
        elif _size(b.text) < SHORT:
            b.label = "short" if not b.links or b.main else "bad"
        elif b.code:
            b.label = "near"
        else:
            stops[i] = _stop_share(b.text)
    known = sum(len(found[i].text) for i, stop in stops.items() if stop >= STOP_LOW) >= KNOWN * sum(len(found[i].text) for i in stops)
    for i, stop in stops.items():
        b = found[i]
        if stop < STOP_LOW and not (known and _is_latin(b.text)):
            b.label = "good" if _size(b.text) >= LONG else "near"
        elif stop >= STOP_HIGH or (stop >= STOP_LOW and (len(b.text) >= LONG or b.main)):
            b.label = "good"
        elif stop >= STOP_LOW or b.main:
            b.label = "near"
        else:
            b.label = "bad"
    first = [b.label for b in found]
    n = len(found)
    place, many = [0] * n, {}  # of each block in its region
    for i, b in enumerate(found):
        place[i] = many[b.region] = many.get(b.region, -1) + 1
    before, after = [None] * n, [None] * n
    for order, near in ((range(n), before), (range(n - 1, -1, -1), after)):
        last: dict[int, int] = {}
        for i in order:
            near[i] = last.get(found[i].region)
            if first[i] in ("good", "bad"):
                last[found[i].region] = i
    for i, b in enumerate(found):
        if first[i] in ("good", "bad"):
            continue
        sides = sorted((abs(place[j] - place[i]), first[j] != "good") for j in (before[i], after[i]) if j is not None)
        if first[i] == "linked":
            b.label = "good" if sides and not any(x for _, x in sides) else "bad"
        elif sides:
            b.label = "bad" if sides[0][1] else "good"
        else:
            b.label = "good" if b.main or first[i] == "near" else "bad"
    return found


def main_text(page: str | None) -> str:
    """Good blocks, a line each."""
    return "\n".join(b.text for b in classify(blocks(page or "")) if b.label == "good")


class _Extract:
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x) for x in b.column("html").to_pylist()]
            names = [n for n in b.schema.names if n != "html"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(texts, pa.string())], [*names, "text"])


def extract(pages: DataFrame, *, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Every page with its main text and n_chars, its code points.

    Null or empty html, and pages without a good block, give an empty text. ``keep``: columns to carry (all but the html);
    columns named text or n_chars give way. Repeated rows give repeated results; an empty table an empty one.
    """
    ship(pages.sparkSession)
    kept = without(pages.drop(html) if keep is None else pages.select(*[f"`{c}`" for c in keep]), "text", "n_chars").columns
    df = pages.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)], F.col(f"`{html}`").alias("html"))
    types = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in df.drop("html").schema), "text string"])
    out = df.mapInArrow(_Extract(), types)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], "text", F.length("text").cast("long").alias("n_chars"))
