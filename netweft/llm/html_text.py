"""Main-text extraction by line-block distribution.

1. Markup is stripped: every block element becomes one line of text with character references decoded. Scripts, styles,
   menus, page headers and footers, sidebars, forms, notices, adverts and reader comments count as markup, told by element
   name, role, or a class or id that is made of such words; a name that only holds one of them counts if most of the text is
   links. Names count neither on an article or main element nor on one that holds most of the page's text, unless they name
   reader comments. What is markup gives no line.
2. The bounds of containers (div, section and the like) that stand between two lines become empty lines, paragraphs, headings
   and list items none; one bound less counts between two lines that both stand in such a flow element, and none behind a
   heading, which belongs to what follows. A menu, header or footer gives a whole window of empty lines. So lines of one block
   of text stand together, and blocks apart.
3. Every line weighs its length outside links. Article elements (or else main elements) that hold ``share`` of the text left
   scale weights: their lines weigh their whole length times ``boost``, other lines of a main element stay, all others
   weigh the ``outside`` part; bounds inside them part nothing. A page without such an element has one scale.
4. Weights are summed over a sliding window of ``window`` lines. A surge point is where the sum reaches ``surge`` (or the
   page's highest sum, if lower), a dive point where it falls to zero. Text from the rise to the first surge up to the last
   dive is kept, whatever its size, but for lines where the sum is zero. On every page this decides what is text.

A narrow map: every page by itself, no shuffle. Memory holds one batch of pages. The scan is linear in a page's length, for
unclosed tags, quotes and elements too.

Defined results: null or empty html gives text '' and n_chars 0; unclosed elements end with their parent; an unclosed tag at
the end of a page is markup to the end; references that are no references stay as they are; very long pages are extracted
whole; repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Possessive, so that no start of a tag is tried in more than one way; a missing quote is looked for once at most, as there is
# none behind it.
TAG = re.compile(r"""(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)>""")
NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"']++))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?=\s|/|$|=)|(?:^|\s)style\s*+=\s*+["'][^"']*?display\s*:\s*none""", re.I)
SPACE = re.compile(r"\s+")

# Element names of HTML and names that pages give to what isn't the article.
RAW = frozenset("script style template noscript textarea iframe svg math canvas object video audio select title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead title tr ul".split()
)
DROPPED = frozenset("nav footer aside form menu dialog button fieldset head search".split())
PARTING = frozenset("nav header footer".split())
CLOSES_P = BLOCK - {"body", "html", "head", "title", "caption", "legend", "tbody", "thead", "tfoot", "tr"}
BOILER = frozenset(
    "ad ads adsbygoogle advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice alert popup modal overlay comment comments reply replies disqus discussion respond sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar toolbar share sharing social related recommended newsletter subscribe signup login search widget pagination pager complementary contentinfo".split()
)
COMMENTS = frozenset("comment comments reply replies disqus".split())
#: Words that articles use as well.
WEAK = frozenset("discussion respond".split())
#: Words that say nothing about what an element holds.
IDLE = frozenset("js wp inline block".split())
#: Words that may stand before a boilerplate word (site-footer) or after it (cookie-bar) in one name.
BEFORE = frozenset("site page main global top bottom left right primary secondary article post entry story user reader".split())
AFTER = frozenset("area bar block body box button buttons column container content form group holder inner item items link links list message page pages panel post posts section slot stories story text thread unit widget wrap wrapper".split())
TITLED = frozenset("article post entry story".split())
CELLS = frozenset({"td", "th"})
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("article body center dialog div header hgroup html main section".split())
OWN = ("article", "main")
#: An element that starts ends an open one of the names given, up to the nearest of the bounds.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}


def _boiler(name: str) -> tuple[str, bool]:
    """A boilerplate word that a class, id or role holds ('' if none), and whether the whole name is made of such words."""
    words = [w for w in re.split("[_-]+", name.lower()) if w and not w.isdigit() and w not in IDLE]
    held = next((w for w in words if w in BOILER), "")
    if not held:
        return "", False
    if len(words) == 1:
        return held, held not in WEAK
    if words[-1] in BOILER and all(w in BOILER or w in BEFORE for w in words):
        return ("", False) if words[-1] == "header" and words[0] in TITLED else (words[-1], words[-1] not in WEAK)
    return words[0] if words[0] in BOILER else held, words[0] in BOILER - WEAK and all(w in BOILER or w in AFTER for w in words[1:])


def _named(attributes: str) -> tuple[set[str], bool]:
    """The words of whole boilerplate names, and whether another name holds such a word."""
    found, weak = set(), False
    for m in NAMES.finditer(attributes):
        for name in (m[2] or m[3] or m[4] or "").split():
            word, whole = _boiler(name)
            if whole:
                found.add(word)
            weak |= bool(word) and not whole
    return found, weak


def _events(page: str) -> Iterator[tuple[str, str, str]]:
    """('text', text, ''), ('open', name, attributes) and ('close', name, '') in the order of the page."""
    at, size = 0, len(page)
    while at < size:
        begin = page.find("<", at)
        if begin < 0:
            begin = size
        if begin > at:
            yield "text", page[at:begin], ""
        if begin == size:
            return
        nxt = page[begin + 1 : begin + 2]
        if nxt in ("!", "?"):
            comment = page.startswith("<!--", begin)
            end = page.find("-->" if comment else ">", begin + 4 if comment else begin)
            at = size if end < 0 else end + (3 if comment else 1)
        elif (nxt.isascii() and nxt.isalpha()) or (nxt == "/" and page[begin + 2 : begin + 3].isascii() and page[begin + 2 : begin + 3].isalpha()):
            m = TAG.match(page, begin + 1)
            if m is None:  # no end of the tag up to the end of the page
                return
            at, name = m.end(), m[2].lower()
            if name in RAW:
                if not m[1] and not m[3].rstrip().endswith("/"):
                    m = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
                    end = page.find(">", m.end()) if m else -1
                    at = size if end < 0 else end + 1
            else:
                yield "close" if m[1] else "open", name, m[3]
        else:
            yield "text", "<", ""
            at = begin + 1


class _Element:
    __slots__ = ("name", "parent", "named", "weak", "before", "text", "linked", "gone")

    def __init__(self, name: str, parent, named: set[str], weak: bool, before: int, linked: int, gone: bool) -> None:
        self.name, self.parent, self.named, self.weak, self.gone = name, parent, named, weak, gone
        self.before, self.text, self.linked = before, 0, linked


def _tree(page: str) -> tuple[list[tuple[str, object, str]], int]:
    """(kind, element, text) in the order of the page, and the characters of text outside elements dropped by name."""
    out: list[tuple[str, object, str]] = []
    stack: list[_Element] = []
    count: Counter[str] = Counter()
    total = linked = gone = own = 0

    def pop(k: int) -> None:
        nonlocal gone, own
        for e in reversed(stack[k:]):
            e.text, e.linked = total - e.before, linked - e.linked
            count[e.name] -= 1
            gone -= e.gone
            own -= e.name in OWN
            out.append(("close", e, ""))
        del stack[k:]

    for kind, name, attributes in _events(page):
        if kind == "text":
            out.append(("text", stack[-1] if stack else None, name))
            if not gone:
                total += len(name)
                linked += len(name) if count["a"] else 0
            continue
        if kind == "close":
            if count[name]:
                pop(next(k for k in range(len(stack) - 1, -1, -1) if stack[k].name == name))
            elif name in BLOCK:
                out.append(("line", None, ""))
            continue
        if name in CLOSES_P and count["p"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].name == "p":
                    pop(k)
                    break
                if stack[k].name in BLOCK:
                    break
        if name in ENDS and any(count[x] for x in ENDS[name][0]):
            same, bounds = ENDS[name]
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].name in same:
                    pop(k)
                    break
                if stack[k].name in bounds:
                    break
        if name in VOID:
            out.append(("line" if name in BLOCK else "space" if name == "br" else "void", None, ""))
            continue
        away = name in DROPPED or (name == "header" and not own) or (bool(attributes) and HIDDEN.search(attributes) is not None and name not in ("html", "body"))
        named, weak = _named(attributes) if attributes and name not in ("html", "body") else (set(), False)
        if own:  # the article's own header
            named.discard("header")
        element = _Element(name, stack[-1] if stack else None, named, weak, total, linked, away)
        stack.append(element)
        count[name] += 1
        gone += away
        own += name in OWN
        out.append(("open", element, ""))
    pop(0)
    return out, total


def _away(e: _Element, total: int) -> bool:
    if e.gone or e.named & COMMENTS:
        return True
    if e.name in OWN or 2 * e.text > total:
        return False
    return bool(e.named) or (e.weak and 2 * e.linked > e.text)


Line = tuple[str, int, tuple[_Element, ...]]


def lines_of(page: str, window: int = 2) -> list[Line]:
    """(text, its characters outside links, the article and main elements that it is in) for each block that isn't markup, and
    the empty lines between them."""
    events, total = _tree(page)
    lines: list[Line] = []
    text: list[str] = []
    away = links = linked = 0
    inside: list[_Element] = []
    blocks: list[str] = ["body"]
    bounds: list[Line] = []
    parted: list[Line] = []
    before = "body"  # the innermost block of the line before

    def flush() -> None:
        nonlocal linked, before
        if text:
            whole = SPACE.sub(" ", html_lib.unescape("".join(text))).strip()
            if whole:
                if before in HEADINGS:
                    bounds.clear()
                elif not {before, blocks[-1]} & CONTAINERS:
                    del bounds[:1]
                lines.extend([*bounds, *parted])
                lines.append((whole, max(0, len(whole) - linked), tuple(inside)))
                bounds.clear()
                parted.clear()
                before = blocks[-1]
            text.clear()
        linked = 0

    for kind, e, piece in events:
        if kind == "text":
            if not away:
                text.append(piece)
                if links:
                    linked += len(piece)
        elif kind == "space":
            text.append(" ")
        elif kind == "line":
            flush()
        elif kind != "void":
            opens = kind == "open"
            gone = _away(e, total)
            if e.name in BLOCK:
                flush()
                if opens:
                    blocks.append(e.name)
                else:
                    blocks.pop()
            elif e.name in CELLS:
                text.append(" ")
            step = 1 if opens else -1
            links += step * (e.name == "a")
            own = e.name in OWN and not e.named & COMMENTS
            if own and not opens:
                inside.remove(e)
            if gone:
                if opens and not away and e.name in PARTING:
                    parted.extend([("", 0, tuple(inside))] * window)
            elif e.name in CONTAINERS and not away:
                bounds.append(("", 0, tuple(inside)))
            if own and opens:
                inside.append(e)
            away += step * gone
    flush()
    return lines


def weigh(lines: list[Line], boost: float = 8.0, outside: float = 0.25, share: float = 0.25) -> tuple[list[str], list[float]]:
    """The lines and their weights, scaled by the article or main elements that hold ``share`` of the text. Bounds inside such
    an element don't part its lines."""
    held: Counter[int] = Counter()
    kind: dict[int, str] = {}
    for text, _, inside in lines:
        for e in inside:
            held[id(e)] += len(text)
            kind[id(e)] = e.name
    least = share * sum(len(text) for text, *_ in lines)
    own = {k for k, n in held.items() if n >= least}
    own = {k for k in own if kind[k] == "article"} or own
    texts, weights = [], []
    for text, plain, inside in lines:
        scaled = any(id(e) in own for e in inside)
        if text or not scaled:
            texts.append(text)
            weights.append(boost * len(text) if scaled else plain * (1.0 if not own or any(e.name == "main" for e in inside) else outside))
    return texts, weights


def regions(sums: list[float], threshold: float) -> list[tuple[int, int]]:
    """(start, dive) of every rise of the window sums between the first one that surges and the last one that does."""
    out, surges, start, surged = [], [], None, False
    for i, s in enumerate([*sums, 0]):
        if s > 0:
            start = i if start is None else start
            surged |= s >= threshold
        elif start is not None:
            out.append((start, i))
            surges.append(surged)
            start, surged = None, False
    if not any(surges):
        return []
    return out[surges.index(True) : len(surges) - surges[::-1].index(True)]


def main_text(page: str | None, window: int = 2, surge: int = 130) -> str:
    if not page:
        return ""
    lines, weights = weigh(lines_of(page, window))
    if not any(weights):  # nothing but links
        weights = [float(len(text)) for text in lines]
    sums = [sum(weights[i : i + window]) for i in range(len(weights))]
    out = []
    for a, b in regions(sums, min(surge, max(sums, default=0))):
        while not weights[a]:  # the window reaches ahead of the rise
            a += 1
        out += [text for text in lines[a:b] if text]
    return "\n".join(out)


def _extract(window: int, surge: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            texts = [main_text(column[k].as_py(), window, surge) for k in range(batch.num_rows)]
            arrays = [batch.column(i) for i in range(batch.num_columns - 1)] + [pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names[:-1], "text"])

    return run


def extract(pages: DataFrame, html: str = "html", carry: tuple[str, ...] = ("page_id", "url"), window: int = 2, surge: int = 130) -> DataFrame:
    """``carry`` columns with text and n_chars (its code points)."""
    from pyspark.sql import types as T

    given = pages.select(*carry, F.col(html).alias("text"))
    out = given.mapInArrow(_extract(window, surge), T.StructType([*given.schema.fields[:-1], T.StructField("text", T.StringType())]))
    return out.withColumn("n_chars", F.length("text").cast("long"))
