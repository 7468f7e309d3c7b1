"""Main text of web pages by tag-path ratios.

A page is cut into blocks: text between the starts and ends of block elements. A block's path names
the block elements it stands in, from the root, each with its class and id; inline elements leave
paths as they are, so that an unclosed ``<b>`` changes nothing. For every path of a page:

* length ratio: code points outside links per block,
* punctuation ratio: sentence punctuation outside links per block.

Both ratios, as series over the blocks in page order, are smoothed with a Gaussian of radius 1 and
fused (geometric mean of each over the page's mean). A path's score is the mean over its blocks; paths
that reach THRESHOLD are content, and their blocks make the text. Elements that never hold content
(scripts, styles, head, navigation, forms ...) and elements whose class, id or role names boilerplate
(advert, cookie, sidebar, comments ...) weigh nothing; neither do paths made mainly of links. If the
page has an ``article`` or ``main`` with content in it, only paths inside compete, headings and short
paragraphs beside selected paths of that element included, and so are lists, tables, quotations and figures
beside them with all that they hold but paths made mainly of links.

A name like "market-share" joins a word that may mean boilerplate (AMBIGUOUS) with one that does not: within an
article such an element is boilerplate only if it is short, has hardly any punctuation or is mostly links.

Null and empty pages give an empty text. Markup that breaks off, unclosed elements, stray ends and
unquoted attributes are read as browsers do in outline; nothing is capped.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lcarank.llm.common import chunks, tidy

THRESHOLD, MOSTLY_LINKS = 0.2, 0.5

BLOCKS = frozenset("""html body main article section header footer nav aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd
table caption thead tbody tfoot tr td th blockquote pre figure figcaption form fieldset legend details summary address
hgroup center menu dialog search frameset noframes option select hr""".split())
#: Elements whose text is no page content; those of RAW hold no markup either.
RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes svg math object canvas".split())
NEVER = frozenset("head nav aside footer form fieldset select option button menu dialog search label datalist audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Starts of these end an open p; an li, dt, dd, tr, td, th or option ends the one before it.
SIBLINGS = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option",
            "thead": "thead tbody tfoot tr td th", "tbody": "thead tbody tfoot tr td th", "tfoot": "thead tbody tfoot tr td th"}
SCOPES = frozenset("ul ol dl table select".split())
BOILERPLATE = frozenset("""ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner
cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup paywall
sidebar side rail menu nav navbar navigation breadcrumb breadcrumbs toolbar masthead footer foot copyright legal
comment comments commentlist disqus reply replies respond discussion responses related recommended recommendations more share sharing social
widget widgets login register search pagination pager tagcloud skip hidden""".split())
#: Of these words, those that other names have as well; words that say nothing about what an element holds.
AMBIGUOUS = frozenset("""share sharing social legal more side rail notice notices alert promo promotion banner related recommended recommendations
response responses discussion search register login hidden skip foot copyright sponsor sponsored subscription menu reply replies""".split())
GENERIC = frozenset("""box wrap wrapper container inner outer block list section area bar item items title body content contents links link button
buttons btn icon icons group row col column panel top bottom left right main post article page site entry the and of js is has""".split())
#: What a doubtful element of an article must hold to stay: code points, sentence punctuation, at most this share in links.
LONG_ENOUGH, MARKS_ENOUGH, FEW_LINKS = 80, 2, 0.3
#: Elements inside which an article goes on.
INNER = frozenset("ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption p div h1 h2 h3 h4 h5 h6 details summary".split())
CONTAINERS = frozenset("ul ol dl table blockquote figure details".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
PUNCTUATION = re.compile(r"[.,;:!?。、，！？；：…।؟،]")

_TAG = re.compile(r"<(?:(!--)|(/?)([A-Za-z][^\s/>]*)|([!?]))")
_QUOTE = re.compile(r"[\"'>]")
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden)(?![^\s=/>])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _tag_end(page: str, at: int) -> int:
    """Index of the ``>`` that ends a tag, beyond quoted values; a quote that never closes is no quote."""
    first = page.find(">", at)
    if first < 0:
        return -1
    if '"' not in (inside := page[at:first]) and "'" not in inside:
        return first
    quote = ""
    for m in _QUOTE.finditer(page, at):
        c = m.group()
        if quote:
            if c == quote:
                quote = ""
        elif c == ">":
            return m.start()
        elif page[m.start() - 1:m.start()] == "=" or page[at:m.start()].rstrip().endswith("="):
            if page.find(c, m.end()) < 0:
                return first
            quote = c
    return first


NO, MAYBE, YES = 0, 1, 2


def _is_boilerplate(name: str, attributes: str) -> int:
    """Whether an element's attributes say so: NO, MAYBE (by a name that may mean something else) or YES."""
    if not attributes or attributes.isspace():
        return NO
    found = NO
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return YES
        if key == "role" and value.strip().lower() in ROLES:
            return YES
        if key in ("class", "id") and name not in ("html", "body", "main", "article"):
            for part in value.split():
                words = {w.lower() for w in _NAME.findall(part)}
                if said := words & BOILERPLATE:
                    if not (said <= AMBIGUOUS and words - BOILERPLATE - GENERIC):
                        return YES
                    found = MAYBE
    return found


class Path:
    """A root-to-leaf tag path: its last element, and the path without it. One object per path of a page."""

    __slots__ = ("name", "parent", "below")

    def __init__(self, name: str = "", parent: Path | None = None):
        self.name, self.parent = name, parent
        self.below: dict[str, Path] = {}

    def down(self, name: str, marks: str) -> Path:
        key = f"{name}.{marks}"
        if key not in self.below:
            self.below[key] = Path(name, self)
        return self.below[key]


class Block:
    __slots__ = ("path", "parts", "linked", "dropped", "article", "doubt")

    def __init__(self, path: Path, dropped: bool, article: bool, doubt: int):
        self.path, self.dropped, self.article, self.doubt = path, dropped, article, doubt
        self.parts: list[str] = []
        self.linked = 0


def blocks_of(page: str) -> list[tuple[Path, str, int, bool, bool]]:
    """(path, text, code points in links, dropped, in an article) of the blocks with text."""
    done: list[Block] = []
    # name, path, dropped, article, number of the doubtful element around (0: none)
    stack: list[tuple[str, Path, bool, bool, int]] = [("", Path(), False, False, 0)]
    open_names: Counter[str] = Counter()
    current, in_link, at, n, doubts = Block(stack[0][1], False, False, 0), 0, 0, len(page), 0

    def close(depth: int) -> None:
        for x in stack[depth:]:
            open_names[x[0]] -= 1
        del stack[depth:]

    def cut() -> None:
        nonlocal current
        if current.parts:
            done.append(current)
        _, path, dropped, article, doubt = stack[-1]
        current = Block(path, dropped, article, doubt)

    def add(text: str) -> None:
        if text:
            plain = html.unescape(text) if "&" in text else text
            current.parts.append(plain)
            if in_link:
                current.linked += len(plain)

    while at < n:
        m = _TAG.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at:m.start()])
        if m[1]:
            end = page.find("-->", m.end() - 2)
            at = n if end < 0 else end + 3
            continue
        end = _tag_end(page, m.end())
        if end < 0:
            break  # the page breaks off inside a tag
        at = end + 1
        if m[4]:
            continue
        name = m[3].lower()
        if m[2]:
            if name == "a":
                in_link = 0
            elif name in BLOCKS or name in NEVER:
                for depth in range(len(stack) - 1, 0, -1) if open_names[name] else ():
                    if stack[depth][0] == name:
                        close(depth)
                        break
                    if stack[depth][0] in SCOPES and name in SIBLINGS:
                        break
                cut()
            elif name == "br":
                current.parts.append(" ")
            continue
        attributes = page[m.end():end]
        if name in RAW:
            if not attributes.endswith("/"):
                ended = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
                at = n if ended is None else max(at, (page.find(">", ended.end()) + 1) or n)
            if name != "svg" and name != "math":
                current.parts.append(" ")
            continue
        if name in VOID and name != "hr":
            if name == "br":
                current.parts.append(" ")
            continue
        if name == "a":
            in_link = 1
            continue
        if name not in BLOCKS and name not in NEVER:
            continue
        if name == "hr":
            cut()
            continue
        own = SIBLINGS.get(name, "").split()
        for depth in range(len(stack) - 1, 0, -1) if own else ():
            if stack[depth][0] in own:
                close(depth)
                break
            if stack[depth][0] in SCOPES:
                break
        for depth in range(len(stack) - 1, 0, -1):  # a block element ends an open paragraph
            if stack[depth][0] == "p":
                close(depth)
                break
            if stack[depth][0] not in HEADINGS:
                break
        _, path, dropped, article, doubt = stack[-1]
        said = _is_boilerplate(name, attributes)
        dropped = dropped or name in NEVER or name == "header" and not article or said == YES or said == MAYBE and not article
        if said == MAYBE and not doubt:
            doubts += 1
            doubt = doubts
        marks = " ".join(sorted(x.lower() for m in _ATTRIBUTE.finditer(attributes) if m[1].lower() == "class" for x in (m[2] or m[3] or m[4] or "").split()))
        stack.append((name, path.down(name, marks), dropped, article or name in ("article", "main"), doubt))
        open_names[name] += 1
        in_link = 0
        cut()
    if current.parts:
        done.append(current)
    texts = [" ".join("".join(b.parts).split()) for b in done]
    held: dict[int, list[int]] = defaultdict(lambda: [0, 0, 0])  # of doubtful elements: code points, marks, in links
    for b, text in zip(done, texts, strict=True):
        if b.doubt and not b.dropped:
            for i, x in enumerate((len(text), len(PUNCTUATION.findall(text)), b.linked)):
                held[b.doubt][i] += x
    stay = {d for d, (size, marks, linked) in held.items() if size >= LONG_ENOUGH and marks >= MARKS_ENOUGH and linked <= FEW_LINKS * size}
    return [(b.path, text, b.linked, b.dropped or bool(b.doubt) and b.doubt not in stay, b.article) for b, text in zip(done, texts, strict=True) if text]


def _smoothed(series: list[float]) -> list[float]:
    near = math.exp(-0.5)
    out = []
    for i, x in enumerate(series):
        total, weight = x, 1.0
        for j in (i - 1, i + 1):
            if 0 <= j < len(series):
                total, weight = total + near * series[j], weight + near
        out.append(total / weight)
    return out


def path_scores(blocks: list[tuple]) -> dict[Path, float]:
    """Fused, smoothed ratio of each path that may hold content."""
    sums: dict[Path, list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0, 0.0])
    for path, text, linked, dropped, _ in blocks:
        s = sums[path]
        if not dropped:
            s[0] += max(0, len(text) - linked)
            s[1] += len(PUNCTUATION.findall(text)) * (1 - min(1, linked / len(text)))
            s[2] += len(text)
        s[3] += 1
    open_ = [b for b in blocks if not b[3] and (s := sums[b[0]])[0] > (1 - MOSTLY_LINKS) * s[2]]
    if not open_:
        return {}
    lengths = _smoothed([sums[b[0]][0] / sums[b[0]][3] for b in open_])
    marks = _smoothed([(sums[b[0]][1] + 0.5) / sums[b[0]][3] for b in open_])
    mean_l, mean_m = sum(lengths) / len(lengths), sum(marks) / len(marks)
    fused: dict[Path, list[float]] = defaultdict(list)
    for b, x, y in zip(open_, lengths, marks, strict=True):
        fused[b[0]].append(math.sqrt(x / mean_l * (y / mean_m)))
    return {p: sum(x) / len(x) for p, x in fused.items()}


def main_text(page: str | None) -> str:
    if not page:
        return ""
    blocks = blocks_of(page)
    inside = [b for b in blocks if b[4] and not b[3]]
    if inside:
        blocks = [b for b in blocks if b[4]]
    scores = path_scores(blocks)
    chosen = {p for p, s in scores.items() if s >= THRESHOLD}
    parents = {p.parent for p in chosen}
    # Headings, and inside an article also short paragraphs, beside chosen paths.
    chosen |= {p for p in scores if p.parent in parents and p.parent is not None and (inside or p.name in HEADINGS)}
    if inside:
        chosen |= {p for p in scores if _within(p, parents)}
    return " ".join(text for path, text, _, dropped, _ in blocks if path in chosen and not dropped)


def _within(path: Path, parents: set[Path]) -> bool:
    """Whether a container that stands beside chosen paths holds this path."""
    p: Path | None = path
    while p is not None and p.name in INNER:
        if p.name in CONTAINERS and p.parent in parents:
            return True
        p = p.parent
    return False


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row of ``pages``: id, url, ``text`` and ``n_chars``."""

    source = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{html_col}`").cast("string").alias("html"), F.col(f"`{url_col}`").alias("url"))
    kind, url_kind = (source.schema[c].dataType.simpleString() for c in ("id", "url"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, urls = 0, batch.column(2)
            for ids, pages_ in chunks([batch]):
                texts = [main_text(p) for p in pages_]
                yield pa.RecordBatch.from_arrays([ids, urls.slice(row, len(ids)), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                                 names=["id", "url", "text", "n_chars"])
                row += len(ids)

    return source.mapInArrow(run, f"id {kind}, url {url_kind}, text string, n_chars long").withColumnRenamed("id", id_col)
