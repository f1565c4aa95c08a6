"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block element. Weighted text lengths are summed over windows of WINDOW lines. Text
begins where a window's sum surges to SURGE of the page's middle sum and ends where the sums dive below it, so a page of
short paragraphs has a low bound and one of long ones a high bound, and an advert of several lines inside the text doesn't end it.

Marks weigh lines. Each element around a line that names itself navigation, notice, advert, comments and the like by class,
id or role divides the line's weight by MARKED, and so does a form; so a whole article in a wrapper with a name like
"share-enabled" is found, as nothing else weighs more. Outside an article that holds half of the unmarked text, lines weigh
what they have over OUTSIDE characters. Lines mostly of links outside an article weigh nothing, nor do those in elements
that are no text by their kind (nav, header, footer, aside, ...). First headings weigh HEADING times their length. Between
surge and dive, the lines with the marks that weigh most together stay, and those with fewer; of marked lines only those in
the same marked element. Scripts, styles and other elements without readable text are no lines.

Null and empty pages have an empty text, repeated pages repeated texts. Pages are independent and take time in proportion
to their length; other columns than page_id, url and html are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 5
SURGE = 0.1
MARKED = 8
HEADING = 4
OUTSIDE = 80
NEVER = 100
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
SKIPPED = frozenset("nav header footer aside form menu dialog button select option textarea script style noscript template svg iframe object head title canvas audio video map math label input fieldset datalist search".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg".split())
NOISE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|banner|sponsor(?:ed)?|promo(?:tion)?|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|signup|login|comments?|disqus|replies|respond|nav(?:bar|igation)?|menus?|breadcrumbs?|pagination|pager|sidebars?|side|widgets?|related|recommended|share|sharing|social|footer|masthead|header|toolbar|search)(?:$|[\s_-])",
    re.I,
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
NEGATED = re.compile(r"(?:no|non|not|without|has|with|hide|hidden)[_-]", re.I)
NAME = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)")
QUOTE_OR_END = re.compile(r"[>\"']")
UNFINISHED = re.compile(r"\s*<[/!?A-Za-z]")
ATTRIBUTE = re.compile(r"""([A-Za-z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
NEXT_TAG = re.compile(r"</?[A-Za-z]")
NEXT_BLOCK = re.compile(rf"</?(?:{'|'.join(sorted(BLOCKS))})(?=[\s/>])", re.I)
SELF_CLOSED = re.compile(r"(?:^|[\s\"'])/\Z")  # a slash after an unquoted value belongs to the value
CLOSED_BY_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6 dt dd li option".split())


def _marks(tag: str, attributes: str) -> int:
    """What an element adds to the marks of its text: by its kind enough that it is never main text (a form may hold a whole page), one by its names and roles."""
    if tag in SKIPPED:
        return 1 if tag == "form" else NEVER
    if not attributes or tag in ("html", "body", "main", "article"):
        return 0
    for name, *value in ATTRIBUTE.findall(attributes):
        name, text = name.lower(), next(filter(None, value), "")
        if name in ("class", "id") and any(NOISE.search(x) and not NEGATED.match(x) for x in text.split()) or name == "role" and text.lower() in ROLES or name == "aria-hidden" and text.lower() == "true":
            return 1
    return int(bool(re.search(r"(?:^|\s)hidden(?:\s|$)", attributes)))


class _Tags:
    """Finds tags from left to right; what a search hasn't found once is not searched for again."""

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in ">\"'"}
        self.unclosed: set[str] = set()

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(start, end, whether it closes, name, attributes) of the next tag; comments and declarations have no name."""
        page = self.page
        while (at := page.find("<", at)) >= 0 and at < self.last[">"] or at >= 0 and page.startswith("<!--", at):
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                return at, end + 3 if end >= 0 else len(page), False, "", ""
            if page[at + 1] in "!?":
                return at, page.index(">", at) + 1, False, "", ""
            if m := NAME.match(page, at):
                end = m.end()
                while end <= self.last[">"]:
                    q = QUOTE_OR_END.search(page, end)
                    if q[0] == ">":
                        return at, q.end(), bool(m[1]), m[2].lower(), page[m.end() : q.start()]
                    end = page.index(q[0], q.end()) + 1 if q.end() <= self.last[q[0]] else q.end()  # an unmatched quote is a character
            at += 1
        return None

    def raw_end(self, tag: str, at: int) -> int:
        """Where the text of a tag without markup ends; of one never closed, before the next tag (of code, the next block)."""
        if tag not in self.unclosed:
            if end := ENDS[tag].search(self.page, at):
                return end.end()
            self.unclosed.add(tag)
        end = (NEXT_BLOCK if tag in ("script", "style") else NEXT_TAG).search(self.page, at)
        return end.start() if end else len(self.page)


@dataclass
class Line:
    text: str
    marks: int  # elements around it that are marked as something else than text
    article: bool = False
    link_chars: int = 0
    heading: bool = False
    holder: int = 0  # the outermost marked element around it, 0 for none


def lines_of(page: str) -> list[Line]:
    out: list[Line] = []
    stack: list[tuple[str, int, bool, int]] = []  # tag, marks here, inside an article, the outermost marked element
    open_: Counter[str] = Counter()
    held: dict[tuple[int, int], list[str]] = {}  # by marks and holder
    marks = holder = elements = links = at = 0
    article = False
    link_chars: Counter[tuple[int, int]] = Counter()
    tags = _Tags(page)

    def close():
        for m in sorted(held):
            if text := " ".join(html.unescape("".join(held[m])).split()):
                out.append(Line(text, m[0], article, link_chars[m], open_["h1"] > 0, m[1]))
        held.clear()
        link_chars.clear()

    def put(text: str):
        if text:
            held.setdefault((marks, holder), []).append(text)
            link_chars[marks, holder] += len(text) if links else 0

    def pop() -> str:
        tag = stack.pop()[0]
        open_[tag] -= 1
        return tag

    while found := tags.next(at):
        start, end, closes, tag, attributes = found
        put(page[at:start])
        at = end
        if not tag:
            continue
        if tag == "br":
            put("\n")
            continue
        block = tag in BLOCKS or tag in SKIPPED
        if block:
            close()
            while stack and stack[-1][0] == "span":  # not closed in its line
                pop()
        if tag == "a":
            links = max(0, links + (-1 if closes else 1))
        if not closes and tag in SKIPPED and SELF_CLOSED.search(attributes):
            continue
        if not closes and tag in RAW:
            at = tags.raw_end(tag, at)
            continue
        if not closes and tag not in VOID:
            if tag in BLOCKS and stack and stack[-1][0] in CLOSED_BY_BLOCK and (stack[-1][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6") or stack[-1][0] == tag):
                pop()
            if block or tag == "span":
                up = stack[-1] if stack else ("", 0, False, 0)
                own, elements = _marks(tag, attributes), elements + 1
                stack.append((tag, up[1] + own, up[2] or tag in ("article", "main"), up[3] or (elements if own else 0)))
                open_[tag] += 1
        elif closes and open_[tag] > 0:
            while pop() != tag:
                pass
        _, marks, article, holder = stack[-1] if stack else ("", 0, False, 0)
    put("" if UNFINISHED.match(page[at:]) else page[at:])
    close()
    return out


def weights(lines: list[Line]) -> list[float]:
    """What every line brings to its windows: its length, MARKED times less for each mark; nothing if it is mostly links outside an article, and outside an article that holds at least as much unmarked text as the rest what it has over OUTSIDE characters."""
    own = [len(x.text) if x.marks < NEVER and (x.article or 2 * x.link_chars <= len(x.text)) else 0 for x in lines]
    plain = [n if not x.marks else 0 for n, x in zip(own, lines)]
    within = sum(n for n, x in zip(plain, lines) if x.article)
    if within and 2 * within >= sum(plain):
        own = [n if x.article else max(0, n - OUTSIDE) for n, x in zip(own, lines)]
    return [n * (HEADING if x.heading else 1) / MARKED**x.marks if n else 0.0 for n, x in zip(own, lines)]


def spans(counts: list[float]) -> list[tuple[int, int]]:
    """Lines from a surge of the windows' sums to the dive after it: the lines of neighbouring windows whose sums reach SURGE of the page's middle one."""
    sums = [sum(counts[i : i + WINDOW]) for i in range(max(1, len(counts) - WINDOW + 1))] if counts else []
    some = sorted(x for x in sums if x)
    surge = SURGE * some[len(some) // 2] if some else 0
    out: list[tuple[int, int]] = []
    for i, total in enumerate(sums):
        if total and total >= surge:
            end = min(i + WINDOW, len(counts))
            if out and i <= out[-1][1]:
                out[-1] = out[-1][0], end
            else:
                out.append((i, end))
    return out


def main_text(page: str | None) -> str:
    lines = lines_of(page or "")
    counts = weights(lines)
    found = spans(counts)
    held: Counter[tuple[int, int]] = Counter()
    for a, b in found:
        for x, n in zip(lines[a:b], counts[a:b]):
            held[x.marks, x.holder] += n
    most, holder = max(held, key=held.get, default=(0, 0))
    stays = lambda x: x.marks < most or x.marks == most and x.holder == holder
    return "\n".join(lines[i].text for a, b in found for i in range(a, b) if counts[i] and stays(lines[i]))


def extract(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, text, n_chars."""

    def run(batches):
        for batch in batches:
            texts = [main_text(page) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
