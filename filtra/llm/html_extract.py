"""Main text of web pages as the maximum-scoring run of words and tags."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filtra.llm.common import columns_of, new_column, read

#: Pages with a marked article that the weights are learned on, at most (in expectation).
SAMPLE_PAGES = 4_000

BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frame h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p "
    "pre section select summary table tbody td tfoot th thead tr ul video audio".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not text of the page: it ends at their own end tag, whatever stands in it.
RAW = frozenset("script style textarea title template iframe svg xmp noembed noframes select canvas object audio video".split())
#: Elements nested deeper than this open no level of their own, as in browsers.
DEEPEST = 512
#: Elements that a sibling of the same kind closes.
_SIBLINGS = frozenset("p li option dt dd tr td th".split())

#: What is held about elements before any page is seen: log-odds that a word in them is main text.
SEMANTIC = {"nav": -4.0, "aside": -4.0, "footer": -4.0, "menu": -4.0, "form": -4.0, "button": -4.0, "header": -4.0, "nested": -3.0, "hidden": -6.0}
#: The same about words of class, id and role.
NAMED = dict.fromkeys(
    "ad ads adv advert adverts advertisement adsense sponsor sponsored promo banner cookie cookies consent gdpr notice notices "
    "notification alert popup modal overlay navbar nav navigation menu breadcrumb breadcrumbs pagination pager sidebar widget "
    "footer masthead topbar toolbar comment comments commentlist disqus replies related recommended share sharing social "
    "newsletter subscribe signup login contentinfo complementary skip copyright".split(),
    -4.0,
) | dict.fromkeys("search discussion respond side aside header disclaimer legal".split(), -1.0)
#: The same about what a block is like.
LIKE = {"links:all": -2.5, "links:most": -1.5, "starts:copyright": -3.0, "words:few": -0.5, "words:many": 1.0, "ends:sentence": 0.7, "block:h1": 1.0, "block:p": 0.5}
#: Being in an article (or main) element, and beside it on a page that has one.
PLACED = {"in": 2.5, "beside": -4.0}
#: Blocks for which what is held beforehand counts, and the limit of a learned weight.
PRIOR_BLOCKS, MOST = 50.0, 4.0

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(\"[^\"]*\"?|'[^']*'?|[^\s\"'>]+))?")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_COPYRIGHT = re.compile(r"©|\(c\)\s|copyright\b", re.I)
_STOPS = tuple(".!?…。！？\"'”’)")


def _tag_end(html: str, at: int, unclosed: set[str]) -> int:
    """Past the > that ends the tag begun before `at`; quoted values may hold >. -1: there is none.

    A quote that nothing closes is an ordinary character; `unclosed` remembers that for
    the rest of the page, so that no stretch is searched twice.
    """
    begin = at
    while True:
        close = html.find(">", at)
        if close < 0:
            return -1
        quotes = [q for q in (html.find(c, at, close) for c in "\"'" if c not in unclosed) if q >= 0]
        if not quotes:
            return close + 1
        first = min(quotes)
        if html[begin:first].rstrip()[-1:] != "=":  # not the beginning of a value
            at = first + 1
            continue
        end = html.find(html[first], first + 1)
        if end < 0:
            unclosed.add(html[first])
            at = first + 1
        else:
            at = end + 1


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """('text', characters, ''), ('open', tag, attributes), ('close', tag, '') in one pass; comments and RAW content vanish."""
    at, n = 0, len(html)
    unclosed: set[str] = set()
    missing: set[str] = set()
    while at < n:
        left = html.find("<", at)
        if left < 0:
            left = n
        if left > at:
            yield "text", html[at:left], ""
        at = left
        if at >= n:
            return
        if html.startswith("<!--", at):
            end = html.find("-->", at + 2)
            at = n if end < 0 else end + 3
            continue
        if html[at + 1 : at + 2] in ("!", "?"):
            end = html.find(">", at)
            at = n if end < 0 else end + 1
            continue
        close = html.startswith("</", at)
        name = _NAME.match(html, at + 1 + close)
        if name is None:
            yield "text", "<", ""
            at += 1
            continue
        end = _tag_end(html, name.end(), unclosed)
        if end < 0:  # a tag that never ends: nothing after it is text
            return
        tag, attrs = name[0].lower(), html[name.end() : end - 1]
        at = end
        if close:
            yield "close", tag, ""
            continue
        if tag in RAW:
            if tag not in missing and not (tag == "svg" and attrs.endswith("/")):
                stop = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
                if stop is None:
                    if tag in ("script", "style", "textarea", "title"):
                        return
                    missing.add(tag)
                else:
                    at = stop.end()
            continue
        yield "open", tag, attrs


@dataclass
class Block:
    """A stretch of text between block tags: its words, the tags before it, and what is known of its place."""

    text: str
    words: int
    tags: list[str]
    level: int  # 2 in an article, 1 in a main element only, else 0
    marks: list[tuple[int, str]]  # (element, mark) of the elements around it, within the container if it is in one
    like: list[str]


def _marks(tag: str, attrs: str, level: int) -> list[str]:
    """What an element's tag and attributes say about what stands in it."""
    out = [tag] if tag in SEMANTIC and not (tag == "header" and level) else []
    if attrs.strip():
        a = {k.lower(): (v or "").strip("\"'") for k, v in _ATTR.findall(attrs)}
        if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(a.get("style", "")):
            out.append("hidden")
        named = {p.lower() for k in ("class", "id", "role") if k in a for p in _PIECE.findall(a[k])}
        out += [f".{p}" for p in sorted(named)]
    return out


def _like(text: str, words: int, linked: int, tag: str) -> list[str]:
    out = [f"block:{tag}"]
    if linked:
        out.append("links:all" if linked >= words else "links:most" if 2 * linked > words else "links:some")
    out.append("words:few" if words < 5 else "words:some" if words < 20 else "words:many")
    if text.endswith(_STOPS):
        out.append("ends:sentence")
    if words < 30 and _COPYRIGHT.match(text):
        out.append("starts:copyright")
    return out


def blocks(html: str) -> list[Block]:
    """The blocks with words of a page, in page order.

    Elements left open close with their parent; a stray end tag closes nothing.
    """
    out: list[Block] = []
    stack: list[tuple[str, int]] = []  # tag, and how many marks stood before it
    marks: list[tuple[int, str]] = []
    opened: Counter[str] = Counter()  # how often each tag is open
    deeper: Counter[str] = Counter()  # open elements beyond DEEPEST
    inner = [0]  # where the marks of the outermost container begin
    parts: list[str] = []
    tags: list[str] = []
    linked = serial = 0

    def flush(tag: str) -> None:
        nonlocal linked, tags
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            words = text.count(" ") + 1
            level = 2 if opened["article"] else 1 if opened["main"] else 0
            out.append(Block(text, words, tags, level, marks[inner[-1] :], _like(text, words, linked, tag)))
            tags = []
        linked = 0

    def around() -> str:
        return next((t for t, _ in reversed(stack) if t in BLOCKS), "body")

    def shut() -> None:
        tag, before = stack.pop()
        opened[tag] -= 1
        del marks[before:]
        if tag in ("article", "main"):
            inner.pop()

    for kind, what, attrs in tokens(html):
        if kind == "text":
            text = unescape(what)
            parts.append(text)
            if opened["a"]:
                linked += len(text.split())
            continue
        if what in BLOCKS:
            flush(around())
        tags.append(what)
        if kind == "close":
            if deeper[what]:
                deeper[what] -= 1
            elif opened[what]:
                while stack[-1][0] != what:
                    shut()
                shut()
            continue
        if what in VOID or attrs.endswith("/") and what not in BLOCKS:
            continue
        if what in _SIBLINGS and stack and stack[-1][0] == what:
            shut()  # its end tag may be left out
        if len(stack) >= DEEPEST:
            deeper[what] += 1
            continue
        serial += 1
        before = len(marks)
        level = 2 if opened["article"] else 1 if opened["main"] else 0
        found = _marks(what, attrs, level)
        if what == "article" and opened["article"]:
            found.append("nested")
        if what in ("article", "main"):
            # of an article within a main element the article is the container; of nested ones the outer
            inner.append(inner[-1] if what == "article" and opened["article"] or what == "main" and level else before)
        stack.append((what, before))
        opened[what] += 1
        marks += [(serial, m) for m in found]
    flush(around())
    return out


@dataclass
class PageWeights:
    """Log-odds of being main text for marks, placement and likeness, and each tag's cost (`other`: never seen)."""

    weight: dict[str, float] = field(default_factory=lambda: {**SEMANTIC, **{f".{k}": v for k, v in NAMED.items()}, **LIKE, **PLACED})
    tag: dict[str, float] = field(default_factory=dict)
    other: float = 0.1

    @classmethod
    def learn(cls, inside: Counter, outside: Counter) -> PageWeights:
        """From how often each feature (and each tag, with < before it) stands within and beside marked articles; key '': all.

        A feature's weight is the mean of its observed log-odds and of what is held
        beforehand, which counts as PRIOR_BLOCKS blocks. A tag's cost is its log-odds
        of standing outside, between 0.05 and 1.
        """
        out = cls()
        n_in, n_out = inside[""], outside[""]
        if not n_in or not n_out:
            return out
        for f in {*inside, *outside} - {""}:
            odds = math.log((inside[f] + 0.5) / (n_in + 1)) - math.log((outside[f] + 0.5) / (n_out + 1))
            if f.startswith("<"):
                out.tag[f[1:]] = min(1.0, max(0.05, -0.2 * odds))
            else:
                n = inside[f] + outside[f]
                mean = (n * odds + PRIOR_BLOCKS * out.weight.get(f, 0.0)) / (n + PRIOR_BLOCKS)
                out.weight[f] = min(MOST, max(-MOST, mean))
        return out

    def word_scores(self, page: list[Block]) -> list[float]:
        """The score of a word of each block, from -1 to 1.

        Marks of an element that holds over half of the page's words say nothing. What a
        block is like cannot outweigh that it stands in the article; marks can.
        """
        total = sum(b.words for b in page)
        best = max((b.level for b in page), default=0)
        held: Counter[int] = Counter()
        for b in page:
            for element in {e for e, _ in b.marks}:
                held[element] += b.words
        get, out = self.weight.get, []
        for b in page:
            s = sum(min(0.0, get(m, 0.0)) for m in {m for e, m in b.marks if 2 * held[e] <= total})
            like = sum(get(f, 0.0) for f in b.like)
            if best:
                like = min(0.5, max(-1.5, like))
                s += get("in", 0.0) if b.level == best else get("beside", 0.0)
            out.append(min(2.0, max(-2.0, s + like)) / 2)
        return out


def best_run(gains: list[float], costs: list[float]) -> tuple[int, int]:
    """(first, past-last) of the run with the largest sum of gains, less the costs between its members, in one scan.

    costs[i] lies between i - 1 and i. Of equal sums the first; no positive gain: (0, 0).
    """
    best, run, start, found = 0.0, 0.0, 0, (0, 0)
    for i, gain in enumerate(gains):
        run -= costs[i]
        if run <= 0:
            run, start = 0.0, i
        run += gain
        if run > best:
            best, found = run, (start, i + 1)
    return found


def extract(html: str | None, weights: PageWeights) -> str:
    """The main text of a page: blocks in page order, one a line, white space made single.

    Words score by their block, tags cost, and the run of blocks with the largest sum
    is found in one scan. Blocks of a negative score within the article are no part of
    the sequence, and two blocks of the article are parted by less than a word's score,
    so that no block of it is lost behind what stands between; blocks of a negative
    score within the run are left out. Null, empty and wordless pages give an empty
    string, as do pages on which no word scores.
    """
    page = blocks(html or "")
    scores = weights.word_scores(page)
    top = max((b.level for b in page), default=0)
    kept, gains, costs, cost, last = [], [], [], 0.0, None
    for b, s in zip(page, scores):
        cost += sum(weights.tag.get(t, weights.other) for t in b.tags)
        if top and b.level == top:
            if s < 0:
                continue
            if last == top:
                cost = min(cost, 0.9 * s * b.words)
        kept.append((b.text, s))
        gains.append(s * b.words)
        costs.append(cost)
        cost, last = 0.0, b.level
    low, high = best_run(gains, costs)
    return "\n".join(text for text, s in kept[low:high] if s >= 0)


def learn_weights(pages: DataFrame, html_col: str = "html", rows: int = SAMPLE_PAGES, id_col: str = "page_id") -> PageWeights:
    """Weights from pages whose article or main element marks the content, at most about `rows`, chosen by id hash."""
    share = min(1.0, rows / max(1, pages.count()))
    some = pages.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < int(share * (1 << 20)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[tuple[str, bool]] = Counter()
        for batch in batches:
            for html in batch.column(0).to_pylist():
                page = blocks(html or "")
                top = max((b.level for b in page), default=0)
                for b in page if top else ():
                    seen = {m for _, m in b.marks} | set(b.like) | {f"<{t}" for t in b.tags}
                    count.update((f, b.level == top) for f in (*seen, ""))
        yield pa.RecordBatch.from_arrays(
            [pa.array([t for t, _ in count], pa.string()), pa.array([i for _, i in count], pa.bool_()), pa.array(count.values(), pa.int64())],
            names=["feature", "inside", "n"],
        )

    # a name that few blocks have says little; what is left is bounded by the sample
    found = some.select(html_col).mapInArrow(run, "feature string, inside boolean, n long").groupBy("feature").agg(
        *[F.sum(F.when(F.col("inside") == flag, F.col("n")).otherwise(0)).alias(name) for flag, name in ((True, "i"), (False, "o"))]
    )
    inside, outside = Counter(), Counter()
    for r in found.where("i + o >= 5").collect():
        inside[r["feature"]], outside[r["feature"]] = r["i"], r["o"]
    return PageWeights.learn(inside, outside)


def extract_text(pages: DataFrame, weights: PageWeights, html_col: str = "html", out: str = "text") -> DataFrame:
    """pages with a new string column `out`. No shuffle; repeated rows get the same text each.

    Other columns stay as they are; one called as `out` raises a ValueError.
    """
    names = pages.columns
    wide = pages.select(*columns_of(pages), F.lit(None).cast("string").alias(new_column(pages, out)))
    html_at = names.index(html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h.as_py(), weights) for h in batch.column(html_at)]
            yield batch.set_column(len(names), out, pa.array(texts, pa.string()))

    return wide.mapInArrow(run, wide.schema)


def op8_html(spark, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = extract_text(pages, learn_weights(pages))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
