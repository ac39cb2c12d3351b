"""HTML extraction by deduction of a host's template from equivalence classes of tokens."""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold.tables import table

#: A token belongs to a host's template if this share of the host's pages has it; fewer pages give no template.
SHARE, LEAST_PAGES = 0.5, 3

#: Elements that begin a block, that have no content, whose content is no text, that are never the
#: main text, and that hold it; and words in class, id or role that say the same.
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea iframe svg math object select title xmp noembed noframes canvas audio video".split())
DROPPED = set("nav header footer aside button menu dialog head script style noscript template textarea iframe svg math object select title".split())
MAIN = set("article main".split())
DROPPED_NAMES = re.compile(r"(?:^|[-_])(?:ad|ads|advert\w*|adbox|banner|sponsor\w*|promo\w*|cookie\w*|consent|notice\w*|gdpr|popup|modal|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|aside|footer|foot|header|masthead|comments?|disqus|replies|respond|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|search|pagination|pager|widget\w*|toolbar|skip)(?:$|[-_])")
MAIN_NAMES = re.compile(r"(?:^|[-_])(?:article|articlebody|main|content|post|entry|story|body-?text)(?:$|[-_])")

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?][^>]*(?:>|\Z)|<(?=/?[a-zA-Z])[^>]*\Z|([^<]+|<)", re.S)
_NAMES = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
#: Elements whose start ends an open one of the same list.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


Path = tuple[str, ...]


def events_of(page: str) -> list[tuple[Path, str | None]]:
    """The elements and text blocks of a page in their order: an element's path and None, a block's path and its text.

    A path's step is the element's name with its class, id and role words. White space inside a block is one blank,
    character references are decoded. A paragraph ends where a block starts, unclosed elements where their parent ends.
    """
    out: list[tuple[Path, str | None]] = []
    stack: list[tuple[str, str]] = []
    text: list[str] = []
    path: Path = ()
    at, end = 0, len(page)

    def flush() -> None:
        if text:
            words = "".join(text).split()
            if words:
                out.append((path, " ".join(words)))
            text.clear()

    def pop_to(depth: int) -> None:
        nonlocal path
        if any(name in BLOCKS for name, _ in stack[depth:]):
            flush()
        del stack[depth:]
        path = tuple(step for _, step in stack)

    while at < end:
        m = _TOKEN.match(page, at)
        if m is None:  # a tag whose quotes never end
            close = page.find(">", at)
            at = end if close < 0 else close + 1
            continue
        at = m.end()
        if m[4] is not None:
            text.append(entities.unescape(m[4]))
            continue
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    pop_to(depth)
                    break
            else:
                if name in BLOCKS:
                    flush()
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in BLOCKS:
            flush()
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "p"), None)
            if depth is not None and not any(n in ("table", "td", "li", "button") for n, _ in stack[depth:]):
                pop_to(depth)
        for other in _CLOSES.get(name, ()):
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == other), None)
            if depth is not None and not any(n in ("ul", "ol", "table", "dl", "select") for n, _ in stack[depth:]):
                pop_to(depth)
        names = " ".join(filter(None, ((k.lower() if k.lower() in ("hidden",) else "") + " " + (a or b or c) if k.lower() != "aria-hidden" else ("hidden" if (a or b or c) == "true" else "") for k, a, b, c in _NAMES.findall(m[3])))).lower().split() if m[3] and not m[3].isspace() else []
        step = ".".join([name, *names])
        out.append(((*path, step), None))
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if name in VOID or m[3].endswith("/") and name in VOID:
            continue
        stack.append((name, step))
        path = (*path, step)
    flush()
    return out


@lru_cache(1 << 16)
def dropped(path: Path) -> bool:
    """Some element above is one that never holds main text, by its name, or is hidden."""
    return any(name in DROPPED or "hidden" in words for name, *words in (step.split(".") for step in path))


@lru_cache(1 << 16)
def doubted(path: Path) -> tuple[Path, ...]:
    """The paths of the elements above that hold no main text, by their words or as forms, unless they wrap the page's."""
    steps = [step.split(".") for step in path]
    return tuple(path[:i] for i, (name, *words) in enumerate(steps, 1) if name == "form" or name not in MAIN and name not in ("html", "body") and any(DROPPED_NAMES.search(w) for w in words))


def wrappers(events: list[tuple[Path, str | None]], template: Template) -> set[Path]:
    """Of the doubted elements, those that wrap the page: they hold most of the text of the host's pages (of this page if
    the template lacks them) and, where the page has elements that name the article, one of those."""
    main = {path[:i] for path, text in events if text is None and path[-1].split(".")[0] in MAIN and not dropped(path) for i in range(len(path))}
    size: dict[Path, int] = defaultdict(int)
    for path, text in events:
        if text is not None and not dropped(path):
            for i in range(len(path) + 1):
                size[path[:i]] += len(text)
    found = set()
    for path in {x for at, text in events if text is not None for x in doubted(at)}:
        held, of = (template.chars[_slot(path)], template.chars[0]) if _slot(path) in template.chars else (size[path], size[()])
        if 2 * held > of and (not main or path in main):
            found.add(path)
    return found


@lru_cache(1 << 16)
def holder(path: Path) -> int:
    """The length of the path down to the innermost element that names the article, by its name or else its words; 0 if none."""
    steps = [step.split(".") for step in path]
    named = [i for i, (name, *_) in enumerate(steps, 1) if name in MAIN]
    worded = [i for i, (name, *words) in enumerate(steps, 1) if name not in ("html", "body") and any(MAIN_NAMES.search(w) for w in words)]
    return max(named or worded, default=0)


def host_of(url: str | None) -> str:
    m = re.match(r"\s*[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#]*)", url or "")
    return m[1].lower() if m else ""


def _number(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


@lru_cache(1 << 16)
def _slot(path: Path) -> int:
    return _number(*path) if path else 0


def tokens_of(events: list[tuple[Path, str | None]]) -> list[tuple[int, int]]:
    """The tokens of a page in their order: (number of the path, 0) of an element, (the path it is in, of the text) of a block."""
    return [(_slot(path), 0 if text is None else _number(text) or 1) for path, text in events if text is None or not dropped(path)]


def occurrence_vectors(pages: DataFrame) -> DataFrame:
    """(host, slot, text, up, pages, high, low, place, chars): in how many of the host's pages a token is, a fingerprint
    of its occurrence vector (two sums over pages of a hash of page and count), the sum of its first places in them and
    the characters of text in it. `up` is the element above.

    Tokens are elements, by their paths, and whole blocks of text, in the article or not. The fingerprint is summed up
    as an aggregate is, first in each task, so a host with a third of all pages is no trouble; repeated rows don't
    cancel out. The token (0, 0) is in every page.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got: dict[tuple[str, int, int], list[int]] = {}
            for page_id, url, page in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                host, mark = host_of(url), f"{page_id}\0{url or ''}"
                events = events_of(page or "")
                tokens: dict[tuple[int, int], list[int]] = {(0, 0): [0, 1, 0, 0]}
                above = {_slot(path): _slot(path[:-1]) for path, text in events if text is None}
                for place, (slot, text) in enumerate(tokens_of(events), 1):
                    tokens.setdefault((slot, text), [slot if text else above[slot], 0, place, 0])[1] += 1
                for path, text in events:
                    if text is not None and not dropped(path):
                        for key in ((_slot(path), _number(text) or 1), *((_slot(path[:i]), 0) for i in range(len(path) + 1))):
                            tokens[key][3] += len(text)
                marks: dict[int, int] = {}
                for (slot, text), (up, n, place, chars) in tokens.items():
                    if n not in marks:
                        marks[n] = _number(mark, str(n))
                    x = got.setdefault((host, slot, text), [up, 0, 0, 0, 0, 0])
                    for i, v in enumerate((1, marks[n] >> 32, marks[n] & 0xFFFFFFFF, place, chars), 1):
                        x[i] += v
            keys, values = list(got), list(got.values())
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), *(pa.array([k[i] for k in keys], pa.int64()) for i in (1, 2)), *(pa.array([v[i] for v in values], pa.int64()) for i in range(6))], names=["host", "slot", "text", *_SUMMED])

    schema = "host string, slot long, text long, " + ", ".join(f"{c} long" for c in _SUMMED)
    rows = pages.select("page_id", "url", "html").mapInArrow(run, schema)
    return rows.groupBy("host", "slot", "text").agg(F.first("up").alias("up"), *[F.sum(c).alias(c) for c in _SUMMED[1:]])


_SUMMED = ["up", "pages", "high", "low", "place", "chars"]


def deduced(tokens: list[dict]) -> dict | None:
    """A host's template from its frequent tokens: its classes, each a list of tokens in their order, and the characters in each element.

    Tokens with one occurrence vector are an equivalence class; elements of one vector in different classes are
    different classes, so that each nests in the class of the nearest element above of another vector. A text belongs
    to the class of the nearest element above it that has its vector: it is there as often as this part of the
    template. A frequent text without such an element is data. None if all text of the host would be template: pages
    that don't differ tell nothing.
    """
    vector = {t["slot"]: (t["pages"], t["high"], t["low"]) for t in tokens if not t["text"]}
    up = {t["slot"]: t["up"] for t in tokens if not t["text"] and t["slot"]}
    known: dict[int, tuple] = {}

    def class_of(slot: int) -> tuple:
        if slot not in known:
            above = up.get(slot)
            while above is not None and vector[above] == vector[slot]:
                above = up.get(above)
            known[slot] = (vector[slot], None if above is None else class_of(above))
        return known[slot]

    classes: dict[tuple, list[dict]] = defaultdict(list)
    total, fixed = 0, 0
    for t in tokens:
        at = t["slot"]
        if not t["text"]:
            classes[class_of(at)].append(t)
            total = t["chars"] if not at else total
            continue
        while at is not None and vector.get(at) != (t["pages"], t["high"], t["low"]):
            at = up.get(at)
        if at is not None:
            classes[class_of(at)].append(t)
            fixed += t["chars"]
    if fixed == total:
        return None
    ordered = [[(t["slot"], t["text"]) for t in sorted(c, key=lambda t: (t["place"], t["slot"], t["text"])) if t["slot"] or t["text"]] for c in classes.values()]
    return {"classes": [c for c in ordered if c], "chars": [(t["slot"], t["chars"]) for t in tokens if not t["text"]]}


def templates(pages: DataFrame, share: float = SHARE, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, template): for each host its deduced() template as JSON.

    Tokens that `share` of the host's pages have can be the template. A page has few tokens that half of the pages
    share, so a template is bounded by a page's size. Hosts of fewer than `least_pages` have none.
    """
    vectors = occurrence_vectors(pages)
    counts = vectors.where("slot = 0 and text = 0").select("host", F.col("pages").alias("n"))
    frequent = vectors.join(counts, "host").where((F.col("n") >= least_pages) & (F.col("pages") >= share * F.col("n")))
    tokens = frequent.groupBy("host").agg(F.collect_list(F.struct("slot", "text", *_SUMMED)).alias("tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [deduced(tokens) for tokens in batch.column("tokens").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array([x and json.dumps(x) for x in found], pa.string())], names=["host", "template"])

    return tokens.mapInArrow(run, "host string, template string")


class Template:
    """A host's classes, ready to be held against a page."""

    def __init__(self, template: str | None) -> None:
        found = json.loads(template) if template else {"classes": [], "chars": []}
        self.classes = [[tuple(t) for t in c] for c in found["classes"]]
        self.of = {t: i for i, c in enumerate(self.classes) for t in c}
        self.chars = dict(map(tuple, found["chars"]))

    def fixed(self, tokens: list[tuple[int, int]]) -> set[tuple[int, int]]:
        """The page's tokens that are template: those of classes whose tokens come in the class's order, once or repeatedly."""
        seen: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t in tokens:
            if t in self.of:
                seen[self.of[t]].append(t)
        return {t for i, found in seen.items() for t in self.classes[i] if found == self.classes[i] * (len(found) // len(self.classes[i]))}


def main_text(page: str | None, template: Template) -> str:
    """The main text of a page: what lies in any slot between the tokens of the template, so is data.

    Blocks under elements for menus, headers, footers, notices, adverts, forms and comments are dropped (class words and
    forms need to be less than a wrapper of the page, see wrappers()), and so are texts that belong to a class of the template. An element that names the article is a hint: if it has data, its
    fixed texts (a headline that all pages have) stay with them. A page that has no data, or whose host has no template,
    keeps what such elements hold.
    """
    events = events_of(page or "")
    kept = [(path, text) for path, text in events if text is not None and not dropped(path)]
    if any(doubted(path) for path, _ in kept):
        wraps = wrappers(events, template)
        kept = [(path, text) for path, text in kept if wraps.issuperset(doubted(path))]
    fixed = template.fixed(tokens_of(events))
    data = [(_slot(path), _number(text) or 1) not in fixed for path, text in kept]
    regions = {path[: holder(path)] for (path, _), new in zip(kept, data, strict=True) if new and holder(path)}
    if not any(data) or regions and not template.classes:
        return "\n\n".join(text for path, text in kept if holder(path))
    return "\n\n".join(text for (path, text), new in zip(kept, data, strict=True) if new or path[: holder(path)] in regions)


def extracted(pages: DataFrame, share: float = SHARE, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of `pages` (page_id, url, html).

    Two passes: tokens' occurrence vectors over all pages of each host, then extraction, for which a page is joined
    with its host's template; Spark splits the hot host's side. Null or empty html has an empty text; a null or
    relative url is of host "". Repeated rows stay; no rows give none. Broken markup is read as far as it goes.
    """
    kind, url = dict(pages.dtypes)["page_id"], F.coalesce("url", F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^\s*[a-zA-Z][a-zA-Z0-9_+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))
    rows = pages.select("page_id", "url", "html", host.alias("host")).join(templates(pages, share, least_pages), "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, Template] = {}
        for batch in batches:
            texts = []
            for page, template in zip(batch.column("html").to_pylist(), batch.column("template").to_pylist(), strict=True):
                if template not in known:
                    known.clear() if len(known) > 256 else None
                    known[template] = Template(template)
                texts.append(main_text(page, known[template]))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.select("page_id", "url", "html", "template").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
