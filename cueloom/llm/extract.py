"""Main text of web pages: page structure, and a suffix array over the token streams of a host's pages."""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .staging import stage

#: Tokens of a repeated run, at least, and distinct pages that it must be on: so many, and this share of those compared.
RUN, PAGES, SHARE = 6, 3, 0.1
#: Share of a block's tokens that repeated runs must cover for it to be boilerplate.
COVERED = 0.8
#: Pages whose article or main elements share this much of their runs hold one text, near copies of each other.
SAME = 0.7
#: Pages that are compared at once, about: a host's pages are dealt into cells by a hash, which report the texts of their
#: runs; these are then counted over the whole host. The share is one of so many pages at most.
CELL = 128
#: Rows (host, number of cells) that are broadcast, at most.
BROADCAST_ROWS = 200_000

_NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_PLAIN = re.compile(r"[^>\"']*")
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "canvas", "object", "video", "audio")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split())
_NOISE = frozenset("nav footer aside form button select menu dialog head search fieldset".split())
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar note".split())
_NOISE_WORDS = frozenset("""adv advert adverts advertisement advertising sponsor sponsored promo cookie cookies consent gdpr popup modal overlay newsletter
    subscribe subscription signup sidebar navbar navigation breadcrumb breadcrumbs footer masthead comments disqus respond replies toolbar pagination pager login
    werbung anzeige anzeigen kommentare kommentar seitenleiste fusszeile kopfzeile publicite commentaire commentaires publicidad anuncio anuncios comentario
    comentarios""".split())
#: These are noise only beside other noise words or words that say where or what a part is: ``ad-box``, but not ``ad-hoc``.
_UNSURE = frozenset("ad ads banner notice notices alert menu nav comment share sharing social related recommended widget skip promotion pub hinweis aviso".split())
_NEUTRAL = frozenset("""top bottom left right main site page box list item items wrap wrapper container section area block bar buttons button links link icons inner
    outer content header footer module panel slot unit text title body column col row desktop mobile sticky fixed small large global primary secondary first
    last posts articles stories media to the js is""".split())
_ARTICLE_NOISE = frozenset("ad ads advert advertisement comment comments promo sponsored related reply".split())
_QUALIFIERS = frozenset("has with no without".split())
_ATTRIBUTED = ("class", "id", "role", "hidden", "style", "aria-hidden")
#: Opening one of these ends open ones of the same kind, up to the boundary.
_ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)),
         "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}

#: Elements of running text: what stands in one, inside an article or main element, is never boilerplate for being repeated.
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th caption figcaption summary legend address".split())

DROPPED, LOOSE, BARE, KEPT = 0, 1, 2, 3
#: Spaces in a loose block, at least, that counts as running text.
LONG = 20

_FACTOR = 0x9E3779B97F4A7C15
_POWERS = np.cumprod(np.full(4096, _FACTOR, np.uint64))


def _is_noise(tag: str, attributes: str, inside: bool) -> bool:
    if tag in _NOISE or tag == "header" and not inside:
        return True
    if tag in ("html", "body", "main") or not any(a in attributes for a in _ATTRIBUTED):
        return False
    low = attributes.lower()
    if re.search(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", low):
        return True
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name == "role" and value.lower() in _NOISE_ROLES:
            return True
        if name in ("class", "id"):
            words = [[w.lower() for w in _WORD.findall(c)] for c in value.split()]
            noise = _ARTICLE_NOISE if tag == "article" else _NOISE_WORDS
            if any(noise.intersection(ws) and not _QUALIFIERS.intersection(ws) for ws in words):
                return True
            if tag != "article" and any(_UNSURE.intersection(ws) and all(w in _UNSURE or w in _NEUTRAL or w.isdigit() for w in ws) for ws in words):
                return True
    return False


def _tags(page: str) -> Iterator[tuple[int, int, bool, str, str, bool]]:
    """(start, end, closing, name in lower case, attributes, ends itself) of each tag in order; comments have no name.

    Every character is looked at a few times at most, whatever the page: where quotes hold the end of a tag until the
    page ends, that tag ends at its first ``>``, and quotes mean nothing from there on. A tag that never ends is none,
    but for one that the page ends in.
    """
    at, last, sections, quotes = 0, page.rfind(">"), page.rfind("]]>"), True
    while (start := page.find("<", at)) >= 0:
        at = start + 1
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else len(page)
            yield start, at, False, "", "", False
            continue
        if page.startswith(("!", "?"), at):
            section = page.startswith("<![CDATA[", start) and at <= sections
            end = page.find("]]>", at) + 2 if section else page.find(">", at) if at <= last else -1
            if end >= 0:
                at = end + 1
                yield start, at, False, "", "", False
            continue
        name = _NAME.match(page, at)
        if not name:
            continue
        if start > last:
            if page.find("<", at) < 0:
                yield start, len(page), False, "", "", False
                return
            continue
        end = name.end()
        while quotes and end <= last:
            end = _PLAIN.match(page, end).end()
            if end > last or page[end] == ">":
                break
            close = page.find(page[end], end + 1)
            end = close + 1 if close >= 0 else len(page)
        if not quotes or end > last:
            quotes, end = False, page.find(">", name.end())
        attributes, at = page[name.end(): end], end + 1
        yield start, at, bool(name[1]), name[2].lower(), attributes, attributes.endswith("/")


def blocks_of(page: str) -> list[tuple[str, int]]:
    """The text blocks of a page in order, each with DROPPED, LOOSE, BARE or KEPT.

    DROPPED is what the structure marks as menus, headers, footers, sidebars, notices, adverts, forms, comments or
    hidden parts; KEPT is what stands in an article or main element besides, BARE that of it which is in no element of
    running text. LOOSE blocks are those that may be either:
    all others, where nothing is kept or more text stands in long loose blocks than in kept ones, as on a page with the
    teaser of another. Scripts, styles and markup are no text at all.
    """
    blocks: list[tuple[str, int]] = []
    stack: list[tuple[str, bool, bool]] = []
    open_: defaultdict[str, list[int]] = defaultdict(list)  # where in the stack the open elements of a name are
    open_blocks: list[int] = []
    parts: list[str] = []
    noise = inside = prose = 0

    def flush() -> None:
        if parts:
            text = "".join(parts)
            text = " ".join((entities.unescape(text) if "&" in text else text).split())
            if text:
                blocks.append((text, DROPPED if noise else LOOSE if not inside else KEPT if prose else BARE))
            parts.clear()

    def innermost(names: tuple[str, ...]) -> int:
        return max((open_[name][-1] for name in names if open_[name]), default=-1)

    def close(at: int) -> None:
        """Ends the open elements from one on; each is ended once, so that all of this is linear in the tags."""
        nonlocal noise, inside, prose
        while len(stack) > at:
            name, was_noise, was_inside = stack.pop()
            open_[name].pop()
            noise -= was_noise
            inside -= was_inside
            if name in _BLOCK:
                open_blocks.pop()
                prose -= name in _PROSE

    at = skip = 0
    for start, end, closing, tag, attributes, ends_itself in _tags(page):
        if start < skip:
            continue
        if start > at:
            parts.append(page[at:start])
        at = end
        if not tag:
            continue
        if tag in _RAW:
            if not closing and not ends_itself:
                found = _RAW[tag].search(page, at)
                at = skip = found.end() if found else len(page)
            continue
        if tag in _BLOCK:
            flush()
        elif tag == "br":
            parts.append(" ")
        if tag in _VOID:
            continue
        if closing:
            if open_[tag]:
                close(open_[tag][-1])
            continue
        if tag in _ENDS:
            same, bounds = map(innermost, _ENDS[tag])
            if same > bounds:
                close(same)
        elif tag in _BLOCK and open_blocks and stack[open_blocks[-1]][0] == "p":
            close(open_blocks[-1])
        is_noise, is_inside = _is_noise(tag, attributes, inside > 0), tag in ("article", "main")
        noise += is_noise
        inside += is_inside
        open_[tag].append(len(stack))
        if tag in _BLOCK:
            open_blocks.append(len(stack))
            prose += tag in _PROSE
        stack.append((tag, is_noise, is_inside))
    parts.append(page[at:])
    flush()
    kept = sum(len(text) for text, kind in blocks if kind >= BARE)
    if kept and kept >= sum(len(text) for text, kind in blocks if kind == LOOSE and text.count(" ") >= LONG):
        blocks = [(text, DROPPED if kind == LOOSE else kind) for text, kind in blocks]
    return blocks


def _runs(tokens: np.ndarray, page: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts of the runs that lie within one page's stream, the group of equal runs that each is in).

    The suffixes of all streams are sorted by prefix doubling to the depth of a run; neighbours in that order that
    share a prefix of a whole run form a group.
    """
    n = len(tokens)
    _, rank = np.unique(tokens, return_inverse=True)
    rank = rank.astype(np.int64)
    depth = 1
    while depth < run:
        step = min(depth, run - depth)
        after = np.full(n, -1, np.int64)
        after[: n - step] = rank[step:]
        key = rank * (n + 1) + after + 1
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate(([0], np.diff(key[order]) != 0)).cumsum()
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        depth += step
    at = np.flatnonzero(page[run - 1:] == page[: n - run + 1])
    return at, rank[at]


def _numbered(values: np.ndarray) -> np.ndarray:
    """The values of a sorted array as numbers from 0."""
    return np.cumsum(np.concatenate(([0], np.diff(values) != 0))) if len(values) else values


def _sources(tokens: np.ndarray, number: np.ndarray, kept: np.ndarray, at: np.ndarray, group: np.ndarray, run: int) -> np.ndarray:
    """For each page, the number of its text: pages with one stream, or with near copies of one article, count as one.

    Streams are compared without what is not kept, such as the adverts of mirrored pages, if anything is kept.
    """
    pages = int(number[-1]) + 1
    bounds = np.searchsorted(number, np.arange(pages + 1))
    streams = [tokens[a:b][kept[a:b]] if kept[a:b].any() else tokens[a:b] for a, b in zip(bounds, bounds[1:])]
    _, source = np.unique([hash(s.tobytes()) for s in streams], return_inverse=True)
    n = int(source.max()) + 1
    sums = np.concatenate(([0], np.cumsum(kept)))
    inner = sums[at + run] - sums[at] == run
    pairs = np.unique(group[inner] * n + source[number[at[inner]]])
    of, on = pairs // n, pairs % n
    size = np.bincount(on, minlength=n)
    place = _numbered(of)
    shared = np.bincount(place)[place] > 1
    place = _numbered(place[shared])
    on, common = on[shared], np.zeros((n, n), np.float32)
    edges = np.searchsorted(place, np.arange(0, len(place) and place[-1] + 4097, 4096))
    for a, b in zip(edges, edges[1:]):
        some = np.zeros((n, 4096), np.float32)
        some[on[a:b], place[a:b] % 4096] = 1
        common += some @ some.T
    near = common >= np.maximum(SAME * np.maximum.outer(size, size), 1)
    near |= np.eye(n, dtype=bool)
    label = np.arange(n)
    while True:
        least = np.where(near, label, n).min(axis=1)
        if (least == label).all():
            return label[source]
        label = least


def repeated(tokens: np.ndarray, page: np.ndarray, run: int = RUN, pages: int = PAGES, share: float = SHARE,
             kept: np.ndarray | None = None) -> np.ndarray:
    """Which tokens lie in a run of at least ``run`` tokens that occurs on enough distinct pages.

    tokens are the pages' streams one after another, kept tells which of them stand in an article or main element.
    Pages with the same stream and near copies of an article count as one: what repeats there is the article.
    """
    n = len(tokens)
    if n < run:
        return np.zeros(n, bool)
    at, group = _runs(tokens, page, run)
    number = np.cumsum(np.concatenate(([0], np.diff(page) != 0)))
    source = _sources(tokens, number, np.zeros(n, bool) if kept is None else kept, at, group, run)
    base = int(number[-1]) + 1
    pairs = np.unique(group * base + source[number[at]])
    groups, on = np.unique(pairs // base, return_counts=True)
    often = groups[on >= max(pages, share * len(np.unique(source)))]
    return _spread(at[np.isin(group, often)], n, run)


def _spread(begin: np.ndarray, n: int, run: int) -> np.ndarray:
    """Which of n tokens lie in the runs that start at ``begin``."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, begin, 1)
    np.add.at(edges, begin + run, -1)
    return np.cumsum(edges[:-1]) > 0


def _texts(pages: list[list[tuple[str, int]]]) -> list[str]:
    """The main text of each of one host's pages, compared all at once: what ``extract_text`` gives, for tests."""
    index: dict[str, int] = {}
    tokens, owner, kinds, spans = [], [], [], []
    for number, blocks in enumerate(pages):
        for text, kind in blocks:
            words = text.split(" ")
            spans.append((number, len(tokens), len(tokens) + len(words), kind, text))
            tokens += [index.setdefault(w, len(index)) for w in words]
            owner += [number] * len(words)
            kinds += [kind] * len(words)
    covered = repeated(np.array(tokens, np.int64), np.array(owner, np.int64), kept=np.array(kinds, np.int64) >= BARE)
    share = np.concatenate(([0], np.cumsum(covered)))
    left: list[list[str]] = [[] for _ in pages]
    for number, begin, end, kind, text in spans:
        if kind == KEPT or kind != DROPPED and share[end] - share[begin] < COVERED * (end - begin):
            left[number].append(text)
    return ["\n".join(k) for k in left]


def _table(ids: list, urls: list, texts: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                      ["page_id", "url", "text", "n_chars"])


def _stream(blocks: list[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(a number of 32 bits for each word of a page, the kind of the block that each is in, where the blocks end)."""
    if not blocks:
        return np.zeros(0, np.uint32), np.zeros(0, np.uint8), []
    text = np.frombuffer((" ".join([t for t, _ in blocks]) + " ").encode("utf-8", "surrogatepass"), np.uint8)
    after = np.flatnonzero(text == 32) + 1
    sizes = np.diff(after, prepend=0)
    starts = after - sizes
    place = np.arange(len(text)) - np.repeat(starts, sizes)
    code = np.add.reduceat(text * _POWERS[place & 4095], starts)
    code ^= code >> np.uint64(31)
    tokens = (code * np.uint64(_FACTOR) >> np.uint64(32)).astype(np.uint32)
    words = [t.count(" ") + 1 for t, _ in blocks]
    return tokens, np.repeat(np.array([k for _, k in blocks], np.uint8), words), list(accumulate(words))


def _run_codes(tokens: np.ndarray, run: int = RUN) -> np.ndarray:
    """A number of 64 bits for each run of a stream, by where it starts."""
    n = max(0, len(tokens) - run + 1)
    code = np.zeros(n, np.uint64)
    for k in range(run):
        code = code * np.uint64(_FACTOR) + tokens[k: k + n].astype(np.uint64)
        code ^= code >> np.uint64(29)
    return code.view(np.int64)


def _told(streams: list[np.ndarray], kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, source, asked) for the runs of some of a host's pages and the texts that they are on; texts alone have run 0 and asked -1.

    asked is 1 for runs that touch a block about which they may decide. A text is known by the least of its pages' hashes.
    """
    sizes = [len(s) for s in streams]
    tokens = np.concatenate(streams).astype(np.int64)
    whole = [int.from_bytes(hashlib.blake2b(s[k != DROPPED].tobytes() or s.tobytes(), digest_size=8).digest(), "little", signed=True)
             for s, k in zip(streams, np.split(kinds, np.cumsum(sizes)[:-1]))]
    filled = np.array([w for w, n in zip(whole, sizes) if n], np.int64)
    texts, runs, sources, asked = np.unique(filled), *[np.zeros(0, np.int64)] * 3
    if len(tokens) >= RUN:
        page = np.repeat(np.arange(len(streams)), sizes)
        number = np.cumsum(np.concatenate(([0], np.diff(page) != 0)))
        at, group = _runs(tokens, page, RUN)
        source = _sources(tokens, number, kinds >= BARE, at, group, RUN)
        names = np.full(len(source), np.iinfo(np.int64).max)
        np.minimum.at(names, source, filled)
        texts = np.unique(names[source])
        open_ = np.concatenate(([0], np.cumsum((kinds == LOOSE) | (kinds == BARE))))
        first, open_groups = np.zeros(len(tokens) + 1, np.int64), np.zeros(len(tokens) + 1, np.int64)
        first[group] = at
        open_groups[group[open_[at + RUN] > open_[at]]] = 1
        pairs = np.unique(group * len(texts) + np.searchsorted(texts, names[source[number[at]]]))
        group, text = pairs // len(texts), pairs % len(texts)
        runs, sources, asked = _run_codes(tokens.astype(np.uint32))[first[group]], texts[text], open_groups[group]
    none = np.zeros(len(texts), np.int64)
    return np.concatenate([runs, none]), np.concatenate([sources, texts]), np.concatenate([asked, none - 1])


def _counted(table: pa.Table) -> pa.Table:
    """(host, run, source, asked) of ``_told`` for each host and cell in the table."""
    rows = table.select(["host", "cell", "tokens", "kinds"]).to_pydict()
    of: dict[tuple[str, int], list[int]] = {}
    for at, key in enumerate(zip(rows["host"], rows["cell"])):
        of.setdefault(key, []).append(at)
    parts = []
    for (host, _), places in of.items():
        runs, sources, asked = _told([np.frombuffer(rows["tokens"][p], np.uint32) for p in places],
                                     np.frombuffer(b"".join(rows["kinds"][p] for p in places), np.uint8))
        parts.append(pa.table({"host": pa.repeat(pa.scalar(host, pa.string()), len(runs)), "run": runs, "source": sources, "asked": asked.astype(np.int32)}))
    return pa.concat_tables(parts)


def _without(blocks: list[tuple[str, int]], runs: np.ndarray) -> str:
    """The main text of a page, by the sorted runs that are boilerplate on its host."""
    if not len(runs):
        return "\n".join(text for text, kind in blocks if kind != DROPPED)
    tokens, _, ends = _stream(blocks)
    codes = _run_codes(tokens)
    begin = np.flatnonzero(runs[np.minimum(np.searchsorted(runs, codes), len(runs) - 1)] == codes)
    if not len(begin):
        return "\n".join(text for text, kind in blocks if kind != DROPPED)
    share = np.concatenate(([0], np.cumsum(_spread(begin, len(tokens), RUN)))).tolist()
    return "\n".join(text for (text, kind), begin, end in zip(blocks, [0, *ends], ends)
                     if kind == KEPT or kind != DROPPED and share[end] - share[begin] < COVERED * (end - begin))


def extract_text(pages: DataFrame, cell: int = CELL) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html): the main text.

    Each page's structure gives its blocks. On hosts with blocks that may be either, the token streams of all pages are
    compared with a suffix array, and such blocks that repeated runs cover are removed as boilerplate, in an article or main
    element as well if they are in no heading, paragraph or other element of running text; the text of mirrored pages and
    near copies stays. Hosts of all sizes go one way: each run's texts are counted over the whole host. Near copies are
    found among about ``cell`` pages at once, equal texts over the whole host. Blocks are joined by one newline. Null and empty
    html give an empty text; null urls form one host; repeated rows, null ids and clashing further columns do no harm.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
        F.coalesce(F.regexp_extract(F.lower("url"), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")).alias("host"))

    def undecided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                hosts: set[str] = set()
                for page, host in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if host not in hosts and any(k in (LOOSE, BARE) for _, k in blocks_of(page)):
                        hosts.add(host)
                yield pa.RecordBatch.from_arrays([pa.array(sorted(hosts), pa.string())], ["host"])

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                found = [_stream(blocks_of(page)) for page in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([t.tobytes() for t, _, _ in found], pa.binary()),
                                                  pa.array([k.tobytes() for _, k, _ in found], pa.binary())], ["host", "cell", "tokens", "kinds"])

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                runs = [np.array([] if not r.is_valid else r.values.to_numpy(), np.int64) for r in batch.column(3)]
                yield _table(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                             [_without(blocks_of(page), r) for page, r in zip(batch.column(2).to_pylist(), runs)])

    sizes = rows.groupBy("host").count().where(F.col("count") >= PAGES)
    asking = rows.select("html", "host").mapInArrow(undecided, "host string").distinct()
    compared = stage(asking.join(sizes, "host").select("host", "count", F.ceil(F.col("count") / cell).alias("cells")), "hosts")
    hosts, total = compared.agg(F.count("*"), F.coalesce(F.sum("count"), F.lit(0))).first()
    # compared hosts are few as a rule; beyond this many rows the join is left to a shuffle
    near = F.broadcast if hosts <= BROADCAST_ROWS else lambda df: df
    dealt = rows.join(near(compared), "host").select("html", "host", F.pmod(F.xxhash64("url", "page_id"), F.col("cells")).alias("cell"))
    told = (dealt.mapInArrow(streamed, "host string, cell long, tokens binary, kinds binary")
            .groupBy(F.pmod(F.xxhash64("host", "cell"), F.lit(max(1, total // cell))).alias("shared"))
            .applyInArrow(_counted, "host string, run long, source long, asked int"))
    found = stage(told.groupBy("host", F.when(F.col("asked") >= 0, F.col("run")).alias("run"), "source").agg(F.max("asked").alias("asked"))
                  .groupBy("host", "run").agg(F.count("*").alias("texts"), F.max("asked").alias("asked"))
                  .where((F.col("asked") != 0) & (F.col("run").isNull() | (F.col("texts") >= PAGES))), "runs")
    need = found.where("run is null").select("host", F.greatest(F.lit(PAGES), F.lit(SHARE) * F.least("texts", F.lit(CELL))).alias("need"))
    often = stage(found.where("run is not null").join(near(need), "host").where("texts >= need").groupBy("host").agg(F.sort_array(F.collect_set("run")).alias("runs")), "often")
    held = often.agg(F.sum(F.size("runs") + 1)).first()[0] or 0
    known = rows.join(F.broadcast(often) if held <= BROADCAST_ROWS * 5 else often, "host", "left")
    return known.select("page_id", "url", "html", "runs").mapInArrow(cleaned, "page_id long, url string, text string, n_chars long")


def op1(spark, sf_dir: str) -> DataFrame:
    """Query: the main text of the whole ``pages`` table."""
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
