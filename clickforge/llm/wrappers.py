"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of a host.

A page is a stream of tags and texts. Repeated neighbouring groups of a stream are folded into one repeated
group. Streams of a host are then aligned one after another: equal tags match, differing texts become text slots,
and what only one side has becomes an optional group. The result is the host's wrapper, which says for each
container (``nav``, ``div.ad``, ...) how much of its text is in slots, how much is the same on every page, and
how much is link text. Containers that hold menus, headers, footers, forms, adverts and the like by their tag or names
are furniture; any element whose names say so is such a container (``p.advert``). On pages with an article or main element
the content is that element, without inner containers whose text never varies; constant text directly in it stays. On
other pages of the host it is what mostly has slots and is not mostly links.

Alignment: nodes whose markup occurs once on both sides are anchors, the longest rising run of them is kept, and between
anchors the n-th occurrence of a key meets the n-th, or each node the next one with its key, whichever matches more; so it takes n log n steps for n nodes. A container is named by
a digest of the names on its path, so deep nesting costs no more than flat markup.

Scale: streams are dealt by (host, one of 1024 salts), sorted and aligned one at a time; the wrappers are merged as a
tree of up to 32 each. Salts come from the streams, so neither the number of tasks nor the order in which they finish
changes a wrapper, and a host with a third of all pages is spread over all tasks. A wrapper
grows with the variety of a host's markup: 3,000 pages of random markup, 100 nodes each, left 3,233 nodes. Equal streams of a host are one page. Pages meet their host's decisions in a join by
host (unique keys on that side, so hot hosts can be split). Whole pages are read; nothing is sampled.

Cases: a null or empty html has an empty text; null urls are a host of their own; unclosed and crossed tags
close as browsers do it, roughly: an end tag closes up to its opening one, if there is one; a quote that is never closed
ends with its tag; an unfinished tag at the end is dropped; very long and broken pages take time in proportion to their
length; repeated pages are alike; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickforge.llm.url_graph import host_of
from clickforge.session import materialize

BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
CONTAINERS = frozenset("article aside body div footer form head header html li main menu nav ol section table td tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
FURNITURE = frozenset("aside button footer form head iframe menu nav noscript select svg template textarea title".split())
_FURNITURE_NAMES = re.compile(
    r"(?:^|[^a-z])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|consent|cookies?|copyright|disclaimer|footer|gdpr|header|login|masthead|"
    r"menu|modal|nav|navbar|navigation|newsletter|notice|pagination|popup|promo|replies|sidebar|signup|sponsor\w*|subscribe|widget)(?:[^a-z]|$)"
)
# these name furniture by themselves or before a holder: "share-links", "related", but not "share-price", "related-work"
_WEAK_NAMES = re.compile(
    r"(?:^|[^a-z])(?:related|share|sharing|social)(?:[^a-z]+(?:area|articles?|bar|block|box|buttons?|container|content|icons?|inner|items?|links?|list|"
    r"media|now|panel|posts?|row|section|stories|this|tools?|wrapper))*[^a-z]*$"
)
_START = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|iframe)\b.*?(?:</\1\s*>|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)",
    re.S | re.I,
)
_STOP = re.compile(r">|=\s*([\"'])")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SALTS, FAN_IN = 1024, 32


def stream(page: str) -> Iterator[tuple[str, str, str]]:
    """("open" | "close", tag, names) and ("text", text, "") of a page, in order; each character is passed a few times."""
    at = 0
    closes = {'"': True, "'": True}  # whether the rest of the page may still have one

    def end_of_tag(i: int) -> int:
        while stop := _STOP.search(page, i):
            i, quote = stop.end(), stop[1]
            if not quote:
                return i
            if closes[quote]:
                other = page.find(quote, i)
                closes[quote] = other >= 0
                i = other + 1 or i
        return len(page)

    while m := _START.search(page, at):
        if m.start() > at:
            yield "text", page[at : m.start()], ""
        at = m.end()
        if m[3]:
            at = end_of_tag(at)
            own = page[m.end() : at]
            names = "" if m[2] or "=" not in own else " ".join(a or b or c for a, b, c in _NAMES.findall(own))
            yield ("close" if m[2] else "open"), m[3].lower(), names
    if at < len(page):
        yield "text", page[at:], ""


def furniture(label: str) -> bool:
    tag, _, names = label.partition(".")
    return tag in FURNITURE or (bool(names) and tag not in ("html", "body", "article", "main") and _named_furniture(names))


def _named_furniture(names: str) -> bool:
    return bool(_FURNITURE_NAMES.search(names)) or any(map(_WEAK_NAMES.search, names.replace(".", " ").split()))


# A path is named by four things: "f" furniture or "c" content, "a" inside an article, "2" an innermost article or main, "1" below
# one or "0" elsewhere, and a digest of all names on it.
TOP = "c-0"


@lru_cache(1 << 16)
def below(path: str, label: str) -> str:
    """The name of the container ``label`` inside ``path``."""
    tag = label.split(".")[0]
    bad = path[0] == "f" or furniture(label) or (tag == "header" and path[1] != "a")
    root = "2" if tag in ("article", "main") else "0" if path[2] == "0" else "1"
    return "fc"[not bad] + ("a" if tag == "article" else path[1]) + root + blake2b(f"{path}/{label}".encode("utf-8", "replace"), digest_size=12).hexdigest()


def walk(page: str) -> Iterator[tuple[str, str, str, bool]]:
    """("tag" | "text", tag or text, name of the open containers, inside a link)."""
    path = [TOP]
    tags: list[str] = []
    open_tags: Counter[str] = Counter()
    links = 0

    def pop() -> str:
        path.pop()
        open_tags[tags[-1]] -= 1
        return tags.pop()

    for kind, value, names in stream(page):
        if kind == "text":
            yield "text", value, path[-1], links > 0
            continue
        if value == "a":
            links = int(kind == "open")
        if kind == "open":
            if tags and (tags[-1] == value == "li" or (tags[-1] == "p" and value in BLOCKS)):
                pop()
            label = value + "".join("." + n for n in sorted(set(names.lower().split())))
            if value == "body" and open_tags["head"]:
                while pop() != "head":
                    pass
            if value in CONTAINERS or (value not in VOID and value not in HEADINGS and furniture(label)):
                tags.append(value)
                open_tags[value] += 1
                path.append(below(path[-1], label))
        elif open_tags[value]:
            while pop() != value:
                pass
            if value in CONTAINERS:
                links = 0
        yield "tag", ("/" if kind == "close" else "") + value, path[-1], links > 0


def fold(nodes: list) -> list:
    """Neighbouring repeats of a group of up to eight nodes become one repeated group."""
    keys = [_key(x) for x in nodes]  # joined nodes keep their key
    for width in range(1, 9):
        out, out_keys, i = [], [], 0
        while i < len(nodes):
            own, n = keys[i : i + width], 1
            while len(own) == width and keys[i + n * width : i + (n + 1) * width] == own:
                n += 1
            if n > 1:
                body = nodes[i : i + width]
                for k in range(1, n):
                    body = [_join(a, b, max) for a, b in zip(body, nodes[i + k * width : i + (k + 1) * width])]
                out.append(["+", "", body] if width > 1 or body[0][0] != "+" else body[0])
                out_keys.append(_key(out[-1]))
                i += n * width
            else:
                out.append(nodes[i])
                out_keys.append(keys[i])
                i += 1
        nodes, keys = out, out_keys
    return nodes


def _key(node: list) -> str:
    """What must agree for two nodes to match: texts always do, groups if their bodies do."""
    if node[0] == "t":
        return "t" + node[1]
    if node[0] == "+":
        return "+" + "(" + " ".join(map(_key, node[2])) + ")"
    if node[0] == "?":
        return "?" + "(" + " ".join(map(_key, node[2])) + ")"
    return "#" + node[1]


def _join(a: list, b: list, pages=sum) -> list:
    """Two matching nodes as one; differing texts leave a slot, and masses add up. ``pages`` is max inside one page."""
    if a[0] == "#":
        return ["#", a[1], a[2] if a[2] == b[2] else None, a[3] + b[3], a[4] + b[4], pages((a[5], b[5]))]
    if a[0] in "+?":
        return [a[0], a[1], [_join(x, y, pages) for x, y in zip(a[2], b[2])]]
    return a


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of the pairs, sorted by their first places, whose second places rise, too."""
    ends: list[int] = []
    last: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(ends, j)
        before[k] = last[at - 1] if at else -1
        ends[at : at + 1], last[at : at + 1] = [j], [k]
    run, k = [], last[-1] if last else -1
    while k >= 0:
        run.append(pairs[k])
        k = before[k]
    return run[::-1]


def _anchors(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places with keys that both sides have once."""
    once_a, once_b = Counter(a), {k: j for j, k in enumerate(b)}
    count_b = Counter(b)
    return _rising([(i, once_b[k]) for i, k in enumerate(a) if once_a[k] == count_b[k] == 1])


def _numbered(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """The n-th occurrence of a key on one side and on the other."""
    seen: Counter[str] = Counter()
    place = {}
    for j, k in enumerate(b):
        place[k, seen[k]] = j
        seen[k] += 1
    seen.clear()
    pairs = []
    for i, k in enumerate(a):
        if (k, seen[k]) in place:
            pairs.append((i, place[k, seen[k]]))
        seen[k] += 1
    return _rising(pairs)


def _embedded(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Each node of ``b`` with the next one in ``a``: all of them, if ``a`` has ``b`` in it, so that it need not grow."""
    places: dict[str, list[int]] = {}
    for i, k in enumerate(a):
        places.setdefault(k, []).append(i)
    pairs, last = [], -1
    for j, k in enumerate(b):
        own = places.get(k, [])
        at = bisect_left(own, last + 1)
        if at < len(own):
            last = own[at]
            pairs.append((last, j))
    return pairs


def _matches(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matching places in rising order: equal ends, anchors, and between them occurrences by number or the next ones."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    mid_a, mid_b = a[head : len(a) - tail], b[head : len(b) - tail]
    found = [(k, k) for k in range(head)]
    i = j = 0
    for x, y in [*_anchors(mid_a, mid_b), (len(mid_a), len(mid_b))]:
        gap = mid_a[i:x], mid_b[j:y]
        found += [(head + i + p, head + j + q) for p, q in max(_numbered(*gap), _embedded(*gap), key=len)]
        if x < len(mid_a):
            found.append((head + x, head + y))
        i, j = x + 1, y + 1
    return found + [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]


def align(a: list, b: list) -> list:
    """The wrapper that both sides match: common nodes, and optional groups for what one side has."""
    bare = lambda x: x[2] if x[0] == "?" else [x]
    keys_a, keys_b = [" ".join(map(_key, bare(x))) for x in a], [" ".join(map(_key, bare(x))) for x in b]
    out, i, j = [], 0, 0
    for x, y in [*_matches(keys_a, keys_b), (len(a), len(b))]:
        out += [n if n[0] == "?" else ["?", "", [n]] for n in [*a[i:x], *b[j:y]]]
        if x < len(a):
            out.append(_match(a[x], b[y]))
        i, j = x + 1, y + 1
    return out


def _match(x: list, y: list) -> list:
    inner = [_join(p, q) for p, q in zip(x[2] if x[0] == "?" else [x], y[2] if y[0] == "?" else [y])]
    return ["?", "", inner] if "?" in (x[0], y[0]) else inner[0]


def wrapper_of(page: str) -> list:
    """A page's stream as nodes: ["t", tag] and ["#", name of the path, text, length, link length, pages]."""
    nodes = []
    for kind, value, path, link in walk(page):
        if kind == "tag":
            nodes.append(["t", value])
        elif text := " ".join(entities.unescape(value).split()):
            nodes.append(["#", path, text, len(text), len(text) * link, 1])
    return fold(nodes)


def _texts(nodes: list) -> Iterator[list]:
    for x in nodes:
        if x[0] == "#":
            yield x
        elif x[0] in "+?":
            yield from _texts(x[2])


def decide(wrapper: list) -> dict[str, list[str]]:
    """The container paths that are content: "main" on pages with an article or main element, "rich" on others."""
    slots: dict[str, float] = {}
    every: dict[str, float] = {}
    linked: dict[str, float] = {}
    for _, path, text, size, links, pages in _texts(wrapper):
        every[path] = every.get(path, 0) + size
        linked[path] = linked.get(path, 0) + links
        if text is None or pages == 1:
            slots[path] = slots.get(path, 0) + size

    good = {p for p in every if p[0] == "c"}
    # in an article or main, inner containers whose text never varies are furniture; a container that some pages
    # leave out stays as long as it has slots
    roots = {p for p in good if p[2] != "0"}
    main = [p for p in roots if p[2] == "2" or slots.get(p, 0)]
    # pages without: what mostly has slots and is not mostly links
    rich = [p for p in good if p not in roots and slots.get(p, 0) * 2 >= every[p] and linked[p] * 2 < every[p]]
    return {"main": sorted(main), "rich": sorted(rich), "roots": sorted(roots)}


def infer(wrappers: Iterator[list]) -> list:
    out = None
    for w in wrappers:
        out = w if out is None else align(out, w)
    return out or []


def extract(page: str, content: dict[str, set[str]]) -> str:
    """Texts of the page's content containers, one block a line. Whether it has an article or main is its own layout."""
    nodes = [(kind, value, path) for kind, value, path, _ in walk(page)]
    roots = content["roots"]
    own = content["main" if any(kind == "text" and path in roots and value.strip() for kind, value, path in nodes) else "rich"]
    blocks: list[str] = []
    parts: list[str] = []
    for kind, value, path in nodes:
        if kind == "tag":
            name = value.lstrip("/")
            if name in BLOCKS:
                blocks.append("".join(parts))
                parts = []
            elif name == "br":
                parts.append(" ")
        elif path in own:
            parts.append(entities.unescape(value))
    blocks.append("".join(parts))
    return "\n".join(b for b in (" ".join(x.split()) for x in blocks) if b)


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [json.dumps(wrapper_of(page)) for page in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.string())], names=["host", "wrapper"])


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One wrapper for each run of rows with the same host and salt; only the present one is held."""
    rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
    for (host, salt), own in groupby(rows, key=lambda r: r[:2]):
        merged = json.dumps(infer(json.loads(r[2]) for r in own))
        yield pa.RecordBatch.from_arrays([pa.array([host], pa.string()), pa.array([salt], pa.int64()), pa.array([merged], pa.string())], names=["host", "salt", "wrapper"])


def _merged(rows: pa.Table) -> pa.Table:
    """The wrappers of one node of the merge tree, in order of their salts; what they decide goes along."""
    salts, own = rows.column("salt").to_pylist(), rows.column("wrapper").to_pylist()
    merged = infer(json.loads(w) for _, w in sorted(zip(salts, own)))
    return pa.table({"host": pa.array([rows.column("host")[0].as_py()], pa.string()), "salt": [min(salts) // FAN_IN],
                     "wrapper": [json.dumps(merged)], "content": [json.dumps(decide(merged))]})


def infer_wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, content): for each host, what ``decide`` says of its wrapper, as JSON."""
    rows = pages.select(host_of(F.col(url)).alias("host"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    # equal pages count once: copies are no evidence that a text is constant
    streams = rows.mapInArrow(_streams, "host string, wrapper string").distinct()
    salted = streams.select("host", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)).alias("salt"), "wrapper")
    dealt = salted.repartition("host", "salt").sortWithinPartitions("host", "salt", "wrapper")
    merged = dealt.mapInArrow(_partial, "host string, salt long, wrapper string")
    for _ in range(2):  # 1024 salts, 32 nodes, one root
        merged = merged.groupBy("host", F.floor(F.col("salt") / FAN_IN).alias("_node")).applyInArrow(
            _merged, "host string, salt long, wrapper string, content string")
    return merged.select("host", "content")


def extract_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, text, n_chars of every page."""
    wrappers = materialize(infer_wrappers(pages, url, html), "wrappers")
    rows = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"), F.coalesce(F.col(html), F.lit("")).alias("_html"), host_of(F.col(url)).alias("host"))
    rows = rows.join(wrappers, "host", "left").select("_key", "_url", "_html", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict] = {}
        for batch in batches:
            texts = []
            for page, content in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if content not in known:
                    known[content] = {"main": set(), "rich": set(), "roots": set()} | {k: set(v) for k, v in json.loads(content or "{}").items()}
                texts.append(extract(page, known[content]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[key, url, "text", "n_chars"],
            )

    kept = rows.select(F.col("_key").alias(key), F.col("_url").alias(url)).schema
    return rows.mapInArrow(run, kept.add("text", "string").add("n_chars", "long"))
