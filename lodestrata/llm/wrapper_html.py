"""Main text of web pages by wrappers: union-free regular expressions over tags, inferred template by template.

Pages of one host come from a few templates: pages whose containers outside aside elements have the same distinct
signatures in the same order. Every distinct page of a template takes part. Pages of equal shape are merged
node by node first; the stream of one shape is the first wrapper of the template; each further one is aligned with it and mismatches are resolved without unions: texts that differ become
slots, a run of equal pieces becomes a repeated group, and what only one side has becomes an
optional group. A page's text is what its template's wrapper says it is:

* The content is the element with the text that differs between pages, outside links.
* In it, containers that are the same on all pages, and containers whose whole text is repeated links, are left out.
* Elements that HTML itself sets apart (``ASIDE_TAGS``, hidden ones) are left out. ``header`` is where the content is the whole body.
* A name such as ``comments`` is a hint, not a verdict: every word of it has to be a known one, and the wrapper has to agree
  (the element has less than half of the text that differs, or is a repeated group of several slots). Without any
  names (``ASIDE_NAMES`` empty) all else works as it does.

Raw text of script, style and textarea goes (to the end of the page where it isn't closed), and what stands in
noscript, template, svg, iframe, select and canvas where these are closed. Text in math and object stays.

Cases: null and empty pages have empty text; a page without the wrapper's content element is read by the wrapper of
its own stream alone; a null url is a host of its own; pages that repeat are kept; a template
with one page has that page's stream as wrapper, and there all text counts as differing; an empty table gives an empty table; other columns
are ignored. Ties between elements go to the one that comes first.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import operator
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, pick, tidy

#: Streams or wrappers that one task aligns in a round, on average at most.
FAN_IN = 16
#: Distinct pages of a template from which text that is the same on all of them is left out.
LEAST_PAGES = 3
#: Nodes that a task holds while it merges pages of equal shape; then it writes them out as one part.
HELD_NODES = 200_000
#: Wrappers up to this many bytes in all go to every task; more are joined by host.
BROADCAST_BYTES = 16 << 20
#: Steps of an alignment held at once, in bytes; those of longer streams are worked out in blocks of rows.
STEP_BYTES = 64 << 20

# Fixed values of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|textarea"
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption title head".split())
#: Elements that HTML sets apart from the content.
ASIDE_TAGS = set("nav aside footer form button head title dialog menu noscript template svg iframe select canvas".split())
#: Hints: a class, id or role whose words are all among these or ``PLAIN_WORDS``, one of these at least.
ASIDE_NAMES = set("nav navbar navigation menu sidebar ad ads advert adverts advertisement sponsored banner cookie cookies consent notice notices alert comment comments commentlist respond disqus footer breadcrumb breadcrumbs share sharing social related promo newsletter subscribe popup modal toolbar masthead pagination pager complementary contentinfo widget".split())
PLAIN_WORDS = set("site page main global top bottom left right upper lower primary secondary sub list item items box block bar area section container wrapper wrap inner outer row group slot unit panel button buttons link links post posts article articles story stories form thread reply replies signup icons icon media user users reader readers".split())
HINTED = BLOCKS - set("html body head article main h1 h2 h3 h4 h5 h6 td th tr tbody thead tfoot".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
HOLDERS = set("div section article main body td center table".split())
#: Containers that can be left out of the content as a whole.
PARTS = set("div section table center ul ol dl header".split())
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<({RAW})\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?][^>]*>", re.S | re.I)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
SPACE = re.compile(r"\s+")
DIGITS = re.compile(r"\d{2,}")  # a single digit names a part, more of them a page


class Page:
    """Tokens of one page: (name, signature, set apart) for tags, text for the rest; and where each element ends."""

    def __init__(self, source: str):
        self.kind: list[int] = []  # 0 text, 1 open, 2 close
        self.value: list = []
        at = 0
        for m in TOKEN.finditer(source):
            if m.start() > at:
                self._add(0, source[at : m.start()])
            at = m.end()
            name = m.group(3)
            if name:
                name = name.lower()
                if m.group(2):
                    self._add(2, name)
                else:
                    self._add(1, (name, *_named(name, m.group(4))))
            elif m.group(0)[:9] == "<![CDATA[":
                self._add(0, entities.escape(m.group(0)[9:].removesuffix("]]>")))
        if at < len(source):
            self._add(0, source[at:])
        self.end: dict[int, int] = {}
        waiting: dict[str, list[int]] = {}
        for k, kind in enumerate(self.kind):
            if kind == 1 and self.value[k][0] not in VOID:
                waiting.setdefault(self.value[k][0], []).append(k)
            elif kind == 2 and waiting.get(self.value[k]):
                self.end[waiting[self.value[k]].pop()] = k

    def _add(self, kind: int, value) -> None:
        self.kind.append(kind)
        self.value.append(value)

    def text(self, low: int, high: int, rule: dict) -> str:
        """Blocks between two tokens, one a line, without what is set apart and what the wrapper's rule leaves out."""
        beside, fixed, whole = set(rule["beside"]), rule["fixed"], not rule["content"] or rule["content"][0].split(".")[0] in ("body", "html")
        blocks, part, k = [], [], low
        while k < high:
            kind, value = self.kind[k], self.value[k]
            if kind == 0:
                part.append(value)
            else:
                name = value if kind == 2 else value[0]
                if kind == 1 and k in self.end and (value[2] == APART or value[1] in beside or (whole and name == "header") or (value[1] in fixed and self.digest(k) in fixed[value[1]])):
                    if name in BLOCKS:
                        blocks.append("".join(part))
                        part = []
                    k = self.end[k] + 1
                    continue
                if name in BLOCKS:
                    blocks.append("".join(part))
                    part = []
                elif name == "br":
                    part.append(" ")
            k += 1
        blocks.append("".join(part))
        clean = (SPACE.sub(" ", entities.unescape(b)).strip() for b in blocks)
        return "\n".join(b for b in clean if b)

    def digest(self, k: int) -> str:
        """Of the texts in an element."""
        texts = (SPACE.sub(" ", entities.unescape(self.value[x])).strip() for x in range(k, self.end[k]) if self.kind[x] == 0)
        return _digest([t for t in texts if t])

    def template(self) -> str:
        """The distinct signatures of the containers outside aside elements, in order."""
        seen, k = {}, 0
        while k < len(self.kind):
            if self.kind[k] == 1:
                name, signature, beside = self.value[k]
                if beside and k in self.end:
                    k = self.end[k]
                elif name in HOLDERS:
                    seen[signature] = None
            k += 1
        return hashlib.md5("\0".join(seen).encode("utf-8", "replace")).hexdigest()

    def find(self, signature: str, nth: int) -> tuple[int, int] | None:
        """The tokens inside the nth element with a signature; to the end where it isn't closed."""
        for k, kind in enumerate(self.kind):
            if kind == 1 and self.value[k][1] == signature:
                if nth == 0:
                    return k + 1, self.end.get(k, len(self.kind))
                nth -= 1
        return None


APART, HINT = 1, 2
_SEEN: dict[tuple[str, str], tuple[str, int]] = {}


def _named(name: str, attributes: str) -> tuple[str, int]:
    """Signature (name and class, digits masked), and whether HTML sets the element apart or its name hints at that."""
    if not attributes or name == "a":
        return name, APART if name in ASIDE_TAGS else 0
    key = (name, attributes)
    if key not in _SEEN:
        if len(_SEEN) > 50_000:
            _SEEN.clear()
        found = {m.group(1).lower(): entities.unescape(m.group(2) or m.group(3) or m.group(4) or "") for m in NAMED.finditer(attributes)}
        kind = found.get("class") or found.get("id") or ""
        apart = name in ASIDE_TAGS or bool(HIDDEN.search(attributes))
        hint = name in HINTED and any(hints(x) for v in found.values() for x in v.split())
        _SEEN[key] = (DIGITS.sub("#", name + ("." + ".".join(sorted(kind.split())) if kind else "")), APART if apart else HINT if hint else 0)
    return _SEEN[key]


def hints(name: str) -> bool:
    """Whether all words of a class, id or role are known ones, and one at least names something beside the content."""
    words = set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()))
    return bool(words & ASIDE_NAMES) and words <= ASIDE_NAMES | PLAIN_WORDS


def _digest(texts: list[str]) -> str:
    return hashlib.md5("\0".join(sorted(texts)).encode("utf-8", "replace")).hexdigest()


# --- wrappers: nodes are [kind, ...] with kind tag, text, slot, opt or rep -----------------
# A slot has its characters and, as long as all pages have the same there, its texts joined by \0; else None.


def stream(page: Page) -> list:
    out = []
    for kind, value in zip(page.kind, page.value, strict=True):
        if kind == 0:
            text = SPACE.sub(" ", entities.unescape(value)).strip()
            if text:
                out.append(["text", text, len(text)])
        else:
            out.append(["tag", value[1] if kind == 1 else "/" + value, value[2] if kind == 1 else 0])
    return out


def shape(node: list) -> tuple:
    """What nodes must share to stand for each other; texts and slots all do."""
    if node[0] == "tag":
        return ("tag", node[1])
    if node[0] in ("text", "slot"):
        return ("slot",)
    return (node[0], tuple(shape(n) for n in node[1]))


def fold(nodes: list, longest: int = 24) -> list:
    """Runs of equal pieces that begin with a tag become repeated groups, short pieces first."""
    shapes = [shape(n) for n in nodes]
    for size in range(1, longest + 1):
        if len(nodes) < 2 * size:
            break
        run = b"\1" * size
        equal = bytes(map(operator.eq, shapes, shapes[size:]))
        at = equal.find(run)
        if at < 0:
            continue
        out, names, k = [], [], 0
        while at >= 0:
            if nodes[at][0] not in ("text", "slot") and _balanced(nodes[at : at + size]):
                body, end = nodes[at : at + size], at + size
                while shapes[end : end + size] == shapes[at : at + size]:
                    body = [merge(a, b, False) for a, b in zip(body, nodes[end : end + size], strict=True)]
                    end += size
                made = body[0] if size == 1 and body[0][0] == "rep" else ["rep", body]
                out += [*nodes[k:at], made]
                names += [*shapes[k:at], shape(made)]
                k = end
                at = equal.find(run, end)
            else:
                at = equal.find(run, at + 1)
        nodes, shapes = out + nodes[k:], names + shapes[k:]
    return nodes


def _balanced(nodes: list) -> bool:
    """Whether a piece closes no element that it hasn't opened."""
    depth: dict[str, int] = {}
    for n in nodes:
        if n[0] == "tag":
            name = n[1].lstrip("/").split(".")[0]
            depth[name] = depth.get(name, 0) + (-1 if n[1][0] == "/" else 1)
            if depth[name] < 0:
                return False
    return True


def chars(node: list) -> int:
    return node[2] if node[0] == "text" else node[1] if node[0] == "slot" else sum(chars(n) for n in node[1]) if node[0] in ("opt", "rep") else 0


def merge(a: list, b: list, pages: bool = True) -> list:
    """One node for two that stand for each other: on two pages, or in two rounds of a repeat."""
    if a[0] == "tag":
        return a
    if a[0] in ("text", "slot"):
        one, two = (n[1] if n[0] == "text" else n[2] for n in (a, b))
        n = chars(a) + chars(b)
        if not pages:
            return ["slot", n, None if one is None or two is None else one + "\0" + two]
        if a[0] == b[0] == "text" and one == two:
            return ["text", one, n]
        return ["slot", n, one if one == two else None]
    return [a[0], align(a[1], b[1], pages)]


def like(a: list, b: list) -> int:
    """Weight of aligning two nodes; 0 if they can't be."""
    if a[0] == "tag" or b[0] == "tag":
        return 3 if a[0] == b[0] and a[1] == b[1] else 0
    if a[0] in ("text", "slot"):
        return (2 if a[:2] == b[:2] else 1) if b[0] in ("text", "slot") else 0
    if a[0] == b[0]:
        return 3 if shape(a) == shape(b) else 2 if shape(a[1][0]) == shape(b[1][0]) else 0
    return 0


def _steps(a: list, b: list, step_bytes: int = STEP_BYTES):
    """The best step at (i, j) of an alignment, asked for by rising i: 1 and 2 leave out a node of a or b, 3 pairs them, 4 and 5 take a group of a or b.

    All cells are worked out, row by row from the last. Kept are the sums of one row in each block of rows and the
    steps of one block, so memory is bounded however long the streams are.
    """
    n, m = len(a), len(b)
    numbers: dict[tuple, int] = {}
    kinds = lambda nodes, what: np.array([numbers.setdefault(what(x), len(numbers)) for x in nodes], np.int64)
    shapes_a, shapes_b = kinds(a, shape), kinds(b, shape)
    # nodes of equal looks have equal weights: one row of weights for each
    looks = lambda x: tuple(x[:2]) if x[0] == "text" else shape(x)
    looks_a, looks_b = [looks(x) for x in a], kinds(b, looks)
    first_b = {int(k): x for k, x in zip(looks_b[::-1], b[::-1], strict=True)}
    weights: dict[tuple, np.ndarray] = {}

    def weigh(i: int) -> np.ndarray:
        if looks_a[i] not in weights:
            if len(weights) * m > step_bytes:
                weights.clear()
            table = np.zeros(len(numbers), np.uint8)
            for k, x in first_b.items():
                table[k] = like(a[i], x)
            weights[looks_a[i]] = table[looks_b]
        return weights[looks_a[i]]

    def places(x: list, other: np.ndarray) -> list[int]:
        inner = [numbers.get(shape(y), -1) for y in x[1]]
        at = np.flatnonzero(other[: max(0, len(other) - len(inner) + 1)] == inner[0])
        return [int(k) for k in at if other[k : k + len(inner)].tolist() == inner]

    of_a = {i: found for i, x in enumerate(a) if x[0] in ("rep", "opt") and (found := places(x, shapes_b))}
    of_b: dict[int, list[tuple[int, int]]] = {}  # row: column and the row behind the group
    wanted: dict[int, set[int]] = {}  # sums that these need
    for j, x in enumerate(b):
        if x[0] in ("rep", "opt"):
            for i in places(x, shapes_a):
                of_b.setdefault(i, []).append((j, i + len(x[1])))
                wanted.setdefault(i + len(x[1]), set()).add(j + 1)
    sums: dict[tuple[int, int], int] = {(i, j): 0 for i, js in wanted.items() if i == n for j in js}

    def row(i: int, below: np.ndarray, how: np.ndarray | None) -> np.ndarray:
        w = weigh(i)
        pair = np.where(w > 0, w + below[1:], -1)
        grouped_a = [(j, 3 + int(below[j + len(a[i][1])])) for j in of_a.get(i, ())]
        grouped_b = [(j, 3 + sums[end, j + 1]) for j, end in of_b.get(i, ())]
        own = np.zeros(m + 1, np.int64)
        own[:m] = np.maximum(below[:m], pair)
        for j, x in grouped_a + grouped_b:
            own[j] = max(own[j], x)
        own = np.maximum.accumulate(own[::-1])[::-1]
        for j in wanted.get(i, ()):
            sums[i, j] = int(own[j])
        if how is not None:
            top = np.maximum(below[:m], own[1:])
            how[:] = np.where(own[1:] > below[:m], 2, 1)
            how[pair >= top] = 3
            top = np.maximum(top, pair)
            for number, grouped in ((4, grouped_a), (5, grouped_b)):
                for j, x in grouped:
                    if x > top[j]:
                        top[j], how[j] = x, number
        return own

    size = max(1, step_bytes // max(1, m))
    last = np.zeros(m + 1, np.int64)
    kept, low = {n: last}, n
    if n > size:
        for i in range(n - 1, -1, -1):
            last = row(i, last, None)
            if i % size == 0:
                kept[i] = last
    block = np.zeros((0, m), np.uint8)

    def step(i: int, j: int) -> int:
        nonlocal block, low
        if not low <= i < low + len(block):
            low = i - i % size
            high = min(n, low + size)
            block, below = np.zeros((high - low, m), np.uint8), kept[high]
            for k in range(high - 1, low - 1, -1):
                below = row(k, below, block[k - low])
        return int(block[i - low, j])

    return step


def align(a: list, b: list, pages: bool = True) -> list:
    """The wrapper of two streams: a best alignment in order; what only one side has is optional.

    A repeated group meets a single piece of its kind by taking it as one round; an optional group meets its own
    content by staying optional.
    """
    n, m = len(a), len(b)
    if [shape(x) for x in a] == [shape(x) for x in b]:
        return [merge(x, y, pages) for x, y in zip(a, b, strict=True)]
    step = _steps(a, b)
    out, only = [], []
    i = j = 0

    def close() -> None:
        if only:
            out.append(only[0] if len(only) == 1 and only[0][0] == "opt" else ["opt", [x for y in only for x in (y[1] if y[0] == "opt" else [y])]])
            only.clear()

    while i < n or j < m:
        how = 1 if j == m else 2 if i == n else step(i, j)
        if how == 1:
            only.append(a[i])
            i += 1
        elif how == 2:
            only.append(b[j])
            j += 1
        else:
            close()
            if how == 3:
                out.append(merge(a[i], b[j], pages))
                i, j = i + 1, j + 1
            else:
                x, y, at = (a[i], b, j) if how == 4 else (b[j], a, i)
                out.append([x[0], [merge(p, q, pages) for p, q in zip(x[1], y[at : at + len(x[1])], strict=True)]])
                i, j = (i + 1, j + len(x[1])) if how == 4 else (i + len(x[1]), j + 1)
    close()
    return out


def infer(pages: list[str]) -> dict:
    """The wrapper of some pages of one template: its expression, and where the content is."""
    streams: dict[int, tuple[int, list]] = {}
    for source in dict.fromkeys(pages):
        _gather(streams, *_folded(Page(source)))
    return described(*unite(streams))


def _folded(page: Page) -> tuple[int, int, list]:
    """A page as (shape's hash, 1, folded stream)."""
    nodes = fold(stream(page))
    return int.from_bytes(hashlib.md5(repr([shape(n) for n in nodes]).encode("utf-8", "replace")).digest()[:7], "little"), 1, nodes


def _gather(streams: dict, key, pages: int, nodes: list) -> None:
    """Streams of equal shape become one, node by node; in whatever order, the result is the same."""
    if key in streams:
        n, other = streams[key]
        streams[key] = (n + pages, [merge(a, b) for a, b in zip(other, nodes, strict=True)])
    else:
        streams[key] = (pages, nodes)


def unite(streams: dict[int, tuple[int, list]]) -> tuple[int, list]:
    """Pages and wrapper of streams or wrappers, those of most pages first."""
    order = sorted(streams.items(), key=lambda x: (-x[1][0], x[0]))
    wrapper = order[0][1][1]
    for _, (_, nodes) in order[1:]:
        wrapper = fold(align(wrapper, nodes))
    return sum(n for _, (n, _) in order), wrapper


def described(pages: int, wrapper: list) -> dict:
    """The wrapper's expression and the rule that pages are read by."""
    view = View(wrapper)
    content = view.locate()
    return {"expression": written(wrapper), "content": content, "fixed": view.fixed_blocks(pages), "beside": view.beside(), "pages": pages}


def written(nodes: list) -> str:
    """The wrapper as a regular expression over tokens."""
    out = []
    for n in nodes:
        if n[0] == "tag":
            out.append(f"<{n[1]}>")
        elif n[0] == "text":
            out.append(re.escape(n[1][:80]))
        elif n[0] == "slot":
            out.append("#TEXT")
        else:
            out.append(f"({written(n[1])}){'?' if n[0] == 'opt' else '+'}")
    return "".join(out)


def flat(nodes: list, optional: bool = False, group: int = 0, groups: list | None = None) -> tuple[list, list[bool], list[int]]:
    """Nodes without their groups, whether each is text that differs between pages or isn't on all of them, and the outermost repeated group of each (0: none)."""
    groups = groups if groups is not None else [0]
    out, varies, within = [], [], []
    for n in nodes:
        if n[0] in ("opt", "rep"):
            own = group
            if n[0] == "rep" and not group:
                groups[0] += 1
                own = groups[0]
            for all_, some in zip((out, varies, within), flat(n[1], optional or n[0] == "opt", own, groups), strict=True):
                all_ += some
        else:
            out.append(n)
            varies.append(n[0] != "tag" and (optional or (n[0] == "slot" and n[2] is None)))
            within.append(group)
    return out, varies, within


def closings(nodes: list) -> dict[int, int]:
    ends, waiting = {}, {}
    for k, n in enumerate(nodes):
        if n[0] != "tag":
            continue
        name = n[1].lstrip("/").split(".")[0]
        if n[1][0] != "/" and name not in VOID:
            waiting.setdefault(name, []).append(k)
        elif n[1][0] == "/" and waiting.get(name):
            ends[waiting[name].pop()] = k
    return ends


class View:
    """What a wrapper says about its elements."""

    def __init__(self, wrapper: list):
        self.nodes, varies, self.group = flat(wrapper)
        nodes, n = self.nodes, len(self.nodes)
        self.varied = any(varies)
        self.ends = closings(nodes)
        self.name = [x[1].lstrip("/").split(".")[0] if x[0] == "tag" else "" for x in nodes]
        # running sums up to each node: text, text in links, text that differs and its slots in repeated groups
        own, linked, varying, records = np.zeros((4, n + 1), np.int64)
        apart_until = link_until = -1
        for k, x in enumerate(nodes):
            if x[0] == "tag":
                if k in self.ends and x[2] == APART:
                    apart_until = max(apart_until, self.ends[k])
                if k in self.ends and self.name[k] == "a":
                    link_until = max(link_until, self.ends[k])
            elif k > apart_until:
                size = chars(x)
                own[k + 1] = size
                linked[k + 1] = size * (k <= link_until)
                varying[k + 1] = size * (k > link_until and (varies[k] or not self.varied))
                records[k + 1] = self.group[k] > 0
        self.own, self.linked, self.varying, self.records = (np.cumsum(x) for x in (own, linked, varying, records))
        self.varies = np.cumsum([0, *varies])
        self.excluded = self._agreed()

    def _in(self, sums: np.ndarray, k: int, end: int | None = None) -> int:
        return int(sums[self.ends.get(k, len(self.nodes)) if end is None else end] - sums[k])

    def _opens(self) -> Iterator[int]:
        return (k for k, x in enumerate(self.nodes) if x[0] == "tag" and x[1][0] != "/")

    def _agreed(self) -> list[int]:
        """Hinted elements that the wrapper agrees on: with less than half of the differing text, or a repeated group of several slots."""
        out, done, total = [], -1, int(self.varying[-1])
        for k in self._opens():
            if k > done and self.nodes[k][2] == HINT and k in self.ends:
                if 2 * self._in(self.varying, k) < total or (self._in(self.records, k) > 1 and self._in(self.varying, k) < total):
                    out.append(k)
                    done = self.ends[k]
        return out

    def locate(self) -> list | None:
        """[signature, number] of the element with the content.

        Weighed is the text of each element that differs between pages or isn't on all of them (all text where
        none differs, as on a host with one page), outside links and what is set apart; an article
        or main element with most of its page's text wins, else the innermost element with at least 0.6 of all
        such text. An element in a repeated group gives way to the one that holds the group.
        """
        weigh = self.varying.copy()
        for k in self.excluded:
            weigh[k:] -= np.minimum(weigh[k:], weigh[self.ends[k]]) - weigh[k]
        running = int(weigh[-1])
        if not running:
            return None
        found, counted, hidden = [], {}, [(k, self.ends[k]) for k in self.excluded]
        for k in self._opens():
            signature = self.nodes[k][1]
            nth = counted.get(signature, 0)
            counted[signature] = nth + 1
            if self.name[k] in HOLDERS and not self.group[k] and (k in self.ends or self.name[k] in ("article", "main", "body")) and not any(a <= k <= b for a, b in hidden):
                found.append((self._in(weigh, k), k, signature, nth))
        named = [x for x in found if self.name[x[1]] in ("article", "main") and x[0] > 0.3 * running]
        articles = [x for x in named if self.name[x[1]] == "article"] or named
        big = [x for x in found if x[0] >= 0.6 * running]
        best = max(articles, key=lambda x: (x[0], -x[1])) if articles else big[-1] if big else None
        return best and [best[2], best[3]]

    def fixed_blocks(self, pages: int) -> dict[str, list[str]]:
        """Containers whose text is the same on all pages: signature and digests. None if no text differs or the pages are few; headings alone stay."""
        out: dict[str, list[str]] = {}
        if not self.varied or pages < LEAST_PAGES:
            return out
        done = -1
        for k in self._opens():
            if k > done and k in self.ends and self.name[k] in PARTS and not self._in(self.varies, k):
                done, texts, under, last = self.ends[k], [], set(), k
                for x in range(k, done):
                    if self.nodes[x][0] == "tag":
                        last = x
                    else:
                        texts += (self.nodes[x][1] if self.nodes[x][0] == "text" else self.nodes[x][2]).split("\0")
                        under.add(self.name[last])
                if texts and not under <= HEADINGS:
                    out.setdefault(self.nodes[k][1], []).append(_digest(texts))
        return out

    def beside(self) -> list[str]:
        """Signatures of containers that are left out wherever they stand: agreed hints, and repeated links with no other text."""
        kinds: dict[str, list[bool]] = {}
        agreed = set(self.excluded)
        for k in self._opens():
            links = k in self.ends and self.name[k] in PARTS and self._in(self.records, k) > 0 and self._in(self.own, k) == self._in(self.linked, k) > 0
            if self.name[k] in PARTS or self.nodes[k][2] == HINT:
                kinds.setdefault(self.nodes[k][1], []).append(k in agreed or links)
        return sorted(signature for signature, all_ in kinds.items() if all(all_) and ("." in signature or signature in ("ul", "ol")))


def apply(wrapper: dict | None, source: str | None) -> tuple[str, bool]:
    """A page's text, and whether the wrapper's content element was there."""
    return read(wrapper, Page(source)) if source else ("", False)


def read(wrapper: dict | None, page: Page) -> tuple[str, bool]:
    place = wrapper and wrapper["content"] and page.find(*wrapper["content"])
    if place:
        return page.text(*place, wrapper), True
    own = described(*unite({0: (1, fold(stream(page)))}))
    place = own["content"] and page.find(*own["content"])
    return page.text(*(place or (0, len(page.kind))), own), False


def infer_wrappers(pages: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """(host, template, wrapper JSON) from all distinct pages.

    Pages of equal shape are merged within each task and then across tasks. The streams of a template are
    aligned in rounds, by ever shorter ends of their shapes' hashes, so that no task aligns all streams of a large template;
    what is aligned with what depends on the pages only.
    """
    scratch = Scratch(pages.sparkSession, "streams")
    columns = "host string, template string, shape long, pages long, nodes string"
    types = pa.schema([("host", pa.string()), ("template", pa.string()), ("shape", pa.int64()), ("pages", pa.int64()), ("nodes", pa.string())])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str, int], tuple[int, list]] = {}
        n = 0

        def out() -> pa.RecordBatch:
            rows = [(*key, count, json.dumps(nodes)) for key, (count, nodes) in held.items()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types.types, strict=True)], schema=types)

        for batch in batches:
            for host, source in zip(batch.column("host"), batch.column("html"), strict=True):
                page = Page(source.as_py())
                key, count, nodes = _folded(page)
                key = (host.as_py(), page.template(), key)
                n += 0 if key in held else len(nodes)
                _gather(held, key, count, nodes)
                if n > HELD_NODES:
                    yield out()
                    held.clear()
                    n = 0
        if held:
            yield out()

    def same_shape(rows: pd.DataFrame) -> pd.DataFrame:
        held: dict = {}
        for r in rows.itertuples():
            _gather(held, 0, r.pages, json.loads(r.nodes))
        return rows[["host", "template", "shape"]].head(1).assign(pages=held[0][0], nodes=json.dumps(held[0][1]))

    def aligned(rows: pd.DataFrame) -> pd.DataFrame:
        n, wrapper = unite({r.shape: (r.pages, json.loads(r.nodes)) for r in rows.itertuples()})
        return rows[["host", "template"]].head(1).assign(shape=rows["shape"].min(), pages=n, nodes=json.dumps(wrapper))

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [json.dumps(described(n, json.loads(x))) for n, x in zip(batch.column("pages").to_pylist(), batch.column("nodes").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("template"), pa.array(made, pa.string())], names=["host", "template", "wrapper"])

    distinct = pages.where("html IS NOT NULL AND html <> ''").select("host", "html").distinct()
    streams = scratch.keep(distinct.mapInArrow(tidy(parts), columns))
    streams = scratch.keep(streams.groupBy("host", "template", "shape").applyInPandas(same_shape, columns))
    most = streams.groupBy("host", "template").count().agg(F.max("count")).first()[0] or 0
    buckets = 1
    while buckets * fan_in < most:
        buckets *= fan_in
    while most > 1 and buckets:
        streams = scratch.keep(streams.groupBy("host", "template", F.pmod("shape", F.lit(buckets))).applyInPandas(lambda rows: aligned(rows), columns))
        buckets //= fan_in
    return streams.select("host", "template", "pages", "nodes").mapInArrow(tidy(final), "host string, template string, wrapper string")


def extract(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per page: page_id, url, text, n_chars, by_wrapper."""
    host = F.coalesce(F.lower(F.regexp_extract(F.col("url"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))
    rows = pick(pages, page_id="long", url="string", html="string").withColumn("host", host)
    scratch = Scratch(pages.sparkSession, "wrappers")
    found = scratch.keep(infer_wrappers(rows))
    # of each host what pages are read by: {template: rule} without the expressions
    parts = [x for c in ("content", "fixed", "beside") for x in (F.lit(f',"{c}":'), F.coalesce(F.get_json_object("wrapper", f"$.{c}"), F.lit("null")))]
    rule = F.concat(F.lit('"'), "template", F.lit('":{"by":1'), *parts, F.lit("}"))
    wrappers = scratch.keep(found.groupBy("host").agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(rule)), ","), F.lit("}")).alias("wrapper")))
    size = wrappers.agg(F.sum(F.octet_length("wrapper").cast("long") + F.octet_length("host"))).first()[0] or 0
    joined = rows.join(F.broadcast(wrappers) if size <= broadcast_bytes else wrappers, "host", "left")
    types = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("by_wrapper", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, dict] = {None: {}}
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                out = []
                for source, wrapper in zip(part.column("html"), part.column("wrapper").to_pylist(), strict=True):
                    if wrapper not in known:
                        if len(known) > 2000:
                            known = {None: {}}
                        known[wrapper] = json.loads(wrapper)
                    page = Page(source.as_py() or "")
                    out.append(read(known[wrapper].get(page.template()), page) if page.kind else ("", False))
                texts = [t for t, _ in out]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([w for _, w in out], pa.bool_())], schema=types)

    return joined.select("page_id", "url", "html", "wrapper").mapInArrow(tidy(run), "page_id long, url string, text string, n_chars long, by_wrapper boolean")
