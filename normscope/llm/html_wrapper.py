"""Main text of web pages by union-free wrapper inference.

Pages of one host come from few templates.  Each page is read as a stream of
structural tags and text; neighbouring repeats, of one block or of a row of blocks
such as a heading and its paragraphs, are folded into repeated groups, so pages that
differ only in how often a part occurs have one *form*.  The distinct forms of a
host are aligned with each other in small groups, then the wrappers of the groups,
until one is left: where two streams mismatch, a row of blocks that the other side
repeats joins its group, the part that one side lacks becomes optional, and
differing text a slot.  The result is the host's wrapper, a union-free regular
expression over tags and slots.

Over all pages of the host, each of the wrapper's slots gathers what its texts are
like (how long, how much of it links, whether it is the same text everywhere);
with the tags around the slot this tells the article's slots from the rest.
Extraction matches each page's form with its host's wrapper and reads those slots;
whether article and main tags mark the article is decided for each form by itself.
"""

from __future__ import annotations

import hashlib
import html as html_entities
import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, materialise

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|iframe|svg|select|math)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<![^>]*>|<\?[^>]*>"
    r"|</?([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</?([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
#: Tags that do not part the text they stand in.
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Parts of a page that are no article, by tag, by role, and by words in class or id.
_OUTSIDE = frozenset("head title nav header footer aside form menu dialog button".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog".split())
_WORDS = re.compile(
    r"nav\w*|menu\w*|header|masthead|footer|foot|side-?bar\w*|aside|ads?|advert\w*|sponsor\w*|promo\w*|banner|cookie\w*|consent|notice\w*|alert|popup|modal|newsletter|subscribe|signup|login|share|sharing|social|comments?|comment-\w+|respond|replies|disqus|related|recommend\w*|breadcrumbs?|pagination|pager|toolbar|widget\w*|form|search\w*|tags?|meta|byline|legal|copyright|skip\w*",
    re.I,
)
#: Within an article these name the part that holds its headline.
_HEADLINE = frozenset(("header", "masthead", "banner"))
#: Blocks nested deeper than this stand side by side.
DEEPEST = 150
#: What may stand beside those words in a class or id; any other part (tag-politics, no-sidebar, with-sidebar) makes it another word.
_BESIDE = frozenset("site page main entry post posts blog article top bottom left right global primary secondary sub list item items area wrap wrapper container inner outer box block bar section row col links link icons buttons button policy 0".split())
_FIRST = frozenset("tag tags category cat no not has have with without is hide show".split())
#: Their own class and id say what the page is about or how it is laid out, not that its text is no article.
_WHOLE = frozenset("html body article main".split())
_MAIN = frozenset(("article", "main"))
#: Kinds of slots: good ones within article or main tags, other good ones, those with the same text on many pages, those outside by a class or id alone.
INNER, OUTER, SAME, NAMED = 0, 1, 2, 3
_CLOSES = {t: {"p"} for t in "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()} | {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
_SCOPES = frozenset("article main section div td th li table ul ol body blockquote aside nav header footer form".split())


@dataclass
class Page:
    """Structural names in page order, and for each text its place among them, its characters and those in links."""

    names: list[str] = field(default_factory=list)
    texts: list[tuple[int, str, int]] = field(default_factory=list)  # place of the text's ``#`` among the names, text, linked characters


def read_page(source: str | None) -> Page:
    """The page's blocks.  A name is a block's path flags: where text may stand, ``#`` after its block's tag.

    Of blocks nested more than ``DEEPEST`` deep the inner ones stand side by side; their texts are read as any other.
    """
    page = Page()
    flat: dict[str, int] = {}  # open tags beyond that depth
    names = page.names
    stack: list[tuple[str, str]] = []
    buffer: list[str] = []
    linked, links = 0, 0
    source = source or ""
    at = 0

    def flush() -> None:
        nonlocal linked
        if buffer:
            raw = "".join(buffer)
            buffer.clear()
            text = " ".join((html_entities.unescape(raw) if "&" in raw else raw).split())
            if text:
                names.append("#")
                page.texts.append((len(names) - 1, text, linked))
        linked = 0

    def close(tags: set[str] | frozenset[str], scope: bool) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in tags:
                for _, name in reversed(stack[k:]):
                    names.append("/" + name)
                del stack[k:]
                return
            if scope and stack[k][0] in _SCOPES:
                return

    for m in _TOKEN.finditer(source):
        if m.start() > at:
            piece = source[at : m.start()]
            buffer.append(piece)
            if links:
                linked += len(piece.strip())
        at = m.end()
        tag = m.group(2) or m.group(4)
        if tag is None:
            continue
        tag = tag.lower()
        ending = source[m.start() + 1] == "/"
        if tag in _INLINE:
            if tag == "a":
                links = 0 if ending else 1
            elif tag in ("br", "img", "input"):
                buffer.append(" ")
            continue
        flush()
        if ending:
            if flat.get(tag):
                flat[tag] -= 1
            elif any(t == tag for t, _ in stack):
                close({tag}, False)
            continue
        if tag in _CLOSES:
            close(_CLOSES[tag], True)
        name = tag
        attributes = m.group(3) or m.group(5) or ""
        if attributes:
            marks = sorted(f"{k.lower()}={v.strip(chr(34) + chr(39)).strip()}" for k, v in _ATTRIBUTE.findall(attributes))
            if marks:
                name += "[" + ";".join(re.sub(r"\d+", "0", x) for x in marks) + "]"
        names.append(name)
        opens = tag not in _VOID and not attributes.rstrip().endswith("/")
        if opens and len(stack) < DEEPEST:
            stack.append((tag, name))
        else:
            names.append("/" + name)
            if opens:
                flat[tag] = flat.get(tag, 0) + 1
    if at < len(source):
        tail = source[at:]
        cut = re.search(r"<[!/?]?[a-zA-Z][^>]*\Z|<!--.*\Z|<\Z", tail, re.S)  # a page that ends within a tag
        buffer.append(tail[: cut.start()] if cut else tail)
    flush()
    for _, name in reversed(stack):
        names.append("/" + name)
    return page


def _tree(names: list[str]) -> list:
    """Blocks of names as nested lists: (label, children), and (``#``, place) for a text."""
    root: list = []
    open_lists = [root]
    for k, n in enumerate(names):
        if n == "#":
            open_lists[-1].append(("#", k))
        elif n[0] == "/":
            open_lists.pop()
        else:
            children: list = []
            open_lists[-1].append((n, children))
            open_lists.append(children)
    return root


@dataclass
class Folded:
    """A part of an expression: a block or a group of blocks (label ``(..``), whether it repeats or may lack, its children, and the texts it stands for."""

    label: str
    many: bool
    children: list[Folded]
    leaves: list[int]
    optional: bool = False


def _joined(x: Folded, y: Folded, many: bool) -> Folded:
    """Two parts of one label as one."""
    return Folded(x.label, many, merge(x.children, y.children), x.leaves + y.leaves, x.optional and y.optional)


def fold(names: list[str]) -> list[Folded]:
    """Fold neighbouring repeats into one part whose repeats are aligned with each other.

    A repeated part's children are the alignment of all repeats' children, so a
    list whose items differ still is one group.  Text slots side by side are one.
    """

    def of(children: list) -> list[Folded]:
        out: list[Folded] = []
        for label, inner in children:
            made = Folded("#", False, [], [inner]) if label == "#" else Folded(label, False, of(inner), [])
            if out and out[-1].label == label:
                out[-1] = _joined(out[-1], made, True)
            else:
                out.append(made)
        return grouped(out)

    return of(_tree(names))


def _group(row: list[Folded], many: bool) -> Folded:
    return Folded(f"({zlib.crc32(chr(31).join(x.label for x in row).encode()):08x}", many, row, [])


def grouped(parts: list[Folded], most: int = 6) -> list[Folded]:
    """Rows of two to ``most`` parts that follow themselves become one repeated group; shorter rows first, from the left."""
    for period in range(2, most + 1):
        labels = [x.label for x in parts]
        out: list[Folded] = []
        at = 0
        while at < len(parts):
            row = labels[at : at + period]
            end = at + period
            while labels[end : end + period] == row and len(row) == period:
                end += period
            if end - at < 2 * period:
                out.append(parts[at])
                at += 1
                continue
            group = _group(parts[at : at + period], True)
            for k in range(at + period, end, period):
                group = _joined(group, _group(parts[k : k + period], True), True)
            out.append(group)
            at = end
        parts = out
    return parts


def absorbed(parts: list[Folded], groups: list[Folded]) -> list[Folded]:
    """Rows of parts that another expression repeats as a group become that group."""
    for g in groups:
        row = [c.label for c in g.children]
        if g.label[0] != "(" or not row or g.label in (x.label for x in parts):
            continue
        out: list[Folded] = []
        at = 0
        while at < len(parts):
            if [x.label for x in parts[at : at + len(row)]] == row:
                out.append(Folded(g.label, True, parts[at : at + len(row)], []))
                at += len(row)
            else:
                out.append(parts[at])
                at += 1
        parts = out
    return parts


def aligned(a: list[Folded], b: list[Folded], most: int = 250_000) -> list[tuple[int | None, int | None]]:
    """Pairs of parts that stand for each other, and parts of one side alone, in order.

    Equal ends first, between them a longest common subsequence by label; beyond
    ``most`` comparisons each part meets the next one of its label.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head].label == b[head].label:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail].label == b[-1 - tail].label:
        tail += 1
    x, y = [p.label for p in a[head : len(a) - tail]], [p.label for p in b[head : len(b) - tail]]
    n, m = len(x), len(y)
    met: list[tuple[int, int]] = []
    if n * m > most:
        places: dict[str, list[int]] = {}
        for j in range(m - 1, -1, -1):
            places.setdefault(y[j], []).append(j)
        last = -1
        for i, label in enumerate(x):
            left = places.get(label, [])
            while left and left[-1] <= last:
                left.pop()
            if left:
                last = left.pop()
                met.append((i, last))
    else:
        best = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n - 1, -1, -1):
            for j in range(m - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
        i = j = 0
        while i < n and j < m:
            if x[i] == y[j]:
                met.append((i, j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    out: list[tuple[int | None, int | None]] = [(k, k) for k in range(head)]
    i = j = 0
    for p, q in [*met, (n, m)]:
        out += [(head + k, None) for k in range(i, p)] + [(None, head + k) for k in range(j, q)]
        if p < n:
            out.append((head + p, head + q))
        i, j = p + 1, q + 1
    return out + [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]


def merge(a: list[Folded], b: list[Folded]) -> list[Folded]:
    """One expression for both: aligned parts are merged, rows that one side repeats join its group, what only one side has is optional."""
    a, b = absorbed(a, b), absorbed(b, a)
    out: list[Folded] = []

    def add(x: Folded) -> None:
        if out and out[-1].label == x.label:  # two optional parts of one label side by side repeat
            out[-1] = _joined(out[-1], x, True)
        else:
            out.append(x)

    for i, j in aligned(a, b):
        if i is not None and j is not None:
            made = _joined(a[i], b[j], a[i].many or b[j].many)
            add(Folded(made.label, made.many, made.children, made.leaves, a[i].optional or b[j].optional))
        else:
            x = a[i] if i is not None else b[j]
            add(Folded(x.label, x.many, x.children, x.leaves, True))
    return out


def slots(nodes: list[Folded], path: tuple[str, ...] = ()) -> Iterator[tuple[str, list[int]]]:
    """Every text slot as (path, texts that stand in it); a path is labels with their rank among equal ones."""
    rank: dict[str, int] = {}
    for n in nodes:
        k = rank[n.label] = rank.get(n.label, -1) + 1
        here = (*path, f"{n.label}~{k}" if k else n.label)
        if n.label == "#":
            yield " > ".join(here), n.leaves
        yield from slots(n.children, here)


def dump(nodes: list[Folded]) -> list:
    return [[n.label, n.many + 2 * n.optional, dump(n.children)] for n in nodes]


def load(data: list) -> list[Folded]:
    return [Folded(label, bool(kind & 1), load(children), [], bool(kind & 2)) for label, kind, children in data]


def expression(nodes: list[Folded]) -> str:
    """The wrapper as a readable regular expression: ``(...)+`` repeats, ``(...)?`` may lack, ``(...)*`` both, ``#`` is a slot."""

    def one(n: Folded) -> str:
        mark = "*" if n.many and n.optional else "+" if n.many else "?" if n.optional else ""
        inner = expression(n.children)
        return (n.label if n.label == "#" else f"({inner})" if n.label[0] == "(" else f"({n.label} {inner})" if inner else f"({n.label})") + mark

    return "".join(map(one, nodes))


def match(page: list[Folded], wrapper: list[Folded], path: tuple[str, ...] = ()) -> Iterator[tuple[str, list[int]]]:
    """Slots of a page's form by the wrapper's paths: the form is aligned with the expression as forms are; parts that it lacks keep their own path."""
    rank: dict[str, int] = {}
    names = []
    for n in wrapper:
        k = rank[n.label] = rank.get(n.label, -1) + 1
        names.append(f"{n.label}~{k}" if k else n.label)
    page = absorbed(page, wrapper)
    for i, j in aligned(page, wrapper):
        if i is None:
            continue
        n = page[i]
        if j is None:  # out of order: the first part of its label
            j = next((k for k in range(len(wrapper)) if wrapper[k].label == n.label), None)
        here = (*path, names[j] if j is not None else n.label)
        if n.label == "#":
            yield " > ".join(here), n.leaves
        else:
            yield from match(n.children, wrapper[j].children if j is not None else [], here)


def host_of(url):
    """Host of an address, lower case; null and odd addresses share the empty host."""
    return F.lower(F.coalesce(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per host, form and slot of some pages: pages, texts, characters, linked characters, least and largest text hash, and up to three hashes of different page contents.

    A form is named by a digest; its text stands in one row, that of the empty slot, so a page's rows grow with its blocks and not with their square.
    """
    names = ["host", "digest", "slot", "form", "pages", "texts", "chars", "linked", "least", "largest", "contents"]
    for whole in batches:
        found: dict[tuple[str, str], dict[str, list]] = {}
        forms: dict[str, str] = {}
        for part in byte_slices(whole, "html"):
            for host, source in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True):
                page = read_page(source)
                form = fold(page.names)
                body = {k: (t, n) for k, t, n in page.texts}
                text = json.dumps(dump(form), separators=(",", ":"))
                digest = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
                forms[digest] = text
                key = (host, digest)
                stats = found.setdefault(key, {"": [0, 0, 0, 0, 0, 0, []]})
                stats[""][0] += 1
                places = [(slot, [body[k] for k in leaves if k in body]) for slot, leaves in slots(form)]
                content = zlib.crc32("\n".join(t for slot, texts in places if not _outside(slot)[0] for t, _ in texts).encode("utf-8", "surrogatepass"))
                for slot, texts in places:
                    said = zlib.crc32("\n".join(t for t, _ in texts).encode("utf-8", "surrogatepass"))
                    s = stats.setdefault(slot, [0, 0, 0, 0, said, said, []])
                    s[0] += 1
                    s[1] += len(texts)
                    s[2] += sum(len(t) for t, _ in texts)
                    s[3] += sum(n for _, n in texts)
                    s[4], s[5] = min(s[4], said), max(s[5], said)
                    if len(s[6]) < 3 and content not in s[6]:
                        s[6].append(content)
        rows = [(host, digest, slot, None if slot else forms[digest], *s) for (host, digest), by in found.items() for slot, s in by.items()]
        if rows:
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns[:4]] + [pa.array(c, pa.int64()) for c in columns[4:-1]] + [pa.array(columns[-1], pa.list_(pa.int64()))], names=names)


def _names_outside(token: str, within: bool = False) -> bool:
    """Whether one class or id names a part that is no article: such a word, or one with nothing but place words beside it.

    ``within``: it stands in an article, where a header is the article's own.
    """
    parts = [p for p in re.split(r"[-_]+", token.lower()) if p]
    if within and _HEADLINE.intersection(parts):
        return False
    if _WORDS.fullmatch(token):
        return True
    if len(parts) < 2 or parts[0] in _FIRST:
        return False
    words = [bool(_WORDS.fullmatch(p)) for p in parts]
    return any(words) and all(w or p in _BESIDE for w, p in zip(words, parts, strict=True))


@lru_cache(maxsize=65_536)
def _outside(path: str) -> tuple[int, str]:
    """0: may be the article; 1: outside by a class or id alone, and the path down to it; 2: outside by a tag, a role or hidden."""
    parts = path.split(" > ")
    named = ""
    within = False
    for k, part in enumerate(parts):
        tag, _, marks = part.partition("[")
        tag = tag.partition("~")[0]
        within = within or tag == "article"
        if tag in _OUTSIDE and not (within and tag == "header"):
            return 2, ""
        for mark in marks.rpartition("]")[0].split(";") if marks else ():
            kind, _, value = mark.partition("=")
            if kind == "hidden" or (kind == "aria-hidden" and value == "true") or (kind == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                return 2, ""
            if kind == "role" and value.lower() in _ROLES:
                return 2, ""
            if not named and kind in ("class", "id") and tag not in _WHOLE and any(_names_outside(v, within) for v in value.split()):
                named = " > ".join(parts[: k + 1])
    return (1, named) if named else (0, "")


def _inside(path: str) -> bool:
    for part in path.split(" > "):
        tag, _, marks = part.partition("[")
        if tag.partition("~")[0] in _MAIN or "role=main" in marks:
            return True
    return False


#: Blocks that are the article's own where they stand in one, however much of them links.
_PROSE = frozenset("h1 h2 h3 h4 h5 h6 p blockquote figcaption pre dt dd".split())


def _is_prose(path: str) -> bool:
    blocks = [part.partition("[")[0].partition("~")[0] for part in path.split(" > ")]
    return bool(_PROSE.intersection(blocks[-2:]))


def slot_kinds(stats: dict[str, list]) -> dict[str, list[float]]:
    """The slots that may hold the article: not outside by their tags, not mostly links.

    The same text on three or more pages that differ elsewhere is boilerplate; copies of one page are one content.
    Each with its kind, its unlinked characters a page, and its characters a text.
    """
    found = {}
    for path, (n, texts, chars, linked, least, largest, contents) in stats.items():
        outside, _ = _outside(path)
        if outside == 2 or chars == 0:
            continue
        same = least == largest and len(set(contents)) >= 3
        inside = _inside(path)
        if linked * 2 > chars and not inside or linked * 10 > chars * 9 and not (inside and _is_prose(path)):
            continue
        found[path] = [NAMED if outside else INNER if inside else SAME if same else OUTER, (chars - linked) / n, chars / max(texts, 1)]
    return dict(sorted(found.items()))


def chosen_slots(paths: list[str], kinds: dict[str, list[float]], cards: bool) -> set[str]:
    """Which of a form's slots are read: those within article or main tags if the article is there, else all good ones.

    ``cards``: the form has several article blocks, as teasers are; then the article is
    in them only if no slot outside has longer texts.  Else a quarter of the text outside is enough.
    Where nothing good is left, slots of the same text are read; where classes and ids leave
    nothing, the block so named that holds most text.
    """
    at = {p: kinds[p] for p in paths if p in kinds}
    best = min((v[0] for v in at.values()), default=INNER)
    if best == SAME:
        return {p for p, v in at.items() if v[0] == SAME}
    if best == NAMED:
        held_by: dict[str, float] = {}
        for p, v in at.items():
            held_by[_outside(p)[1]] = held_by.get(_outside(p)[1], 0) + v[1]
        most = max(sorted(held_by), key=lambda block: held_by[block])
        return {p for p in at if _outside(p)[1] == most}
    inner, outer = ([v for v in at.values() if v[0] == kind] for kind in (INNER, OUTER))
    if inner and outer:
        held = max(v[2] for v in inner) >= max(v[2] for v in outer) if cards else 4 * sum(v[1] for v in inner) >= sum(v[1] for v in outer)
    else:
        held = bool(inner)
    return {p for p, v in at.items() if v[0] == INNER or v[0] == OUTER and not held}


def has_cards(nodes: list[Folded]) -> bool:
    """Whether a form has more than one article block."""

    def count(nodes: list[Folded], times: int) -> int:
        return sum((n.label.partition("[")[0] == "article") * times * (2 if n.many else 1) + count(n.children, 2 if n.many and n.label[0] == "(" else times) for n in nodes)

    return count(nodes, 1) > 1


def _merge_forms(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One wrapper of some forms or wrappers of a host, the most frequent first."""
    rows = rows.sort_values(["pages", "nodes"], ascending=[False, True], kind="stable")
    wrapper = load(json.loads(rows["nodes"].iloc[0]))
    for text in rows["nodes"].iloc[1:]:
        wrapper = merge(wrapper, load(json.loads(text)))
    return pd.DataFrame({"host": [key[0]], "nodes": [json.dumps(dump(wrapper), separators=(",", ":"))], "pages": [int(rows["pages"].sum())], "forms": [int(rows["forms"].sum())]})


def _merged(forms: DataFrame, most: int = 32) -> DataFrame:
    """``host``, ``nodes``, ``pages``, ``forms``: each host's wrapper.  A task merges about ``most`` of a host's forms, then of the wrappers so made."""
    parts = materialise(forms, "forms")
    while (largest := parts.groupBy("host").count().agg(F.max("count")).first()[0] or 0) > 1:
        bins = -(-largest // most)
        dealt = parts.withColumn("bin", F.pmod(F.xxhash64("nodes"), F.lit(bins)).cast("int"))
        parts = materialise(dealt.groupBy("host", "bin").applyInPandas(_merge_forms, "host string, nodes string, pages long, forms long"), "forms")
    return parts


def _leaves(nodes: list[Folded]) -> Iterator[Folded]:
    for n in nodes:
        if n.label == "#":
            yield n
        yield from _leaves(n.children)


def _in_wrapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Statistics of each form's slots, by the wrapper's paths."""
    names = ["host", "slot", "pages", "texts", "chars", "linked", "least", "largest", "contents"]
    wrapper_of: dict[str, list[Folded]] = {}
    for batch in batches:
        for part in byte_slices(batch, "nodes"):
            rows = []
            for r in part.to_pylist():
                if r["nodes"] not in wrapper_of:
                    if len(wrapper_of) > 100:
                        wrapper_of.clear()
                    wrapper_of[r["nodes"]] = load(json.loads(r["nodes"]))
                form = load(json.loads(r["form"]))
                for k, leaf in enumerate(_leaves(form)):
                    leaf.leaves = [k]
                own = {k: p for p, leaves in slots(form) for k in leaves}
                to_wrapper = {own[k]: p for p, leaves in match(form, wrapper_of[r["nodes"]]) for k in leaves}
                rows += [(r["host"], to_wrapper.get(x["slot"], x["slot"]), *(x[c] for c in names[2:])) for x in r["stats"]]
            if rows:
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns[:2]] + [pa.array(c, pa.int64()) for c in columns[2:-1]] + [pa.array(columns[-1], pa.list_(pa.int64()))], names=names)


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            kinds = slot_kinds({r["slot"]: [r[c] for c in ("pages", "texts", "chars", "linked", "least", "largest", "contents")]})
            rows += [(r["host"], p, v) for p, v in kinds.items()]
        if rows:
            hosts, paths, values = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(values, pa.list_(pa.float64()))], names=["host", "slot", "kind"])


def _three(column: str) -> Column:
    """Up to three different values of a group's short arrays: one array of three for each batch of pages is the most that meets."""
    return F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(column)))), 1, 3).alias(column)


def infer_wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``host``, ``wrapper`` (JSON), ``pages``, ``forms``: one row for each host, from all its pages.

    Pages are counted by form before the shuffle, forms are merged as a tree of
    small groups, and slots are counted by the wrapper's paths, so no task holds
    all of a host.  The wrapper itself is as large as the host's parts are various.
    """
    source = pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html"))
    kinds = "pages long, texts long, chars long, linked long, least long, largest long, contents array<long>"
    seen = source.mapInArrow(_survey, f"host string, digest string, slot string, form string, {kinds}")
    sums = [*(F.sum(c).alias(c) for c in ("pages", "texts", "chars", "linked")), F.min("least").alias("least"), F.max("largest").alias("largest"), _three("contents")]
    found = materialise(seen.groupBy("host", "digest", "slot").agg(F.min("form").alias("form"), *sums), "slots")
    forms = found.where("slot = ''")
    wrappers = _merged(forms.select("host", F.col("form").alias("nodes"), "pages", F.lit(1).cast("long").alias("forms")))
    by_form = found.where("slot <> ''").groupBy("host", "digest").agg(F.collect_list(F.struct("slot", *(c.split()[0] for c in kinds.split(", ")))).alias("stats"))
    whole = by_form.join(forms.select("host", "digest", "form"), ["host", "digest"]).drop("digest")
    stats = whole.join(wrappers.select("host", "nodes"), "host").mapInArrow(_in_wrapper, f"host string, slot string, {kinds}").groupBy("host", "slot").agg(*sums)
    good = stats.mapInArrow(_judged, "host string, slot string, kind array<double>").groupBy("host").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("slot", "kind"))))).alias("good"))
    text = F.concat(F.lit('{"nodes":'), "nodes", F.lit(',"slots":'), F.coalesce("good", F.lit("{}")), F.lit("}"))
    return wrappers.join(good, "host", "left").select("host", text.alias("wrapper"), "pages", "forms")


class Extractor:
    """Reads pages by their host's wrapper; remembers which paths of which form are the article's."""

    def __init__(self, most: int = 20_000):
        self.most, self.wrappers, self.known = most, {}, {}

    def __call__(self, source: str | None, wrapper_text: str | None) -> list[str]:
        page = read_page(source)
        if not page.texts:
            return []
        if wrapper_text not in self.wrappers:
            if len(self.wrappers) > self.most:
                self.wrappers.clear()
            made = json.loads(wrapper_text) if wrapper_text else {"nodes": [], "slots": []}
            self.wrappers[wrapper_text] = (load(made["nodes"]), dict(made["slots"]))
        wrapper, kinds = self.wrappers[wrapper_text]
        form = fold(page.names)
        places = list(match(form, wrapper))
        good = chosen_slots([path for path, _ in places], kinds, has_cards(form))
        wanted = {k for path, leaves in places if path in good for k in leaves}
        return [t for k, t, _ in page.texts if k in wanted]


def extract_text(pages: DataFrame, wrappers: DataFrame | None = None, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per page: key, url, ``text`` (the article's blocks joined by two line ends), ``n_chars``.

    Null, empty and text-less pages give the empty text; every row is kept,
    repeated keys too.  ``wrappers`` may come from another table of the same
    hosts; without it they are inferred from ``pages``.
    """
    known = materialise((wrappers if wrappers is not None else infer_wrappers(pages, url, html)).select("host", "wrapper"), "wrappers")
    source = pages.select(F.col(key), F.col(url), F.col(html).alias("html"), host_of(F.col(url)).alias("host"))
    joined = source.join(known, "host", "left").select(key, url, "html", "wrapper")
    schema = pages.select(key, url).schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extract = Extractor()
        for batch in batches:
            for part in byte_slices(batch, "html"):
                texts = ["\n\n".join(extract(h, w)) for h, w in zip(part.column("html").to_pylist(), part.column("wrapper").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(key), part.column(url), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[key, url, "text", "n_chars"])

    return joined.mapInArrow(run, schema)
