"""HTML main-text extraction by wrappers: union-free expressions inferred from the pages of a host.

A page is parsed to a tree of block elements and text slots. Trees of one host are aligned child by child: elements that
one page lacks become optional, runs of like elements repeated groups (of up to PERIOD elements), and texts that differ become slots, texts
that don't stay fixed. The host's wrapper tells where the article is (an article or main element, else the element whose slots hold most
text outside links) and which texts are fixed, in it or outside: those are the host's own. The page is then read along the wrapper: the texts of
the main element's slots come out, fixed ones don't, unless they are most of the element (copies of one article).

Menus, notices, adverts, comments and the like are told by tag, role and class names. A class name alone drops a block only where the wrapper has other text: one that holds KEPT_SHARE of the slot
text outside links, of the page or of the article it is in, stays. A page that is left without any text so is judged by itself.

Wrappers are merged in a tree of partial merges, FAN of them at most in one task, after equal page trees of a host are counted as one: a host that
holds a third of all pages is dealt to many tasks. A wrapper's size is bounded: an element with more than WIDE kinds of
children keeps them as a bag, in which the commoner kinds stand as they are and the rarer ones are one kind a tag name, subtrees included.

Defined results: null or empty html gives an empty text and length 0; a null url counts as a host of its own name, empty; markup that ends
early is read as far as it goes, and a quote without its end doesn't go beyond the tag; long pages are read whole, and elements at any depth; repeated rows come out as they are; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsframe.llm.common import bounded_batches, materialise, spread_join
from oddsframe.llm.url_filter import host_of

FAN, WIDE, PERIOD, DEEP = 256, 48, 4, 60
#: Share of the text around it from which an element stays in spite of its names; and in spite of names of reader comments.
KEPT_SHARE = (0.8, 0.9)
_COMMENT_NAME = re.compile("comment|discuss|disqus|respond|replies")
#: Pages that a text must be the same on to be a host's own.
FIXED_PAGES = 3
#: Bytes of readings that are broadcast, at most.
SENT = 32_000_000

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>=]+|=\s*(?:\"[^\"]*\"|'[^']*')|=)*+)>|<[a-zA-Z/][^>]*\Z|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
_RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
#: Elements within a line that are never text.
_GADGETS = {"noscript", "template", "object", "svg", "math", "canvas", "select", "button", "audio", "video", "map", "progress", "meter", "datalist"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "output", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "center"}
#: Elements never part of a main text; header only outside an article.
_BOILER = {"head", "nav", "footer", "aside", "form", "menu", "dialog", "fieldset", "header"}
#: Names of a page's header; within an article they are the article's.
_HEADER_NAMES = {"header", "hdr", "top", "topbar", "top-bar", "site-top"}
_BOILER_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "form", "menu", "menubar"}
_BOILER_NAME = re.compile(r"(?:^|[^a-z])(ads?|adverts?|advertis(?:ements?|ing)|adsense|sponsor(?:ed|s)?|promo(?:tion)?s?|banner|sidebars?|side-?bar|aside|rail|menus?|dropdown|nav|navbar|navigation|breadcrumbs?|footer|masthead|site-?header|page-?header|cookies?|consent|gdpr|notices?|alert|newsletter|subscribe|subscription|signup|login|comments?|comment-?list|discussions?|disqus|respond|replies|social|share|sharing|related|recommended|popup|modal|overlay|toolbar|pagination|pager|skip-?link|widget|copyright|legal)(?:$|[^a-z])")
#: A start of the left element ends an open element of the right kinds.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
_SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}


class Element:
    __slots__ = ("children", "drop", "inline", "inner", "key", "level", "name", "named")

    def __init__(self, name: str, key: str, drop: bool, inline: bool = False, named: bool = False):
        self.name, self.key, self.drop, self.inline, self.children = name, key, drop, inline, []
        self.named = named  # dropped for its class names alone
        self.level, self.inner = 0, False  # elements around it in the tree; in an article or main element

def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)} if raw.strip(" /\n\t") else {}


def _kind(name: str, raw: str) -> tuple[str, bool, bool, str]:
    """The key of an element in wrappers, if it isn't main text, if only its names say so, and its names. A key holds long lists of names by a hash."""
    a = _attributes(raw)
    names = f"{a.get('class', '')} {a.get('id', '')}".lower().split()
    label = ".".join(sorted({x for n in names if (x := re.sub(r"[^a-z-]+", "", n))}))
    hidden = "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()
    sure = name in _BOILER or hidden or a.get("role", "").lower() in _BOILER_ROLE
    drop = sure or any(_BOILER_NAME.search(re.sub(r"([a-z])([A-Z])", r"\1-\2", n)) for n in names)
    short = label if len(label) <= 40 else f"{label[:24]}~{xxhash.xxh64_intdigest(label):016x}"
    drop = drop and name not in ("html", "body", "article", "main") or drop and bool(re.search("comment", label))
    return (f"{name}.{short}" if label else name), drop, drop and not sure, label


def parse(text: str) -> Element:
    """The tree of block elements; strings among the children are text (links as ("a", text)). Inline elements leave no trace but their text.

    What stands deeper than DEEP elements is opened and closed like any other, but its texts are children of the last one (articles have DEEP more).
    """
    root = Element("", "", False)
    stack, pos, link = [root], 0, 0
    opened: Counter = Counter()

    def shut(k: int) -> None:
        nonlocal link
        opened.subtract(e.name for e in stack[k:])
        flat = stack[k].level > DEEP
        del stack[k:]
        link = 0
        if flat:
            stack[-1].children.append(("|", ""))

    def push(e: Element, seen: bool = True) -> None:
        if seen:
            stack[-1].children.append(e)
        e.level, e.inner = stack[-1].level + 1, stack[-1].inner or e.name in ("article", "main")
        stack.append(e)
        opened[e.name] += 1

    n = len(text)
    while pos < n:
        m = _TOKEN.match(text, pos)
        pos = m.end()
        name = m[2]
        if name is None:
            got = m[0]
            if got[0] != "<" or got == "<":
                stack[-1].children.append(("a" if link else "#", got))
            continue
        name = name.lower()
        if m[1]:
            if name == "a":
                link = max(0, link - 1)
            elif name not in _INLINE:
                if opened[name] > 0:
                    shut(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].name == name))
                else:
                    stack[-1].children.append(("|", ""))
            continue
        if name in _RAW:
            if not m[3].rstrip().endswith("/"):
                close = re.compile(rf"</{name}[^>]*>", re.I).search(text, pos)
                pos = close.end() if close else n
            continue
        if name == "br":
            stack[-1].children.append(("#", " "))
            continue
        if name in _INLINE or name in _VOID:
            link += name == "a"
            if name == "hr":
                stack[-1].children.append(("|", ""))
            continue
        if name in _GADGETS:
            if not m[3].rstrip().endswith("/"):
                push(Element(name, name, True, True))
            continue
        ends = any(opened[x] > 0 for x in ("p", *_ENDS.get(name, ())))
        for k in range(len(stack) - 1, 0, -1) if ends else ():
            if stack[k].inline or stack[k].name in _SCOPE.get(name, ()):
                break
            if stack[k].name in _ENDS.get(name, ()) or stack[k].name == "p":
                shut(k)
                break
            if name == "p":
                break
        key, drop, named, label = _kind(name, m[3])
        if stack[-1].inner:
            drop = drop and (name != "header" or bool(_BOILER_NAME.search(label)))
        elif name not in ("html", "body", "article", "main"):
            top = not _HEADER_NAMES.isdisjoint(label.split("."))
            drop, named = drop or top, named or top and not drop
        e, level = Element(name, key, drop, named=drop and named), stack[-1].level
        if drop or level < DEEP or name in ("article", "main") and level < 2 * DEEP and not stack[-1].inner:
            push(e)
        else:
            stack[-1].children.append(("|", ""))
            e.children = stack[-1].children
            push(e, False)
    return root


# Wrappers are JSON lists: an element is [key, flag, pages, children], flag one of "1?+*"; a text [ "#", flag, pages, fixed hash or null, characters, characters in links];
# a group of elements [ "(", flag, pages, children ]; a bag of kinds without order, the only child then, [ "{", "*", pages, children ]. The key "div.*" stands for the rarer div kinds of a bag.


#: Before the key of an element that is dropped for its names, unless it holds nearly all of the text (_kept).
NAMED = "~"


def wrapper_of(e: Element) -> list:
    """The wrapper of one page."""
    children, text, linked, whole = [], 0, 0, []

    def close() -> None:
        nonlocal text, linked
        if whole and (s := " ".join(" ".join(whole).split())):
            children.append(["#", "1", 1, f"{xxhash.xxh64_intdigest(s.encode('utf-8', 'surrogatepass')):x}", text, linked])
        text, linked = 0, 0
        whole.clear()

    for c in e.children:
        if isinstance(c, Element):
            if c.inline:
                continue
            close()
            if not c.drop:
                children.append(wrapper_of(c))
            elif c.named:
                key, *rest = wrapper_of(c)
                children.append([NAMED + key, *rest])
        elif c[0] == "|":
            close()
        else:
            whole.append(c[1])
            text += len(c[1])
            linked += len(c[1]) * (c[0] == "a")
    close()
    return [e.key, "1", 1, folded(children)]


def _loose(flag: str) -> str:
    return {"1": "?", "+": "*"}.get(flag, flag)


def _joined(a: str, b: str, repeat: bool) -> str:
    many, optional = repeat or a in "+*" or b in "+*", a in "?*" or b in "?*"
    return "*" if many and optional else "+" if many else "?" if optional else "1"


def _id(x: list) -> str:
    return "(" + " ".join(_id(y) for y in x[3]) if x[0] == "(" else x[0]


def merged(a: list, b: list, repeat: bool = False) -> list:
    """One wrapper for both; repeat: they stand side by side in one page."""
    flag, pages = _joined(a[1], b[1], repeat), max(a[2], b[2]) if repeat else a[2] + b[2]
    if a[0] == "#":
        return ["#", flag, pages, a[3] if a[3] == b[3] else None, a[4] + b[4], a[5] + b[5]]
    return [a[0], flag, pages, aligned(a[3], b[3], repeat)]


def folded(children: list) -> list:
    """Runs of like children, or of like groups of children, as one repeated child."""
    out = list(children)
    for period in range(1, PERIOD + 1):
        done, i = [], 0
        while i < len(out):
            group = out[i : i + period]
            ids, j = [_id(x) for x in group], i + period
            if len(group) == period and (period == 1 or len(set(ids)) > 1):
                while [_id(x) for x in out[j : j + period]] == ids:
                    group = [merged(x, y, True) if period == 1 else _same(x, y) for x, y in zip(group, out[j : j + period], strict=True)]
                    j += period
            if j > i + period:
                done.append(group[0] if period == 1 else ["(", "+", group[0][2], group])
                i = j
            else:
                done.append(out[i])
                i += 1
        out = done
    return [_bag(out)] if len(out) > WIDE else out


def _bag(children: list) -> list:
    """Children as a bag; a bag alone stays as it is."""
    if len(children) == 1 and children[0][0] == "{":
        return children[0]
    return _bagged([children], max((x[2] for x in children), default=0), True)


def _bagged(lists: list[list], pages: int, repeat: bool) -> list:
    """One bag of child lists, of one page or of different ones: texts by hash and elements by key, the rarer ones by tag name."""

    def add(kinds: dict[str, list], key: str, x: list, repeat: bool) -> None:
        x = [x[0] if x[0] == "#" else key, "*", *x[2:]]
        kinds[key] = merged(kinds[key], x, repeat) if key in kinds else x

    total: dict[str, list] = {}
    for children in lists:
        kinds: dict[str, list] = {}
        for x in _flat(["", "1", 1, children]):
            add(kinds, f"#{x[3] or ''}" if x[0] == "#" else x[0], x, True)
        for key, x in kinds.items():
            add(total, key, x, repeat)
    if len(total) > WIDE:
        order = sorted(total, key=lambda k: (-total[k][2], k))
        few: dict[str, list] = {k: total[k] for k in order[: WIDE // 2]}
        for k in order[WIDE // 2 :]:
            add(few, "#" if k[0] == "#" else k.partition(".")[0] + ".*", total[k], False)
        total = few
    return ["{", "*", pages, [total[k] for k in sorted(total)]]


def _grouped(children: list, groups: list[list]) -> list:
    """Children with the elements of known groups put together, even where they stand once."""
    out = list(children)
    for g in groups:
        ids, n, i, done = [_id(x) for x in g[3]], len(g[3]), 0, []
        while i < len(out):
            if [_id(x) for x in out[i : i + n]] == ids:
                done.append(["(", "1", out[i][2], out[i : i + n]])
                i += n
            else:
                done.append(out[i])
                i += 1
        out = done
    return out


def aligned(a: list, b: list, repeat: bool) -> list:
    """Two child lists as one: the longest common subsequence is merged, what one lacks becomes optional."""
    if any(len(x) == 1 and x[0][0] == "{" for x in (a, b)):
        a, b = _bag(a), _bag(b)
        return [_bagged([a[3], b[3]], max(a[2], b[2]) if repeat else a[2] + b[2], repeat)]
    groups = [x for x in a + b if x[0] == "("]
    a, b = (folded(_grouped(x, groups)) for x in (a, b)) if groups else (a, b)
    n, m = len(a), len(b)
    ia, ib = [_id(x) for x in a], [_id(x) for x in b]
    if ia == ib:
        return [merged(x, y, repeat) if not repeat else _same(x, y) for x, y in zip(a, b, strict=True)]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if ia[i] == ib[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    out = []
    while i < n or j < m:
        if i < n and j < m and ia[i] == ib[j]:
            out.append(merged(a[i], b[j]) if not repeat else _same(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j >= m or i < n and best[i + 1][j] >= best[i][j + 1]:
            out.append([a[i][0], _loose(a[i][1]), *a[i][2:]])
            i += 1
        else:
            out.append([b[j][0], _loose(b[j][1]), *b[j][2:]])
            j += 1
    return folded(out)


def _same(x: list, y: list) -> list:
    """Merged as inner parts of a repetition: their own flags stay."""
    out = merged(x, y, True)
    out[1] = _joined(x[1], y[1], False)
    return out


def is_fixed(x: list, least: float = FIXED_PAGES) -> bool:
    """If a text is the same on all the pages that have it, and these are enough to tell."""
    return x[3] is not None and x[2] >= least


def _volume(x: list) -> tuple[int, int]:
    """Characters in the slots, and those in links. Fixed texts don't count."""
    if x[0] == "#":
        return (0, 0) if is_fixed(x) else (x[4], x[5])
    parts = [_volume(c) for c in x[3]]
    return sum(p[0] for p in parts), sum(p[1] for p in parts)


def _prose(x: list, fixed: bool) -> int:
    """Characters outside links in the slots (fixed: in all texts) of what isn't dropped for its names."""
    if x[0] == "#":
        return max(0, x[4] - x[5]) if fixed or not is_fixed(x) else 0
    return sum(_prose(c, fixed) for c in x[3] if not c[0].startswith(NAMED))


def _kept(wrapper: list) -> set[str]:
    """Keys of elements that stay in spite of their names, since the wrapper has nearly all text in them: KEPT_SHARE of the slot text outside links of the page, or of the
    article around them. What a name says of reader comments needs more against it, since comments can be longer than what they are about."""
    found: set[str] = set()

    def look(x: list, around: tuple[int, int]) -> None:
        if x[0] == "#":
            return
        if re.match(r"(article|main)(\.|$)", x[0]):
            around = _prose(x, False), _prose(x, True)
        for c in x[3]:
            if c[0].startswith(NAMED):
                own = _prose(c, False), _prose(c, True)
                n, rest = (own[0], around[0]) if own[0] + around[0] else (own[1], around[1])
                if n and n >= KEPT_SHARE[bool(_COMMENT_NAME.search(c[0]))] * (n + rest):
                    found.add(c[0])
            look(c, around)

    look(wrapper, (_prose(wrapper, False), _prose(wrapper, True)))
    return found


def _decided(x: list, kept: set[str]) -> list:
    """The wrapper without what its names drop, and with what stays under its plain key."""
    if x[0] == "#":
        return x
    children = [_decided(c, kept) for c in x[3] if not c[0].startswith(NAMED) or c[0] in kept]
    return [x[0].removeprefix(NAMED), *x[1:3], children]


def revive(e: Element, kept: set[str]) -> None:
    """The page's elements that stay in spite of their names are no longer dropped."""
    for c in e.children if kept else ():
        if isinstance(c, Element):
            c.drop = c.drop and not (c.named and NAMED + c.key in kept)
            revive(c, kept)


def reading_of(wrapper: list) -> dict:
    """How to read a host's pages: the path of its main element, the hashes of the wrapper's fixed texts, which are the host's own, and the keys of elements that
    their names alone don't drop.

    Within an article or main element a text is fixed if half of its pages at least have it, outside if FIXED_PAGES do."""
    own: list[str] = []
    mains: list[str] = []
    kept = _kept(wrapper)
    wrapper = _decided(wrapper, kept)

    def walk(x: list, path: str, least: float, inside: bool) -> None:
        if x[0] == "#":
            if is_fixed(x, least):
                own.append(x[3])
            return
        here = path if x[0] in ("(", "{", "") else f"{path}/{x[0]}"
        if not inside and re.match(r"(article|main)(\.|$)", x[0]):
            mains.append(here)
            inside, least = True, max(FIXED_PAGES, x[2] / 2)
        for c in x[3]:
            walk(c, here, least if inside else max(FIXED_PAGES, x[2] / 2) if x[0] == "{" else FIXED_PAGES, inside)  # texts of a bag are the host's if on half of its pages

    walk(wrapper, "", FIXED_PAGES, False)
    own = sorted(set(own))
    if mains:
        first = [p for p in mains if re.search(r"/article(\.[^/]*)?$", p)] or mains
        return {"main": sorted(set(first)), "own": own, "kept": sorted(kept)}
    path, x = "", wrapper
    while True:  # go down while one child has nearly all text of slots outside links
        parts = [c for c in _flat(x) if c[0] != "#"]
        weight = [max(0, v[0] - v[1]) for v in map(_volume, parts)]
        all_, linked = _volume(x)
        if not parts or max(weight) < 0.8 * max(1, all_ - linked) or parts[weight.index(max(weight))][0].split(".")[0] in ("p", "h1", "h2", "h3", "ul", "ol", "li", "table", "blockquote", "pre"):
            return {"main": [path] if path else [], "own": own, "kept": sorted(kept)}
        x = parts[weight.index(max(weight))]
        # the rarer kinds of a bag are those that don't stand in it by name
        path += f"/{x[0]}" + "".join(sorted({f"!{c[0]}" for c in parts if c[0] != x[0] and c[0].partition(".")[0] == x[0][:-2]}) if x[0].endswith(".*") else ())


def _flat(x: list) -> list:
    return [y for c in x[3] for y in (_flat(c) if c[0] in ("(", "{") else [c])]


def _ways(mains: list[str]) -> dict:
    """The paths of main elements as a tree by key; "" marks an end."""
    out: dict = {}
    for path in mains:
        at = out
        for key in path.split("/")[1:]:
            at = at.setdefault(key, {})
        at[""] = {}
    return out


def _step(ways: list[dict], key: str) -> list[dict]:
    """Where paths go on with an element of this key: by the key itself, and as one of a bag's rarer kinds."""
    if not ways:
        return ways
    rare = key.partition(".")[0] + ".*"
    return [w for at in ways for k, w in at.items() if k and (k == key or k.split("!")[0] == rare and key not in k.split("!")[1:])]


def read(root: Element, reading: dict | None) -> str:
    """The main text of a page along its host's reading; where the page lacks the main element, all but what is never main text."""
    mains = _ways(reading["main"]) if reading else {}
    own = set(reading["own"]) if reading else set()

    def texts(e: Element, ways: list[dict], inside: bool, need: bool) -> Iterator[str | None]:
        for c in e.children:
            if isinstance(c, Element):
                if c.drop:
                    if not c.inline:
                        yield None
                    continue
                yield None
                here = [] if inside else _step(ways, c.key)
                yield from texts(c, here, inside or any("" in w for w in here), need)
                yield None
            elif c[0] == "|":
                yield None
            elif inside or not need:
                yield c[1]

    def blocks(need: bool) -> list[str]:
        found, now = [], []
        for t in (*texts(root, [mains], False, need), None):
            if t is not None:
                now.append(t)
            elif now:
                if s := " ".join(entities.unescape("".join(now)).split()):
                    found.append((s, bool(own) and f"{xxhash.xxh64_intdigest(' '.join(' '.join(now).split()).encode('utf-8', 'surrogatepass')):x}" in own))
                now = []
        slots = [s for s, fixed in found if not fixed]
        # copies of one article have no slots to speak of: then their texts aren't the wrapper's
        enough = sum(map(len, slots)) * 2 >= sum(len(s) for s, _ in found) if need else bool(slots)
        return slots if enough else [s for s, _ in found]

    return "\n".join((blocks(True) if mains and _has(root, [mains]) else None) or blocks(False))


def _has(e: Element, ways: list[dict]) -> bool:
    return any("" in w for w in ways) or any(isinstance(c, Element) and not c.drop and (here := _step(ways, c.key)) and _has(c, here) for c in e.children)


def _names_main(e: Element) -> bool:
    return any(isinstance(c, Element) and not c.drop and (c.name in ("article", "main") or _names_main(c)) for c in e.children)


def _own_articles(root: Element) -> dict | None:
    """A reading from the page alone, if it has an article or main element, or one that its names don't drop."""
    found = reading_of(wrapper_of(root))
    revive(root, set(found["kept"]))
    return found if found["main"] else None


def page_text(page: str, reading: dict | None) -> str:
    """The main text of a page along its host's reading; along its own where it has an article that the host's doesn't know, or nothing is left."""
    root = parse(page)
    if reading is not None:
        revive(root, set(reading["kept"]))
        alone = not _has(root, [_ways(reading["main"])]) if reading["main"] else _names_main(root)
        reading = _own_articles(root) if alone else reading
    return read(root, reading) or read(root, _own_articles(root))


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper JSON) of (host, html)."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            trees = [json.dumps(wrapper_of(parse(t.as_py() or "")), separators=(",", ":")) for t in b.column("html")]
            seen = Counter(zip(b.column("host").to_pylist(), (_shape(t) for t in trees), strict=True))
            first = {}
            for h, t in zip(b.column("host").to_pylist(), trees, strict=True):
                key = (h, _shape(t))
                first[key] = merged(first[key], json.loads(t)) if key in first else json.loads(t)
            yield pa.record_batch([pa.array([k[0] for k in seen], pa.string()), pa.array([json.dumps(first[k], separators=(",", ":")) for k in seen], pa.string())], names=["host", "wrapper"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        out = None
        for w in sorted(pdf["wrapper"]):
            out = json.loads(w) if out is None else merged(out, json.loads(w))
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "wrapper": [json.dumps(out, separators=(",", ":"))]})

    now = materialise(pages.mapInArrow(one, "host string, wrapper string"), "trees")
    while True:
        most = now.groupBy("host").count().agg(F.max("count")).first()[0] or 0
        parts = max(1, -(-most // FAN))
        dealt = now.withColumn("part", F.pmod(F.xxhash64("wrapper"), F.lit(parts)))
        now = materialise(dealt.groupBy("host", "part").applyInPandas(merge, "host string, wrapper string"), "wrappers")
        if parts == 1:
            return now


def _shape(tree: str) -> str:
    """A wrapper without its texts' hashes and counts."""
    return re.sub(r'\["#","(.)",\d+,[^\]]*\]', r"#\1", tree)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """One row a page: page_id, url, text, n_chars."""
    bounded_batches(pages.sparkSession)
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", host_of(F.col("url")))
    found = wrappers(rows.where("html is not null").select("host", "html"))

    def read_off(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column("host"), pa.array([json.dumps(reading_of(json.loads(w.as_py()))) for w in b.column("wrapper")], pa.string())], names=["host", "reading"])

    readings = materialise(found.mapInArrow(read_off, "host string, reading string"), "readings")
    size = readings.agg(F.coalesce(F.sum(F.length("reading") + F.length("host")), F.lit(0))).first()[0]
    kind = rows.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict] = {}
        for b in batches:
            out = []
            for t, r in zip(b.column("html"), b.column("reading").to_pylist(), strict=True):
                if r is not None and r not in known:
                    known[r] = json.loads(r)
                page = t.as_py()
                out.append(page_text(page, known.get(r)) if page else "")
            yield pa.record_batch([b.column("page_id"), b.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    # whole pages move only where the readings are too many to send
    both = rows.join(F.broadcast(readings), "host", "left") if size <= SENT else spread_join(rows, readings, "host", "left")
    return both.select("page_id", "url", "html", "reading").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
