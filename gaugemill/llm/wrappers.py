"""Main text of web pages by wrappers: union-free regular expressions inferred from all pages of a host.

A page is a tree of block elements and text runs. It is first aligned with itself: neighbours of one kind, and short
sequences that repeat, become one repeated node. Then the trees of a host are aligned in turn. A text that differs makes
its run a slot; where nodes differ, a neighbour of their kind makes them a repeated node, and otherwise they are optional.
What is left is the host's wrapper: elements, slots, ``(...)?`` and ``(...)+``, without alternatives. Each slot carries
sums over all pages (characters, those in links, pages, whether the text ever differs), which with the elements around it
tell main text from menus, headers, footers, sidebars, notices, adverts, forms and comments.

Pages of one shape are one tree, with sums that Spark adds up before and after the shuffle; a host's trees are folded in
lots of bounded number, then the lots' wrappers, and so on, so no task sees a whole host.
"""

from __future__ import annotations

import html
import json
import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .scratch import Scratch

# Elements of HTML, by what they mean for blocks of text.
SILENT = {"script", "style", "template", "noscript", "iframe", "svg", "math", "object", "canvas", "audio", "video", "textarea", "title"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "ruby", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "label", "nobr", "center"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
OUTSIDE = {"head", "nav", "footer", "aside", "form", "menu", "button", "select", "dialog", "header", "fieldset"}
#: What an opening tag ends: elements left open, up to the nearest of the enclosing ones.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
# Words of classes, ids and roles around what isn't main text, and around what is.
MARKS = set(
    "ad ads advert adverts advertisement advertising alert announcement banner breadcrumb breadcrumbs byline comment commentlist comments complementary consent contentinfo cookie cookies copyright dialog "
    "disclaimer discussion disqus footer form header legal login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promotion related "
    "reply replies respond responses search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar tracking widget widgets".split()
)
CONTENT = set("article body content entry main post story text".split())
#: Longest repeated sequence looked for, children that an element keeps apart, deepest element, trees folded by one task.
LONGEST, WIDEST, DEEPEST, FOLD = 4, 64, 100, 500
#: Share of a slot's characters in links from which it is a menu; pages from which a text that never differs is a
#: template's; share of the region's characters that these may have.
LINKED, CONSTANT_PAGES, CONSTANT_SHARE = 0.6, 3, 0.3
#: Wrappers of more bytes in all aren't broadcast but meet the pages by a shuffle, each in COPIES copies.
BROADCAST_BYTES, COPIES = 8 << 20, 32
OPTIONAL, REPEATED = 1, 2

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<([a-zA-Z][^\s/<>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*|[^<>]*)>|</([a-zA-Z][^\s/<>]*)[^<>]*>|<[!?][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z:_-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([a-zA-Z:_-]+)")
_WORD = re.compile(r"[a-z]+")


@lru_cache(4096)
def _sign(tag: str, attributes: str) -> str:
    """An element's kind: its tag and the words of its class, id and role; ``!`` marks a hidden one."""
    if not attributes or attributes.isspace():
        return tag
    words, hidden = [], False
    for m in _ATTRIBUTE.finditer(attributes):
        name = (m[1] or m[5]).lower()
        value = (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id", "role", "itemprop"):
            words += ["-".join(_WORD.findall(w)) for w in value.split()]
        hidden = hidden or name == "hidden" or name == "style" and "display:none" in value.replace(" ", "")
    return ".".join([tag, *sorted({w for w in words if w}), *(["!"] if hidden else [])])


@lru_cache(4096)
def marked(sign: str) -> bool:
    """Whether an element isn't main text by its tag, or by a word of its names that tells so; a name that also speaks of
    content counts only where it speaks of comments."""
    tag, *names = sign.split(".")
    if tag in OUTSIDE or "!" in names:
        return True
    for name in names:
        words = name.split("-")
        found = [w for w in words if w in MARKS]
        if found and (not any(w in CONTENT for w in words) or any(w.startswith(("comment", "repl", "respon")) for w in found)):
            return True
    return False


def _general(sign: str) -> str:
    """The tag, and no more of its names than their telling words."""
    tag, *names = sign.split(".")
    return ".".join([tag, *sorted({w for name in names for w in name.split("-") if w in MARKS or w in CONTENT or w == "!"})])


# Nodes are lists: ["T", flags, chars, linked, pages, lowest, highest, text], ["E", flags, sign, children] and
# ["G", flags, children], a sequence that repeats.


def parse(page: str) -> list:
    """The tree of a page; runs of text hold their collapsed text."""
    root = ["E", 0, "", []]
    stack = [root]
    pieces: list[str] = []
    linked = [0, 0]  # whether a link is open, characters in links
    inner: list[list] = []  # open inline elements that are nodes: tag, depth, how often it is open

    def flush() -> None:
        text = " ".join("".join(pieces).split())
        pieces.clear()
        chars, linked[1] = linked[1], 0
        if text:
            code = zlib.crc32(text.encode("utf-8", "surrogatepass"))
            stack[-1][3].append(["T", 0, len(text), min(chars, len(text)), 1, code, code, text])

    def say(raw: str) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        pieces.append(text)
        if linked[0]:
            linked[1] += len(text)

    def close(names: set[str], within: set[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            tag = stack[i][2].split(".", 1)[0]
            if tag in names:
                flush()
                del stack[i:]
                return
            if tag in within:
                return

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        if m[1] is not None:
            tag = m[1].lower()
            if tag in SILENT:
                if not m[2].endswith("/"):
                    end = re.compile(f"</{re.escape(tag)}[^>]*>", re.I).search(page, at)
                    if end is None:
                        at = len(page)
                        break
                    at = end.end()
                continue
            if tag == "br" or tag == "hr":
                say(" ")
            elif tag == "a":
                linked[0] = 1
            elif tag in VOID:
                pass
            elif tag in INLINE:
                sign = _sign(tag, m[2])
                if inner and tag == inner[-1][0] and len(stack) == inner[-1][1]:
                    inner[-1][2] += 1
                elif sign != tag and marked(sign) and len(stack) < DEEPEST:
                    flush()
                    stack.append(["E", 0, sign, []])
                    stack[-2][3].append(stack[-1])
                    inner.append([tag, len(stack), 1])
            else:
                flush()
                linked[0] = 0
                if tag in ENDS:
                    close(*ENDS[tag])
                else:
                    close({"p"}, {"table", "td", "th", "li", "div", "article", "section", "main", "body"})
                if len(stack) < DEEPEST:
                    stack.append(["E", 0, _sign(tag, m[2]), []])
                    stack[-2][3].append(stack[-1])
        elif m[3] is not None:
            tag = m[3].lower()
            if tag == "a":
                linked[0] = 0
            elif tag in INLINE:
                while inner and inner[-1][1] > len(stack):
                    inner.pop()
                if inner and tag == inner[-1][0] and len(stack) == inner[-1][1]:
                    inner[-1][2] -= 1
                    if not inner[-1][2]:
                        flush()
                        stack.pop()
                        inner.pop()
            elif tag not in VOID and tag not in SILENT:
                flush()
                linked[0] = 0
                close({tag}, set())
    if at < len(page):
        say(page[at:])
    flush()
    return root


def key(node: list) -> str:
    return node[2] if node[0] == "E" else "#" if node[0] == "T" else "(" + " ".join(map(key, node[2])) + ")"


def merge(a: list, b: list, across: bool) -> list:
    """One node for two of a kind that stand in one place, ``across`` pages or within one."""
    flags = a[1] | b[1]
    if a[0] == "T":
        return ["T", flags, a[2] + b[2], a[3] + b[3], a[4] + b[4] if across else max(a[4], b[4]), min(a[5], b[5]), max(a[6], b[6]), None]
    if a[0] == "G":
        return ["G", flags, [merge(x, y, across) for x, y in zip(a[2], b[2], strict=True)]]
    return ["E", flags, a[2], align(a[3], b[3], across)]


def beside(a: list, b: list) -> list:
    """One repeated node for two neighbours of a kind."""
    node = merge(a, b, False)
    node[1] = (a[1] & b[1] & OPTIONAL) | REPEATED
    return node


def fold_repeats(nodes: list) -> list:
    """The sequence with neighbours of one kind, then repeats of two and more nodes, made one repeated node each."""
    for period in range(1, LONGEST + 1):
        if len(nodes) < period + 1:
            break
        out: list = []
        keys: list[str] = []
        for node in nodes:
            out.append(node)
            keys.append(key(node))
            while True:
                if period == 1:
                    if len(out) < 2 or keys[-1] != keys[-2]:
                        break
                    last = out.pop()
                    keys.pop()
                    out[-1] = beside(out[-1], last)
                elif len(out) > period and keys[-period - 1] == "(" + " ".join(keys[-period:]) + ")":
                    again = out[-period:]
                    del out[-period:], keys[-period:]
                    out[-1] = beside(out[-1], ["G", 0, again])
                elif len(out) >= 2 * period and keys[-period:] == keys[-2 * period : -period]:
                    first, again = out[-2 * period : -period], out[-period:]
                    del out[-2 * period :], keys[-2 * period :]
                    out.append(["G", REPEATED, [merge(x, y, False) for x, y in zip(first, again, strict=True)]])
                    keys.append(key(out[-1]))
                else:
                    break
        nodes = out
    return nodes


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence; of two very long sequences, of a common subsequence."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    pairs = [(i, i) for i in range(head)]
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    if len(x) * len(y) > 1_000_000:
        places: dict[str, list[int]] = {}
        for j in range(len(y) - 1, -1, -1):
            places.setdefault(y[j], []).append(j)
        at = 0
        for i, k in enumerate(x):
            held = places.get(k, [])
            while held and held[-1] < at:
                held.pop()
            if held:
                at = held.pop() + 1
                pairs.append((head + i, head + at - 1))
    elif x and y:
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x) - 1, -1, -1):
            for j in range(len(y) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
        i = j = 0
        while i < len(x) and j < len(y):
            if x[i] == y[j]:
                pairs.append((head + i, head + j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    return pairs + [(len(a) - tail + i, len(b) - tail + i) for i in range(tail)]


def align(a: list, b: list, across: bool) -> list:
    """One sequence for two: what has a counterpart is merged, the rest is optional, or repeats its neighbour."""
    out, i, j = [], 0, 0
    optional = lambda n: [n[0], n[1] | OPTIONAL, *n[2:]]
    for p, q in [*_common([*map(key, a)], [*map(key, b)]), (len(a), len(b))]:
        out += [optional(n) for n in a[i:p]] + [optional(n) for n in b[j:q]]
        if p < len(a):
            out.append(merge(a[p], b[q], across))
        i, j = p + 1, q + 1
    out = fold_repeats(out)
    return _widest(out) if len(out) > WIDEST else out


def _widest(nodes: list) -> list:
    """A very long sequence as one repeated group of its kinds, each optional; kinds by telling words alone if these are
    too many still. So a wrapper stays bounded where every page names its elements anew."""
    flat = [n for node in nodes for n in (node[2] if node[0] == "G" else [node])]
    for name in (key, lambda n: _general(key(n)) if n[0] == "E" else key(n)):
        kinds: dict[str, list] = {}
        for n in flat:
            k = name(n)
            n = ["E", n[1], k, n[3]] if n[0] == "E" else n
            kinds[k] = beside(kinds[k], n) if k in kinds else n
        if len(kinds) <= WIDEST:
            break
    return [["G", REPEATED, [[n[0], n[1] | OPTIONAL | REPEATED, *n[2:]] for n in kinds.values()]]]


def compact(node: list) -> list:
    """A page's tree aligned with itself, from the leaves up."""
    if node[0] != "E":
        return node
    children = fold_repeats([compact(c) for c in node[3]])
    return ["E", node[1], node[2], _widest(children) if len(children) > WIDEST else children]


def split(node: list, sums: list) -> list:
    """The tree without its sums, which are listed in page order."""
    if node[0] == "T":
        sums.append(tuple(node[2:7]))
        return ["T", node[1]]
    return [*node[:-1], [split(c, sums) for c in node[-1]]]


def join(node: list, sums: Iterator) -> list:
    if node[0] == "T":
        return ["T", node[1], *next(sums), None]
    return [*node[:-1], [join(c, sums) for c in node[-1]]]


# Labels of slots: left out, main text where a page has no region of its own, main text.
DROP, LOOSE, MAIN = 0, 1, 2


def label(wrapper: list) -> list:
    """The wrapper with each slot's label in place of its sums: ["T", flags, label]."""
    slots: list[dict] = []

    def walk(node: list, out: bool, region: str, heading: bool, header: bool) -> None:
        if node[0] == "T":
            slots.append({"node": node, "out": out or header and not heading, "region": region, "heading": heading})
            return
        if node[0] == "E" and node[2]:
            tag, *names = node[2].split(".")
            if region and tag == "header" and not out:
                header = True
            elif marked(node[2]):
                out = True
            heading = heading or tag in HEADINGS
            if not out and (tag == "article" or "articlebody" in names):
                region = "article"
            elif not out and not region and (tag == "main" or "main" in names):
                region = "main"
        for child in node[-1]:
            walk(child, out, region, heading, header)

    walk(wrapper, False, "", False, False)
    for s in slots:
        chars, linked = s["node"][2], s["node"][3]
        if not s["heading"] and chars and linked > LINKED * chars:
            s["out"] = True
    weight = lambda test: sum(s["node"][2] for s in slots if not s["out"] and test(s))
    article, main = weight(lambda s: s["region"] == "article"), weight(lambda s: s["region"] == "main")
    inner = {"article", "main"} if main > article else {"article"}
    kept = weight(lambda s: s["region"] in inner) or weight(lambda s: True)
    constant = [s for s in slots if not (s["out"] or s["heading"] and s["region"]) and s["node"][5] == s["node"][6] and s["node"][4] >= CONSTANT_PAGES]
    if any(s["node"][5] != s["node"][6] for s in slots if not s["out"]) and sum(s["node"][2] for s in constant) <= CONSTANT_SHARE * kept:
        for s in constant:
            s["out"] = True
    found = iter(slots)

    def put(node: list) -> list:
        if node[0] == "T":
            s = next(found)
            return ["T", node[1], DROP if s["out"] else MAIN if s["region"] in inner else LOOSE]
        return [*node[:-1], [put(c) for c in node[-1]]]

    return put(wrapper)


def _places(children: list) -> tuple[list, list[tuple[int, int]]]:
    """The nodes of a sequence, groups opened, and the range of the group that each may go round in."""
    flat, rounds = [], []
    for node in children:
        inner = node[2] if node[0] == "G" else [node]
        begin = len(flat)
        flat += inner
        rounds += [(begin, begin + len(inner)) if node[0] == "G" else (begin, begin + 1 if node[1] & REPEATED else begin)] * len(inner)
    return flat, rounds


def _matched(nodes: list, children: list) -> list:
    """For each node of a page the wrapper's node that it is, null if there is none, along the cheapest way through the
    sequence; leaving out what isn't optional costs one."""
    flat, rounds = _places(children)
    named: dict[str, list[int]] = {}
    for i, n in enumerate(flat):
        named.setdefault(key(n), []).append(i)
    find = lambda n: named.get(key(n)) or (named.get(_general(n[2])) if n[0] == "E" else None) or []
    if all(len(v) == 1 for v in named.values()):
        return [flat[at[0]] if (at := find(n)) else None for n in nodes]
    cost = [0]
    for n in flat:
        cost.append(cost[-1] + (0 if n[1] & OPTIONAL else 1))
    ways: dict[int, tuple[int, tuple | None]] = {-1: (0, None)}
    for n in nodes:
        at = find(n)
        if not at:
            ways = {i: (c, (None, back)) for i, (c, back) in ways.items()}
            continue
        ahead: dict[int, tuple[int, tuple | None]] = {}
        for j in at:
            begin, end = rounds[j]
            for i, (c, back) in ways.items():
                step = c + (cost[j] - cost[i + 1] if j > i else 0 if begin <= i < end else 1000)
                if j not in ahead or step < ahead[j][0]:
                    ahead[j] = (step, (j, back))
        ways = ahead
    back = min(ways.items(), key=lambda w: (w[1][0] + cost[-1] - cost[w[0] + 1], w[0]))[1][1]
    out = []
    while back is not None:
        out.append(None if back[0] is None else flat[back[0]])
        back = back[1]
    return out[::-1]


def extract(page: str, wrapper: list | None) -> str:
    """The main text of one page by its host's labelled wrapper: the slots of the region if the page has any, else all
    that aren't left out. Nodes that the wrapper lacks are judged by their own names."""
    main: list[str] = []
    loose: list[str] = []

    def walk(nodes: list, children: list | None, out: bool) -> None:
        for node, there in zip(nodes, _matched(nodes, children) if children is not None else [None] * len(nodes), strict=True):
            if node[0] == "T":
                mark = there[2] if there is not None else DROP if out else LOOSE
                if mark == MAIN:
                    main.append(node[7])
                elif mark == LOOSE:
                    loose.append(node[7])
            else:
                walk(node[3], there[3] if there is not None else None, out or marked(node[2]))

    walk(parse(page)[3], wrapper[3] if wrapper is not None else None, False)
    return " ".join(main or loose)


def host() -> Column:
    """The host of ``url``, in lower case; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


_SUMS = "array<struct<chars:long,linked:long,pages:long,lowest:long,highest:long>>"


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per host and shape its slots' sums over some of the pages."""
    held: dict[tuple[str, str], list] = {}
    size = 0

    def given() -> pa.RecordBatch:
        hosts, shapes, slots, sums = [], [], [], []
        for (h, shape), total in held.items():
            for i, s in enumerate(total or [(0, 0, 0, 0, 0)]):
                hosts.append(h)
                shapes.append(shape)
                slots.append(i)
                sums.append(s)
        columns = list(zip(*sums, strict=True)) or [[]] * 5
        return pa.RecordBatch.from_pydict({"host": pa.array(hosts, pa.string()), "shape": pa.array(shapes, pa.string()), "slot": pa.array(slots, pa.int32())} | {n: pa.array(c, pa.int64()) for n, c in zip(("chars", "linked", "pages", "lowest", "highest"), columns, strict=True)})

    for batch in batches:
        hosts, pages = batch.column(0), batch.column(1)
        for i in range(batch.num_rows):
            sums: list = []
            shape = json.dumps(split(compact(parse(pages[i].as_py() or "")), sums), separators=(",", ":"))
            at = (hosts[i].as_py(), shape)
            before = held.get(at)
            if before is None:
                held[at] = sums
                size += len(shape) + 100 * len(sums)
            else:
                held[at] = [(a + x, b + y, c + z, min(d, v), max(e, w)) for (a, b, c, d, e), (x, y, z, v, w) in zip(before, sums, strict=True)]
            if size > 1 << 24:
                yield given()
                held.clear()
                size = 0
    yield given()


def _folded(pdf: pd.DataFrame) -> pd.DataFrame:
    """One wrapper for the trees of a lot, the commonest first."""
    trees = [(-int(max((s["pages"] for s in sums), default=0)), shape, sums) for shape, sums in zip(pdf["shape"], pdf["sums"], strict=True)]
    wrapper = None
    for _, shape, sums in sorted(trees, key=lambda t: t[:2]):
        tree = join(json.loads(shape), iter([(int(s["chars"]), int(s["linked"]), int(s["pages"]), int(s["lowest"]), int(s["highest"])) for s in sums]))
        wrapper = tree if wrapper is None else merge(wrapper, tree, True)
    total: list = []
    shape = json.dumps(split(wrapper, total), separators=(",", ":"))
    names = ("chars", "linked", "pages", "lowest", "highest")
    return pd.DataFrame({"host": pdf["host"].iloc[:1], "lot": pdf["lot"].iloc[:1], "shape": [shape], "sums": [[dict(zip(names, t, strict=True)) for t in total]]})


def infer(pages: DataFrame) -> DataFrame:
    """(host, wrapper): of every host of ``url`` the labelled wrapper of all its pages, as JSON."""
    scratch = Scratch(pages.sparkSession, "wrappers")
    seen = pages.select(host().alias("host"), "html").mapInArrow(_shapes, "host string, shape string, slot int, chars long, linked long, pages long, lowest long, highest long")
    code = F.sha2("shape", 256)
    slots = seen.groupBy("host", code.alias("code"), "slot").agg(F.first("shape").alias("shape"), *(F.sum(c).alias(c) for c in ("chars", "linked", "pages")), F.min("lowest").alias("lowest"), F.max("highest").alias("highest"))
    whole = slots.groupBy("host", "code").agg(F.first("shape").alias("shape"), F.transform(F.array_sort(F.collect_list(F.struct("slot", F.struct("chars", "linked", "pages", "lowest", "highest").alias("s")))), lambda x: x["s"]).alias("sums"))
    trees = scratch.save(whole, "trees")
    counts = trees.groupBy("host").agg(F.count("*").alias("n")).withColumn("lots", F.ceil(F.col("n") / FOLD))
    lots = trees.join(counts, "host").select("host", F.expr("pmod(xxhash64(code), lots)").alias("lot"), "shape", "sums")
    most = counts.agg(F.max("lots")).first()[0] or 1
    schema = f"host string, lot long, shape string, sums {_SUMS}"
    wrappers = scratch.save(lots.groupBy("host", "lot").applyInPandas(_folded, schema), "level0")
    level = 0
    while most > 1:
        most, level = math.ceil(most / FOLD), level + 1
        wrappers = scratch.save(wrappers.withColumn("lot", F.col("lot") % most).groupBy("host", "lot").applyInPandas(_folded, schema), f"level{level}")

    @F.pandas_udf("string")
    def labelled(shapes: pd.Series, sums: pd.Series) -> pd.Series:
        trees = (join(json.loads(shape), iter([(s["chars"], s["linked"], s["pages"], s["lowest"], s["highest"]) for s in each])) for shape, each in zip(shapes, sums, strict=True))
        return pd.Series([json.dumps(label(t), separators=(",", ":")) for t in trees], dtype=object)

    return scratch.save(wrappers.select("host", labelled("shape", "sums").alias("wrapper")), "labelled")


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, list] = {}
    for batch in batches:
        names = batch.schema.names
        pages, wrappers = batch.column(names.index("html")), batch.column(names.index("wrapper"))
        out, begin, size = [], 0, 0
        for i in range(batch.num_rows):
            wrapper = wrappers[i].as_py()
            if wrapper is not None and wrapper not in known:
                if len(known) >= 256:
                    known.clear()
                known[wrapper] = json.loads(wrapper)
            out.append(extract(pages[i].as_py() or "", known.get(wrapper)))
            size += len(out[-1])
            if size > 1 << 24 or i == batch.num_rows - 1:
                yield pa.RecordBatch.from_pydict({"row": batch.column(names.index("row")).slice(begin, i + 1 - begin), "text": pa.array(out, pa.string()), "n_chars": pa.array([*map(len, out)], pa.int64())})
                out, begin, size = [], i + 1, 0


def main_text(pages: DataFrame, keep: list[str]) -> DataFrame:
    """Every page's main text and its code points, beside ``keep`` and in no order.

    A null or empty html gives the empty text, as does a page without main text; a null url, or one without a host, counts
    to the host without a name. Repeated pages and repeated ids are rows like others. Whole pages are read, however long;
    elements deeper than DEEPEST lie in their ancestor of that depth. Kept columns that bear a result's name are left out.
    """
    wrappers = infer(pages)
    size = wrappers.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host"))).first()[0] or 0
    names = [c for c in keep if c not in ("text", "n_chars")]
    rows = pages.select(F.struct(*map(F.col, names), F.lit(0).alias("_")).alias("row"), host().alias("host"), "html")
    if size <= BROADCAST_BYTES:
        met = rows.join(F.broadcast(wrappers), "host", "left")
    else:
        dealt = rows.withColumn("copy", F.expr(f"cast(pmod(xxhash64(html, row), {COPIES}) as int)"))
        copied = wrappers.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
        met = dealt.join(copied.hint("merge"), ["host", "copy"], "left")
    schema = f"row {rows.schema['row'].dataType.simpleString()}, text string, n_chars long"
    return met.select("row", "html", "wrapper").mapInArrow(_extracted, schema).select(*(F.col("row")[c].alias(c) for c in names), "text", "n_chars")
