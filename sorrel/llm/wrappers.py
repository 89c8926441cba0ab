"""HTML extraction with wrappers inferred as union-free regular expressions.

A page becomes a stream of tokens: tags by name, and text. Adjacent repetitions of the same tokens are folded into
repeated groups, innermost first, so that lists of any length look alike. The distinct streams of a host, commonest
first (of equally common ones the least by text), are then aligned one by one with the wrapper found so far (as RoadRunner does, Crescenzi et al. 2001): where
both have text, it is a slot; where one has tokens that the other lacks, they become an optional group; where the
tokens left over repeat what stands beside them, they become a repeated group. There are no unions: tokens that can't
be aligned are options one after the other.

A slot whose text is the same on all pages of a host that have it, several different ones and a tenth of the host's at
least, is part of the template, and one
inside nav, footer, aside or menu is furniture; extraction gives the texts of the other slots. Scripts, styles
and comments are no tokens, and inline markup (b, i, a, span, ...) is part of the text around it.

Streams are found in one pass and meet by host, one row for each distinct stream, so hosts with many pages are no
heavier than their variety. Extraction reads each page once more and looks its stream up in its host's wrapper.

Defined results: null and empty html, and pages without text, give text "" and 0 slots. A null url, or one without a
host, belongs to host "". A host with a single page, or copies of one, has no text to call template. Copies (pages of
the same texts) count once for the template, and are extracted like others. Columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sorrel.llm.storage import limited_broadcast, stored

INLINE = {"a", "abbr", "b", "bdi", "big", "br", "cite", "code", "em", "font", "i", "img", "kbd", "label", "mark", "q", "s", "small", "span", "strong", "sub", "sup", "tt", "u", "wbr"}
_OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][\w:-]*))")
_SPECIAL = re.compile("[>\"']")
#: Elements whose content is no markup, and what ends them.
_RAW = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in ("script", "style", "noscript", "template")}
FURNITURE = {"nav", "footer", "aside", "menu"}
#: Elements at which furniture that was never closed ends.
CONTENT = {"article", "main", "section", "h1"}
_WORDS = re.compile(r"[^()+ ]+")
TEXT = "#"
#: Up to here all periods are tried for a repetition; longer ones where a run of so many tokens returns.
SHORT_PERIOD, RUNS = 12, (1, 4, 16)
#: A slot must be on this share of a host's distinct pages for its text to count as template.
SHARE = 0.1


class _Ends:
    """Where the tags of a page end; linear in the page, as no stretch of it is searched twice in vain."""

    def __init__(self, page: str):
        self.page, self.begin, self.next = page, 0, None
        self.failed: set[int] = set()

    def special(self, at: int) -> re.Match | None:
        """The next ">" or quote."""
        if self.begin > at or self.next is None and self.begin == 0 or self.next is not None and self.next.start() < at:
            self.begin, self.next = at, _SPECIAL.search(self.page, at)
        return self.next

    def tag(self, at: int) -> int:
        """The end of the tag whose name ends at a position, or -1: signs in quotes don't count."""
        seen = []
        while m := self.special(at):
            if m[0] == ">":
                return m.end()
            if m.start() in self.failed:
                break
            seen.append(m.start())
            closed = self.page.find(m[0], m.end())
            if closed < 0:
                break
            at = closed + 1
        self.failed.update(seen)
        return -1


def tokens(page: str) -> list[tuple[str, str]]:
    """Tags (name, or /name at the end) and texts ("#", text) of a page, in order.

    A tag that isn't closed is text, and a comment or script that isn't goes to the end of the page.
    """
    out: list[tuple[str, str]] = []
    buffer: list[str] = []
    at = pos = 0
    ends, last = _Ends(page), page.rfind(">")

    def flush() -> None:
        text = " ".join(entities.unescape("".join(buffer)).split())
        buffer.clear()
        if text:
            out.append((TEXT, text))

    while m := _OPEN.search(page, pos):
        pos = m.end()
        if m[1]:
            closed = page.find("-->", pos)
            end = closed + 3 if closed >= 0 else len(page)
        elif pos > last:
            continue
        elif m[2]:
            end = page.find(">", pos) + 1
        else:
            end = ends.tag(pos)
            if end < 0:
                continue
        name = (m[4] or "").lower()
        buffer.append(page[at : m.start()])
        if name in _RAW and not m[3]:
            closing = _RAW[name].search(page, end)
            end, name = closing.end() if closing else len(page), ""
        at = pos = end
        if not name:
            continue
        if name in INLINE:
            if name == "br":
                buffer.append(" ")
            continue
        flush()
        out.append((("/" if m[3] else "") + name, ""))
    buffer.append(page[at:])
    flush()
    return out


@dataclass
class Node:
    """Part of a wrapper: a tag or a text slot, or a group of parts, that may be optional or repeated."""

    tag: str = ""
    parts: list[Node] = field(default_factory=list)
    optional: bool = False
    repeated: bool = False

    def key(self) -> str:
        """Its tokens, without slots' numbers, options or repetitions."""
        return self.tag if self.tag else "(" + " ".join(p.key() for p in self.parts) + ")"

    def __str__(self) -> str:
        body = self.tag if self.tag else "(" + " ".join(map(str, self.parts)) + ")"
        return body + ("+" if self.repeated else "") + ("?" if self.optional else "")


def long_period(keys: list[str]) -> int:
    """The shortest period beyond SHORT_PERIOD at which the stream repeats itself at once, or 0."""
    n, best, tried = len(keys), 0, {}
    if n <= 2 * SHORT_PERIOD:
        return 0
    for size in RUNS:
        last: dict = {}
        for i in range(n - size + 1):
            run = keys[i] if size == 1 else tuple(keys[i : i + size])
            before = last.get(run, -1)
            last[run] = i
            period = i - before
            if before < 0 or period <= SHORT_PERIOD or best and period >= best or tried.get(period, -1) >= i:
                continue
            lo, hi = before, i
            while lo > 0 and keys[lo - 1] == keys[lo - 1 + period]:
                lo -= 1
            while hi < n and keys[hi] == keys[hi - period]:
                hi += 1
            tried[period] = hi - 1
            if hi - lo >= 2 * period:
                best = period
    return best


def fold(tags: list[str]) -> list[tuple[str, int]]:
    """Stream with adjacent repetitions folded: entries of (key, length of the stream it stands for).

    Works up from short periods to long ones; a folded entry's key is "(...)+". Repetitions of any period are
    folded, but that one of more than SHORT_PERIOD tokens is seen only if some run of 1, 4 or 16 of its tokens occurs
    in it once.
    """
    row = [(t, 1) for t in tags]
    for period in range(1, SHORT_PERIOD + 1):
        row = _folded_by(row, period)
    while period := long_period([k for k, _ in row]):
        row = _folded_by(row, period)
    return row


def _folded_by(row: list[tuple[str, int]], period: int) -> list[tuple[str, int]]:
    i, out = 0, []
    keys = [k for k, _ in row]
    n = len(row)
    while i < n:
        j = i + period
        if j < n and keys[i] == keys[j]:
            unit = keys[i:j]
            while keys[j : j + period] == unit:
                j += period
            if j - i > period and not (period == 1 and unit[0] == TEXT):
                body = unit[0] if period == 1 and unit[0].endswith("+") else "(" + " ".join(unit) + ")+"
                out.append((body, sum(w for _, w in row[i:j])))
                i = j
                continue
        out.append(row[i])
        i += 1
    return out


def folded(page: str | None) -> tuple[str, list[str], list[int]]:
    """The folded stream as one string, the texts, and for each text the entry of the stream that it is in."""
    found = tokens(page or "")
    row = fold([t for t, _ in found])
    texts, where, at = [], [], 0
    for entry, (_, width) in enumerate(row):
        for tag, text in found[at : at + width]:
            if tag == TEXT:
                texts.append(text)
                where.append(entry)
        at += width
    return "\n".join(k for k, _ in row), texts, where


def parse_entry(key: str) -> Node:
    """The wrapper part of one entry of a folded stream."""
    words = key.replace("(", " ( ").replace(")+", " )+ ").split()
    stack: list[list[Node]] = [[]]
    for w in words:
        if w == "(":
            stack.append([])
        elif w == ")+":
            parts = stack.pop()
            stack[-1].append(Node(parts=parts, repeated=True))
        else:
            stack[-1].append(Node(tag=w))
    return stack[0][0]


def _longest(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence of two streams, as pairs of positions, common ends taken off first."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    x, y = a[lo : len(a) - hi], b[lo : len(b) - hi]
    # rows[i]: of the ends x[i:] and y[j:], bit m - 1 - j is 0 where one more token of y makes the subsequence longer
    n, m = len(x), len(y)
    where: dict[str, int] = {}
    for j, t in enumerate(y):
        where[t] = where.get(t, 0) | 1 << (m - 1 - j)
    full = (1 << m) - 1
    rows = [full] * (n + 1)
    for i in range(n - 1, -1, -1):
        v = rows[i + 1]
        u = v & where.get(x[i], 0)
        rows[i] = (v + u | v - u) & full
    out = [(i, i) for i in range(lo)]
    i = j = 0
    while i < n and j < m:
        if x[i] == y[j]:
            out.append((lo + i, lo + j))
            i, j = i + 1, j + 1
        elif rows[i] >> (m - 1 - j) & 1:
            j += 1
        else:
            i += 1
    return out + [(len(a) - hi + k, len(b) - hi + k) for k in range(hi)]


class Wrapper:
    """A union-free expression that grows with each stream aligned to it."""

    def __init__(self) -> None:
        self.parts: list[Node] = []
        self.count = 0
        self.ids: list[int] = []  # of the parts, never reused
        self.groups: set[tuple[int, int]] = set()  # ids of the first and last part of repeated groups

    def _keys(self) -> list[str]:
        return [_bare(p) for p in self.parts]

    def align(self, entries: list[str]) -> list[int]:
        """Takes a folded stream in; gives for each of its entries the id of the part that it became."""
        new = [parse_entry(e) for e in entries]
        if not self.count:
            self.parts, self.ids = new, list(range(len(new)))
            self.count = 1
            self.next = len(new)
            return list(self.ids)
        self.count += 1
        matched = _longest(self._keys(), [_bare(n) for n in new])
        parts, ids, given = [], [], [-1] * len(new)
        i = j = 0
        for a, b in [*matched, (len(self.parts), len(new))]:
            i, j = self._gap(parts, ids, given, new, i, a, j, b)
            if a < len(self.parts):
                part = self.parts[a]
                part.repeated |= new[b].repeated
                parts.append(part)
                ids.append(self.ids[a])
                given[b] = self.ids[a]
                i, j = a + 1, b + 1
        self.parts, self.ids = parts, ids
        return given

    def _gap(self, parts: list[Node], ids: list[int], given: list[int], new: list[Node], i: int, a: int, j: int, b: int) -> tuple[int, int]:
        """Between two matches: parts that the stream lacks, and tokens that the wrapper lacks, become optional;
        tokens that repeat the part before them make that part repeated."""
        for k in range(i, a):
            self.parts[k].optional = True
            parts.append(self.parts[k])
            ids.append(self.ids[k])
        k = j
        while k < b:
            tails, heads = [_bare(p) for p in parts], [_bare(n) for n in new[k:b]]
            for width in range(1, min(len(tails), len(heads)) + 1):
                if tails[-width] == heads[0] and tails[-width:] == heads[:width]:
                    if width == 1:
                        parts[-1].repeated = True
                    else:
                        self.groups.add((ids[-width], ids[-1]))
                    given[k : k + width] = ids[-width:]
                    k += width
                    break
            else:
                new[k].optional = True
                parts.append(new[k])
                ids.append(self.next)
                given[k] = self.next
                self.next += 1
                k += 1
        return a, b

    def spans(self) -> list[tuple[int, int, bool]]:
        """First and last position of each repeated group, and whether it is made of groups that cross, as one then."""
        place = {x: i for i, x in enumerate(self.ids)}
        out: list[tuple[int, int, bool]] = []
        for a, b in sorted(((place[a], place[b]) for a, b in self.groups), key=lambda x: (x[0], -x[1])):
            mixed = False
            while crossed := [s for s in out if s[0] < a <= s[1] < b]:
                out = [s for s in out if s not in crossed]
                a, mixed = min(s[0] for s in crossed), True
            out.append((a, b, mixed or any(s[2] for s in out if s[:2] == (a, b))))
        return out

    def __str__(self) -> str:
        """The expression: ? after what may be absent, + after what may be repeated. In a group made of crossing ones all may be absent."""
        words = [str(p) for p in self.parts]
        for a, b, mixed in self.spans():
            if mixed:
                words[a : b + 1] = [w if w.endswith("?") else w + "?" for w in words[a : b + 1]]
        opened, closed = [""] * len(words), [""] * len(words)
        for a, b, _ in self.spans():
            opened[a] += "("
            closed[b] += ")+"
        return " ".join(o + w + c for o, w, c in zip(opened, words, closed))


def _bare(node: Node) -> str:
    """What two parts must share to be aligned: their tokens, a repeated group counting like one of its turns."""
    return node.tag or (_bare(node.parts[0]) if len(node.parts) == 1 else "(" + " ".join(_bare(p) for p in node.parts) + ")")


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _stream_id(stream: str) -> int:
    return int.from_bytes(_mark(stream), "little", signed=True)


def _mark(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest()


STREAMS = "host string, stream string, pages long, kinds array<binary>, least array<binary>, most array<binary>"


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each host and distinct stream: its pages, distinct ones by a hash of their texts, and the least and greatest text of each entry, as hashes."""
    known: dict[tuple[str, str], list] = {}

    def flush() -> pa.RecordBatch:
        rows = [(h, s, n, sorted(kinds), lo, hi) for (h, s), (n, lo, hi, kinds) in known.items()]
        known.clear()
        columns = list(zip(*rows)) if rows else [()] * 6
        types = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.list_(pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["host", "stream", "pages", "kinds", "least", "most"])

    for batch in batches:
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html")):
            stream, texts, where = folded(page.as_py())
            lo: list[bytes | None] = [None] * (stream.count("\n") + 1)
            hi = list(lo)
            for text, entry in zip(texts, where):
                m = _mark(text)
                lo[entry] = m if lo[entry] is None else min(lo[entry], m)
                hi[entry] = m if hi[entry] is None else max(hi[entry], m)
            kind = _mark("\n".join(texts))
            got = known.get((host, stream))
            if got:
                got[0] += 1
                got[3].add(kind)
                got[1] = [x if y is None else y if x is None else min(x, y) for x, y in zip(got[1], lo)]
                got[2] = [x if y is None else y if x is None else max(x, y) for x, y in zip(got[2], hi)]
            else:
                known[host, stream] = [1, lo, hi, {kind}]
        if len(known) > 20_000:
            yield flush()
    yield flush()


WRAPPERS = "host string, stream string, stream_id long, wrapper string, slots array<int>, drop array<boolean>"


def furniture(entries: list[str]) -> list[bool]:
    """Which entries of a stream lie inside an element of FURNITURE.

    One that isn't closed before what is around it ends there, or where an element of CONTENT opens.
    """
    out, stack = [False] * len(entries), []

    def mark(begin: int, end: int, closed: bool) -> None:
        if not closed:
            end = next((i for i in range(begin + 1, end) if CONTENT.intersection(_WORDS.findall(entries[i]))), end)
        out[begin:end] = [True] * (end - begin)

    opened: dict[str, int] = {}
    for at, key in enumerate(entries):
        if key[0] == "/" and opened.get(key[1:]):
            while True:
                tag, begin = stack.pop()
                opened[tag] -= 1
                if tag in FURNITURE:
                    mark(begin, at, tag == key[1:])
                if tag == key[1:]:
                    break
        elif key[0] not in "/(#":
            stack.append((key, at))
            opened[key] = opened.get(key, 0) + 1
    for tag, begin in stack:
        if tag in FURNITURE:
            mark(begin, len(entries), False)
    return out


def _infer(table: pa.Table) -> pa.Table:
    """The wrapper of one host: for each of its streams the parts that its entries became, and which are template."""
    merged: dict[str, list] = {}
    for r in table.to_pylist():
        got = merged.setdefault(r["stream"], [0, r["least"], r["most"], set()])
        got[0] += r["pages"]
        got[3].update(r["kinds"])
        got[1] = [x if y is None else y if x is None else min(x, y) for x, y in zip(got[1], r["least"])]
        got[2] = [x if y is None else y if x is None else max(x, y) for x, y in zip(got[2], r["most"])]
    order = sorted(merged, key=lambda s: (-merged[s][0], s))
    wrapper, slots = Wrapper(), {}
    for stream in order:
        slots[stream] = wrapper.align(stream.split("\n")) if stream else []
    least: dict[int, bytes] = {}
    most: dict[int, bytes] = {}
    pages: dict[int, int] = {}
    for stream in order:
        _, lo, hi, kinds = merged[stream]
        for slot, a, b in zip(slots[stream], lo, hi):
            if a is not None:
                least[slot] = min(least.get(slot, a), a)
                most[slot] = max(most.get(slot, b), b)
                pages[slot] = pages.get(slot, 0) + len(kinds)
    enough = max(2, SHARE * sum(len(kinds) for *_, kinds in merged.values()))
    template = {slot for slot in least if least[slot] == most[slot] and pages[slot] >= enough}
    host = table.column("host")[0].as_py()
    return pa.table({"host": pa.array([host] * len(order), pa.string()), "stream": pa.array(order, pa.string()), "stream_id": pa.array([_stream_id(s) for s in order], pa.int64()), "wrapper": pa.array([str(wrapper), *[None] * (len(order) - 1)], pa.string()), "slots": pa.array([slots[s] for s in order], pa.list_(pa.int32())), "drop": pa.array([[x in template or f for x, f in zip(slots[s], furniture(s.split("\n")))] if s else [] for s in order], pa.list_(pa.bool_()))})


def infer(pages: DataFrame) -> DataFrame:
    """host, stream, stream_id, wrapper (with the commonest stream only), slots and drop for every distinct stream of every host."""
    found = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(_streams, STREAMS)
    return found.groupBy("host").applyInArrow(_infer, WRAPPERS)


EXTRACTED = "page_id long, host string, stream_id long, texts array<string>, entries array<int>"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts, entries = [], [], []
        for page in batch.column("html"):
            stream, text, where = folded(page.as_py())
            ids.append(_stream_id(stream))
            texts.append(text)
            entries.append(where)
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("host"), pa.array(ids, pa.int64()), pa.array(texts, pa.list_(pa.string())), pa.array(entries, pa.list_(pa.int32()))], ["page_id", "host", "stream_id", "texts", "entries"])


def extract(pages: DataFrame, wrappers: DataFrame | None = None) -> DataFrame:
    """page_id, host, n_slots (texts extracted) and text of every row of pages.

    wrappers: infer() of these or other pages; the texts of a page whose stream its host's wrapper doesn't know are all
    extracted.
    """
    known = stored(infer(pages) if wrappers is None else wrappers, "wrappers")
    marks = known.select(F.col("host").alias("__host"), F.col("stream_id").alias("__stream"), "drop").where(F.exists("drop", lambda x: x))
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), "html").mapInArrow(_parse, EXTRACTED)
    marks = limited_broadcast(stored(marks, "template"))
    joined = parsed.join(marks, (parsed["host"] == marks["__host"]) & (parsed["stream_id"] == marks["__stream"]), "left")
    pairs = F.arrays_zip(F.col("texts").alias("t"), F.col("entries").alias("e"))
    kept = F.when(F.col("drop").isNull(), F.col("texts")).otherwise(F.transform(F.filter(pairs, lambda p: ~F.get(F.col("drop"), p["e"])), lambda p: p["t"]))
    return joined.select("page_id", "host", kept.alias("__kept")).select("page_id", "host", F.size("__kept").alias("n_slots"), F.array_join("__kept", "\n").alias("text"))

