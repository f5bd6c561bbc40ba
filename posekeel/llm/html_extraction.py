"""Main-text extraction with wrappers inferred from pages of one host.

A page becomes a stream of block tags and text slots.  The streams of a host
are aligned one after the other; mismatches turn into optional groups, repeats
in a row into repeated groups, differing texts into slots.  The result is a
union-free regular expression, the host's wrapper.  Every page is then aligned
to it, so that each of its texts falls into a slot of the wrapper, and slots
are judged by what the host's pages put there: texts that many of them share,
and slots with few texts, are template.  Tags rule out what they name (menus,
footers, forms); words of class, id and role are a hint outside of the article
and, where they cannot mean anything else, inside.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace

#: fixed values: elements by their part in a page
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg canvas object math".split())
BLOCK = frozenset(
    "html head body title main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption nav header footer aside form fieldset details summary address center dialog menu hgroup search".split()
)
FORM_PARTS = frozenset("button select textarea option label input datalist output legend".split())
DROPPED = frozenset("head title nav aside footer form dialog menu search".split()) | FORM_PARTS
MAIN = frozenset(("article", "main"))
CLOSES_P = BLOCK - frozenset(("html", "head", "body", "title"))
#: elements that an open paragraph outside of them is not closed from
SCOPES = frozenset("table td th div article".split())
ALIKE = {n: g for g in (("li",), ("dt", "dd"), ("tr",), ("td", "th"), ("option",)) for n in g}
#: words in class, id or role that mark parts which are not the article
SIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement adverting sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs sidebar "
    "footer masthead cookie cookies consent notice notices gdpr popup modal newsletter subscribe signup login share sharing related recommended "
    "comment comments disqus replies pagination pager skip complementary contentinfo".split()
)
#: words that mark such parts, too, but can mean a part of an article
HINT_WORDS = frozenset("banner widget aside discussion reply toolbar alert search social".split())
WORD_SPLIT = re.compile(r"[^a-z0-9]+")
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)|<", re.S)
TAG_STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)

#: signs of a skeleton's tokens: "tag", "/tag", the text slot "#" and "@", a
#: slot all of whose text is links
SLOT, LINKS = "#", "@"
#: siblings, of any size, in the longest repeat that is found
MAX_FOLD = 12
#: skeletons, then wrappers, that one task unifies
FAN_IN = 64
#: cells of an alignment that is solved at once; a larger one is halved
CELLS = 1 << 22
#: a slot is judged if so many differing pages of its host fill it
LEAST_PAGES = 5
#: a text in one of so many of the pages that fill a slot, or more, is template
COMMON_PAGES = 2
#: a slot with one text or less for so many fills is template as a whole
FILLS_PER_TEXT = 10


def _mark(name: str, attrs: str) -> str:
    """The token of a start tag: its name, with ! for a part to drop, ~ for one
    that may be, and * for one that holds the article."""
    words = set()
    role_main = False
    if attrs:
        for key, value in ATTRIBUTE.findall(attrs):
            value = value.strip("\"'").lower()
            role_main |= key.lower() == "role" and value == "main"
            words.update(WORD_SPLIT.split(value))
    frame = name in ("html", "body", "article", "main")
    if name in DROPPED or words & SIDE_WORDS and not frame:
        return f"{name}!"
    if name in MAIN or role_main:
        return f"{name}*"
    return f"{name}~" if words & HINT_WORDS and not frame else name


def _tag_end(page: str, at: int, closed: dict[str, bool]) -> int:
    """Where a tag's attributes end, counted from ``at``.  A quote that is never
    closed is an ordinary character; ``closed`` remembers, for the rest of the
    page, that there is no more of its kind, so a page is read once."""
    while True:
        hit = TAG_STOP.search(page, at)
        if not hit:
            return len(page)
        if hit[0] == ">":
            return hit.start()
        at = hit.end()
        if closed.get(hit[0], True):
            other = page.find(hit[0], at)
            if other < 0:
                closed[hit[0]] = False
            else:
                at = other + 1


def page_tokens(page: str) -> tuple[list[str], list[str]]:
    """Skeleton tokens of a page, and the text of each of its slots.  Inline
    tags belong to the text around them; start tags that HTML lets one leave
    unclosed are closed, so the skeleton nests."""
    tokens: list[str] = []
    texts: list[str] = []
    stack: list[tuple[str, str, bool]] = []  # name, mark, whether a paragraph is open in its scope
    open_: Counter = Counter()
    pieces: list[str] = []
    linked = [0, 0]  # pieces with text: in links, and not
    in_link = False
    closed: dict[str, bool] = {}

    def say(text: str) -> None:
        pieces.append(text)
        if text and not text.isspace():
            linked[0 if in_link else 1] += 1

    def flush() -> None:
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                tokens.append(LINKS if linked[0] and not linked[1] else SLOT)
                texts.append(text)
            pieces.clear()
            linked[:] = 0, 0

    def pop() -> str:
        flush()
        name, mark, _ = stack.pop()
        open_[name] -= 1
        tokens.append("/" + mark)
        return name

    at, n = 0, len(page)
    while at < n:
        hit = TOKEN.search(page, at)
        stop = hit.start() if hit else n
        if stop > at:
            say(entities.unescape(page[at:stop]))
        if not hit:
            break
        at = hit.end()
        name = hit["name"]
        if name is None:
            found = hit[0]
            if found == "<":
                say("<")
            elif found.startswith("<![CDATA["):
                say(found[9:].removesuffix("]]>"))
            continue
        name = name.lower()
        stop = _tag_end(page, at, closed)
        attrs, at = page[at:stop], stop + 1
        if hit["end"]:
            if name == "a":
                in_link = False
            elif open_[name] > 0:
                while pop() != name:
                    pass
            elif name == "br":
                pieces.append(" ")
            continue
        if name in RAW:
            if not attrs.endswith("/"):
                done = re.compile(rf"</{re.escape(name)}(?![\w-])[^>]*(?:>|\Z)", re.I).search(page, at)
                at = done.end() if done else n
            continue
        mark = _mark(name, attrs)
        if name in VOID:
            if name in ("br", "hr", "input"):
                pieces.append(" ")
            continue
        if name not in BLOCK and not mark.endswith("!"):
            in_link |= name == "a"
            continue
        if name in CLOSES_P and stack and stack[-1][2]:
            while pop() != "p":
                pass
        if stack and stack[-1][0] in ALIKE.get(name, ()):
            pop()
        flush()
        stack.append((name, mark, name == "p" or bool(stack) and stack[-1][2] and name not in SCOPES))
        open_[name] += 1
        tokens.append(mark)
    while stack:
        pop()
    flush()
    return tokens, texts


# ------------------------------------------------------------------- wrappers
#
# A wrapper is a list of [kind, body, optional]: kind "t" is the token in body,
# kind "+" a group, repeated once or more, of such entries.


def as_wrapper(tokens: list[str]) -> list:
    return fold([["t", t, False] for t in tokens])


def _joined(units: list[list]) -> list:
    return [entry for unit in units for entry in unit]


def _fold_units(units: list[list]) -> list[list]:
    """Neighbouring equal runs of siblings become one repeated group, shorter
    runs first; a group takes in equal runs that follow it."""
    for width in range(1, MAX_FOLD + 1):
        out: list[list] = []
        i = 0
        while i < len(units):
            run = units[i : i + width]
            group = out[-1][0] if out and len(out[-1]) == 1 and out[-1][0][0] == "+" else None
            if group and len(run) == width and group[1] == _joined(run):
                i += width
            elif len(run) == width and sum(map(len, run)) > 1 and units[i + width : i + 2 * width] == run:
                out.append([["+", _joined(run), False]])
                i += width
            else:
                out.append(units[i])
                i += 1
        units = out
    return units


def fold(seq: list) -> list:
    """Fold the children of every element, inner ones first."""
    levels: list[tuple[str | None, list[list]]] = [(None, [])]
    for entry in seq:
        kind, body, _ = entry
        if kind == "t" and body not in (SLOT, LINKS) and body[0] != "/":
            levels.append((body, [[entry]]))
        elif kind == "t" and body[0] == "/" and levels[-1][0] == body[1:]:
            _, units = levels.pop()
            levels[-1][1].append([*units[0], *_joined(_fold_units(units[1:])), entry])
        else:
            levels[-1][1].append([entry])
    while len(levels) > 1:  # alignment can leave tags that do not nest
        _, units = levels.pop()
        levels[-1][1].extend(units)
    return _joined(_fold_units(levels[0][1]))


def _codes(a: list, b: list) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of entries that are equal if, and only if, they are alike."""
    known: dict[tuple, int] = {}
    name = lambda e: (e[0], e[1]) if e[0] == "t" else (e[0], e[1][0][1] if e[1][0][0] == "t" else "+", e[1][-1][1] if e[1][-1][0] == "t" else "+")
    return tuple(np.array([known.setdefault(name(e), len(known)) for e in side], np.int32) for side in (a, b))


def _common_rows(a: np.ndarray, b: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of the table of longest common subsequences, from the first on."""
    row = np.zeros(len(b) + 1, np.int32)
    yield row
    for x in a:
        new = row.copy()
        np.maximum(new[1:], row[:-1] + (b == x), out=new[1:])
        row = np.maximum.accumulate(new)
        yield row


def _aligned(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Places of a longest common subsequence: equal ends first, then by the
    table, in halves of ``a`` while the table is large."""
    n, m = len(a), len(b)
    short = min(n, m)
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    differ = np.flatnonzero(a[n - short + head :][::-1] != b[m - short + head :][::-1])
    tail = int(differ[0]) if len(differ) else short - head
    out = [(i, i) for i in range(head)]
    x, y = a[head : n - tail], b[head : m - tail]
    if len(x) and len(y):
        if len(x) == 1:
            hit = np.flatnonzero(y == x[0])
            out += [(head, head + int(hit[0]))] if len(hit) else []
        elif len(x) * len(y) > CELLS:
            half = len(x) // 2
            for first in _common_rows(x[:half], y):
                pass
            for second in _common_rows(x[half:][::-1], y[::-1]):
                pass
            cut = int(np.argmax(first + second[::-1]))
            out += [(head + i, head + j) for i, j in _aligned(x[:half], y[:cut])]
            out += [(head + half + i, head + cut + j) for i, j in _aligned(x[half:], y[cut:])]
        else:
            table = np.stack(list(_common_rows(x, y)))
            i, j, found = len(x), len(y), []
            while i and j:
                if x[i - 1] == y[j - 1]:
                    i, j = i - 1, j - 1
                    found.append((head + i, head + j))
                elif table[i - 1, j] >= table[i, j - 1]:
                    i -= 1
                else:
                    j -= 1
            out += found[::-1]
    return out + [(n - tail + k, m - tail + k) for k in range(tail)]


def unify(a: list, b: list) -> list:
    """Align two wrappers; what only one has becomes optional."""
    a, b = _grouped(a, b), _grouped(b, a)
    out, i, j = [], 0, 0
    for x, y in [*_aligned(*_codes(a, b)), (len(a), len(b))]:
        out += [[kind, body, True] for kind, body, _ in (*a[i:x], *b[j:y])]
        if x < len(a):
            body = a[x][1] if a[x][0] == "t" or a[x][1] == b[y][1] else unify(a[x][1], b[y][1])
            out.append([a[x][0], body, a[x][2] or b[y][2]])
        i, j = x + 1, y + 1
    return fold(out)


def _grouped(seq: list, other: list) -> list:
    """A run that the other side has as a repeated group is a group of one."""
    bodies = [x[1] for x in other if x[0] == "+"]
    if not bodies:
        return seq
    out, i = [], 0
    while i < len(seq):
        for body in bodies:
            if seq[i : i + len(body)] == body:
                out.append(["+", body, False])
                i += len(body)
                break
        else:
            out.append(seq[i])
            i += 1
    return fold(out)


class Places:
    """Finds the place in a wrapper of each token of a page: the wrapper's
    tokens in order are the states of its position automaton.  Where one can
    go on from a place is looked up when a page asks for it."""

    def __init__(self, wrapper: list):
        self.tokens: list[str] = []
        self.spots: list[tuple[int, int]] = []  # sequence and index of each token
        self.sequences: list[list] = []  # entries: (optional, place or None, group's sequence or None)
        self.owners: list[tuple[int, int] | None] = []  # where a group's sequence stands
        self.known: dict[tuple[int, str], list[int]] = {}
        self._add(wrapper, None)

    def _add(self, seq: list, owner: tuple[int, int] | None) -> int:
        me = len(self.sequences)
        entries: list = []
        self.sequences.append(entries)
        self.owners.append(owner)
        for k, (kind, body, optional) in enumerate(seq):
            if kind == "t":
                entries.append((optional, len(self.tokens), None))
                self.tokens.append(body)
                self.spots.append((me, k))
            else:
                entries.append((optional, None, self._add(body, (me, k))))
        return me

    def _next(self, place: int) -> tuple[list[int], bool]:
        """Places that can follow a place (-1: the start), and whether the page
        can end there."""
        todo = [(self.spots[place][0], self.spots[place][1] + 1) if place >= 0 else (0, 0)]
        seen, out, end = set(todo), [], False
        while todo:
            seq, k = todo.pop()
            if k == len(self.sequences[seq]):
                owner = self.owners[seq]
                end |= owner is None
                more = [] if owner is None else [(seq, 0), (owner[0], owner[1] + 1)]
            else:
                optional, at, inner = self.sequences[seq][k]
                more = [(seq, k + 1)] if optional else []
                if at is not None:
                    out.append(at)
                else:
                    more.append((inner, 0))
            for step in more:
                if step not in seen:
                    seen.add(step)
                    todo.append(step)
        return out, end

    def _options(self, place: int, token: str) -> list[int]:
        if (place, token) not in self.known:
            by_token: dict[str, list[int]] = {}
            for q in sorted(self._next(place)[0]):
                by_token.setdefault(self.tokens[q], []).append(q)
            self.known[place, token] = by_token.get(token, [])
        return self.known[place, token]

    def of_slots(self, tokens: list[str]) -> list[int]:
        """The place of each slot, by the least places if there are several
        ways; -1 for all if the wrapper is not one of the page."""
        steps: list[dict[int, int]] = []
        for t in tokens:
            now: dict[int, int] = {}
            for p in sorted(steps[-1]) if steps else (-1,):
                for q in self._options(p, t):
                    now.setdefault(q, p)
            steps.append(now)
        ends = sorted(p for p in steps[-1] if self._next(p)[1]) if steps else []
        if not ends:
            return [-1] * sum(t in (SLOT, LINKS) for t in tokens)
        at, out = ends[0], []
        for t, back in zip(reversed(tokens), reversed(steps)):
            if t in (SLOT, LINKS):
                out.append(at)
            at = back[at]
        return out[::-1]


def show(wrapper: list) -> str:
    """The wrapper as a regular expression of tags and slots."""
    out = []
    for kind, body, optional in wrapper:
        text = (body if body in (SLOT, LINKS) else f"<{body}>") if kind == "t" else f"({show(body)})+"
        out.append(f"({text})?" if optional else text)
    return "".join(out)


def kept_slots(tokens: list[str]) -> list[bool]:
    """Which slots of a skeleton can hold article text by its tags: those in no
    dropped part and, if the page has an article element, in one; on a page
    without, lists of links are menus.  The wrapper judges these slots."""
    need = any(t.endswith("*") and t[0] != "/" for t in tokens)
    seen: list[tuple[bool, bool]] = []  # (could be kept, stands in a dropped part round its article)
    # of the open elements: in an article, dropped inside it (or on the page),
    # in a dropped part or header outside of it, in a list item
    state = [(False, False, False, False)]
    for t in tokens:
        main, inner, outer, item = state[-1]
        if t in (SLOT, LINKS):
            menu = not main and item and t == LINKS
            seen.append((not inner and not menu and (main or not need), outer))
        elif t[0] == "/":
            state.pop()
        elif t.endswith("*"):
            state.append((True, False, outer or inner, False))
        else:
            gone = t.endswith("!") or not main and (t.endswith("~") or t == "header")
            state.append((main, inner or gone, outer, item or t == "li"))
    # an article in a part to drop (a teaser, a reader's comment) goes if
    # there is one elsewhere; else that part is the page's frame
    free = any(fits and not framed for fits, framed in seen)
    return [fits and not (framed and free) for fits, framed in seen]


# ----------------------------------------------------------------- operator


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _tokenise(columns: list[str], url: str, page: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, skeletons, slots = [], [], []
            for u, p in zip(batch.column(url), batch.column(page)):
                tokens, texts = page_tokens(p.as_py() or "")
                hosts.append(host_of(u.as_py()))
                skeletons.append(" ".join(tokens))
                slots.append(texts)
            out = [batch.column(c) for c in columns] + [pa.array(hosts, pa.string()), pa.array(skeletons, pa.string()), pa.array(slots, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(out, names=[*columns, "host", "skeleton", "slots"])

    return run


def _infer(skeletons: list[str]) -> list:
    wrapper: list | None = None
    seen = set()
    for s in sorted(skeletons, key=lambda s: (len(s), s)):
        new = as_wrapper(s.split(" ") if s else [])
        key = json.dumps(new)
        if key not in seen:
            seen.add(key)
            wrapper = new if wrapper is None else unify(wrapper, new)
    return wrapper or []


def infer_wrappers(work: Workspace, skeletons: DataFrame) -> DataFrame:
    """(host, wrapper as JSON) from distinct (host, skeleton) rows.  A host is
    dealt out over as many shards as it needs for FAN_IN skeletons each; the
    shards' wrappers are unified by so many, until each host has one."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [frame["host"].iloc[0]], "part": [frame["part"].iloc[0]], "wrapper": [json.dumps(_infer(frame["skeleton"].tolist()))]})

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        wrapper: list | None = None
        for text in sorted(frame["wrapper"]):
            new = json.loads(text)
            wrapper = new if wrapper is None else unify(wrapper, new)
        return pd.DataFrame({"host": [frame["host"].iloc[0]], "part": [frame["part"].iloc[0]], "wrapper": [json.dumps(wrapper)]})

    schema = "host string, part long, wrapper string"
    shards = skeletons.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / FAN_IN).alias("_shards"))
    dealt = skeletons.join(shards, "host").select("host", "skeleton", F.pmod(F.xxhash64("skeleton"), F.col("_shards")).alias("part"))
    parts = work.put("parts0", dealt.groupBy("host", "part").applyInPandas(one, schema))
    # the number of shards of the largest host, halved 64-fold each round
    most, k = parts.agg(F.max("part")).first()[0] or 0, 0
    while most > 0:
        most, k = most // FAN_IN, k + 1
        fewer = parts.withColumn("part", F.floor(F.col("part") / FAN_IN))
        parts = work.put(f"parts{k}", fewer.groupBy("host", "part").applyInPandas(merge, schema))
        work.drop(f"parts{k - 1}")
    return parts.select("host", "wrapper")


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, Places] = {}
    for batch in batches:
        masks, places = [], []
        for s, w in zip(batch.column("skeleton").to_pylist(), batch.column("wrapper").to_pylist()):
            if w not in known:
                if len(known) > 50:
                    known.clear()
                known[w] = Places(json.loads(w))
            tokens = s.split(" ") if s else []
            masks.append(kept_slots(tokens))
            places.append(known[w].of_slots(tokens))
        yield pa.RecordBatch.from_arrays(
            [batch.column("host"), batch.column("sk"), pa.array(masks, pa.list_(pa.bool_())), pa.array(places, pa.list_(pa.int32()))], names=["host", "sk", "mask", "places"]
        )


def templates(work: Workspace, judged: DataFrame) -> DataFrame:
    """(host, dull, common): places of the host's wrapper with few texts, and
    hashes of place and text that stand on many pages, from (host, slots, mask,
    places) rows.  Only slots that tags keep are counted, and pages that agree
    in their two longest texts count once: copied pages make no template."""
    slot = F.transform("slots", lambda s, i: F.struct(F.get("places", i).alias("place"), F.xxhash64(s).alias("h"), F.get("mask", i).alias("kept"), (-F.length(s)).alias("n")))
    kept = F.filter(slot, lambda x: x["kept"] & (x["place"] >= 0))
    longest = F.slice(F.sort_array(F.array_distinct(F.transform(kept, lambda x: F.struct(x["n"].alias("n"), x["h"].alias("h"))))), 1, 2)
    fills = F.array_distinct(F.transform(kept, lambda x: F.struct(x["place"].alias("place"), x["h"].alias("h"))))
    seen = work.put("seen", judged.select("host", F.xxhash64(longest).alias("page"), F.inline(fills)).distinct())
    texts = seen.groupBy("host", "place", "h").agg(F.count(F.lit(1)).alias("n"))
    filled = seen.select("host", "place", "page").distinct().groupBy("host", "place").agg(F.count(F.lit(1)).alias("pages"))
    variety = texts.groupBy("host", "place").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("all"))
    slots = filled.where(F.col("pages") >= LEAST_PAGES).join(variety, ["host", "place"]).withColumn("is_dull", F.col("texts") * FILLS_PER_TEXT <= F.col("all"))
    dull = slots.where("is_dull").groupBy("host").agg(F.collect_set("place").alias("dull"))
    often = texts.where("n > 1").join(slots.where("not is_dull"), ["host", "place"]).where(F.col("n") * COMMON_PAGES >= F.col("pages"))
    common = often.groupBy("host").agg(F.collect_set(F.xxhash64("place", "h")).alias("common"))
    return dull.join(common, "host", "full")


def extract_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page: id, url, text and n_chars (code points).

    A null page is empty and gives an empty text; a null or odd url belongs to
    the host with the empty name; repeated rows give repeated results; unclosed
    and stray tags are repaired, unclosed quotes are ordinary characters; a
    very long page is read once, but its alignment takes time in proportion to
    its tags times the wrapper's; a slot that under LEAST_PAGES differing pages
    of its host fill is judged by tags alone; ties between alignments go to the
    least places; other columns are not read, whatever their names; an empty
    table gives no rows.  Work tables are written when this is called."""
    source = df.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"))
    schema = T.StructType(
        [T.StructField("_id", source.schema["_id"].dataType), T.StructField("_url", T.StringType())]
        + [T.StructField("host", T.StringType()), T.StructField("skeleton", T.StringType()), T.StructField("slots", T.ArrayType(T.StringType()))]
    )
    work = Workspace(df.sparkSession)
    # a skeleton is named by a hash of its host and tokens; texts travel without it
    named = source.mapInArrow(_tokenise(["_id", "_url"], "_url", "_html"), schema).withColumn("sk", F.struct(F.xxhash64("skeleton").alias("a"), F.xxhash64(F.lit(17), "skeleton").alias("b")))
    pages = work.put("pages", named)
    skeletons = work.put("skeletons", pages.groupBy("host", "sk").agg(F.first("skeleton").alias("skeleton")))
    wrappers = infer_wrappers(work, skeletons)
    masks = work.put("masks", skeletons.join(wrappers, "host").mapInArrow(_judge, "host string, sk struct<a: long, b: long>, mask array<boolean>, places array<int>"))
    work.drop("skeletons")
    pages = pages.drop("skeleton")
    found = work.put("found", templates(work, pages.join(masks, ["host", "sk"])))
    listed = lambda column, x: F.coalesce(F.array_contains(column, x), F.lit(False))
    mask = F.zip_with("mask", "places", lambda m, p: m & ~listed("dull", p)).alias("mask")
    # one row for each skeleton, written so that its size is known to the join
    judged = work.put("judged", masks.join(found, "host", "left").select("host", "sk", mask, "places", "common"))
    work.drop("masks", "found", "seen")
    kept = F.filter("slots", lambda s, i: F.get("mask", i) & ~listed("common", F.xxhash64(F.get("places", i), F.xxhash64(s))))
    text = F.array_join(kept, " ")
    return pages.join(judged, ["host", "sk"]).select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), text.alias("text"), F.length(text).cast("long").alias("n_chars"))
