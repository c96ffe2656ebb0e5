"""Evaluation texts in training text: a generalised suffix automaton over the words of the test items."""

from __future__ import annotations

import pickle
import re
import unicodedata
import uuid
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.names import fold, lcs
from ledgerloom.operators.joins import spread
from ledgerloom.session import Workspace, empty

WORD = re.compile(r"[^\W_]+")
HYPHENS = frozenset("-‐‑\u00ad")
#: What may stand between the halves of a word that a line end divides.
BROKEN = re.compile(r"\u00ad|[-‐‑\u00ad][ \t]*\r?\n[\s>|*#]*")
DIVIDED = re.compile(r"\u00ad|[-‐‑][ \t]*\r?\n")
INSIDE = re.compile(r"(?<=[^\W_])(?:" + BROKEN.pattern + r")(?=[^\W_])")
#: A passage has at least so many words of an item.
LEAST = 12
#: Matches from SEED words on are looked at, if one has LONG words or all of one place together have CANDIDATE words. LEAST words with any two of
#: them changed have that.
SEED, LONG, CANDIDATE = 3, 6, 7
#: So many of LEAST words in a row stand unchanged near their place before a passage is aligned.
DENSE = 9
#: Test items are put into automata of about so many characters; more items make more automata, one after another.
BLOCK_CHARS = 1_000_000


def words(text: str) -> list[tuple[str, int, int]]:
    """Folded words with their places in the composed form of ``text``; halves of a divided word are one."""
    text = unicodedata.normalize("NFC", text)
    out: list[tuple[str, int, int]] = []
    for m in WORD.finditer(text):
        w, a, b = m.group(), m.start(), m.end()
        if out and text[out[-1][2]] in HYPHENS and BROKEN.fullmatch(text, out[-1][2], a):
            out[-1] = (out[-1][0] + _folded(w), out[-1][1], b)
        else:
            out.append((_folded(w), a, b))
    return out


def plain_words(text: str) -> list[str]:
    """The words without their places, in fewer steps."""
    text = unicodedata.normalize("NFC", text)
    if DIVIDED.search(text):
        text = INSIDE.sub("", text)
    return WORD.findall(text.lower() if text.isascii() else fold(text))


@lru_cache(1 << 18)
def _folded(w: str) -> str:
    return fold(w)


@lru_cache(1 << 17)
def near(a: str, b: str) -> bool:
    """Equal, or a word of four or more letters with slight damage: a common subsequence of at least 0.75."""
    if a == b:
        return True
    la, lb = len(a), len(b)
    return min(la, lb) >= 4 and abs(la - lb) <= 2 and 8 * lcs(a, b) >= 3 * (la + lb)


class Automaton:
    """Generalised suffix automaton of word sequences, in flat arrays once it is built.

    The ends of a state's strings are a range: occurrences are numbered in the order in which a walk of the suffix-link tree meets the
    states of their prefixes, so a state's own and its descendants' stand side by side, and no state lists them.
    """

    def __init__(self, items: dict[int, list[str]]):
        self.items = items
        self.vocabulary: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[int, int, int]] = []
        for n, seq in enumerate(items.values()):
            coded = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in seq]
            ends += [(v, n, pos) for pos, v in enumerate(self._insert(coded))]
        self._flatten(ends)

    def _insert(self, seq: list[int]) -> Iterator[int]:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for w in seq:
            if (q := nxt[last].get(w)) is not None:
                if length[q] == length[last] + 1:
                    last = q
                else:
                    last = self._clone(last, q, w)
                yield last
                continue
            cur = len(nxt)
            nxt.append({}), link.append(0), length.append(length[last] + 1)
            p = last
            while p != -1 and w not in nxt[p]:
                nxt[p][w] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][w]
                link[cur] = q if length[p] + 1 == length[q] else self._clone(p, q, w)
            last = cur
            yield last

    def _clone(self, p: int, q: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        c = len(nxt)
        nxt.append(dict(nxt[q])), link.append(link[q]), length.append(length[p] + 1)
        link[q] = c
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = c
            p = link[p]
        return c

    def _flatten(self, ends: list[tuple[int, int, int]]) -> None:
        """Transitions as one table of (state * words + word, state), ranges of occurrences per state, and the ancestor that stands for the last SEED words."""
        size, words = len(self.next), max(1, len(self.vocabulary))
        self.width = words
        steps = np.fromiter((x for v, to in enumerate(self.next) for w, t in to.items() for x in (v * words + w, t)), np.int64).reshape(-1, 2)
        self.next = dict(zip(steps[:, 0].tolist(), steps[:, 1].tolist()))
        own, kids = defaultdict(list), defaultdict(list)
        for v, n, pos in ends:
            own[v].append((n, pos))
        for v in range(1, size):
            kids[self.link[v]].append(v)
        low, high, order = [0] * size, [0] * size, []
        stack = [(0, False)]
        while stack:
            v, seen = stack.pop()
            if seen:
                high[v] = len(order)
                continue
            low[v] = len(order)
            order += own[v]
            stack.append((v, True))
            stack += [(c, False) for c in kids[v]]
        # longer states come after the states that they link to in the order of length
        top = [0] * size
        for v in sorted(range(1, size), key=self.length.__getitem__):
            if self.length[v] >= SEED:
                top[v] = v if self.length[self.link[v]] < SEED else top[self.link[v]]
        names = list(self.items)
        self.low, self.high, self.top = low, high, top
        self.occurrences = [(names[n], pos) for n, pos in order]

    def matches(self, seq: list[str]) -> Iterator[tuple[int, int, int, int]]:
        """(item, start in ``seq``, start in the item, words) of each match of SEED or more words that can't go on to either side, of every item.

        The walk keeps the longest match of any item. Where it has SEED words, all items that hold the last SEED words stand in
        one range; on the diagonal of each of them a match grows by a word or begins.
        """
        nxt, link, length, width, code = self.next, self.link, self.length, self.width, self.vocabulary
        growing: dict[tuple[int, int], list[int]] = {}
        v = l = 0
        for i, w in enumerate(seq):
            c = code.get(w)
            if c is None:
                v = l = 0
                continue
            while (to := nxt.get(v * width + c)) is None and v:
                v = link[v]
                l = length[v]
            v, l = (to, l + 1) if to is not None else (0, 0)
            if l >= SEED:
                # of a match shorter than its state's strings, the ends are the state's as well
                t = self.top[v]
                for k, pos in self.occurrences[self.low[t] : self.high[t]]:
                    run = growing.get((k, i - pos))
                    if run is not None and run[1] == i - 1:
                        run[1] = i
                        continue
                    if run is not None:
                        yield k, run[0], run[0] - (i - pos), run[1] - run[0] + 1
                    growing[k, i - pos] = [i - SEED + 1, i]
        for (k, d), (a, z) in growing.items():
            yield k, a, a - d, z - a + 1


def align(item: list[str], doc: list[str], low: int, high: int, diagonal: int, band: int = 10) -> tuple[int, int, int]:
    """Best local alignment of ``item`` in doc[low:high] within ``band`` of doc place = item place + diagonal.

    Returns (words matched, first, last + 1 in doc). A match counts 1, a changed, missing or added word -1; two words of one side may stand for one of the other.
    Only places that match or follow a place with a score are looked at; all others have none.
    """
    where: dict[str, list[int]] = {}
    pairs: dict[str, list[int]] = {}
    for j in range(low, high):
        where.setdefault(doc[j], []).append(j)
        if j > low:
            pairs.setdefault(doc[j - 1] + doc[j], []).append(j)
    zero = (0, 0, 0)
    older: dict[int, tuple[int, int, int]] = {}
    last: dict[int, tuple[int, int, int]] = {}
    best, found = zero, zero
    for i, w in enumerate(item):
        first, end, size = max(low, i + diagonal - band), min(high, i + diagonal + band + 1), len(w)
        hits = set(where.get(w, ()))
        if size >= 4:
            hits.update(j for j in range(first, end) if -3 < len(doc[j]) - size < 3 and doc[j] != w and near(w, doc[j]))
        parted = pairs.get(w, ())
        glued = where.get(item[i - 1] + w, ()) if i else ()
        todo = sorted({j for j in (*hits, *parted, *glued, *last, *(j + 1 for j in last)) if first <= j < end}, reverse=True)
        row: dict[int, tuple[int, int, int]] = {}
        while todo:
            j = todo.pop()
            s, m, a = last.get(j - 1, zero)
            if j in hits:
                cell = (s + 1, m + 1, a if s else j)
            else:
                cell = (s - 1, m, a)
                if j in parted:
                    s, m, a = last.get(j - 2, zero)
                    cell = (s + 1, m + 1, a if s else j - 1)
                elif j in glued:
                    s, m, a = older.get(j - 1, zero)
                    cell = (s + 2, m + 2, a if s else j)
            for s, m, a in (last.get(j, zero), row.get(j - 1, zero)):
                if s - 1 > cell[0]:
                    cell = (s - 1, m, a)
            if cell[0] > 0:
                row[j] = cell
                if cell[0] > best[0]:
                    best, found = cell, (cell[1], cell[2], j + 1)
                if j + 1 < end and (not todo or todo[-1] != j + 1):
                    todo.append(j + 1)
        older, last = last, row
    return found if best[0] >= LEAST - 2 else (0, 0, 0)


def _dense(item: list[str], doc: list[str], low: int, high: int, diagonal: int, band: int = 10) -> bool:
    """Whether DENSE of some LEAST words of the item in a row stand near their place in doc[low:high], or half of LEAST close by, and the others there damaged, joined or split at most."""
    at: dict[str, list[int]] = {}
    for j in range(low, high):
        at.setdefault(doc[j], []).append(j - diagonal)
    hits = [any(-band <= j - i <= band for j in at.get(w, ())) for i, w in enumerate(item)]
    if _fullest(hits) >= DENSE:
        return True
    # damaged words, close to the diagonal like those beside them
    close = [any(-3 <= j - i <= 3 for j in at.get(w, ())) for i, w in enumerate(item)]
    if 2 * _fullest(close) < LEAST:
        return False
    for i, there in enumerate(close):
        if not there:
            close[i] = any(_damaged(item, i, doc, j, high) for j in range(max(low, i + diagonal - 3), min(high, i + diagonal + 4)))
    return _fullest(close) >= DENSE


def _damaged(item: list[str], i: int, doc: list[str], j: int, high: int) -> bool:
    """Whether doc[j] is item[i] slightly damaged, joined with a neighbour, or its first part."""
    w, x = item[i], doc[j]
    if abs(len(w) - len(x)) <= 2:
        return near(w, x)
    if len(w) > len(x):
        return j + 1 < high and w[0] == x[0] and w == x + doc[j + 1]
    return (i + 1 < len(item) and x == w + item[i + 1]) or (i > 0 and x == item[i - 1] + w)


def _fullest(hits: list[bool]) -> int:
    """The most hits among LEAST places in a row."""
    run = best = sum(hits[:LEAST])
    for i in range(LEAST, len(hits)):
        run += hits[i] - hits[i - LEAST]
        best = max(best, run)
    return best


def passages(auto: Automaton, doc: list[str]) -> dict[int, list[tuple[int, int, int]]]:
    """item -> (first word, last word + 1, matched words) of the passages of LEAST or more words that ``doc`` holds of it."""
    seeds: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for k, at, pos, n in auto.matches(doc):
        seeds[k].append((at, pos, n))
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for k, own in seeds.items():
        item = auto.items[k]
        # words matched near a diagonal: running sums over the diagonals in order
        by = sorted((at - pos, n) for at, pos, n in own)
        diagonals, sums = [d for d, _ in by], [0, *accumulate(n for _, n in by)]
        done, tried = -1, {}
        for at, pos, n in sorted(own):
            d = at - pos
            if at + n <= done or (n < LONG and sums[bisect_right(diagonals, d + 10)] - sums[bisect_left(diagonals, d - 10)] < CANDIDATE):
                continue
            low, high = max(0, d - 10), min(len(doc), d + len(item) + 10)
            if d not in tried:
                tried[d] = align(item, doc, low, high, d) if _dense(item, doc, low, high, d) else (0, 0, 0)
            got, first, last = tried[d]
            if got >= LEAST and first <= at < last:
                out[k].append((first, last, got))
                done = last
    return out


_LOADED: dict[int, Automaton] = {}


def _load(packed) -> Automaton:
    """The automaton of a broadcast, unpacked once per Python worker."""
    if packed.id not in _LOADED:
        _LOADED.clear()
        _LOADED[packed.id] = pickle.loads(packed.value)
    return _LOADED[packed.id]


class _Broadcast:
    """A broadcast with a name of its own that workers know it by."""

    def __init__(self, spark: SparkSession, value: bytes):
        self.id, self.inner = uuid.uuid4().int, spark.sparkContext.broadcast(value)

    @property
    def value(self) -> bytes:
        return self.inner.value


def _pack(rows: pd.DataFrame) -> pd.DataFrame:
    """The automaton of a block of items: item numbers, which may repeat, and their words."""
    texts = [(int(k), plain_words(t)) for k, t in zip(rows["item_id"], rows["text"])]
    held = {n: w for n, (_, w) in enumerate(texts) if len(w) >= LEAST}
    auto = Automaton(held)
    auto.names = {n: texts[n][0] for n in held}
    return pd.DataFrame({"block": [int(rows["block"].iloc[0])], "data": [pickle.dumps(auto, pickle.HIGHEST_PROTOCOL)]})


def leaked(spark: SparkSession, documents: DataFrame, items: DataFrame, least_coverage: float = 0.0) -> DataFrame:
    """Passages of ``items`` (item_id bigint, text) in ``documents`` (doc_id bigint, text): doc_id, item_id, words, start, end, coverage.

    Words are compared without case, accents, punctuation and line layout. Documents are streamed, whole, through a generalised suffix automaton of the
    items' words, which gives each item's own longest matches, also where items share words; where matches of an item come together, an
    alignment confirms a passage of LEAST or more words in order with few changed, missing or added ones. More than ten words put in or left
    out at one place part a passage, and each part then counts for itself. ``start`` and ``end`` are places in the composed form
    of the text, ``coverage`` the share of the item's words. Passages of less than ``least_coverage`` of their item are left out.

    Null and empty texts hold nothing; an item of less than LEAST words can't be held. Repeated item ids are taken each as they are. The items are
    counted and split into blocks of about BLOCK_CHARS (or one longer item); the automaton of each block is built once, by a task, and its flat form
    is all that the driver ever holds or sends. Further blocks are further passes over the documents, one after another.
    """
    own = items.where("text is not null and item_id is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    size = own.agg(F.coalesce(F.sum(F.length("text") + 50), F.lit(0)).alias("n")).first().n
    docs = documents.where("text is not null and doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    docs = spread(docs, "doc_id")
    blocks = max(1, -(-size // BLOCK_CHARS))
    work = Workspace(spark, "leaks")
    packed = own.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int")).groupBy("block").applyInPandas(_pack, "block int, data binary")
    packed = work.table(packed, "automata")
    out = None
    for b in range(blocks):
        row = packed.where(F.col("block") == b).first()
        data = _Broadcast(spark, bytes(row.data) if row else pickle.dumps(None))
        part = docs.mapInPandas(_streamer(data, least_coverage), FOUND) if row else empty(spark, FOUND)
        if blocks > 1:
            part = work.table(part, "found")
            data.inner.destroy()
        out = part if out is None else out.unionByName(part)
    return out


FOUND = "doc_id bigint, item_id bigint, words int, start int, end int, coverage double"


def _streamer(packed: _Broadcast, least_coverage: float):
    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        auto = _load(packed)
        for batch in batches:
            rows = []
            for d, text in zip(batch["doc_id"], batch["text"]):
                if not passages(auto, plain_words(text)):
                    continue
                toks = words(text)
                for n, found in passages(auto, [w for w, _, _ in toks]).items():
                    k, size = auto.names[n], len(auto.items[n])
                    rows += [(d, k, got, toks[a][1], toks[z - 1][2], got / size) for a, z, got in found if got >= least_coverage * size]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "words", "start", "end", "coverage"])

    return stream


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for d, text, spans in zip(b["doc_id"], b["text"], b["spans"]):
            text, kept, at, gone = unicodedata.normalize("NFC", text), [], 0, 0
            for s in sorted((int(s["start"]), int(s["end"])) for s in spans):
                if s[1] > at:
                    kept.append(text[at : max(at, s[0])])
                    gone += s[1] - max(at, s[0])
                    at = s[1]
            out.append((d, "".join([*kept, text[at:]]), len(spans), gone))
        yield pd.DataFrame(out, columns=["doc_id", "text", "spans", "removed_chars"])


def cleaned(spark: SparkSession, documents: DataFrame, passages: DataFrame, most_words: int = LEAST, most_coverage: float = 0.5) -> DataFrame:
    """doc_id, text, spans, removed_chars of the ``documents`` (doc_id unique) that lose spans: those of ``passages`` (see ``leaked``) that have ``most_words`` words or more, or
    ``most_coverage`` of their item or more. Spans that overlap are one; what stands round them stays as it is, in composed form. Documents without such spans have no row.
    """
    over = passages.where((F.col("words") >= most_words) | (F.col("coverage") >= most_coverage))
    spans = over.select("doc_id", F.struct("start", "end").alias("span")).distinct().groupBy("doc_id").agg(F.collect_list("span").alias("spans"))
    hit = documents.where("text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(spans, "doc_id")
    return hit.mapInPandas(_cut, "doc_id bigint, text string, spans int, removed_chars int")
