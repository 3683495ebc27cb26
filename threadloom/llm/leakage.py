"""Evaluation texts leaking into training text.

Items and documents are compared as runs of letters and digits without case, punctuation, white
space and line breaks; bracketed text does not count. A document leaks an item if at least
``MIN_WORDS`` words in a row of the item stand in a row in it.

One Aho-Corasick automaton holds a short word block at every ``BLOCK``-th word of each item; any run
of MIN_WORDS words contains a whole block, so each leak is hit. A hit is extended letter by letter in
both directions against the item and counts if enough whole words match. Documents are scanned once,
whole, in their own partition. The items are a stated set held by every task: they are read in
groups of at most ``GROUP_CHARS`` characters, one scan of the documents per group and one group after
the other, so the memory of a task and of the driver is bounded whatever their number. A Python worker
builds the automaton of a group once.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.durable import cut, spread
from threadloom.operators.hierarchy import union_all

MIN_WORDS = 13
#: Any 2 * BLOCK - 1 = 13 words in a row contain a block of 7 that starts at a multiple of 7.
BLOCK = (MIN_WORDS + 1) // 2
GROUP_CHARS = 8_000_000

_BRACKETS = re.compile(r"\([^()\[\]]*\)|\[[^()\[\]]*\]")
_WORD = re.compile(r"[^\W_]+")


def blank_brackets(text: str) -> str:
    """``text`` with bracketed passages, innermost first, turned to blanks of the same length."""
    if "(" not in text and "[" not in text:
        return text
    while True:
        out = _BRACKETS.sub(lambda m: " " * len(m[0]), text)
        if out == text:
            return out
        text = out


class Letters:
    """The letters and digits of a text in one string, with word bounds and origins."""

    def __init__(self, text: str):
        plain = blank_brackets(text)
        words = [(m.start(), m.end()) for m in _WORD.finditer(plain)]
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.origin: list[tuple[int, int]] = words
        pieces, at = [], 0
        for a, b in words:
            word = unicodedata.normalize("NFC", plain[a:b]).casefold()
            pieces.append(word)
            self.starts.append(at)
            at += len(word)
            self.ends.append(at)
        self.text = "".join(pieces)


class Items:
    """The automaton over the blocks of a group of items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, Letters(t)) for i, t in items if t]
        self.automaton = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t) in enumerate(self.items):
            for w in range(0, len(t.starts) - BLOCK + 1, BLOCK):
                places.setdefault(t.text[t.starts[w] : t.ends[w + BLOCK - 1]], []).append((n, t.starts[w]))
        for key, where in places.items():
            self.automaton.add_word(key, (len(key), where))
        self.empty = not places
        if places:
            self.automaton.make_automaton()

    def leaks(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, words, start, end) of the longest leak of each item; offsets in ``text``."""
        if self.empty or not text:
            return []
        doc = Letters(text)
        best: dict[int, tuple[int, int, int]] = {}
        seen: set[tuple[int, int, int]] = set()
        for last, (size, where) in self.automaton.iter(doc.text):
            for n, at in where:
                item_id, item = self.items[n]
                shift = last - size + 1 - at  # document position minus item position
                lo, hi = at, at + size
                if (n, shift, lo) in seen:
                    continue
                while lo > 0 and lo + shift > 0 and item.text[lo - 1] == doc.text[lo - 1 + shift]:
                    lo -= 1
                while hi < len(item.text) and hi + shift < len(doc.text) and item.text[hi] == doc.text[hi + shift]:
                    hi += 1
                seen.update((n, shift, s) for s in item.starts[bisect_left(item.starts, lo) : bisect_left(item.starts, hi)])
                first = bisect_left(item.starts, lo)
                final = bisect_right(item.ends, hi) - 1
                doc_starts, doc_ends = doc.starts, doc.ends
                while first <= final and not _among(doc_starts, item.starts[first] + shift):
                    first += 1
                while final >= first and not _among(doc_ends, item.ends[final] + shift):
                    final -= 1
                words = final - first + 1
                if words >= MIN_WORDS and words > best.get(item_id, (0,))[0]:
                    a = bisect_left(doc_starts, item.starts[first] + shift)
                    b = bisect_left(doc_ends, item.ends[final] + shift)
                    best[item_id] = (words, doc.origin[a][0], doc.origin[b][1])
        return [(i, *v) for i, v in best.items()]


def _among(ordered: list[int], value: int) -> bool:
    at = bisect_left(ordered, value)
    return at < len(ordered) and ordered[at] == value


_BUILT: dict[str, Items] = {}


def _items(key: str, group: list[tuple[int, str]]) -> Items:
    """The automaton of a group, built once in a worker process; the one before is let go."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Items(group)
    return _BUILT[key]


def find_leaks(documents: DataFrame, items: DataFrame, group_chars: int = GROUP_CHARS) -> DataFrame:
    """(doc_id, item_id, n_words, start_at, end_at): every item that a document gives away.

    Offsets are code points of the original text, of the longest run. Null or empty texts leak
    nothing; items of fewer than MIN_WORDS words cannot leak; repeated rows repeat their result
    unless the caller makes them distinct. No item: an empty result.
    """
    shape = "doc_id bigint, item_id bigint, n_words bigint, start_at bigint, end_at bigint"
    src = spread(documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint"), "text"))

    def scan(group: list[tuple[int, str]]) -> tuple[DataFrame, object]:
        held = documents.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, group))  # at most group_chars characters, or one item

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = _items(*held.value)
            for batch in batches:
                rows = [(d, *hit) for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for hit in known.leaks(text)]
                cols = list(zip(*rows)) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[x.split()[0] for x in shape.split(", ")])

        return src.mapInArrow(run, shape), held

    usable = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").orderBy("item_id")
    done, group, size = [], [], 0
    for row in usable.toLocalIterator():
        if group and size + len(row["text"]) > group_chars:  # more groups follow: this one is scanned now
            found, held = scan(group)
            done.append(cut(found, "leaks"))
            held.destroy()
            group, size = [], 0
        group.append((row["item_id"], row["text"]))
        size += len(row["text"])
    return union_all([*done, scan(group)[0]])
