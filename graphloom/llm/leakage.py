"""Evaluation texts leaking into training text.

Method: Wu-Manber multi-pattern search over words. The patterns are all runs of LEAST consecutive words of the evaluation
items. A block is two neighbouring words. A shift table says, for the block at the end of the search window, how far
the window may move without missing a pattern; a block that occurs in no pattern lets it jump LEAST - 1 words. Where the
shift is 0, a suffix bucket, then a prefix bucket, select pattern positions, and direct comparison of the words confirms.

Both sides are brought to the same words first: character width and accents (NFKD without marks), case, invisible
characters, HTML tags and entities, backslash escapes, and prefixes of quoted, commented or numbered lines don't matter.

The items are the stated query set. They are searched in blocks of at most BLOCK_CHARS characters (about), so that what is
broadcast has a bound however many items there are.

Defined results: null, empty and blank texts hold nothing; an item with fewer than LEAST words cannot leak; equal items are
found each under its own id; repeated rows of a document give one row. Texts are searched whole.
"""

from __future__ import annotations

import html
import re
import unicodedata
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 13
BLOCK_CHARS = 20_000_000

_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")
_TAG = re.compile(r"""</?[A-Za-z][A-Za-z0-9]*(?:\s+[A-Za-z][\w:-]*(?:\s*=\s*(?:"[^"<>]*"|'[^'<>]*'|[^\s"'<>]+))?)*\s*/?>|<!--.*?-->""", re.S)
_CODE = re.compile(r"\\u\{?([0-9a-fA-F]{4})\}?|\\x([0-9a-fA-F]{2})|\\[nrtfv0](?![a-z]{2}\b)|\\(?=[\"'`*_\\/])|\\[nrt]")
_LINE = re.compile(r"^[ \t]*(?:(?:>|//+!?|/?\*+(?=[ \t])|#+|--+|;+|%+|\||[+-](?=[ \t]))[ \t]*)*(?:\d{1,6}(?:[ \t]*[|:](?=\s)|\t))?", re.M)
_INVISIBLE = re.compile("[\xad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0]|[\U000e0000-\U000e0fff]")
_MARK = re.compile("[\u0300-\u036f\u0483-\u0489\u0591-\u05bd\u0610-\u061a\u064b-\u065f\u0670\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\u3099\u309a\ufe20-\ufe2f]")
_WORD = re.compile(r"[^\W_]+")


def _code(m: re.Match) -> str:
    digits = m[1] or m[2]
    return chr(int(digits, 16)) if digits and not 0xD800 <= int(digits, 16) <= 0xDFFF else " " if m[0] != "\\" else ""


def words_of(text: str | None) -> list[str]:
    """The words of a text as they are compared."""
    if not text:
        return []
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
    if "\\" in text:
        text = _CODE.sub(_code, text)
    text = _LINE.sub(" ", text)
    if "&" in text:
        text = _ENTITY.sub(lambda m: html.unescape(m[0]), text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = _MARK.sub("", unicodedata.normalize("NFKD", _INVISIBLE.sub("", text)))
    return _WORD.findall(text.casefold())


class Patterns:
    """The tables of Wu-Manber for all runs of ``least`` words of the items."""

    def __init__(self, items: list[tuple], least: int = LEAST):
        self.least, self.items = least, [(i, w) for i, t in items if len(w := words_of(t)) >= least]
        self.shift: dict[tuple[str, str], int] = {}
        self.buckets: dict[tuple[str, str], dict[tuple[str, str], list[tuple[int, int]]]] = {}
        for n, (_, w) in enumerate(self.items):
            last = len(w) - least
            for p in range(len(w) - 1):
                # The latest place of this block in any window over it leaves the least to shift.
                left = max(0, least - 2 - p)
                block = (w[p], w[p + 1])
                if left < self.shift.get(block, least - 1):
                    self.shift[block] = left
            for s in range(last + 1):
                e = s + least
                self.buckets.setdefault((w[e - 2], w[e - 1]), {}).setdefault((w[s], w[s + 1]), []).append((n, s))

    def search(self, words: list[str]) -> set[int]:
        """Indices of the items of which a run occurs among the words."""
        found: set[int] = set()
        least, shift, far, i, n = self.least, self.shift, self.least - 1, self.least - 1, len(words)
        while i < n:
            step = shift.get(block := (words[i - 1], words[i]), far)
            if step:
                i += step
                continue
            b = i - least + 1
            for item, s in self.buckets.get(block, {}).get((words[b], words[b + 1]), ()):
                if item not in found and self.items[item][1][s : s + least] == words[b : i + 1]:
                    found.add(item)
            i += 1
        return found


_WORKER: dict[str, Patterns] = {}


def _patterns(key: str, rows: list[tuple], least: int) -> Patterns:
    """The tables of a block of items, built once per worker process; only the last block's are kept."""
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Patterns(rows, least)
    return _WORKER[key]


def leaked_items(docs: DataFrame, items: DataFrame, least: int = LEAST, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(item_id, doc_id): each document with each item of which it holds ``least`` consecutive words."""
    spark = docs.sparkSession
    items = items.select("item_id", "text").filter("text is not null").distinct()
    blocks = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))
    schema = f"item_id {items.schema['item_id'].dataType.simpleString()}, doc_id {docs.schema['doc_id'].dataType.simpleString()}"
    texts = docs.select("doc_id", "text").filter(F.length("text") > 0)

    def part(k: int) -> DataFrame:
        key = uuid.uuid4().hex
        shared = spark.sparkContext.broadcast([tuple(r) for r in items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            patterns = _patterns(key, shared.value, least)
            for b in batches:
                out = [(patterns.items[n][0], d) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for n in sorted(patterns.search(words_of(t)))]
                yield pa.RecordBatch.from_pydict({"item_id": pa.array([x for x, _ in out], out_type[0]), "doc_id": pa.array([x for _, x in out], b.schema.field(0).type)})

        from pyspark.sql.pandas.types import to_arrow_type

        out_type = [to_arrow_type(items.schema["item_id"].dataType)]
        return texts.mapInArrow(run, schema)

    return reduce(DataFrame.unionByName, [part(k) for k in range(blocks)]).distinct()
