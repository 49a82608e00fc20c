"""Encoding of texts with a public byte-level BPE tokenizer.

Method: batched numpy merge rounds. The words (pre-tokens) of a batch that were not met before are laid out as byte symbols
in one flat array. In each round every adjacent pair within a word is looked up by binary search among the sorted pair keys
of the merge list, each word's pair of lowest rank is found by a segmented minimum, and all its occurrences are merged,
left to right. Words without a mergeable pair leave the array.

Defined results: a null and an empty text both give an empty list; texts are encoded whole, without special tokens, and
strings that look like special tokens are ordinary text. A text of any length is one row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

TOKENIZERS = "/opt/tokenizers"

#: Fixed value: how this public tokenizer splits a text into words.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Words kept by a Python worker, at most.
CACHE_WORDS = 400_000
NONE = np.int64(1 << 40)


@dataclass(frozen=True)
class Merges:
    """byte_ids: id of each byte; keys: sorted left << 32 | right; ranks and ids: of those pairs."""

    byte_ids: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray
    ids: np.ndarray


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file: itself if visible, else the next free one from 256."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(free)) for b in range(256)]


def load_merges(path: str) -> Merges:
    """The merge list of a byte-level BPE file. Its size is that of the vocabulary, whatever the corpus."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    left, right = (np.array([vocab[p[i]] for p in pairs], np.int64) for i in (0, 1))
    keys = left << 32 | right
    order = np.argsort(keys)
    ids = np.array([vocab[a + b] for a, b in pairs], np.int64)
    return Merges(np.array([vocab[c] for c in _byte_letters()], np.int64), keys[order], order.astype(np.int64), ids[order])


def merge_words(words: list[bytes], m: Merges) -> list[list[int]]:
    """The ids of each (not empty) word, all words in the same rounds."""
    flat = m.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), lengths)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while flat.size:
        joined = np.flatnonzero(owner[1:] == owner[:-1])
        key = flat[joined] << 32 | flat[joined + 1]
        at = np.minimum(np.searchsorted(m.keys, key), m.keys.size - 1)
        rank = np.full(flat.size, NONE)
        to = np.zeros(flat.size, np.int64)
        hit = m.keys[at] == key
        rank[joined[hit]] = m.ranks[at[hit]]
        to[joined[hit]] = m.ids[at[hit]]
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        size = np.diff(np.r_[starts, flat.size])
        least = np.repeat(np.minimum.reduceat(rank, starts), size)
        over = least == NONE
        if over.any():
            done.append((owner[over], flat[over]))
            keep = ~over
            flat, owner, rank, to, least = flat[keep], owner[keep], rank[keep], to[keep], least[keep]
            if not flat.size:
                break
        chosen = np.flatnonzero(rank == least)
        # Of overlapping occurrences (aaa), those at an even place of their run are merged.
        run = np.r_[True, np.diff(chosen) != 1]
        begin = np.maximum.accumulate(np.where(run, np.arange(chosen.size), 0))
        chosen = chosen[(np.arange(chosen.size) - begin) % 2 == 0]
        flat[chosen] = to[chosen]
        keep = np.ones(flat.size, bool)
        keep[chosen + 1] = False
        flat, owner = flat[keep], owner[keep]
    owner = np.concatenate([o for o, _ in done])
    flat = np.concatenate([f for _, f in done])
    order = np.argsort(owner, kind="stable")
    flat, ends = flat[order].astype(np.int32), np.cumsum(np.bincount(owner, minlength=len(words)))
    return [x.tolist() for x in np.split(flat, ends[:-1])]


def encode(df: DataFrame, id_column: str, text_column: str, path: str = f"{TOKENIZERS}/byte_bpe_50k.json") -> DataFrame:
    """(<id_column>, ids array<int>): the token ids of each text. See the module's docstring."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(load_merges(path))  # as large as the vocabulary: 50,000 merges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = shared.value
        split = regex.compile(PATTERN).findall
        known: dict[str, list[int]] = {}
        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                words = [split(t) if t else [] for t in part.column(1).to_pylist()]
                if len(known) > CACHE_WORDS:
                    known.clear()
                new = [w for w in {w for ws in words for w in ws} if w not in known]
                if new:
                    known.update(zip(new, merge_words([w.encode() for w in new], merges)))
                values, ends = [], [0]
                for ws in words:
                    for w in ws:
                        values += known[w]
                    ends.append(len(values))
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[id_column, "ids"])

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, ids array<int>")
