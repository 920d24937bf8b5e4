"""Quality rules from a suffix array: maximal repeated word runs inside one text.

Documents are handled in blocks of words. One suffix array is built per block by
prefix doubling, with the document as the leading part of the first key, so that
suffixes of different documents never compare equal. The longest common prefixes
of neighbours give, for each word, the longest repeat that starts there; the union
of these spans is the union of all maximal repeats.

Defined cases: null and empty texts have no words and fail the base rule; one text
longer than a block forms a block of its own; repeated rows are scored one by one;
extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Words in a block; the arrays of a block take about 150 bytes a word.
BLOCK_WORDS = 250_000
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "covered_words long, longest_repeat long, base_failed boolean, kept boolean"
)


def suffix_repeats(words: np.ndarray, docs: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each position the length of the longest run of words that starts there and
    occurs again in the same document. words: ids; docs: document of each position,
    ascending; ends: for each position the end (exclusive) of its document."""
    n = len(words)
    longest = np.zeros(n, np.int64)
    if n < 2:
        return longest
    order = np.argsort(docs.astype(np.int64) * (int(words.max()) + 1) + words, kind="stable")
    new = np.ones(n, bool)
    new[1:] = (docs[order[1:]] != docs[order[:-1]]) | (words[order[1:]] != words[order[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, h, active = [rank], 1, order[~(new & np.append(new[1:], True))]
    while len(active):
        after = active + h
        inside = after < ends[active]
        second = np.where(inside, levels[-1][np.where(inside, after, 0)] + 1, 0)
        key = levels[-1][active] * (n + 1) + second
        by = np.argsort(key, kind="stable")
        active, key = active[by], key[by]
        at = np.arange(len(active))
        old = levels[-1][active]
        group = np.maximum.accumulate(np.where(np.append(True, old[1:] != old[:-1]), at, 0))
        new = np.append(True, key[1:] != key[:-1])
        start = np.maximum.accumulate(np.where(new, at, 0))
        rank = levels[-1].copy()
        rank[active] = old + start - group
        levels.append(rank)
        active = active[~(new & np.append(new[1:], True))]
        h *= 2
    suffixes = np.empty(n, np.int64)
    suffixes[levels[-1]] = np.arange(n)
    a, b = suffixes[:-1], suffixes[1:]
    lcp = np.zeros(n - 1, np.int64)
    todo = np.flatnonzero(levels[0][a] == levels[0][b])
    a, b = a[todo], b[todo]
    got = np.zeros(len(todo), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + got, b + got
        inside = (x < ends[a]) & (y < ends[b])
        same = inside & (levels[k][np.where(inside, x, 0)] == levels[k][np.where(inside, y, 0)])
        got += np.where(same, 1 << k, 0)
    lcp[todo] = got
    np.maximum.at(longest, suffixes[:-1], lcp)
    np.maximum.at(longest, suffixes[1:], lcp)
    return longest


def covered(longest: np.ndarray, least: int, fixed: int | None = None) -> np.ndarray:
    """Which words lie in a repeat of at least ``least`` words (of windows of ``fixed`` words)."""
    at = np.flatnonzero(longest >= least)
    edge = np.zeros(len(longest) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + (longest[at] if fixed is None else fixed), -1)
    return np.cumsum(edge[:-1]) > 0


def _block(ids: list, words: list[list[bytes]], plain: list[tuple[int, int, int]], p: dict) -> dict[str, list]:
    sizes = np.array([len(w) for w in words], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    known: defaultdict = defaultdict(count().__next__)
    flat = np.fromiter((known[x] for w in words for x in w), np.int64, int(starts[-1]))
    docs = np.repeat(np.arange(len(words)), sizes)
    longest = suffix_repeats(flat, docs, np.repeat(starts[1:], sizes))
    total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[starts])
    repeat = total(covered(longest, 5, 5))
    spans = total(covered(longest, p["min_repeat"]))
    top = np.zeros(len(words), np.int64)
    np.maximum.at(top, docs, longest)
    failed = (sizes < 10) | (100 * repeat > 20 * sizes)
    fine = (spans <= p["max_covered"] * sizes) & (top <= p["max_repeat"])
    return {
        "doc_id": ids, "n_words": sizes, "word_chars": [x[0] for x in plain], "n_symbols": [x[1] for x in plain],
        "n_dup_lines": [x[2] for x in plain], "n_repeat_words": repeat, "covered_words": spans, "longest_repeat": top,
        "base_failed": failed, "kept": ~failed & fine,
    }


def _plain(text: str) -> tuple[int, int, int]:
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines))


def repetition(docs: DataFrame, min_repeat: int = 10, max_covered: float = 0.15, max_repeat: int = 100) -> DataFrame:
    """Counts and verdict for each row of ``docs`` (doc_id, text).

    ``covered_words`` lie in maximal repeats of at least ``min_repeat`` words; a text
    is kept if the base rule holds, they are at most ``max_covered`` of its words, and
    no repeat is longer than ``max_repeat`` words. One narrow pass, no shuffle.
    """
    p = {"min_repeat": min_repeat, "max_covered": max_covered, "max_repeat": max_repeat}

    def run(batches):
        types = pa.schema([(x.split()[0], {"long": pa.int64(), "boolean": pa.bool_()}[x.split()[1]]) for x in SCHEMA.split(", ")])
        for batch in batches:
            ids, words, plain, held = [], [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                ids.append(doc_id)
                words.append(text.encode().split())
                plain.append(_plain(text))
                held += len(words[-1])
                if held >= BLOCK_WORDS:
                    yield pa.RecordBatch.from_pydict(_block(ids, words, plain, p), types)
                    ids, words, plain, held = [], [], [], 0
            if ids:
                yield pa.RecordBatch.from_pydict(_block(ids, words, plain, p), types)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
