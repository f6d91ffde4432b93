"""Periodic runs of words, as maximal pairs of repeated stretches.

A run with start s, period q and length L is a maximal pair: the places s and s + q begin with
the same L - q words, differ in the word behind these and in the word to their left. So all runs
are found in the tree of LCP intervals, from the bottom up: the places of an interval
are those that share its words, and a pair first met there, from two child intervals and with
two left words, is maximal as it is, with nothing to extend.

Only pairs whose distance is at most half of the shared length count. Of the places near one
place, all but the first of a run have the same left word, so only the next place on each side can
be a pair with the smallest period; the left-word classes of an interval are therefore kept as one
list in text order with the left words beside it, and the smaller list goes into the larger.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .words import WHITE, by_size, cut, spaced

#: Bytes of text that a task looks at together.
BLOCK = 4_000_000


def shared_from(least: int, times: int) -> int:
    """How many words the two places of any run share at least: the length is at least max(least, times * period)."""
    return min(max(least - q, (times - 1) * q) for q in range(1, least + 1))


def repeated(ids: np.ndarray, text: np.ndarray, ends: np.ndarray, deep: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in suffix order, group of each) of those whose next ``deep`` words, at least, come again in their text.

    Prefix doubling over all texts at once; a place leaves the work as soon as its next
    words come once only. ``ends`` has for every place the end of its text. Groups share at
    least ``deep`` words.
    """
    key = text * (int(ids.max(initial=0)) + 1) + ids
    order = np.argsort(key, kind="stable")
    rank = np.zeros(len(ids), np.int64)
    new = np.append(True, key[order][1:] != key[order][:-1]) if len(ids) else np.zeros(0, bool)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))
    active, group, width = order, None, 1
    while len(active):
        head = rank[active]
        if group is None and width >= deep:
            group = (active.copy(), head.copy())
        size_two = np.zeros(len(active), bool)  # in a class of two or more
        same = head[1:] == head[:-1]
        size_two[1:] |= same
        size_two[:-1] |= same
        active, head = active[size_two], head[size_two]
        if not len(active):
            break
        beyond = active + width
        tail = np.where(beyond < ends[active], rank[np.minimum(beyond, len(ids) - 1)], -1)
        by = np.lexsort((tail, head))
        active, head, tail = active[by], head[by], tail[by]
        first = np.append(True, head[1:] != head[:-1])
        at = np.maximum.accumulate(np.where(first, np.arange(len(active)), 0))
        new = first | np.append(True, tail[1:] != tail[:-1])
        inside = np.maximum.accumulate(np.where(new, np.arange(len(active)), 0)) - at
        rank[active] = head + inside
        width *= 2
    if group is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    places, head = group
    same = head[1:] == head[:-1]
    many = np.zeros(len(places), bool)
    many[1:] |= same
    many[:-1] |= same
    places, head = places[many], head[many]
    by = np.argsort(rank[places], kind="stable")
    return places[by], head[by]


def shared_words(ids: list[int], places: list[int], group: list[int], ends: list[int], deep: int) -> list[int]:
    """By place in suffix order: words shared with the one before it, 0 at the start of a group.

    In text order a place shares at most one word less than the place to its left did.
    """
    before = {p: places[k - 1] for k, p in enumerate(places) if k and group[k] == group[k - 1]}
    out, last, n = {}, -2, 0
    for p in sorted(before):
        q = before[p]
        n = max(n - 1, deep) if p == last + 1 else deep
        end = min(ends[p] - p, ends[q] - q)
        n = min(n, end)
        while n < end and ids[p + n] == ids[q + n]:
            n += 1
        out[p], last = n, p
    return [out.get(p, 0) for p in places]


def maximal_pairs(places: list[int], shared: list[int], left: Callable[[int, int], bool], least: int, times: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs; ``left(p, q)`` tells whether the words left of p and q differ."""
    found = []

    def join(a: list[int], b: list[int], n: int) -> list[int]:
        """Two lists of places that share ``n`` words and no more; the runs between them are noted."""
        if len(a) < len(b):
            a, b = b, a
        for k, p in enumerate(b):
            i = bisect_left(a, p)
            if i < len(a) and (k + 1 == len(b) or b[k + 1] > a[i]):
                d = a[i] - p
                if (times - 1) * d <= n and n + d >= least and left(p, a[i]):
                    found.append((p, n + d, d))
            if i and (not k or b[k - 1] < a[i - 1]):
                d = p - a[i - 1]
                if (times - 1) * d <= n and n + d >= least and left(a[i - 1], p):
                    found.append((a[i - 1], n + d, d))
        if len(b) == 1:
            a.insert(bisect_left(a, b[0]), b[0])
        else:
            a += b
            a.sort()  # two sorted stretches: linear
        return a

    open_: list[list] = []  # intervals not closed yet: [words shared with what follows, places]
    now: list[int] = []
    for p, n in zip([*places, -1], [*shared, 0]):
        while open_ and open_[-1][0] > n:
            deep, held = open_.pop()
            now = join(held, now, deep)
        if n:
            if open_ and open_[-1][0] == n:
                open_[-1][1] = join(open_[-1][1], now, n)
            else:
                open_.append([n, now])
        now = [p]
    return found


def runs_of(ids: np.ndarray, first: np.ndarray, least: int = 24, times: int = 3) -> list[tuple[int, int, int, int]]:
    """(text, start, length, period) of the runs in texts of word numbers, sorted; ``first`` as in :class:`words.Words`."""
    sizes = np.diff(first)
    text = np.repeat(np.arange(len(sizes)), sizes)
    ends = np.repeat(first[1:], sizes)
    deep = shared_from(least, times)
    rounds = 1 << (deep.bit_length() - 1)  # doubling meets powers of two
    places, group = repeated(ids, text, ends, rounds)
    if not len(places):
        return []
    words, stop, place_list = ids.tolist(), ends.tolist(), places.tolist()
    begin = set(first.tolist())
    shared = shared_words(words, place_list, group.tolist(), stop, rounds)
    found = maximal_pairs(place_list, shared, lambda p, q: p in begin or words[p - 1] != words[q - 1], least, times)
    return sorted((int(text[s]), s - int(first[text[s]]), n, q) for s, n, q in found)


def kept_words(first: np.ndarray, found: list[tuple[int, int, int, int]]) -> np.ndarray:
    """By word: whether no run holds it after that run's first period."""
    change = np.zeros(int(first[-1]) + 1, np.int64)
    if found:
        t, s, n, q = np.array(found, np.int64).T
        np.add.at(change, first[t] + s + q, 1)
        np.add.at(change, first[t] + s + n, -1)
    return np.cumsum(change)[:-1] == 0


SCHEMA = "id {}, n_words long, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"


def find(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 24, times: int = 3,
    rewrite: Callable[[object, np.ndarray], np.ndarray] | None = None,
) -> DataFrame:
    """Per row: id, n_words, runs (sorted by start, then period) and ``collapsed``, the text without repeats.

    A run is a stretch with smallest period q and at least max(``least``, ``times`` * q) words that
    no neighbouring word extends; ``times`` is at least 3, so that runs are few. Collapsing keeps the first
    period of each run and puts one space between words. Words are stretches without white space.
    ``rewrite(id, words)`` may give other word numbers of the same text to look at.

    A null or empty text has no words and no runs; texts of any length are read whole; repeated
    rows give repeated results, an empty table none. Rows are independent, so nothing is
    shuffled; other columns, whatever their names, are not read.
    """
    if times < 3 or least < 2:
        raise ValueError("runs need times >= 3 and least >= 2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, 1, BLOCK):
            w = cut(batch.column(1), WHITE)
            ids = w.ids
            if rewrite is not None:
                at = w.first.tolist()
                ids = np.concatenate([rewrite(k, ids[a:b]) for k, a, b in zip(batch.column(0).to_pylist(), at, at[1:])] or [ids])
            found = runs_of(ids, w.first, least, times)
            keep = kept_words(w.first, found)
            counts = np.diff(np.append(0, np.cumsum(keep))[w.first])
            text = spaced(w.distinct, ids[keep], counts).cast(pa.string())
            cols = np.array(found, np.int64).reshape(-1, 4).T
            offsets = np.searchsorted(cols[0], np.arange(batch.num_rows + 1))
            runs = pa.StructArray.from_arrays([pa.array(c) for c in cols[1:]], ["start", "length", "period"])
            runs = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), runs)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(w.first)), runs, text], names=["id", "n_words", "runs", "collapsed"])

    kind = SCHEMA.format(dict(docs.dtypes)[id_col])
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, kind).withColumnRenamed("id", id_col)
