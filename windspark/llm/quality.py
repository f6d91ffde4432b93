"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad; features describe the line and its two neighbours. The chain
is fitted on a bounded sample of labelled documents, whose lines first take the
document's label and then, once, what the first fit says of the good lines of bad
documents. Forward-backward gives each line's probability of being good; their mean by
line length, calibrated by a logistic curve, is the document's score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import Shared
from .toxicity import fit_sample

# byte classes: 0 upper, 1 lower, 2 digit, 3 space, 4 common punctuation, 5 symbol, 6 other
_CLASS = np.full(256, 6, np.uint8)
_CLASS[:128] = 5
for _first, _last, _kind in ((65, 90, 0), (97, 122, 1), (48, 57, 2)):
    _CLASS[_first : _last + 1] = _kind
_CLASS[[32, 9, 10, 11, 12, 13]] = 3
_CLASS[[ord(c) for c in ".,;:'\"-()?"]] = 4
_EDGES = (0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75, 0.9)
OWN = 10
#: Bytes of text whose line features are held at once, and of texts taken together.
CHUNK, SLICE = 1 << 18, 1 << 20


def _lines(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts, end of each line, first line of each document and the end); every document has a line."""
    raw = [(t or "").encode("utf-8", "replace") + b"\n" for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    return data, np.flatnonzero(data == 10) + 1, np.append(0, np.cumsum([r.count(b"\n") for r in raw]))


def _distinct(part: bytes) -> int:
    # the words of a very long line are not listed
    return len(set(part.split()) if len(part) < CHUNK else {m.group() for m in re.finditer(rb"\S+", part)})


def _own(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first line, features of a stretch of lines), in stretches of about ``CHUNK`` bytes or one line."""
    at = 0
    while at < len(ends):
        start = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, start + CHUNK, "right")))
        bound = np.append(start, ends[at:stop])
        n, size = stop - at, np.diff(bound) - 1
        counts, words, seen = np.zeros((n, 7)), np.zeros(n), 0
        for p in range(start, int(bound[-1]), CHUNK):  # more than one block only in a line longer than that
            block = data[p : min(p + CHUNK, int(bound[-1]))]
            kind, breaks = _CLASS[block], block == 10
            line = np.cumsum(breaks) - breaks + seen
            counts += np.bincount(line * 7 + kind, minlength=7 * n).reshape(n, 7)
            space = kind == 3
            begins = ~space & np.append(p == start or _CLASS[data[p - 1]] == 3, space[:-1])
            words += np.bincount(line[begins], minlength=n)
            seen += int(breaks.sum())
        counts[:, 3] -= 1  # the line end
        distinct = np.array([_distinct(part) for part in data[start : int(bound[-1]) - 1].tobytes().split(b"\n")], float)
        fresh = np.where(words > 0, distinct / np.maximum(words, 1), 1.0)
        shares = counts[:, [0, 2, 3, 4, 5, 6]] / np.maximum(size, 1)[:, None]
        yield at, np.column_stack([shares, fresh, np.log1p(size) / 10, np.minimum(size / np.maximum(words, 1), 40) / 20, np.log1p(words) / 8])
        at = stop


def _binned(own: np.ndarray) -> np.ndarray:
    return np.hstack([own[:, [k]] > np.array(_EDGES) for k in (0, 1, 3, 4, 6)]).astype(float)


def line_features(texts: list[str], choose=np.arange) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features by line, line weights, first line of each document and the end), for the lines that ``choose(first, end)`` takes.

    Every document has at least one line; whole texts are read.
    """
    data, ends, first = _lines(texts)
    own = np.vstack([part for _, part in _own(data, ends)]) if texts else np.zeros((0, OWN))
    size = np.diff(ends, prepend=0).astype(float)
    xs, taken = [np.zeros((0, 1 + 3 * OWN + 5 * len(_EDGES)))], [np.zeros(0, int)]
    for a, b in zip(first, first[1:]):
        lines = choose(a, b)
        before = np.where((lines > a)[:, None], own[np.maximum(lines - 1, a)], 0)
        after = np.where((lines < b - 1)[:, None], own[np.minimum(lines + 1, b - 1)], 0)
        xs.append(np.hstack([np.ones((len(lines), 1)), own[lines], _binned(own[lines]), before, after]))
        taken.append(lines)
    return np.vstack(xs[1:] or xs), size[np.concatenate(taken)], np.cumsum([len(t) for t in taken])


def line_scores(texts: list[str], w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features times ``w`` by line, line weights, first line of each document and the end).

    Features live for a stretch of lines only; what is kept is three numbers a line, those
    it adds to its own score and to its two neighbours'.
    """
    data, ends, first = _lines(texts)
    binned = len(w) - 1 - 3 * OWN
    cut = np.split(w[1:], [OWN, OWN + binned, 2 * OWN + binned])
    out, later, earlier = np.empty(len(ends)), np.empty(len(ends)), np.empty(len(ends))
    for at, own in _own(data, ends):
        here = slice(at, at + len(own))
        out[here] = w[0] + own @ cut[0] + _binned(own) @ cut[1]
        later[here], earlier[here] = own @ cut[2], own @ cut[3]
    later[first[1:] - 1] = 0  # neighbours end with the document
    earlier[first[:-1]] = 0
    out[1:] += later[:-1]
    out[:-1] += earlier[1:]
    return out, np.diff(ends, prepend=0).astype(float), first


def _batches(first: np.ndarray, most: int = 200_000):
    """Documents by similar numbers of lines, so that padding stays small."""
    n = np.diff(first)
    order = np.argsort(n, kind="stable")
    at = 0
    while at < len(order):
        end = at
        while end < len(order) and n[order[end]] * (end + 1 - at) <= most and n[order[end]] <= 2 * n[order[at]] + 8:
            end += 1
        end = max(end, at + 1)
        yield order[at:end], n[order[at:end]]
        at = end


def marginals(emit: np.ndarray, step: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(line is good) by forward-backward, and summed pair marginals of neighbouring labels."""
    good = np.zeros(len(emit))
    pairs = np.zeros((2, 2))
    trans = np.exp(step)
    for docs, n in _batches(first):
        length = int(n.max())
        at = first[docs][:, None] + np.arange(length)[None, :]
        on = np.arange(length)[None, :] < n[:, None]
        e = emit[np.where(on, at, 0)]
        e = np.where(on[:, :, None], np.exp(e - e.max(2, keepdims=True)), 1.0)
        fwd = np.empty_like(e)
        fwd[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
        for t in range(1, length):
            f = (fwd[:, t - 1] @ trans) * e[:, t]
            fwd[:, t] = np.where(on[:, t, None], f / f.sum(1, keepdims=True), fwd[:, t - 1])
        back = np.ones_like(e)
        for t in range(length - 2, -1, -1):
            b = (back[:, t + 1] * e[:, t + 1]) @ trans.T
            back[:, t] = np.where(on[:, t + 1, None], b / b.sum(1, keepdims=True), 1.0)
        p = fwd * back
        p /= p.sum(2, keepdims=True)
        good[at[on]] = p[:, :, 1][on]
        if length > 1:
            both = fwd[:, :-1, :, None] * trans[None, None] * (e[:, 1:] * back[:, 1:])[:, :, None, :]
            both /= both.sum((2, 3), keepdims=True)
            pairs += both[on[:, 1:]].sum(0)
    return good, pairs


def fit_chain(x: np.ndarray, y: np.ndarray, weight: np.ndarray, first: np.ndarray, rounds: int = 120, l2: float = 1e-4, rate: float = 0.15):
    """(weights, transitions) by Adam on the chain's log-likelihood; weight by line."""
    w, step = np.zeros(x.shape[1]), np.zeros((2, 2))
    m, v = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    total = weight.sum()
    inner = np.ones(len(x), bool)
    inner[first[:-1]] = False
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[np.flatnonzero(inner) - 1], y[inner]), 1.0)
    for k in range(1, rounds + 1):
        s = x @ w
        good, pairs = marginals(np.column_stack([np.zeros_like(s), s]), step, first)
        grad = np.concatenate([x.T @ ((y - good) * weight) / total - l2 * w, ((seen - pairs) / len(x) - l2 * step).ravel()])
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        w += move[:-4]
        step = np.clip(step + move[-4:].reshape(2, 2), -3, 3)
    return w, step


def line_odds(score: np.ndarray, step: np.ndarray, first: np.ndarray) -> np.ndarray:
    """P(line is good) as :func:`marginals` gives it, in two numbers a line: both messages as odds."""
    good = np.empty(len(score))
    (t00, t01), (t10, t11) = np.exp(step)
    for docs, n in _batches(first):
        length = int(n.max())
        at = np.minimum(first[docs] + np.arange(length)[:, None], len(score) - 1)
        odds = np.exp(np.clip(score[at], -300, 300))
        ahead = odds.copy()
        for t in range(1, length):
            ahead[t] *= (t01 + t11 * ahead[t - 1]) / (t00 + t10 * ahead[t - 1])
        back = np.ones(len(docs))
        for t in range(length - 1, -1, -1):
            if t < length - 1:
                r = odds[t + 1] * back
                back = np.where(t + 1 < n, (t10 + t11 * r) / (t00 + t01 * r), 1.0)
            ahead[t] *= back
        on = np.arange(length)[:, None] < n
        good[at[on]] = ahead[on] / (1 + ahead[on])
    return good


def document_means(score: np.ndarray, size: np.ndarray, first: np.ndarray, step: np.ndarray) -> np.ndarray:
    return np.add.reduceat(line_odds(score, step, first) * size, first[:-1]) / np.add.reduceat(size, first[:-1])


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most 500 rows and ``SLICE`` bytes of text, or of one row."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(size, SLICE + (size[at - 1] if at else 0), "right"))
        end = max(at + 1, min(end, at + 500))
        yield batch.slice(at, end - at)
        at = end


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = 2500, segment: int = 48, doc_segments: int = 12) -> dict:
    """Model from at most ``per_class`` labelled documents of each label.

    Only line features of these reach the driver, in chains of at most ``segment`` lines;
    a document of more than ``doc_segments`` chains gives so many, evenly spaced over it.
    Without labels of both kinds every score is the share of label 1 (1 without any).
    """
    sample = fit_sample(docs, labels, label_col, id_col, text_col, per_class)

    def taken(a: int, b: int) -> np.ndarray:
        """Lines of a document that lie in the segments taken; all of them up to the bound."""
        n = -(-(b - a) // segment)
        lines = np.arange(a, b)
        return lines if n <= doc_segments else lines[np.isin((lines - a) // segment, np.linspace(0, n - 1, doc_segments).astype(int))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, 3):
                x, size, first = line_features(part.column(3).to_pylist(), taken)
                rows, sizes = ([v[a:b].tobytes() for a, b in zip(first, first[1:])] for v in (x.astype(np.float32), size))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(rows, pa.binary()), pa.array(sizes, pa.binary())], names=["id", "y", "weight", "x", "size"])

    kind = f"id {dict(docs.dtypes)[id_col]}, y int, weight double, x binary, size binary"
    rows = sorted(sample.select("id", "y", "weight", "text").mapInArrow(run, kind).collect(), key=lambda r: (r.id, r.x))  # bounded by per_class
    if len({r.y for r in rows}) < 2:
        return {"w": None, "share": float(rows[0].y) if rows else 1.0}
    width = line_features([""])[0].shape[1]
    xs = [np.frombuffer(r.x, np.float32).reshape(-1, width).astype(float) for r in rows]
    lengths = np.array([len(a) for a in xs])
    x, size = np.vstack(xs), np.concatenate([np.frombuffer(r.size) for r in rows])
    whole = np.append(0, np.cumsum(lengths))
    cuts = np.append(np.concatenate([np.arange(a, b, segment) for a, b in zip(whole, whole[1:])]), len(x))
    doc_y = np.array([r.y for r in rows])
    doc_w = np.array([r.weight for r in rows])
    y = np.repeat(doc_y, lengths)
    # every document counts alike, its lines by length
    weight = size / np.repeat(np.add.reduceat(size, whole[:-1]), lengths) * np.repeat(doc_w, lengths)
    w, step = fit_chain(x, y, weight, cuts)
    s = x @ w
    good, _ = marginals(np.column_stack([np.zeros_like(s), s]), step, cuts)
    worst = np.minimum.reduceat(good, whole[:-1])
    y = np.where((y == 0) & (good > 0.5) & (good > np.repeat(worst, lengths)), 1, y)
    w, step = fit_chain(x, y, weight, cuts)
    mean = document_means(x @ w, size, whole, step)
    a, b = 6.0, -3.0
    for _ in range(50):  # logistic calibration by Newton steps
        p = 1 / (1 + np.exp(-(a * mean + b)))
        g = np.array([((doc_y - p) * mean * doc_w).sum() - 0.01 * a, ((doc_y - p) * doc_w).sum() - 0.01 * b])
        q = p * (1 - p) * doc_w
        h = np.array([[(q * mean * mean).sum() + 0.01, (q * mean).sum()], [(q * mean).sum(), q.sum() + 0.01]])
        da, db = np.linalg.solve(h, g)
        a, b = a + np.clip(da, -5, 5), b + np.clip(db, -5, 5)
    return {"w": w, "step": step, "a": float(max(a, 0.0)), "b": float(b)}


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and score, 0 to 1, from the whole text; null counts as empty.

    Rows are independent: repeated texts get equal scores, nothing is shuffled, and no
    other column is read. Texts are taken together by bytes, and line features are held for
    a stretch of a text only, so memory is a few numbers a line and some copies of one text.
    """
    shared = Shared(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in _parts(batch, 1):
                if m["w"] is None:
                    out = np.full(part.num_rows, m["share"])
                else:
                    mean = document_means(*line_scores(part.column(1).to_pylist(), m["w"]), m["step"])
                    out = 1 / (1 + np.exp(-(m["a"] * mean + m["b"])))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out)], names=["id", "score"])

    kind = f"id {dict(docs.dtypes)[id_col]}, score double"
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, kind).withColumnRenamed("id", id_col)


def held_out(id_col):
    """crc32 of the id as text, mod 5, is 0: such rows are never learned from."""
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 0
