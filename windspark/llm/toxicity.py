"""Toxicity by cumulative-link ordinal regression on sparse text features.

P(grade > k) = sigmoid(w . x - theta_k): one weight per feature, shared by all ordered
thresholds. Features are the presence of words and of word beginnings, so that inflected
forms of an insult weigh like the insult, and of beginnings that two or three different
words share. Weights have both signs. The model is fitted on a bounded sample of labelled
documents; every document is scored on its whole text.

Labels are 0 and 1 only. Grades of toxic documents come from cross-fitting: models of one
threshold, fitted without the document on features chosen without it, score it, and thirds
of these scores are the grades 1 to 3, so no document's grade depends on its own label.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import Shared

_WORD = re.compile(r"[^\W\d_]+")
#: Lengths of word beginnings used as features.
BEGINNINGS = (4, 5, 6, 7, 8)
#: Grades: 0 not toxic, 1 to 3 toxic by rising score of models that have not seen the document.
GRADES = 4
FOLDS = 2


def _shared(words: set[str], n: int) -> Iterator[str]:
    """Beginnings of ``n`` letters: ^ marks those of one longer word, 2^ and 3^ those of so many."""
    for begin, k in Counter(w[:n] for w in words if len(w) > n).items():
        yield "^" + begin
        if k > 1:
            yield "2^" + begin
        if k > 2:
            yield "3^" + begin


def features(text: str | None) -> set[str]:
    """Words and word beginnings of a whole text, lower case."""
    words = set(_WORD.findall((text or "").lower()))
    return words.union(*[_shared(words, n) for n in BEGINNINGS])


def fit_sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", per_class: int = 4000) -> DataFrame:
    """(id, y, weight, text): at most ``per_class`` labelled documents of each label 0 and 1.

    Picked by hash of the id, the same in every run. Weights restore the labels' shares.
    Null labels and ids are left out; of differing labels of one id the larger counts, of
    several texts of one id the one with the smallest hash.
    """
    clean = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).groupBy("id").agg(F.max("y").alias("y"))
    total = {r.y: r["count"] for r in clean.groupBy("y").count().collect()}
    part = None
    for y in (0, 1):
        own = clean.where(F.col("y") == y).orderBy(F.xxhash64("id", F.lit(3)), "id").limit(per_class)
        own = own.withColumn("weight", F.lit(max(1.0, total.get(y, 0) / per_class)))
        part = own if part is None else part.unionByName(own)
    # bounded: two times per_class ids, and one row of each
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(F.broadcast(part), "id")
    one = F.min(F.struct(F.xxhash64("text").alias("h"), F.coalesce("text", F.lit("")).alias("text"))).alias("t")
    return rows.groupBy("id", "y", "weight").agg(one).select("id", "y", "weight", "t.text")


def choose_features(sample: DataFrame, most: int = 2000, least_docs: int = 3, least_gain: float = 8.0) -> list[list[str]]:
    """The features most tied to the label by likelihood ratio, at most ``most`` of them in each list.

    First those of the whole ``sample`` (fold, y, text), then for each fold those that the other folds give.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                seen = Counter()
                for fold, y, t in zip(*[c.to_pylist() for c in part.columns]):
                    seen.update((f, fold, y) for f in features(t))
                keys = list(zip(*seen)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[0], pa.string()), pa.array(keys[1], pa.int32()), pa.array(keys[2], pa.int32()), pa.array(list(seen.values()), pa.int64())],
                    names=["f", "fold", "y", "n"],
                )

    size = {(r.fold, r.y): r["count"] for r in sample.groupBy("fold", "y").count().collect()}
    cells = [F.sum(F.when((F.col("fold") == k) & (F.col("y") == y), F.col("n")).otherwise(0)).alias(f"n{k}{y}") for k in range(FOLDS) for y in (0, 1)]
    counts = sample.select("fold", "y", "text").mapInArrow(count, "f string, fold int, y int, n long").groupBy("f").agg(*cells).persist()

    def term(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / F.nullif(expected, F.lit(0.0)))).otherwise(0.0)

    def top(folds: list[int]) -> list[str]:
        n0, n1 = (sum(size.get((k, y), 0) for k in folds) for y in (0, 1))
        q, p = (sum(F.col(f"n{k}{y}") for k in folds) for y in (0, 1))
        k, n = p + q, max(n0 + n1, 1)
        # likelihood ratio of one rate by label against one rate for all
        gain = 2 * (term(p, k * n1 / n) + term(q, k * n0 / n) + term(n1 - p, (n - k) * n1 / n) + term(n0 - q, (n - k) * n0 / n))
        scored = counts.select("f", gain.alias("gain"), k.alias("k")).where((F.col("k") >= least_docs) & (F.col("gain") >= least_gain))
        return sorted(r.f for r in scored.orderBy(F.desc("gain"), "f").limit(most).collect())

    out = [top(list(range(FOLDS)))] + [top([j for j in range(FOLDS) if j != k]) for k in range(FOLDS)]
    counts.unpersist()
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_ordinal(x: np.ndarray, grade: np.ndarray, weight: np.ndarray, grades: int = GRADES, rounds: int = 300, l2: float = 0.02, rate: float = 0.1):
    """(w, theta) of the cumulative-link model, by Adam on the weighted log-likelihood."""
    d = x.shape[1]
    w, low, gaps = np.zeros(d), np.array([1.0]), np.zeros(grades - 2)
    state = np.zeros((2, d + grades - 1))
    weight = weight / weight.sum()
    for step in range(1, rounds + 1):
        theta = np.concatenate([low, low + np.cumsum(np.exp(gaps))])
        score = (x @ w.astype(x.dtype)).astype(float)
        up = _sigmoid(score[:, None] - theta[None, :])  # P(grade > k)
        edge = np.hstack([np.ones((len(x), 1)), up, np.zeros((len(x), 1))])
        at = np.arange(len(x))
        p = np.maximum(edge[at, grade] - edge[at, grade + 1], 1e-9)
        slope = np.hstack([np.zeros((len(x), 1)), up * (1 - up), np.zeros((len(x), 1))])
        d_score = (slope[at, grade] - slope[at, grade + 1]) / p * weight
        d_theta = np.zeros(grades - 1)
        np.add.at(d_theta, np.minimum(grade, grades - 2), np.where(grade <= grades - 2, slope[at, grade + 1] / p * weight, 0))
        np.add.at(d_theta, np.maximum(grade - 1, 0), np.where(grade >= 1, -slope[at, grade] / p * weight, 0))
        d_low = d_theta.sum()
        d_gaps = np.array([d_theta[k + 1 :].sum() for k in range(grades - 2)]) * np.exp(gaps)
        grad = np.concatenate([x.T @ d_score.astype(x.dtype) - l2 * w / len(x) * 10, [d_low], d_gaps])
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.999 * state[1] + 0.001 * grad**2
        move = rate * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-8)
        w += move[:d]
        low = low + move[d : d + 1]
        gaps = np.clip(gaps + move[d + 1 :], -6, 4)
    return w, np.concatenate([low, low + np.cumsum(np.exp(gaps))])


def cross_fitted(x: np.ndarray, y: np.ndarray, weight: np.ndarray, fold: np.ndarray, columns: list[list[int]]) -> np.ndarray:
    """Scores above the threshold of models with one threshold, each fitted on the other folds.

    ``columns`` names for each fold the features that its model may use.
    """
    out = np.zeros(len(x))
    for k, own in enumerate(columns):
        rest = fold != k
        if own and len(set(y[rest].tolist())) == 2:
            w, theta = fit_ordinal(x[np.ix_(rest, own)], y[rest], weight[rest], grades=2, rounds=150)
            out[~rest] = x[np.ix_(~rest, own)] @ w - theta[0]
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 4000) -> dict:
    """Model from 0/1 labels: feature weights and thresholds.

    Labelled toxic documents get the grades 1 to 3 by thirds of their cross-fitted scores
    (:func:`cross_fitted`). Without labels of both kinds the model calls nothing toxic.
    """
    fold = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(FOLDS)).cast("int").alias("fold")
    sample = fit_sample(docs, labels, label_col, id_col, text_col, per_class).select(fold, "y", "weight", "text").persist()
    whole, *by_fold = choose_features(sample)
    order = {f: i for i, f in enumerate(sorted(set(whole).union(*by_fold)))}
    chosen = Shared(docs.sparkSession, order)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [sorted(chosen.value[f] for f in features(t) & chosen.value.keys()) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(got, pa.list_(pa.int32()))], names=["fold", "y", "weight", "hits"])

    rows = sample.mapInArrow(hits, "fold int, y int, weight double, hits array<int>").collect()  # bounded by per_class
    sample.unpersist()
    if not whole or len({r.y for r in rows}) < 2:
        return {"words": {}, "theta": np.array([9.0, 10.0, 11.0])}
    rows.sort(key=lambda r: (r.y, r.fold, r.weight, r.hits))
    x = np.zeros((len(rows), len(order)), np.float32)
    for i, r in enumerate(rows):
        x[i, r.hits] = 1
    y = np.array([r.y for r in rows])
    weight = np.array([r.weight for r in rows])
    outside = cross_fitted(x, y, weight, np.array([r.fold for r in rows]), [[order[f] for f in own] for own in by_fold])
    cut = np.quantile(outside[y == 1], [1 / 3, 2 / 3])
    grade = np.where(y == 1, 1 + (outside > cut[0]) + (outside > cut[1]), 0)
    w, theta = fit_ordinal(x[:, [order[f] for f in whole]], grade, weight)
    return {"words": dict(zip(whole, w.tolist())), "theta": theta}


def _scorer(words: dict[str, float]):
    """Sum of the weights of a text's features, without building the features it lacks."""
    whole = {f for f in words if "^" not in f}
    marked = {f for f in words if "^" in f}
    first = {f.partition("^")[2][: BEGINNINGS[0]] for f in marked}

    def total(text: str | None) -> float:
        seen = set(_WORD.findall((text or "").lower()))
        found = seen & whole
        some = {w for w in seen if w[: BEGINNINGS[0]] in first}
        if some:
            for n in BEGINNINGS:
                found.update(marked.intersection(_shared(some, n)))
        return sum(sorted(words[f] for f in found))

    return total


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, severity (expected grade, 0 to 3), p_toxic = P(grade > 0), toxic (p_toxic >= 0.5).

    Whole texts; null and empty texts have no features and so the lowest severity.
    Repeated rows get equal results; other columns are not read; nothing is shuffled.
    """
    shared = Shared(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, theta = _scorer(shared.value["words"]), np.asarray(shared.value["theta"])
        for batch in batches:
            s = np.array([total(t) for t in batch.column(1).to_pylist()], float)
            p = _sigmoid(s[:, None] - theta[None, :])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p.sum(1)), pa.array(p[:, 0]), pa.array(s >= theta[0])], names=["id", "severity", "p_toxic", "toxic"]
            )

    kind = f"id {dict(docs.dtypes)[id_col]}, severity double, p_toxic double, toxic boolean"
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, kind).withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows scored toxic, all columns as they are, nothing shuffled.

    Only texts go to Python and only flags come back. Null texts count as empty.
    """
    shared = Shared(docs.sparkSession, model)

    @F.arrow_udf("boolean")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        total, top = _scorer(shared.value["words"]), float(shared.value["theta"][0])
        for texts in batches:
            yield pa.array([total(t) < top for t in texts.to_pylist()], pa.bool_())

    return docs.where(clean(docs[text_col]))
