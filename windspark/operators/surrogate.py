"""The load surrogate as Spark passes: scoring, fitting by local steps of one carried optimiser, best epoch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOPE = 0.01


def init_model(n_features: int, n_inputs: int, tasks: dict[str, list[str]], hidden=(256, 256), branch=(64, 32), layer_norm: bool = False, attention: bool = False, seed: int = 0) -> dict:
    """Weights by name: input branch, trunk over features and branch, one head for each task."""
    rng = np.random.default_rng(seed)
    w: dict[str, np.ndarray] = {}

    def linear(name, n_in, n_out):
        bound = 1 / np.sqrt(max(n_in, 1))
        w[f"{name}.w"] = rng.uniform(-bound, bound, (n_in, n_out))
        w[f"{name}.b"] = rng.uniform(-bound, bound, n_out)

    for part, start, sizes in (("branch", n_inputs, branch), ("trunk", n_features + branch[-1], hidden)):
        n = start
        for k, h in enumerate(sizes):
            linear(f"{part}{k}", n, h)
            if layer_norm:
                w[f"{part}{k}.g"], w[f"{part}{k}.s"] = np.ones(h), np.zeros(h)
            n = h
    for t, outs in tasks.items():
        mid = 64 if len(outs) > 1 else 32
        linear(f"{t}.in", hidden[-1], mid)
        linear(f"{t}.out", mid, len(outs))
    if attention:
        w["attention"] = np.ones(n_features)
    return {"weights": w, "tasks": tasks, "hidden": tuple(hidden), "branch": tuple(branch), "layer_norm": layer_norm}


def _softmax(x):
    e = np.exp(x - x.max())
    return e / e.sum()


def _relu(x):
    return np.where(x > 0, x, SLOPE * x)


def forward(model: dict, feats: np.ndarray, inputs: np.ndarray, keep: dict | None = None, dropout: float = 0.0, rng: np.random.Generator | None = None) -> dict[str, np.ndarray]:
    """Outputs by task; ``keep`` collects what the gradient needs. With ``rng``, units of branch and trunk drop out."""
    w = model["weights"]

    def block(x, name, drops=True):
        z = x @ w[f"{name}.w"] + w[f"{name}.b"]
        a = z
        if f"{name}.g" in w:
            mu, sd = z.mean(1, keepdims=True), np.sqrt(z.var(1, keepdims=True) + 1e-5)
            n = (z - mu) / sd
            a = n * w[f"{name}.g"] + w[f"{name}.s"]
            if keep is not None:
                keep[f"{name}.n"], keep[f"{name}.sd"] = n, sd
        if keep is not None:
            keep[f"{name}.x"], keep[f"{name}.a"] = x, a
        out = _relu(a)
        if rng is not None and dropout > 0 and drops:
            mask = (rng.random(out.shape) >= dropout) / (1.0 - dropout)
            out = out * mask
            if keep is not None:
                keep[f"{name}.d"] = mask
        return out

    x = inputs
    for k in range(len(model["branch"])):
        x = block(x, f"branch{k}")
    att = _softmax(w["attention"]) if "attention" in w else None
    h = np.hstack([feats * att if att is not None else feats, x])
    for k in range(len(model["hidden"])):
        h = block(h, f"trunk{k}")
    out = {}
    for t in model["tasks"]:
        mid = block(h, f"{t}.in", False)
        if keep is not None:
            keep[f"{t}.out.x"] = mid
        out[t] = mid @ w[f"{t}.out.w"] + w[f"{t}.out.b"]
    return out


def gradient(model: dict, feats: np.ndarray, inputs: np.ndarray, truth: dict[str, np.ndarray], dropout: float = 0.0, rng: np.random.Generator | None = None) -> tuple[dict[str, np.ndarray], float]:
    """Gradient and value of the mean squared error over all outputs."""
    w, keep = model["weights"], {}
    out = forward(model, feats, inputs, keep, dropout, rng)
    n = sum(o.size for o in out.values())
    grad = {k: np.zeros_like(v) for k, v in w.items()}
    loss = 0.0

    def back(name, d):
        if f"{name}.d" in keep:
            d = d * keep[f"{name}.d"]
        d = d * np.where(keep[f"{name}.a"] > 0, 1.0, SLOPE)
        if f"{name}.g" in w:
            norm = keep[f"{name}.n"]
            grad[f"{name}.g"] += (d * norm).sum(0)
            grad[f"{name}.s"] += d.sum(0)
            d = d * w[f"{name}.g"]
            d = (d - d.mean(1, keepdims=True) - norm * (d * norm).mean(1, keepdims=True)) / keep[f"{name}.sd"]
        grad[f"{name}.w"] += keep[f"{name}.x"].T @ d
        grad[f"{name}.b"] += d.sum(0)
        return d @ w[f"{name}.w"].T

    dh = 0.0
    for t, o in out.items():
        e = o - truth[t]
        loss += float((e * e).sum()) / n
        d = 2 * e / n
        grad[f"{t}.out.w"] += keep[f"{t}.out.x"].T @ d
        grad[f"{t}.out.b"] += d.sum(0)
        dh = dh + back(f"{t}.in", d @ w[f"{t}.out.w"].T)
    for k in reversed(range(len(model["hidden"]))):
        dh = back(f"trunk{k}", dh)
    d_feats, d = dh[:, : feats.shape[1]], dh[:, feats.shape[1] :]
    if "attention" in w:
        att = _softmax(w["attention"])
        da = (d_feats * feats).sum(0)
        grad["attention"] += att * (da - (da * att).sum())
    for k in reversed(range(len(model["branch"]))):
        d = back(f"branch{k}", d)
    return grad, loss


def _matrix(batch: pa.RecordBatch, cols: list[int]) -> np.ndarray:
    return np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in cols]) if cols else np.zeros((batch.num_rows, 0))


def score_surrogate(df: DataFrame, model: dict, features: list[str], inputs: list[str], keys: list[str]) -> DataFrame:
    """Keys and one column for each output, by name; row-local with broadcast weights."""
    outs = [o for v in model["tasks"].values() for o in v]
    shared = df.sparkSession.sparkContext.broadcast(model)
    k, nf, ni = len(keys), len(features), len(inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = forward(shared.value, _matrix(batch, list(range(k, k + nf))), _matrix(batch, list(range(k + nf, k + nf + ni))))
            cols = [pa.array(got[t][:, i]) for t, v in shared.value["tasks"].items() for i in range(len(v))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], *cols], names=[*keys, *outs])

    kinds = dict(df.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keys] + [f"`{o}` double" for o in outs])
    return df.select(*keys, *features, *inputs).mapInArrow(run, schema)


def feature_importance(spark, model: dict, features: list[str]) -> DataFrame:
    """(feature, importance): softmax of the attention weights, sum 1."""
    return spark.createDataFrame(list(zip(features, _softmax(model["weights"]["attention"]).tolist())), "feature string, importance double")


def start_state(model: dict) -> dict:
    """An optimiser that has made no step: both moments of every weight, and the number of steps."""
    zero = lambda: {k: np.zeros_like(v) for k, v in model["weights"].items()}
    return {"m": zero(), "v": zero(), "step": 0.0}


def adamw(weights: dict, grad: dict, state: dict, lr: float, decay: float, clip: float | None) -> None:
    """One AdamW step in place; ``clip`` bounds the norm of the whole gradient."""
    if clip:
        norm = np.sqrt(sum(float((x * x).sum()) for x in grad.values()))
        grad = {k: x * min(1.0, clip / (norm + 1e-6)) for k, x in grad.items()}
    state["step"] += 1
    m, v, n = state["m"], state["v"], state["step"]
    for k, g in grad.items():
        m[k] = 0.9 * m[k] + 0.1 * g
        v[k] = 0.999 * v[k] + 0.001 * g**2
        weights[k] *= 1 - lr * decay
        weights[k] -= lr * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.999**n)) + 1e-8)


def _copied(model: dict, state: dict) -> tuple[dict, dict]:
    own = {**model, "weights": {k: v.copy() for k, v in model["weights"].items()}}
    return own, {"m": dict(state["m"]), "v": dict(state["v"]), "step": state["step"]}


def _flat(parts: list[dict], names: list[str]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for p in parts for k in names])


def _shaped(flat: np.ndarray, like: dict, names: list[str], at: int) -> tuple[dict, int]:
    out = {}
    for k in names:
        size = like[k].size
        out[k] = flat[at : at + size].reshape(like[k].shape)
        at += size
    return out, at


def _truth(model: dict, y: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for t, v in model["tasks"].items():
        out[t] = y[:, at : at + len(v)]
        at += len(v)
    return out


def _batches_of(batches: Iterator[pa.RecordBatch], n_cols: int, rows: int) -> Iterator[np.ndarray]:
    """The same rows in matrices of ``rows`` rows, whatever Arrow's batches; the last is shorter."""
    held, n = [], 0
    for batch in batches:
        x = _matrix(batch, list(range(n_cols)))
        while len(x):
            take = min(rows - n, len(x))
            held.append(x[:take])
            n += take
            x = x[take:]
            if n == rows:
                yield np.concatenate(held)
                held, n = [], 0
    if n:
        yield np.concatenate(held)


def _summed(df: DataFrame, run) -> np.ndarray:
    """Sums by position of the (at, x) rows of ``run``, which are of the size of the model."""
    sums = df.mapInArrow(run, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).toPandas()
    if not len(sums):
        raise ValueError("no rows to fit")
    return sums.sort_values("at")["x"].to_numpy()


def _positions(flat: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["at", "x"])


def fit_step(df: DataFrame, model: dict, features: list[str], inputs: list[str], lr: float = 1e-3, decay: float = 1e-4, clip: float | None = None, state: dict | None = None) -> tuple[dict, float, dict]:
    """(model, loss before, optimiser state) after one step along the gradient over all rows.

    Tasks sum up the gradients of their rows; a step costs one pass and moves numbers of the
    size of the model.
    """
    names = list(model["weights"])
    outs = [o for v in model["tasks"].values() for o in v]
    nf, ni = len(features), len(inputs)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in _batches_of(batches, nf + ni + len(outs), 4096):
            g, loss = gradient(shared.value, x[:, :nf], x[:, nf : nf + ni], _truth(shared.value, x[:, nf + ni :]))
            flat = np.append(_flat([g], names), [loss, 1.0]) * len(x)
            total = flat if total is None else total + flat
        if total is not None:
            yield _positions(total)

    flat = _summed(df.select(*features, *inputs, *outs), run)
    flat = flat / flat[-1]
    grad, _ = _shaped(flat, model["weights"], names, 0)
    model, state = _copied(model, state or start_state(model))
    adamw(model["weights"], grad, state, lr, decay, clip)
    return model, float(flat[-2]), state


def fit_epoch(
    df: DataFrame, model: dict, features: list[str], inputs: list[str], lr: float = 1e-3, decay: float = 1e-4, batch_rows: int = 4096, clip: float | None = None,
    state: dict | None = None, dropout: float = 0.0, seed: int = 0, shuffled: bool = True,
) -> tuple[dict, float, dict]:
    """(model, mean loss, optimiser state) after one pass of mini-batches.

    Each partition takes AdamW steps from the same weights and the same moments, in an order
    of rows that ``seed`` gives; weights and moments are then averaged by rows and go on into the
    next pass. With one partition this is a plain loop with one optimiser. Rows are put in order by a
    hash of seed and values, so an order does not depend on how rows came in. What returns is
    three times the size of the model, summed by position in Spark.
    """
    names = list(model["weights"])
    outs = [o for v in model["tasks"].values() for o in v]
    nf, ni = len(features), len(inputs)
    shared = df.sparkSession.sparkContext.broadcast((model, state or start_state(model)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, moments = _copied(*shared.value)
        task = TaskContext.get()
        rng = np.random.default_rng([seed, task.partitionId() if task else 0])
        rows, loss = 0, 0.0
        for x in _batches_of(batches, nf + ni + len(outs), batch_rows):
            g, e = gradient(own, x[:, :nf], x[:, nf : nf + ni], _truth(own, x[:, nf + ni :]), dropout, rng)
            adamw(own["weights"], g, moments, lr, decay, clip)
            rows += len(x)
            loss += e * len(x)
        if rows:
            flat = _flat([own["weights"], moments["m"], moments["v"]], names)
            yield _positions(np.append(flat, [moments["step"], loss / rows, 1.0]) * rows)

    own = df.select(*features, *inputs, *outs)
    if shuffled:
        own = own.sortWithinPartitions(F.xxhash64(F.lit(seed), *own.columns), *own.columns)
    flat = _summed(own, run)
    flat = flat / flat[-1]
    like, at = model["weights"], 0
    parts = []
    for _ in range(3):
        part, at = _shaped(flat, like, names, at)
        parts.append(part)
    return {**model, "weights": parts[0]}, float(flat[-2]), {"m": parts[1], "v": parts[2], "step": float(flat[-3])}


def fit_surrogate(train: DataFrame, val: DataFrame, model: dict, features: list[str], inputs: list[str], epochs: int = 10, seed: int = 0, averages: int = 1, **kw) -> tuple[dict, DataFrame]:
    """(best model, history of epoch, loss, r2) - validation R2 after every epoch, the best is kept.

    One optimiser goes through all epochs. With ``averages`` above 1, partitions are averaged so
    many times in an epoch, after each share of the rows, which are dealt out anew by epoch.
    """
    outs = [o for v in model["tasks"].values() for o in v]
    train, val = train.persist(), val.persist()
    history, best, state = [], None, None
    for epoch in range(1, epochs + 1):
        losses = []
        for k in range(averages):
            part = train
            if averages > 1:
                part = train.where(F.pmod(F.xxhash64(F.lit(seed), F.lit(epoch), *features, *inputs, *outs), F.lit(averages)) == k)
                if part.isEmpty():
                    continue
            model, loss, state = fit_epoch(part, model, features, inputs, state=state, seed=seed * 1_000_003 + epoch, **kw)
            losses.append(loss)
        if not losses:
            raise ValueError("no rows to fit")
        keyed = val.withColumn("_k", F.struct(*outs))
        pred = score_surrogate(keyed, model, features, inputs, ["_k"])
        e = F.lit(0.0)
        t = F.lit(0.0)
        for o in outs:
            e = e + F.sum(F.pow(F.col("_k")[o] - F.col(o), 2))
            t = t + F.count("*") * F.var_pop(F.col("_k")[o])
        r2 = pred.agg((1 - e / (t + 1e-12)).alias("r2")).first()[0]
        history.append((epoch, float(np.mean(losses)), r2))
        if best is None or (r2 is not None and r2 > best[0]):
            best = (r2 if r2 is not None else float("-inf"), model)
    train.unpersist(), val.unpersist()
    return best[1], train.sparkSession.createDataFrame(history, "epoch int, loss double, r2 double")


def keep_best(history: DataFrame) -> DataFrame:
    """The epoch with the highest R2, the first of equals."""
    return history.orderBy(F.desc_nulls_last("r2"), "epoch").limit(1)
