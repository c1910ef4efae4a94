"""Linear algebra over feature columns: bounded partial sums per task, merged in two steps."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

MERGE_SHARDS = 64


def _field_types(df: DataFrame, names: Sequence[str]) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def _merge_vectors(keys: list[str]):
    """Sum `vec` and `n` per key over all batches of a task; state is one vector per key seen."""

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict[tuple, list] = {}
        for pdf in batches:
            for key, vec, n in zip(zip(*[pdf[k] for k in keys]) if keys else [()] * len(pdf), pdf["vec"], pdf["n"]):
                if key in state:
                    state[key][0] += vec
                    state[key][1] += int(n)
                else:
                    state[key] = [np.array(vec, dtype=np.float64), int(n)]
        if state:
            yield pd.DataFrame([{**dict(zip(keys, key)), "vec": vec, "n": n} for key, (vec, n) in state.items()])

    return merge


def sum_vectors(partials: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Element-wise sum of `vec` (and `n`) per key.

    Partials come one per task and key. They are first merged inside shards, so the last step reads
    at most MERGE_SHARDS rows per key.
    """
    keys = list(keys)
    schema = f"{_field_types(partials, keys)}{', ' if keys else ''}vec array<double>, n bigint"
    sharded = partials.withColumn("_shard", F.spark_partition_id() % MERGE_SHARDS).repartition(*keys, "_shard").drop("_shard")
    first = sharded.mapInPandas(_merge_vectors(keys), schema)
    return (first.repartition(*keys) if keys else first.coalesce(1)).mapInPandas(_merge_vectors(keys), schema)


def moments(df: DataFrame, keys: Sequence[str], features: str) -> DataFrame:
    """n, mean vector and centred second-moment matrix (flattened) per key.

    Every task centres its own rows, so only differences between task means are subject to
    cancellation. `vec` holds [sum | centred gram + n*mean*mean^T] before the final correction.
    """
    keys = list(keys)
    schema = f"{_field_types(df, keys)}, vec array<double>, n bigint"

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict[tuple, tuple[int, np.ndarray, np.ndarray]] = {}
        for pdf in batches:
            for key, rows in pdf.groupby(keys, dropna=False, sort=False) if keys else [((), pdf)]:
                x = np.stack(rows["f"].to_numpy()).astype(np.float64)
                mean = x.mean(axis=0)
                centred = (x - mean).T @ (x - mean) + len(x) * np.outer(mean, mean)
                key = key if isinstance(key, tuple) else (key,)
                n, s, g = state.get(key, (0, 0.0, 0.0))
                state[key] = (n + len(x), s + x.sum(axis=0), g + centred)
        if state:
            yield pd.DataFrame([
                {**dict(zip(keys, key)), "vec": np.concatenate([s, g.ravel()]), "n": n} for key, (n, s, g) in state.items()
            ])

    slim = df.select(*keys, F.col(features).cast("array<double>").alias("f"))
    summed = sum_vectors(slim.mapInPandas(partial, schema), keys)

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for _, r in pdf.iterrows():
                vec = np.asarray(r["vec"])
                d = int((np.sqrt(1 + 4 * len(vec)) - 1) / 2)
                mean = vec[:d] / r["n"]
                scatter = vec[d:].reshape(d, d) - r["n"] * np.outer(mean, mean)
                rows.append({**{k: r[k] for k in keys}, "n": int(r["n"]), "mean": mean, "scatter": scatter.ravel()})
            yield pd.DataFrame(rows)

    out = f"{_field_types(df, keys)}, n bigint, mean array<double>, scatter array<double>"
    return summed.mapInPandas(finish, out.lstrip(", "))


#: Rows whose products of features are held at once.
BLOCK_ROWS = 512
#: Doubles of Newton sums that a task holds before it sends them on.
HELD_SUMS = 1 << 23


def masked_logistic_fits(
    rows: DataFrame, group: str, features: str, y: str, weight: str, train: str, folds: int,
    cost: float = 1.0, max_iter: int = 50, tol: float = 1e-8,
) -> dict[tuple, np.ndarray]:
    """L2-penalised logistic regressions of many overlapping row sets, all trained together by Newton steps.

    `train` is an array of bit masks, one word for each set: bit k says that the row trains model k of the
    set, k below `folds`. So a row stands once, next to its features, however many models it takes part in,
    and one pass over the rows serves all models of a step: scores, gradients and Hessians of all of them are
    matrix products with the mask. Models of different values of `group` share no rows. The result is keyed
    (group, set, k) and ends with the intercept. The objective is |w|^2/2 + cost*sum(weight*loss), intercept penalised too.

    A step sends sums of fixed size for each group and set, merged in two steps and solved where they
    meet; the driver holds the coefficients only. Models that still move after `max_iter` steps stop the job.
    """
    spark = rows.sparkSession
    # every step reads these rows again: write them once where any executor can find them
    kept = cut_lineage(rows.select(
        F.col(group).alias("g"), F.col(features).cast("array<double>").alias("f"), F.col(y).cast("double").alias("y"),
        F.col(weight).cast("double").alias("w"), F.col(train).cast("array<bigint>").alias("t")))
    cores = spark.sparkContext.defaultParallelism
    if kept.rdd.getNumPartitions() < cores:  # small input: adaptive coalescing left cores without rows
        kept = cut_lineage(kept.repartition(cores, "f"))
    shape = kept.groupBy("g").agg(F.max(F.size("f")).alias("width"), F.max(F.size("t")).alias("sets")).collect()
    dim = max((r["width"] for r in shape), default=0) + 1
    betas = {r["g"]: np.zeros((dim, r["sets"] * folds)) for r in shape}
    one, other = np.triu_indices(dim)
    kind = _field_types(kept, ["g"])

    def step(current) -> dict:
        shipped = spark.sparkContext.broadcast(current)

        def packed(key, sums: np.ndarray) -> Iterator[dict]:
            for i in range(sums.shape[1] // folds):
                yield {"g": key, "set": i, "vec": sums[:, i * folds : (i + 1) * folds].ravel(), "n": 1}

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            state: dict = {}
            for pdf in batches:
                for key, part in pdf.groupby("g", sort=False, dropna=False):
                    key = next(k for k in shipped.value if k == key or k is None and pd.isna(key))
                    beta = shipped.value[key]
                    for a in range(0, len(part), BLOCK_ROWS):
                        block = part.iloc[a : a + BLOCK_ROWS]
                        x = np.column_stack([np.stack(block["f"].to_numpy()), np.ones(len(block))])
                        bits = np.stack(block["t"].to_numpy()).astype(np.int64)[:, :, None] >> np.arange(folds) & 1
                        w = bits.reshape(len(block), -1) * block["w"].to_numpy()[:, None]
                        p = 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -500, 500)))
                        sums = np.vstack([x.T @ (w * (p - block["y"].to_numpy()[:, None])), (x[:, one] * x[:, other]).T @ (w * p * (1 - p))])
                        state[key] = state[key] + sums if key in state else sums
                if sum(v.size for v in state.values()) > HELD_SUMS:
                    yield pd.DataFrame([r for k, v in state.items() for r in packed(k, v)])
                    state = {}
            if state:
                yield pd.DataFrame([r for k, v in state.items() for r in packed(k, v)])

        def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for r in pdf.to_dict("records"):
                    key = next(k for k in shipped.value if k == r["g"] or k is None and pd.isna(r["g"]))
                    sums = np.asarray(r["vec"]).reshape(-1, folds)
                    now = shipped.value[key][:, r["set"] * folds : (r["set"] + 1) * folds].copy()
                    far = 0.0
                    for k in range(folds):
                        hess = np.zeros((dim, dim))
                        hess[one, other] = hess[other, one] = cost * sums[dim:, k]
                        move = np.linalg.solve(hess + np.eye(dim), cost * sums[:dim, k] + now[:, k])
                        move *= min(1.0, 5 / max(np.abs(move).max(), 1e-300))
                        now[:, k] -= move
                        far = max(far, float(np.abs(move).max()))
                    out.append({"g": r["g"], "set": r["set"], "beta": now.ravel(), "moved": far})
                yield pd.DataFrame(out)

        sums = sum_vectors(kept.mapInPandas(partial, f"{kind}, set int, vec array<double>, n bigint"), ["g", "set"])
        return sums.mapInPandas(solve, f"{kind}, set int, beta array<double>, moved double").collect()

    for _ in range(max_iter):
        moved = 0.0
        for r in step(betas):
            betas[r["g"]][:, r["set"] * folds : (r["set"] + 1) * folds] = np.asarray(r["beta"]).reshape(dim, folds)
            moved = max(moved, r["moved"])
        if moved < tol:
            return {(g, i // folds, i % folds): b[:, i].copy() for g, b in betas.items() for i in range(b.shape[1])}
    raise RuntimeError(f"logistic fits still move by {moved} after {max_iter} steps")


def logistic_fits(
    rows: DataFrame, models: Sequence[str], features: str, y: str, weight: str,
    cost: float = 1.0, max_iter: int = 50, tol: float = 1e-8,
) -> dict[tuple, np.ndarray]:
    """One logistic regression per value of the columns `models`, keyed by them and -1; see `masked_logistic_fits`."""
    packed = rows.select(
        (F.to_json(F.struct(*models)) if models else F.lit("")).alias("_g"), *models, features, y, weight, F.array(F.lit(1).cast("bigint")).alias("_t"))
    fits = masked_logistic_fits(packed, "_g", features, y, weight, "_t", 1, cost, max_iter, tol)
    named = {r["_g"]: tuple(r[m] for m in models) for r in packed.select("_g", *models).distinct().collect()}
    return {(*named[g], -1): b for (g, _, _), b in fits.items()}


def logistic_fit_columns(
    rows: DataFrame, features: Sequence[str], y: str, weight: str, cost: float = 1.0, max_iter: int = 50, tol: float = 1e-8,
) -> np.ndarray:
    """The regression of `logistic_fits` on a few numeric columns; every Newton step is one aggregate of the JVM.

    Gradient and Hessian of k columns are (k + 1)(k + 4)/2 plain sums, combined before they are shuffled, so
    no row leaves the JVM. Meant for up to about ten columns.
    """
    kept = cut_lineage(rows.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)], F.col(y).cast("double").alias("y"), F.col(weight).cast("double").alias("w")))
    dim = len(features) + 1
    x = [*[F.col(f"x{i}") for i in range(dim - 1)], F.lit(1.0)]
    beta = np.zeros(dim)
    for _ in range(max_iter):
        z = sum((x[i] * float(beta[i]) for i in range(1, dim)), x[0] * float(beta[0]))
        scored = kept.withColumn("p", F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))
        pull, curve = F.col("w") * (F.col("p") - F.col("y")), F.col("w") * F.col("p") * (F.lit(1.0) - F.col("p"))
        pairs = [(i, j) for i in range(dim) for j in range(i, dim)]
        sums = scored.agg(*[F.sum(pull * x[i]).alias(f"g{i}") for i in range(dim)], *[F.sum(curve * x[i] * x[j]).alias(f"h{i}_{j}") for i, j in pairs]).first()
        hess = np.eye(dim)
        for i, j in pairs:
            hess[i, j] += cost * (sums[f"h{i}_{j}"] or 0.0)
            hess[j, i] = hess[i, j]
        move = np.linalg.solve(hess, cost * np.array([sums[f"g{i}"] or 0.0 for i in range(dim)]) + beta)
        move *= min(1.0, 5 / max(np.abs(move).max(), 1e-300))
        beta = beta - move
        if np.abs(move).max() < tol:
            return beta
    raise RuntimeError(f"the logistic fit did not settle in {max_iter} steps")
