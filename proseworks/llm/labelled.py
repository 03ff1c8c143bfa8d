"""Bounded samples of labelled documents to learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proseworks.llm.common import held_out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, text: str = "text", key: str = "doc_id") -> tuple[list[tuple[str, int]], dict[int, int]]:
    """Texts with label 0 or 1, at most ``per_class`` of either, and how many rows of each class may be learnt from.

    Rows set aside (see ``held_out``) and rows with a null id or label are never read. Of each class the ids
    with the smallest hash are taken, their texts whole. Order follows the text's hash.
    """
    known = labels.select(F.col(key).cast("long").alias("id"), F.col(label).cast("int").alias("label")).where("id is not null and label in (0, 1)").where(~held_out(F.col("id")))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    chosen = None
    for c in (0, 1):
        some = known.where(F.col("label") == c).orderBy(F.xxhash64("id"), "id").limit(per_class)
        chosen = some if chosen is None else chosen.union(some)
    found = (
        docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
        .join(F.broadcast(chosen), "id")  # at most 2 * per_class ids
        .where("text is not null")
        .select("text", "label", F.xxhash64("text").alias("h"))
        .toArrow()  # at most 2 * per_class rows
    )
    rows = sorted(zip(*(found.column(c).to_pylist() for c in ("h", "text", "label"))))
    return [(t, v) for _, t, v in rows], counts


def logistic(x, y, offset: float = 0.0, ridge: float = 1e-2, rounds: int = 50):
    """Weights of a logistic regression by Newton's method; the last is the intercept, moved by ``offset``."""
    import numpy as np

    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    w[-1] += offset
    return w
