"""Quality classifier: a sparse ensemble of rules over text statistics.

Small trees grown on random halves of the sample give paths; every path is a conjunction of comparisons, a rule.
A logistic regression with an L1 penalty weighs the rules, most weights become zero, and what remains is
compiled into one Spark column expression, so scoring runs inside the scan.

Statistics are built-in functions of the text alone and computed once per text. The fit sees the ``max_rows``
labelled texts with the smallest hashes, a documented bound; scoring sees every text.

Defined results: a null text counts as empty; an empty text has statistics of zero and gets the score these give;
without labels of both kinds every score is the share of good labels (0.5 without any); repeated rows get equal
scores; if a text has several labels, the smallest counts; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from operator import add, and_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslake.session import staged

Rule = tuple[tuple[str, bool, float], ...]


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics of a text."""
    text = F.coalesce(text, F.lit(""))
    chars = F.greatest(F.length(text), F.lit(1)).cast("double")
    words = F.split(F.lower(text), r"[\x20\x09-\x0D]+")
    n_words = F.size(words).cast("double")
    lines = F.split(text, "\n")

    def share(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)) / chars

    return {
        "log_chars": F.log1p(F.length(text).cast("double")),
        "word_length": chars / n_words,
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines).cast("double"),
        "line_length": F.log1p(chars / F.size(lines).cast("double")),
        "symbols": share(r"[#*$%&<>@~^=+_{}\[\]]"),
        "exclaims": share(r"[!?]"),
        "bars": share(r"[|\\/]"),
        "capitals": share(r"[A-Z]"),
        "digits": share(r"[0-9]"),
        "stops": share(r"[.,;:]"),
        "wide": F.octet_length(text) / chars,
    }


def grow(x: np.ndarray, y: np.ndarray, depth: int, least: int, rng: np.random.Generator, bins: int = 24) -> list[tuple]:
    """Paths of a tree: tuples of (column, greater, cut). Cuts are chosen by Gini gain among quantiles."""
    n, p = len(y), y.mean()
    if depth == 0 or n < 2 * least or p in (0.0, 1.0):
        return []
    best = (1e-9, None)
    for j in rng.permutation(x.shape[1])[:max(2, x.shape[1] // 2)]:
        cuts = np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 2)[1:-1]))
        right = x[:, j][:, None] > cuts[None, :]
        n_right = right.sum(axis=0)
        p_right = (right * y[:, None]).sum(axis=0) / np.maximum(n_right, 1)
        p_left = (y.sum() - p_right * n_right) / np.maximum(n - n_right, 1)
        gain = p * (1 - p) - (n_right * p_right * (1 - p_right) + (n - n_right) * p_left * (1 - p_left)) / n
        gain = np.where((n_right >= least) & (n - n_right >= least), gain, -1)
        if gain.max(initial=-1) > best[0]:
            best = (gain.max(), (int(j), float(cuts[int(gain.argmax())])))
    if best[1] is None:
        return []
    j, cut = best[1]
    out = []
    for greater in (False, True):
        side = (x[:, j] > cut) == greater
        out.append(((j, greater, cut),))
        out += [((j, greater, cut), *path) for path in grow(x[side], y[side], depth - 1, least, rng, bins)]
    return out


def lasso(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic weights with an L1 penalty by accelerated proximal steps; the intercept is free."""
    z = np.hstack([np.ones((len(y), 1)), x])
    rate = 4.0 / max(np.linalg.norm(z, 2) ** 2 / len(y), 1e-9)
    weight = ahead = np.zeros(z.shape[1])
    pace = 1.0
    for _ in range(steps):
        slope = z.T @ (1 / (1 + np.exp(-(z @ ahead))) - y) / len(y)
        step = ahead - rate * slope
        step[1:] = np.sign(step[1:]) * np.maximum(np.abs(step[1:]) - rate * penalty, 0)
        faster = (1 + np.sqrt(1 + 4 * pace ** 2)) / 2
        ahead, weight, pace = step + (pace - 1) / faster * (step - weight), step, faster
    return float(weight[0]), weight[1:]


def fit(sample: list[dict], names: list[str], trees: int = 24, depth: int = 3, penalty: float = 1e-3,
        seed: int = 17) -> tuple[float, dict[Rule, float]]:
    """Intercept and weighted rules from rows that hold ``names`` and ``label``."""
    y = np.array([r["label"] for r in sample], dtype=float)
    if not len(y) or y.min() == y.max():
        return float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))), {}
    x, rng = np.array([[r[c] for c in names] for r in sample], dtype=float), np.random.default_rng(seed)
    least = max(2, min(20, len(y) // 50))
    paths = set()
    for _ in range(trees):
        # Halves with equal odds of either label, so that rare labels shape the trees too.
        odds = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
        rows = rng.choice(len(y), size=max(2, len(y) // 2), p=odds)
        paths.update(grow(x[rows], y[rows], depth, least, rng))
    paths = sorted(paths)
    hits = np.stack([np.all([(x[:, j] > cut) == greater for j, greater, cut in path], axis=0) for path in paths], axis=1)
    hits, first = np.unique(hits, axis=1, return_index=True)
    base, weights = lasso(hits.astype(float), y, penalty)
    return base, {tuple((names[j], greater, cut) for j, greater, cut in paths[i]): float(w)
                  for i, w in zip(first, weights, strict=True) if w}


def compiled(base: float, rules: dict[Rule, float]) -> Column:
    """The score between 0 and 1 as a Column over the statistics."""
    terms = [F.when(reduce(and_, [F.col(c) > cut if greater else F.col(c) <= cut for c, greater, cut in rule]), w)
             .otherwise(0.0) for rule, w in rules.items()]
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-reduce(add, terms, F.lit(base))))


def classify(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "quality", max_rows: int = 20_000, cut: float = 0.3, **options) -> DataFrame:
    """Rows (id, score, predicted), fitted on the labelled rows for which ``learn`` holds."""
    stats = statistics(F.col("_text"))
    measured = staged(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
                      .select("_id", *[c.alias(name) for name, c in stats.items()]))
    marked = (
        labels.where(learn & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id"))
        .agg(F.min(label_col).cast("int").alias("label"))
    )
    sample = measured.join(marked, "_id").orderBy(F.xxhash64(F.lit(11), "_id"), "_id", *stats).limit(max_rows)
    base, rules = fit([r.asDict() for r in sample.collect()], list(stats), **options)
    score = compiled(base, rules)
    return measured.select(F.col("_id").alias(id_col), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= cut).cast("int"))
