"""Quality classifier: a sparse rule ensemble over statistics of a text.

Statistics of every whole text come from one Arrow pass. Small trees are boosted on a bounded
sample of labelled rows; each path from a root to a node below it is a rule, a conjunction of
comparisons on statistics. A lasso-penalised logistic regression over the rules keeps a few of
them. The kept rules are compiled into one Spark column expression, so scoring is a projection
and the model that reaches the tasks is a part of the plan.

The sample is at most ``MAX_LABELS`` rows, chosen by the hash of doc_id among labelled rows that
are not held out; everything else covers all rows. Labels, lang, source and doc_id are no inputs.

Defined results: a null text counts as empty and has a score; without labels of both kinds every
score is the share of good labels (0.5 without any); a null doc_id counts as held out; repeated
rows are returned as often as they come; of repeated labels of a document the smallest holds, of
several documents with a labelled doc_id the one with the smallest statistics is learned from; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.common import bounded_batches, free_names, table

MAX_LABELS = 20_000
HELD_OUT_OF = 5
ACCEPT_AT = 0.3
TREES = 24
DEPTH = 3
SHRINK = 0.3
BINS = 48
LEAST_ROWS = 8
LASSO = 2e-3
ROUNDS = 600

STATISTICS = (
    "log_words",
    "word_length",
    "upper_share",
    "digit_share",
    "space_share",
    "symbol_share",
    "bang_share",
    "bar_share",
    "stop_share",
    "odd_word_share",
    "distinct_share",
    "recent_share",
    "repeat_share",
    "top_word_share",
    "line_repeat_share",
    "log_line_words",
)

_SPACES = bytes(range(9, 14)) + b" "
_SYMBOLS = b"#$%&*+<=>@[\\]^_`{}~/"
_ODD_END = re.compile(r"[#$%&*|!+<=>@^_`~{}\[\]\\]{2,}$|^\W+$")


def statistics(text: str) -> list[float]:
    """The statistics named in ``STATISTICS``, of a whole text, in the text's length."""
    raw = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = max(1, len(raw))
    words = text.split()
    n = max(1, len(words))
    share = lambda chars: float(counts[list(chars)].sum()) / size
    letters = max(1, int(counts[65:91].sum() + counts[97:123].sum()))
    distinct = set(words)
    again = sum(map(str.__eq__, words, words[1:])) / max(1, n - 1)
    recent = 0.0
    top = 0.0
    if words:
        # the share of words that occur among the sixteen before them, and the most frequent word's share
        number = {w: i for i, w in enumerate(distinct)}
        ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        seen = np.zeros(len(ids), bool)
        for back in range(1, 17):
            if back < len(ids):
                seen[back:] |= ids[back:] == ids[:-back]
        recent = float(seen.mean())
        top = float(np.bincount(ids).max()) / n if n >= 20 else 0.0
    lines = [x for x in text.split("\n") if x.strip()]
    m = max(1, len(lines))
    return [
        float(np.log1p(len(words))),
        sum(map(len, words)) / n,
        float(counts[65:91].sum()) / letters,
        share(range(48, 58)),
        share(_SPACES),
        share(_SYMBOLS),
        share(b"!?"),
        share(b"|"),
        share(b".,;:"),
        sum(1 for w in distinct if _ODD_END.search(w)) / max(1, len(distinct)),
        len(distinct) / n,
        recent,
        again,
        top,
        1 - len(set(lines)) / m,
        float(np.log1p(n / m)),
    ]


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _statistics_column(texts: pa.Array) -> pa.Array:
    return pa.array([statistics(t.as_py() or "") for t in texts], pa.list_(pa.float64()))


def statistics_column(text: Column) -> Column:
    return _statistics_column(F.coalesce(text.cast("string"), F.lit("")))


#: (statistic, whether it must be above, threshold)
Condition = tuple[int, bool, float]


def _tidy(path: tuple[Condition, ...]) -> tuple[Condition, ...]:
    """The tightest of the conditions on the same side of a statistic."""
    tight: dict[tuple[int, bool], float] = {}
    for k, above, t in path:
        old = tight.get((k, above))
        tight[k, above] = t if old is None else (max(old, t) if above else min(old, t))
    return tuple(sorted((k, above, t) for (k, above), t in tight.items()))


def _grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, cuts: list[np.ndarray], path: tuple, depth: int, out: list, value: np.ndarray) -> None:
    """One tree by second-order gain; writes leaf values, collects the path of every node."""
    if path:
        out.append(_tidy(path))
    g, h = grad[rows].sum(), hess[rows].sum()
    best = (1e-9, None)
    if depth and len(rows) >= 2 * LEAST_ROWS:
        for k, cut in enumerate(cuts):
            if not len(cut):
                continue
            at = np.searchsorted(cut, x[rows, k], side="left")
            gl = np.cumsum(np.bincount(at, grad[rows], len(cut) + 1))[:-1]
            hl = np.cumsum(np.bincount(at, hess[rows], len(cut) + 1))[:-1]
            nl = np.cumsum(np.bincount(at, minlength=len(cut) + 1))[:-1]
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            gain[(nl < LEAST_ROWS) | (len(rows) - nl < LEAST_ROWS)] = -1
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (float(gain[i]), (k, float(cut[i])))
    if best[1] is None:
        value[rows] = -g / (h + 1)
        return
    k, t = best[1]
    left = x[rows, k] <= t
    _grow(x, grad, hess, rows[left], cuts, (*path, (k, False, t)), depth - 1, out, value)
    _grow(x, grad, hess, rows[~left], cuts, (*path, (k, True, t)), depth - 1, out, value)


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 11) -> list[tuple[Condition, ...]]:
    """Distinct paths of boosted trees, each grown on a half of the rows."""
    rng = np.random.default_rng(seed)
    cuts = []
    for k in range(x.shape[1]):
        v = np.unique(x[:, k])
        mid = (v[1:] + v[:-1]) / 2
        cuts.append(np.unique(np.quantile(mid, np.linspace(0, 1, BINS))) if len(mid) > BINS else mid)
    margin, found = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        rows = np.sort(rng.permutation(len(y))[: max(2 * LEAST_ROWS, len(y) // 2)])
        paths: list = []
        value = np.zeros(len(y))
        _grow(x, p - y, p * (1 - p), rows, cuts, (), depth, paths, value)
        rest = np.setdiff1d(np.arange(len(y)), rows)
        if paths:
            # rows left out get the value of the deepest path that they follow
            for path in paths:
                inside = holds(x[rows], path)
                if inside.any():
                    value[rest[holds(x[rest], path)]] = float(value[rows][inside].mean())
        margin += SHRINK * value
        found += paths
    return list(dict.fromkeys(found))


def holds(x: np.ndarray, rule: tuple[Condition, ...]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, above, t in rule:
        out &= (x[:, k] > t) if above else (x[:, k] <= t)
    return out


def lasso(z: np.ndarray, y: np.ndarray, penalty: float = LASSO, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """(weights, bias) of the logistic loss with an absolute-value penalty on the weights, by accelerated proximal steps."""
    n, m = z.shape
    a = np.c_[z, np.ones(n)]
    v = np.ones(m + 1) / np.sqrt(m + 1)
    for _ in range(30):
        v = a.T @ (a @ v)
        norm = np.linalg.norm(v)
        v /= norm
    step = 4 * n / norm
    w = old = np.zeros(m + 1)
    for i in range(rounds):
        ahead = w + (i / (i + 3)) * (w - old)
        p = 1 / (1 + np.exp(-(a @ ahead)))
        new = ahead - step * (a.T @ (p - y) / n)
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        w, old = new, w
    return w[:-1], float(w[-1])


@dataclass(frozen=True)
class RuleModel:
    rules: tuple[tuple[tuple[Condition, ...], float], ...]
    bias: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for rule, weight in self.rules:
            z += weight * holds(x, rule)
        return 1 / (1 + np.exp(-z))

    def column(self, stats: Column) -> Column:
        """The score as a Spark expression over a column of statistics."""
        z = F.lit(self.bias)
        for rule, weight in self.rules:
            test = None
            for k, above, t in rule:
                one = stats[k] > F.lit(t) if above else stats[k] <= F.lit(t)
                test = one if test is None else test & one
            z = z + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

    def text(self) -> list[str]:
        return [" and ".join(f"{STATISTICS[k]} {'>' if above else '<='} {t:.4g}" for k, above, t in rule) + f": {weight:+.3f}" for rule, weight in self.rules]


def fit_rows(x: np.ndarray, y: np.ndarray) -> RuleModel:
    if len(y) == 0:
        return RuleModel((), 0.0)
    if y.min() == y.max():
        return RuleModel((), 6.0 if y[0] else -6.0)
    found = tree_rules(x, y)
    if not found:
        return RuleModel((), float(np.log(y.mean() / (1 - y.mean()))))
    z = np.stack([holds(x, r) for r in found], axis=1).astype(np.float64)
    weights, bias = lasso(z, y)
    kept = [(r, float(w)) for r, w in zip(found, weights, strict=True) if abs(w) > 1e-6]
    return RuleModel(tuple(kept), bias)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % HELD_OUT_OF == 0


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> RuleModel:
    """Learns from at most ``max_labels`` labelled documents that aren't held out."""
    bounded_batches(spark)
    known = labels.select(F.col("doc_id").cast("long").alias("_label_id"), F.col("quality").cast("int").alias("_label"))
    known = known.where("_label_id is not null and _label in (0, 1)").where(~held_out(F.col("_label_id")))
    known = known.groupBy("_label_id").agg(F.min("_label").alias("_label"))
    chosen = known.orderBy(F.xxhash64("_label_id"), "_label_id").limit(max_labels)
    narrow = docs.select(F.col("doc_id").cast("long").alias("_doc_id"), F.col("text").alias("_text"))
    joined = narrow.join(F.broadcast(chosen), F.col("_doc_id") == F.col("_label_id"))
    measured = joined.select("_doc_id", "_label", statistics_column(F.col("_text")).alias("_stats"))
    # of documents that share a labelled doc_id one counts, so the sample keeps its bound
    rows = measured.groupBy("_doc_id", "_label").agg(F.min("_stats").alias("_stats")).collect()
    rows.sort(key=lambda r: (r[0], r[2]))
    return fit_rows(np.array([r[2] for r in rows]).reshape(len(rows), len(STATISTICS)), np.array([r[1] for r in rows], np.float64))


def score_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``: one row per document."""
    model = fit(spark, docs, labels, max_labels)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), statistics_column(F.col("text")).alias("stats"))
    scored = narrow.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.column(F.col("stats")).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= ACCEPT_AT, 1).otherwise(0))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier rejects go; a narrow pass, all columns stay."""
    model = fit(spark, docs, table(spark, sf_dir, "labels"))
    (stats,) = free_names(docs, "_stats_9")
    scored = docs.withColumn(stats, statistics_column(F.col("text")))
    return scored.where(model.column(F.col(stats)) >= ACCEPT_AT).select(*(F.col(f"`{c}`") for c in docs.columns))
