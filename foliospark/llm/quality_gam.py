"""Quality classifier: a generalised additive model with pairwise interactions.

Each text becomes a dozen numbers (shape of its characters, words and lines). Cyclic boosting visits one number after
the other and adds a shallow tree over its bins to that number's lookup table; then the pairs of numbers that explain
most of what is left get tables over their joint bins in the same way. A score is a sum of looked-up values.

The model is fitted on at most MAX_LABELS labelled rows (those of smallest hash of doc_id), so that what reaches the
driver is bounded; scoring is one map-only pass over the whole texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id

MAX_LABELS = 20_000
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0
FEATURES = ("log_words", "word_len", "upper", "digit", "symbol", "pipe", "exclaim", "sentence_end", "distinct", "stutter", "line_repeat", "words_a_line", "non_ascii", "top_word")
BINS, ROUNDS, RATE, LEAVES, LEAST_LEAF = 32, 60, 0.2, 3, 8
PAIR_BINS, PAIRS, PAIR_ROUNDS = 8, 6, 20


def features(text: str | None) -> list[float]:
    """The numbers that describe a text, FEATURES in order; those of a null text are those of an empty one."""
    data = (text or "").encode("utf-8", "surrogatepass")
    w = data.split()
    n, c = max(1, len(w)), np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    solid = max(1, len(data) - int(c[9:14].sum() + c[32]))
    letters = max(1, int(c[65:91].sum() + c[97:123].sum()))
    lines = [x for x in data.split(b"\n") if x.strip()]
    seen = Counter(w)
    top = max(seen.values(), default=0)
    return [
        float(np.log1p(len(w))), solid / n, c[65:91].sum() / letters, c[48:58].sum() / solid, sum(c[list(b"#*$%&<>~^_=+@\\")]) / solid, c[124] / n, c[33] / n,
        (c[46] + c[63] + c[33]) / n, len(seen) / n**0.8, sum(map(eq, w, w[1:])) / n, 1 - len(set(lines)) / max(1, len(lines)), float(np.log1p(n / max(1, len(lines)))), c[128:].sum() / solid, top / n,
    ]


@dataclass
class Gam:
    """edges: per feature its bin edges; tables: per feature its values; pairs: (i, j, values by joint bin)."""

    bias: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for rows of features."""
        total = np.full(len(x), self.bias)
        for k, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[k], x[:, k])]
        for i, j, table in self.pairs:
            total += table[np.searchsorted(self.pair_edges[i], x[:, i]), np.searchsorted(self.pair_edges[j], x[:, j])]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(col: np.ndarray, bins: int) -> np.ndarray:
    at = np.unique(np.quantile(col, np.linspace(0, 1, bins + 1)[1:-1]))
    return at[at < col.max()] if len(col) else at


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int) -> np.ndarray:
    """A regression tree over ordered bins: sums of gradients, hessians and counts per bin to a value per bin."""
    cuts = [(0, len(g))]
    G, H, N = (np.concatenate([[0], np.cumsum(x)]) for x in (g, h, n))
    value = lambda a, b: (G[b] - G[a]) ** 2 / (H[b] - H[a] + 1)
    while len(cuts) < leaves:
        best = (1e-6, None, None)
        for a, b in cuts:
            at = np.arange(a + 1, b)
            at = at[(N[at] - N[a] >= LEAST_LEAF) & (N[b] - N[at] >= LEAST_LEAF)]
            if len(at):
                gain = value(a, at) + value(at, b) - value(a, b)
                k = int(gain.argmax())
                best = max(best, (float(gain[k]), (a, b), int(at[k])), key=lambda x: x[0])
        if best[1] is None:
            break
        (a, b), m = best[1:]
        cuts.remove((a, b))
        cuts += [(a, m), (m, b)]
    out = np.zeros(len(g))
    for a, b in cuts:
        out[a:b] = (G[b] - G[a]) / (H[b] - H[a] + 1)
    return out


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """A model for features x and labels y (0 or 1); without both labels it is the smoothed share of label 1."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = Gam(bias=float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return model
    d = x.shape[1]
    model.edges = [_edges(x[:, k], BINS) for k in range(d)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = [np.searchsorted(e, x[:, k]) for k, e in enumerate(model.edges)]
    total = np.full(len(x), model.bias)

    def state() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for k in range(d):
            g, h = state()
            size = len(model.tables[k])
            step = RATE * _tree(np.bincount(bins[k], g, size), np.bincount(bins[k], h, size), np.bincount(bins[k], minlength=size), LEAVES)
            model.tables[k] += step
            total += step[bins[k]]
    model.pair_edges = [_edges(x[:, k], PAIR_BINS) for k in range(d)]
    coarse = [np.searchsorted(e, x[:, k]) for k, e in enumerate(model.pair_edges)]
    wide = [len(e) + 1 for e in model.pair_edges]
    g, h = state()

    def joint(i: int, j: int) -> np.ndarray:
        return coarse[i] * wide[j] + coarse[j]

    def gain(i: int, j: int) -> float:
        at, size = joint(i, j), wide[i] * wide[j]
        return float((np.bincount(at, g, size) ** 2 / (np.bincount(at, h, size) + 1)).sum())

    chosen = sorted(((i, j) for i in range(d) for j in range(i + 1, d)), key=lambda ij: (-gain(*ij), ij))[:PAIRS]
    tables = {ij: np.zeros((wide[ij[0]], wide[ij[1]])) for ij in chosen}
    for _ in range(PAIR_ROUNDS):
        for i, j in chosen:  # a tree of depth two: rows of the joint table are cut first, then each part's columns
            g, h = state()
            at, shape = joint(i, j), (wide[i], wide[j])
            G, H, N = (np.bincount(at, v, shape[0] * shape[1]).reshape(shape) for v in (g, h, np.ones(len(x))))
            rows = _tree(G.sum(1), H.sum(1), N.sum(1), 2)
            step = np.zeros(shape)
            for v in np.unique(rows):
                part = rows == v
                step[part] = _tree(G[part].sum(0), H[part].sum(0), N[part].sum(0), 2)
            tables[i, j] += RATE * step
            total += RATE * step[coarse[i], coarse[j]]
    model.pairs = [(i, j, tables[i, j]) for i, j in chosen]
    return model


def train(docs: DataFrame, labels: DataFrame, learn: Column, max_labels: int = MAX_LABELS) -> Gam:
    """Fit on the labelled rows of docs for which learn (over doc_id) holds.

    Null ids and labels are left out; of repeated labels of a document the largest counts, of repeated documents each row.
    """
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "quality").filter(learn)
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["doc_id"], "y": pdf["quality"].astype("int32"), "x": [features(t) for t in pdf["text"]]})

    got = rows.mapInPandas(describe, "id long, y int, x array<double>").orderBy(F.xxhash64("id"), "id").limit(2 * max_labels).toPandas()
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(FEATURES))
    order = np.lexsort([*x.T, got["id"].to_numpy()])  # the same model whatever order rows arrive in
    return fit(x[order], (got["y"].to_numpy(float) > 0).astype(float)[order])


def scorer(model: Gam):
    """A column function: text to the model's score."""

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([features(t) for t in text], float).reshape(len(text), len(FEATURES))))

    return score


def is_held_out() -> Column:
    return F.pmod(crc_of_id(), F.lit(FOLDS)) == HELD_OUT


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, held_out, score (0 to 1), predicted (1 from THRESHOLD on).

    Null and empty texts are scored like texts without words; repeated rows get equal scores; no labels, or only one
    kind, give every text the share of label 1; an empty table gives an empty result; texts are read whole, however long. Ids are integers. Of cuts
    that are equally good a tree takes the first. Other columns are ignored. labels.toxic, lang and source play no part.
    """
    score = scorer(train(docs, labels, ~is_held_out()))
    out = docs.select("doc_id", is_held_out().alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier accepts, unchanged."""
    score = scorer(train(docs, labels, ~is_held_out()))
    return docs.filter(score("text") >= THRESHOLD)
