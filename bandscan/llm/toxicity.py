"""Toxicity by cumulative-link ordinal regression on sparse text features.

Labels only say toxic or not, so severity grades are made from the label and a
score that does not know it: labelled texts are dealt to folds by their ids,
and a regression on the other folds scores each fold. Grade 0 is not toxic;
toxic texts get 1, or 2 if that out-of-fold score is above the median of the
toxic ones. The model is P(grade <= k) = logistic(theta_k - w.x): one weight
vector w for all thresholds, theta increasing. x marks which words and word
beginnings a text holds (ASCII letters folded, everything that is no letter
apart), hashed to a table of fixed size. Out come the expected severity, the
probability of any toxicity, and the decision (probability of 0.5 or more).

It is fitted on a bounded sample of labelled documents, `fit_rows`, those with
the smallest hashes of their ids, one row each; only their feature lists reach
the driver, of one text at most `fit_features` features, those with the
smallest hashes (a text of 20,000 words has fewer). A feature gets a weight if its share among toxic texts is at least `lift` times
and `z_min` standard errors above that among the others, and `min_texts` toxic
texts hold it; the others weigh nothing, and as chosen features all speak for
toxicity, no weight is negative. What tasks receive is bounded by the
table's size. Scoring is one scan in numpy, without a shuffle.

Defined results: null and empty texts have no features and get the severity of
the thresholds alone; without labelled rows, or with only toxic or only other
ones, nothing is toxic and severity is 0; labels without a document or with
null in toxic are not used; of several labels of an id the highest counts, and
of several texts of an id the one with the smallest hash; repeated documents
each get a row; very long texts are scored whole; other columns are kept by
clean() and ignored by scored().
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandscan.llm.common import by_batch
from bandscan.llm.numtext import FOLDED, blocks, mix, prefix_sums, separators, span_hash, word_spans

FIT_ROWS, FIT_FEATURES, FOLDS, BITS = 4000, 20_000, 5, 20
#: Bytes of the word beginnings that are features beside the words themselves.
PREFIXES = (3, 4, 5, 6, 7)
_APART = separators("letters")


@dataclasses.dataclass
class Model:
    chosen: np.ndarray  # features that weigh something, sorted
    weights: np.ndarray  # theirs
    thresholds: np.ndarray  # one fewer than grades; empty if there is nothing to learn

    def chances(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k, a column each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -500, 500)))


def features(texts: pa.Array, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct features of each text, and the offsets of the texts; only: a mask of features to keep."""
    found, sizes = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
    for _, _, raw, at in blocks(texts):
        start, end, word_at = word_spans(raw, at, _APART)
        sums, text = prefix_sums(FOLDED[raw]), np.repeat(np.arange(len(at) - 1), np.diff(word_at))
        both = []
        for n in (0, *PREFIXES):
            use = slice(None) if n == 0 else np.flatnonzero(end - start > n)
            s, e, t = start[use], end[use], text[use]
            kind = np.uint64(n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            h = ((span_hash(sums, s, e if n == 0 else s + n) ^ kind) >> np.uint64(64 - BITS)).astype(np.int64)
            keep = slice(None) if only is None else only[h]
            both.append(np.unique((t[keep] << BITS) | h[keep]))
        both = np.unique(np.concatenate(both))
        found.append((both & ((1 << BITS) - 1)).astype(np.int32))
        sizes.append(np.bincount(both >> BITS, minlength=len(at) - 1))
    return np.concatenate(found), np.cumsum(np.concatenate(sizes))


def _chosen(toxic: np.ndarray, idx: np.ndarray, row: np.ndarray, z_min: float, lift: float, min_texts: int) -> np.ndarray:
    """The features that tell toxic texts from others."""
    n1, n0 = toxic.sum(), (~toxic).sum()
    c1 = np.bincount(idx[toxic[row]], minlength=1 << BITS)
    c0 = np.bincount(idx[~toxic[row]], minlength=1 << BITS)
    p = (c1 + c0) / (n1 + n0)
    z = (c1 / n1 - c0 / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))
    return np.flatnonzero((z >= z_min) & (c1 / n1 >= lift * c0 / n0) & (c1 >= min_texts))


def fitted(toxic: np.ndarray, idx: np.ndarray, at: np.ndarray, folds: int = FOLDS, **options) -> Model:
    """The model of texts (labels toxic, features idx from at[k] to at[k + 1]); grades come from scores of other folds' models."""
    if not toxic.any() or toxic.all():
        return Model(np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
    fold, outside = np.arange(len(toxic)) % folds, np.zeros(len(toxic))
    for k in range(folds):
        here = np.flatnonzero(fold != k)
        if not toxic[here].any() or toxic[here].all():
            continue
        parts = [idx[at[i] : at[i + 1]] for i in here]
        model = regression(toxic[here].astype(int), np.concatenate(parts), np.cumsum([0, *map(len, parts)]), **options)
        weigh = np.zeros(1 << BITS)
        weigh[model.chosen] = model.weights
        sums = np.concatenate([[0.0], np.cumsum(weigh[idx])])
        out = np.flatnonzero(fold == k)
        outside[out] = (sums[at[1:]] - sums[at[:-1]])[out]
    severe = toxic & (outside > np.median(outside[toxic]))
    return regression(toxic.astype(int) + severe, idx, at, **options)


def regression(grades: np.ndarray, idx: np.ndarray, at: np.ndarray, z_min: float = 4.0, lift: float = 5.0, min_texts: int = 4, l2: float = 0.02, rounds: int = 500) -> Model:
    """Cumulative-link regression on grades: penalised maximum likelihood by gradient steps with adaptive sizes."""
    toxic = grades > 0
    row = np.repeat(np.arange(len(toxic), dtype=np.int32), np.diff(at))
    chosen = _chosen(toxic, idx, row, z_min, lift, min_texts)
    place = np.full(1 << BITS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    use = place[idx] >= 0
    col, row = place[idx[use]], row[use]
    top = int(grades.max())
    above = np.stack([grades > k for k in range(top)], 1).astype(float)
    share = np.clip(above.mean(0), 1e-3, 1 - 1e-3)
    w, base, gap = np.zeros(len(chosen)), -np.log(share[0] / (1 - share[0])), np.full(top - 1, 1.0)

    def unpack(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return v[: len(w)], np.cumsum(np.concatenate([v[len(w) : len(w) + 1], np.exp(v[len(w) + 1 :])]))

    v = np.concatenate([w, [base], np.log(gap)])
    m, s = np.zeros_like(v), np.zeros_like(v)
    onehot = np.arange(top + 1)[None, :] == grades[:, None]
    for t in range(1, rounds + 1):
        w, theta = unpack(v)
        score = np.bincount(row, w[col], minlength=len(grades))
        over = 1 / (1 + np.exp(np.clip(theta[None, :] - score[:, None], -500, 500)))  # P(grade > k)
        edge = np.concatenate([np.ones((len(grades), 1)), over, np.zeros((len(grades), 1))], 1)
        mine = np.maximum((edge[:, :-1] - edge[:, 1:])[onehot], 1e-12)
        slope = np.concatenate([np.zeros((len(grades), 1)), over * (1 - over), np.zeros((len(grades), 1))], 1)
        by_score = -((slope[:, :-1] - slope[:, 1:])[onehot]) / mine
        by_theta = np.stack([(slope[:, k + 1] * (onehot[:, k + 1].astype(float) - onehot[:, k])) / mine for k in range(top)], 1).sum(0)
        tail = np.cumsum(by_theta[::-1])[::-1]
        grad = np.concatenate([np.bincount(col, by_score[row], minlength=len(w)) + l2 * w, tail[:1], tail[1:] * np.exp(v[len(w) + 1 :])]) / len(grades)
        m, s = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad * grad
        v -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
        v[: len(w)] = np.maximum(v[: len(w)], 0)
    w, theta = unpack(v)
    return Model(chosen, w, theta)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic", fit_rows: int = FIT_ROWS, fit_features: int = FIT_FEATURES) -> Model:
    """Fits on at most `fit_rows` labelled documents."""
    toxic = (F.col(toxic_col) != 0).cast("int")
    chosen = labels.where(F.col(toxic_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(toxic).alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(fit_rows)  # bounded, so it may be broadcast
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("id", "toxic", "text")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        idx, at = features(b.column(2))
        parts = [idx[x:y][np.argsort(mix(idx[x:y]), kind="stable")[:fit_features]] for x, y in zip(at, at[1:])]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([np.sort(x).tobytes() for x in parts], pa.binary())], names=["id", "toxic", "idx"])

    id_type = rows.schema["id"].dataType.simpleString()
    got = rows.mapInArrow(by_batch(run), f"id {id_type}, toxic int, idx binary")
    got = got.groupBy("id", "toxic").agg(F.min_by("idx", F.struct(F.xxhash64("idx"), "idx")).alias("idx")).toArrow().sort_by("id")  # at most fit_rows rows
    parts = [np.frombuffer(x, np.int32) for x in got["idx"].to_pylist()]
    at = np.cumsum([0, *map(len, parts)])
    return fitted(np.array(got["toxic"].to_pylist(), bool), np.concatenate([*parts, np.zeros(0, np.int32)]), at)


def _judged(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Expected severity and probability of any toxicity."""
    if not len(model.thresholds):
        return np.zeros(len(texts)), np.zeros(len(texts))
    only, weigh = np.zeros(1 << BITS, bool), np.zeros(1 << BITS)
    only[model.chosen], weigh[model.chosen] = True, model.weights
    idx, at = features(texts, only)
    sums = np.concatenate([[0.0], np.cumsum(weigh[idx])])
    over = model.chances(sums[at[1:]] - sums[at[:-1]])
    return over.sum(1), over[:, 0]


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", reject: float = 0.5) -> DataFrame:
    """(id, severity, p_toxic, toxic) for each document."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        severity, p = _judged(model, b.column(1))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(np.round(severity, 6)), pa.array(np.round(p, 6)), pa.array(p >= reject)], names=[id_col, "severity", "p_toxic", "toxic"])

    return docs.select(id_col, text_col).mapInArrow(by_batch(run), f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, severity double, p_toxic double, toxic boolean")


def clean(docs: DataFrame, model: Model, text_col: str = "text", reject: float = 0.5) -> DataFrame:
    """The documents, all columns, that are not rejected."""
    place = docs.columns.index(text_col)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return b.filter(pa.array(_judged(model, b.column(place))[1] < reject))

    return docs.mapInArrow(by_batch(run), docs.schema)
