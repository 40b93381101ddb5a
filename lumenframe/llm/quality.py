"""A generalised additive model with pairwise interactions for text quality.

Features are counted over whole texts. Each feature is cut into bins; boosting goes round the features
and gives each a tree of at most three leaves on its bins, each round adding a small step, so that a
feature ends up as one lookup table. Pairs whose residuals a 2 x 2 split explains best then get tables
over two binned features in the same way. A score is the sum of the tables' entries at a text's bins.

Labels are learnt from a sample of at most ``SAMPLE`` labelled rows, the ones with the smallest hash of
their id; only their feature values (some ``len(FEATURES)`` numbers a row) reach the driver. Scoring is a
map over all rows.

Defined results: null and empty texts have all features zero and get the score the model gives to those; a
text is counted whole, however long; a score of exactly one half is label 1, labels are sampled by a hash of the
id, then the id, and equal gains go to the first feature and cut;
repeated rows are scored alike; a label row that is null, repeated or without a document doesn't count;
without labels of both kinds the score is the share of label 1 (1 if there are no labels); an empty table
gives no rows; columns other than ``doc_id`` and ``text`` aren't inputs.
"""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import documents, per_batch, prepare

SAMPLE = 20_000
BINS, PAIR_BINS = 32, 8
ROUNDS, PAIR_ROUNDS, RATE, PAIRS = 150, 60, 0.15, 8

FEATURES = (
    "log_chars", "log_words", "mean_word", "long_word", "upper", "digit", "punctuation", "symbol", "odd_symbol", "space", "line_mean",
    "end_lines", "same_lines", "distinct_words", "top_word", "short_words", "bars", "exclaim", "upper_words", "marked_words", "entropy", "non_ascii", "repeat_pairs",
)

_CLASSES = np.zeros(256, np.intp)  # 1 upper, 2 lower, 3 digit, 4 full stop or comma, 5 other mark, 6 odd symbol, 7 space, 8 line feed, 9 beyond ASCII
for _k, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", ".,;:", "!?'\"()-/", "#$%&*+<=>@[]\\^_`{|}~", " \t\r\v\f", "\n"), 1):
    _CLASSES[list(_chars.encode())] = _k
_CLASSES[128:] = 9
_words = re.compile(r"\S+").findall


def features(text: str | None) -> list[float]:
    """The values of FEATURES for one text."""
    if not text:
        return [0.0] * len(FEATURES)
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    seen = np.bincount(data, minlength=256)
    of = np.bincount(_CLASSES, weights=seen, minlength=10)
    n = len(data)
    words = _words(text)
    count = len(words) or 1
    kinds: dict[str, int] = {}
    for w in words:
        kinds[w] = kinds.get(w, 0) + 1
    lines = [x for x in text.split("\n") if x.strip()]
    lengths = [len(w) for w in words] or [0]
    letters = of[1] + of[2] + of[9] or 1
    share = seen[seen > 0] / n
    pairs = set(zip(words, words[1:], strict=False))
    many = len(lines) or 1
    return [
        float(np.log1p(len(text))), float(np.log1p(len(words))), sum(lengths) / count, float(np.log1p(max(lengths))),
        of[1] / letters, of[3] / n, of[4] / n, of[5] / n, of[6] / n, (of[7] + of[8]) / n, float(np.log1p(sum(map(len, lines)) / many)),
        sum(x.rstrip()[-1] in ".!?" for x in lines) / many, 1 - len(set(lines)) / many, len(kinds) / count, max(kinds.values(), default=0) / count,
        sum(x < 3 for x in lengths) / count, float(seen[0x7C]) / count, float(seen[0x21]) / count, sum(w.isupper() for w in words) / count,
        sum(not w[-1].isalnum() and w[-1] not in ".,;:!?" for w in words) / count, float(-(share * np.log2(share)).sum()), of[9] / n, 1 - len(pairs) / max(1, len(words) - 1),
    ]


@dataclass
class Model:
    base: float
    cuts: list[list[float]]  # of each feature, ascending
    tables: list[list[float]]  # of each feature, one entry more than cuts
    pairs: list[tuple[int, int]]
    pair_cuts: list[list[float]]  # of each feature
    pair_tables: list[list[list[float]]]

    def dumps(self) -> str:
        return json.dumps(self.__dict__)

    @staticmethod
    def loads(text: str) -> Model:
        return Model(**json.loads(text))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of feature values."""
        total = np.full(len(x), self.base)
        for f, (cuts, values) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += np.asarray(values)[np.searchsorted(cuts, x[:, f], side="left")]
        coarse = [np.searchsorted(cuts, x[:, f], side="left") for f, cuts in enumerate(self.pair_cuts)]
        for (f, g), values in zip(self.pairs, self.pair_tables, strict=True):
            total += np.asarray(values)[coarse[f], coarse[g]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cuts(x: np.ndarray, bins: int) -> list[float]:
    """Cut points between distinct values, at about equal shares of rows."""
    values = np.unique(x)
    if len(values) <= 1:
        return []
    at = np.unique(np.searchsorted(values, np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])))
    at = at[at < len(values) - 1]
    return [float(v) for v in np.unique((values[at] + values[at + 1]) / 2)]


def _tree(gradient: np.ndarray, weight: np.ndarray, leaves: int = 3, least: float = 2.0) -> np.ndarray:
    """Values for bins in order: the best split by gain, then the best split of the two parts."""
    parts = [(0, len(gradient))]

    def best(a: int, b: int) -> tuple[float, int]:
        g, h = np.cumsum(gradient[a:b]), np.cumsum(weight[a:b])
        if b - a < 2:
            return 0.0, a
        left, right = h[:-1], h[-1] - h[:-1]
        gain = g[:-1] ** 2 / (left + 1) + (g[-1] - g[:-1]) ** 2 / (right + 1) - g[-1] ** 2 / (h[-1] + 1)
        gain[(left < least) | (right < least)] = 0
        k = int(np.argmax(gain))
        return float(gain[k]), a + k + 1

    while len(parts) < leaves:
        options = [(*best(a, b), (a, b)) for a, b in parts]
        gain, at, (a, b) = max(options)
        if gain <= 1e-9:
            break
        parts.remove((a, b))
        parts += [(a, at), (at, b)]
    out = np.zeros(len(gradient))
    for a, b in parts:
        out[a:b] = gradient[a:b].sum() / (weight[a:b].sum() + 1)
    return out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting of single tables, then of pair tables, on logistic loss. Deterministic."""
    features_n = x.shape[1]
    cuts = [_cuts(x[:, f], BINS) for f in range(features_n)]
    coarse_cuts = [_cuts(x[:, f], PAIR_BINS) for f in range(features_n)]
    share = float(np.mean(y)) if len(y) else 1.0
    tables = [np.zeros(len(c) + 1) for c in cuts]
    if not 0 < share < 1:
        base = 30.0 if share == 1 else -30.0
        return Model(base, cuts, [t.tolist() for t in tables], [], coarse_cuts, [])
    base = float(np.log(share / (1 - share)))
    bins = [np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)]
    total = np.full(len(y), base)
    for _ in range(ROUNDS):
        for f in range(features_n):
            p = 1 / (1 + np.exp(-total))
            k = len(tables[f])
            step = RATE * _tree(np.bincount(bins[f], y - p, k), np.bincount(bins[f], p * (1 - p), k))
            tables[f] += step
            total += step[bins[f]]
    coarse = [np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(coarse_cuts)]
    p = 1 / (1 + np.exp(-total))
    residual, weight = y - p, p * (1 - p)
    ranked = []
    for f in range(features_n):
        for g in range(f + 1, features_n):
            a, b = len(coarse_cuts[f]) + 1, len(coarse_cuts[g]) + 1
            cell = coarse[f] * b + coarse[g]
            gs, hs = np.bincount(cell, residual, a * b), np.bincount(cell, weight, a * b)
            ranked.append((-float((gs**2 / (hs + 1)).sum()), f, g))
    chosen = [(f, g) for _, f, g in sorted(ranked)[:PAIRS]]
    pair_tables = [np.zeros((len(coarse_cuts[f]) + 1, len(coarse_cuts[g]) + 1)) for f, g in chosen]
    for _ in range(PAIR_ROUNDS):
        for (f, g), values in zip(chosen, pair_tables, strict=True):
            p = 1 / (1 + np.exp(-total))
            cell = coarse[f] * values.shape[1] + coarse[g]
            gs = np.bincount(cell, y - p, values.size).reshape(values.shape)
            hs = np.bincount(cell, p * (1 - p), values.size).reshape(values.shape)
            step = RATE * _pair_tree(gs, hs)
            values += step
            total += step[coarse[f], coarse[g]]
    return Model(base, cuts, [t.tolist() for t in tables], chosen, coarse_cuts, [t.tolist() for t in pair_tables])


def _pair_tree(gradient: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Split the first feature once, then each half on the second, at the best cut of the first."""
    best, out = 0.0, np.zeros(gradient.shape)
    for at in range(1, gradient.shape[0]):
        halves = [(slice(0, at), gradient[:at].sum(0), weight[:at].sum(0)), (slice(at, None), gradient[at:].sum(0), weight[at:].sum(0))]
        values = [_tree(g, h, leaves=2) for _, g, h in halves]
        gain = sum(float((v * g).sum()) for v, (_, g, _) in zip(values, halves, strict=True))
        if gain > best:
            best, out = gain, np.zeros(gradient.shape)
            for v, (rows, _, _) in zip(values, halves, strict=True):
                out[rows] = v
    return out


def held_out(doc_id) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def _features_of(docs: DataFrame) -> DataFrame:
    def make():
        def step(batch: pa.RecordBatch):
            values = [features(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.list_(pa.float64()))], names=["doc_id", "x"])

        return step

    return documents(docs).mapInArrow(per_batch(make), "doc_id long, x array<double>")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from labelled rows that aren't held out; ``sample`` bounds how many."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
    known = known.where("low = high").where(~held_out("doc_id"))
    taken = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id", F.col("low").alias("y"))
    # at most ``sample`` rows, a few bytes each, sent to all tasks: the texts stay where they are
    rows = _features_of(docs.join(F.broadcast(taken), "doc_id", "left_semi")).join(F.broadcast(taken), "doc_id").groupBy("doc_id", "y").agg(F.min("x").alias("x")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    x = np.array([r["x"] for r in rows], dtype=float).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([r["y"] for r in rows], dtype=float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""
    said = model.dumps()

    def make():
        own = Model.loads(said)

        def step(batch: pa.RecordBatch):
            x = np.array([features(t.as_py()) for t in batch.column(1)]).reshape(batch.num_rows, len(FEATURES))
            ids = batch.column(0)
            held = pa.array([None if i is None else zlib.crc32(str(i).encode()) % 3 == 1 for i in ids.to_pylist()], pa.bool_())
            s = own.score(x)
            yield pa.RecordBatch.from_arrays([ids, held, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

        return step

    return documents(docs).mapInArrow(per_batch(make), "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    prepare(docs.sparkSession)
    return score(docs, train(docs, labels))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is at least ``threshold``. A map: nothing is joined."""
    prepare(docs.sparkSession)
    said = train(docs, labels).dumps()
    column = docs.columns.index("text")

    def make():
        own = Model.loads(said)

        def step(batch: pa.RecordBatch):
            x = np.array([features(t.as_py()) for t in batch.column(column)]).reshape(batch.num_rows, len(FEATURES))
            yield batch.filter(pa.array(own.score(x) >= threshold))

        return step

    return docs.mapInArrow(per_batch(make), docs.schema)
