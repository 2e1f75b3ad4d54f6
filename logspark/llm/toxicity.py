"""Toxic passages: maximum-scoring segments of token log-odds, calibrated by extreme-value statistics.

A token's log-odds compare how many toxic and how many other labelled rows hold it, under a Dirichlet prior whose mean is what
the token's beginning (6, 5, then 4 characters, so that unseen endings of a known stem count) tells, and at last the rate of
all words. A passage is toxic words among others, which makes every word that tells nothing a little less likely in it: each
token scores its log-odds, positive or negative, less ``DRIFT``. A linear scan finds all maximal segments of a text.

lambda solves E exp(lambda s) = 1 over the scores s of tokens in rows that are not toxic, and K is the likeliest value for those
rows' best segments; a segment of score S in a text of n tokens is then expected by chance K n exp(-lambda S) times (Karlin
and Altschul). A text's evidence is the sum of its significant segments' surplus over chance, and a logistic curve maps it to
0..1. lambda, K and the curve are fitted to scores of rows by log-odds from which the row's own fold was left out.

Edge cases: null and empty texts have no segment and the lowest score; texts are scanned whole; repeated rows are scored
each, and learned from once; a label without an id, or whose id no document has, is not learned from; of labels that
disagree the toxic one counts; without labels of both classes every score is the same, below one half; an empty table gives no
rows; of the input only id and text are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, chunks, hash_share, map_batches, materialize, ngram_set, releases

#: Most labelled rows that the model is fitted to, in expectation: a hash of the id picks them.
MAX_LABELLED = 50_000
PREFIXES = (6, 5, 4)
#: Chosen by accuracy on left-out folds of the rows that may be learned from: rows that the prior weighs like, the cost of a token,
#: and the expected number by chance below which a segment is significant.
PRIOR, DRIFT, MAX_E = 2.0, 1.0, 0.05
#: A token whose log-odds differ less from its beginning's is taken for it, and one in fewer rows of both classes is not counted.
TOLERANCE, LEAST_TOXIC, LEAST_EXPECTED = 0.4, 2, 1.0
FOLDS = 4
#: Width of a cell of the histogram of token scores.
CELL = 0.05


def beginnings(word: str) -> list[str]:
    """The features that tell about a word where the word itself does not, the longest first."""
    return [f"{word[:n]}*" for n in PREFIXES if len(word) >= n]


def features(word: str) -> list[str]:
    return [word, *beginnings(word)]


@dataclass
class Model:
    lexicon: dict[str, float] = field(default_factory=dict)
    lam: float = 1.0
    k: float = 1e-3
    slope: float = 0.0
    intercept: float = -4.0


class _TokenScores(dict):
    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> float:
        value = next((self.lexicon[f] for f in features(word) if f in self.lexicon), 0.0) - DRIFT
        if len(self) > 120_000:
            self.clear()
        self[word] = value
        return value


def log_odds(counts: pd.DataFrame, exposure: float, prior: float = PRIOR) -> dict[str, float]:
    """Log-odds of features from the numbers of toxic and other rows that hold them; exposure: toxic rows' words for each word of others.

    Only features that tell something else than what stands for them otherwise are returned.
    """
    out: dict[str, float] = {}
    exact: dict[str, float] = {}
    depth = counts["feature"].map(lambda f: len(f) if f.endswith("*") else 99)
    for f, t, o in counts.iloc[np.argsort(depth.to_numpy(), kind="stable")][["feature", "toxic", "other"]].itertuples(index=False):
        above = [f"{f[:n]}*" for n in PREFIXES if n < len(f) - 1] if f.endswith("*") else beginnings(f)
        mean = next((exact[g] for g in above if g in exact), 0.0)
        exact[f] = math.log((t + prior * math.exp(mean)) / (o * exposure + prior))
        if abs(exact[f] - next((out[g] for g in above if g in out), 0.0)) >= TOLERANCE:
            out[f] = exact[f]
    return out


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, token after the last, score) by Ruzzo and Tompa's scan.

    Only tokens with positive scores are visited; what stands between them only lowers the running sum.
    """
    out: list[list] = []  # first, end, sum before, sum upto
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    for i in np.flatnonzero(scores > 0).tolist():
        item = [i, i + 1, float(sums[i]), float(sums[i + 1])]
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= item[2]:
                j -= 1
            if j < 0 or out[j][3] >= item[3]:
                out.append(item)
                break
            item = [out[j][0], item[1], out[j][2], item[3]]
            del out[j:]
    return [(a, b, s - p) for a, b, p, s in out]


def evidence(model: Model, n: int, found: list[tuple[int, int, float]]) -> tuple[float, list[float]]:
    """Sum of the significant segments' surplus over chance, and each segment's expected number."""
    base = math.log(max(model.k * n, 1e-300)) if n else 0.0
    surplus = [model.lam * s - base for _, _, s in found]
    return sum(x for x in surplus if x > -math.log(MAX_E)), [math.exp(min(50.0, -x)) for x in surplus]


def _training_rows(docs: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """fold, toxic and text of about max_labelled labelled rows; rows of one class with the same set of word 5-grams are taken once."""
    rated = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rated = rated.where(hash_share("doc_id", max_labelled / max(1, rated.count())))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in chunks(batches):
            yield pa.record_batch(
                [ids, pa.array([xxhash.xxh3_128_digest(ngram_set(t).tobytes()) for t in texts], pa.binary())], names=["doc_id", "key"],
            )

    # About max_labelled rows of 16 bytes are broadcast.
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keys = map_batches(docs.join(F.broadcast(rated), "doc_id").select("doc_id", "text"), digest, "doc_id long, key binary")
    kept = keys.join(F.broadcast(rated), "doc_id").groupBy("key", "toxic").agg(F.min("doc_id").alias("doc_id"))
    kept = materialize(kept.select("doc_id", "toxic", F.pmod(F.xxhash64("key"), F.lit(FOLDS)).cast("int").alias("fold")), "labelled")
    return docs.join(F.broadcast(kept), "doc_id").select((F.col("toxic") * FOLDS + F.col("fold")).alias("group"), "text")


def _counts(train: DataFrame) -> pd.DataFrame:
    """feature and n0.. (rows that hold it by group: fold, and fold + FOLDS if toxic); of feature '' the words of all rows."""
    groups = range(2 * FOLDS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, texts in chunks(batches, 4_000_000):
            out = [Counter() for _ in groups]
            for g, t in zip(group.to_pylist(), texts, strict=True):
                words = set(WORD.findall((t or "").lower()))
                out[g].update({f for w in words for f in features(w)})
                out[g][""] += len(words)
            names = list(set().union(*out))
            yield pa.record_batch(
                [pa.array(names, pa.string()), *(pa.array([c[f] for f in names], pa.int64()) for c in out)],
                names=["feature", *(f"n{g}" for g in groups)],
            )

    columns = [f"n{g}" for g in groups]
    counts = map_batches(
        train, count, "feature string, " + ", ".join(f"{c} long" for c in columns),
    ).groupBy("feature").agg(*(F.sum(c).alias(c) for c in columns))
    counts = materialize(counts, "counts")
    total = counts.where("feature = ''").toPandas()
    other, toxic = ("+".join(columns[:FOLDS]), "+".join(columns[FOLDS:]))
    share = total[columns[FOLDS:]].to_numpy().sum() / max(1, total[columns[:FOLDS]].to_numpy().sum())
    # A rare word tells nothing under the prior, nor does one that both classes hold as often; the driver sees the others.
    tells = f"abs(ln(({toxic} + {PRIOR}) / (({other}) * {float(share)} + {PRIOR}))) >= {TOLERANCE}"
    return pd.concat([
        total, counts.where(f"feature <> '' and ({toxic} >= {LEAST_TOXIC} or ({other}) * {float(share)} >= {LEAST_EXPECTED}) and {tells}").toPandas(),
    ])


def lexicon_without(counts: pd.DataFrame, fold: int | None = None) -> dict[str, float]:
    """log_odds by the rows of all folds but one; empty without rows of both classes."""
    folds = [f for f in range(FOLDS) if f != fold]
    sums = pd.DataFrame({
        "feature": counts["feature"], "toxic": counts[[f"n{FOLDS + f}" for f in folds]].sum(axis=1),
        "other": counts[[f"n{f}" for f in folds]].sum(axis=1),
    })
    words = sums[sums["feature"] == ""][["toxic", "other"]].sum()
    if not words["toxic"] or not words["other"]:
        return {}
    return log_odds(sums[sums["feature"] != ""], words["toxic"] / words["other"])


def scan_row(score: dict[str, float], text: str | None) -> tuple[int, list[float], np.ndarray]:
    """Tokens, scores of the segments and scores of the tokens of a text."""
    words = WORD.findall((text or "").lower())
    s = np.fromiter(map(score.__getitem__, words), float, len(words))
    return len(words), [x for _, _, x in segments(s)], s


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """A model of labels (doc_id, toxic) on docs (doc_id, text). The rows that it may learn from are the caller's choice."""
    train = _training_rows(docs, labels, max_labelled)
    counts = _counts(train)
    model = Model(lexicon_without(counts))
    if not model.lexicon:
        return model
    left_out = [lexicon_without(counts, f) for f in range(FOLDS)]
    del counts

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = [_TokenScores(x) for x in left_out]
        for group, texts in chunks(batches):
            n, best, found, cells = [], [], [], []
            for g, t in zip(group.to_pylist(), texts, strict=True):
                length, segment_scores, s = scan_row(scores[g % FOLDS], t)
                n.append(length)
                best.append(max(segment_scores, default=0.0))
                found.append(segment_scores)
                cells.append(list(Counter(np.rint(s / CELL).astype(int).tolist()).items()) if g < FOLDS else [])
            pair = pa.list_(pa.struct([("cell", pa.int32()), ("n", pa.int64())]))
            yield pa.record_batch(
                [
                    pa.array([g >= FOLDS for g in group.to_pylist()]), pa.array(n, pa.int64()), pa.array(best, pa.float64()),
                    pa.array(found, pa.list_(pa.float64())), pa.array([[{"cell": c, "n": k} for c, k in x] for x in cells], pair),
                ],
                names=["toxic", "n", "best", "found", "cells"],
            )

    rows = materialize(
        map_batches(train, scan, "toxic boolean, n long, best double, found array<double>, cells array<struct<cell:int,n:long>>"), "scanned",
    )
    cells = rows.select(F.explode("cells").alias("c")).groupBy("c.cell").agg(F.sum("c.n").alias("n")).toPandas()
    model.lam = karlin_lambda(cells["cell"].to_numpy(float) * CELL, cells["n"].to_numpy(float), max(model.lexicon.values()) - DRIFT)
    k = rows.where("not toxic").agg((F.count(F.lit(1)) / F.sum(F.col("n") * F.exp(-model.lam * F.col("best")))).alias("k")).first()["k"]
    model.k = k or model.k
    base = F.log(F.greatest(F.lit(1e-300), model.k * F.col("n")))
    surplus = F.filter(F.transform("found", lambda s: model.lam * s - base), lambda x: x > -math.log(MAX_E))
    points = rows.select(F.log1p(F.aggregate(surplus, F.lit(0.0), lambda a, x: a + x)).alias("x"), "toxic").toPandas()
    model.slope, model.intercept = _logistic(points["x"].to_numpy(float), points["toxic"].to_numpy(float))
    return model


def karlin_lambda(scores: np.ndarray, counts: np.ndarray, top: float) -> float:
    """The positive root of E exp(lambda s) = 1 over scores of negative mean; if the mean is not, the smallest lambda considered.
    If no score is positive, one token of the score top stands for what was not seen."""
    if len(scores) and scores.max() <= 0:
        scores, counts = np.append(scores, top), np.append(counts, 1.0)
    if not len(scores) or scores.max() <= 0 or (scores * counts).sum() >= 0:
        return 0.1
    share = np.log(counts / counts.sum())
    f = lambda x: np.logaddexp.reduce(share + x * scores)
    lo, hi = 0.0, 1.0
    while f(hi) < 0:
        lo, hi = hi, hi * 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return max(0.1, hi)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> tuple[float, float]:
    """Slope and intercept of a one-dimensional logistic regression, by damped Newton steps."""
    a, b = 0.0, math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        g = np.array([((p - y) * x).sum() + ridge * a, (p - y).sum() + ridge * b])
        w = p * (1 - p)
        h = np.array([[(w * x * x).sum() + ridge, (w * x).sum()], [(w * x).sum(), w.sum() + ridge]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


PASSAGE = "array<struct<start:int,end:int,score:double,expected:double>>"
_scorers: dict[int, tuple[Model, _TokenScores]] = {}
releases[__name__] = _scorers.clear


def original_places(text: str, lower: str) -> np.ndarray:
    """For each character of the lower-cased text its place in the text: a few letters have a longer lower case."""
    if len(lower) == len(text):
        return np.arange(len(text))
    return np.repeat(np.arange(len(text)), [len(c.lower()) for c in text])


def score_texts(texts: list[str | None], model: Model) -> Iterator[tuple[float, float, list[dict]]]:
    """For each text its score, its evidence and its significant passages (offsets into the text)."""
    if id(model) not in _scorers:
        _scorers.clear()
        _scorers[id(model)] = (model, _TokenScores(model.lexicon))
    scores = _scorers[id(model)][1]
    for t in texts:
        lower = (t or "").lower()
        words = WORD.findall(lower)
        found = segments(np.fromiter(map(scores.__getitem__, words), float, len(words)))
        total, expected = evidence(model, len(words), found)
        passages = []
        if any(e < MAX_E for e in expected):
            spans, at = [m.span() for m in WORD.finditer(lower)], original_places(t, lower)
            passages = [{
                "start": int(at[spans[a][0]]), "end": int(at[spans[b - 1][1] - 1]) + 1, "score": s, "expected": e,
            } for (a, b, s), e in zip(found, expected, strict=True) if e < MAX_E]
        yield 1 / (1 + math.exp(-max(-40.0, min(40.0, model.slope * math.log1p(total) + model.intercept)))), total, passages


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id_column, score, predicted, evidence and passages (significant segments with character offsets) for each row of docs."""
    kind = docs.schema[id_column].dataType.simpleString()
    passage = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in chunks(batches):
            value, weight, found = zip(*score_texts(texts, model), strict=True)
            yield pa.record_batch(
                [
                    ids, pa.array(value, pa.float64()), pa.array([int(v >= 0.5) for v in value], pa.int32()), pa.array(weight, pa.float64()),
                    pa.array(found, passage),
                ],
                names=[id_column, "score", "predicted", "evidence", "passages"],
            )

    return map_batches(
        docs.select(id_column, text_column), run, f"{id_column} {kind}, score double, predicted int, evidence double, passages {PASSAGE}",
    )
