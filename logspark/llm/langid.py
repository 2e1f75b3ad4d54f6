"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased and all but letters become single blanks; n-grams of 1 to 3 characters are hashed to 65,536
features, weighted log(1 + count) x inverse document frequency and scaled to length 1. The model is trained by
follow-the-regularised-leader (FTRL-proximal) with elastic-net penalties on a bounded sample of labelled rows; a tenth
of the sample is kept apart to calibrate a temperature.

Edge cases: a null text and one without a letter are ``und`` with score 0; texts are read whole; repeated rows are
predicted each; without labelled rows every text is ``und``; an empty table gives no rows; of the input only id, text
and lang are read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, map_batches

BITS = 16
UNDETERMINED = "und"
#: Labelled rows that the model is trained on, in expectation, in equal parts for each language that has enough.
MAX_LANGUAGES = 256
MAX_ROWS = 3000
EPOCHS = 3
#: FTRL-proximal: step, smoothing, and the elastic net's two penalties.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.02, 0.1


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted feature numbers of a text and how often each occurs; both empty if it has no letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[codes]
    if not letter.any():
        return np.empty(0, np.uint16), np.empty(0, np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of a run of other characters, the first stays as a blank
    c = np.concatenate([[32], np.where(letter, codes, 32)[keep], [32]]).astype(np.uint64)
    parts, h = [], np.zeros(len(c), np.uint64)
    for n in range(3):
        h = h[: len(c) - n] * np.uint64(0x100000001B3) + c[n:]
        parts.append(((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.uint16))
    found = np.sort(np.concatenate(parts), kind="stable")
    edges = np.flatnonzero(np.diff(found, prepend=np.uint16(found[0] ^ 1)))
    return found[edges], np.diff(edges, append=len(found))


def _unit(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    norm = np.sqrt(x @ x)
    return x / norm if norm else x


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    idf: np.ndarray = field(default_factory=lambda: np.ones(1 << BITS, np.float32))
    weights: np.ndarray = field(default_factory=lambda: np.zeros((1 << BITS, 0), np.float32))
    temperature: float = 1.0

    def predict(self, text: str | None) -> tuple[str, float]:
        idx, counts = ngrams(text)
        if not len(idx) or not self.languages:
            return UNDETERMINED, 0.0
        logits = _unit(counts, self.idf[idx]) @ self.weights[idx] / self.temperature
        p = np.exp(logits - logits.max())
        return self.languages[int(p.argmax())], float(p.max() / p.sum())


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], languages: list[str]) -> Model:
    """A model of (language, features, counts) rows, taken in the order given; each tenth row only calibrates."""
    model = Model(languages)
    learn, apart = [r for k, r in enumerate(rows) if k % 10], rows[::10]
    learn = learn or rows
    df = np.zeros(1 << BITS)
    for _, idx, _ in learn:
        df[idx] += 1
    model.idf = (np.log((1 + len(learn)) / (1 + df)) + 1).astype(np.float32)
    k = {x: i for i, x in enumerate(languages)}
    z, n = (np.zeros((1 << BITS, len(languages))) for _ in range(2))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)

    for _ in range(EPOCHS):
        for y, idx, counts in learn:
            x = _unit(counts, model.idf[idx])
            w = weights(z[idx], n[idx])
            logits = x @ w
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[k[y]] -= 1
            g = x[:, None] * p
            z[idx] += g - (np.sqrt(n[idx] + g * g) - np.sqrt(n[idx])) / ALPHA * w
            n[idx] += g * g
    model.weights = weights(z, n).astype(np.float32)
    if apart and learn is not rows:
        logits = np.array([_unit(c, model.idf[i]) @ model.weights[i] for _, i, c in apart])
        truth = np.array([k[y] for y, _, _ in apart])

        def loss(t: float) -> float:
            s = logits / t
            s = s - s.max(axis=1, keepdims=True)
            return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), truth]).mean())

        model.temperature = float(min(np.geomspace(0.05, 5, 60), key=loss))
    return model


def fit(docs: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """A model of docs (doc_id, text, lang); rows without a language are left out. Which rows it may learn from is the caller's choice.

    Features are made where the rows are; one task trains on the sample, whose size max_rows bounds.
    """
    labelled = docs.where("lang is not null").select("doc_id", "text", "lang")
    # One more than the bound tells that there are too many.
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    languages = sorted(counts)
    if not languages:
        return Model()
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"{len(languages)} languages to learn; the model's table is bounded for {MAX_LANGUAGES}")
    shares = F.create_map(*(F.lit(v) for x in languages for v in (x, float(min(1.0, max_rows / len(languages) / counts[x])))))
    # The same hash for every language, so the share of one language does not hang on another's.
    sample = labelled.where((F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < shares[F.col("lang")] * (1 << 30)) | (shares[F.col("lang")] >= 1.0))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in chunks(batches):
            made = [ngrams(t) for t in texts]
            keep = [bool(len(i)) for i, _ in made]
            cols = [
                lang.filter(pa.array(keep)),
                *(pa.array(
                    [m[j].astype(t).tobytes() for m, k in zip(made, keep, strict=True) if k], pa.binary(),
                ) for j, t in ((0, "<u2"), (1, "<u4"))),
            ]
            yield pa.record_batch(cols, names=["lang", "idx", "n"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(r["lang"], np.frombuffer(r["idx"], "<u2"), np.frombuffer(r["n"], "<u4")) for b in batches for r in b.to_pylist()]
        # An order that does not hang on partitions: by a hash of the features.
        rows.sort(key=_order)
        m = train(rows, languages)
        yield pa.record_batch(
            [pa.array([m.idf.tobytes()], pa.binary()), pa.array([m.weights.tobytes()], pa.binary()), pa.array([m.temperature])],
            names=["idf", "weights", "temperature"],
        )

    vectors = map_batches(sample.select("lang", "text"), extract, "lang string, idx binary, n binary")
    r = map_batches(vectors.repartition(1), learn, "idf binary, weights binary, temperature double").first()
    if r is None:
        return Model()
    return Model(languages, np.frombuffer(r["idf"], np.float32), np.frombuffer(r["weights"], np.float32).reshape(1 << BITS, -1), r["temperature"])


def _order(row: tuple[str, np.ndarray, np.ndarray]) -> int:
    return xxhash.xxh3_64_intdigest(row[1].tobytes() + row[2].tobytes())


def predict(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id_column, lang_pred, score for each row of docs."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in chunks(batches):
            found = [model.predict(t) for t in texts]
            yield pa.record_batch(
                [ids, pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                names=[id_column, "lang_pred", "score"],
            )

    return map_batches(docs.select(id_column, text_column), run, f"{id_column} {kind}, lang_pred string, score double")
