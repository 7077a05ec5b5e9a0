"""Operator 3: language identification by sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._spark import batches_of, fresh
from tessera.llm._words import mix

#: Hashed features, and the lengths of the character n-grams.
FEATURES, LENGTHS = 1 << 15, (1, 2, 3)
_BLOCK = 1 << 20
_SALT = (mix(np.arange(7, 7 + len(LENGTHS), dtype=np.uint64)) | np.uint64(1)).astype(np.uint32) | np.uint32(1)
UNDETERMINED = "und"


def ngram_counts(text: str) -> np.ndarray:
    """Counts of the hashed n-grams of the lower-cased text, a block at a time."""
    out = np.zeros(FEATURES, dtype=np.int64)
    low = text.lower()
    reach = max(LENGTHS) - 1
    for at in range(0, len(low), _BLOCK):
        c = np.frombuffer(low[max(at - reach, 0) : at + _BLOCK].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        held = min(at, reach)  # characters of the block before
        h = np.zeros(len(c), dtype=np.uint32)
        for k in range(max(LENGTHS)):
            h = (h[: len(c) - k] * np.uint32(0x9E3779B1) + c[k:] + np.uint32(1)) * _SALT[k]
            if k + 1 in LENGTHS:
                new = h[max(held - k, 0) :]
                out += np.bincount((new ^ (new >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(17), minlength=FEATURES)
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class LanguageModel:
    """Languages, idf (FEATURES), weights (FEATURES x languages, mostly 0), bias and temperature."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(counts)
        x = np.log1p(counts[at]) * self.idf[at]
        return at, x / max(float(np.sqrt((x * x).sum())), 1e-12)

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        at, x = self.vector(counts)
        z = (x @ self.weights[at] + self.bias) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


def document_frequencies(df: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """In how many of all texts of ``df`` each feature stands, and the number of texts; summed in the tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(FEATURES, dtype=np.int64), 0
        for batch in batches:
            for v in batch.column(0):
                total += ngram_counts(v.as_py()) > 0
                rows += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int64()), pa.array([rows, *total[at].tolist()], pa.int64())], ["feature", "n"])

    found = df.where(F.col(text).isNotNull()).select(text).mapInArrow(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()  # FEATURES + 1 rows at most
    out, rows = np.zeros(FEATURES, dtype=np.int64), 0
    for feature, n in found:
        if feature < 0:
            rows = n
        else:
            out[feature] = n
    return out, rows


def labelled_sample(df: DataFrame, rows: int, text: str, lang: str) -> list[tuple[str, bytes, bytes]]:
    """(language, features, counts) of about ``rows`` rows: of each language the same number of different texts, those with the least hashes; all if it has fewer."""
    place = F.pmod(F.xxhash64(F.lit("sample"), F.col(text)), F.lit(1 << 62))
    sizes = {r[0]: r[1] for r in df.groupBy(lang).agg(F.approx_count_distinct(place)).collect()}  # languages
    if not sizes:
        return []
    each = max(rows // len(sizes), 1)
    # Some more than needed are drawn by a threshold, copies merged, and so many kept.
    share = F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, 2.0 * (each + 20) / n))))
    drawn = df.select(F.col(lang).alias("lang"), F.col(text).alias("text"), place.alias("place")).where(F.col("place") < F.element_at(share, F.col("lang")) * float(1 << 62)).dropDuplicates(["lang", "place"])
    drawn = drawn.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("place"))).where(F.col("k") <= each).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = [], []
            for v in batch.column(1):
                c = ngram_counts(v.as_py())
                k = np.flatnonzero(c)
                at.append(k.astype(np.uint16).tobytes())
                n.append(c[k].astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.binary()), pa.array(n, pa.binary())], ["lang", "features", "counts"])

    return sorted((r[0], bytes(r[1]), bytes(r[2])) for r in drawn.mapInArrow(count, "lang string, features binary, counts binary").collect())


def follow_the_regularised_leader(rows: list[tuple[np.ndarray, np.ndarray, int]], features: int, classes: int, l1: float, l2: float, alpha: float, beta: float, passes: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of the elastic-net multinomial model, by FTRL-proximal steps in a fixed random order."""
    z, n = np.zeros((features + 1, classes)), np.zeros((features + 1, classes))

    def weights(zz: np.ndarray, nn: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(nn)) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(passes):
        for k in rng.permutation(len(rows)):
            at, x, y = rows[k]
            at, x = np.append(at, features), np.append(x, 1.0)
            w = weights(z[at], n[at])
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1.0
            g = x[:, None] * p
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
    w = weights(z, n)
    return w[:-1], w[-1]


def calibrated(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least negative log likelihood, by golden-section search on its logarithm."""

    def loss(t: float) -> float:
        s = logits / np.exp(t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(labels)), labels]).mean())

    lo, hi, r = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def train(
    df: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", fit_rows: int = 2_000, l1: float = 0.05, l2: float = 0.01, alpha: float = 0.5, beta: float = 1.0, passes: int = 3, seed: int = 7
) -> LanguageModel:
    """A model from rows with text and language; all of ``df`` may be learned from.

    Document frequencies are of all rows. The regression is fitted on a sample of ``fit_rows`` different texts at most (one of each language at
    least), evenly from all languages, four fifths for the weights and one for the temperature. Without rows there are no languages.
    """
    batches_of(1_000, df.sparkSession)
    rows = df.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    frequency, total = document_frequencies(rows, text)
    sample = labelled_sample(rows, fit_rows, text, lang)
    languages = sorted({r[0] for r in sample})
    model = LanguageModel(languages, np.log((1.0 + total) / (1.0 + frequency)) + 1.0, np.zeros((FEATURES, len(languages))), np.zeros(len(languages)))
    if not languages:
        return model
    found = []
    for name, at, n in sample:
        counts = np.zeros(FEATURES, dtype=np.int64)
        counts[np.frombuffer(at, np.uint16)] = np.frombuffer(n, np.uint32)
        found.append((*model.vector(counts), languages.index(name)))
    held = [k for k in range(len(found)) if k % 5 == 4]
    fitted = [r for k, r in enumerate(found) if k % 5 != 4]
    model.weights, model.bias = follow_the_regularised_leader(fitted, FEATURES, len(languages), l1, l2, alpha, beta, passes, seed)
    if held and len(languages) > 1:
        logits = np.stack([found[k][1] @ model.weights[found[k][0]] + model.bias for k in held])
        model.temperature = calibrated(logits, np.array([found[k][2] for k in held]))
    return model


def identified(df: DataFrame, model: LanguageModel, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """All rows of ``df`` with lang_pred and score.

    The model (bounded by features and languages) goes to all tasks. A null text, one without a letter, or a model without languages
    gives "und" with score 0. Repeated rows give repeated rows; a table without rows gives none; columns of ``df`` called lang_pred and score are replaced.
    """
    spark = df.sparkSession
    batches_of(1_000, spark)
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        m, out = sent.value, []
        for t in texts:
            if not m.languages or not has_letter(t):
                out.append((UNDETERMINED, 0.0))
                continue
            p = m.probabilities(ngram_counts(t))
            k = int(p.argmax())
            out.append((m.languages[k], float(p[k])))
        return pd.DataFrame(out, columns=["lang_pred", "score"])

    at = fresh(df, "_guess")
    guess = df.withColumn(at, predict(F.col(text)))
    return guess.select(*(c for c in df.columns if c not in ("lang_pred", "score")), F.col(f"{at}.lang_pred").alias("lang_pred"), F.col(f"{at}.score").alias("score"))


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold that is never learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify_languages(df: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", **options) -> DataFrame:
    """``df`` with held_out, lang_pred and score, from a model trained on the rows that aren't held out."""
    model = train(df.where(~held_out(doc_id)).select(doc_id, text, lang), text, lang, doc_id, **options)
    return identified(df.withColumn("held_out", held_out(doc_id)), model, text, doc_id)
