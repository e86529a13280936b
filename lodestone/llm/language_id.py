"""Language ID with error-correcting output codes.

Each language has a binary codeword; each column of the code is a binary
linear classifier over hashed byte n-grams, fitted by ridge regression.  A
text's language is the codeword nearest to its classifiers' outputs, each
column weighted by how well it separated the fitting sample; a second language
almost as near marks the answer as ambiguous.

The classifiers are fitted on a sample: at most ``SAMPLE_PER_LANGUAGE``
labelled texts a language and about ``SAMPLE_ROWS`` in all (but one a
language), chosen by hashes of ids and texts.  The executors turn the chosen
texts into n-gram counts, so what the driver holds is bounded by the number of
rows whatever their length, and the equations by the number of buckets.
Predictions read whole texts and nothing else.

Defined results: a null text, or one without a letter, is ``und`` with score
0 and not ambiguous.  With no labelled text at all every text is ``und``; with
one language every text with a letter is that language.  Of languages equally
near the first by name is taken, and is ambiguous.  Null ids are never held
out.  Repeated rows and ids count as rows each, in the sample too; equal rows
come last there.  Texts of any length are counted whole, each in one task.
Other columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

SAMPLE_PER_LANGUAGE, SAMPLE_ROWS = 400, 1 << 14
#: Languages that can be learned; more of them would be refused.
MAX_LANGUAGES = 4096
BUCKETS = 1 << 12
RIDGE = 1e-3
#: Two languages this near in score are ambiguous.
MARGIN = 0.05
#: Below this score a text's language isn't told.
LEAST_SCORE = 0.3
UNKNOWN = "und"
_NOT_LETTERS = bytes(32 if not (chr(b).isalpha() and b < 128 or b >= 128) else ord(chr(b).lower()) if b < 128 else b for b in range(256))


def has_letter(text: str) -> bool:
    """Whether any character is a letter: fractions, raised and circled digits, Roman numerals and marks aren't."""
    return any(map(str.isalpha, text))


def histogram(text: str) -> np.ndarray:
    """Counts of the hashed byte 2- and 3-grams of a text's letters."""
    raw = np.frombuffer(b" " + text.encode().translate(_NOT_LETTERS) + b" ", np.uint8).astype(np.uint32)
    pairs = raw[:-1] * np.uint32(257) + raw[1:]
    triples = pairs[:-1] * np.uint32(263) + raw[2:]
    # A multiplicative hash whose upper bits select the bucket; pure white space adds nothing.
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    found = np.bincount((triples * np.uint32(2654435761)) >> shift, minlength=BUCKETS)
    found += np.bincount((pairs * np.uint32(2246822519)) >> shift, minlength=BUCKETS)
    return found


def features(texts: list[str]) -> np.ndarray:
    """Rows of square roots of counts, scaled to length one."""
    return scaled_counts(np.stack([histogram(t) for t in texts]))


def scaled_counts(counts: np.ndarray) -> np.ndarray:
    rows = np.sqrt(counts).astype(np.float32)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-6)


def codewords(classes: int) -> np.ndarray:
    """A code of +1 and -1: all splits of few classes, else a random code."""
    if classes <= 1:
        return np.ones((classes, 1))
    if classes <= 6:  # every way to split the classes in two, once
        columns = [[1 if i == 0 or not bits >> (i - 1) & 1 else -1 for i in range(classes)] for bits in range(1, 1 << (classes - 1))]
        return np.array(columns, dtype=float).T
    length = 15 * int(np.ceil(np.log2(classes)))
    rng = np.random.default_rng(classes)
    tried = [np.where(rng.random((classes, length)) < 0.5, 1.0, -1.0) for _ in range(50 if classes <= 512 else 4)]
    return max(tried, key=lambda c: np.min((length - c @ c.T) / 2 + length * np.eye(classes)))


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, score, ambiguous) of each text."""
        out: list[tuple[str, float, bool]] = [(UNKNOWN, 0.0, False)] * len(texts)
        at = [i for i, t in enumerate(texts) if t and self.languages and has_letter(t)]
        for low in range(0, len(at), 256):
            own = at[low : low + 256]
            bits = features([texts[i] for i in own]) @ self.weights + self.bias
            # Loss-weighted decoding: squared hinge against each codeword, columns by trust.
            loss = np.stack([(self.trust * np.maximum(0, 1 - word * bits) ** 2).sum(1) for word in self.code], axis=1) / self.trust.sum()
            near = np.exp(-4.0 * (loss - loss.min(1, keepdims=True)))
            shares = near / near.sum(1, keepdims=True)
            order = np.argsort(-shares, axis=1, kind="stable")
            for row, i in enumerate(own):
                first = float(shares[row, order[row, 0]])
                second = float(shares[row, order[row, 1]]) if len(self.languages) > 1 else 0.0
                out[i] = (self.languages[order[row, 0]], min(1.0, max(0.0, first)), first - second < MARGIN)
        return out


def fit(samples: list[tuple[str, str]]) -> Model:
    """A model of (text, language) pairs."""
    samples = [(t, lang) for t, lang in samples if t and lang is not None and has_letter(t)]
    return fit_features(features([t for t, _ in samples]) if samples else np.zeros((0, BUCKETS), np.float32), [lang for _, lang in samples])


def fit_features(rows: np.ndarray, of: list[str]) -> Model:
    """A model of texts' features and languages."""
    languages = tuple(sorted(set(of)))
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    code = codewords(len(languages))
    if not languages:
        return Model((), code, np.zeros((BUCKETS, 1), np.float32), np.zeros(1), np.ones(1))
    number = {lang: i for i, lang in enumerate(languages)}
    labels = np.array([number[lang] for lang in of])
    # Each language counts alike, however many samples it has.
    weight = 1.0 / np.bincount(labels)[labels] / len(languages)
    targets = code[labels]
    mean = weight @ rows
    bias = weight @ targets
    root = np.sqrt(weight)[:, None]
    wanted = (targets - bias) * root
    ridge = RIDGE * max(float(weight @ ((rows - mean) ** 2).sum(axis=1)) / len(rows), 1e-9)
    if len(rows) <= BUCKETS:  # as many equations as samples
        scaled = ((rows - mean) * root).astype(np.float64)
        weights = scaled.T @ np.linalg.solve(scaled @ scaled.T + ridge * np.eye(len(rows)), wanted)
    else:  # as many as buckets, however many samples
        gram, product = np.zeros((BUCKETS, BUCKETS)), np.zeros((BUCKETS, code.shape[1]))
        for low in range(0, len(rows), 1024):
            part = ((rows[low : low + 1024] - mean) * root[low : low + 1024]).astype(np.float64)
            gram += part.T @ part
            product += part.T @ wanted[low : low + 1024]
        gram[np.diag_indices(BUCKETS)] += ridge
        weights = np.linalg.solve(gram, product)
    bias = bias - mean @ weights
    outputs = rows @ weights.astype(np.float32) + bias
    wrong = weight @ (np.sign(outputs) != targets)
    trust = np.log((1 - wrong + 0.01) / (wrong + 0.01)).clip(0.05)
    return Model(languages, code, weights.astype(np.float32), bias, trust)


def training_sample(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, most: int = SAMPLE_ROWS) -> tuple[np.ndarray, list[str]]:
    """Features and languages of a bounded sample, chosen by hashes of ids and texts."""
    from pyspark.sql import Window

    labelled = docs.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("doc_id", "text").alias("_h"))
    sizes = labelled.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    each = max(1, min(per_language, most // max(1, len(sizes))))
    # Several times as many rows as are wanted pass the scan, however large the table is; the least hashes of them stay.
    bounds = [(r.lang, min(2**63 - 1, int(min(1.0, (3 * each + 100) / r["count"]) * 2**64) - 2**63)) for r in sizes]
    near = labelled.join(F.broadcast(docs.sparkSession.createDataFrame(bounds, "lang string, _most long")), "lang").where("_h <= _most")  # a row a language
    near = near.groupBy("lang", "_h").agg(F.first("text").alias("text"))
    first = near.withColumn("_rank", F.row_number().over(Window.partitionBy("lang").orderBy("_h"))).where(F.col("_rank") <= each)

    def work(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            rows = [(lang, h, histogram(x)) for lang, h, x in zip(batch["lang"], batch["_h"], batch["text"], strict=True) if has_letter(x)]
            used = [np.flatnonzero(found) for *_, found in rows]
            yield {
                "lang": [r[0] for r in rows], "h": [r[1] for r in rows],
                "bucket": [u.astype("<u2").tobytes() for u in used], "n": [r[2][u].astype("<u4").tobytes() for r, u in zip(rows, used, strict=True)],
            }

    found = map_batches(first.select("lang", "_h", "text"), work, "lang string, h long, bucket binary, n binary").collect()
    found.sort(key=lambda r: (r.lang, r.h))
    counts = np.zeros((len(found), BUCKETS), np.uint32)
    for row, r in zip(counts, found, strict=True):
        row[np.frombuffer(r.bucket, "<u2")] = np.frombuffer(r.n, "<u4")
    return (scaled_counts(counts) if found else np.zeros((0, BUCKETS), np.float32)), [r.lang for r in found]


def train(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """A model of the table's labelled rows (``doc_id``, ``text``, ``lang``)."""
    return fit_features(*training_sample(docs, per_language))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, lang_pred, score, ambiguous."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size: buckets by columns of the code

    def work(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            found = shared.value.predict(batch["text"])
            yield {"doc_id": batch["doc_id"], "lang_pred": [f[0] for f in found], "score": [f[1] for f in found], "ambiguous": [f[2] for f in found]}

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(rows, work, "doc_id long, lang_pred string, score double, ambiguous boolean")


def accepted(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: set[str] | None = None) -> DataFrame:
    """The rows whose language is told and is one of ``keep`` (None: any), with their own columns.

    Rejected are ``und``, ambiguous texts and those below ``LEAST_SCORE``. A
    model that learned no language rejects texts without a letter only.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def told(texts: pd.Series) -> pd.Series:
        rows = [t if isinstance(t, str) else None for t in texts]
        if not shared.value.languages:
            return pd.Series([bool(t and has_letter(t)) for t in rows], dtype=bool)
        return pd.Series([is_told(*found, keep) for found in shared.value.predict(rows)], dtype=bool)

    return docs.where(told(F.col(text_col)))


def is_told(lang: str, score: float, ambiguous: bool, keep: set[str] | None = None) -> bool:
    return lang != UNKNOWN and not ambiguous and score >= LEAST_SCORE and (keep is None or lang in keep)


def op6(docs: DataFrame) -> DataFrame:
    """The query: learn from three quarters of the ids, predict all."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = train(docs.where(~held_out))
    return predict(docs, model).withColumn("held_out", held_out).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
