"""Quality classifier by nearest-neighbour voting (operator 8).

A text becomes a latent-semantic vector: relative frequencies of the trigrams
of character classes (square roots, weighted by inverse document frequency) and of
repeated words and lines, projected on the leading eigenvectors of their
covariance.  The labelled vectors (``SAMPLE`` of each class at most, on
average, chosen by a hash of the id) are broadcast; each block of texts is
compared with all of them by exact cosines, and the ``NEIGHBOURS`` nearest vote with
weights that grow with similarity.

Learns only from labelled rows outside the held-out fold; language, source and id never
reach a score.  The sample is bounded, so are the model and the broadcast.

Defined results: a null text, or one without words, scores 0.  With no labelled text, all
others score 0.5.  Null or repeated ids are scored as any row; labels other than 0
and 1 are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, spread, unused

#: Labelled rows of each class to learn from (expected number, chosen by hash).
SAMPLE = 2000
DIMS = 48
NEIGHBOURS = 15
SHARPNESS = 8.0
KEEP = 0.3

# Classes of bytes: 0 other, 1 lower case, 2 upper case, 3 digit, 4 blank, 5 line end, 6 full stop, 7 comma and
# the like, 8 exclamation and question marks, 9 symbols, 10 other marks.
N_CLASSES = 11
BYTE_CLASS = np.zeros(256, dtype=np.int32)
for _class, _chars in ((1, b"abcdefghijklmnopqrstuvwxyz"), (2, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (3, b"0123456789"), (4, b" \t"),
                       (5, b"\n\r"), (6, b"."), (7, b",;:"), (8, b"!?"), (9, b"#*$%&|<>"), (10, b"\"'()[]{}-_/+=@~^`\\")):
    BYTE_CLASS[np.frombuffer(_chars, dtype=np.uint8)] = _class
BYTE_CLASS[0x80:0xA0] = 2  # second bytes of capital and small letters in Latin-1
BYTE_CLASS[0xA0:0xC0] = 1
N_TRIGRAMS = N_CLASSES ** 3
N_TERMS = N_TRIGRAMS + 3


def terms(text: str | None) -> np.ndarray | None:
    """Square roots of relative frequencies; None for a text without words."""
    raw = text.encode() if text else b""
    ws = raw.split()
    if not ws:
        return None
    b = np.frombuffer(raw, dtype=np.uint8)
    c = BYTE_CLASS[b[b < 0xC0]]  # lead bytes add nothing
    out = np.zeros(N_TERMS, dtype=np.float32)
    if len(c) >= 3:
        out[:N_TRIGRAMS] = np.bincount((c[:-2] * N_CLASSES + c[1:-1]) * N_CLASSES + c[2:], minlength=N_TRIGRAMS)
        out[:N_TRIGRAMS] /= len(c) - 2
    lines = [x for x in raw.split(b"\n") if x.strip()]
    out[N_TRIGRAMS] = sum(map(bytes.__eq__, ws, ws[1:])) / len(ws)
    out[N_TRIGRAMS + 1] = 1 - len(set(ws)) / len(ws)
    out[N_TRIGRAMS + 2] = 1 - len(set(lines)) / len(lines)
    return np.sqrt(out)


class Votes:
    """Labelled latent vectors and the projection that made them."""

    def __init__(self, x: np.ndarray, labels: np.ndarray):
        seen = (x > 0).sum(axis=0)
        self.idf = np.log((1 + len(x)) / (1 + seen)).astype(np.float32) + 1
        w = x * self.idf
        self.mean = w.mean(axis=0)
        w = w - self.mean
        _, vectors = np.linalg.eigh(w.T @ w)
        self.axes = np.ascontiguousarray(vectors[:, ::-1][:, :DIMS], dtype=np.float32)
        self.labels = labels.astype(np.float32)
        self.points = self.latent(x)

    def latent(self, x: np.ndarray) -> np.ndarray:
        z = (x * self.idf - self.mean) @ self.axes
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def score(self, x: np.ndarray) -> np.ndarray:
        near = self.latent(x) @ self.points.T
        k = min(NEIGHBOURS, near.shape[1])
        top = np.argpartition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k:]
        sim = np.exp(SHARPNESS * np.take_along_axis(near, top, axis=1))
        return np.clip((sim * self.labels[top]).sum(axis=1) / sim.sum(axis=1), 0, 1)


def _terms_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        got = [terms(t) for t in f["text"]]
        ok = [g is not None for g in got]
        if any(ok):  # chosen texts may all be without words
            yield pd.DataFrame({"label": f["label"][ok], "terms": [g.tobytes() for g in got if g is not None]})


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Votes | None:
    """Fit on at most about ``sample`` labelled texts of each class outside the held-out fold."""
    usable = labels.filter(~held_out("doc_id", 5, 0) & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()) \
        .select("doc_id", F.col("quality").cast("int").alias("label"))
    counts = {r[0]: r[1] for r in usable.groupBy("label").count().collect()}
    if not counts:
        return None
    share = F.when(F.col("label") == 0, sample / max(1, counts.get(0, 0))).otherwise(sample / max(1, counts.get(1, 0)))
    chosen = usable.filter(spread("doc_id", seed=71) < share).dropDuplicates(["doc_id"])
    got = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("label", "text") \
        .mapInPandas(_terms_of, "label int, terms binary").toPandas()  # bounded by the sample
    if not len(got):
        return None
    got = got.sort_values(["label", "terms"])
    return Votes(np.stack([np.frombuffer(t, dtype=np.float32) for t in got["terms"]]), got["label"].to_numpy())


def with_score(docs: DataFrame, model: Votes | None, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the score of each text; other columns stay in the JVM."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        votes = shared.value
        for texts in batches:
            out = np.zeros(len(texts))
            for k in range(0, len(texts), 256):
                got = [terms(t) for t in texts.iloc[k:k + 256]]
                at = [i for i, g in enumerate(got) if g is not None]
                if at:
                    out[np.array(at) + k] = 0.5 if votes is None else votes.score(np.stack([got[i] for i in at]))
            yield pd.Series(out)

    return docs.withColumn(score_col, score(F.col(text_col)))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``."""
    scored = with_score(docs.select("doc_id", "text"), learn(docs, labels))
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score",
                         (F.col("score") >= KEEP).cast("int").alias("predicted"))


def of_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier predicts as quality 1."""
    score = unused(docs, "_score")
    return with_score(docs, learn(docs, labels), score_col=score).filter(F.col(score) >= KEEP).drop(score)
