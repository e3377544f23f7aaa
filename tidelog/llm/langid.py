"""Language identification by hyperdimensional profiles (operator 9).

Each letter has a random vector of +1 and -1 that follows from its code point.  A trigram's
vector binds its letters' vectors, permuted by place; a text's vector bundles
(adds up) those of its trigrams, over the whole text in lower case, with runs of
other characters as one blank; a language's prototype bundles the unit vectors of its
texts.  The prediction is the prototype with the largest cosine.

Learns only from texts with a language outside the held-out fold, of which a bounded
sample is taken (``SAMPLE`` a language on average, by a hash of the id); sums are
integers, so reruns agree.  Language, source and id never reach a prediction.

Defined results: ``und`` with score 0 for a null text, one without letters, or
when there is nothing to learn from; ties go to the first language in order; null or
repeated ids are rows as any other; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, spread

DIMS = 1024
SAMPLE = 1000
SCALE = 1_000_000
UNKNOWN = "und"
BLANK = 32
_CODE = np.uint64(21)
_LOW = np.uint64((1 << 21) - 1)
#: Trigrams whose vectors a task keeps.
KEPT = 16_384


@lru_cache(maxsize=8192)
def letter(code: int) -> np.ndarray:
    return np.random.default_rng([83, code]).integers(0, 2, DIMS, dtype=np.int8) * np.int8(2) - np.int8(1)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the letter trigrams of a whole text."""
    cps = np.frombuffer((text or "").lower().encode("utf-32-le"), dtype=np.uint32)
    is_letter = _letters()[cps]
    if not is_letter.any():
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    first_blank = ~is_letter & np.concatenate([[False], is_letter[:-1]])
    c = np.where(is_letter, cps, BLANK)[is_letter | first_blank].astype(np.uint64)
    c = np.concatenate([[np.uint64(BLANK)], c, [] if c[-1] == BLANK else [np.uint64(BLANK)]]).astype(np.uint64)
    return np.unique((c[:-2] << _CODE << _CODE) | (c[1:-1] << _CODE) | c[2:], return_counts=True)


class Bundles:
    """Vectors of texts; those of trigrams are kept up to a bound."""

    def __init__(self):
        self.place: dict[int, int] = {}
        self.rows = np.zeros((KEPT, DIMS), dtype=np.float32)

    @staticmethod
    def bound(code: int) -> np.ndarray:
        a, b, c = code >> 42, (code >> 21) & int(_LOW), code & int(_LOW)
        return np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c)

    def unit(self, text: str | None) -> np.ndarray | None:
        codes, n = trigrams(text)
        if not len(codes):
            return None
        total = np.zeros(DIMS, dtype=np.float64)
        for k in range(0, len(codes), KEPT // 4):
            part = codes[k:k + KEPT // 4].tolist()
            if len(self.place) + len(part) > KEPT:
                self.place.clear()
            for code in part:
                if code not in self.place:
                    self.rows[len(self.place)] = self.bound(code)
                    self.place[code] = len(self.place)
            total += n[k:k + KEPT // 4].astype(np.float32) @ self.rows[[self.place[c] for c in part]]
        length = np.linalg.norm(total)
        return total / length if length > 0 else None


def learn(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes, as unit vectors."""
    usable = docs.filter(~held_out("doc_id", 4, 2) & F.col("lang").isNotNull())
    counts = usable.groupBy("lang").agg(F.count("*").alias("_n"))
    chosen = usable.select("doc_id", "lang", "text").join(F.broadcast(counts), "lang").filter(spread("doc_id", seed=61) < sample / F.col("_n"))

    def summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bundles = Bundles()
        sums: dict[str, np.ndarray] = {}
        for f in frames:
            for lang, text in zip(f["lang"], f["text"]):
                v = bundles.unit(text)
                if v is not None:
                    sums[lang] = sums.get(lang, 0) + np.rint(v * SCALE).astype(np.int64)
        if sums:  # a partition may have no chosen text
            yield pd.DataFrame({"lang": list(sums), "v": [s.tolist() for s in sums.values()]})

    rows = chosen.select("lang", "text").mapInPandas(summed, "lang string, v array<long>") \
        .select("lang", F.posexplode("v").alias("place", "x")).groupBy("lang", "place").agg(F.sum("x").alias("x")).toPandas()  # languages x DIMS
    langs = sorted(rows["lang"].unique())
    out = np.zeros((len(langs), DIMS))
    out[[langs.index(x) for x in rows["lang"]], rows["place"].to_numpy(dtype=int)] = rows["x"].to_numpy(dtype=float)
    return langs, out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def language(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs))

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        langs, prototypes = shared.value
        bundles = Bundles()
        for texts in batches:
            names, scores = [], []
            for t in texts:
                v = bundles.unit(t) if langs else None
                near = prototypes @ v if v is not None else None
                k = int(np.argmax(near)) if v is not None else 0
                names.append(langs[k] if v is not None else UNKNOWN)
                scores.append(float(np.clip(near[k], 0, 1)) if v is not None else 0.0)
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return docs.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), predict(F.col("text")).alias("p")) \
        .select("doc_id", "held_out", "p.lang_pred", "p.score")
