"""Secret scans with a random forest against false positives (operator 3).

Generators with high recall propose candidates: values of assignments, known key
prefixes, and long opaque runs.  A random forest scores each by its length, character
classes and transitions (surprise under letter pairs of ordinary words), coverage by a
dictionary of ordinary words, its path (the parts of the identifier, hashed, and the operator) and the
neighbouring words.  It is trained from labelled findings; what scores under
``KEEP`` is a false positive.

``weak_label`` labels findings where none are given: provider formats and
values assigned to secret names are true, words and placeholders false, others open.  Each labelled finding is trained
on twice, once with all that its label may rest on blanked out (``HIDDEN``), so that the forest has to learn the
look of values and of their surroundings.  The forest is fitted on a bounded sample of the labelled findings; dictionary and
letter pairs come from the words of all documents; every candidate of every whole text is scored.

The features of the spans that end at one place are taken in one walk backwards from there, and ends don't multiply (runs, pieces
and opaque runs don't overlap their like), so the time is in proportion to the text, however many operators it has.

Defined results: a null or empty text has no findings; null or repeated ids are rows as
any other (each row's findings are listed); an empty table, or one
without both labels, gives findings with score 0.5, kept.  Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_table, spread

#: A word of the dictionary is in this share of the documents at least: no more than 1,000 times the mean number of
#: distinct words of a document are, at any size, and the same ones if all documents are doubled.
DICTIONARY_SHARE = 0.001
#: Findings to train on (expected number, chosen by hash).
SAMPLE = 8000
#: Findings of a batch of rows.
ROWS = 4096
KEEP = 0.5
TREES, DEPTH = 20, 6
LEAST = 6
BUCKETS = 8

# Well-known key formats and names.
PREFIXED = re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA|ghp_|gho_|ghs_|xox[abps]-|sk_live_|AIza|glpat-)[A-Za-z0-9_-]{10,}+")
ASSIGNED = re.compile(r"[=:][ \t]{0,4}+[\"']?(?=[^\s\"'])")
RUN = re.compile(r"[^\s\"']++")
PIECE = re.compile(r"[^\s\"'&;,]++")
NAME = re.compile(r"([A-Za-z][A-Za-z0-9_.-]{0,63})[\"']?[ \t]{0,4}$")
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+")
SECRET_NAME = re.compile(r"(?i)key|token|secret|passw|pwd|auth|cred")
PLACEHOLDER = re.compile(r"(?i)(?=(example|sample|dummy|changeme|placeholder|x{4}|0{8}|\*{3}|your[_-]))")
PATH_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Za-z][a-z]*|[0-9]+")
PROVIDER = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pos]_[A-Za-z0-9]{30,}|AIza[A-Za-z0-9_-]{30,}")

FEATURES = ("chars", "digits", "upper", "lower", "other", "distinct", "entropy", "changes", "surprise", "covered", "prefixed", "assigned",
            "named", "quoted", "name_chars", "placeholder", "equals", *[f"path{i}" for i in range(BUCKETS)], *[f"left{i}" for i in range(BUCKETS)],
            *[f"right{i}" for i in range(BUCKETS)])
#: What a weak label may rest on besides the value's characters.
HIDDEN = frozenset(("prefixed", "assigned", "named", "name_chars", "placeholder", "equals", *[f"path{i}" for i in range(BUCKETS)]))
FINDING = "id string, start long, end long, kind string, " + ", ".join(f"f_{x} double" for x in FEATURES) + ", weak int"


class Words:
    """Ordinary words of the corpus and how their letters follow each other."""

    def __init__(self, words: list[str]):
        self.words = frozenset(words)
        self.longest: dict[str, int] = {}   # by the first three letters
        for w in self.words:
            self.longest[w[:3]] = max(self.longest.get(w[:3], 0), len(w))
        pairs = Counter(p for w in words for p in zip(w, w[1:]))
        total = sum(pairs.values()) + 100
        self.unseen = -math.log(0.1 / total)
        self.surprise = {p: -math.log((n + 0.1) / total) for p, n in pairs.items()}

    def at(self, text: str, i: int, letters: int) -> int:
        """Length of the longest word of three letters or more that begins at ``i``, where so many letters stand, else 0."""
        most = self.longest.get(text[i:i + 3], 0) if letters > 2 else 0
        return next((n for n in range(min(most, letters), 2, -1) if text[i:i + n] in self.words), 0)


def candidates(text: str) -> list[tuple[int, int, str, str]]:
    """``(start, end, kind, name)``, overlapping ones too; the first generator that proposes a span names it.

    The value of each operator with a name before it is proposed up to a blank, quote, ``&``, ``;`` or ``,``, whatever
    value it stands in, and the first one of a run without blanks and quotes up to the run's end as well.
    """
    found: dict[tuple[int, int], tuple[str, str]] = {}
    for m in PREFIXED.finditer(text):
        found[m.span()] = ("prefixed", "")
    run = piece = 0
    for m in ASSIGNED.finditer(text):
        start, ends = m.end(), []
        if start >= run:  # only the first value of a run is also proposed up to the run's end
            run = RUN.match(text, start).end()
            ends.append(run)
        if start >= piece:
            piece = end.end() if (end := PIECE.match(text, start)) else start
        ends.append(piece)
        name = NAME.search(text, max(0, m.start() - 72), m.start())
        for e in ends if name else []:
            if e - start >= LEAST:
                found.setdefault((start, e), ("assigned", name[1]))
    taken = sorted(found)
    k = reach = 0
    for m in OPAQUE.finditer(text):
        while k < len(taken) and taken[k][0] < m.end():
            reach = max(reach, taken[k][1])
            k += 1
        if reach < m.end():  # a run that goes on past the spans it overlaps is proposed whole
            found.setdefault(m.span(), ("opaque", ""))
    return [(s, e, *found[s, e]) for s, e in sorted(found)]


def describe(text: str, spans: list[tuple[int, int, str, str]], words: Words) -> Iterator[tuple[tuple[int, int, str], list[float], int | None]]:
    """``(start, end, kind)``, features and weak label of each span, by their ends."""
    low = "".join(c if len(c) > 1 else c.lower() if len(c.lower()) == 1 else c for c in text)
    marks = [(m.start(), m.end(1)) for m in PLACEHOLDER.finditer(text)]
    by_end: dict[int, list[tuple[int, str, str]]] = {}
    for s, e, kind, name in spans:
        by_end.setdefault(e, []).append((s, kind, name))
    for end, starts in by_end.items():
        starts.sort(reverse=True)
        right = text[end:end + 48].split()[:1]
        chars: dict[str, int] = {}
        count = {"d": 0, "u": 0, "l": 0, "o": 0}
        clumped = surprise = 0.0
        changes = alpha = letters = 0
        covered = [0]                       # by the distance to the end
        m = bisect_left(marks, (end, 0))
        while m and marks[m - 1][1] > end:   # a mark is a few characters long
            m -= 1
        mark = marks[m - 1][0] if m else -1
        after, after_low, i = "", "", end
        for start, kind, name in starts:
            while i > start:
                i -= 1
                c, lower = text[i], low[i]
                k = "d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o"
                count[k] += 1
                was = chars.get(c, 0)
                chars[c] = was + 1
                clumped += (was + 1) * math.log2(was + 1) - (was * math.log2(was) if was else 0.0)
                if after:
                    changes += k != after
                    surprise += words.surprise.get((lower, after_low), words.unseen)
                after, after_low = k, lower
                letters = letters + 1 if c.isalpha() else 0
                alpha += c.isalpha()
                n = words.at(low, i, letters)
                covered.append(n + covered[-n] if n else covered[-1])
            n = end - start
            placeholder = mark >= start
            share = covered[-1] / n
            named = bool(SECRET_NAME.search(name))
            operator = text[max(0, start - 6):start].rstrip("\"' \t")[-1:] if kind == "assigned" else ""
            path = {xxhash.xxh3_64_intdigest(x.lower().encode()) % BUCKETS for x in PATH_PART.findall(name)}
            left = text[max(0, start - 48):start].split()[:-1 if name else None][-1:]
            near = [xxhash.xxh3_64_intdigest(x[0].lower().encode()) % BUCKETS if x else -1 for x in (left, right)]
            values = [n, count["d"] / n, count["u"] / n, count["l"] / n, count["o"] / n, len(chars) / n, math.log2(n) - clumped / n, changes / n,
                      surprise / max(n - 1, 1), share, kind == "prefixed", kind == "assigned", named, text[start - 1:start] in ("'", '"'), len(name),
                      placeholder, operator == "=", *[k in path for k in range(BUCKETS)], *[near[0] == k for k in range(BUCKETS)], *[near[1] == k for k in range(BUCKETS)]]
            word = alpha == n and (count["l"] == n or count["l"] == n - 1 and text[start].isupper())
            if placeholder or (not count["d"] and share > 0.5):
                weak = 0
            elif PROVIDER.fullmatch(text, start, end) or (kind == "assigned" and named and count["d"] > 0.1 * n and n >= 12):
                weak = 1
            else:
                weak = 0 if word else None
            yield (start, end, kind), values, weak


def dictionary(docs: DataFrame, text_col: str = "text", share: float = DICTIONARY_SHARE) -> Words:
    """The words of letters that are in ``share`` of all documents."""
    n = docs.count()
    if not n:
        return Words([])
    texts = docs.select(F.explode(F.array_distinct(F.split(F.lower(F.col(text_col)), r"[^\p{L}]+"))).alias("w"))
    often = texts.filter(F.length("w").between(3, 24)).groupBy("w").count().filter(F.col("count") >= share * n)
    return Words(sorted(r["w"] for r in often.collect()))


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All candidates with their features and weak labels."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionary(docs, text_col))

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["id", "start", "end", "kind", *[f"f_{x}" for x in FEATURES], "weak"]
        rows: list[tuple] = []
        for f in frames:
            for name, text in zip(f["id"], f["text"]):
                spans = candidates(text or "")
                for span, values, weak in describe(text, spans, shared.value) if spans else ():
                    rows.append((name, *span, *map(float, values), weak))
                    if len(rows) >= ROWS:
                        yield pd.DataFrame(rows, columns=names).astype({"weak": "Int32"})
                        rows = []
        if rows:
            yield pd.DataFrame(rows, columns=names).astype({"weak": "Int32"})

    rows = docs.select(F.col(id_col).cast("long").cast("string").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(scan, FINDING).withColumn("id", F.col("id").cast("long"))


def secret_scan(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start, end, kind, score, kept`` for each candidate.

    ``labelled(doc_id, start, end, label)`` are findings judged before; weak labels stand in without.
    """
    found = kept_table(findings(docs, id_col, text_col))
    if labelled is None:
        train = found.filter("weak is not null").withColumn("label", F.col("weak").cast("double"))
    else:
        known = labelled.select(F.col("doc_id").alias("id"), "start", "end", F.col("label").cast("double").alias("label"))
        train = found.join(known, ["id", "start", "end"])
    counts = {r[0]: r[1] for r in train.groupBy("label").count().collect()}
    cols = [f"f_{x}" for x in FEATURES]
    out = [F.col("id").alias(id_col), "start", "end", "kind", "score", (F.col("score") >= KEEP).alias("kept")]
    if len(counts) < 2:
        return found.withColumn("score", F.lit(0.5)).select(*out)
    share = F.when(F.col("label") == 1, SAMPLE / 2 / counts[1.0]).otherwise(SAMPLE / 2 / counts[0.0])
    ready = VectorAssembler(inputCols=cols, outputCol="features")
    chosen = train.filter(spread("id", "start", "end", seed=52) < share).select("label", *cols, F.explode(F.array(F.lit(False), F.lit(True))).alias("_hidden"))
    blanked = [F.when(F.col("_hidden"), 0.0).otherwise(F.col(c)).alias(c) if c[2:] in HIDDEN else F.col(c) for c in cols]
    chosen = kept_table(chosen.select("label", *blanked))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=7).fit(ready.transform(chosen))
    return forest.transform(ready.transform(found)).withColumn("score", vector_to_array("probability")[1]).select(*out)
