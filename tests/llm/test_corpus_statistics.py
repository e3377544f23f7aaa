"""Operators 11 to 13 against brute force and on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter
from decimal import Decimal

import numpy as np
import pytest
from tests.llm.cases import PROSE, documents, no_rows

from tidelog.llm import collocations, merkle, positional_index
from tidelog.llm.collocations import CountAutomaton
from tidelog.llm.common import kept_table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# --- 11 ------------------------------------------------------------------------------------------

def best_phrases(rows, min_count, top, longest=3):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for m in range(1, longest + 1):
                f.update((lang, tuple(ws[i:i + m])) for i in range(len(ws) - m + 1))
    often = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= min_count}
    inside = Counter()
    for (lang, ws), v in often.items():
        for m in range(2, len(ws)):
            for i in range(len(ws) - m + 1):
                inside[lang, ws[i:i + m]] = max(inside[lang, ws[i:i + m]], v)
    out = []
    for lang in n:
        kept = []
        for (x, ws), a in often.items():
            if x == lang and 100 * inside[x, ws] < 50 * a:
                score, _, l, r = min((1000000 * a * a // (f[x, ws[:k]] * f[x, ws[k:]]), k, f[x, ws[:k]], f[x, ws[k:]]) for k in range(1, len(ws)))
                kept.append((-score, -a, " ".join(ws).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("shard,ranges,longest", [(1 << 25, 128, 3), (2000, 3, 3), (500, 1, 4)])
def test_collocations_by_brute_force(llm_spark, shard, ranges, longest):
    """Also where a shard holds a few texts only and the ranges are few."""
    r = random.Random(ranges)
    rows = [(x["lang"], x["text"]) for x in documents(llm_spark, 4).collect() if x["text"] is None or len(x["text"]) < 100_000]
    for _ in range(40):
        rows.append((r.choice(["en", None, "und", ""]), " ".join(r.choice(["Red", "red", "fish", "é", "B", "x\x1cy", "in. the", "of\tthe"]) for _ in range(60))))
    rows += [("en", "New York. new york\nnew york")] * 7
    df = llm_spark.createDataFrame(rows, "lang string, text string").repartition(4)
    got = collocations.collocations(df, min_count=4, top=50, max_words=longest, shard_bytes=shard, least_ranges=ranges)
    assert sorted(map(tuple, got.collect())) == best_phrases(rows, 4, 50, longest)


def test_collocations_awkward(llm_spark):
    for df in (documents(llm_spark, 6, True), no_rows(documents(llm_spark, 6))):
        got = collocations.collocations(df)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        rows = [(x["lang"], x["text"]) for x in df.collect()]
        assert sorted(map(tuple, got.collect())) == best_phrases(rows, 10, 2000)


def test_scores_past_64_bits(llm_spark):
    a, l, r = 9 * 10 ** 14, 10 ** 15 + 7, 10 ** 15 + 3
    df = llm_spark.createDataFrame([(a, l, r)], "a long, l long, r long")
    got = df.selectExpr("(cast(1000000 as decimal(7,0)) * (cast(a as decimal(18,0)) * cast(a as decimal(18,0)))) "
                        "div (cast(l as decimal(18,0)) * cast(r as decimal(18,0))) AS s").first()["s"]
    assert got == int(Decimal(10 ** 6) * a * a // (Decimal(l) * r)) == 10 ** 6 * a * a // (l * r)


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_automata(depth):
    """Paths and weights survive bytes, pieces and unions."""
    r = random.Random(depth)
    alphabet = sorted(r.choice("abcxyzé") .encode() * k for k in range(1, 9))
    alphabet = sorted(set(alphabet))

    def automaton():
        c = Counter(tuple(r.choice(alphabet) for _ in range(depth)) for _ in range(200))
        at = {w: i for i, w in enumerate(alphabet)}
        return c, CountAutomaton.from_paths(alphabet, [np.array([at[p[k]] for p in c]) for k in range(depth)], np.array(list(c.values())))

    def read(a):
        return Counter({tuple(a.words[w] for w in p): v for *p, v in zip(*(c.tolist() for c in a.paths()), a.weights.tolist())})

    (c1, a1), (c2, a2) = automaton(), automaton()
    assert read(a1) == c1 == read(CountAutomaton.from_bytes(a1.to_bytes()))
    assert read(a1.union(a2)) == c1 + c2
    key = np.arange(len(a1.weights)) % 5
    assert sum((read(CountAutomaton.from_bytes(p.to_bytes())) for _, p in a1.pieces(key)), Counter()) == c1


# --- 12 ------------------------------------------------------------------------------------------

def tree(leaves):
    """Levels of a tree, from the leaves to its root."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i:i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def proof(levels, pos):
    out = []
    for level in levels[:-1]:
        out += [("L" if pos & 1 else "R", level[pos ^ 1])] if (pos ^ 1) < len(level) else [("", "")]
        pos >>= 1
    return out


def encoded(*values):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


@pytest.mark.parametrize("bits", [1, 3, 9])
def test_manifest_by_brute_force(llm_spark, bits):
    """Also with blocks of two and eight leaves, so that roots are appended on many levels."""
    df = documents(llm_spark, 2, bits == 3)
    rows = [r.asDict() for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    for r in rows:
        r["leaf"] = H(encoded(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]))
    groups = {}
    for r in sorted(rows, key=lambda r: (r["lang"] is not None, (r["lang"] or "").encode(), r["doc_id"] is not None, r["doc_id"] or 0, r["leaf"])):
        groups.setdefault(r["lang"], []).append(r)
    below = {g: tree([r["leaf"] for r in rs]) for g, rs in groups.items()}
    above = tree([below[g][-1][0] for g in groups])
    want = []
    for i, (g, rs) in enumerate(groups.items()):
        for pos, r in enumerate(rs):
            path = proof(below[g], pos) + proof(above, i)
            h = r["leaf"]
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None:
                h = H(encoded(r["doc_id"], r["source"], r["lang"], r["n_chars"] + 1, r["text"]))
            for side, other in path:
                h = H(other, h) if side == "L" else H(h, other)
            root = above[-1][0]
            want.append((r["doc_id"], r["leaf"], below[g][-1][0], root, H("".join(x for _, x in path)), h, h == root))
    got = [tuple(r) for r in merkle.verified_manifest(df, block_bits=bits).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {r[-1] for r in got} == {True, False}


def test_long_ids_beside_nulls(llm_spark):
    df = llm_spark.createDataFrame([(None, "a", "en", 1, "x"), (2 ** 62 + 1, "a", "en", 1, "y")], "doc_id long, source string, lang string, n_chars long, text string")
    assert {r["doc_id"] for r in merkle.manifest(df.coalesce(1)).collect()} == {None, 2 ** 62 + 1}


def test_manifest_of_few_rows(llm_spark):
    df = documents(llm_spark, 2)
    assert merkle.verified_manifest(no_rows(df)).count() == 0
    one = df.filter("doc_id = 1")
    r = merkle.verified_manifest(one).first()
    assert r["leaf"] == r["subroot"] == r["root"] and r["proof_sha256"] == H() and r["verified"]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13])
def test_open_tree(n):
    leaves = [H(str(i)) for i in range(n)]
    t = merkle.OpenTree()
    for x in leaves:
        t.append(x)
    root, witnesses = t.close()
    levels = tree(leaves)
    assert root == levels[-1][0]
    assert [[w[i + 1:i + 65] if w[i] != "-" else "" for i in range(0, len(w), 65)] for w in witnesses] == [[x for _, x in proof(levels, i)] for i in range(n)]


# --- 13 ------------------------------------------------------------------------------------------

def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def hits(docs, items, size=10):
    out = []
    for doc_id, text in docs:
        ws = plain_words(text)
        covered, found = set(), set()
        at = {}
        for n in {min(size, len(plain_words(t))) for _, t in items} - {0}:
            at[n] = {}
            for i in range(len(ws) - n + 1):
                at[n].setdefault(tuple(ws[i:i + n]), []).append(i)
        for item, t in items:
            iw = plain_words(t)
            n = min(size, len(iw))
            for k in range(len(iw) - n + 1 if n else 0):
                for i in at[n].get(tuple(iw[k:k + n]), []):
                    covered.update(range(i, i + n))
                    found.add("" if item is None else str(item))
        out.append((doc_id, len(ws), len(covered), len(found), H(",".join(sorted(found))), bool(covered)))
    return sorted(out, key=str)


def cases(spark, seed, clashes=False):
    r = random.Random(seed)
    docs = [(x["doc_id"], x["text"]) for x in documents(spark, seed).collect()]
    pool = [t for _, t in docs if t and 60 < len(t) < 5000]
    items = [(1, None), (2, ""), (3, "fox"), (4, "the Quick, BROWN fox"), (None, PROSE), (5, PROSE), (5, "tea near river stones"), (6, "é-É x")]
    for k in range(10, 30):
        ws = r.choice(pool).split()
        i = r.randrange(max(1, len(ws) - 30))
        items.append((k, "; ".join(ws[i:i + r.randint(3, 30)]).upper()))
    docs.append((2 ** 62 + 1, "é É x. É"))
    docs.append((1001, PROSE.upper().replace(" ", ", ") + " " + PROSE))
    return spark.createDataFrame(docs, "doc_id long, text string"), docs, spark.createDataFrame(items, "item_id long, text string"), items


@pytest.mark.parametrize("seed,pass_words,rows", [(1, 1 << 20, 2000), (2, 40, 7), (3, 1 << 20, 1)])
def test_contamination_by_brute_force(llm_spark, seed, pass_words, rows):
    """Also with few candidates at a time, several passes and segments of single documents."""
    llm_spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        df, docs, items, plain = cases(llm_spark, seed)
        got = positional_index.contamination(df, items, pass_words=pass_words, candidates=5)
        assert sorted(map(tuple, got.collect()), key=str) == hits(docs, plain)
    finally:
        llm_spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def test_proximity_by_brute_force(llm_spark):
    docs = [(1, "alpha one two beta three gamma four delta"), (2, "alpha " + "x " * 25 + "beta gamma delta"), (3, "delta gamma beta alpha alpha"),
            (4, "beta gamma delta"), (5, "alpha" + " y" * 20 + " beta gamma delta")]
    items = [(7, "alpha beta, gamma delta alpha")]
    index = kept_table(positional_index.build_index(llm_spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)))
    found = positional_index.matches(index, llm_spark.createDataFrame(items, "item_id long, text string"), within=7)
    ids = positional_index.documents_of(index)
    near = {int(r["doc_id"]) for r in found.filter("kind = 'near'").join(ids, ["segment", "doc"]).collect()}
    assert near == {1, 3}
    assert found.filter("kind = 'phrase'").count() == 0
    with pytest.raises(ValueError):
        positional_index.matches(index, llm_spark.createDataFrame(items, "item_id long, text string"), within=positional_index.GAP)


def test_contamination_awkward(llm_spark):
    df, _, items, plain = cases(llm_spark, 5)
    clashing = documents(llm_spark, 5, True)
    got = positional_index.contamination(clashing, items)
    assert sorted(map(tuple, got.collect()), key=str) == hits([(r["doc_id"], r["text"]) for r in clashing.collect()], plain)
    assert positional_index.contamination(no_rows(df), items).count() == 0
    assert positional_index.contamination(df, no_rows(items)).filter("contaminated OR n_hit > 0 OR n_items > 0").count() == 0
