import random

import numpy as np
import pytest

from tests.llm.cases import documents, no_rows
from tidelog.llm.common import words
from tidelog.llm.embedding_dedup import TABLES, embedding_dedup, same_hash, tables_for
from tidelog.llm.linking import components
from tidelog.llm.ngram_join import bands_for, ngram_join, one_of_each_class


def by_hand(n, linked):
    low = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in linked[i]:
                m = min(low[i], low[j])
                changed |= low[i] != m or low[j] != m
                low[i] = low[j] = m
    return low


def test_components(llm_spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    got = {x["id"]: x["component"] for x in components(llm_spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {i: set() for i in range(1100)}
    for a, b in edges:
        linked[a].add(b)
        linked[b].add(a)
    want = by_hand(1100, linked)
    assert got == {i: want[i] for i in range(1100) if linked[i] - {i}}


def test_no_edges(llm_spark):
    assert components(llm_spark.createDataFrame([], "a long, b long")).count() == 0


def test_bands_reach_the_recall():
    b = bands_for(0.8, 6, 0.9999)
    assert 1 - (1 - 0.8 ** 6) ** b >= 0.9999 > 1 - (1 - 0.8 ** 6) ** (b - 1)
    assert tables_for(0.374, 2.244, 16, 0.999) in range(TABLES - 2, TABLES + 3)
    assert same_hash(0.1, 1) > same_hash(1.4, 1)


def grams(t):
    ws = words(t)
    return {tuple(ws)} if 0 < len(ws) < 5 else {tuple(ws[i:i + 5]) for i in range(len(ws) - 4)}


@pytest.mark.parametrize("clashes", [False, True])
def test_ngram_join_by_brute_force(llm_spark, clashes):
    df = documents(llm_spark, 2, clashes)
    rows = [(r["doc_id"], grams(r["text"])) for r in df.collect()]
    n = len(rows)
    linked = [set() for _ in range(n)]
    for i in range(n):
        for j in range(n):
            (a, x), (b, y) = rows[i], rows[j]
            if i != j and a is not None and b is not None and x and y and 5 * len(x & y) >= 4 * len(x | y):
                linked[i].add(j)
    want = []
    for i, (a, x) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            todo += linked[k := todo.pop()] - seen
            seen |= linked[k]
        cls = min(rows[k][0] for k in seen) if a is not None else None
        want.append((a, cls, len(linked[i]), len(x), a is None or a == cls))
    got = [(r["doc_id"], r["class_id"], r["n_links"], r["n_shingles"], r["kept"]) for r in ngram_join(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = one_of_each_class(df)
    assert kept.columns == df.columns
    named = [r["doc_id"] for r in kept.collect() if r["doc_id"] is not None]
    assert sorted(named) == sorted({a for a, c, *_ in want if a is not None and a == c})
    assert kept.filter("doc_id is null").count() == df.filter("doc_id is null").count()


def test_rows_that_share_an_id_are_judged_by_their_text(llm_spark):
    """Nothing goes by its id alone: B is the only row with its text, though its id is that of A."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    near_b = b.replace("b7 ", "x ")
    rows = [(1, a, "s"), (1, b, "s"), (2, a, "s"), (0, near_b, "s"), (3, c, "s"), (3, c, "t"), (3, None, "s"), (3, "", "s"), (4, c + " end", "s"), (None, c, "s")]
    got = one_of_each_class(llm_spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted([(1, a), (0, near_b), (3, c), (3, None), (None, c)], key=str) \
        or sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted([(1, a), (0, near_b), (3, c), (3, ""), (None, c)], key=str)
    rows = [(1, a), (1, b), (2, a)]
    got = one_of_each_class(llm_spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == [(1, a), (1, b)]


def test_many_near_copies_in_blocks(llm_spark, monkeypatch):
    import tidelog.llm.ngram_join as m
    monkeypatch.setattr(m, "BLOCK", 4000)  # about ten texts in a block
    r = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    docs = []
    for i in range(60):
        ws = list(base)
        ws[r.randrange(150)] = f"x{i}"
        docs.append((i, " ".join(ws)))
    got = m.ngram_join(llm_spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {x["class_id"] for x in got} == {0} and {x["n_links"] for x in got} == {59}


def test_ngram_join_of_nothing(llm_spark):
    assert ngram_join(no_rows(documents(llm_spark))).count() == 0
    assert one_of_each_class(no_rows(documents(llm_spark))).count() == 0


def test_embeddings_by_brute_force(llm_spark):
    r = np.random.default_rng(3)
    rows = []
    for i in range(160):
        v = r.standard_normal(16)
        rows.append((len(rows), int(i % 3), [float(x) for x in v]))
        for _ in range(r.integers(0, 4)):
            rows.append((len(rows), int(i % 3), [float(x) for x in v + 0.08 * r.standard_normal(16)]))
    rows += [(9000, 1, None), (9001, 1, []), (9002, 1, [0.0] * 16), (9003, 1, [float("nan")] + [1.0] * 15), (9004, 1, [None] + [1.0] * 15),
             (9005, None, rows[0][2]), (None, 1, rows[1][2]), (9006, 0, [1.0] * 8), (9007, 0, [1.0] * 8), rows[4], (9008, 2, [1e300] * 16), (9009, 2, [1e-300] * 16)]
    df = llm_spark.createDataFrame([x + ("7",) for x in rows], "vec_id long, label int, embedding array<double>, unit string")

    def usable(i, label, v):
        return i is not None and label is not None and v and None not in v and np.isfinite(v).all() and any(v)

    def cos(a, b):
        a, b = np.array(a) / np.abs(a).max(), np.array(b) / np.abs(b).max()
        return a @ b / np.linalg.norm(a) / np.linalg.norm(b)

    linked = [{j for j, y in enumerate(rows) if i != j and usable(*x) and usable(*y) and x[1] == y[1] and len(x[2]) == len(y[2])
               and cos(x[2], y[2]) >= 0.93} for i, x in enumerate(rows)]
    want = []
    for i, x in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            todo += linked[k := todo.pop()] - seen
            seen |= linked[k]
        low = min(rows[k][0] for k in seen) if x[0] is not None else None
        want.append((x[0], len(linked[i]), low, x[0] is None or low == x[0]))
    got = [tuple(r) for r in embedding_dedup(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert embedding_dedup(no_rows(df)).count() == 0
