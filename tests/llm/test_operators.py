"""Operators 1 and 3 to 9 against brute force, round trips and awkward rows."""

import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from tests.llm.cases import PROSE, documents, no_rows
from tokenizers import Tokenizer

from tidelog.llm import mixing, pii, quality_knn, quality_rules, reply_trees, secret_scan
from tidelog.llm.common import held_out
from tidelog.llm.langid import language
from tidelog.llm.vector_packing import Limits, pack, pack_shard

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_rules_by_brute_force(llm_spark, seed):
    df = documents(llm_spark, seed, seed == 2)
    want = []
    for r in df.collect():
        t = r["text"] or ""
        ws = WORD.findall(t)
        grams = [tuple(ws[i:i + 3]) for i in range(len(ws) - 2)]
        covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)} if len(ws) < 500 else None
        lines = [x for x in t.split("\n") if WORD.search(x)]
        n_repeat = len(covered) if covered is not None else quality_rules.repeated_words([w.encode() for w in ws])
        want.append((r["doc_id"], len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), sum(x in lines[:i] for i, x in enumerate(lines)),
                     n_repeat, len(ws) < 50 or 100 * n_repeat > 50 * len(ws)))
    got = quality_rules.quality_rules(df)
    assert rows(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(want, key=str)
    assert got.filter("kept and base_failed").count() == 0


def test_repeated_words():
    assert quality_rules.repeated_words(list("abcabc")) == 6
    assert quality_rules.repeated_words(list("aaaa")) == 4
    assert quality_rules.repeated_words(list("abcxabcy")) == 6
    assert quality_rules.repeated_words(list("ab")) == 0


def test_a_bad_host_is_rejected(llm_spark):
    good = " ".join(f"w{i}" for i in range(80))
    made = [(i, good, "good") for i in range(40)] + [(100 + i, "short", "bad") for i in range(40)] + [(200, good, "bad"), (201, good, None)]
    df = llm_spark.createDataFrame(made, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(df).collect()}
    assert got[200]["host_rejected"] and not got[200]["kept"] and not got[200]["base_failed"]
    assert all(got[i]["kept"] for i in range(40))
    assert 0 < got[0]["rate_base"] < got[200]["rate_base"] < 1
    assert quality_rules.quality_rules(no_rows(df)).count() == 0


def test_secrets(llm_spark):
    r = random.Random(5)
    made = []
    for i in range(60):
        key = "".join(r.choice("0123456789abcdef") for _ in range(32))
        words_ = " ".join(r.choice(PROSE.split()) for _ in range(20))
        made.append((i, f"{words_} password={key} {words_} unconstitutionally {words_}"))
    made += [(100, None), (101, ""), (102, "AKIA" + "Q7" * 8), (103, 'token = "your_example_token_here_00000000"'), (None, "api_key: 9f8a7b6c5d4e3f2a1b0c")]
    df = llm_spark.createDataFrame(made, "doc_id long, text string").selectExpr("*", "'7' AS score", "1 AS id")
    got = secret_scan.secret_scan(df).collect()
    by = {}
    for x in got:
        by.setdefault(x["doc_id"], []).append(x)
    text = dict(made)
    for i in range(60):
        kept = [text[i][x["start"]:x["end"]] for x in by[i] if x["kept"]]
        assert kept == [text[i].split("password=")[1].split()[0]]
    assert by[102][0]["kept"] and not any(x["kept"] for x in by[103]) and by[None][0]["kept"]
    assert 100 not in by and 101 not in by
    assert secret_scan.secret_scan(no_rows(df)).count() == 0
    said = llm_spark.createDataFrame([(i, x["start"], x["end"], int(x["kind"] == "opaque")) for i in range(60) for x in by[i]],
                                     "doc_id long, start long, end long, label int")
    turned = secret_scan.secret_scan(df, said).filter("doc_id < 60").collect()
    assert all(x["kept"] == (x["kind"] == "opaque") for x in turned)


@pytest.mark.parametrize("text, name, value", [
    ("see https://host/v1?token=9f8a7b6c5d4e3f2a now", "token", "9f8a7b6c5d4e3f2a"), ("INFO: password=hunter2abc99", "password", "hunter2abc99"),
    ("user=admin1&password=hunter2abc99&x=1", "password", "hunter2abc99"), ("host=db.internal;pwd=hunter2abc99;port=1", "pwd", "hunter2abc99"),
    ("user=admin1&password=hunter2abc99", "user", "admin1"), ('token="ab,cd;ef&gh"', "token", "ab,cd;ef&gh")])
def test_a_secret_inside_a_value_is_proposed(text, name, value):
    assert ("assigned", name, value) in {(k, n, text[s:e]) for s, e, k, n in secret_scan.candidates(text)}


def test_a_long_secret_is_proposed_whole():
    r = random.Random(4)
    key = "".join(r.choice("abcdefABCDEF0123456789+/") for _ in range(800))
    for text in (f"token={key}", f'secret = "{key}" x'):
        assert any(k == "assigned" and text[s:e] == key for s, e, k, _ in secret_scan.candidates(text))
    run = "AKIA" + "Q7" * 8 + "/" + key
    assert run in {run[s:e] for s, e, _, _ in secret_scan.candidates(run)}


def plain_features(text, start, end, kind, name, words):
    """The features of one span, each from its definition."""
    v = text[start:end]
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in v)
    classes = ["digits" if c.isdigit() else "upper" if c.isupper() else "lower" if c.islower() else "other" for c in v]
    i = hit = 0
    while i < len(low):
        n = next((n for n in range(min(24, len(low) - i), 2, -1) if low[i:i + n] in words.words), 0)
        hit, i = hit + n, i + (n or 1)
    out = {c: classes.count(c) / len(v) for c in ("digits", "upper", "lower", "other")}
    out |= {"chars": len(v), "distinct": len(set(v)) / len(v), "entropy": -sum(v.count(c) / len(v) * math.log2(v.count(c) / len(v)) for c in set(v)),
            "changes": sum(a != b for a, b in zip(classes, classes[1:])) / len(v), "covered": hit / len(v),
            "surprise": sum(words.surprise.get(p, words.unseen) for p in zip(low, low[1:])) / max(len(v) - 1, 1),
            "placeholder": bool(re.search(r"(?i)example|sample|dummy|changeme|placeholder|x{4}|0{8}|\*{3}|your[_-]", v)),
            "named": bool(secret_scan.SECRET_NAME.search(name)), "name_chars": len(name)}
    return out


@pytest.mark.parametrize("seed", range(4))
def test_secret_features_by_brute_force(seed):
    r = random.Random(seed)
    words = secret_scan.Words(["the", "quick", "token", "there", "brown", "user"])
    parts = ["the", "quick", "token=", "a:", "user=", "&", ";", "9f8a7b6c5d4e3f2a", "xxxx", "your_", "Example", "AKIA" + "Q7" * 8, " ", '"', "é", "İ", "there", "00000000", "Zz"]
    for _ in range(40):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 40)))
        spans = secret_scan.candidates(text)
        names = {(s, e, k): n for s, e, k, n in spans}
        got = list(secret_scan.describe(text, spans, words))
        assert len(got) == len(spans)
        for span, values, _ in got:
            values = dict(zip(secret_scan.FEATURES, values))
            want = plain_features(text, *span, names[span], words)
            assert {k: pytest.approx(v) for k, v in want.items()} == {k: values[k] for k in want}, (text, span)


@pytest.mark.parametrize("piece", ["ab0:", "password=your_x,", "a=b1&", "x" * 7 + ":", "the=quick;", "9f8a7b6c5d4e3f2a"])
def test_a_long_piece_takes_time_in_proportion(piece):
    text = piece * (1_000_000 // len(piece))
    words = secret_scan.Words(["the", "quick", "password"])
    t = time.time()
    n = sum(1 for _ in secret_scan.describe(text, secret_scan.candidates(text), words))
    assert n and time.time() - t < 60   # a few seconds on an idle machine; hours if each value were walked by itself


def test_the_dictionary_does_not_switch_with_size(llm_spark):
    texts = [f"common words here {w} {w}" for w in ("alpha", "beta", "gamma", "beta")]
    one = llm_spark.createDataFrame([(t,) for t in texts], "text string")
    four = one.unionByName(one).unionByName(one).unionByName(one)
    for share, want in ((0.5, {"common", "words", "here", "beta"}), (0.6, {"common", "words", "here"}), (0.001, {"common", "words", "here", "alpha", "beta", "gamma"})):
        for df in (one, four):
            got = secret_scan.dictionary(df, share=share)
            assert got.words == want
    assert secret_scan.dictionary(one).surprise == secret_scan.dictionary(four).surprise


def test_secrets_without_a_secret_name(llm_spark):
    """Held-out: values of names that say nothing are found by their look, words and numbers there are not."""
    r = random.Random(8)
    vocabulary = PROSE.split() + ["configuration", "directory", "information", "production", "location"]
    made, planted = [], {}

    def key():
        return "".join(r.choice("0123456789abcdefghijkmnpqrstuvwxyzABCDEFGH") for _ in range(r.randint(20, 40)))

    for i in range(200):
        words_ = " ".join(r.choice(vocabulary) for _ in range(20))
        made.append((i, f"{words_} api_key={key()} mode={r.choice(vocabulary)}{r.choice(vocabulary)} {words_} db.password: {key()}"))
    for i in range(1000, 1060):
        value = planted[i] = key()
        made.append((i, f"some {r.choice(vocabulary)} handle={value} then region={r.choice(vocabulary)}{r.choice(vocabulary)} end"))
    df = llm_spark.createDataFrame(made, "doc_id long, text string")
    text = dict(made)
    kept = {}
    for x in secret_scan.secret_scan(df).filter("doc_id >= 1000 and kept").collect():
        kept.setdefault(x["doc_id"], set()).add(text[x["doc_id"]][x["start"]:x["end"]])
    found = sum(planted[i] in kept.get(i, ()) for i in planted)
    wrong = sum(len(v - {planted[i]}) for i, v in kept.items())
    print(f"recall {found / 60:.3f}, precision {found / max(found + wrong, 1):.3f}")
    assert found >= 54 and wrong <= 6


@pytest.mark.parametrize("limits", [Limits(), Limits(64, 4, 40), Limits(128, 1000, 128)])
def test_shard_limits(limits):
    r = random.Random(7)
    n = [r.choice([1, 2, 5, 30, 64, 200, 1000]) for _ in range(200)]
    loss = [r.randint(0, x) for x in n]
    pieces = pack_shard(n, loss, limits)
    for i in range(200):
        own = sorted(p[1:3] for p in pieces if p[0] == i)
        assert own[0][0] == 0 and sum(x for _, x in own) == n[i] and all(a + b == c for (a, b), (c, _) in zip(own, own[1:]))
    bins = {}
    for p in pieces:
        bins.setdefault(p[3], []).append(p)
    for ps in bins.values():
        total = sum(p[2] for p in ps)
        assert total <= limits.tokens and len(ps) <= limits.segments
        assert sum(min(p[2], max(0, p[1] + p[2] - loss[p[0]])) for p in ps) <= limits.loss_tokens
        assert [p[4] for p in ps] == [sum(q[2] for q in ps[:k]) for k in range(len(ps))]
        assert total == limits.tokens or total & (total - 1) == 0


def test_packing_round_trip(llm_spark):
    df = documents(llm_spark, 3, True)
    tok = Tokenizer.from_file(VOCABULARY)
    want = {}
    for r in df.collect():
        want.setdefault(r["doc_id"], []).append(tok.encode(r["text"] or "", add_special_tokens=False).ids + [2])
    got = pack(df, VOCABULARY).collect()
    assert sum(x["length"] for x in got) == sum(len(i) for v in want.values() for i in v)
    for x in got:
        assert any(x["doc_tokens"] == len(i) and x["ids_crc32"] == zlib.crc32(np.array(i[x["start"]:x["start"] + x["length"]], dtype="<u4").tobytes())
                   for i in want[x["doc_id"]])
    assert pack(no_rows(df), VOCABULARY).count() == 0


def test_word_tokenizer_is_exact():
    from tidelog.llm.vector_packing import WordTokenizer
    tok, own = Tokenizer.from_file(VOCABULARY), WordTokenizer(VOCABULARY)
    r = random.Random(1)
    chars = "aAbBéÉßİıſtΣς'’.,!?;:0 1́ \u0085 \x1c\x0b\x0c\n\t<|>한글ªʰĿǅÅK"
    made = ["".join(r.choice(chars) for _ in range(r.randint(0, 12))) for _ in range(4000)] + ["x<|endoftext|>y <|startoftext|>"]
    assert [np.frombuffer(b, dtype="<u4").tolist() for b in own(made)] == [tok.encode(s, add_special_tokens=False).ids for s in made]


def luhn(d):
    return sum((2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def base(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        out += [(m.start(), 2, m.end())] if 14 <= len(d) <= 19 and luhn(d) else []
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        out += [(m.start(), 3, m.end())] if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15 else []
    return sorted(out)


def test_personal_data_by_brute_force(llm_spark):
    r = random.Random(3)
    parts = ["a@b.c_d@e.f ", "@", "1.2.3.4.5.6.7.8 ", "+1 (23) 456-7890 ", ". ", "é𝒳", " 4111 1111 1111 1111 ", " 4111-1111-1111-1111", "0000000255.1.1.1 ",
             "a", "9", "+", "-", " ", "x.y@z..q", "j.doe (at) mail.com ", "7 ", "\n", "256.1.1.1", "12 "]
    made = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 14)))) for i in range(600)]
    made += [(1000, None), (1001, ""), (1002, "a" * 100_000 + "@" + "b.c" * 20_000), (1003, "1" * 100_000), (1004, "+1 " * 20_000), (None, "a@b.c"), (5, made[5][1])]
    df = llm_spark.createDataFrame(made, "doc_id long, text string").selectExpr("*", "7 AS _base", "'x' AS spans", "length(text) AS n_chars")
    want = []
    for i, t in made:
        b = base(t or "")
        listed = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in b)
        want.append((i, *[sum(k == j for _, k, _ in b) for j in range(4)], hashlib.sha256(listed.encode()).hexdigest()))
    got = pii.personal_data(df.select("doc_id", "text", "spans"))
    assert rows(got, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == sorted(want, key=str)
    own = {(x["doc_id"], x["base_sha256"]): x["spans"] for x in got.collect()}
    for (i, t), w in zip(made, want):
        listed = {f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base(t or "")}
        assert listed <= set(own[i, w[-1]].split(","))
    red = pii.redacted(df)
    assert red.columns == df.columns and red.filter("text IS NOT NULL AND length(text) <> n_chars").count() == 0
    back = {x["doc_id"]: x["text"] for x in red.collect()}
    assert back[1000] is None and back[1001] == "" and back[None] == "<EMAIL>"
    assert not any(base(t) and base(t) == base(dict(made)[i] or "") for i, t in back.items() if t and i is not None)
    assert pii.personal_data(no_rows(df)).count() == 0 and pii.redacted(no_rows(df)).count() == 0


def hidden(r, i):
    """A document with personal data in a loose form, and where it stands; or one with a number that is none."""
    n = [r.randint(1, 250) for _ in range(4)]
    d = "".join(r.choice("23456789") for _ in range(15))
    card = next(d + c for c in "0123456789" if luhn(d + c))
    forms = [f"{r.choice(PROSE.split())}.{n[0]} (at) mail{n[1]} (dot) com", f"{r.choice(PROSE.split())}{n[0]}[at]host{n[1]}[dot]org", f"({d[:3]}) {d[3:6]}-{d[6:10]}",
             f"1 ({d[:3]}) {d[3:6]}-{d[6:10]}", ".".join(card[k:k + 4] for k in (0, 4, 8, 12)), " . ".join(map(str, n))]
    clean = [f"$ {d[:9]}", f"version {n[0]} . {n[1]} . {n[2]} . {n[3]}", f"order {d[:10]}", f"2024-01-{n[0] % 18 + 10} 12", f"look (at) {r.choice(PROSE.split())}", f"{d[:3]}.{d[3:9]}"]
    return forms[i % 6], clean[i % 6]


def personal_cases(seed, n_base, n_cases):
    """Base spans to learn from, hidden forms under ids from 10,000 and clean numbers from 20,000 on."""
    r = random.Random(seed)
    made, spot = [], {}
    prose = lambda: " ".join(r.choice(PROSE.split()) for _ in range(12))
    for i in range(n_base):
        d = "".join(r.choice("23456789") for _ in range(15))
        v = [f"{r.choice(PROSE.split())}.{r.randint(1, 99)}@mail{r.randint(1, 9)}.example.com", ".".join(str(r.randint(1, 250)) for _ in range(4)),
             next(d + c for c in "0123456789" if luhn(d + c)), f"+1 ({d[:3]}) {d[3:6]}-{d[6:10]}"][i % 4]
        made.append((i, f"{prose()} {v} {prose()}"))
        made.append((50_000 + i, f"{prose()} {hidden(r, i)[1]} {prose()}"))
    for i in range(n_cases):
        for at, v in zip((10_000, 20_000), hidden(r, i)):
            left = prose()
            made.append((at + i, f"{left} {v} {prose()}"))
            spot[at + i] = (len(left) + 1, len(left) + 1 + len(v), v)
    return made, spot


def test_hidden_personal_data_is_found(llm_spark):
    made, spot = personal_cases(11, 400, 120)
    df = llm_spark.createDataFrame(made, "doc_id long, text string").repartition(8)
    got = {x["doc_id"]: x["spans"] for x in pii.personal_data(df).collect()}
    kind = ("email", "email", "phone", "phone", "card", "ip")
    for i in range(120):
        s, e, v = spot[10_000 + i]
        assert f"{kind[i % 6]}:{s}:{e}" in got[10_000 + i].split(","), (v, got[10_000 + i])
        assert got[20_000 + i] == "", (spot[20_000 + i], got[20_000 + i])
    red = {x["doc_id"]: x["text"] for x in pii.redacted(df).collect()}
    assert all(spot[10_000 + i][2] not in red[10_000 + i] for i in range(120))
    assert all(red[i] == t for i, t in made if 20_000 <= i < 50_000)


def test_a_rare_kind_has_its_threshold(llm_spark):
    """Thresholds don't depend on the size of the sample: 40 base spans of a kind among 16,000 ruled-out numbers
    (which are candidates for telephones, so that kind's threshold is a matter of its precision)."""
    made, _ = personal_cases(12, 160, 0)
    made += [(90_000 + i, " ".join(f"id {i}{k:06d} of" for k in range(40))) for i in range(400)]
    df = llm_spark.createDataFrame(made, "doc_id long, text string").repartition(8)
    text = pii.F.col("text")
    found = pii.with_spans(df).select(pii.F.xxhash64("doc_id").alias("_key"), "_cands", pii.places(text, pii.F.col("_base")).alias("_places"))
    assert set(pii.learn(found, sample=400).thresholds) >= {0, 1, 2}


def test_flight_keeps_its_totals():
    r = np.random.default_rng(2)
    for n in (1, 2, 3, 50, 2000):
        size, pi = r.integers(1, 500, n), r.random(n)
        out = mixing.flight(size, pi, np.random.default_rng(1))
        assert ((out > 0) & (out < 1)).sum() <= 2
        assert abs(out.sum() - pi.sum()) < 1e-6 and abs(size @ out - size @ pi) < 1e-4
        done = mixing.landing(size, out, float(size @ pi))
        assert set(done) <= {0.0, 1.0} and abs(size @ done - size @ pi) <= max(size)
        assert n < 50 or abs(size @ done - size @ pi) < 3


def shares(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        open_ = sum(weight[s] for s in order if s not in capped)
        goal = {s: 3 * sizes[s] if s in capped else rest * weight[s] / open_ for s in order}
        over = {s for s in order if s not in capped and goal[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return goal
        capped |= over


@pytest.mark.parametrize("chunk", [4096, 16])
def test_mixing(llm_spark, monkeypatch, chunk):
    monkeypatch.setattr(mixing, "CHUNK", chunk)
    df = documents(llm_spark, 4, True)
    df = df.unionByName(df.limit(1).withColumn("source", mixing.F.lit("tiny")).withColumn("text", mixing.F.lit("one word more")))
    sizes, n = {}, {}
    for r in df.collect():
        k = len(WORD.findall(r["text"] or ""))
        sizes[r["source"]] = sizes.get(r["source"], 0) + k
        n[r["doc_id"]] = n.get(r["doc_id"], 0) + 1
    got = mixing.mix(df).collect()
    assert len(got) == sum(n.values())
    goal = shares(sizes)
    source = {v: k for k, v in sizes.items()}
    taken = dict.fromkeys(sizes, 0)
    for x in got:
        s = source[x["source_size"]]
        taken[s] += x["taken"]
        assert abs(x["target"] - goal[s]) < 1e-6 * max(1, goal[s]) and 0 <= x["taken"] <= 3 * x["size"]
    largest = max(x["size"] for x in got)
    assert all(abs(taken[s] - goal[s]) <= largest for s in sizes)
    again = mixing.mix(df.repartition(3))
    assert rows(again, "doc_id", "size", "taken") == sorted([(x["doc_id"], x["size"], x["taken"]) for x in got], key=str)
    out = mixing.mixed(df)
    assert out.columns == df.columns and out.count() == sum(x["copies"] for x in got if x["size"])
    assert mixing.mix(no_rows(df)).count() == 0 and mixing.mixed(no_rows(df)).count() == 0


def test_conversations_round_trip(llm_spark):
    r = random.Random(6)
    parts = ["hi", "<|im_end|>", "<|im_start|>assistant", "<\\|", "\\", "\n", "<", "|", "é𝒳", "<|", "\\n", "<\\\\|im_end|>\n"]
    made = []
    for c in [*range(40), None, 77]:
        for t in range(r.randint(1, 9) if c != 77 else 70):
            made.append((c, t if r.random() < 0.95 else None, r.choice(["user", "assistant", "system", None, "a\\nb\n<|x"]), r.choice([None, "", *["".join(r.choice(parts) for _ in range(6)) for _ in range(4)]]), 1))
    made.append(made[0])
    df = llm_spark.createDataFrame(made, "conv_id long, turn long, role string, text string, node int")
    want = []
    for c in {m[0] for m in made}:
        turns = sorted(((m[1] is None, m[1] or 0, (m[2] or "").encode(), (m[3] or "").encode()) for m in made if m[0] == c))
        turns = [(a.decode(), b.decode()) for *_, a, b in turns]
        loss = "".join(b for a, b in turns if a == "assistant")
        want.append((c, len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    got = reply_trees.chat_digest(df)
    assert rows(got, "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256") == sorted(want, key=str)
    assert reply_trees.chat_digest(no_rows(df)).count() == 0


def test_best_branch_of_a_tree(llm_spark):
    nodes = [("t", 1, None, 1.0), ("t", 2, 1, 5.0), ("t", 3, 1, 0.0), ("t", 4, 2, 0.0), ("t", 5, 3, 9.0), ("u", 1, 99, None), ("u", 2, 1, 1.0),
             ("v", 1, 2, 1.0), ("v", 2, 1, 1.0), ("w", 1, 2, 1.0), ("w", 2, 1, 1.0), ("w", 3, 2, 1.0), ("w", 9, None, 0.0)]
    df = llm_spark.createDataFrame(nodes, "tree string, node long, parent long, score double")
    got = reply_trees.chosen_paths(df)
    assert rows(got, "tree", "leaf", "node", "depth") == [("t", 5, 1, 2), ("t", 5, 3, 1), ("t", 5, 5, 0), ("u", 2, 1, 1), ("u", 2, 2, 0), ("w", 9, 9, 0)]
    both = reply_trees.chosen_paths(df, 2).filter("tree = 't'")
    assert rows(both, "rank", "node") == [(1, 1), (1, 3), (1, 5), (2, 1), (2, 2), (2, 4)]


def test_quality_votes(llm_spark):
    r = random.Random(8)
    good = [" ".join(r.choice(PROSE.split()) for _ in range(60)).capitalize() + "." for _ in range(120)]
    bad = [" | ".join(r.choice(PROSE.split()).upper() + "!!" for _ in range(40)) for _ in range(60)]
    df = llm_spark.createDataFrame(list(enumerate(good + bad)) + [(500, None), (501, " "), (None, good[0]), (3, good[3])], "doc_id long, text string") \
        .selectExpr("*", "'x' AS _score", "1 AS label", "0 AS quality")
    labels = llm_spark.createDataFrame([(i, int(i < 120), 0) for i in range(180)] + [(None, 1, 0), (7, None, 0), (500, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality_knn.quality(df, labels).collect()
    for x in got:
        if x["doc_id"] is None or x["doc_id"] < 180:
            assert x["predicted"] == (x["doc_id"] is None or x["doc_id"] < 120)
        else:
            assert x["score"] == 0 and x["predicted"] == 0
        assert x["held_out"] == (x["doc_id"] is not None and zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0)
    kept = quality_knn.of_quality(df, labels)
    assert kept.columns == df.columns and kept.count() == 122
    assert quality_knn.quality(no_rows(df), labels).count() == 0
    assert {x["score"] for x in quality_knn.quality(df, no_rows(labels)).collect()} == {0.0, 0.5}


def test_language(llm_spark):
    r = random.Random(8)
    of = {"en": "the and of to in that with which from have this", "fr": "le la les des une que dans pour avec sur être", "de": "der die das und nicht ein ich mit auf über"}
    made = [(i, " ".join(r.choice(of[k].split()) for _ in range(r.randint(3, 30))), k) for i, k in enumerate(list(of) * 60)]
    made += [(900, None, "en"), (901, "123 !!", "fr"), (902, "", None), (None, "the that which", None), (0, made[0][1], made[0][2])]
    df = llm_spark.createDataFrame(made, "doc_id long, text string, lang string").selectExpr("*", "'x' AS lang_pred", "1 AS score", "2 AS _n")
    got = language(df).collect()
    assert len(got) == len(made) and {x["lang_pred"] for x in got if x["doc_id"] in (900, 901, 902)} == {"und"}
    want = {i: k for i, _, k in made if i is not None and i < 900}
    hits = [x["lang_pred"] == want[x["doc_id"]] for x in got if x["doc_id"] in want]
    assert sum(hits) >= 0.95 * len(hits) and next(x for x in got if x["doc_id"] is None)["lang_pred"] == "en"
    assert all(0 <= x["score"] <= 1 for x in got)
    assert language(no_rows(df)).count() == 0
    scattered = language(df.repartition(2 * len(made)))  # partitions without any text to learn from
    assert sorted(map(str, scattered.collect())) == sorted(map(str, got))


def test_fold(llm_spark):
    got = llm_spark.range(50).select("id", held_out("id", 5, 0).alias("h")).collect()
    assert all(x["h"] == (zlib.crc32(str(x["id"]).encode()) % 5 == 0) for x in got)


def test_copies_of_a_row_in_parts(llm_spark, monkeypatch):
    rows_ = [(i, "w " * 40, "a") for i in range(30)] + [(99, "v " * 7, "b")] * 3
    df = llm_spark.createDataFrame(rows_, "doc_id long, text string, source string")
    whole = rows(mixing.mixed(df), "doc_id", "text", "source")
    monkeypatch.setattr(mixing, "PART", 2)
    assert rows(mixing.mixed(df), "doc_id", "text", "source") == whole
    assert sum(r[0] == 99 for r in whole) == 9
