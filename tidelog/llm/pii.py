"""Personal data (operator 5): candidate spans, boosted trees, calibrated thresholds.

DataFrame and SQL functions only.  ``base_spans`` finds e-mail addresses, IPs, card and
phone numbers by the fixed patterns; these are always taken.  High-recall
generators propose further, overlapping candidates (spaced or spelled-out marks, missing
plus signs, other digit groups).  Gradient-boosted trees are trained on a
bounded sample of labelled candidates.  Positive are base spans rewritten in their own context
into forms that only the generators find (``rewritten``); negative are the same spans broken, and
candidates that their format or context rules out (``_wrong``: version numbers, prices, ids,
dates).  All others have no label.  Features are the candidate's format and its context.  A
threshold for each kind is calibrated on all labelled candidates held back from the fit: the
lowest score, from 0.5 on, with the wanted precision.  The trees become one column
expression, so scoring and redaction are narrow: no text is shuffled.

Positions are code points, ends exclusive.  Possessive loops and look-behinds only
keep the patterns linear; the matches are those of the plain patterns.

Defined results: a null text is empty and has no spans; null or repeated ids
are rows as any other; an empty table gives no rows; where labelled candidates are all of one
class there is no model and only base spans are taken.  Other columns are ignored
(kept, in ``redacted``).
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept_table, spread, unused

KINDS = ("email", "ip", "card", "phone")
# The base patterns of the contract, with possessive loops.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Cheap tests that hold for every text with a match.
BASE_NEEDS = {
    "email": "@[A-Za-z0-9-]",
    "ip": r"[0-9]\.[0-9]++\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){13}",
    "phone": r"\+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]++)*+",
    "ip": r"(?<![0-9])[0-9]{1,6}+(?:\x20?[.,:]\x20?[0-9]{1,6}+){3}+",
    "card": r"(?<![0-9])[0-9](?:[\x20.-]?[0-9]){11,22}+",
    "phone": r"(?<![0-9])[+(]{0,2}+[0-9](?:[\x20().-]{0,2}+[0-9]){6,17}+",
}
LOOSE_NEEDS = {
    "email": r"@|\(at\)|\[at\]",
    "ip": r"[0-9]\x20?[.,:]\x20?[0-9]++\x20?[.,:]\x20?[0-9]",
    "card": r"[0-9](?:[\x20.-]?[0-9]){11}",
    "phone": r"[0-9](?:[\x20().-]{0,2}[0-9]){6}",
}
CUES = {
    "cue_mail": r"(?i)mail|contact|write|schreib|écri|correo",
    "cue_phone": r"(?i)phone|call|tel|mobile|fax|anruf|appel",
    "cue_card": r"(?i)card|visa|credit|karte|carte|tarjeta",
    "cue_ip": r"(?i)\bip\b|host|server|addr|version|\bv\b",
}
# What rules a number out: a mark or word before it, a unit after it, a date or a decimal number.
NOT_BEFORE = r"(?i)(?:[$€£¥#§=/]|\b(?:v|ver|version|release|rev|build|section|chapter|page|order|invoice|item|id|no|nr|price|isbn|usd|eur)\b\.?:?)[\x20(]?$"
NOT_AFTER = r"(?i)^(?:\x20?[$€£¥%]|\x20?(?:usd|eur|kg|km|cm|mm|ms|kb|mb|gb|bytes)\b|/)"
DATED = r"(?<![0-9])(?:(?:19|20)[0-9]{2}[.-][0-9]{1,2}[.-][0-9]{1,2}|[0-9]{1,2}[.-][0-9]{1,2}[.-](?:19|20)[0-9]{2})(?![0-9])|^[0-9]+\.[0-9]+$"
DOMAIN = r"(?:\.|\x20?\((?i:dot)\)\x20?|\x20?\[(?i:dot)\]\x20?)[A-Za-z]{2,}$"
CONTEXT = 24
#: Labelled candidates to fit on (expected number, in equal parts by kind and label, chosen by hash), and the share of all held back for the thresholds.
SAMPLE = 12_000
HELD_BACK = 0.25
TREES, DEPTH, RATE = 10, 3, 0.3
PRECISION = 0.95


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def part(c: Column, i: Column) -> Column:
        d = c.try_cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)
    parts = F.transform(F.split(F.reverse(digits), ""), part)
    return F.aggregate(parts, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _small(part: Column) -> Column:
    short = F.regexp_replace(part, "^0+", "")
    return (F.length(short) <= 3) & (F.coalesce(short.try_cast("int"), F.lit(0)) <= 255)


def _valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(v, r"\."), _small)
    if kind == "card":
        d = _digits(v)
        return F.length(d).between(14, 19) & _luhn(d)
    if kind == "phone":
        return F.length(_digits(v)).between(10, 15)
    return F.lit(True)


SPAN = "array<struct<start:long,kind_no:int,end:long,value:string>>"


def _matches(text: Column, kind: str, pattern: str, needs: str) -> Column:
    """Leftmost non-overlapping matches of a pattern with their places."""
    no = KINDS.index(kind)
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    none = F.array().cast(SPAN)

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        span = F.struct(start.alias("start"), F.lit(no).alias("kind_no"), end.alias("end"), x["hit"].alias("value"))
        return F.when(x["hit"].isNull(), acc).otherwise(F.struct(end.alias("pos"), F.concat(acc["out"], F.array(span)).alias("out")))

    placed = F.aggregate(pairs, F.struct(F.lit(0).cast("long").alias("pos"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(text.rlike(needs), placed).otherwise(none)


def base_spans(text: Column) -> Column:
    """All base spans of a text, by start, then kind; never null."""
    def valid(kind: str):
        return lambda s: _valid(kind, s["value"])
    return F.array_sort(F.concat(*[F.filter(_matches(text, k, BASE[k], BASE_NEEDS[k]), valid(k)) for k in KINDS]))


FEATURES = ("kind_no", "chars", "digits", "letters", "dots", "blanks", "dashes", "brackets", "groups", "longest", "plus", "at", "small",
            "luhn", "touches_left", "touches_right", "domain", "ruled_out", "dated", *CUES)
CANDIDATE = "array<struct<start:long,kind_no:int,end:long,value:string,base:int,clear:boolean,wrong:boolean,f:array<double>>>"


def _wrong(s: Column) -> Column:
    """True for a candidate that can't be of its kind, by its format or by what stands beside it."""
    v, digits = s["value"], s["digits"]
    inside = s["ruled_out"] | s["touches_left"] | s["touches_right"]
    by_kind = {
        "email": ~s["domain"],
        "ip": inside | ~F.contains(v, F.lit(".")) | ~F.forall(s["parts"], _small),
        "card": inside | ~F.length(digits).between(14, 19) | ~s["luhn"],
        "phone": inside | s["dated"] | ~F.length(digits).between(7, 15) | v.rlike(r"^[0-9]{1,3}(?:\x20?\.\x20?[0-9]{1,3}){3}$"),
    }
    return reduce(lambda a, k: F.when(s["kind_no"] == KINDS.index(k), by_kind[k]).otherwise(a), by_kind, F.lit(False))


def candidates(text: Column, base: Column) -> Column:
    """High-recall candidates with features; ``base`` is 1 where one overlaps a base span of its kind,
    ``clear`` is true where it overlaps no base span at all, ``wrong`` where it can't be of its kind."""
    loose = F.concat(*[_matches(text, k, LOOSE[k], LOOSE_NEEDS[k]) for k in KINDS])

    def beside(s: Column) -> Column:
        return F.struct(s["start"].alias("start"), s["kind_no"].alias("kind_no"), s["end"].alias("end"), s["value"].alias("value"),
                        text.substr(F.greatest(F.lit(1), s["start"] - CONTEXT + 1).cast("int"), F.least(F.lit(CONTEXT), s["start"]).cast("int")).alias("left"),
                        text.substr((s["end"] + 1).cast("int"), F.lit(CONTEXT)).alias("right"), _digits(s["value"]).alias("digits"),
                        F.filter(F.split(s["value"], "[^0-9]+"), lambda p: p != "").alias("parts"))

    def judged(s: Column) -> Column:
        left, right, v = s["left"], s["right"], s["value"]
        return F.struct(*[s[x].alias(x) for x in ("start", "kind_no", "end", "value", "digits", "parts")], F.concat(left, F.lit(" "), right).alias("near"),
                        F.coalesce(left.rlike(r"[A-Za-z0-9]$"), F.lit(False)).alias("touches_left"),
                        F.coalesce(right.rlike(r"^[A-Za-z0-9]"), F.lit(False)).alias("touches_right"), v.rlike(DOMAIN).alias("domain"),
                        (left.rlike(NOT_BEFORE) | right.rlike(NOT_AFTER)).alias("ruled_out"), v.rlike(DATED).alias("dated"), _luhn(s["digits"]).alias("luhn"))

    def described(s: Column) -> Column:
        v = s["value"]
        count = lambda chars: F.length(v) - F.length(F.regexp_replace(v, chars, ""))
        overlap = lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"])
        f = [s["kind_no"], F.length(v), count("[0-9]"), count("[A-Za-z]"), count(r"\."), count(" "), count("-"), count(r"[()\[\]]"),
             F.size(s["parts"]), F.coalesce(F.array_max(F.transform(s["parts"], lambda p: F.length(p))), F.lit(0)), F.startswith(v, F.lit("+")).cast("int"),
             F.contains(v, F.lit("@")).cast("int"), F.size(F.filter(s["parts"], _small)),
             *[s[x].cast("int") for x in ("luhn", "touches_left", "touches_right", "domain", "ruled_out", "dated")],
             *[s["near"].rlike(c).cast("int") for c in CUES.values()]]
        return F.struct(
            s["start"].alias("start"), s["kind_no"].alias("kind_no"), s["end"].alias("end"), v.alias("value"),
            F.exists(base, lambda b: overlap(b) & (b["kind_no"] == s["kind_no"])).cast("int").alias("base"),
            (~F.exists(base, overlap)).alias("clear"), _wrong(s).alias("wrong"), F.array(*[x.cast("double") for x in f]).alias("f"))

    return F.transform(F.transform(F.transform(loose, beside), judged), described)


def _forms(kind_no: Column, start: Column, v: Column, near: Column) -> Column:
    """A base span in forms that no base pattern takes: as people write it to hide it or by habit (1), and broken (0)."""
    digits = _digits(v)
    turn = F.pmod(F.xxhash64(v, start), F.lit(3))
    user, host = F.substring_index(v, "@", 1), F.substring_index(v, "@", -1)
    bare = F.regexp_replace(v, r"^\+", "")
    local = F.regexp_replace(v, r"^\+[0-9]{1,3}[\x20.-]+(?=[0-9(].*[0-9].*[0-9].*[0-9].*[0-9].*[0-9].*[0-9].*[0-9])", "")
    dotted = F.regexp_replace(F.regexp_replace(local, r"[^0-9]+", "."), r"^\.", "")
    plain = F.when(near.rlike(CUES["cue_phone"]), digits).otherwise(bare)
    last = F.when(F.endswith(digits, F.lit("9")), F.lit("0")).otherwise((F.right(digits, F.lit(1)).try_cast("int") + 1).cast("string"))
    broken = F.concat(F.left(digits, F.length(digits) - 1), last)
    fours = lambda d, mark: F.regexp_replace(d, "([0-9]{4})(?=[0-9])", "$1" + mark)
    form = lambda value, label: F.struct(value.alias("value"), F.lit(label).alias("label"))
    either = lambda *xs: F.when(turn == 0, xs[0]).when(turn == 1, xs[1]).otherwise(xs[-1])
    of = {
        "email": (either(F.concat(user, F.lit(" (at) "), F.regexp_replace(host, r"\.", " (dot) ")),
                         F.concat(user, F.lit("[at]"), F.regexp_replace(host, r"\.", "[dot]")), F.concat(user, F.lit(" @ "), host)),
                  F.concat(user, either(F.lit(" (at) "), F.lit("[at]"), F.lit(" @ ")), F.regexp_replace(host, r"\.", ""))),
        "ip": (either(*[F.regexp_replace(v, r"\.", mark) for mark in (" . ", ". ", " .")]),
               F.concat(F.lit("999"), F.regexp_replace(F.regexp_replace(v, r"^[0-9]+", ""), r"\.", " . "))),
        "card": (fours(digits, "."), fours(broken, ".")),
        "phone": (either(bare, dotted, F.when(F.pmod(F.xxhash64(v), F.lit(2)) == 0, local).otherwise(plain)),
                  F.concat(either(F.lit("#"), F.lit("$"), F.lit("id ")), either(digits, bare, dotted))),
    }
    return reduce(lambda a, k: F.when(kind_no == KINDS.index(k), F.array(form(of[k][0], 1), form(of[k][1], 0))).otherwise(a),
                  KINDS, F.array().cast("array<struct<value:string,label:int>>"))


def places(text: Column, base: Column) -> Column:
    """The base spans with the text beside them."""
    return F.transform(base, lambda s: F.struct(
        s["start"].alias("start"), s["kind_no"].alias("kind_no"), s["value"].alias("value"),
        text.substr(F.greatest(F.lit(1), s["start"] - 2 * CONTEXT + 1).cast("int"), F.least(F.lit(2 * CONTEXT), s["start"]).cast("int")).alias("left"),
        text.substr((s["end"] + 1).cast("int"), F.lit(2 * CONTEXT)).alias("right")))


def rewritten(found: DataFrame) -> DataFrame:
    """``_key, kind_no, label, f``: candidates from the base spans of ``found(_key, _places)`` written in other forms where they stand."""
    spans = found.select("_key", F.explode("_places").alias("s")).select("_key", "s.*")
    near = F.concat(F.col("left"), F.lit(" "), F.col("right"))
    forms = spans.select("_key", "kind_no", "left", "right", F.explode(_forms(F.col("kind_no"), F.col("start"), F.col("value"), near)).alias("x"))
    start = F.length("left").cast("long")
    place = F.struct(start.alias("start"), F.col("kind_no"), (start + F.length("x.value")).alias("end"), F.col("x.value").alias("value"))
    there = forms.select("_key", "x.label", F.array(place).alias("places"), F.concat("left", "x.value", "right").alias("window"))
    own = there.select("_key", "label", F.col("places")[0].alias("place"), F.explode(candidates(F.col("window"), F.col("places"))).alias("c"))
    # A broken form may be found in part (behind its mark); a good one is found whole, where its context doesn't rule it out.
    whole = (F.col("c.start") <= F.col("place.start")) & (F.col("c.end") >= F.col("place.end")) & ~F.col("c.wrong")
    fits = (F.col("c.base") == 1) & F.when(F.col("label") == 1, whole).otherwise(F.col("c.wrong"))
    return own.filter(fits).select("_key", "c.kind_no", "label", "c.f")


def labelled(found: DataFrame) -> DataFrame:
    """The forms of ``rewritten`` and, as negatives, the candidates of ``found(_key, _cands, _places)`` clear of base spans that can't be of their kind."""
    wrong = found.select("_key", F.explode(F.filter("_cands", lambda c: c["clear"] & c["wrong"])).alias("c"))
    return rewritten(found).unionByName(wrong.select("_key", "c.kind_no", F.lit(0).alias("label"), "c.f"))


def with_spans(docs: DataFrame, text_col: str = "text", base: str = "_base", cands: str = "_cands") -> DataFrame:
    """``docs`` with its base spans and candidates."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn(base, base_spans(text)).withColumn(cands, candidates(text, F.col(base)))


def _tree(lines: list[str], f: Column) -> Column:
    """One tree of a model's printed form as a column over the feature array."""
    head = lines.pop(0)
    if (m := re.match(r"\s*Predict: (\S+)", head)):
        return F.lit(float(m[1]))
    at, limit = re.match(r"\s*If \(feature (\d+) <= (\S+)\)", head).groups()
    low = _tree(lines, f)
    lines.pop(0)  # Else
    high = _tree(lines, f)
    return F.when(f[int(at)] <= float(limit), low).otherwise(high)


class Redactor:
    """Trees and thresholds; ``score`` and ``extra`` are column expressions."""

    def __init__(self, trees: list[tuple[float, list[str]]], thresholds: dict[int, float]):
        self.trees, self.thresholds = trees, thresholds

    def score(self, f: Column) -> Column:
        margin = reduce(lambda a, b: a + b, [F.lit(w) * _tree(list(lines), f) for w, lines in self.trees])
        return 1 / (1 + F.exp(-2 * margin))

    def extra(self, cands: Column) -> Column:
        """Candidates clear of base spans whose score reaches their kind's threshold, as spans."""
        none = F.array().cast(SPAN)
        if not self.thresholds:
            return none

        def taken(c: Column) -> Column:
            least = reduce(lambda a, kt: F.when(c["kind_no"] == kt[0], F.lit(kt[1])).otherwise(a), self.thresholds.items(), F.lit(2.0))
            return c["clear"] & (self.score(c["f"]) >= least)

        return F.transform(F.filter(cands, taken), lambda c: F.struct(c["start"], c["kind_no"], c["end"], c["value"])).cast(SPAN)


def learn(found: DataFrame, sample: int = SAMPLE) -> Redactor:
    """Fit on at most about ``sample`` labelled candidates of ``found(_key, _cands, _places)``."""
    cands = kept_table(labelled(found))
    cands = cands.withColumn("held", spread("_key", F.col("f"), seed=92) < HELD_BACK)
    counts = {(r["kind_no"], r["label"]): r["n"] for r in cands.filter("not held").groupBy("kind_no", "label").agg(F.count("*").alias("n")).collect()}
    if len({label for _, label in counts}) < 2:
        return Redactor([], {})
    # As many rows of each kind and label, where there are so many.
    share = reduce(lambda a, kn: F.when((F.col("kind_no") == kn[0][0]) & (F.col("label") == kn[0][1]), F.lit(sample / len(counts) / kn[1])).otherwise(a), counts.items(), F.lit(0.0))
    rows = kept_table(cands.filter(~F.col("held") & (spread("_key", F.col("f"), seed=91) < share))
                      .select(F.col("label").cast("double").alias("label"), *[F.col("f")[i].alias(x + "_f") for i, x in enumerate(FEATURES)]))
    classes = rows.agg(F.min("label"), F.max("label")).first()
    if classes[0] is None or classes[0] == classes[1]:
        return Redactor([], {})
    ready = VectorAssembler(inputCols=[x + "_f" for x in FEATURES], outputCol="features").transform(rows)
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=RATE, seed=7).fit(ready)
    trees = [(w, t.toDebugString.splitlines()[1:]) for w, t in zip(model.treeWeights, model.trees)]
    bins = cands.filter("held").select("kind_no", "label", F.floor(Redactor(trees, {}).score(F.col("f")) * 50).alias("bin")) \
        .groupBy("kind_no", "bin").agg(F.sum("label").alias("good"), F.count("*").alias("all")).collect()  # 51 bins a kind at most
    thresholds = {}
    for k in {r["kind_no"] for r in bins}:
        good = total = 0
        own = sorted((r for r in bins if r["kind_no"] == k), key=lambda r: -r["bin"])
        for r, lower in zip(own, [*[(x["bin"] + 1) / 50 for x in own[1:]], 0.5]):  # down to the next bin with rows
            good, total = good + r["good"], total + r["all"]
            if good >= PRECISION * total:
                thresholds[int(k)] = max(0.5, lower)
    return Redactor(trees, thresholds)


def _listed(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["kind_no"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_extra`` for each row."""
    found = kept_table(with_spans(docs.select(F.col(id_col), F.col(text_col)), text_col).select(
        id_col, F.xxhash64(id_col).alias("_key"), "_base", "_cands", places(F.coalesce(F.col(text_col), F.lit("")), F.col("_base")).alias("_places")))
    extra = learn(found).extra(F.col("_cands"))
    out = found.withColumn("_extra", extra).withColumn("_all", F.array_sort(F.concat("_base", "_extra")))
    no = F.transform("_base", lambda s: s["kind_no"])
    return out.select(
        id_col, *[(F.size(no) - F.size(F.array_remove(no, i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(_listed(F.col("_base")), 256).alias("base_sha256"), _listed(F.col("_all")).alias("spans"),
        F.size("_extra").cast("long").alias("n_extra"))


def _replaced(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans replaced by the first one's kind."""
    labels = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def step(acc: Column, s: Column) -> Column:
        gap = text.substr((acc["pos"] + 1).cast("int"), (s["start"] - acc["pos"]).cast("int"))
        more = F.struct(s["end"].alias("pos"), F.concat(acc["out"], F.array(F.concat(gap, labels[s["kind_no"]]))).alias("out"))
        longer = F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), acc["out"].alias("out"))
        return F.when(s["start"] >= acc["pos"], more).otherwise(longer)

    start = F.struct(F.lit(0).cast("long").alias("pos"), F.array().cast("array<string>").alias("out"))
    whole = F.aggregate(spans, start, step, lambda acc: F.concat(
        F.array_join(acc["out"], ""), text.substr((acc["pos"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with personal data replaced by ``<EMAIL>``, ``<IP>``, ``<CARD>`` or ``<PHONE>``; a null text stays null.

    ``n_chars``, if there, follows the new text.
    """
    base, cands = unused(docs, "_base"), unused(docs, "_cands")
    found = with_spans(docs, text_col, base, cands)
    beside = places(F.coalesce(F.col(text_col), F.lit("")), F.col(base)).alias("_places")
    model = learn(kept_table(found.select(F.xxhash64(id_col).alias("_key"), F.col(cands).alias("_cands"), beside)))
    spans = F.array_sort(F.concat(F.col(base), model.extra(F.col(cands))))
    out = found.withColumn(text_col, _replaced(F.col(text_col), spans))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
