"""Regex field extraction (O10-O16) as column expressions.

``extract_fields`` applies an ordered pattern set to every row and adds a
``fields MAP<STRING,STRING>`` column ({} when nothing matched).

Semantics kept from the reference:

* a pattern without an input field searches the raw text (``text_col``); when
  the record is a decoded JSON value (``json_col``) such a pattern meets a
  non-string and ends the chain;
* ``name:field`` searches the value of ``field``: first among fields extracted
  so far (named keys only; positional keys are ints there), then among the
  top-level members of the JSON object, where only strings are accepted;
* named groups give named keys, unnamed groups are ignored when a name exists,
  otherwise keys ``'1'..'n'``; later values overwrite, a group that took no
  part gives NULL;
* ``mode='stop'`` (the reference, quirk Q1): the chain ends at the first
  pattern that does not match, has a non-string input or names a field not yet
  present.  ``mode='fixpoint'`` (what the reference meant): every pattern is
  tried; one whose input is missing is retried after the others, in passes,
  until a pass adds nothing.

Each step is one narrow projection: a guard, then a
``regexp_extract`` per group under that guard, so the regex runs on the JVM in
whole-stage codegen and nothing is shuffled.  A group that is never absent and never empty is
the guard (the pattern runs once for both), else it is an ``rlike``.  Patterns with optional groups go
through a pandas UDF running Python's ``re`` (Arrow batches), because Java's
``regexp_extract`` cannot tell an absent group from an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import jsonv
from ..functions.regex import PatternSpec, compile_patterns

_H = "__tl_x_"


def _py_matcher(spec: PatternSpec):
    """pandas UDF: STRUCT<m BOOLEAN, g0..gk STRING> with Python ``re.search``."""
    fields = [T.StructField("m", T.BooleanType())] + [
        T.StructField(f"g{j}", T.StringType()) for j in range(len(spec.group_index))]
    schema = T.StructType(fields)
    pattern, idx = spec.pattern, list(spec.group_index)

    @F.pandas_udf(schema)
    def match(s: pd.Series) -> pd.DataFrame:
        rx = re.compile(pattern)
        rows = []
        for v in s:
            m = rx.search(v) if isinstance(v, str) else None
            if m is None:
                rows.append((False,) + (None,) * len(idx))
            else:
                rows.append((True,) + tuple(m.group(i) for i in idx))
        return pd.DataFrame(rows, columns=[f.name for f in fields])

    return match


class _State:
    """Per-row fold state kept in helper columns: alive flag, and per key a
    presence flag and a value."""

    def __init__(self, specs: list[PatternSpec]):
        self.keys: list[str] = []
        self.named: set[str] = set()
        for s in specs:
            for k in s.keys:
                if k not in self.keys:
                    self.keys.append(k)
                if not s.positional:
                    self.named.add(k)
        self.slot = {k: i for i, k in enumerate(self.keys)}

    def p(self, k: str) -> str:
        return f"{_H}p{self.slot[k]}"

    def v(self, k: str) -> str:
        return f"{_H}v{self.slot[k]}"


def _input_value(spec: PatternSpec, st: _State, text_col: str | None, json_col: str | None) -> Column:
    if spec.input_field is None:
        if json_col is not None:
            return F.lit(None).cast("string")       # a decoded record is not a string
        return F.col(text_col)
    f = spec.input_field
    from_json = jsonv.string_member(F.col(json_col), f) if json_col is not None else F.lit(None).cast("string")
    if f in st.named:
        return F.when(F.col(st.p(f)), F.col(st.v(f))).otherwise(from_json)
    return from_json


def _apply_step(df: DataFrame, spec: PatternSpec, st: _State, text_col, json_col,
                gate: Column, done_col: str | None) -> tuple[DataFrame, Column]:
    """Run one pattern where ``gate`` holds; returns df and the 'matched' column."""
    inp = _input_value(spec, st, text_col, json_col)
    m_name, inp_name = f"{_H}m", f"{_H}in"
    others = [c for c in df.columns if c not in (m_name, inp_name)]
    if spec.needs_python:
        r_name = f"{_H}r"
        df = df.select(*others, inp.alias(inp_name))
        df = df.select(*others, F.col(inp_name),
                       F.when(gate & F.col(inp_name).isNotNull(), _py_matcher(spec)(F.col(inp_name))).alias(r_name))
        matched = F.coalesce(F.col(f"{r_name}.m"), F.lit(False))
        df = df.select(*others, F.col(r_name), matched.alias(m_name))
        vals = {k: F.col(f"{r_name}.g{j}") for j, k in enumerate(spec.keys)}
        drop = [r_name]
    else:
        df = df.select(*others, inp.alias(inp_name))
        vals = {k: F.regexp_extract(F.col(inp_name), spec.java, gi) for k, gi in zip(spec.keys, spec.group_index)}
        vals = {k: F.nullif(v, F.lit("")) if spec.null_if_empty(gi) else v for (k, v), gi in zip(vals.items(), spec.group_index)}
        told = spec.telling_key
        if told is None:
            matched = F.coalesce(gate & F.col(inp_name).rlike(spec.java), F.lit(False))
            df = df.select(*others, F.col(inp_name), matched.alias(m_name))
            drop = []
        else:
            r_name = f"{_H}r"
            df = df.select(*others, F.col(inp_name), F.when(gate, vals[told]).alias(r_name))
            df = df.select(*others, F.col(inp_name), F.col(r_name), F.coalesce(F.col(r_name) != "", F.lit(False)).alias(m_name))
            vals[told] = F.col(r_name)
            drop = [r_name]
    m = F.col(m_name)
    new_cols = {}
    for k in spec.keys:
        new_cols[st.p(k)] = (F.col(st.p(k)) | m).alias(st.p(k))
        new_cols[st.v(k)] = F.when(m, vals[k]).otherwise(F.col(st.v(k))).alias(st.v(k))
    sel = []
    for c in df.columns:
        if c in (m_name, inp_name) or c in drop:
            continue
        sel.append(new_cols.get(c, F.col(c)))
    sel.append(m.alias(m_name))
    df = df.select(*sel)
    return df, F.col(m_name)


def extract_fields(df: DataFrame, patterns, *, text_col: str | None = "event_text",
                   json_col: str | None = None, out_col: str = "fields", mode: str = "stop", where: Column | None = None) -> DataFrame:
    """Add ``out_col`` = fields found by the ordered pattern set (see module doc).

    ``text_col`` is searched by patterns without an input field; when
    ``json_col`` (VARIANT) is given the record is the decoded value instead.  Rows
    for which ``where`` does not hold are not searched and get no fields.
    """
    specs = patterns if (isinstance(patterns, list) and patterns and isinstance(patterns[0], PatternSpec)) \
        else compile_patterns(patterns)
    if mode not in ("stop", "fixpoint"):
        raise ValueError("mode must be 'stop' or 'fixpoint'")
    base_cols = list(df.columns)
    st = _State(specs)
    alive = f"{_H}alive"
    init = [F.lit(False).alias(st.p(k)) for k in st.keys] + \
           [F.lit(None).cast("string").alias(st.v(k)) for k in st.keys]
    df = df.select(*[F.col(c) for c in base_cols], *init, (F.lit(True) if where is None else F.coalesce(where, F.lit(False))).alias(alive))
    m_name = f"{_H}m"
    if mode == "stop":
        for spec in specs:
            df, m = _apply_step(df, spec, st, text_col, json_col, F.col(alive), None)
            df = df.select(*[c for c in df.columns if c not in (alive, m_name)], m.alias(alive))
    else:
        # Each pattern applies once; a pattern whose input field is absent waits
        # for a later pass.  Passes are bounded by the number of patterns.
        done = {s.name: f"{_H}d{i}" for i, s in enumerate(specs)}
        df = df.select(*df.columns, *[(~F.col(alive)).alias(d) for d in done.values()])
        for _ in range(len(specs)):
            for spec in specs:
                d = done[spec.name]
                ready = ~F.col(d)
                if spec.input_field is not None:
                    inp = _input_value(spec, st, text_col, json_col)
                    ready = ready & (inp.isNotNull() if spec.input_field not in st.named
                                     else (F.col(st.p(spec.input_field)) | inp.isNotNull()))
                df = df.select(*df.columns[:], ready.alias(f"{_H}g"))
                gate = F.col(f"{_H}g")
                df, m = _apply_step(df, spec, st, text_col, json_col, gate, None)
                df = df.select(*[F.col(c) for c in df.columns if c not in (d, m_name, f"{_H}g")],
                               (F.col(d) | F.col(f"{_H}g")).alias(d))
    # The map is a concatenation of one-entry maps, empty where a key is absent:
    # key order is first appearance and no lambda is needed (codegen stays on).
    empty = F.create_map().cast("map<string,string>")
    parts = [F.when(F.col(st.p(k)), F.create_map(F.lit(k), F.col(st.v(k)))).otherwise(empty) for k in st.keys]
    fields = F.map_concat(*parts) if len(parts) > 1 else (parts[0] if parts else empty)
    return df.select(*[F.col(c) for c in base_cols if c != out_col], fields.alias(out_col))


def extract_by_source(df: DataFrame, sets: dict[str, tuple], *, source_col: str = "source", out_col: str = "fields",
                      parse_time_col: str = "parse_time", **options) -> DataFrame:
    """Each source's own pattern set in one narrow plan: ``sets`` maps a source to ``(patterns, parse_time)``.

    Adds ``out_col`` ({} for a source without a set, or NULL) and ``parse_time_col``, the name of the field
    that holds the time (for ``with_field_time``).  ``options`` are those of ``extract_fields``.  Sources with
    equal sets share one fold.
    """
    shared: dict[tuple, list[str]] = {}
    for source, (patterns, parse_time) in sets.items():
        pairs = patterns.items() if isinstance(patterns, dict) else patterns
        shared.setdefault((tuple(map(tuple, pairs)), parse_time), []).append(source)
    base_cols = [c for c in df.columns if c not in (out_col, parse_time_col)]
    found, field = F.create_map().cast("map<string,string>"), F.lit(None).cast("string")
    for k, ((pairs, parse_time), sources) in enumerate(shared.items()):
        mine = F.col(source_col).isin(sources)
        df = extract_fields(df, list(pairs), out_col=f"{_H}set{k}", where=mine, **options)
        found = F.when(mine, F.col(f"{_H}set{k}")).otherwise(found)
        field = F.when(mine, F.lit(parse_time)).otherwise(field)
    return df.select(*[F.col(c) for c in base_cols], found.alias(out_col), field.alias(parse_time_col))
