"""Benchmark decontamination by a distributed positional inverted index.

``build_index`` makes the index of the training documents, a table to be stored (``contamination`` keeps it in the
checkpoint folder).  One row is a segment, some documents of at most ``SEGMENT_WORDS`` words (or one longer one): its distinct words, and for each
word the list of its places, where the words of the segment's documents are numbered
in a row with a gap between documents.  Building is narrow: nothing is shuffled.

``matches`` searches for test items.  Their texts go to the tasks in passes of at most
``PASS_WORDS`` words, so what is broadcast is bounded; a further pass reads the index
again, not the texts.  In a segment each window of ``size`` item words starts from the list
of its rarest word there; the list, adjusted by the word's offset, gives the places where the window may begin, and is
intersected with the adjusted lists of the other words, from rare to frequent.
What is left are exact phrase matches.  The lists are joined through the table
place -> word that they make up, so an intersection costs one look-up a candidate.

A proximity match of an item is an occurrence of its rarest word (in the segment) that has each of the item's
``near_words`` rarest distinct words at most ``within`` words away, in any order.

Words are runs of digits, letters and all characters beyond ASCII, with A-Z in lower
case.  Defined results: a null or empty text has no words; a null id is kept; rows
that repeat an id are documents of their own; items that share an id are one
item, a null item id counts as an empty one; an item without words matches nothing; empty
tables give no matches; other columns are not read.  A text of any length is indexed whole.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, count

import numpy as np
import pandas as pd
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import kept_table

SIZE = 10
#: Words of a segment, which bounds its row to less than a megabyte.
SEGMENT_WORDS = 1 << 16
#: Unused places between two documents; proximity reaches less far.
GAP = 64
WITHIN = 20
NEAR_WORDS = 4
#: Item words of a pass (about 100 bytes each in a task).
PASS_WORDS = 1 << 20
#: Candidates that a task checks at a time.
CANDIDATES = 1 << 20
_ORDINARY = bytes(c for c in range(128) if chr(c).isalnum())
#: A-Z in lower case, every other ASCII character that is no word character a blank.
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 128 or c in _ORDINARY else 0x20 for c in range(256))

INDEX = "segment long, doc_ids array<string>, starts binary, n_words array<int>, words binary, list_sizes binary, places binary"
FOUND = "segment long, doc int, item string, kind string, start int, end int"


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


def packed(numbers: np.ndarray) -> bytes:
    return numbers.astype("<u4").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u4").astype(np.int64)


def segment(number: int, ids: list, texts: list[list[bytes]]) -> dict:
    """The index row of some documents, given as words."""
    known: dict[bytes, int] = defaultdict(count().__next__)
    n_words = np.array([len(ws) for ws in texts], dtype=np.int64)
    of = np.fromiter(map(known.__getitem__, chain.from_iterable(texts)), np.int32, int(n_words.sum()))
    starts = np.cumsum(n_words + GAP) - n_words - GAP
    at = np.arange(len(of)) + np.repeat(np.arange(len(texts)) * GAP, n_words)
    return {"segment": number, "doc_ids": ids, "starts": packed(starts), "n_words": n_words.tolist(), "words": b" ".join(known),
            "list_sizes": packed(np.bincount(of, minlength=len(known))), "places": packed(at[np.argsort(of, kind="stable")])}


def _segments(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    number = TaskContext.get().partitionId() << 32
    ids, texts, held = [], [], 0
    for f in frames:
        for doc_id, text in zip(f["doc_id"], f["text"]):
            ws = words(text)
            if texts and held + len(ws) > SEGMENT_WORDS:
                yield pd.DataFrame([segment(number, ids, texts)])
                number, ids, texts, held = number + 1, [], [], 0
            ids.append(doc_id)
            texts.append(ws)
            held += len(ws) + GAP
    if texts:
        yield pd.DataFrame([segment(number, ids, texts)])


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index, ids as text."""
    return docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(_segments, INDEX)


def documents_of(index: DataFrame) -> DataFrame:
    """``(segment, doc, doc_id, n_words)`` of all indexed documents."""
    return index.select("segment", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("doc", "x")) \
        .select("segment", "doc", F.col("x.doc_ids").alias("doc_id"), F.col("x.n_words").cast("long").alias("n_words"))


class Items:
    """Test items of a pass: their words' numbers, and their windows in arrays by length."""

    def __init__(self, rows: list[tuple[str, list[bytes]]], size: int):
        self.vocabulary: dict[bytes, int] = defaultdict(count().__next__)
        self.names = [name for name, _ in rows]
        self.words = [np.fromiter(map(self.vocabulary.__getitem__, ws), np.int32, len(ws)) for _, ws in rows]
        self.vocabulary = dict(self.vocabulary)
        by_size = defaultdict(list)
        for k, ws in enumerate(self.words):
            n = min(size, len(ws))
            if n:
                windows = np.lib.stride_tricks.sliding_window_view(ws, n)
                by_size[n].append((np.full(len(windows), k, dtype=np.int32), windows))
        self.windows = [(n, np.concatenate([x for x, _ in got]), np.concatenate([x for _, x in got])) for n, got in by_size.items()]


class Segment:
    """A segment's lists of the items' words."""

    def __init__(self, row, items: Items):
        known = row.words.split(b" ") if row.words else []
        sizes = unpacked(row.list_sizes)
        as_item_word = np.array([items.vocabulary.get(w, -1) for w in known], dtype=np.int32)
        places = unpacked(row.places)
        self.starts = unpacked(row.starts)
        self.end = int(places.max(initial=-1)) + 1
        self.word_at = np.full(self.end + GAP, -1, dtype=np.int32)
        self.word_at[places] = np.repeat(as_item_word, sizes)
        self.places = places
        self.list_size = np.zeros(len(items.vocabulary), dtype=np.int64)
        self.list_start = np.zeros(len(items.vocabulary), dtype=np.int64)
        mine = as_item_word >= 0
        self.list_size[as_item_word[mine]] = sizes[mine]
        self.list_start[as_item_word[mine]] = (np.cumsum(sizes) - sizes)[mine]

    def lists(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words' lists, one list after the other, and the row of ``which`` that each belongs to."""
        n = self.list_size[which]
        row = np.repeat(np.arange(len(which)), n)
        return self.places[self.list_start[which][row] + np.arange(len(row)) - (np.cumsum(n) - n)[row]], row

    def phrases(self, size: int, windows: np.ndarray, candidates: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (window, first place) of all exact occurrences, for bounded numbers of candidates at a time."""
        lengths = self.list_size[windows]
        there = np.flatnonzero(lengths.min(axis=1) > 0)
        order = np.argsort(lengths[there], axis=1, kind="stable")
        rarest = lengths[there, order[:, 0]] if len(there) else np.empty(0, np.int64)
        chunk = np.cumsum(rarest) // candidates
        for c in np.unique(chunk):
            mine = np.flatnonzero(chunk == c)
            at, row = self.lists(windows[there[mine], order[mine, 0]])
            begin, row = at - order[mine, 0][row], mine[row]
            ok = (begin >= 0) & (begin + size <= self.end)
            begin, row = begin[ok], row[ok]
            for rank in range(1, size):
                offset = order[row, rank]
                ok = self.word_at[begin + offset] == windows[there[row], offset]
                begin, row = begin[ok], row[ok]
            yield there[row], begin

    def near(self, ws: np.ndarray, within: int, near_words: int) -> np.ndarray:
        """Places of the rarest word with the next rarest ones at most ``within`` words away."""
        distinct = np.unique(ws)
        distinct = distinct[np.argsort(self.list_size[distinct], kind="stable")][:near_words]
        if not len(distinct) or not self.list_size[distinct].min():
            return np.empty(0, np.int64)
        at = self.lists(distinct[:1])[0]
        for w in distinct[1:]:
            other = self.lists(np.array([w]))[0]
            after = np.searchsorted(other, at - within)
            at = at[(after < len(other)) & (other[np.minimum(after, len(other) - 1)] <= at + within)]
        return at


def merged(item: np.ndarray, doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Overlapping or touching spans of an item in a document made one."""
    order = np.lexsort((begin, doc, item))
    item, doc, begin, end = item[order], doc[order], begin[order], end[order]
    new = np.ones(len(item), dtype=bool)
    new[1:] = (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]) | (begin[1:] > end[:-1])   # all windows of an item have one length
    first = np.flatnonzero(new)
    return item[first], doc[first], begin[first], np.maximum.reduceat(end, first) if len(first) else end


def _search(items: Broadcast, within: int | None, near_words: int, candidates: int) -> Callable[[Iterable[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        its: Items = items.value
        names = np.array(its.names, dtype=object)
        for f in frames:
            for row in f.itertuples():
                seg = Segment(row, its)
                found = [(its_of[w], at, at + n) for n, its_of, windows in its.windows for w, at in seg.phrases(n, windows, candidates)]
                yield from rows(seg, row.segment, names, "phrase", found)
                if within is not None:
                    near = [(k, seg.near(ws, within, near_words)) for k, ws in enumerate(its.words)]
                    yield from rows(seg, row.segment, names, "near", [(np.full(len(at), k), at, at + 1) for k, at in near if len(at)])

    def rows(seg: Segment, number: int, names: np.ndarray, kind: str, found: list) -> Iterator[pd.DataFrame]:
        if sum(len(x[0]) for x in found):
            item, begin, end = (np.concatenate([x[i] for x in found]) for i in range(3))
            doc = np.searchsorted(seg.starts, begin, side="right") - 1
            item, doc, begin, end = merged(item, doc, begin - seg.starts[doc], end - seg.starts[doc])
            yield pd.DataFrame({"segment": number, "doc": doc, "item": names[item], "kind": kind, "start": begin, "end": end})

    return run


def _passes(items: DataFrame, size: int, pass_words: int) -> Iterator[Items]:
    """The items in passes of about ``pass_words`` words; a pass alone comes to the driver at a time."""
    sized = kept_table(items.select(F.coalesce(F.col("item").cast("string"), F.lit("")).alias("item"), "text")
                       .withColumn("_bytes", F.coalesce(F.octet_length("text"), F.lit(0))))
    total = sized.agg(F.sum("_bytes")).first()[0] or 0
    n = 1 + total // (2 * pass_words)   # a word and its mark have two bytes at least
    for k in range(n):
        got = sized.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).collect()
        rows = sorted((r["item"], words(r["text"])) for r in got)
        if any(ws for _, ws in rows):
            yield Items(rows, size)


def matches(index: DataFrame, items: DataFrame, *, item_col: str = "item_id", text_col: str = "text", size: int = SIZE,
            within: int | None = WITHIN, near_words: int = NEAR_WORDS, pass_words: int = PASS_WORDS, candidates: int = CANDIDATES) -> DataFrame:
    """``(segment, doc, item, kind, start, end)``: spans of words, from 0, ``end`` exclusive, that exact windows of an item
    cover (``kind`` ``phrase``, overlapping ones made one), and rarest words with the others near (``near``; none if ``within`` is None)."""
    if within is not None and within >= GAP:
        raise ValueError(f"within has to be below {GAP}")
    spark = index.sparkSession
    out = spark.createDataFrame([], FOUND)
    for part in _passes(items.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")), size, pass_words):
        shared = spark.sparkContext.broadcast(part)
        out = out.unionByName(index.select("segment", "starts", "words", "list_sizes", "places").mapInPandas(_search(shared, within, near_words, candidates), FOUND))
    return out


def contamination(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Per document: its words, how many of them lie in an exact window of an item, and the items found."""
    index = kept_table(build_index(docs))
    found = kept_table(matches(index, items, within=None, **options))
    before = Window.partitionBy("segment", "doc").orderBy("start", "end", "item").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0))), F.lit(0))
    hits = found.select("segment", "doc", "item", new.alias("new")).groupBy("segment", "doc").agg(
        F.sum("new").cast("long").alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items"))
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return documents_of(index).join(hits, ["segment", "doc"], "left").select(
        F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ",").cast("binary"), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"))
