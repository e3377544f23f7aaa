"""Vector bin packing of examples into training sequences (operator 4).

Each sequence has limits on tokens, on segments and on loss-bearing tokens.
Examples are taken in shards (a run of rows of one input partition, bounded by
tokens and rows), so the pass is narrow: no shuffle, and a lost task is simply
run again with the same result.  Inside a shard the dot-product heuristic fills one
sequence after the other: of the pieces that fit, the one whose demand has the
largest dot product with what is left of the limits; when none fits whole, one
is cut to fill the gap.  A sequence that closes short of the token limit is cut
into lengths that are powers of two, which need no padding.

Defined results: a null or empty text is one token, the end id; a null id stays null; rows that
repeat an id are packed each; other columns are ignored; an empty table gives no
rows.  A text over the limit is cut into full sequences first.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import words

END_ID = 2
#: Tokens and rows of a shard, at which it is packed (a single text may be longer).
SHARD_TOKENS = 1 << 20
SHARD_ROWS = 512
#: Words whose ids a Python worker remembers (about 200 bytes each).
REMEMBERED = 2_400_000
#: Marks that may close a word.
CLOSING = b".,!?;:"


@dataclass(frozen=True)
class Limits:
    tokens: int = 4096
    segments: int = 256
    loss_tokens: int = 4096


class WordTokenizer:
    """Ids of whole texts, as little-endian uint32 bytes, word by word.

    The vocabulary's tokenizer drops white space and never joins characters
    across it, so a text's ids are those of its words in a row.  Ids of words
    seen before are remembered.  Unknown words that are letters below U+0300
    (where normal form C changes nothing) and closing marks are taken in lower
    case and without the marks, which the tokenizer parts from letters anyway, and
    go straight to its BPE model; all others go through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers
        self.full = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.full.model)
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [chr(c) for c in range(0x41, 0x300) if chr(c).isalpha()]
        self.as_bytes = {ord(c): byte_level.pre_tokenize_str(c)[0][0] for c in letters}
        self.known: dict[bytes, bytes] = {}

    @staticmethod
    def _bytes(encodings) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in encodings]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return self._bytes(self.full.encode_batch_fast(texts, add_special_tokens=False))

    def _learn(self, new: list[bytes]) -> None:
        known = self.known
        words_, cores, other = [], [], []
        for w in new:
            core = w.lower().rstrip(CLOSING)
            if not core.isalpha():  # not ASCII letters alone
                text = core.decode().lower()
                if not text.isalpha() or max(text) >= "\u0300":
                    other.append(w)
                    continue
                core = text.encode()
            if core != w:
                words_.append(w)
                cores.append(core)
            else:
                known[w] = b""
        known.update(zip(other, self._whole([w.decode() for w in other])))
        needed = [w for w in new if known.get(w) == b""]
        needed += {c for c in cores if c not in known}
        mapped = self.bare.encode_batch_fast([c.decode().translate(self.as_bytes) for c in needed], add_special_tokens=False)
        known.update(zip(needed, self._bytes(mapped)))
        tails = list({w[len(w.rstrip(CLOSING)):] for w in words_})
        tail_ids = dict(zip(tails, self._whole([t.decode() for t in tails])))
        for w, core in zip(words_, cores):
            known[w] = known[core] + tail_ids[w[len(w.rstrip(CLOSING)):]]

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        split = [words(t) for t in texts]
        used = set(chain.from_iterable(split))
        new = [w for w in used if w not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {w: self.known[w] for w in used if w in self.known}
        if new:
            self._learn(new)
        get = self.known.__getitem__
        return [b"".join(map(get, ws)) for ws in split]


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    """One for a Python worker, which serves many tasks."""
    return WordTokenizer(path)


def pack_shard(lengths: list[int], loss_from: list[int], limits: Limits) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(example, start, length, sequence, offset)`` of one shard.

    Tokens of an example from ``loss_from`` on bear loss.
    """
    pieces: list[tuple[int, int, int, int, int]] = []
    seq = 0

    def close(bin_: list[tuple[int, int, int]]) -> None:
        """Number the sequence; short ones are cut into powers of two."""
        nonlocal seq
        total = sum(n for _, _, n in bin_)
        room = limits.tokens if total == limits.tokens else 1 << (total.bit_length() - 1)
        offset = 0
        for ex, start, n in bin_:
            while n:
                take = min(n, room - offset)
                pieces.append((ex, start, take, seq, offset))
                start, n, offset, total = start + take, n - take, offset + take, total - take
                if offset == room:
                    seq, offset = seq + 1, 0
                    room = 1 << (total.bit_length() - 1) if total else 0

    start = np.zeros(len(lengths), dtype=np.int64)
    end = np.array(lengths, dtype=np.int64)
    loss = np.clip(np.array(loss_from, dtype=np.int64), 0, end)

    def most(i: int, tokens: int, loss_tokens: int) -> int:
        """Tokens of what is left of example i that fit."""
        return int(min(tokens, end[i] - start[i], max(0, loss[i] - start[i]) + loss_tokens))

    for i in np.flatnonzero(end >= limits.tokens):
        while end[i] - start[i] >= limits.tokens:
            n = most(i, limits.tokens, limits.loss_tokens)
            close([(int(i), int(start[i]), n)])
            start[i] += n
    left = np.flatnonzero(end > start)
    caps = np.array([limits.tokens, limits.segments, limits.loss_tokens], dtype=float)
    while len(left):
        room = caps.copy()
        bin_: list[tuple[int, int, int]] = []
        while len(left) and room[0] >= 1 and room[1] >= 1:
            n = end[left] - start[left]
            need = np.stack([n, np.ones(len(left)), n - np.clip(loss[left] - start[left], 0, n)], axis=1)
            fits = (need <= room).all(axis=1)
            if fits.any():
                score = (need / caps) @ (room / caps)
                k = int(np.argmax(np.where(fits, score, -1.0)))
                take = int(n[k])
            else:  # cut the one that fills most
                part = np.minimum(np.minimum(room[0], n), np.maximum(0, loss[left] - start[left]) + room[2]).astype(np.int64)
                k = int(np.argmax(part))
                take = int(part[k])
                if take < 1:
                    break
            i = int(left[k])
            bin_.append((i, int(start[i]), take))
            room -= [take, 1, take - min(take, max(0, loss[i] - start[i]))]
            start[i] += take
            if start[i] == end[i]:
                left = np.delete(left, k)
        close(bin_)
    return pieces


def _packed(frames: Iterator[pd.DataFrame], path: str, limits: Limits) -> Iterator[pd.DataFrame]:
    tok = word_tokenizer(path)
    end = array("I", [END_ID]).tobytes()
    base = TaskContext.get().partitionId() << 40
    names: list = []
    ids: list[bytes] = []
    loss: list[int] = []
    held = 0

    def shard() -> pd.DataFrame:
        nonlocal base, names, ids, loss, held
        pieces = pack_shard([len(b) // 4 for b in ids], loss, limits)
        out = pd.DataFrame({
            "doc_id": [names[p[0]] for p in pieces], "start": [p[1] for p in pieces], "length": [p[2] for p in pieces],
            "ids_crc32": [zlib.crc32(ids[p[0]][4 * p[1]:4 * (p[1] + p[2])]) for p in pieces],
            "doc_tokens": [len(ids[p[0]]) // 4 for p in pieces],
            "sequence_id": [base + p[3] for p in pieces], "offset": [p[4] for p in pieces]})
        base += max(p[3] for p in pieces) + 1
        names, ids, loss, held = [], [], [], 0
        return out

    for f in frames:
        for k in range(0, len(f), 256):
            part = f.iloc[k:k + 256]
            for name, b, l in zip(part["id"], tok(part["text"].tolist()), part["loss_from"]):
                names.append(name)
                ids.append(b + end)
                loss.append(int(l))
                held += len(ids[-1]) // 4
                if held >= SHARD_TOKENS or len(ids) >= SHARD_ROWS:
                    yield shard()
    if ids:
        yield shard()


def pack(docs: DataFrame, tokenizer: str, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text",
         loss_from: str | None = None) -> DataFrame:
    """One row for each piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    ``tokenizer`` is the path of a tokenizer file that every executor can read.
    ``loss_from`` names a column with the number of leading tokens without loss
    (none: all tokens bear loss).
    """
    rows = docs.select(F.col(id_col).cast("long").cast("string").alias("id"), F.col(text_col).alias("text"),
                       (F.coalesce(F.col(loss_from), F.lit(0)) if loss_from else F.lit(0)).cast("long").alias("loss_from"))
    out = rows.mapInPandas(lambda fs: _packed(fs, tokenizer, limits),
                           "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
