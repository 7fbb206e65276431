"""Hierarchical multi-length packing of token ids."""
from __future__ import annotations

import bisect
import os
import re
import threading
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tideline.llm.common import STEP_BYTES, byte_letters, ints, steps

#: Word cache of a Python worker; it starts anew when it is full.
CACHE_WORDS = 1_200_000
#: Seconds without a task after which a worker gives its cache back, as workers live on into steps that have no use for it.
IDLE_S = 3
#: Words that normalise by lower-casing alone and that the tokenizer splits into their letters and their other characters.
PLAIN = re.compile(r"([a-z\xdf-\xf6\xf8-\xff]+)([!-&(-/:-@\[-`{-~]*)")
SCHEMA = ("doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, "
          "sequence_tokens bigint, tier int, step_group bigint")


class WordEncoder:
    """Token ids of texts, word by word. White space never enters a token of this vocabulary, so a text's ids are
    those of its words one after the other. Plain words skip the normaliser and the splitting pattern."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.cache, self.parts = Tokenizer.from_file(path), {}, {}
        self.letters = dict(enumerate(byte_letters()))
        self.timer: threading.Timer | None = None

    def work(self) -> None:
        """A task begins."""
        if self.timer is not None:
            self.timer.cancel()

    def rest(self, seconds: float = IDLE_S) -> None:
        """A task has ended."""
        self.work()
        self.timer = threading.Timer(seconds, self.forget)
        self.timer.daemon = True
        self.timer.start()

    def forget(self) -> None:
        self.cache, self.parts = {}, {}

    def part(self, text: str) -> bytes:
        """Ids of a piece that the pattern leaves whole."""
        shown = text.encode("utf-8").decode("latin-1").translate(self.letters)
        return np.array([t.id for t in self.tokenizer.model.tokenize(shown)], "<u4").tobytes()

    def word(self, raw: bytes) -> bytes:
        plain = PLAIN.fullmatch(raw.decode("utf-8").lower())
        if plain is None:
            return np.array(self.tokenizer.encode(raw.decode("utf-8"), add_special_tokens=False).ids, "<u4").tobytes()
        rest, parts = plain[2], self.parts
        if rest not in parts:
            if len(parts) > 50_000:
                parts.clear()
            parts[rest] = self.part(rest) if rest else b""
        return self.part(plain[1]) + parts[rest]

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        split = [t.split() for t in texts]
        cache = self.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        for w in set().union(*split):
            if w not in cache:
                cache[w] = self.word(w)
        return [b"".join(map(cache.__getitem__, ws)) for ws in split]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One per Python worker: tasks that follow at once find its cache warm; ids don't depend on it."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


class Packer:
    """Fills sequences of exactly the tiers' lengths. A piece opens a sequence of the smallest tier that holds it; the
    gap takes the longest pieces that fit from shorter tiers, and the last gap takes the head of a cut piece."""

    def __init__(self, tiers: list[int], step_tokens: int, part: int):
        self.tiers, self.step_tokens = sorted(tiers), step_tokens
        self.top = self.tiers[-1]
        self.pool: list[tuple] = []  # (length, order, doc, start, ids, doc_tokens), ascending
        self.base, self.sequences, self.order = part << 40, 0, 0
        self.groups: list[list[int]] = []  # open step groups: [room, number]
        self.made_groups = 0
        self.out: list[tuple] = []

    def put(self, doc, start: int, ids: bytes, doc_tokens: int) -> None:
        if ids:
            self.order += 1
            bisect.insort(self.pool, (len(ids) // 4, self.order, doc, start, ids, doc_tokens))

    def add(self, doc, ids: bytes) -> None:
        n, at = len(ids) // 4, 0
        while n - at >= self.top:
            self.emit([(self.top, 0, doc, at, ids[4 * at:4 * (at + self.top)], n)], self.top)
            at += self.top
        self.put(doc, at, ids[4 * at:], n)

    def step_group(self, size: int) -> int:
        """The fullest open group with room, so that groups hold equally many tokens."""
        fit = min((g for g in self.groups if g[0] >= size), default=None)
        if fit is None:
            self.made_groups += 1
            self.groups.append(fit := [max(self.step_tokens, size), self.made_groups - 1])
        fit[0] -= size
        if not fit[0]:
            self.groups.remove(fit)
        return self.base + fit[1]

    def emit(self, pieces: list[tuple], size: int) -> None:
        group, at = self.step_group(size), 0
        for n, _, doc, start, ids, total in pieces:
            self.out.append((doc, start, n, ids, total, self.base + self.sequences, at, size, size, group))
            at += n
        self.sequences += 1

    def head(self, piece: tuple, room: int) -> tuple:
        """The piece, or its first `room` tokens while the others go back."""
        n, _, doc, start, ids, total = piece
        if n <= room:
            return piece
        self.put(doc, start + room, ids[4 * room:], total)
        return room, 0, doc, start, ids[:4 * room], total

    def take(self, room: int) -> tuple:
        """The longest piece of at most `room` tokens, else the head of the shortest one."""
        at = bisect.bisect_right(self.pool, (room, self.order + 1))
        return self.head(self.pool.pop(max(at - 1, 0)), room)

    def close(self) -> None:
        """Packs tier by tier, longest first; what cannot fill a sequence of the shortest tier stays in the pool."""
        left = sum(p[0] for p in self.pool)
        for tier in reversed(self.tiers):
            shorter = max((t for t in self.tiers if t < tier), default=0)
            while left >= tier and self.pool and self.pool[-1][0] > shorter:
                pieces, room = [self.head(self.pool.pop(), tier)], tier
                room -= pieces[0][0]
                while room:
                    pieces.append(self.take(room))
                    room -= pieces[-1][0]
                self.emit(pieces, tier)
                left -= tier

    def finish(self) -> None:
        """The rest, under one sequence of the shortest tier or a few longer pieces, in sequences of its binary digits."""
        left, size = sum(p[0] for p in self.pool), self.top
        while left:
            if left < size:
                size //= 2
                continue
            pieces, room = [], size
            while room:
                pieces.append(self.take(room))
                room -= pieces[-1][0]
            self.emit(pieces, size)
            left -= size


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, tiers: tuple[int, ...] = (256, 512, 1024, 2048), step_tokens: int = 16_384) -> DataFrame:
    """Pieces of every document in sequences of the tiers' lengths (powers of two), with their ids.

    A document's ids are its text's plus `end_id`; a null or empty text has that id alone, a null doc_id stays null,
    repeated rows are packed as often as they occur, an empty table gives no rows, and other columns are ignored. Every
    input partition is packed by its own task and needs no shuffle; sequence and step-group numbers carry the
    partition's number, so a task that runs again after a lost executor gives the same rows. All sequences are full.
    The rest of a task is laid out in powers of two below the shortest tier. `step_group` balances sequences into
    groups of `step_tokens` tokens.
    """
    if any(t & (t - 1) for t in tiers):
        raise ValueError("tiers must be powers of two")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(tokenizer), Packer(list(tiers), step_tokens, TaskContext.get().partitionId())

        def rows():
            out, packer.out = packer.out, []
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            for at in range(0, len(out), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[at:at + 2000]), kinds)], names)

        encode.work()
        try:
            for batch, buf, offs in steps(batches, "text", STEP_BYTES):
                raw = buf.tobytes()
                for doc, ids in zip(ints(batch, "doc_id").to_pylist(), encode([raw[a:b] for a, b in zip(offs, offs[1:])])):
                    packer.add(doc, ids + end)
                packer.close()
                yield from rows()
            packer.finish()
            yield from rows()
        finally:
            encode.rest()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
