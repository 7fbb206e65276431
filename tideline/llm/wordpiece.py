"""Greedy word-piece counts by a linear longest-match automaton."""
from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tideline.llm.common import LOWER, WHITE, Prefix, byte_letters, ints, segment_sums, steps, words

#: Symbol of a word's end, behind the 256 bytes.
END = 256
SYMBOLS = 257
NONE = -1


def pieces_of(path: str) -> list[tuple[int, ...]]:
    """Symbol strings of a tokenizer file's vocabulary; a piece that ends a word has END as its last symbol."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    suffix, byte = model["end_of_word_suffix"], {c: b for b, c in enumerate(byte_letters())}
    out = []
    for token in model["vocab"]:
        body, last = (token[:-len(suffix)], (END,)) if token.endswith(suffix) else (token, ())
        if all(c in byte for c in body):
            out.append(tuple(byte[c] for c in body) + last)
    return out


class Automaton:
    """Trie of the pieces with failure links. Node v spells a string; where its matching breaks off, the longest pieces
    that greedy matching takes from that string are popped: pops[v] of them, and matching goes on in node failure[v],
    which spells what is left. failure NONE means that greedy matching cannot go on."""

    def __init__(self, pieces: list[tuple[int, ...]]):
        children: list[dict[int, int]] = [{}]
        final, parent, symbol = [False], [0], [0]
        for piece in pieces:
            v = 0
            for s in piece:
                if s not in children[v]:
                    children[v][s] = len(children)
                    children.append({})
                    final.append(False)
                    parent.append(v)
                    symbol.append(s)
                v = children[v][s]
            final[v] = True
        final[0] = False
        failure, pops = [NONE] * len(children), [0] * len(children)
        level = [0]
        while level:
            following = []
            for u in level:
                for s, v in children[u].items():
                    following.append(v)
                    if final[v]:
                        failure[v], pops[v] = 0, 1
                        continue
                    z, n = failure[u], pops[u]
                    while z != NONE and s not in children[z]:
                        n += pops[z]
                        z = failure[z]
                    if z != NONE:
                        failure[v], pops[v] = children[z][s], n
            level = following
        self.failure, self.pops = np.array(failure), np.array(pops)
        edges = sorted((u * SYMBOLS + s, v) for u, c in enumerate(children) for s, v in c.items())
        self.keys, self.targets = np.array([k for k, _ in edges]), np.array([v for _, v in edges])

    def moved(self, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        key = node * SYMBOLS + symbol
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.targets[at], NONE)

    def counts(self, buf: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Pieces of each word buf[lo:hi], NONE where greedy matching gets stuck. All words advance at once; a step reads
        one byte or follows one failure link, so that a word takes at most two steps for each byte."""
        node, at = np.zeros(len(lo), np.int64), lo.astype(np.int64)
        count, on = np.zeros(len(lo), np.int64), np.arange(len(lo))
        while len(on):
            ended = at[on] == hi[on]
            symbol = np.where(ended, END, buf[np.minimum(at[on], max(len(buf) - 1, 0))].astype(np.int64))
            to = self.moved(node[on], symbol)
            go, stay = on[to != NONE], on[to == NONE]
            node[go] = to[to != NONE]
            at[go] += 1
            count[stay] += self.pops[node[stay]]
            node[stay] = self.failure[node[stay]]
            lost = stay[node[stay] == NONE]
            count[lost] = NONE
            done = go[at[go] > hi[go]]
            self.finish(node, count, done)
            on = np.concatenate([go[at[go] <= hi[go]], stay[node[stay] != NONE]])
        return count

    def finish(self, node: np.ndarray, count: np.ndarray, done: np.ndarray) -> None:
        """Pops what is left behind the end symbol until the root."""
        while len(done):
            count[done] += self.pops[node[done]]
            node[done] = self.failure[node[done]]
            count[done[node[done] == NONE]] = NONE
            done = done[node[done] > 0]


_AUTOMATA: dict[str, Automaton] = {}


def automaton(path: str) -> Automaton:
    """Built once in each Python worker from the vocabulary file."""
    if path not in _AUTOMATA:
        _AUTOMATA[path] = Automaton(pieces_of(path))
    return _AUTOMATA[path]


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown (words that greedy matching cannot spell, one token each) and max_word_tokens.

    Words are runs of bytes other than ASCII white space, with A-Z lower-cased. A null or empty text has no words and 0
    everywhere; repeated rows are counted each; a null doc_id stays null; other columns are ignored. Equal words of a
    task's step are matched once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = automaton(vocabulary)
        for batch, buf, offs in steps(batches, "text"):
            buf = LOWER[buf]
            lo, hi, at = words(buf, offs, WHITE)
            _, one, which = np.unique(Prefix(buf).of(lo, hi), return_index=True, return_inverse=True)
            n = matcher.counts(buf, lo[one], hi[one])[which] if len(lo) else np.zeros(0, np.int64)
            unknown, n = (n < 0).astype(np.int64), np.abs(n)
            most = [int(n[a:b].max()) if b > a else 0 for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([ints(batch, "doc_id"), pa.array(np.diff(at)), pa.array(segment_sums(n, at)), pa.array(segment_sums(unknown, at)), pa.array(most, pa.int64())],
                                             ["doc_id", "n_words", "n_tokens", "n_unknown", "max_word_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_words bigint, n_tokens bigint, n_unknown bigint, max_word_tokens bigint")
