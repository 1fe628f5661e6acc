"""Token counts by a linear longest-match automaton.

The vocabulary is a trie over bytes.  A node that spells a piece has the failure
link "root, one piece popped"; any other node inherits links from its parent's,
adding up the pieces popped on the way.  A word is then counted in one left-to-
right pass: follow edges, and where there is none, add the popped count and take
the failure link - greedy longest-match counts without building a piece and
without backing up.  New words of a batch walk the automaton together, one byte
position at a time, with numpy; counts of seen words come from a bounded memo.

Words are ``[^\\x20\\x09-\\x0D]+`` with the vocabulary's word-start mark (a space
byte) in front.  Defined cases: NULL and empty text count 0; a word the
vocabulary cannot spell counts one piece; repeated rows are counted each; empty
table: no rows; other columns are not read.
"""

from __future__ import annotations

import json
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from driftkit.llm.common import map_batches, slices, utf8

MEMO_WORDS = 150_000
SLICE_BYTES = 4 << 20


def byte_alphabet() -> dict[str, int]:
    """Byte-level vocabularies print bytes as characters: printable Latin-1 as it
    is, the others, in order, from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def vocabulary_pieces(path: str) -> list[bytes]:
    """Pieces of a byte-level vocabulary file, special tokens left out."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special, back = {t["content"] for t in spec["added_tokens"]}, byte_alphabet()
    return [bytes(back[c] for c in piece) for piece in spec["model"]["vocab"] if piece not in special]


class Automaton:
    def __init__(self, pieces: list[bytes]):
        children, ends = [{}], [False]
        for piece in pieces:
            node = 0
            for b in piece:
                nxt = children[node].get(b)
                if nxt is None:
                    nxt = children[node][b] = len(children)
                    children.append({})
                    ends.append(False)
                node = nxt
            ends[node] = bool(piece)
        link, popped = [-1] * len(children), [0] * len(children)  # link -1: no match can go on
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for b, v in children[u].items():
                queue.append(v)
                if ends[v]:
                    link[v], popped[v] = 0, 1
                    continue
                z, count = link[u], popped[u]
                while z >= 0 and b not in children[z]:
                    count += popped[z]
                    z = link[z]
                if z >= 0:
                    link[v], popped[v] = children[z][b], count
        self.link, self.popped = np.array(link), np.array(popped)
        edges = sorted((u << 8 | b, v) for u, kids in enumerate(children) for b, v in kids.items())
        self.edge, self.target = (np.array(x, np.int64) for x in (zip(*edges) if edges else ([], [])))

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Target of each edge, -1 where there is none."""
        if not len(self.edge):
            return np.full(len(state), -1)
        key = state << 8 | byte
        at = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
        return np.where(self.edge[at] == key, self.target[at], -1)

    def count(self, words: list[bytes]) -> np.ndarray:
        """Greedy longest-match piece counts; 1 for a word that cannot be spelled."""
        order = sorted(range(len(words)), key=lambda i: -len(words[i]))
        lengths = np.array([len(words[i]) for i in order])
        flat = np.frombuffer(b"".join(words[i] for i in order), np.uint8).astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        state, total, lost = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.zeros(len(words), bool)

        def fail(todo: np.ndarray) -> np.ndarray:
            total[todo] += self.popped[state[todo]]
            state[todo] = self.link[state[todo]]
            dead = state[todo] < 0
            lost[todo[dead]] = True
            state[todo[dead]] = 0
            return todo[~dead]

        for p in range(int(lengths[0]) if len(words) else 0):
            todo = np.arange(np.searchsorted(-lengths, -p, side="left"))  # longest first: those that have byte p
            todo = todo[~lost[todo]]
            while len(todo):
                nxt = self.step(state[todo], flat[starts[todo] + p])
                state[todo[nxt >= 0]] = nxt[nxt >= 0]
                todo = fail(todo[nxt < 0])
        todo = np.flatnonzero(~lost & (state != 0))
        while len(todo):  # what is left open pops until the root
            todo = fail(todo)
            todo = todo[state[todo] != 0]
        out = np.empty(len(words), np.int64)
        out[order] = np.where(lost, 1, total)
        return out


@lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    return Automaton(vocabulary_pieces(path))


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_words, n_tokens."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        machine, memo = automaton(vocabulary), _MEMOS.setdefault(vocabulary, {})
        n_words, n_tokens = [], []
        for texts in slices(utf8(batch.column("text")), SLICE_BYTES):
            split = [t.split() if t else [] for t in texts]
            if len(memo) > MEMO_WORDS:
                memo.clear()
            new = list(set().union(*split) - memo.keys())
            memo.update(zip(new, machine.count([b" " + w for w in new]).tolist()))
            n_words += map(len, split)
            n_tokens += [sum(map(memo.__getitem__, words)) for words in split]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    slim = docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text")
    return map_batches(slim, "doc_id long, n_words long, n_tokens long", work)


_MEMOS: dict[str, dict] = {}
