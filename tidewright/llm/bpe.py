"""Encoding of a whole corpus with a public byte-level BPE vocabulary.

Method: corpus-level merge replay. The distinct words of a block of the corpus
are laid out as one array of byte tokens; an inverted index maps each token
pair to its positions in it; merges are applied in rank order, each to all its
positions at once, and only the neighbours touched by a merge change the index.
What a word becomes does not depend on other words, so blocks (the rows of one
Arrow batch, less the words seen before in the task) are replayed where they
lie: no shuffle, no words sent around, and a hot word is replayed once a task.

Defined results: null and empty texts give the empty list; text is neither
trimmed nor normalised; strings of special tokens are ordinary text; repeated
rows give equal rows; other columns are not carried.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the vocabulary lies; a parameter of every operator here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: The pattern that splits text before merges, as published with the rank file. Fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Words a task remembers before it starts over; results do not depend on it.
REMEMBERED = 300_000


def read_ranks(path: str = VOCABULARY) -> bytes:
    """The rank file as it is; its size is fixed (0.8 MB), so it may go to every task."""
    with open(path, "rb") as f:
        return f.read()


class Merges:
    """The ranks of a vocabulary and the replay over blocks of words."""

    def __init__(self, rank_file: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line)}
        self.text = {i: t for t, i in self.ranks.items()}
        self.byte = [self.ranks[bytes([i])] for i in range(256)]
        self.joined: dict[tuple[int, int], int] = {}

    def join(self, a: int, b: int) -> int:
        """The token a pair merges into, or -1."""
        got = self.joined.get((a, b))
        if got is None:
            got = self.joined[a, b] = self.ranks.get(self.text[a] + self.text[b], -1)
        return got

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word."""
        out: list[list[int]] = [[]] * len(words)
        token: list[int] = []
        right: list[int] = []  # position of the next token of the word, or -1
        left: list[int] = []
        starts: list[tuple[int, int]] = []
        for w, word in enumerate(words):
            whole = self.ranks.get(word)
            if whole is not None:
                out[w] = [whole]
                continue
            at = len(token)
            starts.append((w, at))
            token.extend(self.byte[c] for c in word)
            n = len(word)
            right.extend(range(at + 1, at + n))
            right.append(-1)
            left.append(-1)
            left.extend(range(at, at + n - 1))
        where: dict[int, list[tuple[int, int, int]]] = {}  # merged token -> (position, left token, right token)
        heap: list[int] = []
        joined, join = self.joined, self.join

        def note(i: int, j: int) -> None:
            a, b = token[i], token[j]
            m = joined.get((a, b))
            if m is None:
                m = join(a, b)
            if m >= 0:
                at = where.get(m)
                if at is None:
                    where[m] = [(i, a, b)]
                    heapq.heappush(heap, m)
                else:
                    at.append((i, a, b))

        for i, j in enumerate(right):
            if j >= 0:
                note(i, j)
        while heap:
            m = heapq.heappop(heap)
            for i, a, b in sorted(where.pop(m)):
                j = right[i]
                if j < 0 or token[i] != a or token[j] != b:
                    continue
                token[i], token[j] = m, -1
                k = right[i] = right[j]
                right[j] = -1
                if k >= 0:
                    left[k] = i
                    note(i, k)
                h = left[i]
                if h >= 0:
                    note(h, i)
        for w, at in starts:
            ids = []
            while at >= 0:
                ids.append(token[at])
                at = right[at]
            out[w] = ids
        return out


def _encoder(rank_file: bytes, counts_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import regex

        merges = Merges(rank_file)
        split = regex.compile(PATTERN).findall
        known: dict[str, list[int]] = {}
        for batch in batches:
            texts = batch.column(1)
            if len(known) > REMEMBERED:
                known.clear()
            # a part of the batch at a time, so that very long texts do not pile up
            for lo in range(0, batch.num_rows, 512):
                part = [split(t) if t else [] for t in texts.slice(lo, 512).to_pylist()]
                new = list({w for words in part for w in words if w not in known})
                known.update(zip(new, merges.replay([w.encode() for w in new])))
                ids = [[i for w in words for i in known[w]] for words in part]
                sizes = np.fromiter((len(x) for x in ids), np.int64, len(ids))
                first = batch.column(0).slice(lo, 512)
                if counts_only:
                    yield pa.RecordBatch.from_arrays([first, pa.array(sizes)], names=["doc_id", "n_tokens"])
                else:
                    flat = np.fromiter((i for x in ids for i in x), np.int32, int(sizes.sum()))
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))
                    yield pa.RecordBatch.from_arrays([first, lists], names=["doc_id", "ids"])

    return run


def encode(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and ids (a list of token ids) of each document."""
    return documents.select("doc_id", "text").mapInArrow(_encoder(read_ranks(vocabulary), False), "doc_id long, ids array<int>")


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and n_tokens of each document; ids never leave the task."""
    return documents.select("doc_id", "text").mapInArrow(_encoder(read_ranks(vocabulary), True), "doc_id long, n_tokens long")
