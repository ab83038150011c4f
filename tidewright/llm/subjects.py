"""Subject areas of each document: none, one or several.

Method: normalised document vectors (hashed words and word pairs, weighted by
inverse document frequency) are clustered by bisecting k-means. The words that
tell a leaf from the corpus are its discriminative terms; they are matched with
the terms of the subjects (those that labelled documents, titles and scope notes
hold more than others), which labels each leaf with a mixture of subjects. The
leaves' words, weighted by these mixtures, are the first weights of a mixture
over sentences, and a leaf's mixture is the prior of the sentences of its
documents. Readers' labels calibrate the weights by expectation maximisation in
which a labelled document's sentences may only treat its own subjects or none. A
document treats each subject that a fifth of its sentences are about.

What is fitted on what: document frequencies, vectors, clusters, leaf terms and
subject terms cover all documents and labels. The sentence weights are
calibrated on a bounded sample of labelled documents (``LABELLED``, the first by
a hash of doc_id), each with all of its sentences. All documents are scored,
over their whole texts.

Distribution: no shuffle of texts; two passes over them (term lists, scoring)
and passes over 128-byte vectors for the clusters. Sums of a pass are added up
by key before the driver gets them (leaves x 129 numbers, leaves and subjects x
8,192 counts). Vectors and centres are whole numbers and their sums exact, so
the leaves do not depend on files, partitions or batches. The model is a
fixed-size array (65,536 x subjects) sent with the task. Hashes are computed for
a whole Arrow batch at once.

Defined results: null, empty and blank texts, and texts of tables, dumps and
code only, treat no subject; equal texts get equal subjects; labels of unknown
documents or subjects are ignored; without any label there are no rows; more
than ``SUBJECTS`` subjects are an error.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewright.session import small, stage

#: Labelled documents the sentence weights are calibrated on, each with all of its sentences.
LABELLED = 2000

#: Share of a document's sentences that must be about a subject.
TREATS = 0.2

#: Size of document vectors, of term weights, of leaf terms; most subjects.
DIM, TERMS, WORDS, SUBJECTS = 128, 1 << 16, 1 << 13, 1000

#: Leaves for each subject, and the fewest documents a leaf is split from.
LEAVES_A_SUBJECT, SPLITTABLE = 8, 8

#: Discriminative terms of a leaf, and labelled documents that a title and scope note count as.
TELLING, TITLE = 60, 20.0

#: Weight of the leaf's mixture beside the terms; first score of "about nothing" beside the leaves' words;
#: rounds of calibration, and those of them on all terms.
LEAF_WEIGHT, START, ROUNDS, FULL = 0.5, -0.5, 12, 3

NONE = "none"

# ---- text to sentences -------------------------------------------------------------------------

_TAG = re.compile(r"</?([a-zA-Z]{1,10})\b[^<>]{0,300}>")
_HIDDEN = re.compile("[­​-‏⁠﻿]")
_END = re.compile(r"(?<=[.!?…)])\s+")
#: What ends in a full stop without ending a sentence, with one blank: "Item AB-12.", "On 3.4."; besides it "no.".
_OPEN = re.compile(r"(?:[^\W\d_]{3,12} [a-z]{2}-[\w/.-]*\.|[^\W\d_]{2,5} [0-9]{1,2}\.[0-9]{1,2}\.)$", re.I)
_NUMBER = re.compile(r"\bno\.$", re.I)
_MOJIBAKE = re.compile("[\u00c2-\u00f4][^\\x00-\x7f]+|[\u00c2-\u00f4]\u00ad")
_ENTITY = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " "}


def _decoded_again(m: re.Match) -> str:
    """A run of characters as the UTF-8 it was before it was read byte by byte, if it was."""
    raw = bytearray()
    for c in m[0]:
        try:
            raw += c.encode("latin-1") if ord(c) < 256 else c.encode("cp1252")
        except UnicodeError:
            return m[0]
    try:
        return raw.decode("utf-8")
    except UnicodeError:
        return m[0]


def mended(text: str) -> str:
    """Text without markup and invisible characters, decoded once more if it was decoded wrongly."""
    if not text.isascii():
        text = _MOJIBAKE.sub(_decoded_again, text)
    if "<" in text:
        text = _TAG.sub(lambda m: "\n" if m[1].lower() in ("br", "p", "li", "div", "tr", "ul", "ol", "h1", "h2", "h3") else " ", text)
    if "&" in text:
        for a, b in _ENTITY.items():
            text = text.replace(a, b)
    if not text.isascii():
        text = _HIDDEN.sub("", unicodedata.normalize("NFKC", text))
    return text


def _goes_on(held: str) -> bool:
    return held.count(" ") == 1 and _OPEN.match(held) is not None or held[-3:].lower() == "no." and _NUMBER.search(held, max(len(held) - 4, 0)) is not None


def sentences(text: str | None) -> list[str]:
    """Sentences of a text; tables, code blocks, dumps and lone words are none."""
    if not text:
        return []
    text = mended(text)
    one_case = text == text.lower() or text == text.upper()
    out, code = [], False
    for line in text.splitlines():
        line = line.strip()
        if line.startswith("```"):
            code = not code
            continue
        if code or "\t" in line or line.startswith("|"):
            continue
        line = line.strip("-*>• ")
        if " " not in line:
            continue
        held = ""
        parts = _END.split(line)
        for i, p in enumerate(parts):
            held = f"{held} {p}" if held else p
            if i + 1 < len(parts):
                nxt = parts[i + 1]
                if nxt.startswith("(") and not nxt[1:2].isupper() or _goes_on(held) or (not one_case and nxt[:1].islower()):
                    continue
            if " " in held:
                out.append(held)
            held = ""
    return out


_WORD = re.compile(r"[^\W_]")
_DIGITS = re.compile(r"[0-9]+")

# ---- hashes of many sentences at once ----------------------------------------------------------

_KIND = np.zeros(0x110000, np.int8)  # of a character: 0 not looked up yet, 1 of a word, 2 other
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(h: np.ndarray) -> np.ndarray:
    """63-bit hashes whose bits all depend on all bits of ``h``."""
    h = (h ^ (h >> np.uint64(30))) * _M2
    h = (h ^ (h >> np.uint64(27))) * _M3
    return ((h ^ (h >> np.uint64(31))) >> np.uint64(1)).astype(np.int64)


def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.full(max(n, 1), _M1))


@dataclass
class Hashes:
    """Hashes and the sentence each belongs to: of words, of pairs of words, of runs of five characters."""

    word: np.ndarray
    of_word: np.ndarray
    pair: np.ndarray
    of_pair: np.ndarray
    run: np.ndarray
    of_run: np.ndarray


def hashes(lines: list[str], runs: bool = True) -> Hashes:
    """Case does not count, a number counts as 0, and what is no letter or digit separates words."""
    text = _DIGITS.sub("0", "\n".join(lines).lower())
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    new = _KIND[code] == 0
    if new.any():
        for c in np.unique(code[new]).tolist():
            _KIND[c] = 1 if _WORD.match(chr(c)) else 2
    inside = np.concatenate([[False], _KIND[code] == 1, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, size = edge[0::2], edge[1::2] - edge[0::2]
    none = np.zeros(0, np.int64)
    if not len(start):
        return Hashes(none, none, none, none, none, none)
    line = np.searchsorted(np.flatnonzero(code == 10), start)
    chars = code[inside[1:-1]].astype(np.uint64)
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    raw = np.add.reduceat(chars * _powers(int(size.max()))[np.arange(len(chars)) - np.repeat(first, size)], first)
    word = _mixed(raw)
    next_to = np.flatnonzero(line[1:] == line[:-1])
    pair = _mixed(raw[next_to] * _M3 + raw[next_to + 1] + np.uint64(1))
    run, of_run = none, none
    if runs:
        # " one two three four " of each line; the blank before the next line closes this one
        seq = np.full(len(chars) + len(size) + 5, 32, np.uint64)
        seq[np.arange(len(chars)) + np.repeat(np.arange(len(size)) + 1, size)] = chars
        of = np.concatenate([np.repeat(line, size + 1), np.full(5, -1)])
        lead = np.zeros(len(seq), bool)
        lead[(first + np.arange(len(size)))[np.concatenate([[True], line[1:] != line[:-1]])]] = True
        lead[len(chars) + len(size)] = True
        n = len(seq) - 4
        # the fifth character is of the same line or the blank that closes it
        fits = ((of[4:] == of[:n]) | (lead[4:] & (of[3 : n + 3] == of[:n]))) & (of[:n] >= 0)
        p = _powers(5)
        at = np.flatnonzero(fits)
        run = _mixed(sum(seq[at + k] * p[k] for k in range(5)) + np.uint64(2))
        of_run = of[at]
    return Hashes(word, line, pair, line[next_to], run, of_run)


def pieces(lines: list[str], characters: int = 250_000) -> Iterator[tuple[int, int]]:
    """Ranges of lines that are hashed at once: of at most so many characters, or one line."""
    a, total = 0, 0
    for i, s in enumerate(lines):
        if i > a and total + len(s) > characters:
            yield a, i
            a, total = i, 0
        total += len(s)
    if a < len(lines):
        yield a, len(lines)


def picked_sums(columns: np.ndarray, pick: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """(n, columns): sums of columns[:, pick] by key, which does not fall; a column at a time, so that each stays in the cache."""
    out = np.zeros((n, len(columns)), columns.dtype)
    if len(key):
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        rows = key[first]
        for j, c in enumerate(columns):
            out[rows, j] = np.add.reduceat(c.take(pick), first)
    return out


# ---- document vectors --------------------------------------------------------------------------

_TABLE = 1 << 14


def _distinct(lines: list[str], doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, sizes, words, sizes): 31-bit hashes of the distinct words and pairs, and distinct words below WORDS, of each document."""
    words, pairs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in pieces(lines):
        h = hashes(lines[a:b], runs=False)
        words.append(doc[a:b][h.of_word] << 31 | h.word & 0x7FFFFFFF)
        pairs.append(doc[a:b][h.of_pair] << 31 | h.pair & 0x7FFFFFFF)
    words, pairs = np.unique(np.concatenate(words)), np.unique(np.concatenate(pairs))
    of = np.concatenate([words, pairs]) >> 31
    order = np.argsort(of, kind="stable")
    t = (np.concatenate([words, pairs]) & 0x7FFFFFFF)[order]
    w = np.unique((words >> 31) * WORDS + (words & (WORDS - 1)))
    return t, np.bincount(of, minlength=docs), w % WORDS, np.bincount(w // WORDS, minlength=docs)


def word_number(h: Hashes) -> np.ndarray:
    return h.word & (WORDS - 1)


def _sentences_of(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """(sentences, document of each) of a batch of texts."""
    lists = [sentences(t) for t in texts]
    return [s for x in lists for s in x], np.repeat(np.arange(len(lists)), [len(x) for x in lists])


def _parts(batch: pa.RecordBatch, characters: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most so many bytes of text, or one text."""
    size = np.array([len(t or "") for t in batch.column(batch.schema.get_field_index("text")).to_pylist()])
    a, total = 0, 0
    for i, n in enumerate(size.tolist()):
        if i > a and total + n > characters:
            yield batch.slice(a, i - a)
            a, total = i, 0
        total += n
    if a < len(size):
        yield batch.slice(a)


def term_lists(documents: DataFrame) -> DataFrame:
    """doc_id, t (hashes of distinct words and pairs) and w (of distinct words, below WORDS)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for b in batches for p in _parts(b)):
            lines, doc = _sentences_of(b.column(1).to_pylist())
            t, n_t, w, n_w = _distinct(lines, doc, b.num_rows)
            cols = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(v.astype(np.int32))) for v, n in ((t, n_t), (w, n_w))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", "t", "w"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, t array<int>, w array<int>")


def _embedded(flat: np.ndarray, sizes: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit vectors, as whole numbers up to 127, of documents given by their terms, one after the other."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = (flat >> 15) & (DIM - 1)
    sign = np.where((flat >> 24) & 1, 1.0, -1.0)
    x = np.bincount(row * DIM + place, weights=idf[flat & (_TABLE - 1)] * sign, minlength=len(sizes) * DIM).reshape(len(sizes), DIM)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    return np.round(x * 127).astype(np.int8)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy().astype(np.int64), np.diff(column.offsets.to_numpy().astype(np.int64))


def _summed_by_key(df: DataFrame, run) -> tuple[np.ndarray, np.ndarray]:
    """(keys, sums) of what ``run`` yields from the batches of a partition: whole numbers, so the order of adding does not count."""
    got = df.mapInArrow(run, "k long, s long").groupBy("k").agg(F.sum("s").alias("s")).toPandas()
    return got["k"].to_numpy(), got["s"].to_numpy()


def _counts(total: np.ndarray) -> pa.RecordBatch:
    k = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k].astype(np.int64))], names=["k", "s"])


def frequencies(lists: DataFrame) -> np.ndarray:
    """Inverse document frequencies of hashed terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_TABLE + 1, np.int64)
        for b in batches:
            total[:-1] += np.bincount(b.column(0).flatten().to_numpy() & (_TABLE - 1), minlength=_TABLE)
            total[-1] += b.num_rows
        yield _counts(total)

    k, s = _summed_by_key(lists.select("t"), run)
    df = np.zeros(_TABLE + 1)
    df[k] = s
    return np.log((df[-1] + 1) / (df[:-1] + 1)).clip(0)


def vectors(lists: DataFrame, idf: np.ndarray) -> DataFrame:
    """doc_id, w and v, the unit vector of each document as 128 signed bytes, staged; zero without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = _embedded(*_lists(b.column(1)), idf)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([r.tobytes() for r in q], pa.binary())], names=["doc_id", "w", "v"])

    return stage(lists.mapInArrow(run, "doc_id long, w array<int>, v binary"))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(-1, DIM).astype(np.float64)


# ---- bisecting k-means -------------------------------------------------------------------------


@dataclass
class Tree:
    """Binary tree of cuts: a vector x of leaf n goes to leaf 2n+2 if x . cut[n][0] > cut[n][1], else to 2n+1.

    All are whole numbers small enough for exact floating-point products.
    """

    cut: dict[int, tuple[np.ndarray, float]]

    def leaf(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        todo = [0] if self.cut else []
        while todo:
            n = todo.pop()
            m = np.flatnonzero(at == n)
            if n in self.cut:
                a, c = self.cut[n]
                at[m] = 2 * n + 1 + (x[m] @ a > c)
                todo += [k for k in (2 * n + 1, 2 * n + 2) if k in self.cut]
        return at


def _between(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """The plane half way between two centres, in 256ths."""
    a, b = np.round(a * 256), np.round(b * 256)
    return b - a, float(np.floor(((b @ b) - (a @ a)) / 512))


def bisect(vecs: DataFrame, leaves: int, rounds: int = 2) -> Tree:
    """Split every leaf in two, level by level, until there are ``leaves``; a leaf below SPLITTABLE documents stays.

    A leaf is first cut through its centre across a random direction, then by
    the planes between its halves' centres. All leaves of a level move in the
    same passes over the vectors.
    """
    tree = Tree({})
    rng = np.random.default_rng(11)
    sums = _leaf_sums(vecs, tree)
    for _ in range(max(int(leaves) - 1, 1).bit_length()):
        trial = {}
        for n in sorted(k for k, (size, _) in sums.items() if size >= SPLITTABLE):
            r = np.round(rng.standard_normal(DIM) * 256)
            trial[n] = (r, float(np.floor(sums[n][1] @ r / sums[n][0])))
        if not trial:
            break
        for _ in range(rounds):
            sums = _leaf_sums(vecs, Tree(tree.cut | trial))
            for n in list(trial):
                kids = [sums.get(2 * n + 1 + s) for s in (0, 1)]
                if all(kids):
                    trial[n] = _between(*[k[1] / k[0] for k in kids])
                else:  # all of its documents are alike
                    del trial[n]
        tree.cut |= trial
        sums = {k: v for k, v in _leaf_sums(vecs, tree).items() if (k - 1) // 2 in trial}
    return tree


def _leaf_sums(vecs: DataFrame, tree: Tree) -> dict[int, tuple[int, np.ndarray]]:
    """{leaf: (documents, sum of vectors)} of documents with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            x = _matrix(b.column(0))
            x = x[np.abs(x).sum(1) > 0]
            at = tree.leaf(x)
            for k in np.unique(at).tolist():
                m = at == k
                total[k] = total.get(k, 0) + np.concatenate([[m.sum()], x[m].sum(0)]).astype(np.int64)
        keys = np.array(sorted(total), np.int64)
        at = (keys[:, None] * (DIM + 1) + np.arange(DIM + 1)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.concatenate([np.zeros(0, np.int64), *[total[k] for k in keys.tolist()]]))], names=["k", "s"])

    out: dict[int, np.ndarray] = {}
    for k, s in zip(*_summed_by_key(vecs.select("v"), run)):  # leaves x 129 numbers
        out.setdefault(int(k) // (DIM + 1), np.zeros(DIM + 1))[int(k) % (DIM + 1)] = s
    return {k: (int(v[0]), v[1:]) for k, v in out.items()}


# ---- leaves and their labels -------------------------------------------------------------------


def word_counts(vecs: DataFrame, group, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """(counts, documents): in how many documents of each group each word occurs, and how many there are.

    ``group`` gives (row, group) pairs of a batch of vecs.
    """
    wide = WORDS + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(groups * wide, np.int64)
        for b in batches:
            flat, sizes = _lists(b.column(b.schema.get_field_index("w")))
            rows, g = group(b)
            n = sizes[rows]
            at = np.arange(n.sum()) + np.repeat((np.cumsum(sizes) - sizes)[rows] - (np.cumsum(n) - n), n)
            total += np.bincount(np.repeat(g, n) * wide + flat[at], minlength=groups * wide)
            total += np.bincount(g * wide + WORDS, minlength=groups * wide)
        yield _counts(total)

    k, s = _summed_by_key(vecs, run)
    out = np.zeros((groups, wide))
    out.ravel()[k] = s
    return out[:, :-1], out[:, -1]


def leaf_words(vecs: DataFrame, tree: Tree) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(leaves, counts, documents) of word_counts by leaf."""
    inner = set(tree.cut)
    leaves = sorted({k for n in inner for k in (2 * n + 1, 2 * n + 2)} - inner) or [0]
    place = {k: i for i, k in enumerate(leaves)}

    def group(b: pa.RecordBatch):
        x = _matrix(b.column(b.schema.get_field_index("v")))
        rows = np.flatnonzero(np.abs(x).sum(1) > 0)
        return rows, np.array([place[k] for k in tree.leaf(x[rows]).tolist()], np.int64)

    return leaves, *word_counts(vecs, group, len(leaves))


def subject_words(vecs: DataFrame, labels: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """word_counts by the subjects readers gave; a document of several counts for each."""
    at = F.array_position(F.array(*[F.lit(s) for s in names]), F.col("subject")) - 1
    per_doc = labels.where(F.col("subject").isin(names)).groupBy("doc_id").agg(F.collect_set(at.cast("int")).alias("g"))
    got = vecs.select("doc_id", "w").join(small(stage(per_doc)), "doc_id").select("w", "g")

    def group(b: pa.RecordBatch):
        g, n = _lists(b.column(b.schema.get_field_index("g")))
        return np.repeat(np.arange(len(n)), n), g

    return word_counts(got, group, len(names))


def log_odds(counts: np.ndarray, documents: np.ndarray) -> np.ndarray:
    """How much oftener a word occurs in the documents of a group than in all of them: log of the ratio of shares."""
    share = (counts.sum(0) + 0.5) / (documents.sum() + 1.0)
    return np.log((counts + 8 * share) / (documents[:, None] + 8) / share)


def telling(counts: np.ndarray, documents: np.ndarray) -> np.ndarray:
    """The TELLING discriminative words of each leaf: those with most documents beyond what their share in the corpus gives."""
    odds = log_odds(counts, documents)
    weight = np.where(odds > 0, counts * odds, 0.0)
    top = np.argsort(-weight, axis=1, kind="stable")[:, :TELLING]
    out = np.zeros_like(weight)
    np.put_along_axis(out, top, np.take_along_axis(weight, top, 1), 1)
    return out


def leaf_labels(leaf: tuple[np.ndarray, np.ndarray], subject: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """(leaves, subjects): mixture of subjects of each leaf, by its discriminative words.

    A word speaks for the subjects whose documents hold it more often than
    others do; a leaf's words vote by their weight. A leaf whose words speak
    for no subject gets equal shares.
    """
    tell = telling(*leaf)
    speaks = np.clip(log_odds(*subject), 0, None).T ** 2  # (words, subjects)
    speaks /= np.maximum(speaks.sum(1, keepdims=True), 1.0)
    vote = tell @ speaks
    total = vote.sum(1, keepdims=True)
    return np.where(total > 0, vote / np.maximum(total, 1e-12), 1.0 / vote.shape[1])


# ---- sentence weights, calibrated by labels ----------------------------------------------------


@dataclass
class Model:
    subjects: list[str]  # the last is NONE
    weights: np.ndarray  # (TERMS, subjects) float32
    prior: np.ndarray
    leaves: dict[int, np.ndarray]  # leaf -> log of its mixture of subjects over the corpus

    def of_sentences(self, lines: list[str], leaf: np.ndarray) -> np.ndarray:
        """The subject number of each sentence; ``leaf`` is that of its document."""
        known = np.stack([*self.leaves.values(), np.zeros(len(self.subjects))])
        place = {k: i for i, k in enumerate(self.leaves)}
        of_leaf = LEAF_WEIGHT * known[np.array([place.get(k, len(place)) for k in leaf.tolist()], np.int64)]
        columns = np.ascontiguousarray(self.weights.T)
        out = np.zeros(len(lines), np.int64)
        for a, b in pieces(lines):
            n, h = b - a, hashes(lines[a:b])
            sc, sizes = np.zeros((n, len(self.subjects))), np.zeros(n, np.int64)
            for t, of in ((h.word, h.of_word), (h.pair, h.of_pair), (h.run, h.of_run)):
                sc += picked_sums(columns, t & (TERMS - 1), of, n)
                sizes += np.bincount(of, minlength=n)
            out[a:b] = (sc / np.sqrt(np.maximum(sizes, 1))[:, None] + self.prior + of_leaf[a:b]).argmax(1)
        return out


def labelled_sample(documents: DataFrame, idf: np.ndarray, tree: Tree, labels: DataFrame, n: int = LABELLED) -> list:
    """(doc_id, labels, leaf, sentences) of at most ``n`` labelled documents."""
    per_doc = labels.where("doc_id is not null and subject is not null").groupBy("doc_id").agg(F.sort_array(F.collect_set("subject")).alias("subjects"))
    chosen = stage(per_doc.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n))
    got = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])  # bounded by n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for b in batches for p in _parts(b)):
            get = lambda c: b.column(b.schema.get_field_index(c))  # noqa: E731,B023
            lines, doc = _sentences_of(get("text").to_pylist())
            leaf = tree.leaf(_embedded(*_distinct(lines, doc, b.num_rows)[:2], idf).astype(float))
            off = np.searchsorted(doc, np.arange(b.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([get("doc_id"), get("subjects"), pa.array(leaf), pa.ListArray.from_arrays(pa.array(off), pa.array(lines, pa.string()))], names=["doc_id", "subjects", "leaf", "s"])

    return sorted(got.select("doc_id", "subjects", "text").mapInArrow(run, "doc_id long, subjects array<string>, leaf long, s array<string>").collect())


def fit(sample: list, names: list[str], leaves: list[int], mixtures: np.ndarray, words: tuple[np.ndarray, np.ndarray], rounds: int = ROUNDS) -> Model | None:
    """Sentence weights from the leaves' words and mixtures, calibrated on labelled documents.

    ``names`` ends in NONE; ``mixtures`` holds the leaves' labels and ``words``
    the counts of their words. Each subject starts with the words of the
    leaves, weighted by their mixtures; then sentences and weights are refined
    in turn, first on words and pairs, at last on all terms.
    """
    k, at = len(names), {s: i for i, s in enumerate(names)}
    docs = [(set(r[1]) & set(names), r[2], r[3]) for r in sample if r[3] and set(r[1]) & set(names)]
    if not docs:
        return None
    allowed = np.zeros((len(docs), k))
    for i, (own, _, _) in enumerate(docs):
        allowed[i, [at[s] for s in own]] = 1
    allowed[:, -1] = 1
    of_doc = np.repeat(np.arange(len(docs)), [len(d[2]) for d in docs])
    lines = [s for d in docs for s in d[2]]
    n_of = np.bincount(of_doc, minlength=len(docs))

    base = (mixtures * words[1][:, None]).sum(0) + 1.0
    base /= base.sum()
    prior_of = {leaf: np.append(np.log((m[:-1] + 0.1 * base[:-1]) / (1.1 * base[:-1])), 0.0) for leaf, m in zip(leaves, mixtures)}
    zero = np.zeros(k)
    of_leaf = LEAF_WEIGHT * np.stack([prior_of.get(d[1], zero) for d in docs])

    h = hashes(lines)
    first = log_odds(mixtures.T @ words[0], mixtures.T @ words[1])
    first[-1] = 0.0
    sc = picked_sums(first, word_number(h), h.of_word, len(lines)) / np.sqrt(np.maximum(np.bincount(h.of_word, minlength=len(lines)), 1))[:, None]
    sc[:, -1] = START

    few = Terms(Hashes(h.word, h.of_word, h.pair, h.of_pair, h.word[:0], h.of_word[:0]), len(lines))
    every = Terms(h, len(lines))
    # readers call a subject treated when a fifth of the sentences are about it: a label's share is held up to that
    owed = np.where(allowed > 0, TREATS * n_of[:, None], 0.0)
    owed[:, -1] = 0.0
    lift = np.zeros_like(allowed)
    closed = np.where(allowed > 0, 0.0, -1e3)
    for r in range(rounds):
        if r in (rounds // 2, rounds - 2):
            free = np.zeros_like(allowed)
            np.add.at(free, (of_doc, (sc + of_leaf[of_doc]).argmax(1)), 1)
            mine = (free * (owed > 0)).sum(1) / n_of
            other = (free * (owed == 0))[:, :-1].sum(1) / n_of
            # a few labels are wrong: a document that by its sentences treats other subjects and none of its own is freed
            wrong = (mine < 0.05) & (other > 0.4)
            closed[wrong], owed[wrong], lift[wrong] = 0.0, 0.0, 0.0
        for _ in range(4):
            q = sc + (closed + lift + of_leaf)[of_doc]
            p = np.exp(q - q.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            mass = np.zeros_like(allowed)
            some = np.flatnonzero(n_of)
            mass[some] = np.add.reduceat(p, (np.cumsum(n_of) - n_of)[some], axis=0)
            lift = np.where(owed > 0, np.clip(lift + np.log((owed + 0.01) / (mass + 0.01)), 0.0, 12.0), 0.0)
        used = every if r >= rounds - FULL else few
        w, prior = used.weights(p)
        if r + 1 < rounds:
            sc = used.scores(w) + prior
    return Model(names, w.astype(np.float32), prior.astype(np.float32), prior_of)


class Terms:
    """The terms of a sample of sentences, in order of sentences and in order of terms."""

    def __init__(self, h: Hashes, n: int):
        of = np.concatenate([h.of_word, h.of_pair, h.of_run])
        order = np.argsort(of, kind="stable")
        self.row = of[order]
        self.term = (np.concatenate([h.word, h.pair, h.run]) & (TERMS - 1))[order]
        self.n, self.sizes = n, np.maximum(np.bincount(of, minlength=n), 1)
        by_term = np.argsort(self.term, kind="stable")
        self.row_by_term, self.term_by_term = self.row[by_term], self.term[by_term]

    def weights(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log of how much oftener each term occurs about a subject than at all; log shares of the subjects.

        Weights are relative to the corpus: terms that tell nothing weigh nothing.
        """
        count = picked_sums(np.ascontiguousarray(p.T, np.float32), self.row_by_term, self.term_by_term, TERMS).astype(float)
        back = (count.sum(1) + 0.5) / (count.sum() + 0.5 * TERMS)
        w = np.log((count + 2 * back[:, None] + 1e-3) / (count.sum(0) + 2 + 1e-3 * TERMS)) - np.log(back)[:, None]
        return w, np.log(p.mean(0) + 1e-9)

    def scores(self, w: np.ndarray) -> np.ndarray:
        return picked_sums(np.ascontiguousarray(w.T, np.float32), self.term, self.row, self.n).astype(float) / np.sqrt(self.sizes)[:, None]


# ---- assignment --------------------------------------------------------------------------------


@dataclass
class Fitted:
    idf: np.ndarray
    tree: Tree
    model: Model | None


def train(documents: DataFrame, labels: DataFrame, subjects: DataFrame, n: int = LABELLED) -> Fitted:
    labels = labels.where("doc_id is not null and subject is not null")
    told = [(r[0], f"{r[1] or ''}. {r[2] or ''}") for r in _described(subjects).limit(SUBJECTS + 1).collect()]
    if len(told) > SUBJECTS:
        raise ValueError(f"more than {SUBJECTS} subjects")
    names = [*sorted({s for s, _ in told} - {NONE}), NONE]
    lists = stage(term_lists(documents))
    idf = frequencies(lists)
    vecs = vectors(lists, idf)
    tree = bisect(vecs, LEAVES_A_SUBJECT * len(names))
    leaves, *words = leaf_words(vecs, tree)
    counts, per = subject_words(vecs, labels, names)
    for s, text in told:
        if s != NONE:
            counts[names.index(s), np.unique(word_number(hashes([text], runs=False)))] += TITLE
            per[names.index(s)] += TITLE
    return Fitted(idf, tree, fit(labelled_sample(documents, idf, tree, labels, n), names, leaves, leaf_labels(words, (counts, per)), words))


def _described(subjects: DataFrame) -> DataFrame:
    """One row a subject: its name, title and scope note, null where the table has none."""
    text = [F.max(c).alias(c) if c in subjects.columns else F.lit(None).cast("string").alias(c) for c in ("title", "scope_note")]
    return subjects.where("subject is not null").groupBy("subject").agg(*text)


def assign(documents: DataFrame, fitted: Fitted) -> DataFrame:
    """doc_id, subject, n_sentences, n_about and share of each subject of each document that has any sentence about it.

    One pass over the texts where they lie; a document's leaf comes from its
    vector, made again from the same sentences.
    """
    schema = "doc_id long, subject string, n_sentences int, n_about int"
    idf, tree, model = fitted.idf, fitted.tree, fitted.model
    if model is None:
        return documents.sparkSession.createDataFrame([], schema + ", share double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for b in batches for p in _parts(b)):
            lines, doc = _sentences_of(b.column(1).to_pylist())
            leaf = tree.leaf(_embedded(*_distinct(lines, doc, b.num_rows)[:2], idf).astype(float))
            k = len(model.subjects)
            key, n = np.unique(doc * k + model.of_sentences(lines, leaf[doc]), return_counts=True)
            about = key % k < k - 1  # the last is none
            row = key[about] // k
            names = pa.array([model.subjects[j] for j in (key[about] % k).tolist()], pa.string())
            cols = [b.column(0).take(pa.array(row)), names, pa.array(np.bincount(doc, minlength=b.num_rows)[row].astype(np.int32)), pa.array(n[about].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "subject", "n_sentences", "n_about"])

    return documents.select("doc_id", "text").where("doc_id is not null").mapInArrow(run, schema).withColumn("share", F.col("n_about") / F.col("n_sentences"))


def subject_shares(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    return assign(documents, train(documents, labels, subjects))


def treated(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """doc_id and subject: one row for each subject a document treats."""
    return subject_shares(documents, labels, subjects).where(F.col("share") >= TREATS - 1e-9).select("doc_id", "subject")


def composition(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """The corpus by subject: documents that treat it and sentences about it."""
    s = subject_shares(documents, labels, subjects)
    return s.groupBy("subject").agg(F.sum(F.when(F.col("share") >= TREATS - 1e-9, 1).otherwise(0)).alias("n_documents"), F.sum("n_about").alias("n_sentences"))
