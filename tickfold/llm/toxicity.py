"""Toxicity by nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes.

Terms are all words and word starts that two or more of the labelled rows have. A term's weight in a text is
(1 + log count) times its inverse document frequency over all documents, times its relevance: how far the
likelihood ratio g of term and label is beyond chance, x / (x + SHRINK) of x = g - CHANCE, and 0 below. So words
of the topic count for little. All labelled rows become unit vectors in an inverted index. Its blocks of
examples keep each term's largest weight. Common terms, which rule out no block, are added by one matrix product for a
step of texts; the k-th best of these sums is a bound, and rare terms' postings are read only in blocks that can
reach it. Neighbours are exact: the last comparison is in double precision. Their votes weigh by distance.

CHANCE, SHRINK, NEIGHBOURS and PRIOR_VOTES were chosen by cross-validation within the learned rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, remainder, texts, utf8, written

#: Labelled rows to learn from at most: the first by a hash of the id. It bounds the index, which is broadcast.
MOST_LABELLED = 8_192
#: Characters of a word start, and labelled rows that must have a term.
START, LEAST_ROWS = 4, 2
#: The likelihood ratio that one term in six has by chance, that beyond it which halves a weight, neighbours that vote, examples of
#: a block, and the prior's weight in votes.
CHANCE, SHRINK, NEIGHBOURS, BLOCK, PRIOR_VOTES = 2.0, 10.0, 15, 128, 0.1
#: A term that one in so many examples has is common.
COMMON = 32
#: Rows of one step, terms that are counted before their counts go on, and scores that are kept.
STEP, KEPT_TERMS, KEPT_SCORES = 500, 100_000, 4_000


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


def start_of(word: bytes) -> bytes | None:
    """The first characters of a longer word, with a ``*``, which no word has."""
    if len(word) <= START:
        return None
    if word.isascii():
        return word[:START] + b"*"
    short = word.decode("utf-8", "replace")
    return short[:START].encode() + b"*" if len(short) > START else None


def terms_of(text: bytes | None) -> Counter:
    """Counts of a text's words and word starts."""
    found = Counter(words_of(text))
    for word, count in [*found.items()]:
        if start := start_of(word):
            found[start] += count
    return found


def _partial(counts: tuple[Counter, Counter]) -> pa.RecordBatch:
    terms = [*counts[0].keys() | counts[1].keys()]
    out = pa.RecordBatch.from_arrays([pa.array(terms, pa.binary()), *(pa.array([c[t] for t in terms], pa.int64()) for c in counts)], ["term", "n0", "n1"])
    for c in counts:
        c.clear()
    return out


def _associations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document counts of terms by label."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), utf8(batch, "text")):
            counts[label].update(terms_of(text).keys())
            if len(counts[0]) + len(counts[1]) > KEPT_TERMS:
                yield _partial(counts)
    yield _partial(counts)


class Vocabulary(dict):
    """Numbers of terms; as a dict, the numbers of recent words and their starts."""

    def __init__(self, terms: list[bytes]):
        super().__init__()
        self.terms = terms
        self.number = {t: i for i, t in enumerate(terms)}

    def __reduce__(self):
        return Vocabulary, (self.terms,)

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= KEPT_TERMS:
            self.clear()
        found = self[word] = tuple(self.number[t] for t in (word, start_of(word)) if t in self.number)
        return found

    def counts(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """Ascending numbers of a text's known terms, and their counts."""
        return np.unique(np.fromiter(chain.from_iterable(map(self.__getitem__, words_of(text))), np.int32), return_counts=True)


def _frequencies(words: Vocabulary):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows = np.zeros(len(words.terms), np.int64), 0
        for batch in batches:
            for text in utf8(batch, "text"):
                df[words.counts(text)[0]] += 1
                rows += 1
        here = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([*here.tolist(), -1], pa.int32()), pa.array([*df[here].tolist(), rows], pa.int64())], ["term", "df"])

    return kernel


def _vectors(words: Vocabulary):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [words.counts(t) for t in utf8(batch, "text")]
            arrays = [pa.array([f[i].astype(np.int32).tobytes() for f in found], pa.binary()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], [*batch.schema.names[:-1], "terms", "counts"])

    return kernel


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges lo..hi - 1 one after the other, and the length of each."""
    n = hi - lo
    return np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n), n


@dataclass
class Index:
    """Unit vectors of examples. Postings are ordered by term and block; cells, of a term and a block that has
    it, hold where their postings start and the largest weight."""

    factor: np.ndarray  # of each term: inverse document frequency times relevance
    ids: list
    labels: np.ndarray
    cells: np.ndarray  # the first cell of each term
    block: np.ndarray  # of each cell
    largest: np.ndarray
    first: np.ndarray  # the first posting of each cell
    posting: np.ndarray
    weight: np.ndarray
    row: np.ndarray  # where an example's own terms start
    row_term: np.ndarray
    row_weight: np.ndarray
    base: float  # share of label 1

    @classmethod
    def build(cls, rows: list[tuple], factor: np.ndarray, base: float) -> Index:
        """rows: (id, label, terms, counts), with ascending terms."""
        # Similar examples in one block keep its bounds low.
        top = lambda t, c: int(t[np.argmax(weigh(t, c, factor))]) if len(t) else -1
        rows = sorted(rows, key=lambda r: (r[1], top(r[2], r[3]), str(r[0])))
        owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[2]) for r in rows])
        term = np.concatenate([np.empty(0, np.int32), *(r[2] for r in rows)])
        weight = np.concatenate([np.empty(0), *(weigh(r[2], r[3], factor) for r in rows)])
        return cls.of_postings([r[0] for r in rows], np.array([r[1] for r in rows], int), factor, owner, term, weight, base)

    @classmethod
    def of_postings(cls, ids: list, labels: np.ndarray, factor: np.ndarray, owner: np.ndarray, term: np.ndarray, weight: np.ndarray, base: float) -> Index:
        order = np.lexsort((owner, term))
        owner, term, weight = owner[order], term[order], weight[order]
        new = np.concatenate((np.ones(min(1, len(term)), bool), (term[1:] != term[:-1]) | (owner[1:] // BLOCK != owner[:-1] // BLOCK)))
        first = np.flatnonzero(new)
        largest = np.maximum.reduceat(weight, first) if len(first) else weight
        cells = np.searchsorted(term[first], np.arange(len(factor) + 1))
        by = np.argsort(owner, kind="stable")
        row = np.searchsorted(owner[by], np.arange(len(ids) + 1))
        return cls(factor, ids, labels, cells, owner[first] // BLOCK, largest, np.append(first, len(term)), owner.astype(np.int32), weight, row, term[by], weight[by], base)

    def cosines(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        at, n = _ranges(self.row[rows], self.row[rows + 1])
        return np.bincount(np.repeat(np.arange(len(rows)), n), self.row_weight[at] * query[self.row_term[at]], len(rows))

    @cached_property
    def common(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each term its row among the common ones, -1 for a rare one; the common terms' weights by example. Made
        where it is used, so it isn't sent; at most COMMON numbers for each posting."""
        often = np.flatnonzero(np.diff(self.first[self.cells]) * COMMON >= max(1, len(self.ids)))
        row = np.full(len(self.factor), -1)
        row[often] = np.arange(len(often))
        dense = np.zeros((len(often), len(self.ids)), np.float32)
        at, n = _ranges(self.first[self.cells[often]], self.first[self.cells[often + 1]])
        dense[np.repeat(np.arange(len(often)), n), self.posting[at]] = self.weight[at]
        return row, dense

    def common_parts(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What common terms add to the cosine of each query and example: one matrix product."""
        row, dense = self.common
        q = np.zeros((len(queries), len(dense)), np.float32)
        for i, (term, value) in enumerate(queries):
            at = row[term]
            q[i, at[at >= 0]] = value[at >= 0]
        return q @ dense

    def nearest(self, term: np.ndarray, value: np.ndarray, k: int, part: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Up to k examples of the highest cosine above 0 and their cosines; of equal ones, the first.

        ``part`` is the query's row of ``common_parts``. The k-th best of it is a first bound. Postings of rare terms
        are read only in blocks whose largest weights could reach that; examples within rounding of the k-th best
        sum are compared as a whole.
        """
        size = len(self.ids)
        if part is None:
            part = self.common_parts([(term, value)])[0]
        slack = 1e-6 + 1.2e-7 * len(self.common[1])  # twice what a sum of so many single-precision terms up to 1 can be off
        kth = lambda x: float(np.partition(x, size - k)[size - k]) - 2 * slack if size > k else 0.0
        rare = self.common[0][term] < 0
        cell, n = _ranges(self.cells[term[rare]], self.cells[term[rare] + 1])
        block, gain = self.block[cell], np.repeat(value[rare], n)
        bound = np.maximum.reduceat(part, np.arange(0, size, BLOCK)) + np.bincount(block, gain * self.largest[cell], -(-size // BLOCK))
        reach = bound[block] >= kth(part)
        cell, gain = cell[reach], gain[reach]
        post, m = _ranges(self.first[cell], self.first[cell + 1])
        part = part + np.bincount(self.posting[post], self.weight[post] * np.repeat(gain, m), size)
        rows = np.flatnonzero((part > 0) & (part >= kth(part)))
        query = np.zeros(len(self.factor))
        query[term] = value
        near = self.cosines(rows, query)
        order = np.lexsort((rows, -np.round(near, 12)))[:k]
        order = order[near[order] > 0]
        return rows[order], near[order]

    def scores(self, found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """(score, neighbours, cosines) of texts by their terms and counts: votes weigh by distance, and a prior
        holds few or far ones back."""
        values = [weigh(t, c, self.factor) for t, c in found]
        parts = self.common_parts([(t, v) for (t, _), v in zip(found, values)])
        for (term, _), value, part in zip(found, values, parts):
            if not len(term) or not len(self.ids):
                yield self.base, np.empty(0, int), np.empty(0)
                continue
            best, near = self.nearest(term, value, NEIGHBOURS, part)
            vote = near / (1.05 - np.minimum(near, 1.0))
            yield float((vote @ self.labels[best] + PRIOR_VOTES * self.base) / (vote.sum() + PRIOR_VOTES)), best, near


def weigh(term: np.ndarray, count: np.ndarray, factor: np.ndarray) -> np.ndarray:
    v = (1 + np.log(count)) * factor[term]
    return v / np.sqrt(v @ v) if len(v) and v.any() else v


def likelihood_ratio(rows0: float, rows1: float):
    """g of a term's documents with label 0 and 1, columns n0 and n1, against rows0 and rows1 of all."""
    n, rows = F.col("n0") + F.col("n1"), F.lit(rows0 + rows1)

    def part(found, of, label: float):
        expected = of * F.lit(label) / rows
        return F.when(found > 0, found * F.log(found / expected)).otherwise(0.0)

    have = part(F.col("n0"), n, rows0) + part(F.col("n1"), n, rows1)
    return 2 * (have + part(rows0 - F.col("n0"), rows - n, rows0) + part(rows1 - F.col("n1"), rows - n, rows1))


def _scored(index: Index, words: Vocabulary, text_col: str, below: float | None):
    """below: the batches' rows with a lower score, as they are; None: their other columns, score and evidence."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[bytes, tuple] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, STEP):
                batch = whole.slice(at, STEP)
                found = [words.counts(t) for t in utf8(batch, text_col)]
                keys = [t.tobytes() + c.tobytes() for t, c in found]
                if len(kept) > KEPT_SCORES:
                    kept.clear()
                todo = {key: f for key, f in zip(keys, found) if key not in kept}
                for key, (score, best, near) in zip(todo, index.scores([*todo.values()])):
                    kept[key] = score, [index.ids[i] for i in best], near.tolist()
                rows = [kept[key] for key in keys]
                if below is not None:
                    yield batch.filter(pa.array([r[0] < below for r in rows], pa.bool_()))
                    continue
                kinds = pa.float64(), pa.list_(batch.schema.types[0]), pa.list_(pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))],
                    [*batch.schema.names[:-1], "score", "evidence", "cosines"],
                )

    return kernel


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 3, held: int = 1, most: int = MOST_LABELLED
) -> tuple[Index, Vocabulary]:
    """The index and its vocabulary, from at most ``most`` labels whose fold (crc32 of the id as text modulo
    folds) isn't ``held``. It is as large as these rows' texts; document frequencies are of all ``docs``."""
    base = texts(docs, id_col, text_col)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1) and id is not null")
    known = known.where(remainder("id", folds) != held).orderBy(F.xxhash64("id"), "id", "label").limit(most)
    train = written(base.join(F.broadcast(known), "id").select("id", "label", "text"))
    sizes = dict(train.groupBy("label").count().collect())
    rows = [float(sizes.get(c, 0)) for c in (0, 1)]
    share = (rows[1] + 0.5) / (sum(rows) + 1)
    if not all(rows):
        return Index.build([], np.empty(0), share), Vocabulary([])
    counted = train.select("label", "text").mapInArrow(_associations, "term binary, n0 long, n1 long")
    counted = counted.groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where(F.col("n0") + F.col("n1") >= LEAST_ROWS)
    beyond = counted.select("term", (likelihood_ratio(*rows) - CHANCE).alias("x")).where("x > 0")
    found = sorted((bytes(t), x) for t, x in beyond.collect())  # of the labelled rows' texts, so bounded as they are
    words = Vocabulary([t for t, _ in found])
    df = dict(base.select("text").mapInArrow(_frequencies(words), "term int, df long").groupBy("term").agg(F.sum("df")).collect())
    x = np.array([x for _, x in found])
    idf = np.log((1 + df.get(-1, 0)) / (1 + np.array([df.get(i, 0) for i in range(len(found))], float))) + 1
    vectors = train.mapInArrow(_vectors(words), f"id {dict(base.dtypes)['id']}, label int, terms binary, counts binary")
    examples = [(i, y, np.frombuffer(t, np.int32), np.frombuffer(c, np.int32)) for i, y, t, c in vectors.collect()]
    return Index.build(examples, idf * x / (x + SHRINK), share), words


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: float = 0.7, **how) -> DataFrame:
    """Per row of ``docs``: id, held_out, score (0 to 1, higher: label 1 likelier), predicted (1 if score >=
    limit), evidence (ids of the voting examples) and cosines.

    Null and empty texts and texts without a known term get the labelled rows' share of label 1. Null labels
    and labels without a document are ignored; repeated rows stay. Without labels of both classes there is
    no vocabulary and every row gets that share. Of equal cosines, the first in the index votes. A text is
    read whole, however long. Other columns are not looked at; an empty table gives an empty one.
    """
    index, words = fit_toxicity(docs, labels, id_col, text_col, **how)
    fold = remainder(id_col, how.get("folds", 3)) == how.get("held", 1)
    base = docs.select(F.col(id_col).alias("id"), fold.alias("held_out"), F.col(text_col).alias("text"))
    kind = dict(base.dtypes)["id"]
    scored = base.mapInArrow(_scored(index, words, "text", None), f"id {kind}, held_out boolean, score double, evidence array<{kind}>, cosines array<double>")
    return scored.withColumn("predicted", (F.col("score") >= limit).cast("int")).withColumnRenamed("id", id_col)


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: float = 0.7, **how) -> DataFrame:
    """The rows of ``docs`` whose score is below ``limit``; all columns stay, whatever their names."""
    index, words = fit_toxicity(docs, labels, id_col, text_col, **how)
    return docs.mapInArrow(_scored(index, words, text_col, limit), docs.schema)
