"""Toxicity by the nearest labelled examples, with exact TF-IDF cosine over a block-max inverted index.

Terms are words and the beginnings of words (4, 5 and 6 bytes), in lower case.
From a bounded sample of labelled documents those terms are taken whose
presence and the label depend on each other (likelihood ratio ``G2``); how far
down that list to go is chosen from ``LEAST_G2`` by the log loss of the sample's
documents, each judged by the others. How many documents of the corpus have a
term is counted over all of them. A document's vector has ``(1 + log tf) * idf``
of its terms and length one.

The index holds the different vectors of the examples in blocks of ``BLOCK``,
and for every block the largest weight of each term. A query's terms and these
bounds give the most that any example of a block can reach. The blocks with a
query's ``FIRST_BLOCKS`` highest bounds are visited first, then all others whose
bound is not below its k-th best score. Different vectors of a batch are
compared once, and stand for all documents and examples that have them. Scores
are sums over postings in double precision, so the neighbours are those of a
full comparison. Nothing is estimated.

Neighbours vote with the weight ``1 / (1 - cosine + softness)``. Votes become
probabilities by isotonic regression over the votes that the examples get from
each other, each without itself.

The driver sees the sample's vectors: ``sample_rows`` examples of at most ``terms``
terms. Texts are read once by the tasks, and what is kept of a document are its
known terms.

Defined results
---------------
* null or empty text, and every text without a known term: no neighbours; the score is the share of toxic examples among those without a term;
* no labels or one class only: every score is that class's share (0.5 if there are none);
* null id: scored, not held out; null label: not learned from; ids that repeat in ``labels`` or ``documents``: each pair of rows may be sampled, within ``sample_rows``; each document row is scored;
* ties: the smaller example id is nearer; equal examples all vote;
* very long texts are read whole, one at a time if one exceeds a batch;
* empty ``documents``: no rows; other input columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .shared import keep_table, read_table, text_batches
from .text_blocks import Words, bounded, lowered, mix, range_hashes, text_bytes

BLOCK = 128
FIRST_BLOCKS = 2
PREFIXES = (4, 5, 6)
LEAST_G2 = (24.0, 48.0, 96.0, 192.0)
_U = np.uint64


def _separators() -> np.ndarray:
    out = np.ones(256, bool)
    out[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = False
    return out


SEPARATORS = _separators()


def is_test(doc_id):
    """crc32 of the id as text, mod 5, is 0; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _term_hashes(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, hash of a term) of all words, then of all beginnings of each length of the words that are longer."""
    raw, offsets = text_bytes(column)
    raw = lowered(raw)
    words = Words(raw, offsets, blanks=SEPARATORS[raw])
    yield words.doc, words.hash
    for size in PREFIXES:
        longer = np.flatnonzero(words.stop - words.start > size)
        start = words.start[longer]
        yield words.doc[longer], mix(range_hashes(raw, start, start + size) ^ _U(size))


def term_counts(column: pa.Array, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place in the sorted hashes ``known``, occurrences) of the known terms of each text, sorted."""
    keys = []
    for text, term in _term_hashes(column):
        at = np.searchsorted(known, term)
        hit = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == term) if len(known) else np.zeros(0, int)
        keys.append(text[hit].astype(np.int64) * max(len(known), 1) + at[hit])
    key, n = np.unique(np.concatenate(keys), return_counts=True)
    return key // max(len(known), 1), key % max(len(known), 1), n


def dependence(toxic: np.ndarray, clean: np.ndarray, all_toxic: int, all_clean: int) -> np.ndarray:
    """G2 of a term's presence and the label, from the numbers of toxic and clean examples that have it."""
    cells = np.stack([toxic, clean, all_toxic - toxic, all_clean - clean]).astype(float)
    total = all_toxic + all_clean
    has = cells[0] + cells[1]
    expected = np.stack([has * all_toxic, has * all_clean, (total - has) * all_toxic, (total - has) * all_clean]) / total
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(cells > 0, cells * np.log(cells / expected), 0.0)
    return 2 * parts.sum(0)


def entries(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``count`` places from each ``start`` on, in a row."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())


def part(bounds: np.ndarray, terms: np.ndarray, weights: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds, terms and weights of ``rows`` only."""
    count = bounds[rows + 1] - bounds[rows]
    at = entries(bounds[rows], count)
    return np.append(0, np.cumsum(count)), terms[at], weights[at]


def distinct(bounds: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each different vector, ascending, and which of them each row equals."""
    raw = np.stack([terms.astype(np.int64), weights.astype(float).view(np.int64)], 1).tobytes()
    seen: dict[bytes, int] = {}
    cuts = (16 * bounds).tolist()
    kind = np.array([seen.setdefault(raw[a:z], len(seen)) for a, z in zip(cuts, cuts[1:])], int)
    return np.unique(kind, return_index=True)[1], kind


class BlockMaxIndex:
    """Vectors of length one, by rows: ``bounds`` (n + 1), ``terms`` and ``weights``; each has at least one term.

    Equal rows are indexed once, and ``members`` has the rows of each different vector.
    """

    def __init__(self, bounds: np.ndarray, terms: np.ndarray, weights: np.ndarray, n_terms: int, block: int = BLOCK) -> None:
        first, kind = distinct(bounds, terms, weights)
        self.members, self.member_bounds = np.argsort(kind, kind="stable"), np.append(0, np.cumsum(np.bincount(kind)))
        bounds, terms, weights = part(bounds, terms, weights, first)
        n = len(bounds) - 1
        row = np.repeat(np.arange(n), np.diff(bounds))
        # vectors with the same strongest terms go to the same blocks, so bounds are tight
        by_row = np.lexsort((terms, -weights, row))
        place = np.arange(len(row)) - np.repeat(bounds[:-1], np.diff(bounds))
        strongest = np.full((3, n), n_terms)
        for k in range(3):
            own = by_row[place == k]
            strongest[k, row[own]] = terms[own]
        self.kinds = np.lexsort((np.arange(n), *strongest[::-1]))  # the vector at each place
        place_of = np.empty(n, int)
        place_of[self.kinds] = np.arange(n)
        self.n, self.block, self.n_terms = n, block, n_terms
        self.blocks = -(-n // block)
        at = place_of[row]
        key = (at // block) * n_terms + terms
        order = np.lexsort((at, key))
        self.at, self.weight = at[order] % block, weights[order]
        self.keys, first = np.unique(key[order], return_index=True)  # the lists: one for each block and term
        self.list_bounds = np.append(first, len(order))
        tops = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        by_term = np.lexsort((self.keys // n_terms, self.keys % n_terms)) if len(first) else np.zeros(0, int)
        self.top_block, self.top = self.keys[by_term] // n_terms, tops[by_term]
        self.term_bounds = np.searchsorted(self.keys[by_term] % n_terms, np.arange(n_terms + 1))

    def _reach(self, query: np.ndarray, terms: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
        """The most that any vector of a block can score, for each query and block."""
        count = self.term_bounds[terms + 1] - self.term_bounds[terms]
        at = entries(self.term_bounds[terms], count)
        cell = np.repeat(query, count) * self.blocks + self.top_block[at]
        return np.bincount(cell, np.repeat(weights, count) * self.top[at], n * self.blocks).reshape(n, self.blocks)

    def _scores(self, block: int, bounds: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Exact scores of queries with the vectors of a block."""
        n = len(bounds) - 1
        query = np.repeat(np.arange(n), np.diff(bounds))
        key = block * self.n_terms + terms
        at = np.searchsorted(self.keys, key)
        have = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == key)
        at, query, weights = at[have], query[have], weights[have]
        count = self.list_bounds[at + 1] - self.list_bounds[at]
        posting = entries(self.list_bounds[at], count)
        cell = np.repeat(query, count) * self.block + self.at[posting]
        return np.bincount(cell, np.repeat(weights, count) * self.weight[posting], n * self.block).reshape(n, self.block)

    def search(self, bounds: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int, at_once: int = 512) -> tuple[np.ndarray, np.ndarray, int]:
        """The ``k`` best rows (-1: none) and scores above 0 of each query, ties to smaller rows; and how many blocks were scored.

        Equal queries are answered once. ``at_once`` bounds the memory: so many
        different queries are compared with the blocks' bounds at a time.
        """
        first, kind = distinct(bounds, terms, weights)
        parts = []
        for a in range(0, len(first), at_once):
            best, score, visited = self._search(*part(bounds, terms, weights, first[a : a + at_once]), k)
            parts.append((*self._spread(best, score), visited))
        if not parts:
            return np.full((0, k), -1), np.zeros((0, k)), 0
        return np.vstack([p[0] for p in parts])[kind], np.vstack([p[1] for p in parts])[kind], sum(p[2] for p in parts)

    def _search(self, bounds: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The ``k`` best vectors and their scores (0: none), ties to those whose first row is smaller."""
        n = len(bounds) - 1
        best, score = np.full((n, k), self.n), np.zeros((n, k))
        if not self.n:
            return best, score, 0
        reach = self._reach(np.repeat(np.arange(n), np.diff(bounds)), terms, weights, n) * (1 + 1e-12)  # sums in another order may differ in the last digits
        visited = 0

        def visit(block: int, own: np.ndarray) -> None:
            nonlocal visited
            own = own[(reach[own, block] > 0) & (reach[own, block] >= score[own, -1])]
            reach[own, block] = -1  # once only
            if not len(own):
                return
            visited += len(own)
            found = self._scores(block, *part(bounds, terms, weights, own))
            better = (found > 0) & (found >= score[own, -1][:, None])
            changed = np.flatnonzero(better.any(1))
            own, (query, cell) = own[changed], np.nonzero(better[changed])
            # the best so far and what is as good as the last of them
            queries = np.append(np.repeat(np.arange(len(own)), k), query)
            kinds = np.append(best[own], self.kinds[block * self.block + cell])
            scores = np.append(score[own], found[changed][query, cell])
            order = np.lexsort((kinds, -scores, queries))
            first = order[np.searchsorted(queries[order], np.arange(len(own)))[:, None] + np.arange(k)]
            best[own], score[own] = kinds[first], scores[first]

        # each query's most promising blocks, so that the last of its best is high, then every block for all queries at once
        most = np.argsort(-reach, 1, kind="stable")[:, :FIRST_BLOCKS]
        for step in range(most.shape[1]):
            for block in np.unique(most[:, step]).tolist():
                visit(block, np.flatnonzero(most[:, step] == block))
        for block in np.argsort(-reach.sum(0), kind="stable").tolist():
            visit(block, np.arange(n))
        return best, score, visited

    def _spread(self, best: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best rows (-1: none) and scores from the best vectors: of each vector no more rows are needed than are asked for."""
        k = best.shape[1]
        query, place = np.nonzero(score > 0)
        kind, own = best[query, place], score[query, place]
        count = np.minimum(self.member_bounds[kind + 1] - self.member_bounds[kind], k)
        row, query, own = self.members[entries(self.member_bounds[kind], count)], np.repeat(query, count), np.repeat(own, count)
        order = np.lexsort((row, -own, query))
        row, query, own = row[order], query[order], own[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        rows, scores, keep = np.full(best.shape, -1), np.zeros(best.shape), rank < k
        rows[query[keep], rank[keep]], scores[query[keep], rank[keep]] = row[keep], own[keep]
        return rows, scores


def unit_vectors(bounds: np.ndarray, terms: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF weights of rows of terms, each row of length one."""
    weight = (1 + np.log(counts)) * idf[terms]
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    return weight / np.sqrt(np.bincount(row, weight**2, len(bounds) - 1))[row]


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing step function nearest to ``y``: the largest x of each step, and its value."""
    steps: list[list[float]] = []
    values, at = np.unique(x, return_inverse=True)
    for top, total, n in zip(values, np.bincount(at, y), np.bincount(at)):
        steps.append([top, total, n])
        while len(steps) > 1 and steps[-2][1] * steps[-1][2] >= steps[-1][1] * steps[-2][2]:
            top, total, n = steps.pop()
            steps[-1] = [top, steps[-1][1] + total, steps[-1][2] + n]
    # half a document of either kind is added to each step: no probability is 0 or 1
    return np.array([s[0] for s in steps]), np.array([(s[1] + 0.5) / (s[2] + 1) for s in steps])


@dataclass
class Neighbours:
    """The examples that have a term, and how votes become scores."""

    idf: np.ndarray
    used: np.ndarray  # which of the known terms count
    index: BlockMaxIndex | None
    ids: np.ndarray
    toxic: np.ndarray
    base: float  # share of toxic examples among those without a term
    k: int
    softness: float
    steps: tuple[np.ndarray, np.ndarray] | None = None

    def neighbours(self, bounds: np.ndarray, terms: np.ndarray, counts: np.ndarray, but: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The nearest examples of each row and their cosines; ``but``: an example for each row that isn't its neighbour."""
        weights = unit_vectors(bounds, terms, counts, self.idf)
        rows, scores, _ = self.index.search(bounds, terms, weights, self.k + (but is not None))
        if but is not None:
            order = np.argsort(rows == but[:, None], 1, kind="stable")[:, : self.k]
            rows, scores = np.take_along_axis(rows, order, 1), np.take_along_axis(scores, order, 1)
            rows = np.where(rows == but[:, None], -1, rows)
        return rows, scores

    def votes(self, rows: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """The toxic share of the neighbours' weights; ``base`` without neighbours."""
        weight = np.where(rows >= 0, 1 / (np.maximum(1 - scores, 0) + self.softness), 0.0)
        total = weight.sum(1)
        yes = (weight * self.toxic[np.maximum(rows, 0)]).sum(1) if len(self.toxic) else np.zeros(len(rows))
        return np.where(total > 0, yes / np.maximum(total, 1e-300), self.base)

    def calibrated(self, votes: np.ndarray) -> np.ndarray:
        tops, values = self.steps
        return values[np.minimum(np.searchsorted(tops, votes), len(values) - 1)]


def known_terms(texts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, of the ``most`` terms of the labelled ``texts`` (``text``, ``toxic``) that tell most about the label, and their G2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            toxic = batch.column("toxic").to_numpy().astype(bool)
            for text, term in _term_hashes(batch.column("text")):
                order = np.lexsort((text, term))
                text, term = text[order], term[order]
                once = np.ones(len(term), bool)
                once[1:] = (term[1:] != term[:-1]) | (text[1:] != text[:-1])
                names, at = np.unique(term[once], return_inverse=True)
                said = np.bincount(at, toxic[text[once]], len(names))
                counts = [pa.array(x.astype(np.int64)) for x in (names.view(np.int64), said, np.bincount(at, minlength=len(names)))]
                yield pa.RecordBatch.from_arrays(counts, names=["term", "toxic", "n"])

    sizes = texts.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    n, n_toxic = sizes[0], sizes[1] or 0
    if n_toxic in (0, n):
        return np.zeros(0, _U), np.zeros(0)
    counted = text_batches(texts).mapInArrow(run, "term long, toxic long, n long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, has = batch.column("toxic").to_numpy(), batch.column("n").to_numpy()
            g2 = dependence(toxic, has - toxic, n_toxic, n - n_toxic)
            yield pa.RecordBatch.from_arrays([batch.column("term"), pa.array(g2)], names=["term", "g2"])

    # a term of one example tells about that example only
    told = counted.where("n > 1").mapInArrow(judge, "term long, g2 double").where(F.col("g2") >= LEAST_G2[0])
    rows = told.orderBy(F.desc("g2"), "term").limit(most).toPandas()
    terms = rows["term"].to_numpy(np.int64).view(_U)
    return np.sort(terms), rows["g2"].to_numpy(float)[np.argsort(terms)]


def term_table(docs: DataFrame, known: np.ndarray, keep: list[str]) -> DataFrame:
    """``keep``, ``terms`` (places in ``known``, ascending) and ``counts`` of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(known)
    schema = docs.select(*keep).schema.add("terms", ArrayType(IntegerType())).add("counts", ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            text, term, n = term_counts(batch.column("text"), shared.value)
            cuts = pa.array(np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x.astype(np.int32))) for x in (term, n)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *lists], names=[*keep, "terms", "counts"])

    return text_batches(docs.select(*dict.fromkeys([*keep, "text"]))).mapInArrow(run, schema)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bounds and values of lists."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.append(0, np.cumsum(sizes)), column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def documents_with(table: DataFrame, n_terms: int) -> DataFrame:
    """``term`` and ``n``, the rows of ``table`` that have it; a task sends one number for each of its terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(n_terms, np.int64)
        for batch in batches:
            n += np.bincount(_flat(batch.column("terms"))[1], minlength=n_terms)
        there = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(n[there])], names=["term", "n"])

    return table.select("terms").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _only(bounds: np.ndarray, terms: np.ndarray, counts: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which rows have a used term, and bounds, terms and counts of those rows, of used terms only."""
    keep = used[terms]
    sizes = np.diff(np.append(0, np.cumsum(keep))[bounds])
    return sizes > 0, np.append(0, np.cumsum(sizes[sizes > 0])), terms[keep], counts[keep]


def fit(examples: pa.Table, idf: np.ndarray, g2: np.ndarray, k: int, softness: float, block: int = BLOCK) -> Neighbours:
    """From ``doc_id``, ``toxic``, ``terms`` and ``counts`` of the examples."""
    examples = examples.sort_by([("doc_id", "ascending"), ("toxic", "ascending")])
    all_bounds, all_terms = _flat(examples.column("terms"))
    all_counts = _flat(examples.column("counts"))[1]
    toxic, ids = examples.column("toxic").to_numpy().astype(float), examples.column("doc_id").to_numpy()
    prior = toxic.mean() if len(toxic) else 0.5
    models = []
    for least in LEAST_G2:
        used = g2 >= least
        has, bounds, terms, counts = _only(all_bounds, all_terms, all_counts, used)
        # the prior counts as one more example without a term
        base = float((toxic[~has].sum() + prior) / ((~has).sum() + 1))
        model = Neighbours(idf, used, None, ids[has], toxic[has], base, k, softness)
        if not has.any():
            models.append((np.inf, model))
            continue
        model.index = BlockMaxIndex(bounds, terms, unit_vectors(bounds, terms, counts, idf), len(idf), block)
        votes = np.full(len(toxic), base)
        votes[has] = model.votes(*model.neighbours(bounds, terms, counts, np.arange(int(has.sum()))))
        model.steps = isotonic(votes, toxic)
        score = model.calibrated(votes)
        models.append((-float(np.log(np.where(toxic > 0, score, 1 - score)).mean()), model))
    return min(models, key=lambda x: x[0])[1]


def train(docs: DataFrame, labels: DataFrame, sample_rows: int, terms: int, k: int, softness: float) -> tuple[Neighbours, DataFrame]:
    """The model, and the terms of every row of ``docs`` as a written table."""
    order = [F.xxhash64("doc_id"), "doc_id", "toxic"]
    sample = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_test(F.col("doc_id")))
        .orderBy(*order)
        .limit(sample_rows)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    known, g2 = known_terms(texts.select("text", "toxic"), terms)
    table = keep_table(term_table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), known, ["doc_id"]), "terms")
    having = documents_with(table, len(known)).toPandas()  # a number for each known term
    n = np.zeros(len(known))
    n[having["term"].to_numpy(int)] = having["n"].to_numpy(float)
    idf = np.log((1 + table.count()) / (1 + n)) + 1
    examples = table.join(F.broadcast(sample), "doc_id").orderBy(*order, F.xxhash64("terms", "counts")).limit(sample_rows)  # ids may repeat, so once more
    return fit(examples.toArrow(), idf, g2, k, softness), table


SCORES = "doc_id long, score double, evidence array<struct<doc_id:long,toxic:int,cosine:double>>"


def toxicity(
    docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, terms: int = 2048, k: int = 15, softness: float = 0.1
) -> DataFrame:
    """``doc_id``, ``score`` and ``evidence`` (the neighbours that voted, nearest first) of every row of ``docs``."""
    model, table = train(docs, labels, sample_rows, terms, k, softness)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            has, *vectors = _only(*_flat(batch.column("terms")), _flat(batch.column("counts"))[1], m.used)
            rows, cosines = np.full((batch.num_rows, m.k), -1), np.zeros((batch.num_rows, m.k))
            if m.index is not None and has.any():
                rows[has], cosines[has] = m.neighbours(*vectors)
            votes = m.votes(rows, cosines)
            score = votes if m.steps is None else m.calibrated(votes)
            there = rows >= 0
            voters = pa.StructArray.from_arrays(
                [pa.array(m.ids[rows[there]]), pa.array(m.toxic[rows[there]].astype(np.int32)), pa.array(cosines[there])], names=["doc_id", "toxic", "cosine"]
            )
            cuts = pa.array(np.append(0, np.cumsum(there.sum(1))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.ListArray.from_arrays(cuts, voters)], names=["doc_id", "score", "evidence"])

    return table.mapInArrow(run, SCORES)


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, and its voters as id, label and cosine, the nearest first."""
    found = toxicity(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "labels"))
    voter = lambda v: F.concat_ws(":", v["doc_id"].cast("string"), v["toxic"].cast("string"), F.format_string("%.4f", v["cosine"]))
    return found.select(
        "doc_id",
        is_test(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.array_join(F.transform("evidence", voter), " ").alias("evidence"),
    )
