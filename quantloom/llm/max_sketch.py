"""Ranked lexical search with hashed max-sketches.

A term t with weight w adds w * f to the score of a document in which it occurs
tf times, f growing with tf and falling with the document's length.  A
document's *sketch* has ``WIDTH`` coordinates; each holds the largest impact
w * f of the document's terms that hash to it.  The sum of the coordinates of an
item's terms is never below the item's score, so documents are opened in
descending order of that bound, scored exactly, and left closed from where the
bound falls below the item's tenth score so far.

One pass gathers the statistics (documents, terms, document frequencies), one
builds the sketches and searches them, each task with its part of the documents
and all items of a batch: the bounds of a batch are one matrix product.  The ten
best of every task are merged at the end.  A batch has at most ``BATCH_TERMS``
distinct item terms on average; more items mean more batches.

A task must know the weight of every term for its sketches.  The ``FREQUENT``
most frequent terms have theirs; for any other the weight of a term of one
document is taken, which is never smaller, so bounds stay bounds at any size of
the vocabulary.  Exact scores use exact weights, which come with the items.

Terms are told apart by 64-bit hashes.  Only a clash with a term of an item
matters; with 10^4 such terms and 10^9 in the corpus its chance is 10^-6.

Defined results.  Null texts have no terms and are never returned; nor are
scores of 0.  Rows are documents of their own: repeated rows each get a rank;
documents with equal score are in order of doc_id, null last.  Rows of the
benchmark with one item_id are one item with the terms of all; a null item_id is
an id like others.  Items without terms have no rows.  Other columns are
ignored.  Empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import scratch
from quantloom.llm.kernels import CHUNK_BYTES, range_hash, rolling_sums, text_buffers

#: Coordinates of a sketch.
WIDTH = 8192
TOP = 10
#: Documents and bytes of text that are searched at a time; a longer text is searched alone.
PIECE_DOCS, PIECE_BYTES = 1024, 2 << 20
#: More than what 32-bit sums of ``WIDTH`` addends can fall short by.
ROUNDING = 1.001
#: Candidates of an item that are opened at a time.
OPENED = 32
FREQUENT = 200_000
#: Distinct terms over the items of a batch, about.
BATCH_TERMS = 30_000
_TERM = np.zeros(256, bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[0x41:0x5B] += 32


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def term_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of the texts in ``raw`` in order, and each text's bounds in them."""
    term = _TERM[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[offsets] = True
    begins, ends = term.copy(), term.copy()
    begins[1:] &= ~term[:-1] | cut[1:-1]
    ends[:-1] &= ~term[1:] | cut[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    del term, cut, begins, ends
    hashes, at = np.empty(len(start), np.uint64), 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + CHUNK_BYTES, side="right")))
        sums = rolling_sums(_LOWER[raw[start[at] : end[to - 1]]])
        hashes[at:to] = range_hash(sums, start[at:to] - start[at], end[at:to] - start[at])
        at = to
    return hashes.view(np.int64), np.searchsorted(start, offsets)


def _pieces(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + PIECE_BYTES, side="right")) - 1
        last = min(max(last, first + 1), n, first + PIECE_DOCS)
        yield first, last
        first = last


class Piece:
    """Distinct terms of some documents: (document, term) pairs in order, with their frequencies."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        hashes, bounds = term_hashes(raw, offsets)
        self.docs = len(offsets) - 1
        self.length = np.diff(bounds)
        self.vocabulary, place = np.unique(hashes, return_inverse=True)
        owner = np.repeat(np.arange(self.docs), self.length)
        self.keys, self.tf = np.unique(owner * max(len(self.vocabulary), 1) + place, return_counts=True)
        self.owner, self.term = np.divmod(self.keys, max(len(self.vocabulary), 1))


def _each_piece(batches, text: str):
    for batch in batches:
        raw, offsets = text_buffers(batch.column(text))
        for first, last in _pieces(offsets):
            yield batch, first, last, Piece(raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])


def statistics(docs: DataFrame) -> tuple[int, int, DataFrame]:
    """Documents with a term, all terms, and a table (term, df)."""

    def run(batches):
        for _, _, _, piece in _each_piece(batches, "text"):
            df = np.bincount(piece.term, minlength=len(piece.vocabulary))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(piece.vocabulary, 0)), pa.array(np.append(df, 0)), pa.array(np.append(np.zeros(len(df), np.int64), np.count_nonzero(piece.length))), pa.array(np.append(np.zeros(len(df), np.int64), piece.length.sum()))],
                ["term", "df", "docs", "terms"],
            )

    counted = docs.select("text").mapInArrow(run, "term long, df long, docs long, terms long")
    table = scratch(counted.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("df", "docs", "terms")]), "term-counts")
    sums = table.agg(F.sum("docs"), F.sum("terms")).first()
    return sums[0] or 0, sums[1] or 0, table.filter(F.col("df") > 0).select("term", "df")


def item_terms(items: DataFrame) -> DataFrame:
    """item_id and each distinct term of the item, with its text's hash as the documents' terms have it."""

    def run(batches):
        for batch, first, last, piece in _each_piece(batches, "text"):
            ids = batch.column("item").slice(first, last - first)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(piece.owner)), pa.array(piece.vocabulary[piece.term])], ["item", "term"])

    given = items.select(F.struct("item_id").alias("item"), "text")
    kind = items.schema["item_id"].dataType.simpleString()
    return given.mapInArrow(run, f"item struct<item_id: {kind}>, term long").distinct()


def frequent_terms(counts: DataFrame, most: int = FREQUENT) -> DataFrame:
    """At most ``most`` terms of the highest document frequencies: all from some power of two on."""
    level = F.floor(F.log2("df"))
    kept, floor = 0, 64
    for row in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):
        kept += row["count"]
        if kept > most:
            break
        floor = row["level"]
    return counts.filter(level >= floor)


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score of each item's best documents."""
    spark = docs.sparkSession
    n_docs, n_terms, counts = statistics(docs)
    out_type = "item int, doc_id long, score long"
    known = scratch(item_terms(items).join(counts, "term", "left"), "item-terms")
    numbers = known.select("item").distinct()
    distinct = known.count()
    batches = max(1, -(-distinct // BATCH_TERMS))
    often = frequent_terms(counts).toArrow()
    order = np.argsort(often.column("term").to_numpy())
    frequent = spark.sparkContext.broadcast(
        (often.column("term").to_numpy()[order], np.array([weight(n_docs, d) for d in often.column("df").to_numpy()[order].tolist()], np.int64))
    )
    highest = weight(n_docs, 1) if n_docs else 0
    found = None
    for k in range(batches):
        part = known.filter(F.pmod(F.xxhash64("item"), F.lit(batches)) == k).orderBy("item", "term").toArrow()
        rows = part.column("item").to_pylist()
        ids = list({r["item_id"]: None for r in rows})
        index = {x: i for i, x in enumerate(ids)}
        owner = np.array([index[r["item_id"]] for r in rows], np.int64)
        df = part.column("df").fill_null(0).to_numpy()
        weights = np.array([weight(n_docs, d) if d else 0 for d in df.tolist()], np.int64)
        # A term of no document adds nothing to any score.
        queries = spark.sparkContext.broadcast((len(ids), owner[df > 0], part.column("term").to_numpy()[df > 0], weights[df > 0]))
        best = _searched(docs, queries, frequent, (n_docs, n_terms, highest), top, out_type)
        if not ids:
            continue
        named = spark.createDataFrame(
            pa.table({"number": pa.array(range(len(ids)), pa.int32()), "item_id": pa.array(ids, part.schema.field("item").type.field(0).type)})
        )
        ranked = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = best.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top)
        best = best.join(F.broadcast(named), F.col("item") == F.col("number")).select("item_id", "rank", "doc_id", "score")
        found = best if found is None else found.unionByName(best)
    if found is None:
        kind = items.schema["item_id"].dataType.simpleString()
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return found


class Search:
    """The items of a batch, and each one's best documents in the texts seen so far."""

    def __init__(self, queries, frequent, totals, top):
        self.n, owner, term, weights = queries
        self.known, self.known_weight = frequent
        self.n_docs, self.n_terms, self.highest = totals
        self.top = top
        self.order = np.argsort(owner, kind="stable")
        self.term, self.weight = term[self.order], weights[self.order]
        self.at = np.searchsorted(owner[self.order], np.arange(self.n + 1))
        # How many terms of each item are in each coordinate.
        self.lookup = np.zeros((WIDTH, self.n), np.float32)
        np.add.at(self.lookup, (self._coordinate(self.term), owner[self.order]), 1)
        self.best: list[list[tuple[int, float, int | None]]] = [[] for _ in range(self.n)]
        self.least = np.ones(self.n)

    @staticmethod
    def _coordinate(term: np.ndarray) -> np.ndarray:
        return (term.view(np.uint64) >> np.uint64(40)).astype(np.int64) % WIDTH

    def _factor(self, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The part of an impact that depends on the document."""
        m = 10 + (90 * length * self.n_docs) // max(self.n_terms, 1)
        return (1_000_000_000 * tf) // (1000 * tf + 8 * m)

    def sketches(self, piece: Piece) -> np.ndarray:
        place = np.minimum(np.searchsorted(self.known, piece.vocabulary), max(len(self.known) - 1, 0))
        weights = np.full(len(piece.vocabulary), self.highest, np.int64)
        if len(self.known):
            weights = np.where(self.known[place] == piece.vocabulary, self.known_weight[place], weights)
        impact = weights[piece.term] * self._factor(piece.tf, piece.length[piece.owner])
        cell = piece.owner * WIDTH + self._coordinate(piece.vocabulary)[piece.term]
        out = np.zeros(piece.docs * WIDTH, np.float32)
        np.maximum.at(out, cell, impact.astype(np.float32))
        return out.reshape(piece.docs, WIDTH)

    def scores(self, piece: Piece, item: int, docs: np.ndarray) -> np.ndarray:
        """Exact scores of some documents for an item."""
        span = slice(self.at[item], self.at[item + 1])
        place = np.searchsorted(piece.vocabulary, self.term[span])
        place = np.minimum(place, len(piece.vocabulary) - 1)
        here = piece.vocabulary[place] == self.term[span]
        place, weights = place[here], self.weight[span][here]
        keys = docs[:, None] * len(piece.vocabulary) + place[None, :]
        at = np.minimum(np.searchsorted(piece.keys, keys), len(piece.keys) - 1)
        tf = np.where(piece.keys[at] == keys, piece.tf[at], 0)
        return (self._factor(tf, piece.length[docs][:, None]) * weights[None, :]).sum(axis=1)

    def add(self, piece: Piece, ids: list[int | None]) -> None:
        if not len(piece.keys):
            return
        bounds = (self.sketches(piece) @ self.lookup) * np.float32(ROUNDING)
        for item in np.flatnonzero((bounds >= self.least).any(axis=0)).tolist():
            bound = bounds[:, item]
            docs = np.flatnonzero(bound >= self.least[item])
            docs = docs[np.argsort(-bound[docs], kind="stable")]
            for k in range(0, len(docs), OPENED):
                some = docs[k : k + OPENED]
                some = some[bound[some] >= self.least[item]]
                if not len(some):
                    break
                for doc, score in zip(some.tolist(), self.scores(piece, item, some).tolist(), strict=True):
                    if score > 0:
                        key = ids[doc]
                        self.best[item].append((-score, math.inf if key is None else key, key))
                kept = sorted(self.best[item], key=lambda x: x[:2])[: self.top]
                self.best[item] = kept
                if len(kept) == self.top:
                    self.least[item] = max(1, -kept[-1][0])


def _searched(docs: DataFrame, queries, frequent, totals, top: int, out_type: str) -> DataFrame:
    def run(batches):
        own = Search(queries.value, frequent.value, totals, top)
        for batch, first, last, piece in _each_piece(batches, "text"):
            own.add(piece, batch.column("doc_id").slice(first, last - first).to_pylist())
        rows = [(i, key, -score) for i, kept in enumerate(own.best) for score, _, key in kept]
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        kinds = (pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["item", "doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, out_type)


def op11_search(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP11_SQL = r"""
WITH dt AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM dt GROUP BY ALL),
dn AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
s AS (SELECT count(*) AS nd, sum(n)::BIGINT AS l FROM dn),
it AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
w AS (
  SELECT term, floor(1000 * ln((2 * any_value(nd) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM tf, s WHERE term IN (SELECT term FROM it) GROUP BY term),
sc AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nd) // l))))::BIGINT AS score
  FROM it JOIN w USING (term) JOIN tf USING (term) JOIN dn USING (doc_id), s GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM sc WHERE score > 0)
SELECT item_id, k::INTEGER AS rank, doc_id, score FROM r WHERE k <= 10
"""
