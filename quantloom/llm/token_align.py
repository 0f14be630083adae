"""Alignment of the tokens of two tokenizers over the same texts.

Tokenizer A is a byte-level one of the ``tokenizers`` library, B a byte-fallback
one of ``sentencepiece``.  Both see a text with a space before it.  A's character
offsets and B's proto spans are coarse cuts in bytes; a token whose coarse span
has another length than its decoded bytes (a part of a character, a byte
fallback, the space before the text) is cut by its decoded bytes.  Where tokens
of both end, a *group* ends; tokens whose byte ranges overlap are *linked*.

Texts are not encoded whole.  Neither tokenizer has a token across a single
space between two characters that are no white space (A's splitting pattern ends
a token there, and no piece of B has a space behind another character, which is
checked when B is loaded), so texts are cut there, each distinct stretch of a
task is aligned once, and a document's result is put together from its
stretches.  A document of any length is worked on in parts of ``PART_CHARS``.

Links are then looked up in the corpus: an id pair's count is the number of
documents that hold it linked.  The most frequent pairs, at most
``LOOKUP_PAIRS``, are looked up in arrays that every task has; the others by a
shuffled join, so that no pair however common is a hot key of it.

Defined results.  A text that is null, empty, or whose joined tokens of A or B
are not the bytes of space and text (it holds U+2581, or a character that a
tokenizer changes) has no tokens: zeros and an empty digest.  Special tokens'
strings are plain text.  Each row is a document of its own, also with a null or
repeated doc_id.  Columns beside doc_id and the text are ignored.  An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import scratch

#: Folder of the tokenizer files, the same on every machine.
TOKENIZERS = "/opt/tokenizers"
FILE_A = "byte_bpe_50k.json"
FILE_B = "piece_bpe_32k.model"
#: Characters of a document that are worked on at a time.
PART_CHARS = 1 << 19
#: A task forgets its aligned stretches when they have more characters than this.
KEPT_CHARS = 1 << 22
#: Pairs that are looked up in arrays, 17 bytes each.
LOOKUP_PAIRS = 1_000_000
#: A single space between characters that are no white space.
CUT = re.compile(r"(?<=\S) (?=\S)")
_FALLBACK = re.compile(r"<0x([0-9A-F]{2})>")
_MARKS = (",", "|", ",", ";", "\n")
_OPEN: dict[str, Aligner] = {}


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def refined(begin: np.ndarray, end: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Where each token ends, in bytes: its coarse span's end if that has the token's size, else cut by decoded bytes."""
    total = np.cumsum(size)
    fit = np.maximum.accumulate(np.where(end - begin == size, np.arange(len(size)), -1))
    return np.where(fit < 0, total, end[fit] + total - total[fit])


class Aligner:
    """Both tokenizers, and the alignments of stretches seen so far."""

    def __init__(self, folder: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(os.path.join(folder, FILE_A))
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=os.path.join(folder, FILE_B))
        byte = byte_alphabet()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for entry, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(byte[c] for c in entry) if all(c in byte for c in entry) else b""
        self.bytes_b = []
        for i in range(len(self.b)):
            piece = self.b.id_to_piece(i)
            if "▁" in piece.lstrip("▁"):
                raise ValueError(f"{FILE_B}: piece {i} goes on behind a space, so texts cannot be cut there")
            code = _FALLBACK.fullmatch(piece)
            self.bytes_b.append(bytes([int(code[1], 16)]) if code else piece.replace("▁", " ").encode())
        self.size_a, self.size_b = (np.array([len(x) for x in table], np.int64) for table in (self.bytes_a, self.bytes_b))
        # An id as text before each mark that may follow it: within A, after A, within B, after a group, after a stretch.
        self.names = [f"{i}{mark}" for i in range(max(len(self.bytes_a), len(self.bytes_b))) for mark in _MARKS]
        self.forget()

    def forget(self) -> None:
        """Drop all alignments."""
        self.number: dict[str, int] = {}
        self.held = 0
        self.text: list[bytes | None] = []
        self.counts = np.zeros((0, 4), np.int64)
        self.at = np.zeros(1, np.int64)
        self.pairs = np.zeros(0, np.int64)

    def encode(self, text: str) -> tuple[list[int], np.ndarray, list[int], np.ndarray] | None:
        """Ids and ends (bytes of space and text) of A and of B; None where a tokenizer's bytes differ from the text's."""
        raw = f" {text}".encode()
        a, b = self.a.encode(f" {text}", add_special_tokens=False), self.b.encode(text, return_type="proto")
        ids_a, spans_b = a.ids, np.fromiter(chain.from_iterable([(p.id, p.begin, p.end) for p in b.pieces]), np.int64).reshape(-1, 3)
        ids_b = spans_b[:, 0].tolist()
        if b"".join([self.bytes_a[i] for i in ids_a]) != raw or b"".join([self.bytes_b[i] for i in ids_b]) != raw:
            return None
        coarse_a = np.fromiter(chain.from_iterable(a.offsets), np.int64).reshape(-1, 2)
        if len(raw) != len(text) + 1:
            char = np.append(np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80), len(raw))
            coarse_a = char[coarse_a]
        # The space before the text is not in B's spans; it belongs to the first piece.
        coarse_b = spans_b[:, 1:] + 1
        coarse_b[:1, 0] = 0
        return ids_a, refined(*coarse_a.T, self.size_a[np.array(ids_a)]), ids_b, refined(*coarse_b.T, self.size_b[spans_b[:, 0]])

    def _learn(self, fresh: list[str]) -> list[tuple]:
        """Alignments of stretches, encoded together; halves where bytes differ or a cut is not one of the tokens."""
        found = self.encode(" ".join(fresh))
        ends = np.cumsum([len(s.encode()) + 1 for s in fresh])
        if found is not None:
            ids_a, ends_a, ids_b, ends_b = found
            # How many tokens end at each byte.
            seen = np.zeros(int(ends[-1]) + 1, np.int8)
            seen[ends_a] += 1
            seen[ends_b] += 1
            if (seen[ends] == 2).all():
                return [(fresh, ends, seen, *found)]
        if len(fresh) == 1:
            return [(fresh, ends, None, None, None, None, None)]
        half = len(fresh) // 2
        return self._learn(fresh[:half]) + self._learn(fresh[half:])

    def learn(self, stretches: list[str]) -> None:
        """Align the stretches that are not known yet."""
        fresh = [s for s in dict.fromkeys(stretches) if s not in self.number]
        if "▁" in "".join(fresh):
            # B writes it as a space.
            self.number.update((s, -1) for s in fresh if "▁" in s)
            fresh = [s for s in fresh if "▁" not in s]
        counts, sizes, pairs = [self.counts], [np.diff(self.at)], [self.pairs]
        for some, ends, seen, ids_a, ends_a, ids_b, ends_b in self._learn(fresh) if fresh else []:
            n = len(some)
            self.number.update(zip(some, range(len(self.text), len(self.text) + n), strict=True))
            self.held += int(ends[-1])
            if seen is None:
                self.text.append(None)
                counts.append(np.zeros((1, 4), np.int64))
                sizes.append(np.zeros(1, np.int64))
                continue
            both = np.flatnonzero(seen == 2)
            # Every end of a token closes an interval that one token of A and one of B cover: a link.
            closed = np.flatnonzero(seen)
            owner = np.searchsorted(ends, closed)
            pairs.append((np.array(ids_a, np.int64)[np.searchsorted(ends_a, closed)] << 32) | np.array(ids_b, np.int64)[np.searchsorted(ends_b, closed)])
            sizes.append(np.bincount(owner, minlength=n))
            counts.append(np.stack([np.bincount(np.searchsorted(ends, e), minlength=n) for e in (ends_a, ends_b, both)] + [sizes[-1]], axis=1))
            group_a, group_b = np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)
            mark_a = (ends_a == both[group_a]).astype(np.int64)
            last = np.zeros(len(seen), bool)
            last[ends] = True
            mark_b = 2 + (ends_b == both[group_b]) + last[ends_b]
            marked = np.concatenate([np.array(ids_a) * len(_MARKS) + mark_a, np.array(ids_b) * len(_MARKS) + mark_b])
            order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
            self.text += "".join([self.names[k] for k in marked[order].tolist()]).encode().split(b"\n")[:-1]
        self.counts, self.pairs = np.concatenate(counts), np.concatenate(pairs)
        self.at = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])

    def parts(self, text: str) -> Iterator[list[str]]:
        """The stretches of a text in order, part by part."""
        at = 0
        while at <= len(text):
            cut = CUT.search(text, at + PART_CHARS) if len(text) - at > PART_CHARS else None
            end = cut.start() if cut else len(text)
            yield CUT.split(text[at:end])
            at = end + 1

    def prepare(self, stretches: list[str]) -> None:
        """Align what is new, after forgetting if much is held."""
        if self.held > KEPT_CHARS:
            self.forget()
        self.learn(stretches)

    def digests(self, texts: list[str | None]) -> Iterator[tuple[list[int], str, np.ndarray, np.ndarray]]:
        """Counts (a, b, groups, links), digest of the groups, distinct linked pairs and how often each, of every text."""
        # Long texts first: what they make room for is not needed again.
        long = {i: self._digest(self.parts(t), prepare=True) for i, t in enumerate(texts) if t and len(t) > PART_CHARS}
        short = {i: CUT.split(t) for i, t in enumerate(texts) if t and i not in long}
        self.prepare([s for stretches in short.values() for s in stretches])
        for i in range(len(texts)):
            yield long[i] if i in long else self._digest([short[i]] if i in short else [])

    def _digest(self, parts, prepare: bool = False):
        none = [0, 0, 0, 0], "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        sums, sha, pairs, times, any_part = np.zeros(4, np.int64), hashlib.sha256(), none[2], none[3], False
        for stretches in parts:
            if prepare:
                self.prepare(stretches)
            numbers = list(map(self.number.__getitem__, stretches))
            if min(numbers) < 0:
                return none
            text = list(map(self.text.__getitem__, numbers))
            if None in text:
                return none
            sha.update((b";" if any_part else b"") + b";".join(text))
            any_part = True
            distinct, often = np.unique(np.array(numbers), return_counts=True)
            sums += often @ self.counts[distinct]
            size = self.at[distinct + 1] - self.at[distinct]
            place = np.repeat(self.at[distinct] - np.cumsum(size) + size, size) + np.arange(size.sum())
            codes, inverse = np.unique(np.concatenate([pairs, self.pairs[place]]), return_inverse=True)
            times = np.bincount(inverse, np.concatenate([times, np.repeat(often, size)]), len(codes)).astype(np.int64)
            pairs = codes
        return (sums.tolist(), sha.hexdigest(), pairs, times) if any_part else none


def aligner(folder: str) -> Aligner:
    """The process's tokenizers of a folder."""
    if folder not in _OPEN:
        _OPEN[folder] = Aligner(folder)
    return _OPEN[folder]


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *[len(v) for v in values]])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *values])))


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def alignments(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """The groups themselves: doc_id, part, start, a, b and size of every group of every document.

    ``part`` counts the parts of a document, ``groups`` holds in order the ids of
    both tokenizers and the bytes from ``start`` (in space and text) to ``end``.
    A document without tokens has no row.
    """
    group = "struct<start:bigint,end:bigint,a:array<int>,b:array<int>>"

    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))

    def run(batches):
        own = aligner(folder)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text or next(own.digests([text]))[1] == "":
                    continue
                start = 0
                for part, stretches in enumerate(own.parts(text)):
                    ids_a, ends_a, ids_b, ends_b = own.encode(" ".join(stretches))
                    both = np.intersect1d(ends_a, ends_b)
                    to_a, to_b = ((np.searchsorted(e, both) + 1).tolist() for e in (ends_a, ends_b))
                    ends = (start + both).tolist()
                    rows = [
                        {"start": b, "end": e, "a": ids_a[p:q], "b": ids_b[r:s]}
                        for b, e, p, q, r, s in zip([start, *ends], ends, [0, *to_a], to_a, [0, *to_b], to_b)
                    ]
                    start = ends[-1]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc], pa.int64()), pa.array([part], pa.int32()), pa.array([rows], kind)], ["doc_id", "part", "groups"]
                    )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, part int, groups array<{group}>")


def document_links(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """row, doc_id, counts, groups_sha256, and the document's distinct linked pairs (a * 2^32 + b) with their times."""

    def run(batches):
        own = aligner(folder)
        for batch in batches:
            row, doc, text = (batch.column(i) for i in range(3))
            size = np.cumsum([0, *[len(t or "") for t in text.to_pylist()]])
            first = 0
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(size, size[first] + PART_CHARS, side="right")) - 1)
                done = list(own.digests(text.slice(first, last - first).to_pylist()))
                counts = np.array([d[0] for d in done], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [row.slice(first, last - first), doc.slice(first, last - first)]
                    + [pa.array(counts[:, i]) for i in range(4)]
                    + [pa.array([d[1] for d in done], pa.string()), _lists([d[2] for d in done]), _lists([d[3] for d in done])],
                    ["row", "doc_id", *_COUNTS, "groups_sha256", "pairs", "times"],
                )
                first = last

    given = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = ", ".join(f"{c} long" for c in _COUNTS)
    return given.mapInArrow(run, f"row long, doc_id long, {counts}, groups_sha256 string, pairs array<long>, times array<long>")


def pair_counts(links: DataFrame) -> DataFrame:
    """pair, n (documents that hold it) and best (no pair with the same id of A has more), one row per pair of the corpus."""
    counts = scratch(links.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pairs")
    counts = counts.withColumn("a", F.shiftright("pair", 32))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return scratch(counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair-counts")


def frequent(counts: DataFrame, most: int = LOOKUP_PAIRS) -> tuple[DataFrame, DataFrame | None]:
    """The frequent pairs, at most ``most``, and the others, None if there are none."""
    level = F.floor(F.log2("n"))
    levels = {r["level"]: r["count"] for r in counts.groupBy(level.alias("level")).count().collect()}
    floor, total = max(levels, default=0) + 1, 0
    while floor - 1 in levels or (levels and floor > min(levels)):
        total += levels.get(floor - 1, 0)
        if total > most:
            break
        floor -= 1
    if not levels or floor <= min(levels):
        return counts, None
    return counts.filter(level >= floor), counts.filter(level < floor)


def link_sums(links: DataFrame, counts: DataFrame, most: int = LOOKUP_PAIRS) -> DataFrame:
    """``links`` without its arrays, with n_best (links whose pair is best) and count_sum (counts over links)."""
    spark = links.sparkSession
    top, others = frequent(counts, most)
    table = top.orderBy("pair").toArrow()
    known = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("pair", "n", "best")))

    def look_up(batch):
        pairs, ends = batch.column("pairs").flatten().to_numpy(), np.cumsum([0, *batch.column("pairs").value_lengths().to_pylist()])
        times = batch.column("times").flatten().to_numpy()
        keys, n, best = known.value
        place = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
        hit = keys[place] == pairs if len(keys) else np.zeros(len(pairs), bool)
        return pairs, times, ends, place, hit, n, best

    def sums(batches):
        for batch in batches:
            pairs, times, ends, place, hit, n, best = look_up(batch)
            out = []
            for value in (best, n):
                each = np.where(hit, value[place] if len(value) else 0, 0) * times
                total = np.concatenate([[0], np.cumsum(each, dtype=np.int64)])
                out.append(pa.array(total[ends[1:]] - total[ends[:-1]]))
            kept = [c for c in batch.schema.names if c not in ("pairs", "times")]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + out, [*kept, "n_best", "count_sum"])

    def rest(batches):
        for batch in batches:
            pairs, times, ends, _, hit, _, _ = look_up(batch)
            row = np.repeat(batch.column("row").to_numpy(), np.diff(ends))
            yield pa.RecordBatch.from_arrays([pa.array(x[~hit]) for x in (row, pairs, times)], ["row", "pair", "times"])

    head = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    found = links.mapInArrow(sums, f"{head}, n_best long, count_sum long")
    if others is None:
        return found
    more = (
        links.select("row", "pairs", "times")
        .mapInArrow(rest, "row long, pair long, times long")
        .join(others, "pair")
        .groupBy("row")
        .agg(F.sum(F.col("best").cast("long") * F.col("times")).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more_sum"))
    )
    return found.join(more, "row", "left").select(
        *[c for c in found.columns if c not in ("n_best", "count_sum")],
        *[(F.col(c) + F.coalesce(F.col(m), F.lit(0))).alias(c) for c, m in (("n_best", "more_best"), ("count_sum", "more_sum"))],
    )


def align_documents(docs: DataFrame, folder: str = TOKENIZERS, most: int = LOOKUP_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document."""
    links = scratch(document_links(docs, folder), "links")
    out = link_sums(links, pair_counts(links), most)
    return out.select("doc_id", *_COUNTS, "n_best", "count_sum", "groups_sha256")


def op12_align(spark, sf_dir: str) -> DataFrame:
    return align_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
