r"""Removal of repeated strings with a Burrows-Wheeler transform built column by column.

A byte goes if a ``LENGTH``-byte string that covers it also starts in a document
with a smaller doc_id.  Strings are judged on the input.

Partition.  Every window of ``LENGTH`` bytes has a minimizer, the smallest hash
among its ``GRAM``-byte pieces; equal windows have equal minimizers.  Windows in
a row with the same minimizer form one *stretch* of less than two windows'
length.  Only stretches whose minimizer occurs in two documents can matter, and
all that may share a window share the minimizer, so collections of stretches
can be treated apart.

Transform.  Within a collection, round j inserts one symbol of every stretch,
from its end: the suffix of length j is placed by the rank of its first symbol
in the transform so far, and the common prefix with its neighbours is one more
than the least common prefix between the places its tail and theirs hold.  The
transform and the common prefixes are arrays that each round rewrites in one
sequential merge; they take the place of the method's external files, since a
collection is bounded.  Runs of suffixes with common
prefixes of LENGTH or more are the occurrences of one string; the smallest
doc_id of a run decides.

Stretches that agree with no other one around their minimizer are left out of
the transform; a window they share with nobody needs no sorting.

Equal stretches are merged first, after a comparison of their bytes, so a passage
in a million documents is one string of its collection.  Minimizers with more
than ``HOT`` stretches after a first merge inside each task are not built as one
collection: their windows are grouped one by one, by content.

Defined results.  Null text has no bytes.  A null doc_id matches nothing and
loses nothing.  Rows with equal doc_id do not remove from each other.  Repeated
rows each get a row.  Texts may hold any bytes, valid UTF-8 or not.  Texts shorter than LENGTH lose nothing.  Columns beside
doc_id and text are ignored.

Scale.  Exact copies are settled by hash first.  Minimizers are about one per 18
bytes, counted with pre-aggregation and joined back by sort-merge join, which
splits hot ones; equal stretches are merged before they are shuffled and sorted.  Each step
writes its table to the shared folder, and tables no longer needed are deleted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm import kernels
from quantloom.llm.common import drop_scratch, free_shuffles, scratch

LENGTH = 50
GRAM = 16
_FIRST, _SECOND, _THIRD = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
HOT = 20_000
#: Minimizers above that bound are at most one per HOT stretches; up to this many they are broadcast.
BROADCAST_HOT = 200_000
#: Stretches in one collection, besides those of its last minimizer.
COLLECTION = 4_000
#: Ids of exact copies up to this many are broadcast; beyond, a shuffled join.
BROADCAST_IDS = 500_000
_DOCS = "doc_id long, mark int, text string"


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the GRAM = 16 bytes from every place of a buffer on: two words of eight bytes, mixed."""
    n = len(raw) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    words = np.empty(n + 8, np.uint64)
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    for k in range(8):
        shown = words[k::8]
        shown[:] = padded[k : k + 8 * len(shown)].view("<u8")
    out = words[:n] * _FIRST
    out ^= words[8:] * _SECOND
    out ^= out >> np.uint64(32)
    out *= _THIRD
    out ^= out >> np.uint64(29)
    return out


def stretches(raw: np.ndarray, offsets: np.ndarray):
    """Text index, first byte, windows and minimizer of every stretch of the texts in a buffer."""
    none = np.zeros(0, np.int64)
    if len(raw) < LENGTH:
        return none, none, none, np.zeros(0, np.uint64)
    least, width, have = gram_hashes(raw), LENGTH - GRAM + 1, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    # A window must end in its text: the last LENGTH - 1 places of each text start none.
    steps = np.zeros(len(least) + 1, np.int8)
    stop = offsets[1:][np.diff(offsets) > 0]
    begin = np.maximum(offsets[:-1][np.diff(offsets) > 0], stop - LENGTH + 1)
    steps[begin[begin < len(least)]] += 1
    steps[stop[stop < len(least)]] -= 1
    inside = np.cumsum(steps[:-1], dtype=np.int8) == 0
    edge = np.ones(len(least) + 1, bool)
    edge[1:-1] = (least[1:] != least[:-1]) | (inside[1:] != inside[:-1])
    edge = np.flatnonzero(edge)
    keep = inside[edge[:-1]]
    head, run = edge[:-1][keep], np.diff(edge)[keep]
    # A minimizer that repeats within a text makes long runs; these are cut.
    cuts = -(-run // width)
    place = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    head = np.repeat(head, cuts) + place * width
    run = np.minimum(np.repeat(run, cuts) - place * width, width)
    return np.searchsorted(offsets, head, side="right") - 1, head, run, least[head]


def _minimizers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id and each distinct minimizer of a text."""
    for batch in batches:
        raw, offsets = kernels.text_buffers(batch.column("text"))
        ids = batch.column("doc_id").to_numpy()
        for a, b in kernels.pieces(offsets):
            owner, _, _, value = stretches(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            if not len(owner):
                continue
            order = np.lexsort((value, owner))
            owner, value = owner[order], value[order]
            new = np.ones(len(owner), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
            owner, value = owner[new], value[new]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[a + owner]), pa.array(value.view(np.int64))], names=["doc_id", "anchor"]
            )


def _must_agree(data: np.ndarray, a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> None:
    """Stop where two strings with one hash differ; they are merged by it."""
    alike = np.array_equal(size_a, size_b)
    if alike:
        step = np.arange(size_a.sum()) - np.repeat(np.cumsum(size_a) - size_a, size_a)
        alike = np.array_equal(data[np.repeat(a, size_a) + step], data[np.repeat(b, size_a) + step])
    if not alike:
        raise ValueError("two different stretches have the same hash and minimizer")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stretches of a text whose minimizer is in its list ``anchors``."""
    for batch in batches:
        raw, offsets = kernels.text_buffers(batch.column("text"))
        ids, marks = batch.column("doc_id").to_numpy(), batch.column("mark").to_numpy()
        lists = batch.column("anchors")
        at = lists.offsets.to_numpy().astype(np.int64)
        wanted = lists.values.to_numpy().view(np.uint64)
        for a, b in kernels.pieces(offsets):
            piece = raw[offsets[a] : offsets[b]]
            owner, start, run, value = stretches(piece, offsets[a : b + 1] - offsets[a])
            take = np.zeros(len(owner), bool)
            bounds = np.searchsorted(owner, np.arange(b - a + 1))
            for k in range(b - a):
                own = slice(bounds[k], bounds[k + 1])
                take[own] = np.isin(value[own], wanted[at[a + k] : at[a + k + 1]])
            owner, start, run, value = owner[take], start[take], run[take], value[take]
            if not len(owner):
                continue
            end = start + run + LENGTH - 1
            sums = kernels.rolling_sums(piece.astype(np.uint64))
            sid = kernels.range_hash(sums, start, end)
            # Of equal stretches here only that of the smallest document carries the bytes.
            order = np.lexsort((ids[a + owner], sid, value))
            new = np.ones(len(order), bool)
            new[1:] = (value[order][1:] != value[order][:-1]) | (sid[order][1:] != sid[order][:-1])
            lead = order[new]
            led = lead[np.cumsum(new) - 1]
            _must_agree(piece, start[order[~new]], start[led[~new]], (end - start)[order[~new]], (end - start)[led[~new]])
            count = np.zeros(len(owner), np.int64)
            count[lead] = np.diff(np.append(np.flatnonzero(new), len(order)))
            size = np.where(count > 0, end - start, 0)
            out_at = np.concatenate([[0], np.cumsum(size)])
            index = np.arange(out_at[-1]) + np.repeat(start - out_at[:-1], size)
            binary = pa.Array.from_buffers(
                pa.binary(),
                len(size),
                [
                    pa.py_buffer(np.packbits(count > 0, bitorder="little")),
                    pa.py_buffer(out_at.astype(np.int32)),
                    pa.py_buffer(piece[index]),
                ],
            )
            local = start - (offsets[a : b + 1] - offsets[a])[owner]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(value.view(np.int64)),
                    pa.array(sid.view(np.int64)),
                    pa.array(ids[a + owner]),
                    pa.array(marks[a + owner]),
                    pa.array(local.astype(np.int32)),
                    pa.array(count),
                    binary,
                ],
                names=["anchor", "sid", "doc_id", "mark", "start", "count", "bytes"],
            )


def _least_between(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minimum over [low, high] for many ranges, from minima over powers of two."""
    if not len(low):
        return np.zeros(0, np.uint8)
    level = np.frexp((high - low + 1).astype(np.float32))[1].astype(np.int64) - 1
    n = len(values)
    table = np.empty((int(level.max()) + 1, n), np.uint8)
    table[0] = values
    for k in range(1, len(table)):
        half, width = 1 << (k - 1), n + 1 - (1 << k)
        np.minimum(table[k - 1, :width], table[k - 1, half : half + width], out=table[k, :width])
    flat, base = table.ravel(), level * n
    return np.minimum(flat[base + low], flat[base + high + 1 - (1 << level)])


def column_transform(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Origins (string, start) in suffix order and common prefixes with the suffix before (at most 255).

    Built in as many rounds as the longest string has symbols, the strings being
    shorter than 255.  The transform is held by symbol: for each symbol, in
    order, the places where it stands, which are the places of the tails of the
    suffixes that it begins.  So an entry is symbol and tail's place in one
    number, and the entry's own rank is the suffix's.  The origins are read off
    the finished transform, by walking every string back from its end.
    """
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    longest = int(lengths.max(initial=0))
    # Symbols are numbered in order, so that any bytes will do.
    known = np.flatnonzero(np.bincount(data, minlength=1))
    number = np.zeros(256, np.int64)
    number[known] = np.arange(len(known))
    kind, bits = (np.uint32, 24) if n + len(data) < 1 << 24 else (np.int64, 48)
    shift, low_bits = kind(bits), kind((1 << bits) - 1)
    entries, common = np.zeros(0, kind), np.zeros(n, np.uint8)
    # Suffixes of length 0 come first, in the order of the strings.
    at = who = np.flatnonzero(lengths > 0)
    for length in range(1, longest + 1):
        symbol = number[data[offsets[who + 1] - length]]
        order = np.argsort(symbol, kind="stable")
        at, who = at[order], who[order]
        fresh = ((symbol[order] << bits) + at).astype(kind)
        smaller = np.searchsorted(entries, fresh)
        to = smaller + np.arange(len(fresh))
        old = np.ones(len(entries) + len(fresh), bool)
        old[to] = False
        merged = np.empty(len(old), kind)
        merged[old], merged[to] = entries, fresh
        # A new suffix and the one after it get new common prefixes with their predecessors.
        after = to + 1
        after = after[np.append(after[:-1] < to[1:], after[-1] < len(merged))]
        touched = np.concatenate([to[to > 0], after])
        here, before = merged[touched], merged[touched - 1]
        same = (here >> shift) == (before >> shift)
        low, high = (before[same] & low_bits).astype(np.int64) + 1, (here[same] & low_bits).astype(np.int64)
        value = np.zeros(len(touched), np.uint8)
        value[same] = _least_between(common, low, high) + np.uint8(1)
        grown = np.zeros(n + len(merged), np.uint8)
        grown[n:][old] = common[n:]
        grown[n + touched] = value
        # Places move up by the new suffixes before them.
        moved = np.zeros(n + len(entries), kind)
        np.subtract(np.flatnonzero(old), np.arange(len(entries)), out=moved[n:], casting="unsafe")
        merged += moved.take((merged & low_bits).astype(np.int64), mode="clip")
        left = lengths[who] > length
        entries, common, at, who = merged, grown, n + to[left], who[left]
    head = np.zeros(n + len(entries), np.int64)
    head[entries & low_bits] = np.arange(n, n + len(entries))
    owner, start = np.empty(len(head), np.int64), np.empty(len(head), np.int64)
    at = who = np.arange(n)
    for length in range(longest + 1):
        owner[at], start[at] = who, lengths[who] - length
        left = lengths[who] > length
        at, who = head[at[left]], who[left]
    return owner, start, common


def may_share(anchors: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which stretches may have a window in common with another one of the same minimizer.

    Equal windows hold the minimizer's piece at the same place, so they agree on
    the 17 bytes before it or on the 17 after it.  Minimizers that occur twice
    in one of their stretches are not judged here: all of theirs may.
    """
    n = len(anchors)
    reach = (LENGTH - GRAM) // 2
    sums = kernels.rolling_sums(data.astype(np.uint64))
    owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
    grams = gram_hashes(data)
    at = np.flatnonzero(grams == anchors[owner[: len(grams)]])
    at = at[at + GRAM <= offsets[1:][owner[at]]]
    held = np.bincount(owner[at], minlength=n)
    group = np.cumsum(np.concatenate([[0], anchors[1:] != anchors[:-1]]))
    open_ = (np.bincount(group, weights=held != 1) > 0)[group]
    alone = at[~open_[owner[at]]]
    shared = open_.copy()
    for low, high in ((alone - reach, alone + GRAM), (alone, alone + GRAM + reach)):
        who = owner[alone]
        fits = (low >= offsets[who]) & (high <= offsets[who + 1])
        who = who[fits]
        side = kernels.mix(kernels.range_hash(sums, low[fits], high[fits]) + anchors[who])
        _, inverse, count = np.unique(side, return_inverse=True, return_counts=True)
        shared[who[count[inverse] > 1]] = True
    return shared


def _least_docs(docs: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """String, window start and smallest document of every window of LENGTH bytes, in order."""
    owner, start, common = column_transform(data, offsets)
    new = common < LENGTH
    new[0] = True
    head = np.flatnonzero(new)
    least = np.minimum.reduceat(docs[owner], head)[np.cumsum(new) - 1]
    whole = start + LENGTH <= np.diff(offsets)[owner]
    owner, start, least = owner[whole], start[whole], least[whole]
    order = np.lexsort((start, owner))
    return owner[order], start[order], least[order]


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of windows with the same smallest document: anchor, sid, first, last, least."""

    def judged(table):
        # Equal stretches become one, with the smallest document and all their occurrences.
        keys = [table.column(c).to_numpy() for c in ("doc_id", "sid", "anchor")]
        order = np.lexsort(keys)
        anchor, sid = keys[2][order], keys[1][order]
        new = np.ones(len(order), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (sid[1:] != sid[:-1])
        count = np.add.reduceat(table.column("count").to_numpy()[order], np.flatnonzero(new))
        data, offsets = kernels.text_buffers(table.column("bytes"))
        led, size = order[new][np.cumsum(new) - 1][~new], np.diff(offsets)
        more = order[~new]
        _must_agree(data, offsets[more], offsets[led], size[more], size[led])
        table = table.take(pa.array(order[new]))
        data, offsets = kernels.text_buffers(table.column("bytes"))
        docs = table.column("doc_id").to_numpy()
        anchors = table.column("anchor").to_numpy().view(np.uint64)
        shared = may_share(anchors, data, offsets)
        # A stretch that shares nothing is its own only occurrence, from its first window to its last.
        lone = np.flatnonzero(~shared & (count > 1))
        chosen = np.flatnonzero(shared)
        picked = np.repeat(shared, np.diff(offsets))
        bounds = np.concatenate([[0], np.cumsum(np.diff(offsets)[chosen])])
        owner, start, least = _least_docs(docs[chosen], data[picked], bounds) if len(chosen) else (lone[:0],) * 3
        owner = chosen[owner]
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (least[1:] != least[:-1])
        head = np.flatnonzero(new)
        last = start[np.append(head[1:], len(owner))[: len(head)] - 1]
        who, least = owner[head], least[head]
        matters = (count[who] > 1) | (least < docs[who])
        pick = pa.array(np.concatenate([who[matters], lone]))
        whole = np.diff(offsets)[lone] - LENGTH
        return pa.RecordBatch.from_arrays(
            [
                table.column("anchor").combine_chunks().take(pick),
                table.column("sid").combine_chunks().take(pick),
                pa.array(np.concatenate([start[head][matters], 0 * whole]).astype(np.int32)),
                pa.array(np.concatenate([last[matters], whole]).astype(np.int32)),
                pa.array(np.concatenate([least[matters], docs[lone]])),
            ],
            names=["anchor", "sid", "first", "last", "least"],
        )

    for table in kernels.stream_blocks(batches, "anchor", COLLECTION):
        yield judged(table)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 from text and its removed ranges."""
    for batch in batches:
        raw, offsets = kernels.text_buffers(batch.column("text"))
        lists = batch.column("ranges")
        flat = lists.values
        at = lists.offsets.to_numpy().astype(np.int64)
        first = flat.field(0).to_numpy().astype(np.int64)
        last = flat.field(1).to_numpy().astype(np.int64)
        known = lists.is_valid().to_numpy(zero_copy_only=False)
        removed, spans, digests = [], [], []
        for k in range(batch.num_rows):
            own = raw[offsets[k] : offsets[k + 1]]
            gone = count = 0
            if known[k] and at[k + 1] > at[k]:
                low, high = first[at[k] : at[k + 1]], last[at[k] : at[k + 1]]
                order = np.argsort(low, kind="stable")
                low, high = low[order], np.maximum.accumulate(high[order])
                head = np.flatnonzero(np.concatenate([[True], low[1:] > high[:-1]]))
                low, high = low[head], high[np.append(head[1:], len(high)) - 1]
                gone, count = int((high - low).sum()), len(low)
                keep = np.ones(len(own), bool)
                for a, b in zip(low, high, strict=True):
                    keep[a:b] = False
                own = own[keep]
            removed.append(gone)
            spans.append(count)
            digests.append(hashlib.sha256(own.tobytes()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(np.diff(offsets)),
                pa.array(removed, pa.int64()),
                pa.array(spans, pa.int64()),
                pa.array(digests, pa.string()),
            ],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def _text_rows(docs: DataFrame, marked: bool) -> DataFrame:
    """doc_id, text and ``mark``, which tells texts with the same doc_id apart where there are such."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.hash("text") if marked else F.lit(0)).alias("mark"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def _identities(docs: DataFrame) -> tuple[DataFrame, bool]:
    """Hashes of all texts, and whether any doc_id occurs twice."""
    hashed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.hash("text").alias("mark"),
        F.xxhash64("text").alias("h1"),
        F.xxhash64(F.lit(29), F.col("text")).alias("h2"),
        F.octet_length("text").alias("n"),
    ).filter("doc_id is not null")
    hashed = scratch(hashed, "text-hashes")
    repeated = hashed.groupBy("doc_id").count().filter("count > 1").limit(1).collect()
    return hashed, bool(repeated)


def copy_ranges(hashed: DataFrame, marked: bool, length: int = LENGTH) -> DataFrame:
    """doc_id, mark, first, last of texts that an earlier document has as a whole."""
    hashed = hashed.filter(F.col("n") >= length)
    earliest = hashed.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("earliest"), F.max("doc_id").alias("latest"))
    mark = F.col("mark") if marked else F.lit(0)
    return scratch(
        hashed.join(earliest.filter("earliest < latest"), ["h1", "h2", "n"])
        .filter("doc_id > earliest")
        .select("doc_id", mark.alias("mark"), F.lit(0).alias("first"), F.col("n").alias("last")),
        "copy-ranges",
    )


def _hot_windows(hot: DataFrame) -> DataFrame:
    """The same runs as ``_judge``, one window each, for minimizers with very many stretches."""
    windows = hot.select(
        "anchor", "sid", "least", F.col("bytes"), F.explode(F.sequence(F.lit(0), F.length("bytes") - LENGTH)).alias("first")
    ).withColumn("window", F.substring("bytes", F.col("first") + 1, F.lit(LENGTH)))
    windows = windows.select("anchor", "sid", "first", "least", "window")
    earliest = windows.groupBy("window").agg(F.min("least").alias("earliest"))
    return windows.join(earliest, "window").select(
        "anchor", "sid", "first", F.col("first").alias("last"), F.col("earliest").alias("least")
    )


def repeated_ranges(docs: DataFrame, marked: bool, hashed: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, mark, first, last (bytes, end exclusive): ranges to remove, which may overlap."""
    spark = docs.sparkSession
    copies = copy_ranges(hashed, marked)
    later = copies.select("doc_id", "mark").distinct()
    if later.count() <= BROADCAST_IDS:
        later = F.broadcast(later)
    texts = _text_rows(docs, marked).filter("doc_id is not null").join(later, ["doc_id", "mark"], "left_anti")

    seen = scratch(texts.mapInArrow(_minimizers, "doc_id long, anchor long"), "minimizers")
    shared = seen.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    shared = scratch(shared.filter("low < high").select("anchor"), "shared-minimizers")
    free_shuffles(spark)
    found_in = scratch(seen.join(shared, "anchor"), "marked-minimizers")
    drop_scratch(seen, shared)
    free_shuffles(spark)

    # Texts that share a doc_id share a list; minimizers that a text lacks do nothing there.
    lists = found_in.groupBy("doc_id").agg(F.collect_list("anchor").alias("anchors"))
    found = texts.join(lists, "doc_id").mapInArrow(
        _cut, "anchor long, sid long, doc_id long, mark int, start int, count long, bytes binary"
    )
    found = scratch(found, "stretches")
    drop_scratch(found_in)
    free_shuffles(spark)

    distinct = found.filter("bytes is not null").select("anchor", "sid", "doc_id", "count", "bytes")
    heavy = scratch(distinct.groupBy("anchor").count().filter(F.col("count") > hot).select("anchor"), "hot-minimizers")
    hot_count = heavy.count()
    free_shuffles(spark)
    if hot_count <= BROADCAST_HOT:
        heavy = F.broadcast(heavy)
    calm = distinct.join(heavy, "anchor", "left_anti") if hot_count else distinct
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    judged = (
        calm.repartition(2 * parts, "anchor")
        .sortWithinPartitions("anchor")
        .mapInArrow(_judge, "anchor long, sid long, first int, last int, least long")
    )
    if hot_count:
        merged = distinct.join(heavy, "anchor", "left_semi").groupBy("anchor", "sid", "bytes")
        judged = judged.unionByName(_hot_windows(merged.agg(F.min("doc_id").alias("least"))))
    judged = scratch(judged, "judged-stretches")
    free_shuffles(spark)

    removed = (
        found.select("anchor", "sid", "doc_id", "mark", "start")
        .join(judged, ["anchor", "sid"])
        .filter("least < doc_id")
        .select(
            "doc_id",
            "mark",
            (F.col("start") + F.col("first")).alias("first"),
            (F.col("start") + F.col("last") + LENGTH).alias("last"),
        )
    )
    removed = scratch(removed, "removed-ranges")
    drop_scratch(found, judged, heavy)
    free_shuffles(spark)
    return removed.unionByName(copies)


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    hashed, marked = _identities(docs)
    ranges = repeated_ranges(docs, marked, hashed, hot)
    ranges = ranges.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    return (
        _text_rows(docs, marked)
        .join(ranges, ["doc_id", "mark"], "left")
        .select("doc_id", "text", "ranges")
        .mapInArrow(_finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    )


def op1_repeats(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
