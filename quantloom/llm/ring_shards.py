"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

A document's place on the ring is the hash of its text, so equal texts are
neighbours.  Every shard has ``VNODES`` points on the ring and at most
(1 + ``SLACK``) times its share of all bytes.  A document goes to the next point
clockwise whose shard is not full; so what overflows a full shard continues
clockwise, a group of copies fills neighbours, and adding a shard moves little
more than what the new one takes.

The ring is filled by cells, not by rows: a histogram of ``CELLS`` arcs, whose
size does not depend on the data, is enough to know which shard gets which arc.
Only an arc in which a shard becomes full (at most one for each shard) is looked
into, by two more histograms and at last by running sums of the rows of one
sub-arc in ``SUBCELLS`` of its ``SUBCELLS``.  Documents larger than a ``FEW``-th
of a shard (there cannot be more than ``FEW`` times the shards of them) are
placed before, one by one, the largest first, each at the next point whose shard
has room; one for which no shard has room goes to the emptiest.  If one document
is larger than a share, the others level out below it.

Defined results.  A null text has no bytes and is placed like an empty one.
Repeated rows (equal doc_id and text) are counted first and placed in blocks of
``BLOCK``; a null doc_id is an id like others.  Reruns agree.  Columns beside
doc_id and text are ignored, whatever their names.  An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import packed, scratch

SHARDS = 40
#: Points of each shard on the ring.
VNODES = 256
#: A shard is full at so much more than its share.
SLACK = 0.001
CELL_BITS, SUB_BITS = 16, 12
CELLS, SUBCELLS = 1 << CELL_BITS, 1 << SUB_BITS
#: Units of more than a shard's share by this are placed one by one.
FEW = 1000
#: Repeated rows that are placed together.
BLOCK = 16
#: Bytes that a document counts besides those of its text.
OVERHEAD = 16
#: Units of a shard that are numbered in one sort.
NUMBERED = 1_000_000


def _point(name: str) -> int:
    """A place on the ring, 0 to 2^64."""
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "big")


class Ring:
    """Points of the shards in ring order, and what room each shard has left."""

    def __init__(self, shards: int, vnodes: int, room: int):
        points = sorted((_point(f"{s}/{v}"), s) for s in range(shards) for v in range(vnodes))
        self.at, self.shard = [p for p, _ in points], [s for _, s in points]
        self.load, self.room = [0] * shards, [room] * shards
        self._next = list(range(len(points)))

    def level(self, rest: int, slack: float) -> None:
        """Give each shard room up to the level at which ``rest`` more bytes fill all shards, plus the slack."""
        loads, filled = sorted(self.load), 0
        height = loads[0]
        for k, load in enumerate(loads[1:] + [None], start=1):
            step = rest - filled if load is None else min(rest - filled, (load - height) * k)
            filled, height = filled + step, height + step / k
            if filled >= rest:
                break
        limit = int(height * (1 + slack)) + 1
        self.room = [limit - load for load in self.load]
        self._next = list(range(len(self.at)))

    def _open(self, i: int) -> int:
        """The first point from the i-th on, clockwise, whose shard is not full."""
        path, n = [], len(self.at)
        for _ in range(n + 1):
            i %= n
            if self._next[i] == i:
                if self.room[self.shard[i]] > 0:
                    break
                self._next[i] = i + 1
            path.append(i)
            i = self._next[i]
        for p in path:
            self._next[p] = i if i > p else i + n
        return i

    def put(self, place: int, size: int) -> int:
        """A whole unit: the next shard clockwise that has room for all of it, else the emptiest."""
        start, seen = bisect_left(self.at, place), set()
        for k in range(len(self.at)):
            shard = self.shard[(start + k) % len(self.at)]
            if self.room[shard] >= size:
                break
            seen.add(shard)
            if len(seen) == len(self.room):
                shard = max(range(len(self.room)), key=lambda s: (self.room[s], -s))
                break
        self.load[shard] += size
        self.room[shard] -= size
        return shard

    def pour(self, place: int, size: int) -> list[tuple[int, int]]:
        """An arc's bytes: (end, shard) of every run of them, as shards become full."""
        i, done, runs = bisect_left(self.at, place), 0, []
        while done < size:
            i = self._open(i)
            shard = self.shard[i]
            step = min(size - done, self.room[shard])
            self.load[shard] += step
            self.room[shard] -= step
            done += step
            runs.append((done, shard))
        return runs


def units(docs: DataFrame) -> DataFrame:
    """Distinct documents in blocks of repeats: doc_id, size, text_crc32, pos, ord, block, copies, bytes and ring cells."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + OVERHEAD).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("pos"),
        F.xxhash64("doc_id", text).alias("ord"),
    )
    counted = slim.groupBy(*slim.columns).agg(F.count("*").alias("n"))
    blocks = counted.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / BLOCK))))
    copies = F.least(F.col("n") - F.col("block") * BLOCK, F.lit(BLOCK).cast("long"))
    top = F.shiftrightunsigned("pos", 64 - CELL_BITS).cast("int")
    mid = F.shiftrightunsigned("pos", 64 - CELL_BITS - SUB_BITS).bitwiseAND(F.lit(SUBCELLS - 1)).cast("int")
    low = F.shiftrightunsigned("ord", 64 - SUB_BITS).cast("int")
    return blocks.select(
        *slim.columns, "block", copies.alias("copies"), (F.col("size") * copies).alias("bytes"), top.alias("c1"), mid.alias("c2"), low.alias("c3")
    )


def _table(spark, columns: dict[str, tuple[list, pa.DataType]]) -> DataFrame:
    """A small table of known bound from the driver, marked for broadcast."""
    return F.broadcast(spark.createDataFrame(pa.table({k: pa.array(v, t) for k, (v, t) in columns.items()})))


def _divide(rows, runs: dict, keys: int):
    """Parts of cut arcs in order of their number: those within one run with its shard, and those cut again with their start."""
    whole, cut, at = [], {}, {}
    for row in sorted(rows):
        *cell, size = row
        arc = tuple(cell[:keys])
        start = at.get(arc, runs[arc][0])
        at[arc] = end = start + size
        ends = runs[arc][1]
        first = next(k for k, (e, _) in enumerate(ends) if start < e or k == len(ends) - 1)
        if end <= ends[first][0] or first == len(ends) - 1:
            whole.append((*cell, ends[first][1]))
        else:
            cut[tuple(cell)] = (start, ends)
    return whole, cut


def place(docs: DataFrame, shards: int = SHARDS, slack: float = SLACK, vnodes: int = VNODES) -> DataFrame:
    """The units of ``docs`` with their shard, as a written table."""
    if shards < 1 or slack < 0 or vnodes < 1:
        raise ValueError("shards and vnodes must be positive, slack not negative")
    spark = docs.sparkSession
    table = scratch(units(docs), "ring-units")
    total = table.agg(F.sum("bytes")).first()[0] or 0
    few = max(1, total // (shards * FEW))
    ring = Ring(shards, vnodes, int(total / shards * (1 + slack)) + 1)
    unsigned = lambda x: x % (1 << 64)
    large = [(-r["bytes"], unsigned(r["pos"]), unsigned(r["ord"]), r["block"], r) for r in table.filter(F.col("bytes") > few).select("pos", "ord", "block", "bytes").collect()]
    put = [(r["pos"], r["ord"], r["block"], ring.put(unsigned(r["pos"]), r["bytes"])) for *_, r in sorted(large, key=lambda x: x[:4])]
    rest = table.filter(F.col("bytes") <= few)
    cells = [(r["c1"], r["bytes"]) for r in rest.groupBy("c1").agg(F.sum("bytes").alias("bytes")).collect()]
    ring.level(sum(b for _, b in cells), slack)
    # Arcs are filled in an order of their own, so that no region of the ring is served first.
    runs = {c: ring.pour(c << (64 - CELL_BITS), b) for c, b in sorted(cells, key=lambda x: _point(f"cell {x[0]}"))}

    first = [(c, r[0][1]) for c, r in runs.items() if len(r) == 1]
    cut = {(c,): (0, r) for c, r in runs.items() if len(r) > 1}
    maps = [(["c1"], first)]
    for keys in (["c1", "c2"], ["c1", "c2", "c3"]):
        inside = _table(spark, {k: ([c[i] for c in cut], pa.int32()) for i, k in enumerate(keys[:-1])})
        sums = rest.join(inside, keys[:-1], "left_semi").groupBy(*keys).agg(F.sum("bytes").alias("bytes"))
        whole, cut = _divide([tuple(r) for r in sums.collect()], cut, len(keys) - 1)
        maps.append((keys, whole))

    out = table
    for i, (keys, whole) in enumerate(maps):
        columns = {k: ([w[j] for w in whole], pa.int32()) for j, k in enumerate(keys)}
        out = out.join(_table(spark, {**columns, f"s{i}": ([w[-1] for w in whole], pa.int32())}), keys, "left")
    own = _table(
        spark,
        {k: ([p[j] for p in put], t) for j, (k, t) in enumerate([("pos", pa.int64()), ("ord", pa.int64()), ("block", pa.int64()), ("own", pa.int32())])},
    )
    out = out.join(own, ["pos", "ord", "block"], "left").withColumn("shard", F.coalesce("own", "s0", "s1", "s2"))
    kept = ["doc_id", "size", "text_crc32", "pos", "ord", "block", "copies", "bytes", "shard"]
    last = _table(
        spark,
        {f"k{i}": ([c[i] for c in cut], pa.int32()) for i in range(3)}
        | {
            "start": ([s for s, _ in cut.values()], pa.int64()),
            "ends": ([[e for e, _ in r[:-1]] for _, r in cut.values()], pa.list_(pa.int64())),
            "to": ([[s for _, s in r] for _, r in cut.values()], pa.list_(pa.int32())),
        },
    )
    before = Window.partitionBy("c1", "c2", "c3").orderBy("pos", "ord", "block").rowsBetween(Window.unboundedPreceding, -1)
    rows = out.filter(F.col("shard").isNull()).drop("shard").join(last, [F.col(f"c{i + 1}") == F.col(f"k{i}") for i in range(3)])
    at = F.col("start") + F.coalesce(F.sum("bytes").over(before), F.lit(0))
    rows = rows.withColumn("at", at).withColumn("shard", F.element_at("to", F.size(F.filter("ends", lambda e: e <= F.col("at"))) + 1))
    return scratch(out.filter(F.col("shard").isNotNull()).select(*kept).unionByName(rows.select(*kept)), "ring-placed")


def numbered(placed: DataFrame) -> DataFrame:
    """One row per document with its slot: gapless from 0 within each shard, in an order of hashes."""
    counts = placed.groupBy("shard").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    parts = max(1, -(-counts // NUMBERED))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("ord", "block"), F.lit(parts)))
    sums = placed.groupBy("shard", "part").agg(F.sum("copies").alias("held"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("shard", "part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard", "part").orderBy("ord", "pos", "block").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("base") + F.coalesce(F.sum("copies").over(inside), F.lit(0))
    rows = placed.join(sums, ["shard", "part"]).withColumn("start", start)
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return rows.select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("copy")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, slack: float = SLACK, vnodes: int = VNODES) -> DataFrame:
    """``docs`` with a column shard, replaced if there is one; rows equal in id and text stay with the first block of them."""
    placed = place(docs, shards, slack, vnodes).filter(F.col("block") == 0).select("pos", "ord", "shard")
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(packed(docs).alias("row"), F.xxhash64(text).alias("pos"), F.xxhash64(F.col("doc_id").cast("long"), text).alias("ord"))
    return keyed.join(placed, ["pos", "ord"]).select(*[F.col(f"row.`{c}`") for c in docs.columns if c != "shard"], "shard")


def loads(placed: DataFrame) -> DataFrame:
    """shard, rows and bytes of every shard that has a document."""
    return placed.groupBy("shard").agg(F.sum("copies").alias("rows"), F.sum("bytes").alias("bytes"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, files_per_shard: int = 1) -> None:
    """Write ``docs`` as Parquet under ``path``, one folder per shard; a shard's rows are spread over its files."""
    out = shard_documents(docs, shards)
    salt = F.pmod(F.xxhash64("doc_id", "text"), F.lit(files_per_shard))
    out.repartition(shards * files_per_shard, "shard", salt).write.mode("errorifexists").partitionBy("shard").parquet(path)


def op13_shards(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return numbered(place(docs)).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
