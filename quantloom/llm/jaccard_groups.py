r"""Jaccard join of documents by groups with token unions.

Two documents link when 100 * |A n B| >= p * |A u B| over the sets of their
distinct shingles of some words: p = 90 and 3 words in op5, 80 and 5 in the
pipeline.  The result has every document's component.

Candidates.  For sets of sizes up to x and y the symmetric difference of a
linked pair is at most d = floor((100 - p) (x + y) / (100 + p)).  The tokens are dealt by hash to
m > d parts; then linked sets agree on some whole part, and the part's hash is a
join key that nothing but equal parts shares.  Sizes come in levels with a fixed
m each; a set whose partners reach down into lower levels also gives the keys of
those.  Parts without tokens give no key; m has spare parts for them, and a set
with more empty parts than spare ones gives keys for those too.  So no linked
pair is missed (64-bit hashes stand for shingles).

Rare tokens.  Texts with a passage in common share parts without being linked, and
the pairs of those grow with the square of the texts that have the passage.  So
among the sets that share a part all tokens are put in one order, rarest first.  Of
two linked sets each has p % of its tokens in the other; so the first token that
both have is among the first n - ceil(p n / 100) + 1 of either, and from here on only
these are keys.  Tokens that no other set has come first in the order and give no
key: a set with fewer than p % of its tokens elsewhere has none.  Near copies share
many keys; of keys with the same sets one is kept.

Groups.  Sets join the group of the key they share with most others, split into
groups of at most ``GROUP`` members and about ``GROUP_TOKENS`` tokens.  The union
of the tokens of each group that shares a key with another one is stored in a table.  A set that shares a key with another
group meets that union first: their overlap bounds its overlap with each member,
and only groups whose bound reaches p % of the set are opened, that is, have their
members joined and compared exactly.  Each comparison returns links that span what it found
connected, not all pairs, and groups are only compared as far as their members
are not connected yet (:func:`near_labels`), so that a large family of near
copies costs little more than its size.

Defined results.  Texts without words and null texts have no shingles, and a
component of their own.  Documents with equal sets are copies, linked without
comparison.  Repeated rows each get a row.  With a null doc_id the component is
the smallest other id, or null.  Columns beside doc_id and text are ignored.
:func:`keep_one_of_each` keeps the row with the smallest doc_id of a component,
nulls last, then by a hash of the text; of equal rows one stays.  Rows without
shingles all stay.

Scale.  The texts are read once for sizes, fingerprints and keys (about n/6 keys
for n shingles at 90 %, n/2 at 80 %, dealt in two passes then), and once more, only
the candidates', for their sets, whose tokens are counted in ``TOKEN_PASSES``.  Within a task copies give their keys once.  A task
holds a union and a block of queries, or the sets of two groups, at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm import kernels
from quantloom.llm.common import BROADCAST_KEYS, drop_scratch, free_shuffles, packed, scratch, settled, small
from quantloom.llm.components import components

GROUP = 256
#: Members that stand for a group in the second round.
CHAMPIONS = 16
GROUP_TOKENS = 2_000_000
#: Sets that ask for one group in a block.
ASKING = 4096
#: Passes over the asking sets at most, so that no shuffle holds them all; fewer where tasks would have less than ``TASK_BYTES``.
ASK_PASSES = 4
#: Passes over the candidates' tokens, so that no shuffle holds them all.
TOKEN_PASSES = 4
#: Bytes of token sets for which an exchange has a task of its own, between one and four times the session's partitions.
TASK_BYTES = 1 << 20
#: Fingerprints that a task remembers; copies beyond give their keys again, which changes nothing.
SEEN = 200_000
_U = np.uint64


def _levels(ratio: float = 1.4, largest: int = 1 << 40) -> np.ndarray:
    """Lower size bounds of the levels."""
    bounds = [1]
    while bounds[-1] < largest:
        bounds.append(max(bounds[-1] + 1, int(bounds[-1] * ratio)))
    return np.array(bounds, np.int64)


LEVELS = _levels()


@lru_cache(None)
def parts_of_level(level: int, percent: int = 90) -> tuple[int, int]:
    """Parts and spare parts of a level: sizes below the next bound, and partners up to 100/percent of that.

    The spare parts are as many as the level's smallest sets leave empty, with
    three standard deviations, but no more than a quarter of the difference.
    """
    low, top = int(LEVELS[level]), int(LEVELS[level + 1]) - 1
    differ = (100 - percent) * (top + top * 100 // percent) // (100 + percent)
    spare = 2
    while spare < 2 + differ // 4:
        m = differ + 1 + spare
        mean = m * (1 - 1 / m) ** low
        spread = max(0.0, m * (m - 1) * (1 - 2 / m) ** low + mean - mean * mean) ** 0.5
        if spare >= mean + 3 * spread:
            break
        spare += 1
    return differ + 1 + spare, spare


def part_keys(tokens: np.ndarray, percent: int = 90) -> np.ndarray:
    """The join keys of a set of distinct token hashes."""
    n = len(tokens)
    level = int(np.searchsorted(LEVELS, n, side="right")) - 1
    out = [_keys_at(tokens, level, percent)]
    while level and percent * n <= 100 * (int(LEVELS[level]) - 1):
        level -= 1
        out.append(_keys_at(tokens, level, percent))
    return np.concatenate(out)


def _keys_at(tokens: np.ndarray, level: int, percent: int) -> np.ndarray:
    m, spare = parts_of_level(level, percent)
    spread = kernels.mix(tokens + _U(0xA5A5A5A5))
    part = ((spread >> _U(32)) * _U(m)) >> _U(32)
    order = np.argsort(part, kind="stable")
    part = part[order]
    start = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    held = part[start]
    content = np.add.reduceat(spread[order], start)
    name = _U(level) << _U(48)
    keys = kernels.mix(content + kernels.mix(name + held))
    if m - len(held) > spare:
        empty = np.setdiff1d(np.arange(m, dtype=np.uint64), held)
        keys = np.concatenate([keys, kernels.mix(kernels.mix(name + empty) + _U(1))])
    return keys


def _sketches(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """doc_id, mark, n, fa (fingerprint of the set) and keys, where the task has not given those of an equal set."""
    seen: set[int] = set()
    for batch in batches:
        raw, offsets = kernels.text_buffers(batch.column("text"))
        ids = batch.column("doc_id")
        for a, b in kernels.pieces(offsets):
            tokens, at = kernels.shingles(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
            n, fa, keys = [], [], []
            for k in range(b - a):
                own = np.unique(tokens[at[k] : at[k + 1]])
                n.append(len(own))
                fa.append(kernels.mix(own).sum(dtype=np.uint64))
                new = len(own) and int(fa[-1]) not in seen
                keys.append(part_keys(own, percent) if new else own[:0])
                if len(seen) < SEEN:
                    seen.add(int(fa[-1]))
            sizes = np.array([len(x) for x in keys])
            flat = np.concatenate(keys).view(np.int64) if len(keys) else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat)
            )
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(a, b - a),
                    batch.column("mark").slice(a, b - a),
                    pa.array(np.array(n, np.int64)),
                    pa.array(np.array(fa, np.uint64).view(np.int64)),
                    lists,
                ],
                names=["doc_id", "mark", "n", "fa", "keys"],
            )


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """fa and the sorted token hashes of a text as bytes."""
    for batch in batches:
        raw, offsets = kernels.text_buffers(batch.column("text"))
        for a, b in kernels.pieces(offsets):
            tokens, at = kernels.shingles(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
            own = [np.unique(tokens[at[k] : at[k + 1]]) for k in range(b - a)]
            fa = np.array([kernels.mix(x).sum(dtype=np.uint64) for x in own], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(fa.view(np.int64)), pa.array([x.tobytes() for x in own], pa.binary())], names=["fa", "tokens"]
            )


def _flat(batches: Iterator[pa.RecordBatch], place: int, passes: int) -> Iterator[pa.RecordBatch]:
    """key, fa: the tokens of each set that are dealt to one of the passes."""
    for batch in batches:
        names, tokens = batch.column("fa").to_numpy(), batch.column("tokens")
        own = [np.frombuffer(tokens[i].as_buffer(), np.uint64) for i in range(batch.num_rows)]
        own = [x[x % _U(passes) == _U(place)] for x in own]
        keys = np.concatenate([*own, np.zeros(0, np.uint64)]).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(names, [len(x) for x in own]))], names=["key", "fa"])


def _overlaps(left: list[np.ndarray], right: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """Intersection sizes of all left sets with all right sets, by blocks of shared tokens."""
    shared = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    out = np.zeros((len(left), len(right)), np.float32)

    def placed(sets):
        at = [np.searchsorted(shared, x) for x in sets]
        return [p[(p < len(shared)) & (shared[np.minimum(p, len(shared) - 1)] == x)] for p, x in zip(at, sets, strict=True)]

    if not len(shared):
        return out
    ours, theirs = placed(left), placed(right)
    for low in range(0, len(shared), width):
        span = min(width, len(shared) - low)
        blocks = []
        for sets in (ours, theirs):
            block = np.zeros((len(sets), span), np.float32)
            for row, p in enumerate(sets):
                block[row, p[(p >= low) & (p < low + span)] - low] = 1
            blocks.append(block)
        out += blocks[0] @ blocks[1].T
    return out


def _reach(sets: list[np.ndarray], union: np.ndarray, percent: int) -> np.ndarray:
    """Which sets have ``percent`` of their tokens in a union: only those can link into its group."""
    inside = np.array([np.isin(x, union, assume_unique=True).sum() for x in sets])
    sizes = np.array([len(x) for x in sets])
    return 100 * inside >= percent * sizes


def _group_links(ids: list[np.ndarray], sets: list[list[np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """Links that span the connected parts of one group (one side) or of two (links across)."""
    own = len(sets) == 1
    left, right = sets[0], sets[-1]
    opened_left = np.flatnonzero(_reach(left, np.unique(np.concatenate(right)), percent)) if not own else np.arange(len(left))
    if not len(opened_left):
        return []
    left = [left[i] for i in opened_left]
    opened_right = np.flatnonzero(_reach(right, np.unique(np.concatenate(left)), percent)) if not own else np.arange(len(right))
    if not len(opened_right):
        return []
    right = [right[i] for i in opened_right]
    both = _overlaps(left, right).astype(np.int64)
    total = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :]
    linked = 100 * both >= percent * (total - both)
    names = np.concatenate([ids[0][opened_left], ids[-1][opened_right]])
    leader = np.arange(len(names))

    def root(i):
        while leader[i] != i:
            leader[i] = leader[leader[i]]
            i = leader[i]
        return i

    if own:
        for i in range(len(left)):
            leader[len(left) + i] = i
    found = []
    for i, j in zip(*np.nonzero(linked), strict=True):
        a, b = root(i), root(len(left) + j)
        if a != b:
            leader[max(a, b)] = min(a, b)
            found.append((int(names[i]), int(names[len(left) + j])))
    return found


def _compare(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of each pair of groups; rows come sorted by the pair."""
    for group in kernels.stream_groups(batches, ["ga", "gb"]):
        side = group.column("side").to_numpy()
        names = group.column("fa").to_numpy()
        tokens = [np.frombuffer(x, np.uint64) for x in group.column("tokens").to_pylist()]
        one = group.column("ga")[0].as_py() == group.column("gb")[0].as_py()
        chosen = [np.flatnonzero(side == s) for s in ([0] if one else [0, 1])]
        if any(len(c) == 0 for c in chosen):
            continue
        links = _group_links([names[c] for c in chosen], [[tokens[i] for i in c] for c in chosen], percent)
        if links:
            a, b = zip(*links, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """g and the union of its members' tokens; rows come sorted by g."""
    for group in kernels.stream_groups(batches, ["g"]):
        tokens = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in group.column("tokens").to_pylist()]))
        yield pa.RecordBatch.from_arrays([group.column("g").combine_chunks()[:1], pa.array([tokens.tobytes()], pa.binary())], names=["g", "tokens"])


def _bound(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The asking rows (side 1) of each ga, block that have ``percent`` of their tokens in its union (side 0, which comes first)."""
    held = union = None
    for batch in batches:
        ga, block, side = (batch.column(c).to_numpy() for c in ("ga", "block", "side"))
        tokens, opened = batch.column("tokens"), []
        for i in range(batch.num_rows):
            own = np.frombuffer(tokens[i].as_buffer(), np.uint64)
            if side[i] == 0:
                held, union = (ga[i], block[i]), own.copy()
            elif held == (ga[i], block[i]) and _reach([own], union, percent)[0]:
                opened.append(i)
        yield batch.select(["ga", "gb", "fa"]).take(pa.array(opened, pa.int64()))


def _dealing(rows: DataFrame, sizes: DataFrame) -> tuple[int, int]:
    """Tasks of an exchange that ships the set of each of ``rows`` (fa), and passes that keep it small.

    Only the dealing depends on the bytes; what is compared does not.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shipped = 8 * (rows.select("fa").join(sizes, "fa").agg(F.sum("n")).first()[0] or 0)
    tasks = min(max(-(-shipped // TASK_BYTES), parts), 4 * parts)
    return tasks, min(max(-(-shipped // (TASK_BYTES * tasks)), 1), ASK_PASSES)


def _links(work: DataFrame, sets: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Compare the sides (ga, gb, side, fa) of each pair and write the links found."""
    work = scratch(work.select("ga", "gb", "side", "fa"), "near-work")
    tasks, _ = _dealing(work, sizes)
    dealt = sets.join(small(work), "fa").repartition(tasks, "ga", "gb").sortWithinPartitions("ga", "gb")
    links = scratch(dealt.select("ga", "gb", "side", "fa", "tokens").mapInArrow(lambda batches: _compare(batches, percent), "a long, b long"), "near-links")
    free_shuffles(links.sparkSession)
    return links


def _ask(asks: DataFrame, members: DataFrame, sets: DataFrame, sizes: DataFrame, unions: DataFrame, percent: int) -> DataFrame:
    """Links of asking sets (ga, gb, fa) to ``members`` (g, fa) of the groups ga whose unions they reach."""
    asks = scratch(asks.select("ga", "gb", "fa"), "near-asks")
    # A union goes once to each block of those that ask; only groups that many ask have several.
    many = scratch(asks.groupBy("ga").agg(F.count("*").alias("n")).filter(F.col("n") > ASKING), "near-asked")
    block = F.when(F.col("n").isNull(), F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64("fa"), F.ceil(F.col("n") / ASKING)))
    asks = scratch(asks.join(small(many), "ga", "left").select("ga", block.alias("block"), "gb", "fa"), "near-asks")
    tasks, passes = _dealing(asks, sizes)
    opened = []
    for k in range(passes):
        some = scratch(asks.filter(F.pmod(F.xxhash64("ga", "block"), F.lit(passes)) == k), "near-asks") if passes > 1 else asks
        asking = sets.join(small(some), "fa").select("ga", "block", F.lit(1).alias("side"), "gb", "fa", "tokens")
        none = F.lit(None).cast("long")
        asked = some.select("ga", "block").distinct().join(unions.withColumnRenamed("g", "ga"), "ga")
        dealt = asking.unionByName(asked.select("ga", "block", F.lit(0).alias("side"), none.alias("gb"), none.alias("fa"), "tokens"))
        dealt = dealt.repartition(tasks, "ga", "block").sortWithinPartitions("ga", "block", "side")
        opened.append(scratch(dealt.mapInArrow(lambda batches: _bound(batches, percent), "ga long, gb long, fa long"), "near-opened"))
        free_shuffles(asks.sparkSession)
    opened = scratch(reduce(DataFrame.unionByName, opened), "near-opened")
    theirs = opened.select("ga", "gb").distinct().join(members.select(F.col("g").alias("ga"), "fa"), "ga")
    work = opened.select("ga", "gb", F.lit(1).alias("side"), "fa").unionByName(theirs.select("ga", "gb", F.lit(0).alias("side"), "fa"))
    return _links(work, sets, sizes, percent)


def _merge(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (fa, g, label) after the links join their components."""
    ends = labels.select("fa", "label")
    mapped = (
        links.join(ends.toDF("a", "la"), "a").join(ends.toDF("b", "lb"), "b").filter("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    )
    found = components(mapped.distinct()).toDF("label", "joined")
    return scratch(
        labels.join(found, "label", "left").select("fa", "g", F.coalesce("joined", "label").alias("label")), "near-merged"
    )


def shared_keys(sketches: DataFrame, percent: int) -> DataFrame:
    """key, fa, c: the keys that c > 1 sets have, one key for all keys of the same sets."""
    spark = sketches.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = sketches.select(F.explode("keys").alias("key"), "fa")
    # A lower threshold has more keys; by passes over parts of them no shuffle holds them all.
    passes, found = -(-(100 - percent) // 10), []
    for k in range(passes):
        some = keyed.filter(F.pmod("key", F.lit(passes)) == k)
        # Both aggregations run on the one exchange by key.
        sets_of = some.repartition(4 * parts, "key").groupBy("key", "fa").agg(F.count("*").alias("rows")).groupBy("key")
        sets_of = sets_of.agg(
            F.count("*").alias("c"), F.min("fa").alias("low"), F.max("fa").alias("high"), F.bit_xor(F.xxhash64("fa")).alias("all")
        ).filter("c > 1")
        kept = sets_of.groupBy("c", "low", "high", "all").agg(F.min("key").alias("key")).select("key", "c")
        found.append(scratch(kept, "near-keys"))
        free_shuffles(spark)
    # Keys kept in different passes may have the same sets, which is only work done twice.
    kept = reduce(DataFrame.unionByName, found)
    kept = F.broadcast(kept) if sum(t.count() for t in found) <= BROADCAST_KEYS else kept
    return scratch(keyed.join(kept, "key").distinct(), "near-hits")


def rare_keys(sets: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """key, fa, c: the rarest tokens of each set (fa, tokens), as far as c > 1 sets have them among theirs."""
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = []
    for k in range(TOKEN_PASSES):
        flat = sets.mapInArrow(lambda batches, k=k: _flat(batches, k, TOKEN_PASSES), "key long, fa long").repartition(4 * parts, "key")
        flat = flat.withColumn("c", F.count("*").over(Window.partitionBy("key"))).filter("c > 1")
        found.append(scratch(flat, "near-tokens"))
        free_shuffles(sets.sparkSession)
    shared = reduce(DataFrame.unionByName, found)
    # Sets with too few tokens elsewhere link with none; the others' first ones in the order are left.
    least = F.ceil(F.lit(percent) * F.col("n") / 100)
    able = shared.groupBy("fa").agg(F.count("*").alias("own")).join(sizes, "fa").filter(F.col("own") >= least)
    able = scratch(able.select("fa", (F.col("own") - least + 1).cast("int").alias("first")), "near-able")
    ranked = shared.join(small(able), "fa").groupBy("fa", "first").agg(F.sort_array(F.collect_list(F.struct("c", "key"))).alias("keys"))
    rare = scratch(ranked.select(F.explode(F.slice("keys", F.lit(1), F.col("first"))["key"]).alias("key"), "fa"), "near-rare")
    sets_of = rare.groupBy("key").agg(
        F.count("*").alias("c"), F.min("fa").alias("low"), F.max("fa").alias("high"), F.bit_xor(F.xxhash64("fa")).alias("all")
    ).filter("c > 1")
    kept = scratch(sets_of.groupBy("c", "low", "high", "all").agg(F.min("key").alias("key")).select("key", "c"), "near-keys")
    hits = scratch(rare.join(small(kept), "key"), "near-hits")
    free_shuffles(sets.sparkSession)
    return hits


def near_labels(docs: DataFrame, sketches: DataFrame, hits: DataFrame, group: int = GROUP, size: int = 3, percent: int = 90) -> DataFrame:
    """fa, label: the component of every fingerprint that shares a key with another one, be it part or rare token.

    Three rounds, each over what the ones before left apart.  First every group
    within itself.  Then a few champions of groups that share a key, against
    those of the key's first group, which joins most of what belongs together.
    Last, exactly, whatever is still apart: a set whose component is not the
    largest under one of its keys is compared with all members of each group
    that has a larger one there.  So of two linked sets in different components
    the one of the smaller asks the group of the other.
    """
    spark = docs.sparkSession
    # One text stands for each fingerprint; it is told by doc_id and mark, so that rows without an id serve too.
    picked = hits.select("fa").distinct().join(sketches.select("fa", "n", "doc_id", "mark"), "fa").groupBy("fa").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "mark")).alias("pick"), F.max("n").alias("n")
    )
    picked = scratch(picked, "near-picks")
    rows = picked.select(F.col("pick.doc_id").alias("pick_doc"), F.col("pick.mark").alias("pick_mark")).distinct()
    rows = small(scratch(rows, "near-rows"))
    same = F.col("doc_id").eqNullSafe(F.col("pick_doc")) & (F.col("mark") == F.col("pick_mark"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").join(rows, same, "left_semi").select("text")
    sets = scratch(texts.mapInArrow(lambda batches: _sets(batches, size), "fa long, tokens binary"), "near-sets")
    if sets.count() > picked.count():
        # Repeated rows bring equal sets.
        sets = scratch(sets.dropDuplicates(["fa"]), "near-sets")

    hits = rare_keys(sets, picked.select("fa", "n"), percent)
    best = hits.groupBy("fa").agg(F.max(F.struct("c", "key")).alias("best")).select("fa", F.col("best.key").alias("home"))
    picked = scratch(picked.join(best, "fa").select("fa", "n", "home"), "near-homes")
    homes = picked.groupBy("home").agg(F.count("*").alias("members"), F.sum("n").alias("tokens"))
    parts = F.ceil(F.greatest(F.col("members") / group, F.col("tokens") / GROUP_TOKENS))
    members = scratch(
        picked.join(homes, "home").select("fa", F.xxhash64("home", F.pmod(F.xxhash64("fa"), parts)).alias("g")), "near-members"
    )
    sizes = picked.select("fa", "n")
    within = members.select(F.col("g").alias("ga"), F.col("g").alias("gb"), F.lit(0).alias("side"), "fa")
    labels = _merge(members.select("fa", "g", F.col("fa").alias("label")), _links(within, sets, sizes, percent))

    met = scratch(hits.join(members, "fa").select("key", "fa", "g"), "near-met")
    spots = met.select("key", "g").distinct()
    centres = spots.groupBy("key").agg(F.min("g").alias("ga"))
    spokes = scratch(spots.join(centres, "key").filter("g <> ga").select("ga", F.col("g").alias("gb")).distinct(), "near-spokes")
    meeting = spokes.select(F.explode(F.array("ga", "gb")).alias("g")).distinct()
    theirs = scratch(members.join(meeting, "g", "left_semi"), "near-meeting")
    tasks, _ = _dealing(theirs, sizes)
    dealt = sets.join(small(theirs), "fa").select("g", "tokens").repartition(tasks, "g")
    unions = scratch(dealt.sortWithinPartitions("g").mapInArrow(_unite, "g long, tokens binary"), "near-unions")
    free_shuffles(spark)
    place = F.row_number().over(Window.partitionBy("g").orderBy(F.xxhash64("fa"), "fa"))
    champions = members.withColumn("place", place).filter(F.col("place") <= CHAMPIONS).select("g", "fa")
    asks = spokes.join(champions.withColumnRenamed("g", "gb"), "gb").select("ga", "gb", "fa")
    labels = _merge(labels, _ask(asks, champions, sets, sizes, unions, percent))

    sized = labels.join(labels.groupBy("label").agg(F.count("*").alias("size")), "label")
    ranked = met.join(sized.select("fa", F.struct("size", "label").alias("rank")), "fa")
    ranked = scratch(ranked, "near-ranked")
    tops = ranked.groupBy("key").agg(F.max("rank").alias("top"))
    behind = ranked.join(tops, "key").filter("rank < top").select("key", "fa", "g", "rank")
    best_there = ranked.groupBy("key", F.col("g").alias("h")).agg(F.max("rank").alias("there"))
    asks = behind.join(best_there, (behind["key"] == best_there["key"]) & (F.col("rank") < F.col("there")) & (F.col("g") != F.col("h")))
    asks = scratch(asks.select("h", "fa").distinct(), "near-asks")
    # Groups that many ask are dealt in blocks; only those need a count beside the rows.
    many = scratch(asks.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > group), "near-asked")
    block = F.when(F.col("n").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("fa"), F.ceil(F.col("n") / group)))
    asks = asks.join(small(many), "h", "left").select(F.col("h").alias("ga"), F.xxhash64("h", block).alias("gb"), "fa")
    return _merge(labels, _ask(asks, members, sets, sizes, unions, percent)).select("fa", "label")


def _labelled(docs: DataFrame, group: int, size: int, percent: int) -> DataFrame:
    """doc_id, mark (hash of the text), n, label (null without shingles) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    sketches = scratch(
        docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInArrow(
            lambda batches: _sketches(batches, size, percent),
            f"doc_id {kind}, mark long, n long, fa long, keys array<long>",
        ),
        "near-sketches",
    )
    hits = settled(lambda: shared_keys(sketches, percent), "near-hits")
    narrow = scratch(sketches.drop("keys"), "near-sizes")
    drop_scratch(sketches)
    free_shuffles(docs.sparkSession)
    labels = settled(lambda: near_labels(docs, narrow, hits, group, size, percent), "near-labels")
    drop_scratch(hits)
    free_shuffles(docs.sparkSession)
    labelled = (
        narrow.join(labels, "fa", "left")
        .select("doc_id", "mark", "n", F.when(F.col("n") > 0, F.coalesce("label", "fa")).alias("label"))
    )
    labelled = scratch(labelled, "near-labelled")
    drop_scratch(narrow, labels)
    return labelled


def near_components(docs: DataFrame, group: int = GROUP, size: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id of every document; ``percent`` of ``size``-word shingles links."""
    labelled = _labelled(docs, group, size, percent)
    least = labelled.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("least"))
    return labelled.join(least, "label", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"),
    )


def keep_one_of_each(docs: DataFrame, group: int = GROUP, size: int = 3, percent: int = 90) -> DataFrame:
    """One document of every component, columns as given.

    The texts are shuffled only if more rows go than may be broadcast.
    """
    labelled = _labelled(docs.select("doc_id", "text"), group, size, percent).filter("label is not null")
    rank = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "mark")
    keys = labelled.groupBy("label", "doc_id", "mark").agg(F.count("*").alias("times"))
    first = labelled.groupBy("label").agg(F.min(rank).alias("first"))
    keys = keys.join(first, "label").select("doc_id", "mark", "times", (rank == F.col("first")).alias("stays"))
    keys = scratch(keys, "near-keys")
    rows = docs.select(packed(docs).alias("row"), "doc_id", F.xxhash64("text").alias("mark"))

    def matching(table: DataFrame, how: str) -> DataFrame:
        other = table.select(F.col("doc_id").alias("k_doc"), F.col("mark").alias("k_mark"))
        same = F.col("doc_id").eqNullSafe(F.col("k_doc")) & (F.col("mark") == F.col("k_mark"))
        return rows.join(small(other), same, how)

    once = matching(keys.filter("not stays or times > 1"), "left_anti")
    twice = keys.filter("stays and times > 1")
    if twice.isEmpty():
        return once.select("row.*")
    merged = matching(twice, "left_semi").groupBy("doc_id", "mark").agg(F.first("row").alias("row"))
    return once.select("row").unionByName(merged.select("row")).select("row.*")


def op5_near(spark, sf_dir: str) -> DataFrame:
    return near_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM dw WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (WITH RECURSIVE t(a, b) AS (SELECT a, b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a) SELECT a, min(b) AS b FROM t GROUP BY a)
SELECT dw.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(dw.doc_id, coalesce(r.b, dw.doc_id)) AS component_id
FROM dw LEFT JOIN n ON n.doc_id = dw.doc_id LEFT JOIN r ON r.a = dw.doc_id
"""
