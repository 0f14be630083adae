"""The near_duplicates stage of the pipeline: 5-word shingles, 0.8."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from quantloom.llm import common, jaccard_groups


def changed(words, places):
    return [f"new{k}" if k in places else w for k, w in enumerate(words)]


def test_stage_finds_scattered_changes(spark):
    rng = random.Random(11)
    short, long, far = ([f"{name}{k}" for k in range(n)] for name, n in (("a", 100), ("b", 400), ("c", 100)))
    texts = [(1, short), (2, changed(short, {30, 70})), (3, long), (4, changed(long, set(range(25, 400, 50))))]
    # 81 of 111 shingles: under the threshold.
    texts += [(5, far), (6, changed(far, {25, 50, 75}))]
    texts += [(10 + i, [f"w{rng.randrange(500)}" for _ in range(rng.randint(40, 200))]) for i in range(30)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts], "doc_id long, text string")
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 5, 6, *range(10, 40)]


def test_part_keys_meet_at_lower_thresholds():
    rng = np.random.default_rng(5)
    new = lambda n: rng.integers(1, 2**63, n, dtype=np.uint64)
    tried = 0
    for percent in (60, 80):
        for n in (4, 5, 9, 20, 37, 60, 150, 700, 3000):
            for _ in range(40):
                x = np.unique(new(n))
                drop = int(rng.integers(0, (100 - percent) * n // 100 + 1))
                most = 100 * (n - drop) // percent - n
                y = np.unique(np.concatenate([x[drop:], new(int(rng.integers(0, max(most, 0) + 1)))]))
                both = len(np.intersect1d(x, y))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    tried += 1
                    assert len(np.intersect1d(jaccard_groups.part_keys(x, percent), jaccard_groups.part_keys(y, percent)))
    assert tried > 300


def test_written_steps_bound_arrow_batches_by_bytes(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    rows = spark.range(0, 8000, 1, 1).select(F.repeat(F.lit("x"), F.when(F.col("id") == 7, 20_000_000).otherwise(5000)).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    for before in (None, "100000000"):
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
        found = common.scratch(rows.mapInArrow(sizes, "n long, size long"), "sizes").collect()
        assert spark.conf.get(name, None) == before
        assert sum(r.n for r in found) == 8000
        # A batch exceeds the bound by its last row at most.
        assert all(r["size"] <= common.BATCH_BYTES + 21_000_000 for r in found)
        assert sum(r["size"] > common.BATCH_BYTES + 10_000 for r in found) <= 1
    spark.conf.unset(name)


def test_dealing_changes_no_component(spark, monkeypatch):
    rng = random.Random(11)
    rows = []
    for family in range(12):
        words = [f"w{rng.randrange(500)}" for _ in range(120)]
        for _ in range(5):
            words = list(words)
            words[rng.randrange(len(words))] = f"x{rng.randrange(500)}"
            rows.append((len(rows), " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    deal = jaccard_groups._dealing
    monkeypatch.setattr(jaccard_groups, "_dealing", lambda *a: seen.append(deal(*a)) or seen[-1])
    found = []
    for task_bytes in (1 << 20, 64):
        monkeypatch.setattr(jaccard_groups, "TASK_BYTES", task_bytes)
        found.append(sorted(map(tuple, jaccard_groups.near_components(docs, group=2, size=3, percent=80).collect())))
    assert found[0] == found[1]
    assert len({r[2] for r in found[0]}) < len(rows)
    passes = {p for _, p in seen}
    assert {1, jaccard_groups.ASK_PASSES} <= passes


def brute(rows, size, percent):
    """The smallest id reachable by links, by comparing all pairs."""
    sets = {i: {tuple(w[k : k + size]) for k in range(max(len(w) - size + 1, 1))} for i, w in rows}
    least = {i: i for i in sets}
    links = [(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    while any(least[i] != least[j] for i, j in links):
        for i, j in links:
            least[i] = least[j] = min(least[i], least[j])
    return least


def test_texts_with_a_common_passage_ask_for_no_groups(spark, monkeypatch):
    rng = random.Random(7)
    passage = [f"p{k}" for k in range(60)]
    rows = [(i, [f"t{i}x{k}" for k in range(25)] + passage) for i in range(80)]
    # Families whose members are mostly passage, and one chain of near copies.
    rows += [(100 + i, [f"f{i // 4}", *passage[i % 4 :], f"g{i // 2}"]) for i in range(12)]
    chain = [f"c{k}" for k in range(90)]
    for i in range(9):
        chain = changed(chain, {rng.randrange(90)})
        rows.append((200 + i, chain))
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    asked, ask = [], jaccard_groups._ask

    def counted(asks, *rest):
        asked.append(asks.select("fa").distinct().filter(F.col("fa").isin(lonely)).count())
        return ask(asks, *rest)

    single = docs.filter("doc_id < 80").select(F.lit(0).alias("doc_id"), F.lit(0).alias("mark"), "text")
    found = single.mapInArrow(lambda b: jaccard_groups._sets(b, 5), "fa long, tokens binary").collect()
    lonely = [r.fa for r in found]
    monkeypatch.setattr(jaccard_groups, "_ask", counted)
    got = {r.doc_id: r.component_id for r in jaccard_groups.near_components(docs, group=4, size=5, percent=80).collect()}
    assert got == brute(rows, 5, 80)
    assert len(asked) == 2 and sum(asked) == 0
