"""Ranked search against plain Python and against its SQL, and the promise of the bounds."""

import math
import random
import re
import string
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.llm import max_sketch as M

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(docs, items, top=10):
    terms = [Counter(TERM.findall((t or "").translate(LOWER))) for _, t in docs]
    n = sum(bool(c) for c in terms)
    total = sum(sum(c.values()) for c in terms)
    df = Counter(t for c in terms for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(TERM.findall((t or "").translate(LOWER)))
    out = []
    for i, query in wanted.items():
        scored = []
        for (d, _), c in zip(docs, terms, strict=True):
            m = 10 + (90 * sum(c.values()) * n) // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in query if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(i, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def run(spark, docs, items, **options):
    frames = [spark.createDataFrame(rows, f"{i} long, text string").withColumn("item", F.lit("x")).withColumn("term", F.lit(1)) for rows, i in ((docs, "doc_id"), (items, "item_id"))]
    return sorted((tuple(r) for r in M.search(*frames, **options).select("item_id", "rank", "doc_id", "score").collect()), key=str)


def corpus(seed=11):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(1, 6))) for _ in range(600)] + ["été", "日本", "X1", "x1"]
    text = lambda n: " ".join(rng.choice(words[: rng.randint(1, len(words))]) + rng.choice(["", ".", ", ", "-Z9", "\n"]) for _ in range(n))
    docs = [(k, text(rng.randint(0, 80))) for k in range(400)] + [(500 + k, "one text again") for k in range(30)]
    docs += [(None, "one text again"), (None, None), (600, None), (601, ""), (602, "..."), (603, text(30_000)), (604, "one text again"), (604, "one text again")]
    items = [(k, text(rng.randint(1, 30))) for k in range(25)] + [(30, "one text again"), (31, None), (32, ""), (33, "unknownterm"), (30, "ONE more"), (34, "text"), (34, "text"), (None, "one")]
    return docs, items


def test_sql(spark):
    got = sorted(tuple(r) for r in M.op11_search(spark, SF).select("item_id", "rank", "doc_id", "score").collect())
    with duckdb.connect() as con:
        for name in ("documents", "benchmark"):
            con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
        assert got == sorted(con.sql(M.OP11_SQL).fetchall()) and got


@pytest.mark.parametrize("changed", [{}, {"WIDTH": 16, "OPENED": 3, "PIECE_DOCS": 7}, {"FREQUENT": 20}, {"BATCH_TERMS": 40, "FREQUENT": 0}])
def test_plain_python(spark, monkeypatch, changed):
    for name, value in changed.items():
        monkeypatch.setattr(M, name, value)
    docs, items = corpus()
    assert run(spark, docs, items) == brute(docs, items)


def test_bounds_hold_and_leave_documents_closed(monkeypatch):
    docs, items = corpus(5)
    import pyarrow as pa

    raw, offsets = M.text_buffers(pa.array([t or "" for _, t in docs]))
    piece = M.Piece(raw, offsets)
    df = np.bincount(piece.term, minlength=len(piece.vocabulary))
    n, total = int((piece.length > 0).sum()), int(piece.length.sum())
    weights = np.array([M.weight(n, d) for d in df.tolist()])
    terms = M.Piece(*M.text_buffers(pa.array([t or "" for _, t in items])))
    at = np.minimum(np.searchsorted(piece.vocabulary, terms.vocabulary[terms.term]), len(df) - 1)
    here = piece.vocabulary[at] == terms.vocabulary[terms.term]
    queries = (len(items), terms.owner[here], piece.vocabulary[at[here]], weights[at[here]])
    search = M.Search(queries, (piece.vocabulary, weights), (n, total, M.weight(n, 1)), 10)
    bounds = (search.sketches(piece) @ search.lookup) * np.float32(M.ROUNDING)
    for item in range(len(items)):
        assert (bounds[:, item] >= search.scores(piece, item, np.arange(piece.docs))).all()
    opened, exact = [], search.scores
    monkeypatch.setattr(search, "scores", lambda p, i, d: (opened.append(len(d)), exact(p, i, d))[1])
    search.add(piece, [i for i, _ in docs])
    assert sum(opened) < 0.5 * len(items) * len(docs)


def test_empty_tables(spark):
    docs, items = corpus()
    assert run(spark, [], items) == [] and run(spark, docs, []) == [] and run(spark, [(1, None)], items) == []


def test_text_item_ids(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c")], "doc_id int, text string")
    items = spark.createDataFrame([("q", "a c c"), (None, "b")], "item_id string, text string")
    rows = sorted((str(r.item_id), r["rank"], r.doc_id) for r in M.search(docs, items).collect())
    assert rows == [("None", 1, 1), ("None", 2, 2), ("q", 1, 1), ("q", 2, 2)]
