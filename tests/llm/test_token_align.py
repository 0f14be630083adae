"""Token alignment against encoding every text whole."""

import hashlib
import itertools
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from quantloom.llm import token_align as T

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def own():
    return T.Aligner(T.TOKENIZERS)


def whole(own, text):
    """Ids, ends, groups and links from one encoding of the whole text, by plain loops over decoded bytes."""
    if not text:
        return None
    raw = f" {text}".encode()
    ids_a, ids_b = own.a.encode(f" {text}", add_special_tokens=False).ids, own.b.encode(text)
    tokens_a, tokens_b = [own.bytes_a[i] for i in ids_a], [own.bytes_b[i] for i in ids_b]
    if b"".join(tokens_a) != raw or b"".join(tokens_b) != raw:
        return None
    ends_a, ends_b = (list(itertools.accumulate(map(len, t))) for t in (tokens_a, tokens_b))
    groups, links, i, j, from_a, from_b, at = [], [], 0, 0, 0, 0, 0
    while i < len(ids_a):
        links.append((ids_a[i], ids_b[j]))
        a, b = ends_a[i], ends_b[j]
        i, j = i + (a <= b), j + (b <= a)
        if a == b:
            groups.append((at, a, ids_a[from_a:i], ids_b[from_b:j]))
            from_a, from_b, at = i, j, a
    return ids_a, ids_b, groups, links


def digest(groups):
    return hashlib.sha256(";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for _, _, a, b in groups).encode()).hexdigest()


def brute(own, texts):
    """Expected rows of all texts, and how many lookups fell on each pair."""
    found = [whole(own, t) for t in texts]
    count = Counter(p for f in found if f for p in set(f[3]))
    most = {}
    for (a, _), n in count.items():
        most[a] = max(n, most.get(a, 0))
    rows = []
    for f in found:
        if f is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
        else:
            a, b, groups, links = f
            rows.append((len(a), len(b), len(groups), len(links), sum(count[x] == most[x[0]] for x in links), sum(count[x] for x in links), digest(groups)))
    return rows


def as_rows(df):
    return {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()}


def odd_texts():
    rng = random.Random(12)
    alphabet = [*"ab c  \n\t'sé日😀\x00\x1c<|>1.,ﬁ\xa0", "<|endoftext|>", "</s>", "<0x41>", "'ll", "▁"]
    texts = ["".join(rng.choice(alphabet[: -1 if k % 4 else None]) for _ in range(rng.randint(1, 60))) for k in range(300)]
    return [*texts, None, "", " ", "▁", "x", "x", "日本語" * 50, "a" * 3000, "one two\nthree  four " * 2000]


def test_driver_table(spark, own):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()
    assert as_rows(T.op12_align(spark, SF)) == dict(zip([r[0] for r in rows], brute(own, [r[1] for r in rows]), strict=True))


@pytest.mark.parametrize("most", [T.LOOKUP_PAIRS, 40, 0])
def test_odd_texts_and_both_ways_of_looking_up(spark, own, most):
    texts = odd_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("pairs", F.lit("x")).withColumn("row", F.lit("y"))
    assert as_rows(T.align_documents(docs, most=most)) == dict(enumerate(brute(own, texts)))


def test_parts_and_forgetting_change_nothing(own, monkeypatch):
    texts = odd_texts()
    want = list(own.digests(texts))
    monkeypatch.setattr(T, "PART_CHARS", 50)
    monkeypatch.setattr(T, "KEPT_CHARS", 200)
    other = [d for k in range(0, len(texts), 7) for d in own.digests(texts[k : k + 7])]
    for a, b in zip(want, other, strict=True):
        assert a[:2] == b[:2] and a[2].tolist() == b[2].tolist() and a[3].tolist() == b[3].tolist()


def test_groups_are_a_real_output(spark, own, monkeypatch):
    texts = odd_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in T.alignments(docs).orderBy("doc_id", "part").collect():
        got.setdefault(r.doc_id, []).extend((g.start, g.end, list(g.a), list(g.b)) for g in r.groups)
    want = {i: f[2] for i, t in enumerate(texts) if (f := whole(own, t))}
    assert got == want


def test_no_rows_and_repeated_ids(spark, own):
    assert T.align_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "a b"), (1, "c")], "doc_id long, text string")
    out = T.align_documents(docs).collect()
    assert sorted((r.doc_id or 0, r.count_sum) for r in out if r.doc_id is None) == [(0, 6), (0, 6)] and len(out) == 4
