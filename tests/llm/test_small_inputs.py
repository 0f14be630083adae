"""Every corpus operator on nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
import random
import re
import string

import pytest
from pyspark.sql import functions as F

from quantloom.llm import decontaminate, jaccard_groups, language_mix, licenses, mixing, quality_rules, rule_ensemble
from quantloom.llm import secret_scan, suffix_dedup, url_filter

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("words", "size", "h1", "label", "spans", "mark", "kept", "hit_doc", "hit_mark", "row", "m_doc", "finish", "copy", "k_doc", "p_mark", "quality")
WORDS = [f"w{i}" for i in range(400)]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    base = [sentence(rng, rng.randint(60, 120)) for _ in range(25)]
    out = [(i, t, "en" if i % 2 else "de", f"s{i % 3}", len(t)) for i, t in enumerate(base)]
    words = base[0].split()
    words[40] = "changed"
    out += [
        (25, None, None, None, None),
        (26, "", "en", "s1", 0),
        (27, " \n\t ", "en", "s1", 4),
        (28, base[3], "en", None, len(base[3])),
        (29, base[3], "de", "s0", len(base[3])),
        (30, " ".join(words), "en", "s0", 1),
        (31, sentence(rng, 10) + " " + base[5][:300], "en", "s2", 1),
        (32, ("same line here\n" * 3000) + "end", "en", "s2", 1),
        (33, "é" * 40 + base[7], "fr", "s2", 1),
        (34, "short one", "en", "s2", 9),
        (34, "short one", "en", "s2", 9),
        (None, base[2], "en", "s0", 1),
        (None, None, None, None, None),
    ]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    # Extra columns with names that operators might use inside.
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in CLASHING})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_repeats_against_brute_force(docs, rows, empty):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs).collect())
    first = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49 if i is not None else 0):
            w = b[p : p + 50]
            first[w] = min(first.get(w, i), i)
    want = []
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - 49 if i is not None else 0):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = [True] * 50
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want.append((i is None, i or 0, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    assert got == sorted(want)
    hot = suffix_dedup.remove_repeats(docs, hot=0).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in hot) == got
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_components_against_brute_force(docs, rows, empty):
    sets = []
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append((i, frozenset(tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))) if w else frozenset()))
    boss = list(range(len(sets)))

    def root(k):
        while boss[k] != k:
            k = boss[k]
        return k

    for a, (_, x) in enumerate(sets):
        for b, (_, y) in enumerate(sets[:a]):
            if x and y and 100 * len(x & y) >= 90 * len(x | y):
                boss[root(a)] = root(b)
    least = {}
    for k, (i, x) in enumerate(sets):
        if i is not None and x:
            least[root(k)] = min(least.get(root(k), i), i)
    want = sorted((str(i), len(x), str(least.get(root(k)) if x else i)) for k, (i, x) in enumerate(sets))
    for group in (256, 2):
        got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_groups.near_components(docs, group).collect())
        assert got == want
    assert jaccard_groups.near_components(empty).count() == 0
    kept = jaccard_groups.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert {28, 29, 30}.isdisjoint({r.doc_id for r in kept.collect()})


def test_components_of_long_chains(spark):
    from quantloom.llm.components import components

    # Zigzag: 0 - 999 - 1 - 998 - ...; a shuffled path; a path in order; a loop on its own.
    zigzag = [k // 2 if k % 2 == 0 else 999 - k // 2 for k in range(1000)]
    mixed = random.Random(6).sample(range(2000, 3000), 1000)
    links = [e for path in (zigzag, mixed, range(4000, 5000)) for e in zip(path, path[1:], strict=False)] + [(7000, 7000)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: low for low in (0, 2000, 4000) for i in range(low, low + 1000)} | {7000: 7000}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_part_keys_meet_for_every_linked_pair():
    import numpy as np

    rng = np.random.default_rng(0)
    for n in (9, 10, 19, 37, 60, 150, 700, 3000):
        for _ in range(30):
            x = np.unique(rng.integers(1, 2**63, n, dtype=np.uint64))
            drop = int(rng.integers(0, len(x) // 10 + 1))
            extra = (10 * (len(x) - drop) - 9 * len(x)) // 9
            y = np.concatenate([x[drop:], rng.integers(1, 2**63, max(0, int(rng.integers(0, max(extra, 0) + 1))), dtype=np.uint64)])
            y = np.unique(y)
            both = len(np.intersect1d(x, y))
            if 100 * both >= 90 * (len(x) + len(y) - both):
                assert len(np.intersect1d(jaccard_groups.part_keys(x), jaccard_groups.part_keys(y)))


def test_column_transform_sorts_suffixes():
    import numpy as np

    rng = random.Random(9)
    strings = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 12))).encode() for _ in range(80)]
    data = np.frombuffer(b"".join(strings), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in strings])])
    owner, start, common = suffix_dedup.column_transform(data, offsets)
    got = [strings[i][j:] for i, j in zip(owner, start, strict=True)]
    assert got == sorted(s[j:] for s in strings for j in range(len(s) + 1))
    for k in range(1, len(got)):
        a, b = got[k - 1], got[k]
        n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert common[k] == n


def test_quality_rules(spark, docs, rows, empty):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(10)] + [(3, None, 1), (99, 0, 0)], "doc_id long, quality int, toxic int")
    out = quality_rules.judge_quality(docs, labels).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out if r.doc_id is not None}
    assert by[25].n_words == 0 and by[25].base_failed and not by[25].kept
    assert by[32].n_dup_lines == 2999 and by[32].base_failed
    assert by[0].kept
    assert quality_rules.judge_quality(empty, labels).count() == 0
    assert quality_rules.judge_quality(docs, labels.limit(0)).count() == len(rows)


def test_binomial_tail_is_exact(spark):
    from math import comb

    df = spark.createDataFrame([(0, 50), (3, 200), (10, 500)], "k long, n long")
    got = df.select("k", "n", quality_rules.binomial_tail(F.col("k"), F.col("n"), 0.02).alias("t")).collect()
    for r in got:
        assert r.t == pytest.approx(sum(comb(r.n, i) * 0.02**i * 0.98 ** (r.n - i) for i in range(r.k + 1)))


def test_cutoffs_keep_their_promise(spark):
    good = [(f"g{i}", "en", False, 0.0 if i > 2 else 0.9, 1) for i in range(4000)]
    bad = [(f"b{i}", "en", False, 0.7, 0) for i in range(300)]
    few = [(f"f{i}", "xx", False, 0.7 * (i % 2), i % 2) for i in range(20)]
    rows = [(i, s, f, *[v] * len(quality_rules.GRIDS), q) for i, s, f, v, q in good + bad + few]
    schema = "doc_id string, stratum string, base_failed boolean, " + ", ".join(f"{k} double" for k in quality_rules.GRIDS) + ", quality int"
    cuts = quality_rules.choose_cutoffs(spark.createDataFrame(rows, schema)).collect()
    assert {r.stratum for r in cuts} == {"en"}
    # The laxest admissible cutoff that catches every bad document.
    assert {r.rule: r.cutoff for r in cuts}["repeat_ratio"] == 0.4


def test_language(spark, rows, empty):
    rng = random.Random(1)
    texts = {"aa": ["alo", "bami", "kuna"], "bb": ["strum", "krind", "plosk"]}
    made = [(i, " ".join(rng.choice(texts[g]) for _ in range(60)), g) for i in range(80) for g in [rng.choice(list(texts))]]
    half = " ".join(["alo bami kuna"] * 40 + ["strum krind plosk"] * 20)
    made += [(1000, None, "aa"), (1001, "12 !?", "bb"), (1002, "", None), (1003, half, None), (None, "alo bami", None)]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in language_mix.identify(df, *language_mix.learn_languages(df)).collect()}
    assert all(out[i].lang_pred == g for i, _, g in made[:80])
    assert {out[i].lang_pred for i in (1000, 1001, 1002)} == {"und"} and out[1001].score == 0
    mixed = {x.lang: x.share for x in out[1003].languages}
    # Shares are of letters: 11 of each three words of one language, 16 of the other.
    assert mixed["aa"] == pytest.approx(440 / 760, abs=0.05) and mixed["bb"] == pytest.approx(320 / 760, abs=0.05)
    assert language_mix.identify(df.limit(0), *language_mix.learn_languages(df.limit(0))).count() == 0
    none = language_mix.identify(df, *language_mix.learn_languages(df.limit(0))).collect()
    assert {r.lang_pred for r in none} == {"und"}


def test_decontaminate_against_brute_force(spark, docs, rows, empty):
    words_of = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    five = " ".join(words_of(rows[5][1])[20:45])
    items = [(1, five.upper()), (2, "short one"), (3, None), (4, ""), (5, "nowhere at all to be found in these texts my friend"), (6, five), (None, "w1"), (7, "w7")]
    table = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for i, t in items:
        w = words_of(t)
        if i is not None:
            for k in range(max(1, len(w) - 9) if w else 0):
                windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    want = set()
    for i, t, *_ in rows:
        w, hit, found = words_of(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        want.add((str(i), len(w), len(hit), ",".join(sorted(found))))
    got = decontaminate.decontaminate(docs, table).collect()
    assert {(str(r.doc_id), r.n_words, r.n_hit, ",".join(r["items"])) for r in got} == want
    assert decontaminate.decontaminate(docs, table.limit(0)).filter("n_hit > 0").count() == 0
    assert decontaminate.decontaminate(empty, table).count() == 0
    clean = decontaminate.clean_documents(docs, table)
    assert clean.columns == docs.columns and clean.filter("doc_id = 5").count() == 0


def test_rule_ensemble(spark, docs, rows, empty):
    rng = random.Random(2)
    made = []
    for i in range(400):
        bad = i % 4 == 0
        made.append((i, " ".join(w + ("###" if bad else "") for w in sentence(rng, 50).split()), 0 if bad else 1))
    df = spark.createDataFrame([(i, t) for i, t, _ in made], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in made] + [(5000, 1), (1, None)], "doc_id long, quality int")
    scores = {r.doc_id: r.score for r in rule_ensemble.score_quality(df, labels).collect()}
    assert all((scores[i] >= 0.3) == (q == 1) for i, _, q in made)
    out = rule_ensemble.score_quality(docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert {r.score for r in rule_ensemble.score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert rule_ensemble.score_quality(empty, labels).count() == 0
    kept = rule_ensemble.keep_good(df, labels)
    assert kept.columns == df.columns and kept.count() == 300


def test_licenses(spark, empty):
    texts = [
        (1, "Released under the MIT License."),
        (2, "Licensed under the Apache License, Version 2.0."),
        (3, "cc by nc CC BY-NC 4.0"),
        (4, "This work is licensed under the GNU Lesser General Public License, version 3."),
        (5, "SPDX-License-Identifier: BSD-3-Clause"),
        (6, None),
        (7, "nothing here"),
        (7, "nothing here"),
    ]
    out = [r for r in licenses.scan_licenses(spark.createDataFrame(texts, "doc_id long, text string")).collect()]
    by = {r.doc_id: r for r in out}
    assert len(out) == len(texts)
    assert by[1].places == [1] and by[1].labels == ["mit"]
    assert by[2].base_labels == ["apache-2"] and by[2].labels == ["apache-2"]
    assert by[3].places == [0, 3]
    assert by[4].base_labels == [] and by[4].labels == ["lgpl-3"]
    assert by[5].labels == ["bsd-3"]
    assert by[6].n_words == 0 and by[6].labels == [] and by[6].score == 0
    assert licenses.scan_licenses(empty).count() == 0
    assert len(licenses.signature_rules()) >= 200


def test_licenses_without_the_word_license(spark):
    want = {
        "Released under the GNU GPL version 3": "gpl-3",
        "distributed under CC BY-SA": "cc-by-sa",
        "It is published under the terms of the GPLv2.": "gpl-2",
        "available under MPL 2.0": "mpl-2",
        "see https://creativecommons.org/publicdomain/zero/1.0/": "cc0",
        "http://www.mozilla.org/MPL/2.0/": "mpl-2",
        "https://www.eclipse.org/legal/epl-2.0/": "epl-2",
        "https://scripts.sil.org/OFL": "ofl",
        "http://www.wtfpl.net/": "wtfpl",
        "Dedicated to the public domain": "public-domain",
        "All rights reserved.": "proprietary",
    }
    assert not any("licen" in text.lower() for text in want)
    df = spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")
    out = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    assert [out[i].labels for i in range(len(want))] == [[label] for label in want.values()]
    assert all(r.score > 0 for r in out.values())


def test_secrets(spark, docs, rows, empty):
    rng = random.Random(3)
    code = lambda n: "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n))
    words = " ".join(rng.choice(["under", "morning", "river", "station", "paper", "window"]) for _ in range(200))
    texts = [(i, f"{words} token = '{code(32)}' {words}") for i in range(40)]
    loose = code(28)
    texts += [(100, f"é {loose} end"), (101, "PassWord: abc secret=abcdef"), (102, "AKIA" + "A" * 16 + " " + "0a" * 12), (103, None), (104, "secret=token = \"abcdefgh\"")]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("n_chars", F.length("text"))
    out = {r.doc_id: r for r in secret_scan.scan_secrets(df).collect()}
    assert [(s.start, s.end, s.kind) for s in out[100].spans] == [(2, 30, "markov")]
    assert [(s.start, s.end, s.kind) for s in out[101].spans] == [(14, 27, "assign")]
    assert [(s.start, s.end, s.kind) for s in out[102].spans] == [(0, 20, "access"), (21, 45, "hex")]
    assert out[103].spans == [] and out[104].n_assign == 0
    clean = {r.doc_id: r for r in secret_scan.redact(df).collect()}
    assert clean[100].text == "é [secret] end" and clean[100].n_chars == len("é [secret] end")
    assert clean[103].text is None
    assert secret_scan.scan_secrets(docs).count() == len(rows)
    assert secret_scan.redact(docs).exceptAll(docs.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long")))).count() == 0
    assert secret_scan.scan_secrets(empty).count() == 0


def test_urls(spark):
    pages = [
        (1, "https://www.Listed.example.net/a/?x#y"),
        (2, "http://m.listed.example.net/a"),
        (3, "http://x.example.org/en/12"),
        (4, "http://example.org/"),
        (5, None),
        (6, "no scheme"),
        (7, "http://notexample.org/en/1"),
        (8, "http://other.net/a"),
        (8, "http://other.net/a"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string").withColumn("html", F.lit("x"))
    listed = spark.createDataFrame([("http://listed.example.net/a",), (None,), ("http://listed.example.net/a",)], "url string")
    out = url_filter.judge_urls(df, listed).collect()
    by = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out}
    assert len(out) == len(pages)
    assert by[1] == ("www.listed.example.net", "/a/", None, "block") and by[2][3] == "block"
    assert by[3][2:] == ("example.org/en/1", "block") and by[4][2:] == ("org/", "allow")
    assert by[5] == ("", "", None, "allow") == by[6]
    assert by[7][2:] == ("org/", "allow") and by[8][3] == "allow"
    assert url_filter.judge_urls(df, listed.limit(0)).filter("listed").count() == 0
    assert url_filter.judge_urls(df.limit(0), listed).count() == 0


def test_mixing(docs, rows, empty):
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = sum(size(r[1]) for r in rows)
    assert sum(r.taken for r in out) <= 1.5 * total
    biggest = max(size(r[1]) for r in rows)
    sources = {r.source for r in out}
    assert None in sources
    for s in sources:
        mine = [r for r in out if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= biggest
        assert mine[0].target <= 2 * mine[0].source_size
    assert all(r.taken <= 2 * r.size for r in out)
    again = mixing.mix(docs.repartition(3)).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, out)) == sorted(map(key, again))
    assert mixing.mix(empty).count() == 0
    # Copies written out are exactly those that the table of sizes counts.
    single = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    taken = sum(r.taken for r in mixing.mix(single).collect())
    assert sum(size(r.text) for r in mixing.mixed_documents(single).collect()) == taken
    assert mixing.mixed_documents(empty).count() == 0
