"""Contract columns against plain Python on whole driver tables, and the pipeline against a brute-force version."""

import hashlib
import random
import re
import string
import zlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from quantloom.llm import decontaminate, jaccard_groups, language_mix, licenses, mixing, quality_rules, rule_ensemble, secret_scan, suffix_dedup
from quantloom.llm.license_rules import BY_LICENSE

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
BLANK = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def texts():
    return {i: t or "" for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()}


def test_op2_counts(spark, texts):
    for r in quality_rules.op2_quality_rules(spark, SF).collect():
        t = texts[r.doc_id]
        words = BLANK.findall(t)
        lines = [x for x in t.split("\n") if BLANK.search(x)]
        places = {}
        for i in range(len(words) - 2):
            places.setdefault(tuple(words[i : i + 3]), []).append(i)
        again = {i + k for p in places.values() if len(p) > 1 for i in p for k in range(3)}
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(words) < 50 or 100 * len(again) > 50 * len(words))
        assert not (r.base_failed and r.kept)


def test_op2_null_and_empty_lang_are_two_strata(spark):
    docs = spark.createDataFrame([(1, "a b", None), (2, "a b", ""), (3, "a b", "en")], "doc_id long, text string, lang string")
    assert len({r.stratum for r in quality_rules.statistics(docs).collect()}) == 3


def test_op7_base(spark, texts):
    for r in licenses.op7_licenses(spark, SF).collect():
        words = ALNUM.findall(texts[r.doc_id].translate(LOWER))
        found = {}
        for phrase, label in licenses.BASE:
            parts = phrase.split(" ")
            found[label] = [i for i in range(len(words)) if words[i : i + len(parts)] == parts]
        places = sum(found.values(), [])
        labels = sorted(k for k, v in found.items() if v)
        assert (r.n_words, r.n_base, r.base_labels) == (len(words), len(places), ",".join(labels))
        assert (r.first_word, r.last_word) == ((min(places), max(places)) if places else (None, None))
        assert set(labels) <= set(r.labels.split(",")) and 0 <= r.score <= 1


@settings(max_examples=400, deadline=None)
@given(st.data())
def test_op7_keyword_is_in_every_match(data):
    rules = licenses.signature_rules()
    _, _, keyword, pattern, _ = data.draw(st.sampled_from(rules))
    sample = data.draw(st.from_regex(re.compile(pattern, re.ASCII)))
    assert keyword in re.search(pattern, sample, re.ASCII).group()


def test_op7_rules_fire_alone(spark):
    rules = licenses.signature_rules()
    assert {r[1] for r in rules} == set(BY_LICENSE) and len(rules) == sum(map(len, BY_LICENSE.values()))
    texts = ["see https://creativecommons.org/licenses/by/4.0/ there", "Released under the GPL v3.", "Distributed under the terms of the Apache 2.0", "é" * 90 + " all  rights\nreserved " * 700]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, words string, keywords string")
    out = {r.doc_id: r.labels for r in licenses.scan_licenses(df).collect()}
    assert [out[i] for i in range(4)] == [["cc-by"], ["gpl-3"], ["apache-2"], ["proprietary"]]


def base_spans(t):
    found = [("assign", m.start(), m.end()) for m in re.finditer(r"(?:(?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t) if len(m.group(1)) >= 6]
    found += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m.group()) >= 20]
    found += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m.group()) >= 24]
    order = {"assign": 0, "access": 1, "hex": 2}
    return sorted(found, key=lambda s: (s[1], order[s[0]]))


def test_op8_base(spark, texts):
    for r in secret_scan.op8_secrets(spark, SF).collect():
        want = base_spans(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in want) for k in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(r.spans.split(","))


def test_op8_candidates(spark):
    rng = random.Random(8)
    code = lambda n, chars: "".join(rng.choice(chars) for _ in range(n))
    words = " ".join(rng.choice(["under", "morning", "river2", "station", "paper", "window_frame", "Internationalisation"]) for _ in range(300))
    rows = [(i, f"{words} secret={code(32, string.ascii_letters + string.digits)} {words}") for i in range(60)]
    letters, short = code(24, string.ascii_letters), code(17, string.ascii_letters + string.digits)
    rows += [(100, letters), (101, short), (102, "1234567890123456 morningmorningstation INTERNATIONALISATION"), (103, f"token=abcdef/{'x' * 3} {letters}")]
    rows += [(104, ("z " * 50 + f"{letters} ") * 400), (104, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("loose", F.lit("x")).withColumn("spans", F.lit("y"))
    out = {r.doc_id: [(s.start, s.end, s.kind) for s in r.spans] for r in secret_scan.scan_secrets(df).collect() if r.doc_id > 99 and r.spans}
    assert out[100] == [(0, 24, "markov")] and out[101] == [(0, 17, "markov")] and 102 not in out
    assert out[103][-1] == (17, 41, "markov") and len(out[104]) == 400
    clean = secret_scan.redact(df)
    assert clean.columns == df.columns and clean.count() == len(rows)
    assert not clean.filter(F.contains("text", F.lit(letters))).count()


def test_op3_held_out(spark):
    langs = {i: x for i, x in duckdb.sql(f"SELECT doc_id, lang FROM '{SF}/documents.parquet'").fetchall()}
    got = [(langs[r.doc_id], r.lang_pred) for r in language_mix.op3_language(spark, SF).collect() if r.held_out and langs[r.doc_id] and r.lang_pred != "und"]
    assert len(got) > 20 and sum(a == b for a, b in got) >= 0.9 * len(got)


def test_op3_many_languages_and_long_texts(spark):
    rng = random.Random(5)
    tongues = {f"l{k}": ["".join(rng.choice(string.ascii_lowercase) for _ in range(6)) for _ in range(8)] for k in range(9)}
    say = lambda k, n: " ".join(rng.choice(tongues[f"l{k}"]) for _ in range(n))
    rows = [(i, say(i % 9, 80), f"l{i % 9}") for i in range(180)]
    rows += [(1000, " ".join(say(k, 200) for k in range(6)), None), (1001, say(3, 200_000), None), (1001, say(3, 50), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("share", F.lit(1)).withColumn("gram", F.lit(2))
    out = language_mix.identify(df, *language_mix.learn_languages(df)).collect()
    mixed = next(r for r in out if r.doc_id == 1000)
    assert {x.lang for x in mixed.languages} == {f"l{k}" for k in range(6)}
    assert [r.lang_pred for r in out if r.doc_id == 1001] == ["l3", "l3"]
    few, model = language_mix.learn_languages(df, languages=4)
    assert len(few) == 4 == model.shape[1]


def test_op6_held_out(spark):
    marks = {i: q for i, q in duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall()}
    got = [(marks[r.doc_id], r.predicted) for r in rule_ensemble.op6_quality(spark, SF).collect() if r.held_out and marks.get(r.doc_id) is not None]
    assert got and sum(a == b for a, b in got) >= 0.85 * len(got)


def test_op6_repeated_rows_are_fitted_once(spark):
    docs = spark.createDataFrame([(1, "good text here"), (1, "good text here"), (1, "other"), (2, "bad ###")], "doc_id long, text string").withColumn("s", F.lit(1))
    labels = spark.createDataFrame([(i, 1) for i in (1, 2, 3)], "doc_id long, quality int").withColumn("text", F.lit("x"))
    used = sum(1 for i in (1, 2) if zlib.crc32(str(i).encode()) % 5)
    assert len(rule_ensemble.training_rows(docs, labels)[1]) == used


def test_op1_any_bytes(spark):
    passage = "F1" * 20 + "FF" + "C3" * 45
    rows = spark.sql(f"SELECT 1L AS doc_id, CAST(X'6162{passage}' AS STRING) AS text UNION ALL SELECT 2L, CAST(X'{passage}7A' AS STRING)")
    out = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(rows).collect()}
    assert out == {1: (68, 0, 0), 2: (67, 66, 1)}


def test_op4_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text), (1, text), (1, text), (2, "x"), (None, None), (None, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(f"w{i}" for i in range(5, 20)))], "item_id long, text string")
    out = decontaminate.decontaminate(docs, items).collect()
    assert len(out) == 6 and sum(r.n_hit == 15 for r in out) == 3


def test_op5_near_copies_without_id(spark):
    words = [f"v{k}" for k in range(80)]
    near = [*words[:40], "new", *words[41:]]
    rows = [(None, " ".join(near)), (4, " ".join(words)), (None, "lonely text of mine"), (None, "lonely text of mine"), (None, ""), (None, ""), (9, "other words here"), (9, "other words here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("label", F.lit("x")).withColumn("times", F.lit(1))
    out = jaccard_groups.near_components(docs).collect()
    assert sorted(str(r.component_id) for r in out if r.n_shingles > 70) == ["4", "4"]
    kept = sorted((str(r.doc_id), r.text) for r in jaccard_groups.keep_one_of_each(docs).collect())
    assert kept == [("4", " ".join(words)), ("9", "other words here"), ("None", ""), ("None", ""), ("None", "lonely text of mine")]


def test_op10_written_mix_of_repeated_rows(spark):
    rows = [(1, "a b c d", "s", 1)] * 4 + [(2, "e f", "s", 1), (2, "g h", "s", 2), (3, "i j k", None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copy int").withColumn("finish", F.lit("x"))
    plan = mixing.mix(docs).collect()
    written = mixing.mixed_documents(docs)
    assert written.columns == ["doc_id", "text", "source", "copy", "finish"]
    assert sum(len(r.text.split()) for r in written.collect()) == sum(r.taken for r in plan)


def queue(docs):
    """doc ids of the mix in order of finish, by the plain method."""
    size = {i: len(BLANK.findall(t)) for i, t, _ in docs}
    names = sorted({s for *_, s in docs if s is not None}) + [None] * any(s is None for *_, s in docs)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    whole = {s: sum(size[i] for i, _, x in docs if x == s) for s in names}
    target, open_, rest = {}, set(names), 1.5 * sum(whole.values())
    while open_:
        level = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= 2 * whole[s]}
        for s in full or open_:
            target[s] = 2.0 * whole[s] if full else weight[s] * level
            rest -= target[s]
        open_ -= full or open_
    copies = []
    for s in names:
        at = 0
        for i in sorted((i for i, _, x in docs if x == s), key=lambda i: hashlib.md5(str(i).encode()).hexdigest()):
            at += size[i]
            copies += [((at + c * whole[s]) / target[s], hashlib.md5(str(i).encode()).hexdigest(), c, i) for c in (0, 1) if size[i]]
    taken, total = [], 0
    for place in sorted(copies):
        total += size[place[3]]
        if total > 1.5 * sum(whole.values()):
            break
        taken.append(place[3])
    return taken


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id: (r.text or "", r.source) for r in corpus_pipeline.quality(spark, docs, SF).collect()}
    sets = {}
    for i, (t, _) in kept.items():
        w = BLANK.findall(t.translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    boss = {i: i for i in kept}

    def root(i):
        while boss[i] != i:
            i = boss[i]
        return i

    ids = sorted(kept)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                boss[y] = x
    single = [i for i in ids if root(i) == i]
    items = [ALNUM.findall((t or "").translate(LOWER)) for _, t in duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()]
    windows = {tuple(w[k : k + 10]) for w in items for k in range(max(1, len(w) - 9) if w else 0)}
    widths = {len(w) for w in windows}
    words = {i: ALNUM.findall(kept[i][0].translate(LOWER)) for i in single}
    clean = [i for i in single if not any(tuple(words[i][k : k + n]) in windows for n in widths for k in range(len(words[i]) - n + 1))]
    assert 0 < len(clean) < len(single) < len(kept)
    left = spark.createDataFrame([(i, kept[i][0]) for i in clean], "doc_id long, text string")
    want = {}
    for r in secret_scan.scan_secrets(left).collect():
        t, at, parts = kept[r.doc_id][0], 0, []
        for s in r.spans:
            if s.start >= at:
                parts += [t[at : s.start], "[secret]"]
            at = max(at, s.end)
        want[r.doc_id] = "".join(parts) + t[at:]
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r.text for r in out}.items() <= want.items()
    assert [r.doc_id for r in sorted(out, key=lambda r: (r.finish, hashlib.md5(str(r.doc_id).encode()).hexdigest()))] == queue([(i, want[i], kept[i][1]) for i in clean])
    assert all(not base_spans(r.text) for r in out)


def test_pipeline_stages_keep_any_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    names = ("kept", "finish", "copy", "hit_id", "hit_mark", "m_doc", "row", "words", "spans", "shape", "lines", "label", "quality", "score", "mark", "times")
    docs = docs.withColumns({c: F.lit("x") for c in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        out.count()
    last = corpus_pipeline.mixed(spark, docs, SF)
    assert last.columns == [c for c in docs.columns if c not in ("copy", "finish")] + ["copy", "finish"]
    assert corpus_pipeline.mixed(spark, docs.limit(0), SF).count() == 0
