r"""Language identification as the inference of a mixture.

A language is a distribution over hashed letter trigrams.  A text is a mixture
of languages: its letters are cut into windows of ``WINDOW`` trigrams, each
written in one language, and expectation-maximisation estimates the languages'
proportions.  The set of languages is chosen by penalised likelihood: the k most
likely languages, k = 1, 2, ..., are fitted again, and each language beyond the
first must raise the log-likelihood by more than the penalty.  A text goes on as
long as its next language has half a window or more in the mixture of all.  The
prediction is the language with the largest proportion, the score its share.

Learning uses text and non-null lang of documents whose crc32(doc_id as text)
mod 4 is not 2, of each language at most about ``SAMPLE_DOCS`` documents, taken
by a hash of doc_id, and of the ``LANGUAGES`` languages with most documents.  lang, source and doc_id are never inputs of a prediction.

Defined results.  Null text and text without a letter give ``und`` and score 0,
as does everything if nothing could be learned.  Ties go to the language that
sorts first.  A null doc_id is not held out and not learned from.  Repeated rows
each get a row.  Columns beside doc_id, text and lang are ignored.

Scale.  Learning counts documents per language, then reads the sample only: the
shares are literals of its filter, so no text is shuffled.  It returns languages
x ``BUCKETS`` counts (4 bytes each in the model: 128 KB a language, 64 MB at
most), whatever the corpus.  Prediction is one pass over the texts, with the
model broadcast, and no shuffle; a task holds the likelihoods of ``PIECE`` letters
at a time, however long a text is.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import bucket_of

BUCKETS = 1 << 15
WINDOW = 48
LANGUAGES = 512
SAMPLE_DOCS = 1500
#: Log-likelihood that a further language must add, besides half the log of the windows.
PENALTY = 12.0
STEPS = 15
HELD_OUT = 4
#: Letters are worked on in pieces of about this many.
PIECE = 1 << 20

_LETTERS: dict[str, np.ndarray] = {}


def _is_letter(codes: np.ndarray) -> np.ndarray:
    if "table" not in _LETTERS:
        _LETTERS["table"] = np.array([chr(i).isalpha() for i in range(0x40000)], bool)
    table = _LETTERS["table"]
    return table[np.minimum(codes, len(table) - 1)]


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram buckets around every letter of the texts (lower-cased, others as blank) and each text's bounds."""
    lowered = [" " + (t or "").lower() + " " for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) for t in lowered])
    letter = _is_letter(codes)
    kept = np.where(letter, codes, 0).astype(np.uint64)
    middle = np.flatnonzero(letter)
    mixed = (kept[middle - 1] * np.uint64(0x9E3779B1) + kept[middle] * np.uint64(0x85EBCA77)) * np.uint64(
        0xC2B2AE3D27D4EB4F
    ) + kept[middle + 1] * np.uint64(0x165667B19E3779F9)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    grams = (mixed >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)
    return grams, np.concatenate([[0], np.searchsorted(middle, ends)])


def _rows(texts: list, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    first = size = 0
    for k, text in enumerate(texts):
        if size and size + len(text or "") > limit:
            yield first, k
            first, size = k, 0
        size += len(text or "") + 2
    if first < len(texts):
        yield first, len(texts)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        texts = batch.column("text").to_pylist()
        for a, b in _rows(texts):
            grams, bounds = trigrams(texts[a:b])
            owner = np.repeat(np.arange(b - a), np.diff(bounds))
            own = langs[a:b]
            for lang in sorted(set(own)):
                counts = np.bincount(grams[(own == lang)[owner]], minlength=BUCKETS)
                seen = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(seen), pa.string()), pa.array(seen), pa.array(counts[seen])],
                    names=["lang", "gram", "n"],
                )


def learn_languages(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, languages: int = LANGUAGES) -> tuple[list[str], np.ndarray]:
    """Languages in order, and log P(trigram | language) as an array of BUCKETS x languages."""
    usable = docs.select("doc_id", "text", "lang").filter(
        (bucket_of(F.col("doc_id"), HELD_OUT) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()
    )
    seen = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()
    share = F.lit(0.0)
    for n, named in groupby(seen, key=lambda r: r["n"]):
        share = F.when(F.col("lang").isin([r["lang"] for r in named]), F.lit(min(1.0, sample_docs / n))).otherwise(share)
    place = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) / 1_000_000
    counts = usable.filter(place < share).select("lang", "text").mapInArrow(_count_grams, "lang string, gram long, n long")
    rows = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows["lang"].unique().tolist())
    table = np.full((BUCKETS, len(langs)), 0.5)
    table[rows["gram"].to_numpy(int), rows["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int)] += rows[
        "n"
    ].to_numpy(float)
    return langs, np.log(table / table.sum(axis=0)).astype(np.float32)


def _mixture(like: np.ndarray, first: np.ndarray, owner: np.ndarray, allowed: np.ndarray, steps: int = STEPS):
    """Proportions per text and its log-likelihood by EM over its windows, within the allowed languages."""
    share = allowed / allowed.sum(axis=1, keepdims=True)
    windows = np.diff(np.append(first, len(like)))
    top = like.max(axis=1, keepdims=True)
    weight = np.exp(np.maximum(like - top, -60.0)) * allowed[owner]
    total = None
    for _ in range(steps):
        joint = weight * share[owner]
        total = joint.sum(axis=1)
        share = np.add.reduceat(joint / np.maximum(total, 1e-300)[:, None], first, axis=0) / windows[:, None]
    total = (weight * share[owner]).sum(axis=1)
    return share, np.add.reduceat(np.log(np.maximum(total, 1e-300)) + top[:, 0], first)


def _window_likelihoods(model: np.ndarray, grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Log-likelihood of each window under each language; a piece of the letters at a time."""
    ends = np.append(starts[1:], len(grams))
    out = np.empty((len(starts), model.shape[1]))
    step = max(1, PIECE // (WINDOW * max(1, model.shape[1] // 8)))
    for a in range(0, len(starts), step):
        own = slice(a, min(a + step, len(starts)))
        low = starts[own][0]
        out[own] = np.add.reduceat(model[grams[low : ends[own][-1]]], starts[own] - low, axis=0)
    return out


def predict(texts: list[str | None], model: np.ndarray, penalty: float = PENALTY):
    """Index of the predicted language (-1: none), its share, and all shares, of every text."""
    n, languages = len(texts), model.shape[1]
    best, score, shares = np.full(n, -1), np.zeros(n), np.zeros((n, languages))
    grams, bounds = trigrams(texts)
    counts = np.diff(bounds)
    there = np.flatnonzero(counts > 0)
    if not len(there) or not languages:
        return best, score, shares
    cuts = -(-counts[there] // WINDOW)
    first = np.concatenate([[0], np.cumsum(cuts)[:-1]])
    owner = np.repeat(np.arange(len(there)), cuts)
    starts = bounds[there][owner] + (np.arange(len(owner)) - first[owner]) * WINDOW
    like = _window_likelihoods(model, grams, starts)
    whole, _ = _mixture(like, first, owner, np.ones((len(there), languages)))
    # The likeliest single language first, then sets by their share of the full mixture.
    rank = np.argsort(-whole, axis=1, kind="stable")
    chosen = np.zeros((len(there), languages))
    chosen[np.arange(len(there)), np.argmax(np.add.reduceat(like, first, axis=0), axis=1)] = 1
    chosen, chosen_like = _mixture(like, first, owner, chosen)
    going = np.arange(len(there))
    for k in range(2, languages + 1):
        going = going[whole[going, rank[going, k - 1]] * cuts[going] >= 0.5]
        if not len(going):
            break
        spot = np.full(len(there), -1)
        spot[going] = np.arange(len(going))
        rows = np.flatnonzero(spot[owner] >= 0)
        allowed = np.zeros((len(going), languages))
        np.put_along_axis(allowed, rank[going, :k], 1.0, axis=1)
        own_first = np.concatenate([[0], np.cumsum(cuts[going])[:-1]])
        share, value = _mixture(like[rows], own_first, spot[owner[rows]], allowed)
        value = value - (k - 1) * (penalty + 0.5 * np.log(cuts[going]))
        better = value > chosen_like[going]
        chosen[going[better]], chosen_like[going[better]] = share[better], value[better]
    best[there] = np.argmax(chosen, axis=1)
    score[there] = chosen.max(axis=1)
    shares[there] = chosen
    return best, np.clip(score, 0.0, 1.0), shares


def identify(docs: DataFrame, langs: list[str], model: np.ndarray) -> DataFrame:
    """doc_id, lang_pred, score and languages (those chosen, with their shares) of every document."""
    held = docs.sparkSession.sparkContext.broadcast((langs, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = held.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in _rows(texts):
                best, score, shares = predict(texts[a:b], table)
                found = [
                    [{"lang": names[j], "share": float(s[j])} for j in np.flatnonzero(s > 0.005)] for s in shares
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        pa.array([names[i] if i >= 0 else "und" for i in best], pa.string()),
                        pa.array(score),
                        pa.array(found, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))),
                    ],
                    names=["doc_id", "lang_pred", "score", "languages"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, lang_pred string, score double, languages array<struct<lang:string,share:double>>"
    )


def op3_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = F.coalesce(bucket_of(F.col("doc_id"), HELD_OUT) == 2, F.lit(False))
    return identify(docs, *learn_languages(docs)).select("doc_id", held.alias("held_out"), "lang_pred", "score", "languages")
