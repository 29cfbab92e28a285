"""Language identification of mixed texts.

A word is a run of letters of one script. Its script leaves the languages that were seen in that script; each of these
scores the word by the log-likelihood of its letter trigrams and of the word itself; Viterbi over the words with a penalty
for every switch labels spans of one language. The document's language is the one with the most letters, its score their
share of all letters. Words in a script that no language was seen in belong to none.

Training counts features per language over a sample of labelled rows: all of them up to ``TRAIN_ROWS``, above that those
whose hashed key lies below the bound that leaves as many. Counts are summed on the executors; the model has a fixed number
of buckets per language.

Defined results: a null text, or one without letters of a language, is ``und`` with score 0 and no spans; rows without a label teach
nothing; a row without a key is held out; languages with equal letters rank by name; repeated rows get equal results; with
no labelled row at all every text is ``und``; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, gathered, session, sliced, text_or_empty
from .encoding import parts

#: Labelled rows that training uses at most (in expectation, by a hash of the key).
TRAIN_ROWS = 20_000
TRIGRAMS = WORDS = 1 << 15
#: Nats that a switch costs.
SWITCH = 12.0
#: Share of a language's letters from which on a script belongs to it.
SCRIPT_SHARE = 0.005
#: Characters whose features are held at once, and characters times languages whose words are.
PART = 500_000
GROUP = 64_000_000
#: Languages that a model may have: each has a fixed number of numbers, which go to the driver and to every worker.
LANGUAGES = 255
UND = "und"

# Blocks of Unicode by script.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "gurmukhi": [(0xA00, 0xA7F)],
    "gujarati": [(0xA80, 0xAFF)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "kannada": [(0xC80, 0xCFF)],
    "malayalam": [(0xD00, 0xD7F)],
    "sinhala": [(0xD80, 0xDFF)],
    "thai": [(0xE00, 0xE7F)],
    "lao": [(0xE80, 0xEFF)],
    "tibetan": [(0xF00, 0xFFF)],
    "myanmar": [(0x1000, 0x109F)],
    "georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "ethiopic": [(0x1200, 0x139F)],
    "khmer": [(0x1780, 0x17FF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9D)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: the lower-case letter (0: not a letter), the script (0: another)."""
    lower, script = np.zeros(0x110000, np.uint32), np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            lower[c] = ord(low) if len(low) == 1 else c
    for k, ranges in enumerate(SCRIPTS.values(), 1):
        for a, b in ranges:
            script[a : b + 1] = k
    return lower, script


@dataclass
class Words:
    """Words of some texts: first code point and letters of each, its script, and the texts' bounds among the words."""

    at: np.ndarray
    letters: np.ndarray
    script: np.ndarray
    bounds: np.ndarray
    low: np.ndarray  # lower-case letters, joined
    first: np.ndarray  # of each word among them


def words_of(texts: list[str]) -> Words:
    lower, script = _tables()
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "replace"), "<u4")
    low, kind = lower[points], script[points]
    is_letter = low > 0
    new = is_letter.copy()
    new[1:] &= ~(is_letter[:-1] & (kind[1:] == kind[:-1]))
    at = np.flatnonzero(new)
    own = low[is_letter]
    first = (np.cumsum(is_letter) - 1)[at]
    text_at = np.concatenate([[0], np.cumsum(sizes)])
    bounds = np.searchsorted(at, text_at)
    start = text_at[np.searchsorted(text_at, at, side="right") - 1]
    return Words(at - start, np.diff(np.append(first, len(own))), kind[at], bounds, own, first)


def slices(texts: list[str], size: int = PART) -> Iterator[tuple[int, int, str]]:
    """(text, first character, part): texts in parts of about size characters, cut where no word is."""
    for i, t in enumerate(texts):
        at = 0
        while len(t) - at > size:
            end = at + size
            while end < len(t) and t[end].isalpha():
                end += 1
            yield i, at, t[at:end]
            at = end
        yield i, at, t[at:] if at else t


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ x >> np.uint64(29)


_POWERS = np.cumprod(np.full(64, 0x100000001B3, np.uint64))


def feature_ids(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The trigram bucket at each letter (its neighbours in the word, 0 outside), the bucket of each word."""
    c, n = w.low.astype(np.uint64), len(w.low)
    before, after = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    before[1:], after[:-1] = c[:-1], c[1:]
    before[w.first] = 0
    after[w.first[1:] - 1] = 0
    tri = _mixed(before << np.uint64(42) | c << np.uint64(21) | after) & np.uint64(TRIGRAMS - 1)
    place = np.arange(n) - np.repeat(w.first, w.letters)
    word = np.add.reduceat(c * _POWERS[np.minimum(place, 63)], w.first) if n else np.empty(0, np.uint64)
    return tri.astype(np.int64), (_mixed(word) & np.uint64(WORDS - 1)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """Log-likelihoods: [bucket, language], trigrams first; allowed: [script, language]."""

    languages: tuple[str, ...]
    table: np.ndarray
    allowed: np.ndarray


_NEVER = np.float32(-1e9)


def word_scores(texts: list[str], model: Model) -> tuple[Words, np.ndarray]:
    """The words of texts and the score of each in each language; features are made for one part of the texts at a time."""
    size = max(1, PART * 8 // max(8, len(model.languages)))
    cut = list(slices(texts, size))
    at, letters, script, scores, per = [], [], [], [], np.zeros(len(texts), np.int64)
    for a, z in parts([len(t) for _, _, t in cut], size):
        w = words_of([t for _, _, t in cut[a:z]])
        n = np.diff(w.bounds)
        np.add.at(per, [i for i, _, _ in cut[a:z]], n)
        at.append(w.at + np.repeat([start for _, start, _ in cut[a:z]], n))
        letters.append(w.letters)
        script.append(w.script)
        scores.append(_scored(w, model))
    none = np.empty(0, np.int64)
    words = Words(np.concatenate([none, *at]), np.concatenate([none, *letters]), np.concatenate([none.astype(np.uint8), *script]), np.concatenate([[0], np.cumsum(per)]), none, none)
    return words, np.concatenate([np.zeros((0, len(model.languages)), np.float32), *scores])


def _scored(w: Words, model: Model) -> np.ndarray:
    if not len(w.at):
        return np.zeros((0, len(model.languages)), np.float32)
    tri, word = feature_ids(w)
    out = np.add.reduceat(model.table[tri], w.first, axis=0) + model.table[TRIGRAMS + word]
    fits = model.allowed[w.script]
    out[~fits & fits.any(axis=1, keepdims=True)] = _NEVER
    out[~fits.any(axis=1)] = 0
    return out


def viterbi(scores: np.ndarray, bounds: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """The best language of each word; texts advance together, the longest first, so a step is one pass over those left."""
    size = np.diff(bounds)
    order = np.argsort(-size, kind="stable")
    start, size = bounds[:-1][order], size[order]
    labels = np.zeros(len(scores), np.uint8)
    if not len(scores):
        return labels
    left = np.searchsorted(-size, -np.arange(size[0]), side="left")  # texts longer than t
    stayed, came = np.ones(scores.shape, bool), np.zeros(len(scores), np.uint8)
    best = scores[start[: left[0]]].copy()
    for t in range(1, size[0]):
        n = left[t]
        at, old = start[:n] + t, best[:n]
        top = old.argmax(axis=1)
        old = old - old[np.arange(n), top][:, None]  # relative to the best, so that long texts lose no precision
        stay = old >= -np.float32(penalty)
        best[:n] = np.where(stay, old, -np.float32(penalty)) + scores[at]
        stayed[at], came[at] = stay, top
    now = best.argmax(axis=1).astype(np.uint8)
    for t in range(size[0] - 1, 0, -1):
        n = left[t]
        at = start[:n] + t
        labels[at] = now[:n]
        now[:n] = np.where(stayed[at, now[:n]], now[:n], came[at])
    labels[start[: left[0]]] = now[: left[0]]
    return labels


def identify(texts: list[str], model: Model) -> tuple[list[str], list[float], list[list[dict]]]:
    """Language, score and spans of each text."""
    if not model.languages:
        return [UND] * len(texts), [0.0] * len(texts), [[] for _ in texts]
    out: tuple[list, list, list] = ([], [], [])
    for a, z in parts([len(t) * len(model.languages) for t in texts], GROUP):
        for column, got in zip(out, _identified(texts[a:z], model), strict=True):
            column.extend(got)
    return out


def _identified(texts: list[str], model: Model) -> tuple[list[str], list[float], list[list[dict]]]:
    w, scores = word_scores(texts, model)
    n, k = len(texts), len(model.languages)
    labels = viterbi(scores, w.bounds)
    none = ~model.allowed[w.script].any(axis=1)
    text_of = np.repeat(np.arange(n), np.diff(w.bounds))
    letters = np.bincount(text_of * k + labels, weights=np.where(none, 0, w.letters), minlength=n * k).reshape(n, k)
    total, top = np.bincount(text_of, weights=w.letters, minlength=n), letters.argmax(axis=1)
    share = letters[np.arange(n), top] / np.maximum(total, 1)
    marks = np.where(none, -1, labels.astype(np.int16))
    turn = np.flatnonzero((np.diff(marks) != 0) | (np.diff(text_of) != 0)) + 1 if len(labels) else np.empty(0, np.int64)
    first = np.concatenate([[0], turn]).astype(np.int64) if len(labels) else turn
    last = np.append(first[1:], len(labels)) - 1 if len(labels) else first
    spans: list[list[dict]] = [[] for _ in texts]
    for a, z in zip(first.tolist(), last.tolist(), strict=True):
        if marks[a] >= 0:
            spans[text_of[a]].append({"lang": model.languages[labels[a]], "start": int(w.at[a]), "end": int(w.at[z] + w.letters[z])})
    return [model.languages[i] if s else UND for i, s in zip(top.tolist(), total.tolist(), strict=True)], share.tolist(), spans


def train(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = TRAIN_ROWS) -> Model:
    """Learns from the rows of df that have a label."""
    session(df.sparkSession)
    labelled = df.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), text_or_empty(text).alias("t"), F.xxhash64(F.col(key).cast("string"), text_or_empty(text)).alias("h"))
    n, langs = labelled.agg(F.count(F.lit(1)), F.count_distinct("lang")).first()
    if langs > LANGUAGES:
        raise ValueError(f"{langs} languages; a model has {LANGUAGES} at most")
    if n > rows:
        labelled = labelled.where(F.pmod("h", F.lit(1 << 30)) < int(rows / n * (1 << 30)))
    labelled = labelled.groupBy("lang", "h").agg(F.first("t").alias("t"))  # a row that repeats counts once, and can't fill the sample
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])
    size = TRIGRAMS + WORDS + len(SCRIPTS) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in gathered(batches):
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for x in sorted(set(langs)):
                cut = [t for _, _, t in slices([t for t, y in zip(texts, langs, strict=True) if y == x])]
                for w in (words_of(cut[a:z]) for a, z in parts([len(t) for t in cut], PART)):
                    if not len(w.at):
                        continue
                    tri, word = feature_ids(w)
                    got = np.bincount(tri, minlength=size) + np.bincount(TRIGRAMS + word, minlength=size) + np.bincount(TRIGRAMS + WORDS + w.script.astype(np.int64), weights=w.letters, minlength=size).astype(np.int64)
                    sums[x] = sums.get(x, 0) + got
        for x, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(s[at], pa.int64())], schema=schema)

    found = labelled.select("lang", "t").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = found.toArrow()  # buckets times languages at most
    langs = sorted(set(got.column("lang").to_pylist()))
    counts = np.zeros((size, len(langs)))
    if langs:
        counts[np.asarray(got.column("bucket")), np.searchsorted(np.array(langs), np.asarray(got.column("lang").to_pylist()))] = np.asarray(got.column("n"))
    features, by_script = counts[: TRIGRAMS + WORDS], counts[TRIGRAMS + WORDS :]
    tables = []
    for block in (features[:TRIGRAMS], features[TRIGRAMS:]):
        tables.append(np.log((block + 0.1) / (block.sum(axis=0, keepdims=True) + 0.1 * len(block))))
    return Model(tuple(langs), np.concatenate(tables).astype(np.float32), by_script >= SCRIPT_SHARE * np.maximum(by_script.sum(axis=0, keepdims=True), 1))


def predict(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """key, lang_pred, score, spans (language, first and last code point) and the columns of keep."""
    spark = session(df.sparkSession)
    sent, keep = spark.sparkContext.broadcast(model), keep or []
    schema = pa.schema([("lang_pred", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))])
    rest = [key, *(c for c in keep if c not in (key, text))]
    first = [text] * (text in keep)  # the text travels once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches):
            langs, shares, spans = identify([t or "" for t in b.column(0).to_pylist()], sent.value)
            made = [pa.array(x, f.type) for x, f in zip((langs, shares, spans), schema, strict=True)]
            yield from sliced(pa.RecordBatch.from_arrays([*b.columns[1 - len(first) :], *made], names=[*first, *rest, *schema.names]))

    source = df.select(F.col(text).cast("string").alias(text), *rest)
    ddl = ", ".join(f"`{c}` {t}" for c, t in source.dtypes[1 - len(first) :]) + ", lang_pred string, score double, spans array<struct<lang:string,start:long,end:long>>"
    return source.mapInArrow(run, ddl).select(key, *keep, *schema.names)


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5, F.lit(0)) == 0


def op5_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir, "doc_id", "text", "lang").withColumn("held_out", held_out())
    model = train(rows.where(~F.col("held_out")))
    return predict(rows, model, keep=["held_out"]).select("doc_id", "held_out", "lang_pred", "score", F.size("spans").alias("n_spans"))
