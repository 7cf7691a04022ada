"""Toxicity scoring with a weighted lexicon matched by Aho-Corasick."""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .samples import share_of, with_labels
from .scratch import Scratch, only
from .textbytes import shingle_sets, string_bytes

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = str.maketrans(
    "аеорсухікмтнвзԁѕјԛԝɡαβεικνορτυχγωı",
    "aeopcyxikmthbzdsjqwgabeiknoptuxywi",
)
#: Digits and signs written for letters. i, l and their stand-ins fold to one letter.
SUBSTITUTES = str.maketrans("013457896@$!|l", "oieastbggasiii")

_OTHER = re.compile("[ɐ-ɰıͰ-ϿЀ-ԯ]")
_WRITTEN = re.compile(r"[0134578@$!|]+(?=[^\W\d_])")
_APART = re.compile(r"[\W\d_]+")


def fold(text: str) -> str:
    """Lower-cased words between single spaces, one at each end.

    Compatibility forms, look-alike letters of other scripts, and digits or
    signs that stand before a letter become the letter meant; l counts as i.
    Accented letters stay: they tell words of a language apart.
    """
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        if _OTHER.search(text):
            text = text.translate(HOMOGLYPHS)
    if _WRITTEN.search(text):
        text = _WRITTEN.sub(lambda m: m[0].translate(SUBSTITUTES), text)
    return f" {_APART.sub(' ', text.replace('l', 'i')).strip()} "


@dataclass
class Lexicon:
    """Terms with weights, exception phrases and the calibration of the score.

    A term or phrase holds its boundaries: " word " is a whole word; " word" is
    a word's beginning, with at least one more letter after it.
    """

    terms: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    bias: float = -4.0
    slope: float = 4.0

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for term, weight in self.terms.items():
            found.add_word(term, (len(term), weight, term))
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), None, phrase))
        if len(found):
            found.make_automaton()
        return found


def matches(automaton: ahocorasick.Automaton, folded: str) -> list[tuple[int, int, float, str]]:
    """Matched terms as (start, end, weight, term), but for those inside an exception phrase.

    Hits come in the order of their ends, so whether one lies in an exception
    is one binary search; the time grows with the text, however many hits it has.
    """
    if not len(automaton):
        return []
    hits = [
        (end + 1 - n, end + 1, weight, term)
        for end, (n, weight, term) in automaton.iter(folded)
        if term[-1] == " " or folded[end + 1] != " "
    ]
    ends, starts = [], []  # exceptions by their end; for each, the least start of it and of all that end later
    for a, b, weight, _ in hits:
        if weight is None:
            ends.append(b)
            starts.append(a)
    for k in range(len(starts) - 2, -1, -1):
        starts[k] = min(starts[k], starts[k + 1])

    def spared(start: int, end: int) -> bool:
        k = bisect_left(ends, end - 1)
        return k < len(ends) and starts[k] <= start + 1

    return [h for h in hits if h[2] is not None and not (ends and spared(h[0], h[1]))]


def evidence(automaton: ahocorasick.Automaton, folded: str) -> float:
    """Summed weights over the logarithm of the text's length in words."""
    return sum(h[2] for h in matches(automaton, folded)) / math.log2(2 + folded.count(" "))


def score_toxicity(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text: doc_id, score (0 to 1), predicted (score >= 0.5), hits (matched terms).

    Null and empty texts have no hit and get the score of a text without hits.
    A very long text is folded and matched whole, in time that grows with it.
    Each row is scored by itself, so ties, repeated rows and null ids keep
    their rows; an empty table gives no rows; extra columns are ignored.
    """
    told = docs.sparkSession.sparkContext.broadcast(lexicon)  # at most `max_terms` terms

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = told.value
        automaton = use.automaton()
        for batch in batches:
            values, hits = [], []
            for text in batch.column(1):
                folded = fold(text.as_py() or "")
                found = matches(automaton, folded)
                amount = sum(h[2] for h in found) / math.log2(2 + folded.count(" "))
                values.append(1 / (1 + math.exp(-max(-60.0, min(60.0, use.bias + use.slope * amount)))))
                hits.append(len(found))
            values = np.array(values, float)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(values),
                    pa.array((values >= 0.5).astype(np.int32)),
                    pa.array(hits, pa.int32()),
                ],
                ["doc_id", "score", "predicted", "hits"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return only(docs, doc_id=id_col, text=text_col).mapInArrow(
        score, f"doc_id {kind}, score double, predicted int, hits int"
    )


def reject_toxic(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of `docs`, unchanged, whose whole text scores below `limit`.

    Null and empty texts stay. Each row is judged by itself: repeated rows and
    null ids stay or go by their text, a very long text is matched whole. An
    empty table gives no rows; other columns are not looked at.
    """
    told = docs.sparkSession.sparkContext.broadcast(lexicon)  # at most `max_terms` terms
    place = docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = told.value
        automaton = use.automaton()
        # the score grows with the evidence, so the limit is one on the evidence
        most = (math.log(limit / (1 - limit)) - use.bias) / use.slope if use.slope > 0 else math.inf
        for batch in batches:
            keep = [evidence(automaton, fold(text.as_py() or "")) < most for text in batch.column(place)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)


def learn_lexicon(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample_rows: int = 5_000,
    max_terms: int = 2_000,
    min_support: int = 4,
    exceptions: tuple[str, ...] = (),
    scratch: Scratch | None = None,
) -> Lexicon:
    """Learn terms, weights, exceptions and calibration from labelled rows.

    Fitted on a bounded sample: about `sample_rows` labelled rows of either
    label, chosen by a hash of their id (and text). Near copies in it (equal least
    shingle) count once. Candidates are whole words and word beginnings of 3 to
    7 letters; of them, those are taken in turn that cover most toxic texts not
    yet covered and hardly any other. Without toxic or without other rows the
    lexicon is empty and every text scores low. Rows with null label, id or
    text are not learned from; of several labels of one id the largest holds.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    exceptions = tuple(fold(phrase) for phrase in exceptions)
    told = (
        only(labels, id=id_col, label=label_col)
        .where("id IS NOT NULL AND label IS NOT NULL")
        .groupBy("id")
        .agg(F.max("label").cast("int").alias("label"))
    )
    rows = {r["label"]: r["n"] for r in told.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not rows.get(0) or not rows.get(1):
        return Lexicon(exceptions=exceptions)
    rate = F.when(F.col("label") == 1, min(1.0, sample_rows / rows[1])).otherwise(min(1.0, sample_rows / rows[0]))
    chosen = told.where(share_of("id") < rate)
    sample = (
        with_labels(only(docs, id=id_col, text=text_col).where("text IS NOT NULL"), chosen, 4 * sample_rows)
        .mapInArrow(_folder, "label int, folded string, least long")
        .dropDuplicates(["label", "least"])
        .select("label", "folded")
    )
    sample = scratch.keep(sample.repartition(4 * spark.sparkContext.defaultParallelism))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        positive: dict[str, int] = {}
        negative: dict[str, int] = {}
        for batch in batches:
            for label, folded in zip(batch["label"], batch["folded"], strict=True):
                into = positive if label else negative
                for term in _candidates(folded):
                    into[term] = into.get(term, 0) + 1
        for into, label in ((positive, 1), (negative, 0)):
            if into:
                yield pd.DataFrame({"term": list(into), "label": label, "n": list(into.values())})

    n_of = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = n_of.get(1, 0), n_of.get(0, 0)
    if not n_pos or not n_neg:
        return Lexicon(exceptions=exceptions)
    counted = (
        sample.mapInPandas(count, "term string, label int, n long")
        .groupBy("term")
        .agg(F.sum(F.col("n") * F.col("label")).alias("pos"), F.sum(F.col("n") * (1 - F.col("label"))).alias("neg"))
        .where(F.col("pos") >= min_support)
        .withColumn("weight", F.log((F.col("pos") + 0.5) / (n_pos + 1)) - F.log((F.col("neg") + 0.5) / (n_neg + 1)))
        .where("weight > 2")
        .orderBy(F.desc(F.col("pos") * F.col("weight")), "term")
        .limit(max_terms)
        .collect()
    )
    weights = {r["term"]: r["weight"] for r in counted}
    if not weights:
        return Lexicon(exceptions=exceptions)
    picked = _cover(sample, weights, min_support)
    lexicon = Lexicon({t: weights[t] for t in picked}, exceptions)

    # words that hold a term in other texts but in no toxic one are exceptions, and so are often seen pairs of words
    def hit_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = lexicon.automaton()
        for batch in batches:
            out = []
            for label, folded in zip(batch["label"], batch["folded"], strict=True):
                for start, end, _, _ in matches(automaton, folded):
                    first, stop = folded.rindex(" ", 0, start + 1), folded.index(" ", end - 1)
                    out.append((label, folded[first : stop + 1], False))
                    if first:
                        out.append((label, folded[folded.rindex(" ", 0, first) : stop + 1], True))
                    if stop + 1 < len(folded):
                        out.append((label, folded[first : folded.index(" ", stop + 1) + 1], True))
            yield pd.DataFrame(out, columns=["label", "words", "is_phrase"])

    spare = (
        sample.mapInPandas(hit_words, "label int, words string, is_phrase boolean")
        .groupBy("words", "is_phrase")
        .agg(F.sum("label").alias("pos"), F.count("*").alias("n"))
        .where((F.col("pos") == 0) & (~F.col("is_phrase") | (F.col("n") >= 2 * min_support)))
        .orderBy(F.desc("n"), "words")
        .limit(max_terms)
        .collect()
    )
    lexicon.exceptions = (*exceptions, *(r["words"] for r in spare))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = lexicon.automaton()
        for batch in batches:
            yield pd.DataFrame({"y": batch["label"], "x": [evidence(automaton, t) for t in batch["folded"]]})

    seen = sample.mapInPandas(measure, "y int, x double").toPandas()  # two numbers a sampled row
    lexicon.bias, lexicon.slope = _calibrate(seen["x"].to_numpy(float), seen["y"].to_numpy(float))
    scratch.drop(sample)
    return lexicon


def _folder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        texts = batch.column(names.index("text"))
        data, offsets, _ = string_bytes(texts)
        hashes, at = shingle_sets(data, offsets)
        least = [int(hashes[a:b][0].view(np.int64)) if b > a else 0 for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(names.index("label")), pa.array([fold(t.as_py()) for t in texts]), pa.array(least, pa.int64())],
            ["label", "folded", "least"],
        )


def _candidates(folded: str) -> set[str]:
    words = set(folded.split())
    found = {f" {w} " for w in words if 2 <= len(w) <= 24}
    for n in range(3, 8):
        found.update(" " + w[:n] for w in words if len(w) > n)
    return found


def _cover(sample: DataFrame, weights: dict[str, float], min_support: int) -> list[str]:
    """Candidates in the order of a greedy cover of the toxic sample rows."""
    terms = sorted(weights)
    index = {t: i for i, t in enumerate(terms)}
    every = Lexicon(weights)

    def incidence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = every.automaton()
        for batch in batches:
            yield pd.DataFrame(
                {"ids": [sorted({index[h[3]] for h in matches(automaton, t)}) for t in batch["folded"]]}
            )

    rows = sample.where("label = 1").mapInPandas(incidence, "ids array<int>").collect()
    table = np.zeros((len(rows), len(terms)), bool)
    for k, row in enumerate(rows):
        table[k, row["ids"]] = True
    value = np.array([weights[t] for t in terms])
    length = np.array([len(t) for t in terms])
    open_rows = np.full(len(rows), 2)  # each row wants two terms
    picked: list[str] = []
    left = np.ones(len(terms), bool)
    while left.any() and (open_rows > 0).any():
        gain = np.where(left, (table[open_rows > 0]).sum(axis=0) * np.maximum(value - 2, 0), -1)
        best = np.flatnonzero(gain == gain.max())
        best = best[np.argmax(length[best])]
        if (table[open_rows > 0, best]).sum() < min_support:
            break
        picked.append(terms[best])
        open_rows[table[:, best]] -= 1
        left[best] = False
    return picked


def _calibrate(x: np.ndarray, y: np.ndarray, strength: float = 1.0) -> tuple[float, float]:
    """Bias and slope of a logistic curve with a slight pull to small values; classes weigh alike."""
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    design = np.stack([np.ones_like(x), x], axis=1)
    at = np.array([-1.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ at, -30, 30)))
        slope = design.T @ (weight * (p - y)) + strength * 0.01 * at
        bend = design.T @ (design * (weight * p * (1 - p))[:, None]) + strength * 0.01 * np.eye(2)
        step = np.linalg.solve(bend, slope)
        at = at - step
        if np.abs(step).max() < 1e-8:
            break
    return float(at[0]), float(at[1])
