"""Language identification: family first, then one-versus-one linear support vector machines within it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .samples import share_of
from .scratch import Scratch, only
from .textbytes import slices, string_bytes

#: Hashed n-gram counts of a text.
BUCKETS = 2048
#: Rows whose features are held at once.
SLICE_ROWS = 256
#: Families of common languages; any other language is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("cs", "sk", "pl", "ru", "uk", "bg", "hr", "sl"),
    "uralic": ("fi", "et", "hu"),
}

_FOLD = np.full(256, 32, np.uint64)  # all but letters is space
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def gram_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Unit vectors of square roots of hashed counts of byte 1-, 2- and 3-grams of letters, a row for each text."""
    rows, length = len(offsets) - 1, np.diff(offsets)
    owner = np.repeat(np.arange(rows, dtype=np.int64), length)
    b = _FOLD[data]
    out = np.zeros(rows * BUCKETS)
    with np.errstate(over="ignore"):
        gram = b.copy()
        for n in (1, 2, 3):
            if n > 1:
                gram = gram[:-1] * np.uint64(0x100000001B3) + b[n - 1 :]
            if not len(gram):
                break
            inside = owner[: len(gram)] == owner[n - 1 :]
            place = ((gram * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)) >> np.uint64(53)).astype(np.int64)
            key = owner[: len(gram)] * BUCKETS + place
            out += np.bincount(key[inside], minlength=len(out))
    out = np.sqrt(out.reshape(rows, BUCKETS))
    return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-12)


def _lettered(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter, of any script."""
    seen = np.concatenate([[0], np.cumsum(_FOLD[data] != 32)])
    out = seen[offsets[1:]] > seen[offsets[:-1]]
    for k in np.flatnonzero(out):
        raw = data[offsets[k] : offsets[k + 1]]
        if raw.max() > 127 and not ((raw >= 97) & (raw < 123) | (raw >= 65) & (raw < 91)).any():
            out[k] = any(c.isalpha() for c in raw.tobytes().decode())
    return out


def linear_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 200, stop: float = 1e-3) -> np.ndarray:
    """Weights and bias (last) of a linear SVM of squared hinge loss; y is 1 or -1, both sides weigh alike.

    At most `rounds` accelerated gradient steps, fewer once a step moves the
    weights by less than `stop` of their length.
    """
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    w, before, t = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 1.0
    step = 1 / (1 + 2 * cost * 2.0)  # rows have a squared norm of 2 at most
    at = w
    for _ in range(rounds):
        gap = np.maximum(0, 1 - y * (x @ at.astype(x.dtype)))
        slope = at / len(at) * 0.01 - 2 * cost * ((weight * y * gap).astype(x.dtype) @ x)
        before, w = w, at - step * slope
        if np.linalg.norm(w - before) < stop * np.linalg.norm(w):
            break
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        at = w + (last - 1) / t * (w - before)
    return w


@dataclass
class LanguageModel:
    """Families with one machine each (one in all for two), and a machine for each pair of languages of a family."""

    families: list[tuple[str, ...]] = field(default_factory=list)
    family_weights: np.ndarray = field(default_factory=lambda: np.zeros((0, BUCKETS + 1)))
    pairs: list[list[tuple[int, int]]] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language and confidence (0.5 to 1) of each row of features."""
        family, sure = _widest(x, self.family_weights, len(self.families))
        name = np.empty(len(x), object)
        for f, members in enumerate(self.families):
            rows = np.flatnonzero(family == f)
            if len(rows):
                one, inner = _vote(x[rows], self.pairs[f], self.weights[f], len(members))
                name[rows] = np.array(members, object)[one]
                sure[rows] = np.minimum(sure[rows], inner)
        return name, sure


def _widest(x: np.ndarray, weights: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The family of the largest margin, and the logistic of its lead over the next (of half of it, for a lead of two)."""
    if n == 1:
        return np.zeros(len(x), np.int64), np.ones(len(x))
    margin = x @ weights[:, :-1].T + weights[:, -1]
    if n == 2:
        margin = np.hstack([margin, -margin])
    best = np.argmax(margin, axis=1)
    top = np.sort(margin, axis=1)
    return best, 1 / (1 + np.exp(-2 * np.clip(top[:, -1] - top[:, -2], 0, 20)))


def _vote(x: np.ndarray, pairs: list[tuple[int, int]], weights: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The class that wins most pairs, ties by the sum of margins, and the logistic of its smallest margin."""
    votes, total, least = np.zeros((len(x), n)), np.zeros((len(x), n)), np.full((len(x), n), np.inf)
    margin = x @ weights[:, :-1].T + weights[:, -1] if len(pairs) else np.zeros((len(x), 0))
    for k, (a, b) in enumerate(pairs):
        m = margin[:, k]
        votes[:, a] += m >= 0
        votes[:, b] += m < 0
        total[:, a] += m
        total[:, b] -= m
        least[:, a] = np.minimum(least[:, a], m)
        least[:, b] = np.minimum(least[:, b], -m)
    best = np.argmax(votes + 1e-3 * np.tanh(total), axis=1)
    m = least[np.arange(len(x)), best]
    return best, 1 / (1 + np.exp(-4 * np.clip(m, 0, 10)))


def group_families(names: list[str], families: dict[str, tuple[str, ...]] = FAMILIES) -> list[tuple[str, ...]]:
    """The languages of `names` by family, each family and all families in order."""
    of = {name: next((f for f, members in families.items() if name in members), name) for name in sorted(names)}
    return [tuple(n for n in of if of[n] == f) for f in sorted(set(of.values()))]


def machines(families: list[tuple[str, ...]]) -> list[tuple[tuple[str, ...], tuple[str, ...]]]:
    """Languages on either side of each machine: families first, then the pairs within each family.

    Two families need one machine; of more, each has one against all others.
    Within a family every two languages have one.
    """
    every = [n for members in families for n in members]
    out = []
    if len(families) > 1:
        for members in families[: 1 if len(families) == 2 else None]:
            out.append((members, tuple(n for n in every if n not in members)))
    for members in families:
        out += [((a,), (b,)) for a, b in combinations(members, 2)]
    return out


def assemble(families: list[tuple[str, ...]], weights: list[np.ndarray]) -> LanguageModel:
    """A model of the weights of `machines`, in their order."""
    first = 0 if len(families) < 2 else 1 if len(families) == 2 else len(families)
    model = LanguageModel(families, np.array(weights[:first]).reshape(first, BUCKETS + 1))
    at = first
    for members in families:
        pairs = list(combinations(range(len(members)), 2))
        model.pairs.append(pairs)
        model.weights.append(np.array(weights[at : at + len(pairs)]).reshape(len(pairs), BUCKETS + 1))
        at += len(pairs)
    return model


def fit_languages(x: np.ndarray, lang: np.ndarray, families: dict[str, tuple[str, ...]] = FAMILIES) -> LanguageModel:
    """Fit all machines here, for data that fits here."""
    groups = group_families(list(set(lang)), families)
    weights = []
    for left, right in machines(groups):
        rows = np.isin(lang, left + right)
        weights.append(linear_svm(x[rows], np.where(np.isin(lang[rows], left), 1.0, -1.0)))
    return assemble(groups, weights)


def learn_languages(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    rows_per_language: int = 1_500,
    side_rows: int = 3_000,
    families: dict[str, tuple[str, ...]] = FAMILIES,
    scratch: Scratch | None = None,
) -> LanguageModel:
    """Learn every language from a bounded sample, each machine in a task of its own.

    The sample has about `rows_per_language` rows of each language, chosen by a
    hash of id and text; texts equal in all features count once. It is written
    as a table of feature rows. A machine is fitted on at most about
    `side_rows` rows of either side, so its task stays small however many
    languages there are, and only weights come to the driver: one row of
    BUCKETS numbers for each family and each pair within one.

    Rows with null id, text or language are not learned from. A very long text
    is measured whole. No labelled row: every text is `und`.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    told = only(docs, id=id_col, text=text_col, lang=lang_col).where(
        "id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL"
    )
    counts = {r["lang"]: r["n"] for r in told.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not counts:
        return LanguageModel()
    rates = spark.createDataFrame([(k, min(1.0, rows_per_language / n)) for k, n in counts.items()], "lang string, rate double")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets, _ = string_bytes(batch.column(1))
            for a, b in slices(offsets, 1 << 18, SLICE_ROWS):
                x = gram_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]).astype("<f2")
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "x"]
                )

    chosen = told.join(F.broadcast(rates), "lang").where(share_of("id", "text") < F.col("rate"))  # a row a language
    sample = scratch.keep(chosen.select("lang", "text").mapInArrow(measure, "lang string, x binary").dropDuplicates())

    sampled = {r["lang"]: r["n"] for r in sample.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    groups = group_families(list(counts), families)
    wanted = machines(groups)
    seats = []
    for k, sides in enumerate(wanted):
        for side, members in zip((1.0, -1.0), sides, strict=True):
            rate = min(1.0, side_rows / max(sum(sampled.get(n, 0) for n in members), 1))
            seats += [(n, k, side, rate) for n in members]
    weights = {k: np.zeros(BUCKETS + 1) for k in range(len(wanted))}
    if seats:
        table = spark.createDataFrame(seats, "lang string, machine int, side double, rate double")

        def fit(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["side", "x"])  # the same sums on every run
            x = np.frombuffer(b"".join(rows["x"]), "<f2").reshape(len(rows), BUCKETS).astype("f4")
            w = linear_svm(x, rows["side"].to_numpy())
            return pd.DataFrame({"machine": rows["machine"].iloc[:1], "w": [w.tobytes()]})

        dealt = sample.join(table, "lang").where(share_of("x", "machine") < F.col("rate"))
        for r in dealt.select("machine", "side", "x").groupBy("machine").applyInPandas(fit, "machine int, w binary").collect():
            weights[r["machine"]] = np.frombuffer(r["w"])
    scratch.drop(sample)
    return assemble(groups, [weights[k] for k in range(len(wanted))])


def identify_languages(
    docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The language of every whole text: doc_id, lang_pred, score (confidence, 0 to 1).

    Null text and text without a letter: `und` with score 0, as everything is
    if the model has no language. A very long text is judged whole, by itself.
    Each row is judged alone, so ties, repeated rows and null ids keep their
    rows; an empty table gives no rows; extra columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # a row of BUCKETS numbers for each machine

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = held.value
        for batch in batches:
            data, offsets, valid = string_bytes(batch.column(1))
            for a, b in slices(offsets, 1 << 18, SLICE_ROWS):
                name, score = np.full(b - a, "und", object), np.zeros(b - a)
                own, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                rows = np.flatnonzero(_lettered(own, at) & valid[a:b])
                if use.families and len(rows):
                    x = gram_features(own, at)
                    name[rows], score[rows] = use.predict(x[rows])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array(name, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"]
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return only(docs, doc_id=id_col, text=text_col).mapInArrow(judge, f"doc_id {kind}, lang_pred string, score double")
