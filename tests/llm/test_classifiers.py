from __future__ import annotations

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelume.llm import queries
from sitelume.llm.language import LanguageModel, fit_languages, identify_languages, learn_languages
from sitelume.llm.quality import QualityModel, fit_pairs, learn_quality, score_quality
from sitelume.llm.toxicity import Lexicon, fold, learn_lexicon, matches, reject_toxic, score_toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def larger(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def held(column="doc_id", modulus=5, rest=0):
    return F.crc32(F.col(column).cast("string")) % modulus == rest


def test_fold():
    assert fold("You 1d10t! м0r0n L0ser,  idiot!! Réeux $tupid") == " you idiot moron ioser idiot réeux stupid "
    assert fold("") == "  "
    assert fold("ｉｄｉｏｔ") == " idiot "
    assert fold("the&&& 12 $$$") == " the "


def test_terms_boundaries_and_exceptions():
    lexicon = Lexicon({" ioser ": 2.0, " vequ": 3.0}, (" vequit ",))
    found = lambda text: [h[3] for h in matches(lexicon.automaton(), fold(text))]
    assert found("loser") == [" ioser "]
    assert found("losers closer") == []
    assert found("loser loser") == [" ioser ", " ioser "]
    assert found("vequ vequa vequit") == [" vequ"]
    assert matches(Lexicon().automaton(), " x ") == []


def test_toxicity_held_out(spark):
    """On rows that nothing was learned from: what is missed has no term of the lexicon at all."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    lexicon = learn_lexicon(docs, labels.where(~held()))
    told = score_toxicity(docs, lexicon).join(labels, "doc_id").where(held())
    found, toxic, right, bare = told.agg(
        F.count_if(F.col("predicted") == 1), F.count_if(F.col("toxic") == 1),
        F.count_if((F.col("predicted") == 1) & (F.col("toxic") == 1)), F.count_if((F.col("predicted") == 0) & (F.col("toxic") == 1) & (F.col("hits") == 0)),
    ).first()
    assert toxic > 80 and right >= 0.8 * toxic and right >= 0.95 * found
    assert toxic - right - bare <= 2


def test_obfuscated_words_are_found(spark, larger):
    docs, labels = larger
    lexicon = learn_lexicon(docs, labels)
    rows = [(1, "what an 1d10t and a l0ser you are"), (2, "what a calm and friendly text"), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in score_toxicity(df, lexicon).collect()}
    assert got == {1: 1, 2: 0, 3: 0, 4: 0}
    assert sorted(r.doc_id for r in reject_toxic(df, lexicon).collect()) == [2, 3, 4]


def test_toxicity_of_odd_rows(odd, empty, labels):
    assert score_toxicity(odd, Lexicon({" one ": 3.0})).count() == odd.count()
    assert reject_toxic(odd, Lexicon()).schema == odd.schema
    assert score_toxicity(empty, Lexicon()).collect() == []
    assert learn_lexicon(empty, labels).terms == {}
    assert learn_lexicon(odd, labels.where("false")).terms == {}


def test_quality_held_out(larger):
    docs, labels = larger
    model = learn_quality(docs, labels.where(~held()))
    told = score_quality(docs, model).join(labels, "doc_id").where(held())
    rows = told.select("score", "predicted", "quality").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_pairs_order_scores():
    random = np.random.default_rng(0)
    x = random.standard_normal((400, 5))
    label = (x[:, 2] + 0.1 * random.standard_normal(400) > -1).astype(int)
    model = fit_pairs(x, label, pairs=5_000)
    score = model.raw(x)
    assert score[label == 1].mean() > score[label == 0].mean() + score.std()
    assert abs((model.score(x) < 0.3).mean() - (label == 0).mean()) < 0.01


def test_quality_of_odd_rows(odd, empty, labels):
    model = QualityModel()
    rows = score_quality(odd, model).collect()
    assert len(rows) == odd.count()
    assert all(0 <= r.score <= 1 for r in rows)
    assert score_quality(empty, model).collect() == []
    assert (learn_quality(empty, labels).weight == 0).all()
    assert (learn_quality(odd, labels.where("false")).weight == 0).all()


def test_language_held_out(larger):
    docs, _ = larger
    model = learn_languages(docs.where(~held(modulus=4, rest=2)))
    assert model.families == [("de", "en"), ("es", "fr")]
    told = identify_languages(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(held(modulus=4, rest=2))
    assert told.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.97


def test_languages_of_odd_rows(odd, empty, larger):
    model = learn_languages(larger[0])
    rows = {(r.doc_id, r.lang_pred) for r in identify_languages(odd, model).collect()}
    assert {(3, "und"), (4, "und"), (5, "und"), (8, "und"), (None, "und")} <= rows
    assert all(p in ("de", "en", "es", "fr") for d, p in rows if d in (1, 2, 6, 7, 9))
    assert identify_languages(empty, model).collect() == []
    assert {r.lang_pred for r in identify_languages(odd, learn_languages(empty)).collect()} == {"und"}


def test_many_languages_are_all_learned(spark):
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    rows, draw = [], random.Random(2)
    for n in range(60):  # each language has letters of its own
        letters = draw.sample(alphabet, 6)
        for k in range(30):
            text = " ".join("".join(draw.choices(letters, k=6)) for _ in range(40))
            rows.append((30 * n + k, text, f"l{n:02d}" if n > 3 else ("cs", "sk", "pl", "ru")[n]))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = learn_languages(df.where("doc_id % 5 <> 0"))
    assert sum(len(f) for f in model.families) == 60 and len(model.families) == 57
    told = identify_languages(df.where("doc_id % 5 = 0"), model).join(df.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in told]) > 0.9
    assert len({r.lang_pred for r in told}) > 50


def naive_matches(lexicon, folded):
    """Every term and phrase looked up at every place, each hit compared with each phrase."""
    found = []
    for term, weight in [*lexicon.terms.items(), *((p, None) for p in lexicon.exceptions)]:
        for at in range(len(folded) - len(term) + 1):
            end = at + len(term)
            if folded[at:end] == term and (term[-1] == " " or folded[end : end + 1] != " "):
                found.append((at, end, weight, term))
    spared = [(a, b) for a, b, w, _ in found if w is None]
    return sorted(h for h in found if h[2] is not None and not any(a <= h[0] + 1 and h[1] - 1 <= b for a, b in spared))


def test_matches_equal_a_naive_matcher():
    draw = random.Random(8)
    for _ in range(300):
        words = ["".join(draw.choices("ab", k=draw.randrange(1, 5))) for _ in range(draw.randrange(1, 25))]
        terms = {f" {draw.choice(words)} ": 1.0 for _ in range(3)} | {" " + draw.choice(words)[:2]: 2.0}
        phrases = tuple({f" {' '.join(words[k : k + draw.randrange(1, 4)])} " for k in draw.sample(range(len(words)), min(3, len(words)))})
        lexicon, folded = Lexicon({t: w for t, w in terms.items() if t not in phrases}, phrases), f" {' '.join(words)} "
        assert sorted(matches(lexicon.automaton(), folded)) == naive_matches(lexicon, folded)


def test_a_text_of_a_million_words_is_matched_in_seconds():
    lexicon = Lexicon({" bad ": 1.0, " ba": 1.0}, (" badge ", fold("bad luck")))
    text = "bad luck badge bad " * 250_000
    began = time.perf_counter()
    assert len(matches(lexicon.automaton(), fold(text))) == 500_000  # the last word of each four, by both terms
    assert time.perf_counter() - began < 10


def test_learned_queries_judge_held_out_rows(spark):
    """The registered queries, on rows whose labels they do not see."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for query, label, least in ((queries.op2_bradley_terry_quality, "quality", 0.93), (queries.op8_toxicity_lexicon, "toxic", 0.93)):
        told = query(spark, SF).where("held_out").join(labels, "doc_id").where(f"{label} IS NOT NULL")
        assert told.agg(F.avg((F.col("predicted") == F.col(label)).cast("int"))).first()[0] > least


def test_one_language():
    model = fit_languages(np.eye(3, 2048), np.array(["xx"] * 3, object))
    assert list(model.predict(np.eye(3, 2048))[0]) == ["xx"] * 3
    assert LanguageModel().families == []
