import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from tests.llm.helpers import AWKWARD, documents
from tracewell.llm import language

SYLLABLES = {"aa": ["ka", "lo", "mi"], "bb": ["strü", "grö", "ßen"], "cc": ["ción", "ñe", "que"]}


def word(pick, lang):
    return "".join(pick.choice(SYLLABLES[lang]) for _ in range(pick.randint(1, 4)))


def corpus(n=240):
    pick = random.Random(1)
    return [(i, " ".join(word(pick, lang) for _ in range(pick.randint(1, 60))), lang, "s") for i, lang in zip(range(n), itertools.cycle(SYLLABLES))]


def test_forward_backward_equals_enumeration():
    random_ = np.random.default_rng(0)
    sizes = np.array([3, 1, 4])
    scores = random_.normal(size=(8, 3))
    start, moves = random_.normal(size=3), random_.normal(size=(3, 3))
    marginal, pairs = language.forward_backward(scores, sizes, start, moves)
    want, want_pairs, at = np.zeros((8, 3)), np.zeros((3, 3)), 0
    for size in sizes:
        paths = list(itertools.product(range(3), repeat=int(size)))
        value = np.array([np.exp(start[p[0]] + sum(scores[at + t, p[t]] for t in range(size)) + sum(moves[p[t], p[t + 1]] for t in range(size - 1))) for p in paths])
        for p, v in zip(paths, value / value.sum()):
            for t in range(size):
                want[at + t, p[t]] += v
            for t in range(size - 1):
                want_pairs[p[t], p[t + 1]] += v
        at += size
    assert np.allclose(marginal, want) and np.allclose(pairs, want_pairs)


def test_features_do_not_depend_on_the_batch():
    words = ["a", "ab", "straße", "ñandú", "x" * 300]
    alone = [sorted(zip(*(x.tolist() for x in language.features([w])[1:]))) for w in words]
    owner, slot, weight = language.features(words)
    for i in range(len(words)):
        mine = owner == i
        assert sorted(zip(slot[mine].tolist(), weight[mine].tolist())) == alone[i]


def test_held_out_accuracy(spark):
    docs = documents(spark, corpus())
    rows = language.identify(docs).select("lang", "lang_pred", "lang_score", language.held_out(F.col("doc_id")).alias("held")).collect()
    held = [r for r in rows if r["held"]]
    assert len(held) > 30 and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95
    assert all(0 <= r["lang_score"] <= 1 for r in rows)


def test_code_switched_text_is_labelled_word_by_word():
    pick = random.Random(2)
    model = language.fit([(lang, text) for _, text, lang, _ in corpus()])
    labeller = language._Labeller(model)
    text = " ".join([word(pick, "aa") for _ in range(30)] + [word(pick, "bb") for _ in range(20)])
    best, score, sizes, switches = labeller.label([text, "", None, "123 !!"])
    assert model.languages[best[0]] == "aa" and 0.5 < score[0] < 0.7 and switches[0] == 1
    assert sizes.tolist() == [50, 0, 0, 0] and best.tolist()[1:] == [-1, -1, -1] and score.tolist()[1:] == [0, 0, 0]


def test_awkward_documents(spark):
    docs = documents(spark, AWKWARD + [r for r in corpus(60) if r[0] > 20])
    out = language.identify(docs.selectExpr("*", "'mine' lang_pred"))
    rows = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == docs.count() and out.columns[: len(docs.columns)] == docs.columns
    for doc_id in (1, 2, 3):
        assert rows[doc_id]["lang_pred"] == "und" and rows[doc_id]["lang_score"] == 0
    assert rows[8]["lang_pred"] != "und" and rows[7]["lang_words"] == 50_000


def test_labels_ids_and_sources_are_no_inputs(spark):
    docs = documents(spark, corpus(60))
    model = language.fit(language.training_rows(docs))
    pick = {"doc_id": "doc_id + 1000 doc_id", "lang": "'zz' lang", "source": "null source"}
    changed = docs.selectExpr(*[pick.get(c, c) for c in docs.columns])
    a = [(r["text"], r["lang_pred"], r["lang_score"]) for r in language.identify(docs, model).collect()]
    b = [(r["text"], r["lang_pred"], r["lang_score"]) for r in language.identify(changed, model).collect()]
    assert a == b


def test_held_out_rows_are_not_learned_from(spark):
    rows = [r for r in language.training_rows(documents(spark, corpus(60)))]
    docs = documents(spark, corpus(60))
    held = {r["text"] for r in docs.filter(language.held_out(docs["doc_id"])).collect()}
    assert rows and not held & {text for _, text in rows}


def test_nothing_to_learn_from_and_empty_table(spark):
    assert {r["lang_pred"] for r in language.identify(documents(spark, [(1, "abc"), (2, None)])).collect()} == {"und"}
    assert language.identify(documents(spark, [])).collect() == []
