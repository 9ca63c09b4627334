import math
import os
import random
import re
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pytest

from foliant.llm import toxicity as tox
from foliant.llm.text import words as hash_words

FOLDER = "/root/testdata/sf0.1"


def test_slopes_are_those_of_the_risk():
    rng = np.random.default_rng(0)
    sp, su, prior, h = rng.normal(size=7), rng.normal(size=9), 0.2, 1e-6
    by_p, by_u, risk = tox.risk_slopes(sp, su, prior)
    for k in range(7):
        moved = sp.copy()
        moved[k] += h
        assert (tox.risk_slopes(moved, su, prior)[2] - risk) / h == pytest.approx(by_p[k], abs=1e-5)
    for k in range(9):
        moved = su.copy()
        moved[k] += h
        assert (tox.risk_slopes(sp, moved, prior)[2] - risk) / h == pytest.approx(by_u[k], abs=1e-5)


def test_an_overfit_negative_part_is_taken_back():
    sp, su = np.array([3.0]), np.array([-9.0, -9.0])
    by_p, by_u, risk = tox.risk_slopes(sp, su, 0.9)
    assert risk == pytest.approx(0.9 * np.logaddexp(0, -3.0)) and (by_u < 0).all() and by_p[0] > 0


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    rows, labels = [], []
    for i in range(1500):
        text = [rng.choice(words) for _ in range(rng.randrange(20, 120))]
        bad = rng.random() < 0.15
        if bad:
            for _ in range(rng.randrange(2, 6)):
                text[rng.randrange(len(text))] = rng.choice(["vile", "nasty", "rotten", "filth"])
        rows.append((i, " ".join(text), bad))
        if i % 2 == 0:
            labels.append((i, 1 if bad else None if rng.random() < 0.5 else 0))
    return spark.createDataFrame(rows, "doc_id long, text string, bad boolean").cache(), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(planted):
    docs, labels = planted
    model = tox.train(docs.drop("bad"), labels)
    out = {r.doc_id for r in tox.rejected(docs, model).collect()}
    held = [(r.doc_id, r.bad) for r in docs.where("doc_id % 2 = 1").collect()]
    hits = sum(bad and i in out for i, bad in held)
    assert hits >= 0.9 * sum(b for _, b in held) and sum(not bad and i in out for i, bad in held) <= 2
    assert tox.filtered(docs, model).count() == docs.count() - len(out)


def test_only_confirmed_ones_listed(planted):
    docs, labels = planted
    bad = {r.doc_id for r in docs.where("bad").collect()}
    for prior in (0.145, None):
        model = tox.train(docs, labels.where("toxic = 1"), prior=prior)
        out = {r.doc_id for r in tox.rejected(docs, model).collect()}
        assert len(out & bad) >= 0.9 * len(bad) and len(out - bad) <= 15


def test_the_prior(planted, monkeypatch):
    """The share among the labels where they are a fair sample; where toxic ones were preferred, what the words allow."""
    docs, labels = planted
    priors, fit = [], tox.fit
    monkeypatch.setattr(tox, "fit", lambda p, u, prior, *rest: priors.append(prior) or fit(p, u, prior, *rest))
    true = docs.where("bad").count() / docs.count()
    bad = labels.where("toxic = 1")
    tox.train(docs.drop("bad"), labels)
    assert priors == [bad.count() / labels.count()] * tox.CLASSIFIERS
    for preferred in (bad.unionByName(labels.where("toxic is null or toxic = 0").limit(20)), bad):
        priors.clear()
        model = tox.train(docs.drop("bad"), preferred)
        assert all(0.9 * true < p < 2.5 * true for p in priors)
        confirmed = {r.doc_id for r in bad.collect()}
        assert len(confirmed & {r.doc_id for r in tox.rejected(docs, model).collect()}) >= 0.95 * len(confirmed)
    priors.clear()
    tox.train(docs.drop("bad"), labels, prior=0.7)
    tox.train(docs.drop("bad"), labels, prior=0.0)
    assert priors == [0.7] * tox.CLASSIFIERS + [tox.LEAST_PRIOR] * tox.CLASSIFIERS


def _word_sets(texts):
    return [set(re.findall(r"\w+", (t or "").lower())) for t in texts]


def _rows(x):
    return tox.Rows(np.nonzero(x)[1], np.concatenate([[0], np.cumsum(x.sum(1).astype(int))]))


def _slow_fit(xp, xu, prior, seed, steps):
    """The same descent over dense rows, with slopes by differences."""
    rng = np.random.default_rng(seed)
    decay = tox.DECAY / len(xp)
    xp, xu = (x[rng.permutation(len(x))[: -(-len(x) * 4 // 5)]] for x in (xp, xu))
    loss = lambda s: np.log1p(np.exp(-s))
    w = np.append(np.zeros(xp.shape[1]), math.log(prior / (1 - prior)))
    m, v, average = w * 0, w * 0, w * 0
    for step in range(1, steps + 1):
        def parts(w):
            sp, su = xp @ w[:-1] + w[-1], xu @ w[:-1] + w[-1]
            return prior * loss(sp).mean(), loss(-su).mean() - prior * loss(-sp).mean()

        back = parts(w)[1] < 0
        goal = lambda w: -parts(w)[1] if back else sum(parts(w))
        g = np.array([(goal(w + h) - goal(w - h)) / 2e-6 for h in np.eye(len(w)) * 1e-6])
        g[:-1] += decay * w[:-1]
        m, v = m + 0.1 * (g - m), v + 0.01 * (g * g - v)
        w = w - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        average += w * (step > steps // 2)
    return average / (steps - steps // 2)


def test_against_a_slow_version(spark, planted):
    """Features as sets of words, selection word by word, dense descent on the risk, scores word by word."""
    docs, labels = planted
    texts = {r.doc_id: r.text for r in docs.collect()}
    yes = {r.doc_id for r in labels.where("toxic = 1").collect()}
    p, u = _word_sets(texts[i] for i in sorted(yes)), _word_sets(texts.values())
    vocabulary = sorted(set().union(*u))
    often = [w for w in vocabulary if sum(w in d for d in p) + sum(w in d for d in u) >= tox.LEAST_DOCS]
    bound = NormalDist().inv_cdf(1 - tox.CHANCE / 2 / len(often))
    chosen = []
    for w in often:
        a, b = sum(w in d for d in p), sum(w in d for d in u)
        share = (a + b) / (len(p) + len(u))
        if abs(a / len(p) - b / len(u)) >= bound * math.sqrt(share * (1 - share) * (1 / len(p) + 1 / len(u))):
            chosen.append(w)
    model = tox.train(docs.drop("bad"), labels, positives=10**6, unlabelled=10**6)
    hashed = dict(zip(chosen, (int(hash_words(pa.array([w]))[0][0]) for w in chosen)))
    assert sorted(hashed.values()) == model.known.tolist() and {"vile", "nasty", "rotten", "filth"} <= set(chosen)
    prior = min(len(yes) / labels.count(), tox.estimated_prior(np.array([sum(w in d for d in p) for w in often]), len(p), np.array([sum(w in d for d in u) for w in often]), len(u)))

    order = sorted(chosen, key=hashed.get)
    xp, xu = (np.array([[w in d for w in order] for d in rows], float) for rows in (p, u))
    fast = tox.fit(_rows(xp), _rows(xu), prior, len(order), seed=5, steps=80)
    slow = _slow_fit(xp, xu, prior, seed=5, steps=80)
    assert fast[0] == pytest.approx(slow[:-1], abs=1e-4) and fast[1] == pytest.approx(slow[-1], abs=1e-4)
    got = {r.doc_id: r.score for r in tox.scores(docs, model).collect()}
    for i, words_ in zip(texts, u):
        s = model.intercept + sum(float(model.weights[order.index(w)]) for w in words_ if w in hashed)
        assert got[i] == pytest.approx(1 / (1 + math.exp(-s)), abs=1e-9)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
def test_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    model = tox.train(docs, labels.where("doc_id % 3 <> 0"))
    out = {r.doc_id for r in tox.rejected(docs, model).collect()}
    held = {r.doc_id: r.toxic for r in labels.where("doc_id % 3 = 0").collect()}
    hits, wrong = sum(t == 1 and i in out for i, t in held.items()), sum(t == 0 and i in out for i, t in held.items())
    assert hits >= 0.8 * sum(t == 1 for t in held.values()) and hits / (hits + wrong) >= 0.9


def test_odd_rows(spark, odd, empty, planted):
    docs, labels = planted
    model = tox.train(docs, labels)
    scores = tox.scores(odd, model).collect()
    assert len(scores) == odd.count() and all(0 <= r.score < 0.5 for r in scores)
    assert all(r.score == 0 for r in scores if r.doc_id in (1, 2, 3))
    assert tox.filtered(odd, model).schema == odd.schema and tox.filtered(odd, model).count() == odd.count()
    assert tox.rejected(empty, model).count() == 0 and tox.filtered(empty, model).count() == 0
    nothing = [labels.where("1 = 0"), labels.selectExpr("doc_id", "cast(null as int) as toxic"), labels.selectExpr("cast(null as long) as doc_id", "1 as toxic")]
    for none in nothing:
        untrained = tox.train(odd, none)
        assert {r.score for r in tox.scores(odd, untrained).collect()} == {0.0} and tox.filtered(odd, untrained).count() == odd.count()
    assert tox.train(empty, labels).known is None
    tox.train(odd, spark.createDataFrame([(5, 1), (5, 0), (5, 1), (8, None)], "doc_id long, toxic int"))
