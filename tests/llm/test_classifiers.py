import numpy as np
from pyspark.sql import functions as F

from sievelake.llm import boosting, language_id, linear, quality, toxicity
from tests.llm.conftest import prose

SYLLABLES = {"en": "th er on an re he in ed nd ha", "de": "sch ung ein ich der ver ge keit und au", "fr": "eau oi que ment tion ez ou ai le la", "es": "cion ado ente ar os la el que do mos"}


def test_language_by_family_then_language(spark):
    rows = [(i, prose(i, 60, SYLLABLES[lang]), lang) for i, lang in enumerate(list(SYLLABLES) * 60)]
    edge = [(1000, None, "en"), (1001, "", None), (1002, "1234 !!", "en"), (1003, prose(7777, 60, SYLLABLES["fr"]), None), (1004, prose(1, 30000, SYLLABLES["de"]), "de")]
    docs = spark.createDataFrame(rows + edge, "doc_id long, text string, lang string").withColumn("score", F.lit("mine"))
    model = language_id.fit(docs.where("doc_id % 5 <> 0"), per_language=30)
    assert model.families == ["germanic", "romance"]
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    held = [r for r in rows if r[0] % 5 == 0]
    assert np.mean([got[i].lang_pred == lang for i, _, lang in held]) > 0.95
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003, 1004)] == ["und", "und", "und", "fr", "de"]
    assert all(0 <= r.score <= 1 for r in got.values()) and got[1000].score == 0
    assert {r.lang_pred for r in language_id.predict(docs, language_id.fit(docs.limit(0))).collect()} == {"und"}
    few = language_id.fit(docs, per_language=10, most_languages=2)  # ties of counts by code
    assert few.families == ["germanic"] and {c for m in few.within for c in m.classes} == {"de", "en"}


def test_squared_hinge_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5)).astype("f4")
    y = np.where(x[:, 0] + 0.5 * x[:, 1] > 0.2, 1, -1)
    w, b = linear.squared_hinge(x, y, cost=50)
    assert (np.sign(x @ w + b) == y).mean() > 0.97


def test_boosting_and_calibration():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    model = boosting.BoostedTrees(x[:2000], y[:2000], rounds=40)
    assert ((model.margin(x[2000:]) > 0) == y[2000:]).mean() > 0.95
    p = boosting.Isotonic(model.margin(x[2000:]), y[2000:])(np.linspace(-9, 9, 50))
    assert (np.diff(p) >= -1e-12).all() and 0 <= p.min() and p.max() <= 1


def test_isotonic_matches_brute_force():
    rng = np.random.default_rng(2)
    s, y = np.arange(40.0), (rng.random(40) < np.linspace(0, 1, 40)).astype(float)
    for labels in (y, np.sort(y), y[::-1].copy(), rng.integers(0, 2, 40).astype(float)):
        fitted = boosting.Isotonic(s, labels)
        # the closest non-decreasing function: the largest over beginnings of the least over ends of the mean between
        best = [max(min(labels[a : b + 1].mean() for b in range(i, 40)) for a in range(i + 1)) for i in range(40)]
        cuts = [0, *(i for i in range(1, 40) if abs(best[i] - best[i - 1]) > 1e-12), 40]
        blocks = [slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
        assert np.allclose(fitted.at, [s[b].mean() for b in blocks])
        own = [(labels[b].sum() + 0.5) / (len(labels[b]) + 1) if len(labels[b]) > 1 else labels[b][0] for b in blocks]
        assert np.allclose(fitted.value, np.maximum.accumulate(own))
        assert np.allclose(fitted(fitted.at), fitted.value) and len(boosting.Isotonic(s[:0], y[:0])(s)) == 40


def labelled(spark, docs, column):
    return spark.createDataFrame([(i, v) for i, _, v in docs], f"doc_id long, {column} int")


def test_toxicity(spark):
    rng = np.random.default_rng(3)
    docs = []
    for i in range(400):
        text, bad = prose(i, 60), i % 5 == 1
        if bad:
            words = text.split()
            for at in rng.integers(0, 60, 4):
                words[at] = rng.choice(["idiot", "moron", "blargh" + prose(i, 1)])
            text = " ".join(words)
        docs.append((i * 7, text, int(bad)))
    frame = spark.createDataFrame([(i, t) for i, t, _ in docs] + [(5001, None), (5002, ""), (5003, "idiot " * 20000)], "doc_id long, text string").withColumn("label", F.lit("x"))
    labels = labelled(spark, docs, "toxic").unionByName(spark.createDataFrame([(5003, None), (None, 1)], "doc_id long, toxic int"))
    model = toxicity.fit(frame, labels)
    got = {r.doc_id: r.score for r in toxicity.score(frame, model).collect()}
    import zlib

    held = [(got[i], y) for i, _, y in docs if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(s >= 0.5) == y for s, y in held]) > 0.95
    assert all(0 <= s <= 1 for s in got.values()) and got[5001] == got[5002] < 0.5
    none = toxicity.fit(frame, labels.limit(0))
    assert {r.score for r in toxicity.score(frame, none).collect()} == {0.0}


def test_quality_and_its_gradient(spark):
    docs = []
    for i in range(300):
        text = prose(i, 120)
        good = i % 4 != 0
        docs.append((i, text.capitalize() + "." if good else " | ".join(text.split()).upper() + "!!", int(good)))
    frame = spark.createDataFrame([(i, t) for i, t, _ in docs] + [(900, None), (901, ""), (902, prose(1, 20000))], "doc_id long, text string").withColumn("score", F.lit(3))
    model = quality.fit(frame, labelled(spark, docs, "quality"))
    got = {r.doc_id: r.score for r in quality.score(frame, model).collect()}
    assert np.mean([(got[i] >= 0.3) == y for i, _, y in docs]) > 0.97
    assert all(0 <= s <= 1 for s in got.values()) and got[900] == got[901] and got[902] >= 0.3

    net, rng = quality.AttentionNetwork(4), np.random.default_rng(0)
    x, starts, y = rng.normal(size=(7, 4)), np.array([0, 3, 4]), np.array([1.0, 0.0, 1.0])
    loss = lambda: -np.mean(y * np.log(quality._sigmoid(net.forward(x, starts)[-1])) + (1 - y) * np.log(1 - quality._sigmoid(net.forward(x, starts)[-1])))
    for name, g in net.gradient(x, starts, y).items():
        flat = net.p[name].reshape(-1)
        for k in range(0, flat.size, max(1, flat.size // 3)):
            old = flat[k]
            flat[k] = old + 1e-5
            up = loss()
            flat[k] = old - 1e-5
            down = loss()
            flat[k] = old
            assert abs((up - down) / 2e-5 - g.reshape(-1)[k]) < 1e-6, name
