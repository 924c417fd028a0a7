import random
import zlib

import numpy as np

from echograms.llm import language_id as li
from echograms.llm import toxicity as tx
from tests.llm.helpers import documents, odd_rows

TONGUES = {"en": "the of and ing tion her with from", "de": "der und die ung heit schen für über", "fr": "le la eau eux ment ière été où", "es": "el los ción mente ñado que para así"}


def sentence(rng, lang, n=25):
    parts = TONGUES[lang].split()
    return " ".join(rng.choice(parts) + rng.choice(parts) * rng.randint(0, 1) for _ in range(n))


def corpus(rng, n):
    langs = list(TONGUES)
    return [(i, sentence(rng, langs[i % 4]), langs[i % 4]) for i in range(n)]


def test_language_of_unseen_documents(spark, tmp_path):
    rows = corpus(random.Random(11), 400) + [(1000 + i, t, None) for i, (_, t) in enumerate(odd_rows())]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in li.op4_language_id(spark, str(tmp_path)).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out for i in held) and sum(got[i].lang_pred == rows[i][2] for i in held) >= 0.98 * len(held)
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1000].score == 0.0
    assert all(0 <= r.score <= 1 for r in got.values())


def test_nothing_to_learn_and_empty_table(spark):
    docs = documents(spark, [(1, "abc", None), (None, "abc", "en")])
    model = li.trained_on(docs)
    assert model.languages == [] and [r.lang_pred for r in li.identify(docs, model, "doc_id").collect()] == ["und", "und"]
    none = documents(spark, [])
    assert li.identify(none, li.trained_on(none), "doc_id").collect() == []
    assert li.keep_identified(none, model).columns == none.columns


def test_gram_counts_cover_the_whole_text():
    assert li.gram_counts("ab").sum() == 4 + 3 + 2
    assert li.gram_counts("x" * 100_000).sum() == 3 * 100_002 - 3


def toxic_rows(rng, n, lang="en"):
    bad = "idiot scum trash moron".split()
    rows, labels = [], []
    for i in range(n):
        words = sentence(rng, lang, 40).split()
        toxic = i % 6 == 0
        for _ in range(3 if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice([*bad, "vequ" + rng.choice("ta ire no mo con".split())])
        rows.append((i, " ".join(words), lang))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_of_unseen_documents(spark, tmp_path):
    rows, labels = toxic_rows(random.Random(12), 900)
    rows += [(2000 + i, t) for i, (_, t) in enumerate(odd_rows())]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([*labels, (5000, 1), (0, None)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r.doc_id: r for r in tx.op3_toxicity(spark, str(tmp_path)).collect()}
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out for i, _ in held)
    assert sum(got[i].predicted == y for i, y in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values()) and got[2000].predicted == 0 and len(got) == 910


def test_no_labels_and_empty_table(spark):
    docs, labels = documents(spark, [(1, "a b")]), spark.createDataFrame([], "doc_id long, toxic int")
    net = tx.learn(docs, labels)
    assert 0 <= tx.toxicity(docs, net, "doc_id").first().score <= 1
    assert tx.toxicity(documents(spark, []), net, "doc_id").collect() == []


def featurise(text):
    raw = text.encode()
    return tx.word_features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]


def featured(rows, labels):
    out = []
    for (_, t, lang), (_, y) in zip(rows, labels):
        out.append((featurise(t), lang, y))
    return out


def test_long_texts_score_as_in_one_piece():
    rows, labels = toxic_rows(random.Random(13), 60)
    net = tx.train(featured(rows, labels))
    features = featurise(" ".join(t for _, t, _ in rows) * 20)
    best = np.maximum(net.pooled(net.embed(features))[0], 0)
    assert abs(net.logit(features) - float(best @ net.out + net.bias)) < 1e-3


def plain_score(net, features):
    """The score by loops over filters, places and coordinates."""
    vectors = [[sum(float(net.table[f][d]) for f in word) for d in range(tx.DIM)] for word in features.tolist()]
    total, k = float(net.bias), 0
    for width, f, b in zip(tx.WIDTHS, net.filters, net.biases):
        padded = vectors + [[0.0] * tx.DIM] * max(0, width - len(vectors))
        for j in range(tx.FILTERS):
            best = max(sum(padded[p + o][d] * float(f[o][d][j]) for o in range(width) for d in range(tx.DIM)) for p in range(len(padded) - width + 1))
            total += max(0.0, best + float(b[j])) * float(net.out[k])
            k += 1
    return 1 / (1 + np.exp(-(total - net.shift)))


def test_scores_equal_plain_loops_and_training_lowers_the_loss():
    rows, labels = toxic_rows(random.Random(14), 240)
    data = featured(rows, labels)
    net = tx.train(data)
    for f, _, _ in [*data[:6], (featurise("two words"), None, 0), (featurise(""), None, 0)]:
        assert abs(net.score(f) - plain_score(net, f)) < 1e-4
    samples = [(f, y) for f, _, y in data]

    def loss(n):
        z = np.array([n.logit(f) for f, _ in samples])
        y = np.array([y for _, y in samples])
        each = np.logaddexp(0, np.where(y == 1, -z, z))
        return each[y == 1].mean() + each[y == 0].mean()

    start = tx.fresh(samples)
    before = loss(start)
    tx.fit(start, samples)
    assert loss(start) < 0.3 * before


def test_a_gradient_step_follows_the_loss(monkeypatch):
    """One epoch of one batch: every weight that moved did so against the slope of the loss, taken by small differences."""
    monkeypatch.setattr(tx, "EPOCHS", 1)
    rows, labels = toxic_rows(random.Random(15), 30)
    samples = [(f, y) for f, _, y in featured(rows, labels)]
    net, moved = tx.fresh(samples), tx.fresh(samples)
    tx.fit(moved, samples)
    n, pos = len(samples), sum(y for _, y in samples)

    def loss(n_):
        return sum((n / (2 * pos) if y else n / (2 * (n - pos))) * np.logaddexp(0, -n_.logit(f) if y else n_.logit(f)) for f, y in samples) / n

    checked = 0
    for place in [("out", i) for i in range(0, len(net.out), 5)] + [("filter", (i, 0, 0, j)) for i in range(3) for j in (0, 4, 7)]:
        value = net.out if place[0] == "out" else net.filters[place[1][0]]
        new = moved.out if place[0] == "out" else moved.filters[place[1][0]]
        at = place[1] if place[0] == "out" else place[1][1:]
        old = value[at].copy()
        value[at] = old + 2e-3
        up = loss(net)
        value[at] = old - 2e-3
        slope = (up - loss(net)) / 4e-3
        value[at] = old
        if abs(slope) > 1e-3:
            checked += 1
            assert np.sign(new[at] - old) == -np.sign(slope), (place, slope)
    assert checked >= 5


def test_samples_are_bounded_in_words_and_take_long_and_repeated_ones(spark):
    rows, labels = toxic_rows(random.Random(16), 120)
    docs = documents(spark, rows + [(3, "idiot " * 30_000), (3, "scum")])
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    keep, tx_train = [], tx.train
    try:
        tx.train = lambda got: keep.append(got) or tx_train(got[:50])
        tx.learn(docs, marks)
        tx.learn(docs, marks, words=2000)
    finally:
        tx.train = tx_train
    whole, short = keep
    eligible = {i for i, _ in labels if zlib.crc32(str(i).encode()) % 5}
    assert len(whole) == len(eligible) + (2 if 3 in eligible else 0) and (3 not in eligible or max(len(f) for f, _, _ in whole) == 30_000)
    for y in (0, 1):
        assert 0 < sum(len(f) for f, _, k in short if k == y) <= 1000


def test_ftrl_equals_plain_loops(monkeypatch):
    """Follow-the-regularised-leader with elastic net, weight by weight, over two passes."""
    monkeypatch.setattr(li, "EPOCHS", 2)
    rng = np.random.default_rng(3)
    rows = []
    for i in range(20):
        at = np.sort(rng.choice(40, 6, replace=False))
        rows.append((at, rng.random(6) + 0.1, i % 3))
    model = li.train(["a", "b", "c"], np.ones(li.BUCKETS), rows)
    z, n = {}, {}

    def weight(k, i):
        zi, ni = z.get((k, i), 0.0), n.get((k, i), 0.0)
        penalty = 0.0 if i == li.BUCKETS else li.L1
        return 0.0 if abs(zi) <= penalty else -(zi - np.sign(zi) * penalty) / ((li.BETA + ni**0.5) / li.ALPHA + li.L2)

    for _ in range(2):
        for r, (at, value, label) in enumerate(rows):
            if r % 5 == 0:
                continue
            pairs = [*zip(at.tolist(), value.tolist()), (li.BUCKETS, 1.0)]
            scores = [sum(weight(k, i) * v for i, v in pairs) for k in range(3)]
            p = np.exp(np.array(scores) - max(scores))
            p /= p.sum()
            for k in range(3):
                for i, v in pairs:
                    g = (p[k] - (k == label)) * v
                    old = n.get((k, i), 0.0)
                    s = ((old + g * g) ** 0.5 - old**0.5) / li.ALPHA
                    z[k, i] = z.get((k, i), 0.0) + g - s * weight(k, i)
                    n[k, i] = old + g * g
    for k in range(3):
        assert abs(model.bias[k] - weight(k, li.BUCKETS)) < 1e-9
        assert all(abs(model.weights[k, i] - weight(k, i)) < 1e-9 for i in range(40))


def test_rare_languages_are_learned(spark):
    rng = random.Random(17)
    rows = [(i, sentence(rng, "en"), "en") for i in range(600)] + [(1000 + i, sentence(rng, "es"), "es") for i in range(9)]
    model = li.trained_on(documents(spark, rows), sample=30)
    assert model.languages == ["en", "es"] and model.predict(sentence(rng, "es"))[0] == "es"


def test_rows_with_columns_named_like_internal_ones(spark):
    docs = documents(spark, [(1, "the word"), (2, None)]).withColumnsRenamed({"size": "row", "score": "lang_pred", "source": "_text"})
    model = li.Model(["en"], np.ones(li.BUCKETS), np.zeros((1, li.BUCKETS)), np.zeros(1))
    kept = li.keep_identified(docs, model)
    assert kept.columns == docs.columns and [(r.doc_id, r.row, r.lang_pred, r["_text"]) for r in kept.collect()] == [(1, "x", "y", "s")]


def test_all_labelled_rows_are_learned_from(spark, monkeypatch):
    rows, labels = toxic_rows(random.Random(18), 300)
    docs, marks = documents(spark, rows + [(3, "idiot " * 3000), (9000, None)]), spark.createDataFrame([*labels, (9000, 1)], "doc_id long, toxic int")
    seen, started = [], tx.started
    monkeypatch.setattr(tx, "started", lambda *a: seen.append(a) or started(*a))
    net = tx.learn_all(docs, marks, words=2000)  # no bound: only the size of a part
    fold = {r.doc_id for r in docs.selectExpr("doc_id").where("pmod(xxhash64('toxic', doc_id), 5) = 0").collect()}
    taught = [(t, y) for (i, t, _), (_, y) in zip(rows, labels) if zlib.crc32(str(i).encode()) % 5 and i not in fold]
    taught += [("idiot " * 3000, labels[3][1])] if zlib.crc32(b"3") % 5 and 3 not in fold else []
    counts, texts = seen[0]
    assert texts.tolist() == [sum(y == k for _, y in taught) for k in (0, 1)]
    for word in ("idiot", "scum"):
        at = featurise(word)[0, 0]
        assert counts[:, at].tolist() == [sum(y == k and at in featurise(t) for t, y in taught) for k in (0, 1)]
    scores = {r.doc_id: r.score for r in tx.toxicity(docs, net, "doc_id").collect()}
    assert sum((scores[i] >= 0.5) == y for i, y in labels if i != 3) >= 0.9 * len(labels)


def test_thresholds_of_all_rows_are_those_of_a_sort(spark):
    rng = random.Random(19)
    rows = [(x, int(rng.random() < 1 / (1 + np.exp(-x))), "a" if i % 3 else None) for i, x in enumerate(rng.gauss(0, 2) for _ in range(300))]
    found = {(r.whole, r.lang): (r.high + r.low) / 2 for r in tx.thresholds(spark.createDataFrame(rows, "logit double, toxic int, lang string"))}
    of = lambda own: tx.best_threshold(np.array([x for x, _, _ in own]), np.array([y for _, y, _ in own]))
    assert found.keys() == {(True, None), (False, "a")}
    assert abs(found[True, None] - of(rows)) < 1e-9 and abs(found[False, "a"] - of([r for r in rows if r[2]])) < 1e-9


def test_few_labels_are_joined_as_many_are(spark):
    """What is shuffled follows the input at any size: no plan for few labels, and unlabelled texts stay where they are."""
    rows, labels = toxic_rows(random.Random(20), 300)
    docs, marks = documents(spark, rows), spark.createDataFrame([*labels[:60], (None, 1)], "doc_id long, toxic int")
    found = tx._labelled(docs, marks)
    eligible = {i for i, _ in labels[:60] if zlib.crc32(str(i).encode()) % 5}
    assert sorted(r.text for r in found.collect()) == sorted(t for i, t, _ in rows if i in eligible)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "ShuffledHashJoin" in plan
    assert "Sort [doc_id" in plan[: plan.index("ShuffledHashJoin")]  # training follows the order of rows
    scan = plan[plan.index("ShuffledHashJoin") :]
    assert scan.index("ArrowEvalPython") > scan.index("Exchange hashpartitioning")  # the bit table is asked below the shuffle
