"""Toxicity: held-out accuracy on a small table and edge cases."""

import numpy as np

from rillwork.llm.toxicity import _CODES, MAX_DISTANCE, calibrate, classify_toxicity, compressor, distances, largest, windows, without_toxic


def test_planted_words(spark):
    common = [f"plain{i % 23}" for i in range(60)]
    docs = [(i, " ".join([*common[i % 20 :], "horribleword"] if i % 4 == 0 else common[i % 20 :])) for i in range(400)]
    frame = spark.createDataFrame([*docs, (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    rows = classify_toxicity(frame, labels).collect()
    assert len(rows) == 402
    held = [r for r in rows if r["held_out"] and r["doc_id"] < 400]
    assert held and all(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held)
    assert all(r["predicted"] == 0 for r in rows if r["doc_id"] >= 900)
    kept = without_toxic(frame.selectExpr("*", "1 as distance", "2 as row"), labels)
    assert kept.columns == ["doc_id", "text", "distance", "row"]
    assert kept.count() == 302


def test_no_labels_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, "c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["predicted"] for r in classify_toxicity(docs, none).collect()] == [0, 0]
    assert classify_toxicity(docs.limit(0), none).count() == 0


def test_words_that_change_their_endings(spark):
    common = [f"plain{i % 23}" for i in range(60)]
    docs = [(i, " ".join([*common[i % 20 :], f"horrib{'abcdefghij'[i % 10]}x"] if i % 4 == 0 else common[i % 20 :])) for i in range(400)]
    frame = spark.createDataFrame(docs + docs[:40], "doc_id long, text string").selectExpr("*", "1 as distance", "2 as half", "3 as label")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    rows = classify_toxicity(frame, labels).collect()
    assert len(rows) == 440 and all(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in rows if r["held_out"])


def test_calibration_against_plain_pooling():
    rng = np.random.default_rng(3)
    found, kinds = rng.integers(0, MAX_DISTANCE + 1, 300), rng.integers(0, 2, 300)
    scores = calibrate(found, kinds, 0.1)
    assert len(scores) == MAX_DISTANCE + 1 and (np.diff(scores) >= 0).all()
    weight = np.where(kinds == 1, 0.1 / kinds.sum(), 0.9 / (1 - kinds).sum())
    # the least squares among all scores that never fall: largest mean of runs that begin, least of runs that end
    share = lambda a, b: (weight * kinds)[(found >= a) & (found <= b)].sum() / max(weight[(found >= a) & (found <= b)].sum(), 1e-300)
    top = MAX_DISTANCE + 1
    for d in np.unique(found).tolist():
        plain = max(min(share(a, b) for b in range(d, top) if ((found >= a) & (found <= b)).any()) for a in range(d + 1))
        assert abs(plain - scores[d]) < 0.15


def test_distances_against_single_compressions():
    words = b"pathetic clown and the others are here pathetic"
    toxic, ordinary = compressor(_CODES[np.frombuffer(b" pathetic clown ", np.uint8)].tobytes()), compressor(_CODES[np.frombuffer(b" and the ", np.uint8)].tobytes())
    buf, s, e, _ = windows([words])
    spread = [_CODES[buf[i:j]].tobytes() for i, j in zip(s, e, strict=True)]
    want = [(len(ordinary.compress(w)) - len(toxic.compress(w))) * MAX_DISTANCE // len(ordinary.compress(w)) for w in spread]
    assert distances(buf, s, e, toxic, ordinary).tolist() == want
    assert largest([words, b""], toxic, ordinary).tolist() == [max(want), 0]
