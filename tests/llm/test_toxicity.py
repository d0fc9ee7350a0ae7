"""Noisy words against an exhaustive search, and held-out accuracy."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from lendwell.llm import toxicity, words

BAD = ["idiot", "moron", "scum", "stupid", "worthless", "pathetic"]


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(0)
    return np.log(rng.dirichlet(np.ones(toxicity.N), (toxicity.N, toxicity.N))).astype(np.float32)


def exhaustive(token, model):
    """Score and text of the best of all readings."""
    reads, drops = toxicity._options(token)
    best = (-np.inf, None)
    choices = [[*r, (None, d, "")] if np.isfinite(d) else r for r, d in zip(reads, drops, strict=True)]
    for path in itertools.product(*choices):
        a = b = 0
        total = 0.0
        for cls, cost, _ in path:
            total += cost
            if cls is not None:
                total += model[a, b, cls]
                a, b = b, cls
        total += model[a, b, 0]
        best = max(best, (total, "".join(x for _, _, x in path)))
    return best


def test_viterbi_finds_the_best_reading(model):
    rng = random.Random(3)
    tokens = ["".join(rng.choice("ab01!l$ .é-") for _ in range(rng.randint(1, 6))) for _ in range(150)] + ["aaaa", "abbbb0", ""]
    got = toxicity.restore(tokens, model)
    for token, text in zip(tokens, got, strict=True):
        score, want = exhaustive(token, model)
        again = [p for p in [want, text]]
        assert text == want or abs(value(token, text, model) - score) < 1e-3, (token, again)


def value(token, text, model):
    """The best score among readings that give `text`."""
    reads, drops = toxicity._options(token)
    choices = [[*r, (None, d, "")] if np.isfinite(d) else r for r, d in zip(reads, drops, strict=True)]
    best = -np.inf
    for path in itertools.product(*choices):
        if "".join(x for _, _, x in path) == text:
            a = b = 0
            total = 0.0
            for cls, cost, _ in path:
                total += cost
                if cls is not None:
                    total += model[a, b, cls]
                    a, b = b, cls
            best = max(best, total + model[a, b, 0])
    return best


def test_suspicious_words():
    texts = ["An 1d1ot! 2024 and (trash) yes", "x i d i o t z", "i.d.i.o.t sooooo é", "", "a b c", "###", "p" * 200 + "1"]
    found = {}
    for chunk in words.chunks(pa.array(texts)):
        noisy = toxicity.noisy_words(chunk)
        for i, token in zip(noisy.token_text, noisy.tokens, strict=True):
            found.setdefault(int(i) + chunk.first, []).append(token)
        plain = [bytes(chunk.data[a:b]).decode() for a, b in zip(noisy.starts, noisy.ends, strict=True)]
    assert found[0] == ["1d1ot"] and found[1] == ["x i d i o t z"] and found[2] == ["i.d.i.o.t", "sooooo"]
    assert 3 not in found and 4 not in found and 5 not in found
    assert "".join(found[6]) == "p" * 200 + "1" and max(map(len, found[6])) == toxicity.PIECE
    assert plain[:4] == ["An", "2024", "and", "trash"]


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["ta", "re", "mo", "ni", "lu", "so"]) for _ in range(rng.randint(1, 4)))
    noise = lambda w: rng.choice([w.replace("i", "1").replace("o", "0"), w.replace("s", "$", 1), " ".join(w), w[0] + w[1] * 4 + w[2:], w + "!!"])
    rows, labels = [], []
    for i in range(900):
        text = [word() for _ in range(rng.randint(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            # A third are written noisily, so that only restored words tell.
            some = rng.sample(BAD, 2)
            text[len(text) // 2 :] = [*[noise(w) if i % 3 == 0 else w for w in some], *text[len(text) // 2 :]]
        rows.append((i, " ".join(text), 0.5))
        labels.append((i, int(toxic)))
    rows += [(2000, None, 0.1), (2001, "", 0.1), (None, "nobody is an idiot moron", 0.1), (2002, "1d10t " * 50_000, 0.1)]
    labels += [(3, None), (None, 1), (4, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    return rows, dict(labels), toxicity.score_toxicity(docs, marks).collect()


def test_held_out_accuracy(scored):
    import zlib

    rows, labels, got = scored
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(("null" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    right = [r.predicted == labels[r.doc_id] for r in held]
    assert len(held) > 120 and np.mean(right) > 0.95
    noisy = [r for r in held if labels[r.doc_id] and r.doc_id % 3 == 0]
    assert np.mean([r.predicted for r in noisy]) > 0.8


def test_labels_of_held_out_rows_are_never_read(spark, scored):
    rows, labels, got = scored
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    held = {r.doc_id for r in got if r.held_out}
    turned = [(i, 1 - t if i in held else t) for i, t in labels.items() if i is not None and t is not None]
    again = toxicity.score_toxicity(docs, spark.createDataFrame(turned, "doc_id long, toxic int")).collect()
    base = toxicity.score_toxicity(docs, spark.createDataFrame([(i, t) for i, t in labels.items() if i is not None and t is not None], "doc_id long, toxic int")).collect()
    assert sorted((str(r.doc_id), r.score) for r in again) == sorted((str(r.doc_id), r.score) for r in base)


def test_no_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in toxicity.score_toxicity(docs, none).collect()] == [0]
    assert toxicity.score_toxicity(docs.limit(0), none).count() == 0


def test_masked_words_reach_the_lattice():
    texts = ["a$$ sh!+ @$$ 455 5417 a b c", "word,! stop. 2024 x y", "", "a $ $ $", "($$ |", "é$$ idiot!"]
    found = {}
    for chunk in words.chunks(pa.array(texts)):
        tokens, owner = toxicity.masked_words(chunk)
        for i, token in zip(owner, tokens, strict=True):
            found.setdefault(int(i) + chunk.first, []).append(token)
    assert found == {0: ["a$$", "sh!+", "@$$", "455", "5417", "a b c"], 3: ["a $ $ $"], 4: ["($$"], 5: ["é$$", "idiot!"]}


def test_masked_words_take_part_in_the_features(spark):
    plain = ["nice", "ass", "shit", "that", "this", "cat"] * 200
    docs = spark.createDataFrame([(" ".join(plain),)], "text string")
    model = toxicity.language_model(docs)
    assert toxicity.restore(["a$$", "sh!+", "@$$", "455", "cat!", "this$$$"], model) == ["ass", "shit", "ass", "ass", "cat", "this"]
    for masked, word in [("a$$", "ass"), ("sh!+", "shit"), ("@$$", "ass"), ("455", "ass"), ("c a t", "cat"), ("cat!", "cat")]:
        chunk = next(iter(words.chunks(pa.array([masked, word]))))
        owner, feature = toxicity.text_features(chunk, model)
        assert set(feature[owner == 1]) <= set(feature[owner == 0]), masked
