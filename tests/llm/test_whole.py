"""Operators do their whole job on documents without ids and on few labels."""

import hashlib

import numpy as np
import pytest

from tether.llm import quality, suffixes


def cut(texts, length=100):
    """What is left of each text, in order, when windows that start earlier go."""
    seen, out = set(), []
    for t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if t[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(t[p : p + length])
        out.append("".join(c for c, g in zip(t, gone) if not g))
    return out


@pytest.mark.parametrize("crowd", [suffixes.CROWD, 1])
def test_texts_without_an_id_or_with_one_id_are_documents_of_their_own(spark, monkeypatch, crowd):
    monkeypatch.setattr(suffixes, "CROWD", crowd)
    rng = np.random.default_rng(7)
    text = lambda n: "".join(rng.choice(list("abcdefgh \n"), n))
    passage = text(150)
    texts = [(1, passage), (5, text(300)), (5, text(40) + passage + text(90)), (None, text(400)), (None, text(60) + passage + text(200)), (None, text(60) + passage + text(30)), (None, text(50)), ((1 << 63) - 1, text(200))]
    shared = text(120)
    texts += [(None, shared + text(20)), (None, shared + text(80)), (None, texts[-1][1])]
    texts = texts + [texts[3]]
    digest = lambda t: hashlib.sha256(t.encode()).digest()
    order = sorted(set(texts), key=lambda r: (r[0] is None, r[0] or 0, digest(r[1])))
    left = dict(zip(order, cut([t for _, t in order])))
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    found = suffixes.find_repeats(df)
    kept = [(r["doc_id"], r["text"]) for r in suffixes.kept_texts(df, found).collect()]
    assert sorted(kept, key=str) == sorted(((r[0], left[r]) for r in texts if left[r]), key=str)
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in suffixes.removed(df, found).collect()]
    assert sorted(got, key=str) == sorted(((r[0], len(r[1]), len(r[1]) - len(left[r]), digest(left[r]).hex()) for r in texts), key=str)


def test_rules_are_learnt_from_few_labels():
    x = np.random.default_rng(11).normal(size=(58, len(quality.STATISTICS)))
    y = (x[:, 3] > 0.2).astype(float)
    model = quality.fit(x, y)
    raw = model.bias + sum(w * quality._holds(x, r) for r, w in zip(model.rules, model.weights))
    assert model.rules and ((raw > 0) == (y == 1)).mean() > 0.9
    for n in (1, 2, 5):
        assert np.isfinite(quality.fit(x[:n], np.arange(n) % 2.0).bias)
