import hashlib
import random
import re

import numpy as np
import pytest

from tether.llm import embeddings, minhash, suffixes

DOCS = "doc_id long, text string, lang string, extra string"


def words(rng, n, kinds=400):
    return [f"w{rng.randrange(kinds)}" for _ in range(n)]


def brute_near(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_agree_with_all_pairs(spark):
    rng = random.Random(1)
    rows, n = [(0, None), (1, ""), (2, " \n "), (3, "A b"), (4, "a B"), (5, "a b c d e"), (6, "x" * 100_000)], 10
    base = words(rng, 200)
    for k in range(60):  # copies of one text that may be alike only through it
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = f"edit{n}"
        rows.append((n, " ".join(w)))
        n += 1
    passage = words(rng, 60)
    for _ in range(60):
        rows.append((n, " ".join(words(rng, 80) + passage)))
        n += 1
    rows += [(n, rows[-1][1].upper()), (n + 1, " ".join(words(rng, 9000)))]
    df = spark.createDataFrame([(i, t, "en", "z") for i, t in rows], DOCS)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df).collect()}
    assert got == {i: (s, c, i == c) for i, (s, c) in brute_near(rows).items()}


def test_near_copies_that_do_not_link_and_words_of_a_special_form(spark):
    rng = random.Random(7)
    base, rows = words(rng, 150, 10**6), []
    for i in range(250):  # copies of one text, most of which are alike to the original at best
        w = list(base)
        for _ in range(rng.randrange(3, 14)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    rows.append((250, " ".join(base)))
    a = "a"
    for _ in range(10):  # different words that polynomial hashes modulo a power of two do not tell apart
        a += a.translate({97: 98, 98: 97})
    rows += [(300, a), (301, a.translate({97: 98, 98: 97}))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for few in (8, 2):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, minhash.Settings(few=few)).collect()}
        assert got == brute_near(rows)


def test_near_duplicates_of_nothing_and_repeats(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(1, "a b c", None, None)] * 2 + [(None, "lonely words here", None, None)]
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert got == [(1, 1, True), (1, 1, True), (None, None, True)]


def test_fewest_matches():
    s = minhash.Settings()
    assert 0 < minhash.least_matches(25, s) < 25 * 0.75
    assert minhash.least_matches(200, s) > 100


def brute_repeats(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = len(re.findall(b"\1+", bytes(gone)))
        out[i] = (len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest())
    return out


def repeat_cases():
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abcdefgh é\n") for _ in range(n))
    passage, rows = text(180), [(0, None), (1, ""), (2, "a" * 99), (3, "a" * 350), (4, "ab" * 150), (5, text(100))]
    for i in range(6, 40):
        rows.append((i, text(rng.randrange(200)) + passage[rng.randrange(40) :] + text(rng.randrange(200)) + passage[: rng.randrange(180)]))
    return rows + [(40, rows[-1][1]), (41, rows[5][1]), (42, text(9000)), (43, rows[-1][1] * 2)]


@pytest.mark.parametrize("crowd, length", [(suffixes.CROWD, 100), (2, 100), (suffixes.CROWD, 200), (5, 40)])
def test_repeats_agree_with_brute_force(spark, monkeypatch, crowd, length):
    monkeypatch.setattr(suffixes, "CROWD", crowd)
    monkeypatch.setattr(suffixes, "BLOCK", 3000)
    rows = repeat_cases()
    df = spark.createDataFrame([(i, t, "en", "z") for i, t in rows], DOCS).repartition(3)
    got = suffixes.removed(df, suffixes.find_repeats(df, length), length).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == brute_repeats(rows, length)


def test_kept_texts(spark):
    rows = [(1, "x" * 10 + "abcdefghij" * 10, "en", "z"), (2, "abcdefghij" * 10, "en", "z"), (3, None, "en", "z"), (4, "é" * 3, "en", "z")]
    df = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r["text"] for r in suffixes.kept_texts(df, suffixes.find_repeats(df)).collect()}
    assert got == {1: rows[0][1], 3: None, 4: "ééé"}


def test_kept_texts_treats_empty_documents_alike_with_and_without_n_chars(spark):
    rows = [(1, "abcdefghij" * 10, 100), (2, "abcdefghij" * 10, 100), (3, "", None), (4, None, None), (5, "", 0), (6, "x" + "abcdefghij" * 10, 101)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    for d in (df, df.drop("n_chars")):
        got = {r["doc_id"]: r["text"] for r in suffixes.kept_texts(d, suffixes.find_repeats(d)).collect()}
        assert got == {1: rows[0][1], 3: "", 4: None, 5: "", 6: "x"}


def test_many_equal_separators(spark):
    line = "=" * 120 + "\n"
    rng = random.Random(6)
    rows = [(i, "".join(line + str(rng.random()) for _ in range(2500))) for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = suffixes.removed(df, suffixes.find_repeats(df)).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == brute_repeats(rows)


def test_loser_tree_merges_and_knows_shared_prefixes():
    rng = random.Random(3)
    for k in (1, 2, 3, 5, 8):
        runs = [sorted("".join(rng.choice("ab") for _ in range(rng.randrange(1, 12))).encode() for _ in range(rng.randrange(9))) for _ in range(k)]
        before, out = b"", []
        for _, entry, known in suffixes.merge([suffixes.Run(*suffixes.front_code(r)) for r in runs]):
            assert known == suffixes.shared(before, entry, 0)
            out.append(entry)
            before = entry
        assert out == sorted(x for r in runs for x in r)


def test_vectors_agree_with_all_pairs(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 16))
    x[60:90] = x[:30] + rng.normal(scale=0.12, size=(30, 16))
    x[90:100] = x[0]
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    rows += [(200, None), (201, []), (202, [0.0] * 16), (203, [float("nan")] * 16), (204, [None] + [1.0] * 15), (205, [1.0, 2.0]), (206, [2.0, 4.0])]
    df = spark.createDataFrame([(i, v, "z") for i, v in rows], "vec_id long, embedding array<float>, label string")
    v = np.array([r[1] for r in rows[:120]], float)
    u = v / np.linalg.norm(v, axis=1)[:, None]
    near = (u @ u.T >= 0.9) & ~np.eye(120, dtype=bool)
    comp = np.arange(120)
    while True:
        new = np.array([min(comp[i], *(comp[near[i]] if near[i].any() else [comp[i]])) for i in range(120)])
        if (new == comp).all():
            break
        comp = new
    want = {i: (int(near[i].sum()), int(comp[i])) for i in range(120)} | {i: (0, i) for i in range(200, 205)} | {205: (1, 205), 206: (1, 205)}
    for block in (4096, 20):
        got = embeddings.near_vectors(df, block=block).collect()
        assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == want
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_quantisation_bound_holds():
    x = np.random.default_rng(5).normal(size=(50, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q, s, e = embeddings.quantise(x)
    q = q.astype(float)
    gap = np.abs(x @ x.T - (q @ q.T) * s[:, None] * s[None, :])
    assert (gap <= e[:, None] + (1 + e[:, None]) * e[None, :] + 1e-9).all()


def test_tiny_and_huge_vectors_take_no_links_from_others(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=8)
    rows = [(i, (base + rng.normal(scale=0.01, size=8)).tolist()) for i in range(5)]
    rows += [(100 + i, (rng.normal(size=8) * 1e-200).tolist()) for i in range(40)] + [(200, (base * 1e-300).tolist()), (201, (base * 1e300).tolist()), (202, [5e-324] + [0.0] * 7)]
    v = np.array([r[1] for r in rows])
    u = embeddings.unit(v)
    near = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    for block in (8192, 10):
        got = {r["vec_id"]: r["n_links"] for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=block).collect()}
        assert got == {r[0]: int(k) for r, k in zip(rows, near.sum(axis=1))}


def test_pairs_at_the_threshold_are_settled_in_full_precision(spark):
    a = np.zeros(6)
    a[0] = 1.0
    rows = [(0, a.tolist())]
    for k, c in enumerate((0.9 + 1e-9, 0.9 - 1e-9, 0.95, 0.85)):
        v = np.zeros(6)
        v[0], v[k + 1] = c, np.sqrt(1 - c * c)
        rows.append((k + 1, v.tolist()))
    got = {r["vec_id"]: r["component_id"] for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 0, 4: 4}
