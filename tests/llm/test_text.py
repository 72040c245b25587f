import json
import random
import zlib

import numpy as np
import pytest

from tether.llm import editcount, language, media, mixing, packing, quality, toolcalls
from tether.llm.tokens import SPECIAL, Encoder
from tether.runtime.scratch import Scratch

DOCS = "doc_id long, text string, lang string, source string"


def reference_bits(t, data, order=language.ORDER):
    """Code length of a byte string, one byte at a time."""
    total, data = 0.0, bytes(b + 32 if 65 <= b <= 90 else b for b in data)
    for i, byte in enumerate(data):
        history = (b"   " + data[:i])[-order:]
        for k in range(order, -1, -1):
            context = int.from_bytes(history[order - k :], "big")
            spot = np.flatnonzero(t.contexts[k] == context)
            if not len(spot):
                continue
            n, kinds = t.totals[k][spot[0]], t.kinds[k][spot[0]]
            own = np.flatnonzero(t.keys[k] == (context << 8 | byte))
            if len(own):
                total -= np.log2(t.counts[k][own[0]] / (n + kinds))
                break
            total -= np.log2(kinds / (n + kinds))
        else:
            total += 8
    return total


def test_code_lengths_are_exact():
    def learn(texts):
        buf = np.frombuffer("".join(texts).encode(), np.uint8)
        off = np.array([0, *np.cumsum([len(t.encode()) for t in texts])])
        w, n = np.unique(language.windows(buf, off), return_counts=True)
        return language.tree("x", w, n.astype(float))

    trees = [learn(["the cat sat on the mat", "a dog"]), learn(["le chat était là", "un chien"])]
    texts = ["The cat", "é", "", "zzz \x00 chat était", "là"]
    buf = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.array([0, *np.cumsum([len(t.encode()) for t in texts])])
    for pairs in (768, 5):
        got = language.Pricer(trees, pairs).bits(buf, off)
        want = [[reference_bits(t, x.encode()) for t in trees] for x in texts]
        assert np.allclose(got, want, atol=1e-3)


def test_language_cases(spark):
    rows = [(i, f"the quick fox and the lazy dog number{i}", "en", None) for i in range(30)] + [(100 + i, f"der schnelle fuchs und der hund{i}", "de", None) for i in range(30)]
    docs = spark.createDataFrame(rows, DOCS)
    trees = language.learn(docs)
    # lang_pred is a column that the operator replaces
    rows = [(1, None, "en"), (2, "", None), (3, "123 !?", "en"), (4, "the dog", "de"), (5, "der hund " * 20000, None), (5, "der hund", None)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string")
    got = sorted((r["doc_id"], r["lang_pred"]) for r in language.identify(odd, trees).collect())
    assert got == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "de"), (5, "de")]
    assert [r["lang_pred"] for r in language.identify(odd, language.learn(docs.limit(0))).collect()] == ["und"] * 6


def test_pack_fills_gapless_and_tightly(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("word" for _ in range(rng.randrange(0, 900))), None, None) for i in range(60)] + [(60, None, None, None), (61, "", None, None), (62, "long " * 5000, None, None), (62, "long " * 5000, None, None)]
    got = packing.pack(spark.createDataFrame(rows, DOCS), with_ids=True).collect()
    encoder = Encoder()
    by_sequence = {}
    texts = {i: t for i, t, *_ in rows}
    for r in got:
        ids = np.append(encoder.ids(texts[r["doc_id"]] or ""), 0).astype("<u4")[r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(ids.tobytes()) == r["ids_crc32"] and list(ids) == r["ids"]
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= packing.CAPACITY
    assert len(by_sequence) <= -(-sum(r["length"] for r in got) // packing.CAPACITY) + 1
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0


def test_rounds_are_as_tight_as_best_fit_decreasing(spark):
    rng = random.Random(2)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for _ in range(5):
            lengths = [rng.randrange(1, 101) for _ in range(rng.randrange(1, 200))]
            gaps = []
            for n in sorted(lengths, reverse=True):
                fits = [g for g in gaps if g >= n]
                if fits:
                    gaps.remove(min(fits))
                    gaps.append(min(fits) - n)
                else:
                    gaps.append(100 - n)
            df = spark.createDataFrame([(None, 0, n) for n in lengths], "doc_id long, piece int, length long")
            places = {}
            for r in packing.place(df, 100).collect():
                places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
            assert sorted(n for own in places.values() for _, n in own) == sorted(lengths)
            for own in places.values():
                own.sort()
                assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 100
            assert len(places) <= len(gaps) + 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_ranges_exchange_what_one_sweep_would_match():
    rng = random.Random(4)
    for _ in range(300):
        events = sorted(((rng.randrange(1, 30), rng.randrange(2)) for _ in range(rng.randrange(40))), key=lambda e: (-e[0], e[1]))
        cuts = sorted(rng.randrange(len(events) + 1) for _ in range(4))
        stack, want = [], set()
        for k, (_, kind) in enumerate(events):
            if kind == 0:
                stack.append(k)
            elif stack:
                want.add((stack.pop(), k))
        got, left, numbers = set(), {}, []
        for part, (lo, hi) in enumerate(zip([0, *cuts], [*cuts, len(events)])):
            slots, pieces = [], []
            for k in range(lo, hi):
                if events[k][1] == 0:
                    slots.append(k)
                elif slots:
                    got.add((slots.pop(), k))
                else:
                    pieces.append(k)
            left[part] = slots, pieces
            numbers.append((part, len(pieces), len(slots)))
        plan = packing.exchange(numbers)
        for part, (_, pieces) in left.items():
            own = [i for i in range(len(plan.part)) if plan.part[i] == part]
            for at in range(plan.met[part]):
                i = max(i for i in own if plan.first[i] <= at)
                got.add((left[plan.source[i]][0][plan.top[i] - (at - plan.first[i])], pieces[at]))
        assert got == want
        assert all(plan.low[part] == sum(k not in {a for a, _ in want} for k in slots) for part, (slots, _) in left.items())


SCRAPS = ["a", "the", " ", "  ", "\n", "'s", "'re", "é", "12", "!", "?? ", SPECIAL, "日本", "　", "😀", "'", " x", "\r\n", "…"]


def test_edits_and_ids_agree_with_the_tokenizer():
    from tokenizers import Tokenizer

    rng, encoder, count = random.Random(3), Encoder(), editcount.Counter()
    plain = Tokenizer.from_file(encoder.json_file)
    ids = lambda t: plain.encode(t, add_special_tokens=False).ids
    for k in range(600):
        t = "".join(rng.choice(SCRAPS) for _ in range(rng.randrange(30)))
        if k % 3:
            t = t.replace(SPECIAL, "")
        assert list(encoder.ids(t)) == ids(t)
        edits = [(p, rng.randrange(5), "".join(rng.choice(SCRAPS) for _ in range(rng.randrange(3)))) for p in rng.sample(range(len(t) + 1), min(3, len(t) + 1))]
        before, after, _, new = editcount.apply_edits(t, edits, count)
        assert (before, after) == (len(ids(t)), len(ids(new)))


def test_recount_cases(spark):
    rows = [(1, None, None), (2, "", [(0, 0, "new words")]), (3, "some text here", [(5, 4, None)]), (3, "some text here", []), (4, "word " * 50000, [(100, 3, "x")])]
    df = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<pos: int, gone: int, put: string>>")
    got = editcount.recount(df).collect()
    encoder = Encoder()
    assert [(r["doc_id"], r["n_tokens"], r["n_tokens_edited"]) for r in got[:4]] == [(1, 0, 0), (2, 0, len(encoder.ids("new words"))), (3, 3, len(encoder.ids("some  here"))), (3, 3, 3)]
    assert got[4]["n_pretokens_encoded"] < 10


def test_mixture_reaches_targets(spark):
    rng = random.Random(4)
    rows = [(i, " ".join("w" * rng.randrange(5, 60)), None, f"s{i % 4}" if i % 9 else None) for i in range(900)]
    rows += [(1000, None, None, "tiny"), (1001, "one two", None, "tiny"), (1001, "one two", None, "tiny"), (None, "", None, "s0")]
    got = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows) and all(0 <= r["copies"] <= 3 for r in got)
    assert sum({r["source"]: r["source_size"] for r in got}.values()) == pytest.approx(sum({r["source"]: r["target"] for r in got}.values()))
    for s in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == s]
        assert sum(r["size"] for r in own) == own[0]["source_size"] and own[0]["target"] <= 3 * own[0]["source_size"] + 1e-6
        assert abs(sum(r["size"] * r["copies"] for r in own) - own[0]["target"]) <= 30
    key = lambda rs: sorted((str(r["doc_id"]), r["copies"]) for r in rs)
    assert key(got) == key(mixing.mix(spark.createDataFrame(rows, DOCS).repartition(5)).collect())
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0


def test_quality_separates_marked_texts(spark):
    rng = random.Random(5)
    good = lambda: " ".join("abcdefgh"[: rng.randrange(2, 8)] + rng.choice("xyz") for _ in range(60)) + "."
    rows = [(i, good() if i % 3 else good().upper().replace(" ", "!! "), None, None) for i in range(400)] + [(400, None, None, None), (401, "", None, None), (402, "x", None, None)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)] + [(1, None)], "doc_id long, quality int")
    stats = quality.statistics(spark.createDataFrame(rows, DOCS))
    got = {r["doc_id"]: r for r in quality.score(stats, quality.learn(stats, labels)).collect()}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values()) and len(got) == 403
    assert all(got[i]["predicted"] == int(i % 3 > 0) for i in range(300, 400))
    none = quality.learn(stats, labels.limit(0))
    assert none.rules == () and quality.score(stats, none).count() == 403


def test_media_round_trip():
    for text in ("", "abc", "é" * 500, "x" * 192):
        p = media.pad(text.encode())
        assert len(p) % 192 == 0 and len(p) > 0
        assert media.decode_png(media.encode_png(p)) == p
    with pytest.raises(ValueError):
        media.decode_png(b"nothing")
    broken = bytearray(media.encode_png(media.pad(b"abc")))
    broken[-20] ^= 1
    with pytest.raises(ValueError):
        media.decode_png(bytes(broken))


def test_items_keep_order_and_captions():
    html = "<h1>T</h1><p>one <b>two</b><script>no()</script></p><figure><img src='a' alt='x'><figcaption>cap <i>it</i></figcaption></figure><p>three<img src=b><p>end &amp; out"
    assert media.read_html(html) == [["text", "T", None, None], ["text", "one two", None, None], ["media", None, "a", "cap it"], ["text", "three", None, None], ["media", None, "b", None], ["text", "end & out", None, None]]
    assert media.read_html(None) == media.read_html("") == []
    assert media.read_html("<p>a<figcaption>x")[0][1] == "a"


def test_interleave_resolves_digests(spark, tmp_path):
    docs = spark.createDataFrame([(1, "same", None, None), (2, "same", None, None), (3, None, None, None), (None, "other", None, None)], DOCS)
    pages, stored = media.documents_as_pages(docs, Scratch(spark))
    pages = pages.unionByName(spark.createDataFrame([(9, 0, "<img src='http://x'><img src='sha256:00'>")], "doc_id long, n_bytes long, html string"))
    got = media.interleave(pages, media.describe(stored), "doc_id").where("kind = 'media'").collect()
    assert len(got) == 6 and sum(r["feature"] is None for r in got) == 2
    one, two = (next(r for r in got if r["doc_id"] == i) for i in (1, 2))
    assert one["payload_sha256"] == two["payload_sha256"] == one["digest"] and one["caption"] == "4 bytes"


def test_calls_are_linked_ordered_and_validated(spark):
    schemas = {"f": {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer", "minimum": 1}}, "additionalProperties": False}}
    calls = '[{"id":"b","name":"f","arguments":{"x":"$call:a"}},{"id":"a","name":"f","arguments":"{\\"x\\":2}"},{"id":"c","name":"g","arguments":{}}]'
    cycle = '[{"id":"p","name":"f","arguments":{"x":"$call:q"}},{"id":"q","name":"f","arguments":{"x":"$call:p"}}]'
    rows = [(1, 0, "assistant", "hi", calls, "z"), (1, 1, None, None, None, "z"), (1, 1, None, None, None, "z"), (2, 0, "assistant", "é", cycle, "z"), (3, 0, "user", "x", "{broken", "z")]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, tool_calls string, json string")
    results = spark.createDataFrame([("a", "2", 1), ("a", "1", 1), ("zz", "9", 1), (None, "9", 1)], "call_id string, content string, turn int")
    got = sorted(toolcalls.format_chat(messages, results, schemas).collect(), key=lambda r: (r["conv_id"], r["turn"]))
    assert [(r["n_calls"], r["n_linked"], r["n_valid"]) for r in got] == [(3, 1, 1), (0, 0, 0), (0, 0, 0), (2, 0, 0), (0, 0, 0)]
    assert got[0]["json"].index('"id":"a"') < got[0]["json"].index('"id":"b"') and '"result":"1"' in got[0]["json"]
    assert "waits for itself" in got[3]["json"] and "unreadable_calls" in got[4]["json"] and "é" in got[3]["json"]
    assert toolcalls.format_chat(messages.limit(0), results, schemas).count() == 0


def test_calls_in_odd_json_are_kept_as_text(spark):
    deep = "[" * 5000 + "]" * 5000
    odd = [f'[{{"id":"a","name":"f","arguments":{a}}}]' for a in (deep, "[" * 300 + "]" * 300, "NaN", "-Infinity", "1e999", '"\\ud800"', "{")] + ['[{"id":"\\ud800","name":"f"}]', deep]
    rows = [(k, 0, "user", "x", raw) for k, raw in enumerate(odd)] + [(50, 0, "user", None, '[{"id":"\\ud83d\\ude00","name":"f","arguments":"[1"}]')]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, tool_calls string")
    results = spark.createDataFrame([("😀", "1")], "call_id string, content string")
    schema = {"f": {"type": ["string", "null"]}}
    got = {r["conv_id"]: r for r in toolcalls.format_chat(messages, results, schema).collect()}
    assert len(got) == len(rows)
    for k in range(len(odd)):
        assert got[k]["n_calls"] == 0 and json.loads(got[k]["json"])["unreadable_calls"] == odd[k]
    assert tuple(got[50])[3:6] == (1, 1, 1)
    assert toolcalls.problems(True, {"type": "integer"}) and not toolcalls.problems(None, {"type": ["integer", "null"]})


def brute_targets(sizes, cap=3):
    """Water-filling by bisection on the common level."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    low, high = 0.0, 1e12
    for _ in range(300):
        mid = (low + high) / 2
        if sum(min(cap * sizes[s], mid * weight[s]) for s in sizes) < sum(sizes.values()):
            low = mid
        else:
            high = mid
    return {s: min(cap * sizes[s], high * weight[s]) for s in sizes}


def test_targets_and_dual_agree_with_bisection(spark):
    rng = random.Random(8)
    for sizes in ({"a": 100, "b": 5, "c": 900, None: 50, "é": 7, "Z": 1}, {"x": 10}, {"x": 0, "y": 30}, {f"s{k}": rng.randrange(1, 10**6) for k in range(20)}):
        got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        want = brute_targets(sizes)
        assert {r["source"] for r in got} == set(sizes)
        assert all(r["target"] == pytest.approx(want[r["source"]], rel=1e-9, abs=1e-9) for r in got)
    docs = {s: [rng.randrange(1, 400) for _ in range(80)] for s in "abc"}
    hist = [(s, n, v.count(n)) for s, v in docs.items() for n in set(v)]
    total = {s: sum(v) for s, v in docs.items()}
    goals = [(s, total[s], t) for s, t in zip("abc", (0.3 * total["a"], 1.4 * total["b"], 2.9 * total["c"]))]
    rows = mixing.solve(spark.createDataFrame(hist, "source string, size long, n long"), spark.createDataFrame(goals, "source string, source_size long, target double"), Scratch(spark)).collect()
    for r in rows:
        have = sum(x * min(3.0, np.exp(min(50, r["lam"] * x / r["mean"]))) for x in docs[r["source"]])
        assert have == pytest.approx(r["target"], rel=1e-6)


def test_image_and_feature_agree_with_a_plain_reading():
    for size in (0, 5, 192, 193, 3000):
        p = media.pad(bytes(random.Random(size).randrange(256) for _ in range(size)))
        png = media.encode_png(p)
        body, at = b"", 8
        while at < len(png):
            n = int.from_bytes(png[at : at + 4], "big")
            body += png[at + 8 : at + 8 + n] if png[at + 4 : at + 8] == b"IDAT" else b""
            at += 12 + n
        raw = zlib.decompress(body)
        rows = [raw[k + 1 : k + 193] for k in range(0, len(raw), 193)]
        assert b"".join(rows) == p and media.decode_png(png) == p
        mean = [sum(p[c::3]) / (len(p) // 3) for c in range(3)]
        assert media.feature(p).startswith(f"64x{len(rows)} rgb=" + ",".join(f"{m:.3f}" for m in mean))


def test_rules_agree_with_a_plain_reading(spark):
    rng = np.random.default_rng(9)
    x = rng.random((300, len(quality.STATISTICS)))
    y = ((x[:, 1] > 0.5) & (x[:, 4] <= 0.6)).astype(float)
    model = quality.fit(x, y)
    assert model.rules
    rows = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "doc_id long, " + ", ".join(f"{c} double" for c in quality.STATISTICS))
    got = {r["doc_id"]: r["score"] for r in quality.score(rows, model).collect()}
    for i, v in enumerate(x):
        z = model.bias + sum(w for r, w in zip(model.rules, model.weights) if all(v[k] <= b if most else v[k] > b for k, most, b in r))
        assert got[i] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-12)
    assert np.mean([(got[i] >= 0.5) == bool(y[i]) for i in range(300)]) > 0.95
