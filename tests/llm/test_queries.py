"""The registered queries over the smallest tables, held against plain readings of what they promise."""

import hashlib
import json
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from tether.llm import catalog, queries_tokens
from tether.llm.editcount import Counter as Tokens
from tether.llm.editcount import apply_edits
from tether.llm.tokens import Encoder
from tests.llm.test_dedup import brute_near, brute_repeats
from tests.llm.test_text import brute_targets

D = "/root/testdata/sf0.001"


def table(name):
    return pq.read_table(f"{D}/{name}.parquet").to_pylist()


@pytest.fixture(scope="module")
def docs():
    return {r["doc_id"]: r for r in table("documents")}


def run(spark, name):
    return [r.asDict() for r in catalog.queries()[name](spark, D).collect()]


def held(doc_id, mod, rest):
    return zlib.crc32(str(doc_id).encode()) % mod == rest


def size(text):
    return len((text or "").translate({c: 32 for c in range(9, 14)}).split(" ")) - (text or "").translate({c: 32 for c in range(9, 14)}).split(" ").count("")


def check_packing(rows, texts, copies=None):
    """Pieces cover their documents' ids, and sequences are gapless and no longer than 2048."""
    encoder, places, starts = Encoder(), defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.append(encoder.ids(texts[r["doc_id"]] or ""), 0).astype("<u4")
        assert zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        starts[r["doc_id"]].append((r["piece"], r["start"], r["length"], len(ids)))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in starts.values():
        n = sum(p[0] == 0 for p in pieces)
        assert sum(p[2] for p in pieces) == n * pieces[0][3]
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(places) <= -(-sum(r["length"] for r in rows) // 2048) + 1
    return Counter({d: sum(p[0] == 0 for p in pieces) for d, pieces in starts.items()})


def test_op1_op8(spark, docs):
    rows = [(i, r["text"]) for i, r in docs.items()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in run(spark, "op1_minhash_dedup")}
    assert got == {i: (s, c, i == c) for i, (s, c) in brute_near(rows).items()}
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in run(spark, "op8_suffix_dedup")}
    assert got == brute_repeats(rows)


def test_op2_op5(spark, docs):
    got = run(spark, "op2_language_id")
    langs = {r["lang"] for r in docs.values()} | {"und"}
    assert Counter(r["doc_id"] for r in got) == Counter(docs.keys())
    assert all(r["held_out"] == held(r["doc_id"], 4, 2) and r["lang_pred"] in langs and 0 <= r["score"] <= 1 for r in got)
    told = [docs[r["doc_id"]]["lang"] == r["lang_pred"] for r in got if r["held_out"] and docs[r["doc_id"]]["lang"]]
    assert np.mean(told) > 0.9
    got = {r["doc_id"]: r for r in run(spark, "op5_rule_quality")}
    assert set(got) == set(docs)
    assert all(r["held_out"] == held(i, 3, 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for i, r in got.items())
    right = [got[r["doc_id"]]["predicted"] == r["quality"] for r in table("labels") if held(r["doc_id"], 3, 1)]
    assert len({r["score"] for r in got.values()}) > 1 and np.mean(right) > 0.8


def test_op3_op10(spark, docs):
    texts = {i: r["text"] for i, r in docs.items()}
    assert check_packing(run(spark, "op3_best_fit_packing"), texts) == Counter(texts.keys())
    encoder, count = Encoder(), Tokens()
    for r in run(spark, "op10_edit_aware_counts"):
        text = texts[r["doc_id"]] or ""
        edits = [(zlib.crc32(f"{r['doc_id']}:{k}".encode()) % (len(text) + 1), gone, put) for k, (gone, put) in enumerate(queries_tokens.EDITS)]
        assert (r["n_tokens"], r["n_tokens_edited"]) == (len(encoder.ids(text)), len(encoder.ids(apply_edits(text, edits, count)[3])))


def test_op4_op6(spark, docs):
    got = {r["doc_id"]: r for r in run(spark, "op4_entropy_mix")}
    by = defaultdict(int)
    for r in docs.values():
        by[r["source"]] += size(r["text"])
    want, taken = brute_targets(dict(by)), defaultdict(int)
    for i, r in docs.items():
        g = got[i]
        assert g["size"] == size(r["text"]) and g["source_size"] == by[r["source"]] and g["target"] == pytest.approx(want[r["source"]])
        assert 0 <= g["taken"] <= 3 * g["size"]
        taken[r["source"]] += g["taken"]
    assert all(abs(taken[s] - want[s]) <= max(0.05 * want[s], 500) for s in want)
    for r in run(spark, "op6_interleaved_media"):
        data = (docs[r["doc_id"]]["text"] or "").encode()
        payload = data + b" " * (max(1, -(-len(data) // 192)) * 192 - len(data))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r["media_bytes"] > 0 and len(r["media_sha256"]) == 64 and r["feature"]


def test_op7_op9(spark):
    v = {r["vec_id"]: np.array(r["embedding"], float) for r in table("embeddings")}
    ids = sorted(v)
    u = np.stack([v[i] / np.linalg.norm(v[i]) for i in ids])
    near = (u @ u.T >= 0.9) & ~np.eye(len(ids), dtype=bool)
    got = {r["vec_id"]: r["n_links"] for r in run(spark, "op7_int8_embedding_dedup")}
    assert got == {i: int(n) for i, n in zip(ids, near.sum(axis=1))}
    talks, got = table("conversations"), run(spark, "op9_tool_call_chat")
    assert Counter((r["conv_id"], r["turn"], r["role"]) for r in got) == Counter((r["conv_id"], r["turn"], r["role"]) for r in talks)
    for r in got:
        m = json.loads(r["json"])
        assert r["json"] == json.dumps(m, sort_keys=True, separators=(",", ":"), ensure_ascii=False) and r["n_calls"] == 3
        place = {c["id"]: k for k, c in enumerate(m["tool_calls"])}
        for c in m["tool_calls"]:
            assert all(place.get(x[6:], -1) < place[c["id"]] for x in c["arguments"].values() if isinstance(x, str) and x.startswith("$call:"))


def test_pipeline_stage_by_stage(spark, docs, tmp_path):
    frame = spark.read.parquet(f"{D}/documents.parquet")
    names, rows = frame.columns, [r.asDict() for r in frame.collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frame, D)
        path = f"file://{tmp_path}/{k}"
        out.write.parquet(path)
        frame, before = spark.read.parquet(path), rows
        rows = [r.asDict() for r in frame.collect()]
        assert k == 4 or frame.columns == names
        ids = Counter(r["doc_id"] for r in rows)
        if name == "language_id":
            assert all(any(c.isalpha() for c in r["text"] or "") for r in rows)
            assert {r["doc_id"] for r in before if sum(c.isalpha() for c in r["text"] or "") > 20} <= set(ids)
        elif name == "minhash_dedup":
            near = brute_near([(r["doc_id"], r["text"]) for r in before])
            assert set(ids) == {i for i, (_, c) in near.items() if i == c}
        elif name == "suffix_dedup":
            want = brute_repeats([(r["doc_id"], r["text"]) for r in before])
            texts = {r["doc_id"]: r["text"] for r in rows}
            assert set(texts) == {i for i, w in want.items() if w[0] != w[1] or not w[0]}
            whole = [i for i in texts if not any(0x80 <= b for b in texts[i].encode())]
            assert all(hashlib.sha256(texts[i].encode()).hexdigest() == want[i][3] for i in whole)
        elif name == "mixing":
            assert set(ids) <= {r["doc_id"] for r in before} and max(ids.values()) <= 3
        else:
            assert check_packing(rows, {r["doc_id"]: r["text"] for r in before}) == Counter(r["doc_id"] for r in before)
