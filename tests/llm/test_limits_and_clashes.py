"""Sizes, ties, clashing names and foreign files that the operators promise to handle."""

import base64
import hashlib
import json

import numpy as np
import pytest

from casebook.llm import byte_bpe, op02_warc as warc, op03_topk as topk, op04_line_dedup as lines, op07_chat as chat, op09_minhash as near
from casebook.llm.shared import open_out, unused


def test_payload_over_one_chunk_and_files_of_lost_attempts(spark):
    big = "é" * (1 << 20) + "end"
    pages = spark.createDataFrame([(1, "u", big), (2, "u", big), (3, "u", "x")], "page_id bigint, url string, html string").coalesce(1)
    manifest = warc.write_warc(pages)
    folder = manifest.first().path.rpartition("/")[0]
    with open_out(f"{folder}/lost-attempt.warc.gz") as out:
        out.write(b"no archive")
    rows = warc.read_warc(manifest).collect()
    parts = sorted((r.chunk_no, bytes(r.chunk)) for r in rows if r.page_id == 1)
    assert len(parts) == 3 and b"".join(p for _, p in parts) == big.encode()
    last = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in rows if r.last}
    assert last == {1: (len(big.encode()), "response", None), 2: (len(big.encode()), "revisit", 1), 3: (1, "response", None)}
    assert {r.payload_digest for r in rows if r.last and r.page_id < 3} == {base64.b32encode(hashlib.sha1(big.encode()).digest()).decode()}


def test_topk_over_many_cells_and_with_huge_components(spark, monkeypatch):
    g = np.random.default_rng(3)
    rows = [(i, [float(x) for x in g.normal(size=6) * (5 if 300 < i < 420 else 1)]) for i in range(900)] + [(900, [1e30, -1e25, 3.0]), (920, [1e12] * 6), (940, None)]
    for name, value in (("BLOCK", 16), ("QUERY_GROUP", 20), ("BLOCK_GROUP", 100), ("BOUND_GROUP", 4)):
        monkeypatch.setattr(topk, name, value)
    got = {(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    clip = lambda x: min(max(x, topk.LEAST), topk.MOST)
    ok = {i: [clip(int(np.floor(x * 64))) for x in v] + [0] * (6 - len(v)) for i, v in rows if v}
    want = set()
    for q in (i for i in ok if i % 20 == 0):
        best = sorted((-clip(sum(a * b for a, b in zip(ok[q], v))), c) for c, v in ok.items() if c != q)[:20]
        want |= {(q, n + 1, c, -s) for n, (s, c) in enumerate(best)}
    assert got == want


def test_column_names_that_operators_use_themselves(spark):
    names = ["_doc", "_ROW", "_drop", "_lines", "_gone"]
    docs = spark.createDataFrame([(1, "a shared line\nx", *names), (2, "a shared line\ny", *names)], "doc_id bigint, text string, " + ", ".join(f"{n} string" for n in names))
    out = lines.dedup_lines(docs).orderBy("doc_id").collect()
    assert [(r.text, r.n_dropped, *(r[n] for n in names)) for r in out] == [("a shared line\nx", 0, *names), ("y", 1, *names)]
    assert near.keep_one(docs).columns == docs.columns
    assert unused(["_A", "_a_"], "_a", "_a") == ["_a__", "_a___"]


def test_near_duplicates_of_one_leader_in_several_groups(spark, monkeypatch):
    monkeypatch.setattr(near, "GROUP", 3)
    base = " ".join(f"w{i}" for i in range(200))
    texts = [base + f" tail{i}" for i in range(20)] + ["word " * 60_000, "word " * 60_000 + "more", " ".join(f"v{i}" for i in range(200))]
    got = {r.doc_id: r.class_id for r in near.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert got == {i: 0 if i < 20 else 20 if i < 22 else 22 for i in range(23)}


def test_chats_without_an_id_with_equal_turns_and_the_probes_id(spark):
    rows = [(None, 1, "user", "b"), (None, 1, "assistant", "a"), (None, None, "system", "s"), (2, 1, "user", "x"), (2, 1, "user", "x")]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    out = chat.format_chats(table)
    got = {r.conv_id: [tuple(t) for t in r.t] for r in out.select("conv_id", chat.read_chats(out.formatted).alias("t")).collect()}
    assert got == {None: [("system", "s"), ("assistant", "a"), ("user", "b")], 2: [("user", "x"), ("user", "x")]}
    with pytest.raises(Exception, match="conversation -1"):
        chat.chat_digests(chat.with_probe(spark.createDataFrame([(-1, 0, "user", "x")], table.schema))).collect()


@pytest.mark.parametrize("part, change", [("pre_tokenizer", {"type": "Whitespace"}), ("pre_tokenizer", {"add_prefix_space": True}), ("normalizer", {"type": "NFC"}), ("model", {"byte_fallback": True}), ("added_tokens", None)])
def test_other_tokenizer_files_are_refused(part, change):
    with open(byte_bpe.default_path()) as f:
        spec = {k: v for k, v in json.load(f).items()}
    spec["model"] = {k: v for k, v in spec["model"].items() if k not in ("vocab", "merges")}
    byte_bpe.checked(spec)
    spec[part] = [] if change is None else (spec[part] or {}) | change
    with pytest.raises(ValueError):
        byte_bpe.checked(spec)
