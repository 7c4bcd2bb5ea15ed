import hashlib
import random
import struct
import zlib
from io import BytesIO

import numpy as np
import pytest
from parity import compare

from casebook.llm import byte_bpe, op01_toxicity as tox, op02_warc as warc, op03_topk as topk, op04_line_dedup as lines, op05_bpe as bpe, op06_decontam as decon, op07_chat as chat, op08_license as lic, op09_minhash as near, op10_records as rec, textblock as tb
from casebook.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
SPECIAL = "<|endoftext|>"
DOCS = "doc_id bigint, text string, score string, n_lines string, passages string, drop string"
ODD = [None, "", " ", "\n\n", "one\ntwo", "it's 12 o'clock\t  now", f"a{SPECIAL} b", "é漢😀", "x" * 30_000, "same line of text\nother", "same line of text\nother"]


def docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "clash", "clash", "clash", "clash") for i, t in zip(ids, texts)], DOCS)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(byte_bpe.default_path())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql_twin(spark, name):
    compare(spark, name, QUERIES[name], ORACLE_SQL[name], SF)


def test_pieces_equal_the_library(tokenizer):
    random.seed(5)
    signs = "ab1 ''  \n\t.é,½²streveldm\x1c漢\U0001f600"
    texts = ["".join(random.choices(signs, k=random.randint(0, 14))) for _ in range(5000)] + [f"a{SPECIAL}'s", SPECIAL * 2, "'s'll're"]
    texts += ["a" + chr(c) + "1 " + chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    h, begin, end, first, joined = tb.byte_bpe_pieces(texts, SPECIAL)
    words, slot = tb.distinct_pieces(h, begin, end, joined, SPECIAL)
    own = byte_bpe.codec(byte_bpe.default_path())
    ids = [own.ids_of(w) for w in words]
    for i, want in enumerate(tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert [x for k in slot[first[i] : first[i + 1]] for x in ids[k]] == want.ids, texts[i]


def test_bpe_and_records_round_trip(spark, tokenizer):
    table = docs(spark, ODD, [5, 4, None, 7, 7, 1, 2, 3, 9, 10, 10])
    got = sorted(map(str, bpe.encode_decode(table).collect()))
    want = []
    for i, t in zip([5, 4, None, 7, 7, 1, 2, 3, 9, 10, 10], ODD):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False))))
    assert got == sorted(f"Row(doc_id={a}, n_tokens={b}, ids_sha256='{c}', decoded_sha256='{d}')" for a, b, c, d in want)
    start = 0
    rows = sorted(rec.records_digest(table).collect(), key=lambda r: r.start)
    order = sorted(zip([5, 4, None, 7, 7, 1, 2, 3, 9, 10, 10], ODD), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
    for r, (i, t) in zip(rows, order, strict=True):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4")))
        start += len(ids)
    assert bpe.encode_decode(table.limit(0)).count() == 0 and rec.records_digest(table.limit(0)).count() == 0


def test_damaged_record_is_refused():
    good = rec.frame(b"abc")
    assert rec.unframe(BytesIO(good)) == b"abc" and rec.unframe(BytesIO(b"")) is None
    for k in range(len(good)):
        with pytest.raises((ValueError, struct.error)):
            rec.unframe(BytesIO(good[:k] + bytes([good[k] ^ 1]) + good[k + 1 :]))


def test_line_dedup_odd_rows(spark):
    ids = [*range(len(ODD) - 1), None]
    got = {r.doc_id: r for r in lines.dedup_lines(docs(spark, [*ODD[:-1], ODD[-1]], ids)).collect()}
    assert got[9].n_dropped == 0 and got[None].n_dropped == 0 and got[0].text == "" and got[0].n_lines == 1 and got[3].n_lines == 3
    twice = docs(spark, ["A shared line\nx", "a shared LINE \ny\na shared line", "own"], [3, 4, 4])
    rows = {(r.doc_id, r.text, r.n_dropped) for r in lines.dedup_lines(twice).collect()}
    assert rows == {(3, "A shared line\nx", 0), (4, "y", 2), (4, "own", 0)}
    assert lines.dedup_lines(twice.limit(0)).count() == 0
    three = {(r.doc_id, r.n_dropped) for r in lines.dedup_lines(twice, min_docs=3).collect()}
    assert three == {(3, 0), (4, 0)}


def test_chat_reads_back_hostile_texts(spark):
    random.seed(2)
    texts = ["".join(random.choices(["<|", "|>", "<", "|", "\\", "\n", "im_start", "<|im_end|>\n", "a", "n"], k=random.randint(0, 9))) for _ in range(300)] + [None, ""]
    rows = spark.createDataFrame([(i % 40, i, random.choice(["user", "assistant", "a\n<|\\n", None]), t, "x") for i, t in enumerate(texts)], "conv_id bigint, turn bigint, role string, text string, formatted string")
    out = chat.format_chats(rows)
    back = out.select("conv_id", chat.read_chats(out.formatted).alias("t")).collect()
    want = {}
    for r in sorted(rows.collect(), key=lambda r: r.turn):
        want.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    assert {r.conv_id: [tuple(t) for t in r.t] for r in back} == want
    assert chat.chat_digests(rows.limit(0)).count() == 0


def test_warc_chunks_and_revisits(spark):
    pages = spark.createDataFrame([(3, "http://a/\n b", "p" * 5000, 1), (1, None, "p" * 5000, 1), (2, "u", None, 1), (4, "u", "", 1), (None, "u", "p" * 5000, 1), (6, "u", "é<>\r\n\r\nWARC/1.1", 1), (6, "u", "é<>\r\n\r\nWARC/1.1", 1)], "page_id bigint, url string, html string, chunk_no int")
    manifest = warc.write_warc(pages, chunk_bytes=512)
    rows = warc.read_warc(manifest, 512).collect()
    last = sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in rows if r.last)
    assert last == sorted([("1", 5000, "response", None), ("3", 5000, "revisit", 1), ("2", 0, "response", None), ("4", 0, "revisit", 2), ("None", 5000, "response", None), ("6", 16, "response", None), ("6", 16, "response", None)])
    parts = sorted((r.chunk_no, bytes(r.chunk)) for r in rows if r.page_id == 1)
    assert b"".join(p for _, p in parts) == b"p" * 5000 and len(parts) == 10
    assert warc.read_warc(warc.write_warc(pages.limit(0))).count() == 0


def test_topk_against_all_pairs(spark):
    g = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in (g.normal(size=8) if i % 3 else np.ones(8))], 0) for i in range(700)]
    vectors += [(700, None, 0), (701, [1.0, None], 0), (702, [float("nan")] * 8, 0), (720, [0.5, 0.25], 0), (None, [1.0] * 8, 0)]
    got = {(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>, rank int")).collect()}
    ok = {i: np.pad(np.floor(64 * np.array(v)).astype(int), (0, 8 - len(v))) for i, v, _ in vectors[:700] + vectors[703:704]}
    want = set()
    for q in (i for i in ok if i % 20 == 0):
        best = sorted((-int(ok[q] @ ok[c]), c) for c in ok if c != q)[:20]
        want |= {(q, n + 1, c, -s) for n, (s, c) in enumerate(best)}
    assert got == want


def test_segments_against_brute_force():
    random.seed(3)
    for _ in range(300):
        s = np.array([random.choice([-2.0, -1.0, 0.5, 1.0, 3.0]) for _ in range(random.randint(0, 12))])
        found = tox.segments(s)
        sums = np.concatenate([[0], np.cumsum(s)])

        def split(a, b):  # the greatest segment, then the same left and right of it
            pairs = [(sums[j] - sums[i], i, j) for i in range(a, b) for j in range(i + 1, b + 1)]
            if not pairs or max(pairs)[0] <= 0:
                return []
            top = max(p[0] for p in pairs)
            _, i, j = min((p for p in pairs if p[0] == top), key=lambda p: (p[1], p[2] - p[1]))
            return split(a, i) + [top] + split(j, b)

        assert abs(max((x for _, _, x in found), default=0) - max(split(0, len(s)), default=0)) < 1e-9
        assert all(a < b and x > 0 for a, b, x in found) and all(p[1] <= q[0] for p, q in zip(found, found[1:]))


def test_toxicity_held_out_accuracy_and_odd_rows(spark):
    random.seed(4)
    clean = [f"w{i}" for i in range(300)]
    texts, labels = [], []
    for i in range(600):
        words = random.choices(clean, k=60)
        if i % 5 == 0:
            for w in random.sample(["vileness", "vilest", "scummy", "rotter"], 3):
                words.insert(random.randrange(60), w)
        texts.append(" ".join(words)), labels.append((i, int(i % 5 == 0)))
    table = docs(spark, [*texts, None, ""], [*range(600), None, 601])
    y = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id bigint, toxic int")
    model = tox.fit(table, y)
    got = {r.doc_id: r for r in tox.score_documents(table, model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out for i in held) and np.mean([got[i].predicted == (i % 5 == 0) for i in held]) > 0.97
    assert got[601].predicted == 0 and not got[None].held_out and got[0].passages
    none = tox.fit(table, y.limit(0))
    assert all(r.predicted == 0 for r in tox.score_documents(table, none).collect())
    assert tox.score_documents(table.limit(0), model).count() == 0


def test_decontamination_templates(spark):
    item = "a train leaves at 45 miles per hour while we see that Anna walks 12 miles to the old town and then Anna rests for two hours before the long way home"
    other = item.replace("45", "60").replace("Anna", "Bertha").replace("12", "7")
    broken = item.replace("that Anna walks", "that Carla walks")
    noise = " ".join(f"word{chr(97 + i % 26)}{i}" for i in range(60))
    table = docs(spark, [f"{noise} {item} {noise}", f"{noise}. {other}", noise, None, "", item[:40]])
    got = {(r.doc_id, r.item_id): r.kind for r in decon.contaminated(table, spark.createDataFrame([(1, item), (2, None), (3, "short")], "item_id bigint, text string")).collect()}
    assert got == {(0, 1): "exact", (1, 1): "template"}
    crossed = decon.contaminated(docs(spark, [broken]), spark.createDataFrame([(1, item)], "item_id bigint, text string")).collect()
    assert not crossed
    assert decon.contaminated(table, spark.createDataFrame([], "item_id bigint, text string")).count() == 0


def test_license_whole_texts_and_notices(spark):
    text = "Copyright (c) 2020 Someone\n" + lic.LICENSES["MIT"].replace("license", "licence").upper()
    rows = {r.doc_id: (r.license_id, r.n_notices, r.notices) for r in lic.scan(docs(spark, [text, "x\nreleased under the mit licence!\ny", None, "", "plain"])).collect()}
    assert rows == {0: ("MIT", 0, ""), 1: (None, 1, "MIT"), 2: (None, 0, ""), 3: (None, 0, ""), 4: (None, 0, "")}


def test_near_duplicates_against_all_pairs(spark):
    random.seed(6)
    vocab = [f"v{i}" for i in range(400)]
    base = [" ".join(random.choices(vocab, k=80)) for _ in range(12)]
    texts = []
    for b in base:
        texts.append(b)
        for n in (0, 1, 1, 2, 3, 6):
            words = b.split()
            for _ in range(n):
                words[random.randrange(80)] = random.choice(vocab)
            texts.append(" ".join(words))
    texts += [None, "", "!!", "one two", "One, two!"]
    table = docs(spark, texts)
    got = {r.doc_id: r.class_id for r in near.near_duplicates(table).collect()}
    idf = near.document_frequency(table)
    sets = [next(iter(near.shingles(tb.Words([t]), idf))) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i][0]) and near.jaccard(sets[i], sets[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert got == dict(enumerate(root))
    assert near.keep_one(table).count() == len(set(root)) and near.near_duplicates(table.limit(0)).count() == 0
    same_id = near.near_duplicates(docs(spark, [base[0], base[1], base[0]], [1, 1, 2])).collect()
    assert {r.doc_id: r.class_id for r in same_id} == {1: 1, 2: 1}
