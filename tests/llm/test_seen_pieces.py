"""op10's memory of pieces: what it has seen costs no Python object, and ids are the library's in any case."""

import numpy as np
import pytest
from tokenizers import Tokenizer

from casebook.llm import op10_records, textblock as tb
from casebook.llm.byte_bpe import Codec, SeenPieces, default_path

TEXTS = ["The cat's hat,  the cat's 12 hats\n\n\tand éà 東京 <|endoftext|>", None, "", "\0 a\0b <|endoftext|><|endoftext|> don't  ", " hat the cat ☃☃ x"]


def wanted(texts):
    library = Tokenizer.from_file(default_path())
    return [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def found(seen, texts):
    h, begin, end, first, joined = tb.byte_bpe_pieces(texts, seen.own.special_text)
    table, head, size = seen.ids(h, begin, end, joined)
    return [tb.ragged(table, head[a:b], size[a:b]).tolist() for a, b in zip(first[:-1].tolist(), first[1:].tolist())]


def test_known_pieces_are_found_without_their_text(monkeypatch):
    path = default_path()
    before = [s.tolist() for s in op10_records.encoded(TEXTS, path, 2)]
    assert before == [[*ids, 2] for ids in wanted(TEXTS)]

    def refuse(*_):
        raise AssertionError("a known piece was taken up again")

    monkeypatch.setattr(tb, "distinct_pieces", refuse)
    monkeypatch.setattr(Codec, "ids_of", refuse)
    assert [s.tolist() for s in op10_records.encoded(TEXTS[::-1], path, 2)] == before[::-1]


@pytest.mark.parametrize("limit", [0, 1, 3, 1000])
def test_limit_changes_no_id(limit):
    seen = SeenPieces(Codec(default_path()), limit)
    for k in range(3):
        texts = TEXTS[k:] + [f"{k} more{k} words{k * 7}"] + TEXTS[:k]
        assert found(seen, texts) == wanted(texts)
    assert len(seen.key) <= limit and (np.diff(seen.key.astype(object)) > 0).all()


def test_pieces_that_share_a_first_hash():
    seen = SeenPieces(Codec(default_path()), 1000)
    assert found(seen, TEXTS) == wanted(TEXTS)
    seen.check ^= np.uint64(1)  # now every known piece has another second hash: none may be taken for known
    kept = len(seen.key)
    assert found(seen, TEXTS) == wanted(TEXTS) and len(seen.key) == kept

    h, begin, end, first, joined = tb.byte_bpe_pieces(TEXTS, seen.own.special_text)
    h[0] = np.where(h[0] == tb.special_hash(), h[0], h[0] % np.uint64(3))  # and within one batch
    table, head, size = SeenPieces(seen.own, 1000).ids(h, begin, end, joined)
    assert [tb.ragged(table, head[a:b], size[a:b]).tolist() for a, b in zip(first[:-1].tolist(), first[1:].tolist())] == wanted(TEXTS)
