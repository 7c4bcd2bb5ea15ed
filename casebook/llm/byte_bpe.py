"""Byte-level BPE with the ``tokenizers`` library, a distinct piece at a time."""

from __future__ import annotations

import json
import os
from functools import lru_cache
from itertools import chain

import numpy as np

from casebook.llm import textblock as tb

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(1)
def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary: itself, or the next from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in own else next(spare)) for b in range(256)]


#: What a tokenizer file must say for ``textblock.byte_bpe_pieces`` to split as it does.
EXPECTED = {
    "normalizer": {"": None},
    "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True},
    "decoder": {"type": "ByteLevel"},
    "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False},
}
SPECIAL_FLAGS = ("single_word", "lstrip", "rstrip", "normalized")


def checked(spec: dict) -> None:
    """ValueError where a tokenizer file asks for what this module does not do."""
    for part, wants in EXPECTED.items():
        own = spec.get(part) or {}
        for name, want in wants.items():
            if (own.get(name) if name else spec.get(part)) != want:
                raise ValueError(f"{part} {name or own}: {own.get(name)!r} where {want!r} is expected")
    added = spec.get("added_tokens", [])
    if len(added) != 1 or any(added[0].get(f) for f in SPECIAL_FLAGS):
        raise ValueError("exactly one added token, matched as it stands, is expected")


class Codec:
    """The tokenizer of one file; ``ids_of`` gives a piece's ids, ``pieces`` every id's bytes. A file that splits, or
    normalises, otherwise than ``EXPECTED`` is refused."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        checked(json.loads(self.tokenizer.to_str()))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self._letters = dict(enumerate(_byte_letters()))

    @property
    def special_text(self) -> str:
        return next(iter(self.special))

    def ids_of(self, piece: str) -> list[int]:
        if piece in self.special:
            return [self.special[piece]]
        return [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self._letters))]

    @lru_cache(1)
    def pieces(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The id-to-piece table: all bytes one after the other, where each id's start, and how many it has."""
        back = {c: b for b, c in enumerate(_byte_letters())}
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        table = [b""] * (max(vocab.values()) + 1)
        for text, i in vocab.items():
            table[i] = text.encode() if text in self.special else bytes(back[c] for c in text)
        size = np.fromiter(map(len, table), np.int64, len(table))
        return np.frombuffer(b"".join(table), np.uint8), np.cumsum(size) - size, size

    @lru_cache(1)
    def numerals(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every id in decimal with a comma behind it, laid out as ``pieces`` is."""
        table = [f"{i},".encode() for i in range(len(self.pieces()[1]))]
        size = np.fromiter(map(len, table), np.int64, len(table))
        return np.frombuffer(b"".join(table), np.uint8), np.cumsum(size) - size, size

    @staticmethod
    def spelled(ids: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray], step: int = 65536):
        """Bytes of all ids by a table, in parts of ``step`` ids."""
        flat, first, size = table
        for k in range(0, len(ids), step):
            part = ids[k : k + step]
            yield tb.ragged(flat, first[part], size[part]).tobytes()


class SeenPieces:
    """Ids of the pieces met so far, found by their hashes without a Python object for each: sorted first hashes, the
    second ones (both must agree), and where each piece's ids lie. At most ``limit`` pieces are remembered; further
    ones are encoded again with every batch that holds them."""

    def __init__(self, own: Codec, limit: int):
        self.own, self.limit = own, limit
        self.key, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.head, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def ids(self, hashes: np.ndarray, begin: np.ndarray, end: np.ndarray, joined: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A table of ids, and for each piece of ``textblock.byte_bpe_pieces`` where its ids start there and how many."""
        key, where, slot = np.unique(hashes[0], return_index=True, return_inverse=True)
        check, slot = hashes[1][where], slot.reshape(-1)
        if not (check[slot] == hashes[1]).all():  # two pieces share the first hash: go by the pieces themselves
            words, slot = tb.distinct_pieces(hashes, begin, end, joined, self.own.special_text)
            flat, size = self._encoded(words)
            return flat, (np.cumsum(size) - size)[slot], size[slot]
        place = np.searchsorted(self.key, key)
        near = np.minimum(place, len(self.key) - 1)
        taken = self.key[near] == key if len(self.key) else np.zeros(len(key), bool)
        known = taken.copy()
        known[taken] = self.check[near[taken]] == check[taken]
        new = np.flatnonzero(~known)
        blank = key[new] == tb.special_hash()
        spans = zip(begin[where[new]].tolist(), end[where[new]].tolist(), blank.tolist())
        flat, size_new = self._encoded([self.own.special_text if s else joined[b:e] for b, e, s in spans])
        head, size = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
        head[known], size[known] = self.head[near[known]], self.size[near[known]]
        ends = np.cumsum(size_new)
        head[new], size[new] = len(self.flat) + ends - size_new, size_new
        table = np.concatenate([self.flat, flat])
        self._remember(table, new[~taken[new]][: max(0, self.limit - len(self.key))], place, key, check, head, size)
        return table, head[slot], size[slot]

    def _remember(self, table, fresh, place, key, check, head, size) -> None:
        if len(fresh):
            at = place[fresh]
            self.flat = table[: int((head[fresh] + size[fresh]).max())]
            self.key, self.check = np.insert(self.key, at, key[fresh]), np.insert(self.check, at, check[fresh])
            self.head, self.size = np.insert(self.head, at, head[fresh]), np.insert(self.size, at, size[fresh])

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        rows = list(map(self.own.ids_of, words))
        size = np.fromiter(map(len, rows), np.int64, len(rows))
        return np.fromiter(chain.from_iterable(rows), np.uint32, int(size.sum())), size


@lru_cache(4)
def codec(path: str) -> Codec:
    """One codec per process and file."""
    return Codec(path)
