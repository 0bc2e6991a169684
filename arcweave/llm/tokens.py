"""Encoding of whole texts with public tokenizer files; ids are those of the tokenizers library's plain call, whatever the text.

A BPE tokenizer never merges over a pre-token's edge. Where a tokenizer drops white space, a text may be cut there, each distinct chunk
encoded once while it is held, and the ids put together again: Arrow cuts a slice's texts and numbers their distinct chunks; those that
are not held yet go to the tokenizer's BPE model, pre-token by pre-token, if they are plain, and else through its whole chain. Byte-level
BPE keeps white space; its texts are encoded by the ranks of the same vocabulary.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Letters and signs of the Latin blocks: composed already, lower-cased to one letter each. Other chunks go through the whole tokenizer.
PLAIN = "^[!-;=-~\\x{a1}-\\x{12f}\\x{131}-\\x{24f}]*$"
#: Fixed value: the pre-tokens of the word tokenizer.
PRE_TOKENS = r"('s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+)"
EDGE = "\x01"  # in no plain chunk


def byte_letters() -> dict[int, str]:
    """Byte-level BPE writes bytes as letters: printable Latin-1 signs stand for themselves, the rest follow from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(0x100 + i) for i, b in enumerate(hidden)}


class ChunkEncoder:
    """For tokenizers that lower-case texts and drop white space, with byte letters."""

    def __init__(self, path: str, most_chunks: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.most_chunks = most_chunks
        self.known: dict[str, int] = {}
        self.flat, self.counts, self.hits = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _gathered(self, at: np.ndarray, flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the entries `at`, one after the other, and how many each has."""
        own = counts[at]
        ends = np.cumsum(own)
        return flat[np.repeat((np.cumsum(counts) - counts)[at] - ends + own, own) + np.arange(ends[-1] if len(ends) else 0)], own

    @staticmethod
    def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(counts.sum())), counts

    def _encode_pre_tokens(self, cut: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        names, letters, tokenize = cut.to_pylist(), self.letters, self.model.tokenize
        for i in np.flatnonzero(~pc.string_is_ascii(cut).to_numpy(zero_copy_only=False)).tolist():
            names[i] = names[i].encode().decode("latin-1").translate(letters)
        return self._flat([[x.id for x in tokenize(t)] for t in names])

    def _encode_plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.split_pattern(pc.replace_substring_regex(texts, PRE_TOKENS, f"\\1{EDGE}"), EDGE)
        cut = lists.flatten().dictionary_encode()
        flat, own = self._gathered(cut.indices.to_numpy(), *self._encode_pre_tokens(cut.dictionary))
        return flat, np.diff(np.concatenate([[0], np.cumsum(own)])[lists.offsets.to_numpy()])

    def _merged(self, first: np.ndarray, some: tuple, others: tuple) -> tuple[np.ndarray, np.ndarray]:
        """Two encodings put together again: those where `first` is true are in `some`."""
        order = np.empty(len(first), np.int64)
        order[first], order[~first] = np.arange(len(some[1])), len(some[1]) + np.arange(len(others[1]))
        return self._gathered(order, *(np.concatenate(x) for x in zip(some, others, strict=True)))

    def _encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = pc.match_substring_regex(held := pa.array(chunks, pa.string()), PLAIN).to_numpy(zero_copy_only=False)
        known = pc.filter(pc.utf8_lower(held), plain)
        letters = pc.utf8_is_alpha(known).to_numpy(zero_copy_only=False)
        done = self._merged(letters, self._encode_pre_tokens(pc.filter(known, letters)), self._encode_plain(pc.filter(known, ~letters)))
        if plain.all():
            return done
        return self._merged(plain, done, self._flat(self._ids([x for x, p in zip(chunks, plain, strict=True) if not p])))

    def _learn(self, chunks: list[str]) -> None:
        flat, counts = self._encode_chunks(chunks)
        self.known.update(zip(chunks, range(len(self.counts), len(self.counts) + len(chunks)), strict=True))
        self.flat, self.counts = np.concatenate([self.flat, flat]), np.concatenate([self.counts, counts])
        self.hits = np.concatenate([self.hits, np.zeros(len(chunks), np.int64)])

    def _shrink(self) -> None:
        """Keeps the half that was used most; the rest is encoded again when it comes up."""
        order = np.argsort(-self.hits, kind="stable")[: self.most_chunks // 2]
        names = list(self.known)
        self.known = {names[i]: k for k, i in enumerate(order.tolist())}
        self.flat, self.counts = self._gathered(order, self.flat, self.counts)
        self.hits = self.hits[order] // 2

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as views of one array."""
        if not texts:
            return []
        lists = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.string()), "\n", " "), " ")
        chunks, sizes = lists.flatten().dictionary_encode(), np.diff(lists.offsets.to_numpy())
        names = chunks.dictionary.to_pylist()
        if len(self.known) + len(names) > self.most_chunks:
            self._shrink()
        if fresh := [x for x in names if x not in self.known]:
            self._learn(fresh)
        at = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))
        own = chunks.indices.to_numpy()
        self.hits[at] += np.bincount(own, minlength=len(names))
        ids, counts = self._gathered(at[own], self.flat, self.counts)
        ends = np.cumsum(counts)
        stops = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]
        return [ids[a:b] for a, b in zip(stops[:-1], stops[1:], strict=True)]


class RankEncoder:
    """Ids of a byte-level BPE tokenizer by its vocabulary's ranks, which take a fraction of the time. It is for texts of the Latin blocks, whose
    classes all libraries share, without very long words; other texts go through the tokenizer itself."""

    #: Latin blocks and general punctuation; no special tokens, no run of 400 characters without white space.
    USUAL = "^[\\x00-\\x{24f}\\x{2010}-\\x{2027}\\x{2030}-\\x{205e}\\x{20ac}]*$"
    UNUSUAL = "<\\||[\\x1c-\\x1f\\x{85}]|\\S{400}"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        byte_of = {x: b for b, x in byte_letters().items()} | {chr(b): b for b in range(256) if b not in byte_letters()}
        special = {i for i, x in self.tokenizer.get_added_tokens_decoder().items() if x.special}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in self.tokenizer.get_vocab().items() if i not in special}
        self.ranks = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        held = pa.array(texts, pa.string())
        usual = pc.and_not(pc.match_substring_regex(held, self.USUAL), pc.match_substring_regex(held, self.UNUSUAL)).to_pylist()
        return [np.array(self.ranks.encode_ordinary(x) if ok else self.tokenizer.encode(x, add_special_tokens=False).ids, np.uint32) for x, ok in zip(texts, usual, strict=True)]


_ENCODERS: dict[tuple, ChunkEncoder | RankEncoder] = {}


def encoder(path: str, keep_space: bool) -> ChunkEncoder | RankEncoder:
    """One encoder for each Python worker, which serves many tasks."""
    if (path, keep_space) not in _ENCODERS:
        _ENCODERS[path, keep_space] = RankEncoder(path) if keep_space else ChunkEncoder(path)
    return _ENCODERS[path, keep_space]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
