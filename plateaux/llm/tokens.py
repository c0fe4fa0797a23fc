"""Byte-level BPE ids of whole documents, from a public vocabulary file of the tokenizers library."""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

#: The vocabulary file is a parameter of every operator; this is its default.
VOCABULARY = "byte_bpe_50k.json"
#: Words that a worker remembers (of late and from before), and the longest of them.
KNOWN, LONGEST = 1 << 18, 64
#: New words that are encoded in one call.
TOGETHER = 256
#: Where a text may be cut: before one space between two characters that are not white space. The pre-tokens of byte-level
#: vocabularies start there, whatever the characters are.
_CUT = re.compile(r"(?<=\S)(?= \S)")
_ENCODERS: dict = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """ids of texts as bytes of little-endian unsigned integers, two or four bytes each by the vocabulary's size.

    All ids are the tokenizers library's at its defaults, added tokens (<|endoftext|>) included. As pre-tokens are merged
    each on its own, a text is cut between words; words not met of late are encoded by the library, many in one call, and their
    ids are remembered. In one call, words part where a token begins with a space. A text with the content of an added token, or one of a file that is not plainly byte-level (loading looks
    at the file's parts and compares on a probe), is encoded whole.
    """

    PROBE = "Twelve words, isn't it?\n\nÄußerst  ça l'été \t niño 2024-01-31 key_ID='a+b/c='  日本 語 \x85 x end "

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.code = "H" if self.width == 2 else "I"
        self.batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        self.known: dict[str, bytes] = {}
        self.known_before: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values(), default=-1) + 1, bool)  # ids whose token begins with a space
        self.spaced[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True
        self.in_pieces = self._byte_level() and self._pieces(self.PROBE) == self._whole(self.PROBE)

    def _byte_level(self) -> bool:
        before = self.tokenizer.pre_tokenizer
        return self.tokenizer.normalizer is None and type(before).__name__ == "ByteLevel" and not before.add_prefix_space and not self.tokenizer.model.dropout

    def _packed(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _whole(self, text: str) -> bytes:
        return self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _learn(self, missing: set[str]) -> None:
        """Words (each stands for itself with a space before it) that are not known from here on are."""
        old, new = self.known_before, []
        for p in missing:
            if p in old:
                self.known[p] = old[p]
            else:
                new.append(p)
        # words without a space inside: their ids begin where a token with a space does, so many are encoded in one go
        plain = [p for p in new if " " not in p and not p[-1].isspace()]
        for i in range(0, len(plain), TOGETHER):
            words = plain[i:i + TOGETHER]
            ids = np.array(self.batch([" " + " ".join(words)], add_special_tokens=False)[0].ids, self.dtype)
            edges = [*(np.flatnonzero(self.spaced[ids]) * self.width).tolist(), len(ids) * self.width]
            if len(edges) != len(words) + 1:
                self._learn_each(words)
                continue
            data = ids.tobytes()
            self.known.update((p, data[a:b]) for p, a, b in zip(words, edges, edges[1:], strict=False))
        if len(plain) < len(new):
            self._learn_each([p for p in new if " " in p or p[-1].isspace()])

    def _learn_each(self, words: list[str]) -> None:
        for p, found in zip(words, self.batch([" " + p for p in words], add_special_tokens=False), strict=True):
            self.known[p] = self._packed(found.ids)

    def _pieces(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        missing = set(rest).difference(self.known)
        # remembered words have no white space at their ends; where one of the others has, the regular expression cuts
        if rest and (not first or first[-1].isspace()) or any(not p or p[0].isspace() or p[-1].isspace() for p in missing):
            first, *rest = _CUT.split(text)
            rest = [p[1:] for p in rest]
            missing = set(rest).difference(self.known)
        if missing:
            self._learn(missing)
        out = b"".join([self._whole(first), *map(self.known.__getitem__, rest)])
        for p in missing:
            if len(p) > LONGEST or p[-1].isspace():
                del self.known[p]
        if len(self.known) > KNOWN:  # the words of late stay at hand
            self.known_before, self.known = self.known, {}
        return out

    def encode(self, text: str) -> bytes:
        if not self.in_pieces or any(t in text for t in self.added):
            return self._whole(text)
        return self._pieces(text)


def encoder(path: str) -> Encoder:
    """One encoder for each worker process, kept between its tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
