"""Token ids of whole texts with a word-level cache.

The tokenizer lower-cases, drops white space and encodes each pre-token alone, so a text's ids are its pre-tokens' ids in
order. No pre-token holds white space, so a worker keeps a bounded cache from words between white space and from pre-tokens to ids, cuts only
unseen words into pre-tokens and runs the vocabulary's merges only for unseen ones of these. Texts
with code points outside printable ASCII and Latin letters, for which Unicode tables of libraries may differ, or capitals
whose lower case lies outside them, and texts that spell an added token go through the tokenizer whole.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np

_PLAIN = {"\t", "\n", "\r", *map(chr, range(0x20, 0x7F)), *map(chr, range(0xA1, 0x250))}

#: A code point that is not plain itself or in lower case.
_UNSURE = re.compile(f"[^{''.join(re.escape(c) for c in sorted(_PLAIN) if set(c.lower()) <= _PLAIN)}]")

#: Code points of the longest word of several pre-tokens that is cached.
LONG = 64


def _listed(kind: str) -> str:
    """The code points below 0x250 of a Unicode category, for a character class."""
    return "".join(re.escape(chr(i)) for i in range(0x250) if unicodedata.category(chr(i))[0] == kind)


#: The vocabulary file's pre-tokens over code points below 0x250: letters, an English ending, one digit, other signs.
PRE_TOKEN = re.compile(rf"[{_listed('L')}]+|'(?:s|t|re|ve|m|ll|d)|[{_listed('N')}]|[^\s{_listed('L')}{_listed('N')}]+")


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: 256 + k for k, b in enumerate(x for x in range(256) if x not in plain)}


class _Cache(dict):
    """Word between white space, or pre-token, to little-endian 32-bit ids. A pre-token alone is cut into itself, so one table holds both."""

    def __init__(self, model, most: int):
        super().__init__()
        self.model, self.most, self.letters = model, most, _byte_letters()

    def __missing__(self, word: str) -> bytes:
        parts = PRE_TOKEN.findall(word)
        if len(parts) == 1 and parts[0] == word:
            spelled = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
            ids = np.array([t.id for t in self.model.tokenize(spelled)], "<u4").tobytes()
        else:
            ids = b"".join(map(self.__getitem__, parts))
            # Long ones seldom come again.
            if len(word) > LONG:
                return ids
        if len(self) >= self.most:
            self.clear()
        self[word] = ids
        return ids


class WordTokenizer:
    def __init__(self, path: str, cache_words: int = 800_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Added tokens are matched before pre-tokenisation, which the cache does not see.
        added = [(t["content"], t["normalized"]) for t in json.loads(self.tokenizer.to_str()).get("added_tokens") or []]
        self.raw = [content for content, normalized in added if not normalized]
        self.lowered = [content.lower() for content, normalized in added if normalized]
        self.ids = _Cache(self.tokenizer.model, cache_words).__getitem__

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        low = text.lower()
        if any(c in text for c in self.raw) or any(c in low for c in self.lowered) or _UNSURE.search(text):
            return self.whole(text)
        return b"".join(map(self.ids, low.split()))
