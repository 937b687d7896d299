"""Token ids of whole texts by a public tokenizer file, fast enough for a corpus.

The tokenizer used here never looks across a space, so a text is split at its
spaces and each distinct chunk is encoded once per Python worker; a document's
ids are the joined, already packed ids of its chunks.  Chunks of plain lower-case
ASCII letters, with at most ASCII punctuation behind them, skip the tokenizer's
normaliser: there each letter run and each punctuation run is a word of its own.
Strings of special tokens in a text count as these tokens, as the tokenizer has it; the
text is cut at them before.  The cache of chunks is bounded.
"""

from __future__ import annotations

import re

import numpy as np

#: Chunks kept by a worker; beyond it the cache starts anew.
CACHE = 1_200_000
#: The id written after each document.
END_ID = 0
_PLAIN = re.compile(rb"([a-z]*)([!-&(-/:-@\[-`{-~]*)")


class Chunks(dict):
    """chunk (bytes, A-Z lower-cased) -> its ids, packed; missing chunks are encoded on first use."""

    def __init__(self, path: str, id_type: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # chunks hold none but by lower-casing
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.cuts = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.id_type = np.dtype(id_type)
        if self.tokenizer.get_vocab_size() - 1 > np.iinfo(self.id_type).max:
            raise ValueError(f"ids do not fit {id_type}")
        self.words: dict[bytes, bytes] = {b"": b""}

    def pack(self, ids) -> bytes:
        return np.array(ids, dtype=self.id_type).tobytes()

    def word(self, word: bytes) -> bytes:
        """The ids of one run of lower-case letters or of punctuation."""
        found = self.words.get(word)
        if found is None:
            found = self.words[word] = self.pack([t.id for t in self.tokenizer.model.tokenize(word.decode())])
        return found

    def __missing__(self, chunk: bytes) -> bytes:
        m = _PLAIN.fullmatch(chunk)
        if m:
            ids = self.word(m[1]) + self.word(m[2])
        else:
            ids = self.pack(self.tokenizer.encode(chunk.decode("utf-8", "replace"), add_special_tokens=False).ids)
        if len(chunk) <= 64:
            self[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Packed ids of a whole text, without the end id."""
        if len(self) > CACHE:
            self.clear()
            self.words = {b"": b""}
        if self.cuts and any(t in text for t in self.special):
            return b"".join(self.pack([self.special[t]]) if t in self.special else self._plain(t) for t in self.cuts.split(text))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.encode("utf-8", "replace").lower().split(b" ")))


_loaded: dict[tuple[str, str], Chunks] = {}


def chunks(path: str, id_type: str) -> Chunks:
    """One table of chunks for each tokenizer file, type of ids and worker process."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if (path, id_type) not in _loaded:
        _loaded[path, id_type] = Chunks(path, id_type)
    return _loaded[path, id_type]
