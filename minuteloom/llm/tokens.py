"""Ids of a public word-BPE vocabulary for whole texts, cached by word.

The vocabulary's pre-tokenizer never joins characters across white space, so a text's ids are those of its
white-space chunks one after another. Chunks and words repeat, and each worker process keeps their ids in a bounded cache that
outlives tasks. Texts with characters outside a verified range (where Python's lower-casing and white space
are those of the vocabulary's normalizer) go through the tokenizer itself, whole.
"""

from __future__ import annotations

from minuteloom.llm.common import worker_cache

#: Id written after each document.
END_ID = 2
#: Entries of a cache's young half before they become the old ones, which are forgotten.
CACHE_ENTRIES = 400_000
#: Longer chunks are not cached.
CACHED_CHUNK = 48
#: The vocabulary's split pattern. Fixed value of the public vocabulary file.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: Characters for which lower-casing, composing and white space are the same in Python and in the tokenizer.
PLAIN = "[\\t-\\r\\x20-\\x7e\\xa1-\\xff\\u2010-\\u2027\\u2030-\\u205e\\u20ac]*"


class TextEncoder:
    """encode(text) gives the ids as little-endian unsigned 32-bit bytes, without END_ID."""

    def __init__(self, path: str):
        import re

        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.plain = re.compile(PLAIN)
        self.split = regex.compile(SPLIT)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_char = {b: chr(b) for b in printable}
        for n, b in enumerate(b for b in range(256) if b not in byte_char):
            byte_char[b] = chr(256 + n)
        self.byte_char = byte_char
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        import numpy as np

        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def word(self, word: str) -> bytes:
        import numpy as np

        spelled = "".join([self.byte_char[b] for b in word.encode()])
        return np.array([t.id for t in self.model.tokenize(spelled)], dtype="<u4").tobytes()

    def piece(self, piece: str) -> bytes:
        """The ids of a chunk or of a word in it. What was used since the young entries were last full stays."""
        ids = self.young.get(piece) or self.old.get(piece)
        if ids is None:
            parts = self.split.findall(piece)
            ids = self.word(piece) if parts == [piece] else b"".join([self.young.get(p) or self.piece(p) for p in parts])
        if len(piece) <= CACHED_CHUNK:
            if len(self.young) >= CACHE_ENTRIES:
                self.old, self.young = self.young, {}
            self.young[piece] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.plain.fullmatch(text) or "<|" in text and any(s in text for s in self.special):
            return self.whole(text)
        get, piece = self.young.get, self.piece
        return b"".join([get(c) or piece(c) for c in text.lower().split()])


def encoder(path: str) -> TextEncoder:
    """The encoder of this worker process: kept outside the pickled functions, so that tasks share its caches."""
    return worker_cache("encoder", path, lambda: TextEncoder(path))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
