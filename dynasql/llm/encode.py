"""Token ids of whole texts by a public byte-level BPE vocabulary, with a word cache.

The vocabulary's pre-tokens never reach across a space or line feed between two
other characters, so a text without two white space characters in a row is the
concatenation of its words, each with the separator before it; their ids are
cached as bytes. Any other text is encoded whole.
"""

from __future__ import annotations

import base64
import json
import os
import re
import struct

DOUBLE = re.compile(r"\s\s")
#: Words kept by a worker process; beyond that, new words are encoded each time.
CACHE_WORDS = 300_000


class _Words(dict):
    def __init__(self, encode, prefix: str):
        super().__init__()
        self.encode, self.prefix = encode, prefix

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(self.prefix + word)
        if len(self) < CACHE_WORDS and len(word) < 64:
            self[word] = ids
        return ids


class Encoder:
    """ids(text): the ids as unsigned little-endian 32-bit numbers in bytes."""

    def __init__(self, vocabulary: str, pattern: str, added: dict[str, int] | None = None):
        import tiktoken

        self.added = {text: struct.pack("<I", i) for text, i in (added or {}).items()}
        self.cuts = re.compile("|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.coder = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.first, self.line, self.spaced = (_Words(self.whole, p) for p in ("", "\n", " "))

    def whole(self, text: str) -> bytes:
        ids = self.coder.encode_ordinary(text)
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids(self, text: str) -> bytes:
        if DOUBLE.search(text):
            return self.whole(text)
        out, head, spaced = [], self.first, self.spaced.__getitem__
        for line in text.split("\n"):
            words = line.split(" ")
            out.append(head[words[0]])
            out.extend(map(spaced, words[1:]))
            head = self.line
        return b"".join(out)

    def ids_with_added(self, text: str) -> bytes:
        """As ids, but the added tokens of the vocabulary, where a text spells them out, are one id each."""
        if self.cuts is None or not self.cuts.search(text):
            return self.ids(text)
        out, at = [], 0
        for m in self.cuts.finditer(text):
            out += (self.ids(text[at : m.start()]), self.added[m[0]])
            at = m.end()
        return b"".join([*out, self.ids(text[at:])])


def added_tokens(tokenizer: str) -> dict[str, int]:
    """The added tokens that a tokenizer's JSON file lists, with their ids."""
    with open(tokenizer, encoding="utf-8") as f:
        return {x["content"]: x["id"] for x in json.load(f).get("added_tokens", [])}


_loaded: dict[str, Encoder] = {}


def encoder(vocabulary: str | None = None) -> Encoder:
    """The encoder of a vocabulary file, loaded once for each worker process."""
    import public_tokenizers

    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
    if path not in _loaded:
        listed = path.removesuffix(".tiktoken") + ".json"
        _loaded[path] = Encoder(path, public_tokenizers.PATTERN, added_tokens(listed) if os.path.exists(listed) else None)
    return _loaded[path]
