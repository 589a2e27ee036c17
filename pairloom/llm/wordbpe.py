"""Exact ids of a lower-casing BPE with word ends, fast enough for whole corpora.

The tokenizer file drops white space and never joins across it, so a text falls apart into
white-space chunks; the ids of each distinct chunk are found once and kept as bytes. New
chunks of plain Latin text go through the same merges in tiktoken: the word-end mark becomes
the byte 0x01, which such chunks never hold. Every other chunk or text goes through the
tokenizers library itself.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

END = b"\x01"
# Latin letters, digits, ASCII and common signs: here Python's lower() and split() agree with the library's.
PLAIN = re.compile("[\t\n\r -~¡-§©«¬®-±´¶-¸»¿-ſ‐-‟€]*")
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^a-z0-9ß-öø-ſ]+")
# Bounds of the chunk cache of a Python worker: entries, and characters of a chunk that is kept.
KEPT_CHUNKS, KEPT_CHARS = 150_000, 64


def _byte_of() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class WordBpe(dict):
    """Chunk -> ids as little-endian unsigned 32-bit bytes, filled on demand."""

    def __init__(self, path: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.core = None
        if model.get("end_of_word_suffix") == "</w>" and not model.get("continuing_subword_prefix"):
            byte_of, ranks = _byte_of(), {}
            order = sorted(model["vocab"].items(), key=lambda x: x[1])
            for token, i in order:
                ended = token.endswith("</w>")
                body = token.removesuffix("</w>") if ended else token
                if all(c in byte_of for c in body):
                    raw = bytes(byte_of[c] for c in body) + END * ended
                    if raw not in ranks:  # an ended byte shadows nothing: 0x01 itself never occurs
                        ranks[raw] = i
            self.ends = np.zeros(max(model["vocab"].values()) + 1, bool)
            self.ends[[i for raw, i in ranks.items() if raw.endswith(END)]] = True
            self.core = tiktoken.Encoding("word", pat_str=r"[^\x01]+\x01", mergeable_ranks=ranks, special_tokens={})

    def learn(self, chunks: list[str]) -> None:
        """Find the ids of new plain chunks, all in one call."""
        if len(self) + len(chunks) >= KEPT_CHUNKS:
            self.clear()
        if self.core is None:
            for c in chunks:
                self[c] = np.asarray(self.library.encode(c, add_special_tokens=False).ids, "<u4").tobytes()
            return
        pieces = [PIECES.findall(c) for c in chunks]
        ids = np.asarray(self.core.encode_ordinary("\x01".join(["\x01".join(p) for p in pieces]) + "\x01"), "<u4")
        # a chunk ends with the token that ends its last piece
        ends = (np.flatnonzero(self.ends[ids]) + 1)[np.cumsum([len(p) for p in pieces]) - 1].tolist()
        raw, start = ids.tobytes(), 0
        for c, end in zip(chunks, ends, strict=True):
            self[c] = raw[4 * start : 4 * end]
            start = end

    def ids_bytes(self, text: str) -> bytes:
        """The ids of a text, 4 bytes each."""
        if not text:
            return b""
        if "<|" in text or not PLAIN.fullmatch(text):  # "<|": the library takes its special strings for tokens
            return np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        chunks = text.lower().split()
        try:
            return b"".join(map(self.__getitem__, chunks))
        except KeyError:
            new = list(dict.fromkeys(c for c in chunks if c not in self))
            self.learn(new) if len(self) + len(new) < KEPT_CHUNKS else self.learn(list(dict.fromkeys(chunks)))
            out = b"".join(map(self.__getitem__, chunks))
            for c in new:
                if len(c) > KEPT_CHARS:
                    del self[c]
            return out


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)
