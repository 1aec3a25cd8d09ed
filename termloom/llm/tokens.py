"""Tokens of public subword tokenizers: counts, ids, and where in the text each token starts."""

from __future__ import annotations

import sys
import types

import numpy as np

#: Vocabulary file used unless a caller names another; it must stand at this place on every machine.
DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Fixed value: the pattern that splits text before the merges of the rank files.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Encoder:
    """One interface to rank files (.tiktoken), piece models (.model) and tokenizer files (.json)."""

    def __init__(self, path: str):
        self.kind = path.rsplit(".", 1)[-1]
        if self.kind == "tiktoken":
            import base64

            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
            self._enc = tiktoken.Encoding("ranks", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
            self._bytes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
            for piece, i in ranks.items():
                self._bytes[i] = len(piece)
        elif self.kind == "model":
            import sentencepiece

            self._enc = sentencepiece.SentencePieceProcessor(model_file=path)
        elif self.kind == "json":
            from tokenizers import Tokenizer

            self._enc = Tokenizer.from_file(path)
            self._enc.encode_special_tokens = True
        else:
            raise ValueError(f"no tokenizer is known for {path}")

    def ids(self, text: str) -> list[int]:
        if self.kind == "tiktoken":
            return self._enc.encode_ordinary(text)
        if self.kind == "model":
            return self._enc.encode(text, num_threads=1)
        return self._enc.encode(text, add_special_tokens=False).ids

    def starts(self, text: str) -> np.ndarray:
        """The character at which each token starts; tokens inside one character share its place."""
        if self.kind == "json":
            return np.array([a for a, _ in self._enc.encode(text, add_special_tokens=False).offsets], dtype=np.int64)
        if self.kind == "tiktoken":
            end = np.cumsum(self._bytes[np.array(self.ids(text), dtype=np.int64)])
            at = np.concatenate(([0], end[:-1])) if len(end) else end
        else:
            at = np.array([p.begin for p in self._enc.encode(text, return_type="proto").pieces], dtype=np.int64)
        # both count bytes
        raw = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1
        return char[np.minimum(at, len(raw) - 1)] if len(at) else at


def encoder(path: str) -> Encoder:
    """The encoder of a file, loaded once in a Python worker and kept for its later tasks."""
    # a task unpickles this module's functions anew; only a registered module outlives it
    kept = sys.modules.setdefault("_termloom_encoders", types.ModuleType("_termloom_encoders")).__dict__
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]
