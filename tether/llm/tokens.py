"""Byte-level BPE ids and pre-tokens from public vocabulary files, which are read where they lie."""

from __future__ import annotations

import base64
import os
import re

import numpy as np

#: The pre-token pattern of the vocabulary (fixed value), and the same without its look-ahead, which matches alike in
#: texts that have no two white-space characters in a row and is much faster there.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
SPECIAL = "<|endoftext|>"
_twice = re.compile(r"\s\s")


def default_files() -> tuple[str, str]:
    """The vocabulary as ranks, and as a tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids as the tokenizer file gives them without added special tokens; the special token's own string is one id."""

    def __init__(self, files: tuple[str, str] | None = None):
        import tiktoken

        self.ranks_file, self.json_file = files or default_files()
        with open(self.ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.full = tiktoken.Encoding("full", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.plain = tiktoken.Encoding("plain", pat_str=PLAIN, mergeable_ranks=ranks, special_tokens={})
        self.slow = None

    def ids(self, text: str) -> np.ndarray:
        if SPECIAL in text:
            return np.array(self._reference(text), np.uint32)
        use = self.full if _twice.search(text) else self.plain
        return np.array(use.encode_ordinary(text), np.uint32)

    def pretoken_size(self, piece: str) -> int:
        """Ids of one pre-token."""
        return 1 if piece == SPECIAL else len((self.full if piece.isspace() else self.plain).encode_ordinary(piece))

    def _reference(self, text: str) -> list[int]:
        if self.slow is None:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.json_file)
        return self.slow.encode(text, add_special_tokens=False).ids
