"""Tokenizer access for tasks: one encoder per Python worker, safe cuts, memoised pieces."""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

import numpy as np

#: The code points of Unicode's White_Space property, and the vocabulary's one added token.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
END_OF_TEXT = "<|endoftext|>"
END_OF_TEXT_ID = 50256

#: Words with the white-space character before them, and what remains of longer runs of white space.
#: Byte-level BPE with the usual pre-tokenisation never joins bytes across these pieces.
PIECES = re.compile(f"[{WHITE}]?[^{WHITE}]+|[{WHITE}]+(?=[{WHITE}][^{WHITE}])|[{WHITE}]+")
#: A run of white space that the rank table's encoder isn't given.
LONG_BLANK = re.compile(f"[{WHITE}]{{1000}}")
#: A single white-space character between others: a place where a text can be cut.
SAFE_CUT = re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}][^{WHITE}])")


#: Characters of a piece that is worth keeping.
LONG_PIECE = 64


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def library(path: str):
    """The tokenizer of ``path``, loaded once in a worker; its own threads stay off as Spark has the cores."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def rank_encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def cut(text: str, most: int = 1 << 16) -> list[str]:
    """``text`` in parts of about ``most`` characters, cut at safe places only (longer where there is none)."""
    if len(text) <= most or END_OF_TEXT in text:
        return [text]
    parts, at = [], 0
    while len(text) - at > most:
        found = SAFE_CUT.search(text, at + most)
        if not found:
            break
        parts.append(text[at : found.start()])
        at = found.start()
    parts.append(text[at:])
    return parts


class PieceCounter:
    """Token counts of texts: new pieces are encoded in batches of about equal bytes, known ones looked up."""

    def __init__(self, path: str, batch_bytes: int = 1 << 18, most_known: int = 1 << 20):
        self.path, self.batch_bytes, self.most_known = path, batch_bytes, most_known
        self.known: dict[str, int] = {}

    def lengths(self, parts: list[str]) -> list[int]:
        """Token counts of ``parts``, encoded in batches balanced by bytes."""
        out: list[int] = []
        batch: list[str] = []
        size = 0
        for part in parts:
            n = len(part.encode()) + 16
            if batch and size + n > self.batch_bytes:
                out += map(len, library(self.path).encode_batch_fast(batch, add_special_tokens=False))
                batch, size = [], 0
            batch.append(part)
            size += n
        if batch:
            out += map(len, library(self.path).encode_batch_fast(batch, add_special_tokens=False))
        return out

    def count(self, texts: list[str]) -> list[int]:
        if len(self.known) > self.most_known:
            self.known.clear()
        added = [t.content for t in library(self.path).get_added_tokens_decoder().values()]
        whole = [i for i, t in enumerate(texts) if any(a in t for a in added)]
        special = dict(zip(whole, self.lengths([texts[i] for i in whole]), strict=True))
        split = [[] if i in special else PIECES.findall(t) for i, t in enumerate(texts)]
        new = {p for pieces in split for p in pieces}
        new = [p for p in new if p not in self.known]
        self.known.update(zip(new, self.lengths(new), strict=True))
        look = self.known.__getitem__
        out = [special[i] if i in special else sum(map(look, pieces)) for i, pieces in enumerate(split)]
        for p in new:
            if len(p) > LONG_PIECE:  # long pieces seldom come again, and would fill the table
                del self.known[p]
        return out


def encode_ids(text: str, ranks: str, vocabulary: str) -> np.ndarray:
    """Ids of a whole text as unsigned 32-bit integers.

    The rank table holds the same merges as ``vocabulary``; its encoder is some
    six times faster.  It gives up on long runs of white space (its regex engine's
    stack is bounded), so the vocabulary's own library encodes parts with such a run.
    """
    parts = []
    for i, segment in enumerate(text.split(END_OF_TEXT)):
        if i:
            parts.append(np.array([END_OF_TEXT_ID], "<u4"))
        for part in cut(segment):
            if LONG_BLANK.search(part):
                parts.append(np.array(library(vocabulary).encode(part, add_special_tokens=False).ids, "<u4"))
            elif part:
                parts.append(np.array(rank_encoder(ranks).encode_ordinary(part), "<u4"))
    return np.concatenate(parts) if parts else np.zeros(0, "<u4")
