"""Token ids by a public byte-level BPE vocabulary, with a fast path that gives the same ids."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Texts of these characters alone split alike in both libraries; others take the reference library.
PLAIN = re.compile("[\\t\\n\\r -~¡-ſ–—‘’“”…€]*")
#: Where a long text may be cut: the vocabulary's words never reach over a single space between two letters.
CUT = re.compile(r"(?<=[^\W\d_]) (?=[^\W\d_])")
LONG_TEXT = 1 << 20
#: Runs beyond this length are left to the reference library.
LONG_RUN = re.compile(r"\S{4096}|\s{4096}")


class Encoder:
    """``encode(text)`` gives the ids of ``vocabulary`` (a tokenizers JSON file), never its special tokens.

    ``ranks``, where given, is the same vocabulary as a rank file: plain texts are then encoded by the
    faster library, which gives the same ids (held by tests); all other texts by tokenizers itself.
    """

    def __init__(self, vocabulary: str, ranks: str | None = None, pattern: str | None = None) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(vocabulary)
        self.slow.encode_special_tokens = True
        self.fast = None
        if ranks:
            import base64

            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a text. A long one is encoded piece by piece, cut where its ids are the same either way."""
        if not text:
            return np.empty(0, np.uint32)
        if len(text) > LONG_TEXT:
            return np.concatenate([self.encode_piece(piece) for piece in pieces(text, LONG_TEXT)])
        return self.encode_piece(text)

    def encode_piece(self, text: str) -> np.ndarray:
        if self.fast and PLAIN.fullmatch(text) and not LONG_RUN.search(text):
            return np.array(self.fast.encode_ordinary(text), np.uint32)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


def pieces(text: str, size: int) -> Iterator[str]:
    """Stretches of about ``size`` characters, cut before a single space between letters (or not at all)."""
    start = 0
    while start < len(text):
        cut = CUT.search(text, start + size)
        end = cut.start() if cut else len(text)
        yield text[start:end]
        start = end


@lru_cache(maxsize=4)
def encoder(vocabulary: str, ranks: str | None = None, pattern: str | None = None) -> Encoder:
    """One encoder for each Python worker and vocabulary."""
    return Encoder(vocabulary, ranks, pattern)


def public_vocabulary() -> dict[str, str]:
    """Arguments of :func:`encoder` for the installed public 50k vocabulary."""
    import public_tokenizers as public

    return {"vocabulary": public.path("byte_bpe_50k.json"), "ranks": public.path("byte_bpe_50k.tiktoken"), "pattern": public.PATTERN}
