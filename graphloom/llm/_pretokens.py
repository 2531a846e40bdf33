"""Pre-tokens of the public tokenizers, found with ``re`` where that is exact.

``re`` agrees with the tokenizers library over the code points of ``SAFE``
(tests compare each of them); a text with any other goes through the library.
"""

from __future__ import annotations

import re

import public_tokenizers

#: Latin letters, ASCII and Latin-1 marks, dashes and quotes. Without what ``re`` and
#: the library class differently or what changes its length in lower case.
SAFE = "\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ɏ‐-‧€"
UNSAFE = re.compile(f"[^{SAFE}]")

BYTE_BPE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
WORD_BPE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


def load(name: str):
    """The named tokenizer, on one thread, without truncation or padding."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(name if "/" in name else public_tokenizers.path(name))
    t.no_truncation()
    t.no_padding()
    return t


def special_strings(tokenizer) -> re.Pattern | None:
    """Matches the strings that the library takes for special tokens."""
    words = sorted((x.content for x in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
    return re.compile("|".join(map(re.escape, words))) if words else None


def safe(text: str, special: re.Pattern | None) -> bool:
    return not UNSAFE.search(text) and not (special and special.search(text))
