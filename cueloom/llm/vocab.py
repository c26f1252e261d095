"""Public tokenizer files, and the split of a text before the merges, inside tasks."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

#: The split pattern of the rank files (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Blocks in which every code point is a letter, and further characters that are neither letter, number nor space.
#: A text made of these, ASCII and \t \n \r alone is split by the standard library's faster engine, with equal results.
LETTERS = ("A-Za-zÀ-ÖØ-öø-ɏɐ-ʯΑ-ΡΣ-ώЀ-ҁ"
           "Ҋ-ԯぁ-ゖァ-ヺ一-龥가-힣")
OTHERS = "¡-©«¬®-±´¶-¸»¿×÷‐-‧‰-⁞€"

_UNUSUAL = re.compile(f"[^\t\n\r -~{LETTERS}{OTHERS}]")
_FAST = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\t\n\r 0-9{LETTERS}]+|[\t\n\r ]+(?![^\t\n\r ])|[\t\n\r ]+")


@lru_cache(1)
def _general():
    import regex

    return regex.compile(PATTERN)


def default_path(name: str) -> str:
    """Where the public vocabulary file of that name is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def usual(text: str) -> bool:
    return _UNUSUAL.search(text) is None


#: The matches of ``PATTERN`` in a usual text.
usual_pieces = _FAST.findall


def pieces_of(text: str) -> list[str]:
    """The matches of ``PATTERN``, in order; together they are the whole text."""
    return usual_pieces(text) if usual(text) else _general().findall(text)


@lru_cache(4)
def ranks(path: str) -> dict[bytes, int]:
    """The rank of every byte sequence of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(4)
def rank_encoding(path: str):
    """The library's encoder over a rank file, without special tokens."""
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(2)
def json_tokenizer(path: str):
    """The library's encoder over a tokenizer file."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)
