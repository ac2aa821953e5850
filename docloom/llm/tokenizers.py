"""Loading of the public tokenizer files, once for each worker process."""

from __future__ import annotations

import base64
import json
from functools import lru_cache


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def rank_encoder(path: str, pattern: str):
    """A tiktoken encoding without special tokens."""
    import tiktoken

    return tiktoken.Encoding("docloom", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(maxsize=4)
def file_encoder(path: str):
    """The tokenizers.Tokenizer of the file, as it is."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def added_tokens(path: str) -> tuple[str, ...]:
    """The strings that the file's tokenizer reads as one token wherever they stand."""
    with open(path, encoding="utf-8") as f:
        return tuple(t["content"] for t in json.load(f).get("added_tokens", ()))


def public(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def public_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def encode(text: str, json_path: str, rank_path: str | None, pattern: str | None) -> list[int]:
    """Ids as `json_path`'s tokenizer gives them, without its template's special tokens.

    Where the same vocabulary is at hand as ranks, the several times faster
    rank encoder gives the same ids. Texts that hold the string of an added token
    (it is one id then), and texts the rank encoder cannot take (runs of white
    space beyond its regex engine's stack), go to the tokenizer itself.
    """
    if rank_path and not any(t in text for t in added_tokens(json_path)):
        try:
            return rank_encoder(rank_path, pattern).encode_ordinary(text)
        except BaseException as e:
            # the engine reports its limits as a panic, which is no Exception
            if type(e).__name__ != "PanicException" and not isinstance(e, ValueError):
                raise
    return file_encoder(json_path).encode(text, add_special_tokens=False).ids
