"""Ids of a byte-level BPE vocabulary file, by the fast byte-pair encoder that takes such vocabularies as ranks.

The ids equal those of the ``tokenizers`` library on the same file with ``add_special_tokens=False`` at its default setting (tests
compare both): an added token that a text spells out, such as ``<|endoftext|>``, is one id. The encoder is about five times faster.
"""

from __future__ import annotations

import json
from functools import lru_cache

import public_tokenizers
import tiktoken

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
END_OF_DOCUMENT = 2


def _byte_characters() -> dict[str, int]:
    """The printable characters that stand for bytes in such files: printable Latin-1 for itself, the rest from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def encoder(path: str = VOCABULARY) -> tiktoken.Encoding:
    """Encoder of a vocabulary file, read once per worker."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    special = {token["content"]: token["id"] for token in content["added_tokens"]}
    of = _byte_characters()
    ranks = {bytes(of[c] for c in token): rank for token, rank in content["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def document_ids(text: str | None, path: str = VOCABULARY) -> list[int]:
    """Ids of a whole text and the id that ends a document; a null text is empty."""
    ids = encoder(path).encode(text or "", allowed_special="all")
    ids.append(END_OF_DOCUMENT)
    return ids
