"""Token ids of the byte-level BPE vocabulary, many texts at a time.

The reference encoder is ``tokenizers.Tokenizer`` over the JSON file. The same merge ranks,
taken from that file, also drive ``tiktoken``, which splits texts by the same pattern several
times faster. The two libraries may carry different Unicode tables, so only texts whose code
points are all below U+0250 take the fast way, where the character classes are settled; any
other text, and any that contains the string of a special token, is encoded by ``tokenizers``
itself. Tests hold one against the other.
"""

from __future__ import annotations

import json
import re

#: The splitting pattern of the byte-level vocabulary, as its JSON file implies it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Separates documents in a stream of ids.
END_ID = 2

_BEYOND = "[^\x00-ɏ]"
_encoders: dict[str, "Encoder"] = {}


def byte_of_char() -> dict[str, int]:
    """The vocabulary's spelling of bytes: printable Latin-1 as itself, the others from U+0100 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spelled = {chr(b): b for b in kept}
    return spelled | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(kept))}


class Encoder:
    """Ids of texts by the vocabulary file at ``path``, as ``tokenizers`` gives them without adding special tokens."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        special = {t["id"] for t in model["added_tokens"]}
        self.size = 1 + max([*model["model"]["vocab"].values(), *special])
        self.beyond = re.compile("|".join([_BEYOND, *[re.escape(t["content"]) for t in model["added_tokens"]]]))
        table = byte_of_char()
        ranks = {bytes(table[c] for c in t): i for t, i in model["model"]["vocab"].items() if i not in special}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.beyond.search(text):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def encoder(path: str) -> Encoder:
    """The encoder for ``path``, loaded once in a process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_path() -> str:
    """Where this machine has the byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
