"""Token ids of whole texts, as little-endian unsigned 32-bit numbers.

Ids are those of the tokenizers library with a .json vocabulary. Where a file of ranks of the same vocabulary is named as well,
tiktoken encodes the texts that both cut alike, to the same ids in a fifth of the time.
"""

from __future__ import annotations

import base64
import re
import sys
from array import array

# Names of public vocabulary files; the two hold one vocabulary.
JSON, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
# Fixed value: how the byte-level vocabulary's tokenizer cuts texts before its merges.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Characters that are letters, digits or spaces alike in every version of Unicode.
_PLAIN = re.compile("[\x00-\x1b\x20-\x7eÀ-ɏ]*")


def tokenizer_path(name: str) -> str:
    """The place of a public vocabulary file; operators take any other as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def packed(ids: list[int]) -> bytes:
    found = array("I", ids)
    if sys.byteorder == "big":
        found.byteswap()
    return found.tobytes()


class Encoder:
    """Ids by the tokenizers file ``path``.

    With ``ranks``, a text of plain characters and without special tokens is encoded by tiktoken; any other text, whose pieces the
    two libraries might cut by different versions of Unicode, is encoded by tokenizers.
    """

    def __init__(self, path: str, ranks: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_ranks = ranked(ranks) if ranks else None

    def ids(self, text: str) -> bytes:
        return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encode(self, text: str | None) -> bytes:
        """Ids of the whole text; none of null."""
        if not text:
            return b""
        if self.by_ranks and _PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            return packed(self.by_ranks(text))
        return self.ids(text)

    def tokens(self) -> list[bytes]:
        """The bytes of each id's token."""
        # Fixed rule of byte-level vocabularies: printable characters stand for themselves, the other bytes for 256, 257, ...
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        found = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        return [bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t in found]


def ranked(path: str):
    """Encodes by a file of ranks."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


_encoders: dict[tuple[str, str | None], Encoder] = {}


def encoder(path: str, ranks: str | None = None) -> Encoder:
    """One encoder a worker and vocabulary."""
    if (path, ranks) not in _encoders:
        _encoders[path, ranks] = Encoder(path, ranks)
    return _encoders[path, ranks]


def vocabulary(tokenizer: str | None) -> tuple[str, str | None]:
    """The files of an operator's parameter: a .json file, which is used alone, or null for the public vocabulary with its ranks."""
    return (tokenizer, None) if tokenizer else (tokenizer_path(JSON), tokenizer_path(RANKS))
