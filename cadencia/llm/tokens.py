"""Byte-level BPE vocabularies from a tokenizer file: exact ids at tiktoken's speed.

The file's path is a parameter; executors open it where the tokenizer package is installed on each of them.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np

BYTE_BPE = "byte_bpe_50k.json"

#: Fixed value: the split pattern of this family of byte-level vocabularies.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(BYTE_BPE)


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in such files: itself where printable, else the next free code point from 256."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@functools.cache
def load(path: str):
    """(encoding, special tokens as id -> bytes) of a byte-level BPE file; one for each process."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    letters = _byte_letters()
    ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("own", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens=special), {i: t.encode() for t, i in special.items()}


@functools.cache
def piece_table(path: str) -> dict[int, bytes]:
    encoding, special = load(path)
    return {i: piece for piece, i in encoding._mergeable_ranks.items()} | special


#: Longer runs of white space overflow the pattern's backtracking; such texts are split by hand first.
LONG_BLANK = 50_000
#: White space as the pattern has it: unlike Python's it leaves out four control characters.
_BLANKS = re.compile(rf"[^\S\x1c-\x1f]{{{LONG_BLANK},}}")


def encode(path: str, text: str, plain: bool = False) -> np.ndarray:
    """Ids of one text as uint32; strings of special tokens count as these, as in the library's own encode(), unless `plain`."""
    encoding, special = load(path)
    marks = () if plain else tuple(t.decode() for t in special.values())
    allowed = "all" if any(t in text for t in marks) else set()
    whole = lambda t: encoding.encode_to_numpy(t, allowed_special=allowed, disallowed_special=())
    parts, at = [], 0
    for m in _BLANKS.finditer(text):
        # the pattern takes a run as one word, less its last blank where another word follows
        end = m.end() if m.end() == len(text) or text.startswith(marks, m.end()) else m.end() - 1
        parts += [whole(text[at : m.start()]), np.array(encoding._encode_single_piece(text[m.start() : end]), np.uint32)]
        at = end
    return np.concatenate([*parts, whole(text[at:])]) if parts else whole(text)


PIECE_BPE = "piece_bpe_32k.model"


def pieces_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(PIECE_BPE)


@functools.cache
def load_pieces(path: str):
    """(model, bytes of each id) of a piece vocabulary with bytes to fall back on; one for each process."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    table = [bytes([int(p[3:5], 16)]) if model.IsByte(i) else p.replace("\u2581", " ").encode() for i in range(model.GetPieceSize()) for p in [model.IdToPiece(i)]]
    return model, table
