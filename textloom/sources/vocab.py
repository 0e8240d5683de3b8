"""Vocabularies and merges in JSON (base64 values) and in the byte-to-unicode form of public BPE files."""

from __future__ import annotations

import base64
import json

from textloom.operators.bpe import Tokenizer


def save(tokenizer: Tokenizer, vocab_path: str, merges_path: str) -> None:
    code = lambda b: base64.b64encode(b).decode()
    with open(vocab_path, "w") as f:
        json.dump({str(i): code(t) for i, t in tokenizer.vocab.items()}, f)
    with open(merges_path, "w") as f:
        json.dump([[code(a), code(b)] for a, b in tokenizer.merges], f)


def load(vocab_path: str, merges_path: str, specials: list[str] | None = None) -> Tokenizer:
    with open(vocab_path) as f:
        vocab = {int(i): base64.b64decode(t) for i, t in json.load(f).items()}
    with open(merges_path) as f:
        merges = [(base64.b64decode(a), base64.b64decode(b)) for a, b in json.load(f)]
    return Tokenizer(vocab, merges, specials or [])


def byte_letters() -> dict[str, int]:
    """Letter of each byte: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def load_public(vocab_path: str, merges_path: str, specials: list[str] | None = None) -> Tokenizer:
    """Files with a token-to-id map and a merge per line, in byte letters."""
    letters = byte_letters()
    plain = lambda s: bytes(letters[c] for c in s) if all(c in letters for c in s) else s.encode()
    with open(vocab_path, encoding="utf-8") as f:
        vocab = {i: plain(t) for t, i in json.load(f).items()}
    with open(merges_path, encoding="utf-8") as f:
        pairs = [line.split(" ") for line in f.read().split("\n") if line and not line.startswith("#version")]
    return Tokenizer(vocab, [(plain(a), plain(b)) for a, b in pairs], specials or [])
