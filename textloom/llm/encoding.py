"""Token ids of whole texts from a tokenizer file of the ``tokenizers`` library.

Byte-level BPE splits a text into pre-tokens before it merges, and a single space or line
feed between two words always is such a split. So a text whose white space is only single
spaces and line feeds has the ids of its words in order, and each distinct word needs to be
encoded once per worker. New words go to the library together, a line each. Any other text,
and any that holds an added token of the file (such as its end-of-text mark), is encoded
as it stands. Either way every id comes from the library, as its plain call gives it.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: Words that a worker remembers at most; later ones are encoded again for each batch.
MEMORY = 1_000_000
LINES = 512
_OTHER_SPACE = re.compile(r"[^\S \n]")

_loaded: dict[tuple[str, int], Encoder] = {}


class Encoder:
    """Texts to arrays of unsigned 16-bit ids (32-bit if the vocabulary needs it)."""

    def __init__(self, path: str, memory: int = MEMORY) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.memory = memory
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        self.added = [t.content for t in added]
        feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        # words can be remembered only where a line feed is one id and keeps words apart
        both = self.tokenizer.encode("a\n b\nc", add_special_tokens=False).ids
        alone = [self.tokenizer.encode(x, add_special_tokens=False).ids for x in ("a", " b", "c")]
        apart = not any(c.isspace() for t in self.added for c in t) and (self.tokenizer.normalizer is None or not any(t.normalized for t in added))
        self.by_word = apart and len(feed) == 1 and both == alone[0] + feed + alone[1] + feed + alone[2]
        self.feed = feed[0] if self.by_word else None
        #: "" and " " come from white space that isn't single
        self.known: dict[str, bytes | None] = {"\n": np.array(feed, self.dtype).tobytes(), "": None, " ": None}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _learn(self, words: list[str]) -> dict[str, bytes | None]:
        """Ids of words, each without white space but for one leading space; None for what isn't such a word."""
        good, out, size = words, {}, self.dtype.itemsize
        if _OTHER_SPACE.search("\n".join(words)):
            good = [w for w in words if not _OTHER_SPACE.search(w)]
            out = dict.fromkeys(words)
        for k in range(0, len(good), LINES):
            some = good[k : k + LINES]
            ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(some)], add_special_tokens=False)[0].ids, self.dtype)
            cuts = (np.flatnonzero(ids == self.feed) * size).tolist()
            if len(cuts) != len(some) - 1:  # never seen; then each on its own
                out.update((w, self._whole(w)) for w in some)
                continue
            data = ids.tobytes()
            starts = [0, *[cut + size for cut in cuts]]
            out.update(zip(some, [data[a:b] for a, b in zip(starts, [*cuts, len(data)])]))
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if not self.by_word:
            return [np.frombuffer(self._whole(x), self.dtype) for x in texts]
        parts = [x.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0") if x and "\0" not in x and not any(t in x for t in self.added) else () for x in texts]
        new = set().union(*parts).difference(self.known)
        over = len(self.known) + len(new) > self.memory
        self.known.update(self._learn(list(new)))
        get, out = self.known.__getitem__, []
        for text, words in zip(texts, parts, strict=True):
            try:
                data = b"".join(map(get, words)) if words else self._whole(text)
            except TypeError:  # a word that is None: other white space than single spaces and line feeds
                data = self._whole(text)
            out.append(np.frombuffer(data, self.dtype))
        if over:
            for word in new:
                del self.known[word]
        return out


def encoder(path: str, memory: int = MEMORY) -> Encoder:
    """The worker's encoder of a tokenizer file."""
    key = (path, memory)
    if key not in _loaded:
        _loaded[key] = Encoder(path, memory)
    return _loaded[key]


def default_path() -> str:
    """The public byte-level BPE with 50,257 ids."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
