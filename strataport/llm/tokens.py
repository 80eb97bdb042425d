"""Token ids of whole texts by a public tokenizer file of the tokenizers library."""

from __future__ import annotations

import numpy as np

#: Chunks remembered in one of the two generations of a worker's cache.
REMEMBERED = 500_000


def _byte_signs() -> dict[int, str]:
    """Of each byte, as a Latin-1 sign, the sign that stands for it in a byte-level vocabulary: itself where it shows,
    else the next from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b != 173]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_SIGNS = _byte_signs()


class Encoder:
    """Encodes with byte-level BPE, remembering the ids of each chunk of text.

    Byte-level pre-tokenization never lets a token reach from a character that isn't white space into white space, so a
    text may be cut there, and its ids are those of the chunks in a row. Texts where that doesn't help (runs of white
    space, added tokens) are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.line_end = self._encode("\n")
        self.known = _Known(self)

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _word(self, chunk: str) -> bytes:
        """Ids of letters, with a blank before them or not: a single pre-token, which the model takes directly."""
        found = self.tokenizer.model.tokenize(chunk.encode().decode("latin-1").translate(_SIGNS))
        return np.array([t.id for t in found], self.dtype).tobytes()

    def ids(self, text: str) -> bytes:
        """Ids of ``text`` as little-endian integers of ``dtype``."""
        if not text:
            return b""
        if " \n" in text or "\x00" in text or any(a in text for a in self.added):
            return self._encode(text)
        parts = text.replace("\n", " \n").split(" ")
        parts[0] = "\x00" + parts[0]
        out = list(map(self.known.__getitem__, parts))
        return self._encode(text) if None in out else b"".join(out)


class _Known(dict):
    """Ids of each chunk after a blank (``\\x00``: at the start of a text, ``\\n``: after a line's end); None for a chunk
    that ends in white space, which must not be cut there. Two generations bound what is remembered."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder, self.old = encoder, {}

    def __missing__(self, part: str) -> bytes | None:
        if part in self.old:
            ids = self.old[part]
        else:
            ids = self._found(part)
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        if len(part) <= 64:
            self[part] = ids
        return ids

    def _found(self, part: str) -> bytes | None:
        mark = part[:1] if part[:1] in ("\x00", "\n") else ""
        body = part[len(mark) :]
        if not body:
            return b"" if mark == "\x00" else None
        if body[-1].isspace():
            return None
        if body[0].isspace() or max(body) >= "\u0530":  # letters of later scripts may differ between Unicode versions
            return self.encoder._encode(part if mark == "\n" else body if mark else " " + body)
        if mark == "\n":
            return self.encoder.line_end + self["\x00" + body]
        lead = "" if mark else " "
        if body.isalpha():
            return self.encoder._word(lead + body)
        n = next(i for i, c in enumerate(body) if not c.isalpha())
        if n and not body[n].isspace():  # a pre-token ends where letters end
            return self[mark + body[:n]] + self["\x00" + body[n:]]
        return self.encoder._encode(lead + body)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for this file."""
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
