"""Token ids of whole texts by the ``tokenizers`` library, with repeated chunks encoded once per worker.

Both supported vocabularies cut a text into pieces before any merge, and no piece reaches across a
plain space. So a text is split at spaces, the library's model merges each unknown piece, and the ids of
known chunks come from a dictionary. Texts with other characters or spacing than the rules below allow go
to the library whole; either way the ids are those of the library.
"""

from __future__ import annotations

import json
import re

import numpy as np

CACHE_ENTRIES = 1 << 20  # of a worker; the cache starts anew beyond it, which costs time only

# texts of these characters only have the same pieces for Python's patterns and for the library's
_PLAIN = re.compile(r"[\t\n\r -~¡-¬®-ÿ]*")
_LETTER, _DIGIT = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾"

_WORD_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^\s{_LETTER}{_DIGIT}]+")
_BYTE_PIECES = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?[^\s{_LETTER}{_DIGIT}]+|\s+(?!\S)|\s+"
)
_LOOSE_SPACE = re.compile(r" \s")


def _byte_signs() -> dict[int, str]:
    """The printable sign that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_BYTE_SIGNS = _byte_signs()


def _kind(config: dict) -> str:
    """Which of the two known ways of cutting a text the vocabulary file asks for; "" for any other."""
    pre = config.get("pre_tokenizer") or {}
    if config.get("normalizer") is None and pre.get("type") == "ByteLevel":
        return "byte" if pre.get("use_regex") and not pre.get("add_prefix_space") else ""
    steps = [s["type"] for s in (config.get("normalizer") or {}).get("normalizers", [])]
    parts = pre.get("pretokenizers", [])
    if steps == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in parts] == ["Split", "ByteLevel"]:
        known = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        return "word" if parts[0]["pattern"] == {"Regex": known} and parts[0]["invert"] else ""
    return ""


class TextEncoder:
    """Encodes texts to little-endian unsigned ids; a text that holds an added token goes to the library whole.

    ``dtype`` is ``<u2`` where every id fits, else ``<u4``.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        config = json.loads(self.tokenizer.to_str())
        self.kind = _kind(config)
        self.added = [t["content"] for t in config["added_tokens"]]
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in config["added_tokens"]):
            self.kind = ""  # found by other rules than plain containment
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.cut = (_WORD_PIECES if self.kind == "word" else _BYTE_PIECES).findall
        self.cache: dict[str, bytes] = {}  # by chunk
        self.pieces: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return np.array(ids, self.dtype).tobytes()

    def _learn(self, chunks: set[str]) -> None:
        """Cut unknown chunks into pieces and run the library's merges once for each unknown piece."""
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        if len(self.pieces) > CACHE_ENTRIES:
            self.pieces.clear()
        cut, tokenize, known = self.cut, self.tokenizer.model.tokenize, self.pieces
        for chunk in chunks.difference(self.cache):
            parts = cut(" " + chunk)
            for piece in parts:
                if piece not in known:
                    shown = piece.encode().decode("latin-1").translate(_BYTE_SIGNS)
                    known[piece] = np.array([t.id for t in tokenize(shown)], self.dtype).tobytes()
            self.cache[chunk] = b"".join([known[p] for p in parts])

    def encode(self, text: str) -> bytes:
        if not self.kind or any(t in text for t in self.added) or not _PLAIN.fullmatch(text):
            return self._whole(text)
        if self.kind == "word":
            chunks, head = text.lower().split(), b""
        else:
            if _LOOSE_SPACE.search(text) or text[-1:] == " ":
                return self._whole(text)
            first, *chunks = text.split(" ")
            head = self._whole(first) if first else b""
        try:
            return head + b"".join(map(self.cache.__getitem__, chunks))
        except KeyError:
            self._learn(set(chunks))
        return head + b"".join(map(self.cache.__getitem__, chunks))


_ENCODERS: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """The worker's encoder of a vocabulary file; loaded once and kept between tasks."""
    if path not in _ENCODERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]
