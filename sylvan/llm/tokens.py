"""Token ids of whole texts by the tokenizers library, with a memory of known words.

Both vocabularies merge within the pieces of a fixed split pattern only, and no piece reaches across the
last white space before a word.  A text's ids are therefore those of its units (a word with the
white space character before it) in a row.  Units recur far more often than they are new: each worker keeps
the ids of the units it has met lately (MEMORY) and gives only new units' pieces to
the library's model.  Splitting here is for characters on which every Unicode version agrees; a
text with any other character goes through the library whole, and so does every text where the file's normalizer, split
or added tokens are not those of the two known kinds.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array

import numpy as np

#: Units kept in a worker's newer and older memory each; a full newer one becomes the older.
MEMORY = 350_000

# The vocabularies' split patterns, for the characters outside OTHER.
LETTERS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f"
NUMBERS = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
BLANK = "\t\n\x0b\x0c\r\x20\u00a0"
OTHER = re.compile("[^\t\n\x0b\x0c\r\x20-\x7e\u00a0-\u012f\u0131-\u017f\u2010-\u2027\u2030-\u205e]")
BYTE_LEVEL = re.compile(rf" ?[{LETTERS}]+| ?[{NUMBERS}]+|'(?:[stmd]|re|ve|ll)| ?[^{BLANK}{LETTERS}{NUMBERS}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]")
WORD_LEVEL = re.compile(rf"[{LETTERS}]+|[{NUMBERS}]|'(?:[stmd]|re|ve|ll)|[^{BLANK}{LETTERS}{NUMBERS}]+")
UNIT = re.compile(rf"[{BLANK}]?[^{BLANK}]+|[{BLANK}]+(?![^{BLANK}])")

BLANKS = "\t\n\x0b\x0c\r\x20\u00a0"
FIRST = "\x00"
# How the two kinds of vocabulary files describe their normalizer and split.
BYTE_KIND = (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True})
WORD_KIND = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
)
#: Signs that can follow a word; an apostrophe can begin a piece of its own.
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: White space that is not one space or line feed between words.
UNEVEN = ("  ", "\n\n", " \n", "\n ", "\t", "\r", "\u00a0", "\x0b", "\x0c")
#: Byte-level vocabularies write byte b as this character (printable bytes as themselves, others from U+0100 on).
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARS = {b: chr(0x100 + k) for k, b in enumerate(x for x in range(256) if x not in PRINTABLE)}

_encoders: dict[str, Encoder] = {}


class Encoder:
    """ids(texts) gives each text's ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings are ordinary text
        self.library.no_padding()
        self.library.no_truncation()
        self.model = self.library.model
        described = json.loads(self.library.to_str())
        kind = described["normalizer"], described["pre_tokenizer"]
        plain = described["model"]["type"] == "BPE" and not described["model"]["dropout"] and described["post_processor"] is None
        self.split = plain and kind in (BYTE_KIND, WORD_KIND) and all(t["special"] for t in described["added_tokens"])
        self.lower = kind == WORD_KIND
        self.pattern = WORD_LEVEL if self.lower else BYTE_LEVEL
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.signs: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _ids(self, unit: str) -> bytes:
        model = self.model.tokenize
        return array("I", [t.id for piece in self.pattern.findall(unit) for t in model(piece.encode().decode("latin-1").translate(BYTE_CHARS))]).tobytes()

    def _learn(self, keys: set[str]) -> None:
        """Most new keys are a word, or a word and the signs after it: those have one piece or two."""
        model, known, older, space = self.model.tokenize, self.known, self.older, "" if self.lower else BYTE_CHARS[0x20]
        for key in keys:
            ids = older.get(key)
            if ids is None:
                word = key.rstrip(SIGNS)
                if word.isalpha() and word.isascii():
                    ids = known.get(word) or older.get(word)
                    if ids is None:
                        ids = known[word] = array("I", [t.id for t in model(space + word)]).tobytes()
                    if len(word) < len(key):
                        signs = key[len(word) :]
                        if signs not in self.signs:
                            if len(self.signs) > MEMORY:
                                self.signs = {}
                            self.signs[signs] = self._ids(signs)
                        ids += self.signs[signs]
                else:
                    ids = self._ids(key[1:] if key[0] == FIRST else key if self.lower or key[0] in BLANKS else " " + key)
            known[key] = ids

    def _keys(self, text: str) -> list[str]:
        """A unit's key is its word, after FIRST or the white space character unless that is a space."""
        if self.lower:
            return text.lower().split()
        if not text or text[0] in BLANKS or text[-1] in BLANKS or any(x in text for x in UNEVEN):
            return [u[1:] if u[0] == " " and len(u) > 1 and u[1] not in BLANKS else u if u[0] in BLANKS else FIRST + u for u in UNIT.findall(text)]
        keys = text.replace("\n", " \n").split(" ")
        keys[0] = FIRST + keys[0]
        return keys

    def ids(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for text in texts:
            if not self.split or OTHER.search(text):
                out.append(self.whole(text))
                continue
            keys = self._keys(text)
            try:
                out.append(b"".join(map(self.known.__getitem__, keys)))
            except KeyError:
                new = set(keys).difference(self.known)
                if len(self.known) + len(new) > MEMORY:
                    self.known, self.older = {}, self.known
                    new = set(keys)
                self._learn(new)
                out.append(b"".join(map(self.known.__getitem__, keys)))
        return out


def encoder(path: str) -> Encoder:
    """The worker's encoder of that vocabulary file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def crc(ids: bytes) -> int:
    return zlib.crc32(ids)
