"""Token ids of whole texts by a public tokenizer, at the speed of a dictionary.

A byte-level tokenizer splits a text into pieces that it encodes each by itself, and no piece reaches over
the place before a space that stands between two other characters. So the ids of a text are those of its
words (each with the space before it), one after another, and a word that was met before is looked up.
Words not met before are encoded by the tokenizers library; so is every text with one of its special tokens, as a whole.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from functools import cache

#: White space as the tokenizer knows it (Python's own has four control characters more).
_SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
#: What a text may not hold to be cut at single spaces and line ends alone.
_ODD_ASCII = ("  ", " \n", "\n ", "\n\n", *"\t\r\x0b\x0c")
_ODD_MORE = tuple(x for x in _SPACES if x > "\x7f")
assert array("I").itemsize == 4 and sys.byteorder == "little"
_pieces = re.compile(f" ?[^{_SPACES}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]").findall
#: Marks that a byte-level tokenizer never joins to a letter before them; none that its special tokens have.
_MARKS = ".,;:!?%$&*#()[]{}\"/+=~^@"


def vocabulary_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _odd(text: str) -> bool:
    return any(x in text for x in _ODD_ASCII) or not text.isascii() and any(x in text for x in _ODD_MORE)


#: A byte-level model's stand-ins for bytes, as the characters with these code points (latin-1): printable ones
#: stand for themselves, the others take the code points from 256 on, in order.
_printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_stand_ins = {b: chr(b) for b in _printable} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _printable)}


class _Pieces(dict):
    """Ids of pieces as little-endian unsigned 32-bit integers; a piece is what ``before`` and the key make up.

    At most ROOM pieces are remembered, some 165 bytes each; then all are forgotten.
    """

    ROOM = 700_000

    def __init__(self, tokenizer, marks: _Pieces | None, before: str = ""):
        super().__init__()
        self.encode, self.tokenize, self.marks, self.before = tokenizer.encode, tokenizer.model.tokenize, marks, before
        self.lead = before.translate(_stand_ins)

    def __missing__(self, key: str) -> bytes:
        if key.isalpha():  # one piece, so the model alone is asked
            own = key if key.isascii() else key.encode().decode("latin-1").translate(_stand_ins)
            ids = array("I", [t.id for t in self.tokenize(self.lead + own)]).tobytes()
        elif self.marks is not None and (stem := key.rstrip(_MARKS)) != key and stem[-1:].isalpha():
            known = stem in self
            ids = self[stem] + self.marks[key[len(stem) :]]
            if not known:  # a word met once may well not come again with the same mark
                return ids
        else:
            piece = key if key[:1] == "\n" else self.before + key
            ids = array("I", self.encode(piece, add_special_tokens=False).ids).tobytes() if piece else b""
        if len(self) >= self.ROOM:
            self.clear()
        self[key] = ids
        return ids


class Encoder:
    """ids(text): the text's ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Strings that the library looks for before it cuts a text; one with any of them is encoded as a whole.
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        marks = _Pieces(self.tokenizer, None)
        self.bare, self.after_space = _Pieces(self.tokenizer, marks), _Pieces(self.tokenizer, marks, " ")

    def ids(self, text: str) -> bytes:
        if any(x in text for x in self.special):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if _odd(text):
            return b"".join(map(self.bare.__getitem__, _pieces(text)))
        head, *rest = text.replace("\n", " \n").split(" ")
        return self.bare[head] + b"".join(map(self.after_space.__getitem__, rest))


_loaded: list[Encoder] = []


@cache
def encoder(path: str) -> Encoder:
    """One for all tasks of a Python worker."""
    _loaded.append(Encoder(path))
    return _loaded[-1]


def forget() -> None:
    """Empty the word memories of this worker, which Spark keeps for tasks that may need none."""
    for own in _loaded:
        own.bare.clear()
        own.after_space.clear()
