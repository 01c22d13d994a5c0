"""Encoding whole texts with a public tokenizer file, piece by piece: words repeat, so each is encoded once per worker."""

from __future__ import annotations

import functools
import itertools
import re
from array import array

from tokenizers import Tokenizer

#: Pieces met more than once that a worker remembers; when they are more, the half that came last goes. Longer pieces are not kept.
CACHED_PIECES, CACHED_CHARS = 220_000, 64
#: Pieces met but once, most of which never come again: when they are more, the half that came first goes.
CACHED_ONCE = 80_000
#: Full stops and commas after a letter or digit: the library's words end there.
_MARK = re.compile(r"[.,](?<=[^\W_].)")
#: The same after Latin letters and digits that stay one letter under normal form and lower case. Other letters (a capital I with
#: a dot, or those of India and Hebrew that are written as letter and sign) may end in a sign, after which no word ends.
_PLAIN_MARK = re.compile("[.,](?<=[0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f].)")
#: A line end between two characters other than white space is a word of its own (byte-level).
_LINE = re.compile(r"\n(?<=\S.)(?=\S)", re.DOTALL)
#: A blank that white space follows, or the text's end, and a blank before anything else.
_ODD, _BEFORE = re.compile(r" (?=\s)| \Z"), re.compile(r"(?= \S)")

#: Pieces that normaliser and pre-tokenizer leave as one word: letters of Latin-1, lower-case ones where letters are lowered.
_LETTERS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+").fullmatch
_BLANK_LETTERS = re.compile(" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch
#: A blank or none and plain letters, then signs: a word ends between them.
_SIGNED = re.compile("( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:;=?@\\[\\]^_`{|}~]+)").fullmatch
#: Byte-level models spell a word by its bytes: these are the letters for bytes that occur in such pieces.
_SPELLED = {32: "\u0120", 0xAD: "\u0143"} | {x: chr(0x122 + x - 0x80) for x in range(0x80, 0xA1)}

#: Anything but Latin letters whose lower case is one letter whatever stands around them.
_FAR = re.compile("[^\0-\u012f\u0131-\u024f]")


def _cut_before_blanks(text: str) -> list[str]:
    """For byte-level tokenizers, whose words carry the blank before them."""
    odd = "  " in text or " \n" in text or " \t" in text or " \r" in text or " \x0b" in text or " \x0c" in text or text.endswith(" ")
    if odd or "\0" in text or not text.isascii() and _ODD.search(text):
        return _BEFORE.split(text)
    return _MARK.sub("\0\\g<0>", _LINE.sub("\0\n\0", text) if "\n" in text else text).replace(" ", "\0 ").split("\0")


def _cut_at_blanks(text: str) -> list[str]:
    """For tokenizers that drop white space and lower letters."""
    if "<|" not in text and (text.isascii() or not _FAR.search(text)):  # control strings are told by their letters' case
        text = text.lower()
    return _PLAIN_MARK.sub(" \\g<0>", text).replace("\n", " ").split(" ")


class PieceEncoder(dict):
    """Ids of whole texts as little-endian unsigned 32-bit integers, equal to encode(text, add_special_tokens=False).

    The library encodes every piece: its model alone where the piece is a word of plain letters, else with its own normaliser
    and pre-tokenizer; signs after such a word are a piece of their own. Here texts are only cut, and the ids of pieces met before are looked up. keep_blanks tells which of the
    two cuts is right for the tokenizer. No word and no composed character reaches across a cut, so the pieces' ids in order
    are the text's ids; a test holds that against the library for any text.
    """

    def __init__(self, path: str, keep_blanks: bool):
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.once = self.tokenizer.model, {}
        self.cut, self.is_word = (_cut_before_blanks, _BLANK_LETTERS) if keep_blanks else (_cut_at_blanks, _LETTERS)

    def __missing__(self, piece: str) -> bytes:
        out = self.once.pop(piece, None)
        if out is not None:
            self[piece] = out
            return out
        if self.is_word(piece):
            spelled = piece.replace(" ", _SPELLED[32]) if piece.isascii() else piece.encode().decode("latin-1").translate(_SPELLED)
            out = array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()
        elif signed := _SIGNED(piece):
            out = self[signed[1]] + self[signed[2]]
        else:
            out = array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()
        if len(piece) <= CACHED_CHARS:
            self.once[piece] = out
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for t in texts:
            out.append(b"".join(map(self.__getitem__, self.cut(t))))
            if len(self.once) > CACHED_ONCE:
                self.once = dict(itertools.islice(self.once.items(), len(self.once) - CACHED_ONCE // 2, None))
            if len(self) > CACHED_PIECES:
                keep = [*itertools.islice(self.items(), CACHED_PIECES // 2)]
                self.clear()
                self.update(keep)
        return out


@functools.lru_cache(maxsize=4)
def encoder(path: str, keep_blanks: bool) -> PieceEncoder:
    """One encoder for each worker process."""
    return PieceEncoder(path, keep_blanks)


def batches(texts: list[str], chars: int = 2_000_000):
    """Slices of texts of about so many characters, so that a batch of very long texts is not encoded at once."""
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= chars:
            yield slice(start, i + 1)
            start, held = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))
