"""Tokenizing with a public tokenizer file inside Spark tasks.

Texts are cut where no pre-token can cross, and the ids of each distinct piece are remembered, so that the tokenizer itself
runs once per piece and worker rather than once per occurrence. The cuts are exact for both files used here:

* "words": the tokenizer drops white space, so a text's ids are those of its words, one after the other;
* "led": a pre-token may begin with white space but has none after its first other character, so a text may be cut before
  every run of white space. Texts with white space outside ASCII are encoded in one go.

Strings of special tokens (`<|endoftext|>`) in a text become those tokens, as in the library's plain call, and such texts are encoded
in one go; with `special_as_text` they are ordinary text.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

from .common import forget

LED = re.compile(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
WIDE_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
#: What the UTF-8 of WIDE_SPACE begins with; cheap to look for.
WIDE_BYTES = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a", b"\xe2\x80", b"\xe2\x81", b"\xe3\x80", b"\x1c", b"\x1d", b"\x1e", b"\x1f")
#: Remembered pieces, half of them in each of two generations: when the younger is full, the older is forgotten and what is used of
#: it moves up before. This bounds memory and changes no result.
REMEMBERED, LONGEST = 600_000, 64


def byte_letters() -> dict[int, str]:
    """The characters by which byte-level BPE writes bytes: printable ones stand for themselves, the rest follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(other)}


class Encoder:
    """ids(text) gives the ids of UTF-8 bytes as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, cut: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        added = [] if special_as_text else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = [t.lower().encode() if self.tokenizer.normalizer is not None else t.encode() for t in added]
        self.model, self.normalizer = self.tokenizer.model, self.tokenizer.normalizer
        self.letters = [byte_letters()[b] for b in range(256)]
        self.cut, self.known, self.older = cut, {}, {}
        self.vocabulary = self.tokenizer.get_vocab_size()

    def whole(self, text: bytes) -> bytes:
        return array("I", self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()

    def piece(self, piece: bytes) -> bytes:
        """A word of letters is one pre-token, so the model alone is asked; one mark after it is a pre-token of its own."""
        text = piece.decode("utf-8", "replace")
        led = self.cut == "led" and text[:1] == " "
        body = text[1:] if led else text
        if len(piece) <= LONGEST and body[-1:] in (".", ",") and body[:-1].isalpha() and (body.isascii() or self.normalizer is None):
            return self.one(piece[:-1]) + self.one(piece[-1:])
        if self.normalizer is not None and not (body.isascii() and body.islower()):
            body = self.normalizer.normalize_str(body)
        if len(piece) > LONGEST or not body.isalpha():
            return self.whole(piece)
        spelled = body if body.isascii() else "".join([self.letters[b] for b in body.encode()])
        return array("I", [t.id for t in self.model.tokenize(self.letters[32] + spelled if led else spelled)]).tobytes()

    def one(self, piece: bytes) -> bytes:
        if (got := self.known.get(piece)) is None:
            got = self.older.get(piece) or self.piece(piece)
            if len(piece) <= LONGEST:
                self.known[piece] = got
        return got

    def ids(self, text: bytes) -> bytes:
        lowered = text.lower() if self.normalizer is not None else text  # the tokenizer lowers letters anyway; A-Z may be lowered first
        if any(x in lowered for x in self.special):
            return self.whole(text)
        if self.cut == "words":
            pieces = lowered.split()
        elif any(b in text for b in WIDE_BYTES) and WIDE_SPACE.search(text.decode("utf-8", "replace")):
            return self.whole(text)
        else:
            pieces = LED.findall(text)
        got = list(map(self.known.get, pieces))
        if None in got:
            one = self.one
            for i in [i for i, x in enumerate(got) if x is None]:
                got[i] = one(pieces[i])
            if len(self.known) > REMEMBERED // 2:
                self.known, self.older = {}, self.known
        return b"".join(got)


@lru_cache(maxsize=4)
def encoder(path: str, cut: str, special_as_text: bool = False) -> Encoder:
    """One encoder per worker process."""
    return Encoder(path, cut, special_as_text)


forget.append(encoder.cache_clear)


def public_path(name: str) -> str:
    """Where a public tokenizer file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)
