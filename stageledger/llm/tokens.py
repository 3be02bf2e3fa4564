"""Tokenizer encoding on executors, with ids memoised per white-space piece.

The library does every encoding. A text is cut only where its pre-tokenizer is
bound to cut too (before a single space or newline between non-space
characters), so joining the pieces' ids gives the ids of the whole text. A text
with other white space, control characters or an added token's content (which the
library by its default gives that token's id) goes to the library whole.
``tests/llm/test_token_store.py`` holds the two against each other.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

#: Pieces that a worker remembers; bounds its memory (about 200 bytes each).
MEMO_LIMIT = 700_000

#: White space or marks around which the pre-tokenizers' cuts are not single-piece cuts.
_ODD = re.compile("[^\\S \n]|[\x00-\x08\x0e-\x1f\x7f-\x9f]|<\\||  | \n|\n |\n\n")
_ODD_PAIRS = ("  ", " \n", "\n ", "\n\n", "<|")
_RUN_PAIRS = ("..", ",,", ".,", ",.", " .", " ,", "\n.", "\n,")
#: Byte-level characters: a printable byte stands for itself, the others for 256 and up in order.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: chr(b) for b in _PLAIN} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _PLAIN)}
#: A stop or comma inside a run of signs, where no cut may be made before it.
_RUN = re.compile(r"[\W_][.,]")
_BEYOND_LATIN = re.compile("[^\x00-\u024f]")
_CACHE: dict[tuple[str, str], "Encoder"] = {}


class _Memo(dict):
    """piece -> ids; a piece that isn't there is encoded, and remembered while there is room."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.missed = encode, 0

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(piece)
        if len(self) < MEMO_LIMIT:
            self[piece] = ids
        else:
            self.missed += 1
            if self.missed > MEMO_LIMIT:  # what is common has changed: learn anew
                self.clear()
                self.missed = 0
        return ids


class Encoder:
    """texts -> ids as little-endian bytes of ``dtype``."""

    def __init__(self, path: str, dtype: str = "<u4"):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.normal = self.tokenizer.normalizer.normalize_str if self.tokenizer.normalizer else str
        #: Contents of added tokens that "<|" in ``_ODD`` doesn't find already; the library looks for some after normalizing.
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if not t.content.startswith("<|")]
        self.added = re.compile("|".join(re.escape(form(t)) for t in added for form in (str, self.normal)), re.I) if added else None
        self.dtype = np.dtype(dtype)
        self.code = {2: "H", 4: "I"}[self.dtype.itemsize]
        self.drops_space = self.tokenizer.normalizer is not None
        self.merge = self.tokenizer.model.tokenize
        self.memo = _Memo(self._piece)

    @classmethod
    def of(cls, path: str, dtype: str = "<u4") -> "Encoder":
        if (path, dtype) not in _CACHE:
            _CACHE[path, dtype] = cls(path, dtype)
        return _CACHE[path, dtype]

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype=self.dtype).tobytes() for x in found]

    def _pieces(self, text: str) -> list[str] | None:
        """Pieces to encode apart, or None for a text that must stay whole."""
        drops = self.drops_space
        if self.added and (self.added.search(text) or self.added.search(self.normal(text))):
            return None
        if text.replace(" ", "").replace(".", "").replace(",", "").replace("\n", "").isalnum():  # the quick way to know
            if not drops and any(map(text.__contains__, _ODD_PAIRS)):
                return None
            run = any(map(text.__contains__, _RUN_PAIRS[:4] if drops else _RUN_PAIRS))
        elif _ODD.search(text):
            return None
        else:
            run = bool(_RUN.search(text))
        if run:
            return text.split(" ") if drops else text.replace(" ", "\0 ").split("\0")
        if drops:
            if text.isascii() or not _BEYOND_LATIN.search(text):
                text = text.lower()
            return text.replace(",", " ,").replace(".", " .").split()
        return text.replace(" ", "\0 ").replace(",", "\0,").replace(".", "\0.").replace("\n", "\0\n").split("\0")

    def _piece(self, piece: str) -> bytes:
        """Ids of one piece. The library's merges run straight on bare words of Latin
        letters, which its normalizer and pre-tokenizer leave whole; other pieces
        take the whole way."""
        bare = piece if self.drops_space else piece[1:] if piece[:1] == " " else ""
        if bare.isalpha() and max(bare) < "\u0250":
            mapped = bare.lower() if self.drops_space else piece
            if not mapped.isascii() or not self.drops_space:
                mapped = mapped.encode().decode("latin-1").translate(_BYTE_CHARS)
            return array(self.code, [x.id for x in self.merge(mapped)]).tobytes()
        return array(self.code, self.tokenizer.encode([piece], is_pretokenized=True, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        get, out = self.memo.__getitem__, []
        for text in texts:
            if not text:
                out.append(b"")
            elif (pieces := self._pieces(text)) is None:
                out.append(self.whole([text])[0])
            else:
                out.append(b"".join(map(get, pieces)))
        return out


def vocabulary_path(name: str) -> str:
    """Where a public vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
