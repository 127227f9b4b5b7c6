"""Token ids of whole texts by the tokenizers library, piece by piece through a bounded cache.

Both vocabularies split a text before each run of white space that follows other characters, so the ids of a
text are those of its pieces "white space, then a word", in order. Cuts are found in the Arrow buffer's bytes and
pieces numbered there; each distinct piece is encoded by the library once and kept in a cache of two generations,
whose size doesn't follow the input.
"""

from __future__ import annotations

import gc
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: The Unicode property White_Space, which is \\s of the vocabularies' patterns (fixed values): in ASCII, and beyond it.
SPACE = "\t\n\x0b\x0c\r "
WIDE_SPACE = "".join(map(chr, [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Marks that never belong to a letter before them.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Words of letters that normal forms leave alone and that have a lower case of one letter: no pattern parts them.
WORD = re.compile(f" ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-{chr(0x12F)}{chr(0x131)}-{chr(0x24F)}]+").fullmatch
#: Bytes of text that are encoded at once, a longer text in one.
CHUNK = 4 << 20


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _letters() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _marked(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_SPACE, _MARK, _LETTER, _LEAD = _marked(SPACE), _marked(MARKS), _marked("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"), np.zeros(256, bool)
_LEAD[[c.encode()[0] for c in WIDE_SPACE]] = True
_WIDE = {c.encode() for c in WIDE_SPACE}


def starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the pieces of texts begin; data holds their bytes, text i those from bounds[i] to bounds[i + 1].

    Cuts: before each run of white space, between a lone line end and the word after it, between a letter and a mark.
    """
    n = len(data)
    space = _SPACE[data]
    for i in np.flatnonzero(_LEAD[data]).tolist() if _LEAD[data].any() else ():
        for size in (2, 3):
            if data[i : i + size].tobytes() in _WIDE:
                space[i : i + size] = True
    cut = space.copy()
    cut[1:] &= ~space[:-1]
    cut[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
    line = np.flatnonzero(cut & (data == 10)) + 1
    line = line[line < n]
    cut[line[~space[line]]] = True
    mark = np.flatnonzero(_MARK[data])
    mark = mark[mark > 0]
    one = _LETTER[data[mark - 1]]
    two = (data[mark - 2] == 0xC3) & (data[mark - 1] >= 0x80) & (data[mark - 1] != 0x97) & (data[mark - 1] != 0xB7) & (mark > 1)
    cut[mark[one | two]] = True
    return np.flatnonzero(cut)


class Encoder:
    """encode(texts) gives the ids of Arrow strings, each text's closed by the end id 0; a null text is empty.

    Names of special tokens in a text are ordinary text, as the vocabularies' own description sets the library up.
    """

    def __init__(self, path: str, keep: int = 200_000, long: int = 64):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.lower = self.library.normalizer is not None and self.library.normalizer.normalize_str("A b") == "a b"
        self.keep, self.long, self.letters = keep, long, _letters()
        self.now: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, texts: pa.Array, chunk: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first, bounds, ids) for runs of texts: text first + i has the ids from bounds[i] to bounds[i + 1]."""
        texts = texts.cast(pa.large_string()).fill_null("")
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        first, collecting = 0, gc.isenabled()
        while first < len(texts):
            end = max(first + 1, int(np.searchsorted(at, at[first] + chunk, side="right")) - 1)
            gc.disable()  # many short-lived strings and no cycles: collections would only walk through them
            try:
                made = self._encode(data[at[first] : at[end]], at[first : end + 1] - at[first])
            finally:
                if collecting:
                    gc.enable()
            yield first, *made
            first = end

    def _encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces are numbered, looked up once each, and their ids put together by number; an empty piece ends each text."""
        begin = starts(data, bounds)
        ends = np.searchsorted(begin, bounds[1:]) + np.arange(1, len(bounds))
        offsets = np.sort(np.concatenate((begin, bounds[1:], bounds[-1:])), kind="stable").astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data))
        numbered = pieces.dictionary_encode()
        values = self._values(numbered.dictionary.to_numpy(zero_copy_only=False).tolist())
        at = np.cumsum([0, *map(len, values)], dtype=np.int64) // 4
        ids = pa.LargeListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(values), "<u4"))).take(numbered.indices)
        place = ids.offsets.to_numpy()
        return np.concatenate(([0], place[ends] - place[0])), ids.flatten().to_numpy()

    def _values(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces."""
        found = list(map(self.now.get, pieces))
        missing = [p for p, v in zip(pieces, found, strict=True) if v is None]
        if not missing:
            return found
        if len(self.now) + len(missing) > self.keep:
            self.old, self.now = self.now, {}
        made = {p: self.old[p] for p in missing if p in self.old}
        made |= self._ids([p for p in missing if p not in made])
        if len(made) <= self.keep:  # else more pieces than are ever kept
            self.now |= made
            for p in [p for p in made if len(p) > self.long]:
                del self.now[p]
        return [made[p] if v is None else v for p, v in zip(pieces, found, strict=True)]

    def _ids(self, pieces: list[str]) -> dict[str, bytes]:
        """Of each piece: a word by the library's model at once, another through its whole chain, the empty one the end id."""
        tokenize, letters, found, rest = self.library.model.tokenize, self.letters, {}, []
        lower, space = self.lower, self.letters[32]
        for p in pieces:
            if not WORD(p):
                rest.append(p)
                continue
            w = p.lower().lstrip(" ") if lower else p
            w = w.replace(" ", space) if w.isascii() else w.encode().decode("latin-1").translate(letters)
            found[p] = array("I", [t.id for t in tokenize(w)]).tobytes()
        for i in range(0, len(rest), 1024):
            for p, e in zip(rest[i : i + 1024], self.library.encode_batch_fast(rest[i : i + 1024], add_special_tokens=False), strict=True):
                found[p] = array("I", e.ids).tobytes()
        if "" in found:
            found[""] = b"\x00\x00\x00\x00"
        return found
