"""Encoding with the public tokenizers, unit by unit, with the units a worker has met remembered.

The bytes of some megabytes of text are cut by numpy wherever a pre-tokenizer cuts in any case: before white space, and
between letters, digits and signs. Both sides of a cut are ASCII, so no composed character spans it; no cut touches an
apostrophe or a bar, which begin contractions and special strings. The encodings of the units, one after the other, are
the encoding of the text; a fuzz test compares them. What else holds for a vocabulary (white space dropped, case folded,
digits alone) is asked of its tokenizer and makes units fewer. Arrow numbers the distinct units of a stretch, only those
not yet met go to the tokenizer, and ids are put together by one gather.
"""

from __future__ import annotations

import os
import string
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of units and ids that a worker remembers for one vocabulary, in two generations; the older one goes when the
#: younger is full, and what is used meanwhile moves into the younger.
REMEMBERED_BYTES = 96 << 20
#: A unit longer than this is encoded anew each time; an entry costs about this much beside its bytes.
LONGEST_KEPT, ENTRY_BYTES = 64, 200
UNITS_A_CALL = 20_000

OTHER, LETTER, DIGIT, SIGN, BLANK, SPACE, GLUE = range(7)


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _kinds() -> np.ndarray:
    kinds = np.full(256, OTHER, np.uint8)
    for chars, kind in ((string.punctuation, SIGN), (string.ascii_letters, LETTER), (string.digits, DIGIT), ("'|", GLUE),
                        (" ", BLANK), ("\t\n\x0b\x0c\r", SPACE)):
        kinds[list(chars.encode())] = kind
    return kinds


KINDS = _kinds()


class Units:
    """Unit -> little-endian 32-bit ids, for one tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.held = 0
        a, b = self._ids("ax"), self._ids("b")
        self.drops_space = all(self._ids(f"{x}ax{y}b") == a + b for x in ("", " ") for y in (" ", "\n", " \n ", "\t\r\x0b\x0c"))
        self.folds_case = self._ids("Ax BY") == self._ids("ax by")
        single_digits = self._ids(string.digits) == [i for x in string.digits for i in self._ids(x)]
        word, solid, space = (LETTER, DIGIT, SIGN), (LETTER, DIGIT, SIGN, GLUE), (BLANK, SPACE)
        cuts = np.zeros((8, 8), bool)
        for left in range(8):
            for right in range(8):
                cuts[left, right] = (left in solid and right in space) or (left in word and right in word and left != right) \
                    or (single_digits and left == right == DIGIT) or (self.drops_space and left in space and right in solid)
        self.cuts, self.solid = cuts.ravel(), np.isin(np.arange(8), solid)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def cut(self, texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
        """All texts' units in order, and at which unit each text starts (and the last one ends)."""
        raw = b"".join(texts)
        data = np.frombuffer(raw, np.uint8)
        kinds = KINDS[data]
        at = np.zeros(len(data) + 1, bool)
        ends = np.cumsum([0, *map(len, texts)])
        at[ends] = True
        if len(data) > 1:
            at[1:-1] |= self.cuts[kinds[:-1] << 3 | kinds[1:]]
        if len(data) > 2 and not self.drops_space:  # behind a line end or tab that stands alone
            alone = np.flatnonzero(kinds[1:-1] == SPACE) + 1
            at[alone[self.solid[kinds[alone - 1]] & self.solid[kinds[alone + 1]]] + 1] = True
        if self.folds_case and len(data) > 1:
            # not before a byte beyond ASCII, with which a letter may compose, nor beside a bar
            capital = np.flatnonzero((data[:-1] - np.uint8(65)) < 26)
            plain = (data[capital + 1] < 128) & (kinds[capital + 1] != GLUE) & (kinds[np.maximum(capital, 1) - 1] != GLUE)
            data = data.copy()
            data[capital[plain]] += 32
        offsets = np.flatnonzero(at).astype(np.int32)
        units = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        return units, np.searchsorted(offsets, ends)

    def values(self, units: list[bytes]) -> list[bytes]:
        """Ids of each unit; the tokenizer sees only those not remembered."""
        old = self.old
        found = list(map(self.young.get, units))
        unmet = [i for i, value in enumerate(found) if value is None]
        new = []
        for i in unmet:
            value = found[i] = old.get(units[i])
            if value is None:
                new.append(i)
            else:
                self._keep(units[i], value)
        for a in range(0, len(new), UNITS_A_CALL):
            some = new[a : a + UNITS_A_CALL]
            for i, coded in zip(some, self.encode([units[i].decode() for i in some], add_special_tokens=False), strict=True):
                found[i] = array("I", coded.ids).tobytes()
                if len(units[i]) <= LONGEST_KEPT:
                    self._keep(units[i], found[i])
        return found

    def _keep(self, unit: bytes, value: bytes) -> None:
        if self.held > REMEMBERED_BYTES // 2:
            self.old, self.young, self.held = self.young, {}, 0
        self.young[unit] = value
        self.held += len(unit) + len(value) + ENTRY_BYTES

    def looked_up(self, texts: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """(number of each unit's distinct value, those values, first unit of each text)."""
        units, starts = self.cut(texts)
        coded = units.dictionary_encode()
        distinct = coded.dictionary
        ends = np.frombuffer(distinct.buffers()[1], np.int32, len(distinct) + 1).tolist()
        raw = distinct.buffers()[2].to_pybytes() if len(distinct) else b""
        return coded.indices.to_numpy(), self.values([raw[a:b] for a, b in zip(ends, ends[1:])]), starts


@lru_cache(maxsize=4)
def units_of(path: str) -> Units:
    """One for each worker process and file."""
    return Units(path)


def _bytes(texts: list[str] | list[bytes]) -> list[bytes]:
    return [x.encode() if isinstance(x, str) else x for x in texts]


def encode_ids(texts: list[str] | list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after the other, and where each text's begin (and the last one's end)."""
    which, values, starts = units_of(path).looked_up(_bytes(texts))
    flat = np.frombuffer(b"".join(values), "<u4")
    sizes = np.fromiter(map(len, values), np.int64, len(values)) >> 2
    first = np.cumsum(sizes) - sizes
    each = sizes[which]
    ends = np.concatenate([[0], np.cumsum(each)])
    ids = flat[np.arange(ends[-1]) + np.repeat(first[which] - ends[:-1], each)]
    return ids, ends[starts]


def encode_all(texts: list[str] | list[bytes], path: str) -> list[bytes]:
    """Ids of each text, little-endian unsigned 32-bit."""
    ids, at = encode_ids(texts, path)
    raw = ids.tobytes()
    return [raw[4 * a : 4 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def count_all(texts: list[str] | list[bytes], path: str) -> list[int]:
    """Number of ids of each text."""
    which, values, starts = units_of(path).looked_up(_bytes(texts))
    sizes = np.fromiter(map(len, values), np.int64, len(values)) >> 2
    ends = np.concatenate([[0], np.cumsum(sizes[which])])
    return np.diff(ends[starts]).tolist()
