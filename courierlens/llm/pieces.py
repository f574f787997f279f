"""Splitting texts into pre-tokens, and a bounded per-worker memory of encoded pieces."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import regex

#: Fixed value: the splitting pattern of both vocabularies (public_tokenizers.PATTERN).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# The standard engine is twice as fast but has no letter classes. It is used on texts that
# hold nothing beyond ASCII, Latin-1 letters and general punctuation, where classes can be listed.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_LISTED = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+"
_BEYOND = re.compile(rf"[^\t\n\x0b\x0c\r -~{_LETTERS}‐-‧]")
_general = regex.compile(PATTERN).findall
_listed = re.compile(_LISTED).findall


def pieces(text: str) -> list[str]:
    """The matches of PATTERN, which together make up the whole text."""
    return _general(text) if _BEYOND.search(text) else _listed(text)


#: Bytes that a generation of a memory may take, characters of the longest piece that is remembered, and bytes
#: that Python takes for an entry besides its text and ids.
MEMORY_BYTES, LONGEST_KEPT, ENTRY_BYTES = 80 << 20, 256, 180


def _cost(piece: str, data: bytes) -> int:
    return ENTRY_BYTES + len(piece) + len(data)


class Memory:
    """Id bytes of pieces. Two generations of about ``limit`` bytes each; older ones are forgotten.

    ``encode`` turns a list of unseen pieces into their id bytes. Long pieces are encoded each time.
    """

    def __init__(self, encode: Callable[[list[str]], Iterable[bytes]], limit: int = MEMORY_BYTES):
        self._encode, self._limit, self._held = encode, limit, 0
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """The id bytes of every text; none for a null or empty text."""
        split = [pieces(t) if t else () for t in texts]
        if self._held > self._limit:
            self._older, self._known, self._held = self._known, {}, 0
        known, older = self._known, self._older
        unseen = [p for p in set().union(*split) if p not in known]
        known.update((p, older[p]) for p in unseen if p in older)
        new = [p for p in unseen if p not in known]
        known.update(zip(new, self._encode(new)))
        found = [b"".join(map(known.__getitem__, s)) for s in split]
        for piece in [p for p in new if len(p) > LONGEST_KEPT]:
            del known[piece]
        self._held += sum(_cost(p, known[p]) for p in unseen if p in known)
        return found


class LazyMemory(dict):
    """The same for an encoder that takes one piece at a time: it is called where a lookup fails."""

    def __init__(self, encode: Callable[[str], bytes], limit: int = MEMORY_BYTES):
        super().__init__()
        self._encode, self._limit, self._held, self._older = encode, limit, 0, {}

    def __missing__(self, piece: str) -> bytes:
        data = self._older.get(piece)
        if data is None:
            data = self._encode(piece)
        if len(piece) <= LONGEST_KEPT:
            self[piece] = data
            self._held += _cost(piece, data)
        return data

    def ids(self, text: str | None) -> bytes:
        if self._held > self._limit:
            self._older, self._held = dict(self), 0
            self.clear()
        return b"".join(map(self.__getitem__, pieces(text))) if text else b""


def slices(sizes: Iterable[int], most: int) -> Iterable[tuple[int, int]]:
    """Runs of neighbouring rows (first, behind the last) of at most ``most`` in all, one row at least."""
    first, held, at = 0, 0, -1
    for at, size in enumerate(sizes):
        if held and held + size > most:
            yield first, at
            first, held = at, 0
        held += size or 1
    if at >= first:
        yield first, at + 1
