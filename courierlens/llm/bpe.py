"""Byte-level BPE by prefix dynamic programming, and decoding.

Every byte prefix of a piece has exactly one valid encoding, so its last token says all there
is to know about it: dropping that token leaves a shorter prefix with its own last token. A
token that ends at a position is the right one if it is compatible with the last token of the
prefix before it, which depends on these two tokens alone. One pass from left to right fills
the table; bytes appended later continue it, an edit keeps everything ahead of it.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from courierlens.llm.pieces import Memory, slices

#: Text handled at once in a task.
SLICE_CHARS = 2_000_000


class Vocabulary:
    """Ranked byte strings. The rank is the token's id and the priority of the merge that makes it."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=0)
        self._halves: dict[int, tuple[int, int] | tuple[()] | None] = {}
        self._fit: dict[tuple[int, int], bool] = {}
        #: Finds all tokens that end at a position. Its alphabet is the bytes, as Latin-1 text.
        self.ending = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.ending.add_word(token.decode("latin-1"), (rank, len(token)))
        self.ending.make_automaton()

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            fields = [line.split() for line in lines if line.strip()]
        return cls({base64.b64decode(token): int(rank) for token, rank in fields})

    def halves(self, token: int) -> tuple[int, int] | tuple[()] | None:
        """The two tokens whose merge makes this one; () for a single byte, None if no merges lead to it."""
        if token not in self._halves:
            data = self.tokens[token]
            parts = [data[i:i + 1] for i in range(len(data))]
            while len(parts) > 2:
                rank, at = min((self.ranks.get(parts[i] + parts[i + 1], token), i) for i in range(len(parts) - 1))
                if rank >= token:
                    break
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            found: tuple[int, int] | tuple[()] | None = None
            if len(parts) == 1:
                found = ()
            elif len(parts) == 2 and all(p in self.ranks for p in parts):
                found = (self.ranks[parts[0]], self.ranks[parts[1]])
            self._halves[token] = found
        return self._halves[token]

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens stay side by side when their joined bytes are encoded.

        Goes back in time over the tokens that touched at their border. They would have
        merged if the merge outranks the next change on either side; on a tie the one
        further left goes first. With ``left`` -1 for none: whether merges lead to ``right``.
        """
        if len(self._fit) > 1_000_000:
            self._fit.clear()
        self._fit[left, right] = fits = self._fits(left, right)
        return fits

    def _fits(self, left: int, right: int) -> bool:
        if self.halves(right) is None:
            return False
        ranks, tokens, until = self.ranks, self.tokens, float("inf")
        while left >= 0:
            merged = ranks.get(tokens[left] + tokens[right])
            if merged is not None and merged < until:
                return False
            of_left, of_right = self.halves(left), self.halves(right)
            if of_left and (not of_right or left > right):
                until, left = left, of_left[1]
            elif of_right:
                until, right = right + 1, of_right[0]
            else:
                break
        return True

    def fill(self, text: str, last: list[int], first: int = 0, until: int | None = None) -> None:
        """Fills in the last token of every prefix of ``text`` that ends behind ``first``, up to ``until``.

        ``last`` has one entry per border between characters. Characters beyond Latin-1 are in
        no token, so they separate texts that are handled together. -1 marks the start of a text.
        """
        known, fits = self._fit.get, self.fits
        from_here = max(0, first - self.longest)
        for at, (token, length) in self.ending.iter(text, from_here, len(text) if until is None else until):
            end = at + 1
            if last[end] < 0 and end > first:
                before = last[end - length]
                if end - length < from_here:
                    continue
                fit = known((before, token))
                if fit or fit is None and fits(before, token):
                    last[end] = token

    def walk(self, last: list[int], start: int, end: int) -> list[int]:
        """The ids of the text between two borders, read backwards from its last token."""
        found, tokens = [], self.tokens
        while end > start:
            token = last[end]
            if token < 0:
                raise ValueError("a byte is not in the vocabulary")
            found.append(token)
            end -= len(tokens[token])
        found.reverse()
        return found

    @cached_property
    def _bytes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All tokens' bytes in a row, and where each id's bytes start and how many they are."""
        starts, lengths = np.zeros((2, max(self.tokens, default=0) + 1), np.int64)
        at = 0
        for token, data in self.tokens.items():
            starts[token], lengths[token] = at, len(data)
            at += len(data)
        return np.frombuffer(b"".join(self.tokens.values()), np.uint8), starts, lengths

    def decode(self, ids: np.ndarray) -> bytes:
        joined, starts, lengths = self._bytes
        sizes = lengths[ids]
        ahead = np.cumsum(sizes) - sizes
        return joined[np.repeat(starts[ids] - ahead, sizes) + np.arange(sizes.sum())].tobytes()


class Prefixes:
    """The last token of every byte prefix of ``data``, for one growing or changing piece.

    ``filled`` says how many entries the last change has computed.
    """

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self._vocabulary, self.data, self._last, self.filled = vocabulary, b"", [-1], 0
        self.append(data)

    def append(self, more: bytes) -> Prefixes:
        """Continues the table; what it holds so far stays as it is."""
        known = len(self.data)
        self.data += more
        self._last += [-1] * len(more)
        self._vocabulary.fill(self.data.decode("latin-1"), self._last, known)
        self.filled = len(more)
        return self

    def edit(self, start: int, end: int, new: bytes) -> Prefixes:
        """Replaces data[start:end]. Prefixes up to ``start`` stay.

        An entry follows from the bytes and the entries within the length of the longest token ahead
        of it. So where that many entries behind the new bytes are what they were, all later ones are, too.
        """
        old, longest = self._last, self._vocabulary.longest
        shift, changed = len(new) - (end - start), start + len(new)
        self.data = self.data[:start] + new + self.data[end:]
        size, text = len(self.data), self.data.decode("latin-1")
        last = old[:start + 1] + [-1] * (size - start)
        done = start
        while done < size:
            step = min(size, done + 2 * longest)
            self._vocabulary.fill(text, last, done, step)
            done = step
            first = done - longest + 1
            if first > changed and last[first:done + 1] == old[first - shift:done + 1 - shift]:
                break
        self._last, self.filled = last[:done + 1] + old[done + 1 - shift:], done - start
        return self

    def ids(self) -> list[int]:
        return self._vocabulary.walk(self._last, 0, len(self.data))


#: Between pieces that are encoded in one go.
_BORDER = "\u0100"


def encode_pieces(vocabulary: Vocabulary, pieces: list[str]) -> list[list[int]]:
    """Ids of each piece. A piece that is itself a token is that token, whatever merges lead to."""
    data = [p.encode() for p in pieces]
    found = [[whole] if (whole := vocabulary.ranks.get(d)) is not None else None for d in data]
    left = [i for i, ids in enumerate(found) if ids is None]
    for at in range(0, len(left), 4096):
        some = left[at:at + 4096]
        text = _BORDER.join(data[i].decode("latin-1") for i in some)
        last = [-1] * (len(text) + 1)
        vocabulary.fill(text, last)
        start = 0
        for i in some:
            found[i] = vocabulary.walk(last, start, start + len(data[i]))
            start += len(data[i]) + 1
    return found


class Encoder:
    """Encodes whole texts piece by piece to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary.load(path)
        self.ids = Memory(lambda new: (np.array(ids, "<u4").tobytes() for ids in encode_pieces(self.vocabulary, new))).ids


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process and vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_texts(df: DataFrame, key: str, text: str, vocabulary: str, with_ids: bool = True) -> DataFrame:
    """Encodes and decodes whole texts.

    Returns ``key``, n_tokens, ids_sha256 (of little-endian unsigned 32-bit ids), decoded_sha256
    and, if asked for, ids and decoded. A null or an empty text has no ids; a null key stays null
    and repeated rows stay repeated. Other columns are not read. ``vocabulary`` is the path of a
    file of base64 tokens and ranks that every executor has. No shuffle.
    """
    rows = df.select(df[key].alias("key"), df[text].cast("string").alias("text"))
    kind = df.schema[key].dataType.simpleString()
    schema = "key " + kind + ", n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for first, behind in slices((len(t or "") for t in texts), SLICE_CHARS):
                n, sha, decoded_sha, lists, decoded = [], [], [], [], []
                for data in own.ids(texts[first:behind]):
                    ids = np.frombuffer(data, "<u4")
                    back = own.vocabulary.decode(ids)
                    n.append(len(ids))
                    sha.append(hashlib.sha256(data).hexdigest())
                    decoded_sha.append(hashlib.sha256(back).hexdigest())
                    if with_ids:
                        lists.append(ids)
                        decoded.append(back)
                columns = [batch.column(0).slice(first, behind - first), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(decoded_sha, pa.string())]
                if with_ids:
                    columns += [pa.array(lists, pa.list_(pa.int32())), pa.array(decoded, pa.binary())]
                names = ["key", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][:len(columns)]
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
