"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string the encoder stores the one token that can come last in the encoding of that
prefix. A token may follow another only if merging by rank keeps the border between the two, and for each prefix
exactly one token that ends there follows the last token of what precedes it. So a prefix's encoding never has to
be revised: appends go on from the stored entries, and an edit only re-encodes from the edit to the point where
pieces are the same again.

Defined results: a null or empty text has no tokens (n_tokens 0, digests of the empty string); repeated rows are
encoded each; other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import hashlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from annogrid.llm.common import map_batches

#: A vocabulary file larger than this is not broadcast.
MAX_VOCABULARY_BYTES = 64 << 20
#: Pieces whose encodings a worker remembers.
CACHE_PIECES = 500_000
CACHE_PIECE_CHARS = 64
#: Prefixes of pieces whose last tokens a worker remembers, and the longest piece that goes there.
SHARED_PREFIXES = 600_000
SHARED_PREFIX_BYTES = 64
#: Pairs of tokens whose border a worker remembers.
REMEMBERED_PAIRS = 400_000


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """The ranks of a .tiktoken file."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


class PrefixEncoder:
    """Encodes byte strings by ranks; the tables depend on the vocabulary only."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.follows: dict[int, bool] = {}
        self.ending: dict[bytes, int] = {}
        self.known: dict[bytes, int] = {}
        self.length = [len(self.bytes_of.get(rank, b"")) for rank in range(max(ranks.values()) + 1)]
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            reachable = len(token) == 1 or self._learn(token, rank)
            for k in range(1, len(token)):
                self.ending.setdefault(token[k:], -1)
            if reachable:
                self.ending[token] = rank
            else:
                self.ending.setdefault(token, -1)

    def _learn(self, token: bytes, rank: int) -> bool:
        """Find the last merge that makes a token; False if merging its bytes never makes it."""
        for k in range(1, len(token)):
            left, right = self.ranks.get(token[:k], rank), self.ranks.get(token[k:], rank)
            if left < rank and right < rank and self._border_holds(left, right):
                self.halves[rank] = left, right
                self.merged[left, right] = rank
                return True
        return False

    def _border_holds(self, left: int, right: int) -> bool:
        """Whether merging by rank keeps the border between two tokens.

        Both tokens are taken apart again, latest merge first. If the two parts at the border could have merged
        before the merge that was undone last, the border would not have lasted.
        """
        before = 1 << 40
        while True:
            if self.merged.get((left, right), before) < before:
                return False
            can_left, can_right = left in self.halves, right in self.halves
            if can_left and (left > right or not can_right):
                before, left = left, self.halves[left][1]
            elif can_right:
                before, right = right + 1, self.halves[right][0]
            else:
                return True

    def may_follow(self, left: int, right: int) -> bool:
        """As _border_holds, remembered by one number for both tokens."""
        key = left << 32 | right
        known = self.follows.get(key)
        if known is None:
            if len(self.follows) >= REMEMBERED_PAIRS:
                self.follows.clear()
            known = self.follows[key] = self._border_holds(left, right)
        return known

    def extend(self, data: bytes, last: list[int], start: int) -> None:
        """Fill last[i] (the last token of data[:i]) for every i from start + 1 on."""
        ending, may_follow, follows = self.ending.get, self.may_follow, self.follows
        del last[start + 1 :]
        for i in range(start + 1, len(data) + 1):
            k = i - 1
            while True:
                token = ending(data[k:i])
                if token is None:
                    raise ValueError(f"no valid token ends at byte {i}")
                if token >= 0:
                    if k == 0:
                        break
                    known = follows.get(last[k] << 32 | token)
                    if known or known is None and may_follow(last[k], token):
                        break
                k -= 1
                if k < 0:
                    raise ValueError(f"no valid token ends at byte {i}")
            last.append(token)

    def walk_back(self, last: list[int], end: int) -> list[int]:
        ids, size = [], self.bytes_of
        while end:
            ids.append(last[end])
            end -= len(size[last[end]])
        ids.reverse()
        return ids

    def encode_piece(self, piece: bytes) -> list[int]:
        """A piece that is itself in the vocabulary is that token, as in the public library."""
        if not piece:
            return []
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) > SHARED_PREFIX_BYTES:
            last = [-1]
            self.extend(piece, last, 0)
            return self.walk_back(last, len(piece))
        known = self.known
        start = len(piece)
        while start and piece[:start] not in known:
            start -= 1
        if start < len(piece):
            self._extend_shared(piece, start)
        ids, end = [], len(piece)
        while end:
            token = known[piece[:end]]
            ids.append(token)
            end -= self.length[token]
        ids.reverse()
        return ids

    def _extend_shared(self, piece: bytes, start: int) -> None:
        """As extend, with the table of all pieces so far as one trie: prefixes that pieces share are done once."""
        known, ending, follows = self.known, self.ending.get, self.follows.get
        if len(known) > SHARED_PREFIXES:
            known.clear()
            start = 0
        for i in range(start + 1, len(piece) + 1):
            k, prefix = i - 1, piece[:i]
            while True:
                token = ending(prefix[k:])
                if token is None or k < 0:
                    raise ValueError(f"no valid token ends at byte {i}")
                if token >= 0:
                    if k == 0:
                        break
                    before = known[prefix[:k]]
                    valid = follows(before << 32 | token)
                    if valid or valid is None and self.may_follow(before, token):
                        break
                k -= 1
            known[prefix] = token

    def decode(self, ids) -> bytes:
        table = self.bytes_of
        return b"".join([table[i] for i in ids])


class PrefixTable:
    """The stored last tokens of one growing byte string: exact appends, cuts and edits without the text's pieces."""

    def __init__(self, encoder: PrefixEncoder, data: bytes = b""):
        self.encoder, self.data, self.last = encoder, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        start, self.data = len(self.data), self.data + more
        self.encoder.extend(self.data, self.last, start)

    def cut(self, end: int) -> None:
        self.data = self.data[:end]
        del self.last[end + 1 :]

    def edit(self, start: int, end: int, new: bytes) -> None:
        tail = self.data[end:]
        self.cut(start)
        self.append(new + tail)

    def ids(self, end: int | None = None) -> list[int]:
        """The encoding of the first end bytes (of all by default), read back from the table."""
        return self.encoder.walk_back(self.last, len(self.data) if end is None else end)


class EncodedText:
    """A text kept with the encodings of its pieces; appends and edits only re-encode the pieces they touch.

    A piece's border depends on at most the piece itself and the white space after it, so splitting goes on from the
    last two pieces before a change and stops where it meets an old border past the change.
    """

    def __init__(self, encoder: PrefixEncoder, pattern: str, text: str = ""):
        self.encoder, self.split = encoder, regex.compile(pattern)
        self.text, self.starts, self.tokens = "", [], []
        self.recoded = 0
        self.edit(0, 0, text)

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace text[start:end] by new."""
        from bisect import bisect_left, bisect_right

        shift = len(new) - (end - start)
        text = self.text[:start] + new + self.text[end:]
        first = max(0, bisect_right(self.starts, start) - 3)
        at = self.starts[first] if self.starts else 0
        starts, tokens, safe, last = [], [], start + len(new), len(self.starts)
        for match in self.split.finditer(text, at):
            old = match.start() - shift
            if match.start() > safe and old > end:
                k = bisect_left(self.starts, old)
                if k < len(self.starts) and self.starts[k] == old:
                    last = k
                    break
            starts.append(match.start())
            tokens.append(self.encoder.encode_piece(match.group().encode()))
        self.recoded = len(starts)
        self.starts = self.starts[:first] + starts + [x + shift for x in self.starts[last:]]
        self.tokens = self.tokens[:first] + tokens + self.tokens[last:]
        self.text = text

    def ids(self) -> list[int]:
        return [i for piece in self.tokens for i in piece]


class _Pieces(dict):
    """Packed ids by piece; pieces not seen yet are encoded on the way."""

    def __init__(self, encoder: PrefixEncoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        packed = np.array(self.encoder.encode_piece(piece.encode()), "<u4").tobytes()
        if len(piece) <= CACHE_PIECE_CHARS:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = packed
        return packed


_coders: dict = {}


class TextCoder:
    """Encodes and decodes whole texts; one for each worker, vocabulary and pattern."""

    def __init__(self, vocabulary: bytes, pattern: str):
        self.encoder = PrefixEncoder(parse_ranks(vocabulary))
        self.pieces, self.split = _Pieces(self.encoder), regex.compile(pattern).findall
        self.bytes_of = [self.encoder.bytes_of.get(i, b"") for i in range(max(self.encoder.bytes_of) + 1)]

    @classmethod
    def of(cls, vocabulary: bytes, pattern: str) -> TextCoder:
        key = hashlib.sha256(vocabulary + pattern.encode()).digest()
        if key not in _coders:
            _coders[key] = cls(vocabulary, pattern)
        return _coders[key]

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def decode(self, packed: bytes) -> bytes:
        table = self.bytes_of
        return b"".join([table[i] for i in np.frombuffer(packed, "<u4").tolist()])


def encode_documents(
    docs: DataFrame, vocabulary_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """Encode every text, decode the ids again, and return counts and digests (with_ids: the packed ids and the decoded bytes too)."""
    data = Path(vocabulary_path).read_bytes()
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"vocabulary of {len(data)} bytes; at most {MAX_VOCABULARY_BYTES} are broadcast")
    vocabulary = docs.sparkSession.sparkContext.broadcast(data)
    id_type = dict(docs.dtypes)[id_col]
    extra = ", ids binary, decoded binary" if with_ids else ""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = TextCoder.of(vocabulary.value, pattern)
        counts, digests, decoded_digests, ids, decoded = [], [], [], [], []
        for text in batch.column(1).to_pylist():
            packed = coder.encode(text or "")
            plain = coder.decode(packed)
            counts.append(len(packed) // 4)
            digests.append(hashlib.sha256(packed).hexdigest())
            decoded_digests.append(hashlib.sha256(plain).hexdigest())
            if with_ids:
                ids.append(packed)
                decoded.append(plain)
        columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded_digests, pa.string())]
        names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            columns += [pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())]
            names += ["ids", "decoded"]
        return pa.RecordBatch.from_arrays(columns, names)

    return map_batches(
        docs.select(id_col, text_col), run, f"`{id_col}` {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}"
    )
