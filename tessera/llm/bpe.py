"""Byte-level BPE: encoding by a lazily determinised finite-state transducer, decoding by an incremental UTF-8 machine.

Encoding. The tokens form a tree; a machine that may start a token at every byte is at several nodes of the tree at once.
Its sets of nodes become states, and its arcs are made when first taken: an arc names the next state and the tokens that
end at the byte, the longest first. Of these exactly one is the last token of the encoding so far: that which merging leaves
side by side with the last token at its start. This pair test undoes merges and is memoised. After LOOKAHEAD bytes
at most, tokens leave up to the last border that every token still under way shares, which is the end if none is. A piece that is itself a token becomes that token, as in public rank-file encoders.

Each match of the split pattern is encoded by itself; words and matches seen before come from bounded caches in the worker.
Texts of any length are read whole, and a match of any length takes time in proportion to its bytes.

Decoding. Token bytes are fed in runs to a UTF-8 state machine that holds back an incomplete last character until its
bytes arrive, so a run may end inside a character.

Edge cases: a null or empty text has no ids and decodes to the empty text; bytes that are no UTF-8 decode to U+FFFD; an id
outside the vocabulary is an error. Ids are little-endian unsigned 32-bit integers in a binary column. An input column
with the name of an output column is replaced by it; rows, repeated or not, are independent.
"""

from __future__ import annotations

import base64
import gc
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bounds of what a worker keeps: arcs, tested pairs, and the bytes of split matches and of words with their ids.
MAX_ARCS = 200_000
MAX_PAIRS = 300_000
MAX_PIECE_BYTES = 32 << 20
MAX_WORD_BYTES = 64 << 20
#: What an entry of a cache takes beside its characters and ids.
ENTRY_BYTES = 160
#: Bytes after which decided tokens are emitted.
LOOKAHEAD = 256
#: Above all ranks.
NONE = 1 << 60
FLUSH_BYTES = 4 << 20


class Transducer:
    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.sizes = {i: len(t) for t, i in ranks.items()}
        #: The tree of tokens: (node << 8 | byte) to node; the token that a node ends, or -1; its depth; whether it goes on.
        self.tree: dict[int, int] = {}
        self.ends, self.depth, self.inner = [-1], [0], [True]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                self.inner[node] = True
                if (child := self.tree.get(node << 8 | byte)) is None:
                    child = self.tree[node << 8 | byte] = len(self.ends)
                    self.ends.append(-1)
                    self.depth.append(self.depth[node] + 1)
                    self.inner.append(False)
                node = child
            self.ends[node] = rank
        self.pairs: dict[int, bool] = {}
        self.made: dict[int, tuple[int, int] | None] = {}
        if max(ranks[t] for t in ranks if len(t) == 1) > min((ranks[t] for t in ranks if len(t) > 1), default=NONE):
            raise ValueError("single bytes must have the lowest ranks")
        self.reset()

    def reset(self) -> None:
        #: A state is the nodes of tokens under way, the longest first; state 0 has none.
        self.states: dict[tuple[int, ...], int] = {(): 0}
        self.nodes: list[tuple[int, ...]] = [()]
        #: (state << 8 | byte) to the next state and the (length, token) that end there, the longest first.
        self.arcs: dict[int, tuple[int, tuple[tuple[int, int], ...]]] = {}

    def arc(self, state: int, byte: int) -> tuple[int, tuple[tuple[int, int], ...]]:
        reached = [c for n in (*self.nodes[state], 0) if (c := self.tree.get(n << 8 | byte)) is not None]
        under_way = tuple(c for c in reached if self.inner[c])
        if (after := self.states.get(under_way)) is None:
            after = self.states[under_way] = len(self.nodes)
            self.nodes.append(under_way)
        made = self.arcs[state << 8 | byte] = after, tuple((self.depth[c], self.ends[c]) for c in reached if self.ends[c] >= 0)
        return made

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the last merge of a token joins; None for a byte. A token that merging never makes has -1."""
        if token not in self.made:
            piece = self.tokens[token]
            if len(piece) == 1:
                self.made[token] = None
            else:
                *_, (left, right) = self.merges(piece, token)
                self.made[token] = left, right
        return self.made[token]

    def merges(self, piece: bytes, token: int) -> Iterator[tuple[int, int]]:
        """The pairs that plain merging joins; (-1, -1) at the end if the result is not the token."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(a + b, NONE), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best == NONE:
                break
            yield self.ranks[parts[at]], self.ranks[parts[at + 1]]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) > 1:
            yield -1, -1

    def fits(self, before: int, token: int) -> bool:
        """Whether merging leaves the two tokens side by side; before is -1 at the start of a piece.

        The merges next to the border are undone, the latest first: a pair across the border that would have been joined
        before the merge just undone means that the border does not stand.
        """
        key = before + 1 << 32 | token
        if (known := self.pairs.get(key)) is not None:
            return known
        if len(self.pairs) > MAX_PAIRS:
            self.pairs.clear()
        known = self.halves(token) != (-1, -1)
        left, right, limit = before, token, NONE
        while known and left >= 0:
            if self.ranks.get(self.tokens[left] + self.tokens[right], NONE) < limit:
                known = False
            elif left > right:
                # of two merges of one rank the left one comes first
                if (halves := self.halves(left)) is None:
                    break
                limit, left = left, halves[1]
            else:
                if (halves := self.halves(right)) is None:
                    break
                limit, right = right + 1, halves[0]
        self.pairs[key] = known
        return known

    def encode(self, piece: bytes) -> list[int]:
        if (token := self.ranks.get(piece)) is not None:
            return [token]
        if len(self.arcs) > MAX_ARCS:
            self.reset()
        out: list[int] = []
        state, last, arcs, pairs = 0, [-1], self.arcs.get, self.pairs.get
        for byte in piece:
            state, ending = arcs(state << 8 | byte) or self.arc(state, byte)
            found, end = -2, len(last)
            for size, token in ending:
                if size <= end and (before := last[end - size]) >= -1:
                    known = pairs(before + 1 << 32 | token)
                    if known or known is None and self.fits(before, token):
                        found = token
                        break
            last.append(found)
            if end >= LOOKAHEAD:
                last = self.decided(state, last, out)
        way, at = [], len(last) - 1
        while at > 0:
            way.append(last[at])
            at -= self.sizes[way[-1]]
        way.reverse()
        return out + way

    def way(self, last: list[int], end: int) -> list[int]:
        """Token borders on the way back from end to 0."""
        out = [end]
        while end > 0:
            end -= self.sizes[last[end]]
            out.append(end)
        return out

    def decided(self, state: int, last: list[int], out: list[int]) -> list[int]:
        """Emit the tokens that no later byte can change; what is left of last, from its first border on."""
        end = len(last) - 1
        cut = end
        if state:
            starts = [end - self.depth[n] for n in self.nodes[state]]
            common = set(self.way(last, end)) if last[end] >= -1 else None
            for start in starts:
                if start >= 0 and last[start] >= -1:
                    way = set(self.way(last, start))
                    common = way if common is None else common & way
            cut = max(common or {0})
        if cut:
            way = self.way(last, cut)
            out += [last[at] for at in reversed(way[:-1])]
            left = last[cut:]
            # tokens that reach back over the cut are on no way that is left
            return left[:1] + [t if t >= 0 and self.sizes[t] <= j else -2 for j, t in enumerate(left[1:], 1)]
        return last


def ranges(test) -> str:
    """The code points that pass a test, as ranges for a character class."""
    out, begun = [], None
    for i in range(sys.maxunicode + 2):
        if i <= sys.maxunicode and test(chr(i)):
            begun = i if begun is None else begun
        elif begun is not None:
            out.append(f"\\U{begun:08x}-\\U{i - 1:08x}")
            begun = None
    return "".join(out)


#: White_Space; str.isspace() also holds four separator controls.
SPACES = ranges(lambda c: c.isspace() and not "\x1c" <= c <= "\x1f")


def split_pattern(pattern: str) -> re.Pattern:
    r"""The pattern for the standard module, with its \p{L}, \p{N} and \s as explicit ranges of code points.

    \s is the White_Space property here, as in rank-file encoders; the ranges come from the Unicode database.
    """

    letters = ranges(lambda c: unicodedata.category(c)[0] == "L")
    numbers = ranges(lambda c: unicodedata.category(c)[0] == "N")
    for name, held in ((r"\p{L}", letters), (r"\p{N}", numbers), (r"\s", SPACES)):
        pattern = re.sub(r"\[([^\]]*)\]", lambda m: "[" + m[1].replace(name, held) + "]", pattern)  # noqa: B023
        pattern = pattern.replace(name, f"[{held}]")
    return re.compile(pattern.replace(r"\S", f"[^{SPACES}]"))


class Cache(dict):
    """From a text to its packed ids, with a bound on bytes: what was met since half of the bound was filled, and ``older``,
    what was met in the half before."""

    def __init__(self, bound: int) -> None:
        super().__init__()
        self.older: dict[str, bytes] = {}
        self.half, self.size = bound // 2, 0

    def made(self, text: str) -> bytes:
        raise NotImplementedError

    def __missing__(self, text: str) -> bytes:
        packed = self.older.get(text)
        if packed is None:
            packed = self.made(text)
            if len(text) > 64:
                return packed
        if self.size > self.half:
            self.older, self.size = dict(self), 0
            self.clear()
        self.size += ENTRY_BYTES + len(text) + len(packed)
        self[text] = packed
        return packed


class Pieces(Cache):
    """From a match of the split pattern."""

    def __init__(self, transducer: Transducer) -> None:
        super().__init__(MAX_PIECE_BYTES)
        self.transducer = transducer

    def made(self, text: str) -> bytes:
        return array("I", self.transducer.encode(text.encode())).tobytes()


class Words(Cache):
    """From white space with the word after it. No match of the pattern has white space after another character, so each
    word is split by itself, once."""

    #: Runs that no match crosses the end of.
    unit = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")

    def __init__(self, pattern: str, transducer: Transducer) -> None:
        super().__init__(MAX_WORD_BYTES)
        self.split, self.pieces = split_pattern(pattern), Pieces(transducer)

    def made(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split.findall(text)))

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.unit.findall(text)))


#: Bytes that a lead byte asks for after it.
FOLLOW = [0] * 0xC2 + [1] * 30 + [2] * 16 + [3] * 5 + [0] * 11


class Utf8Stream:
    """An incremental UTF-8 decoder: feed() returns the characters that are complete so far."""

    def __init__(self) -> None:
        self.held = b""

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data)
        for back in range(1, min(3, cut) + 1):
            byte = data[-back]
            if byte < 0x80:
                break
            if byte >= 0xC0:
                if FOLLOW[byte] >= back:
                    cut -= back
                break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def end(self) -> str:
        held, self.held = self.held, b""
        return held.decode("utf-8", "replace")


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


_encoders: dict[tuple[str, str], Words] = {}


def _encoder(ranks: Broadcast, pattern: str) -> Words:
    """One for each worker process."""
    key = (ranks.value["id"], pattern)
    if key not in _encoders:
        gc.set_threshold(200_000, 50, 50)  # large caches, none of them garbage, would be walked again and again
        _encoders.clear()
        _encoders[key] = Words(pattern, Transducer(ranks.value["ranks"]))
    return _encoders[key]


def _share(df: DataFrame, path: str) -> Broadcast:
    """The vocabulary, a file of fixed size, read by the driver so that executors need no copy."""
    return df.sparkSession.sparkContext.broadcast({"id": path, "ranks": read_ranks(path)})


class Decoder:
    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.at = {i: t for t, i in ranks.items()}.__getitem__

    def decode(self, ids: bytes | None) -> str:
        stream, parts = Utf8Stream(), []
        numbers = np.frombuffer(ids or b"", "<u4")
        for i in range(0, len(numbers), 16_384):
            parts.append(stream.feed(b"".join(map(self.at, numbers[i : i + 16_384].tolist()))))
        return "".join([*parts, stream.end()])


def _mapped(df: DataFrame, given: str, added: list[tuple[str, T.DataType, pa.DataType]], keep: list[str] | None, each) -> DataFrame:
    """df's kept columns and the added ones, which each()(value) makes from the given column; Arrow batches stay small."""
    names = [name for name, _, _ in added]
    keep = [c for c in (df.columns if keep is None else keep) if c not in names]
    schema = T.StructType([*(df.schema[c] for c in keep), *(T.StructField(name, kind) for name, kind, _ in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = each()
        for batch in batches:
            values, made, held, begun = batch.column(given), [], 0, 0
            for i, value in enumerate(values):
                made.append(make(value.as_py()))
                held += sum(len(x) for x in made[-1] if not isinstance(x, bool))
                if held >= FLUSH_BYTES or i == batch.num_rows - 1:
                    part = batch.slice(begun, i + 1 - begun)
                    columns = [pa.array(column, kind) for column, (_, _, kind) in zip(zip(*made, strict=True), added, strict=True)]
                    yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), *columns], names=[*keep, *names])
                    made, held, begun = [], 0, i + 1

    return df.select(*dict.fromkeys([*keep, given])).mapInArrow(run, schema)


def encode(
    df: DataFrame, path: str, pattern: str, *, text_col: str = "text", out: str = "ids", keep: list[str] | None = None, decoded: str | None = None, restored: str | None = None
) -> DataFrame:
    """df with a binary column of token ids and, where named, the text that these ids decode to and whether it is the given one.

    keep: the input columns that stay; all, if None.
    """
    ranks = _share(df, path)
    text, flag = [(decoded, T.StringType(), pa.string())] if decoded else [], [(restored, T.BooleanType(), pa.bool_())] if restored else []
    added = [(out, T.BinaryType(), pa.binary()), *text, *flag]

    def each():
        words = _encoder(ranks, pattern)
        back = Decoder(ranks.value["ranks"]) if decoded or restored else None

        def make(text: str | None) -> tuple:
            ids = words.encode(text) if text else b""
            if back is None:
                return (ids,)
            again = back.decode(ids)
            return ids, *([again] if decoded else []), *([again == (text or "")] if restored else [])

        return make

    return _mapped(df, text_col, added, keep, each)


def decode(df: DataFrame, path: str, *, ids_col: str = "ids", out: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """df with the text of a binary column of token ids."""
    ranks = _share(df, path)

    def each():
        back = Decoder(ranks.value["ranks"])
        return lambda ids: (back.decode(ids),)

    return _mapped(df, ids_col, [(out, T.StringType(), pa.string())], keep, each)
