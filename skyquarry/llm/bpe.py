"""Token ids of texts by a public byte-level BPE vocabulary (problem 8).

Prefix dynamic programming: a piece of text is encoded by storing, for each of its byte prefixes, the
one token with which a valid encoding of the prefix ends. A token may follow another exactly if the two
alone, joined, are encoded as these two; so each new prefix needs only its neighbours, bytes can be
appended without looking back further, and after an edit only the pieces around it are encoded anew.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how texts are cut into pieces before encoding.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries kept in a task's memory of pieces and of pairs; beyond, the memory starts anew.
MEMORY = 300_000


class Vocabulary:
    """Ranks of tokens; a rank is both the id and the priority of the merge that makes the token."""

    def __init__(self, lines: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines.splitlines() if line)}
        self.bytes = {i: t for t, i in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.pieces: dict[str, list[int]] = {}
        self._pairs: dict[tuple[int, int], bool] = {}
        self._find = regex.compile(PATTERN).findall

    def merge(self, data: bytes) -> list[int]:
        """Encoding by merging the pair of lowest rank, again and again; used for pairs of tokens only."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def may_follow(self, a: int, b: int) -> bool:
        pair = (a, b)
        known = self._pairs.get(pair)
        if known is None:
            if len(self._pairs) >= MEMORY:
                self._pairs.clear()
            known = self._pairs[pair] = self.merge(self.bytes[a] + self.bytes[b]) == [a, b]
        return known

    def extend(self, data: bytes, last: list[int]) -> None:
        """Fills ``last``, the last token of each prefix of ``data``, from where it ends."""
        for end in range(len(last), len(data) + 1):
            for start in range(max(0, end - self.longest), end):
                token = self.ranks.get(data[start:end])
                if token is not None and (start == 0 or self.may_follow(last[start], token)):
                    last.append(token)
                    break
            else:
                raise ValueError("a byte is not in the vocabulary")

    def walk(self, last: list[int]) -> list[int]:
        """Ids of the bytes whose prefixes' last tokens are ``last``."""
        ids, end = [], len(last) - 1
        while end:
            ids.append(last[end])
            end -= len(self.bytes[last[end]])
        ids.reverse()
        return ids

    def piece(self, text: str) -> list[int]:
        ids = self.pieces.get(text)
        if ids is None:
            last = [-1]
            self.extend(text.encode("utf-8", "surrogatepass"), last)
            ids = self.walk(last)
            if len(self.pieces) >= MEMORY:
                self.pieces.clear()
            self.pieces[text] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        piece, known = self.piece, self.pieces
        return [i for p in self._find(text) for i in (known.get(p) or piece(p))]

    def split(self, text: str) -> list[str]:
        return self._find(text)


class Piece:
    """A piece of text with its prefix table: the last token of each byte prefix."""

    __slots__ = ("text", "data", "last")

    def __init__(self, vocabulary: Vocabulary, text: str, old: "Piece | None" = None):
        self.text, self.data, self.last = text, text.encode("utf-8", "surrogatepass"), [-1]
        if old is not None:  # what both begin with keeps its entries
            same = next((k for k, (x, y) in enumerate(zip(self.data, old.data)) if x != y), min(len(self.data), len(old.data)))
            self.last = old.last[: same + 1]
        vocabulary.extend(self.data, self.last)


class Editable:
    """A text with the prefix tables of its pieces, kept exact under appends and edits.

    Pieces lie in blocks of bounded length, so a place is found and pieces are exchanged without walking
    over the text. A piece depends on the text to its right only at its end, and a contraction on the two
    pieces before it; so two pieces to the left of a change are cut again, and to the right as many as
    it takes until an old boundary returns. A piece that begins like the old one in its place goes on from
    the old table. ``encoded`` counts the bytes that the last change entered into tables.
    """

    BLOCK = 256

    def __init__(self, vocabulary: Vocabulary, text: str = ""):
        self.vocabulary = vocabulary
        self.blocks: list[list[Piece]] = [[]]
        self.lengths = [0]
        self.encoded = 0
        if text:
            self.edit(0, 0, text)

    def __iter__(self) -> Iterator[Piece]:
        return (p for block in self.blocks for p in block)

    @property
    def text(self) -> str:
        return "".join(p.text for p in self)

    @property
    def ids(self) -> list[int]:
        return [i for p in self for i in self.vocabulary.walk(p.last)]

    def append(self, more: str) -> None:
        self.edit(sum(self.lengths), 0, more)

    def _find(self, at: int) -> tuple[int, int, int]:
        """Block, index and start of the piece that is cut again first for a change at ``at``."""
        start, b = 0, 0
        while b < len(self.blocks) - 1 and start + self.lengths[b] < at:
            start += self.lengths[b]
            b += 1
        k = 0
        while k < len(self.blocks[b]) and start + len(self.blocks[b][k].text) < at:
            start += len(self.blocks[b][k].text)
            k += 1
        for _ in range(2):
            if k == 0 and b > 0:
                b -= 1
                k = len(self.blocks[b])
            if k:
                k -= 1
                start -= len(self.blocks[b][k].text)
        return b, k, start

    def edit(self, at: int, removed: int, inserted: str) -> None:
        """Replaces ``removed`` characters from ``at`` on by ``inserted``."""
        if at < 0 or removed < 0 or at + removed > sum(self.lengths):
            raise IndexError("the edit reaches beyond the text")
        first_block, first, start = self._find(at)
        taken: list[Piece] = []  # old pieces from ``start`` on
        following = (p for b in range(first_block, len(self.blocks)) for p in self.blocks[b][first if b == first_block else 0 :])
        reached, more = start, 4
        while True:
            whole = False
            while reached < at + removed or more:
                piece = next(following, None)
                if piece is None:
                    whole = True
                    break
                taken.append(piece)
                if reached >= at + removed:
                    more -= 1
                reached += len(piece.text)
            old = "".join(p.text for p in taken)
            window = old[: at - start] + inserted + old[at - start + removed :]
            cuts, shift = self.vocabulary.split(window), len(inserted) - removed
            bounds, place = {}, start
            for k, p in enumerate(taken):
                bounds[place] = k
                place += len(p.text)
            fresh, here, keep = [], start, len(taken)
            for k, text in enumerate(cuts):
                # a boundary of old pieces beyond the change, and not at the end of the window, where a cut may depend on what follows
                if here >= at + len(inserted) and here - shift >= at + removed and here - shift in bounds and k < len(cuts) - 1:
                    keep = bounds[here - shift]
                    break
                fresh.append(text)
                here += len(text)
            else:
                if not whole:
                    more = 2 * len(taken)
                    continue
            break
        before = {}
        place = start
        for p in taken[:keep]:
            before[place] = p
            place += len(p.text)
        new, place, self.encoded = [], start, 0
        for text in fresh:
            old_piece = before.get(place)
            if old_piece is not None and old_piece.text == text:
                new.append(old_piece)
            else:
                new.append(Piece(self.vocabulary, text, old_piece))
                same = next((k for k, (x, y) in enumerate(zip(new[-1].data, old_piece.data)) if x != y), min(len(new[-1].data), len(old_piece.data))) if old_piece else 0
                self.encoded += len(new[-1].data) - same
            place += len(text)
        self._exchange(first_block, first, keep, new)

    def _exchange(self, b: int, k: int, n: int, new: list[Piece]) -> None:
        """Puts ``new`` in the place of ``n`` pieces from piece ``k`` of block ``b`` on."""
        last = b
        rest = n
        while rest > len(self.blocks[last]) - (k if last == b else 0) and last < len(self.blocks) - 1:
            rest -= len(self.blocks[last]) - (k if last == b else 0)
            last += 1
        tail = self.blocks[last][(k if last == b else 0) + rest :]
        pieces = self.blocks[b][:k] + new + tail
        blocks = [pieces[i : i + self.BLOCK] for i in range(0, len(pieces), self.BLOCK)] or [[]]
        self.blocks[b : last + 1] = blocks
        self.lengths[b : last + 1] = [sum(len(p.text) for p in block) for block in blocks]


def _encoder(lines, counts: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = Vocabulary(lines.value)
        for pdf in batches:
            ids = [vocabulary.encode(t) if t else [] for t in pdf.text]
            yield pdf.drop(columns="text").assign(**({"n_tokens": [len(i) for i in ids]} if counts else {"ids": ids}))

    return run


def _encoded(df: DataFrame, key: str, text: Column, extra: list[str], counts: bool, path: str) -> DataFrame:
    with open(path, "rb") as f:
        lines = df.sparkSession.sparkContext.broadcast(f.read())  # a fixed file of under 1 MB
    source = df.select(F.col(key), *extra, text.alias("text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in source.dtypes if c != "text") + (", n_tokens long" if counts else ", ids array<int>")
    return source.mapInPandas(_encoder(lines, counts), schema)


def encode(df: DataFrame, key: str, text: str, *, path: str = VOCABULARY) -> DataFrame:
    """(key, ids) of every row, in its order: no special tokens; an empty list for an empty or null text.

    Strings of special tokens are ordinary text. Repeated rows and null keys come out as they are, extra
    columns are ignored, texts of any length are encoded whole, an empty table gives an empty result.
    """
    return _encoded(df, key, F.col(text), [], False, path)


def count_tokens(df: DataFrame, key: str, text: str, extra: list[str], *, path: str = VOCABULARY) -> DataFrame:
    """(key, extra columns, n_tokens) of every row."""
    return _encoded(df, key, F.col(text), extra, True, path)
