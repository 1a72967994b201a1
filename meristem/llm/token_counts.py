"""Edit-aware token counts: a segment tree over each document's pre-tokens, kept in a table.

``tree_table`` encodes every document once and stores its tree: the pre-tokens' lengths and token counts in blocks, and the
segment tree of the blocks' sums. ``edited_trees`` takes stored trees and a batch of edits and gives the trees after them, which a
later batch takes in turn; no document is split or encoded as a whole again. An edit re-splits the text from the first
pre-token that it can change (the pattern looks at most two code points beyond what it takes, so from the one that ends one code
point before the edit) until a new pre-token begins where an old one did beyond the edit; only these pre-tokens are encoded
again. Touched blocks are cut anew into blocks of at most ``BLOCK`` pre-tokens; if their number stays, only the sums above them are
updated, otherwise the sums are laid out anew from the blocks' sums.

The pattern looks ahead but never behind, so a split from any pre-token's start equals the whole text's split there.

Defined cases: a null text counts as empty; edits apply in order, each to the text that the one before it left; positions are
code points, cut to the text; null edits are none; repeated rows each get a row; an empty table gives no rows; key columns
may have any name but those of the results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import bounded_batches, staged

BLOCK = 64


def _chunks(values: list[int]) -> list[list[int]]:
    return [values[i : i + BLOCK] for i in range(0, len(values), BLOCK)]


def _packed(values: list[int]) -> bytes:
    """A byte for each value; values from 255 on are 255 there and follow behind as 32-bit numbers."""
    all_ = np.array(values, np.int64)
    return np.minimum(all_, 255).astype(np.uint8).tobytes() + all_[all_ >= 255].astype("<u4").tobytes()


def _unpacked(data: bytes, n: int) -> list[int]:
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<u4", offset=n)
    return out.tolist()


class TokenTree:
    """Pre-token segment tree of one text."""

    def __init__(self, text: str, split: Callable, count: Callable[[str], int]):
        parts = split(text)
        self.text, self.split, self.count, self.encoded = text, split, count, 0
        self.sizes = _chunks(list(map(len, parts))) or [[]]
        self.tokens = _chunks(list(map(count, parts))) or [[]]
        self._lay_out([sum(x) for x in self.sizes], [sum(x) for x in self.tokens])

    @classmethod
    def stored(cls, row: dict, split: Callable, count: Callable[[str], int]) -> TokenTree:
        """A tree as ``row`` keeps it."""
        tree = cls.__new__(cls)
        tree.text, tree.split, tree.count, tree.encoded = row["text"] or "", split, count, 0
        ends = np.cumsum(np.frombuffer(row["blocks"], np.uint8), dtype=np.int64).tolist()
        starts = [0, *ends[:-1]]
        sizes, tokens = (_unpacked(row[c], ends[-1]) for c in ("sizes", "counts"))
        tree.sizes = [sizes[i:j] for i, j in zip(starts, ends, strict=True)]
        tree.tokens = [tokens[i:j] for i, j in zip(starts, ends, strict=True)]
        tree.chars, tree.sums = (np.frombuffer(row[c], "<u4").astype(np.int64) for c in ("chars", "sums"))
        tree.leaves = len(tree.sums) // 2
        return tree

    def row(self) -> dict:
        flat = lambda blocks: _packed([x for own in blocks for x in own])
        lengths = bytes(map(len, self.sizes))
        return {"text": self.text, "blocks": lengths, "sizes": flat(self.sizes), "counts": flat(self.tokens), "chars": self.chars.astype("<u4").tobytes(), "sums": self.sums.astype("<u4").tobytes()}

    def _lay_out(self, chars: list[int], sums: list[int]) -> None:
        """The segment tree above the blocks' sums."""
        self.leaves = 1 << (len(chars) - 1).bit_length()
        self.chars, self.sums = np.zeros(2 * self.leaves, np.int64), np.zeros(2 * self.leaves, np.int64)
        self.chars[self.leaves : self.leaves + len(chars)], self.sums[self.leaves : self.leaves + len(chars)] = chars, sums
        level = self.leaves
        while level > 1:
            for tree in (self.chars, self.sums):
                tree[level // 2 : level] = tree[level : 2 * level].reshape(-1, 2).sum(axis=1)
            level //= 2

    @property
    def total(self) -> int:
        return int(self.sums[1])

    @property
    def pieces(self) -> int:
        return sum(map(len, self.sizes))

    def _refresh(self, block: int) -> None:
        node = self.leaves + block
        self.chars[node], self.sums[node] = sum(self.sizes[block]), sum(self.tokens[block])
        node //= 2
        while node:
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]
            node //= 2

    def _seek(self, at: int) -> tuple[int, int]:
        """The block that holds code point ``at`` (the last block for the end) and its start, by descent."""
        node, start = 1, 0
        while node < self.leaves:
            node *= 2
            if at >= start + self.chars[node]:
                start += int(self.chars[node])
                node += 1
        block = node - self.leaves
        if block >= len(self.sizes):
            block = len(self.sizes) - 1
            start = len(self.text) - int(self.chars[self.leaves + block])
        return block, start

    def edit(self, start: int, length: int, insert: str) -> None:
        """Replace ``length`` code points from ``start`` by ``insert``."""
        old = self.text
        start = min(max(start, 0), len(old))
        stop = min(start + max(length, 0), len(old))
        shift = len(insert) - (stop - start)
        self.text = new = old[:start] + insert + old[stop:]
        # The first pre-token that ends one code point before the edit or later.
        first, at = self._seek(max(0, start - 2))
        k = 0
        while k < len(self.sizes[first]) and at + self.sizes[first][k] < start - 1:
            at += self.sizes[first][k]
            k += 1
        begin = at
        # Old pre-tokens from there on, as far as they are needed; new ones until both begin alike beyond the edit.
        block, i, old_at = first, k, at
        sizes, tokens = [], []
        position = begin
        done = False
        for m in self.split.iter(new, begin):
            if position >= start + len(insert):
                while old_at + shift < position or old_at < stop:
                    while block < len(self.sizes) and i >= len(self.sizes[block]):
                        block, i = block + 1, 0
                    if block >= len(self.sizes):
                        break
                    old_at += self.sizes[block][i]
                    i += 1
                if old_at + shift == position and old_at >= stop and block < len(self.sizes):
                    done = True
                    break
            piece = m.group()
            sizes.append(len(piece))
            tokens.append(self.count(piece))
            position += len(piece)
        self.encoded += len(sizes)
        if not done:
            block, i = len(self.sizes), 0
        keep_sizes, keep_tokens, last = self.sizes[first][:k] + sizes, self.tokens[first][:k] + tokens, min(block, len(self.sizes) - 1)
        if block < len(self.sizes):
            keep_sizes += self.sizes[block][i:]
            keep_tokens += self.tokens[block][i:]
        own = _chunks(keep_sizes) or ([[]] if last - first + 1 == len(self.sizes) else [])
        blocks = len(self.sizes)
        chars, sums = (tree[self.leaves : self.leaves + blocks].tolist() for tree in (self.chars, self.sums))
        self.sizes[first : last + 1], self.tokens[first : last + 1] = own, _chunks(keep_tokens) or ([[]] if own else [])
        if len(self.sizes) == blocks:
            for b in range(first, last + 1):
                self._refresh(b)
        else:
            chars[first : last + 1], sums[first : last + 1] = [sum(x) for x in own], [sum(x) for x in self.tokens[first : first + len(own)]]
            self._lay_out(chars, sums)


class _Split:
    def __init__(self, pattern: str):
        compiled = regex.compile(pattern)
        self.all, self.iter = compiled.findall, lambda text, at: compiled.finditer(text, at)

    def __call__(self, text: str) -> list[str]:
        return self.all(text)


class _Counts(dict):
    """Token counts of pre-tokens, bounded."""

    def __init__(self, encode: Callable[[str], list[int]], most: int = 800_000):
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, piece: str) -> int:
        if len(self) >= self.most:
            self.clear()
        n = self[piece] = len(self.encode(piece))
        return n


_LOADED: dict[str, tuple[_Split, Callable[[str], int]]] = {}


def counter(path: str | None = None) -> tuple[_Split, Callable[[str], int]]:
    """Splitter and counter of a public byte-level vocabulary (ranks file); by default the one installed for the workers."""
    import base64

    import public_tokenizers
    import tiktoken

    where = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    if where not in _LOADED:
        with open(where, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        _LOADED[where] = _Split(public_tokenizers.PATTERN), _Counts(encoding.encode_ordinary).__getitem__
    return _LOADED[where]


#: A stored tree's columns: the text, the blocks' lengths, the pre-tokens' sizes and token counts, the two segment trees.
TREE = {"text": "string", "blocks": "binary", "sizes": "binary", "counts": "binary", "chars": "binary", "sums": "binary"}
_ARROW = {"string": pa.string(), "binary": pa.binary(), "bigint": pa.int64()}
EDITS = "array<struct<start:bigint,length:bigint,insert:string>>"


def _batch(batch: pa.RecordBatch, keys: list[str], names: dict[str, str], rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({c: batch.column(c) for c in keys} | {n: pa.array([r[n] for r in rows], _ARROW[t]) for n, t in names.items()})


def _schema(frame: DataFrame, keys: list[str], names: dict[str, str]):
    return frame.select(*keys).withColumns({c: F.lit(None).cast(t) for c, t in names.items()}).schema


def tree_table(documents: DataFrame, keys: list[str], tokenizer_path: str | None = None) -> DataFrame:
    """``keys`` of ``documents`` (text ...) with each text's tree (``TREE``), and n_pieces and n_tokens."""
    bounded_batches(documents.sparkSession)
    names = TREE | {"n_pieces": "bigint", "n_tokens": "bigint"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, count = counter(tokenizer_path)
        for batch in batches:
            trees = [TokenTree(text or "", split, count) for text in batch.column("__text").to_pylist()]
            yield _batch(batch, keys, names, [t.row() | {"n_pieces": t.pieces, "n_tokens": t.total} for t in trees])

    return documents.select(*keys, F.col("text").cast("string").alias("__text")).mapInArrow(run, _schema(documents, keys, names))


def edited_trees(trees: DataFrame, edits: Column | DataFrame, keys: list[str], tokenizer_path: str | None = None, keep: bool = True) -> DataFrame:
    """Trees (``keys`` and ``TREE``) after a batch of edits: ``keys``, n_pieces and tokens_before, tokens_after, n_encoded (pre-tokens
    encoded for the edits), text_after and, with ``keep``, the new trees. ``edits``: an array of structs (start, length, insert),
    as a column of ``trees`` or as a table (``keys``, edits) that is joined."""
    bounded_batches(trees.sparkSession)
    names = {"n_pieces": "bigint", "tokens_before": "bigint", "tokens_after": "bigint", "n_encoded": "bigint", "text_after": "string"} | (TREE if keep else {})
    if isinstance(edits, DataFrame):
        rows = trees.join(edits.select(*keys, F.col("edits").cast(EDITS).alias("__edits")).hint("merge"), keys, "left").select(*keys, *TREE, "__edits")
    else:
        rows = trees.select(*keys, *TREE, edits.cast(EDITS).alias("__edits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, count = counter(tokenizer_path)
        for batch in batches:
            out = []
            for row in batch.select([*TREE, "__edits"]).to_pylist():
                tree = TokenTree.stored(row, split, count)
                was = {"n_pieces": tree.pieces, "tokens_before": tree.total}
                for e in row["__edits"] or ():
                    if e is not None:
                        tree.edit(e["start"] or 0, e["length"] or 0, e["insert"] or "")
                out.append((tree.row() if keep else {}) | was | {"tokens_after": tree.total, "n_encoded": tree.encoded, "text_after": tree.text})
            yield _batch(batch, keys, names, out)

    return rows.mapInArrow(run, _schema(trees, keys, names))


def edited_counts(documents: DataFrame, edits: Column, keys: list[str], tokenizer_path: str | None = None) -> DataFrame:
    """Counts before and after ``edits`` (a column of ``documents``) through a stored table of trees."""
    kept = documents.select(*keys, "text", edits.cast(EDITS).alias("__kept_edits"))
    trees = staged(tree_table(kept, [*keys, "__kept_edits"], tokenizer_path), "token-trees", "zstd")
    return edited_trees(trees, F.col("__kept_edits"), keys, tokenizer_path, keep=False)
