"""Token counts that follow edits.

A document's pre-tokens are the leaves of a segment tree whose nodes sum characters and
tokens. An edit finds its place by descending over the characters; from a few pre-tokens
before it (what a pre-token looks at ahead of itself may have changed) the text is split
anew until a new boundary falls on an old one, for from there on nothing changes. Only
those pre-tokens are encoded again, and only the sums above their blocks are updated.
"""

from __future__ import annotations

import base64
import importlib.util
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrove.cluster import ship

#: Pre-tokens in a leaf block; a block that outgrows four times as many makes the tree be laid out again.
BLOCK = 64
#: Pre-tokens before an edit that are split again. A pre-token looks at most over one run of white space ahead, which is three pre-tokens.
CONTEXT = 4
_CACHE = 400_000  # encoded pre-tokens that a worker keeps before it starts afresh
_SEGMENT = 1 << 20  # characters that are split at a time

#: Fixed value: the split pattern of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_vocabulary() -> str | None:
    """The installed public 50k byte-level vocabulary, or None."""
    spec = importlib.util.find_spec("public_tokenizers")
    if spec is None or not spec.submodule_search_locations:
        path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
        return path if os.path.exists(path) else None
    return os.path.join(next(iter(spec.submodule_search_locations)), "byte_bpe_50k.tiktoken")


class Tokenizer:
    """Counts the tokens of pre-tokens by a byte-level vocabulary file (base64 bytes and rank a line)."""

    def __init__(self, path: str, pattern: str = PATTERN):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self._encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._split = regex.compile(pattern)
        self._safe = regex.compile(r"\p{L}(?= \p{L})")
        self._known: dict[str, int] = {}

    def split(self, text: str) -> list[str]:
        return self._split.findall(text)

    def pieces(self, text: str, at: int = 0) -> Iterator[str]:
        """Pre-tokens from ``at`` on, one by one."""
        for found in self._split.finditer(text, at):
            yield found[0]

    def count(self, pieces: list[str]) -> np.ndarray:
        known, encode = self._known, self._encode
        if len(known) > _CACHE:
            known.clear()
        out = []
        for p in pieces:
            n = known.get(p)
            if n is None:
                n = known[p] = len(encode(p))
            out.append(n)
        return np.array(out, dtype=np.int64)

    def measured(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(characters, tokens) of each pre-token, long texts a stretch at a time."""
        chars, tokens, at = [], [], 0
        while at < len(text):
            end = len(text)
            if end - at > _SEGMENT:  # between a letter and a space before a letter there is always a boundary
                near = self._safe.search(text, at + _SEGMENT)
                end = near.end() if near else end
            pieces = self.split(text[at:end])
            chars.append(np.fromiter(map(len, pieces), np.int64, len(pieces)))
            tokens.append(self.count(pieces))
            at = end
        if not chars:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(chars), np.concatenate(tokens)


class TokenTree:
    """The segment tree over one document's pre-tokens."""

    def __init__(self, text: str, tokenizer: Tokenizer):
        self.text, self.tokenizer, self.encoded = text, tokenizer, 0
        self._lay(*tokenizer.measured(text))

    def _lay(self, chars: np.ndarray, tokens: np.ndarray) -> None:
        n = max(1, -(-len(chars) // BLOCK))
        self.blocks = [(chars[i * BLOCK : (i + 1) * BLOCK], tokens[i * BLOCK : (i + 1) * BLOCK]) for i in range(n)]
        self.width = 1 << (n - 1).bit_length()
        self.sums = np.zeros((2 * self.width, 2), np.int64)
        edges = np.arange(0, n * BLOCK, BLOCK)
        if len(chars):
            self.sums[self.width : self.width + n, 0] = np.add.reduceat(chars, edges)
            self.sums[self.width : self.width + n, 1] = np.add.reduceat(tokens, edges)
        low = self.width
        while low > 1:
            level = self.sums[low : 2 * low]
            self.sums[low // 2 : low] = level[0::2] + level[1::2]
            low //= 2

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def pretokens(self) -> int:
        return sum(len(b[0]) for b in self.blocks)

    def _block_at(self, char: int) -> tuple[int, int]:
        """(block that holds the character or ends there, characters before the block)."""
        node, before = 1, 0
        while node < self.width:
            left = int(self.sums[2 * node, 0])
            node *= 2
            if char > before + left:
                before, node = before + left, node + 1
        return min(node - self.width, len(self.blocks) - 1), before

    def _update(self, block: int) -> None:
        node = self.width + block
        self.sums[node] = self.blocks[block][0].sum(), self.blocks[block][1].sum()
        while node > 1:
            node //= 2
            self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]

    def edit(self, start: int, length: int, replacement: str) -> None:
        """Replace ``length`` characters from ``start`` on; both are cut to the text."""
        start = max(0, min(start, len(self.text)))
        end = max(start, min(start + length, len(self.text)))
        if start == end and not replacement:
            return
        grown = len(replacement) - (end - start)
        block, before = self._block_at(start)
        chars = self.blocks[block][0]
        place = int(np.searchsorted(np.cumsum(chars), start - before))  # first pre-token that ends at or after start
        first_block, first = block, place
        back = CONTEXT
        while back and (first or first_block):
            if not first:
                first_block -= 1
                first = len(self.blocks[first_block][0])
                before -= int(self.sums[self.width + first_block, 0])
                continue
            first, back = first - 1, back - 1
        at = before + int(self.blocks[first_block][0][:first].sum())
        self.text = self.text[:start] + replacement + self.text[end:]
        # walk the old boundaries (in new characters) and the new ones until they meet behind the edit
        fresh: list[str] = []
        new, old, b, i = at, at, first_block, first
        for piece in self.tokenizer.pieces(self.text, at):
            fresh.append(piece)
            new += len(piece)
            while old + grown < new and b < len(self.blocks):
                if i == len(self.blocks[b][0]):
                    b, i = b + 1, 0
                    continue
                old += int(self.blocks[b][0][i])
                i += 1
            if old + grown == new and old >= end and new >= start + len(replacement):
                break
        else:
            b, i = len(self.blocks) - 1, len(self.blocks[-1][0])
        b = min(b, len(self.blocks) - 1)
        self.encoded += len(fresh)
        tokens = self.tokenizer.count(fresh)
        lengths = np.fromiter(map(len, fresh), np.int64, len(fresh))
        head, tail = self.blocks[first_block], self.blocks[b]
        lengths = np.concatenate([head[0][:first], lengths, tail[0][i:]])
        tokens = np.concatenate([head[1][:first], tokens, tail[1][i:]])
        touched = range(first_block, b + 1)
        if len(lengths) > 4 * BLOCK * len(touched):
            rest = self.blocks[b + 1 :]
            self._lay(np.concatenate([x[0] for x in self.blocks[:first_block]] + [lengths] + [x[0] for x in rest]), np.concatenate([x[1] for x in self.blocks[:first_block]] + [tokens] + [x[1] for x in rest]))
            return
        share = np.linspace(0, len(lengths), len(touched) + 1).astype(int)
        for k, at_block in enumerate(touched):
            self.blocks[at_block] = (lengths[share[k] : share[k + 1]], tokens[share[k] : share[k + 1]])
            self._update(at_block)


_tokenizers: dict[str, Tokenizer] = {}


def tokenizer_at(path: str) -> Tokenizer:
    """The worker's tokenizer for a vocabulary file."""
    if path not in _tokenizers:
        _tokenizers[path] = Tokenizer(path)
    return _tokenizers[path]


EDITS_TYPE = "array<struct<start:long,length:long,replacement:string>>"


def edited_counts(docs: DataFrame, edits: Column, path: str | None) -> DataFrame:
    """doc_id, n_chars, n_pretokens, n_tokens, n_edits, n_reencoded, n_chars_after, n_tokens_after of each row.

    ``docs`` needs doc_id and text. ``edits`` is an array of (start, length, replacement) in
    characters, applied in order, each to the text that the earlier ones left; starts and
    lengths beyond the text are cut to it. Null text is empty, null edits are none, and a
    null field of an edit is 0 or empty. Repeated rows count each; no rows give no rows; other
    columns, whatever their names, are not looked at. A document, however long, is held by
    one task at a time, and its tree is the only thing that is kept. ``path`` is a vocabulary
    file that the driver can read; it is sent to the executors. ValueError if it is None or
    not there.
    """
    ship(docs.sparkSession)
    if path is None or ("://" not in path and not os.path.exists(path)):
        raise ValueError(f"token counts need a vocabulary file, and {path or 'none'} was found")
    docs.sparkSession.sparkContext.addFile(path)
    name = os.path.basename(path)
    own = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), edits.cast(EDITS_TYPE).alias("edits"))
    kind = own.schema["doc_id"].dataType.simpleString()
    names = ["n_chars", "n_pretokens", "n_tokens", "n_edits", "n_reencoded", "n_chars_after", "n_tokens_after"]

    def run(batches):
        import pyarrow as pa
        from pyspark import SparkFiles

        tokenizer = tokenizer_at(SparkFiles.get(name))
        for batch in batches:
            out = []
            for text, changes in zip(batch.column(1), batch.column(2)):
                tree = TokenTree(text.as_py(), tokenizer)
                row = [len(tree.text), tree.pretokens, tree.tokens]
                changes = changes.as_py() or []
                for c in changes:
                    if c is not None:
                        tree.edit(c["start"] or 0, max(0, c["length"] or 0), c["replacement"] or "")
                out.append(row + [len(changes), tree.encoded, len(tree.text), tree.tokens])
            columns = np.array(out, np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(columns[:, k]) for k in range(len(names))], names=["doc_id"] + names)

    return own.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names))


def stated_edits(doc_id: Column, text: Column) -> Column:
    """The edits that the query applies to a document, by hashes of its id: one replacement, one insertion, one deletion."""
    size = F.char_length(F.coalesce(text, F.lit("")))
    place = lambda k: F.pmod(F.crc32(F.concat_ws("|", F.lit(k), doc_id.cast("string")).cast("binary")), size + 1)
    edit = lambda k, length, what: F.struct(place(k).alias("start"), F.lit(length).cast("long").alias("length"), F.lit(what).alias("replacement"))
    return F.array(edit("replace", 9, "don't 42"), edit("insert", 0, " a new sentence.\n\n"), edit("delete", 25, ""))
