"""Byte-level BPE by monoid tree reduction: halves encode alone, and joins re-encode what the seam can change."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, table

#: Code points of a leaf of the encoding tree, ids of a leaf of the decoding tree, first code points of a seam's window.
LEAF, LEAF_IDS, WINDOW = 2048, 2048, 16

# White space as the pattern has it.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_cut = re.compile(f"[^{SPACES}][{SPACES}]")


class Codec:
    """Encodes and decodes by a rank file."""

    def __init__(self, ranks_path: str, pattern: str = public_tokenizers.PATTERN):
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.plain = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.decimal = {rank: str(rank) for rank in ranks.values()}

    def window(self, text: str, lo: int, mid: int, hi: int) -> tuple[int, int]:
        """The part of text[lo:hi] around the seam at mid outside of which a join changes no token.

        It grows, twice as wide each time, until both edges are cuts or ends of the text. A cut is a position between a
        character that isn't white space and one that is. It always parts two matches of the pattern: no alternative has
        white space after its first character unless it is all white space. Matching depends only on what follows the
        start of a match, and the match before a cut ends alike with or without what follows, so
        encode(a + b) = encode(a) + encode(b) there: the tokens outside the window are proven stable."""
        a = b = mid
        width = WINDOW
        while a > lo and a == mid:
            edge = max(lo, mid - width)
            cuts = [m.end() - 1 for m in _cut.finditer(text, edge, mid)]
            a = cuts[-1] if cuts else lo if edge == lo else mid
            width *= 2
        width = WINDOW
        while b < hi and b == mid:
            edge = min(hi, mid + width)
            cut = _cut.search(text, mid, edge)
            b = cut.end() - 1 if cut else hi if edge == hi else mid
            width *= 2
        return a, b

    def join(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        """The ids of text[lo:hi] from those of its parts at mid."""
        a, b = self.window(text, lo, mid, hi)
        keep = len(left) - len(self.plain(text[a:mid])) if a > lo else 0
        skip = len(self.plain(text[mid:b])) if b < hi else len(right)
        return [*left[:keep], *self.plain(text[a:b]), *right[skip:]]

    def encode(self, text: str, leaf: int = LEAF) -> list[int]:
        def tree(lo: int, hi: int) -> list[int]:
            if hi - lo <= leaf:
                return self.plain(text[lo:hi])
            mid = (lo + hi) // 2
            return self.join(text, lo, mid, hi, tree(lo, mid), tree(mid, hi))

        return tree(0, len(text))

    def decode(self, ids: list[int], leaf: int = LEAF_IDS) -> bytes:
        """Bytes of halves, concatenated up the tree."""
        token = self.bytes_of.__getitem__
        parts = [b"".join(map(token, ids[i : i + leaf])) for i in range(0, len(ids), leaf)]
        while len(parts) > 1:
            parts = [b"".join(parts[i : i + 2]) for i in range(0, len(parts), 2)]
        return parts[0] if parts else b""


@lru_cache(maxsize=2)
def codec(ranks_path: str, pattern: str = public_tokenizers.PATTERN) -> Codec:
    return Codec(ranks_path, pattern)


def encode_documents(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id and ids (array<int>) of every row, whole texts, no special tokens; null or empty text: no ids.

    A row depends on nothing but its text: no shuffle. A text of n code points takes log(n / LEAF) levels of joins, each
    over its window; where there is no cut, as in a text without white space, the window is the whole part. Repeated rows
    are encoded each for itself, other columns ignored; empty table: no rows."""

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        c = codec(ranks_path, pattern)
        for b in batches:
            yield {"doc_id": b["id"], "ids": [c.encode(t) if t else [] for t in b["text"]]}

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return arrow_map(own, rows, f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode_ids(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and bytes of every row of ids; null: no bytes."""

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        c = codec(ranks_path)
        for b in batches:
            yield {"doc_id": b["id"], "bytes": [c.decode(x or []) for x in b["ids"]]}

    own = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return arrow_map(own, rows, f"doc_id {encoded.schema[id_col].dataType.simpleString()}, bytes binary")


def round_trips(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of encoding and of decoding the ids again, in one pass over the rows: doc_id, n_tokens, ids_sha256
    (decimal ids joined by commas), decoded_sha256. Null text is empty."""

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        c = codec(ranks_path)
        decimal = c.decimal.__getitem__
        for b in batches:
            out: dict[str, list] = {"doc_id": b["id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for t in b["text"]:
                ids = c.encode(t) if t else []
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(",".join(map(decimal, ids)).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield out

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return arrow_map(own, rows, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """round_trips over documents; null and empty texts have no ids."""
    return round_trips(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


QUERIES = {"op5_byte_bpe": op5_byte_bpe}
