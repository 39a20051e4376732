"""Lexical retrieval packing: BM25 neighbours from a sharded inverted index fill each seed document's window."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, small_batches, table
from .token_counts import byte_alphabet

#: Tokens of a window; documents of an index shard; neighbours that are tried whole before one is cut.
WINDOW, SHARD, TRIED = 1024, 1024, 16
#: Seeds of a search over all shards at most, and how many neighbours each gets; commonest terms, and the share of a group's
#: seeds from which on the scores for such a term are a matrix product.
SEEDS, FOUND, COMMON, DENSE = 16384, 64, 1536, 0.02
#: Cells of the index, documents on which they are fitted, documents whose expected scores the driver keeps, and those
#: that are scored together. So many unused documents, or fewer, are asked whole. Documents of a row of the index;
#: the cosine of cells that search together.
CELLS, FITTED, KEPT, BLOCK, WHOLE, ROW, LIKE = 64, 6144, 32768, 4096, 8192, 512, 0.9
#: Share of the true TOP neighbours that lies within the depth of the search, and the seeds that are asked whole to find
#: it; seeds with fewer distinct ids than LIGHT have a depth of their own.
RECALL, TOP, ASKED, LIGHT = 0.95, 10, 512, 80
#: BM25's saturation and length normalisation.
K1, B = 1.2, 0.75
END_ID = 0


#: What the pattern looks ahead for: a run of white space leaves its last character to what follows. That is slow.
LOOKAHEAD = r"\s+(?!\S)|"
WIDE_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search


def has_runs(text: str) -> bool:
    """Whether the text may have white space beside white space; without it the pattern finds the same without looking ahead."""
    low = np.frombuffer(text.encode(), np.uint8) <= 32
    return bool((low[1:] & low[:-1]).any()) or not text.isascii() and bool(WIDE_SPACE(text))


class Tokenizer:
    """Ids as the tokenizers library gives them for a byte-level BPE file, through tiktoken's engine. A special
    token's string in a text is that token, as the library has it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        patterns = public_tokenizers.PATTERN, public_tokenizers.PATTERN.replace(LOOKAHEAD, "")
        whole, plain = (tiktoken.Encoding("ranks", pat_str=x, mergeable_ranks=ranks, special_tokens={}).encode_ordinary for x in patterns)
        self.size = 1 + max([*ranks.values(), *self.special.values()])
        self.kind = "<u2" if self.size <= 1 << 16 else "<u4"
        code = "H" if self.kind == "<u2" else "I"
        self.plain = lambda text: array(code, (whole if has_runs(text) else plain)(text)).tobytes()
        specials = sorted(self.special, key=len, reverse=True)
        self.parts = re.compile(f"({'|'.join(map(re.escape, specials))})").split if specials else None

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, self.kind)
        if self.parts is None or not any(s in text for s in self.special):
            return np.frombuffer(self.plain(text), self.kind)
        bits = [np.array([self.special[t]], self.kind).tobytes() if k % 2 else self.plain(t) for k, t in enumerate(self.parts(text)) if t]
        return np.frombuffer(b"".join(bits), self.kind)


@lru_cache(maxsize=1)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def tokenized(docs: DataFrame, path: str, id_col: str, text_col: str) -> DataFrame:
    """For every row: doc_id, doc_tokens (with the end id), crcs of its full windows, the tail's ids, and the distinct ids of
    the whole document with their counts."""

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        t = tokenizer(path)
        end = np.array([END_ID], t.kind)
        for b in batches:
            out: dict[str, list] = {"doc_id": b["id"]} | {k: [] for k in ("doc_tokens", "crcs", "tail", "terms", "counts")}
            for text in b["text"]:
                ids = np.concatenate([t.encode(text), end])
                full = len(ids) // WINDOW
                terms, counts = np.unique(ids, return_counts=True)
                out["doc_tokens"].append(len(ids))
                out["crcs"].append([crc(ids[k * WINDOW : (k + 1) * WINDOW]) for k in range(full)])
                out["tail"].append(ids[full * WINDOW :].tobytes())
                out["terms"].append(terms.tobytes())
                out["counts"].append(counts.astype("<u4").tobytes())
            yield out

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return arrow_map(own, rows, f"doc_id {docs.schema[id_col].dataType.simpleString()}, doc_tokens long, crcs array<long>, tail binary, terms binary, counts binary")


def document_frequencies(tokens: DataFrame, size: int, kind: str) -> np.ndarray:
    """In how many documents each id occurs, over all of them: a vector as long as the vocabulary."""

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        seen = np.zeros(size, np.int64)
        for b in batches:
            seen += np.bincount(np.frombuffer(b"".join(b["terms"]), kind), minlength=size)
        at = np.flatnonzero(seen)
        yield {"term": at.astype(np.int32), "docs": seen[at]}

    out = np.zeros(size)
    for r in arrow_map(tokens.select("terms"), rows, "term int, docs long").groupBy("term").agg(F.sum("docs").alias("docs")).collect():
        out[r["term"]] = r["docs"]
    return out


def postings(terms: list[np.ndarray], counts: list[np.ndarray], lengths: np.ndarray, idf: np.ndarray, mean_length: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Term, document and BM25 weight of each posting, document by document."""
    every = np.concatenate(terms)
    doc = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
    tf = np.concatenate(counts).astype(np.float32)
    return every, doc, idf[every] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[doc] / mean_length))


class Shard:
    """An inverted index over the documents of one shard: postings by term, weighted by BM25 with corpus-wide statistics."""

    def __init__(self, terms: list[np.ndarray], counts: list[np.ndarray], lengths: np.ndarray, idf: np.ndarray, mean_length: float):
        every, doc, weight = postings(terms, counts, lengths, idf, mean_length)
        by = np.argsort(every, kind="stable")
        self.doc, self.weight, self.size = doc[by], weight[by], len(terms)
        self.at = np.searchsorted(every[by], np.arange(len(idf) + 1))

    def scores(self, query: np.ndarray) -> np.ndarray:
        start, n = self.at[query], self.at[query + np.uint32(1)] - self.at[query]
        at = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(self.doc[at], self.weight[at], self.size)


class Search:
    """The best documents for a block of seeds, over shards that come one after the other: exact BM25, for the commonest
    terms as a product of dense matrices, for the others by postings.

    A key orders a seed's documents: the bits of the score, then how far the document is behind the seed, so that the
    seeds of many equal documents don't all ask for the same ones."""

    def __init__(self, seeds: np.ndarray, terms: list[np.ndarray], found: int, total: int, idf: np.ndarray, mean_length: float, column: np.ndarray, groups: np.ndarray | None = None):
        """groups: the seeds' groups, ascending; without them every seed is asked of every document."""
        self.seeds, self.found, self.total = seeds.astype(np.int64), found, total
        self.idf, self.mean_length, self.column = idf, mean_length, column
        self.groups = np.zeros(len(seeds), np.int64) if groups is None else groups
        self.best = np.full((len(seeds), found), -1, np.int64)
        self.parts = []  # group, its dense columns, those of its other common terms, and blocks of its seeds
        for group in np.unique(self.groups).tolist():
            low, high = np.searchsorted(self.groups, [group, group + 1]).tolist()
            shared = np.bincount(np.concatenate(terms[low:high]), minlength=len(idf))
            used = np.flatnonzero((shared > 0) & (column >= 0))
            often = shared[used] >= (DENSE * (high - low) if high - low >= 256 else 1)
            place, blocks = np.full(len(idf), -1, np.int32), []
            place[used[often]] = np.arange(np.count_nonzero(often))
            for at in range(low, high, 1024):  # bounded memory, however many seeds a group has
                own = terms[at : min(at + 1024, high)]
                every, seed = np.concatenate(own), np.repeat(np.arange(len(own)), [len(t) for t in own])
                common = place[every] >= 0
                queries = np.zeros((len(own), np.count_nonzero(often)), bool)
                queries[seed[common], place[every[common]]] = True
                every, seed = every[~common], seed[~common]
                starts = np.concatenate([[0], np.cumsum(np.bincount(every, minlength=len(idf)))]).astype(np.int32)
                blocks.append((at, queries, starts, seed[np.argsort(every, kind="stable")]))
            self.parts.append((group, column[used[often]], used[~often], blocks))

    def keys(self, scores: np.ndarray, seed: np.ndarray, doc: np.ndarray) -> np.ndarray:
        return (scores.view(np.int32).astype(np.int64) << 31) + (self.total - 1 - (doc - self.seeds[seed]) % self.total)

    def add(self, ids: np.ndarray, terms: list[np.ndarray], counts: list[np.ndarray], lengths: np.ndarray) -> None:
        self.add_flat(ids, np.concatenate(terms), np.concatenate(counts), np.array([len(t) for t in terms]), lengths)

    def add_flat(self, ids: np.ndarray, terms: np.ndarray, counts: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, asked: Callable[[int], np.ndarray] | None = None) -> None:
        """Terms and counts of all documents, one document after the other. asked: the documents that a group's seeds ask
        for; all do without it."""
        tf = counts.astype(np.float32)
        norm = (K1 * (1 - B + B * lengths / self.mean_length)).astype(np.float32)
        weight = self.idf[terms] * tf * np.float32(K1 + 1) / (tf + np.repeat(norm, sizes))
        doc, place = np.repeat(np.arange(len(ids)), sizes), self.column[terms]
        common, rare = np.flatnonzero(place >= 0), np.flatnonzero(place < 0)
        dense = np.zeros((len(ids), COMMON), np.float32)
        dense.reshape(-1)[doc[common] * COMMON + place[common]] = weight[common]
        ends = np.searchsorted(doc[rare], np.arange(len(ids) + 1))
        terms, weight = terms[rare].astype(np.int64), weight[rare]
        _, seeds, own = np.intersect1d(self.seeds, ids, assume_unique=True, return_indices=True)
        for group, columns, others, blocks in self.parts:
            docs = np.arange(len(ids)) if asked is None else np.flatnonzero(asked(group))
            for at in range(0, len(docs), 2048):  # bounded memory, however many documents a group asks for
                some = docs[at : at + 2048]
                wide = dense.take(some, axis=0)
                n = ends[some + 1] - ends[some]
                postings = np.repeat(ends[some + 1] - np.cumsum(n), n) + np.arange(n.sum())
                every, doc, heavy = terms[postings], np.repeat(np.arange(len(some)), n), weight[postings]
                if len(others):
                    few = wide.take(self.column[others], axis=1)
                    nonzero = np.flatnonzero(few)
                    every, doc, heavy = (np.concatenate(x) for x in ((every, others[nonzero % len(others)]), (doc, nonzero // len(others)), (heavy, few.reshape(-1)[nonzero])))
                wide = wide.take(columns, axis=1).T
                for first, queries, starts, seed in blocks:
                    scores = queries.astype(np.float32) @ wide
                    start = starts[every]
                    n = starts[every + 1] - start
                    met = np.flatnonzero(n)
                    start, n = start[met], n[met]
                    hit = seed[np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())]
                    np.add.at(scores.reshape(-1), hit * len(some) + np.repeat(doc[met], n), np.repeat(heavy[met], n))
                    here = np.flatnonzero((seeds >= first) & (seeds < first + len(queries)))
                    spot = np.searchsorted(some, own[here])
                    found = some[np.minimum(spot, len(some) - 1)] == own[here]
                    scores[seeds[here[found]] - first, spot[found]] = -1
                    self._merge(scores, ids[some].astype(np.int64), first)

    def _merge(self, scores: np.ndarray, ids: np.ndarray, first: int) -> None:
        """scores of the seeds from first on."""
        worst = self.best[first : first + len(scores)].min(axis=1)
        least = np.where(worst < 0, 0, worst >> 31).astype(np.int32).view(np.float32)
        step = max(1, (1 << 21) // len(ids))
        for at in range(0, len(scores), step):  # bounded memory, even where all documents pass
            block = scores[at : at + step]
            seed, doc = np.divmod(np.flatnonzero(block >= least[at : at + step, None]), len(ids))
            if not len(seed):
                continue
            passed = np.bincount(seed, minlength=len(block))
            rows = np.flatnonzero(passed)
            most = int(passed.max())
            if most < len(ids):
                keys = np.full((len(rows), most), -1, np.int64)
                ahead = np.cumsum(passed) - passed
                keys[(np.cumsum(passed > 0) - 1)[seed], np.arange(len(seed)) - ahead[seed]] = self.keys(block[seed, doc], first + at + seed, ids[doc])
            else:
                keys = self.keys(block[rows], first + at + rows[:, None], ids[None, :])
            every = np.concatenate([self.best[first + at + rows], keys], axis=1)
            self.best[first + at + rows] = np.partition(every, -self.found, axis=1)[:, -self.found :]


class Windows:
    """Greedy filling: for every document the tokens of its tail that are unused (the last ones), and pieces so far."""

    def __init__(self, left: np.ndarray):
        self.left, self.total, self.sequences = left, int(left.sum()), 0
        self.pieces = array("q")  # document, left before, length, sequence, offset, one piece after the other

    def fill(self, seed: int, ranked: list[int], complete: bool) -> bool:
        """A window from a seed and its unused neighbours, best first; nothing is done (False) where the list ends before
        the choice is made, unless it is complete."""
        left, room, taken, skipped, tried = self.left, WINDOW - int(self.left[seed]), [seed], [], 1
        for d in ranked:
            if not room or (tried >= TRIED and skipped):
                break
            if n := int(left[d]):
                if n <= room:
                    taken.append(d)
                    room -= n
                else:
                    skipped.append(d)
                tried += 1
        if room and not (skipped and (complete or tried >= TRIED)):
            return False
        offset = 0
        for d in taken + skipped[:1] if room else taken:  # the best neighbour that is too long is cut
            n = min(int(left[d]), WINDOW - offset)
            self.pieces.extend((d, int(left[d]), n, self.sequences, offset))
            left[d] -= n
            offset += n
        self.total -= WINDOW
        self.sequences += 1
        return True


class Packer:
    """Packs the tails of a pool, which is one shard, into full windows."""

    def __init__(self, idf: np.ndarray, mean_length: float, partition: int):
        self.idf, self.mean_length = idf, mean_length
        self.pool: list[list] = []  # doc_id, doc_tokens, start, tail, terms, counts
        self.next_id = partition << 32
        self.out: dict[str, list] = {}

    def place(self, doc: list, take: int, offset: int) -> None:
        row = {"doc_id": doc[0], "start": doc[2], "length": take, "ids_crc32": crc(doc[3][:take]), "doc_tokens": doc[1], "sequence_id": 2 * self.next_id, "offset": offset}
        for k, v in row.items():
            self.out.setdefault(k, []).append(v)
        doc[2], doc[3] = doc[2] + take, doc[3][take:]

    def fill(self, leave: int) -> None:
        """Windows from the pool while more than leave documents, and enough tokens for a window, are unused."""
        pool, left = self.pool, np.array([len(d[3]) for d in self.pool])
        if not pool:
            return
        shard = Shard([d[4] for d in pool], [d[5] for d in pool], np.array([d[1] for d in pool]), self.idf, self.mean_length)
        seed = 0
        while (left > 0).sum() > leave and left.sum() >= WINDOW:
            while not left[seed]:
                seed += 1
            room, offset = WINDOW, 0
            scores = shard.scores(pool[seed][4].astype(np.uint32))
            scores[left == 0] = -1
            scores[seed] = np.inf
            ranked = np.argsort(-scores, kind="stable").tolist()
            tried, skipped = 0, []
            for d in ranked:  # the seed comes first
                if not left[d] or not room:
                    continue
                if left[d] <= room:
                    take = int(left[d])
                    self.place(pool[d], take, offset)
                    room, offset, left[d] = room - take, offset + take, 0
                else:
                    skipped.append(d)
                tried += 1
                if tried >= TRIED and skipped:
                    break
            if room:  # the best neighbour that is too long is cut
                d = skipped[0]
                self.place(pool[d], room, offset)
                left[d] -= room
            self.next_id += 1
        self.pool = [d for d in pool if len(d[3])]

    def finish(self) -> None:
        """The rest, less than a window, in sequences whose lengths are powers of two and need no padding."""
        while any(len(d[3]) for d in self.pool):
            room, offset = 1 << (sum(len(d[3]) for d in self.pool).bit_length() - 1), 0
            for d in self.pool:
                if room and (take := min(room, len(d[3]))):
                    self.place(d, take, offset)
                    room, offset = room - take, offset + take
            self.next_id += 1

    def flush(self) -> dict[str, list]:
        out, self.out = self.out, {}
        return out


def tail_lengths(tokens: DataFrame, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Numbers documents from 0 in the order of n: where each partition of n starts, and the lengths of all tails."""

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        parts = [(np.array(b["n"], np.int64), np.array(b["length"], np.uint16)) for b in batches]
        if parts:
            yield {k: [np.concatenate(x).tobytes()] for k, x in zip(("n", "length"), zip(*parts))}

    own = tokens.select("n", (F.octet_length("tail") / np.dtype(kind).itemsize).cast("int").alias("length"))
    found = [(np.frombuffer(r["n"], np.int64), np.frombuffer(r["length"], np.uint16)) for r in arrow_map(own, rows, "n binary, length binary").collect()]
    n, length = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, (np.int64, np.uint16)[k]) for k in (0, 1))
    starts = np.concatenate([[0], np.cumsum(np.bincount(n >> 33))]).astype(np.int64)
    out = np.zeros(len(n), np.uint16)
    out[number(n, starts)] = length
    return starts, out


def number(n: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return starts[n >> 33] + (n & ((1 << 33) - 1))


class Cells:
    """What the index is sorted by: cells of like documents, and the share of a cell's documents in which each common term
    occurs. So a document has an expected score for a seed of each cell, and a seed's neighbours are mostly among those
    whose expected score for its cell is high."""

    def __init__(self, terms: list[np.ndarray], column: np.ndarray, idf: np.ndarray):
        """Spherical k-means of the documents' sets of common terms, weighted by idf."""
        doc, at = self.common(terms, column)
        has = np.zeros((len(terms), COMMON), np.float32)
        has[doc, at] = 1
        weight = np.zeros(COMMON, np.float32)
        weight[column[column >= 0]] = np.sqrt(idf[column >= 0])
        norm = 1 / np.maximum(np.sqrt(has @ weight**2), 1e-6)
        count = max(1, min(CELLS, len(terms) // 64))
        self.centres = has[:: max(1, len(terms) // count)][:count] * weight**2
        for _ in range(12):
            self.centres /= np.maximum(np.linalg.norm(self.centres / np.maximum(weight, 1e-6), axis=1, keepdims=True), 1e-6)
            member = np.zeros((count, len(terms)), np.float32)
            member[np.argmax(has @ self.centres.T, axis=1), np.arange(len(terms))] = norm
            sums = member @ has
            self.centres = np.where(member.any(axis=1)[:, None], sums * weight**2, self.centres)
        self.centres /= np.maximum(np.linalg.norm(self.centres / np.maximum(weight, 1e-6), axis=1, keepdims=True), 1e-6)
        member = np.zeros((count, len(terms)), np.float32)
        member[np.argmax(has @ self.centres.T, axis=1), np.arange(len(terms))] = 1
        self.share = member @ has / np.maximum(member.sum(axis=1, keepdims=True), 1)
        self.size = count
        self.family = np.full(count, -1)  # of like cells, whose seeds search together: they ask for nearly the same documents
        unit = self.share / np.maximum(np.linalg.norm(self.share, axis=1, keepdims=True), 1e-6)
        for c in np.argsort(-member.sum(axis=1), kind="stable").tolist():
            if self.family[c] < 0:
                self.family[(self.family < 0) & ((unit @ unit[c] > LIKE) | (np.arange(count) == c))] = c

    @staticmethod
    def common(terms: list[np.ndarray], column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        doc, at = np.repeat(np.arange(len(terms)), [len(t) for t in terms]), column[np.concatenate(terms)]
        return doc[at >= 0], at[at >= 0]

    def judge(self, n: np.ndarray, terms: list[np.ndarray], counts: list[np.ndarray], lengths: np.ndarray, idf: np.ndarray, mean_length: float, column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each document's cell, and its expected score for every cell; by a hash of n up to 2 % more, so that of many equal
        documents a depth takes some."""
        every, doc, weight = postings(terms, counts, lengths, idf, mean_length)
        at = column[every]
        dense = np.zeros((len(terms), COMMON), np.float32)
        dense[doc[at >= 0], at[at >= 0]] = weight[at >= 0]
        more = 1 + 0.02 * ((n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.float32) / (1 << 24)
        expected = np.minimum(dense @ self.share.T * more[:, None], 60000).astype(np.float16)
        return np.argmax((dense > 0).astype(np.float32) @ self.centres.T, axis=1), expected


class Part:
    """Documents of the index, as arrays: n, tokens, how many terms, cell and expected scores of each; and all terms and
    their counts, one document after the other."""

    NAMES = ("n", "lengths", "sizes", "cell", "expected", "terms", "counts")
    SCHEMA = "low long, high long, " + ", ".join(f"{x} binary" for x in NAMES)

    def __init__(self, *arrays: np.ndarray):
        self.n, self.lengths, self.sizes, self.cell, self.expected, self.terms, self.counts = self.arrays = arrays

    @classmethod
    def read(cls, batches: Iterator[dict], kind: str) -> Iterator[Part]:
        kinds = (np.int64, np.int64, np.int32, np.int32, np.float16, kind)
        for b in batches:
            for *row, counts in zip(*(b[x] for x in cls.NAMES)):
                arrays = [np.frombuffer(x, k) for x, k in zip(row, kinds)]
                arrays[4] = arrays[4].reshape(len(arrays[0]), -1)
                yield cls(*arrays, np.frombuffer(counts, f"<u{len(counts) // len(arrays[5])}").astype(np.uint32))

    @classmethod
    def join(cls, parts: list[Part]) -> Part:
        return cls(*(np.concatenate(x) for x in zip(*(p.arrays for p in parts)))) if len(parts) > 1 else parts[0]

    def take(self, keep: np.ndarray) -> Part:
        """keep: a mask."""
        if keep.all():
            return self
        wide = np.repeat(keep, self.sizes)
        return Part(*(x[keep] for x in self.arrays[:5]), *(x[wide] for x in self.arrays[5:]))

    def rows(self) -> dict[str, list]:
        """The documents in rows of ROW."""
        cuts = list(range(0, len(self.n), ROW))
        ends = np.concatenate([[0], np.cumsum(self.sizes)])
        out = {x: [a[k : k + ROW].tobytes() for k in cuts] for x, a in zip(self.NAMES[:5], self.arrays)}
        of = [slice(ends[k], ends[min(k + ROW, len(self.n))]) for k in cuts]
        out |= {"terms": [self.terms[x].tobytes() for x in of], "counts": [self.counts[x].astype(np.min_scalar_type(self.counts[x].max())).tobytes() for x in of]}
        return out | {"low": [int(self.n[k : k + ROW].min()) for k in cuts], "high": [int(self.n[k : k + ROW].max()) for k in cuts]}


def gathered(parts: Iterator[Part], least: int) -> Iterator[Part]:
    """Joined until there are as many documents as least, or 1,024 times as many terms."""
    some: list[Part] = []
    for p in parts:
        some.append(p)
        if sum(len(x.n) for x in some) >= least or sum(len(x.terms) for x in some) >= least << 10:
            yield Part.join(some)
            some = []
    if some:
        yield Part.join(some)


def collected(df: DataFrame) -> list:
    with small_batches(df.sparkSession):
        return df.collect()


def mixed(n: np.ndarray) -> np.ndarray:
    """A hash from 0 to below 1."""
    x = n.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(32)).astype(np.float64) / (1 << 32)


class Index:
    """All unused documents' terms, with their cells and expected scores; and what the driver keeps: a sample of expected
    scores, from which it knows how deep a share of the unused documents reaches in each cell."""

    def __init__(self, tokens: DataFrame, total: int, starts: np.ndarray, shared, scratch: Scratch, kind: str):
        self.starts, self.shared, self.kind, self.scratch, self.size = starts, shared, kind, scratch, total
        self.cells, self.share, self.calibrated = None, np.ones(2), np.inf
        if total > WHOLE:
            drawn = F.pmod(F.xxhash64("n"), F.lit(1 << 30)) < F.lit(int(min(1.0, FITTED / total) * (1 << 30)))
            terms = [np.frombuffer(r["terms"], kind) for r in tokens.where(drawn).select("terms").collect()]
            self.cells = Cells(terms, shared.value[2], shared.value[0])
        sent = tokens.sparkSession.sparkContext.broadcast(self.cells)

        def judged(batches: Iterator[dict]) -> Iterator[Part]:
            for b in batches:
                if b["n"]:
                    n, lengths = np.array(b["n"], np.int64), np.array(b["doc_tokens"], np.int64)
                    terms, counts = [np.frombuffer(t, kind) for t in b["terms"]], [np.frombuffer(c, "<u4") for c in b["counts"]]
                    cell, expected = np.zeros(len(n), np.int32), np.zeros((len(n), 0), np.float16)
                    if sent.value:
                        cell, expected = sent.value.judge(n, terms, counts, lengths, *shared.value)
                    yield Part(n, lengths, np.array([len(t) for t in terms], np.int32), cell.astype(np.int32), expected, np.concatenate(terms), np.concatenate(counts))

        def rows(batches: Iterator[dict]) -> Iterator[dict]:
            for p in gathered(judged(batches), ROW):
                yield p.rows()

        self.table = scratch.write(arrow_map(tokens.select("n", "doc_tokens", "terms", "counts"), rows, Part.SCHEMA), "index")
        if self.cells:
            self.at, self.expected = self._expected(lambda n: mixed(n) < KEPT / total)

    def compact(self, left: np.ndarray, unused: int) -> None:
        """Writes the index again once few of its documents are unused."""
        if unused > 0.6 * self.size:
            return
        kind, starts, sent = self.kind, self.starts, self.table.sparkSession.sparkContext.broadcast(left)

        def rows(batches: Iterator[dict]) -> Iterator[dict]:
            for p in gathered((p.take(sent.value[number(p.n, starts)] > 0) for p in Part.read(batches, kind)), ROW):
                if len(p.n):
                    yield p.rows()

        before = self.table
        self.table, self.size = self.scratch.write(arrow_map(before, rows, Part.SCHEMA), "index"), unused
        self.scratch.drop(before)
        sent.destroy()

    def _expected(self, wanted: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """wanted: a mask of n."""

        def joined(batches: Iterator[dict]) -> Iterator[dict]:
            for b in batches:
                for n, expected in zip(b["n"], b["expected"]):
                    n = np.frombuffer(n, np.int64)
                    keep = wanted(n)
                    yield {"n": [n[keep].tobytes()], "expected": [np.frombuffer(expected, np.float16).reshape(len(n), -1)[keep].tobytes()]}

        found = collected(arrow_map(self.table.select("n", "expected"), joined, "n binary, expected binary"))
        at = number(np.frombuffer(b"".join(r["n"] for r in found), np.int64), self.starts)
        return at, np.frombuffer(b"".join(r["expected"] for r in found), np.float16).reshape(len(at), self.cells.size)

    def seeds(self, seeds: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Terms of seeds (ascending), and their groups: twice the cell, and one more for a light seed."""
        starts, kind, wanted = self.starts, self.kind, self.table.sparkSession.sparkContext.broadcast(seeds)

        def rows(batches: Iterator[dict]) -> Iterator[dict]:
            for p in Part.read(batches, kind):
                at = number(p.n, starts)
                keep = np.isin(at, wanted.value)
                p = p.take(keep)
                yield {"at": [at[keep].tobytes()], "cell": [p.cell.tobytes()], "sizes": [p.sizes.tobytes()], "terms": [p.terms.tobytes()]}

        part = np.searchsorted(starts, [seeds[0], seeds[-1]], "right") - 1
        low, high = (int((p << 33) + s - starts[p]) for p, s in zip(part.tolist(), (seeds[0], seeds[-1])))
        wide = self.table.where((F.col("high") >= low) & (F.col("low") <= high))
        found = collected(arrow_map(wide, rows, "at binary, cell binary, sizes binary, terms binary"))
        wanted.destroy()
        at, cell, sizes, terms = (np.frombuffer(b"".join(r[x] for r in found), k) for x, k in (("at", np.int64), ("cell", np.int32), ("sizes", np.int32), ("terms", kind)))
        by = np.argsort(at)
        ends = np.cumsum(sizes)
        return [terms[ends[k] - sizes[k] : ends[k]] for k in by.tolist()], 2 * cell[by].astype(np.int64) + (sizes[by] < LIGHT)

    def depth(self, left: np.ndarray, unused: int, found: int, groups: np.ndarray) -> np.ndarray | None:
        """The expected score from which on documents are asked, by group: so many are above it that RECALL of the true
        neighbours is among them, and that the seeds can fill their windows. None: all documents are asked."""
        kept = self.expected[left[self.at] > 0]
        seeds = np.bincount(groups, minlength=2 * self.cells.size)
        share = np.maximum(np.tile(self.share, self.cells.size), np.maximum(16 * found, 4 * seeds) / unused)
        if share.min() >= 1:
            return None
        out = np.full(2 * self.cells.size, np.inf, np.float32)
        for g in np.flatnonzero(seeds).tolist():
            k = int(np.ceil(share[g] * len(kept)))
            out[g] = np.partition(kept[:, g // 2], len(kept) - k)[len(kept) - k] if 0 < k < len(kept) else -np.inf
        return out

    def calibrate(self, left: np.ndarray, unused: np.ndarray) -> None:
        """Asks some seeds of all unused documents, and notes which share of these is expected to score as high as the
        true neighbours' last but a few."""
        seeds = np.sort(np.random.default_rng(0).choice(unused, ASKED, replace=False))
        top = self.neighbours(seeds, TOP, left, True)[0]
        docs = np.unique(top)
        part = np.searchsorted(self.starts, docs, "right") - 1
        wanted = (part << 33) + docs - self.starts[part]
        at, expected = self._expected(lambda n: np.isin(n, wanted))
        order = np.argsort(at)
        groups = self.seeds(seeds)[1]
        own = expected[order[np.searchsorted(at[order], top)], groups[:, None] // 2]
        kept = np.sort(self.expected[left[self.at] > 0], axis=0)
        above = np.stack([1 - np.searchsorted(kept[:, g // 2], x) / len(kept) for g, x in zip(groups.tolist(), own)])
        light = groups % 2 > 0
        self.share = np.array([np.quantile(above[x], RECALL) if x.sum() >= 8 else np.quantile(above, RECALL) for x in (~light, light)])
        self.calibrated = unused.size

    def neighbours(self, seeds: np.ndarray, found: int, left: np.ndarray, whole: bool = False) -> tuple[np.ndarray, bool]:
        """For each seed (ascending) the best unused documents of all shards, best first, -1 where there are no more; and
        whether all of them were asked, not only those to the depth that the recall needs.

        Of a list each task sends about twice its share. So it is known down to the last document of any task that may have
        more; what is below that is left out."""
        spark, shared, kind = self.table.sparkSession, self.shared, self.kind
        terms, groups = self.seeds(seeds)
        least = None if whole or self.cells is None else self.depth(left, int(np.count_nonzero(left)), found, groups)
        together, by, deep = None, np.arange(len(seeds)), None
        if self.cells and (least is not None or len(seeds) > ASKED):  # families, and in each the light seeds apart
            together = 2 * self.cells.family[groups // 2] + groups % 2
            by = np.argsort(together, kind="stable")
            together = together[by]
        if least is not None:  # expected scores aren't negative: their bits are in their order
            bits = np.maximum(least, 0).astype(np.float16).view(np.uint16)
            active = np.unique(groups)
            members = 2 * self.cells.family[active // 2] + active % 2
            deep = {g: (active[members == g] // 2, bits[active[members == g]]) for g in np.unique(members).tolist()}
        sent = spark.sparkContext.broadcast((seeds[by], [terms[k] for k in by.tolist()], together, deep, left, self.starts))

        def rows(batches: Iterator[dict]) -> Iterator[dict]:
            seeds, terms, groups, deep, left, starts = sent.value
            search = Search(seeds, terms, sent_each, len(left), *shared.value, groups)
            for p in gathered((p.take(left[number(p.n, starts)] > 0) for p in Part.read(batches, kind)), BLOCK):
                if len(p.n):
                    expected = np.ascontiguousarray(p.expected).view(np.uint16)
                    asked = None if deep is None else lambda g: (expected[:, deep[g][0]] >= deep[g][1]).any(axis=1)  # noqa: B023
                    search.add_flat(number(p.n, starts), p.terms, p.counts, p.sizes.astype(np.int64), p.lengths, asked)
            for at in range(0, len(seeds), 1024):
                yield {"first": [at], "keys": [search.best[at : at + 1024].tobytes()]}

        def best(batches: Iterator[dict]) -> Iterator[dict]:
            seeds, total = sent.value[0], len(sent.value[4])
            for b in batches:
                for at, lists in zip(b["first"], b["keys"]):
                    keys = np.stack([np.frombuffer(k, np.int64).reshape(-1, sent_each) for k in lists], axis=1)
                    known = keys.min(axis=2).max(axis=1) if sent_each < found else -1  # a task that has no more sends -1
                    keys = np.sort(keys.reshape(len(keys), -1), axis=1)[:, : -found - 1 : -1]
                    keys = np.where(keys < np.reshape(known, (-1, 1)), -1, keys)
                    docs = np.full((len(keys), found), -1, np.int32)
                    behind = total - 1 - (keys & ((1 << 31) - 1))
                    docs[:, : keys.shape[1]] = np.where(keys < 0, -1, (seeds[at : at + len(keys), None] + behind) % total)
                    yield {"first": [at], "docs": [docs.tobytes()]}

        tasks = spark.sparkContext.defaultParallelism
        sent_each = found if least is None else min(found, 16 + 2 * -(-found // tasks))
        index = self.table.coalesce(tasks)
        lists = arrow_map(index, rows, "first int, keys binary").groupBy("first").agg(F.collect_list("keys").alias("keys"))
        out = np.full((len(seeds), found), -1, np.int32)
        for r in collected(arrow_map(lists, best, "first int, docs binary")):
            some = np.frombuffer(r["docs"], np.int32).reshape(-1, found)
            out[by[r["first"] : r["first"] + len(some)]] = some
        sent.destroy()
        return out, least is None


def fill_windows(index: Index, left: np.ndarray, scratch: Scratch) -> DataFrame | None:
    """Windows until one shard can hold all unused documents; left is brought up to date. The table of pieces."""
    windows, tables, starts, spark = Windows(left), [], index.starts, index.table.sparkSession

    def keep() -> None:
        at, before, length, sequence, offset = np.array(windows.pieces).reshape(-1, 5).T
        part = np.searchsorted(starts, at, "right") - 1
        columns = {"n": (part << 33) + at - starts[part], "before": before, "length": length, "sequence_id": 2 * sequence, "offset": offset}
        tables.append(scratch.write(spark.createDataFrame(pa.table(columns)), "pieces"))
        windows.pieces = array("q")

    most = size = max(1024, min(SEEDS, len(left) // 8))
    found = FOUND
    while windows.total >= WINDOW and (unused := np.flatnonzero(left)).size > SHARD:
        if index.cells and unused.size > WHOLE and unused.size < 0.7 * index.calibrated:
            index.calibrate(left, unused)
        index.compact(left, unused.size)
        seeds = unused[:size]
        done = asked = 0
        lists, whole = index.neighbours(seeds, found, left, unused.size <= WHOLE)
        for seed, ranked in zip(seeds.tolist(), lists):
            if left[seed] and windows.total >= WINDOW:
                asked += 1
                done += windows.fill(seed, ranked[ranked >= 0].tolist(), bool(whole and (ranked[-1] < 0 or found >= unused.size - 1)))
        if 2 * done < asked and (size > 64 or not done):  # many want the same documents: fewer seeds, longer lists
            size, found = max(16, size // 4), found * 4
        elif 10 * done > 9 * asked and size < most:
            size, found = size * 4, max(FOUND, found // 4)
        if len(windows.pieces) > 5 << 18:
            keep()
    if windows.pieces:
        keep()
    return spark.read.schema(tables[0].schema).parquet(*(t._scratch_path for t in tables)) if tables else None


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every document's ids (then the end id): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Sequences have WINDOW tokens, but for the rest, which goes into sequences of 512, 256 ... tokens: no padding at all.
    Full windows of a long document are sequences of their own. Its tail seeds, or fills, a window: each seed asks the
    shards of the index, all of them, for the unused documents that score highest by BM25 for all of its distinct ids,
    and takes them in that order, whole where they fit; the last one is cut, and its rest stays unused.

    A block of seeds is broadcast to all shards; the driver fills windows from the merged lists, and a seed whose list is
    used up asks again. A seed is scored against the unused documents whose expected score for its cell is high: a share
    of them that is calibrated, by brute force for some seeds, to hold RECALL of the TOP true neighbours; all of them
    where WHOLE or fewer are unused, or where longer lists are needed. That share is nearly the same at every size, so CPU
    time still grows with the square of the documents in the end. The driver holds two bytes a document. Document frequencies and the mean length cover all documents; the
    broadcast idf is as long as the vocabulary. Null text is empty: the end id alone. Every row is packed, repeated
    ones too; empty table: no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    tokens = scratch.write(tokenized(docs, path, id_col, text_col).withColumn("n", F.monotonically_increasing_id()), "tokens")
    total, mean_length = tokens.agg(F.count(F.lit(1)), F.avg("doc_tokens")).first()
    kind, width = tokenizer(path).kind, np.dtype(tokenizer(path).kind).itemsize
    df = document_frequencies(tokens, tokenizer(path).size, kind)
    column = np.full(len(df), -1, np.int32)
    column[np.argsort(-df, kind="stable")[:COMMON]] = np.arange(min(COMMON, len(df)))
    idf, mean_length = np.log1p((total - df + 0.5) / (df + 0.5)).astype(np.float32), float(mean_length or 1)
    starts, left = tail_lengths(tokens, kind)
    index = Index(tokens, total, starts, spark.sparkContext.broadcast((idf, mean_length, column)), scratch, kind)
    pieces = fill_windows(index, left, scratch)
    shared = spark.sparkContext.broadcast((idf, mean_length, left, starts))

    def unused(batches: Iterator[dict]) -> Iterator[dict]:
        left, starts = shared.value[2:]
        for b in batches:
            at = number(np.array(b["n"], np.int64), starts)
            keep = np.flatnonzero(left[at]).tolist()
            out = {k: [v[i] for i in keep] for k, v in b.items() if k != "n"}
            yield out | {"tail": [t[-width * int(n) :] for t, n in zip(out["tail"], left[at[keep]])]}

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        packer = Packer(*shared.value[:2], 1)  # ids from 1 << 32: beyond those of fill_windows
        for b in batches:
            for i, n, tail, terms, counts in zip(b["doc_id"], b["doc_tokens"], b["tail"], b["terms"], b["counts"]):
                ids = np.frombuffer(tail, kind)
                packer.pool.append([i, n, n - len(ids), ids, np.frombuffer(terms, kind), np.frombuffer(counts, "<u4")])
        packer.fill(0)
        packer.finish()
        if packer.out:
            yield packer.flush()

    def cut(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            tails = (np.frombuffer(t, kind) for t in b["tail"])
            crcs = [crc(t[len(t) - before :][:n]) for t, before, n in zip(tails, b["before"], b["length"])]
            yield {k: b[k] for k in ("doc_id", "length", "doc_tokens", "sequence_id", "offset")} | {"start": [n - before for n, before in zip(b["doc_tokens"], b["before"])], "ids_crc32": crcs}

    id_kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    rest = arrow_map(tokens.select("n", "doc_id", "doc_tokens", "tail", "terms", "counts"), unused, f"doc_id {id_kind}, doc_tokens long, tail binary, terms binary, counts binary")
    tails = arrow_map(rest.repartition(1), rows, schema)  # less than a window, or at most a shard
    if pieces is not None:
        tails = tails.unionByName(arrow_map(tokens.select("n", "doc_id", "doc_tokens", "tail").join(pieces, "n").drop("n"), cut, schema))
    full = tokens.select("doc_id", "doc_tokens", F.posexplode("crcs").alias("k", "crc"))
    window = F.lit(WINDOW).cast("long")
    full = full.select("doc_id", (F.col("k") * window).alias("start"), window.alias("length"), F.col("crc").alias("ids_crc32"), "doc_tokens", (2 * F.monotonically_increasing_id() + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return tails.unionByName(full)


def op8_packing(spark, sf_dir: str) -> DataFrame:
    """pack over documents; a null or empty text is its end id."""
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op8_packing": op8_packing}
