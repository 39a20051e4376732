import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quiverspan.llm import byte_bpe, packing, token_counts

RANKS, WORDS, BYTES = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")
ALPHABET = "abcdefgh stlmdrv'  .,\n\t0123ABCéüß中  !?<|>"
texts = st.one_of(st.text(alphabet=ALPHABET, max_size=300), st.text(max_size=120))


@settings(max_examples=150, deadline=None)
@given(text=texts, leaf=st.integers(1, 40))
def test_tree_encoding_equals_the_library(text, leaf):
    c = byte_bpe.codec(RANKS)
    ids = c.encode(text, leaf)
    assert ids == c.plain(text) and c.decode(ids, leaf) == text.encode("utf-8", "surrogatepass").decode("utf-8", "replace").encode()


def test_round_trips(docs, rows, empty):
    got = byte_bpe.round_trips(docs, RANKS).collect()
    text = {i: t or "" for i, t, *_ in rows}
    plain = byte_bpe.codec(RANKS).plain
    assert len(got) == len(rows)
    for r in got:
        ids = plain(text[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()
    assert byte_bpe.round_trips(empty, RANKS).count() == 0
    again = byte_bpe.decode_ids(byte_bpe.encode_documents(docs, RANKS), RANKS, "doc_id")
    assert {(r["doc_id"], bytes(r["bytes"])) for r in again.collect()} == {(i, t.encode()) for i, t in text.items()}


@pytest.fixture(scope="module")
def word_library():
    return Tokenizer.from_file(WORDS)


@settings(max_examples=150, deadline=None)
@given(text=texts, chunk=st.integers(1, 30))
def test_counts_equal_the_library(word_library, text, chunk):
    text = text.encode("utf-8", "replace").decode()
    c = token_counts.counter(WORDS)
    want = len(word_library.encode(text, add_special_tokens=False).ids)
    assert c.count(text) == want == c.count(text, chunk)


def test_state_maps_compose_in_any_order(word_library):
    c = token_counts.counter(WORDS)
    rng = random.Random(2)
    text = "".join(rng.choice("abc de.f,1 2's'r'l") for _ in range(400))
    maps = c.maps(text, 7)
    left = maps[0]
    for m in maps[1:]:
        left = token_counts.Composed(left, m)
    right = maps[-1]
    for m in maps[-2::-1]:
        right = token_counts.Composed(m, right)
    state, count = token_counts.scan(c.maps(text, 7)).at(token_counts.START)
    assert left.at(token_counts.START) == right.at(token_counts.START) == (state, count)
    assert count + c.transducer.finish(state) == len(word_library.encode(text, add_special_tokens=False).ids)


def test_a_chunk_maps_every_entering_state():
    """A map's value for a state is what the transducer does from there, character by character."""
    c = token_counts.counter(WORDS)
    t = c.transducer
    states = [t.walk(token_counts.START, x)[0] for x in ("", "hel", "...", "'", "'r", "it'l", "a1", "zz'")]
    for text in ("lo wor", "e the", "", "   ", "abcdef", "'s", " x", "l "):
        chunk = token_counts.Chunk(t, text, None)
        for s in states:
            at, count, slow = s, 0, None
            for ch in text:
                at, n = t.walk(at, ch)
                count += n
            slow = at, count
            assert chunk.at(s) == slow


def test_short_texts_take_the_same_path(monkeypatch):
    made = []
    real = token_counts.Chunk
    monkeypatch.setattr(token_counts, "Chunk", lambda *a: made.append(a[1]) or real(*a))
    c = token_counts.counter(WORDS)
    assert c.count("one two") and made == ["one two"]


@pytest.mark.parametrize("alphabet", ["abcdefghijklmnopqrstuvwxyz", "ABCdefg0123456789+/", "'!?.-"])
def test_a_long_text_without_white_space(word_library, alphabet):
    rng = random.Random(8)
    text = "".join(rng.choice(alphabet) for _ in range(300_000))
    assert token_counts.counter(WORDS).count(text) == len(word_library.encode(text, add_special_tokens=False).ids)


def test_bounded_automaton_gives_the_same_counts(monkeypatch, word_library):
    for name, most in (("MAX_STATES", 50), ("MAX_HELD", 100), ("MAX_PAIRS", 30), ("MAX_RUN", 6)):
        monkeypatch.setattr(token_counts, name, most)
    c = token_counts.Counter(WORDS)
    rng = random.Random(3)
    for _ in range(60):
        text = " ".join("".join(rng.choice("abcdeinrst") for _ in range(rng.randrange(1, 14))) for _ in range(30))
        assert c.count(text, 40) == len(word_library.encode(text, add_special_tokens=False).ids)
        assert len(c.transducer.words) <= 101 and len(c.transducer.merges.pair_ok) <= 30


def test_count_tokens(docs, rows, empty, word_library):
    text = {i: t or "" for i, t, *_ in rows}
    got = token_counts.count_tokens(docs, WORDS).collect()
    assert len(got) == len(rows)
    for r in got:
        n = len(word_library.encode(text[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text[r["doc_id"]].encode()), n, n > 2048)
    assert token_counts.count_tokens(empty, WORDS).count() == 0


@settings(max_examples=100, deadline=None)
@given(text=texts)
def test_ranks_of_the_json_file_equal_the_library(text):
    text = text.encode("utf-8", "replace").decode()
    assert packing.tokenizer(BYTES).encode(text).tolist() == library().encode(text, add_special_tokens=False).ids


def test_two_special_strings(tmp_path):
    """As the library has them, in a file with two, one the start of the other."""
    import json

    spec = json.load(open(BYTES, encoding="utf-8"))
    first = spec["added_tokens"][0]
    for n, content in enumerate(("<|end", "<|end|>")):
        spec["added_tokens"].append({**first, "id": packing.tokenizer(BYTES).size + n, "content": content})
    path = tmp_path / "two.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    ours, theirs = packing.Tokenizer(str(path)), Tokenizer.from_file(str(path))
    for text in ("a<|end|>b", f"<|end{first['content']} x <|end|>", "<|end|><|end", "none <| here", first["content"] * 2):
        assert ours.encode(text).tolist() == theirs.encode(text, add_special_tokens=False).ids


def test_window_edges_are_cuts_or_ends():
    c = byte_bpe.codec(RANKS)
    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choice("ab  \n.1") for _ in range(rng.randrange(2, 120)))
        mid = rng.randrange(1, len(text))
        a, b = c.window(text, 0, mid, len(text))
        cuts = [i for i in range(1, len(text)) if text[i].isspace() and not text[i - 1].isspace()]
        assert a == max([x for x in cuts if x < mid], default=0) and b == min([x for x in cuts if x > mid], default=len(text))


_cache: list = []


def library():
    if not _cache:
        _cache.append(Tokenizer.from_file(BYTES))
    return _cache[0]


def test_packing_covers_every_id_once(spark, docs, rows, empty):
    for df in (docs, docs.repartition(1)):
        got = packing.pack(df, BYTES).collect()
        copies = defaultdict(int)
        for i, *_ in rows:
            copies[i] += 1
        pieces, sequences = defaultdict(list), defaultdict(list)
        for r in got:
            pieces[r["doc_id"]].append(r)
            sequences[r["sequence_id"]].append(r)
        for i, t, *_ in rows:
            ids = [*library().encode(t or "", add_special_tokens=False).ids, 0]
            covered = np.zeros(len(ids), int)
            for r in pieces[i]:
                covered[r["start"] : r["start"] + r["length"]] += 1
                assert r["doc_tokens"] == len(ids)
                assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
            assert (covered == copies[i]).all()
        for s in sequences.values():
            at = 0
            for r in sorted(s, key=lambda r: r["offset"]):
                assert r["offset"] == at
                at += r["length"]
            assert at <= 1024 and at & (at - 1) == 0  # a power of two: no padding
    assert packing.pack(empty, BYTES).count() == 0


def test_a_seed_is_filled_with_like_documents():
    rng = np.random.default_rng(0)
    idf = np.ones(2000, np.float32)
    packer = packing.Packer(idf, 300.0, 0)
    for k in range(40):  # two topics with ids of their own, in turns
        ids = rng.integers(1 + 1000 * (k % 2), 1000 + 1000 * (k % 2), 300).astype("<u2")
        terms, counts = np.unique(ids, return_counts=True)
        packer.pool.append([k, 300, 0, ids, terms, counts.astype(np.uint32)])
    packer.fill(0)
    packer.finish()
    by = defaultdict(set)
    for i, s, n in zip(packer.out["doc_id"], packer.out["sequence_id"], packer.out["length"]):
        by[s].add(i % 2)
    assert np.mean([len(x) == 1 for x in by.values()]) > 0.7


def test_bm25_scores_equal_the_formula():
    rng = np.random.default_rng(4)
    docs = [np.unique(rng.integers(0, 50, 30), return_counts=True) for _ in range(12)]
    lengths, idf = np.array([c.sum() for _, c in docs]), rng.random(50).astype(np.float32)
    shard = packing.Shard([t.astype("<u2") for t, _ in docs], [c.astype(np.uint32) for _, c in docs], lengths, idf, 30.0)
    query = docs[3][0].astype(np.uint32)
    want = [sum(idf[t] * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * n / 30)) for t, c in zip(*d) if t in query) for d, n in zip(docs, lengths)]
    assert np.allclose(shard.scores(query), want, rtol=1e-5)


def test_seeds_are_asked_of_all_shards(spark, monkeypatch):
    """Three documents a topic, far from each other in the table: as many meet as if one shard held all documents."""
    rng, n, topics = random.Random(6), 2100, 700
    words = [w[1:] for w in sorted(library().get_vocab()) if w[0] == "Ġ" and w[1:].isascii() and w[1:].isalpha()]
    common, own = words[:100], words[100 : 100 + 3 * topics]
    texts = [" ".join(rng.sample([*(common * 3), *own[3 * (i % topics) : 3 * (i % topics) + 3] * 5], 315)) for i in range(n)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)

    def beside():
        sequences = defaultdict(set)
        for r in packing.pack(docs, BYTES).collect():
            sequences[r["sequence_id"]].add(r["doc_id"])
        return len({d for s in sequences.values() for d in s if any(e != d and e % topics == d % topics for e in s)}) / n

    assert n > 2 * packing.SHARD
    found = beside()
    monkeypatch.setattr(packing, "SHARD", n)
    assert found > 0.8 and found > beside() - 0.02


def test_search_equals_brute_force():
    rng = np.random.default_rng(7)
    docs = [np.unique(rng.integers(0, 3000, 120) ** 2 // 3000, return_counts=True) for _ in range(700)]
    docs[300:340] = docs[:1] * 40  # equal ones
    terms, counts, lengths = [t.astype("<u2") for t, _ in docs], [c.astype(np.uint32) for _, c in docs], np.full(700, 120)
    df = np.bincount(np.concatenate(terms), minlength=3000)
    idf, column = np.log1p((700.5 - df) / (df + 0.5)).astype(np.float32), np.full(3000, -1)
    column[np.argsort(-df, kind="stable")[: packing.COMMON]] = np.arange(packing.COMMON)
    seeds = np.arange(0, 700, 7)
    search = packing.Search(seeds, [terms[i] for i in seeds], 20, 700, idf, 120.0, column)
    for at in range(0, 700, 150):
        search.add(np.arange(at, min(700, at + 150)), terms[at : at + 150], counts[at : at + 150], lengths[at : at + 150])
    whole = packing.Shard(terms, counts, lengths, idf, 120.0)
    for i, keys in zip(seeds.tolist(), search.best):
        scores = whole.scores(terms[i].astype(np.uint32))
        got = (i + 699 - (keys & ((1 << 31) - 1))) % 700
        assert i not in got and len(set(got.tolist())) == 20
        assert np.allclose(np.sort(scores[got]), np.sort(np.delete(scores, i))[-20:], rtol=1e-4)


def test_the_index_finds_the_neighbours_without_asking_all(spark, sf_dir, monkeypatch):
    """Against brute force over the unused documents, early and late: recall 0.9, and most pairs are never scored."""
    docs, found = spark.read.parquet(f"{sf_dir}/../sf0.1/documents.parquet"), []

    def look(index, left, scratch):
        rng = np.random.default_rng(11)
        for _ in range(2):
            unused = np.flatnonzero(left)
            index.calibrate(left, unused)
            seeds = np.sort(rng.choice(unused, 300, replace=False))
            (true, _), (got, whole) = index.neighbours(seeds, 10, left, True), index.neighbours(seeds, 10, left)
            groups = index.seeds(seeds)[1]
            asked = index.expected[left[index.at] > 0][:, groups // 2] >= index.depth(left, unused.size, 10, groups)[groups]
            found.append((np.mean([len(set(a) & set(b)) / 10 for a, b in zip(true.tolist(), got.tolist())]), asked.mean(), whole))
            left[rng.random(len(left)) < 0.5] = 0
        left[:] = 0

    monkeypatch.setattr(packing, "fill_windows", look)
    packing.pack(docs, BYTES)
    assert len(found) == 2 and all(recall >= 0.9 and asked < 0.4 and not whole for recall, asked, whole in found), found


def test_most_seeds_that_are_asked_fill_a_window(spark, sf_dir, monkeypatch):
    """A seed whose list is used up before its window is full is asked again, of all shards: few are. A pass reads a few wide
    rows of documents, most of them unused. And what tasks send of their lists is enough to know the best neighbours."""
    docs, asked, done, shared, read = spark.read.parquet(f"{sf_dir}/../sf0.1/documents.parquet"), [], [], [], []
    neighbours, fill, depth = packing.Index.neighbours, packing.Windows.fill, packing.Index.depth

    def ask(index, seeds, found, left, whole=False):
        out = neighbours(index, seeds, found, left, whole)
        if not whole:
            asked.append(len(seeds))
            read.append((index.table.count(), sum(len(r["n"]) // 8 for r in index.table.select("n").collect()), np.count_nonzero(left)))
        if not whole and not shared:
            some = np.arange(0, len(left), 50)
            with monkeypatch.context() as m:  # every document is asked, as if by depth
                m.setattr(packing.Index, "depth", lambda *a: np.zeros_like(depth(*a)))
                part = neighbours(index, some, 128, left)[0]
            for a, b in zip(part.tolist(), neighbours(index, some, 128, left, True)[0].tolist()):
                known = [d for d in a if d >= 0]
                shared.append((len(known), len(set(known) & set(b[: len(known)])) / len(known)))
        return out

    def count(windows, seed, ranked, complete):
        filled = fill(windows, seed, ranked, complete)
        if len(asked) and not complete:
            done.append(filled)
        return filled

    monkeypatch.setattr(packing, "WHOLE", 4000)
    monkeypatch.setattr(packing.Index, "neighbours", ask)
    monkeypatch.setattr(packing.Windows, "fill", count)
    packing.pack(docs, BYTES)
    assert sum(asked) < 1.5 * sum(done), (asked, sum(done))
    assert all(rows <= 100 and unused > 0.59 * held for rows, held, unused in read), read
    assert min(n for n, _ in shared) >= 16 and np.mean([x for _, x in shared]) > 0.99


def test_white_space_beside_white_space():
    """The pattern without its look-ahead is used only where it finds the same."""
    for text in ("a b\nc ", " a  b", "a \n b", "a b", "a  b", "é  x", "a\x85 b", "a\x1c b", "\t\tx", "x \t", "é　 1", " "):
        assert packing.tokenizer(BYTES).encode(text).tolist() == library().encode(text, add_special_tokens=False).ids
    assert packing.has_runs("a  b") and packing.has_runs("é x") and not packing.has_runs("a b\nç d ")
