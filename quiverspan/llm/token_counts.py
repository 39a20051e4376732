"""Token counts by finite-state compilation: a deterministic transducer whose transitions carry token counts."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, table

#: Compiled states, pairs of tokens, and code points of stored runs at most; beyond, they are thrown away and grow anew
#: (results stay). Longer runs than MAX_RUN aren't stored.
MAX_STATES, MAX_PAIRS, MAX_HELD, MAX_RUN = 300_000, 1_000_000, 4 << 20, 64
#: Code points of a chunk whose state map is made alone; code points before it that may tell the state it is entered in.
CHUNK, LOOK_BACK = 4096, 64

# The tokenizer splits a text by 's|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+ ; white space as its
# regular expressions have it; the end-of-word mark.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
END = "</w>"

#: What a state is within; a state: that, the merges' state before the last symbol, and what isn't decided yet.
NOTHING, LETTERS, OTHERS, QUOTE = "nothing", "letters", "others", "quote"
Within = tuple[tuple[int, "str | None", int], ...]
State = tuple[str, "Within | None", str]
START: State = (NOTHING, None, "")

_odd = re.compile("[\x1c-\x1f]")
_spaces = re.compile(f"[{SPACES}]+")
is_letter, is_number = (lru_cache(maxsize=1 << 16)(lambda c, full=regex.compile(p).fullmatch: bool(full(c))) for p in (r"\p{L}", r"\p{N}"))


def byte_alphabet() -> list[str]:
    """A printable character for each byte: itself where printable, else the next free one from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Merges:
    """The vocabulary's side of the automaton: what can follow what inside one piece.

    For any prefix of a word, BPE's last token t is the one ending there for which (the last token before t, t) stays
    unmerged when encoded as a pair, and there is exactly one. So after a prefix all that matters for what follows is,
    for each earlier position from which some vocabulary entry still reaches past the end: how far along that entry is
    (a trie node), the last token at that position, and the count there relative to now. That tuple is the state.
    """

    START: Within = ((0, None, 0),)

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        pairs = (m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"])
        self.rank = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.made: dict[str, tuple[int, str, str]] = {}  # the merge that makes a token
        for (a, b), i in self.rank.items():
            self.made.setdefault(a + b, (i, a, b))
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.next: list[dict[str, int]] = [{}]  # trie over symbols; a final symbol has END
        self.token_at: dict[int, str] = {}
        for token in model["vocab"]:
            node = 0
            for symbol in self.symbols(token):
                if symbol not in self.next[node]:
                    self.next[node][symbol] = len(self.next)
                    self.next.append({})
                node = self.next[node][symbol]
            self.token_at[node] = token
        self.pair_ok: dict[tuple[str | None, str], bool] = {}

    @staticmethod
    def symbols(token: str) -> list[str]:
        return [*token[: -len(END) - 1], token[-len(END) - 1 :]] if token.endswith(END) and len(token) > len(END) else list(token)

    def unmerged(self, one: str, two: str) -> bool:
        """Whether two tokens stay as they are when they are encoded as one string.

        Of their inner merges the latest is undone, on the side of the boundary, again and again. A merge across the
        boundary that comes before those undone so far would have been taken first (one that is equal to a merge of the
        right token, too: the leftmost comes first)."""
        limit = len(self.rank)
        while True:
            if self.rank.get((one, two), limit) < limit:
                return False
            a, b = self.made.get(one), self.made.get(two)
            if a is None and b is None:
                return True
            if b is None or a is not None and a[0] > b[0]:
                limit, one = a[0], a[2]
            else:
                limit, two = b[0] + 1, b[1]

    def _follows(self, last: str | None, token: str) -> bool:
        if last is None:
            return True
        if (ok := self.pair_ok.get((last, token))) is None:
            if len(self.pair_ok) >= MAX_PAIRS:
                self.pair_ok.clear()
            ok = self.pair_ok[last, token] = self.unmerged(last, token)
        return ok

    def _reach(self, state: Within, symbol: str) -> tuple[list[tuple[int, str | None, int]], str, int]:
        """What stays alive past symbol, the last token then, and the count then relative to the state's."""
        alive, found = [], None
        for node, last, count in state:
            if (to := self.next[node].get(symbol)) is not None:
                if self.next[to]:
                    alive.append((to, last, count))
                if found is None and (token := self.token_at.get(to)) is not None and self._follows(last, token):
                    found = token, count + 1
        assert found is not None, "every byte is a token"
        return alive, *found

    def step(self, state: Within, symbol: str) -> tuple[Within, int]:
        alive, token, change = self._reach(state, symbol)
        return (*((node, last, count - change) for node, last, count in alive), (0, token, 0)), change

    def last(self, state: Within, symbol: str) -> int:
        """By how much the count changes when symbol ends the piece."""
        return self._reach(state, symbol + END)[2]


class Transducer:
    """A deterministic transducer over the characters of a normalised text, compiled as its transitions are first taken.

    A state says what the split pattern is within (nothing, a run of letters, a run of other characters, an apostrophe
    that may begin a contraction) and, in a run, the state of the merges before its last symbol, and that symbol: whether
    a symbol ends its piece shows only with the next character. Each transition has the number of tokens that it emits,
    as far as it is then known; white space leads to START from everywhere, with the rest of the count.
    """

    def __init__(self, path: str):
        self.merges = Merges(path)
        special = sorted(self.merges.special, key=len, reverse=True)
        self.split_special = re.compile("|".join(map(re.escape, special))) if special else None
        self.alphabet = byte_alphabet()
        self.words = Words(self)
        self.reset()

    def reset(self) -> None:
        self.states: list[State] = [START]
        self.ids: dict[State, int] = {START: 0}
        self.next: list[dict[str, tuple[int, int]]] = [{}]  # by character: the state, and the tokens emitted
        self.rest: list[int | None] = [0]  # tokens that end-of-text or white space emits

    def id_of(self, state: State) -> int:
        if (i := self.ids.get(state)) is None:
            i = self.ids[state] = len(self.states)
            self.states.append(state)
            self.next.append({})
            self.rest.append(None)
        return i

    # Compilation of one transition ---------------------------------------------------------------

    def _run(self, kind: str, within: Within, pending: str, more: str) -> tuple[State, int]:
        """A run that goes on with the characters more."""
        emitted = 0
        for symbol in (self.alphabet[b] for c in more for b in c.encode("utf-8", "surrogatepass")):
            if pending:
                within, change = self.merges.step(within, pending)
                emitted += change
            pending = symbol
        return (kind, within, pending), emitted

    def _whole(self, piece: str) -> int:
        (_, within, pending), emitted = self._run(LETTERS, Merges.START, "", piece)
        return emitted + self.merges.last(within, pending)

    def _begin(self, c: str) -> tuple[State, int]:
        """The first character of a piece, after the end of another."""
        if c in SPACES:
            return START, 0
        if c == "'":
            return (QUOTE, None, c), 0
        if is_number(c):
            return START, self._whole(c)
        return self._run(LETTERS if is_letter(c) else OTHERS, Merges.START, "", c)

    def _finish(self, state: State) -> int:
        kind, within, pending = state
        if kind == NOTHING:
            return 0
        if kind == QUOTE:  # no contraction: the apostrophe is a piece, and so is the letter behind it
            return self._whole("'") + (self._whole(pending[1:]) if len(pending) > 1 else 0)
        return self.merges.last(within, pending)

    def _compile(self, state: State, c: str) -> tuple[State, int]:
        kind, within, pending = state
        if kind == QUOTE:
            if pending + c in CONTRACTIONS:
                return START, self._whole(pending + c)
            if len(pending) == 1 and any(x.startswith(pending + c) for x in CONTRACTIONS):
                return (QUOTE, None, pending + c), 0
            if len(pending) == 1 and c not in SPACES and not is_letter(c) and not is_number(c):
                return self._run(OTHERS, Merges.START, "", pending + c)
            if len(pending) > 1:  # a letter behind an apostrophe is the start of a run of letters
                within_letters, emitted = self._run(LETTERS, Merges.START, "", pending[1:])
                to, more = self._compile(within_letters, c)
                return to, self._whole("'") + emitted + more
        elif kind == LETTERS and is_letter(c) or kind == OTHERS and not (c in SPACES or is_letter(c) or is_number(c)):
            return self._run(kind, within, pending, c)
        to, emitted = self._begin(c)
        return to, self._finish(state) + emitted

    def _take(self, i: int, c: str) -> tuple[int, int]:
        to, emitted = self._compile(self.states[i], c)
        found = self.next[i][c] = self.id_of(to), emitted
        return found

    # Walks ----------------------------------------------------------------------------------------

    def walk(self, state: State, text: str) -> tuple[State, int]:
        """The state after text, and the tokens emitted on the way."""
        self.bound()
        i, count, table = self.id_of(state), 0, self.next
        for c in text:
            i, emitted = table[i].get(c) or self._take(i, c)
            count += emitted
        return self.states[i], count

    def finish(self, state: State) -> int:
        """Tokens of the piece that the state is within, if the text or the run ends there."""
        i = self.id_of(state)
        if (n := self.rest[i]) is None:
            n = self.rest[i] = self._finish(state)
        return n

    def bound(self) -> None:
        """Throws the compiled part away if it is too large; states are values, so those in use stay good."""
        if len(self.states) > MAX_STATES:
            self.reset()


class Words(dict):
    """The compound transitions of runs between white space, from START to START."""

    def __init__(self, transducer: Transducer):
        self.transducer, self.held = transducer, 0

    def __missing__(self, run: str) -> int:
        state, count = self.transducer.walk(START, run)
        count += self.transducer.finish(state)
        if len(run) <= MAX_RUN:
            if self.held >= MAX_HELD:
                self.clear()
                self.held = 0
            self[run] = count
            self.held += len(run)
        return count


class Chunk:
    """A chunk's state map: for each state in which it is entered, the state that it is left in and the tokens between.

    White space leads to START from everywhere. So all entering states share what comes behind the first white space,
    and a map's value for a state is a walk over the run before it. live holds the values that are known."""

    def __init__(self, t: Transducer, text: str, entering: State | None):
        self.t = t
        runs = (_spaces.split(text) if _odd.search(text) else text.split()) if text else []
        runs = [r for r in runs if r]
        head = bool(runs) and text[0] not in SPACES
        self.synced = bool(text) and (not runs or len(runs) > 1 or not head or text[-1] in SPACES)
        self.head = runs[0] if head else ""
        self.inside, self.exit = 0, START
        if self.synced:
            tail = text[-1] not in SPACES
            self.inside = sum(map(t.words.__getitem__, runs[head : len(runs) - tail]))
            if tail:
                self.exit, emitted = t.walk(START, runs[-1])
                self.inside += emitted
        self.live: dict[State, tuple[State, int]] = {}
        if entering is not None:
            self.at(entering)

    def at(self, state: State) -> tuple[State, int]:
        if (found := self.live.get(state)) is None:
            if not self.synced:
                found = self.t.walk(state, self.head)
            elif state == START:
                found = self.exit, (self.t.words[self.head] if self.head else 0) + self.inside
            else:
                to, emitted = self.t.walk(state, self.head)
                found = self.exit, emitted + self.t.finish(to) + self.inside
            self.live[state] = found
        return found


class Composed:
    """First one state map, then another; associative. Live are the states for which the first one is."""

    def __init__(self, first, then):
        self.first, self.then = first, then
        self.live: dict[State, tuple[State, int]] = {}
        for state, (to, _) in first.live.items():
            if to in then.live:
                self.at(state)

    def at(self, state: State) -> tuple[State, int]:
        if (found := self.live.get(state)) is None:
            middle, one = self.first.at(state)
            to, two = self.then.at(middle)
            found = self.live[state] = to, one + two
        return found


def scan(maps: list):
    """Composes neighbours level by level, as a parallel scan does."""
    while len(maps) > 1:
        maps = [Composed(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return maps[0]


class Counter:
    def __init__(self, path: str):
        self.transducer = Transducer(path)

    def entering(self, text: str, at: int) -> State | None:
        """The state before text[at], if the characters just before it tell: START where nothing comes before, or behind
        white space or a number, which are left in START whatever came before them."""
        if at == 0:
            return START
        for k in range(at - 1, max(-1, at - LOOK_BACK), -1):
            if text[k] in SPACES or is_number(text[k]):
                return self.transducer.walk(START, text[k + 1 : at])[0]
        return None

    def maps(self, text: str, chunk: int) -> list[Chunk]:
        return [Chunk(self.transducer, text[i : i + chunk], self.entering(text, i)) for i in range(0, len(text), chunk)]

    def plain(self, text: str, chunk: int = CHUNK) -> int:
        """Tokens of a text without special strings: the value for START of the composition of its chunks' maps."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # each character by itself: no final sigma
        text = text.lower()
        if not text:
            return 0
        state, count = scan(self.maps(text, chunk)).at(START)
        return count + self.transducer.finish(state)

    def count(self, text: str | None, chunk: int = CHUNK) -> int:
        if not text:
            return 0
        if "<|" not in text or self.transducer.split_special is None:
            return self.plain(text, chunk)
        parts = self.transducer.split_special.split(text)
        return len(parts) - 1 + sum(self.plain(p, chunk) for p in parts if p)


@lru_cache(maxsize=1)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row, by its whole text; null or empty: 0. Repeated rows are counted
    each for itself, other columns ignored; empty table: no rows.

    Every text, short or long, is the composition of its chunks' state maps. A row needs nothing but its text: no
    shuffle. The compiled automaton is bounded by MAX_STATES, MAX_PAIRS and MAX_HELD."""

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        c = counter(path)
        for b in batches:
            yield {"doc_id": b["id"], "n_bytes": b["n"], "n_tokens": [c.count(t) for t in b["text"]]}

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("n"))
    counted = arrow_map(own, rows, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    """count_tokens over documents with the word-end BPE."""
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op9_token_counts": op9_token_counts}
