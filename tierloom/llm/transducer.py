"""Token counts by a compiled finite-state tokenizer.

A BPE segmentation is valid exactly where each pair of neighbouring tokens is, by itself, what the
merges make of the two. That makes segmentation a nondeterministic transducer over (last token, place
in the token trie) with one accepting path per word. It is determinised lazily: a state is the set of
live paths, each with the tokens it is ahead of the set's minimum, and a transition emits by how much
that minimum rises. Around it stands the transducer of a text: it cuts words as the library does and has a
state after every character.

A long text is cut into chunks, whose rows are spread over tasks. Each gives its state map: from the state
before the chunk to the state after it and the tokens emitted on the way. All states meet at the first white
space or digit, so a map is the run over what stands before that, and a constant after it. The maps of a text,
a few bytes each, are composed by a prefix scan.

Defined cases: null and empty texts count 0; repeated rows and null doc_ids are kept as they are; an
empty table gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import json
import pickle
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple, TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, rows
from .token_cache import _CONTRACTED, _PLAIN, byte_alphabet

T = TypeVar("T")
#: Characters of a chunk; its boundaries may fall anywhere. Longer texts are counted by chunks.
CHUNK_CHARS = 1 << 16
# Endings that are words of their own after a quote, in lower case.
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
_QUOTED = frozenset("'" + e for e in _ENDINGS)
_QUOTED_STARTS = frozenset("'" + e[:1] for e in _ENDINGS if len(e) > 1)
_DIGIT = re.compile(r"[0-9\xb2\xb3\xb9\xbc-\xbe]")
_LETTER = re.compile(r"[a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ž]")
_MEETING = re.compile(r"[\s0-9\xb2\xb3\xb9\xbc-\xbe]")
#: Entries after which a worker's lazily built tables start afresh (a memory bound only).
TABLE_ENTRIES = 1_000_000
#: Longest piece that is remembered whole.
_PIECE_CHARS = 64


class BpeTransducer:
    """Lazily determinised token counter for words in the byte alphabet."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.suffix = suffix
        self.ranks = {pair: i for i, pair in reversed(list(enumerate(merges)))}
        self.alphabet = byte_alphabet()
        self.child: dict[int, int] = {}
        self.inner: list[str | None] = [None]
        self.final: list[str | None] = [None]
        self.leaf = [True]
        for token in vocabulary:
            ends = bool(suffix) and token.endswith(suffix)
            symbols = token[: len(token) - len(suffix)] if ends else token
            if not symbols or any(c not in self.alphabet for c in symbols):
                continue
            node = 0
            for c in symbols:
                key = node << 8 | self.alphabet[c]
                if key not in self.child:
                    self.child[key] = len(self.inner)
                    self.inner.append(None)
                    self.final.append(None)
                    self.leaf[node] = False
                    self.leaf.append(True)
                node = self.child[key]
            (self.final if ends else self.inner)[node] = token
        self._reset()

    def _reset(self) -> None:
        self.states: list[tuple] = [((None, 0, 0),)]
        self.number = {self.states[0]: 0}
        self.step: dict[int, tuple[int, int]] = {}
        self.last: dict[int, int] = {}
        self.pairs: dict[tuple, bool] = {}

    def merge(self, symbols: list[str]) -> list[str]:
        """What the merges make of a sequence: the best-ranked pair first, leftmost among equals."""
        while len(symbols) > 1:
            rank, at = min((self.ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)))
            if rank == 1 << 60:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def _symbols(self, token: str) -> list[str]:
        if self.suffix and token.endswith(self.suffix):
            return [*token[: -len(self.suffix) - 1], token[-len(self.suffix) - 1 :]]
        return list(token)

    def neighbours(self, left: str | None, right: str) -> bool:
        """Whether two tokens (or a first token) stay as they are side by side."""
        key = (left, right)
        if (known := self.pairs.get(key)) is None:
            alone = [right] if left is None else [left, right]
            known = self.pairs[key] = self.merge(list(chain.from_iterable(map(self._symbols, alone)))) == alone
        return known

    def numbered(self, entries: tuple) -> int:
        """The number of a set of live paths."""
        if (number := self.number.get(entries)) is None:
            number = self.number[entries] = len(self.states)
            self.states.append(entries)
        return number

    def advance(self, state: int, byte: int) -> tuple[int, int]:
        """The state after a byte that ends no word, and the tokens emitted."""
        key = state << 8 | byte
        if (moved := self.step.get(key)) is None:
            moved = self.step[key] = self._advance(state, byte)
        return moved

    def finish(self, state: int, byte: int) -> int:
        """The tokens that are left when a byte ends the word."""
        key = state << 8 | byte
        if (rest := self.last.get(key)) is None:
            rest = self.last[key] = self._finish(state, byte)
        return rest

    def _advance(self, state: int, byte: int) -> tuple[int, int]:
        live, new = [], None
        for last, node, ahead in self.states[state]:
            node = self.child.get(node << 8 | byte, 0)
            if not node:
                continue
            token = self.inner[node]
            if token is not None and new is None and self.neighbours(last, token):
                new = (token, 0, ahead + 1)
            if not self.leaf[node] or self.final[node] is not None:
                live.append((last, node, ahead))
        if new is not None:
            live.append(new)
        if not live:
            raise ValueError("the vocabulary does not cover this byte")
        least = min(x[2] for x in live)
        return self.numbered(tuple((last, node, ahead - least) for last, node, ahead in live)), least

    def _finish(self, state: int, byte: int) -> int:
        for last, node, ahead in self.states[state]:
            node = self.child.get(node << 8 | byte, 0)
            token = node and (self.final if self.suffix else self.inner)[node]
            if token and self.neighbours(last, token):
                return ahead + 1
        raise ValueError("no segmentation ends here")

    def count(self, word: bytes) -> int:
        """Tokens of one word of at least one byte."""
        if len(self.step) + len(self.last) + len(self.states) > TABLE_ENTRIES:
            self._reset()
        state = total = 0
        step = self.step
        for byte in word[:-1]:
            key = state << 8 | byte
            moved = step.get(key)
            if moved is None:
                moved = step[key] = self._advance(state, byte)
            state = moved[0]
            total += moved[1]
        key = state << 8 | word[-1]
        rest = self.last.get(key)
        if rest is None:
            rest = self.last[key] = self._finish(state, word[-1])
        return total + rest


class State(NamedTuple):
    """Where the transducer of a text stands inside a piece.

    ``kind`` of the open word: none, letters or other signs; ``paths``: its live segmentations up to the byte
    ``held`` back, as only the end of a word shows which byte is its last; ``quote``: a quote that may yet open
    an ending, with what came after it.
    """

    kind: str = ""
    paths: tuple = ((None, 0, 0),)
    held: int = -1
    quote: str = ""


class TextTransducer:
    """Runs over text in lower case from any state; white space ends what is open."""

    def __init__(self, machine: BpeTransducer):
        self.machine = machine

    def _push(self, state: State, data: bytes) -> tuple[State, int]:
        number, held, emitted = self.machine.numbered(state.paths), state.held, 0
        for byte in data:
            if held >= 0:
                number, more = self.machine.advance(number, held)
                emitted += more
            held = byte
        return State(state.kind, self.machine.states[number], held), emitted

    def end(self, state: State) -> int:
        """Tokens of what is open in a state where nothing follows."""
        if state.quote:
            return self.machine.count(b"'") + (self.machine.count(state.quote[1:].encode()) if state.quote[1:] else 0)
        return self.machine.finish(self.machine.numbered(state.paths), state.held) if state.held >= 0 else 0

    def run(self, state: State, text: str) -> tuple[State, int]:
        """The state after a text, and the tokens emitted on the way."""
        total, queue = 0, list(reversed(text))
        while queue:
            c = queue.pop()
            if state.quote:
                if state.quote + c in _QUOTED:
                    total += self.machine.count((state.quote + c).encode())
                    state = State()
                    continue
                if state.quote + c in _QUOTED_STARTS:
                    state = state._replace(quote=state.quote + c)
                    continue
                queue += [c, *reversed(state.quote[1:])]  # no ending: the quote is a sign like others
                state, more = self._push(State("other"), b"'")
            elif c.isspace() or _DIGIT.match(c):
                more = self.end(state) + (0 if c.isspace() else self.machine.count(c.encode()))
                state = State()
            else:
                kind, more = ("letters" if _LETTER.match(c) else "other"), 0
                if kind != state.kind:
                    more, state = self.end(state), State(kind)
                    if c == "'":
                        total += more
                        state = State(quote="'")
                        continue
                state, emitted = self._push(state, c.encode())
                more += emitted
            total += more
        return state, total


class ChunkMap(NamedTuple):
    """From the state before a chunk to the state after it and the tokens between.

    ``head`` is what stands before the first place where all states meet. Where there is one (``met``), the
    rest of the chunk emits ``count`` tokens from there and ends in ``state``, whatever the state before.
    """

    head: str
    met: bool
    count: int
    state: State


def prefix_scan(items: list[T], compose: Callable[[T, T], T]) -> list[T]:
    """Inclusive scan of an associative operation in logarithmically many parallel rounds."""
    if len(items) < 2:
        return list(items)
    pairs = [compose(a, b) for a, b in zip(items[::2], items[1::2], strict=False)]
    inner = prefix_scan(pairs, compose)
    out = [items[0]]
    for i in range(1, len(items)):
        out.append(inner[i // 2] if i % 2 else compose(inner[i // 2 - 1], items[i]))
    return out


class TokenCounter:
    """Counts tokens of whole texts as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = whole.normalizer, whole.pre_tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.machine = BpeTransducer(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        self.plain = bool(self.machine.suffix)
        specials = [x["content"] for x in spec["added_tokens"]]
        self.specials = re.compile("|".join(map(re.escape, specials))) if specials else None
        self.text = TextTransducer(self.machine)
        self.memo: dict[str, int] = {}

    def piece(self, piece: str) -> int:
        """Tokens of one white-space-delimited piece in lower case; those of usual length are remembered as one step."""
        if len(piece) > _PIECE_CHARS:
            state, count = self.text.run(State(), piece)
            return count + self.text.end(state)
        found = self.memo.get(piece)
        if found is None:
            if len(self.memo) > TABLE_ENTRIES:
                self.memo = {}
            found = self.memo[piece] = sum(self.machine.count(w.encode()) for w in _CONTRACTED.findall(piece))
        return found

    def chunkable(self, text: str) -> bool:
        """Whether the transducer's classes are the library's for all of a text."""
        return self.plain and bool(_PLAIN.fullmatch(text)) and not (self.specials and self.specials.search(text))

    def pieces(self, text: str) -> int:
        """Tokens of a stretch in lower case that starts and ends at white space; known pieces are one step each."""
        found = text.split()
        known = list(map(self.memo.get, found))
        return sum(known) if None not in known else sum(self.piece(p) if n is None else n for p, n in zip(found, known, strict=True))

    def chunk_map(self, chunk: str) -> ChunkMap:
        """The state map of a chunk in lower case."""
        first = _MEETING.search(chunk)
        if first is None:
            return ChunkMap(chunk, False, 0, State())
        at = first.start()
        space = next((i for i in range(at, len(chunk)) if chunk[i].isspace()), len(chunk))
        state, count = self.text.run(State(), chunk[at:space])  # from a digit on
        if space < len(chunk):
            last = len(chunk) - 1
            while not chunk[last].isspace():
                last -= 1
            count += self.text.end(state) + self.pieces(chunk[space:last])
            state, more = self.text.run(State(), chunk[last:])
            count += more
        return ChunkMap(chunk[:at], True, count, state)

    def apply(self, chunk: ChunkMap, state: State) -> tuple[State, int]:
        """The state after a chunk and its tokens, from the state before it."""
        after, count = self.text.run(state, chunk.head)
        return (chunk.state, count + self.text.end(after) + chunk.count) if chunk.met else (after, count)

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """The map of two chunks in a row."""
        if not a.met:
            return b._replace(head=a.head + b.head)
        state, count = self.apply(b, a.state)
        return ChunkMap(a.head, True, a.count + count, state)

    def total(self, chunks: list[ChunkMap]) -> tuple[int, list[int]]:
        """Tokens of a text given by its chunks' maps, and how many are complete after each chunk."""
        reached = [self.apply(m, State()) for m in prefix_scan(chunks, self.compose)]
        state, count = reached[-1]
        return count + self.text.end(state), [c for _, c in reached]

    def count(self, text: str | None, chunk_chars: int = CHUNK_CHARS) -> int:
        """Tokens of one text (null: none)."""
        if not text:
            return 0
        if self.chunkable(text):
            text = text.lower()
            if len(text) <= chunk_chars:
                return self.pieces(text)
            return self.total([self.chunk_map(text[i : i + chunk_chars]) for i in range(0, len(text), chunk_chars)])[0]
        if not self.specials:
            return self._general(text)
        parts = self.specials.split(text)
        return len(parts) - 1 + sum(map(self._general, parts))

    def _general(self, text: str) -> int:
        """Any text, by the library's own normalizer and cutting rule."""
        if not text:
            return 0
        if self.normalizer is not None:
            text = self.normalizer.normalize_str(text)
        alphabet, count = self.machine.alphabet, self.machine.count
        return sum(count(bytes(map(alphabet.__getitem__, word))) for word, _ in self.pre_tokenizer.pre_tokenize_str(text) if word)


@lru_cache(maxsize=4)
def counter(path: str) -> TokenCounter:
    """One counter per Python worker and vocabulary."""
    return TokenCounter(path)


_COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])
_COUNTS_DDL = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
_CHUNKS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("i", pa.int32()), ("whole", pa.bool_()), ("chunk", pa.string())])
_MAPS = pa.schema([*list(_CHUNKS)[:4], ("map", pa.binary())])


def token_counts(documents: DataFrame, tokenizer_path: str, limit: int = 2048, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether they exceed ``limit``.

    Texts of up to ``chunk_chars`` characters are counted where they are read. Longer ones are cut into chunks
    that go to tasks of their own; only these texts are shuffled, and then one map for each chunk.
    """
    length = F.coalesce(F.char_length("text"), F.lit(0))
    some = documents.select("doc_id", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(tokenizer_path).count

        def items() -> Iterator[tuple]:
            for batch in batches:
                for doc, text in rows(batch, "doc_id", "text"):
                    n = tokens(text, chunk_chars)
                    yield doc, len((text or "").encode()), n, n > limit

        yield from batched(_COUNTS, items())

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunkable = counter(tokenizer_path).chunkable

        def items() -> Iterator[tuple]:
            for batch in batches:
                for row, doc, text in rows(batch, "row", "doc_id", "text"):
                    n_bytes = len(text.encode())
                    if not chunkable(text):
                        yield row, doc, n_bytes, 0, True, text
                        continue
                    low = text.lower()
                    for i, at in enumerate(range(0, len(low), chunk_chars)):
                        yield row, doc, n_bytes, i, False, low[at : at + chunk_chars]

        yield from batched(_CHUNKS, items(), 16)

    def map_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(tokenizer_path)

        def items() -> Iterator[tuple]:
            for batch in batches:
                for row, doc, n_bytes, i, whole, chunk in rows(batch, "row", "doc_id", "n_bytes", "i", "whole", "chunk"):
                    made = ChunkMap("", True, of.count(chunk), State()) if whole else of.chunk_map(chunk)
                    yield row, doc, n_bytes, i, pickle.dumps(made)

        yield from batched(_MAPS, items(), 1000)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = counter(tokenizer_path).total

        def items() -> Iterator[tuple]:
            for batch in batches:
                for doc, n_bytes, maps in rows(batch, "doc_id", "n_bytes", "maps"):
                    n, _ = total([pickle.loads(m["map"]) for m in maps])
                    yield doc, n_bytes, n, n > limit

        yield from batched(_COUNTS, items(), 1000)

    short = some.where(length <= chunk_chars).mapInArrow(count, _COUNTS_DDL)
    long = some.where(length > chunk_chars).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    chunks = long.mapInArrow(cut_up, "row long, doc_id long, n_bytes long, i int, whole boolean, chunk string").repartition("row", "i")
    maps = chunks.mapInArrow(map_chunks, "row long, doc_id long, n_bytes long, i int, map binary")
    gathered = maps.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes"), F.array_sort(F.collect_list(F.struct("i", "map"))).alias("maps"))
    return short.unionByName(gathered.mapInArrow(scan, _COUNTS_DDL))
