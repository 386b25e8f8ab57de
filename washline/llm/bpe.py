"""Byte-level BPE with vectorised pre-tokenisation.

The splitting pattern is worked off without a regular expression. Every code point has a class (letter,
number, white space, other); with a look at its neighbours it becomes one of nine symbols. A small
automaton reads the symbols, and each symbol is a transition function on its states. Composing
functions is associative, and the functions that compositions can reach are few, so a composition is a
look-up in a table: prefixes are composed inside blocks of all texts at once, the blocks' totals are
scanned, and the state before every character follows. A boundary is where the automaton starts a token.

The slices between boundaries feed the pair merging, whose results are cached for short slices. The end
of every token in bytes is kept; decoding joins the tokens' bytes.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_values, let_go_after

CACHED = 150_000
CACHED_BYTES = 48
CHUNK = 1 << 20
ROWS = 256
FEW = 64
SCAN_BLOCK = 64

#: The code points of white space (Unicode White_Space).
WHITE_SPACE = [
    *range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F,
    0x205F, 0x3000,
]
#: What may follow an apostrophe as a token of its own, by its length.
SHORT_ENDINGS = ["s", "t", "m", "d"]
LONG_ENDINGS = ["re", "ve", "ll"]

OTHER, LETTER, NUMBER, SPACE = range(4)

# What a character is to the automaton.
(S_LETTER, S_NUMBER, S_OTHER, S_SPACE_BEFORE, S_SPACE_INSIDE, S_SPACE_LAST, S_SHORT, S_LONG,
 S_START) = range(9)
# What the token holds so far: nothing yet; letters; numbers; others; one plain space; white space that
# goes on; white space that ends; an apostrophe with one, or two, characters to come; a full ending.
(FRESH, LETTERS, NUMBERS, OTHERS, PREFIX, BLANK, BLANK_END, ONE_MORE, TWO_MORE, ENDED) = range(10)


def _next(state: int, symbol: int) -> tuple[int, bool]:
    """The state after a character, and whether the character starts a token."""
    if symbol == S_START:
        return FRESH, False
    if symbol == S_LETTER:
        if state == TWO_MORE:
            return ONE_MORE, False
        if state == ONE_MORE:
            return ENDED, False
        return LETTERS, state not in (LETTERS, PREFIX)
    if symbol == S_NUMBER:
        return NUMBERS, state not in (NUMBERS, PREFIX)
    if symbol == S_SPACE_BEFORE:
        return PREFIX, True
    if symbol == S_SPACE_INSIDE:
        return BLANK, state != BLANK
    if symbol == S_SPACE_LAST:
        return BLANK_END, True
    if state in (OTHERS, PREFIX):  # an apostrophe inside a run of others is one of them
        return OTHERS, False
    return {S_SHORT: ONE_MORE, S_LONG: TWO_MORE}.get(symbol, OTHERS), True


@lru_cache(maxsize=1)
def _automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(number of each symbol's function, composition table, result of function and state, token
    starts by symbol and state)``; functions are numbered as compositions reach them."""
    states, symbols = range(ENDED + 1), range(S_START + 1)
    functions = [tuple(_next(q, s)[0] for q in states) for s in symbols]
    numbers: dict[tuple[int, ...], int] = {}
    for f in [tuple(states), *functions]:
        numbers.setdefault(f, len(numbers))
    pending = list(numbers)
    while pending:
        f = pending.pop()
        for g in functions:
            h = tuple(g[q] for q in f)
            if h not in numbers:
                numbers[h] = len(numbers)
                pending.append(h)
    every = list(numbers)
    compose = np.array([[numbers.get(tuple(g[q] for q in f), 0) for g in every] for f in every], np.int16)
    return (
        np.array([numbers[f] for f in functions], dtype=np.int16), compose,
        np.array(every, dtype=np.uint8),
        np.array([[_next(q, s)[1] for q in states] for s in symbols]),
    )


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of every code point, in the edition of Unicode that the tokenizer library has."""
    table = np.zeros(0x110000, dtype=np.uint8)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    single_bytes = {bytes([i]): i for i in range(256)}
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        asked = tiktoken.Encoding(
            pattern, pat_str=pattern, mergeable_ranks=single_bytes, special_tokens={}
        )
        found = asked.decode(asked.encode_ordinary(every))  # what matches, and nothing else
        table[[ord(c) for c in found]] = kind
    table[WHITE_SPACE] = SPACE
    return table


def _symbols(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The automaton's symbols; ``starts`` are the places of the marks before each text."""
    kinds = _classes()[points]
    kinds[starts] = SPACE  # a mark ends the text before it as a space would
    following = np.append(kinds[1:], SPACE)
    symbols = np.array([S_OTHER, S_LETTER, S_NUMBER, S_SPACE_INSIDE], np.uint8)[kinds]
    last = (kinds == SPACE) & (following != SPACE)
    symbols[last] = np.where(points[last] == 32, S_SPACE_BEFORE, S_SPACE_LAST)
    quotes = np.flatnonzero(points == 39)
    if len(quotes):
        padded = np.append(points, [0, 0])
        one, two = padded[quotes + 1], padded[quotes + 2]
        short = np.isin(one, [ord(x) for x in SHORT_ENDINGS])
        pairs = [(ord(x[0]) << 21) | ord(x[1]) for x in LONG_ENDINGS]
        long = np.isin((one.astype(np.int64) << 21) | two, pairs)
        symbols[quotes[short]] = S_SHORT
        symbols[quotes[long]] = S_LONG
    symbols[starts] = S_START
    return symbols


def _states_before(symbols: np.ndarray) -> np.ndarray:
    """The automaton's state before every symbol, by a blocked scan of composed functions."""
    functions, compose, results, _ = _automaton()
    n = len(symbols)
    rows = -(-n // SCAN_BLOCK)
    own = np.zeros(rows * SCAN_BLOCK, dtype=np.int16)  # 0 is the identity
    own[:n] = functions[symbols]
    own = np.ascontiguousarray(own.reshape(rows, SCAN_BLOCK).T)
    before = np.empty_like(own)
    now = np.zeros(rows, dtype=np.int16)
    width = len(compose)
    flat = compose.ravel()
    for j in range(SCAN_BLOCK):
        before[j] = now
        now = flat[now.astype(np.int32) * width + own[j]]
    # totals of blocks: a scan in doubling steps
    totals, step = now, 1
    while step < rows:
        totals = np.concatenate((
            totals[:step], flat[totals[:-step].astype(np.int32) * width + totals[step:]]
        ))
        step *= 2
    entry = np.concatenate(([FRESH], results[totals[:-1], FRESH])).astype(np.intp)
    return results[before, entry[None, :]].T.ravel()[:n]


def split(texts: list[bytes]) -> list[np.ndarray]:
    """The ends in bytes of the slices of every text (UTF-8)."""
    joined = "\0" + "\0".join(t.decode("utf-8") for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    widths = 1 + (points >= 0x80) + (points >= 0x800).astype(np.int64) + (points >= 0x10000)
    ends = np.cumsum(widths)
    marks_at = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))  # bytes before each mark
    starts = np.searchsorted(ends - widths, marks_at)
    symbols = _symbols(points, starts)
    opens = _automaton()[3][symbols, _states_before(symbols)]
    at = (ends - widths)[opens]
    cut = np.searchsorted(at, np.append(marks_at, ends[-1]))
    return [
        np.append(at[a + 1: b], m + 1 + n) - m - 1 if n else np.zeros(0, np.int64)
        for a, b, m, n in zip(cut[:-1], cut[1:], marks_at, sizes)
    ]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The tokens of one slice: the pair of lowest rank is merged first, the leftmost on ties."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    return _merge_few(piece, ranks) if n <= FEW else _merge_many(piece, ranks)


def _merge_few(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    never = len(ranks)
    cuts = list(range(len(piece) + 1))
    pairs = [ranks.get(piece[i: i + 2], never) for i in range(len(piece) - 1)]
    while pairs:
        least = min(pairs)
        if least >= never:
            break
        i = pairs.index(least)
        del cuts[i + 1], pairs[i]
        if i < len(pairs):
            pairs[i] = ranks.get(piece[cuts[i]: cuts[i + 2]], never)
        if i:
            pairs[i - 1] = ranks.get(piece[cuts[i - 1]: cuts[i + 1]], never)
    return [ranks[piece[a:b]] for a, b in zip(cuts, cuts[1:])]


def _merge_many(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap, in time that hardly grows faster than the slice."""
    n = len(piece)
    end = list(range(1, n + 1))  # where the part that starts here ends; 0 once it is merged away
    back = list(range(-1, n - 1))

    def pair(start: int) -> tuple[int, int, int] | None:
        if end[start] >= n:
            return None
        stop = end[end[start]]
        rank = ranks.get(piece[start:stop])
        return None if rank is None else (rank, start, stop)

    heap = [p for p in map(pair, range(n - 1)) if p]
    heapq.heapify(heap)
    while heap:
        _, start, stop = heapq.heappop(heap)
        middle = end[start]
        if not middle or middle >= n or end[middle] != stop:
            continue  # one of the two parts has changed
        end[start], end[middle] = stop, 0
        if stop < n:
            back[stop] = start
        for changed in (start, back[start]):
            if changed >= 0 and (new := pair(changed)):
                heapq.heappush(heap, new)
    out, at = [], 0
    while at < n:
        out.append(ranks[piece[at: end[at]]])
        at = end[at]
    return out


def read_ranks(path: str) -> bytes:
    """The rank file, read once on the driver and sent along: its size is that of a vocabulary."""
    with open(path, "rb") as file:
        return file.read()


@lru_cache(maxsize=2)
def parse_ranks(content: bytes) -> dict[bytes, int]:
    lines = (line.split() for line in content.splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in lines}


class Encoder:
    def __init__(self, content: bytes):
        self.ranks = parse_ranks(content)
        self.sizes = np.zeros(max(self.ranks.values()) + 1, dtype=np.int32)
        for token, rank in self.ranks.items():
            self.sizes[rank] = len(token)
        self.recent: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def ids(self, text: bytes, ends: np.ndarray) -> np.ndarray:
        recent, out, start = self.recent, [], 0
        append = out.append
        for end in ends.tolist():
            piece = text[start:end]
            found = recent.get(piece)
            if found is None:
                found = self._missing(piece)
                recent = self.recent
            append(found)
            start = end
        return np.frombuffer(b"".join(out), dtype="<i4")

    def forget(self) -> None:
        self.recent, self.older = {}, {}

    def _missing(self, piece: bytes) -> bytes:
        """Packed ids, kept in two generations of bounded size: what was used since the last change
        stays."""
        found = self.older.get(piece)
        if found is None:
            found = np.array(merge(piece, self.ranks), dtype="<i4").tobytes()
        if len(piece) <= CACHED_BYTES:
            if len(self.recent) >= CACHED:
                self.older, self.recent = self.recent, {}
            self.recent[piece] = found
        return found


@lru_cache(maxsize=1)
def _encoder(content: bytes) -> Encoder:
    """One for each worker process; its tables outlive a task, what it has cached does not."""
    return Encoder(content)


def encode(
    docs: DataFrame, ranks: bytes, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(key, ids, ends)`` per document: token ids, and where each token ends in the UTF-8 text.

    A null or empty text has no tokens. Every row of ``docs``, repeated ones and those with a null
    key too, has a row of its own.
    """
    chosen = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("__text"))
    kind = chosen.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks)
        for batch in batches:
            start, size = 0, 0
            lengths = [v or 0 for v in pa.compute.binary_length(batch.column(1)).to_pylist()]
            for i, n in enumerate(lengths):
                if i > start and size + n > CHUNK:
                    yield _encoded(batch.slice(start, i - start), encoder, key)
                    start, size = i, 0
                size += n
            yield _encoded(batch.slice(start), encoder, key)

    whole = let_go_after(run, lambda: _encoder(ranks).forget())
    return chosen.mapInArrow(whole, f"`{key}` {kind}, ids array<int>, ends array<int>")


def _encoded(batch: pa.RecordBatch, encoder: Encoder, key: str) -> pa.RecordBatch:
    texts = byte_values(batch.column(1))
    if len(texts) == 1:
        parts = chunks(texts[0])
        found = [encoder.ids(p, e) for p in parts for e in split([p])]
        ids = [np.concatenate(found)]
    else:
        ids = [encoder.ids(t, e) for t, e in zip(texts, split(texts))]
    ends = [np.cumsum(encoder.sizes[i], dtype=np.int32) for i in ids]
    return pa.RecordBatch.from_arrays(
        [batch.column(0), _lists(ids), _lists(ends)], [key, "ids", "ends"]
    )


def chunks(text: bytes) -> list[bytes]:
    """A very long text in parts, cut where a plain space follows a visible ASCII character: a slice
    starts there whatever surrounds it."""
    out, at = [], 0
    while len(text) - at > CHUNK:
        found = re.compile(rb"(?<=[!-~]) ").search(text, at + CHUNK)
        if not found:
            break
        out.append(text[at: found.start()])
        at = found.start()
    return [*out, text[at:]]


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values).astype(np.int32)))


def decode(tokens: DataFrame, ranks: bytes, key: str = "doc_id") -> DataFrame:
    """``(key, n_tokens, id_bytes, decoded)``: ids as little-endian 32-bit numbers, and the bytes they
    stand for. ``tokens`` has ``key``, ``ids`` and ``ends`` as ``encode`` returns them; a token
    that does not end where ``ends`` says raises."""
    kind = tokens.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _tokens(ranks)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                yield _decoded(batch.slice(at, ROWS), table, key)

    return tokens.select(key, "ids", "ends").mapInArrow(
        let_go_after(run), f"`{key}` {kind}, n_tokens long, id_bytes binary, decoded binary"
    )


@lru_cache(maxsize=1)
def _tokens(content: bytes) -> dict[int, bytes]:
    return {rank: token for token, rank in parse_ranks(content).items()}


def _decoded(batch: pa.RecordBatch, table: dict[int, bytes], key: str) -> pa.RecordBatch:
    many, packed, texts = [], [], []
    for ids, ends in zip(batch.column(1), batch.column(2)):
        numbers = np.asarray(ids.values, dtype="<i4") if ids.is_valid else np.zeros(0, "<i4")
        text = b"".join(map(table.__getitem__, numbers.tolist()))
        if len(numbers) and ends.is_valid and ends.values[-1].as_py() != len(text):
            raise ValueError("the tokens do not end where the offsets say")
        many.append(len(numbers))
        packed.append(numbers.tobytes())
        texts.append(text)
    return pa.RecordBatch.from_arrays(
        [batch.column(0), pa.array(many, pa.int64()), pa.array(packed, pa.binary()),
         pa.array(texts, pa.binary())], [key, "n_tokens", "id_bytes", "decoded"],
    )


def token_digests(docs: DataFrame, ranks: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_tokens, ids_sha256, decoded_sha256)``: the tokens of every document, checked by decoding, as
    their number and digests of the ids and of the decoded bytes."""
    return decode(encode(docs, ranks, key, text), ranks, key).select(
        F.col(f"`{key}`"), "n_tokens", F.sha2("id_bytes", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
