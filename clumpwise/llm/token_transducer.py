"""Token counts by finite-state tokenizer compilation.

A byte-pair vocabulary with word ends is compiled into a deterministic
transducer over symbols (a byte, or a byte that ends its word). After any
prefix of a word the encoding of that prefix is unique and grows by whole
tokens: the encoding of a longer prefix is that of some shorter one plus one
token, the one that may stand next to that prefix's last token. So a state is
the longest suffix that may still grow into a token, with the last tokens and
relative counts of the prefixes inside it; a transition carries the change of
the token count. States are made when first reached, and all but the present one are dropped and
made anew when there are too many.

The word splitter is a transducer over characters around it (``Reader``): its state is the
kind of the open word, the byte-pair state inside it, and what is not yet fed. A
text is cut into chunks. Each chunk is a map of reader states, state in to
(state out, tokens): white space closes every word, so from a chunk's first white
space on the map is constant, and before it the map is the chunk's head, which is
stepped from the state that comes in. Maps compose associatively, and a parallel prefix scan over a
long text's maps gives the counts of all its prefixes. Whole words that stand inside chunks lead from
the start state to the start state; these long transitions are kept in a bounded memory.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clumpwise.llm.textops import map_arrow

#: Characters of a chunk.
CHUNK = 1 << 16
#: Most states, and most words remembered, in one worker.
STATES, WORDS = 150_000, 400_000


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte that byte-level vocabularies use."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Transducer:
    """A byte-pair vocabulary with ``merges`` and an end-of-word suffix, as a lazily compiled transducer."""

    def __init__(self, merges: list[tuple[str, str]], suffix: str) -> None:
        # inside, a word's last symbol is moved up by 2048, so that every symbol is one character
        def inner(token: str) -> str:
            if suffix and token.endswith(suffix):
                token = token[: -len(suffix)]
                return token[:-1] + chr(ord(token[-1]) + 2048)
            return token

        self.rank = {}
        for k, (a, b) in enumerate(merges):
            self.rank.setdefault((inner(a), inner(b)), k)
        self.tokens = {a + b for a, b in self.rank}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        self.stems = {t[:k] for t in self.tokens for k in range(1, len(t))}
        self.longest = max(map(len, self.tokens), default=1)
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[tuple, int] = {("", ((None, 0),)): 0}
        self.keys: list[tuple] = [("", ((None, 0),))]
        self.steps: dict[tuple[int, str], tuple[int, int]] = {}

    def merged(self, symbols: str) -> list[str]:
        """The encoding by definition: the pair of lowest rank first, leftmost on a tie."""
        parts = list(symbols)
        while len(parts) > 1:
            best = min(zip(parts, parts[1:], strict=False), key=lambda p: self.rank.get(p, 1 << 60))
            if best not in self.rank:
                break
            out, k = [], 0
            while k < len(parts):
                if k + 1 < len(parts) and (parts[k], parts[k + 1]) == best:
                    out.append(parts[k] + parts[k + 1])
                    k += 2
                else:
                    out.append(parts[k])
                    k += 1
            parts = out
        return parts

    def _adjacent(self, a: str | None, b: str) -> bool:
        """Whether token b may follow token a (None: the word's start)."""
        if b not in self.whole:
            self.whole[b] = self.merged(b) == [b]
        if a is None or not self.whole[b]:
            return self.whole[b]
        ok = self.pairs.get((a, b))
        if ok is None:
            ok = self.merged(a + b) == [a, b]
            if len(self.pairs) > STATES:
                self.pairs.clear()
            self.pairs[a, b] = ok
        return ok

    def step(self, state: int, symbol: str) -> tuple[int, int]:
        """(next state, change of the token count)."""
        known = self.steps.get((state, symbol))
        if known is not None:
            return known
        open_, last = self.keys[state]  # last[j]: of the prefix that is len(open_) - j symbols shorter
        text = open_ + symbol
        n = len(open_)
        for size in range(min(len(text), self.longest), 0, -1):
            token = text[-size:]
            if size > 1 and token not in self.tokens:
                continue
            before, count = last[n + 1 - size]
            if self._adjacent(before, token):
                now = (token, count + 1)
                break
        else:
            raise AssertionError("no encoding")
        delta = now[1] - last[-1][1]
        keep = min(len(text), self.longest - 1)
        while keep and text[-keep:] not in self.stems:
            keep -= 1
        tail = (*last, now)[len(text) - keep :]
        base = tail[-1][1]
        key = (text[len(text) - keep :], tuple((t, c - base) for t, c in tail))
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.keys)
            self.keys.append(key)
        self.steps[state, symbol] = number, delta
        return number, delta

    def count(self, symbols: str) -> int:
        """Tokens of one word, its last symbol marked as its end."""
        state = total = 0
        for x in symbols:
            state, delta = self.step(state, x)
            total += delta
            if len(self.keys) > STATES:
                state = self.fresh(state)
        return total

    def fresh(self, state: int) -> int:
        """The number of a state after all others are dropped."""
        key = self.keys[state]
        self.clear()
        if key not in self.numbers:
            self.numbers[key] = len(self.keys)
            self.keys.append(key)
        return self.numbers[key]


#: A reader's state: the open word's kind, the byte-pair state key inside it, its last byte that is not yet fed (-1: none), and held characters.
State = tuple[str, tuple, int, str]
BYTE_START = ("", ((None, 0),))
START: State = ("", BYTE_START, -1, "")


class Reader:
    """The word splitter over single characters: letters run, others run, each number stands alone, white space parts words,
    and literals (such as 's after a word) that begin where a word begins go before all."""

    def __init__(self, transducer: Transducer, literals: Iterable[str], symbols: list[str]) -> None:
        self.transducer, self.literals, self.symbols = transducer, frozenset(literals), symbols
        self.stems = {x[:k] for x in self.literals for k in range(1, len(x))}

    def _byte(self, state: tuple, symbol: str) -> tuple[tuple, int]:
        t = self.transducer
        if len(t.keys) > STATES:
            t.clear()
        if state not in t.numbers:
            t.numbers[state] = len(t.keys)
            t.keys.append(state)
        number, delta = t.step(t.numbers[state], symbol)
        return t.keys[number], delta

    def close(self, state: State) -> int:
        """Tokens that end with the open word."""
        kind, inside, last, held = state
        if held:  # no literal after all
            state, n = self._plain(START, held)
            return n + self.close(state)
        return self._byte(inside, chr(ord(self.symbols[last]) + 2048))[1] if kind else 0

    def _plain(self, state: State, text: str) -> tuple[State, int]:
        """Read held characters; the first begins no literal."""
        state, n = self._open(state, text[0], kind_of(text[0]))
        for c in text[1:]:
            state, k = self.read(state, c)
            n += k
        return state, n

    def _open(self, state: State, c: str, kind: str) -> tuple[State, int]:
        """Add a character to the open word (or open one)."""
        _, inside, last, _ = state
        n = 0
        for b in c.encode("utf-8", "surrogatepass"):
            if last >= 0:
                inside, k = self._byte(inside, self.symbols[last])
                n += k
            last = b
        if kind == "N":  # a number is a word by itself
            return START, n + self._byte(inside, chr(ord(self.symbols[last]) + 2048))[1]
        return (kind, inside, last, ""), n

    def read(self, state: State, c: str) -> tuple[State, int]:
        """(next state, tokens) of one character."""
        kind, inside, last, held = state
        if held:
            both = held + c
            if both in self.literals:
                word, n = START, 0
                for x in both:
                    word, k = self._open(word, x, "P")
                    n += k
                return START, n + self.close(word)
            if both in self.stems:
                return (kind, inside, last, both), 0
            return self._plain(START, both)
        now = kind_of(c)
        if now == "S":
            return START, self.close(state)
        if kind and kind == now:
            return self._open(state, c, kind)
        n = self.close(state)
        if c in self.literals or c in self.stems:
            return ("", BYTE_START, -1, c), n
        state, k = self._open(START, c, now)
        return state, n + k

    def run(self, state: State, text: str) -> tuple[State, int]:
        total = 0
        for c in text:
            state, n = self.read(state, c)
            total += n
        return state, total


@lru_cache(maxsize=65536)
def kind_of(c: str) -> str:
    """L: letter, N: number, S: white space, P: anything else."""
    return "L" if _LETTER.match(c) else "N" if _NUMBER.match(c) else "S" if _SPACE.match(c) else "P"


@dataclass(frozen=True)
class ChunkMap:
    """State in -> (state out, tokens). ``heads`` are read from the state that comes in. If ``closed``, a white space follows them, then
    ``tokens`` more, and the state out is ``out`` whatever came in."""

    heads: tuple
    closed: bool = False
    tokens: int = 0
    out: State = START

    def texts(self) -> Iterator[str]:
        """The head's parts in order."""
        todo: list = [self.heads]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                yield x
            else:
                todo.extend(reversed(x))


class WordCounter:
    """Token counts of texts for a tokenizer file of the ``word end`` kind (see ``compiled``)."""

    def __init__(self, spec: str) -> None:
        j = json.loads(spec)
        model = j["model"]
        steps = [x["type"] for x in j["normalizer"]["normalizers"]]
        split = j["pre_tokenizer"]["pretokenizers"]
        if model["type"] != "BPE" or not model.get("end_of_word_suffix") or steps != ["NFC", "Replace", "Lowercase"] or split[0]["behavior"] != "Removed" or not split[0]["invert"] or any(t["normalized"] or t["single_word"] for t in j["added_tokens"]):
            raise ValueError("not a tokenizer of the kind compiled here")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.transducer = Transducer(merges, model["end_of_word_suffix"])
        self.word = regex.compile(split[0]["pattern"]["Regex"])
        self.special = re.compile("|".join(re.escape(t["content"]) for t in j["added_tokens"]) or r"(?!)")
        self.bytes = byte_symbols()
        self.known: dict[str, int] = {}
        *literals, letters, number, other = split[0]["pattern"]["Regex"].split("|")
        if [letters, number, other] != [r"[\p{L}]+", r"[\p{N}]", r"[^\s\p{L}\p{N}]+"] or any(re.escape(x) != x for x in literals):
            raise ValueError("not a word splitter of the kind compiled here")
        self.reader = Reader(self.transducer, literals, self.bytes)

    def tokens_of(self, word: str) -> int:
        """The long transition of a whole word: its tokens, from the start state to the start state."""
        n = self.known.get(word)
        if n is None:
            b = word.encode("utf-8", "surrogatepass")
            symbols = "".join(self.bytes[x] for x in b[:-1]) + chr(ord(self.bytes[b[-1]]) + 2048)
            n = self.transducer.count(symbols)
            if len(word) <= 64:
                if len(self.known) >= WORDS:
                    self.known.clear()
                self.known[word] = n
        return n

    def chunk_map(self, text: str) -> ChunkMap:
        """The map of one chunk."""
        first = _SPACE.search(text)
        if first is None:
            return ChunkMap((text,))
        a = first.start()
        b = max(text.rfind(x) for x in set(_SPACE.findall(text[max(a, len(text) - 4096) :]) or _SPACE.findall(text)))
        out, n = self.reader.run(START, text[b:])
        return ChunkMap((text[:a],), True, n + (self.inside(text[a:b]) if b > a else 0), out)

    def apply(self, x: ChunkMap, state: State) -> tuple[State, int]:
        """(state out, tokens) of a map from one state."""
        n = 0
        for text in x.texts():
            state, k = self.reader.run(state, text)
            n += k
        return (x.out, n + self.reader.close(state) + x.tokens) if x.closed else (state, n)

    def join(self, x: ChunkMap, y: ChunkMap) -> ChunkMap:
        """The map of two neighbouring chunks; associative."""
        if not x.closed:
            return ChunkMap((x.heads, y.heads), y.closed, y.tokens, y.out)
        out, n = self.apply(y, x.out)
        return ChunkMap(x.heads, True, x.tokens + n, out)

    def inside(self, text: str) -> int:
        """Tokens of a text that begins and ends at word borders."""
        known, count = self.known, 0
        for w in self.word.findall(text):
            n = known.get(w)
            count += self.tokens_of(w) if n is None else n
        return count

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ").lower()
        if len(text) <= CHUNK:
            return self.inside(text)
        maps = [self.chunk_map(text[k : k + CHUNK]) for k in range(0, len(text), CHUNK)]
        while len(maps) > 1:  # the whole is the root of the scan's tree
            maps = [self.join(*maps[k : k + 2]) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)]
        return self.total(maps[0])

    def total(self, x: ChunkMap) -> int:
        state, n = self.apply(x, START)
        return n + self.reader.close(state)

    def prefix_counts(self, chunks: list[str]) -> list[int]:
        """Tokens of every prefix of chunks (of normalised text): a parallel prefix scan over their maps.

        In step d each map is joined with the one d places before it, so log2 n
        steps of independent joins give all prefixes.
        """
        maps, d = [self.chunk_map(c) for c in chunks], 1
        while d < len(maps):
            maps = [self.join(maps[k - d], m) if k >= d else m for k, m in enumerate(maps)]
            d *= 2
        return [self.total(m) for m in maps]

    def text(self, text: str) -> int:
        """Tokens of a text; special strings inside are one token each, as the library has it by default."""
        if "<|" not in text:
            return self.plain(text)
        parts = self.special.split(text)
        return sum(map(self.plain, parts)) + len(parts) - 1


_SPACE, _LETTER, _NUMBER = (regex.compile(x) for x in (r"\s", r"\p{L}", r"\p{N}"))
_COMPILED: dict[int, WordCounter] = {}


def compiled(spec: str) -> WordCounter:
    """The worker's counter for a tokenizer file's content."""
    key = hash(spec)
    if key not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[key] = WordCounter(spec)
    return _COMPILED[key]


def count_tokens(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row, by the tokenizer file at ``tokenizer_path`` (read on the driver).

    Whole texts, without begin, end or added special tokens. A null text counts
    as empty (0 bytes, 0 tokens). Repeated rows stay; other columns are ignored.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = compiled(spec.value)
        counter: Callable[[str], int] = words.text
        for batch in batches:
            n = [counter(t.as_py()) if t.is_valid else 0 for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])
        _COMPILED.clear()  # an idle worker holds no tokenizer

    size = F.coalesce(F.octet_length("text").cast("long"), F.lit(0).cast("long"))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), size.alias("n_bytes"))
    return map_arrow(rows, scan, "doc_id long, n_bytes long, n_tokens long")
