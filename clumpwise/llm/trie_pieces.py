"""SentencePiece encoding and decoding by a shared-prefix Viterbi pass.

White space is marked, and a text falls apart into marked words (a run of marks
with the characters after it), as no piece holds a mark after another
character. The distinct words of a slice of documents are sorted, so that they
form a trie, and are walked depth-first: the forward scores along the common
prefix of two neighbours are kept and only the rest is computed.

A forward cell holds the best segmentation of a prefix: its last piece and the
place where that piece begins. The models are of the merging kind, whose score
ranks segmentations by the merges that make them, so the best last piece of a
prefix is the one that may stand beside the last piece of the cell before it;
what may stand side by side is settled by the model's merges once a pair. Where
no piece may end a word (none is known) the merges themselves are taken; tests compare
all this with the library. A very long word keeps packed cells and the open pieces of
its last characters only, and shares no prefix.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clumpwise.llm.textops import map_arrow, ramp

MARK = "▁"
#: What the unknown piece reads as.
UNKNOWN = " \u2047 "
#: Most words and pairs remembered by one worker, and the longest word remembered.
WORDS, PAIRS, REMEMBERED = 400_000, 300_000, 64
#: Characters from which a word is walked by itself, in packed cells.
LONG = 1024
#: Characters of texts whose words are sorted together.
SLICE_CHARS = 2_000_000

# inside, marks are spaces: such strings are smaller and faster than those with marks
_WORD = re.compile(r" *[^ ]+| +")


class PieceModel:
    """Pieces, scores and bytes of a model file, with forward-backward segmentation."""

    def __init__(self, blob: bytes) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=blob)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.is_byte = [sp.is_byte(i) for i in range(n)]
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.is_byte[i]}
        plain = [i for i in range(n) if not (self.is_byte[i] or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {self.pieces[i].replace(MARK, " "): i for i in plain}
        if len(self.bytes) != 256 or any(" " in p.lstrip(" ") for p in self.ids) or sp.encode("a  b", out_type=str) != [MARK + "a", MARK, MARK + "b"]:
            raise ValueError("a model with byte pieces, marks at the front and unchanged white space is needed")
        own = [b"" if sp.is_control(i) else UNKNOWN.encode() if sp.is_unknown(i) else bytes([int(p[3:5], 16)]) if self.is_byte[i] else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        self.size = np.asarray([len(x) for x in own], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(own), np.uint8)
        self.marked = np.asarray([p.startswith(MARK) for p in self.pieces])
        self.unknown = next((i for i in range(n) if sp.is_unknown(i)), -1)
        self.silent = {i for i in range(n) if sp.is_control(i)}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        # words by number, and each number's ids: row[rows_at[k] : rows_at[k + 1]]
        self.known: dict[str, int] = {}
        self.row, self.rows_at = array("i"), array("q", [0])
        self.pairs: dict[int, bool] = {}
        self.text: dict[int, str] = {i: p for p, i in self.ids.items()}
        self.trie: dict = {}
        for p, i in self.ids.items():
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            if self.merged(p) == [p]:  # else the merges never end in this piece
                node[0] = i

    def merged(self, text: str) -> list[str]:
        """The segmentation by definition: the adjacent pair whose piece scores best is merged first, leftmost on a tie."""
        import heapq

        parts: list[str | None] = list(text)
        left, right = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        score = self.score
        heap = [(-score[p], i, p) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in score]
        heapq.heapify(heap)
        while heap:
            _, i, p = heapq.heappop(heap)
            j = right[i] if parts[i] is not None else len(parts)
            if j >= len(parts) or parts[i] + parts[j] != p:
                continue
            parts[i], parts[j] = p, None
            right[i] = right[j]
            if right[j] < len(parts):
                left[right[j]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b < len(parts) and (q := parts[a] + parts[b]) in score:
                    heapq.heappush(heap, (-score[q], a, q))
        return [p for p in parts if p is not None]

    def _adjacent(self, a: int, b: int) -> bool:
        """Whether the merges leave piece b beside piece a: none of them crosses the border."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        score, left = self.score, self.text[a]
        parts = list(left + self.text[b])
        border, best = len(left), [score.get(x + y) for x, y in zip(parts, parts[1:], strict=False)]
        ok = True
        while True:
            top, i = None, -1
            for k, x in enumerate(best):
                if x is not None and (top is None or x > top):
                    top, i = x, k
            if i < 0:
                break
            if i + 1 == border:
                ok = False
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del best[i]
            border -= i + 1 < border
            if i:
                best[i - 1] = score.get(parts[i - 1] + parts[i])
            if i < len(best):
                best[i] = score.get(parts[i] + parts[i + 1])
        ok = self.pairs[a << 24 | b] = ok and len(parts) == 2
        return ok

    def _single(self, c: str) -> int:
        """The number of a character that is no piece, beyond those of all pieces."""
        number = len(self.pieces) + ord(c)
        self.text[number] = c
        return number

    def _numbers(self, path: Sequence[int]) -> tuple[int, ...]:
        n = len(self.pieces)
        if max(path, default=0) < n:
            return tuple(path)
        out: list[int] = []
        for p in path:
            if p < n:
                out.append(p)
            else:
                c = chr(p - n)
                out.extend(self.bytes[x] for x in (MARK if c == " " else c).encode("utf-8", "surrogatepass"))
        return tuple(out)

    def walk(self, words: Sequence[str]) -> Iterator[tuple[str, tuple[int, ...]]]:
        """(word, ids) of sorted distinct words (without first marks): a depth-first walk of their trie that reuses forward cells.

        Besides its cell, each depth keeps the places where a piece may have
        begun, with the node of the pieces' own trie that it has come to.
        """
        root, pairs = self.trie, self.pairs
        last, begun = [-1], [0]  # the forward cells: last piece (-2: none) and where it begins
        open_: list[list[tuple[int, dict]]] = [[(0, root)]]
        before = ""
        for key in words:
            word = " " + key
            if len(word) > LONG:
                yield key, self._numbers(self.long_path(word))
                continue
            depth = 0
            for x, y in zip(before, word, strict=False):
                if x != y:
                    break
                depth += 1
            del last[depth + 1 :], begun[depth + 1 :], open_[depth + 1 :]
            for at in range(len(last) - 1, len(word)):
                c = word[at]
                cell = now = -2
                still = []
                for begin, node in open_[at]:
                    node = node.get(c)
                    if node is None:
                        continue
                    still.append((begin, node))
                    if cell == -2 and (piece := node.get(0)) is not None and (left := last[begin]) != -2:
                        if left == -1:
                            cell, now = piece, begin
                        else:
                            ok = pairs.get(left << 24 | piece)
                            if ok or ok is None and self._adjacent(left, piece):
                                cell, now = piece, begin
                if cell == -2 and c not in self.ids and (left := last[at]) != -2:
                    piece = self._single(c)
                    if left == -1 or self._adjacent(left, piece):
                        cell, now = piece, at
                still.append((at + 1, root))
                last.append(cell)
                begun.append(now)
                open_.append(still)
            before = word
            path, at = [], len(word)
            while at and last[at] != -2:
                path.append(last[at])
                at = begun[at]
            if at:
                path = [self.ids[p] if p in self.ids else self._single(p) for p in reversed(self.merged(word))]
            yield key, self._numbers(path[::-1])

    def long_path(self, word: str) -> Sequence[int]:
        """The last pieces of a word's best path, in order: the same forward cells, 12 bytes a character."""
        last, begun, open_ = array("i", [-1]), array("q", [0]), [(0, self.trie)]
        for at, c in enumerate(word):
            cell = now = -2
            still = []
            for begin, node in open_:
                node = node.get(c)
                if node is None:
                    continue
                still.append((begin, node))
                if cell == -2 and (piece := node.get(0)) is not None and (left := last[begin]) != -2 and (left == -1 or self._beside(left, piece)):
                    cell, now = piece, begin
            if cell == -2 and c not in self.ids and (left := last[at]) != -2:
                piece = self._single(c)
                if left == -1 or self._beside(left, piece):
                    cell, now = piece, at
            still.append((at + 1, self.trie))
            last.append(cell)
            begun.append(now)
            open_ = still
        path, at = array("i"), len(word)
        while at and last[at] != -2:
            path.append(last[at])
            at = begun[at]
        if at:
            return [self.ids[p] if p in self.ids else self._single(p) for p in self.merged(word)]
        path.reverse()
        return path

    def _beside(self, a: int, b: int) -> bool:
        ok = self.pairs.get(a << 24 | b)
        return self._adjacent(a, b) if ok is None else ok

    def words(self, text: str) -> list[str]:
        """The marked words of a text, each without its first mark; an empty text has none."""
        if not text:
            return []
        if MARK in text:
            text = text.replace(MARK, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            return [w[1:] for w in _WORD.findall(" " + text)]
        return text.split(" ")

    def forget(self) -> None:
        """Drop the remembered words (what may stand side by side is kept)."""
        self.known = {}
        self.row, self.rows_at = array("i"), array("q", [0])

    def encode_flat(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, without begin and end pieces, and n + 1 offsets."""
        split = [self.words(t) for t in texts]
        new = set().union(*split).difference(self.known)
        if len(self.known) + len(new) > WORDS:
            self.forget()
            new = set().union(*split)
        known, row, rows_at = self.known, self.row, self.rows_at
        for word, ids in self.walk(sorted(new)):
            known[word] = len(rows_at) - 1
            row.extend(ids)
            rows_at.append(len(row))
        rows, at = np.array(row, np.int32), np.array(rows_at)
        k = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.int64)
        lens = np.diff(at)[k]
        flat = rows[ramp(at[k], lens)]
        ends = np.concatenate([[0], np.cumsum(lens)])[np.concatenate([[0], np.cumsum([len(ws) for ws in split])]).astype(np.int64)]
        for w in new:
            if len(w) > REMEMBERED:
                del known[w]
        return flat, ends

    def encode_all(self, texts: Sequence[str]) -> list[np.ndarray]:
        """The ids of each text."""
        flat, ends = self.encode_flat(texts)
        return [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def decode_all(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts of lists of ids, ``ids[offsets[k] : offsets[k + 1]]``; the same as ``decode`` of each."""
        lens = self.size[ids]
        data = self.flat[ramp(self.begin[ids], lens)].tobytes()
        ends = np.concatenate([[0], np.cumsum(lens)])[offsets].tolist()
        out = []
        for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
            if b > a and self.marked[ids[offsets[k]]]:
                a += 1
            try:
                out.append(data[a:b].decode())
            except UnicodeDecodeError:
                out.append(self.decode(ids[offsets[k] : offsets[k + 1]].tolist()))
        return out

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ids: marks become spaces, but for one at the start; runs of byte pieces are read as UTF-8.

        A byte that is no part of valid UTF-8 becomes U+FFFD; control pieces are silent.
        """
        out: list[str] = []
        run = bytearray()
        for i in ids:
            if self.is_byte[i]:
                run.append(int(self.pieces[i][3:5], 16))
                continue
            if run:
                out.append(_utf8(bytes(run)))
                run.clear()
            if i == self.unknown:
                out.append(UNKNOWN)
            elif i not in self.silent:
                out.append((self.pieces[i] if out else self.pieces[i].removeprefix(MARK)).replace(MARK, " "))
        if run:
            out.append(_utf8(bytes(run)))
        return "".join(out)


def _utf8(b: bytes) -> str:
    try:
        return b.decode()
    except UnicodeDecodeError:
        pass
    out, k = [], 0
    while k < len(b):
        for n in (1, 2, 3, 4):
            try:
                out.append(b[k : k + n].decode())
                k += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            k += 1
    return "".join(out)


_MODELS: dict[int, PieceModel] = {}


def loaded(blob: bytes) -> PieceModel:
    """The worker's model for a file's content."""
    if (key := hash(blob)) not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = PieceModel(blob)
    return _MODELS[key]


def _parts(texts: Sequence[str | None]) -> Iterator[tuple[int, list[str]]]:
    part: list[str] = []
    held = at = 0
    for k, t in enumerate(texts):
        part.append(t or "")
        held += len(part[-1])
        if held >= SLICE_CHARS:
            yield at, part
            part, held, at = [], 0, k + 1
    if part:
        yield at, part


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text, ids): the pieces of every whole text by the model file at ``model_path`` (read on the driver).

    A null or empty text has no pieces. Repeated rows stay; other columns are ignored.
    """
    with open(model_path, "rb") as f:
        blob = docs.sparkSession.sparkContext.broadcast(f.read())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(blob.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for at, part in _parts(texts):
                flat, offs = model.encode_flat(part)
                lists = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(flat))
                yield pa.record_batch([*(batch.column(k).slice(at, len(part)) for k in (0, 1)), lists], ["doc_id", "text", "ids"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), scan, "doc_id long, text string, ids array<int>")


def decode(rows: DataFrame, model_path: str) -> DataFrame:
    """``rows`` (doc_id, text, ids) with ``decoded``, the text of the ids (null ids: empty)."""
    with open(model_path, "rb") as f:
        blob = rows.sparkSession.sparkContext.broadcast(f.read())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(blob.value)
        for batch in batches:
            lists = batch.column(2)
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            lens = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            texts = model.decode_all(ids, np.concatenate([[0], np.cumsum(lens)]).astype(np.int64))
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], ["doc_id", "text", "ids", "decoded"])

    return map_arrow(rows.select("doc_id", "text", "ids"), scan, "doc_id long, text string, ids array<int>, decoded string")


def coded(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids, exact): pieces, and whether these decode to the text again, in one pass.

    A null text has no pieces and comes back as empty, which counts as exact.
    """
    with open(model_path, "rb") as f:
        blob = docs.sparkSession.sparkContext.broadcast(f.read())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(blob.value)
        for batch in batches:
            for at, part in _parts(batch.column(1).to_pylist()):
                flat, offs = model.encode_flat(part)
                exact = [a == b for a, b in zip(model.decode_all(flat, offs), part, strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(flat))
                yield pa.record_batch([batch.column(0).slice(at, len(part)), lists, pa.array(exact, pa.bool_())], ["doc_id", "ids", "exact"])
        model.forget()  # an idle worker holds the model, but no words

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), scan, "doc_id long, ids array<int>, exact boolean")


def round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_pieces, ids_sha256, exact) of every row; the digest is of the ids, comma-joined."""
    rows = coded(docs, model_path)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), "exact")
