"""SentencePiece encoding and decoding by a forward pass that words with common prefixes share.

Distinct marked words (a run of marks and what follows it, cut again between characters that stand side by side in no piece)
are sorted; going through them in that order is a depth-first traversal of their trie, so the forward states of the prefix that
a word shares with the one before are kept, and only the rest is computed.

With a unigram model a prefix's state is its best score and last piece (Viterbi). With a BPE model scores are merge ranks, and
their best sum isn't what the model's merges give. There, a prefix's state is its only surviving path: the last piece of the
prefix's own encoding, that is the piece that ends there, starts where another state ends, and stands unmerged beside that
state's piece. Two pieces stand unmerged if merging their joined characters gives just these two; that is remembered per pair.

Normalisation by the identity only (as in the models read here); marks are U+2581; characters outside the vocabulary fall back
to bytes, or to the unknown id. Decoding joins pieces, turns marks to spaces and drops the space put before a text.

Defined results: a null or empty text has no ids; repeated rows get equal results; a mark in a text decodes as a space, as in
the library; other columns are ignored, whatever their names. Everything is local to a row; a worker remembers a bounded number
of words.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, gathered, session, sliced, text_or_empty
from .encoding import APART, PART, REMEMBERED, Codes, Runs, distinct, parts
from .packing import tokenizer_path

MARK = "▁"
# Kinds of model and of piece in the model format.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0
REPLACED = " ⁇ "
#: Pairs of pieces whose compatibility a worker remembers.
PAIRS = 500_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte, at = data[at], at + 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[at : at + n]
            at += n


class Pieces:
    """A model: its pieces, scores and kinds, and encoding and decoding by them."""

    def __init__(self, pieces: list[tuple[str, float, int]], model: int, dummy_prefix: bool = True) -> None:
        self.names, self.model, self.dummy = [p[0] for p in pieces], model, dummy_prefix
        self.id_of = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER_DEFINED)}
        self.score = [s for _, s, _ in pieces]
        self.bytes = {int(p[1:-1], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        self.low = min((self.score[i] for i in self.id_of.values()), default=0.0) - UNKNOWN_PENALTY
        self.trie: dict = {}  # character to node; the piece that ends in a node stands under the empty string
        self.joined = np.zeros((128, 128), bool)  # ASCII characters side by side in a piece, the mark being a space
        for p in self.id_of:
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = p
            codes = [ord(c) for c in p.replace(MARK, " ")]
            for x, y in zip(codes, codes[1:], strict=False):
                if x < 128 and y < 128:
                    self.joined[x, y] = True
        self.marks_lead = not any(MARK in p.lstrip(MARK) for p in self.id_of)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.lone: dict[str, bool] = {}
        raw = [self._raw(p, s, k) for p, s, k in pieces]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_at = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        self.codes, self.runs = Codes(), Runs()

    @classmethod
    def load(cls, path: str) -> Pieces:
        pieces, model, dummy = [], UNIGRAM, True
        with open(path, "rb") as f:
            data = f.read()
        for n, v in _fields(data):
            if n == 1:
                own = dict(_fields(v))
                pieces.append((own[1].decode(), struct.unpack("<f", own.get(2, b"\0\0\0\0"))[0], own.get(3, NORMAL)))
            elif n == 2:
                model = dict(_fields(v)).get(3, UNIGRAM)
            elif n == 3:
                spec = dict(_fields(v))
                dummy = bool(spec.get(3, 1))
                if spec.get(1, b"") != b"identity" or spec.get(4, 1):
                    raise ValueError("only models with identity normalisation that keep white space are supported")
        if model not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        return cls(pieces, model, dummy)

    @staticmethod
    def _raw(piece: str, _: float, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[1:-1], 16)])
        return {CONTROL: b"", UNKNOWN: REPLACED.encode()}.get(kind, piece.replace(MARK, " ").encode())

    # ---- encoding

    def merged(self, text: str) -> list[str]:
        """The text's pieces by the model's merges, the best score first, then from the left."""
        parts: list[str | None] = list(text)
        right = list(range(1, len(parts) + 1))
        left = list(range(-1, len(parts) - 1))

        def option(i: int):
            j = right[i]
            if j < len(parts) and (k := self.id_of.get(parts[i] + parts[j])) is not None:
                return (-self.score[k], i, parts[i], parts[j])
            return None

        queue = [o for i in range(len(parts) - 1) if (o := option(i))]
        heapify(queue)
        while queue:
            _, i, a, b = heappop(queue)
            j = right[i] if parts[i] is not None else len(parts)
            if j >= len(parts) or (parts[i], parts[j]) != (a, b):
                continue
            parts[i], parts[j], right[i] = a + b, None, right[j]
            if right[i] < len(parts):
                left[right[i]] = i
            for k in (left[i], i):
                if k >= 0 and (o := option(k)):
                    heappush(queue, o)
        return [p for p in parts if p is not None]

    def _apart(self, a: str, b: str) -> bool:
        if (got := self.pairs.get((a, b))) is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            got = self.pairs[a, b] = self.merged(a + b) == [a, b]
        return got

    def segments(self, words: list[str]) -> Iterator[tuple[str, list[str]]]:
        """(word, pieces) of sorted words. last[i] is the piece at the end of the path of the first i characters, None where no
        path ends; score[i] its score; begun[i] the pieces that may go on there (start, node of their trie), the longest first."""
        last: list[str | None] = [""]
        score, begun, before = [0.0], [[]], ""
        extend = self._best if self.model == UNIGRAM else self._survivor
        for word in words:
            shared = 0
            for x, y in zip(before, word, strict=False):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :], score[shared + 1 :], begun[shared + 1 :]
            for i in range(shared, len(word)):
                extend(word[i], i, last, score, begun)
            out, at = [], len(word)
            while at:
                out.append(last[at])
                at -= len(out[-1])
            yield word, out[::-1]
            before = word

    def _best(self, c: str, i: int, last: list, score: list, begun: list) -> None:
        found, top, still = None, 0.0, []
        for j, node in [*begun[i], (i, self.trie)]:
            if (node := node.get(c)) is not None:
                still.append((j, node))
                if (piece := node.get("")) is not None and last[j] is not None:
                    total = score[j] + self.score[self.id_of[piece]]
                    if found is None or total > top:
                        found, top = piece, total
        if c not in self.id_of and last[i] is not None and (found is None or score[i] + self.low > top):
            found, top = c, score[i] + self.low
        last.append(found)
        score.append(top)
        begun.append(still)

    def _survivor(self, c: str, i: int, last: list, score: list, begun: list) -> None:
        found, still = None, []
        for j, node in begun[i]:
            if (node := node.get(c)) is not None:
                still.append((j, node))
                if found is None and (piece := node.get("")) is not None and (end := last[j]) is not None:
                    if self._apart(end, piece) if j else self._lone(piece):
                        found = piece
        if (node := self.trie.get(c)) is not None:
            still.append((i, node))
        if found is None and (not i or last[i] is not None and self._apart(last[i], c)):
            found = c
        last.append(found)
        score.append(0.0)
        begun.append(still)

    def _lone(self, piece: str) -> bool:
        if (got := self.lone.get(piece)) is None:
            got = self.lone[piece] = self.merged(piece) == [piece]
        return got

    def _ids(self, pieces: list[str]) -> list[int]:
        out = []
        for p in pieces:
            if (k := self.id_of.get(p)) is not None:
                out.append(k)
            elif self.bytes:
                out += [self.bytes[b] for b in p.encode("utf-8", "replace")]
            else:
                out.append(self.unknown)
        return out

    def marked(self, text: str) -> list[str]:
        """The words of a text, which no piece crosses."""
        if not text:
            return []
        first, *rest = ((MARK if self.dummy else "") + text.replace(" ", MARK)).split(MARK)
        out, marks = ([first] if first else []), 0
        for x in rest:
            marks += 1
            if x:
                out.append(MARK * marks + x)
                marks = 0
        return out + [MARK * marks] * (marks > 0)

    def _cut(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct words of texts without marks or APART, the words in order as places among them, len(texts) + 1 bounds."""
        lead = " " if self.dummy else ""
        data = np.frombuffer("".join([lead + t + APART if t else APART for t in texts]).encode(), np.uint8)
        end = data == ord(APART)
        new = end.copy()
        new[:1] = True
        new[1:] |= end[:-1]
        plain = data < 128
        new[1:] |= plain[1:] & plain[:-1] & ~self.joined[data[:-1] & 127, data[1:] & 127]
        if self.marks_lead:
            new[1:] |= (data[1:] == 32) & (data[:-1] != 32)
        at = np.flatnonzero(new)
        words, codes = distinct(data, at)
        own = ~end[at]
        return [w.replace(" ", MARK) if w != APART else "" for w in words], codes[own], np.concatenate([[0], np.cumsum(own)[~own] if len(at) else []]).astype(np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and len(texts) + 1 bounds."""
        flats, sizes = [np.empty(0, np.uint32)], [np.zeros(1, np.int64)]
        for a, z in parts([len(t) for t in texts], PART):
            ids, bounds = self._part(texts[a:z])
            flats.append(ids)
            sizes.append(np.diff(bounds))
        return np.concatenate(flats), np.cumsum(np.concatenate(sizes))

    def _part(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.codes) > REMEMBERED:
            self.codes, self.runs = Codes(), Runs()
        odd = {i: self.marked(t) for i, t in enumerate(texts) if APART in t or MARK in t}
        words, places, bounds = self._cut(["" if i in odd else t for i, t in enumerate(texts)])
        number = self.codes.__getitem__
        codes = np.fromiter(map(number, words), np.int64, len(words))[places]
        if odd:
            runs = [np.array([number(w) for w in odd[i]] if i in odd else codes[a:z], np.int64) for i, (a, z) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))]
            codes, bounds = np.concatenate(runs), np.concatenate([[0], np.cumsum([len(x) for x in runs])])
        if fresh := self.codes.taken():
            ids = {w: self._ids(p) for w, p in self.segments(sorted(fresh))}
            own = [ids[w] for w in fresh]
            self.runs.add(np.fromiter((i for x in own for i in x), np.uint32), np.fromiter(map(len, own), np.int64))
        flat, ends = self.runs.of(codes)
        return flat, ends[bounds]

    # ---- decoding

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The texts of ids between bounds."""
        ids = ids.astype(np.int64)
        first, size = self.raw_at[:-1][ids], np.diff(self.raw_at)[ids]
        ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        data = self.raw[np.repeat(first - ends[:-1], size) + np.arange(ends[-1])].tobytes()
        cuts = ends[bounds].tolist()
        out = []
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            text = data[a:z].decode("utf-8", "replace")
            out.append(text[1:] if self.dummy and text.startswith(" ") else text)
        return out


_LOADED: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """One per worker process and file."""
    if path not in _LOADED:
        _LOADED[path] = Pieces.load(path)
    return _LOADED[path]


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids."""
    session(df.sparkSession)
    schema = pa.schema([("key", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches):
            flat, bounds = pieces(path).encode(b.column(1).to_pylist())
            ids = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat.astype(np.int32)))
            yield from sliced(pa.RecordBatch.from_arrays([b.column(0), ids.cast(schema.field("ids").type)], schema=schema))

    return df.select(F.col(key).cast("long").alias("key"), text_or_empty(text).alias("t")).mapInArrow(run, "key long, ids array<int>").withColumnRenamed("key", key)


def decode(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key, text, n_ids, ids_crc32 (of little-endian unsigned 32-bit ids); null ids: the empty text."""
    session(df.sparkSession)
    schema = pa.schema([("key", pa.int64()), ("text", pa.string()), ("n_ids", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            flat, bounds = np.asarray(lists.flatten()), np.asarray(lists.offsets).astype(np.int64)
            bounds = bounds - bounds[0]
            texts = pieces(path).decode(flat, bounds)
            raw = flat.astype("<u4")
            sums = [zlib.crc32(raw[a:z].tobytes()) for a, z in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(np.diff(bounds)), pa.array(sums, pa.int64())], schema=schema)

    source = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("ids"))
    return source.mapInArrow(run, "key long, text string, n_ids long, ids_crc32 long").withColumnRenamed("key", key)


def op10_shared_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("piece_bpe_32k.model")
    rows = decode(encode(documents(spark, sf_dir, "doc_id", "text"), path), path)
    return rows.select("doc_id", "n_ids", "ids_crc32", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))
