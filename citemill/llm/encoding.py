"""Encoding by the tokenizers library, with each distinct pre-token encoded once per worker.

Pre-tokens are encoded independently of each other by the models read here, so the ids of a text are the ids of its
pre-tokens in order. Where all characters lie in a range in which the tokenizer's split pattern is known here, texts are cut
into pre-tokens by the classes of their characters, many texts at once. Any other text, texts that hold the content of an added
token, texts with very long pre-tokens, and any tokenizer of another make-up go to the library whole; so ids are the library's
for every text.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa

# The split patterns of the two tokenizer makes.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Outside it, a text goes to the library whole.
UNSURE = re.compile("[^\x00-\x1b\x20-\x84\x86-\x9f\xa1-įı-ɏ]")
LAST = 0x24F
#: A character that no sure text has; it keeps texts and words apart.
APART = "\x1f"
#: Distinct pieces that a worker remembers (beyond it starts anew), and bytes of the longest.
REMEMBERED = 400_000
LONGEST = 256
SPACE, LETTER, DIGIT, OTHER, BETWEEN = range(5)
#: What may follow an apostrophe as one pre-token with it.
CONTRACTED = (b"s", b"t", b"m", b"d", b"re", b"ve", b"ll")
#: Bytes of text that are cut at once.
PART = 4_000_000


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies; APART becomes a space."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in shown}
    out |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in out)}
    return out | {ord(APART): " "}


class Codes(dict):
    """Piece to number; unseen pieces get the next number and wait in fresh."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        self.fresh.append(piece)
        return n

    def taken(self) -> list[str]:
        out, self.fresh = self.fresh, []
        return out


class Runs:
    """Arrays of numbers, one after the other, that grow at the end; room doubles."""

    def __init__(self) -> None:
        self._flat, self._ends, self.n = np.empty(1024, np.uint32), np.zeros(1024, np.int64), 0

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        held, m = int(self._ends[self.n]), len(sizes)
        while len(self._flat) < held + len(flat):
            self._flat = np.concatenate([self._flat, np.empty_like(self._flat)])
        while len(self._ends) < self.n + m + 1:
            self._ends = np.concatenate([self._ends, np.empty_like(self._ends)])
        self._flat[held : held + len(flat)] = flat
        self._ends[self.n + 1 : self.n + m + 1] = held + np.cumsum(sizes, dtype=np.int64)
        self.n += m

    def of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs with these numbers, joined, and the bounds of each."""
        first = self._ends[codes]
        size = self._ends[codes + 1] - first
        ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        return self._flat[np.repeat(first - ends[:-1], size) + np.arange(ends[-1])], ends


@cache
def _classes() -> np.ndarray:
    """Class of each character up to LAST."""
    out = np.full(LAST + 1, OTHER, np.uint8)
    for c in range(LAST + 1):
        x = chr(c)
        out[c] = LETTER if x.isalpha() else DIGIT if unicodedata.category(x)[0] == "N" else SPACE if x.isspace() else OTHER
    out[ord(APART)] = BETWEEN
    return out


def pre_token_starts(data: np.ndarray, kind: str) -> np.ndarray:
    """The first byte of each pre-token of texts in UTF-8, every text followed by APART, which counts as one. With words,
    white space is a piece of its own; with bytes, a space goes with what follows it."""
    of = _classes()
    cls = of[np.minimum(data, 127)]
    lead = np.flatnonzero(data >= 0xC0)
    cls[lead] = cls[lead + 1] = of[np.minimum((data[lead].astype(np.int64) & 31) << 6 | data[lead + 1] & 63, LAST)]
    new = np.ones(len(data), bool)
    new[1:] = (cls[1:] != cls[:-1]) | (cls[1:] == BETWEEN)
    if kind == "byte":
        solid = (cls != SPACE) & (cls != BETWEEN)
        new[:-1] |= (cls[:-1] == SPACE) & solid[1:]  # the last of a run of white space stands alone or goes with what follows
        new[1:] &= ~((data[:-1] == 32) & solid[1:])
    else:
        new |= cls == DIGIT
        new[lead + 1] = False
    marks = np.flatnonzero(new & (data == 39))
    for end in CONTRACTED:
        own = marks[marks + len(end) + 1 < len(data)]
        for i, byte in enumerate(end, 1):
            own = own[data[own + i] == byte]
        new[own + 1] = False
        new[own + len(end) + 1] = True
    return np.flatnonzero(new)


def distinct(data: np.ndarray, at: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The distinct pieces of data (UTF-8) that begin at these bytes, and all pieces in order as places among them."""
    edges = np.append(at, len(data)).astype(np.int64)
    held = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(edges), pa.py_buffer(data)).dictionary_encode()
    return held.dictionary.to_pylist(), np.asarray(held.indices)


def parts(sizes: list[int], limit: int) -> list[tuple[int, int]]:
    """Bounds of consecutive groups of about limit, one at least in each."""
    out, a, held = [], 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            out.append((a, i))
            a, held = i, 0
        held += n
    return [*out, (a, len(sizes))] if a < len(sizes) else out


class Encoder:
    """Distinct pieces are remembered with their ids."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.kind = self._kind(made)
        self.added = [x["content"] for x in made.get("added_tokens", [])]
        self.words_alone = self.tokenizer
        if self.kind:  # the same model over words that are cut and mapped already
            self.words_alone = Tokenizer.from_str(json.dumps(made | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "added_tokens": []}))
        self.shown = byte_characters()
        self._reset()

    def _reset(self) -> None:
        self.codes, self.runs = Codes(), Runs()

    @staticmethod
    def _kind(made: dict) -> str | None:
        norm, pre, model = made.get("normalizer"), made.get("pre_tokenizer") or {}, made.get("model", {})
        if model.get("type") != "BPE" or model.get("dropout"):
            return None
        if not norm and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            return "byte"
        steps = [x.get("type") for x in (norm or {}).get("normalizers", [])]
        parts = pre.get("pretokenizers", [])
        if steps == ["NFC", "Replace", "Lowercase"] and len(parts) == 2 and parts[0].get("pattern") == {"Regex": WORD_PATTERN} and parts[0].get("invert") and not parts[1].get("add_prefix_space"):
            return "word"
        return None

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _unsure(self, text: str, low: str) -> bool:
        return self.kind is None or bool(UNSURE.search(text)) or any(x in text or x in low for x in self.added)

    def _learn(self) -> None:
        fresh = self.codes.taken()
        for i in range(0, len(fresh), 8192):
            some = fresh[i : i + 8192]
            real = [w for w in some if w != APART and not (self.kind == "word" and w.isspace())]
            groups = [real[j : j + 256] for j in range(0, len(real), 256)]
            shown = [APART.join(g).encode().decode("latin-1").translate(self.shown) for g in groups]
            flats, sizes = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
            for group, e in zip(groups, self.words_alone.encode_batch(shown, add_special_tokens=False), strict=True):
                flats.append(np.array(e.ids, np.uint32))
                sizes.append(np.bincount(np.array(e.word_ids, np.int64), minlength=len(group)))
            size = np.concatenate(sizes)
            if len(real) < len(some):
                held = np.zeros(len(some), np.int64)
                held[[w != APART and not (self.kind == "word" and w.isspace()) for w in some]] = size
                size = held
            self.runs.add(np.concatenate(flats), size)

    def encode(self, texts: list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and len(texts) + 1 bounds; end: an id put after each text."""
        flats, sizes = [np.empty(0, np.uint32)], [np.zeros(1, np.int64)]
        for a, z in parts([len(t) for t in texts], PART):
            ids, bounds = self._part(texts[a:z], end)
            flats.append(ids)
            sizes.append(np.diff(bounds))
        return np.concatenate(flats), np.cumsum(np.concatenate(sizes))

    def _part(self, texts: list[str], end: int | None) -> tuple[np.ndarray, np.ndarray]:
        if len(self.codes) > REMEMBERED:
            self._reset()
        own = texts if self.kind != "word" else [t.lower() for t in texts]
        odd = {i for i, (t, low) in enumerate(zip(texts, own, strict=True)) if self._unsure(t, low)}
        data, at = self._starts(own, odd)
        if (long := at[:-1][np.diff(at) > LONGEST]).size:
            ends = np.flatnonzero(data == ord(APART))
            odd |= set(np.searchsorted(ends, long).tolist())
            data, at = self._starts(own, odd)
        pieces, codes = distinct(data, at)
        numbers = np.fromiter(map(self.codes.__getitem__, pieces), np.int64, len(pieces))
        self._learn()
        ids, ends = self.runs.of(numbers[codes])
        bounds = np.concatenate([[0], ends[np.flatnonzero(data[at] == ord(APART))]])
        if odd:
            spare = dict(zip(sorted(odd), self._whole([texts[i] for i in sorted(odd)]), strict=True))
            runs = [spare[i] if i in spare else ids[a:z] for i, (a, z) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))]
            ids, bounds = np.concatenate(runs), np.concatenate([[0], np.cumsum([len(x) for x in runs])])
        if end is not None:
            ids, bounds = np.insert(ids, bounds[1:], np.uint32(end)), bounds + np.arange(len(bounds))
        return ids, bounds

    def _starts(self, texts: list[str], without: set[int]) -> tuple[np.ndarray, np.ndarray]:
        held = [t + APART if i not in without else APART for i, t in enumerate(texts)]
        data = np.frombuffer("".join(held).encode(), np.uint8)
        return data, pre_token_starts(data, self.kind or "byte")


_LOADED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process and file."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]
