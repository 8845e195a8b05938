"""Encoding Arrow text columns with a tokenizers file, each distinct piece once.

Encoding whole texts spends most of its time on words it has seen before. Texts
are cut into pieces at places where the tokenizer itself always cuts, so the ids
of the pieces one after another are the ids of the whole. The pieces of a slice
of rows are found and hashed on bytes, each distinct one is looked up in a
bounded cache or encoded by the library, and the ids are gathered by index.

A cut is made, with ASCII letter or letter of U+00C0-U+00FF called a letter,

* before a space or a line end that follows a printable ASCII character or a
  letter: byte-level rules let white space lead the next piece and never take it
  into one that has begun; rules that drop white space part there as well;
* between a letter and ASCII punctuation other than ``'``, ``<``, ``>`` and ``|``: a run of
  letters ends there in either rule set.

Everything else stays in one piece, so longer white space, apostrophes, other
scripts and strings of special tokens (made of ``<``, ``|``, letters and ``>``) are seen
whole by the library. A piece that is one word of known letters goes straight to the
library's model, since the rules before it would leave it as it is. Special strings are matched before lower-casing, so pieces that
hold ``<`` or ``|`` are never folded. Pieces are told apart by 64-bit hashes.

Cuts and folding are proven for two rule sets, which are read from the tokenizer's
file: byte-level rules without a normalizer, and rules that compose, lower-case and
keep runs of letters, single digits and runs of other signs. With any other file every text is one piece.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidefold.llm import bytewords as bw

LIMIT = 600_000
SLICE = 2 << 20
MISSES = 4_096
LONG = 4 << 20

_byte = np.arange(256)
_SPACE = (_byte == 0x20) | (_byte == 0x0A)
_LETTER = ((_byte >= 0x41) & (_byte <= 0x5A)) | ((_byte >= 0x61) & (_byte <= 0x7A))
_PRINTABLE = (_byte >= 0x21) & (_byte <= 0x7E)
_PUNCTUATION = _PRINTABLE & ~_LETTER & ~((_byte >= 0x30) & (_byte <= 0x39)) & ~np.isin(_byte, list(b"'<>|"))
# Second bytes of U+00C0-U+00FF without the signs of multiplication and division.
_SECOND = (_byte >= 0x80) & (_byte <= 0xBF) & (_byte != 0x97) & (_byte != 0xB7)
_LOWER_SECOND = _SECOND & (_byte >= 0x9F)
# Byte-level models spell a byte by the character of its number where that is printable, other bytes by those from 256 on.
_plain = ((_byte >= 0x21) & (_byte <= 0x7E)) | ((_byte >= 0xA1) & (_byte != 0xAD))
_SPELLED = np.where(_plain, _byte, 255 + np.cumsum(~_plain)).astype("<u2")
_SPECIAL = np.isin(_byte, list(b"<|"))
_FOLDED = np.where(_byte == 0x0A, 0x20, bw.FOLD).astype(np.uint8)

_safe_cut = re.compile(r"(?<=[A-Za-z]) ")
_marked = re.compile(r"<\|[a-z]+\|>")
# Fixed value: the pattern of the rules that keep words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_loaded: dict = {}


def load(path: str):
    """The tokenizer, once per Python process, with its own default handling of special strings."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_padding()
        tokenizer.no_truncation()
        _loaded[path] = tokenizer
    return _loaded[path]


def cut(raw: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Where pieces begin; ``rows`` are the places where rows begin."""
    begins = np.zeros(len(raw) + 1, bool)
    if len(raw) > 1:
        letter = _LETTER[raw[:-1]]
        letter[1:] |= _SECOND[raw[1:-1]] & (raw[:-2] == 0xC3)
        after = raw[1:]
        begins[1:-1] = (_SPACE[after] & (letter | _PRINTABLE[raw[:-1]])) | (letter & _PUNCTUATION[after])
    begins[rows] = True
    return np.flatnonzero(begins[:-1])


def rules(path: str) -> str | None:
    """Which of the known rule sets the tokenizer's file holds."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    before, cutter = found.get("normalizer"), found.get("pre_tokenizer") or {}
    if any(x["content"] != x["content"].lower() or not _marked.fullmatch(x["content"]) or x["lstrip"] or x["rstrip"] for x in found["added_tokens"]):
        return None
    if before is None and cutter.get("type") == "ByteLevel" and cutter["use_regex"] and not cutter["add_prefix_space"]:
        return "bytes"
    steps = [x["type"] for x in (before or {}).get("normalizers", ())]
    first = (cutter.get("pretokenizers") or [{}])[0]
    if steps == ["NFC", "Replace", "Lowercase"] and first.get("type") == "Split" and first["behavior"] == "Removed" and first["invert"]:
        return "words" if first["pattern"].get("Regex") == WORDS else None
    return None


class Pieces:
    """Known pieces, sorted by hash: where their ids are in ``flat``, how many, and when they were last asked for."""

    def __init__(self, keys, begin, size, used, flat):
        self.keys, self.begin, self.size, self.used, self.flat = keys, begin, size, used, flat

    @classmethod
    def none(cls, kind):
        return cls(np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, kind))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[place] == keys, place, -1)

    def merged(self, keys, begin, size, used, flat, limit: int) -> "Pieces":
        """These and others whose ids are in ``flat``; beyond ``limit`` what was not asked for lately is forgotten."""
        keys, used = np.concatenate([self.keys, keys]), np.concatenate([self.used, used])
        begin, size = np.concatenate([self.begin, begin + len(self.flat)]), np.concatenate([self.size, size])
        flat = np.concatenate([self.flat, flat])
        order = np.argsort(keys, kind="stable")
        if len(keys) > limit:
            middle = np.partition(used, len(used) // 2)[len(used) // 2]
            order = order[used[order] > middle] if used.max() > middle else order[: limit // 2]
        begin, size = begin[order], size[order]
        stop = np.cumsum(size)
        ids = flat[np.repeat(begin - stop + size, size) + np.arange(stop[-1] if len(stop) else 0)]
        return Pieces(keys[order], stop - size, size, used[order], ids)


class Encoder:
    """Ids of texts. Where the tokenizer lower-cases and drops white space, A-Z and line ends are folded and a leading blank is left out."""

    def __init__(self, path: str):
        self.tokenizer, self.rules = load(path), rules(path)
        self.folds = self.rules == "words"
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.turn = 0
        # New pieces wait in a small table, so that the large one is seldom written anew.
        self.known, self.recent = Pieces.none(self.kind), Pieces.none(self.kind)

    def _one_word(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which pieces are one word of known letters: the rules hand it as it is to the tokenizer's model."""
        second = _LOWER_SECOND if self.folds else _SECOND
        lead = data == 0xC3
        strange = ~(_LETTER[data] | lead)
        strange[1:] &= ~(lead[:-1] & second[data[1:]])
        strange[1:] |= lead[:-1] & ~second[data[1:]]
        strange = np.concatenate([[0], np.cumsum(strange)])
        first = start + (data[start] == 0x20) if len(start) and not self.folds else start
        return (strange[end] == strange[first]) & (end > first)

    def _encoded(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the pieces one after another, ids of each)."""
        if not len(start):
            return np.zeros(0, self.kind), np.zeros(0, np.int64)
        size = end - start
        stop = np.cumsum(size)
        data = data[np.repeat(start - stop + size, size) + np.arange(stop[-1])]
        start, end = stop - size, stop
        body = data.tobytes()
        found: list = [None] * len(start)
        if self.rules:
            # One character a byte, as byte-level models spell them.
            spelled, model = _SPELLED[data].tobytes().decode("utf-16-le"), self.tokenizer.model
            word = self._one_word(data, start, end)
            for k, a, b in zip(np.flatnonzero(word).tolist(), start[word].tolist(), end[word].tolist()):
                found[k] = [x.id for x in model.tokenize(spelled[a:b])]
            others = np.flatnonzero(~word)
        else:
            others = np.arange(len(start))
        for at in range(0, len(others), MISSES):
            part = others[at : at + MISSES]
            texts = [body[a:b].decode() for a, b in zip(start[part].tolist(), end[part].tolist())]
            for k, x in zip(part.tolist(), self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                found[k] = x.ids
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), self.kind, int(sizes.sum())), sizes

    def _values(self, keys: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each distinct piece's ids begin, how many)."""
        self.turn += 1
        begin, size, missing, before = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64), np.ones(len(keys), bool), 0
        for part in (self.known, self.recent):
            place = part.find(keys)
            hit = place >= 0
            begin[hit], size[hit] = before + part.begin[place[hit]], part.size[place[hit]]
            part.used[place[hit]] = self.turn
            missing &= ~hit
            before += len(part.flat)
        new = np.flatnonzero(missing)
        ids, size[new] = self._encoded(data, start[new], end[new])
        own = np.cumsum(size[new]) - size[new]
        begin[new] = before + own
        flat = np.concatenate([self.known.flat, self.recent.flat, ids])
        short = (end - start)[new] <= 64
        stamp = np.full(int(short.sum()), self.turn)
        self.recent = self.recent.merged(keys[new][short], own[short], size[new][short], stamp, ids, LIMIT)
        if len(self.recent.keys) > LIMIT // 8:
            r = self.recent
            self.known, self.recent = self.known.merged(r.keys, r.begin, r.size, r.used, r.flat, LIMIT), Pieces.none(self.kind)
        return flat, begin, size

    def rows(self, texts: pa.Array):
        """(first row, ids, offsets) of consecutive slices of rows; NULL is the empty text."""
        for a, b in bw.slices(texts, SLICE):
            part = pc.fill_null(texts.slice(a, b - a), "").cast(pa.large_string())
            if self.rules and b - a == 1 and len(part[0].as_buffer() or b"") > LONG:
                yield a, *self._long(part[0].as_py())
            else:
                yield a, *self._slice(part)

    def _long(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """A very long text in parts that end at cuts."""
        at, ids = 0, []
        while at < len(text):
            stop = _safe_cut.search(text, at + LONG)
            to = stop.start() if stop else len(text)
            ids.append(self._slice(pa.array([text[at:to]], pa.large_string()))[0])
            at = to
        flat = np.concatenate(ids)
        return flat, np.asarray([0, len(flat)])

    def _folded(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """``raw`` with its pieces folded, but for those in which a special string may stand."""
        data = _FOLDED[raw]
        special = np.flatnonzero(_SPECIAL[raw])
        if len(special):
            whole = np.zeros(len(start), bool)
            whole[np.searchsorted(start, special, "right") - 1] = True
            np.copyto(data, raw, where=np.repeat(whole, end - start))
        return data

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]] if bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
        bounds = bounds - bounds[0]
        start = cut(raw, bounds[:-1]) if self.rules else np.unique(bounds[:-1][np.diff(bounds) > 0])
        if not len(start):
            return np.zeros(0, self.kind), np.zeros(len(texts) + 1, np.int64)
        end = np.append(start[1:], len(raw))
        data = self._folded(raw, start, end) if self.folds else raw
        # White space parts pieces and is dropped: a word is the same piece with and without a blank before it.
        inner = start + ((data[start] == 0x20) & (end - start > 1)) if self.folds else start
        keys, first, which = np.unique(bw.keys_of(data, inner, end), return_index=True, return_inverse=True)
        flat, begin, size = self._values(keys, data, inner[first], end[first])
        each = size[which]
        stop = np.concatenate([[0], np.cumsum(each)])
        ids = flat[np.repeat(begin[which] - stop[:-1], each) + np.arange(stop[-1])]
        return ids, stop[np.searchsorted(start, bounds)]


_encoders: dict = {}


def encoder(path: str) -> Encoder:
    """One encoder per process, kept between tasks of a reused worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
