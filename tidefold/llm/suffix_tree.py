"""Language-model scores of texts by a probabilistic suffix tree over words.

Tokens are the lower-cased (A-Z) runs of characters that are no ASCII white
space, then one end token a text. The root predicts every token from its count.
Deeper states are the contexts of up to ``DEPTH`` words that occur at least
``STATE`` times in training; a state lists the next tokens that follow it at least
``NEXT`` times. Both are plain counts, so the tree grows with the corpus, and a
passage that occurs often enough is learnt in a corpus of any size. A state is
retained if its distribution diverges from that of its longest retained suffix
by ``DIVERGENCE`` nats or more. With ``c`` its count, ``k(x)`` its listed counts and
``K`` their sum it predicts

    P(x) = (k(x) + (c - K + SMOOTH) * P'(x)) / (c + SMOOTH)

where ``P'`` is the prediction of that suffix, so every state sums to one. A token
is scored by its longest retained suffix.

The tree is never gathered. Each input partition is cut into batches of about ``BATCH_BYTES``,
written once as numbers of the batch's own sorted words, in a table bucketed by
batch. Depth by depth each batch asks for the word sequences it holds: it sends every distinct sequence once, with its own
training count; counts are added up by sequence, and what is listed goes back to the batches that asked.
The first of these then works out the prediction of the shorter suffix from the answers it has (arrays
in a few rows, in tables bucketed by batch, too). It sends each context's share of the divergence; shares are added up by
state, and what is retained goes back as well. Sequences and contexts travel as sorted arrays, one for each batch and
range of the hash space, never as rows. A sequence is
asked for only if all of it but the last word is frequent enough to be a state.
Most of these are still too rare to be listed. So before sequences are sent,
the batches count shorter hashes of them in packed arrays, one for each range of the
hash space; whoever adds up a range tells every batch which of its hashes reach
``NEXT`` together. A hash is never rarer than a sequence that it stands for, so
nothing that could be listed is held back, and what is sent is counted exactly. At
the end each batch scores its own texts. A sequence has at most one row a batch,
so even the most frequent one is a small group.

NULL and empty texts are the end token alone. Rows of a NULL id are learnt from.
Repeated rows are learnt from and scored one by one, in whatever batches they fall.
Without training rows all counts are zero and the score is that of the root.
Words and sequences are told apart by 64-bit hashes.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidefold.llm import bytewords as bw
from tidefold.llm.common import give_back, in_fold, lean, table
from tidefold.llm.grouped import groups
from tidefold.session import shared_folder, spread_keys, store

DEPTH = 3
STATE, NEXT = 16, 4
DIVERGENCE = 0.01
SMOOTH = 20.0
BATCH_BYTES = 12 << 20
TOKENS = 1 << 18
# Bits of a cell beside those of its range: few sequences share one by chance.
CELL = 24
END = bw.mix(np.asarray([0x454E44], np.uint64))[0]

NUMBERED = "batch long, doc_id long, held_out boolean, ids binary, words binary, counts binary"
SENT = "range long, batch long, keys binary, n binary"
SHARES = "range long, batch long, keys binary, n binary, listed binary, gain binary, below binary"
PACKED = "range long, batch long, cells binary, counts binary"
ANSWERS = "batch long, depth int, is_state boolean, range long, keys binary, n binary, listed binary, cells binary"
SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(keys of all tokens with the end of each text, first token of each text)."""
    w = bw.split(texts, bw.SPACED)
    first = w.first + np.arange(len(w.first))
    out = np.full(first[-1], END, np.uint64)
    out[np.arange(len(w.key)) + w.row_of()] = w.key
    return out, first


def grams(keys: np.ndarray, length: int) -> np.ndarray:
    """For each token the hash of the ``length`` tokens that end with it; only right where they are in the same text."""
    if length == 1:
        return keys
    out = np.zeros(len(keys), np.uint64)
    if len(keys) >= length:
        out[length - 1 :] = bw.runs(keys, length)
    return out


def place_in_text(first: np.ndarray) -> np.ndarray:
    return np.arange(first[-1]) - np.repeat(first[:-1], np.diff(first))


class Places:
    """Where keys stand in a sorted table of ``width``-bit hashes: first bits lead to a few entries, which are tried in turn."""

    def __init__(self, table: np.ndarray, width: int = 64):
        self.table = table if len(table) else np.zeros(1, np.uint64)
        bits = min(width, max(1, len(table).bit_length()))
        self.shift = np.uint64(width - bits)
        self.starts = np.searchsorted(table >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key in the table, or -1."""
        slot = (keys >> self.shift).astype(np.int64)
        at, end = self.starts[slot], self.starts[slot + 1]
        out = np.where((at < end) & (self.table.take(at, mode="clip") == keys), at, -1)
        left = np.flatnonzero((out < 0) & (at + 1 < end))
        while len(left):
            at[left] += 1
            hit = self.table[at[left]] == keys[left]
            out[left[hit]] = at[left[hit]]
            left = left[~hit]
            left = left[at[left] + 1 < end[left]]
        return out


def _unsigned(part: pa.Table, name: str) -> np.ndarray:
    return part.column(name).to_numpy().astype(np.int64).view(np.uint64)


def _numbered(part: pa.Table) -> pa.Table:
    """The texts of a batch as numbers of its sorted words, and one row with these words and their training counts."""
    texts, held = part.column("text").combine_chunks(), part.column("held_out").to_numpy(zero_copy_only=False)
    texts = pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) else texts
    found = []
    for a, b in bw.slices(texts):
        keys, first = tokens(texts.slice(a, b - a))
        key, which = np.unique(keys, return_inverse=True)
        found.append((key, which.astype(np.int32), np.diff(first), np.bincount(which, np.repeat(~held[a:b], np.diff(first)), len(key)).astype(np.int64)))
    words, place = np.unique(np.concatenate([x[0] for x in found]), return_inverse=True)
    counts = np.bincount(place, np.concatenate([x[3] for x in found]), len(words)).astype(np.int64)
    ids, at = [], 0
    for key, which, sizes, _ in found:
        mine = place[at : at + len(key)].astype("<i4")[which]
        stops = np.concatenate([[0], np.cumsum(sizes)])
        ids += [mine[x:y].tobytes() for x, y in zip(stops[:-1].tolist(), stops[1:].tolist())]
        at += len(key)
    none = pa.nulls(len(ids), pa.binary())
    batch = part.column("batch")[0].as_py()
    texts_part = pa.table([part.column("batch"), part.column("doc_id"), part.column("held_out"), pa.array(ids, pa.binary()), none, none], NAMES)
    words_part = pa.table(
        [pa.array([batch], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.bool_()), pa.nulls(1, pa.binary()), pa.array([words.tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary())], NAMES
    )
    return pa.concat_tables([texts_part, words_part])


NAMES = [f.split()[0] for f in NUMBERED.split(", ")]


def _dealer(most: int):
    """Batches of about ``most`` bytes of a partition's rows, numbered; no text is shuffled."""

    def numbered(rows: list[pa.RecordBatch], batch: int):
        part = pa.Table.from_batches(rows)
        return _numbered(part.append_column("batch", pa.array(np.full(part.num_rows, batch, np.int64)))).to_batches()

    def deal(batches):
        waiting, size, number = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for a, b in bw.slices(batch.column("text"), -(-most // 4)):
                waiting.append(batch.slice(a, b - a))
                size += pc.sum(pc.binary_length(waiting[-1].column("text"))).as_py()
                if size >= most:
                    yield from numbered(waiting, number)
                    waiting, size, number = [], 0, number + 1
                    give_back()
        if waiting:
            yield from numbered(waiting, number)

    return deal


def _word_rows(batches):
    """(batch, key, n) of every batch's words."""
    for part in batches:
        for batch, words, counts in zip(part.column("batch").to_pylist(), part.column("words"), part.column("counts")):
            key, n = np.frombuffer(words.as_buffer(), np.int64), np.frombuffer(counts.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), batch)), pa.array(key), pa.array(n)], ["batch", "key", "n"])


class Batch:
    """A batch's texts as numbers of its words, and what it was told: training counts of its words, its states and listed sequences of each depth."""

    def __init__(self, part: pa.Table, answers: pa.Table, total: int, distinct: int):
        self.total, self.distinct = total, distinct
        texts = pc.is_null(part.column("words"))
        self.words = np.frombuffer(part.filter(pc.invert(texts)).column("words")[0].as_buffer(), np.uint64)
        self.texts = part.filter(texts).combine_chunks()
        self.held = self.texts.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
        ids = self.texts.column("ids").combine_chunks()
        self.texts = self.texts.select(["doc_id", "held_out"])
        ids = pa.concat_arrays(ids.chunks) if isinstance(ids, pa.ChunkedArray) else ids
        bounds = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1].astype(np.int64)
        self.ids = np.frombuffer(ids.buffers()[2], np.uint8)[bounds[0] : bounds[-1]].view("<i4")
        self.first = (bounds - bounds[0]) // 4
        self.rows = {(d, s): (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)) for d in range(DEPTH + 1) for s in (False, True)}
        names, self.marked = ("depth", "is_state", "range", "keys", "n", "listed", "cells"), [np.zeros(0, np.uint64)]
        told: dict = {}
        # Buffers, not copies; one depth after another becomes arrays.
        rows = zip(*(answers.column(c).to_pylist() for c in names[:3]), *([x.as_buffer() for x in answers.column(c)] for c in names[3:]))
        for d, is_state, r, keys, n, listed, cells in sorted(rows, key=lambda x: x[2] or 0):
            if cells is None and not d:
                self.rows[d, is_state] = self.words, _wide(n, len(self.words)), _wide(listed, len(self.words))
            elif cells is None:
                told.setdefault((d, is_state), []).append((keys, n, listed))
            else:
                self.marked.append(np.cumsum(_from_planes(cells), dtype=np.uint64) + (np.uint64(r) << np.uint64(CELL)))
        for place, mine in told.items():
            keys = [_sorted_keys(x[0]) for x in mine]
            numbers = (np.concatenate([_unpacked(x[c], len(k)) for k, x in zip(keys, mine)]) for c in (1, 2))
            self.rows[place] = np.concatenate(keys), *numbers
        self.counts = self.rows[0, False][1]
        self.word_state = Places(self.rows[1, True][0])(self.words)
        # Used for every token of the batch, so made once.
        self.places = {k: Places(x[0]) for k, x in self.rows.items() if k[0]}

    def slices(self):
        """(first row, last row, numbers, keys, first token of each row) of about ``TOKENS`` tokens; a text stays whole."""
        at = 0
        while at < len(self.first) - 1:
            to = max(at + 1, int(np.searchsorted(self.first, self.first[at] + TOKENS, "right")) - 1)
            ids = self.ids[self.first[at] : self.first[to]]
            yield at, to, ids, self.words[ids], self.first[at : to + 1] - self.first[at]
            at = to

    def frequent(self, depth: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """The contexts of this many words that occur at least so often, and how often."""
        key, n, _ = self.rows[depth - 1, False]
        return key[n >= least], n[n >= least]

    def asking(self, depth: int, least_state: int, least_next: int):
        """What :meth:`slices` gives, each token's place in its text, and the tokens that end a sequence of a frequent context and a frequent next token."""
        following, leading = self.counts >= least_next, self.counts >= least_state
        contexts = Places(self.frequent(depth, least_state)[0])
        for a, b, ids, keys, first in self.slices():
            place = place_in_text(first)
            at = np.flatnonzero((place >= depth) & following[ids])
            if depth == 1:
                at = at[leading[ids[at - 1]]]
            else:
                at = at[contexts(grams(keys, depth)[at - 1]) >= 0]
            yield a, b, ids, keys, first, place, at

    def root(self, count: np.ndarray) -> np.ndarray:
        return (count + 0.5) / (self.total + 0.5 * (self.distinct + 1))

    def predicted(self, ids: np.ndarray, keys: np.ndarray, place: np.ndarray, at: np.ndarray, depth: int = DEPTH) -> np.ndarray:
        """Probability of the tokens ``at`` by their longest retained suffixes of at most ``depth`` words."""
        p = self.root(self.counts[ids[at]])
        for d in range(1, depth + 1):
            states, c, listed = self.rows[d, True]
            if not len(states):
                continue
            some = np.flatnonzero(place[at] >= d)
            before = at[some] - 1
            s = self.word_state[ids[before]] if d == 1 else self.places[d, True](grams(keys, d)[before])
            some, s = some[s >= 0], s[s >= 0]
            _, n, _ = self.rows[d, False]
            e = self.places[d, False](grams(keys, d + 1)[at[some]])
            k = np.where(e >= 0, n[e], 0) if len(n) else 0
            p[some] = (k + (c[s] - listed[s] + SMOOTH) * p[some]) / (c[s] + SMOOTH)
        return p


def _in_planes(values: np.ndarray, kind: str = "<u4") -> bytes:
    """Numbers of this kind, all first bytes before all second ones: high bytes of small integers are runs that compress."""
    return np.ascontiguousarray(values.astype(kind).view(np.uint8).reshape(len(values), -1).T).tobytes() if len(values) else b""


def _from_planes(body: bytes, kind: str = "<u4") -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(body, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on in as few planes as the largest needs."""
    width = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T[:width]).tobytes()


def _unpacked(body, count: int) -> np.ndarray:
    planes = np.frombuffer(body, np.uint8).reshape(-1, count) if count else np.zeros((1, 0), np.uint8)
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if np.dtype(k).itemsize >= len(planes))
    out = np.zeros((count, np.dtype(kind).itemsize), np.uint8)
    out[:, : len(planes)] = planes.T
    return out.view(kind).ravel()


def _key_gaps(keys: np.ndarray) -> bytes:
    """Sorted keys as their number, the first, and the gaps between them."""
    return np.asarray([len(keys), keys[0]], "<u8").tobytes() + _packed(np.diff(keys))


def _sorted_keys(body) -> np.ndarray:
    count, first = np.frombuffer(body, "<u8", 2).tolist()
    out = np.empty(count, np.uint64)
    out[0], out[1:] = first, _unpacked(memoryview(body)[16:], count - 1)
    return np.cumsum(out, dtype=np.uint64, out=out)


def _key_ranges(keys: np.ndarray, bits: int):
    """(range, first, last) of the ranges of ``bits`` bits in sorted keys."""
    stops = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    return ((r, a, b) for r, (a, b) in enumerate(zip(stops[:-1].tolist(), stops[1:].tolist())) if b > a)


def _ranges(cells: np.ndarray):
    """(range, first, last) of the ranges in sorted cells; the low ``CELL`` bits of a cell are its place in the range."""
    high = cells >> np.uint64(CELL)
    edges = np.concatenate([[0], np.flatnonzero(high[1:] != high[:-1]) + 1, [len(cells)]]) if len(cells) else np.zeros(1, np.int64)
    return zip(high[edges[:-1]].tolist() if len(cells) else [], edges[:-1].tolist(), edges[1:].tolist())


def _pieces(found: list[tuple[np.ndarray, ...]], bits: int):
    """What slices found, sorted by a first column of ``bits`` bits, put together for one eighth of its values after another."""
    edges = [np.searchsorted(x[0], np.arange(1, 8, dtype=np.uint64) << np.uint64(bits - 3)) for x in found]
    edges = [[0, *e.tolist(), len(x[0])] for e, x in zip(edges, found)]
    for k in range(8):
        yield tuple(np.concatenate(c) for c in zip(*[[column[e[k] : e[k + 1]] for column in x] for e, x in zip(edges, found)]))


def _packed_counts(depth: int, total: int, distinct: int, least_state: int, least_next: int, bits: int):
    """The training counts of a batch's sequences by the first ``bits`` and ``CELL`` bits of their hash, a row for each range of the first."""

    def few(n: np.ndarray) -> np.ndarray:
        return np.minimum(n, least_next).astype(np.min_scalar_type(least_next))

    def count(part: pa.Table, answers: pa.Table) -> pa.Table:
        batch, found = Batch(part, answers, total, distinct), []
        for a, b, ids, keys, first, _, at in batch.asking(depth, least_state, least_next):
            cell, which = np.unique(grams(keys, depth + 1)[at] >> np.uint64(64 - CELL - bits), return_inverse=True)
            found.append((cell, few(np.bincount(which, np.repeat(~batch.held[a:b], np.diff(first))[at], len(cell)))))
        out, number = [], part.column("batch")[0].as_py()
        for cell, n in _pieces(found, bits + CELL):
            cells, which = np.unique(cell, return_inverse=True)
            n = few(np.bincount(which, n, len(cells)))
            low = (cells & np.uint64((1 << CELL) - 1)).astype(np.int64)
            out += [{"range": r, "batch": number, "cells": _in_planes(np.diff(low[x:y], prepend=0)), "counts": n[x:y].tobytes()} for r, x, y in _ranges(cells)]
        return _rows(out, PACKED)

    return count


def _narrow(values: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0)))).tobytes()


def _wide(body: bytes, count: int) -> np.ndarray:
    return np.frombuffer(body, f"<u{max(1, len(body) // max(1, count))}").astype(np.int64)


def _rows(rows: list[dict], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.Table.from_pylist(rows, pa.schema([(c, kinds[k]) for c, k in (f.split() for f in schema.split(", "))]))


def _table(rows: list[dict]) -> pa.Table:
    return _rows(rows, ANSWERS)


def _marked(depth: int, least_next: int):
    """For each batch the cells of a range that reach the count over all batches."""

    def mark(part: pa.Table) -> pa.Table:
        low = [np.cumsum(_from_planes(x), dtype=np.int64) for x in part.column("cells").to_pylist()]
        n = np.concatenate([np.frombuffer(x, np.min_scalar_type(least_next)) for x in part.column("counts").to_pylist()])
        cells, which = np.unique(np.concatenate(low), return_inverse=True)
        enough = (np.bincount(which, n, len(cells)) >= least_next)[which]
        stops = np.cumsum([0, *map(len, low)]).tolist()
        kept = [_in_planes(np.diff(x[enough[a:b]], prepend=0)) for x, a, b in zip(low, stops[:-1], stops[1:])]
        places = zip(part.column("batch").to_pylist(), part.column("range").to_pylist(), kept)
        return _table([{"batch": b, "depth": depth, "is_state": False, "range": r, "cells": x} for b, r, x in places])

    return mark


def _in_arrays(part: pa.Table) -> pa.Table:
    """What a batch is told of its words: their numbers in the order of their keys, which it has."""
    at = np.argsort(_unsigned(part, "key"))
    n, listed = (_narrow(part.column(c).to_numpy()[at]) for c in ("n", "listed"))
    return _table([{"batch": part.column("batch")[0].as_py(), "depth": 0, "is_state": False, "keys": b"", "n": n, "listed": listed}])


def _gram_rows(depth: int, total: int, distinct: int, least_state: int, least_next: int, bits: int):
    """The distinct sequences of a frequent context and a frequent next token in a batch, where their cell is marked, in order."""

    def ask(part: pa.Table, answers: pa.Table) -> pa.Table:
        batch, found = Batch(part, answers, total, distinct), []
        marked = Places(np.concatenate(batch.marked), bits + CELL)
        for a, b, ids, keys, first, _, at in batch.asking(depth, least_state, least_next):
            whole = grams(keys, depth + 1)
            at = at[marked(whole[at] >> np.uint64(64 - CELL - bits)) >= 0]
            gram, which = np.unique(whole[at], return_inverse=True)
            found.append((gram, np.bincount(which, np.repeat(~batch.held[a:b], np.diff(first))[at], len(gram)).astype(np.int32)))
        out, number = [], part.column("batch")[0].as_py()
        for gram, n in _pieces(found, 64):
            gram, which = np.unique(gram, return_inverse=True)
            n = np.bincount(which, n, len(gram)).astype(np.int64)
            out.append(pa.table([pa.array(np.full(len(gram), number, np.int64)), pa.array(gram.view(np.int64)), pa.array(n)], ["batch", "gram", "n"]))
        return pa.concat_tables(out)

    return ask


def _packed_grams(*places):
    """The same as sorted arrays, a row for each range of the first bits of their hash."""
    rows, bits = _gram_rows(*places), max(3, places[-1] - 3)

    def ask(part: pa.Table, answers: pa.Table) -> pa.Table:
        found = rows(part, answers)
        keys, n, batch = _unsigned(found, "gram"), found.column("n").to_numpy(), part.column("batch")[0].as_py()
        return _rows([{"range": r, "batch": batch, "keys": _key_gaps(keys[a:b]), "n": _packed(n[a:b])} for r, a, b in _key_ranges(keys, bits)], SENT)

    return ask


def _met(part: pa.Table, *columns: str):
    """What batches sent of one range: (numbers of the batches, ends of their shares, keys, the other columns), batch by batch."""
    rows = sorted(part.select(["batch", "keys", *columns]).to_pylist(), key=lambda x: x["batch"])
    keys = [_sorted_keys(x["keys"]) for x in rows]
    numbers = [np.concatenate([_from_planes(x[c], "<f8") if c in ("gain", "below") else _unpacked(x[c], len(k)) for x, k in zip(rows, keys)]) for c in columns]
    return [x["batch"] for x in rows], np.cumsum([0, *map(len, keys)]).tolist(), np.concatenate(keys), *numbers


def _answered(depth: int, is_state: bool, r: int, batches: list, stops: list, kept: np.ndarray, keys: np.ndarray, n: np.ndarray, listed: np.ndarray) -> pa.Table:
    """For each batch what is kept of the keys it sent."""
    out = []
    for batch, a, b in zip(batches, stops[:-1], stops[1:]):
        at = a + np.flatnonzero(kept[a:b])
        if len(at):
            arrays = {"keys": _key_gaps(keys[at]), "n": _packed(n[at]), "listed": _packed(listed[at])}
            out.append({"batch": batch, "depth": depth, "is_state": is_state, "range": r} | arrays)
    return _table(out)


def _listed(depth: int, least_next: int):
    """For each batch the sequences of a range that reach the count over all batches; ``listed`` is 1 in the first batch that holds one."""

    def add(part: pa.Table) -> pa.Table:
        batches, stops, keys, n = _met(part, "n")
        known, one, which = np.unique(keys, return_index=True, return_inverse=True)
        together = np.bincount(which, n, len(known)).astype(np.int64)[which]
        first = np.zeros(len(keys), np.int64)
        first[one] = 1
        return _answered(depth, False, part.column("range")[0].as_py(), batches, stops, together >= least_next, keys, together, first)

    return add


def _shares(depth: int, total: int, distinct: int, least_state: int, least_next: int, bits: int):
    """A batch's frequent contexts with their counts, and what the listed sequences that it holds first add to their divergence."""

    def share(part: pa.Table, answers: pa.Table) -> pa.Table:
        batch = Batch(part, answers, total, distinct)
        own, k, first = batch.rows[depth, False]
        own, k = own[first > 0], k[first > 0].astype(np.float64)
        mine, context, p, known = Places(own), np.zeros(len(own), np.uint64), np.ones(len(own), np.float32), np.zeros(len(own), bool)
        for _, _, ids, keys, _, place, at in batch.asking(depth, least_state, least_next):
            e = mine(grams(keys, depth + 1)[at])
            new = np.flatnonzero(e >= 0)
            new = new[~known[e[new]]]
            e, one = np.unique(e[new], return_index=True)
            at = at[new[one]]
            known[e], context[e] = True, grams(keys, depth)[at - 1]
            p[e] = batch.predicted(ids, keys, place, at, depth - 1)
        keys, c = batch.frequent(depth, least_state)
        s, p = Places(keys)(context), p.astype(np.float64)
        listed, gain, below = (np.bincount(s, x, len(keys)) for x in (k, k * np.log(k / p), p))
        out, number = [], part.column("batch")[0].as_py()
        for r, a, b in _key_ranges(keys, max(3, bits - 3)):
            whole = {"n": _packed(c[a:b]), "listed": _packed(listed[a:b])}
            out.append({"range": r, "batch": number, "keys": _key_gaps(keys[a:b]), "gain": _in_planes(gain[a:b], "<f8"), "below": _in_planes(below[a:b], "<f8")} | whole)
        return _rows(out, SHARES)

    return share


def _retained(depth: int, least: float):
    """For each batch its contexts of a range that diverge from their shorter suffix by ``least`` nats or more, with what they list."""

    def add(part: pa.Table) -> pa.Table:
        batches, stops, keys, n, *sums = _met(part, "n", "listed", "gain", "below")
        known, one, which = np.unique(keys, return_index=True, return_inverse=True)
        c, (listed, gain, below) = n[one].astype(np.float64), (np.bincount(which, x, len(known)) for x in sums)
        rest = 1 - listed / c
        left = np.where(rest > 0, rest * np.log(np.where(rest > 0, rest, 1) / np.maximum(1 - below, 1e-12)), 0)
        kept = (listed > 0) & ((gain - listed * np.log(c)) / c + left >= least)
        return _answered(depth, True, part.column("range")[0].as_py(), batches, stops, kept[which], keys, n, listed[which].astype(np.int64))

    return add


def _score(total: int, distinct: int):
    def score(part: pa.Table, answers: pa.Table) -> pa.Table:
        batch, out = Batch(part, answers, total, distinct), []
        for _, _, ids, keys, first in batch.slices():
            count = batch.counts[ids]
            best = np.log10(batch.predicted(ids, keys, place_in_text(first), np.arange(len(ids))))
            out.append([np.diff(first), *(np.add.reduceat(x, first[:-1]) for x in ((count > 0).astype(np.int64), np.log10(batch.root(count)), best))])
        n_tokens, seen, base, best = (pa.array(np.concatenate(c)) for c in zip(*out))
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        texts = batch.texts
        return pa.table([texts.column("doc_id"), texts.column("held_out"), n_tokens, seen, pa.array(np.full(texts.num_rows, total, np.int64)), base, best], names)

    return score


def _bucketed(df: DataFrame, key: str, name: str | None = None) -> str:
    """Name of a table bucketed by ``key`` that ``df`` is written to, or added to: jobs that group it by the key do not shuffle it again."""
    spark = df.sparkSession
    parts, name = int(spark.conf.get("spark.sql.shuffle.partitions")), name or f"batches_{uuid.uuid4().hex}"
    writer = df.write.mode("append").bucketBy(parts, key).sortBy(key)
    writer.option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    return name


def _alone(work):
    """``work`` on a group, which gives back what it freed before the next one."""

    def run(part: pa.Table) -> pa.Table:
        out = work(part)
        give_back()
        return out

    return run


def _paired(work):
    """The same for cogroups."""

    def run(part: pa.Table, answers: pa.Table) -> pa.Table:
        out = work(part, answers)
        give_back()
        return out

    return run


def _told(rows: DataFrame) -> str:
    """Answers (batch, key, n, listed) on words as arrays, in a table bucketed by batch."""

    def packed(batches):
        for part in groups(batches, "batch"):
            yield from _in_arrays(part).to_batches()

    # Rows come in batches of bounded size; a group of them at once would be held outside the JVM's heap.
    return _bucketed(spread_keys(rows, "batch").sortWithinPartitions("batch").mapInArrow(lean(packed), ANSWERS), "batch")


def _levels(dealt: DataFrame, words: DataFrame, total: int, distinct: int, batches: int) -> DataFrame:
    """Answers of all depths, one depth after another."""
    # More batches make more ranges, so what one range holds stays the same.
    bits = min(32, batches.bit_length() + 3)
    # One table for all depths, read anew after each step.
    spark = dealt.sparkSession
    name = _told(words.select("batch", "key", "n", F.lit(0).cast("long").alias("listed")))

    def told(condition: str) -> DataFrame:
        return spark.table(name).filter(condition)

    def asked(work, answers: DataFrame, schema: str) -> DataFrame:
        return dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_paired(work), schema).groupBy("range")

    def answer(met, work) -> None:
        _bucketed(met.applyInArrow(_alone(work), ANSWERS), "batch", name)

    for depth in range(1, DEPTH + 1):
        places = depth, total, distinct, STATE, NEXT, bits
        # What is asked follows from the words and the sequences one shorter; only predictions need the rest.
        before = f"depth = 0 OR depth = {depth - 1} AND NOT is_state AND cells IS NULL"
        answer(asked(_packed_counts(*places), told(before), PACKED), _marked(depth, NEXT))
        answer(asked(_packed_grams(*places), told(f"{before} OR depth = {depth} AND cells IS NOT NULL"), SENT), _listed(depth, NEXT))
        answer(asked(_shares(*places), told("cells IS NULL"), SHARES), _retained(depth, DIVERGENCE))
    return told("cells IS NULL")


def scores(docs: DataFrame, held_out) -> DataFrame:
    """Scores of every row of ``docs(doc_id, text)``, learnt from the rows that ``held_out`` (a condition) leaves."""
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), held_out.alias("held_out")
    )
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches = max(1, -(-size // BATCH_BYTES))
    # Written once, so every job sees the same batches; many small partitions are taken together.
    dealt = docs.sparkSession.table(_bucketed(own.coalesce(4 * batches).mapInArrow(lean(_dealer(BATCH_BYTES)), NUMBERED), "batch"))
    batches = max(1, dealt.filter("words IS NOT NULL").count())
    asked = dealt.filter("words IS NOT NULL").select("batch", "words", "counts").mapInArrow(lean(_word_rows), "batch long, key long, n long")
    same = Window.partitionBy("key")
    words = store(asked.select("batch", "key", F.sum("n").over(same).alias("n"), (F.col("batch") == F.min("batch").over(same)).alias("is_first")))
    total, distinct = words.filter("is_first AND n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    answers = _levels(dealt, words, total, distinct, batches)
    return dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_paired(_score(total, distinct)), SCORE)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), in_fold(F.col("doc_id"), 5, 1))


CHECKS = {"op6_suffix_tree": (op6, None)}
