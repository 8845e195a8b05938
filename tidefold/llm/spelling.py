"""Spelling variants: words one edit apart, found by composing acceptors.

Words come from maximal runs of ASCII letters and U+00C0-U+00FF, lower-cased in
A-Z, with the agreed deletions applied; they are counted with partial sums.

The composed machine is vocabulary acceptor, one-edit transducer, vocabulary
acceptor. Before its edit it can only be in states (p, p), because the acceptor is
deterministic; the edit leads to (s, t), with one symbol replaced or left out on
one side; after it both sides read the same symbols. Acceptors are minimised, so
what follows an edit is explored once for each pair of states, however many
prefixes lead there, and a word is known by its number in sorted order (the sum of
the words skipped along its path), so accepted pairs are pairs of numbers.

The machine is partitioned by its initial state. An arc out of it is a *cell*: the
shorter length ``m`` of a pair, the segment ``[lo, hi)`` in which the words part,
and the letters before and behind that segment, which both share. A word is in the
cells of ``m`` equal to its length and one less, each with two segments; every pair
is accepted in exactly one cell, that of its longest common prefix. Cells with more
than ``SYMBOLS`` letters in their segments are halved, each half with a longer
shared part, until they fit; a cell of one letter is small by itself. So a common
prefix or ending of many words never makes one large group.

NULL and empty texts have no runs, and a NULL document id stands as the empty
text before the colon. Repeated rows count again. Runs of any length are allowed,
texts are taken in windows of some megabytes. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.llm import bytewords as bw
from tidefold.llm.common import table
from tidefold.session import spread_keys, store

LETTERS = 6
LEAST = 5
RATIO = 5
EVERY = 199
SYMBOLS = 1 << 20
HELD = 1 << 19
SEEDS = 1 << 20
CELLS = 1 << 23
WINDOW = 8 << 20

_every = np.arange(256)
_LETTER = (bw.FOLD >= 0x61) & (bw.FOLD <= 0x7A)
_LEAD = 0xC3  # lead byte of U+00C0-U+00FF
_FINAL, _ARC = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)


def letter_runs(texts: pa.Array, window: int = WINDOW) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, starts, ends, rows) of the runs with enough letters, window by window."""
    for first, to in bw.slices(texts):
        part = pc.fill_null(texts.slice(first, to - first), "").cast(pa.large_string())
        bounds = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
        if bounds[-1] == bounds[0]:
            continue
        data = bw.FOLD[np.frombuffer(part.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]]
        bounds = bounds - bounds[0]
        data, guards = np.insert(data, bounds, 0x20), bounds + np.arange(len(bounds))
        lead = data == _LEAD
        inside = _LETTER[data] | lead
        inside[1:] |= lead[:-1]
        seconds = np.concatenate([[0], np.cumsum(lead)])
        at = 0
        while at < len(data) - 1:
            end = min(at + window, len(data))
            while end < len(data) and inside[end - 1]:
                end += 1
            turns = np.flatnonzero(np.diff(inside[at:end].astype(np.int8))) + 1 + at
            start, stop = turns[::2], turns[1::2]
            enough = stop - start - (seconds[stop] - seconds[start]) >= LETTERS
            start, stop = start[enough], stop[enough]
            yield data, start, stop, first + np.searchsorted(guards, start) - 1
            at = end - 1


def _counter(window: int):
    def count(batches):
        """(word, n) with equal words of some slices added up."""
        held: dict[bytes, int] = {}

        def flushed():
            words = [x.decode() for x in held]
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            heads = [zlib.crc32(b"%s:" % (b"" if k is None else str(k).encode())) for k in batch.column("doc_id").to_pylist()]
            for data, start, stop, row in letter_runs(batch.column("text"), window):
                body = memoryview(data)
                key = bw.keys_of(data, start, stop)
                # A run's fate hangs on its document and itself, so equal runs of a row are one.
                _, one, times = np.unique(bw.mix(key + row.astype(np.uint64) * bw.STEP), return_index=True, return_counts=True)
                crc = np.fromiter(
                    (zlib.crc32(body[a:b], heads[r]) for a, b, r in zip(start[one].tolist(), stop[one].tolist(), row[one].tolist())), np.int64, len(one)
                )
                changed = crc % EVERY == 0
                for k in np.flatnonzero(changed):
                    run = bytes(body[start[one[k]] : stop[one[k]]]).decode()
                    place = int(crc[k]) % len(run)
                    word = run[:place] + run[place + 1 :]
                    if len(word) >= LETTERS:
                        held[word.encode()] = held.get(word.encode(), 0) + int(times[k])
                one, times = one[~changed], times[~changed]
                _, place, which = np.unique(key[one], return_index=True, return_inverse=True)
                total = np.bincount(which, times, len(place)).astype(np.int64)
                for a, b, n in zip(start[one[place]].tolist(), stop[one[place]].tolist(), total.tolist()):
                    word = bytes(body[a:b])
                    held[word] = held.get(word, 0) + n
                if len(held) > HELD:
                    yield flushed()
        yield flushed()

    return count


def vocabulary(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(word, n) of the words that occur often enough; stored."""
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = rows.mapInArrow(_counter(window), "word string, n long")
    return store(counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST))


def _placed(rows: DataFrame) -> DataFrame:
    """Rows (word, n, m, lo, hi) with their cell and the word's letters inside the segment."""
    behind = F.greatest(F.col("m") - F.col("hi"), F.lit(0))
    cell: Column = F.concat_ws(
        ":", F.lpad(F.col("m").cast("string"), 9, "0"), "lo", "hi", F.expr("substring(word, 1, lo)"), F.expr("right(word, greatest(m - hi, 0))")
    )
    middle = F.substring("word", F.col("lo") + 1, F.char_length("word") - F.col("lo") - behind)
    return rows.withColumns({"cell": cell, "middle": middle})


def cells(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """Rows (word, n, m, lo, hi, cell, middle) in cells of at most about ``symbols`` letters."""
    length = F.char_length("word")
    shorter = words.withColumn("m", F.explode(F.filter(F.array(length, length - 1), lambda m: m >= LETTERS)))
    half = F.floor(F.col("m") / 2).cast("int")

    def segments(a, middle, b):
        return F.explode(F.array(F.struct(a.alias("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), b.alias("hi"))))

    rows = _placed(shorter.withColumn("s", segments(F.lit(0), half, F.col("m") + 1)).select("word", "n", "m", "s.lo", "s.hi"))
    done = []
    while True:
        sizes = rows.groupBy("cell").agg(F.sum(F.char_length("middle")).alias("size"), F.max(F.col("hi") - F.col("lo")).alias("width"))
        large = store(sizes.filter((F.col("size") > symbols) & (F.col("width") > 1)).select("cell"))
        if large.isEmpty():
            break
        done.append(rows.join(large, "cell", "left_anti"))
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = rows.join(large, "cell", "left_semi").withColumn("s", segments(F.col("lo"), middle, F.col("hi")))
        rows = store(_placed(halves.select("word", "n", "m", "s.lo", "s.hi")))
    for more in done:
        rows = rows.unionByName(more)
    return rows


class Acceptor:
    """The minimised acceptor of sorted, distinct words of some cells.

    ``first_row`` numbers words in sorted order, a prefix being before what it begins.
    States are nodes of the prefix tree with equal right languages, told by 64-bit
    hashes taken from the ends to the roots.
    """

    def __init__(self, cell: np.ndarray, symbols: np.ndarray, size: np.ndarray):
        n, width = symbols.shape
        shared = np.full(n, -1, np.int64)
        if n > 1:
            equal = symbols[1:] == symbols[:-1]
            shared[1:] = np.where(equal.all(1), width, np.argmin(equal, 1))
            shared[1:] = np.minimum(shared[1:], np.minimum(size[1:], size[:-1]))
            shared[1:][cell[1:] != cell[:-1]] = -1
        rows, parents, letters, starts, at, numbers = [], [], [], [0], 0, None
        for depth in range(width + 1):
            new = (shared < depth) & (size >= depth)
            row = np.flatnonzero(new)
            if not len(row):
                break
            parents.append(numbers[row] if depth else np.full(len(row), -1))
            letters.append(symbols[row, depth - 1].astype(np.int64) if depth else np.zeros(len(row), np.int64))
            rows.append(row)
            numbers = at + np.cumsum(new) - 1
            at += len(row)
            starts.append(at)
        row, parent, letter = (np.concatenate(x) for x in (rows, parents, letters))
        depth = np.repeat(np.arange(len(rows)), np.diff(starts))
        final = size[row] == depth
        below, right = np.zeros(at, np.uint64), np.zeros(at, np.uint64)
        for a, b in zip(starts[-2::-1], starts[:0:-1]):
            right[a:b] = bw.mix(below[a:b] + final[a:b] * _FINAL + np.uint64(1))
            if a:
                np.add.at(below, parent[a:b], bw.mix(right[a:b] * _ARC + letter[a:b].astype(np.uint64)))
        _, named, state = np.unique(right, return_index=True, return_inverse=True)
        chosen = np.zeros(at + 1, bool)
        chosen[named] = True
        arc = np.flatnonzero(chosen[parent])  # a root's parent is -1, the slot that is never chosen
        key = state[parent[arc]] * 256 + letter[arc]
        order = np.argsort(key)
        arc = arc[order]
        self.key, self.source, self.letter, self.target = key[order], state[parent[arc]], letter[arc], state[arc]
        self.skip = row[arc] - row[parent[arc]]
        self.final = final[named]
        self.first = np.searchsorted(self.source, np.arange(len(named) + 1))
        order = np.argsort(state, kind="stable")
        self.reached, self.ways = row[order], np.searchsorted(state[order], np.arange(len(named) + 1))

    def _after(self, origin, s, t, i, j, barred=None):
        """Accepted (state before the edit, number, number, accepted at once) from pairs of states behind the edit."""
        at_once = barred is not None
        while len(s):
            both = self.final[s] & self.final[t]
            yield origin[both], i[both], j[both], at_once
            degree = np.diff(self.first)
            turned = degree[s] > degree[t]
            s, t, i, j = np.where(turned, t, s), np.where(turned, s, t), np.where(turned, j, i), np.where(turned, i, j)
            each = degree[s]
            who = np.repeat(np.arange(len(s)), each)
            arc = np.repeat(self.first[s] - np.cumsum(each) + each, each) + np.arange(len(who))
            if barred is not None:
                # Of the places where leaving out a letter of a run gives the same word only the last counts.
                stays = self.letter[arc] != barred[who]
                who, arc, barred = who[stays], arc[stays], None
            wanted = t[who] * 256 + self.letter[arc]
            other = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
            met = self.key[other] == wanted
            who, arc, other = who[met], arc[met], other[met]
            origin, s, t, i, j = origin[who], self.target[arc], self.target[other], i[who] + self.skip[arc], j[who] + self.skip[other]
            at_once = False

    def _edits(self):
        arcs = len(self.key)
        left = self.first[self.source + 1] - 1 - np.arange(arcs)
        total = np.concatenate([[0], np.cumsum(left)])
        at = 0
        while at < arcs:
            to = max(at + 1, int(np.searchsorted(total, total[at] + SEEDS, "right")) - 1)
            one = np.repeat(np.arange(at, to), left[at:to])
            two = one + 1 + np.arange(len(one)) - (total[one] - total[at])
            yield from self._after(self.source[one], self.target[one], self.target[two], self.skip[one], self.skip[two])
            at = to
        for at in range(0, arcs, SEEDS):
            arc = slice(at, at + SEEDS)
            p = self.source[arc]
            yield from self._after(p, self.target[arc], p, self.skip[arc], np.zeros(len(p), np.int64), self.letter[arc])

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """Numbers of accepted words, and whether one of them is the other with a letter behind it."""
        for origin, i, j, at_once in self._edits():
            each = self.ways[origin + 1] - self.ways[origin]
            who = np.repeat(np.arange(len(origin)), each)
            way = self.reached[np.repeat(self.ways[origin] - np.cumsum(each) + each, each) + np.arange(len(who))]
            yield way + i[who], way + j[who], at_once


def _compose(part: pa.Table):
    """Batches (word, near, near_n) of whole sorted cells, both ways round."""
    key = part.column("cell").combine_chunks()
    new = np.concatenate([[True], pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)]) if len(key) else np.zeros(0, bool)
    size = pc.utf8_length(part.column("middle")).to_numpy().astype(np.int64)
    begins = np.flatnonzero(new)
    if len(begins) > 1 and len(size) * size.max() > CELLS:
        cut = int(begins[len(begins) // 2])
        yield from _compose(part.slice(0, cut))
        yield from _compose(part.slice(cut))
        return
    symbols = np.zeros((len(size), max(1, int(size.max(initial=0)))), np.uint8)
    # Code points up to U+00FF are their bytes in Latin-1.
    symbols[np.arange(symbols.shape[1]) < size[:, None]] = np.frombuffer("".join(part.column("middle").to_pylist()).encode("latin-1"), np.uint8)
    m, hi, n = (part.column(c).to_numpy() for c in ("m", "hi", "n"))
    length = pc.utf8_length(part.column("word")).to_numpy()
    words = part.column("word").combine_chunks()
    for a, b, at_once in Acceptor(np.cumsum(new), symbols, size).pairs():
        stays = np.minimum(length[a], length[b]) == m[a]
        if at_once:
            stays &= hi[a] > m[a]  # behind an inner segment the common prefix may go on
        a, b = np.concatenate([a[stays], b[stays]]), np.concatenate([b[stays], a[stays]])
        for at in range(0, len(a), 1 << 16):
            x, y = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([words.take(pa.array(x)), words.take(pa.array(y)), pa.array(n[y])], ["word", "near", "near_n"])


def _composed(batches):
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        waiting.append(batch)
        held = pa.Table.from_batches(waiting)
        if held.num_rows < 1 << 16:
            continue
        key = held.column("cell").combine_chunks()
        new = np.flatnonzero(pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False))
        if len(new):
            cut = int(new[-1]) + 1
            yield from _compose(held.slice(0, cut))
            waiting = held.slice(cut).to_batches()
    if waiting:
        held = pa.Table.from_batches(waiting)
        if held.num_rows:
            yield from _compose(held)


def near_words(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(word, near, near_n): every pair of ``words(word, n)`` one edit apart, both ways round, once."""
    rows = spread_keys(cells(words, symbols), "cell").sortWithinPartitions("cell", "middle")
    return rows.select("cell", "middle", "word", "n", "m", "hi").mapInArrow(_composed, "word string, near string, near_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms(word, form)``; counts grow along forms, so there is no cycle and few rounds."""
    state = store(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while not state.filter("moved").isEmpty():
        step = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        state = store(state.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
    return state.select("word", "root")


def variants(docs: DataFrame, ratio: int = RATIO, symbols: int = SYMBOLS, window: int = WINDOW) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word."""
    words = vocabulary(docs, window)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best")
    near = near_words(words, symbols).groupBy("word").agg(F.count("*").alias("n_near"), best)
    is_form = -F.col("best.less") >= ratio * F.col("n")
    rows = store(
        words.join(near, "word", "left").select(
            "word", F.when(is_form, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(is_form, -F.col("best.less")).alias("form_n"),
        )
    )
    roots = _roots(rows.filter(F.col("form").isNotNull()))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


CHECKS = {"op13_spelling": (op13, None)}
