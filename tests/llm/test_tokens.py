"""Token counts and files against the library, text by text."""

import zlib
from collections import Counter
from math import log, log10

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from tokenizers import Tokenizer

import brute
from conftest_llm import rows_of
from tidefold.llm import pieces, suffix_tree, token_counts, token_files

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " ", "\n", "a", " a  b\n\nc ", "it's IT'S 's", "Ünï,cödé! «q»", "<|endoftext|> x<|endoftext|>y <|startoftext|>", "İstanbul ΑΣ ǅ ﬁ", "a!b!!c'd''e",
    "x < y | z <| w", "tab\there\x1cfs nb em", "漢字 かな 12345 a1b2", "é ≮ ́x", "Abc!!! abc ABC, abc", "END.\nNext line", "a \n b", "﻿bom",
]


def ids_of(encoder, texts):
    out = []
    for _, ids, stops in encoder.rows(pa.array(texts, pa.string())):
        out += [ids[x:y].tolist() for x, y in zip(stops[:-1], stops[1:])]
    return out


@pytest.mark.parametrize("path,folds", [(BYTES, False), (WORDS, True)])
def test_pieces_encode_like_whole_texts(path, folds, monkeypatch):
    plain = Tokenizer.from_file(path)
    rng = np.random.default_rng(1)
    parts = [p for t in ODD for p in t.split(" ")] + [" ", "\n", "  ", "'", "!"]
    texts = ODD + ["".join(rng.choice(parts, rng.integers(1, 9))) for _ in range(3000)]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    encoder = pieces.Encoder(path)
    assert ids_of(encoder, texts) == want == ids_of(encoder, texts)  # the second time from the cache
    assert ids_of(encoder, [None, "", None]) == [[], [], []] and ids_of(encoder, []) == []
    monkeypatch.setattr(pieces, "LONG", 100)
    monkeypatch.setattr(pieces, "SLICE", 64)
    long = " ".join(texts)
    assert ids_of(encoder, [long]) == [plain.encode(long, add_special_tokens=False).ids]
    assert ids_of(encoder, texts[:300]) == want[:300]


@pytest.mark.parametrize("path,folds", [(BYTES, False), (WORDS, True)])
def test_special_strings_in_other_case(path, folds):
    """Only the exact spelling is a special token; other spellings are ordinary text."""
    plain = Tokenizer.from_file(path)
    texts = ["a <|ENDOFTEXT|> b", "a <|endoftext|> b", "<|EndOfText|>", "x<|StartOfText|>Y\n<|startoftext|>Z", "<|STARTOFTEXT|>\nA|B <C", "One\nTwo ONE"]
    encoder = pieces.Encoder(path)
    assert ids_of(encoder, texts) == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_go_to_the_model_as_the_rules_leave_them():
    """Every letter that counts as known, alone, doubled and between others, with and without a blank, in either case."""
    letters = [chr(c) for c in [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)]]
    texts = [f"{x} {x}{x} a{x}b A{x} {x}B a {x}" for x in letters] + ["naïve Ärger GROẞE straße ÿÿ", "e\u0301 É E\u0301"]
    for path in (BYTES, WORDS):
        plain = Tokenizer.from_file(path)
        assert ids_of(pieces.Encoder(path), texts) == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_rules_are_read_from_the_file(tmp_path):
    """Other rules than the known ones: no cuts, and still the library's ids."""
    import json

    assert (pieces.rules(BYTES), pieces.rules(WORDS)) == ("bytes", "words")
    with open(WORDS) as f:
        changed = json.load(f)
    changed["normalizer"]["normalizers"].pop()
    path = str(tmp_path / "other.json")
    with open(path, "w") as f:
        json.dump(changed, f)
    plain, encoder = Tokenizer.from_file(path), pieces.Encoder(path)
    assert encoder.rules is None
    texts = ["Hello World", "hello world", "", "A\nB", "Hello World"]
    assert ids_of(encoder, texts) == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "LIMIT", 50)
    plain, encoder = Tokenizer.from_file(BYTES), pieces.Encoder(BYTES)
    for k in range(20):
        text = " ".join(f"word{k}n{j}, Abc" for j in range(40))
        assert ids_of(encoder, [text]) == [plain.encode(text).ids]
        assert len(encoder.known.keys) <= 50 and len(encoder.recent.keys) <= 50 and len(encoder.known.flat) == encoder.known.size.sum()


def test_long_texts_are_spliced(spark):
    """Chunks, widened overlaps, a text without any boundary, repeats: always the library's count."""
    plain = Tokenizer.from_file(BYTES)
    rng = np.random.default_rng(2)
    texts = [
        " ".join(f"tok{k % 97} über-{k}" for k in range(3000)), "x" * 5000, ("y" * 700 + " ") * 12, "a  b\n\n" * 900, " " * 3000 + "end", "短い文 " * 800,
        "".join(rng.choice(list("ab .,!'\n\té"), 4000)),
    ]
    rows = [(k, t) for k, t in enumerate([*texts, texts[0]])] + [(0, texts[0]), (99, None), (None, "short one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = token_counts.token_counts(docs, BYTES, limit=900, stride=512, overlap=16).collect()
    want = [(k, len((t or "").encode()), len(plain.encode(t or "", add_special_tokens=False).ids)) for k, t in rows]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_counts_and_files_of_odd_rows(odd_docs, no_docs, tmp_path):
    counted = token_counts.token_counts(odd_docs, BYTES).collect()
    plain = Tokenizer.from_file(BYTES)
    want = [(i, len((t or "").encode()), len(plain.encode(t or "").ids)) for i, t in rows_of(odd_docs)]
    assert sorted(map(str, map(tuple, counted))) == sorted(map(str, want))
    assert token_counts.token_counts(no_docs, BYTES).count() == 0 and token_files.token_files(no_docs).count() == 0

    folder = str(tmp_path / "set")
    manifest = token_files.write_token_files(odd_docs, folder, WORDS)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read_token_files(manifest, folder).collect())
    plain, start = Tokenizer.from_file(WORDS), 0
    left = Counter((i, t) for i, t in rows_of(odd_docs))
    for place, doc, n, crc in got:
        assert place == start
        texts = [t for (i, t), times in left.items() if i == doc and times]
        ids = {t: plain.encode(t or "", add_special_tokens=False).ids + [1] for t in texts}
        text = next(t for t in texts if zlib.crc32(np.asarray(ids[t], "<u4").tobytes()) == crc)
        left[(doc, text)] -= 1
        assert n == len(ids[text])
        start += n
    assert not +left
    order = [doc for _, doc, _, _ in got]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    # Straight from the files, without the reader's job.
    row = manifest.orderBy("shard").first()
    ids, offsets, _ = token_files.read_shard(folder, row["shard"], row["width"])
    assert isinstance(ids, np.memmap) and len(ids) == row["n_tokens"] == offsets[-1] and offsets.dtype == np.dtype("<u8")


def tree_scores(rows, held, state, following):
    """(base, score) of each text by the definition, with dictionaries of word tuples."""
    texts = [brute.SPACED.findall((t or "").translate(brute.FOLD)) + [None] for _, t in rows]
    counts = [Counter() for _ in range(suffix_tree.DEPTH + 2)]
    for (k, _), x in zip(rows, texts):
        if not held(k):
            for length in range(1, suffix_tree.DEPTH + 2):
                counts[length].update(tuple(x[i : i + length]) for i in range(len(x) - length + 1))
    total, distinct, smooth = sum(counts[1].values()), len(counts[1]), suffix_tree.SMOOTH
    retained = {}

    def predicted(before, x, depth):
        p = (counts[1][(x,)] + 0.5) / (total + 0.5 * (distinct + 1))
        for d in range(1, min(depth, len(before)) + 1):
            if before[-d:] in retained:
                c, entries = retained[before[-d:]]
                p = (entries.get(x, 0) + (c - sum(entries.values()) + smooth) * p) / (c + smooth)
        return p

    for depth in range(1, suffix_tree.DEPTH + 1):
        entries = {}
        for gram, n in counts[depth + 1].items():
            if n >= following:
                entries.setdefault(gram[:-1], {})[gram[-1]] = n
        new = {}
        for s, c in counts[depth].items():
            if c >= state and s in entries:
                own = {x: (n / c, predicted(s, x, depth - 1)) for x, n in entries[s].items()}
                rest, below = 1 - sum(a for a, _ in own.values()), 1 - sum(b for _, b in own.values())
                gain = sum(a * log(a / b) for a, b in own.values()) + (rest * log(rest / max(below, 1e-12)) if rest > 1e-15 else 0)
                if gain >= suffix_tree.DIVERGENCE:
                    new[s] = c, entries[s]
        retained.update(new)
    out = []
    for x in texts:
        each = [(predicted((), w, 0), predicted(tuple(x[max(0, i - suffix_tree.DEPTH) : i]), w, suffix_tree.DEPTH)) for i, w in enumerate(x)]
        out.append((len(x), sum(counts[1][(w,)] > 0 for w in x), total, *(sum(log10(e[k]) for e in each) for k in (0, 1))))
    return out, retained


@pytest.mark.parametrize("state,following,batch", [(2, 1, 4_000), (16, 4, 4_000), (6, 2, 32 << 20)])
def test_scores_match_a_direct_tree(spark, monkeypatch, state, following, batch):
    """Base and tree scores of every text, with NULLs, repeated rows and copies of NULL ids, in one batch and in many."""
    monkeypatch.setattr(suffix_tree, "BATCH_BYTES", batch)
    monkeypatch.setattr(suffix_tree, "STATE", state)
    monkeypatch.setattr(suffix_tree, "NEXT", following)
    rng = np.random.default_rng(4)
    rows = [(k, " ".join(w for _ in range(60) for w in (("red", "car") if rng.random() < 0.5 else ("Blue", "sky", str(rng.integers(0, 40)))))) for k in range(40)]
    rows += [(100, None), (101, ""), (None, "red car"), (7, rows[7][1]), (None, "a b c d"), (None, "a b c d"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = (docs["doc_id"] % 5 == 1).__and__(docs["doc_id"].isNotNull())
    got = suffix_tree.scores(docs, held).collect()
    want, retained = tree_scores(rows, lambda k: k is not None and k % 5 == 1, state, following)
    assert len(retained) > 3 and {len(s) for s in retained} >= {1, 2}
    key = lambda r: (str(r[0]), *(round(x, 6) for x in r[1:]))
    assert sorted(key((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"])) for r in got) == sorted(
        key((k, *w)) for (k, _), w in zip(rows, want)
    )


def test_batches_send_only_sequences_that_can_be_listed():
    """Two batches: pairs that reach the count only together are sent by both, all rarer ones by none."""
    rng = np.random.default_rng(6)
    texts = [[" ".join(["red", "car", *(f"w{k}" for k in rng.integers(0, 60, 300))]) for _ in range(3)] for _ in range(2)]
    parts, words = [], Counter()
    for b, mine in enumerate(texts):
        columns = [pa.array([b] * 3, pa.int64()), pa.array(range(3), pa.int64()), pa.array([False, False, b == 1]), pa.array(mine)]
        parts.append(suffix_tree._numbered(pa.table(columns, ["batch", "doc_id", "held_out", "text"])))
        row = parts[-1].slice(3)
        for k, n in zip(np.frombuffer(row["words"][0].as_buffer(), np.int64).tolist(), np.frombuffer(row["counts"][0].as_buffer(), np.int64).tolist()):
            words[k] += n

    def answers(part, marks=()):
        own = np.frombuffer(part.slice(3)["words"][0].as_buffer(), np.int64)
        rows = pa.table({"batch": part["batch"][0].as_py() * np.ones(len(own), int), "depth": np.zeros(len(own), np.int32), "is_state": np.zeros(len(own), bool),
                         "key": own, "n": np.asarray([words[k] for k in own.tolist()]), "listed": np.zeros(len(own), int)})
        return pa.concat_tables([suffix_tree._in_arrays(rows), suffix_tree._table(list(marks))])

    total, bits = sum(words.values()), 5
    counted = pa.concat_tables([suffix_tree._packed_counts(1, total, len(words), 2, 4, bits)(p, answers(p)) for p in parts])
    marks = [m for r in set(counted["range"].to_pylist()) for m in suffix_tree._marked(1, 4)(counted.filter(pc.equal(counted["range"], r))).to_pylist()]
    sent = [suffix_tree._gram_rows(1, total, len(words), 2, 4, bits)(p, answers(p, [m for m in marks if m["batch"] == b])) for b, p in enumerate(parts)]
    together, own = Counter(), []
    for b, mine in enumerate(texts):
        pairs = Counter()
        for k, t in enumerate(mine):
            keys, _ = suffix_tree.tokens(pa.array([t]))
            for g in suffix_tree.grams(keys, 2)[1:].view(np.int64).tolist():
                pairs[g] += not (b == 1 and k == 2)
        own.append(pairs)
        together.update(pairs)
    for got, pairs in zip(sent, own):
        assert dict(zip(got["gram"].to_pylist(), got["n"].to_pylist())) == {g: n for g, n in pairs.items() if together[g] >= 4}
    assert any(0 < n < 4 for pairs in own for g, n in pairs.items() if together[g] >= 4) and len(together) > 2 * sent[0].num_rows


def test_sequences_travel_as_arrays():
    """What two batches send of a range is added up; each is told what it holds of the listed ones, in few bytes, and one is the first."""
    rng = np.random.default_rng(7)
    all_keys = np.sort(rng.integers(0, 1 << 63, 4_000).astype(np.uint64) << np.uint64(1))
    held = [np.sort(rng.choice(all_keys, 3_000, replace=False)) for _ in range(2)]
    counts = [rng.integers(0, 5, 3_000) for _ in range(2)]
    counts[0][:9] = 70_000
    sent = [suffix_tree._rows([{"range": 5, "batch": b, "keys": suffix_tree._key_gaps(k), "n": suffix_tree._packed(n)}], suffix_tree.SENT) for b, (k, n) in enumerate(zip(held, counts))]
    assert all(x.num_rows == 1 and x.nbytes < 12 * 3_000 for x in sent)
    together, first = Counter(), {}
    for b, (k, n) in enumerate(zip(held, counts)):
        for x, y in zip(k.tolist(), n.tolist()):
            together[x] += y
            first.setdefault(x, b)
    told = suffix_tree._listed(2, 4)(pa.concat_tables(sent[::-1])).to_pylist()
    assert [(r["batch"], r["depth"], r["is_state"], r["range"]) for r in told] == [(0, 2, False, 5), (1, 2, False, 5)]
    for r, mine in zip(told, held):
        keys = suffix_tree._sorted_keys(r["keys"]).tolist()
        assert keys == [k for k in mine.tolist() if together[k] >= 4]
        assert suffix_tree._unpacked(r["n"], len(keys)).tolist() == [together[k] for k in keys]
        assert suffix_tree._unpacked(r["listed"], len(keys)).tolist() == [first[k] == r["batch"] for k in keys]
    assert suffix_tree._sorted_keys(suffix_tree._key_gaps(all_keys[:1])).tolist() == all_keys[:1].tolist()


@pytest.mark.parametrize("filler", [20, 2_000])
def test_a_passage_is_learnt_in_a_corpus_of_any_size(spark, filler):
    """A passage of 100 training texts keeps its score when the rest of the corpus grows a hundredfold."""
    passage = " ".join(f"p{k}" for k in range(40))
    rng = np.random.default_rng(5)
    rows = [(5 * k, passage) for k in range(100)] + [(1, passage)] + [(5 * k + 2, " ".join(f"f{w}" for w in rng.integers(0, 500, 200))) for k in range(filler)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_tree.scores(docs, docs["doc_id"] == 1).filter("held_out").first()
    # The first word is the root's matter; the other forty tokens follow a learnt context.
    assert got["score"] > -8 and got["base_score"] < -60


def test_scores_of_odd_rows(spark, odd_docs, no_docs):
    got = suffix_tree.scores(odd_docs, odd_docs["doc_id"].eqNullSafe(6)).collect()
    assert len(got) == odd_docs.count() and all(r["score"] <= 0 and np.isfinite(r["score"]) for r in got)
    none = suffix_tree.scores(odd_docs, odd_docs["text"].isNull() | odd_docs["text"].isNotNull()).collect()
    assert {r["train_tokens"] for r in none} == {0} and all(r["score"] == r["base_score"] and r["n_known"] == 0 for r in none)
    assert suffix_tree.scores(no_docs, no_docs["doc_id"].isNull()).count() == 0


def test_what_a_task_freed_is_given_back():
    """A worker that is kept for other tasks holds no freed pages, even below an array that still lives."""
    from tidefold.llm.common import lean

    def held():
        return int(next(x for x in open("/proc/self/status") if x.startswith("VmRSS")).split()[1]) / 1024

    def work(batches):
        arrays = [np.ones(12_000) for _ in range(2_000)]
        last.append(arrays[-1])
        yield from batches
        del arrays
        peaks.append(held())

    last, peaks = [], []
    assert list(lean(work)([1, 2])) == [1, 2]
    assert held() < peaks[0] - 100
