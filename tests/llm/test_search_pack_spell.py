"""Ranked search, packing and spelling variants against SQL, the library and brute force, with odd rows."""

import collections
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import brute
from conftest_llm import rows_of
from tidefold.llm import lexical_search, packing, spelling

SF = "/root/testdata/sf0.001"
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def by_sql(docs, items):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"}))
    con.register("benchmark", items.select("item_id", "text").toPandas().astype({"item_id": "Int64"}))
    result = con.execute(lexical_search.SQL)
    return [d[0] for d in result.description], sorted(result.fetchall(), key=str)


@pytest.mark.parametrize("table,block,window,cells", [("given", 1 << 18, 8 << 20, 1 << 22), ("given", 300, 1000, 50), ("odd", 1 << 18, 8 << 20, 1 << 22), ("odd", 5, 64, 1)])
def test_ranks_equal_sql(spark, odd_docs, table, block, window, cells):
    """Blocks of items, windows of texts and small score tables change nothing."""
    items = spark.createDataFrame([(1, "W1x one, SHORT short"), (2, None), (3, ""), (4, "!!"), (None, "idiot é x"), (5, "émile EMILE"), (1, "x y z"), (6, "nowhere")], "item_id long, text string")
    # Ties between repeated ids may come in any order; texts of theirs are equal.
    docs = odd_docs if table == "odd" else spark.read.parquet(f"{SF}/documents.parquet")
    items = items if table == "odd" else spark.read.parquet(f"{SF}/benchmark.parquet")
    names, want = by_sql(docs, items)
    got = lexical_search.ranked(docs, items, block=block, window=window, cells=cells).select(*names).collect()
    assert sorted(map(tuple, got), key=str) == want and want


def test_ranks_of_no_rows(spark, no_docs, odd_docs):
    items = spark.createDataFrame([(1, "short")], "item_id long, text string")
    assert lexical_search.ranked(no_docs, items).count() == 0
    assert lexical_search.ranked(odd_docs, items.limit(0)).count() == 0


def test_many_ties_end_in_order_of_ids(spark):
    docs = spark.createDataFrame([(k, "same words") for k in range(500)] + [(None, "same words")], "doc_id long, text string").repartition(7)
    got = lexical_search.ranked(docs, spark.createDataFrame([(1, "words")], "item_id long, text string")).orderBy("rank").collect()
    # Every document holds the term: its weight is floor(1000 * ln(1004 / 1003)) = 0, so nothing scores.
    assert got == []
    more = docs.unionByName(spark.createDataFrame([(1000 + k, "other") for k in range(500)], "doc_id long, text string"))
    got = lexical_search.ranked(more, spark.createDataFrame([(1, "words")], "item_id long, text string")).orderBy("rank").collect()
    assert [(r["rank"], r["doc_id"]) for r in got] == [(k + 1, k) for k in range(10)]


def checked_packs(rows, texts, size, end_id=0):
    """Rows of ``packed`` against the library's ids; returns ids of padding."""
    library = Tokenizer.from_file(BYTES)
    whole = sorted([*library.encode(t or "", add_special_tokens=False).ids, end_id] for _, t in texts)
    sequences, docs = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        assert 0 < r["length"] <= size and len(r["ids"]) == r["length"] * r["width"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        docs[r["doc_id"]].append((r["start"], r["length"], np.frombuffer(r["ids"], "<u2").tolist()))
    assert sorted(sequences) == list(range(len(sequences)))
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
        padding += size - at
    # Documents of one id may be several rows; only whole documents can be told then.
    assert sum(n for parts in docs.values() for _, n, _ in parts) == sum(map(len, whole))
    repeated = {d for d, n in collections.Counter(d for d, _ in texts).items() if n > 1}
    joined = sorted([t for _, _, ids in sorted(parts) for t in ids] for d, parts in docs.items() if d not in repeated)
    assert joined == sorted([*library.encode(t or "", add_special_tokens=False).ids, end_id] for d, t in texts if d not in repeated)
    return padding


@pytest.mark.parametrize("size", [1024, 64])
def test_packs_hold_every_id_once(spark, odd_docs, no_docs, size):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(5)
    rows = packing.packed(docs, BYTES, size=size).collect()
    assert checked_packs(rows, rows_of(docs), size) < size
    assert checked_packs(packing.packed(odd_docs, BYTES, size=size).collect(), rows_of(odd_docs), size) < size
    assert packing.packed(no_docs, BYTES).count() == 0


def test_packed_query_equals_library(spark):
    library, pieces = Tokenizer.from_file(BYTES), collections.defaultdict(list)
    for r in packing.op12(spark, SF).collect():
        pieces[r["doc_id"]].append(r)
    for doc, text in rows_of(spark.read.parquet(f"{SF}/documents.parquet")):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        at = 0
        for r in sorted(pieces[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.asarray(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)


@pytest.mark.parametrize("shape", ["even", "long", "one", "short", "large"])
def test_plans_cover_every_rank(shape):
    """Each rank of each length is in one slot, sequences are full but for the last ids, cut or not."""
    size = 32
    rng = np.random.default_rng(2)
    counts = {
        "even": rng.integers(0, 40, size + 1), "long": np.where(np.arange(size + 1) > 20, 17, 0), "one": np.where(np.arange(size + 1) == 19, 101, 0),
        "short": np.where(np.arange(size + 1) < 4, 9, 0), "large": rng.integers(0, 5 * 10**11, size + 1),
    }[shape]
    counts[0] = 0
    slots = packing.plan(counts)
    ids = int((counts * np.arange(size + 1)).sum())
    assert slots.sequences == -(-(ids - int(counts[size]) * size) // size) + int(counts[size])
    if shape == "large":
        assert len(slots.key) < size * size
        return
    filled = collections.defaultdict(list)
    for length in range(1, size + 1):
        for rank in range(int(counts[length])):
            at, n = rank, length
            while n:
                k = int(np.searchsorted(slots.key, n * packing.RANKS + at, "right")) - 1
                behind = at - int(slots.key[k] % packing.RANKS)
                filled[int(slots.sequence[k]) + behind].append((int(slots.offset[k]), int(slots.take[k])))
                at, n = int(slots.rest[k]) + behind, n - int(slots.take[k])
    assert sorted(filled) == list(range(slots.sequences))
    for parts in filled.values():
        assert [a for a, _ in sorted(parts)] == [0, *np.cumsum([n for _, n in sorted(parts)])[:-1].tolist()]
        assert sum(n for _, n in parts) <= size


def test_shortest_pack_comes_first():
    packs = packing.shortest_first(np.asarray([0, 2, 0, 1, 0, 1, 1, 0, 0, 0, 0]))  # lengths 6, 5, 3, 1, 1 into 10
    assert sorted(p.slots for p in packs) == [[(5, 0), (3, 5)], [(6, 0), (1, 6), (1, 7)]]


RUN = re.compile("[A-Za-zÀ-ÿ]+")


def words_of(rows):
    counts = collections.Counter()
    for doc, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(brute.FOLD)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 5 and len(w) >= 6}


def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a != b and len(b) - len(a) <= 1 and (a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :])


def variants_of(words):
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {w: min(xs, key=lambda x: (-words[x], x)) for w, xs in near.items() if xs}
    form = {w: x for w, x in form.items() if words[x] >= 5 * words[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), words[w], len(near[w]), words[form[w]] if w in form else None) for w in words), form


def test_variants_match_brute_force(spark):
    rng = random.Random(3)
    base = ["".join(rng.choices("abcdeéÿ", k=rng.randint(6, 11))) for _ in range(40)]
    rows = []
    for doc in range(60):
        text = []
        for word in base:
            text += [word.upper() if rng.random() < 0.2 else word] * rng.choice([0, 1, 5])
            k = rng.randrange(len(word))
            text.append(rng.choice([word[:k] + word[k + 1 :], word[:k] + "z" + word[k + 1 :], word[:k] + word[k] + word[k:], word + word[-1]]))
        rng.shuffle(text)
        rows.append((doc, rng.choice([" ", "\n", "9", "_"]).join(text), "x"))
    rows += [(None, " ".join(base), "x"), (None, None, "x"), (70, "", "x"), (71, "ÀÀÀÀÀÀÀ " * 5 + "×÷×÷×÷ " * 6 + "Ā" * 9, None), (72, "x" * 5000 + " " + ("y" * 3000 + " ") * 6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string")
    words = words_of(rows_of(docs))
    want, form = variants_of(words)
    got = spelling.variants(docs, window=500).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(tuple, got)) == want and len(form) > 5


@pytest.mark.parametrize("letters,symbols", [("ab", 1 << 20), ("ab", 60), ("ab", 8), ("abcdé", 200)])
def test_each_pair_is_accepted_once(spark, letters, symbols):
    """Also where cells are halved down to single letters and runs of a letter give one word in several ways."""
    rng = random.Random(7)
    words = sorted({"".join(rng.choices(letters, k=rng.randint(6, 12))) for _ in range(300)} | {"a" * k for k in range(6, 14)})
    rows = spark.createDataFrame([(w, 5 + k) for k, w in enumerate(words)], "word string, n long")
    got = collections.Counter((r["word"], r["near"], r["near_n"]) for r in spelling.near_words(rows, symbols).collect())
    assert got == collections.Counter((a, b, 5 + k) for a in words for k, b in enumerate(words) if one_edit(a, b))


def test_long_chains_reach_their_root(spark):
    forms = spark.createDataFrame([(f"w{k:03d}", f"w{k + 1:03d}") for k in range(70)], "word string, form string")
    assert {r["root"] for r in spelling._roots(forms).collect()} == {"w070"}


def test_variants_of_odd_rows(odd_docs, no_docs):
    assert spelling.variants(no_docs).count() == 0
    got = {r["word"] for r in spelling.variants(odd_docs).collect()}
    assert got == set(words_of(rows_of(odd_docs)))
