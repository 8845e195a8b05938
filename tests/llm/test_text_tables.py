"""Near copies, decontamination and mixing against brute force, with odd rows."""

import pytest

import brute
from conftest_llm import rows_of
from tidefold.llm import decontaminate, jaccard_join, mixing
from tidefold.llm.components import components

SF = "/root/testdata/sf0.001"


def test_near_copies_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = rows_of(docs)
    want = brute.near_copies(rows)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.near_copies(docs).collect()}
    assert got == {rows[i][0]: x for i, x in want.items()}
    assert jaccard_join.one_of_each(docs).count() == len({x for x, _ in want.values()})


def test_near_copies_of_odd_rows(odd_docs, no_docs):
    rows = rows_of(odd_docs)
    got = sorted(map(str, ((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_join.near_copies(odd_docs).collect())))
    want = sorted(str((rows[i][0], c, n)) for i, (c, n) in brute.near_copies(rows).items())
    assert got == want
    kept = jaccard_join.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    # 2 and 3 are near copies of 1, one row of 10 repeats the other; the NULL ids are versions of one document.
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 4, 5, 6, 7, 8, 9, 10, 11, 12]
    assert jaccard_join.near_copies(no_docs).count() == 0 and jaccard_join.one_of_each(no_docs).count() == 0


def test_unlinked_texts_of_one_id_stay(spark):
    """Rows are dropped for their texts, whatever ids they share."""
    text = [" ".join(f"t{k}w{j}" for j in range(80)) for k in range(7)]
    near = text[5].replace("t5w20", "other")
    rows = [(None, text[0]), (None, text[1]), (None, text[2]), (None, text[2]), (3, text[3]), (3, text[4]), (3, text[4]), (4, text[5]), (3, near), (None, near), (None, None), (None, None), (5, "!"), (5, "!")]
    docs = spark.createDataFrame([(*r, "e") for r in rows], "doc_id long, text string, __row string")
    kept = jaccard_join.one_of_each(docs)
    want = [(None, text[0]), (None, text[1]), (None, text[2]), (3, text[3]), (3, text[4]), (3, near), (None, None), (None, None), (5, "!"), (5, "!")]
    assert kept.columns == docs.columns
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in kept.collect()))) == sorted(map(str, want))


def test_many_rows_of_one_id_meet_only_their_own_class(spark):
    """A third of the rows without an id, each with a near copy: one text is fetched for each class."""
    import numpy as np

    rng = np.random.default_rng(9)
    base = [[f"v{x}" for x in rng.integers(0, 100_000, 60)] for _ in range(120)]
    rows = [(None, " ".join(w)) for w in base] + [(k if k % 2 else 7, " ".join([*w[:30], "changed", *w[31:]])) for k, w in enumerate(base)] + [(k, f"alone {k}") for k in range(1000, 1120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(str, ((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_join.near_copies(docs).collect())))
    assert got == sorted(str((rows[i][0], c, n)) for i, (c, n) in brute.near_copies(rows).items())
    assert jaccard_join.one_of_each(docs).count() == 240


def test_large_group_is_compared_in_blocks(spark, monkeypatch):
    """A family cut into blocks has the same links as a whole one."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 300)
    monkeypatch.setattr(jaccard_join, "NODE_ROWS", 4)
    base = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join([*base[: i % 7], "z" + str(i), *base[i % 7 + 1 :]])) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.near_copies(rows)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.near_copies(docs).collect()}
    assert got == want


def test_components(spark):
    pairs = [(1, 2), (2, 3), (5, 4), (7, 7), (9, 3), (None, 1)] + [(k, k + 1) for k in range(100, 160)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 4: 4, 5: 4, 7: 7} | {k: 100 for k in range(100, 161)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("block", [1 << 20, 3])
def test_contamination_matches_brute_force(spark, odd_docs, no_docs, block):
    """One block or several give the same findings; short items are shorter windows."""
    text = dict(rows_of(odd_docs))
    items = [(1, " ".join(text[1].split()[5:30]).upper()), (2, "Two,  three"), (3, None), (None, "short"), (4, "!!"), (5, "idiot"), (1, "idiot"), (6, text[12])]
    found = decontaminate.contamination(odd_docs, spark.createDataFrame(items, "item_id long, text string"), block=block)
    got = sorted(map(str, ((r["doc_id"], r["__found"]["n_words"], r["__found"]["n_hit"], sorted(r["__found"]["items"])) for r in found.collect())))
    assert got == sorted(map(str, brute.contamination(rows_of(odd_docs), items)))
    assert decontaminate.contamination(no_docs, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    clean = decontaminate.contamination(odd_docs, spark.createDataFrame([], "item_id long, text string"))
    assert clean.filter("__found.n_hit > 0").count() == 0


def test_spans_are_cut_and_documents_dropped(spark, odd_docs):
    items = spark.createDataFrame([(5, "idiot"), (6, "two three")], "item_id long, text string")
    cut = decontaminate.without_spans(odd_docs, items)
    assert cut.columns == odd_docs.columns and cut.count() == odd_docs.count()
    text = {r["doc_id"]: r["text"] for r in cut.filter("doc_id = 9 or text like 'one%'").collect()}
    assert text[9].startswith("! w") and text[None] == "one "
    kept = decontaminate.without_documents(odd_docs, items)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 2


def test_decontamination_query_equals_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    query, sql = decontaminate.CHECKS["op2_decontaminate"]
    df = query(spark, SF)
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(result.fetchall())


def level_targets(sizes):
    """Targets by dealing the excess again and again, as the definition says."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3.0, 1.0, 2.0)[k % 3] for k, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(capped.values())
        target = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if target[s] > 2 * sizes[s] + 1e-9]
        if not over:
            return capped | target
        capped |= {s: 2.0 * sizes[s] for s in over}


def test_mix_reaches_its_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.copies(docs, bucket_rows=5).collect()
    again = sorted((r["doc_id"], r["copies"]) for r in mixing.copies(docs.repartition(7), bucket_rows=5).collect())
    assert sorted((r["doc_id"], r["copies"]) for r in rows) == again
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    want = level_targets(sizes)
    for source in sizes:
        own = [r for r in rows if r["source"] == source]
        assert all(abs(r["target"] - want[source]) < 1e-6 * want[source] + 1e-9 and r["source_size"] == sizes[source] for r in own)
        assert abs(sum(r["size"] * r["copies"] for r in own) - want[source]) <= max(r["size"] for r in own)
        assert all(0 <= r["copies"] <= 2 for r in own)
    assert mixing.mixed(docs).count() == sum(r["copies"] for r in mixing.copies(docs).collect())


def test_mix_of_odd_rows(odd_docs, no_docs):
    rows = mixing.copies(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {r["doc_id"]: r["size"] for r in rows}[8] == 3 and {r["doc_id"]: r["size"] for r in rows}[4] == 0
    mixed = mixing.mixed(odd_docs)
    assert mixed.columns == odd_docs.columns and mixed.count() == sum(r["copies"] for r in rows)
    assert mixing.copies(no_docs).count() == 0 and mixing.mixed(no_docs).count() == 0


def test_rows_of_no_id_fall_in_many_buckets(spark):
    """Many rows of NULL ids and equal sizes: sums still meet the targets, and every row keeps its own text."""
    rows = [(None, f"a{k} b{k} c{k}", "x", k) for k in range(300)] + [(k, f"d{k} e", "y", k) for k in range(200)] + [(None, None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _bucket long")
    got = mixing.copies(docs, bucket_rows=20).collect()
    sizes = {"x": 900, "y": 400, None: 0}
    want = level_targets(sizes)
    for source in ("x", "y"):
        assert abs(sum(r["size"] * r["copies"] for r in got if r["source"] == source) - want[source]) <= 3
    mixed = mixing.mixed(docs, bucket_rows=20)
    assert mixed.columns == docs.columns
    out = mixed.collect()
    assert len(out) == sum(r["copies"] for r in got) and {tuple(r) for r in out} <= set(rows)
    from collections import Counter

    assert set(Counter(map(tuple, out)).values()) <= {1, 2}


def test_rounding_keeps_expectations():
    import numpy as np

    rng = np.random.default_rng(3)
    size, part = rng.integers(1, 50, 40).astype(float), rng.random(40)
    total = np.zeros(40)
    for _ in range(4000):
        out, held = mixing.pivot(rng.integers(-(1 << 63), (1 << 63) - 1, 40), size, part)
        assert abs((out * size).sum() - (part * size).sum()) < 1e-6 and ((out > 0) & (out < 1)).sum() <= 1
        total += out
    assert np.abs(total / 4000 - part).max() < 0.05


def test_filters_stay_at_the_scan(spark):
    plan = decontaminate.op2(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_links_at_and_above_any_threshold():
    """Nine tenths of small sets, and a plain threshold on sets of thousands, where products of a float's ratio overflow."""
    import numpy as np
    import pyarrow as pa

    from tidefold.llm import jaccard_join as jj

    def linked(threshold, *sets):
        rows = pa.RecordBatch.from_arrays(
            [pa.array([1] * len(sets)), pa.array([False] * len(sets)), pa.array([0] * len(sets), pa.int32()), pa.array(range(len(sets)), pa.int64()),
             pa.array([1] * len(sets), pa.int64()), pa.array([np.asarray(s, np.uint64).tobytes() for s in sets], pa.binary())],
            ["group", "pair", "own", "node", "copies", "set"],
        )
        return sorted(n for out in jj._links(threshold)(iter([rows])) for n in out.column("node").to_pylist())

    assert linked(0.9, range(10), range(9)) == [0, 1]
    assert linked(0.9, range(10), range(8)) == []
    assert linked(0.8, range(5), range(4)) == [0, 1] and linked(0.8, range(5), range(3)) == []
    for threshold in (0.7, 1 / 3, 0.85):
        assert linked(threshold, range(6_000), range(5_400)) == [0, 1]
        assert linked(threshold, range(6_000), range(int(6_000 * threshold) - 1)) == []
    sizes = np.arange(2, 400)
    for top, bottom, threshold in ((4, 5, 0.8), (9, 10, 0.9), (7, 10, 0.7)):
        least = jj.least_common(sizes, threshold)
        assert (bottom * least >= top * (sizes - least)).all() and (bottom * (least - 1) < top * (sizes - least + 1)).all()


def test_links_right_at_the_threshold_are_all_found(spark):
    """700 pairs of exactly four fifths, which share no more than the threshold asks for."""
    import random

    rng = random.Random(12)
    rows = []
    for k in range(700):
        words = [f"u{rng.randrange(10**9)}" for _ in range(49)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words[:24], f"v{k}", *words[25:]]))]
    assert len(brute.shingles(rows[0][1]) & brute.shingles(rows[1][1])) * 5 == 4 * len(brute.shingles(rows[0][1]) | brute.shingles(rows[1][1]))
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (i - i % 2, 1) for i, _ in rows}
