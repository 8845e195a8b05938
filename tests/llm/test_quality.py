"""Toxicity, host rules, near-equal lines, page layout and the pipeline."""

import duckdb
import pytest

import brute
import corpus_pipeline
from conftest_llm import rows_of
from tidefold.llm import host_rules, html_layout, line_dedup, toxicity
from tidefold.llm.common import in_fold

SF = "/root/testdata/sf0.001"


def test_held_out_toxicity(spark):
    """Held-out rows of the larger table are told apart well beyond chance."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.op8(spark, "/root/testdata/sf0.1").join(labels, "doc_id").filter("held_out").collect()
    true = sum(r["predicted"] and r["toxic"] for r in rows)
    assert true / sum(r["toxic"] for r in rows) > 0.75 and true / sum(r["predicted"] for r in rows) > 0.9
    assert docs.count() > len(rows) > 500


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(9, 1), (9, 0), (1, 0), (2, None), (None, 1), (77, 1)], "doc_id long, toxic int")
    weights = toxicity.learnt(odd_docs, labels)
    scored = toxicity.scored(odd_docs, weights, name="p").collect()
    assert len(scored) == odd_docs.count() and all(0 <= r["p"] <= 1 for r in scored)
    empty = {round(r["p"], 12) for r in scored if not brute.alnum_words(r["text"])}
    assert len(empty) == 1
    kept = toxicity.without_toxic(odd_docs, labels)
    assert kept.columns == odd_docs.columns
    assert toxicity.without_toxic(no_docs, labels).count() == 0
    untrained = toxicity.learnt(odd_docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["p"] for r in toxicity.scored(odd_docs, untrained, name="p").collect()} == {0.5}


def test_passes_equal_plain_ftrl():
    """Weights after every pass against one number at a time."""
    import math

    import numpy as np

    rng = np.random.default_rng(6)
    examples = [(np.unique(np.append(rng.integers(1, 40, 12), 0)), float(rng.random() < 0.4)) for _ in range(60)]
    z, n = np.zeros(40), np.zeros(40)
    pz, pn = [0.0] * 40, [0.0] * 40

    def weight(i):
        bound = 0.0 if i == 0 else toxicity.L1
        if abs(pz[i]) <= bound:
            return 0.0
        return -(pz[i] - math.copysign(bound, pz[i])) / ((toxicity.BETA + math.sqrt(pn[i])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(3):
        toxicity.ftrl_pass(examples, z, n)
        for slots, label in examples:
            w = {int(i): weight(int(i)) for i in slots}
            g = 1 / (1 + math.exp(-sum(w.values()))) - label
            for i in w:
                step = (math.sqrt(pn[i] + g * g) - math.sqrt(pn[i])) / toxicity.ALPHA
                pz[i] += g - step * w[i]
                pn[i] += g * g
        assert np.allclose(z, pz) and np.allclose(n, pn) and np.allclose(toxicity.weights_of(z, n), [weight(i) for i in range(40)])


def test_scores_are_the_sum_of_the_weights(spark):
    """The score of a text from its distinct words, neighbours and skip-grams, one by one."""
    import math

    import numpy as np
    import pyarrow as pa

    from tidefold.llm import bytewords as bw

    weights = np.random.default_rng(7).normal(0, 1, 1 << toxicity.BITS).astype(np.float32)
    texts = ["one two three two one", "", None, "a", "A b C a B c " * 50]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, weights).collect()}

    def slot(*words, salt=0):
        keys = [bw.split(pa.array([w]), bw.ALNUM).key[0] for w in words]
        h = keys[0] if len(keys) == 1 else bw.mix(np.asarray([keys[0]]) * bw.STEP + np.asarray([keys[1]]) + np.uint64(salt))[0]
        return max(1, int(h >> np.uint64(64 - toxicity.BITS)))

    for k, t in enumerate(texts):
        w = brute.alnum_words(t)
        slots = {slot(x) for x in w} | {slot(a, b, salt=1) for a, b in zip(w, w[1:])} | {slot(a, b, salt=2) for a, b in zip(w, w[2:])}
        assert got[k] == pytest.approx(1 / (1 + math.exp(-(sum(float(weights[i]) for i in slots) + float(weights[0])))), rel=1e-6)


def test_sample_is_bounded_and_counts_a_text_once(spark):
    rows = [(k % 50, f"text {k % 50}") for k in range(400)] + [(None, "text 1")] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(None, 1)], "doc_id long, toxic int")
    every = toxicity.sample_of(docs, labels).collect()
    import zlib

    assert sorted(r["text"] for r in every) == sorted(f"text {k}" for k in range(50) if zlib.crc32(str(k).encode()) % 4 != 2)
    some = toxicity.sample_of(docs, labels, 7).collect()
    assert sorted(r["key"] for r in some) == sorted(r["key"] for r in every)[:7]
    plan = toxicity.sample_of(docs, labels, 7)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan


def test_folds(spark):
    import zlib

    df = spark.createDataFrame([(k,) for k in range(50)] + [(None,)], "doc_id long")
    got = {r[0]: r[1] for r in df.select("doc_id", in_fold(df["doc_id"], 4, 2)).collect()}
    assert got == {k: zlib.crc32(str(k).encode()) % 4 == 2 for k in range(50)} | {None: False}


@pytest.mark.parametrize("table", ["given", "odd"])
def test_host_rules_equal_sql(spark, odd_docs, table):
    con = duckdb.connect()
    docs = spark.read.parquet(f"{SF}/documents.parquet") if table == "given" else odd_docs.dropDuplicates(["doc_id"]).filter("doc_id is not null")
    frame = docs.select("doc_id", "text", "source").toPandas().astype({"doc_id": "int64"})
    con.register("documents", frame)
    result = con.execute(host_rules.SQL)
    names = [d[0] for d in result.description]
    assert sorted(map(tuple, host_rules.judged(docs).select(*names).collect())) == sorted(result.fetchall())


def test_bad_hosts_are_rejected(spark, no_docs):
    rows = [(k, "word " * 3, "bad") for k in range(60)] + [(100 + k, " ".join(f"w{k}v{j}" for j in range(30)), "good") for k in range(60)]
    rows += [(200, " ".join(f"q{j}" for j in range(30)), "bad"), (201, "short", "good"), (202, None, None), (203, " ".join(f"r{j}" for j in range(30)), None)]
    got = {r["doc_id"]: r for r in host_rules.judged(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not got[200]["base_failed"] and not got[200]["kept"] and got[100]["kept"] and not got[201]["kept"]
    assert host_rules.judged(no_docs).count() == 0


def test_repeated_windows_by_hand(spark):
    eight = " ".join("abcdefgh")
    texts = [(1, f"{eight} x {eight}"), (2, eight), (3, " ".join(["z"] * 20)), (4, f"{eight} {eight} i {eight}"), (5, "a\nb\n\na \na\n \n")]
    got = {r["doc_id"]: (r["n_repeat_words"], r["n_dup_lines"]) for r in host_rules.measured(spark.createDataFrame([(*t, "s") for t in texts], "doc_id long, text string, source string")).collect()}
    assert got == {1: (16, 0), 2: (0, 0), 3: (20, 0), 4: (24, 0), 5: (0, 1)}


def line_components(rows):
    lines = {}
    for doc, text in rows:
        for no, line in enumerate((text or "").split("\n")):
            if brute.SPACED.search(line):
                lines.setdefault(line.lower(), []).append((doc, no))
    n = line_dedup.SHINGLE
    sets = {x: {(" " + x)[k : k + n] for k in range(len(x) + 2 - n)} or {x} for x in lines}
    root = {x: x for x in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    names = sorted(lines)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if len(sets[a] & sets[b]) >= line_dedup.SIMILAR * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    out = {}
    for x, places in lines.items():
        out.setdefault(find(x), []).extend(places)
    return out


def test_lines_match_brute_force(spark):
    long = [" ".join(f"token{(k * j) % 53}" for j in range(1, 40)) for k in range(1, 6)]
    rows = [(k, "\n".join([long[k % 5].replace("token7 ", f"token{k} "), "Same line", "", f"only {k}"])) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.line_classes(docs).collect()
    want = line_components(rows)
    classes = {}
    for r in got:
        classes.setdefault(r["class_id"], []).append((r["doc_id"], r["line_no"]))
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, want.values()))
    assert sorted((r["doc_id"], r["line_no"]) for r in got if r["kept"]) == sorted(min(x) for x in want.values())
    assert all(r["class_lines"] == len(classes[r["class_id"]]) for r in got)


def line_groups(spark, rows):
    """(classes found, classes by brute force), each as sorted places."""
    classes = {}
    for r in line_dedup.line_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        classes.setdefault(r["class_id"], []).append((r["doc_id"], r["line_no"]))
    return sorted(map(sorted, classes.values())), sorted(map(sorted, line_components(rows).values()))


@pytest.mark.parametrize("block", [1_024, 3])
def test_lines_near_a_center_are_compared_too(spark, monkeypatch, block):
    """Variants near the hub and not near each other are one component, whatever the center."""
    import random

    monkeypatch.setattr(line_dedup, "BLOCK_KEYS", block)
    rng = random.Random(4)
    rows = []
    for group in range(15):
        hub = " ".join("".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(20))[:120].strip()
        places = range(8, 104, 8)
        rows += [(group * 100 + k, x) for k, x in enumerate([hub, *(hub[:p] + "Z" + hub[p + 1 :] for p in places)])]
    got, want = line_groups(spark, rows)
    assert len(want) == 15 and got == want


def test_lines_of_other_sizes_are_not_compared(spark, monkeypatch):
    """Lines that share their words with a center but are far longer are told apart by their sizes, before any set is made."""
    from pyspark.sql import functions as F

    compared = []
    whole = line_dedup.verified

    def seen(pairs, texts):
        compared.append(pairs.count())
        return whole(pairs, texts)

    monkeypatch.setattr(line_dedup, "verified", seen)
    monkeypatch.setattr(line_dedup, "signature", lambda line: F.struct(F.size(line_dedup.shingles(line)).alias("size"), F.array(F.lit(1)).alias("bands")))
    words = [f"word{k}" for k in range(90)]
    rows = [(k, " ".join(words[:n])) for k, n in enumerate((10, 11, 30, 32, 90))]
    got, want = line_groups(spark, rows)
    assert got == want and len(want) == 3 and sum(compared) <= 4


def test_lines_without_spaces_meet(spark):
    """Long tokens, tabs, other scripts and lines of one to three words, changed near their start."""
    import random

    rng = random.Random(5)
    han = [chr(0x4E00 + k) for k in range(2000)]
    rows = []
    for k in range(60):
        word = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789/-", k=120))
        tabs = "\t".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(17))
        three = word[:40] + " " + word[40:80] + " " + tabs[:40].replace("\t", "x")
        for j, line in enumerate([word, tabs, "".join(rng.choices(han, k=120)), three]):
            rows += [(k * 100 + j * 10, line), (k * 100 + j * 10 + 1, line[: k % 8] + "Q" + line[k % 8 + 1 :])]
    got, want = line_groups(spark, rows)
    assert len(want) == 240 and len(got) <= 242 and got != [[p] for x in want for p in x]


def test_lines_of_odd_rows(odd_docs, no_docs):
    got = line_dedup.line_classes(odd_docs).collect()
    assert len(got) == sum(bool(brute.SPACED.search(x)) for _, t in rows_of(odd_docs) for x in (t or "").split("\n"))
    assert [r["kept"] for r in got if r["doc_id"] == 10] == [True, True] and {r["kept"] for r in got if r["doc_id"] in (2, 3)} == {False}
    assert line_dedup.line_classes(no_docs).count() == 0


def test_lines_stay_native(spark):
    for query in (line_dedup.near_lines, host_rules.measured):
        plan = query(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


PAGES = [
    ("<p>a<p>b", "a\n\nb"), ("<ul><li>x<li>y<ol><li>z</ol></ul>", "- x\n- y\n  1. z"), ("a<br>b &amp; c", "a\nb & c"), ("<div>a</div>b<div>c</div>", "a\nb\nc"),
    ("<table><tr><th>Name<th>N<tr><td>a<td>10<tr><td>long<td>2<br>3</table>", "Name | N\na    | 10\nlong | 2\n     | 3"),
    ("<title>t</title><script>if (a<b) '</p>'</script><style>x</style>seen<!-- not --><p hidden>no</p>", "seen"),
    ("<div style='display: NONE'>a<p>b</div>c", "c"), ("<i style='visibility:hidden'>a<b style='visibility:visible'>b</b></i>c", "bc"),
    ("<pre>  two\n    four</pre>", "  two\n    four"), ("x <b>y</b> z", "x y z"), ("<td>stray</td></table></b>text", "straytext"), ("a < b > c", "a < b > c"), ("", ""), (None, ""),
    ("<a title='>'>q</a>", "q"), ("<details><summary>s</summary>hidden</details>t", "s\nt"), ("<dl><dt>a<dd>b<dt>c<dd>d</dl>", "a\n  b\nc\n  d"),
    ("<table><td>1<table><td>in<td>ner</table><td>2</table>", "1        | 2\n         |\nin | ner |"), ("<p>x<ul><li>i</ul>y", "x\n\n- i\n\ny"),
]


def test_pages(spark):
    rows = [(k, html, "u") for k, (html, _) in enumerate(PAGES)] + [(None, "<p>z", None), (0, "<p>a<p>b", "u")]
    docs = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = sorted((str(r["page_id"]), r["text"]) for r in html_layout.rendered(docs).collect())
    assert got == sorted([(str(k), text) for k, (_, text) in enumerate(PAGES)] + [("None", "z"), ("0", "a\n\nb")])
    assert html_layout.rendered(docs.limit(0)).count() == 0


def test_broken_and_deep_pages_end(spark):
    for html in ("<" * 5000, "<div>" * 20_000 + "x", "<table><td>" * 500 + "x", "<p a='" + "b" * 5000, "<!--" + "x" * 5000, "</" * 3000, "<li>" * 3000 + "y"):
        assert isinstance(html_layout.visible_text(html), str)
    assert html_layout.visible_text("<div>" * 20_000 + "x") == "x"


SPANS = [
    ("<table><tr><td colspan=2>wide<td>c<tr><td>a<td>b<td>c</table>", "wide  | c\na | b | c"),
    ("<table><tr><td rowspan=2>r<td>x<tr><td>y</table>", "r | x\n  | y"),
    ("<table><tr><td>a<td rowspan=0>b<td>c<tr><td>d<td>e<tr><td colspan=3>a very long cell indeed<tr><td colspan=1000>z</table>", "a | b | c\nd |   | e\na very long cell indeed\nz"),
    ("<table><tr><th colspan=2>head<tr><td>1<td>22<tr><td colspan='x'>3<td colspan=-1>4</table>", "head\n1 | 22\n3 | 4"),
    ("<table><tr><td rowspan=3 colspan=2>big<td>1<tr><td>2<tr><td>3<tr><td>l<td>m<td>n</table>", "big   | 1\n      | 2\n      | 3\nl | m | n"),
    ("<table><tr><td>1<br>2<td rowspan=2>x<br>y<br>z<tr><td>3</table>", "1 | x\n2 | y\n  | z\n3 |"),
]


@pytest.mark.parametrize("html,text", SPANS)
def test_spans_take_their_columns_and_rows(html, text):
    assert html_layout.visible_text(html) == text


@pytest.mark.parametrize("piece", ["<ul><li>a", "<blockquote>a", "<a ", "<! ", "</ ", '<a "', "<table><td>a", "<ol><li>", "<li>a", "<div>a", "<!--x>", "<![CDATA[x>"])
def test_pages_of_one_repeated_piece_are_linear(piece):
    """Some hundred kilobytes in a few seconds, and no output beyond the stated indent."""
    import time

    html = piece * (300_000 // len(piece))
    begun = time.process_time()
    text = html_layout.visible_text(html)
    assert time.process_time() - begun < 10
    assert len(text) <= len(html) * (html_layout.INDENT + 8)
    assert max(map(len, text.split("\n"))) < 300_001


def test_what_never_ends_is_told_from_text():
    assert html_layout.visible_text("a<b>c</b> d < e <!-- f > g") == "ac d < e"
    assert html_layout.visible_text("a<p>x <![CDATA[1 < 2 > y") == "a\n\nx 1 < 2 > y"
    assert html_layout.visible_text("<p>a <unfinished b") == "a <unfinished b"


def test_deep_lists_stop_indenting():
    lines = html_layout.visible_text("<ul><li>a" * 100).split("\n")
    assert lines[0] == "- a" and lines[5] == " " * 10 + "- a" and len(lines) == 100 and lines[-1] == " " * html_layout.INDENT + "- a"


def test_all_text_of_the_given_pages_is_kept(spark):
    import re
    from html import unescape

    for row in spark.read.parquet(f"{SF}/pages.parquet").limit(200).collect():
        bare = re.sub(r"(?s)<!--.*?-->|<(script|style|title)\b.*?</\1>|<[^>]*>", " ", row["html"])
        assert re.findall(r"\w+", unescape(bare)) == re.findall(r"\w+", re.sub(r"(?m)^ *\d+\. ", "", html_layout.visible_text(row["html"])))


def test_pipeline_stages(spark):
    """Each stage against its definition on the stage's own input; toxic, copied and leaked rows are gone."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "decontamination", "mixing", "token_files"]
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(corpus_pipeline.store(stage(spark, seen[-1], SF)))
    assert all(d.columns == columns for d in seen[:5])
    assert 0 < seen[1].count() < seen[0].count()
    classes = brute.near_copies(rows_of(seen[1]))
    assert sorted(r["doc_id"] for r in seen[2].collect()) == sorted({c for c, _ in classes.values()})
    hits = {doc: n for doc, _, n, _ in brute.contamination(rows_of(seen[2]), items)}
    assert sorted(r["doc_id"] for r in seen[3].collect()) == sorted(d for d, n in hits.items() if not n)
    import zlib
    from collections import Counter

    import numpy as np
    from tokenizers import Tokenizer

    from tidefold.llm import mixing, token_files

    taken = {r["doc_id"]: r["copies"] for r in mixing.copies(seen[3]).collect()}
    assert Counter(r["doc_id"] for r in seen[4].collect()) == Counter({k: n for k, n in taken.items() if n})
    library, text = Tokenizer.from_file(token_files.default_tokenizer()), dict(rows_of(seen[4]))
    start = 0
    for r in sorted(seen[5].collect(), key=lambda r: r["start"]):
        ids = library.encode(text[r["doc_id"]] or "", add_special_tokens=False).ids + [1]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()))
        start += len(ids)
    assert seen[5].count() == seen[4].count()


def test_pipeline_of_no_rows(spark, no_docs):
    docs = no_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_only_wanted_lines_are_fetched_and_sketches_rule_out_no_link(spark):
    """Before any text is compared: lines that share no bucket do not travel, and a sketch never excludes a near pair."""
    import random

    from pyspark.sql import functions as F

    rng = random.Random(6)
    base = ["".join(rng.choices("abcdefgh é漢", k=n)) for n in (5, 12, 40, 120, 400, 900, 2500) for _ in range(6)]
    lines = base + [x[: len(x) // 2] + "Q" + x[len(x) // 2 + 1 :] for x in base] + [x + x[: len(x) // 9] for x in base] + [x * 3 for x in base]
    df = spark.createDataFrame(list(enumerate(lines)), "key long, line string")
    met = line_dedup.among(df, df.filter("key % 50 = 0").select("key"))
    assert {0, 50, 100, 150} <= {r["key"] for r in met.collect()} and met.count() < 8
    n = line_dedup.SHINGLE
    sets = [{(" " + x)[k : k + n] for k in range(len(x) + 2 - n)} or {x} for x in lines]
    known = line_dedup.sketches(df)
    assert {r["key"]: r["size"] for r in known.collect()} == {k: len(x) for k, x in enumerate(sets)}
    l, r = known.alias("l"), known.alias("r")
    pairs = l.join(r, F.col("l.key") < F.col("r.key")).filter(line_dedup.possible("l", "r")).select(F.col("l.key").alias("a"), F.col("r.key").alias("b"))
    hopeful = {tuple(x) for x in pairs.collect()}
    near = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert near and near <= hopeful and len(hopeful) < 4 * len(near)
    assert {tuple(x) for x in line_dedup.verified(pairs, known).collect()} == near
