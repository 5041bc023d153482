"""The corpus pipeline: each stage against what it must keep of its own input."""

import corpus_pipeline as c
from netweft.llm import decontaminate, toxicity
from netweft.llm.common import table


def test_stages_keep_what_they_should(spark, sf):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    for (name, stage), check in zip(c.STAGES, (toxic, exact, near, clean, encoded)):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = c.materialise(stage(spark, docs, sf), "test-stage")
        if check is not encoded:
            assert out.columns == columns
        after = {r["doc_id"] for r in out.collect()}
        assert after <= set(before)
        check(spark, sf, docs, before, after)
        docs = out
    assert sorted(r["doc_id"] for r in c.run(spark, sf).collect()) == sorted(after)


def toxic(spark, sf, docs, before, after):
    rejected = {r["doc_id"] for r in toxicity.score(docs, table(spark, sf, "labels")).where("predicted = 1").collect()}
    assert after == set(before) - rejected


def exact(spark, sf, docs, before, after):
    plain = lambda t: "".join(x for x in t or "" if x not in " \t\n\x0b\x0c\r")
    assert sorted(plain(before[k]) for k in after) == sorted({plain(t) for t in before.values()})


def near(spark, sf, docs, before, after):
    from test_text_operators import shingles

    sets = {k: shingles(t or "") for k, t in before.items()}
    link = lambda a, b: 100 * len(a & b) >= 85 * len(a | b) > 0
    kept = sorted(after)
    assert not any(link(sets[a], sets[b]) for i, a in enumerate(kept) for b in kept[:i])
    assert all(any(link(sets[k], sets[o]) for o in before if o != k) for k in set(before) - after)


def clean(spark, sf, docs, before, after):
    found = decontaminate.decontaminate(docs, table(spark, sf, "benchmark"))
    assert after == {r["doc_id"] for r in found.collect() if not (r["n_hit"] > 0 and 20 * r["n_hit"] >= r["n_words"])}


def encoded(spark, sf, docs, before, after):
    assert after == set(before)


def five_word_classes(texts):
    """Smallest id of every class of texts that five-word sets with similarity of 0.8 or more link."""
    words = {k: t.lower().split() for k, t in texts.items()}
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for k, w in words.items()}
    least = {k: k for k in texts}
    for a in sorted(texts):
        for b in sorted(texts):
            if b < a and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) > 0:
                x, y = sorted((least[a], least[b]))
                least = {k: x if v == y else v for k, v in least.items()}
    return set(least.values())


def test_near_stage_takes_five_words_and_80_percent(spark):
    w = [f"w{i}" for i in range(100)]
    texts = {
        1: w,
        2: w + [f"x{i}" for i in range(20)],  # added at the end: 96 of 116
        3: w[:45] + [f"y{i}" for i in range(6)] + w[51:],  # replaced inside: 86 of 106
        4: w + [f"z{i}" for i in range(24)],  # 96 of 120, just 0.8
        5: w + [f"v{i}" for i in range(25)],  # 96 of 121
    }
    texts = {k: " ".join(v) for k, v in texts.items()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert five_word_classes(texts) == {1, 5}
    assert {r["doc_id"] for r in c.near_stage(spark, docs, "").collect()} == {1, 5}


def test_near_stage_against_brute_force(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert {r["doc_id"] for r in c.near_stage(spark, docs, sf).collect()} == five_word_classes(texts)


def test_stages_decide_by_row(spark, sf):
    """Null and repeated ids, null and empty texts, a very long text and columns with the names that stages and operators use."""
    long = "ein langer Text über nichts " * 20_000
    rows = [
        (1, "one two three four five six seven eight nine"),
        (1, "one two three four five six seven eight nine"),
        (1, "quite another text with the same id as the first"),
        (None, "a text without an id stays as it is the only one"),
        (None, "a text without an id stays  as it is the only one"),
        (None, "one two three four five six seven eight  nine"),
        (2, None),
        (3, ""),
        (3, ""),
        (4, long),
        (5, long + "x"),
    ]
    schema = "doc_id long, text string, n_words string, n_hit int, score int, label int, row_key long, document string, kept string, row int, key string"
    docs = spark.createDataFrame([(*r, f"w{i}", i, i, i, i, "d", "k", i, "y") for i, r in enumerate(rows)], schema)
    plain = lambda t: "".join((t or "").split())

    def after(stage, df):
        out = stage(spark, df, sf)
        assert out.schema.names == docs.schema.names
        out = out.collect()
        assert all(r["n_words"] == f"w{r['n_hit']}" and r["document"] == "d" for r in out)
        return {r["n_hit"] for r in out}

    assert after(c.toxicity_stage, docs) == set(range(len(rows)))
    best = {}
    for i, (k, t) in enumerate(rows):
        best.setdefault(plain(t), []).append((-len(t or ""), k is None, k or 0, i))
    kept = after(c.exact_stage, docs)
    assert len(kept) == len(best)
    assert all([x[:3] for x in sorted(v)][0] in [x[:3] for x in v if x[3] in kept] for v in best.values())
    near = after(c.near_stage, docs)
    assert {2, 6, 7, 8, 9} <= near and len(near & {0, 1, 5}) == len(near & {3, 4}) == 1 and 5 not in near and 10 not in near
    assert after(c.decontamination_stage, docs) == set(range(len(rows)))
    assert sorted(r["doc_id"] or -1 for r in c.encoding_stage(spark, docs, sf).collect()) == sorted(k or -1 for k, _ in rows)
    for _, stage in c.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_rows_of_files_have_keys_without_a_copy(spark, tmp_path):
    """Keys of rows read from Parquet are their places; a key is found again however the table is split or filtered."""
    path = f"file://{tmp_path}/docs"
    rows = [(i % 7, f"text {i}", i) for i in range(3_000)]
    spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(5).write.parquet(path)
    docs = spark.read.parquet(path)
    keys = {r["document"]["n"]: r["row_key"] for r in c._keyed(docs, "k").collect()}
    assert len(set(keys.values())) == 3_000
    assert c._keyed(docs, "k").inputFiles() == docs.inputFiles()
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        assert {r["document"]["n"]: r["row_key"] for r in c._keyed(docs.where("n % 3 = 1"), "k").collect()} == {n: k for n, k in keys.items() if n % 3 == 1}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert set(c._keyed(docs.unionByName(docs), "k").inputFiles()).isdisjoint(docs.inputFiles())
    kept = c._kept(c._keyed(docs, "k"), c._keyed(docs, "k").select("row_key", (c.F.col("document.n") < 10).alias("kept")), "kept")
    assert sorted(r["n"] for r in kept.collect()) == list(range(10)) and docs.count() == 3_000
