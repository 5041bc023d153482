"""Fill-in-middle, language and vector codes against brute force; odd rows have defined results."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from netweft.llm import codes, infill, language

from tests.llm.test_text_operators import docs, none, odd  # noqa: F401


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 11


def cut_up(doc_id, text, percent=90, spm_percent=20):
    """The contract, code point by code point."""
    text, h = text or "", sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if not n or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= percent:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    form = "spm" if h4 % 100 < spm_percent else "psm"
    output = f"<P>{prefix}<S>{suffix}<M>{middle}" if form == "psm" else f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, form, a, b - a, sha(output), sha(text)


TRICKY = ["<P>a", "x<S", "<S><M>", "<<<P", "a\x1eb\x1b\x1ed\x1be\x1b", "\x1e", "\x1b", "\r\n\n\x85 ", "é\U0001f468‍\U0001f469", "$0\\1", "M>S>P><", "漢" * 5]


def test_infill_against_brute_force(spark, odd, docs):  # noqa: F811
    given = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    given = given.unionByName(spark.createDataFrame([(1000 + 50 * k + i, t) for k in range(20) for i, t in enumerate(TRICKY)], "doc_id long, text string"))
    want = Counter(cut_up(r["doc_id"], r["text"]) for r in given.collect())
    got = Counter(map(tuple, infill.digest(infill.transform(given)).collect()))
    assert got == want
    assert {k[2] for k in want} == {"plain", "psm", "spm"}


def test_infill_parts_and_columns(spark, none):  # noqa: F811
    df = spark.createDataFrame([(i, "abcdefgh"[: i % 9], f"k{i}", "m") for i in range(200)], "doc_id long, text string, n string, middle string").withColumnsRenamed({"n": "note"})
    rows = infill.transform(df, seed=7, percent=100, spm_percent=50, carry=("note",)).collect()
    assert all(r["note"] == f"k{r['doc_id']}" for r in rows)
    assert all(r["form"] == "plain" if not r["text"] else r["prefix"] + r["middle"] + r["suffix"] == r["text"] for r in rows)
    assert {r["form"] for r in infill.transform(df, percent=0).collect()} == {"plain"}
    assert infill.digest(infill.transform(none)).count() == 0


def test_marks_cut_units(spark):
    df = spark.createDataFrame([("a\x1eb\x1bc",)], "t string")
    m = infill.mark(F.col("t"))
    r = df.select(infill.units(m), infill.unmark(infill.until(m, F.lit(2))), infill.unmark(infill.last(m, F.lit(3))), infill.unmark(infill.until(m, F.lit(0))), infill.unmark(infill.last(m, F.lit(6)))).first()
    assert tuple(r) == (5, "a\x1e", "\x1bc", "", "a\x1eb\x1bc")


# 12


def context_counts(texts, order):
    out = defaultdict(Counter)
    for t in texts:
        b = bytes(order) + t.encode()
        for i in range(order, len(b)):
            for k in range(order + 1):
                out[b[i - k : i]][b[i]] += 1
    return out


def code_length(tree, text, order):
    b, total = bytes(order) + text.encode(), 0.0
    for i in range(order, len(b)):
        for k in range(order, -2, -1):
            seen = tree.get(b[i - k : i]) if k >= 0 else None
            if k < 0:
                total += 8
            elif seen:
                if b[i] in seen:
                    total -= math.log2(seen[b[i]] / (sum(seen.values()) + len(seen)))
                    break
                total -= math.log2(len(seen) / (sum(seen.values()) + len(seen)))
    return total


@pytest.mark.parametrize("contexts", [10**6, 40])
def test_code_lengths_against_brute_force(spark, contexts):
    known = [("en", "the cat sat on the mat with the hat"), ("de", "der Hut saß auf der Matte"), ("fr", "le chat à la fenêtre"), ("en", "\0\0a mat"), (None, "xx"), ("de", None)]
    df = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(known)], "doc_id long, text string, lang string")
    trees = language.fit(df, contexts=contexts, order=3, held_out=9)
    assert trees.langs == ["de", "en", "fr"]
    own = {x: context_counts([t or "" for lang, t in known if lang == x], 3) for x in trees.langs}
    for x, tree in own.items():
        first = sorted(tree, key=lambda c: (-sum(tree[c].values()), len(c), int.from_bytes(c)))[:contexts]
        own[x] = {c: tree[c] for c in first}
    texts = ["the mat", "", "Der Hut der Matte", "fenêtre ünknown \U0001f600 zzz", "\0\0\0", "a" * 5_000, "q"]
    got = language.code_lengths(trees, [t.encode() for t in texts], batch=16)
    want = [[code_length(own[x], t, 3) for x in trees.langs] for t in texts]
    assert np.allclose(got, want, rtol=1e-12)
    pieces = [list(language.pieces(t.encode(), 3, 5)) for t in texts]
    assert [b"".join(p[3:] for p in ps) for ps in pieces] == [t.encode() for t in texts]
    starts = np.cumsum([0, *map(len, pieces[3])])[:-1]
    assert np.allclose(trees.lengths(np.frombuffer(b"".join(pieces[3]), np.uint8), starts).sum(axis=0), want[3])


def test_table_finds_every_key():
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 1 << 50, 20_000))
    t = language.Table(keys)
    assert (t.find(keys) == np.arange(len(keys))).all()
    other = np.setdiff1d(rng.integers(0, 1 << 50, 20_000), keys)
    assert (t.find(other) == -1).all()


def test_held_out_languages(spark, sf):
    d = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet")
    found = language.predict(d, language.fit(d), carry=("lang", "source"))
    rows = [r for r in found.collect() if r["held_out"] and r["lang_pred"] != "und"]
    assert len(rows) > 150
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_sample_is_bounded(spark):
    df = spark.createDataFrame([(i, f"text {i % 700}", "en" if i % 3 else "de") for i in range(4_000)], "doc_id long, text string, lang string")
    got = language.sample(df.unionByName(df), 50, 4, 2).groupBy("lang").count().collect()
    assert {(r["lang"], r["count"]) for r in got} == {("en", 50), ("de", 50)}
    again = [sorted(map(tuple, language.sample(x, 50, 4, 2).collect())) for x in (df, df.repartition(5))]
    assert again[0] == again[1]


def test_language_of_odd_rows(spark, odd, none, docs):  # noqa: F811
    extra = spark.createDataFrame([(20, "12 34 !?"), (21, "\U0001f600"), (22, "ß")], "doc_id long, text string")
    trees = language.fit(docs)
    rows = language.predict(odd.select("doc_id", "text").unionByName(extra), trees).collect()
    assert len(rows) == 13
    for r in rows:
        assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 4 == 2)
        assert (r["lang_pred"] == "und") == (r["doc_id"] in (2, 3, 4, 20, 21)) and 0 <= r["score"] <= 1
    empty = none.select("doc_id", "text", F.lit(None).cast("string").alias("lang"))
    assert language.fit(empty) is None and language.predict(empty, None).count() == 0
    assert {r["lang_pred"] for r in language.predict(odd, None).collect()} == {"und"}


# 13


def brute_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(kept[0][2]) // parts
    cutup = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for *_, v in kept]
    books = [[c[p] for c in cutup[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for c in cutup:
                groups[nearest(c[p], books[p])[1]].append(c[p])
            books[p] = [tuple(sum(col) // len(groups[k]) for col in zip(*groups[k])) if k in groups else e for k, e in enumerate(books[p])]
    out, by = [], defaultdict(int)
    for (i, lab, _), c in zip(kept, cutup):
        near = [nearest(c[p], books[p]) for p in range(parts)]
        out.append((i, lab, "".join(f"{k:02x}" for _, k in near), sum(d for d, _ in near)))
        by[lab] += out[-1][3]
    sha256 = sha(",".join(str(x) for book in books for e in book for x in e))
    return Counter((i, code, err, by[lab], sha256) for i, lab, code, err in out)


@pytest.mark.parametrize(("n", "block"), [(150, 4_096), (150, 7), (20, 4_096)])
def test_codes_against_brute_force(spark, n, block):
    rng = np.random.default_rng(n)
    rows = [(int(i), int(i % 3) if i % 5 else None, [float(np.float32(x)) for x in rng.normal(size=32)]) for i in rng.permutation(n)]
    rows += [(3, 1, rows[0][2]), (3, 1, rows[0][2]), (None, 2, rows[1][2]), (-1, 0, None), (-2, 0, [None] * 32), (-3, 0, [float("nan")] * 32), (-4, None, [1.0] * 31 + [float("-inf")])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<float>, code string").repartition(4)
    assert Counter(map(tuple, codes.digest(*codes.encode(df, block_rows=block)).collect())) == brute_codes(rows)


def test_codes_of_odd_vectors(spark):
    schema = "vec_id long, label int, embedding array<float>"
    assert codes.digest(*codes.encode(spark.createDataFrame([], schema))).count() == 0
    assert codes.digest(*codes.encode(spark.createDataFrame([(1, 1, None), (2, 2, [None])], schema))).count() == 0
    one = spark.createDataFrame([(1, None, [0.5] * 16), (2, 2, [0.5] * 8), (3, 2, [])], schema)
    with pytest.raises(ValueError):
        codes.encode(one.where("vec_id = 2"))
    got = codes.digest(*codes.encode(one.where("vec_id <> 2"))).collect()
    assert [(r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got] == [(1, "00" * 16, 0, 0)]
    with pytest.raises(Exception, match="have to be below"):
        codes.digest(*codes.encode(spark.createDataFrame([(1, 1, [1e30] * 16)], schema))).collect()


def test_new_queries_match_sql(spark, sf):
    import duckdb

    from netweft.llm import queries
    from tests.test_library import TABLES, same

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name in ("op11_infill", "op13_codes"):
        got, want = queries.QUERIES[name](spark, sf).toPandas(), con.execute(queries.ORACLES[name]).df()
        order = sorted(got.columns)
        rows = [Counter(tuple(same(v) for v in r) for r in d[order].itertuples(index=False, name=None)) for d in (got, want)]
        assert rows[0] == rows[1]
