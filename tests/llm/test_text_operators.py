"""Text operators against brute force, exact round trips and held-out accuracy; odd rows have defined results."""

import hashlib
import re
import time
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from netweft.llm import chat, decontaminate, exact, html_text, ngram_join, pieces, pii, quality, shards, toxicity

ODD = [
    (1, "one two three four five six", "x"),
    (1, "one two three four five six", "x"),
    (2, None, None),
    (3, "", "x"),
    (4, " \t\n", "x"),
    (None, "one  two three four five six", "x"),
    (5, "mail a@b.co, 10.0.0.1 or 4111 1111 1111 1111; +49 (30) 1234-5678", "x"),
    (6, "word " * 60_000, "x"),
    (7, "ünï cödé ▁ 漢字 \U0001f600\n\nline", None),
    (8, "ONE two three four five SIX", "x"),
]
SCHEMA = "doc_id long, text string, n_words string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def rows_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.collect()]


# 1


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return 13 <= len(digits) <= 19 and total % 10 == 0


def base_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if luhn(re.sub("[ -]", "", m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def small_model(spark):
    return pii.fit(spark, per_template=100, trees=2, depth=2)


def test_pii_base_spans(odd, docs):
    tricky = "a@b.c_d@e.f x@y@z.com 1.2.3.4.5.6.7.8 999.1.1.1 +1 2345 6789- 0 \U0001f600 me@x.org 4111-1111-1111-1111"
    given = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(docs.sparkSession.createDataFrame([(-5, tricky)], "doc_id long, text string"))
    want = defaultdict(int)
    for key, text in rows_of(given):
        spans = base_spans(text)
        want[key, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest(), *(sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone"))] += 1
    got = defaultdict(int)
    for r in pii.digest(pii.find(given, model=small_model(docs.sparkSession))).collect():
        got[r["doc_id"], r["base_sha256"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] += 1
        assert r["spans"] is not None
    assert got == want


def test_pii_of_nothing(none):
    assert pii.digest(pii.find(none, model=small_model(none.sparkSession))).count() == 0


def test_pii_recall_and_precision_by_kind(spark):
    """Data and look-alikes that the test makes by its own rules, in sentences of its own."""
    import base64
    import random

    rng = random.Random(7)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda n: "".join(rng.choice("aeiouklmnprst") for _ in range(n))
    made = {
        "secret": lambda: rng.choice(['token = "%s"', "my api key: %s", "export SECRET=%s"]) % rng.choice([rng.randbytes(20).hex(), rng.randbytes(16).hex(), base64.b64encode(rng.randbytes(30)).decode()]),
        "account": lambda: rng.choice(["IBAN %s", "bank account %s", "account: %s"]) % f"DE{digits(2)} {digits(4)} {digits(4)} {digits(4)} {digits(4)} {digits(2)}",
        "phone": lambda: rng.choice(["call %s", "phone %s", "my mobile is %s"]) % rng.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}"]),
        "email": lambda: rng.choice(["mail %s", "contact: %s", "write to %s"]) % f"{word(6)} [at] {word(7)} [dot] org",
    }
    rows, want = [], {}
    for k, (kind, make) in enumerate((kind, make) for kind, make in made.items() for _ in range(40)):
        rows.append((k, f"{word(5)} {word(4)} {make()} and {word(6)}."))
        want[k] = kind
    clean = [lambda: f"{word(7)} {word(23)} {word(5)}", lambda: f"{word(4)}/{word(8)}/{word(7)}/{word(9)}", lambda: "=" * 40, lambda: f"order {digits(3)}-{digits(3)}-{digits(4)}", lambda: f"we met {word(5)} (at) {word(6)}. {word(5)}"]
    rows += [(1_000 + k, clean[k % 5]()) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.fit(spark)
    found = {r["doc_id"]: {s["kind"] for s in r["spans"]} for r in pii.find(docs, model=model).collect()}
    for kind in made:
        assert np.mean([kind in found[k] for k in want if want[k] == kind]) >= 0.9, kind
    assert np.mean([bool(found[k]) for k in found if k >= 1_000]) <= 0.05
    alone = pii.find(docs.where("doc_id = 85"), model=model).first()
    assert {s["kind"] for s in alone["spans"]} == found[85]


# 2


def check_exact(df):
    groups = defaultdict(list)
    for key, text in rows_of(df):
        groups[re.sub(r"[\x20\x09-\x0D]", "", text)].append((-len(text), key is None, key or 0, key))
    want = defaultdict(int)
    for text, members in groups.items():
        keep = min(members)[3]
        for *_, key in members:
            want[key, keep, len(members), hashlib.sha256(text.encode()).hexdigest()] += 1
    found = exact.exact_groups(df).collect()
    got = defaultdict(int)
    for r in found:
        got[r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]] += 1
    assert got == want
    assert sum(r["kept"] for r in found) == len(groups)


def test_exact_groups(odd, docs):
    check_exact(odd)
    check_exact(docs)


def test_exact_groups_of_nothing(none):
    assert exact.exact_groups(none).count() == 0


def test_trie_spills_and_gives_every_string_once():
    rng = np.random.default_rng(1)
    trie, want = exact.PatriciaTrie(lambda a, b: a + b, budget=4_000), defaultdict(int)
    for _ in range(3_000):
        s = bytes(rng.integers(97, 100, rng.integers(0, 9)).astype(np.uint8))
        want[s] += 1
        trie.insert(s, 1)
    found = list(trie.items())
    assert len(found) == len(want) and dict(found) == want


@pytest.mark.parametrize("seed", range(5))
def test_trie_keeps_what_was_spilled_below_a_later_branch(seed):
    rng = np.random.default_rng(seed)
    strings = [b"A" * 3000 + bytes(rng.integers(97, 100, 6)) for _ in range(60)]
    strings += [b"A" * int(n) + b"B" + bytes(rng.integers(97, 100, 4)) for n in np.sort(rng.integers(0, 3000, 60))[::-1]]
    strings += [strings[i] for i in rng.integers(0, len(strings), 40)]
    trie, want = exact.PatriciaTrie(lambda a, b: a + b, budget=20_000), defaultdict(int)
    for s in strings:
        trie.insert(s, 1)
        want[s] += 1
    found = list(trie.items())
    assert len(found) == len(want) and dict(found) == want


# 3 and 6


def area(score, label):
    ranks = np.argsort(np.argsort(score)) + 1
    n1 = label.sum()
    n0 = len(label) - n1
    return (ranks[label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


@pytest.mark.parametrize(("module", "label", "least"), [(toxicity, "toxic", 0.9), (quality, "quality", 0.95)])
def test_held_out_accuracy(spark, module, label, least):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    found = module.score(docs, labels)
    assert found.count() == docs.count()
    held = found.where("held_out").join(labels, "doc_id").toPandas()
    assert area(held["score"].to_numpy(), held[label].to_numpy()) >= least


def naive_slots(text):
    """Slots of character n-grams, one n-gram at a time."""
    words = "".join(c if ord(c) >= 128 or c.isalpha() else " " for c in text.lower()).split()
    padded, out = f" {' '.join(words)} " if words else "", set()
    for n in toxicity.SIZES:
        for i in range(len(padded) - n + 1):
            h = 0
            for c in padded[i : i + n]:
                h = (h * 1_000_003 + ord(c)) % 2**64
            out.add((h + n) * 0x9E3779B97F4A7C15 % 2**64 >> 64 - toxicity.BITS)
    return out


def test_toxicity_scores_of_a_fixed_model(spark, odd):
    texts = {k: t or "" for k, t, _ in ODD if t is None or len(t) < 1_000}
    weights, rng = np.zeros(1 << toxicity.BITS, np.float32), np.random.default_rng(8)
    for slots in map(naive_slots, texts.values()):
        some = sorted(slots)[::2]
        weights[some] = rng.normal(size=len(some))
    shared = spark.sparkContext.broadcast((weights, -0.3))
    for r in toxicity.add_score(odd, toxicity._score(shared), 3, 1, carry=("n_words",)).collect():
        if r["doc_id"] in texts and r["doc_id"] is not None:
            slots = naive_slots(texts[r["doc_id"]])
            assert abs(r["score"] - 1 / (1 + np.exp(0.3 - sum(float(weights[x]) for x in slots)))) < 1e-5
            assert r["n_words"] == dict((k, x) for k, _, x in ODD)[r["doc_id"]]


def test_quality_scores_of_a_fixed_machine(spark, odd):
    """All pairs one by one give what the sum-of-squares identity gives."""
    machine = quality.Machine(rank=3, seed=2)
    rng = np.random.default_rng(4)
    machine.w0, machine.w, machine.v = 0.2, rng.normal(0, 0.1, machine.w.shape), rng.normal(0, 0.3, machine.v.shape)
    machine.bounds = np.sort(rng.normal(1, 2, machine.bounds.shape), axis=1)
    want = {}
    for k, text, _ in ODD:
        columns, x = quality.features(*quality.describe(text or ""), machine.bounds)
        z = machine.w0 + float(machine.w[columns] @ x)
        for i in range(len(columns)):
            for j in range(i):
                z += float(machine.v[columns[i]] @ machine.v[columns[j]]) * x[i] * x[j]
        want[k] = 1 / (1 + np.exp(-z))
    found = quality.add_score(odd, quality._score(spark.sparkContext.broadcast(machine)), 4, 2).collect()
    assert len(found) == len(ODD) and all(abs(r["score"] - want[r["doc_id"]]) < 1e-9 for r in found)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_classifiers_take_odd_rows(spark, odd, none, module):
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(9)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    found = module.score(odd, labels).collect()
    assert len(found) == len(ODD)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in found)
    assert module.score(none, labels).count() == 0
    assert {r["predicted"] for r in module.score(odd, labels.limit(0)).collect()} == {0}


# 4


def test_matrix_has_exact_sums():
    for rows in ([5, 0, 17, 3], [1], [0, 0], [1000, 1]):
        m = shards.communication_matrix(rows, 8, 3)
        assert m.sum(axis=1).tolist() == rows
        assert m.min() >= 0 and np.ptp(m.sum(axis=0)) <= 1


def test_matrix_is_hypergeometric():
    """With 4 rows in each of 2 partitions and 2 shards, a partition sends 2 rows to shard 0 in 36 of 70 draws."""
    draws = np.array([shards.communication_matrix([4, 4], 2, s)[0, 0] for s in range(3_000)])
    assert abs((draws == 2).mean() - 36 / 70) < 0.04


@pytest.mark.parametrize("per_block", [65_536, 7])
def test_shards(docs, odd, per_block):
    for df in (docs, odd):
        found = shards.digest(shards.shuffle_to_shards(df, rows_per_block=per_block)).collect()
        slots = defaultdict(list)
        for r in found:
            slots[r["shard"]].append(r["slot"])
        assert len(found) == df.count()
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        sizes = [len(slots[s]) for s in range(8)]
        assert max(sizes) - min(sizes) <= 1
        want = defaultdict(int)
        for key, text in rows_of(df):
            want[key, len(text.encode()) + 1, zlib.crc32(text.encode()), "rows", None] += 1
        got = defaultdict(int)
        for r in found:
            got[r["doc_id"], r["size"], r["text_crc32"], r["law"], r["grown_shard"]] += 1
        assert got == want


def test_shuffle_is_uniform(spark):
    """Where a row comes from says nothing about its shard and slot."""
    n = 8_000
    df = spark.range(n, numPartitions=5).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    found = shards.shuffle_to_shards(df, rows_per_block=100).toPandas().sort_values("doc_id")
    table = np.zeros((8, 8))
    np.add.at(table, (found["doc_id"] * 8 // n, found["shard"]), 1)
    assert ((table - n / 64) ** 2 / (n / 64)).sum() < 49 + 5 * np.sqrt(98)
    assert abs(np.corrcoef(found["doc_id"], found["slot"])[0, 1]) < 5 / np.sqrt(n)
    other = shards.shuffle_to_shards(df, seed=5).toPandas().sort_values("doc_id")
    assert 0.05 < (other["shard"].to_numpy() == found["shard"].to_numpy()).mean() < 0.2


def test_shards_of_nothing(none):
    assert shards.shuffle_to_shards(none).count() == 0


# 5


def hits(text, items):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    hit, found = set(), set()
    for item, t in items:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        k = min(13, len(own))
        for w in {tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if own else ():
            for i in range(len(words) - k + 1):
                if tuple(words[i : i + k]) == w:
                    hit.update(range(i, i + k))
                    found.add(item)
    return len(words), len(hit), sorted(found)


def test_decontamination(spark, sf, odd, docs):
    items = [(9, "two THREE, four"), (10, "five six"), (10, None), (11, ""), (None, "one"), (12, "word " * 20)]
    own = spark.createDataFrame(items, "item_id long, text string")
    short = odd.where("doc_id is null or doc_id <> 6")
    for most in (4_000_000, 40):
        found = decontaminate.decontaminate(short, own, max_chars=most, carry=["doc_id", "text"]).collect()
        assert len(found) == short.count()
        for r in found:
            assert (r["n_words"], r["n_hit"], r["item_ids"]) == hits(r["text"] or "", items[:4] + items[5:])
            assert all(0 <= s["start"] < s["end"] <= len(r["text"]) for s in r["hit_spans"])
    assert decontaminate.decontaminate(odd, own.limit(0)).where("n_hit > 0").count() == 0
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    given = [(r["item_id"], r["text"]) for r in bench.collect()]
    hit = decontaminate.decontaminate(docs, bench).where("n_hit > 0").collect()
    assert hit
    for r in hit[:5]:
        assert (r["n_words"], r["n_hit"], r["item_ids"]) == hits(r["text"], given)


# 7


def test_shingles_that_share_half_a_hash_stay_apart(spark):
    """Texts without a common word, whose shingles once met in an owner and 32 bits."""
    rows = [(1, "w184 x35 y111 z398", None), (2, "w292 x383 y473 z494", None), (3, "w184 x35 y111 z398 ", None)]
    found = {r["doc_id"]: r["component_id"] for r in ngram_join.classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {1: 1, 2: 2, 3: 1}


def test_owners_compare_whole_hashes():
    """Two hashes with equal halves aren't one shingle."""
    import pickle

    one, two = np.array([5, 7 << 32 | 9], np.uint64), np.array([1 << 32 | 5, 7 << 32 | 9], np.uint64)
    counts = np.array([2], np.uint16)
    batch = ngram_join._packed([(0, 1, pickle.dumps((counts, one))), (0, 2, pickle.dumps((counts, two)))])
    out = [pickle.loads(x) for b in ngram_join._count(iter([batch])) for x in b.column(2).to_pylist()]
    assert [tokens.tolist() for _, tokens, _ in out] == [[7 << 32 | 9]] * 2


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def check_classes(df, **how):
    rows = [(k, shingles(t)) for k, t in rows_of(df)]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            both = len(a & rows[j][1])
            if both and 100 * both >= 85 * (len(a) + len(rows[j][1]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    want, got = defaultdict(int), defaultdict(int)
    for i, (k, s) in enumerate(rows):
        want[k, len(s), least.get(find(i))] += 1
    for r in ngram_join.classes(df, **how).collect():
        got[r["doc_id"], r["n_shingles"], r["component_id"]] += 1
    assert got == want


def test_ngram_join(odd, docs):
    check_classes(odd)
    check_classes(docs)


def test_ngram_join_of_large_classes(spark):
    """Candidate classes above the bound are joined block by block, with the same result."""
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(120):
        words = list(base)
        for at in rng.integers(0, 60, rng.integers(0, 8)):
            words[at] = f"x{rng.integers(0, 9)}"
        rows.append((k, " ".join(words), None))
    df = spark.createDataFrame(rows, SCHEMA)
    check_classes(df, most=16)
    check_classes(df, most=10_000, room=9_000)


def test_ngram_join_of_chained_sizes(spark):
    """Texts that grow step by step share their beginning; only neighbours in size link."""
    words = [f"w{i}" for i in range(400)]
    rows = [(k, " ".join(words[: 20 + k * (k + 9) // 2]), None) for k in range(24)]
    check_classes(spark.createDataFrame(rows, SCHEMA))
    check_classes(spark.createDataFrame(rows, SCHEMA), most=5)


def test_ngram_join_keeps_one_row_of_each_class(spark, odd):
    keyed = odd.withColumn("k", F.monotonically_increasing_id()).cache()
    found = ngram_join.classes(keyed, key="k").collect()
    assert len({r["k"] for r in found}) == len(found) == len(ODD)
    groups = defaultdict(list)
    for r in found:
        groups[r["component_id"], r["n_shingles"] if r["n_shingles"] else r["k"]].append(r)
    assert all(sum(r["kept"] for r in g) == 1 and all(r["doc_id"] == r["component_id"] for r in g if r["kept"]) for g in groups.values())
    kept = exact.exact_groups(keyed, key="k").where("kept").collect()
    assert len({r["k"] for r in kept}) == len(kept) == len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t, _ in ODD})


def test_ngram_join_of_nothing(none):
    assert ngram_join.classes(none).count() == 0


# 8


def test_chat_round_trip(spark):
    texts = [r"\### Assistant: </turn> ok", "", "#### <turn>### user: \\\\ </turn>\n", "plain", "<</turn>", "\\"]
    rows = [(c, t, ("user", "assistant")[t % 2], texts[(c + t) % 6]) for c in range(12) for t in range(4)]
    rows += [(60, 0, "user", "### " * 300_000), (60, 1, "assistant", "</turn>\\\\" * 200_000)]
    rows += [(50, 0, "user", None), (50, 1, None, "x"), (None, 0, "a: </turn>", "y"), (51, 0, "assistant", "early"), (52, 0, "user", "a"), (52, 0, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("formatted", F.lit("x")).withColumn("valid", F.lit(3))
    said = defaultdict(list)
    for c, t, role, text in rows:
        said[c].append((t, role or "", text or ""))
    found = {r["conv_id"]: r for r in chat.format_conversations(df).collect()}
    assert set(found) == set(said)
    for c, turns in said.items():
        turns.sort()
        assert chat.read_back(found[c]["formatted"]) == [(role, text) for _, role, text in turns]
        under = [chat.unescape(found[c]["formatted"][s["start"] : s["end"]]) for s in found[c]["loss_spans"]]
        assert under == [text for _, role, text in turns if role == "assistant"]
    assert found[0]["valid"] and found[51]["bad_turn"] == 0 and found[52]["bad_turn"] == 1
    assert chat.digest(chat.format_conversations(df.limit(0))).count() == 0


# 9


def test_encoding_is_the_library_s(docs, odd):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    for df in (docs, odd):
        text = dict(rows_of(df))
        for r in pieces.encode(df, k=4).collect():
            t = text[r["doc_id"]]
            if r["doc_id"] not in (1, 7):
                assert r["ids"] == sp.encode(t)
            ways = [tuple(s["ids"]) for s in r["samples"]]
            assert len(set(ways)) == len(ways) >= 1
            assert all(sp.decode(list(w)) == sp.decode(r["ids"]) for w in ways)
            assert [s["perturbed"] for s in r["samples"]] == sorted((s["perturbed"] for s in r["samples"]), reverse=True)
            assert all(s["log_inclusion"] <= 0 for s in r["samples"])


def all_ways(v, unit):
    """Every segmentation of a unit into pieces (a character without a piece: its bytes), with the log of its weight."""
    if not unit:
        return [((), 0.0)]
    out = []
    for n in range(1, len(unit) + 1):
        ids = (v.plain[unit[:n]],) if unit[:n] in v.plain else tuple(v.sp.piece_to_id(f"<0x{b:02X}>") for b in unit.encode()[: len(unit[0].encode())]) if n == 1 else None
        if ids:
            x = -sum(np.log1p(-v.sp.get_score(i)) for i in ids)
            out += [((*ids, *w), x + y) for w, y in all_ways(v, unit[n:])]
    return out


def test_units_are_those_of_the_pattern():
    texts = ["", "a  b \n\n c", " x", "\n", "  ", "a\n b\u2581c d ", "\u2581", "\n\n x\n", "\U0001f600 \u00e9\n"]
    units, index, past = pieces.cut(texts)
    for t, a, b in zip(texts, past, past[1:]):
        want = re.findall("\n| *[^ \n]+| +", " " + t.replace("\u2581", " ")) if t else []
        assert [units[i] for i in index[a:b]] == want


def test_lattice_holds_every_segmentation():
    """With k above their number all segmentations come out, with their probabilities."""
    v = pieces.Vocabulary(pieces.default_model(), 1.0)
    for text in ("the", "unrelated", "an ab", "a\n\U0001f600b", "b\u00e9\u6f22"):
        ways = dict(all_ways(v, ("\u2581" + text).replace(" ", "\u2581")))
        total = np.logaddexp.reduce(list(ways.values()))
        ((ids, found, kappa, same),) = pieces.segment(v, [text], [3], len(ways) + 1, 5)
        assert same and kappa == -np.inf and ids.tolist() == v.sp.encode(text)
        assert len(found) == len(ways) and {tuple(w.tolist()) for w, _, _ in found} == set(ways)
        assert all(abs(p - (ways[tuple(w.tolist())] - total)) < 1e-9 for w, p, _ in found)


def test_samples_are_drawn_without_replacement():
    """Frequencies of ordered pairs are p q / (1 - p), and inclusion scores weigh a sample's probabilities up to 1."""
    v = pieces.Vocabulary(pieces.default_model(), 1.0)
    text, n = "of a", 6_000
    ways = dict(all_ways(v, "\u2581of\u2581a"))
    total = np.logaddexp.reduce(list(ways.values()))
    prob = {w: np.exp(x - total) for w, x in ways.items()}
    assert len(prob) > 6
    pairs, sums = defaultdict(int), []
    for _, found, kappa, _ in pieces.segment(v, [text] * n, list(range(n)), 3, 11):
        pairs[tuple(found[0][0].tolist()), tuple(found[1][0].tolist())] += 1
        assert len({tuple(w.tolist()) for w, _, _ in found}) == 3 and kappa < found[2][2] < found[1][2] < found[0][2]
        sums.append(sum(np.exp(p - pieces.inclusion(p, kappa)) for _, p, _ in found))
    for a in prob:
        for b in prob:
            p = prob[a] * prob[b] / (1 - prob[a]) if a != b else 0.0
            assert abs(pairs[a, b] / n - p) < 5 * np.sqrt(p * (1 - p) / n) + 1e-3
    assert abs(np.mean(sums) - 1) < 5 * np.std(sums) / np.sqrt(n)


def test_samples_depend_on_the_row_alone():
    v = pieces.Vocabulary(pieces.default_model(), 1.0)
    texts, keys = ["the weather is unbelievable", "x" * 3_000, "", "one two"], [4, -1, None, 4]
    show = lambda rows: [(ids.tolist(), [(w.tolist(), p, g) for w, p, g in found], kappa, same) for ids, found, kappa, same in rows]
    together = show(pieces.segment(v, texts, keys, 3, 7))
    assert together == [show(pieces.segment(v, [t], [k], 3, 7))[0] for t, k in zip(texts, keys)]
    assert [len(found) for _, found, _, _ in together] == [3, 3, 1, 3] and all(row[3] for row in together)
    assert together != show(pieces.segment(v, texts, keys, 3, 8))


def test_decoding_is_a_round_trip(docs):
    text = dict(rows_of(docs))
    for r in pieces.decode(pieces.encode(docs, k=1)).collect():
        assert r["text"] == text[r["doc_id"]]


def test_digest_of_odd_rows(odd, none):
    found = pieces.digest(odd).collect()
    assert len(found) == len(ODD)
    assert all(r["round_trip"] for r in found if r["doc_id"] != 7)
    assert pieces.digest(none).count() == 0


# 10

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li>Home</li></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Head &amp; line</h1><p>First  <b>bold</b>
text<p>Second &#x41;</p><aside>Side</aside><form>Name</form><script>var a = "<p>no</p>";</script></article>
<section id="comments"><p>I like this very much, thank you for it</p></section><footer>Foot</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Head & line\nFirst bold text\nSecond A"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p>") == ""
    assert html_text.main_text("plain") == "plain"


def test_names_of_what_holds_the_article_do_not_drop_it():
    side = "<div class='sidebar'>Side text of the page</div>"
    for page in (
        f"<article class='post share-enabled'><p>Text one</p><p>Two</p></article>{side}",
        f"<div id='page' class='has-sidebar'><article><p>Text one</p><p>Two</p></article>{side}</div>",
        f"<div class='sidebar wide'>{side}<main class='widget'><p>Text one</p><p>Two</p><p>{'x' * 60}</p></main></div>",
        f"<article class=comments-open><header class='entry-header'>Text one</header><div><p>Two</p><div class='ad-slot'>Buy</div></div></article>{side}",
    ):
        assert html_text.main_text(page).startswith("Text one\nTwo"), page
        assert "Side" not in html_text.main_text(page) and "Buy" not in html_text.main_text(page)
    comments = "<section id='comments'><article class='comment'><p>" + "I like this very much " * 30 + "</p></article></section>"
    assert html_text.main_text(f"<article><p>Short.</p></article>{comments}") == "Short."


def test_main_text_without_named_article():
    long, rest = "word " * 40, "And a short end."
    body = f"<div><h1>Title</h1></div><div><div><p>{long}</p></div><div class='ad'>Buy</div><div><p>{long} &lt;b&gt;</p></div><div><p>{rest}</p></div></div>"
    want = "\n".join(["Title", long.strip(), long + "<b>", rest])
    menu = "<div><a href=x>Home</a></div><div><a href=y>News</a></div><div><a href=z>All</a></div><div><a href=u>More</a></div>"
    for page in (body, f"<header>Site</header><nav>Menu</nav>{body}<footer>Foot</footer>", f"<body>{menu}{body}{menu}<div class='site-footer'>Foot</div>"):
        assert html_text.main_text(page) == want
    short = "<div class=menu><a href=x>Home</a></div><p>Just this.</p>"
    assert html_text.main_text(short) == "Just this."
    big = f"<h1>Head</h1><p>{'long ' * 20_000}</p><nav>Menu</nav><p>{'tail ' * 30}</p>"
    assert html_text.main_text(big).endswith("\n" + ("tail " * 30).strip())  # however large the other region is


def test_surge_and_dive():
    sums = [0, 5, 90, 3, 0, 2, 0, 0, 100, 1]
    assert html_text.regions(sums, 86) == [(1, 4), (5, 6), (8, 10)]
    assert html_text.regions(sums, 95) == [(8, 10)]
    assert html_text.regions(sums, 101) == html_text.regions([], 1) == []


def test_teasers_and_names():
    text = "A paragraph of the text that this page is about, with some more words. "
    body = "".join(f"<p>{text * 2}{i}</p>" for i in range(4))
    want = "\n".join(f"{text * 2}{i}" for i in range(4))
    teaser = "<article class=card><h3>Another story</h3><p>Read what else there is.</p></article>"
    assert html_text.main_text(f"<main>{body}</main><div>{teaser}</div>") == want
    for name in ("js-related-posts-inline", "adsbygoogle", "newsletter-signup-form-2"):
        assert html_text.main_text(f"<article>{body}<div class='{name}'><p>Leak</p></div><p>End.</p></article>") == want + "\nEnd."
    said = "The Discussion section of this paper"
    assert html_text.main_text(f"<article>{body}<div class='discussion'><p>{said}</p></div></article>") == want + "\n" + said
    links = "".join(f"<li><a href='/{i}'>Another page {i}</a></li>" for i in range(5))
    assert html_text.main_text(f"<article>{body}<div class='post-sharing-x'><ul>{links}</ul></div></article>") == want


def test_the_curve_decides():
    """Names, roles and landmarks apart, surge and dive tell text from what stands around it; other bounds give other texts."""
    long, short = "some words of the text " * 9, "Buy this thing today"
    page = f"<div><a href=x>Home</a></div><div>{short}</div><div><div><h1>Title</h1><p>{long}</p><p>Short.</p></div></div><div>Imprint of the page</div>"
    want = f"Title\n{long.strip()}\nShort."
    assert html_text.main_text(page) == want
    assert html_text.main_text(page, surge=10) == f"{short}\n{want}\nImprint of the page"
    assert html_text.main_text(page, window=9) == f"{short}\n{want}\nImprint of the page"
    named = page.replace("<div><div><h1>", "<div><article><h1>").replace("Short.</p></div>", "Short.</p></article>")
    assert html_text.main_text(named) == want
    # an article scales weights, and no more: what surges beside it stays
    assert html_text.main_text(named.replace(short, long * 4)).startswith(long.strip())


def test_pages_without_any_name():
    """With all landmarks turned into div and without class, id and role, the curve alone finds the article."""
    import duckdb

    rows = duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet' WHERE html LIKE '%<article%'").fetchall()
    precision, recall = [], []
    for (page,) in rows:
        want = Counter(html_text.main_text(page).split())
        bare = re.sub(r"<(/?)(nav|header|footer|aside|form|section|article|main)\b[^>]*>", r"<\1div>", page)
        bare = re.sub(r"<(\w+)([^>]*?)>", lambda m: "<" + m[1] + re.sub(r"""\s(class|id|role)=("[^"]*"|'[^']*'|\S+)""", "", m[2]) + ">", bare)
        got = Counter(html_text.main_text(bare).split())
        both = sum((got & want).values())
        precision.append(both / max(1, sum(got.values())))
        recall.append(both / max(1, sum(want.values())))
    assert len(rows) > 100 and np.mean(precision) >= 0.98 and np.mean(recall) >= 0.98


@pytest.mark.parametrize("part", ["<a b ", '<p title=" ', "<div class='x", "<!-- ", "<script>x", "& < ", "<p a='b>", "</i>", "<!x "])
def test_broken_pages_take_linear_time(part):
    began = time.process_time()
    html_text.main_text(part * (1_000_000 // len(part)))
    assert time.process_time() - began < 4


class Plain(HTMLParser):
    """Brute force for pages whose article is marked: blocks inside the article element, by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.inside, self.skip, self.blocks = 0, 0, [""]

    def handle_starttag(self, tag, attributes):
        self.inside += tag == "article"
        self.skip += tag in ("script", "style", "nav", "aside", "footer", "form")
        if tag in ("p", "div", "h1", "h2", "li", "ul", "article"):
            self.blocks.append("")
        elif tag == "br" and self.inside:
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        self.skip -= tag in ("script", "style", "nav", "aside", "footer", "form")
        if tag in ("p", "div", "h1", "h2", "li", "ul", "article"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside and not self.skip:
            self.blocks[-1] += data


def test_pages_against_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").where("html like '%<article%'").collect()
    assert len(rows) > 100
    for r in rows:
        parser = Plain()
        parser.feed(r["html"])
        want = [" ".join(b.split()) for b in parser.blocks]
        assert html_text.main_text(r["html"]) == "\n".join(b for b in want if b)


def test_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    more = spark.createDataFrame([(-1, None, None), (-2, "u", ""), (-2, "u", PAGE), (None, None, "<p>" + "x" * 3_000_000)], "page_id long, url string, html string")
    found = html_text.extract(pages.select("page_id", "url", "html").unionByName(more).withColumn("text", F.lit(1)).withColumn("n_chars", F.lit(2))).collect()
    assert len(found) == pages.count() + 4 and max(r["n_chars"] for r in found) == 3_000_000
    assert all(r["n_chars"] == len(r["text"]) and "<" not in r["text"] for r in found if (r["page_id"] or -1) >= 0)
    assert html_text.extract(more.limit(0)).count() == 0
