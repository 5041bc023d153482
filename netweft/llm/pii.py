"""Personal data by candidate gradient boosting, with DataFrame functions only.

Generators with high recall propose spans: the base patterns (email, ip, card, phone), loose forms of them (spelt-out
addresses, numbers without a country code) and other kinds (secrets, account and identity numbers). Proposals of different
generators may overlap. Every base match that passes its check is a span. Other candidates are scored by boosted trees from
their format and context; a candidate whose score reaches the threshold of its kind, and that overlaps no base span, is a
span too.

No table says which candidates are personal data, so the trees are fitted (MLlib) to candidates that are planted: ``EXAMPLES``
are templates of data and of look-alikes (order numbers, long words, paths, rulers, sentences), filled in by a hash of a row
number, and a candidate's label is the template that made it, not any property that a feature states. A quarter of them is held
back to calibrate: a kind's threshold is the lowest score from which on ``precision`` of the candidates held back are data (the
most precise score, if none reaches that). The model thus depends on no input and is the same for every table. The trees then
become plain CASE expressions, so scoring is a narrow projection without shuffle or Python.

Patterns use possessive forms and look-behinds that give the same leftmost matches as the plain ones in linear time. Offsets
are code points: the text is split at the matches, and lengths of pieces are added up.

Defined results: null text is empty and has no spans; repeated rows give repeated results; overlapping candidates of one
kind: the earlier one stays; very long texts are searched whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values. Leftmost non-overlapping matches are those of
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+     ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card  [0-9]([\x20-]?[0-9])+                                  phone \+[0-9][\x20().0-9-]+[0-9]
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
LOOSE = {
    "email_loose": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\[at\]|\(at\)|\{at\}) ?[A-Za-z0-9-]++(?: ?(?:\[dot\]|\(dot\)|\{dot\}|\.) ?[A-Za-z0-9-]++)++",
    "phone_loose": r"(?<![0-9+])\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{20,}+",
    "account": r"(?<![A-Za-z0-9])(?:[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?|[0-9]{3}-[0-9]{2}-[0-9]{4})(?![A-Za-z0-9])",
}
#: What a text must contain for a generator to look at it.
NEEDS = {"email": "@", "email_loose": "at"}
#: Kind of the spans that a generator proposes, in the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone", "secret", "account")
KIND_OF = {g: g.removesuffix("_loose") for g in (*BASE, *LOOSE)}
CONTEXT = {
    "key_words": r"(?i)(token|key|secret|passw|auth|bearer|api)",
    "phone_words": r"(?i)(tel|phone|call|fax|mobile|cell)",
    "mail_words": r"(?i)(mail|contact|write)",
    "card_words": r"(?i)(card|visa|account|iban|ssn|social|credit|bank)",
    "count_words": r"(?i)(order|item|part|isbn|invoice|ref|version|page|commit|model|no\\.|ticket|serial)",
}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
FEATURES = ("kind_no", "chars", "digits", "uppers", "lowers", "marks", "spaces", "hex", "switches", "distinct", "first", "words", "assigned", "quoted", "glued_before", "glued_after", *CONTEXT)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    """Whether the digits, of which there are 13 to 19, pass Luhn's check."""
    d = F.reverse(_digits(m))
    n = F.length(d)

    def add(total: Column, i: Column) -> Column:
        x = F.substring(d, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(x > 9, x - 9).otherwise(x)

    return n.between(13, 19) & (F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(19)), F.lit(1))), F.lit(0), add) % 10 == 0)


def passes(kind: str, m: Column) -> Column:
    """The contract's check of a base match."""
    if kind == "ip":
        return m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return _luhn(m)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


# What the templates are filled with, as SQL over the number ``id``: text of n random characters from place k of a hash.
HEX, BASE64 = "substr(sha2(concat('x', id), 256), {k}, {n})", "regexp_replace(substr(base64(unhex(sha2(concat('b', id), 256))), {k}, {n}), '=', 'A')"
LOWER = "translate(" + HEX + ", '0123456789abcdef', 'aeioulnrstdmpkgb')"
UPPER = "translate(upper(" + HEX + "), '89ABCDEF', 'KTRZMWQX')"
NUMBER = "translate(" + HEX + ", 'abcdef', '142857')"
FILL = {"h": HEX, "b": BASE64, "l": LOWER, "u": UPPER, "d": NUMBER}
#: Templates by generator: ({kind of characters}{number}) stands for random ones; data first, then look-alikes. Each is (text
#: before, candidate, text after); a bar parts alternatives that the hash chooses from.
EXAMPLES = {
    "secret": (
        [
            ('token = "|api_key: "|secret="|password = "|the |de |', "{h40}|{h32}|{h64}|{b40}|{b32}|{b43}", '"|" |; |, '),
            ("key=|Bearer |AWS_KEY=|auth: |access token | with |", "AK{u20}|gp_{b36}|sk-{b32}|{b22}", " |\n|.|'"),
        ],
        [
            ("the | und |in |commit |page |= |", "{l24}|{l30}|{l38}|{l20}heit|{l9}-{l8}-{l7}|{l12}-{l11}-{l9}-{l10}|{l6}/{l7}/{l5}/{l6}|{l4}/{l8}/{l9}/{l12}|{l9}/{l12}/{l8}/{l10}/{l7}|{l8}_{l7}_{l9}|{l14}_{l12}_{l13}", " |. |, |"),
            ("\n| |see |", "====================|--------------------------------|________________________|+++++++++++++++++++++", "\n| |"),
            ("see |at |path |", "{u2}{l8}{u2}{l7}{u2}{l6}|{u1}{l9}{u1}{l12}{u1}{l10}|{l5}-{d4}-{d2}-{d2}-{l6}-{l5}|{l8}/{d4}/{d2}/{l9}-{l10}|{d24}|{d32}", " |\n|, "),
        ],
    ),
    "account": (
        [("iban |account |IBAN: |konto |to |SSN |social security |", "DE{d2} {d4} {d4} {d4} {d4} {d2}|GB{d2} {u4} {d4} {d4} {d4} {d2}|FR{d20}|{d3}-{d2}-{d4}", " |, |.|\n")],
        [("part |model |order no. |item |ref |serial |version ", "{u2}{d2} {u4} {u4} {u4}|AB12{u12}|{d3}-{d2}-{d4}|XK{d2}{u16}", " |, |.|\n")],
    ),
    "phone_loose": (
        [("call |tel. |phone: |fax |at |mobile | |", "{d3}-{d3}-{d4}|({d3}) {d3}-{d4}|{d3}.{d3}.{d4}|{d3} {d3} {d4}", " |, |.|\n")],
        [("order |item no. |isbn |invoice |part |ticket |ref |version ", "{d3}-{d3}-{d4}|{d3}.{d3}.{d4}|{d3} {d3} {d4}", " |, |-{d2}|.{d2}")],
    ),
    "email_loose": (
        [("mail |contact |write to | |", "{l6} [at] {l7} [dot] com|{l4}.{l5}(at){l8}.org|{l7}{d2} {at} {l6} {dot} net|{l5} (at) {l6} (dot) de", " |, |\n")],
        [("we met |look |the |", "{l6} (at) {l5}. {u2}{l5}|{l4} (at) {l7}. {l6}|{l5} [at] {l8}. {l4}", " |, | {l4}")],
    ),
    "email": ([("mail | |", "{l6}@{l7}.com|{l4}.{l5}{d2}@{l8}.example.org", " |.|, ")], []),
    "ip": ([("from |host | |", "1{d2}.{d2}.{d2}.{d2}", " |:80|, ")], [("version |section |", "{d1}.{d1}.{d1}.{d1}", " |. ")]),
    "card": ([("card |visa |paid with |", "4{d3} {d4} {d4} {d4}|5{d15}", " |. ")], [("order |item |isbn |", "{d4} {d6}|{d13}|{d17}", " |. ")]),
    "phone": ([("call |tel. |", "+1 ({d3}) {d3}-{d4}|+49 {d3} {d7}", " |, ")], [("so |= ", "+{d1} {d2}|+{d2}.{d2}", " |. ")]),
}


def _filled(template: str, salt: int) -> Column:
    """One of the alternatives of a template, filled in."""
    import re

    def sql(one: str) -> str:
        parts, at, k = [], 0, 1 + salt % 5
        for m in re.finditer(r"\{([hblud])([0-9]+)\}", one):
            if m.start() > at:
                parts.append(one[at : m.start()])
            n = int(m[2])
            parts.append(FILL[m[1]].format(k=1 if k + n > 44 else k, n=n))
            k = 1 + (k + n) % 40
            at = m.end()
        rest = one[at:]
        literal = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"
        filled = [p if p.startswith(("substr(", "translate(", "regexp_replace(")) else literal(p) for p in parts]
        return "concat(" + ", ".join([*filled, literal(rest)]) + ")"

    ways = template.split("|")
    return F.expr(f"element_at(array({', '.join(map(sql, ways))}), cast(pmod(xxhash64(id, {salt}), {len(ways)}) + 1 as int))")


def examples(spark: SparkSession, per_template: int) -> DataFrame:
    """Planted candidates: c (as a generator would propose it), label and h, a hash of the row. Only those that the generator's
    pattern matches whole count."""
    out, salt = None, 1
    for no, g in enumerate(BASE | LOOSE):
        for label, templates in zip((1.0, 0.0), EXAMPLES[g]):
            for before, m, after in templates:
                rows = spark.range(per_template).select((F.col("id") + salt * per_template).alias("id"))
                c = F.struct(F.lit(g).alias("generator"), F.lit(no).alias("no"), _filled(m, salt).alias("m"), _filled(before, salt + 1).alias("before"), _filled(after, salt + 2).alias("after"))
                rows = rows.select(c.alias("c"), F.lit(label).alias("label"), F.xxhash64("id").alias("h"))
                pattern = (BASE | LOOSE)[g].replace(r"\G|", "")
                rows = rows.where(F.regexp_extract("c.m", pattern, 0) == F.col("c.m")) if g != "email" else rows
                out = rows if out is None else out.unionByName(rows)
                salt += 3
    return out


def features(c: Column) -> dict[str, Column]:
    """Format and context of a candidate, as numbers."""
    m, before, after = c["m"], c["before"], c["after"]
    without = lambda s: (F.length(m) - F.length(F.regexp_replace(m, s, ""))).cast("double")
    out = {
        "kind_no": c["no"].cast("double"),
        "chars": F.length(m).cast("double"),
        "digits": without("[0-9]"),
        "uppers": without("[A-Z]"),
        "lowers": without("[a-z]"),
        "marks": without("[^A-Za-z0-9 ]"),
        "spaces": without(" "),
        "hex": m.rlike("^[0-9a-f]+$").cast("double"),
        "switches": without("(?<=[A-Za-z])[0-9]|(?<=[0-9])[A-Za-z]"),
        "distinct": F.size(F.array_distinct(F.split(m, ""))).cast("double"),
        "first": F.coalesce(F.left(_digits(m), F.lit(1)).try_cast("double"), F.lit(-1.0)),
        "words": F.size(F.regexp_extract_all(m, F.lit("[a-z]{5,}"), F.lit(0))).cast("double"),
        "assigned": before.rlike(r"[=:]\s*[\"']?$").cast("double"),
        "quoted": (before.rlike("[\"']$") & after.rlike("^[\"']")).cast("double"),
        "glued_before": before.rlike("[A-Za-z0-9]$").cast("double"),
        "glued_after": after.rlike("^[A-Za-z0-9]").cast("double"),
    }
    return out | {name: before.rlike(p).cast("double") for name, p in CONTEXT.items()}


def _candidates(generator: str, no: int, pieces: Column, found: Column) -> Column:
    """Spans of the matches ``found``, given the pieces of text between them."""
    each = F.transform(found, lambda m, i: F.struct(m.alias("m"), F.get(pieces, i).alias("piece"), F.get(pieces, i + 1).alias("next")))
    empty = F.array().cast("array<struct<start:int,end:int,m:string,before:string,after:string>>")

    def add(acc: Column, e: Column) -> Column:
        start = acc["at"] + F.length(e["piece"])
        end = start + F.length(e["m"])
        span = F.struct(start.alias("start"), end.alias("end"), e["m"].alias("m"), F.right(e["piece"], F.lit(24)).alias("before"), F.left(e["next"], F.lit(2)).alias("after"))
        return F.struct(end.alias("at"), F.array_append(acc["out"], span).alias("out"))

    spans = F.aggregate(each, F.struct(F.lit(0).alias("at"), empty.alias("out")), add, lambda acc: acc["out"])
    return F.transform(spans, lambda s: F.struct(F.lit(generator).alias("generator"), F.lit(no).alias("no"), s["start"].alias("start"), s["end"].alias("end"), s["m"].alias("m"), s["before"].alias("before"), s["after"].alias("after")))


def propose(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key`` and, for each generator, an array of candidates (column c_<generator>) of every row."""
    given = docs.select(key, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    given = given.withColumn("any_digit", F.col("t").rlike("[0-9]"))
    patterns = BASE | LOOSE
    needs = {g: F.contains(F.col("t"), F.lit(NEEDS[g])) if g in NEEDS else F.lit(True) if g == "secret" else F.col("any_digit") for g in patterns}
    found = given.select("*", *[F.when(needs[g], F.regexp_extract_all("t", F.lit(p), F.lit(0))).alias(f"m_{g}") for g, p in patterns.items()])
    # Most texts have no match, so the second pass over the text is rare.
    split = found.select(key, *[c for c in found.columns if c.startswith("m_")], *[F.when(F.size(f"m_{g}") > 0, F.split("t", p, -1)).alias(f"p_{g}") for g, p in patterns.items()])
    empty = F.array().cast("array<struct<generator:string,no:int,start:int,end:int,m:string,before:string,after:string>>")
    return split.select(key, *[F.when(F.size(f"m_{g}") > 0, _candidates(g, no, F.col(f"p_{g}"), F.col(f"m_{g}"))).otherwise(empty).alias(f"c_{g}") for no, g in enumerate(patterns)])


class Model:
    """The boosted trees (weight, nested splits) and the threshold of each loose generator."""

    def __init__(self, trees: list, thresholds: dict[str, float]) -> None:
        self.trees, self.thresholds = trees, thresholds

    def score(self, c: Column) -> Column:
        """Probability that the candidate is personal data."""
        f = F.transform(F.array(F.struct(*[x.alias(n) for n, x in features(c).items()])), self._scored)
        return F.get(f, F.lit(0))

    def _scored(self, f: Column) -> Column:
        out = F.lit(0.0)
        for weight, tree in self.trees:
            out = out + F.lit(weight) * _case(f, tree)
        return 1 / (1 + F.exp(-2 * out))


def _case(f: Column, tree) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    name, threshold, left, right = tree
    return F.when(f[name] <= threshold, _case(f, left)).otherwise(_case(f, right))


def _tree(node, names: tuple[str, ...]):
    if node.subtreeDepth() == 0:
        return float(node.prediction())
    split = node.split()
    return names[split.featureIndex()], float(split.threshold()), _tree(node.leftChild(), names), _tree(node.rightChild(), names)


def fit(spark: SparkSession, per_template: int = 1_500, trees: int = 10, depth: int = 4, precision: float = 0.95) -> Model:
    """Trees and thresholds from ``per_template`` planted candidates a template."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    planted = examples(spark, per_template)
    flat = planted.select("label", "h", F.col("c.generator").alias("generator"), *[x.alias(n) for n, x in features(F.col("c")).items()])
    rows = flat.coalesce(4).cache()
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    boosted = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=5, cacheNodeIds=False).fit(vectors.where("pmod(h, 4) <> 0"))
    model = Model([(float(w), _tree(t._call_java("rootNode"), FEATURES)) for w, t in zip(boosted.treeWeights, boosted.trees)], {})
    struct = F.struct(*[F.col(n) for n in FEATURES])
    held = rows.where("pmod(h, 4) = 0").select("generator", "label", F.round(model._scored(struct), 3).alias("score"))
    bins = held.groupBy("generator", "score").agg(F.count("*").alias("n"), F.sum("label").alias("good")).collect()  # at most 1001 bins a generator
    for g in LOOSE:
        n = good = 0
        reached, best = None, (-1.0, 1.0)
        for r in sorted((r for r in bins if r["generator"] == g), key=lambda r: -r["score"]):
            n, good = n + r["n"], good + r["good"]
            if good >= precision * n:
                reached = r["score"]
            best = max(best, ((good + 1) / (n + 2), r["score"]))
        model.thresholds[g] = best[1] if reached is None else reached
    rows.unpersist()
    return model


SPAN = "array<struct<no:int,start:int,end:int,kind:string,score:double>>"


def find(docs: DataFrame, text: str = "text", key: str = "doc_id", model: Model | None = None) -> DataFrame:
    """``key``, base spans and all spans (kind number, start, end, kind, score), each in the order of kind and start."""
    model = model or fit(docs.sparkSession)
    made = propose(docs, text, key)

    def span(g: str, c: Column, score: Column) -> Column:
        kind = KIND_OF[g]
        return F.struct(F.lit(KINDS.index(kind)).alias("no"), c["start"].alias("start"), c["end"].alias("end"), F.lit(kind).alias("kind"), score.alias("score"))

    def base_of(g: str) -> Column:
        return F.transform(F.filter(f"c_{g}", lambda c: passes(g, c["m"])), lambda c: span(g, c, F.lit(1.0)))

    def loose_of(g: str) -> Column:
        return F.filter(F.transform(f"c_{g}", lambda c: span(g, c, model.score(c))), lambda s: F.round(s["score"], 3) >= model.thresholds[g])

    base = F.concat(*map(base_of, BASE)).cast(SPAN)
    more = [loose_of(g) for g in LOOSE]
    out = made.select(key, base.alias("base"), *[m.cast(SPAN).alias(f"x_{g}") for g, m in zip(LOOSE, more)])
    loose = F.concat(*[F.col(f"x_{g}") for g in LOOSE])
    clear = F.when(F.size(loose) > 0, F.filter(loose, lambda e: ~F.exists("base", lambda b: (b["start"] < e["end"]) & (e["start"] < b["end"])))).otherwise(loose)
    return out.select(key, "base", F.array_sort(F.concat("base", clear)).alias("spans"))


def redact(docs: DataFrame, spans: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key`` and the text with every span replaced by its kind in brackets; spans that overlap are merged."""

    def add(acc: Column, s: Column) -> Column:
        ahead = F.greatest(acc["at"], s["start"])
        piece = F.concat(F.substring(F.col("t"), acc["at"] + 1, F.greatest(ahead - acc["at"], F.lit(0))), F.when(s["end"] > acc["at"], F.concat(F.lit("["), s["kind"], F.lit("]"))).otherwise(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], piece).alias("out"))

    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    both = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("t")).join(spans.select(key, ordered.alias("s")), key)
    done = F.aggregate("s", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), add)
    return both.select(key, F.concat(done["out"], F.substring(F.col("t"), done["at"] + 1, F.length("t"))).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k, spans: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k, "base") for k in BASE]
    more = [count(k, "spans") for k in KINDS[4:]]
    every = F.size("spans").cast("long").alias("n_spans")
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), *more, every)
