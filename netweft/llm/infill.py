"""Fill-in-middle documents by escaped marker injection.

A text is cut into units (code points) without a Python worker:

1. ``DELIMITER`` and ``ESCAPE`` inside the text are escaped, so that the delimiter is free to mark units;
2. one ``regexp_replace`` appends the delimiter to every unit, an escaped character being one unit;
3. counting the delimiters gives the number of units n;
4. ``substring_index`` takes the units up to a rank from the left, or from a rank to the end;
5. delimiters go, escapes are undone, and the parts are put together with the sentinels of the form.

The two cut points and the form follow from a hash of the row's id and a seed alone, so a row's result depends neither on
partitions nor on other rows. Every step is a function of one row: no shuffle, and a task holds a few copies of one text.

Defined results: null text is empty; an empty text, and one that holds a sentinel, stays as it is (form ``plain``); a null id
counts as empty in the hash; rows that repeat are separate rows with the same result; texts of any length are cut as a whole;
an empty table gives no rows; other columns are ignored unless carried. Texts are valid UTF-8.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netweft.llm.common import sha_hex

DELIMITER, ESCAPE = "\x1e", "\x1b"
ESCAPED = ((ESCAPE, ESCAPE + "e"), (DELIMITER, ESCAPE + "d"))
UNIT = f"(?s){ESCAPE}[de]|."
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def escape(text: Column) -> Column:
    """The text without a delimiter; ``unescape`` undoes it."""
    for plain, coded in ESCAPED:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPED):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def mark(text: Column) -> Column:
    """The escaped text with the delimiter after every unit."""
    return F.regexp_replace(escape(text), UNIT, "$0" + DELIMITER)


def units(marked: Column) -> Column:
    return F.length(marked) - F.length(F.replace(marked, F.lit(DELIMITER), F.lit("")))


def until(marked: Column, rank: Column) -> Column:
    """Units 1 to ``rank``, still marked between them."""
    return F.call_function("substring_index", marked, F.lit(DELIMITER), rank.cast("int"))


def last(marked: Column, count: Column) -> Column:
    """What follows the delimiter that is the ``count``-th from the right; the whole if there are fewer."""
    return F.call_function("substring_index", marked, F.lit(DELIMITER), -count.cast("int"))


def unmark(marked: Column) -> Column:
    return unescape(F.replace(marked, F.lit(DELIMITER), F.lit("")))


def _before(text: Column, sentinel: str) -> Column:
    return F.substring_index(text, sentinel, 1)


def _after(text: Column, sentinel: str) -> Column:
    return F.substring_index(text, sentinel, -1)


def restore(output: Column, form: Column) -> Column:
    """The text from output and form alone. No sentinel occurs in a part, and none can arise where a part meets one, as a
    sentinel's first character is none of its others."""
    body = F.substring(output, len(PREFIX) + 1, 2**31 - 1)
    tail = _after(body, SUFFIX)
    psm = F.concat(_before(body, SUFFIX), _after(tail, MIDDLE), _before(tail, MIDDLE))
    head = _after(body, PREFIX)
    spm = F.concat(_before(head, MIDDLE), _after(head, MIDDLE), _before(body, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def transform(docs: DataFrame, seed: int = 1, percent: int = 90, spm_percent: int = 20, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, n, form, prefix, middle, suffix (null if plain) and output, with the columns to ``carry``.

    ``percent`` of the documents are cut, and of these ``spm_percent`` are written suffix first.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    number = lambda k: F.conv(F.substring("__hash", 8 * k + 1, 8), 16, 10).cast("long")
    holds = lambda s: F.contains(F.col("text"), F.lit(s))
    rows = docs.select(*carry, "doc_id", text.alias("text"), drawn.alias("__hash")).withColumn("__marked", mark(F.col("text"))).withColumn("n", units(F.col("__marked")).cast("long"))
    plain = (F.col("n") == 0) | holds(PREFIX) | holds(SUFFIX) | holds(MIDDLE) | (number(2) % 100 >= percent)
    rows = rows.withColumn("form", F.when(plain, "plain").when(number(3) % 100 < spm_percent, "spm").otherwise("psm"))
    first, second = number(0) % (F.col("n") + 1), number(1) % (F.col("n") + 1)
    rows = rows.withColumns({"__a": F.least(first, second), "__b": F.greatest(first, second)})
    marked, cut = F.col("__marked"), F.col("form") != "plain"
    rows = rows.withColumns({
        "prefix": F.when(cut, unmark(until(marked, F.col("__a")))),
        "middle": F.when(cut, unmark(last(until(marked, F.col("__b")), F.col("__b") - F.col("__a")))),
        "suffix": F.when(cut, unmark(last(marked, F.col("n") - F.col("__b") + 1))),
    })
    parts = F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle"))
    parts = parts.when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle"))
    return rows.withColumn("output", parts.otherwise(F.col("text"))).select(*carry, "doc_id", "text", "n", "form", "prefix", "middle", "suffix", "output")


def digest(transformed: DataFrame) -> DataFrame:
    length = lambda c: F.length(c).cast("long").alias(f"{c}_chars")
    out = transformed.select("doc_id", "n", "form", length("prefix"), length("middle"), "output", restore(F.col("output"), F.col("form")).alias("restored"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha_hex(F.col("output")).alias("output_sha256"), sha_hex(F.col("restored")).alias("restored_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (SELECT doc_id, t, n, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS y,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
       WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT doc_id, t, n, form, least(x, y) AS a, greatest(x, y) - least(x, y) AS m, substring(t, 1, least(x, y)) AS pre,
  substring(t, least(x, y) + 1, greatest(x, y) - least(x, y)) AS mid, substring(t, greatest(x, y) + 1) AS suf FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN m END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p"""
