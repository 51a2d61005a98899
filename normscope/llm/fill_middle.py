"""Fill-in-the-middle: texts cut at two seeded places into prefix, middle and suffix, and put together anew.

A text is a row of units: runs of ASCII letters, and single code points of any other
kind.  The cutting is relational.  Texts are dealt to parts by a digest of their row;
within its part every text's units are exploded to rows (:func:`unit_rows`), a window
gives each unit its ordinal and the code points up to its end, and the cut requests,
two a document, meet the units by ordinal (:func:`offsets`).  What comes back are two
offsets a document, by which ``substring`` cuts the text.

Texts cross the network once: both readers of the dealt table use the same exchange.
Units never do.  A part holds about ``part_bytes`` of text, whatever the table's size,
so that the units of a part can be sorted in memory; long texts are read in slices of
``slice_chars`` code points, so no array holds more units than that.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_name, materialise

#: What a unit is, for Spark and for DuckDB alike.
UNIT_PATTERN = "[A-Za-z]+|[^A-Za-z]"


@dataclass(frozen=True)
class FillSettings:
    """``plain_from``: documents whose number (0 to 99) is that or more stay plain; ``spm_below``: of the others, those below it put the suffix first.

    ``repeats``: rows of one id and text above this share of a part's rows are combined before the shuffle.
    """

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    seed: str = "1:"
    plain_from: int = 90
    spm_below: int = 20
    part_bytes: int = 8_000_000
    slice_chars: int = 262_144
    repeats: float = 0.25


def draws(key: Column, seed: str) -> list[Column]:
    """Four numbers below 2**32 of a document: the first four words of its seeded SHA-256.  A null key counts as the empty one."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def n_units(text: Column) -> Column:
    """How many units a text has: its code points, a run of letters counted once."""
    return F.char_length(F.regexp_replace(text, "[A-Za-z]+", "a")).cast("long")


def dealt_texts(rows: DataFrame, counted: DataFrame, s: FillSettings) -> DataFrame:
    """``k1``, ``k2``, ``doc (key, text)``: each different row once, dealt by its digest into parts of about ``part_bytes``.

    Rows that repeat very often, told by ``counted``, are combined before they are
    shuffled; there are at most ``1 / repeats`` such keys a part.
    """
    total = counted.agg(F.sum("copies").alias("rows"), F.sum(F.col("copies") * F.col("bytes")).alias("bytes")).first()
    parts = max(1, -(-int(total["bytes"] or 0) // s.part_bytes))
    most = max(8, int((total["rows"] or 0) / parts * s.repeats))
    hot = F.broadcast(counted.where(F.col("copies") > most).select("k1", "k2"))
    often = rows.join(hot, ["k1", "k2"], "left_semi").distinct()
    single = rows.join(hot, ["k1", "k2"], "left_anti")
    dealt = single.unionByName(often).select("k1", "k2", F.struct("key", "text").alias("doc")).repartition(parts, "k1", "k2")
    return dealt.groupBy("k1", "k2").agg(F.any_value("doc").alias("doc"))  # in place; rows of one digest are equal


def unit_rows(texts: DataFrame, slice_chars: int) -> DataFrame:
    """``k1``, ``k2``, ``ordinal`` (from 1), ``chars``: each unit, and the code points up to its end.

    A run of letters that a slice's end cuts is two rows of one ordinal, of which the later has the unit's end.
    """
    text = F.col("doc.text")

    def letter(place: Column) -> Column:
        return F.substring(text, place, F.lit(1)).rlike("^[A-Za-z]$")

    def cut(k: Column) -> Column:
        start = k * slice_chars
        goes_on = (k > 0) & letter(start) & letter(start + 1)
        return F.struct(F.substring(text, start + 1, F.lit(slice_chars)).alias("piece"), goes_on.alias("goes_on"))

    last = F.expr(f"greatest(char_length(doc.text) - 1, 0) div {slice_chars}").cast("int")
    slices = texts.select("k1", "k2", F.posexplode(F.transform(F.sequence(F.lit(0), last), cut)).alias("slice", "cut"))
    matches = F.regexp_extract_all(F.col("cut.piece"), F.lit(UNIT_PATTERN), F.lit(0))
    units = slices.select("k1", "k2", "slice", F.col("cut.goes_on").alias("goes_on"), F.posexplode(matches).alias("pos", "unit"))
    rows = units.select("k1", "k2", "slice", "pos", F.char_length("unit").alias("length"), F.when((F.col("pos") == 0) & F.col("goes_on"), 0).otherwise(1).alias("starts"))
    so_far = Window.partitionBy("k1", "k2").orderBy("slice", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select("k1", "k2", F.sum("starts").over(so_far).alias("ordinal"), F.sum("length").over(so_far).alias("chars"))


def offsets(units: DataFrame, requests: DataFrame) -> DataFrame:
    """``k1``, ``k2``, ``low_chars``, ``high_chars``: the code points before either cut, of documents that cut behind a unit.

    ``requests``: ``k1``, ``k2``, ``low`` (whether it is the first cut), ``ordinal`` of the last unit before it.  The
    ordinals are compared as a difference, so that both sides stay dealt by document.
    """
    asked = requests.withColumnsRenamed({"k1": "r1", "k2": "r2", "ordinal": "wanted"})
    met = units.join(asked, (F.col("k1") == F.col("r1")) & (F.col("k2") == F.col("r2")) & (F.col("ordinal") - F.col("wanted") == 0))
    end = F.col("chars")
    return met.groupBy("k1", "k2").agg(F.max(F.when(F.col("low"), end)).alias("low_chars"), F.max(F.when(~F.col("low"), end)).alias("high_chars"))


def rebuilt(output: Column, form: Column, s: FillSettings) -> Column:
    """The text again, from an output and its form alone.

    The parts hold no mark, and a mark begins with a character that no mark has elsewhere, so none arises where parts meet.
    """
    marks = "|".join(f"\\Q{m}\\E" for m in (s.prefix, s.suffix, s.middle))
    parts = F.split(output, marks)
    first, second, third = (F.get(parts, F.lit(k)) for k in (1, 2, 3))
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, third, second)).otherwise(F.concat(second, third, first))


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: FillSettings = FillSettings()) -> DataFrame:
    """``key``, ``n``, ``form``, ``prefix_chars``, ``middle_chars``, ``output``, ``restored`` for every row of ``docs``.

    ``n`` counts units.  ``form``: ``plain`` (the text itself) for empty texts, texts
    that hold a mark, and a share of the others; ``psm`` or ``spm`` else.
    ``restored`` is the text rebuilt from ``output`` and ``form``.  Null texts count as
    empty, null keys are drawn for like an empty key.  Equal rows have equal results,
    a row each; rows of one key and different texts are cut each for itself.  Other
    columns, whatever their names, are not read.  An empty table gives no rows.
    """
    s = settings
    own = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = own.select(*(F.xxhash64(F.lit(k), "key", "text").alias(f"k{k}") for k in (1, 2)), "key", "text")
    counted = materialise(rows.groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.max(F.octet_length("text")).alias("bytes")), "fill-rows")
    texts = dealt_texts(rows, counted, s)

    t, n = F.col("doc.text"), F.col("n")
    h1, h2, h3, h4 = draws(F.col("doc.key"), s.seed)
    marked = F.lit(False)
    for mark in (s.prefix, s.suffix, s.middle):
        marked = marked | t.contains(mark)
    form = F.when((n == 0) | marked | (h3 % 100 >= s.plain_from), "plain").when(h4 % 100 < s.spm_below, "spm").otherwise("psm")
    planned = texts.withColumn("n", n_units(t)).select("k1", "k2", "doc", "n", F.least(h1 % (n + 1), h2 % (n + 1)).alias("low"), F.greatest(h1 % (n + 1), h2 % (n + 1)).alias("high"), form.alias("form"))
    requests = planned.where(F.col("form") != "plain").select("k1", "k2", F.explode(F.array(F.struct(F.lit(True).alias("low"), F.col("low").alias("ordinal")), F.struct(F.lit(False).alias("low"), F.col("high").alias("ordinal")))).alias("cut")).select("k1", "k2", "cut.*")
    found = offsets(unit_rows(texts, s.slice_chars), requests)

    low, high = F.coalesce("low_chars", F.lit(0)).cast("int"), F.coalesce("high_chars", F.lit(0)).cast("int")
    whole = planned.join(found, ["k1", "k2"], "left").join(counted.select("k1", "k2", "copies"), ["k1", "k2"])
    parts = whole.select("doc", "n", "form", "copies", low.alias("a"), high.alias("b"))
    a, b = F.col("a"), F.col("b")
    before, between, after = F.substring(t, F.lit(1), a), F.substring(t, a + 1, b - a), F.substring(t, b + 1, F.char_length(t))
    made = F.when(F.col("form") == "plain", t).when(F.col("form") == "psm", F.concat(F.lit(s.prefix), before, F.lit(s.suffix), after, F.lit(s.middle), between)).otherwise(F.concat(F.lit(s.suffix), after, F.lit(s.prefix), before, F.lit(s.middle), between))
    cut = F.col("form") != "plain"
    copy = fresh_name(docs, "copy")
    out = parts.select(F.col("doc.key").alias(key), "n", "form", F.when(cut, a).cast("long").alias("prefix_chars"), F.when(cut, b - a).cast("long").alias("middle_chars"), made.alias("output"), "copies")
    out = out.withColumn("restored", rebuilt(F.col("output"), F.col("form"), s))
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop(copy, "copies")


def fill_report(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: FillSettings = FillSettings()) -> DataFrame:
    """The digests of :func:`fill_in_middle`'s texts: ``output_sha256`` and ``restored_sha256`` in their place."""
    made = fill_in_middle(docs, key, text, settings)
    return made.select(key, "n", "form", "prefix_chars", "middle_chars", *(F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("output", "restored")))


def oracle_sql(settings: FillSettings = FillSettings()) -> str:
    """The same over ``documents``, with lists of units instead of rows."""
    s = settings
    numbers = ", ".join(f"CAST('0x' || substr(h, {1 + 8 * k}, 8) AS BIGINT) AS h{k + 1}" for k in range(4))
    held = " OR ".join(f"contains(t, '{m}')" for m in (s.prefix, s.suffix, s.middle))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{UNIT_PATTERN}') AS u, sha256('{s.seed}' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
m AS (SELECT doc_id, t, u, len(u) AS n, {numbers} FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
  CASE WHEN n = 0 OR {held} OR h3 % 100 >= {s.plain_from} THEN 'plain' WHEN h4 % 100 < {s.spm_below} THEN 'spm' ELSE 'psm' END AS form FROM m),
p AS (SELECT *, coalesce(array_to_string(u[1:low], ''), '') AS a, coalesce(array_to_string(u[low + 1:high], ''), '') AS b, coalesce(array_to_string(u[high + 1:], ''), '') AS e FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(a) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(b) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{s.prefix}' || a || '{s.suffix}' || e || '{s.middle}' || b ELSE '{s.suffix}' || e || '{s.prefix}' || a || '{s.middle}' || b END) AS output_sha256, sha256(t) AS restored_sha256
FROM p"""
