"""Secret scans over a trigram inverted index, in DataFrame functions alone.

Every rule's regular expression is read into a Boolean trigram query: what every
match's text must hold, as ANDs and ORs of three characters in a row (letters
compared in lower case).  The index is a table of postings (trigram, document) for
the trigrams that the queries name.  Postings meet by document, which intersects
and unites them as each query says and leaves each rule's candidate documents; only
those meet its expression.  A rule without mandatory trigrams scans every document.

Spans come from splitting a text at a rule's matches: lengths of the parts
between and of the matches add up to every match's place.  Sums run over blocks of
matches, so a text's time grows with its matches, not with their square.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_name, materialise


@dataclass(frozen=True)
class Rule:
    """``group`` must have ``least`` characters for a match to count."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


def any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else re.escape(c) for c in word)


#: The three base kinds, in the order in which they are listed.
BASE_RULES = (
    Rule("assign", "(" + "|".join(map(any_case, ("password", "passwd", "secret", "token"))) + "|" + any_case("api") + "_?" + any_case("key") + ")[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    # A run that is too short holds no longer one, so the bound can stand in the expression.
    Rule("access", "AKIA[A-Z0-9]{14,}"),
    Rule("hex", "[0-9a-f]{16,}"),
)
#: Kinds that this scan adds.
MORE_RULES = (
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{10,}\\.eyJ[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE_RULES + MORE_RULES

#: A trigram query: a trigram, or ("and" | "or", its parts); None demands nothing.
Query = str | tuple[str, tuple] | None
#: More texts than this for a part of an expression, and its trigrams demand nothing by themselves.
MOST_TEXTS = 40
#: Candidates are broadcast up to this number (16 bytes each, some 40 in the join's table); more are joined by key.
MOST_BROADCAST = 500_000


def _both(kind: str, parts: list[Query]) -> Query:
    """The AND or OR of some queries, flat and without repeats."""
    if kind == "or" and (not parts or None in parts):
        return None
    flat: list[Query] = []
    for p in parts:
        for q in p[1] if isinstance(p, tuple) and p[0] == kind else [p]:
            if q is not None and q not in flat:
                flat.append(q)
    return flat[0] if len(flat) == 1 else (kind, tuple(flat)) if flat else None


def _of_texts(texts: frozenset[str]) -> Query:
    """One of some texts stands here: an OR of the ANDs of their trigrams, without those that another one covers."""
    held = sorted({tuple(dict.fromkeys(t[i : i + 3] for i in range(len(t) - 2))) for t in texts}, key=lambda x: (len(x), x))
    least = [x for k, x in enumerate(held) if not any(set(y) <= set(x) for y in held[:k])]
    return _both("or", [_both("and", list(x)) for x in least])


def _demands(items: list) -> tuple[frozenset[str] | None, Query]:
    """Of parsed items in a row: all texts that they match, in lower case, or None if too many; and what a match must hold."""
    run: frozenset[str] | None = frozenset([""])  # texts of the items since the last that has too many
    found: list[Query] = []
    whole = True
    for op, value in items:
        texts, query = _demand(op, value)
        if texts is not None and len(run) * len(texts) <= MOST_TEXTS:
            run = frozenset(a + b for a, b in product(run, texts))
            continue
        found += [_of_texts(run), query]
        run, whole = texts if texts is not None else frozenset([""]), False
    return run if whole else None, _both("and", [*found, _of_texts(run)])


def _demand(op, value) -> tuple[frozenset[str] | None, Query]:
    """The same for one parsed item."""
    if op is C.LITERAL:
        return frozenset([chr(value).lower()]), None
    if op is C.IN and all(k in (C.LITERAL, C.RANGE) for k, _ in value):
        codes = {c for k, v in value for c in ([v] if k is C.LITERAL else range(v[0], min(v[1], v[0] + 99) + 1))}
        texts = frozenset(chr(c).lower() for c in codes)
        return (texts if len(texts) <= 8 else None), None
    if op is C.SUBPATTERN:
        return _demands(list(value[3]))
    if op is C.BRANCH:
        branches = [_demands(list(b)) for b in value[1]]
        texts = frozenset().union(*(t for t, _ in branches if t is not None))
        exact = all(t is not None for t, _ in branches) and len(texts) <= MOST_TEXTS
        return (texts if exact else None), _both("or", [q if t is None else _of_texts(t) for t, q in branches])
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        least, most, inner = value
        texts, query = _demands(list(inner))
        if texts is not None and most != C.MAXREPEAT and len(texts) ** int(most) <= MOST_TEXTS:
            return frozenset("".join(p) for n in range(least, int(most) + 1) for p in product(texts, repeat=n)), None
        return None, (query if least else None)
    if op is C.AT:
        return frozenset([""]), None
    return None, None  # classes, any character and the like demand nothing


def trigram_query(rule: Rule) -> Query:
    """What every match's text holds, in lower case, derived from the rule's expression; None: no mandatory trigram."""
    return _demands(list(_parser.parse(rule.pattern)))[1]


def trigrams_of(query: Query) -> set[str]:
    return {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1])) if query else set()


def trigram_index(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings (``trigram``, ``doc``) of all trigrams that the rules' queries name, over whole texts.

    A row for each trigram that a document holds.  Null texts and keys have none.
    """
    wanted = sorted(set().union(*(trigrams_of(trigram_query(r)) for r in rules)))
    low = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("doc"), F.lower(text).alias("low"))
    held = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in wanted))) if wanted else F.array().cast("array<string>")
    return low.select("doc", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc``, ``rules`` (bit k: rule k): the rules whose trigram queries a document's postings satisfy.

    The postings of a document meet in one row, partially before the shuffle: a bit
    for each trigram.  An AND intersects postings, an OR unites them.
    """
    queries = [trigram_query(r) for r in rules]
    names = sorted(set().union(*map(trigrams_of, queries)))
    place = {t: divmod(k, 60) for k, t in enumerate(names)}
    masks = []
    for half in range(-(-len(names) // 60)):
        own = [x for t in names if place[t][0] == half for x in (F.lit(t), F.lit(1 << place[t][1]).cast("long"))]
        masks.append(F.bit_or(F.coalesce(F.create_map(*own)[F.col("trigram")], F.lit(0).cast("long"))).alias(f"m{half}"))
    if not masks:
        return index.select("doc", F.lit(0).cast("long").alias("rules")).limit(0)

    def met(query: Query) -> Column:
        if isinstance(query, str):
            half, bit = place[query]
            return F.col(f"m{half}").bitwiseAND(F.lit(1 << bit).cast("long")) != 0
        return reduce((lambda x, y: x & y) if query[0] == "and" else (lambda x, y: x | y), map(met, query[1]))

    bits = reduce(lambda x, y: x + y, [F.when(met(q), F.lit(1 << k)).otherwise(0).cast("long") for k, q in enumerate(queries) if q is not None])
    return index.groupBy("doc").agg(*masks).select("doc", bits.alias("rules")).where("rules <> 0")


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


#: Matches of a block: sums add up within blocks of this many matches, then over the blocks.
BLOCK = 64
SPAN = "struct<start:int,place:int,end:int,kind:string>"
#: In both, ``transform(array(x), v -> ..)[0]`` computes x once.  Blocks of matches, each with its length and its matches' places in it; then the blocks' own places.
_SPANS = """CASE WHEN {body} RLIKE {pattern} THEN
  transform(array(transform(array(transform(array(struct(regexp_extract_all({body}, {pattern}, 0) AS whole, split({body}, {pattern}, -1) AS gaps, regexp_extract_all({body}, {pattern}, {group}) AS held)),
    x -> transform(x.whole, (m, i) -> struct(length(x.gaps[i]) AS gap, length(m) AS size, length(x.held[i]) AS held)))[0]),
    v -> transform(sequence(0, CAST((size(v) - 1) DIV {block} AS INT)), b -> aggregate(slice(v, b * {block} + 1, {block}),
      struct(0 AS at, CAST(array() AS array<struct<start:int,end:int,held:int>>) AS found),
      (s, x) -> struct(s.at + x.gap + x.size AS at, concat(s.found, array(struct(s.at + x.gap AS start, s.at + x.gap + x.size AS end, x.held AS held))) AS found))))[0]),
    v -> flatten(zip_with(v, aggregate(v, struct(0 AS at, CAST(array() AS array<int>) AS before), (s, x) -> struct(s.at + x.at AS at, concat(s.before, array(s.at)) AS before), s -> s.before),
      (b, at) -> transform(filter(b.found, f -> f.held >= {least}), f -> struct(f.start + at AS start, {place} AS place, f.end + at AS end, {kind} AS kind)))))[0]
  ELSE CAST(array() AS array<struct<start:int,place:int,end:int,kind:string>>) END"""
#: The parts of a text between its spans, which may overlap: blocks of spans that know the last end before them; a block's parts are cut from its own stretch of the text.
_SWEPT = """CASE WHEN size({spans}) > 0 THEN array_join(concat(flatten(transform(
  transform(array(transform(sequence(0, CAST((size({spans}) - 1) DIV {block} AS INT)), b -> slice({spans}, b * {block} + 1, {block}))),
    v -> filter(zip_with(v, aggregate(v, struct(0 AS at, CAST(array() AS array<int>) AS before), (s, x) -> struct(greatest(s.at, array_max(transform(x, y -> y.end))) AS at, concat(s.before, array(s.at)) AS before), s -> s.before),
      (b, at) -> aggregate(b, struct(at AS at, CAST(array() AS array<struct<start:int,end:int>>) AS gaps),
        (s, x) -> struct(greatest(s.at, x.end) AS at, if(x.start >= s.at, concat(s.gaps, array(struct(s.at AS start, x.start AS end))), s.gaps) AS gaps), s -> s.gaps)), g -> size(g) > 0))[0],
  g -> transform(array(substring({body}, g[0].start + 1, g[size(g) - 1].end - g[0].start)), own -> transform(g, x -> substring(own, x.start - g[0].start + 1, x.end - x.start)))[0])),
  array(substring({body}, array_max(transform({spans}, x -> x.end)) + 1, length({body})))), {mark}) ELSE {body} END"""


def _spans(rule: Rule, place: int, text: str) -> Column:
    """array<struct<start, place, end, kind>> of a rule's matches in a text column, in code points."""
    body = f"coalesce({_name(text)}, '')"
    return F.expr(_SPANS.format(body=body, pattern=_literal(rule.pattern), group=rule.group, least=rule.least, place=place, kind=_literal(rule.kind), block=BLOCK))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``spans``: array of (start, place, end, kind), by start, then the rules' order.

    Null and empty texts have none.  Rows with a repeated key share their
    candidates; rows with a null key meet every rule.  A column named ``spans``
    is replaced; other columns may have any name.

    The candidates are written and counted; up to ``MOST_BROADCAST`` they are sent to
    the texts, so no text is shuffled, more of them meet the texts by key.
    """
    kept = docs.drop("spans")
    doc, mask = fresh_name(kept, "doc"), fresh_name(kept, "rules")
    found = materialise(candidates(trigram_index(kept, rules, key, text), rules), "candidates").toDF(doc, mask)
    found = F.broadcast(found) if found.count() <= MOST_BROADCAST else found
    joined = kept.join(found, F.col(key) == F.col(doc), "left")
    none = F.array().cast(f"array<{SPAN}>")
    parts = []
    for place, rule in enumerate(rules):
        spans = _spans(rule, place, text)
        if trigram_query(rule) is not None:
            candidate = (F.coalesce(F.col(mask), F.lit(0).cast("long")).bitwiseAND(F.lit(1 << place).cast("long")) != 0) | F.col(key).isNull()
            spans = F.when(candidate, spans).otherwise(none)
        parts.append(spans)
    return joined.withColumn("spans", F.array_sort(F.concat(*parts))).drop(doc, mask)


def _line(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def secret_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, counts of the base kinds, ``base_sha256`` of their spans, and ``spans`` of all kinds as text."""
    base = F.filter("spans", lambda s: s["place"] < len(BASE_RULES))

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(r.kind) for r in BASE_RULES]
    return scan(docs, rules, key, text).select(key, *counts, F.sha2(_line(base).cast("binary"), 256).alias("base_sha256"), _line(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span (overlapping ones merged) replaced by ``mark``; all columns and rows stay."""
    own = fresh_name(docs, "own_spans")
    found = scan(docs.withColumnRenamed("spans", own), rules, key, text)
    swept = found.withColumn(text, F.expr(_SWEPT.format(spans="spans", body=_name(text), mark=_literal(mark), block=BLOCK)))
    return swept.drop("spans").withColumnRenamed(own, "spans").select(*docs.columns)


def oracle_sql(rules: tuple[Rule, ...] = RULES, table: str = "documents") -> str:
    """The report in DuckDB's SQL: every rule against every text."""

    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    parts = []
    for place, r in enumerate(rules):
        p = quoted(r.pattern)
        parts.append(
            f"""SELECT doc_id, rid, {place} AS place, '{r.kind}' AS kind,
      unnest(list_transform(range(1, len(w) + 1), lambda i: {{'s': list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0), 'n': length(w[i]), 'h': length(h[i])}})) AS m
    FROM (SELECT doc_id, rid, regexp_split_to_array(t, {p}) AS g, regexp_extract_all(t, {p}, 0) AS w, regexp_extract_all(t, {p}, {r.group}) AS h FROM d) WHERE len(w) > 0"""
        )
    union = "\n  UNION ALL\n  ".join(parts)
    least = " ".join(f"WHEN {k} THEN {r.least}" for k, r in enumerate(rules))
    base = len(BASE_RULES)
    counts = ", ".join(f"coalesce(count(*) FILTER (place = {k}), 0) AS n_{r.kind}" for k, r in enumerate(BASE_RULES))
    return f"""WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM {table}),
f AS (SELECT rid, place, kind, CAST(m.s AS BIGINT) AS s, CAST(m.s + m.n AS BIGINT) AS e FROM (
  {union}
) WHERE m.h >= CASE place {least} END),
g AS (SELECT rid, {counts},
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place) FILTER (place < {base}) AS base,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place) AS spans FROM f GROUP BY rid)
SELECT doc_id, {", ".join(f"CAST(coalesce(n_{r.kind}, 0) AS BIGINT) AS n_{r.kind}" for r in BASE_RULES)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)"""
