"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells (source, language, topic) with a token count each.
Raking scales what is taken of the cells until the sums over sources, languages and
topics have the targets' shares; a cell cannot give more than it holds, so every
step of the raking is bounded by that, and what a full cell cannot give the others
of its source, language and topic do.  Each cell's documents are then sampled with
one probability.  The targets win over the budget: where a value's target is more
than the table can give, the sample gets smaller.

Tables of documents carry no topic; unless a column has that name, the register
that the whole text is written in stands in for it, told by the share of digits, of
marks and of line ends.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_name, materialise

DIMENSIONS = ("source", "lang", "topic")
#: ASCII characters that are neither letters, digits, white space nor the marks of plain prose.
MARKS = "!\"#$%&()*+/<=>@[\\]^_`{|}~"


@dataclass(frozen=True)
class Mix:
    """``temper``: without explicit targets, a margin's target is its own shares to this power, made to sum to one,
    where no value's target is more than it holds of the budget.

    ``budget``: share of all tokens to keep, at most.  ``rounds``: of raking, at most.
    ``settled``: relative change of a round below which raking ends.
    ``most_cells``: more cells than this are raked by Spark, not in the driver, in the same steps.
    """

    temper: float = 0.7
    budget: float = 0.8
    rounds: int = 60
    settled: float = 1e-10
    most_cells: int = 200_000


def topic_of(text: Column) -> Column:
    body = F.coalesce(text, F.lit(""))
    size = F.greatest(F.length(body), F.lit(1))
    digits = F.length(body) - F.length(F.translate(body, "0123456789", ""))
    marks = F.length(body) - F.length(F.translate(body, MARKS, ""))
    lines = F.length(body) - F.length(F.translate(body, "\n", ""))
    return F.when(digits * 20 >= size, "figures").when(marks * 20 >= size, "marks").when(lines * 60 >= size, "lines").otherwise("prose")


def token_count(text: Column) -> Column:
    """Words: runs of anything but ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def lottery(key: Column) -> Column:
    """A number in [0, 1) that depends on the key alone."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, the three dimensions (null: empty string), ``n_tokens`` of each whole text."""
    topic = F.col("topic") if "topic" in docs.columns else topic_of(F.col(text))
    return docs.select(key, *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in DIMENSIONS[:2]), F.coalesce(topic, F.lit("")).alias("topic"), token_count(F.col(text)).alias("n_tokens"))


FILLS = 8  # steps in which tempered targets settle under their bounds, at most


def tempered(shares: pd.Series, mix: Mix) -> pd.Series:
    """Shares to the power ``temper``, none above its own share of the budget; what is cut off goes to the others."""
    raised, most = shares**mix.temper, shares / mix.budget
    full = pd.Series(False, index=shares.index)
    for _ in range(FILLS):
        scale = (1.0 - most[full].sum()) / raised[~full].sum() if not full.all() else 0.0
        full |= raised * scale >= most
    return most.where(full, raised * ((1.0 - most[full].sum()) / raised[~full].sum() if not full.all() else 0.0))


def _goals(cells: pd.DataFrame, mix: Mix, targets: dict[str, dict[str, float]] | None) -> tuple[dict[str, pd.Series], float]:
    """Each dimension's tokens by value, and the sample's size in tokens: the budget, or less where a target asks for more than there is."""
    total = float(cells["tokens"].sum())
    shares, size = {}, mix.budget * total
    for d in DIMENSIONS:
        held = cells.groupby(d)["tokens"].sum().astype(float)
        if targets and d in targets:
            wanted = pd.Series(targets[d], dtype=float)
            shares[d] = (wanted / wanted.sum()).reindex(held.index).fillna(0.0)
            asked = shares[d] > 0
            size = min(size, float((held[asked] / shares[d][asked]).min())) if asked.any() else 0.0
        else:
            shares[d] = tempered(held / total, mix)
    return {d: s * size for d, s in shares.items()}, size


def rake(cells: pd.DataFrame, goals: dict[str, pd.Series], mix: Mix) -> np.ndarray:
    """Tokens taken of each cell: scaled to one margin's goals after the other, never more than the cell holds."""
    held = cells["tokens"].to_numpy(dtype=np.float64)
    taken = held.copy()
    codes = {d: cells[d].astype("category").cat for d in goals}
    for _ in range(mix.rounds):
        before = taken
        for d, goal in goals.items():
            code, names = codes[d].codes, codes[d].categories
            sums = np.bincount(code, weights=taken, minlength=len(names))
            want = goal.reindex(names).fillna(0.0).to_numpy()
            taken = np.minimum(held, taken * np.divide(want, sums, out=np.zeros_like(sums), where=sums > 0)[code])
        if (np.abs(taken - before) <= mix.settled * held).all():
            break
    return taken


def fitted_cells(measures: DataFrame, mix: Mix = Mix(), targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """The cells with ``tokens``, ``weight`` (share of the sample's tokens) and ``probability``.

    ``targets``: shares by value for some of the dimensions; the others are
    tempered.  A target for a value that the table lacks is unreachable: the other
    values keep their proportions.  Cells without tokens have weight zero and
    probability one (there is nothing to balance).  Values without a target get none
    of the mix.
    """
    spark = measures.sparkSession
    cells = measures.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens"))
    schema = "source string, lang string, topic string, tokens long, weight double, probability double"
    cells = materialise(cells, "cells")
    if cells.count() > mix.most_cells:
        return _fitted_by_spark(cells, mix, targets)
    frame = cells.toPandas().sort_values(list(DIMENSIONS), kind="stable").reset_index(drop=True)
    filled = (frame["tokens"] > 0).to_numpy()
    out = frame.assign(weight=0.0, probability=1.0)
    if filled.any():
        own = frame[filled].reset_index(drop=True)
        goals, _ = _goals(own, mix, _present(own, targets))
        taken = rake(own, goals, mix)
        out.loc[filled, "weight"] = taken / taken.sum() if taken.sum() > 0 else 0.0
        out.loc[filled, "probability"] = taken / own["tokens"].to_numpy()
    return _from_frame(spark, out.astype({"tokens": "int64"}), schema) if len(out) else spark.createDataFrame([], schema)


def _from_frame(spark: SparkSession, frame: pd.DataFrame, schema: str) -> DataFrame:
    """A small frame by way of Arrow: rows of Python objects would start Python processes on the executors to be read, which then idle there."""
    return spark.createDataFrame(pa.Table.from_pandas(frame, preserve_index=False), schema)


def _present(cells: pd.DataFrame, targets: dict[str, dict[str, float]] | None) -> dict[str, dict[str, float]] | None:
    """The targets of values that the cells have."""
    return {d: {k: v for k, v in t.items() if k in set(cells[d])} for d, t in targets.items()} if targets else targets


def _fitted_by_spark(cells: DataFrame, mix: Mix, targets: dict[str, dict[str, float]] | None) -> DataFrame:
    """The same steps where the cells themselves are many: margins by Spark, a written table after each round.

    A margin's values are brought to the driver for its goals, so one dimension may
    have at most ``most_cells`` values, the three together any number of cells.
    """
    state = materialise(cells.where("tokens > 0").withColumn("taken", F.col("tokens").cast("double")), "cells")
    total = float(state.agg(F.sum("tokens")).first()[0])
    size, shares = mix.budget * total, {}
    for d in DIMENSIONS:
        sums = state.groupBy(d).agg(F.sum("tokens").alias("tokens")).limit(mix.most_cells + 1).toPandas()
        if len(sums) > mix.most_cells:
            raise ValueError(f"{d} has more than {mix.most_cells} values")
        own = sums.assign(**{x: "" for x in DIMENSIONS if x != d})
        goals, bound = _goals(own, mix, _present(own, {k: v for k, v in (targets or {}).items() if k == d}))
        shares[d] = goals[d] / bound if bound else goals[d]
        size = min(size, bound)
    goals = {d: F.broadcast(_from_frame(state.sparkSession, pd.DataFrame(sorted(shares[d].items()), columns=[d, "goal"]).assign(goal=lambda f: f["goal"].astype(float) * size), f"{d} string, goal double")) for d in DIMENSIONS}
    for _ in range(mix.rounds):
        before = state
        moved = state.withColumnRenamed("taken", "was").withColumn("taken", F.col("was"))
        for d in DIMENSIONS:
            sums = moved.groupBy(d).agg(F.sum("taken").alias("sum")).join(goals[d], d)
            factor = F.broadcast(sums.select(d, F.when(F.col("sum") > 0, F.col("goal") / F.col("sum")).otherwise(0.0).alias("factor")))
            moved = materialise(moved.join(factor, d).withColumn("taken", F.least(F.col("tokens").cast("double"), F.col("taken") * F.col("factor"))).select(*DIMENSIONS, "tokens", "was", "taken"), "cells")
        state = moved.drop("was")
        if not moved.where(F.abs(F.col("taken") - F.col("was")) > mix.settled * F.col("tokens")).head(1):
            break
    kept = state.agg(F.sum("taken")).first()[0]
    fitted = state.select(*DIMENSIONS, "tokens", (F.col("taken") / F.lit(kept or 1.0)).alias("weight"), (F.col("taken") / F.col("tokens")).alias("probability"))
    empty = cells.where("coalesce(tokens, 0) = 0").select(*DIMENSIONS, "tokens", F.lit(0.0).alias("weight"), F.lit(1.0).alias("probability"))
    return fitted.unionByName(empty)


def departures(cells: DataFrame, mix: Mix = Mix(), targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """``dimension``, ``value``, ``target``, ``share``, ``departure``: how far each value's share of the sample lies from its target, for fitted ``cells``.

    The sample's size is bounded margin by margin; targets that only fail together, as
    where a value's tokens all lie in another value's cells, are missed, and this is where it shows.
    """
    rows: list[tuple[str, str, float, float, float]] = []
    for d in DIMENSIONS:
        held = cells.where("tokens > 0").groupBy(d).agg(F.sum("tokens").alias("tokens"), F.sum("weight").alias("weight")).limit(mix.most_cells + 1).toPandas()
        if len(held) > mix.most_cells:
            raise ValueError(f"{d} has more than {mix.most_cells} values")
        if not len(held):
            continue
        own = held.assign(**{x: "" for x in DIMENSIONS if x != d})
        goals, size = _goals(own, mix, _present(own, {k: v for k, v in (targets or {}).items() if k == d}))
        wanted = goals[d] / size if size else goals[d]
        rows += [(d, value, float(wanted[value]), float(share), float(share - wanted[value])) for value, share in sorted(zip(held[d], held["weight"], strict=True))]
    return cells.sparkSession.createDataFrame(rows, "dimension string, value string, target double, share double, departure double")


def mixture(docs: DataFrame, mix: Mix = Mix(), targets: dict[str, dict[str, float]] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, dimensions, ``n_tokens``, ``probability`` and ``kept``.

    A document is kept if its lottery number is below its cell's probability, so
    repeated keys share one fate and the choice is the same in every run.  Null
    keys draw as the empty text does.
    """
    measures = materialise(measured(docs, key, text), "measures")
    cells = fitted_cells(measures, mix, targets)
    chances = cells.select(*DIMENSIONS, "probability")
    joined = measures.join(F.broadcast(chances) if cells.count() <= mix.most_cells else chances, list(DIMENSIONS))
    return joined.select(key, *DIMENSIONS, "n_tokens", F.round("probability", 6).alias("probability"), (lottery(F.col(key)) < F.round("probability", 6)).alias("kept"))


def sample_documents(docs: DataFrame, mix: Mix = Mix(), targets: dict[str, dict[str, float]] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The sampled documents, with their own columns only, whatever their names.

    Up to ``most_cells`` cells are sent to the texts, so none is shuffled; more are joined by key.
    """
    measures = materialise(measured(docs, key, text), "measures")
    cells = fitted_cells(measures, mix, targets)
    topic = F.col("topic") if "topic" in docs.columns else topic_of(F.col(text))
    own = [fresh_name(docs, f"own_{d}") for d in DIMENSIONS]
    chance = fresh_name(docs, "chance")
    values = [F.coalesce(c.cast("string"), F.lit("")) for c in (F.col("source"), F.col("lang"), topic)]
    chances = cells.select(*(F.col(d).alias(o) for d, o in zip(DIMENSIONS, own, strict=True)), F.round("probability", 6).alias(chance))
    chances = F.broadcast(chances) if cells.count() <= mix.most_cells else chances
    named = docs.select("*", *(v.alias(o) for v, o in zip(values, own, strict=True)))
    return named.join(chances, own).where(lottery(F.col(key)) < F.col(chance)).select(*docs.columns)


def oracle_sql(mix: Mix = Mix(), table: str = "documents") -> str:
    """:func:`mixture` with tempered targets in DuckDB's SQL: one step of the raking after the other."""
    marks = MARKS.replace("'", "''")
    steps = [
        f"""m AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
  CASE WHEN (n - length(translate(t, '0123456789', ''))) * 20 >= greatest(n, 1) THEN 'figures'
       WHEN (n - length(translate(t, '{marks}', ''))) * 20 >= greatest(n, 1) THEN 'marks'
       WHEN (n - length(translate(t, chr(10), ''))) * 60 >= greatest(n, 1) THEN 'lines' ELSE 'prose' END AS topic,
  CAST(len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens
  FROM (SELECT *, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM {table}))""",
        "c AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM m GROUP BY ALL)",
        "w0 AS MATERIALIZED (SELECT *, tokens AS taken FROM c WHERE tokens > 0)",
    ]
    scale = "(1 - coalesce(sum(most) FILTER (done) OVER (), 0)) / sum(raised) FILTER (NOT done) OVER ()"
    for d in DIMENSIONS:
        steps.append(f"t_{d}_0 AS MATERIALIZED (SELECT {d}, pow(s, {mix.temper}) AS raised, s / {mix.budget} AS most, false AS done FROM (SELECT {d}, sum(tokens) / (SELECT sum(tokens) FROM w0) AS s FROM w0 GROUP BY {d}))")
        for k in range(FILLS):
            steps.append(f"t_{d}_{k + 1} AS MATERIALIZED (SELECT {d}, raised, most, done OR raised * coalesce({scale}, 0) >= most AS done FROM t_{d}_{k})")
        steps.append(f"t_{d} AS MATERIALIZED (SELECT {d}, {mix.budget} * (SELECT sum(tokens) FROM w0) * CASE WHEN done THEN most ELSE raised * {scale} END AS goal FROM t_{d}_{FILLS})")
    last = "w0"
    for k in range(mix.rounds):
        for d in DIMENSIONS:
            name = f"w{k + 1}_{d}"
            steps.append(f"{name} AS MATERIALIZED (SELECT w.source, w.lang, w.topic, w.tokens, least(w.tokens, w.taken * g.goal / sum(w.taken) OVER (PARTITION BY w.{d})) AS taken FROM {last} w JOIN t_{d} g ON w.{d} = g.{d})")
            last = name
    steps.append(f"q AS (SELECT source, lang, topic, taken / tokens AS p FROM {last})")
    body = ",\n".join(steps)
    return f"""WITH {body}
SELECT doc_id, source, lang, topic, n_tokens, round(coalesce(p, 1.0), 6) AS probability,
  CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0 < round(coalesce(p, 1.0), 6) AS kept
FROM m LEFT JOIN q USING (source, lang, topic)"""
