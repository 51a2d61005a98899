"""Vector codes, fill-in-the-middle and impact-ordered search, against plain versions."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from normscope.llm import fill_middle, impact_search, vector_codes
from normscope.llm.fill_middle import FillSettings
from normscope.llm.impact_search import ImpactIndex, ImpactSettings
from normscope.llm.vector_codes import CodeSettings

TEXTS = "doc_id long, text string, lang string, copies int, copy string, k1 int, output string"
VECTORS = "vec_id long, embedding array<double>, label int, row string, code string, q int, part int"


# ---- fill-in-the-middle


def plain_fill(doc_id, text):
    """What a row becomes, unit by unit."""
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    if n == 0 or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b, c = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if h4 % 100 < 20:
        return n, "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"
    return n, "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"


ODD = ["", None, " ", "a", "word", "two  words\n", "naïve 日本語 😀 x😀y", "<P> marked", "a <S", "S> b < P>", "M><", "tab\tand\rline end", "z" * 900, ("run " * 400) + "q" * 300 + "é" * 77, "1234567890" * 40, "\x00nul", "é combined"]


@pytest.mark.parametrize("settings", [FillSettings(), FillSettings(slice_chars=7, part_bytes=500), FillSettings(slice_chars=1, part_bytes=2_000)])
def test_cuts_equal_the_plain_version(spark, settings):
    rows = [(k, t) for k, t in enumerate(ODD * 3)] + [(None, "no key"), (None, "no key"), (None, None), (7, "another text under 7"), (7, "another text under 7")]
    got = fill_middle.fill_in_middle(spark.createDataFrame([(k, t, "en", 9, "x", 1, "o") for k, t in rows], TEXTS), settings=settings).collect()
    found = sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got), key=str)
    assert found == sorted(((k, *plain_fill(k, t)) for k, t in rows), key=str)
    assert sorted((str(r["doc_id"]), r["restored"]) for r in got) == sorted((str(k), t or "") for k, t in rows)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_very_frequent_equal_rows_are_combined_and_kept(spark):
    rows = [(1, "one text under one key"), *((k, f"text {k}") for k in range(30))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").union(spark.createDataFrame([(1, "one text under one key")] * 400, "doc_id long, text string"))
    got = fill_middle.fill_report(docs, settings=FillSettings(part_bytes=300)).groupBy("doc_id", "output_sha256").count().collect()
    assert sum(r["count"] for r in got) == 431 and max(r["count"] for r in got) == 401


def test_no_documents_give_no_cuts(spark):
    out = fill_middle.fill_report(spark.createDataFrame([], TEXTS))
    assert out.count() == 0 and out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]


def test_texts_cross_the_network_once_and_units_never(spark):
    docs = spark.createDataFrame([(k, f"words of text {k} " * 20) for k in range(200)], "doc_id long, text string")
    out = fill_middle.fill_report(docs, settings=FillSettings(part_bytes=20_000))
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("ReusedExchange") == 2 and plan.count("REPARTITION_BY_NUM") == 3  # one exchange, told again where it is reused
    assert plan.split("+- Window")[1].split("Generate posexplode")[0].count("Exchange") == 0


# ---- vector codes


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """Codes, errors and the codebooks' digest by full distances, in Python's integers, for vectors of one length."""
    kept = [(i, lab, [int(np.floor(4096 * x)) for x in v]) for i, lab, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    d = len(kept[0][2]) // parts
    books = [[r[2][p * d : (p + 1) * d] for r in first] for p in range(parts)]

    def nearest(part, book):
        return min((sum((x - y) ** 2 for x, y in zip(part, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = [r[2][p * d : (p + 1) * d] for r in kept]
            at = [nearest(x, books[p])[1] for x in own]
            books[p] = [[sum(c) // at.count(k) for c in zip(*(x for x, a in zip(own, at, strict=True) if a == k), strict=True)] if k in at else e for k, e in enumerate(books[p])]
    out = []
    for i, lab, q in kept:
        met = [nearest(q[p * d : (p + 1) * d], books[p]) for p in range(parts)]
        out.append((i, lab, "".join(f"{k:02x}" for _, k in met), sum(g for g, _ in met)))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return out, digest


def coded_rows(df):
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect()), key=str)


def with_sums(out, digest):
    sums = {}
    for _, lab, _, e in out:
        sums[lab] = sums.get(lab, 0) + e
    return sorted(((i, c, e, sums[lab], digest) for i, lab, c, e in out), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, "clash", "c", 1, 2) for i, lab, v in rows], VECTORS)


@pytest.mark.parametrize("n", [3, 16, 240])
def test_codes_equal_full_distances(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 24)).round(2)
    x[n // 3 : 2 * n // 3] = x[0]  # copies: ties between entries and unused ones
    rows = [(i, None if i % 7 == 0 else i % 3, v.tolist()) for i, v in enumerate(x)]
    rows += [(4, 1, rng.normal(size=24).tolist()), (None, 1, x[0].tolist()), (None, None, None), (99, 1, [None] * 24), (98, 1, [float("nan")] * 24), (97, 1, [1.0] * 23 + [float("inf")])]
    want, digest = plain_codes(rows)
    assert coded_rows(vector_codes.compression_report(frame(spark, rows).repartition(3))) == with_sums(want, digest)


def test_codes_do_not_depend_on_batches_or_hot_labels(spark):
    rng = np.random.default_rng(4)
    rows = [(i, 5 if i < 300 else i, v.tolist()) for i, v in enumerate(rng.normal(size=(420, 16)))]
    want, digest = plain_codes(rows)
    for batch, share in ((17, 0.25), (8_192, 1e9)):
        assert coded_rows(vector_codes.compression_report(frame(spark, rows), settings=CodeSettings(batch=batch, hot_share=share))) == with_sums(want, digest)


def test_other_lengths_have_their_own_codebooks(spark):
    rng = np.random.default_rng(6)
    short, odd = [(i, 1, v.tolist()) for i, v in enumerate(rng.normal(size=(40, 8)))], [(100 + i, 1, v.tolist()) for i, v in enumerate(rng.normal(size=(30, 11)))]
    got = {r["vec_id"]: (r["code"], r["error"]) for r in vector_codes.compression_report(frame(spark, [*short, *odd, (200, 1, [])])).collect()}
    for rows in (short, [(i, lab, v + [0.0] * 5) for i, lab, v in odd]):
        assert {i: got[i] for i, _, _ in rows} == {i: (c, e) for i, _, c, e in plain_codes(rows)[0]}
    assert got[200] == ("00" * 8, 0)


def test_no_vectors_give_no_codes_and_huge_components_an_error(spark):
    assert vector_codes.compression_report(frame(spark, [])).count() == 0
    assert vector_codes.compression_report(frame(spark, [(1, 1, None)])).count() == 0
    with pytest.raises(Exception, match="beyond what the codes' integers hold"):
        vector_codes.compression_report(frame(spark, [(1, 1, [1e30] * 8)])).count()


def test_masks_drop_entries_and_ties_go_to_the_lower_index():
    rng = np.random.default_rng(2)
    book = np.concatenate([rng.integers(-4000, 4000, (14, 8)), np.zeros((2, 8), np.int64)])
    x = np.concatenate([book[rng.integers(0, 16, 3_000)] + rng.integers(-300, 300, (3_000, 8)), np.zeros((5, 8), np.int64)])
    entry, gap, work = vector_codes.nearest_entries(x, book)
    full = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    assert np.array_equal(entry, full.argmin(axis=1)) and np.array_equal(gap, full.min(axis=1))
    assert (entry[-5:] == 14).all() and work < 0.5 * x.size * 16
    spread = book.var(axis=0)
    assert (np.diff(spread[vector_codes.search_order(book)]) <= 1e-6).all()


# ---- impact-ordered search


def plain_search(rows, nearest=5):
    kept = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(kept):
        if i is None or i % 50:
            continue
        scores = sorted((-sum(x * y for x, y in zip(q, v, strict=True)), j is None, j or 0) for b, (j, v) in enumerate(kept) if b != a and len(v) == len(q))[:nearest]
        out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(scores)]
    return sorted(out, key=str)


def searched(spark, rows, **settings):
    found = impact_search.search(frame(spark, [(i, 1, v) for i, v in rows]), F.col("vec_id") % 50 == 0, settings=ImpactSettings(**settings)).collect()
    return sorted((tuple(r) for r in found), key=str)


@pytest.mark.parametrize("settings", [{}, {"block": 64, "chunk": 3, "levels": 3, "few": 1}, {"block": 1, "levels": 1, "shares": (1.0,)}])
def test_search_equals_every_product(spark, settings):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(330, 12)) * rng.gamma(0.4, size=12)
    x[40:120] = x[0]
    x[130:140] = 0.0
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(50, x[3].tolist()), (50, x[50].tolist()), (None, x[0].tolist()), (None, (2 * x[0]).tolist()), (400, None), (450, [None] * 12), (500, [float("nan")] * 12), (550, [0.5] * 12)]
    rows += [(600 + 25 * k, v.tolist()) for k, v in enumerate(rng.normal(size=(4, 3)))] + [(1000, []), (1001, []), (2000, [1.0] * 5)]
    assert searched(spark, rows, **settings) == plain_search(rows)


def test_search_of_nothing(spark):
    assert searched(spark, []) == [] and searched(spark, [(0, None)]) == [] and searched(spark, [(1, [1.0])]) == []


def test_reading_stops_early_on_proof_where_few_lists_decide():
    rng = np.random.default_rng(3)
    values = rng.integers(-3, 4, (4_000, 24))
    values[:, :2] = rng.integers(-400, 400, (4_000, 2))
    index = ImpactIndex(values, 16)
    weight = np.r_[300, -200, rng.integers(-4, 5, 22)]
    rows, scores, read = index.search(weight, np.zeros(0, np.int64), 5, -1, tuple(np.linspace(0.02, 1, 40)), 48)
    exact = values @ weight
    assert set(np.argsort(-exact, kind="stable")[:5]) <= set(rows) and np.array_equal(exact[rows], scores)
    assert read < 0.5 * values.size and len(rows) <= 48
    # A score that no row reaches: hardly any is possible, and reading ends as early.
    possible, _, read = index.search(weight, np.array([exact.max() + 400] * 5), 5, -1, (0.1, 0.5, 1.0), 48)
    assert len(possible) <= 48 and read < 0.6 * values.size
