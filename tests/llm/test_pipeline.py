"""Each stage of the pipeline against its operator's plain version, on the stage's own input."""

import sentencepiece
from conftest import SF_DIR
from test_texts import documents, plain_classes, plain_sets, spans_of

import corpus_pipeline
from normscope.llm import common, mixing, simhash_dedup, toxicity
from normscope.llm.common import materialise
from normscope.llm.queries import tokenizer_file


KIND = "doc_id long, text string, lang string, source string, n_chars long, own_source string, spans string"


def test_stages_with_nulls_repeats_and_other_columns(spark):
    # No label has these keys, so nothing is known to be toxic.
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(None, None, None, None, None, "x", "y"), (10**9 + 1, "", "en", None, 0, "x", "y"), (10**9 + 1, "", "en", None, 0, "x", "y"), (10**9 + 2, "token=abcdefghijklmn", None, "web", 20, "x", "y"), (10**9 + 3, long, "en", "web", 9, "x", "y"), (10**9 + 4, long + " more", "en", "web", 9, "x", "y"), (None, long, "en", "web", 9, "x", "y")]
    for docs in (spark.createDataFrame(rows, KIND), spark.createDataFrame([], KIND)):
        before = docs
        for name, stage in corpus_pipeline.STAGES:
            docs = materialise(stage(spark, docs, SF_DIR), name)
            if name == "simhash_dedup" and before.count():
                assert sorted(str(r["doc_id"]) for r in docs.collect()) == ["1000000001", "1000000001", "1000000002", "1000000003", "None", "None"]
            if name == "secret_scan" and before.count():
                assert [r["text"] for r in docs.where("doc_id = 1000000002").collect()] == ["[SECRET]"]
        assert docs.count() <= before.count() and docs.columns[0] == "doc_id"


def test_stages(spark):
    docs = documents(spark)
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        kept[name] = docs = materialise(stage(spark, docs, SF_DIR), name)
    rows = {k: {r["doc_id"]: r for r in v.collect()} for k, v in kept.items()}
    every = {r["doc_id"]: r for r in documents(spark).collect()}
    assert all(v.columns == documents(spark).columns for k, v in kept.items() if k != "sentencepiece")

    scores = toxicity.toxicity_scores(documents(spark), labels).collect()
    assert set(rows["toxicity"]) == {r["doc_id"] for r in scores if r["predicted"] == 0}
    ids = sorted(rows["toxicity"])
    classes = plain_classes(plain_sets([every[i]["text"] for i in ids]))
    stay, want = set(rows["simhash_dedup"]), {ids[c] for c in classes}
    assert want <= stay and len(stay - want) <= 0.1 * (len(ids) - len(want))
    assert set(rows["secret_scan"]) == set(rows["simhash_dedup"])
    for i, r in rows["secret_scan"].items():
        assert r["text"] == every[i]["text"] or spans_of(every[i]["text"])
        assert r["n_chars"] == len(r["text"])
    chosen = {r["doc_id"] for r in mixing.mixture(kept["secret_scan"]).where("kept").collect()}
    assert set(rows["mixing"]) == chosen
    theirs = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    assert {i: r["ids"] for i, r in rows["sentencepiece"].items()} == {i: theirs.encode(r["text"]) for i, r in rows["mixing"].items()}
    assert sorted(map(str, corpus_pipeline.run(spark, SF_DIR).collect())) == sorted(map(str, kept["sentencepiece"].collect()))


def python_steps(plan: str) -> tuple[int, bool]:
    """Most Python functions of one stage of a physical plan, and whether rows of Python objects are read in it."""
    most, above = 0, []  # above: (depth, Python functions of its stage down to here)
    for line in plan.splitlines():
        depth = next((k for k, c in enumerate(line) if c.isalnum()), 0)
        above = [a for a in above if a[0] < depth]
        here = 0 if "Exchange" in line.split("(")[0] else (above[-1][1] if above else 0) + ("MapInArrow" in line.split("[")[0])
        above.append((depth, here))
        most = max(most, here)
    return most, "ExistingRDD" in plan


def test_a_task_needs_one_python_worker_at_most(spark, monkeypatch):
    """Each further function of a stage would have a worker process of its own, which keeps its memory while it idles."""
    assert python_steps("MapInArrow f()\n+- MapInArrow g()\n   +- Exchange hash\n      +- MapInArrow h()") == (2, False)
    plans = []

    def written(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return materialise(df, name)

    for module in (common, mixing, simhash_dedup):
        monkeypatch.setattr(module, "materialise", written)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF_DIR), name)
    assert {n for n, p in plans if "MapInArrow" in p} >= {"toxicity", "wide", "meets", "simhash", "sentencepiece"}
    told = [(n, *python_steps(p)) for n, p in plans]
    assert [t for t in told if t[1] > 1 or t[2]] == []
