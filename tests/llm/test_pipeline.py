"""The pipeline against its stages done by brute force."""

import hashlib

import corpus_pipeline
from candela.llm import bpe, decontaminate, toxicity
from candela.llm.common import table
from tests.llm.test_operators import near_brute, prose, template_group


def test_pipeline_equals_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    scores = toxicity.toxicity(docs, table(spark, sf_dir, "labels"))
    left = {r.doc_id for r in scores.where("predicted = 0").collect()}
    last = {}
    for k in left:
        last[texts[k] or ""] = max(k, last.get(texts[k] or "", k))
    left = set(last.values())
    left = {i for i, _, c in near_brute([(k, texts[k]) for k in sorted(left)]) if i == c}
    items = [decontaminate.normalise(r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    search = decontaminate.Items(list(range(len(items))), items, decontaminate.ERROR_RATE)
    automaton = search.automaton()
    plain = {k: decontaminate.normalise(texts[k]) for k in left}
    hit = {k for k in left if search.matches(automaton, plain[k])}
    assert {k for k in left if any(i in plain[k] for i in items)} <= hit
    library = bpe.Tokenizer.from_file(bpe.default_vocabulary())
    want = {}
    for k in left - hit:
        ids = library.encode(texts[k] or "", add_special_tokens=False).ids
        want[k] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    found = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert found == want and 0 < len(found) < len(texts)


def test_stages_on_odd_rows(spark, sf_dir, tmp_path):
    """Null, empty, repeated and very long texts, null ids and clashing columns, stage by stage and as a whole; and an empty table."""
    item = next(r.text for r in table(spark, sf_dir, "benchmark").collect() if len(r.text or "") > 60)
    long = prose(3, 25_000)
    rows = [(1, None), (2, ""), (3, " "), (4, prose(4, 40)), (4, prose(4, 40)), (5, prose(4, 40)), (6, long), (7, f"{long} {item} end"), (8, prose(4, 40) + " more"), (None, prose(5, 30))]
    kind = "doc_id long, text string, lang string, source string, n_chars long, digest string, mark string"
    docs = spark.createDataFrame([(*r, "en", "own", 1, "own", "own") for r in rows], kind)
    want = [
        ("toxicity", {1, 2, 3, 4, 5, 6, 7, 8, None}), ("exact dedup", {2, 3, 5, 6, 7, 8, None}), ("near dedup", {2, 3, 5, 6, None}),
        ("benchmark decontamination", {2, 3, 5, 6, None}),
    ]
    for (name, stage), (_, ids) in zip(corpus_pipeline.STAGES, want, strict=False):
        left = stage(spark, docs, sf_dir).collect()
        assert {r.doc_id for r in left} == ids, name
        assert {(r.lang, r.source, r.digest, r.mark) for r in left} == {("en", "own", "own", "own")}
        docs = spark.createDataFrame(left, kind)
        assert stage(spark, docs.where("false"), sf_dir).count() == 0
    assert {r.doc_id for r in corpus_pipeline.benchmark(spark, spark.createDataFrame([(*r, "", "", 1, "", "") for r in rows], kind), sf_dir).collect()} == {1, 2, 3, 4, 5, 6, 8, None}
    docs = spark.createDataFrame([(*r, "en", "own", 1, "own", "own") for r in rows], kind)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("benchmark", "labels"):
        table(spark, sf_dir, name).write.parquet(f"{tmp_path}/{name}.parquet")
    assert {r.doc_id: r.n_tokens > 0 for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {2: False, 3: False, 5: True, 6: True, None: True}


def test_stages_keep_the_columns(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(60)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_near_stage_on_one_template_equals_brute_force(spark, sf_dir):
    rows = list(enumerate(template_group(17, 1100, 200)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id for r in corpus_pipeline.near(spark, docs, sf_dir).collect()} == {i for i, _, c in near_brute(rows) if i == c}
