import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)
#: Names that the stages use in between, or that their operators give to new columns.
CLASHES = ["toxicity", "kept", "many", "row", "mask", "items", "dc_n_hit", "n_words", "found", "tried", "joined", "component_id", "fp", "ids", "decoded"]
MAIL = "write to ann.lee@mail.example.org now"


@pytest.fixture(scope="module")
def scored(request):
    """The network is trained once for the tests of its stage."""
    from rectio.llm import toxicity

    fit, kept = toxicity.fit, []

    def once(*args, **kwargs):
        if not kept:
            kept.append(fit(*args, **kwargs))
        return kept[0]

    toxicity.fit = once
    yield
    toxicity.fit = fit


@pytest.mark.parametrize("name", STAGES)
def test_stage_on_edge_rows(spark, edge, name, scored):
    docs = edge.drop("score", "fingerprint")
    docs = docs.unionByName(docs.where("doc_id = 3").withColumn("text", F.lit(MAIL)).withColumn("doc_id", F.lit(30).cast("long")))
    docs = docs.select("*", *[F.lit(f"kept {c}").alias(c) for c in CLASHES])
    out = STAGES[name](spark, docs, SF)
    rows = out.collect()
    if name == "bpe":
        assert len(rows) == 10 and sorted(r.n_tokens for r in rows)[:3] == [0, 0, 0]
    else:
        assert out.columns == docs.columns
        assert all(r[c] == f"kept {c}" for r in rows for c in CLASHES)
    ids = sorted((-1 if r.doc_id is None else r.doc_id) for r in rows)
    if name in ("benchmark decontamination", "pii", "bpe"):
        assert ids == [-1, 1, 2, 3, 4, 5, 5, 7, 8, 30]
    if name == "simhash near-dedup":
        assert ids == [-1, 1, 3, 4, 30]
    if name == "toxicity":
        # equal texts share their lot
        assert ids.count(5) in (0, 2) and (4 in ids) == (5 in ids) and ({1, 2, 7} <= set(ids) or not {1, 2, 7} & set(ids))
    if name == "pii":
        by = {r.doc_id: r for r in rows}
        assert by[1].text is None and by[1].n_chars is None and by[2].text == "" and by[30].text != MAIL
        assert by[30].n_chars == len(by[30].text) and by[3].text == "one"
    empty = STAGES[name](spark, docs.limit(0), SF)
    assert empty.count() == 0 and empty.columns == out.columns


def test_repeated_and_mixed_ids(spark, documents):
    texts = [(1, "alpha beta gamma delta"), (1, "alpha beta gamma delta"), (1, "one two three four five"), (2, "one two three four five"), (3, "alpha beta gamma delta")]
    kept = STAGES["simhash near-dedup"](spark, documents(texts), SF).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, "alpha beta gamma delta"), (1, "one two three four five")]


def test_surrogates_follow_the_sessions_key(spark, documents):
    docs = documents([(1, MAIL), (2, MAIL)])
    spark.conf.set("spark.rectio.pii.key", "one key")
    try:
        first, again = ([r.text for r in STAGES["pii"](spark, docs, SF).collect()] for _ in range(2))
        spark.conf.set("spark.rectio.pii.key", "another")
        other = [r.text for r in STAGES["pii"](spark, docs, SF).collect()]
    finally:
        spark.conf.unset("spark.rectio.pii.key")
    assert first == again and len(set(first)) == 1 and first != other
