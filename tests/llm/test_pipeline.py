import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from scenequery.llm import decontaminate, minhash, quality  # noqa: E402

from . import test_minhash, test_mixing, test_tokens  # noqa: E402


@pytest.fixture(scope="module")
def steps(spark, sf):
    out, docs = [], spark.read.parquet(f"{sf}/documents.parquet")
    out.append(docs)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.common.materialise(stage(spark, docs, sf), "test")
        out.append(docs)
    return out


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages_keep_the_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontaminate", "mixing", "tokens"]
    for df in steps[1:-1]:
        assert df.dtypes == steps[0].dtypes


def test_quality_stage(spark, sf, steps):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(steps[0], labels)
    want = [i for i, t in pairs(steps[0]) if model.score(quality.np.array([quality.features_of(t.encode())]))[0] >= quality.THRESHOLD]
    assert sorted(want) == sorted(i for i, _ in pairs(steps[1])) and 0 < len(want) < steps[0].count()


def test_near_duplicate_stage(steps):
    want = sorted(r[0] for r in test_minhash.brute(pairs(steps[1])) if r[3])
    assert want == sorted(i for i, _ in pairs(steps[2]))


def test_decontamination_stage(spark, sf, steps):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = sorted(r[0] for r in decontaminate.brute(pairs(steps[2]), items) if not r[5])
    assert want == sorted(i for i, _ in pairs(steps[3]))


def test_mixing_stage(steps):
    docs = [(r.doc_id, r.text, r.lang, r.source) for r in steps[3].collect()]
    rows, _ = test_mixing.brute(docs, share=corpus_pipeline.MIX["share"], epochs=corpus_pipeline.MIX["max_epochs"], alpha=corpus_pipeline.MIX["alpha"])
    have = [i for i, _ in pairs(steps[4])]
    wrong = sum(have.count(r[0]) != r[5] + (r[6] > 0) for r in rows)
    assert wrong <= len({r[1:4] for r in rows})  # a document at a leaf's cut


def test_token_stage(spark, sf, steps):
    import public_tokenizers

    tok = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    want = test_tokens.expected(pairs(steps[4]), tok)
    assert sorted((tuple(r) for r in steps[5].collect()), key=lambda r: r[1]) == want
    assert corpus_pipeline.run(spark, sf).count() == len(want)


def test_minhash_threshold():
    assert (minhash.PART, minhash.WHOLE) == (80, 100)
