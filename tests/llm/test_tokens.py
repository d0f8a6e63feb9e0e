import zlib

import numpy as np
import pytest

from scenequery.llm import tokens as T

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def tok():
    return open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()


def expected(docs, tok):
    from tokenizers import Tokenizer

    t, start, out = Tokenizer.from_str(tok), 0, []
    for doc_id, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or "")):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


ODD = ["", None, "a\tb  c\n\n d", "don't STOP 12345", "<|endoftext|> x<|startoftext|>y", "é ́e İSTANBUL ΟΔΟΣ ς", "x y z\x1ca\u0085b", "w" * 5000, "日本語 テスト 🙂", " ̸= Ångström", "'s 'T re'll", "a., b.. é. 1. Σ. x's. ., , . o\u0301. \x01 a\x01b \x01. <|EndOfText|>.", "I\u0307. A\u030a, Ⅷ. x\u0301, ª. ª"]


def test_round_trip(spark, tok):
    docs = [(i * 7 % 40, t) for i, t in enumerate(ODD * 3)] + [(None, "a b"), (3, "same"), (3, "same")]
    df = spark.createDataFrame([(i, t, "s", 9) for i, t in docs], "doc_id long, text string, start string, n_tokens int")
    manifest = T.write(df, tok, 2, seq_len=16)
    got = sorted((tuple(r) for r in T.read(manifest).collect()), key=lambda r: r[1])
    assert got == expected(docs, tok)


def test_sequences_are_views(spark, tok):
    docs = [(i, "the quick brown fox " * (i + 1)) for i in range(40)]
    manifest = T.write(spark.createDataFrame(docs, "doc_id long, text string"), tok, 2, seq_len=8).orderBy("part").collect()
    flat, ids = [], []
    for m in manifest:
        f, n = T.open_sequences(m.path), -(-m.n_tokens // 8)
        for i in range(n):
            seq, mask = T.sequence(f, i)
            assert not seq.flags.owndata and len(seq) == 8
            flat += [int(x) for x, on in zip(seq, mask.to_pylist()) if on]
    for _, text in docs:
        from tokenizers import Tokenizer

        ids += [*Tokenizer.from_str(tok).encode(text, add_special_tokens=False).ids, 2]
    assert flat == ids


def test_empty_table(spark, tok):
    assert T.read(T.write(spark.createDataFrame([], "doc_id long, text string"), tok, 2)).collect() == []


def test_cache_overflow(tok):
    e, f = T.Encoder(tok, cache_words=2), T.Encoder(tok)
    for batch in (["a b c", "d " * 9], ["a b", None, "z" * 99]):
        assert e.encode(batch) == f.encode(batch)


def test_encoder_is_the_library(spark, sf, tok):
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_str(tok), T.Encoder(tok)
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for text, got in zip(texts, e.encode(texts), strict=True):
        assert np.frombuffer(got, e.dtype).tolist() == t.encode(text or "", add_special_tokens=False).ids, text


def test_whole_table(spark, sf, tok):
    from scenequery.llm.queries import op8_token_sequences

    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in op8_token_sequences(spark, sf).collect()), key=lambda r: r[1]) == expected(docs, tok)
