"""The pipeline against plain versions of its stages."""

import hashlib

import pytest

pytest.importorskip("corpus_pipeline")
sentencepiece = pytest.importorskip("sentencepiece")

import corpus_pipeline  # noqa: E402
from nearfield.llm.piece_codec import model_path  # noqa: E402
from tests.llm.test_native_operators import plain_all, plain_contamination  # noqa: E402
from tests.llm.test_near_duplicates import plain_components, plain_jaccard  # noqa: E402


def masked(text):
    out, at = [], 0
    for part in plain_all(text).split(","):
        if part:
            s, e = map(int, part.split(":")[1:])
            if s > at or not out:
                out.append(text[at:s])
            at = max(at, e)
    return "[SECRET]".join([*out, text[at:]])


def test_pipeline_equals_plain_version(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = [(i, t) for i, t in docs if any(c.isalpha() for c in t or "")]
    links, _ = plain_jaccard(docs)
    root, least = plain_components(len(docs), links), {}
    for (i, _), r in zip(docs, root, strict=True):
        least[r] = min(i, least.get(r, i))
    docs = [d for d, r in zip(docs, root, strict=True) if least[r] == d[0]]
    docs = [(i, t) for i, t in docs if not plain_contamination(t, items)[-1]]
    sp = sentencepiece.SentencePieceProcessor(model_file=model_path())
    want = {}
    for i, t in docs:
        ids = sp.encode(masked(t), add_bos=True, add_eos=True)
        want[i] = (len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())
    rows = corpus_pipeline.run(spark, sf).collect()
    assert len(rows) == len(want) and {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows} == want


def test_stages_on_odd_rows(spark, tmp_path):
    rows = [(1, "token=abcdefghij", "en", "s", 16), (1, "token=abcdefghij", "en", "s", 16), (None, None, None, None, None), (2, "", "en", None, 0), (3, "12 34", None, None, 5), (4, "word " * 9000, "en", "s", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").selectExpr("*", "1 as id", "2 as hash")
    spark.createDataFrame([(1, "none of this")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for frame in (docs, docs.limit(0)):
        out = frame
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, out, str(tmp_path))
            if k < 4:
                assert out.columns == frame.columns, name
            out.write.parquet(path := f"{tmp_path}/{frame is docs}-{k}")
            out = spark.read.parquet(path)
        assert sorted(r.doc_id for r in out.collect()) == ([1, 4] if frame is docs else [])
