"""The pipeline's stages against plain Python."""

from __future__ import annotations

import re

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tests.llm import brute


def test_stages_one_by_one(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], small).write.parquet(str(tmp_path / str(k)))
        seen.append(spark.read.parquet(str(tmp_path / str(k))))
        assert k == len(corpus_pipeline.STAGES) - 1 or seen[-1].columns == columns
    texts = [{r["doc_id"]: r["text"] for r in df.collect()} for df in seen[:4]]
    assert set(texts[1]) <= {i for i, t in texts[0].items() if not brute.quality_row(t)[5]}
    want = {i for i, (_, _, kept) in brute.near_duplicates(list(texts[1].items()), 5).items() if kept}
    assert set(texts[2]) == want and all(texts[2][i] == texts[0][i] for i in want)
    for i, t in texts[3].items():
        spans = sorted(brute.personal(texts[2][i]), key=lambda s: s[1])
        assert bool(spans) == bool(re.search("<(EMAIL|IP|CARD|PHONE)>", t))
        assert spans or t == texts[2][i]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.array(tokenizer.encode(t, add_special_tokens=False).ids + [0]) for i, t in texts[3].items()}
    brute.packed([tuple(r) for r in seen[4].select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset").collect()], ids)


def test_run(spark, small):
    assert corpus_pipeline.run(spark, small).count() > 0


def test_hard_rows_and_empty_tables(spark, tmp_path):
    """Nulls anywhere, empty and long texts, repeated ids, names that clash with the operators' own, and no rows at all."""
    long = " ".join(f"word{k % 977}" for k in range(40_000))
    fine = "one two three four five six seven eight nine ten eleven twelve and mail to a@b.co"
    data = [(1, None, "en", "a"), (2, "", None, None), (3, long, "en", "a"), (4, fine, "en", "a"), (4, fine, "en", "a"), (5, fine, "de", None), (None, fine, None, "b"), (6, "few words", "en", "a")]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string").selectExpr("*", "bigint(length(text)) AS n_chars", *(f"'clash' AS {c}" for c in ("kept", "own", "of", "rep", "spans", "copy", "queue", "part", "stratum", "key")))
    labels = spark.createDataFrame([(4, 1, 0), (4, None, None), (None, 1, 0), (99, 0, 1)], "doc_id bigint, quality int, toxic int")
    docs.write.parquet(str(tmp_path / "hard" / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "hard" / "labels.parquet"))
    packed = corpus_pipeline.run(spark, str(tmp_path / "hard")).filter("start = 0").collect()
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in packed) == [(False, 4), (True, None)]
    kept = corpus_pipeline.quality_rules(spark, docs, str(tmp_path / "hard"))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.select("doc_id").collect()} == {4, 5, None}
    docs.limit(0).write.parquet(str(tmp_path / "empty" / "documents.parquet"))
    labels.limit(0).write.parquet(str(tmp_path / "empty" / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0
