import hashlib
import re
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from windspark.llm import exact_dedup, minhash, mixing, queries, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_by_themselves(spark):
    """Each stage on what the one before it kept, against the operator's row results."""
    import sentencepiece

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact dedup", "near dedup", "mixing", "sentencepiece"]
    step = {n: f for n, f in corpus_pipeline.STAGES}
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    clean = step["toxicity"](spark, docs, SF).persist()
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(clean) == ids(toxicity.score(docs, model).where("not toxic"))
    single = step["exact dedup"](spark, clean, SF).persist()
    assert ids(single) == ids(exact_dedup.copy_groups(clean).where("kept"))
    apart = step["near dedup"](spark, single, SF).persist()
    assert ids(apart) == ids(minhash.near_classes(single).where("kept"))
    mixed = step["mixing"](spark, apart, SF).persist()
    want = {r.doc_id: r.copies for r in mixing.mix(apart).collect() if r.copies}
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == want
    for df in (clean, single, apart, mixed):
        assert df.columns == docs.columns
    last = step["sentencepiece"](spark, mixed, SF).collect()
    assert len(last) == mixed.count()
    lib = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path())
    texts = {r.doc_id: r.text for r in mixed.collect()}
    for r in last[:40]:
        want = ",".join(map(str, lib.encode(texts[r.doc_id])))
        assert r.ids_sha256 == hashlib.sha256(want.encode()).hexdigest()


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns[:2] == ["doc_id", "n_tokens"] and out.where(F.col("n_tokens") < 0).count() == 0


EMPTY = hashlib.sha256(b"").hexdigest()


def tables(spark, path, docs, labels=()):
    docs.write.parquet(f"file://{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"file://{path}/labels.parquet")
    return f"file://{path}"


def test_stages_on_odd_rows(spark, odd_docs, tmp_path):
    """Nulls, repeats, empty and long texts, clashing names: each stage by brute force, then run()."""
    docs = odd_docs.unionByName(odd_docs.where("doc_id in (4, 5, 6) or doc_id is null"))
    sf = tables(spark, tmp_path, docs, [(None, None, None), (1, None, 1), (4, 1, 0), (4, 1, 0), (99, 0, 1)])
    step = dict(corpus_pipeline.STAGES)
    row = lambda r: tuple(r[c] for c in docs.columns)
    before = docs.collect()

    clean = step["toxicity"](spark, docs, sf).persist()
    assert clean.columns == docs.columns and not Counter(map(row, clean.collect())) - Counter(map(row, before))
    clean = step["toxicity"](spark, docs, tables(spark, tmp_path / "none", docs)).persist()  # nothing to learn from
    assert Counter(map(row, clean.collect())) == Counter(map(row, before))

    groups = {}
    for r in before:
        groups.setdefault(re.sub("[ \t\n\x0b\x0c\r]", "", r.text or ""), []).append(r)
    stay = [min(g, key=lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id or 0)) for g in groups.values()]
    single = step["exact dedup"](spark, clean, sf).persist()
    assert Counter((r.doc_id, r.text) for r in single.collect()) == Counter((r.doc_id, r.text) for r in stay)

    apart = step["near dedup"](spark, single, sf).persist()
    assert Counter(r.doc_id for r in apart.collect()) == Counter(r.doc_id for r in stay if r.doc_id != 3)

    mixed = step["mixing"](spark, apart, sf).persist()
    size = lambda r: len(re.findall(r"[^ \t\n\x0b\x0c\r]+", r.text or ""))
    target, most, got = {}, Counter(), Counter()
    for r in mixing.mix(apart).collect():
        target[r.source] = r.target
        most[r.source] = max(most[r.source], r["size"])
    for r in mixed.collect():
        got[r.source] += size(r)
    assert mixed.columns == docs.columns and max(Counter(map(row, mixed.collect())).values()) <= 3
    assert all(abs(got[s] - t) <= most[s] for s, t in target.items())

    last = step["sentencepiece"](spark, docs, sf).collect()
    assert Counter(r.doc_id for r in last) == Counter(r.doc_id for r in before)
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == (0, EMPTY, EMPTY) for r in last if r.doc_id in (5, 6))
    assert corpus_pipeline.run(spark, sf).count() > 0


@pytest.mark.parametrize("kind", ["empty", "nulls"])
def test_run_without_content(spark, odd_docs, tmp_path, kind):
    """No rows give no rows; rows of nulls only are copies of one empty text."""
    if kind == "empty":
        docs = odd_docs.where("doc_id < -5")
    else:
        docs = spark.range(6).select(*[F.lit(None).cast(t).alias(c) for c, t in odd_docs.dtypes])
    out = corpus_pipeline.run(spark, tables(spark, tmp_path, docs)).collect()
    assert [(r.doc_id, r.n_tokens, r.decoded_sha256) for r in out] == ([] if kind == "empty" else [(None, 0, EMPTY)])
