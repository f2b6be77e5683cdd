"""The pipeline against its stages' plain rules."""

import zlib
from collections import Counter

import corpus_pipeline as P
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sonolake.llm import pii
from sonolake.llm import quality as Q
from sonolake.llm import textkernel as K
from sonolake.llm.queries import tokenizer_path
from sonolake.llm.util import held_out

from .common import ALNUM, awkward, frame, low
from .test_pairs import near_rule


def test_stages_and_columns(spark):
    docs = frame(spark, awkward()).drop("bucket", "n_words", "spans")
    gone = {i for i, (_, c, _) in near_rule(awkward(), 5, 80).items() if c != i}
    kept = P.near_duplicate_stage(spark, docs, "")
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in awkward()} - gone
    clash = frame(spark, awkward())
    for stage in (P.decontaminate_stage, P.quality_stage, P.pii_stage):
        own = stage(spark, clash, "/root/testdata/sf0.001")
        assert own.columns == clash.columns and {(r.bucket, r.n_words, r.spans) for r in own.collect()} == {(1, 2, 3)}
    masked = P.pii_stage(spark, docs.withColumn("text", F.concat("text", F.lit(" a@b.org"))), "")
    assert masked.columns == docs.columns and masked.where("text like '%@b.org%'").count() == 0


def test_run(spark, sf):
    out = P.run(spark, sf)
    assert [n for n, _ in P.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "PII", "best-fit packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clean = docs.join(spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1"), "doc_id").join(P.near_duplicate_stage(spark, docs, sf).select("doc_id"), "doc_id")
    clean = clean.join(P.decontaminate_stage(spark, docs, sf).select("doc_id"), "doc_id")
    lost = clean.join(out.select("doc_id").distinct(), "doc_id", "left_anti").count()
    assert lost <= 0.03 * clean.count()


def test_run_equals_plain_rules_stage_by_stage(spark, tmp_path):
    from tokenizers import Tokenizer

    mail = "write to me@x.org or +49 30 1234567 now "
    docs = awkward() + [(3, "one"), (None, "no id at all"), (None, None), (300, mail + "tail"), (301, "junk # # # # $ $ % % ^ ^ & &"), (302, "x the answer to that question is forty two of course y")]
    items = [(1, "the answer to that question is forty two of course"), (2, None), (None, "p3 p4 p5 p6 p7 p8 p9 p10 p11 p12 p13"), (3, "")]
    labels = [(i, int(i % 7 > 1), 0) for i, _ in awkward() if i is not None and i % 2]
    frame(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    known.write.parquet(f"{tmp_path}/labels.parquet")

    rules, bias = Q.fit(frame(spark, docs), known, "quality", held_out("doc_id", 3, 1))
    x = Q.statistics(*K.text_buffers(pa.array([t for _, t in docs], pa.string())))
    total = bias + sum(w * Q.holds(r, x) for r, w in rules)
    left = [d for d, good in zip(docs, np.broadcast_to(total, len(docs)) >= 0, strict=True) if good]
    assert 0 < len(left) < len(docs)

    groups = near_rule([d for d in left if d[0] is not None], 5, 80)
    left = [(i, t) for i, t in left if i is None or groups[i][1] == i]
    assert len(left) < len(docs) - 7

    windows = {tuple(w[k : k + 10]) for _, t in items if (w := ALNUM.findall(low(t or ""))) for k in range(max(len(w) - 9, 1))}
    clean = lambda w: not any(tuple(w[k : k + 10]) in windows for k in range(len(w) - 9))
    before, left = len(left), [(i, t) for i, t in left if clean(ALNUM.findall(low(t or "")))]
    assert len(left) < before

    masked = [(i, None if t is None else pii.mask(t, pii.find(t))) for i, t in left]
    encode, want = Tokenizer.from_file(tokenizer_path()).encode, Counter()
    for i, t in masked:
        ids = np.array([*encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for k, s in enumerate(range(0, len(ids), 4096)):
            want[i, k, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())] += 1
    out = P.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    places: dict = {}
    for r in out:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        assert [o for o, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 4096


def test_empty_tables(spark, tmp_path):
    none = frame(spark, awkward()).limit(0)
    none.write.parquet(f"{tmp_path}/documents.parquet")
    none.selectExpr("doc_id item_id", "text").write.parquet(f"{tmp_path}/benchmark.parquet")
    none.selectExpr("doc_id", "1 quality", "0 toxic").write.parquet(f"{tmp_path}/labels.parquet")
    docs = none
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == none.columns and docs.count() == 0
    assert P.run(spark, str(tmp_path)).count() == 0
    full = frame(spark, awkward())
    for _, stage in (P.STAGES[0], P.STAGES[2]):  # nothing to learn from, nothing to look for
        assert stage(spark, full, str(tmp_path)).count() == full.count()
