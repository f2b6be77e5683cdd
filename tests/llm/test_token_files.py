"""Token files: round trips against the tokenizer itself, access to single documents, many parts and files."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonolake.llm import token_files
from sonolake.llm.queries import op12_token_files, tokenizer_path


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def documents():
    rnd = random.Random(4)
    words = [f"w{i}x" for i in range(200)] + ["the", "Of", "naïve", "中文", "it's", "7", "..."]
    docs = [(i, " ".join(rnd.choices(words, k=rnd.choice([0, 1, 20, 300])))) for i in range(300)]
    docs += [(None, None), (None, "two words"), (-5, ""), (1 << 40, "far"), (999, "word " * 20_000)]
    return docs + [(50, f"again {i}") for i in range(150)] + [(51, "the same")] * 3


def test_round_trip(spark, tmp_path, encode):
    docs = documents()
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, part long, n long").repartition(3)
    manifest = token_files.write_token_files(frame, f"file://{tmp_path}/a", tokenizer_path(), part_bytes=20_000, file_bytes=4_000)
    assert manifest.count() > 10 and manifest.agg(F.max("seq")).first()[0] > 0 and manifest.agg(F.sum("n_docs")).first()[0] == len(docs)
    rows = sorted(token_files.read_token_files(spark, f"file://{tmp_path}/a", keep=True).collect(), key=lambda r: r.start)
    assert sorted(((r.doc_id, r.ids) for r in rows), key=repr) == sorted(((i, encode(t)) for i, t in docs), key=repr)
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in rows]
    assert keys == sorted(keys)
    total = 0
    for r in rows:
        assert (r.start, r.n_tokens, r.ids_crc32) == (total, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
        total += r.n_tokens
    index = {(r.name, r.i): r for r in token_files.token_index(spark, f"file://{tmp_path}/a").collect()}
    assert len(index) == len(docs) and sorted(r.start for r in index.values()) == [r.start for r in rows]
    wanted = spark.createDataFrame([(999,), (51,), (-5,), (12345,), (None,)], "doc_id long")
    got = sorted((r.doc_id, len(r.ids)) for r in token_files.read_documents(wanted, f"file://{tmp_path}/a").collect())
    assert got == sorted((i, len(encode(t))) for i, t in docs if i in (999, 51, -5))


def test_repeats_of_one_id_are_spread(spark):
    import pyarrow as pa

    low = np.array([1, 7, 7, 7, 9])
    batch = pa.record_batch({"doc_id": pa.array([7] * 500 + [8, 9, 0, 6, None], pa.int64()), "place": pa.array(range(505), pa.int64())})
    part = token_files._part(batch, 2, low)
    assert set(part[:500].tolist()) == {3, 4, 5} and part[500:504].tolist() == [5, 6, 2, 2] and part[504] in (0, 1)


def test_small_and_empty_tables(spark, tmp_path, encode):
    one = spark.createDataFrame([(3, "word")], "doc_id long, text string")
    token_files.write_token_files(one, str(tmp_path / "one"), tokenizer_path())
    assert [r.ids for r in token_files.read_token_files(spark, str(tmp_path / "one"), keep=True).collect()] == [encode("word")]
    assert token_files.write_token_files(one.limit(0), str(tmp_path / "none"), tokenizer_path()).count() == 0
    assert token_files.read_token_files(spark, str(tmp_path / "none")).count() == 0


def test_another_dictionary_is_refused(spark, tmp_path):
    one = spark.createDataFrame([(3, "word")], "doc_id long, text string")
    name = token_files.write_token_files(one, str(tmp_path), tokenizer_path()).first().name
    file = token_files.TokenFile(str(tmp_path), name)
    (tmp_path / token_files._dictionary_name(file.dictionary)).write_bytes(b"something else")
    with pytest.raises(ValueError):
        token_files._codec(str(tmp_path), file)


def test_query(spark, sf, encode):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    total, want = 0, []
    for i in sorted(texts):
        ids = encode(texts[i])
        want.append((i, total, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        total += len(ids)
    assert sorted(map(tuple, op12_token_files(spark, sf).collect())) == want
