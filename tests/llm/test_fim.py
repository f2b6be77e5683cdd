"""Fill-in-middle against plain rules, at several chunk sizes."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from sonolake.llm.fim import fill_in_middle, restored

UNITS = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def rule(doc_id, text):
    text = text or ""
    units = UNITS.findall(text)
    n, digest = len(units), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    prefix, middle, suffix = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def documents():
    rnd = random.Random(1)
    docs = [(None, "abc de"), (0, None), (1, ""), (2, "<P>"), (2, "<P>"), (3, "é"), (4, "a<Pb>c"), (5, "<<P>>"), (6, "<P"), (7, "a" * 3000), (8, "é" * 3000), (9, "<S" * 700 + ">")]
    parts = ["a", "bc", "Pé", "P", ">", " ", "é", "中文", "\n", "😀", "S", "M", "xyz"]
    for i in range(10, 250):
        docs.append((i, "".join(rnd.choices([*parts, "<"] if i % 3 == 0 else parts, k=rnd.choice([1, 5, 50, 700])))))
    return docs + docs[40:50] + [(41, "another text")]


@pytest.mark.parametrize("chunk", [1 << 18, 600, 5])
def test_forms_and_cuts(spark, chunk):
    docs = documents()
    frame = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in docs], "doc_id long, text string, n long, key long, form long").repartition(3)
    got = fill_in_middle(frame, chunk).withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=repr) == sorted((rule(*d) for d in docs), key=repr)
    assert all(r.back == r.text for r in got)


def test_empty_table(spark):
    assert fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0
