"""Operators that judge each text: against plain rules, exact round trips and held-out accuracy."""

import math
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from sonolake.llm import packing, pii
from sonolake.llm import quality as Q
from sonolake.llm import toxicity as X
from sonolake.llm.decontaminate import MOST_BYTES, _parts, decontaminate
from sonolake.llm.licenses import PARAGRAPHS, PHRASES, TEMPLATES, license_scan
from sonolake.llm.ppm import DISCOUNT, lm_score
from sonolake.llm.queries import QUERIES, tokenizer_path

from .common import ALNUM, SPACED, awkward, frame, low

quality, toxicity = Q.quality, X.toxicity


def test_decontaminate(spark):
    docs = awkward()
    items = [(1, " ".join(f"P{i}" for i in range(20, 45))), (2, "one two"), (2, "w1"), (10, docs[20][1]), (11, None), (12, "..."), (13, "é")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(low(t or ""))
        for k in range(max(len(w) - 9, 1 if w else 0)):
            windows[tuple(w[k : k + 10])].add(str(i))
    for most in (MOST_BYTES, 400):
        got = {r.doc_id: r for r in decontaminate(frame(spark, docs), bench, most_bytes=most).collect()}
        for i, t in docs:
            w, hit, names = ALNUM.findall(low(t or "")), set(), set()
            for n in {len(x) for x in windows}:
                for k in range(len(w) - n + 1):
                    if (x := windows.get(tuple(w[k : k + n]))) and len(w[k : k + n]) == n:
                        hit.update(range(k, k + n))
                        names |= x
            assert (got[i].n_words, got[i].n_hit, got[i]["items"]) == (len(w), len(hit), sorted(names)), i
            assert sum(len(ALNUM.findall(low(t[s.start : s.end]))) for s in got[i].spans) == len(hit)
    assert decontaminate(frame(spark, docs), bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


def test_more_distinct_words_than_symbols(spark):
    assert list(_parts("a b cc dd ee ff g", 2, 5)) == ["a b", "b cc", "cc dd", "dd ee", "ee ff", "ff g"]
    own = [p.split() for p in _parts(" ".join(map(str, range(1_150_000))), 10, MOST_BYTES)]
    assert all(len(p) < 0x110000 - 0x10000 for p in own) and own[0][0] == "0" and own[-1][-1] == "1149999"
    assert all(int(q[0]) == int(p[-1]) - 8 for p, q in zip(own, own[1:]))
    docs = spark.createDataFrame([(1, " ".join(map(str, range(2_000, 2_012)))), (2, "0 1 2 3 4 5 6 7 8 9 x"), (3, "1 3 5"), (4, None), (5, "")], "doc_id long, text string").coalesce(1)
    item = spark.createDataFrame([(1, " ".join(map(str, range(3_000))))], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate(docs, item, most_bytes=5000).collect()}
    assert got == {1: (12, 12, ["1"]), 2: (11, 10, ["1"]), 3: (3, 0, []), 4: (0, 0, []), 5: (0, 0, [])}


def test_decontaminate_keeps_columns_of_any_name(spark):
    docs = frame(spark, awkward()).coalesce(1).withColumns({"_hits_so_far": F.lit(1), "items": F.lit("x")})
    out = decontaminate(docs, spark.createDataFrame([(1, "one two"), (2, "zz")], "item_id long, text string"), most_bytes=8, keep=True)
    assert set(out.columns) == {*docs.columns, "n_hit"} and out.where("_hits_so_far = 1").count() == docs.count()
    assert out.where("n_hit > 0").count() == sum("one two" in low(t or "") for _, t in awkward())
    assert decontaminate(docs.limit(0), docs.limit(0).select(F.col("doc_id").alias("item_id"), "text")).count() == 0


def test_items_without_an_id_hit(spark):
    bench = spark.createDataFrame([(None, "one two three"), (None, "four"), (7, "two three")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x One two three"), (2, "four four"), (3, "two three"), (4, "x")], "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate(docs, bench).collect()}
    assert got == {1: (3, ["7", None]), 2: (2, [None]), 3: (2, ["7"]), 4: (0, [])}


def test_op3_equals_its_sql_with_items_without_an_id(spark, tmp_path):
    import duckdb

    from sonolake.llm.sql import ORACLE

    spark.createDataFrame([(None, "one two three"), (None, "four"), (7, "two three")], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, "x One two three"), (2, "four four"), (3, "two three"), (4, "x")], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for name in ("benchmark", "documents"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    got = QUERIES["op3_decontaminate"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(f"select {', '.join(got.columns)} from ({ORACLE['op3_decontaminate']})").fetchall())


def test_licenses(spark):
    docs = awkward() + [(900, "cc by nc cc by-nc CC/BY nc!"), (901, "  Under the MIT license"), (902, "xx under the mit license."), (903, "éunder the mit license"), (904, "apache license version 2 under the mit licenses under the mit license"), (905, "This work is licensed under the GNU General Public License, version 3.")]
    got = {r.doc_id: r for r in license_scan(frame(spark, docs)).collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        w = ALNUM.findall(low(t or ""))
        at = [(k, label) for p, label in PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r, places = got[i], [k for k, _ in at]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(places, default=None), max(places, default=None)), i
        assert r.base_labels == ",".join(sorted({label for _, label in at}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[905].labels == "gpl-3" and got[905].base_labels == ""
    assert license_scan(frame(spark, docs).limit(0)).count() == 0


def test_licenses_in_wrapped_lines(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software)"
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    docs = []
    for k, (text, width) in enumerate((t, w) for t in (mit, bsd) for w in (30, 72)):
        for j, (end, mark) in enumerate((("\n", ""), ("\r\n", " * "))):
            docs.append((10 * k + j, "Copyright 2024" + end * 2 + end.join(mark + x for x in textwrap.wrap(text, width))))
    docs.append((100, "\n\n".join(textwrap.wrap(mit, 72))))  # paragraphs of their own
    got = {r.doc_id: (r.labels, r.score) for r in license_scan(frame(spark, docs)).collect()}
    assert got == {i: ("mit" if i < 20 else "bsd", 1.0) if i < 100 else ("", 0.0) for i, _ in docs}


def test_license_paragraphs_and_rows_with_one_id(spark):
    isc, gpl = PARAGRAPHS[3][1].split(), PARAGRAPHS[5][1]
    wrapped = "\n".join(textwrap.wrap(" ".join(w.upper() if k % 9 == 0 else w for k, w in enumerate(isc)), 60))
    rows = [(1, f"Hello.\n\n{wrapped.replace(' granted', '; granted')}.\n\nBye"), (1, "nothing"), (None, gpl), (2, " ".join(isc[: len(isc) // 2])), (3, "under the \u212aey license"), (4, None)]
    got = sorted((r.doc_id or 0, r.labels, r.score) for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, "gpl-3", 1.0), (1, "", 0.0), (1, "isc", 1.0), (2, "", 0.0), (3, "", 0.0), (4, "", 0.0)]


def test_op7_equals_its_sql(spark, tmp_path):
    import duckdb

    from sonolake.llm.sql import ORACLE

    rnd = random.Random(12)
    words = sorted({w for _, t in (*TEMPLATES, *PARAGRAPHS) for w in t.split()})
    marks = ["\n", ". ", "\n\n", "; ", "\n - \n", "\t"]
    pick = lambda: rnd.choice(TEMPLATES + PARAGRAPHS)[1].split() if rnd.random() < 0.6 else [*rnd.choices(words, k=6), "x", "MIT"]
    text = lambda: "".join((rnd.choice(marks) if rnd.random() < 0.08 else " ") + w for w in pick() if rnd.random() < 0.95)
    spark.createDataFrame([(i, "".join(text() for _ in range(rnd.randint(0, 5))) or None) for i in range(300)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = QUERIES["op7_license_scan"](spark, str(tmp_path))
    rows = sorted(map(repr, map(tuple, got.collect())))
    assert rows == sorted(map(repr, con.execute(f"select {', '.join(got.columns)} from ({ORACLE['op7_license_scan']})").fetchall())) and sum("bsd" in r for r in rows) > 3


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    def sound(kind, m):
        d = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": all(int(x) <= 255 for x in m.split(".")) if kind == "ip" else True, "card": 14 <= len(d) <= 19 and pii.luhn(d), "phone": 10 <= len(d) <= 15}[kind]

    return sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(BASE.items()) for m in re.finditer(p, text) if sound(kind, m.group()))


def test_pii_equals_the_plain_rules():
    rnd = random.Random(7)
    bits = ["a@b.c", "@", ".", "x_y@z-1.de.com", "1.2.3.4", "999.1.1.1", "1.2.3.4.5.6.7.8", "4539578763621486", "4539 5787-6362 1486", "+49 (0)30 1234567", "+1", " ", "-", "é", "00012.1.2.255", "a@b@c.d", "%+", "7"]
    for _ in range(3000):
        text = "".join(rnd.choices(bits, k=rnd.randint(1, 8)))
        assert [s for s in pii.find(text) if s[1] < 4] == base_spans(text), text


def test_pii_iban_context_and_mask(spark):
    text = "my bank account GB82 WEST 1234 5698 7654 32 and mail me@x.org"
    got = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame([(1, text), (2, None), (3, "GB83WEST12345698765432")], "doc_id long, text string"), masked=True).collect()}
    assert [(s.kind, text[s.start : s.end]) for s in got[1].spans] == [("iban", "GB82 WEST 1234 5698 7654 32"), ("email", "me@x.org")]
    assert got[1].spans[0].score == 0.9 and got[1].masked == "my bank account [IBAN] and mail [EMAIL]"
    assert got[2].spans == [] and got[3].spans == []


def test_ibans_among_other_words():
    de, gb, be, no = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "BE68 5390 0754 7034", "NO93 8601 1117 947"
    for text, want in (
        (f"{de} BIC COBADEFFXXX", [de]), (f"{gb} AND go", [gb]), ("DE89370400440532013000 2024", ["DE89370400440532013000"]),
        (f"{be} {no}", [be, no]), (f"AB12 CDEF GHIJ {de}", [de]), (f"x{de}", []), ("GB83 WEST 1234 5698 7654 32 AND", []),
    ):
        assert [text[s:e] for s, e in pii.ibans(text)] == want, text


def _runs(texts, order):
    import pyarrow as pa

    from sonolake.llm import textkernel as K
    from sonolake.llm.ppm import byte_runs

    return byte_runs(K.Words(*K.text_buffers(pa.array(texts, pa.string())), lower=True), order)[0]


def _whole_trie(texts, order):
    """One trie over all runs, against which the sharded model is held."""
    from sonolake.llm.ppm import Trie, _counted

    levels, (k, n) = [], _counted(_runs(texts, order))
    for length in range(order + 1, 0, -1):
        levels.append((length, k, n))
        k, n = _counted(k & np.uint64((1 << 8 * (length - 1)) - 1), n)
    return Trie(levels, order)


def ppm_rule(texts, order):
    """Prediction by partial matching with exclusion from plain dictionaries: a function text -> log10 of its probability."""
    line = lambda t: b"\0" * order + " ".join(SPACED.findall(low(t or ""))).encode() + b"\0"
    seen = defaultdict(Counter)
    for s in map(line, texts):
        for i in range(order, len(s)):
            for k in range(order + 1):
                seen[s[i - k : i]][s[i]] += 1

    def score(text):
        s, total = line(text), 0.0
        for i in range(order, len(s)):
            out = set()
            for k in range(order, -1, -1):
                own = {c: n for c, n in seen.get(s[i - k : i], {}).items() if c not in out}
                if s[i] in own:
                    total += math.log10((own[s[i]] - DISCOUNT) / sum(own.values()))
                    break
                if own:
                    total += math.log10(DISCOUNT * len(own) / sum(own.values()))
                    out |= set(own)
            else:
                total -= math.log10(256 - len(seen.get(b"", {})))
        return total

    return score


def test_lm_score(spark):
    docs = awkward()
    docs_by = dict(docs)
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    words = {i: [*SPACED.findall(low(t or "")), None] for i, t in docs}
    c = Counter(w for i, ws in words.items() if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    small = {"bucket_bytes": 4000, "shard_bytes": 3000, "runs": 700, "asked": 1}
    for order, sizes in ((5, {}), (5, small), (6, small), (2, small)):
        trie = _whole_trie([t for i, t in docs if not held(i)], order)
        plain = ppm_rule([t for i, t in docs if not held(i)], order)
        got = {r.doc_id: r for r in lm_score(frame(spark, docs), order=order, **sizes).collect()}
        for i, ws in words.items():
            r = got[i]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(ws), sum(c[w] > 0 for w in ws), n)
            assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel_tol=1e-9)
            assert math.isclose(r.score, trie.logs(_runs([docs_by[i]], order)).sum(), rel_tol=1e-5)
            if len(ws) < 2000:
                assert math.isclose(r.score, plain(docs_by[i]), rel_tol=1e-5), (order, i)
    assert lm_score(frame(spark, docs).limit(0)).count() == 0
    alone = lm_score(frame(spark, [(i, "x y") for i in range(40) if held(i)])).collect()  # no training rows
    assert len(alone) and all((r.n_known, r.train_tokens) == (0, 0) and r.score < 0 for r in alone)


def test_ppm_probabilities_sum_to_one():
    from sonolake.llm import textkernel as K
    from sonolake.llm.ppm import Trie, _counted, byte_runs

    import pyarrow as pa

    text = "the cat sat on the mat and the cat ran " * 5 + "zebra"
    key = byte_runs(K.Words(*K.text_buffers(pa.array([text]))), 3)[0]
    levels, (k, n) = [], _counted(key)
    for length in (4, 3, 2, 1):
        levels.insert(0, (length, k, n))
        k, n = _counted(k & np.uint64((1 << 8 * (length - 1)) - 1), n)
    for drop in (0, 1):
        trie = Trie([(a, k[n > drop], n[n > drop]) for a, k, n in levels], 3)
        for context in (b"the", b"cat", b"zzz", b"qth", b"\0\0\0", b"bra"):
            runs = (np.uint64(int.from_bytes(context, "big")) << np.uint64(8)) + np.arange(256, dtype=np.uint64)
            assert math.isclose((10 ** trie.logs(runs)).sum(), 1, abs_tol=1e-4), (context, drop)


def _packed(rows, capacity):
    seen = defaultdict(list)
    for r in rows:
        seen[r.sequence_id].append((r.offset, r.length))
    for own in seen.values():
        place = 0
        for offset, length in sorted(own):
            assert offset == place
            place += length
        assert place <= capacity
    return len(seen)


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    marks = "Hello, World. HELLO; É. é! A... b?! 3. x'. don't. DON'T, <|ENDOFTEXT|>. <|endoftext|>, ǅ, İ. ſ: e\u0301. ß! ab.c, .. , A1? q:"
    docs = awkward() + [(800, "x<|endoftext|>y <|startoftext|> ñã ẛ̣"), (801, marks), (802, marks.upper()), (803, marks.lower())]
    encode = Tokenizer.from_file(tokenizer_path()).encode
    want = {}
    for i, t in docs:
        ids = np.array([*encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for k, s in enumerate(range(0, len(ids), 256)):
            want[i, k] = (s, len(ids[s : s + 256]), zlib.crc32(ids[s : s + 256].tobytes()))
    rows = packing.pack(packing.pieces(frame(spark, docs), tokenizer_path(), capacity=256), capacity=256, salted=20).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    assert _packed(rows, 256) <= math.ceil(sum(n for _, n, _ in want.values()) / 256) + 2
    assert packing.pack(packing.pieces(frame(spark, docs).limit(0), tokenizer_path())).count() == 0


def test_words_behind_marks_are_encoded_as_a_whole():
    ids = packing._Ids(tokenizer_path())
    letters = [chr(c) for c in range(0x21, 0x1000) if chr(c).isprintable() and not chr(c).isspace()]
    for w in (w for c in letters for w in (f"{c}.", f"a{c},", f"{c}B!")):
        assert np.frombuffer(ids[w], "<u4").tolist() == ids.tokenizer.encode(w, add_special_tokens=False).ids, w


def test_plans_hold_every_piece():
    rng = np.random.default_rng(3)
    for _ in range(40):
        counts = np.zeros(65, np.int64)
        at = rng.integers(1, 65, rng.integers(1, 30))
        counts[at] = rng.integers(1, 200, len(at))
        used = np.zeros(65, np.int64)
        for lengths, n in packing.plan(counts, 64):
            assert n > 0 and sum(lengths) <= 64
            np.add.at(used, np.array(lengths), n)
        assert (used == counts).all()


def test_classifiers_hold_out_their_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    for f, label, modulus, remainder, least in ((quality, "quality", 3, 1, 0.97), (toxicity, "toxic", 4, 2, 0.95)):
        got = f(docs, labels).join(labels, "doc_id").collect()
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == remainder) and 0 <= r.score <= 1 for r in got)
        own = [r for r in got if r.held_out]
        assert sum(r.predicted == r[label] for r in own) / len(own) >= least


def test_classifiers_without_rows_or_labels(spark):
    docs = frame(spark, awkward())
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for f in (quality, toxicity):
        assert f(docs, none).count() == docs.count()
        assert f(docs.limit(0), none).count() == 0


def test_quality_by_plain_rules(spark):
    """The statistics by plain Python, the compiled column by its rules, the weights by the lasso's optimality conditions."""
    docs = [(i, t) for i, t in awkward()[:70] if t] + [(500, "A b b\nA b b\n#x 12 !\n\n")]
    from sonolake.llm import textkernel as K
    import pyarrow as pa

    s = Q.statistics(*K.text_buffers(pa.array([t for _, t in docs])))
    for (_, t), row in zip(docs, s, strict=True):
        w, raw = SPACED.findall(t), t.encode()
        lines = [x for x in t.split("\n") if x]
        letters = sum(len(c.encode()) for c in t if c.isascii() and c.isalpha() or not c.isascii())
        n, odd = max(len(w), 1), [c for c in t if c.isascii() and c > " " and c != "\x7f" and not c.isalnum() and c not in ".,;:!?'\"()-"]
        want = {
            "n_bytes": len(raw), "n_words": len(w), "word_length": sum(len(x.encode()) for x in w) / n, "upper_share": sum("A" <= c <= "Z" for c in t) / max(letters, 1),
            "digit_share": sum("0" <= c <= "9" for c in t) / len(raw), "odd_share": len(odd) / len(raw), "distinct_share": len(set(w)) / n, "repeat_share": sum(a == b for a, b in zip(w, w[1:])) / n,
            "top_share": max(Counter(w).values(), default=0) / n, "longest_word": max((len(x.encode()) for x in w), default=0), "short_share": sum(len(x.encode()) <= 2 for x in w) / n,
            "mark_share": sum(c in ".,;:!?'\"()-" for c in t) / len(raw), "bare_odd_share": sum(len(x) == 1 and x in odd for x in w) / n, "marked_words": sum(x[-1] in odd for x in w) / n,
            "same_lines": 1 - len(set(lines)) / len(lines) if lines else 0, "line_length": sum(len(x.encode()) for x in lines) / max(len(lines), 1),
        }
        assert set(want) == set(Q.STATS)
        for name, value in want.items():
            assert math.isclose(row[Q.STATS.index(name)], value, abs_tol=1e-9), (name, t[:60])
    rng = np.random.default_rng(5)
    x = rng.random((400, len(Q.STATS)))
    y = ((x[:, 1] > 0.5) & (x[:, 3] < 0.7)).astype(float)
    paths = Q.boosted_paths(x, y)
    r = np.stack([Q.holds(p, x) for p in paths], axis=1).astype(float)
    for p, column in zip(paths, r.T, strict=True):
        assert column.tolist() == [float(all((row[k] > bound) == above for k, bound, above in p)) for row in x]
    weights, bias = Q.lasso(r, y, rounds=20_000)
    slope = r.T @ (1 / (1 + np.exp(-(r @ weights + bias))) - y) / len(y)
    assert np.all(np.abs(slope) <= Q.PENALTY + 1e-4) and np.allclose(slope[weights != 0], -np.sign(weights[weights != 0]) * Q.PENALTY, atol=1e-4)
    kept = [(p, float(v)) for p, v in zip(paths, weights, strict=True) if v]
    rows = spark.createDataFrame([tuple(map(float, row)) for row in x[:60]], ", ".join(f"{c} double" for c in Q.STATS))
    got = [v.p for v in rows.select(Q.compiled(kept, bias).alias("p")).collect()]
    assert np.allclose(sorted(got), sorted(1 / (1 + math.exp(-(bias + sum(v for p, v in kept if all((row[k] > b) == above for k, b, above in p))))) for row in x[:60]))


def test_toxicity_by_a_plain_loop(spark):
    """FTRL-proximal in a plain loop over dictionaries gives the same scores."""
    from sonolake.llm import textkernel as K

    rnd = random.Random(11)
    docs = [(i, " ".join(rnd.choices(["Bad", "so", "day", "tree", "é", "rain"] + ["vile"] * (i % 3 == 0), k=9))) for i in range(120)] + [(500, None), (501, "")]
    labels = [(i, int("vile" in t)) for i, t in docs if t]
    hashes = {w: int(K.Words(*K.text_buffers(__import__("pyarrow").array([w])), K.ALNUM, lower=True).hashes()[0]) for w in {low(x) for _, t in docs for x in (t or "").split()}}
    mixed = lambda v: int(K.mix(np.array([v % (1 << 64)], np.uint64))[0])

    def hashed(t):
        w = [hashes[low(x)] for x in (t or "").split()]
        pairs = [mixed(a * salt + b) for gap, salt in ((1, 0xD1342543DE82EF95), (2, 0xAF251AF3B0F025B5)) for a, b in zip(w, w[gap:])]
        return {v >> (64 - X.BITS) for v in [*w, *pairs]} | {"bias"}

    z, n = defaultdict(float), defaultdict(float)
    weight = lambda f: 0.0 if abs(z[f]) <= 1.0 else -(z[f] - math.copysign(1.0, z[f])) / ((X.BETA + math.sqrt(n[f])) / X.ALPHA + X.L2)
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    rows = sorted((mixed(i), hashed(dict(docs)[i]), y) for i, y in labels if not held(i))
    for _ in range(X.EPOCHS):
        for _, features, y in rows:
            w = {f: weight(f) for f in features}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for f in features:
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / X.ALPHA * w[f]
                n[f] += g * g
    got = {r.doc_id: r.score for r in X.toxicity(frame(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int"), l1=1.0).collect()}
    for i, t in docs:
        assert math.isclose(got[i], 1 / (1 + math.exp(-sum(map(weight, hashed(t))))), rel_tol=1e-9), i


def test_repeated_ids_are_learnt_alike(spark):
    docs = spark.createDataFrame([(i % 40, f"{'bad' if i % 2 else 'good'} w{i}") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for f in (quality, toxicity):
        runs = [sorted((r.doc_id, r.score) for r in f(docs.repartition(n, "text"), labels).collect()) for n in (1, 3)]
        assert runs[0] == runs[1] and len(runs[0]) == 400


def test_queries_are_registered():
    assert [q.split("_")[0] for q in QUERIES] == [f"op{n}" for n in range(1, 14)]
