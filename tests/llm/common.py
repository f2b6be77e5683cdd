"""Plain reference rules and awkward documents for the operator tests."""

import random
import re

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def awkward(seed=3, n=60):
    """(doc_id, text) with nulls, blanks, copies, near copies, shared passages, one very long text."""
    rnd = random.Random(seed)
    vocabulary = ["the", "of", "é", "Ünder", "mit", "license", "a", "b-c", "x", "7", "under", "cc", "by", "nc", "naïve", "MIT"] + [f"w{i}" for i in range(300)]
    line = lambda k: rnd.choice([" ", "\n", "\t", "  "]).join(rnd.choices(vocabulary, k=k))
    passage = " ".join(f"p{i}" for i in range(60))
    docs = [(0, None), (1, ""), (2, " \n\t"), (3, "one"), (4, "one two"), (5, "ONE two"), (6, "same same same " * 30), (7, "same same same " * 30)]
    for i in range(8, n):
        t = line(rnd.choice([3, 12, 13, 14, 40, 120]))
        if i % 4 == 0:
            t = f"{t} {passage} {line(5)}"
        docs.append((i, t))
    base = line(150).split()
    for i in range(n, n + 12):
        own = list(base)
        for _ in range(i - n):
            own[rnd.randrange(len(own))] = f"z{rnd.randrange(99)}"
        docs.append((i, " ".join(own)))
    docs += [(n + 20 + i, docs[9 + i % 3][1]) for i in range(7)]
    docs.append((n + 40, line(6000)))
    return docs


def frame(spark, docs):
    """With columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2, 3) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long, bucket long, n_words long, spans long").repartition(3)
