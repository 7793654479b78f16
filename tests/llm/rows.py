"""Small documents that hit nulls, empties, repeats, ties, long texts and clashing names."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, th int, TEXT2 string, n_words string, score string"
_LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words(text, lower=False):
    b = (text or "").encode()
    return re.findall(rb"[^\x20\x09-\x0D]+", b.translate(_LOW) if lower else b)


def prose(r, n):
    return " ".join("".join(r.choice("abcdeéß") for _ in range(r.randint(1, 6))) for _ in range(n))


def documents(seed=0):
    r = random.Random(seed)
    shared = prose(r, 70)
    base = prose(r, 120).split(" ")
    out = [None, "", " \n\t ", "one", "two words", "ÉÄ ... 12", prose(r, 49), prose(r, 50), shared]
    out += [f"{prose(r, r.randint(0, 60))} {shared}  {prose(r, r.randint(0, 60))}" for _ in range(12)]
    for _ in range(14):
        near = list(base)
        for _ in range(r.randint(0, 6)):
            near[r.randrange(len(near))] = prose(r, 1)
        out.append(" ".join(near))
    out += [out[10], out[10].replace(" ", "\n"), out[10].upper(), " ".join(base), prose(r, 6000), "x" * 20000, "same " * 300]
    ids = list(range(len(out)))
    r.shuffle(ids)
    rows = [(i, t) for i, t in zip(ids, out, strict=True)]
    return [*rows, rows[9], rows[9], (None, out[10]), (None, "no id here at all")]


def frame(spark, rows, lang=None):
    full = [(i, t, lang(t) if lang else "en", "s", len(t or ""), 1, "clash", "n", "s") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)
