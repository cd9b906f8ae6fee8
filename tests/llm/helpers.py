"""Small documents with every awkward case, and brute-force versions of the operators."""

import random
import re

import numpy as np

SPACE = re.compile(r"[\x20\x09-\x0D]")
NAMES = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int, end: int = 9) -> str:
    rng = random.Random(seed)
    words = [rng.choice(NAMES) + rng.choice(NAMES) for _ in range(n)]
    return " ".join(w + "." if i % end == end - 1 else w for i, w in enumerate(words))


def awkward():
    """(doc_id, text): nulls, empty and blank texts, ties, repeated rows, copies, near copies, a very long text, odd characters."""
    base = prose(1, 120)
    near = base.replace(base.split()[40], "changed", 1)
    rows = [(1, base), (2, base + " "), (3, near), (4, None), (5, ""), (6, " \t\n"), (7, base.replace(" ", "\n")), (8, "one two three"), (9, "ONE two three"), (10, "one  two\tthree")]
    rows += [(11, prose(2, 200)), (11, prose(2, 200)), (12, prose(3, 60)), (12, prose(4, 60)), (None, prose(5, 50)), (None, None), (13, "Élan über naïve — “quoted” İstanbul 漢字   x"), (14, "x" * 3000 + " " + prose(6, 30000))]
    rows += [(20 + i, prose(7, 300)) for i in range(12)] + [(40 + i, prose(8, 150) + f" tail{i} end{i}") for i in range(12)]
    return rows


def docs(spark, rows=None, clash=False):
    rows = awkward() if rows is None else rows
    df = spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    if clash:  # extra columns with the operators' own names
        for c in ("h", "node", "digest", "n", "kept", "score", "key", "pos", "term", "piece", "bad", "k_id", "runs"):
            df = df.withColumn(c, df["n_chars"])
    return df.repartition(3)


def table(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, width=5):
    w = [x for x in SPACE.split(low(text)) if x]
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def mix(x):
    m64 = 2**64 - 1
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & m64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & m64
    return x ^ (x >> 31)


def plain_language(model, text):
    """(language, score, rejected) of a text by plain loops over the trained model."""
    words = (text or "").encode().lower().split()
    if not any(map(str.isalpha, text or "")) or not words:
        return "und", 0.0, True
    total, n = np.zeros(model.table.shape[1]), 0
    for w in words:
        w = b"<" + w + b">"
        for k in (2, 3, 4, 5):
            for i in range(len(w) - k + 1):
                total += model.table[mix(int.from_bytes(w[i : i + k], "little") + k & 2**64 - 1) >> 48]
                n += 1
    z = (total / n @ model.weights + model.bias) / model.temperature
    p = np.exp(z - z.max())
    p /= p.sum()
    return model.langs[p.argmax()], float(p.max()), bool(p.max() < model.threshold)
