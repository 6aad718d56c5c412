"""Small documents with the awkward cases: nulls, blanks, copies, repeated rows, long words, clashing columns."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, id string, fp string, shard string"


def words(rng: random.Random, n: int, vocabulary: int = 60) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def texts(seed: int = 1) -> list[str | None]:
    rng = random.Random(seed)
    base = [words(rng, n) for n in (1, 2, 3, 4, 9, 10, 30, 60, 120, 400)]
    near = base[9].split()
    near[7] = "changed"
    return [None, "", "  \t\n ", *base, base[8], base[8].upper(), " ".join(near), base[9] + "\n" + base[7], "é ü 漢字 漢字 \u00a0x", "a\x0bb\x0cc\rd", "x" * 300_000 + " " + words(rng, 20_000)]


def rows(seed: int = 1) -> list[tuple]:
    t = texts(seed)
    out = [(i, x, ("en", "fr", None)[i % 3], ("a", "b", "é", None)[i % 4], None if x is None else len(x), "s", "s", "s", "s", "s") for i, x in enumerate(t)]
    out.append(out[5])  # a repeated row
    out.append((5, "other text of the same id", "en", "a", 25, "s", "s", "s", "s", "s"))
    out.append((None, "a row without an id", None, None, None, None, None, None, None, None))
    return out


def documents(spark, seed: int = 1):
    return spark.createDataFrame(rows(seed), DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)
