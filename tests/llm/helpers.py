"""Small tables with nulls, empty and long texts, repeated rows and clashing columns; plain brute-force versions."""

from __future__ import annotations

import random
import re

WORDS = "the of and alpha beta gamma delta straße élan один 日本 x7 run-time it's we'll A B C zeta eta theta iota kappa".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, digest string, d long, variant long, places string"


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(400)) for _ in range(n))


def documents(seed: int = 1, n: int = 40) -> list[tuple]:
    """doc_id, text and clashing columns; copies, near copies, a shared passage, null and empty texts, a long one."""
    rng = random.Random(seed)
    shared = prose(rng, 60)
    texts: list[str | None] = [None, "", "   ", "one", "One two", prose(rng, 30_000)]
    for i in range(n):
        kind = i % 6
        if kind == 0 or len(texts) < 8:
            texts.append(prose(rng, rng.randrange(5, 120)))
        elif kind == 1:
            texts.append(rng.choice([t for t in texts if t]))
        elif kind == 2:
            words = prose(rng, 80).split()
            texts.append(" ".join(words))
            for _ in range(3):
                changed = list(words)
                changed[rng.randrange(80)] = f"new{rng.randrange(99)}"
                texts.append(" ".join(changed))
        elif kind == 3:
            texts.append(prose(rng, rng.randrange(0, 20)) + " " + shared + " " + prose(rng, rng.randrange(0, 20)))
        elif kind == 4:
            texts.append("é" * rng.randrange(40, 300))
        else:
            texts.append("\n".join([prose(rng, 6)] * rng.randrange(1, 12)))
    rows = [(i * 3, t, "en", "s", None if t is None else len(t), 0.5, "x", 1, 2, "y") for i, t in enumerate(texts)]
    return rows


def frame(spark, rows: list[tuple], parts: int = 3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def components(n: int, links) -> list[int]:
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text: str | None, size: int) -> set[tuple]:
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}
