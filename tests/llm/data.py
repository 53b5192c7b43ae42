"""Small tables with the awkward rows every operator must take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __node string, score string, n_lines int"

WORDS = "the of and to in is that it was for on are with as his they at be this from have or by one had not but what all were".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "a", "er", "ing", "s"]) for _ in range(n))


def documents(spark):
    """Null, empty, short, very long, equal, near equal and repeated texts; null and repeated keys; clashing names."""
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    texts = [
        (1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, "two words"), (7, prose(2, 30_000)),
        (8, "x" * 50_000), (9, "Ünïcödé  text\twith\nlines " + prose(3, 40)), (None, prose(4, 60)), (None, base),
        (10, prose(5, 80)), (10, prose(5, 80)), (10, prose(6, 80)), (11, " \n \t "), (12, base + " " + prose(7, 100)),
    ]
    rows = [(k, t, "en", None if i % 5 == 0 else f"s{i % 3}", 0, "clash", "clash", 7) for i, (k, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
