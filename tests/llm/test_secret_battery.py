"""The randomness battery and its limits against plain Python, span by span."""

import collections
import math
import random
import re

from evidentia.llm import secrets

HEXES, THIRTY_TWO, SIXTY_FOUR = (secrets.ALPHABETS[k] for k in ("hex", "base32", "base64"))


def encoding(s):
    digit = re.search("[0-9]", s)
    if digit and re.search("[a-fA-F]", s) and re.fullmatch("[0-9a-f]+|[0-9A-F]+", s):
        return "hex"
    if digit and re.search("[A-Z]", s) and re.fullmatch("[A-Z2-7]+=*", s):
        return "base32"
    return "base64" if digit and re.search("[A-Z]", s) and re.search("[a-z]", s) else None


def p_value(s):
    """Smallest of three two-sided p-values, corrected for being the smallest."""
    name = encoding(s)
    alphabet = secrets.ALPHABETS[name]
    plain = s.rstrip("=").replace("-", "+").replace("_", "/")
    codes = [alphabet.index(c) for c in (plain.lower() if name == "hex" else plain)]
    k, n = len(alphabet), len(codes)
    chi = sum((c - n / k) ** 2 / (n / k) for c in [codes.count(x) for x in range(k)])
    middle = (k - 1) / 2
    changes = sum((a < k / 2) != (b < k / 2) for a, b in zip(codes, codes[1:]))
    products = sum((a - middle) * (b - middle) for a, b in zip(codes, codes[1:]))
    z = [
        (chi - (k - 1)) / math.sqrt(2 * (k - 1) * (1 - 1 / n)), (changes - (n - 1) / 2) / math.sqrt((n - 1) / 4),
        products / (math.sqrt(n - 1) * (k * k - 1) / 12),
    ]
    return 1 - (1 - min(math.erfc(abs(x) / math.sqrt(2)) for x in z)) ** 3


def brute(rows):
    """(start, end) of every random-looking string of each text."""
    found = [(i, m.start(), m.end(), m.group()) for i, (_, t) in enumerate(rows) for m in re.finditer(secrets.CANDIDATE, t or "") if encoding(m.group())]
    held = collections.defaultdict(collections.Counter)
    cls = lambda s: (encoding(s), len(s).bit_length() - 1)
    for s in {f[3] for f in found}:
        held[cls(s)][min(int(p_value(s) * secrets.BINS), secrets.BINS - 1)] += 1
    limit = {}
    for name, bins in held.items():
        spread = 2 * sum(c for b, c in bins.items() if b >= secrets.BINS // 2)
        for t in range(secrets.BINS):
            above = sum(c for b, c in bins.items() if b >= t)
            if above and max(0.0, above - spread * (1 - t / secrets.BINS)) <= secrets.RATE * above:
                limit[name] = t / secrets.BINS
                break
    out = collections.defaultdict(list)
    for i, a, b, s in found:
        if cls(s) in limit and p_value(s) >= limit[cls(s)]:
            out[i].append((a, b))
    return out


def test_every_random_span(spark):
    rng = random.Random(3)
    rows = []
    for key in range(260):
        words = []
        for _ in range(rng.randint(1, 6)):
            kind, n = rng.randrange(6), rng.choice([20, 24, 31, 40, 64])
            alphabet = (HEXES, HEXES.upper(), THIRTY_TWO, SIXTY_FOUR)[kind] if kind < 4 else None
            if alphabet:
                words.append("".join(rng.choice(alphabet) for _ in range(n)))
            elif kind == 4:
                words.append("Chapter1" + "TheQuickBrownFox" * 2)
            else:
                words.append("".join(rng.choice("aB1") for _ in range(n)))
        rows.append((key, f"é {' , '.join(words)} end"))
    rows += [(900, None), (901, ""), (902, rows[0][1]), (903, rows[0][1])]
    want = brute(rows)
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"] if s["kind"] == "random"]
           for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {key: want[i] for i, (key, _) in enumerate(rows)}
    assert sum(map(len, got.values())) > 300
