"""Small inputs and plain counterparts of the operators."""

import random
import re

SPACED = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text, pattern=SPACED):
    return re.findall(pattern, lower(text))


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


ODD = [None, "", " \n\t", "one", "One  TWO\tthree", "é日本 ü\u3000x", "a" * 300, "\n".join(["same line here"] * 4)]


def sample():
    """Ids and texts: odd ones, plain ones, exact copies and near copies of several degrees."""
    rows = list(enumerate(ODD))
    base = [prose(s, 60 + 7 * s) for s in range(12)]
    rows += [(100 + i, t) for i, t in enumerate(base)]
    rows += [(200 + i, base[i % 3]) for i in range(9)]
    for i in range(40):
        rng = random.Random(i)
        copy = base[i % 4].split()
        for _ in range(i % 6):
            copy[rng.randrange(len(copy))] = f"x{i}"
        rows.append((300 + i, " ".join(copy)))
    return rows
