"""Small tables with every odd row: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random
import re

COLUMNS = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "row long, digest string, fingerprint long, place long, n_lines long, digests string, kept_id long, key string"
)
BLANK_WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = str.maketrans(UPPER, UPPER.lower())


def lower(text):
    return (text or "").translate(LOWER)


def words(text):
    return BLANK_WORD.findall(lower(text))


def sentence(rng, n):
    return " ".join(rng.choice(SYLLABLES) + rng.choice(SYLLABLES) for _ in range(n))


SYLLABLES = "the und de la tion ung les ción einer with von que für ée ño ing".split()


def texts(seed=1):
    rng = random.Random(seed)
    shared = [sentence(rng, 25) for _ in range(6)]
    out = [None, "", " \t\n ", "\n\n", "Öß É", "1234 5678 —", "a", "A b c D", "x " * 40_000, "no break\x1cunit  line", "z" * 30_000]
    for _ in range(60):
        lines = [rng.choice(shared) if rng.random() < 0.3 else sentence(rng, rng.randint(1, 60)) for _ in range(rng.randint(1, 6))]
        out.append("\n".join(lines))
    for text in rng.sample(out[11:], 12):
        swapped = text.split(" ")
        swapped[len(swapped) // 2] = "changed"
        out += [text, text.upper().lower(), " ".join(swapped), text.capitalize()]
    return out


def rows(seed=1, nulls=False):
    rng = random.Random(seed)
    all_texts = texts(seed)
    ids = rng.sample(range(1000), len(all_texts))
    out = [(i, t, rng.choice(["en", "de", None]), "src", 0) + (0, "d", 1, 2, 3, "x", 4, "k") for i, t in zip(ids, all_texts)]
    if nulls:
        out += [(None, t, None, None, None) + (None,) * 8 for t in (None, "", all_texts[20], all_texts[21])]
        out += [out[30], out[30], out[40]]
    return out


def documents(spark, seed=1, nulls=False, parts=3):
    return spark.createDataFrame(rows(seed, nulls), COLUMNS).repartition(parts, "doc_id")


def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def hot(spark, copies=400, parts=4):
    """One text in a third of all rows, and a line that all of them share."""
    rng = random.Random(9)
    line = sentence(rng, 40)
    base = sentence(rng, 60) + "\n" + line
    out = [(n, base if n % 3 == 0 else f"{sentence(rng, 50)}\n{line}") for n in range(copies)]
    return spark.createDataFrame(out, "doc_id long, text string").repartition(parts)
