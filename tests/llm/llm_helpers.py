import random

WORDS = [a + b for a in "ba ce di fo gu ha je ki lo mu".split() for b in "ran ten sil mor pud".split()]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def changed(text: str, seed: int, n: int) -> str:
    """``text`` with n words replaced."""
    rng, words = random.Random(seed), text.split()
    for i in rng.sample(range(len(words)), n):
        words[i] = f"new{rng.random():.9f}"
    return " ".join(words)


SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, id long, tag string, size string, key string, "
    "n_words string, kept string, component_id string, row string, _x string, bad string, score string, "
    "_id string, _tag string, _raw string, _row string, _text string, _copy string, _n string, c string, d string"
)


def documents(spark, rows):
    """Rows (doc_id, text, lang, source) with further columns whose names operators might use themselves."""
    full = [(d, t, la, s, None if t is None else len(t), *[None] * 20) for d, t, la, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def odd_rows():
    long = prose(3, 200_000)
    base = prose(1, 120)
    return [
        (1, base, "en", "a"), (1, base, "en", "a"), (2, base, None, None), (3, None, "en", "b"), (4, "", "en", "b"),
        (5, " \n\t ", None, "c"), (None, prose(2, 80), "fr", "a"), (None, prose(2, 80), "fr", "a"), (None, None, None, None),
        (6, long, "en", "a"), (7, "x" * 300_000, "en", None), (8, "один два три " * 40, "ru", "ü"), (9, "a", "en", "a"),
    ]
