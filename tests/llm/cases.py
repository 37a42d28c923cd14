"""Small documents for the tests: ordinary ones, and all that is awkward."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n_docs=60, seed=1, words=80):
    """Documents of invented words with exact copies, near copies, shared passages and repeated lines."""
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choice(["an", "be", "Tio", "ré", "ou", "st,", "la", "en."]) for _ in range(draw.randint(1, 3))) for _ in range(400)]
    passage = " ".join(draw.choice(vocabulary) for _ in range(30))
    texts = []
    for i in range(n_docs):
        kind = draw.randrange(6)
        if kind == 0 and texts:
            texts.append(draw.choice(texts))
        elif kind == 1 and texts:
            parts = draw.choice(texts).split(" ")
            parts[draw.randrange(len(parts))] = "changed"
            texts.append(" ".join(parts))
        else:
            parts = [draw.choice(vocabulary) for _ in range(draw.randint(3, words))]
            if kind == 2:
                parts.insert(len(parts) // 2, passage)
            text = " ".join(parts)
            texts.append("\n".join([text, text, "Short.", text[: len(text) // 2]]) if kind == 3 else text)
    return [(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(texts)]


def awkward():
    """NULLs in every column, empty and blank texts, a long one, odd characters, ties and repeated rows."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(4000))
    rows = [
        (1, None, "en", "a", 0),
        (2, "", None, "a", 0),
        (3, " \t\n\n ", "en", None, None),
        (4, "one", "en", "a", 3),
        (5, "one two three four", "en", "b", 18),
        (6, long, "en", "a", len(long)),
        (7, long, "en", "a", len(long)),
        (8, "Ünï côdé 😀 日本語 " * 12, "xx", "c", None),
        (9, "no\x00nul\x1fcontrol\x85marks \n" * 9, "en", "c", 1),
        (9, "no\x00nul\x1fcontrol\x85marks \n" * 9, "en", "c", 1),
        (10, "THE!! " * 70, "en", None, 420),
        (-3, "one two three four", "en", "b", 18),
        (2**40, "| # $ % & * < >\n" * 4, "en", "a", 1),
    ]
    return rows


def clashing(frame):
    """The frame with extra columns named like the operators' own."""
    from pyspark.sql import functions as F

    names = "key node label hits words shard slot size kept_id dirty_id rate copies draw score kept c0 posterior n_words".split()
    return frame.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
