"""Small tables with nulls, empty and very long texts, ties, repeated rows and clashing names."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words string, component_id string"


def words(rng, n, vocab=400):
    return " ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 3) + str(rng.randint(0, vocab)) for _ in range(n))


def documents(seed=7, n=60):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        text = words(rng, rng.choice([3, 12, 30, 60, 200]), 40)
        if i % 7 == 3 and out:
            text = out[rng.randrange(len(out))][1] or ""
        if i % 7 == 5 and out:
            parts = (out[rng.randrange(len(out))][1] or "x").split()
            for _ in range(max(1, len(parts) // 60)):
                parts[rng.randrange(len(parts))] = "edit%d" % rng.randint(0, 9)
            text = " ".join(parts)
        if i % 11 == 1:
            text = text + "\n" + text[: len(text) // 2] + "\n" + text
        out.append((i, text, "en", f"s{i % 4}", len(text), "x", "y"))
    long = words(rng, 6000, 3000)
    out += [
        (100, None, None, None, None, None, None),
        (101, "", "en", "s0", 0, None, None),
        (102, " \t\n\x0b\x0c\r ", "en", None, 7, None, None),
        (103, long, "en", "s1", len(long), None, None),
        (104, long + " tail", "en", "s1", len(long) + 5, None, None),
        (105, "one", "en", "s2", 3, None, None),
        (106, "one", "en", "s2", 3, None, None),
        (107, "One TWO three", "en", "s9", 13, None, None),
        (108, "ünï cödé \U0001f600 a\u00a0b \u2003 c #*$ <|x|> %&", "en", "\U0001f600", 30, None, None),
        (109, "stop " * 50, "en", "s3", 250, None, None),
        (110, "line a\nline a\nline b\n\nline a\n  \n", "en", "s3", 30, None, None),
    ]
    out.append(out[5])
    return out
