"""Small inputs that the operators' tests share."""

import random

WORDS = "the and of to in license under mit apache version 2 cc by nc été straße naïve 3 word token line data set big".split()


def texts(seed=0, n=60):
    """Nulls, empty and blank texts, repeats, ties and a very long text, with odd white space and symbols."""
    rnd = random.Random(seed)
    out = [None, "", " ", "\n", "\n\n", "\t \x0b\x0c\r", "a", "A b\nA b \na  B", "#*$%&|<> !", "x" * 5000, "   non ascii　space", "don't we'll I'M\n'r e", "0" * 300 + " " * 50 + "\n" * 20]
    for _ in range(n):
        ws = [rnd.choice(WORDS) + rnd.choice(["", "", ".", ",", "!", "#"]) for _ in range(rnd.randint(1, 120))]
        out.append("".join(w + rnd.choice([" ", " ", " ", "\n", "  "]) for w in ws))
    out += [out[20], out[21], out[20].upper(), " ".join(rnd.choice(WORDS) for _ in range(20000))]
    return out


def docs(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, ["en", "fr", None][i % 3], "s", 0 if t is None else len(t), "extra") for i, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, words string")
