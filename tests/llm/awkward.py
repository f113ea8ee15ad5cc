"""Documents with everything that operators must bear: nulls in any column, empty and very long texts, ties, repeated rows, clashing columns."""

import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, node long, key string, size int, row_hash string, doc string, keep int, spans string, mix_n string, mix_foo int, _keep int, _n_lines int, _near_node string, row int, label int, score double"


def texts(seed=2):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, line = say(70), "This Line is held by many documents"
    out = ["", None, " ", "\n", "one", "one two three", "x" * 5000, "é" * 300 + "😀" * 50, say(20_000)]
    for k in range(40):
        body = say(rng.randint(30, 200))
        if k % 4 == 0:
            body = body + "\n" + passage + "\n" + say(30)
        if k % 3 == 0:
            body = f"{body}\n  {line.upper() if k % 2 else line}\t\n{say(10)}"
        out.append(body)
    near = say(300).split(" ")
    for _ in range(8):
        copy = list(near)
        copy[rng.randrange(300)] = "edited"
        out.append(" ".join(copy))
    return [*out, out[10], out[10], out[12]]


def rows(seed=2):
    found = [(k, t, "en" if k % 2 else None, None if k % 7 == 0 else f"src{k % 3}", None if t is None else len(t)) for k, t in enumerate(texts(seed))]
    # A repeated row, a tie of doc_id, and rows without doc_id.
    found += [found[15], (20, "another text under an id that exists " * 8, None, "src1", 5), (None, "a text without an id " * 12, "en", "src0", 1), (None, None, None, None, None)]
    extra = (7, "k", 3, "h", "d", 0, "s", "m", 4, 1, 5, "n", 6, 2, 0.5)
    return [(*r, *extra) for r in found]


def documents(spark, seed=2):
    return spark.createDataFrame(rows(seed), COLUMNS).repartition(3)


def unique_rows(seed=2):
    """doc_id and text of the rows with an id of their own."""
    return [(k, t or "") for k, t in enumerate(texts(seed))]


def unique(spark, seed=2):
    return spark.createDataFrame(list(enumerate(texts(seed))), "doc_id long, text string").repartition(3)


def empty(spark):
    return spark.createDataFrame([], COLUMNS)
