"""Documents with the cases that every operator must stand: null, empty, blank and very long texts, ties, repeated rows, extra columns."""

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)] + str((x >> 16) % 97))
    return " ".join(out)


BASE = prose(1, 300)
DOCS = [
    (1, BASE),
    (2, BASE.replace(" ", "  ", 5)),
    (3, BASE.replace(" ", "\n")),
    (4, BASE + " tail"),
    (5, None),
    (6, ""),
    (7, " \t\n"),
    (8, prose(2, 60_000)),
    (9, "one two"),
    (10, "one two"),
    (10, "one two"),
    (11, "Ünïcödé 日本語 🙂 a_b 1.5,2 ▁x"),
    (12, prose(3, 200)),
    (13, "x" * 5000),
    (None, prose(4, 50)),
    (14, "ONE TWO"),
]
#: Extra columns with names that operators use inside.
EXTRA = "doc_id long, text string, _id long, _text string, score double, fp long, _class int, lang string"


def docs(spark, rows=DOCS):
    return spark.createDataFrame([(i, t, 7, "other", 0.5, 3, 1, "en") for i, t in rows], EXTRA)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)
