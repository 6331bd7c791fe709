"""A small corpus with the hard cases: nulls, repeats, long and empty texts, shared passages, near copies."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, version int, anchor double, stretches string, n int, score string"


def corpus(seed=5, n=60):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(1, 9))) for _ in range(400)]
    words = lambda k: [r.choice(vocabulary) for _ in range(k)]
    passage, second = words(80), words(50)
    rows = []
    for i in range(n):
        body = words(r.randint(5, 250))
        if i % 3 == 0:
            at = r.randint(0, len(body))
            body[at:at] = passage[r.randint(0, 10) : 80 - r.randint(0, 10)]
        if i % 7 == 0:
            body += second
        rows.append([i, " ".join(body)])
    rows += [[100 + i, rows[0][1]] for i in range(4)]  # exact copies
    near = rows[1][1].split() * 3
    rows += [[110 + i, " ".join(near[:i] + ["changed"] + near[i + 1 :])] for i in range(6)]
    rows += [
        [200, None], [201, ""], [202, " \n\t "], [203, "one"], [204, "two words"], [205, "a " * 3000], [206, "x" * 5000], [207, "ab" * 700],
        [208, "é日本 ÄÖ ﬁ " * 60], [209, "  lead  and\n\n runs   of\tspace "], [210, "<|endoftext|> don't <s> ▁ x" * 5], [211, "# $ | % & * < > " * 12],
        [212, "word. " * 9 + "Line one\nLine one\nLine two\n" * 8], [213, " ".join(words(40)) + " " + "z" * 300],
        [None, "no identifier here " * 20], [None, None], [None, "no identifier here " * 20],
        [7, rows[7][1]], [7, rows[7][1]], [7, "another text with the same identifier"], [-5, "negative"],
    ]
    names = ["s1", "s2", "S3", None]
    return [(i, t, ("en", "de", None)[k % 3], names[k % 4], None if t is None else len(t), "r", k, 0.5, "s", k, "x") for k, (i, t) in enumerate(rows)]


def frame(spark, rows=None):
    return spark.createDataFrame(corpus() if rows is None else rows, SCHEMA).repartition(5)


def texts(rows=None):
    return [(r[0], (r[1] or "").encode()) for r in (corpus() if rows is None else rows)]


def collected(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)
