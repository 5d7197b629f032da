"""Rows with nulls, empty and long texts, ties, repeats and clashing extra columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, id long, found string, n long, component long, region string, line string"


def hard_rows(seed=5, n=120, vocabulary=("the", "a", "Éa", "token", "=", "abc123def4567890", "#x", "d$", "password=0123456789ab", "\t", ".", ",")):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        text = "".join(r.choice(vocabulary) + r.choice([" ", "  ", "\n", " \n", ""]) for _ in range(r.randint(0, 40)))
        rows.append((i, text if r.random() > 0.05 else None, r.choice(["en", None]), r.choice(["s1", "s2", None])))
    rows += [(None, "no id here at all", "en", "s1"), (1000, "", "en", "s1"), (1001, " \n\t", None, None), (1002, "word " * 20_000, "en", "s1"), (1003, "x" * 100_000, "en", "s1")]
    rows += [rows[3], rows[3], rows[-1]]
    return [(*x, len(x[1] or ""), 0.25, 7, "found", 3, 9, "r", "l") for x in rows]


def hard_frame(spark, **settings):
    return spark.createDataFrame(hard_rows(**settings), SCHEMA)
