"""Tables and brute-force versions that the tests of this folder share."""

import random

import numpy as np

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use inside, as extra columns.
EXTRA = "id bigint, h string, n bigint, s0 bigint, s1 bigint, row bigint, key bigint, keep boolean, group_id bigint, rank int, toxic boolean, tokens string, lang_pred string, shard int, block int, before bigint, _n bigint, _y int, _id bigint, node bigint, root bigint, v string, u string"
WORDS = "the of and to in that was his with for they you have from this not but what all were when your said there use word how each which their will other about out many then them these some her would make like him into time has look two more write see number way could people than first water been call who oil sit now find long down day did get come made may part".split()


def prose(rng, n):
    out = []
    while len(out) < n:
        k = min(n - len(out), rng.randint(4, 12))
        words = [rng.choice(WORDS) for _ in range(k)]
        out += [words[0].capitalize(), *words[1:-1], words[-1] + "."] if k > 1 else [words[0].capitalize() + "."]
    return " ".join(out)


def extra(rows, width=23):
    """Rows with values in the columns of EXTRA."""
    return [(*r, 1, "x", 1, 1, 1, 1, 1, False, 1, 1, True, "x", "x", 1, 1, 1, 1, 1, 1, 1, 1, "x", "x") for r in rows]


def edge_rows():
    """Nulls in each column, empty, blank and very long texts, repeated rows, ids that repeat with other texts."""
    rng = random.Random(4)
    a = prose(rng, 60)
    return [
        (1, a, "en", "s1", 300),
        (1, a, "en", "s1", 300),
        (2, a, "en", "s2", 300),
        (3, None, "en", "s1", 0),
        (4, "", "en", "s1", 0),
        (5, "   \n ", None, None, None),
        (None, prose(rng, 50), "en", "s1", 250),
        (None, None, None, None, None),
        (6, prose(rng, 60_000), "en", "s2", 300_000),
        (7, "x" * 200_000, "en", "s2", 200_000),
        (8, "日本語 " * 50, "ja", "s3", 200),
        (9, "!!! 123 ???", "en", "s3", 11),
        (10, prose(rng, 80), "en", "", 400),
        (10, prose(rng, 80), "en", "s1", 400),
    ]


def documents(spark, rows, clash=True):
    return spark.createDataFrame(extra(rows) if clash else rows, f"{SCHEMA}, {EXTRA}" if clash else SCHEMA)


def groups(n, pairs):
    """The least place of each one's component."""
    up = list(range(n))

    def find(k):
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return np.array([find(k) for k in range(n)])
