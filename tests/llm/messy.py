"""Small tables with every awkward case: nulls, empty and very long texts, repeated rows, clashing extra columns."""

from __future__ import annotations

import random

LETTERS = ["alpha", "beta", "gamma", "delta", "river", "stone", "été", "straße", "niño", "42", "x1"]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 7))) for _ in range(n))


def texts() -> list[str | None]:
    base = prose(1, 300)
    out: list[str | None] = [None, "", "   \n\t ", "one", "Two words", base, base, base.upper(), base.replace(base.split()[5], "zz", 1)]
    out += [prose(100 + i, 20 + 13 * i) for i in range(12)]
    out += [prose(7, 20_000), "a  b\n\n c \n d e  ", "x<|endoftext|>y end", " wide 　 space\x00nul", "été " * 50, "🙂 emoji 🙂🙂 ok", "²½ ① Ⅷ"]
    return out


def documents(spark, rows=None):
    """doc_id, text, lang, source and columns that operators might use inside."""
    if rows is None:
        rows = []
        for i, t in enumerate(texts()):
            rows.append((i * 3 % 101, t, ["en", "de", None][i % 3], ["s1", "s0", None, "S2"][i % 4]))
        rows += [rows[5], rows[5], (None, texts()[5], None, "s1"), (None, None, "en", None), (None, prose(9, 30), "de", "s0"), (4, None, None, None)]
    schema = (
        "doc_id long, text string, lang string, source string, n_chars long, fp long, k string, h string, t string, "
        "body string, score string, size string, `a.b` string, words string, times int, root int, shard int, items string, "
        "__k string, __h string, __times int, __of string, __epochs int, __until double, __copy int"
    )
    return spark.createDataFrame(
        [(*r, len(r[1] or ""), 1, "k", "h", None, "b", "s", "z", "d", "w", 3, 2, 1, "i", "kk", "hh", 9, "o", 8, 0.5, 7) for r in rows], schema
    ).repartition(3)


def empty(spark):
    return documents(spark).limit(0)
