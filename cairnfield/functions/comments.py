"""text without comments, by a scanner that knows strings; lines stay where they are."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Languages whose comments begin with a hash; the others are of the C family.
HASHED = ("python", "ruby", "shell")


def strip(text: str | None, lang: str | None) -> str | None:
    """text with comments, and docstrings of hashed languages, as spaces. Line ends and strings stay."""
    if text is None:
        return None
    hashed = lang in HASHED
    out, i, n = list(text), 0, len(text)

    def blank(a: int, b: int) -> None:
        for k in range(a, min(b, n)):
            if out[k] not in "\r\n":
                out[k] = " "

    while i < n:
        c, two, three = text[i], text[i : i + 2], text[i : i + 3]
        if hashed and three in ('"""', "'''"):
            end = text.find(three, i + 3)
            end = n if end < 0 else end + 3
            blank(i, end)
            i = end
        elif hashed and c == "#" or not hashed and two == "//":
            end = text.find("\n", i)
            end = n if end < 0 else end
            blank(i, end)
            i = end
        elif not hashed and two == "/*":
            end = text.find("*/", i + 2)
            end = n if end < 0 else end + 2
            blank(i, end)
            i = end
        elif c in "\"'`":
            k = i + 1
            while k < n and text[k] != c and (c == "`" or text[k] != "\n"):
                k += 2 if text[k] == "\\" else 1
            i = k + 1
        else:
            i += 1
    return "".join(out)


def stripped(text: Column, lang: Column) -> Column:
    """strip() over columns, in Arrow batches: a state machine that no regular expression equals."""

    @F.pandas_udf("string")
    def run(t: pd.Series, lang_: pd.Series) -> pd.Series:
        return pd.Series([strip(a if isinstance(a, str) else None, b) for a, b in zip(t, lang_, strict=True)], dtype=object)

    return run(text, lang)
