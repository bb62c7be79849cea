"""Splitting text at delimiters, with quotes, as one native expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _class(chars: str) -> str:
    return "".join("\\" + c if not c.isalnum() else c for c in chars)


def tokens(text: Column | str, delimiters: str = " ,;:\t", keep_blank: bool = False, quotes: str = "\"'") -> Column:
    """The fields of a text as an array of strings.

    Fields end at any of ``delimiters``. A quote character opens a span up to the next same character, or to the end;
    delimiters and other quotes inside count as text, and the marks themselves go. Empty fields are left out unless
    ``keep_blank``; a text that ends with a delimiter then has a blank field after it, one that ends with an empty pair of
    quotes has none for them. Empty text has no fields, nor has any text without delimiters given; null text gives null.
    """
    c = F.col(text) if isinstance(text, str) else text
    if not delimiters:
        return F.when(c.isNotNull(), F.array().cast("array<string>"))
    spans = [f"\\{q}([^\\{q}]*+)(?:\\{q}|\\z)" for q in quotes]
    plain = f"[^{_class(delimiters + quotes)}]++"
    field = "(?:" + "|".join([plain, *(s.replace("(", "(?:", 1) for s in spans)]) + ")*+"
    # one delimiter in front makes every match begin with one, so no match is empty
    raw = F.regexp_extract_all(F.concat(F.lit(delimiters[0]), c), F.lit(f"(?s)[{_class(delimiters)}]({field})"), F.lit(1))
    out = raw
    if quotes:
        marks, groups = "(?s)" + "|".join(spans), "".join(f"${n}" for n in range(1, len(spans) + 1))
        out = F.transform(raw, lambda x: F.regexp_replace(x, marks, groups))
    if keep_blank:
        out = F.when((F.element_at(out, -1) == "") & ~F.right(c, F.lit(1)).isin(*delimiters), F.slice(out, F.lit(1), F.size(out) - 1)).otherwise(out)
    else:
        out = F.filter(out, lambda x: x != "")
    return F.when(c == "", F.array().cast("array<string>")).otherwise(out)
