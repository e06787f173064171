"""Fill-in-middle: texts cut at whole units by one counted regex a row.

Only SQL functions: ``regexp_count`` gives the number of units n, and a
pattern built for the row takes the first a units, the next b - a and the
rest in one match. Both counted groups are possessive, so the match neither
goes back nor nests, however many units there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import quoted, without

LINE = r"[^\n]*\n|[^\n]+"
MARKS = ("<P>", "<S>", "<M>")
RESULT = ("n", "form", "prefix_chars", "middle_chars", "output")


def _checked(marks: tuple[str, str, str]) -> None:
    """Marks must be told apart wherever they stand in an output."""
    for i, a in enumerate(marks):
        for j, b in enumerate(marks):
            overlap = any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)) + (i != j)))
            if not a or overlap or (i != j and a in b):
                raise ValueError("marks must not be empty, hold one another or overlap")


def _draws(seed: int | str, id_col: str) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(quoted(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def transform(
    docs: DataFrame, seed: int | str = 7, percent: int = 100, spm_percent: int = 50, unit: str = LINE, marks: tuple[str, str, str] = MARKS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Every row of ``docs`` with ``n`` (units of its whole text), ``form``
    (plain, psm or spm), ``prefix_chars``, ``middle_chars`` (null if plain)
    and ``output``.

    Two draws by hash of seed and id choose how many units go before and
    after the middle, a third whether the text stays plain (beyond
    ``percent`` of 100), a fourth the order. Texts that hold a mark, or none
    of the unit, stay plain. ``unit`` must match the text from one unit to
    the next without a gap and have no groups.

    Null and empty texts are plain with n = 0 and an empty output; a null id
    draws as an empty one; rows with equal ids draw alike; texts of any
    length are cut whole; columns named as a result give way to it; an empty
    table gives an empty result.
    """
    _checked(marks)
    pre, suf, mid = marks
    keep = without(docs, [*RESULT, "__text"])
    h1, h2, h3, h4 = _draws(seed, id_col)
    rows = docs.select(*[quoted(c) for c in keep], F.coalesce(quoted(text_col), F.lit("")).alias("__text"), h1.alias("__1"), h2.alias("__2"), h3.alias("__3"), h4.alias("__4"))
    rows = rows.withColumn("n", F.regexp_count("__text", F.lit(unit)).cast("long"))
    x, y = F.col("__1") % (F.col("n") + 1), F.col("__2") % (F.col("n") + 1)
    marked = F.lit(False)
    for m in marks:
        marked = marked | F.contains("__text", F.lit(m))
    plain = (F.col("n") == 0) | marked | (F.col("__3") % 100 >= percent)
    rows = rows.select("*", F.least(x, y).alias("__a"), F.greatest(x, y).alias("__b"), F.when(plain, "plain").when(F.col("__4") % 100 < spm_percent, "spm").otherwise("psm").alias("form"))
    group = f"((?:{unit}){{"
    pattern = F.concat(F.lit(r"(?s)\A" + group), F.col("__a"), F.lit("}+)" + group), F.col("__b") - F.col("__a"), F.lit(r"}+)(.*)\z"))
    p, s, m = ((mark.replace("\\", "\\\\").replace("$", "\\$") + f"${i}") for mark, i in ((pre, 1), (suf, 3), (mid, 2)))
    order = F.when(F.col("form") == "psm", F.lit(p + s + m)).otherwise(F.lit(s + p + m))
    rows = rows.withColumn("output", F.when(F.col("form") == "plain", F.col("__text")).otherwise(F.regexp_replace("__text", pattern, order)))
    prefix, middle, _ = _parts(marks)
    # counted from the output, in which every mark stands once
    return rows.select(*[quoted(c) for c in keep], "n", "form", F.length(prefix).cast("long").alias("prefix_chars"), F.length(middle).cast("long").alias("middle_chars"), "output")


def _parts(marks: tuple[str, str, str]) -> tuple[Column, Column, Column]:
    """Prefix, middle and suffix of ``output``; null if plain."""
    pre, suf, mid = marks
    out, psm, spm = F.col("output"), F.col("form") == "psm", F.col("form") == "spm"

    def between(a: str, b: str | None) -> Column:
        begin = F.instr(out, F.lit(a)) + len(a)
        size = F.instr(out, F.lit(b)) - begin if b else F.length(out)
        return F.substring(out, begin, size)

    prefix = F.when(psm, between(pre, suf)).when(spm, between(pre, mid))
    suffix = F.when(psm, between(suf, mid)).when(spm, between(suf, pre))
    return prefix, F.when(psm | spm, between(mid, None)), suffix


def restore(rows: DataFrame, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """Every row with ``restored``: the text that ``output`` and ``form`` were
    made from, and nothing else. A null output restores to null; another form
    than psm or spm counts as plain."""
    _checked(marks)
    keep = without(rows, ["restored"])
    prefix, middle, suffix = _parts(marks)
    return rows.select(*[quoted(c) for c in keep], F.when(F.col("form").isin("psm", "spm"), F.concat(prefix, middle, suffix)).otherwise(F.col("output")).alias("restored"))


def digests(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Per document the columns of :func:`transform` without its output, and
    the digests of the output and of the text restored from it."""
    sha = lambda c: F.sha2(F.encode(F.col(c), "UTF-8"), 256).alias(f"{c}_sha256")
    text = options.pop("text_col", "text")
    cut = transform(docs.select(quoted(id_col).alias("__id"), quoted(text).alias("text")), id_col="__id", **options)
    cut = restore(cut.drop("text"), options.get("marks", MARKS))
    return cut.select(F.col("__id").alias(id_col), "n", "form", "prefix_chars", "middle_chars", sha("output"), sha("restored"))
