"""Fill-in-middle forms of texts: markers put after the units of an escaped text, parts taken by rank, the exact text back.

All of it is column expressions. The text's own delimiters are escaped, a delimiter is appended after every unit, and
parts are what stands before the delimiter of a rank: no list of units is ever made, so that a very long text costs a few
copies of itself.

Defined cases: a null or empty text has no units and stays plain (null gives the empty output). A null key counts as the
empty string. Texts that hold one of the three marks stay plain, as they could not be restored. Rows are independent:
repeated rows and ties give equal rows. Columns of docs other than the key and the text are neither read nor returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: After each unit; it stands for itself nowhere else in an escaped text.
END = "\x1e"
ESCAPE = "\x1b"
LINES = r"[^\n]*\n|[^\n]+"
#: Of the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")


def escaped(text: Column) -> Column:
    """Text without END, from which unescaped() gives it back."""
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(f"{ESCAPE}e")), F.lit(END), F.lit(f"{ESCAPE}u"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(f"{ESCAPE}u"), F.lit(END)), F.lit(f"{ESCAPE}e"), F.lit(ESCAPE))


def marked(text: Column, units: str = LINES) -> Column:
    """The escaped text with END after every unit."""
    return F.regexp_replace(escaped(text), units, f"$0{END}")


def n_units(marked_text: Column) -> Column:
    return (F.length(marked_text) - F.length(F.replace(marked_text, F.lit(END)))).cast("long")


def plain_part(part: Column) -> Column:
    """A part of a marked text as it was."""
    return unescaped(F.replace(part, F.lit(END)))


def draws(seed: str, key: Column, n: int = 4) -> list[Column]:
    """The first n groups of eight hex digits of the sha256 of seed:key, as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(n)]


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output of a form was made from: the marks stand in it once each, in the order of its form."""
    p, s, m = marks
    psm = form == "psm"
    first, second = F.when(psm, F.lit(p)).otherwise(F.lit(s)), F.when(psm, F.lit(s)).otherwise(F.lit(p))
    at, to = F.position(second, output), F.position(F.lit(m), output)
    front = F.substr(output, F.length(first) + 1, at - 1 - F.length(first))
    back = F.substr(output, at + F.length(second), to - at - F.length(second))
    middle = F.substr(output, to + len(m))
    return F.when(form == "plain", output).otherwise(F.when(psm, F.concat(front, middle, back)).otherwise(F.concat(back, middle, front)))


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: str = "7", percent: int = 100, spm_percent: int = 50, units: str = LINES, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """(key, n, form, prefix, middle, suffix, output): texts cut at two random places between units and put together anew.

    units: a pattern that any text falls into wholly, in the engine's regular expressions. percent: of the texts, how many
    are cut; spm_percent: of those, how many have the suffix first. The same seed and key cut a text of so many units alike.
    plain rows have no parts, and the text as output.
    """
    p, s, m = marks
    h1, h2, h3, h4 = (F.col(f"_h{i}") for i in range(4))
    n, whole = F.col("n"), F.col("_marked")
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.withColumns({"_marked": marked(F.col("_text"), units)} | {f"_h{i}": h for i, h in enumerate(draws(seed, F.col(key)))})
    rows = rows.withColumn("n", n_units(whole))
    rows = rows.withColumns({"_a": F.least(h1 % (n + 1), h2 % (n + 1)).cast("int"), "_b": F.greatest(h1 % (n + 1), h2 % (n + 1)).cast("int")})
    first = lambda k: F.call_function("substring_index", whole, F.lit(END), k)  # noqa: E731  the units before the k-th mark
    holds_mark = F.contains("_text", F.lit(p)) | F.contains("_text", F.lit(s)) | F.contains("_text", F.lit(m))
    form = F.when((n == 0) | holds_mark | (h3 % 100 >= percent), "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    rows = rows.withColumn("form", form).withColumns({"_head": first(F.col("_a")), "_front": first(F.col("_b"))})
    cut = F.col("form") != "plain"
    parts = {
        "prefix": F.when(cut, plain_part(F.col("_head"))),
        "middle": F.when(cut, plain_part(F.substr("_front", F.length("_head") + 1))),
        "suffix": F.when(cut, plain_part(F.substr("_marked", F.length("_front") + 1))),
    }
    output = F.when(F.col("form") == "plain", F.col("_text")).when(F.col("form") == "psm", F.concat(F.lit(p), "prefix", F.lit(s), "suffix", F.lit(m), "middle")).otherwise(F.concat(F.lit(s), "suffix", F.lit(p), "prefix", F.lit(m), "middle"))
    return rows.withColumns(parts).select(key, "n", "form", *parts, output.alias("output"))
