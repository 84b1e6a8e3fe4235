"""Fill-in-the-middle: texts are cut between units by zero-width boundaries, and a middle part is moved to the end.

A grammar of units is a list of pairs of character classes, and a unit ends wherever a character of the first class
stands before one of the second. Each pair is translated to a lookbehind and a lookahead, so Spark's split cuts at the
boundaries and consumes nothing: the pieces, joined, are the text. All of it runs on columns of one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANY = r"[\s\S]"
SPACE, WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
#: Grammars by name. words: a word with the white space before it, and what white space ends the text. lines: with their
#: line feeds. chars: code points. parts: runs of letters, of digits and of other characters; capitals begin a part.
GRAMMARS = {
    "words": [(WORD, SPACE)],
    "lines": [(r"\n", ANY)],
    "chars": [(ANY, ANY)],
    "parts": [(r"[\p{L}\p{M}]", r"[^\p{L}\p{M}]"), (r"\p{Nd}", r"\P{Nd}"), (r"[^\p{L}\p{M}]", r"[\p{L}\p{M}]"), (r"\P{Nd}", r"\p{Nd}"), (r"\p{Ll}", r"\p{Lu}")],
}
#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")


def boundary(grammar: str | list[tuple[str, str]]) -> str:
    """A regex that matches the empty string between two units of a grammar."""
    pairs = GRAMMARS[grammar] if isinstance(grammar, str) else grammar
    return "|".join(f"(?<={before})(?={after})" for before, after in pairs)


def units(text: Column, grammar: str | list[tuple[str, str]] = "words") -> Column:
    """The units of a text in order. Split gives one empty piece for an empty text, which has no unit; so does a null."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(grammar)))


def draws(key: Column, seed: int, n: int = 4) -> list[Column]:
    """Whole numbers below 2^32 that depend on seed and key alone; a null key counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(n)]


def transform(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", grammar: str | list[tuple[str, str]] = "words", rate: int = 50, spm: int = 80, seed: int = 42) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output for each row of docs.

    Two places between units, drawn by seed and doc_id, bound the middle; it may be empty. Of 100 documents about rate
    are moved, of these about spm to the form spm (suffix, prefix, middle), the others to psm (prefix, suffix, middle);
    the rest is plain. Null and empty texts, and those that hold a mark, are plain too, as it couldn't be told from
    the marks put in. prefix_chars and middle_chars are code points, null if plain; the output of a null text is empty.

    Rows are independent: repeated ones come out alike, a null doc_id counts as an empty one, an empty table gives an
    empty one. Texts of any length are cut whole, in one row. No other column of docs is read or kept, so their names
    may clash with those of the result.
    """
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    t, n, a, b = F.col("t"), F.col("n"), F.col("a"), F.col("b")
    plain = (t == "") | F.rlike(t, F.lit("|".join(MARKS))) | (h3 % 100 >= rate)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.withColumn("u", units(t, grammar)).withColumn("n", F.size("u").cast("long"))
    rows = rows.withColumn("form", F.when(plain, "plain").when(h4 % 100 < spm, "spm").otherwise("psm"))
    rows = rows.withColumns({"a": F.least(h1 % (n + 1), h2 % (n + 1)).cast("int"), "b": F.greatest(h1 % (n + 1), h2 % (n + 1)).cast("int")})
    part = lambda first, size: F.when(F.col("form") != "plain", F.array_join(F.slice("u", first, size), ""))
    rows = rows.select("doc_id", "n", "form", "t", part(F.lit(1), a).alias("p"), part(a + 1, b - a).alias("m"), part(b + 1, F.greatest(n.cast("int") - b, F.lit(0))).alias("s"))
    psm, spm_ = F.concat(F.lit(PREFIX), "p", F.lit(SUFFIX), "s", F.lit(MIDDLE), "m"), F.concat(F.lit(SUFFIX), "s", F.lit(PREFIX), "p", F.lit(MIDDLE), "m")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm_).otherwise(t)
    return rows.select("doc_id", "n", "form", F.length("p").cast("long").alias("prefix_chars"), F.length("m").cast("long").alias("middle_chars"), output.alias("output"))


def restore(moved: DataFrame, name: str = "restored", output: str = "output", form: str = "form") -> DataFrame:
    """moved with name: the text that transform made each output of. No mark begins inside another or in the text, so a cut at the marks finds the parts."""
    rows = moved.withColumn("parts_", F.split(output, "|".join(MARKS)))  # the first is empty
    first, second, third = (F.try_element_at("parts_", F.lit(i)) for i in (2, 3, 4))
    found = F.when(F.col(form) == "psm", F.concat(first, third, second)).when(F.col(form) == "spm", F.concat(second, third, first)).otherwise(F.col(output))
    return rows.withColumn(name, found).drop("parts_")
