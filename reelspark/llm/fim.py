"""Fill-in-the-middle by escaped marker injection, in built-in functions.

A delimiter that texts may hold themselves is escaped first. ``regexp_replace`` then
puts it behind every unit, so the number of delimiters is the number of units and
``substring_index`` takes any run of units by rank. Parts are freed of delimiters,
unescaped and assembled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A unit: white space and the word behind it, or white space at the end of a text.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
# The delimiter, and the escape sign with what stands behind it for itself and for the delimiter; none is white space.
_CUT, _ESC, _OWN, _HIDDEN = "\x01", "\x02", "\x03", "\x04"


def escape(text: Column) -> Column:
    """``text`` without the delimiter; white space and words stay where they are."""
    return F.replace(F.replace(text, F.lit(_ESC), F.lit(_ESC + _OWN)), F.lit(_CUT), F.lit(_ESC + _HIDDEN))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(_ESC + _HIDDEN), F.lit(_CUT)), F.lit(_ESC + _OWN), F.lit(_ESC))


def marked(text: Column) -> Column:
    """The escaped text with a delimiter behind every unit."""
    return F.regexp_replace(escape(text), f"({UNIT})", "$1" + _CUT)


def units(mark: Column) -> Column:
    return F.length(mark) - F.length(F.replace(mark, F.lit(_CUT), F.lit("")))


def _up_to(mark: Column, count: Column) -> Column:
    """The first ``count`` parts of a marked text, or the last ``-count``."""
    return F.call_function("substring_index", mark, F.lit(_CUT), count.cast("int"))


def _plain(part: Column) -> Column:
    return unescape(F.replace(part, F.lit(_CUT), F.lit("")))


def restored(output: Column, form: Column) -> Column:
    """The text behind ``output``: its parts are found by the markers, none of which a text in another form than plain holds."""
    body, before, after = F.substring(output, 4, 2**31 - 1), F.lit(SUFFIX), F.lit(MIDDLE)
    cut = lambda x, sign, side: F.substring_index(x, sign, side)
    middle = cut(body, MIDDLE, -1)
    psm = F.concat(cut(body, SUFFIX, 1), middle, cut(cut(body, SUFFIX, -1), MIDDLE, 1))
    spm = F.concat(cut(cut(body, PREFIX, -1), MIDDLE, 1), middle, cut(body, PREFIX, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm_rate: int = 80) -> DataFrame:
    """``id, n, form, prefix_chars, middle_chars, output, restored`` per row.

    ``n`` counts units. A text is rearranged with a chance of ``rate`` in a hundred, of
    these ``spm_rate`` in a hundred with the suffix first; all choices come from the
    SHA-256 of seed and id, so rows with equal ids are cut by the same numbers, also null
    ids, which count as an empty string. A null text is an empty one; empty texts and
    texts that hold a marker stay plain, with null lengths. Texts of any length are
    read whole. Repeated rows give equal results, an empty table none. Other columns are
    ignored.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.sha2(F.concat(F.lit(f"{seed}:"), key), 256).alias("h"))
    group = lambda k: F.conv(F.substring("h", 8 * k + 1, 8), 16, 10).cast("long")
    rows = rows.select("id", "text", *[group(k).alias(f"h{k + 1}") for k in range(4)])
    rows = rows.withColumn("mark", marked(F.col("text"))).withColumn("n", units(F.col("mark")).cast("long"))
    held = (F.col("text") == "") | F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    form = F.when(held | (F.col("h3") % 100 >= rate), "plain").when(F.col("h4") % 100 < spm_rate, "spm").otherwise("psm")
    one, two = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    rows = rows.select("id", "text", "mark", "n", form.alias("form"), F.least(one, two).alias("low"), F.greatest(one, two).alias("high"))
    cut = F.col("form") != "plain"
    mark, low, high = F.col("mark"), F.col("low"), F.col("high")
    rows = rows.select(
        "id", "text", "n", "form",
        F.when(cut, _plain(_up_to(mark, low))).alias("prefix"),
        F.when(cut, _plain(_up_to(_up_to(mark, high), low - high))).alias("middle"),
        F.when(cut, _plain(_up_to(mark, high - F.col("n") - 1))).alias("suffix"),
    )
    psm = F.concat(F.lit(PREFIX), F.col("prefix"), F.lit(SUFFIX), F.col("suffix"), F.lit(MIDDLE), F.col("middle"))
    spm = F.concat(F.lit(SUFFIX), F.col("suffix"), F.lit(PREFIX), F.col("prefix"), F.lit(MIDDLE), F.col("middle"))
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    rows = rows.select("id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"), output.alias("output"))
    return rows.withColumn("restored", restored(F.col("output"), F.col("form")))
