"""Records of CSV files of any size: line breaks in quotes, lines above the header, a header of its own per file.

Files are read in splits, line by line. What a line does to the quotes is a function of whether it starts inside one, so
lines of a block compose, blocks of a file compose, and a prefix over the few rows of the block table tells every block
whether it starts inside quotes. Only lines that open, continue or close such a record are brought together.

Lines: ``_file, _block`` (offset of the split), ``_n`` (order within the split), ``value``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldweave.session import freeze

# Charset names as configurations spell them and as Spark knows them (fixed values).
CHARSETS = {"utf8": "UTF-8", "latin1": "ISO-8859-1", "latin-1": "ISO-8859-1", "iso8859-1": "ISO-8859-1", "ascii": "US-ASCII"}


def charset(encoding: str) -> str:
    return CHARSETS.get(encoding.lower(), encoding.upper())


def file_lines(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """Lines of all files at ``path``. Texts of two or four bytes per character cannot be split and are read whole."""
    name = charset(encoding)
    if name.startswith(("UTF-16", "UTF-32")):
        texts = spark.read.format("binaryFile").load(path).select(F.col("path").alias("_file"), F.decode("content", name).alias("_text"))
        return text_lines(texts, "_file", F.col("_text"))
    raw = spark.read.text(path, lineSep="\n")
    value = F.col("value") if name == "UTF-8" else F.decode(F.col("value").cast("binary"), name)
    return raw.select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_n"), value.alias("value")
    )


def text_lines(texts: DataFrame, file_col: str, text: Column) -> DataFrame:
    """Lines of texts that are at hand as a column."""
    split = texts.select(F.col(file_col).alias("_file"), F.posexplode(F.split(text, "\n")).alias("_n", "value"))
    return split.select("_file", F.lit(0).cast("bigint").alias("_block"), F.col("_n").cast("bigint").alias("_n"), "value")


def _quote_steps(line: Column, delimiter: str) -> tuple[Column, Column]:
    """(a line that starts outside quotes ends inside, one that starts inside ends inside); quotes are doubled to escape.

    A quote opens only at the start of a field: marks of inches within a field are text.
    """
    sep = re.escape(delimiter)
    other = f"[^{sep}]" if len(delimiter) == 1 else f"(?:(?!{sep})[\\s\\S])"
    quoted = '[^"]*+(?:""[^"]*+)*+'
    field = f'(?:"{quoted}"{other}*+|(?!"){other}*+)'
    opened = f'(?:{field}{sep})*+"{quoted}\\z'
    has = F.contains(line, F.lit('"'))
    outside = has & line.rlike(f"\\A{opened}")
    inside = ~has | line.rlike(f'\\A{quoted}(?:\\z|"{other}*+{sep}{opened})')
    return F.coalesce(outside, F.lit(False)), F.coalesce(inside, F.lit(True))


def _carry(df: DataFrame, by: list[str], order: str, sets: str, turns: str) -> DataFrame:
    """``_base, _turned`` before each row, from rows that set a state (``sets``, else null) or turn it over (``turns``).

    The state before a row is ``_base`` (what the last row that sets one left), or the state before the first row where
    ``_base`` is null, turned ``_turned`` times.
    """
    w = Window.partitionBy(*by).orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    counted = df.withColumn("_turned", F.coalesce(F.sum(turns).over(before), F.lit(0)))
    adjusted = counted.withColumn("_base", F.when(F.col(sets).isNotNull(), F.pmod(F.col(sets) - F.col("_turned"), F.lit(2))))
    return adjusted.withColumn("_base", F.last("_base", ignorenulls=True).over(before))


def _state(first: Column) -> Column:
    return F.pmod(F.coalesce("_base", first) + F.col("_turned"), F.lit(2))


def line_blocks(lines: DataFrame, delimiter: str) -> DataFrame:
    """One row per split: ``_file, _block, _lines, _opens`` (1 where some line would leave a quote open)."""
    outside, _ = _quote_steps(F.col("value"), delimiter)
    return freeze(lines.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_lines"), F.max(outside.cast("int")).alias("_opens")), "blocks")


def records(lines: DataFrame, blocks: DataFrame, delimiter: str, header_row: int = 0, numbered: bool = False) -> tuple[DataFrame, DataFrame]:
    """(header record per file, all records below it): ``_file, header`` and ``_file, record`` without their line ends.

    The header is the record number ``header_row``, from 0; files that end before it have none and give no records. Blank
    lines count above the header and are left out below it. With ``numbered`` the records have ``line_no``, lines below
    the header's first one, from 0. A quote that is never closed does not count: from there on a line is a record.
    """
    chain = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    # splits that must be read in order: those that may hold the header, and all from the first one that opens a quote
    safe = F.when(F.col("_opens") == 0, F.col("_lines")).otherwise(0)
    before = lambda f, c: F.coalesce(f(c).over(chain), F.lit(0))
    marked = blocks.withColumns(
        {"_above": before(F.sum, "_lines"), "_safe": before(F.sum, safe), "_opened": F.greatest(F.col("_opens"), before(F.max, "_opens"))}
    )
    ordered = F.lit(numbered) | (F.col("_safe") <= header_row) | (F.col("_opened") == 1)
    marked = marked.select("_file", "_block", "_above", ordered.alias("_ordered"))

    known = lines.join(marked, ["_file", "_block"])
    whole = known.where(~F.col("_ordered")).select("_file", F.col("value").alias("record"))
    inside = known.where("_ordered")
    out, kept = _quote_steps(F.col("value"), delimiter)
    stepped = inside.withColumns({"_out": out.cast("int"), "_in": kept.cast("int")}).withColumns(
        {"_sets": F.when(F.col("_out") == F.col("_in"), F.col("_out")), "_turns": (F.col("_out") > F.col("_in")).cast("int")}
    )
    stepped = _carry(stepped, ["_file", "_block"], "_n", "_sets", "_turns")
    number = F.row_number().over(Window.partitionBy("_file", "_block").orderBy("_n"))
    parts = freeze(
        stepped.select("_file", "_block", (F.col("_above") + number - 1).alias("_line"), "value", "_base", "_turned", "_sets", "_turns", "_out", "_in"), "lines"
    )

    # what a whole split does to the quotes: its last line's step after what came before it
    ends = parts.groupBy("_file", "_block").agg(F.max_by(F.struct("_base", "_turned", "_sets", "_turns"), "_line").alias("_e"))
    after = ends.select("_file", "_block", "_e.*").withColumns(
        {
            "_sets": F.coalesce("_sets", F.when(F.col("_base").isNotNull(), F.pmod(F.col("_base") + F.col("_turned") + F.col("_turns"), F.lit(2)))),
            "_turns": F.when(F.col("_base").isNull() & F.col("_sets").isNull(), F.pmod(F.col("_turned") + F.col("_turns"), F.lit(2))).otherwise(0),
        }
    )
    entered = _carry(after.select("_file", "_block", "_sets", "_turns"), ["_file"], "_block", "_sets", "_turns")
    entered = entered.select("_file", "_block", _state(F.lit(0)).alias("_first"))

    placed = parts.join(entered, ["_file", "_block"]).withColumn("_open", _state(F.col("_first")))
    placed = placed.withColumn("_ends", F.when(F.col("_open") == 0, F.col("_out")).otherwise(F.col("_in")))
    placed = freeze(placed.select("_file", "_block", "_line", "value", "_open", "_ends"), "placed")
    begun = F.when(F.col("_open") == 0, F.col("_line"))
    tops = placed.groupBy("_file", "_block").agg(F.max(begun).alias("_top"), F.max_by("_ends", "_line").alias("_ends"))
    tops = tops.withColumn("_carried", F.max("_top").over(chain))
    # the record that a file ends in without a closing quote
    loose = tops.groupBy("_file").agg(F.max_by("_ends", "_block").alias("_e"), F.max("_top").alias("_loose")).where("_e = 1").select("_file", "_loose")
    single = placed.where("_open = 0 and _ends = 0").select("_file", "_line", F.col("value").alias("record"))
    several = placed.where("_open = 1 or _ends = 1").join(tops.select("_file", "_block", "_carried"), ["_file", "_block"]).join(loose, "_file", "left")
    running = F.max(begun).over(Window.partitionBy("_file", "_block").orderBy("_line"))
    several = several.withColumn("_start", F.coalesce(running, "_carried"))
    several = several.withColumn("_start", F.when(F.col("_start") == F.col("_loose"), F.col("_line")).otherwise(F.col("_start")))
    pieces = F.array_sort(F.collect_list(F.struct("_line", "value")))
    joined = several.groupBy("_file", F.col("_start").alias("_line")).agg(F.array_join(F.transform(pieces, lambda p: p["value"]), "\n").alias("record"))
    in_order = freeze(single.unionByName(joined), "records")

    rank = F.row_number().over(Window.partitionBy("_file").orderBy("_line"))
    head = in_order.withColumn("_rank", rank).where(F.col("_rank") <= header_row + 1).where(F.col("_rank") == header_row + 1)
    bare = lambda c: F.regexp_replace(c, r"\r\z", "")
    head = freeze(head.select("_file", F.col("_line").alias("_header_line"), bare(F.col("record")).alias("header")), "headers")
    below = in_order.join(head, "_file").where(F.col("_line") > F.col("_header_line"))
    line_no = (F.col("_line") - F.col("_header_line") - 1).alias("line_no")
    if numbered:
        body = below.select("_file", line_no, bare(F.col("record")).alias("record"))
    else:
        body = below.select("_file", "record").unionByName(whole.join(head, "_file", "left_semi")).select("_file", bare(F.col("record")).alias("record"))
    return head.select("_file", "header"), body.where(F.trim("record") != "")


def csv_options(delimiter: str) -> dict[str, str]:
    return {"sep": delimiter, "escape": '"', "quote": '"', "multiLine": "true"}


def cells(record: Column, width: int, delimiter: str) -> Column:
    """Fields of one CSV record as an array."""
    schema = ", ".join(f"c{i} string" for i in range(width))
    parsed = F.from_csv(record, F.lit(schema), csv_options(delimiter))
    return F.array(*[parsed[f"c{i}"] for i in range(width)])


def header_width(headers: DataFrame, delimiter: str) -> int:
    """Columns of the widest header, or more where names hold the delimiter."""
    top = headers.agg(F.max(F.size(F.split("header", re.escape(delimiter))))).collect()[0][0]
    return max(1, top or 1)


def header_names(headers: DataFrame, width: int, delimiter: str) -> DataFrame:
    """``_file, names``; like the built-in reader a name that is missing, or there twice, goes by its position."""
    count = F.size(F.split("header", re.escape(delimiter)))
    raw = F.transform(F.slice(cells(F.col("header"), width, delimiter), F.lit(1), count), lambda c: F.trim(F.coalesce(c, F.lit(""))))

    def named(names: Column) -> Column:
        again = lambda c: F.size(F.filter(names, lambda o: F.lower(o) == F.lower(c))) > 1
        return F.transform(
            names, lambda c, i: F.when(c == "", F.concat(F.lit("_c"), i.cast("string"))).when(again(c), F.concat(c, i.cast("string"))).otherwise(c)
        )

    return headers.select("_file", raw.alias("_raw")).select("_file", named(F.col("_raw")).alias("names"))


def columns_of(body: DataFrame, names: DataFrame, width: int, delimiter: str) -> DataFrame:
    """Records as columns, by the header of their own file; all names of all files, letter case aside.

    Only the distinct names come to the driver: they are the columns of the result.
    """
    found = names.select("names").distinct().select("names", F.posexplode("names").alias("at", "name"))
    first = found.groupBy(F.lower("name").alias("key")).agg(F.min(F.struct(F.array_join("names", delimiter).alias("h"), "at", "name")).alias("f"))
    order = [r["name"] for r in first.orderBy("f").select("f.name").collect()]
    lowered = F.transform("names", F.lower)
    at = F.array(*[F.array_position(lowered, n.lower()).cast("int") - 1 for n in order])
    rows = body.join(names.select("_file", at.alias("_at")), "_file").select("_at", cells(F.col("record"), width, delimiter).alias("_cells"))
    return rows.select(*[F.when(F.col("_at")[i] >= 0, F.get("_cells", F.col("_at")[i])).alias(n) for i, n in enumerate(order)])
