"""Text as lines: scans, comments, interval tables of functions, and joins of lines to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeline.functions.text import source_type


def read_sources(spark: SparkSession, path: str, suffix: str = ".sol") -> DataFrame:
    """file_path, text of all files below a folder, without build output."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").text(path, wholetext=True)
    files = files.select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("text"))
    return files.where(~F.col("file_path").rlike("/(out|cache)/"))


def split_lines(text: str | Column = "text") -> Column:
    return F.split(text, "\r\n|\r|\n")


def to_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """All columns but the text, with line_no (from 1) and raw; \\n, \\r\\n and \\r end lines. Null texts have none."""
    keep = [c for c in df.columns if c != text]
    return df.select(*keep, F.posexplode(split_lines(text)).alias("line_no", "raw")).withColumn("line_no", F.col("line_no") + 1)


def strip_comment(line: Column) -> Column:
    """What stands before //."""
    return F.split_part(line, F.lit("//"), F.lit(1))


def is_comment_or_blank(line: Column) -> Column:
    return F.trim(line).rlike(r"^(//|/\*|\*|$)")


def brace_delta(code: Column) -> Column:
    return F.length(F.replace(code, F.lit("}"), F.lit(""))) - F.length(F.replace(code, F.lit("{"), F.lit("")))


DECLARED_FUNCTION = r"\bfunction\s+([A-Za-z_][A-Za-z0-9_]*)\b"
DECLARED_SPECIAL = r"\b(constructor|receive|fallback)\s*\("
DECLARED_CONTRACT = r"\b(?:contract|interface|library)\s+([A-Za-z_][A-Za-z0-9_]*)"
_STATE = "struct<contract:string,depth:int,open:boolean,name:string,start:int,signature:array<string>,braces:int,found:array<struct<contract_name:string,function_name:string,start_line:int,end_line:int,signature:string>>>"


def _empty(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _said(code: Column) -> dict[str, Column]:
    """What the fold asks of a line, worked out once for each."""
    named = (F.nullif(F.regexp_extract(code, pattern, 1), F.lit("")) for pattern in (DECLARED_FUNCTION, DECLARED_SPECIAL))
    return {"delta": brace_delta(code).cast("int"), "contract": F.nullif(F.regexp_extract(code, DECLARED_CONTRACT, 1), F.lit("")), "named": F.coalesce(*named), "brace": code.contains("{"), "semicolon": code.contains(";")}


def _found() -> Column:
    """An array of contract_name, function_name, start_line, end_line, signature of the functions of a text, in order.

    One fold over a file's lines: a contract is open until its braces balance, a function from its declaration until
    its own do. Declarations without a body have no range. Multi-line signatures are joined.
    """
    coded = F.transform(split_lines(F.coalesce("text", F.lit(""))), lambda raw, i: F.struct((i + 1).cast("int").alias("no"), F.trim(raw).alias("raw"), strip_comment(raw).alias("code")))
    lines = F.transform(coded, lambda x: F.struct(x["no"].alias("no"), x["raw"].alias("raw"), *(c.alias(name) for name, c in _said(x["code"]).items())))
    start = F.struct(
        _empty("string").alias("contract"), F.lit(0).alias("depth"), F.lit(False).alias("open"), F.lit("").alias("name"), F.lit(0).alias("start"),
        F.array().cast("array<string>").alias("signature"), F.lit(0).alias("braces"), F.array().cast("array<struct<contract_name:string,function_name:string,start_line:int,end_line:int,signature:string>>").alias("found"),
    ).cast(_STATE)

    def step(s: Column, x: Column) -> Column:
        raw, delta, contract, named, brace, semicolon = (x[c] for c in ("raw", "delta", "contract", "named", "brace", "semicolon"))
        depth = F.when(s["contract"].isNotNull(), s["depth"] + delta).otherwise(s["depth"])
        left = s["contract"].isNotNull() & (depth <= 0)
        signature = F.when(s["open"], F.concat(s["signature"], F.array(raw))).otherwise(F.array(raw))
        braces = F.when(s["open"], s["braces"] + delta).otherwise(delta)
        body = F.array_join(signature, " ").contains("{")
        begins = ~s["open"] & contract.isNull() & ~left & named.isNotNull() & ~(semicolon & ~brace)
        inside = s["open"] | begins
        ends = inside & body & (braces <= 0) & (s["open"] | brace)
        dropped = s["open"] & ~body & semicolon
        name, first = F.when(begins, named).otherwise(s["name"]), F.when(begins, x["no"]).otherwise(s["start"])
        owner = F.when(s["open"], s["contract"]).when(contract.isNotNull(), contract).when(left, _empty("string")).otherwise(s["contract"])
        one = F.struct(owner.alias("contract_name"), name.alias("function_name"), first.alias("start_line"), x["no"].alias("end_line"), F.array_join(signature, " ").alias("signature"))
        return F.struct(
            owner.alias("contract"),
            F.when(s["open"], s["depth"]).when(contract.isNotNull(), F.greatest(s["depth"], F.lit(0)) + delta).when(left, F.lit(0)).otherwise(depth).alias("depth"),
            (inside & ~ends & ~dropped).alias("open"),
            name.alias("name"),
            first.alias("start"),
            F.when(inside, signature).otherwise(F.array().cast("array<string>")).alias("signature"),
            F.when(s["open"] & ~body, s["braces"]).otherwise(braces).alias("braces"),
            F.when(ends, F.concat(s["found"], F.array(one))).otherwise(s["found"]).alias("found"),
        ).cast(_STATE)

    return F.aggregate(lines, start, step)["found"]


def function_ranges(sources: DataFrame) -> DataFrame:
    """contract_name, function_name, start_line, end_line, signature of each function of (keys..., text)."""
    keys = [c for c in sources.columns if c != "text"]
    return sources.select(*keys, F.explode(_found()).alias("x")).select(*keys, "x.*")


def bodies(sources: DataFrame) -> DataFrame:
    """``function_ranges`` with each function's lines as an array, ``body``. They are cut from their own text, so nothing is joined."""
    keys = [c for c in sources.columns if c != "text"]
    found = sources.select(*keys, split_lines().alias("_lines"), F.explode(_found()).alias("x"))
    return found.select(*keys, "x.*", F.slice("_lines", F.col("x.start_line"), F.col("x.end_line") - F.col("x.start_line") + 1).alias("body"))


def held_lines(sources: DataFrame) -> DataFrame:
    """``to_lines`` with the function that holds each line, if one does: contract_name, function_name, start_line, end_line, signature.

    Functions of a text are in order and do not overlap, so with the gaps between them they are pieces of it, and a piece's
    lines are cut from the same row: nothing is joined.
    """
    keys = [c for c in sources.columns if c != "text"]
    inner = ["contract_name", "function_name", "start_line", "end_line", "signature"]
    texts = sources.where("text is not null").select(*keys, split_lines().alias("_lines"), _found().alias("_found"))
    piece = lambda first, last, r: F.struct(first.alias("first"), F.slice("_lines", first, last - first + 1).alias("lines"), r.alias("r"))
    begins, ends = F.concat("_found.start_line", F.array(F.size("_lines") + 1)), F.concat(F.array(F.lit(0)), F.col("_found.end_line"))
    none = F.struct(*(F.lit(None).cast("int" if c.endswith("_line") else "string").alias(c) for c in inner))
    gaps = F.zip_with(ends, begins, lambda end, begin: piece(end + 1, begin - 1, none))
    inside = F.transform("_found", lambda r: piece(r["start_line"], r["end_line"], F.struct(*(r[c].alias(c) for c in inner))))
    pieces = texts.select(*keys, F.explode(F.concat(inside, gaps)).alias("x"))
    return pieces.select(*keys, "x.first", "x.r", F.posexplode("x.lines").alias("nth", "raw")).select(*keys, (F.col("first") + F.col("nth")).alias("line_no"), "raw", "r.*")


def target_sources(sources: DataFrame) -> DataFrame:
    """Sources that are judged: production code and files of unknown kind."""
    return sources.where(source_type(F.col("file_path")).isin("production", "unknown"))


#: Lines of a bin, by which lines and ranges meet.
BIN = 64


def containing(lines: DataFrame, ranges: DataFrame, keys: list[str], line: str = "line_no") -> DataFrame:
    """Lines with the first range that holds them (left outer).

    An equi join on the file and a bin of BIN lines, then the interval: a line meets the ranges of its bin only. The joins shuffle:
    ranges compress so well that one small in a shuffle would fill the driver as a broadcast.
    """
    inner = [c for c in ranges.columns if c not in keys]
    bin_of = lambda c: F.floor(F.col(c) / BIN)
    spread = ranges.select(*keys, F.struct("start_line", "end_line", *(c for c in inner if c not in ("start_line", "end_line"))).alias("_r"), F.explode(F.sequence(bin_of("start_line"), bin_of("end_line"))).alias("_bin"))
    places = lines.select(*keys, line).distinct().withColumn("_bin", bin_of(line))
    met = places.join(spread.hint("merge"), [*keys, "_bin"]).where(F.col(line).between(F.col("_r.start_line"), F.col("_r.end_line")))
    held = met.groupBy(*keys, line).agg(F.min("_r").alias("_r")).select(*keys, line, *(F.col("_r")[c].alias(c) for c in inner))
    return lines.join(held.hint("merge"), [*keys, line], "left")


def nesting_ranges(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Lines with the running brace depth before and after each."""
    w = Window.partitionBy(*keys).orderBy("line_no")
    delta = brace_delta(strip_comment(F.col("raw")))
    return lines.withColumn("depth_after", F.sum(delta).over(w)).withColumn("depth_before", F.col("depth_after") - delta)
