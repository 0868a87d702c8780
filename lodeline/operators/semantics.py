"""Meaning of statements: kinds, data flows, calls, checkpoint lookups, fee formulas, native payments and helper flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.functions.text import has_any
from lodeline.operators import codefacts as C
from lodeline.sources import sample

#: Patterns and terms of the facts.
CALL = r"\b([A-Za-z_][A-Za-z0-9_]*)\s*(?:\.\s*([A-Za-z_][A-Za-z0-9_]*))?\s*\("
ASSIGN = r"\b([A-Za-z_][A-Za-z0-9_]*(?:\s*\[[^\]]+\])?(?:\.[A-Za-z_][A-Za-z0-9_]*)?)\s*(=|\+=|-=|\*=|/=|\+\+|--)"
ALIAS = r"\b[A-Za-z_][A-Za-z0-9_]*(?:\s*\[[^\]]+\])?\s+storage\s+([A-Za-z_][A-Za-z0-9_]*)\s*=\s*([^;]+)"
NO_CALLS = ("if", "for", "while", "require", "assert", "return", "revert", "emit")
LOOKUPS = ("lowerLookup", "upperLookup", "upperLookupRecent", "latestCheckpoint", "latest", "push")
SIGNATURES = ("signature", "signatures", "signer", "signers", "threshold", "recover", "isvalidsignature")
TOKEN_CALLS = ("transfer", "transferFrom", "safeTransfer", "safeTransferFrom", "mint", "burn", "sendAssets", "receiveAssets")
NATIVE = (".send(", ".transfer(", ".call{value:", ".call{ value:")
FEES = ("fee",)
HELPERS = ("sendAssets", "receiveAssets", "safeTransferFrom", "safeTransfer", "transferFrom", "transfer")
HELPER_TERMS = ("sendassets", "receiveassets", "safetransfer", "transferfrom", ".transfer(")
UNITS = r"(D6|D18|Shares|Assets|Price|shares|assets|price)"
WORD = r"[A-Za-z_][A-Za-z0-9_]*"

SEMANTIC = """contract Rewards {
    uint256 public feeD6;
    mapping(uint256 => Batch) public batches;

    function settle(uint256 id, bytes[] calldata signatures) external {
        require(signatures.length >= threshold, "few");
        Batch storage batch = batches[id];
        uint256 fee = Math.mulDiv(shares, feeD6 * price(asset, 1), 1e18);
        uint256 cut = feeD6 * assetsPrice / DIVISOR;
        uint32 at = checkpoints.upperLookupRecent(uint32(block.timestamp));
        index--;
        total[id] += lookup(history.latest());
        vault.sendAssets(address(this), payTo(id, 2), fee);
        payable(keeper).transfer(1);
        helper.sendAssets(native, 1);
        return total;
    }

    receive() external payable {}
}
"""
SOURCES = (("semantic", "src/Rewards.sol", SEMANTIC), *sample.LINKED_SOURCES)


def call_arguments(code: Column, callee: Column) -> Column:
    """The text between the balanced parentheses of the first call of ``callee`` in a line; null without one.

    An open call reaches to the line's end.
    """
    start = F.instr(code, F.concat(callee, F.lit("(")))
    rest = F.substring(code, start + F.length(callee) + 1, F.length(code))
    begin = F.struct(F.lit(1).alias("depth"), F.lit("").alias("text"))

    def step(s: Column, c: Column) -> Column:
        depth = s["depth"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)
        open_ = s["depth"] > 0
        return F.struct(F.when(open_, depth).otherwise(0).alias("depth"), F.when(open_ & (depth > 0), F.concat(s["text"], c)).otherwise(s["text"]).alias("text"))

    return F.when(start > 0, F.aggregate(F.split(rest, ""), begin, step)["text"])


def split_arguments(arguments: Column) -> Column:
    """Arguments at commas outside parentheses, trimmed, empty ones left out."""
    begin = F.struct(F.lit(0).alias("depth"), F.lit("").alias("now"), F.array().cast("array<string>").alias("done"))

    def step(s: Column, c: Column) -> Column:
        depth = s["depth"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)
        cut = (c == ",") & (depth == 0)
        return F.struct(depth.alias("depth"), F.when(cut, F.lit("")).otherwise(F.concat(s["now"], c)).alias("now"), F.when(cut, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]).alias("done"))

    parts = F.aggregate(F.split(F.coalesce(arguments, F.lit("")), ""), begin, step, lambda s: F.concat(s["done"], F.array(s["now"])))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def statements(rows: DataFrame) -> DataFrame:
    """PLACE, kind of every statement, the first that applies."""
    code, low = F.col("code"), F.lower("code")
    kind = F.when(code.rlike(r"\brequire\s*\("), "require").when(code.rlike(r"\bif\s*\("), "if").when(code.rlike(r"\bfor\s*\("), "for").when(code.rlike(ASSIGN), "assignment").when(code.rlike(CALL), "call")
    return rows.where(code != "").select(*C.PLACE, kind.when(low.startswith("return"), "return").when(low.startswith("emit"), "emit").otherwise("other").alias("kind"))


def data_flows(rows: DataFrame) -> DataFrame:
    """PLACE, to_expr, from_expr, flow_kind: the first assignment of a line, and a storage alias."""
    code = F.col("code")
    whole = F.regexp_extract(code, ASSIGN, 0)
    right = F.trim(F.regexp_replace(F.substring(code, F.instr(code, whole) + F.length(whole), F.length(code)), ";+$", ""))
    assigned = F.when(code.rlike(ASSIGN), F.struct(F.regexp_replace(F.regexp_extract(code, ASSIGN, 1), r"\s+", "").alias("to_expr"), F.when(right != "", right).otherwise(F.regexp_extract(code, ASSIGN, 2)).alias("from_expr"), F.lit("assignment").alias("flow_kind")))
    alias = F.when(code.rlike(ALIAS), F.struct(F.regexp_extract(code, ALIAS, 1).alias("to_expr"), F.trim(F.regexp_extract(code, ALIAS, 2)).alias("from_expr"), F.lit("storage_alias").alias("flow_kind")))
    return rows.select(*C.PLACE, F.explode(F.array_compact(F.array(assigned, alias))).alias("x")).select(*C.PLACE, "x.*")


def semantic_calls(rows: DataFrame) -> DataFrame:
    """PLACE, callee, receiver, call_kind, arguments of every call of a line."""
    code = F.col("code")
    calls = rows.select(*C.PLACE, "code", F.explode(C.all_groups(code, CALL, 1, 2)).alias("m"))
    calls = calls.select(*C.PLACE, "code", F.col("m.g1").alias("first"), F.nullif("m.g2", F.lit("")).alias("method")).withColumn("callee", F.coalesce("method", "first")).where(~F.col("callee").isin(*NO_CALLS))
    kind = (
        F.when(F.col("callee").isin(*LOOKUPS), "checkpoint")
        .when(has_any(F.lower("callee"), SIGNATURES) | has_any(F.lower("code"), SIGNATURES), "signature")
        .when(F.col("callee").isin(*TOKEN_CALLS), "token")
        .when(has_any(code, NATIVE), "native_transfer")
        .when(F.col("first").rlike("^[A-Z]"), "library")
        .otherwise("external")
    )
    return calls.select(*C.PLACE, "callee", F.when(F.col("method").isNotNull(), F.col("first")).alias("receiver"), kind.alias("call_kind"), F.nullif(call_arguments(code, F.col("callee")), F.lit("")).alias("arguments"))


def checkpoint_lookups(rows: DataFrame) -> DataFrame:
    """PLACE, lookup, direction, adjustment, at_expr: lookups of checkpoints, and steps of an index."""
    code = F.col("code")
    step = F.when(code.contains("--"), "decrement").when(code.contains("++"), "increment").otherwise("none")
    found = [F.when(code.contains(f".{m}("), F.struct(F.lit(m).alias("lookup"), F.lit("lower" if m.startswith("lower") else "upper" if m.startswith("upper") else "latest" if "latest" in m else "unknown").alias("direction"))) for m in LOOKUPS]
    adjusted = F.when(code.rlike(r"\b[A-Za-z_][A-Za-z0-9_]*\s*(?:--|\+\+)") & has_any(F.lower("code"), ("index", "iterator", "batch")), F.struct(F.lit("index_adjustment").alias("lookup"), F.lit("unknown").alias("direction")))
    placed = rows.select(*C.PLACE, "code", F.explode(F.array_compact(F.array(*found, adjusted))).alias("x")).select(*C.PLACE, "code", "x.*")
    return placed.select(*C.PLACE, "lookup", "direction", step.alias("adjustment"), F.get(split_arguments(call_arguments(code, F.col("lookup"))), F.lit(0)).alias("at_expr"))


def fee_formulas(rows: DataFrame) -> DataFrame:
    """PLACE, denominator, numerator, units: lines that compute a fee."""
    code = F.col("code")
    fees = rows.where(has_any(F.lower("code"), FEES) & has_any(code, ("*", "/", "mulDiv")))
    args = split_arguments(call_arguments(code, F.lit("mulDiv")))
    words = F.regexp_extract_all(code, F.lit(WORD), F.lit(0))
    ratio = code.contains("mulDiv")
    bottom = F.when(ratio, F.when(F.size(args) >= 3, F.element_at(args, -1))).otherwise(F.nullif(F.regexp_extract(code, r"/\s*([A-Za-z0-9_]+)", 1), F.lit("")))
    top = F.slice(F.array_distinct(F.when(ratio, F.slice(args, 1, 2)).otherwise(words)), 1, 12)
    units = F.slice(F.array_distinct(F.filter(words, lambda w: w.rlike(UNITS))), 1, 12)
    return fees.select(*C.PLACE, bottom.alias("denominator"), top.alias("numerator"), units.alias("units"))


def native_payments(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """PLACE, receiver, can_receive: native transfers, and whether the receiver, if it is a known contract, takes them (else null)."""
    code, low = F.col("code"), F.lower("code")
    compact = F.replace(low, F.lit(" "), F.lit(""))
    native = (has_any(compact, ("sendassets(", "receiveassets(")) & low.contains("native")) | has_any(compact, (".call{value:", ".send(", ".transfer("))
    receiver = F.coalesce(F.nullif(F.regexp_extract(code, r"\b([A-Za-z_][A-Za-z0-9_]*)\s*\.\s*(?:call|send|transfer)\b", 1), F.lit("")), F.nullif(F.regexp_extract(code, r"payable\s*\(\s*([A-Za-z_][A-Za-z0-9_]*)\s*\)", 1), F.lit("")))
    from lodeline.sources import lines as L

    ranges = L.function_ranges(sources).groupBy("repo", F.col("contract_name").alias("receiver")).agg(F.bool_or(F.col("function_name").isin("receive", "fallback")).alias("can_receive"))
    paid = rows.where(native & ~has_any(low, ("safetransfer", "transferfrom"))).select(*C.PLACE, receiver.alias("receiver"))
    return paid.join(ranges, ["repo", "receiver"], "left").select(*C.PLACE, "receiver", "can_receive")


def helper_flows(rows: DataFrame) -> DataFrame:
    """PLACE, asset_kind, from_expr, to_expr, amount_expr: asset movements through helpers, arguments split by balance."""
    code, low = F.col("code"), F.lower("code")
    arguments = F.coalesce(*(F.nullif(call_arguments(code, F.lit(h)), F.lit("")) for h in HELPERS))
    found = rows.where(has_any(low, HELPER_TERMS)).withColumn("a", split_arguments(arguments))
    kind = F.when(low.contains("native") | low.contains("msg.value"), "native").when(low.contains("erc721") | low.contains("nft"), "erc721").otherwise("erc20")
    n, arg = F.size("a"), lambda i: F.get("a", F.lit(i))
    return found.select(*C.PLACE, kind.alias("asset_kind"), F.when(n >= 3, arg(0)).alias("from_expr"), F.when(n >= 3, arg(1)).otherwise(arg(0)).alias("to_expr"), F.when(n >= 3, arg(2)).otherwise(arg(1)).alias("amount_expr"))


def _facts(spark: SparkSession, sf_dir: str) -> C.Facts:
    return C.Facts(sample.repositories(spark, sf_dir, SOURCES))


def q_statement_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements(_facts(spark, sf_dir).rows)


def q_data_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return data_flows(_facts(spark, sf_dir).rows)


def q_semantic_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic_calls(_facts(spark, sf_dir).rows)


def q_checkpoint_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checkpoint_lookups(_facts(spark, sf_dir).rows)


def q_fee_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fee_formulas(_facts(spark, sf_dir).rows).withColumns({c: F.array_join(c, "|") for c in ("numerator", "units")})


def q_native_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _facts(spark, sf_dir)
    return native_payments(own.rows, own.sources)


def q_helper_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return helper_flows(_facts(spark, sf_dir).rows)


QUERIES = {n.removeprefix("q_"): f for n, f in list(globals().items()) if n.startswith("q_")}

_any, _list, _PLACE = C._any, C._list, C._PLACE
_BASE = C.FACTS_SQL.replace(sample.lines_sql(sample.LINKED_SOURCES), sample.lines_sql(SOURCES))
#: Macros by lists of characters: the balanced arguments of a call, and their split.
_DEPTH = "list_reduce(list_prepend(0, list_transform(string_split(left({s}, i), ''), lambda c: CASE c WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END)), lambda x, y: x + y)"


def _arguments(code: str, callee: str) -> str:
    rest = f"substring({code}, instr({code}, {callee} || '(') + length({callee}) + 1)"
    ends = f"list_filter(range(1, length({rest}) + 1), lambda i: {_DEPTH.format(s=rest)} = -1)"
    return f"(CASE WHEN instr({code}, {callee} || '(') > 0 THEN coalesce(left({rest}, {ends}[1] - 1), {rest}) END)"


def _split(arguments: str) -> str:
    cuts = f"list_filter(range(1, length({arguments}) + 1), lambda i: substring({arguments}, i, 1) = ',' AND {_DEPTH.format(s=arguments)} = 0)"
    bounds = f"list_concat([0], {cuts}, [CAST(length({arguments}) + 1 AS BIGINT)])"
    return f"list_filter(list_transform(range(1, len({bounds})), lambda k: trim(substring({arguments}, ({bounds})[k] + 1, ({bounds})[k + 1] - ({bounds})[k] - 1))), lambda x: x <> '')"


_RIGHT = f"trim(regexp_replace(substring(code, instr(code, regexp_extract(code, '{ASSIGN}', 0)) + length(regexp_extract(code, '{ASSIGN}', 0))), ';+$', ''))"
ORACLE = {
    "statement_kinds": f"""WITH {_BASE} SELECT {_PLACE}, CASE WHEN regexp_matches(code, '\\brequire\\s*\\(') THEN 'require' WHEN regexp_matches(code, '\\bif\\s*\\(') THEN 'if' WHEN regexp_matches(code, '\\bfor\\s*\\(') THEN 'for' WHEN regexp_matches(code, '{ASSIGN}') THEN 'assignment'
WHEN regexp_matches(code, '{CALL}') THEN 'call' WHEN starts_with(lower(code), 'return') THEN 'return' WHEN starts_with(lower(code), 'emit') THEN 'emit' ELSE 'other' END AS kind FROM located WHERE code <> ''""",
    "data_flows": f"""WITH {_BASE} SELECT {_PLACE}, regexp_replace(regexp_extract(code, '{ASSIGN}', 1), '\\s+', '', 'g') AS to_expr, CASE WHEN {_RIGHT} <> '' THEN {_RIGHT} ELSE regexp_extract(code, '{ASSIGN}', 2) END AS from_expr, 'assignment' AS flow_kind FROM located WHERE regexp_matches(code, '{ASSIGN}')
UNION ALL SELECT {_PLACE}, regexp_extract(code, '{ALIAS}', 1), trim(regexp_extract(code, '{ALIAS}', 2)), 'storage_alias' FROM located WHERE regexp_matches(code, '{ALIAS}')""",
    "semantic_calls": f"""WITH {_BASE},
m AS (SELECT *, CASE WHEN coalesce(method, '') = '' THEN first ELSE method END AS callee FROM (SELECT *, unnest(regexp_extract_all(code, '{CALL}', 1)) AS first, unnest(regexp_extract_all(code, '{CALL}', 2)) AS method FROM located))
SELECT {_PLACE}, callee, CASE WHEN method <> '' THEN first END AS receiver, CASE WHEN callee IN {_list(LOOKUPS)} THEN 'checkpoint' WHEN {_any("lower(code)", SIGNATURES)} OR {_any("lower(callee)", SIGNATURES)} THEN 'signature' WHEN callee IN {_list(TOKEN_CALLS)} THEN 'token'
WHEN {_any("code", NATIVE)} THEN 'native_transfer' WHEN regexp_matches(first, '^[A-Z]') THEN 'library' ELSE 'external' END AS call_kind, nullif({_arguments("code", "callee")}, '') AS arguments FROM m WHERE callee NOT IN {_list(NO_CALLS)}""",
    "checkpoint_lookups": f"""WITH {_BASE},
k AS (SELECT l.*, v.lookup, CASE WHEN starts_with(lookup, 'lower') THEN 'lower' WHEN starts_with(lookup, 'upper') THEN 'upper' WHEN contains(lookup, 'latest') THEN 'latest' ELSE 'unknown' END AS direction FROM located l JOIN (VALUES {", ".join(f"('{m}')" for m in LOOKUPS)}) v(lookup) ON contains(code, '.' || lookup || '(')
  UNION ALL SELECT *, 'index_adjustment', 'unknown' FROM located WHERE regexp_matches(code, '\\b[A-Za-z_][A-Za-z0-9_]*\\s*(?:--|\\+\\+)') AND {_any("lower(code)", ("index", "iterator", "batch"))}),
a AS (SELECT *, coalesce({_arguments("code", "lookup")}, '') AS args FROM k)
SELECT {_PLACE}, lookup, direction, CASE WHEN contains(code, '--') THEN 'decrement' WHEN contains(code, '++') THEN 'increment' ELSE 'none' END AS adjustment, ({_split("args")})[1] AS at_expr FROM a""",
    "fee_formulas": f"""WITH {_BASE},
a AS (SELECT *, coalesce({_arguments("code", "'mulDiv'")}, '') AS args, regexp_extract_all(code, '{WORD}') AS words FROM located WHERE contains(lower(code), 'fee') AND {_any("code", ("*", "/", "mulDiv"))}),
s AS (SELECT *, {_split("args")} AS parts FROM a),
n AS (SELECT *, CASE WHEN contains(code, 'mulDiv') THEN parts[1:2] ELSE words END AS top FROM s),
o AS (SELECT *, array_to_string(list_slice(list_filter(top, lambda x, i: list_position(top, x) = i), 1, 12), '|') AS numerator, list_filter(words, lambda w: regexp_matches(w, '{UNITS}')) AS u FROM n)
SELECT {_PLACE}, CASE WHEN contains(code, 'mulDiv') THEN CASE WHEN len(parts) >= 3 THEN parts[-1] END ELSE nullif(regexp_extract(code, '/\\s*([A-Za-z0-9_]+)', 1), '') END AS denominator, numerator, array_to_string(list_slice(list_filter(u, lambda x, i: list_position(u, x) = i), 1, 12), '|') AS units FROM o""",
    "native_payments": f"""WITH {_BASE},
p AS (SELECT *, coalesce(nullif(regexp_extract(code, '\\b([A-Za-z_][A-Za-z0-9_]*)\\s*\\.\\s*(?:call|send|transfer)\\b', 1), ''), nullif(regexp_extract(code, 'payable\\s*\\(\\s*([A-Za-z_][A-Za-z0-9_]*)\\s*\\)', 1), '')) AS receiver, replace(lower(code), ' ', '') AS compact FROM located),
c AS (SELECT repo, contract_name AS receiver, bool_or(function_name IN ('receive', 'fallback')) AS can_receive FROM ranges JOIN target USING (repo, file_path) GROUP BY ALL)
SELECT {_PLACE}, p.receiver, c.can_receive FROM p LEFT JOIN c USING (repo, receiver)
WHERE (({_any("compact", ("sendassets(", "receiveassets("))} AND contains(lower(code), 'native')) OR {_any("compact", (".call{value:", ".send(", ".transfer("))}) AND NOT {_any("lower(code)", ("safetransfer", "transferfrom"))}""",
    "helper_flows": f"""WITH {_BASE},
h AS (SELECT *, coalesce({", ".join(f"nullif({_arguments('code', C.sample.quoted(h))}, '')" for h in HELPERS)}, '') AS args FROM located WHERE {_any("lower(code)", HELPER_TERMS)}),
s AS (SELECT *, {_split("args")} AS a FROM h)
SELECT {_PLACE}, CASE WHEN contains(lower(code), 'native') OR contains(lower(code), 'msg.value') THEN 'native' WHEN contains(lower(code), 'erc721') OR contains(lower(code), 'nft') THEN 'erc721' ELSE 'erc20' END AS asset_kind,
CASE WHEN len(a) >= 3 THEN a[1] END AS from_expr, CASE WHEN len(a) >= 3 THEN a[2] ELSE a[1] END AS to_expr, CASE WHEN len(a) >= 3 THEN a[3] ELSE a[2] END AS amount_expr FROM s""",
}
