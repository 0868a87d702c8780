"""Typed facts of contract code: declarations, storage, calls, asset flows, guards and boundaries.

One pass places every line in its function and contract, with the state variables it mentions; each fact table is a
projection of that frame, or of the functions' bodies.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeline.functions.text import has_any
from lodeline.plans.shared import join_shuffled, materialise
from lodeline.sources import lines as L
from lodeline.sources import sample

FILE = ["repo", "file_path"]
PLACE = [*FILE, "line_no", "contract_name", "function_name"]
#: The place of a fact and its line, so that no reader has to join lines again.
TOLD = [*PLACE, "code"]
SCOPE = [*FILE, "contract_name"]

#: Patterns, in the order declaration, assignment, calls, aliases and members.
STATE_VARIABLE = r"^(?:mapping\s*\([^;]+\)|[A-Za-z_]\w*(?:\[\])?)\s+(?:(public|private|internal|external)\s+)?([A-Za-z_]\w*)\s*(?:=|;)"
NOT_STATE = r"^(function |constructor|if |for |while |return |require)|\("
ASSIGNED = r"\b([A-Za-z_]\w*)\s*(?:\[[^\]]+\])?\s*(?:=|\+=|-=|\*=|/=|\+\+|--)"
MEMBER_ASSIGNED = r"\b([A-Za-z_]\w*)\s*\.\s*([A-Za-z_]\w*)\s*(?:=|\+=|-=|\*=|/=|\+\+|--)"
MEMBER_CALL = r"\b([A-Za-z_]\w*)\s*\.\s*([A-Za-z_]\w*)\s*\("
OWN_CALL = r"(?<![.\w])([A-Za-z_]\w*)\s*\("
STORAGE_ALIAS = r"\b[A-Za-z_]\w*(?:\s*\[[^\]]+\])?\s+storage\s+([A-Za-z_]\w*)\s*=\s*([A-Za-z_]\w*)\s*(?:\[|;|$)"
MEMBER = r"\b([A-Za-z_]\w*)\s*\.\s*([A-Za-z_]\w*)\b"
WORD = r"\b[A-Za-z_]\w*\b"
#: Words that are no modifiers, no calls and no written variables.
SIGNATURE_WORDS = ("function", "constructor", "external", "public", "internal", "private", "view", "pure", "payable", "returns", "virtual", "override")
NO_CALLS = ("if", "for", "while", "require", "assert", "return", "emit", "revert", "mapping")
NO_WRITES = ("return", "if", "for", "while", "require")
#: Terms and methods of the facts.
AUTH_TERMS = ("onlyowner", "onlyrole", "hasrole", "owner", "admin", "msg.sender", "tx.origin", "_checkowner")
LIFECYCLE_TERMS = ("initialize", "start", "end", "pause", "unpause", "deposit", "withdraw", "claim", "mint", "burn", "upgrade")
ASSET_METHODS = ("transfer", "transferFrom", "safeTransfer", "safeTransferFrom", "mint", "mintEgg", "_mint", "burn", "_burn")
PULL_METHODS = ("transferFrom", "safeTransferFrom")
PRICE_TERMS = ("latestanswer", "latestrounddata", "oracle", "getprice")
PLAIN_TYPES = ("address", "uint256", "uint", "bool", "bytes32", "string")
VISIBILITIES = ("external", "public", "internal", "private")


def all_groups(text: Column, pattern: str, *groups: int) -> Column:
    """Structs g1, g2... of the groups of every match."""
    found = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in groups]
    return F.transform(F.arrays_zip(*(x.alias(f"g{g}") for g, x in zip(groups, found, strict=True))), lambda x: F.struct(*(x[f"g{g}"].alias(f"g{g}") for g in groups))) if len(groups) > 1 else found[0]


def statement(raw: Column) -> Column:
    """Code of a line, trimmed; empty for lines of comments."""
    code = F.trim(L.strip_comment(raw))
    return F.when(code.rlike(r"^(/\*|\*)"), F.lit("")).otherwise(code)


def contract_ranges(lines: DataFrame) -> DataFrame:
    """``lines`` (file, line_no, code) with ``at_contract``: the contract or interface that is open there, if any."""
    of_file = Window.partitionBy(*FILE).orderBy("line_no")
    delta = L.brace_delta(F.col("code"))
    named = F.regexp_extract("code", L.DECLARED_CONTRACT, 1)
    found = lines.withColumn("_after", F.sum(delta).over(of_file)).withColumn("_before", F.col("_after") - delta)
    found = found.withColumn("_begins", (named != "") & (F.col("_before") == 0))
    last = lambda condition, what, over: F.last(F.when(condition, what), ignorenulls=True).over(over)
    begun, owner = last(F.col("_begins"), F.col("line_no"), of_file), last(F.col("_begins"), named, of_file)
    opened = last(F.col("code").contains("{"), F.col("line_no"), of_file.rowsBetween(Window.unboundedPreceding, -1)) >= begun
    inside = begun.isNotNull() & (~F.coalesce(opened, F.lit(False)) | (F.col("_before") > 0))
    return found.withColumn("at_contract", F.when(inside, owner)).drop("_after", "_before", "_begins")


def located(sources: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """repo, file_path, line_no, code, contract_name, function_name, start_line, at_contract, vars of every line; ``ranges`` are those of functions, if known.

    Functions do not overlap, so a line's is the last that began, if it has not ended. Their ranges are rows among the lines, and
    all windows are of files: lines are shuffled and sorted once.
    """
    ranges = L.function_ranges(sources) if ranges is None else ranges
    begun = ranges.select(*FILE, F.col("start_line").alias("line_no"), F.lit(None).cast("string").alias("code"), F.struct(F.col("contract_name").alias("contract"), F.col("function_name").alias("name"), "start_line", "end_line").alias("_r"))
    lines = L.to_lines(sources).select(*FILE, "line_no", statement(F.col("raw")).alias("code"))
    so_far = Window.partitionBy(*FILE).orderBy("line_no", F.col("code").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = lines.unionByName(begun, allowMissingColumns=True).withColumn("_r", F.last("_r", ignorenulls=True).over(so_far)).where("code is not null")
    held = held.withColumn("_r", F.when(F.col("line_no") <= F.col("_r.end_line"), F.col("_r")))
    rows = contract_ranges(held)
    first = F.first("at_contract", ignorenulls=True).over(Window.partitionBy(*FILE).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    inside = F.col("_r").isNotNull()
    return with_state(rows.select(*FILE, "line_no", "code", F.when(inside, F.col("_r.contract")).otherwise(F.coalesce("at_contract", first)).alias("contract_name"), F.col("_r.name").alias("function_name"), "_r.start_line", "at_contract"))


def _declares() -> Column:
    """Whether a line declares a state variable."""
    code = F.col("code")
    return F.col("function_name").isNull() & F.col("at_contract").isNotNull() & (code.startswith("mapping") | ~code.rlike(NOT_STATE)) & code.rlike(STATE_VARIABLE)


def state_variables(rows: DataFrame) -> DataFrame:
    """repo, file_path, contract_name, name, type_name, visibility, line_no: declarations outside functions."""
    code = F.col("code")
    return rows.where(_declares()).select(*FILE, "contract_name", F.regexp_extract(code, STATE_VARIABLE, 2).alias("name"), F.split(code, r"\s+")[0].alias("type_name"), F.nullif(F.regexp_extract(code, STATE_VARIABLE, 1), F.lit("")).alias("visibility"), "line_no")


def with_state(rows: DataFrame) -> DataFrame:
    """``rows`` with ``vars``: name and type of the state variables of their contract (the last declaration of a name) that they mention."""
    code = F.col("code")
    declared = F.when(_declares(), F.struct(F.col("contract_name").alias("of"), F.col("line_no").alias("at"), F.regexp_extract(code, STATE_VARIABLE, 2).alias("name"), F.split(code, r"\s+")[0].alias("type_name")))
    of_file = F.collect_list("_declared").over(Window.partitionBy(*FILE))  # by file, as a window by contract would sort the lines again
    known = rows.withColumn("_declared", declared).withColumn("_vars", of_file).withColumn("_vars", F.filter("_vars", lambda v: v["of"] == F.col("contract_name")))
    words = known.withColumn("_words", F.when(F.size("_vars") > 0, F.regexp_extract_all(code, F.lit(WORD), F.lit(0))))
    last = lambda v: ~F.exists("_vars", lambda o: (o["name"] == v["name"]) & (o["at"] > v["at"]))
    mentioned = F.transform(F.filter("_vars", lambda v: F.array_contains("_words", v["name"]) & last(v)), lambda v: F.struct(v["name"].alias("name"), v["type_name"].alias("type_name")))
    return words.withColumn("vars", mentioned).drop("_declared", "_vars", "_words")


def _names(variables: Column) -> Column:
    return F.transform(variables, lambda v: v["name"])


def _type_of(variables: Column, name: Column) -> Column:
    return F.get(F.transform(F.filter(variables, lambda v: v["name"] == name), lambda v: v["type_name"]), F.lit(0))


def _root(aliases: Column, name: Column) -> Column:
    """Root of the last alias of that name."""
    return F.get(F.transform(F.filter(F.reverse(aliases), lambda a: a["g1"] == name), lambda a: a["g2"]), F.lit(0))


def _members(aliases: Column, found: Column) -> Column:
    """root.member of each (alias, member) whose alias is known."""
    return F.array_compact(F.transform(found, lambda m: F.concat(_root(aliases, m["g1"]), F.lit("."), m["g2"])))


def written(code: Column) -> Column:
    """Names that are assigned to, in order, with repetitions."""
    return F.filter(F.regexp_extract_all(code, F.lit(ASSIGNED), F.lit(1)), lambda x: ~x.isin(*NO_WRITES))


def visibility(signature: Column) -> Column:
    return F.coalesce(*(F.when(signature.rlike(rf"\b{v}\b"), F.lit(v)) for v in VISIBILITIES))


def functions(ranges: DataFrame, rows: DataFrame) -> DataFrame:
    """A row a function: visibility, payable, modifiers, parameters, aliases, reads, writes and calls of its body."""
    key = [*FILE, "contract_name", "function_name", "start_line"]
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "code"))), lambda x: x["code"]), "\n")
    bodies = rows.where("function_name is not null").groupBy(*key).agg(body.alias("body"), F.array_distinct(F.flatten(F.collect_list("vars"))).alias("vars"))
    signatures = ranges.select(*key, "end_line", "signature")
    found = join_shuffled(signatures, bodies, key)
    body, names, signature = F.col("body"), _names(F.col("vars")), F.col("signature")
    tail = F.element_at(F.split(signature, r"\)"), -1)
    arguments = F.regexp_extract(signature, r"\((.*?)\)", 1)
    found = found.withColumn("aliases", F.filter(all_groups(body, STORAGE_ALIAS, 1, 2), lambda a: F.array_contains(names, a["g2"])))
    aliases = F.col("aliases")
    member_reads, member_writes = _members(aliases, all_groups(body, MEMBER, 1, 2)), _members(aliases, all_groups(body, MEMBER_ASSIGNED, 1, 2))
    own_calls = F.filter(F.regexp_extract_all(body, F.lit(OWN_CALL), F.lit(1)), lambda x: ~x.isin(*NO_CALLS))
    member_calls = F.transform(all_groups(body, MEMBER_CALL, 1, 2), lambda m: F.concat(m["g1"], F.lit("."), m["g2"]))
    return found.select(
        *key,
        "end_line",
        "signature",
        visibility(signature).alias("visibility"),
        signature.contains("payable").alias("payable"),
        F.filter(F.regexp_extract_all(tail, F.lit(WORD), F.lit(0)), lambda x: ~x.isin(*SIGNATURE_WORDS)).alias("modifiers"),
        F.filter(F.transform(F.split(arguments, ","), lambda x: F.element_at(F.split(F.trim(x), r"\s+"), -1)), lambda x: x != "").alias("parameters"),
        "aliases",
        F.array_sort(F.array_union(F.array_intersect(names, F.regexp_extract_all(body, F.lit(WORD), F.lit(0))), member_reads)).alias("reads"),
        F.array_distinct(F.concat(F.filter(written(body), lambda x: F.array_contains(names, x)), member_writes)).alias("writes"),
        F.array_distinct(F.concat(member_calls, own_calls)).alias("calls"),
    )


def storage_accesses(rows: DataFrame, fns: DataFrame) -> DataFrame:
    """TOLD, variable_name, access: state variables that a line mentions, by name or through a storage alias."""
    code, aliases = F.col("code"), F.col("aliases")
    assigned, writes = written(code), _members(aliases, all_groups(code, MEMBER_ASSIGNED, 1, 2))
    own = F.transform(_names(F.col("vars")), lambda x: F.struct(x.alias("variable_name"), F.when(F.array_contains(assigned, x), "write").otherwise("read").alias("access")))
    members = F.transform(_members(aliases, all_groups(code, MEMBER, 1, 2)), lambda x: F.struct(x.alias("variable_name"), F.when(F.array_contains(writes, x), "write").otherwise("read").alias("access")))
    known = fns.where(F.size("aliases") > 0).select(*SCOPE, "function_name", "start_line", "aliases")
    named = rows.where(F.size("vars") > 0).select(*TOLD, F.explode(own).alias("x"))
    through = join_shuffled(rows.where(code.contains(".")), known, [*SCOPE, "function_name", "start_line"]).select(*TOLD, F.explode(members).alias("x"))
    return named.unionByName(through).select(*TOLD, "x.*")


def call_edges(rows: DataFrame) -> DataFrame:
    """TOLD, receiver, to_contract, to_function, call_kind: calls of members, the receiver typed by its declaration."""
    calls = rows.select(*TOLD, "vars", F.explode(all_groups(F.col("code"), MEMBER_CALL, 1, 2)).alias("m"))
    calls = calls.select(*TOLD, F.col("m.g1").alias("receiver"), F.col("m.g2").alias("to_function"), _type_of(F.col("vars"), F.col("m.g1")).alias("kind"))
    plain = F.lower("kind").isin(*PLAIN_TYPES) | F.col("kind").endswith("[]")
    kept = calls.where(~F.col("to_function").isin("push", "pop") & ~F.coalesce(plain, F.lit(False)))
    kind = F.when(F.col("to_function") == "delegatecall", "delegatecall").when(F.col("to_function").isin("call", "send"), "low_level").otherwise("external")
    return kept.select(*TOLD, "receiver", F.coalesce("kind", "receiver").alias("to_contract"), "to_function", kind.alias("call_kind"))


def token_types(sources: DataFrame) -> DataFrame:
    """repo, symbol, token_kind: contracts and variables that hold tokens; the last fact of a symbol counts."""
    text = F.coalesce("text", F.lit(""))
    named = all_groups(text, r"\bcontract\s+(\w+)\s*(?:is\s+([^{]+))?", 1, 2)
    about = F.lower(F.concat_ws(" ", "c.g1", "c.g2"))
    kind = F.when(about.contains("erc721"), "erc721").when(about.contains("erc1155"), "erc1155").when(about.contains("erc20"), "erc20")
    ordered = sources.select(*FILE, F.posexplode(named).alias("at", "c")).select(*FILE, "at", F.col("c.g1").alias("symbol"), kind.alias("token_kind")).where("token_kind is not null")
    kinds = ordered.groupBy("repo", "symbol").agg(F.max_by("token_kind", F.struct("file_path", "at")).alias("declared"))
    contracts = join_shuffled(ordered, kinds, ["repo", "symbol"]).select(*FILE, F.lit(0).alias("part"), "at", "symbol", F.col("declared").alias("token_kind"))
    declared = all_groups(text, r"\b([A-Za-z_]\w*)\s+(?:public|private|internal|external)?\s*(\w+)\s*;", 1, 2)
    variables = sources.select(*FILE, text.contains("ERC721").alias("nfts"), text.contains("ERC20").alias("tokens"), F.posexplode(declared).alias("at", "d"))
    low = F.lower("d.g1")
    found = join_shuffled(variables, kinds.withColumnRenamed("symbol", "type_name"), (variables["repo"] == kinds["repo"]) & (F.col("d.g1") == F.col("type_name")), "left").select(
        variables["repo"],
        "file_path",
        F.lit(1).alias("part"),
        "at",
        F.col("d.g2").alias("symbol"),
        F.coalesce(
            "declared",
            F.when(low.contains("erc721") | (F.col("nfts") & low.contains("nft")), "erc721")
            .when(low.contains("erc1155"), "erc1155")
            .when(low.contains("erc20") | (low == "token") | (F.col("tokens") & F.lower("d.g2").isin("token", "asset", "underlying")), "erc20"),
        ).alias("token_kind"),
    )
    facts = contracts.unionByName(found.where("token_kind is not null"))
    return facts.groupBy("repo", "symbol").agg(F.max_by("token_kind", F.struct("file_path", "part", "at")).alias("token_kind"))


def receiver_of(code: Column, methods: tuple[str, ...] = ("transfer", "transferFrom", "approve")) -> Column:
    """The receiver of the first method, in the order of ``methods``, that the line calls; else a cast ERC20."""
    own = [F.nullif(F.regexp_extract(code, rf"\b([A-Za-z_]\w*)\s*\.\s*{m}\s*\(", 1), F.lit("")) for m in methods]
    return F.coalesce(*own, F.nullif(F.regexp_extract(code, r"\b(I?ERC20)\s*\([^)]+\)\s*\.\s*(?:transfer|transferFrom|approve)\s*\(", 1), F.lit("")))


def receiver_kind(receiver: Column, known: Column) -> Column:
    """Kind of token a receiver is: by interface name, by declaration, by its own name."""
    low = F.lower(receiver)
    by_interface = F.coalesce(*(F.when(low.isin(k, f"i{k}"), F.lit(k)) for k in ("erc20", "erc721", "erc1155")))
    by_name = F.when(low.contains("nft") | low.contains("erc721"), "erc721").when(low.contains("erc1155"), "erc1155").when(has_any(low, ("token", "erc20", "asset")), "erc20")
    return F.coalesce(by_interface, known, by_name, F.lit("unknown"))


def with_receiver(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """``rows`` with the receiver of a token call and its kind."""
    called = rows.withColumn("receiver", receiver_of(F.col("code")))
    joined = join_shuffled(called, tokens.withColumnRenamed("symbol", "receiver"), ["repo", "receiver"], "left")
    return joined.withColumn("kind", receiver_kind(F.col("receiver"), F.col("token_kind"))).drop("token_kind")


def unchecked_returns(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """PLACE, receiver, kind, why: token calls whose result is dropped, and low-level ones of which only the status is checked.

    Transfers of non-fungible tokens are left alone.
    """
    code, low = F.col("code"), F.lower("code")
    compact = F.replace(code, F.lit(" "), F.lit(""))
    direct = has_any(compact, (".transfer(", ".transferFrom(", ".approve("))
    wanted = with_receiver(rows.where((code != "") & ~has_any(low, ("safetransfer", "safeapprove"))), tokens)
    wanted = wanted.where(~(direct & (compact.startswith("to.transfer(") | ~F.col("kind").isin("erc20", "unknown"))))
    ignored = direct & ~compact.contains("require(") & ~F.split_part(compact, F.lit(".transfer"), F.lit(1)).contains("=")
    status_only = code.contains("call(") & has_any(code, ("ERC20", "transfer.selector", "transferFrom.selector", "approve(", "approve.selector")) & ~code.contains("abi.decode") & ~low.contains("returndata")
    return wanted.withColumn("why", F.when(ignored, "result ignored").when(status_only, "only the call's status is checked")).where("why is not null").select(*PLACE, "receiver", "kind", "why")


def asset_flows(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """TOLD, asset, asset_kind, from_expr, to_expr, amount_expr, expression of every call of an asset method."""
    calls = rows.select(*TOLD, F.explode(all_groups(F.col("code"), MEMBER_CALL, 1, 2)).alias("m")).where(F.col("m.g2").isin(*ASSET_METHODS))
    calls = join_shuffled(calls.select(*TOLD, F.col("m.g1").alias("asset"), F.col("m.g2").alias("method")), tokens.withColumnRenamed("symbol", "asset"), ["repo", "asset"], "left")
    pattern = r"concat('\\.', method, '\\s*\\((.*)\\)')"
    arguments = F.when(F.expr(f"code rlike {pattern}"), F.transform(F.split(F.expr(f"regexp_extract(code, {pattern}, 1)"), ","), lambda x: F.trim(x)))
    calls = calls.withColumn("a", arguments)
    pulled = F.col("method").isin(*PULL_METHODS)
    arg = lambda i: F.get("a", F.lit(i))
    native = F.when((F.col("method") == "transfer") & F.col("asset").isin("payable", "to"), "native").otherwise("unknown")
    return calls.select(*TOLD, "asset", F.coalesce("token_kind", native).alias("asset_kind"), F.when(pulled, arg(0)).alias("from_expr"), F.when(pulled & (F.size("a") > 1), arg(1)).otherwise(arg(0)).alias("to_expr"), F.coalesce(arg(2), arg(1)).alias("amount_expr"), F.col("code").alias("expression"))


def auth_constraints(rows: DataFrame) -> DataFrame:
    """TOLD, role: lines that name an authority."""
    low = F.lower("code")
    return rows.where(has_any(low, AUTH_TERMS)).select(*TOLD, F.when(low.contains("owner"), "owner").when(low.contains("role"), "role").alias("role"))


def lifecycle_transitions(rows: DataFrame) -> DataFrame:
    """TOLD, variables: lines in the context of a lifecycle term that assign a state variable or an activity flag."""
    code = F.col("code")
    flags = F.regexp_extract_all(code, F.lit(r"\b([A-Za-z_]\w*)\s*\.\s*(isActive|active|deadline\w*)\s*="), F.lit(2))
    own = F.filter(F.regexp_extract_all(code, F.lit(ASSIGNED), F.lit(1)), lambda x: F.array_contains(_names(F.col("vars")), x))
    found = rows.where(code != "").where(has_any(F.lower(F.concat_ws(" ", F.coalesce("function_name", F.lit("")), code)), LIFECYCLE_TERMS))
    return found.withColumn("variables", F.concat(own, flags)).where(F.size("variables") > 0).select(*TOLD, "variables")


def trust_boundaries(rows: DataFrame) -> DataFrame:
    """TOLD, boundary_kind: up to three kinds a line."""
    low = F.lower("code")
    kinds = F.array(
        F.when(low.contains(".delegatecall"), "delegatecall").when(low.contains(".call"), "external_call"),
        F.when(has_any(low, ("transfer", "mint", "burn")), "asset_transfer"),
        F.when(has_any(low, PRICE_TERMS), "oracle_read"),
    )
    return rows.select(*TOLD, F.explode(F.array_compact(kinds)).alias("boundary_kind"))


class Facts:
    """The fact tables of sources, each worked out when first asked for; ranges, lines and functions are written down."""

    def __init__(self, sources: DataFrame):
        self.given, self.sources = sources, L.target_sources(sources)

    @cached_property
    def ranges(self) -> DataFrame:
        return materialise(L.function_ranges(self.sources), "function-ranges")

    @cached_property
    def rows(self) -> DataFrame:
        return materialise(located(self.sources, self.ranges), "code-lines")

    @cached_property
    def variables(self) -> DataFrame:
        return state_variables(self.rows)

    @cached_property
    def functions(self) -> DataFrame:
        return materialise(functions(self.ranges, self.rows), "functions")

    @cached_property
    def tokens(self) -> DataFrame:
        return token_types(self.given)

    @cached_property
    def storage(self) -> DataFrame:
        return storage_accesses(self.rows, self.functions)

    @cached_property
    def edges(self) -> DataFrame:
        return call_edges(self.rows)

    @cached_property
    def flows(self) -> DataFrame:
        return asset_flows(self.rows, self.tokens)

    @cached_property
    def auth(self) -> DataFrame:
        return auth_constraints(self.rows)

    @cached_property
    def lifecycle(self) -> DataFrame:
        return lifecycle_transitions(self.rows)

    @cached_property
    def boundaries(self) -> DataFrame:
        return trust_boundaries(self.rows)


def facts(spark: SparkSession, sf_dir: str) -> Facts:
    return Facts(sample.repositories(spark, sf_dir, sample.LINKED_SOURCES))


def _text(df: DataFrame, *arrays: str) -> DataFrame:
    return df.select(*(F.array_join(c, ",").alias(c) if c in arrays else F.col(c) for c in df.columns))


def q_state_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).variables


def q_function_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = facts(spark, sf_dir).functions.select(*SCOPE, "function_name", "start_line", "visibility", "payable", "modifiers", "parameters", "reads", "writes", "calls")
    return _text(kept, "modifiers", "parameters", "reads", "writes", "calls")


def q_storage_accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).storage.drop("code")


def q_call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).edges.drop("code")


def q_token_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).tokens


def q_receiver_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = facts(spark, sf_dir)
    return with_receiver(own.rows, own.tokens).where("receiver is not null").select(*PLACE, "receiver", "kind")


def q_unchecked_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = facts(spark, sf_dir)
    return unchecked_returns(own.rows, own.tokens)


def q_asset_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).flows.drop("code")


def q_auth_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).auth.drop("code")


def q_lifecycle_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(facts(spark, sf_dir).lifecycle.drop("code"), "variables")


def q_trust_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).boundaries.drop("code")


QUERIES = {
    "state_variables": q_state_variables,
    "function_facts": q_function_facts,
    "storage_accesses": q_storage_accesses,
    "call_edges": q_call_edges,
    "token_types": q_token_types,
    "receiver_kinds": q_receiver_kinds,
    "unchecked_returns": q_unchecked_returns,
    "asset_flows": q_asset_flows,
    "auth_constraints": q_auth_constraints,
    "lifecycle_transitions": q_lifecycle_transitions,
    "trust_boundaries": q_trust_boundaries,
}


def _list(values) -> str:
    return "(" + ", ".join(sample.quoted(v) for v in values) + ")"


def _any(column: str, terms) -> str:
    return "(" + " OR ".join(f"contains({column}, {sample.quoted(t)})" for t in terms) + ")"


#: The oracle reads production paths only, as ``target_sources`` does; test/ and lib/ are the others in the sample.
FACTS_SQL = f"""{sample.lines_sql(sample.LINKED_SOURCES)},
target AS (SELECT DISTINCT repo, file_path FROM src WHERE NOT regexp_matches(file_path, '^(test|lib)/')),
stmt AS (SELECT l.repo, l.file_path, l.line_no, CASE WHEN regexp_matches(trim(l.code), '^(/\\*|\\*)') THEN '' ELSE trim(l.code) END AS code FROM code l JOIN target USING (repo, file_path)),
spans AS (
  SELECT c.repo, c.file_path, c.contract, c.c_line, min(e.line_no) AS c_end FROM contracts c JOIN depths e ON e.repo = c.repo AND e.file_path = c.file_path AND e.line_no >= c.c_line
  WHERE e.depth_after <= 0 AND contains(e.code, '}}') GROUP BY ALL),
located AS (
  SELECT s.*, r.function_name, r.start_line, c.contract AS at_contract,
         coalesce(r.contract_name, c.contract, (SELECT arg_min(x.contract, x.c_line) FROM spans x WHERE x.repo = s.repo AND x.file_path = s.file_path)) AS contract_name
  FROM stmt s LEFT JOIN ranges r ON r.repo = s.repo AND r.file_path = s.file_path AND s.line_no BETWEEN r.start_line AND r.end_line
  LEFT JOIN spans c ON c.repo = s.repo AND c.file_path = s.file_path AND s.line_no BETWEEN c.c_line AND c.c_end),
vars AS (
  SELECT repo, file_path, contract_name, regexp_extract(code, '{STATE_VARIABLE}', 2) AS name, regexp_extract(code, '^\\S+') AS type_name,
         nullif(regexp_extract(code, '{STATE_VARIABLE}', 1), '') AS visibility, line_no
  FROM located WHERE function_name IS NULL AND at_contract IS NOT NULL AND (starts_with(code, 'mapping') OR NOT regexp_matches(code, '{NOT_STATE}')) AND regexp_matches(code, '{STATE_VARIABLE}')),
bodies AS (
  SELECT r.repo, r.file_path, r.contract_name, r.function_name, r.start_line, string_agg(s.code, chr(10) ORDER BY s.line_no) AS body
  FROM ranges r JOIN stmt s ON s.repo = r.repo AND s.file_path = r.file_path AND s.line_no BETWEEN r.start_line AND r.end_line GROUP BY ALL),
alias AS (
  SELECT a.repo, a.file_path, a.contract_name, a.function_name, a.start_line, alias, root FROM (
    SELECT *, unnest(regexp_extract_all(body, '{STORAGE_ALIAS}', 1)) AS alias, unnest(regexp_extract_all(body, '{STORAGE_ALIAS}', 2)) AS root FROM bodies) a
  JOIN vars v ON v.repo = a.repo AND v.file_path = a.file_path AND v.contract_name = a.contract_name AND v.name = a.root),
calls AS (
  SELECT repo, file_path, line_no, contract_name, function_name, code, unnest(regexp_extract_all(code, '{MEMBER_CALL}', 1)) AS receiver, unnest(regexp_extract_all(code, '{MEMBER_CALL}', 2)) AS method FROM located),
storage AS (
  SELECT DISTINCT l.repo, l.file_path, l.line_no, l.contract_name, l.function_name, v.name AS variable_name,
         CASE WHEN list_contains(regexp_extract_all(l.code, '{ASSIGNED}', 1), v.name) THEN 'write' ELSE 'read' END AS access
  FROM located l JOIN vars v ON v.repo = l.repo AND v.file_path = l.file_path AND v.contract_name = l.contract_name AND list_contains(regexp_extract_all(l.code, '{WORD}'), v.name)
  UNION ALL
  SELECT m.repo, m.file_path, m.line_no, m.contract_name, m.function_name, a.root || '.' || m.member,
         CASE WHEN list_contains(list_transform(regexp_extract_all(m.code, '{MEMBER_ASSIGNED}'), lambda x: regexp_replace(x, '^(\\w+)\\s*\\.\\s*(\\w+).*$', '\\1.\\2')), m.alias || '.' || m.member) THEN 'write' ELSE 'read' END
  FROM (SELECT *, unnest(regexp_extract_all(code, '{MEMBER}', 1)) AS alias, unnest(regexp_extract_all(code, '{MEMBER}', 2)) AS member FROM located) m
  JOIN alias a ON a.repo = m.repo AND a.file_path = m.file_path AND a.function_name = m.function_name AND a.start_line = m.start_line AND a.alias = m.alias),
kinds AS (
  SELECT repo, symbol, arg_max(kind, file_path) AS kind FROM (
    SELECT repo, file_path, symbol, CASE WHEN contains(about, 'erc721') THEN 'erc721' WHEN contains(about, 'erc1155') THEN 'erc1155' WHEN contains(about, 'erc20') THEN 'erc20' END AS kind FROM (
      SELECT repo, file_path, symbol, lower(symbol || ' ' || bases) AS about FROM (
        SELECT repo, file_path, unnest(regexp_extract_all(text, '\\bcontract\\s+(\\w+)\\s*(?:is\\s+([^{{]+))?', 1)) AS symbol, unnest(regexp_extract_all(text, '\\bcontract\\s+(\\w+)\\s*(?:is\\s+([^{{]+))?', 2)) AS bases FROM src)))
  WHERE kind IS NOT NULL GROUP BY ALL),
tokens AS (
  SELECT repo, symbol, arg_max(kind, (file_path, part, nth)) AS token_kind FROM (
    SELECT s.repo, s.file_path, 0 AS part, 0 AS nth, k.symbol, k.kind FROM kinds k JOIN src s ON s.repo = k.repo AND regexp_matches(s.text, '\\bcontract\\s+' || k.symbol || '\\b')
    UNION ALL
    SELECT d.repo, d.file_path, 1, nth, name, coalesce(k.kind,
           CASE WHEN contains(lower(type), 'erc721') OR (contains(text, 'ERC721') AND contains(lower(type), 'nft')) THEN 'erc721' WHEN contains(lower(type), 'erc1155') THEN 'erc1155'
                WHEN contains(lower(type), 'erc20') OR lower(type) = 'token' OR (contains(text, 'ERC20') AND lower(name) IN ('token', 'asset', 'underlying')) THEN 'erc20' END) AS kind
    FROM (SELECT *, unnest(range(len(types))) AS nth, unnest(types) AS type, unnest(names) AS name FROM (
            SELECT *, regexp_extract_all(text, '\\b([A-Za-z_]\\w*)\\s+(?:public|private|internal|external)?\\s*(\\w+)\\s*;', 1) AS types,
                   regexp_extract_all(text, '\\b([A-Za-z_]\\w*)\\s+(?:public|private|internal|external)?\\s*(\\w+)\\s*;', 2) AS names FROM src)) d
    LEFT JOIN kinds k ON k.repo = d.repo AND k.symbol = d.type)
  WHERE kind IS NOT NULL GROUP BY ALL),
received AS (
  SELECT l.*, receiver, CASE WHEN lower(receiver) IN ('erc20', 'ierc20') THEN 'erc20' WHEN lower(receiver) IN ('erc721', 'ierc721') THEN 'erc721' WHEN lower(receiver) IN ('erc1155', 'ierc1155') THEN 'erc1155'
         WHEN token_kind IS NOT NULL THEN token_kind WHEN {_any("lower(receiver)", ("nft", "erc721"))} THEN 'erc721' WHEN contains(lower(receiver), 'erc1155') THEN 'erc1155'
         WHEN {_any("lower(receiver)", ("token", "erc20", "asset"))} THEN 'erc20' ELSE 'unknown' END AS kind
  FROM (SELECT *, coalesce(nullif(regexp_extract(code, '\\b([A-Za-z_]\\w*)\\s*\\.\\s*transfer\\s*\\(', 1), ''), nullif(regexp_extract(code, '\\b([A-Za-z_]\\w*)\\s*\\.\\s*transferFrom\\s*\\(', 1), ''),
               nullif(regexp_extract(code, '\\b([A-Za-z_]\\w*)\\s*\\.\\s*approve\\s*\\(', 1), ''), nullif(regexp_extract(code, '\\b(I?ERC20)\\s*\\([^)]+\\)\\s*\\.\\s*(?:transfer|transferFrom|approve)\\s*\\(', 1), '')) AS receiver FROM located) l
  LEFT JOIN tokens t ON t.repo = l.repo AND t.symbol = l.receiver),
edges AS (
  SELECT c.repo, c.file_path, c.line_no, c.contract_name, c.function_name, c.receiver, coalesce(v.type_name, c.receiver) AS to_contract, c.method AS to_function,
         CASE WHEN method = 'delegatecall' THEN 'delegatecall' WHEN method IN ('call', 'send') THEN 'low_level' ELSE 'external' END AS call_kind
  FROM calls c LEFT JOIN vars v ON v.repo = c.repo AND v.file_path = c.file_path AND v.contract_name = c.contract_name AND v.name = c.receiver
  WHERE method NOT IN ('push', 'pop') AND coalesce(lower(v.type_name), '') NOT IN {_list(PLAIN_TYPES)} AND NOT ends_with(coalesce(v.type_name, ''), '[]')),
flows AS (
  SELECT repo, file_path, line_no, contract_name, function_name, asset, asset_kind, CASE WHEN pulled THEN a[1] END AS from_expr,
         CASE WHEN pulled AND len(a) > 1 THEN a[2] ELSE a[1] END AS to_expr, coalesce(a[3], a[2]) AS amount_expr, code AS expression
  FROM (SELECT c.*, c.receiver AS asset, coalesce(t.token_kind, CASE WHEN method = 'transfer' AND receiver IN ('payable', 'to') THEN 'native' ELSE 'unknown' END) AS asset_kind, method IN {_list(PULL_METHODS)} AS pulled,
               list_transform(string_split(regexp_extract(code, '\\.' || method || '\\s*\\((.*)\\)', 1), ','), lambda x: trim(x)) AS a
        FROM calls c LEFT JOIN tokens t ON t.repo = c.repo AND t.symbol = c.receiver WHERE method IN {_list(ASSET_METHODS)})),
auth AS (
  SELECT repo, file_path, line_no, contract_name, function_name, CASE WHEN contains(lower(code), 'owner') THEN 'owner' WHEN contains(lower(code), 'role') THEN 'role' END AS role
  FROM located WHERE {_any("lower(code)", AUTH_TERMS)}),
lifecycle AS (
  SELECT * FROM (
    SELECT repo, file_path, line_no, contract_name, function_name,
           array_to_string(list_concat(list_filter(regexp_extract_all(code, '{ASSIGNED}', 1), lambda x: coalesce(list_contains(names, x), false)),
             regexp_extract_all(code, '\\b([A-Za-z_]\\w*)\\s*\\.\\s*(isActive|active|deadline\\w*)\\s*=', 2)), ',') AS variables
    FROM located LEFT JOIN (SELECT repo, file_path, contract_name, list(name) AS names FROM vars GROUP BY ALL) USING (repo, file_path, contract_name)
    WHERE code <> '' AND {_any("lower(coalesce(function_name, '') || ' ' || code)", LIFECYCLE_TERMS)}) WHERE variables <> ''),
boundaries AS (
  SELECT repo, file_path, line_no, contract_name, function_name, kind AS boundary_kind FROM (
    SELECT *, unnest([CASE WHEN contains(lower(code), '.delegatecall') THEN 'delegatecall' WHEN contains(lower(code), '.call') THEN 'external_call' END,
                      CASE WHEN {_any("lower(code)", ("transfer", "mint", "burn"))} THEN 'asset_transfer' END, CASE WHEN {_any("lower(code)", PRICE_TERMS)} THEN 'oracle_read' END]) AS kind FROM located) WHERE kind IS NOT NULL),
listed AS (
  SELECT repo, file_path, contract_name, function_name, start_line, 0 AS part, unnest(range(len(regexp_extract_all(body, '{MEMBER_CALL}')))) AS nth,
         unnest(regexp_extract_all(body, '{MEMBER_CALL}', 1)) || '.' || unnest(regexp_extract_all(body, '{MEMBER_CALL}', 2)) AS called FROM bodies
  UNION ALL
  SELECT repo, file_path, contract_name, function_name, start_line, 1, unnest(range(len(own))), unnest(own) FROM (
    SELECT *, regexp_extract_all(replace(chr(10) || body, '(', '( '), '[^.A-Za-z0-9_]([A-Za-z_][A-Za-z0-9_]*)[ ]*\\(', 1) AS own FROM bodies)),
called AS (SELECT repo, file_path, contract_name, function_name, start_line, called, min((part, nth)) AS first FROM listed WHERE called NOT IN {_list(NO_CALLS)} GROUP BY ALL)"""

#: FACTS_SQL and fn: a row a function, its text in full_sig.
FUNCTIONS_SQL = f"""{FACTS_SQL},
w AS (SELECT b.repo, b.file_path, b.start_line, x, i, 0 AS part FROM (SELECT *, unnest(regexp_extract_all(body, '{ASSIGNED}', 1)) AS x, unnest(range(len(regexp_extract_all(body, '{ASSIGNED}')))) AS i FROM bodies) b
      JOIN vars v ON v.repo = b.repo AND v.file_path = b.file_path AND v.contract_name = b.contract_name AND v.name = b.x
      UNION ALL
      SELECT b.repo, b.file_path, b.start_line, a.root || '.' || m, i, 1 FROM (
        SELECT *, unnest(regexp_extract_all(body, '{MEMBER_ASSIGNED}', 1)) AS x, unnest(regexp_extract_all(body, '{MEMBER_ASSIGNED}', 2)) AS m, unnest(range(len(regexp_extract_all(body, '{MEMBER_ASSIGNED}')))) AS i FROM bodies) b
      JOIN alias a ON a.repo = b.repo AND a.file_path = b.file_path AND a.start_line = b.start_line AND a.alias = b.x),
ws AS (SELECT repo, file_path, start_line, list(x ORDER BY first) AS writes FROM (SELECT repo, file_path, start_line, x, min((part, i)) AS first FROM w GROUP BY ALL) GROUP BY ALL),
r AS (SELECT b.repo, b.file_path, b.start_line, v.name AS x FROM bodies b JOIN vars v ON v.repo = b.repo AND v.file_path = b.file_path AND v.contract_name = b.contract_name AND list_contains(regexp_extract_all(b.body, '{WORD}'), v.name)
      UNION
      SELECT b.repo, b.file_path, b.start_line, a.root || '.' || m FROM (SELECT *, unnest(regexp_extract_all(body, '{MEMBER}', 1)) AS x, unnest(regexp_extract_all(body, '{MEMBER}', 2)) AS m FROM bodies) b
      JOIN alias a ON a.repo = b.repo AND a.file_path = b.file_path AND a.start_line = b.start_line AND a.alias = b.x),
rs AS (SELECT repo, file_path, start_line, list(x ORDER BY x) AS reads FROM r GROUP BY ALL),
cs AS (SELECT repo, file_path, start_line, list(called ORDER BY first) AS calls FROM called GROUP BY ALL),
fn AS (SELECT b.repo, b.file_path, contract_name, function_name, b.start_line,
       CASE WHEN regexp_matches(full_sig, '\\bexternal\\b') THEN 'external' WHEN regexp_matches(full_sig, '\\bpublic\\b') THEN 'public' WHEN regexp_matches(full_sig, '\\binternal\\b') THEN 'internal' WHEN regexp_matches(full_sig, '\\bprivate\\b') THEN 'private' END AS visibility,
       contains(full_sig, 'payable') AS payable,
       list_filter(regexp_extract_all(string_split(full_sig, ')')[-1], '{WORD}'), lambda x: x NOT IN {_list(SIGNATURE_WORDS)}) AS modifiers,
       list_filter(list_transform(string_split(regexp_extract(full_sig, '\\((.*?)\\)', 1), ','), lambda x: regexp_extract(trim(x), '\\S+$')), lambda x: x <> '') AS parameters,
       coalesce(reads, []) AS reads, coalesce(writes, []) AS writes, coalesce(calls, []) AS calls, full_sig
FROM (SELECT b.*, (SELECT string_agg(trim(l.raw), ' ' ORDER BY l.line_no) FROM lines l JOIN ranges g ON g.repo = l.repo AND g.file_path = l.file_path AND g.start_line = b.start_line AND l.line_no BETWEEN g.start_line AND g.end_line WHERE l.repo = b.repo AND l.file_path = b.file_path) AS full_sig FROM bodies b) b
LEFT JOIN ws USING (repo, file_path, start_line) LEFT JOIN rs USING (repo, file_path, start_line) LEFT JOIN cs USING (repo, file_path, start_line))"""

_PLACE = "repo, file_path, line_no, contract_name, function_name"
ORACLE = {
    "state_variables": f"WITH {FACTS_SQL} SELECT * FROM vars",
    "function_facts": f"""WITH {FUNCTIONS_SQL}
SELECT repo, file_path, contract_name, function_name, start_line, visibility, payable, array_to_string(modifiers, ',') AS modifiers, array_to_string(parameters, ',') AS parameters,
       array_to_string(reads, ',') AS reads, array_to_string(writes, ',') AS writes, array_to_string(calls, ',') AS calls FROM fn""",
    "storage_accesses": f"WITH {FACTS_SQL} SELECT * FROM storage",
    "call_edges": f"WITH {FACTS_SQL} SELECT * FROM edges",
    "token_types": f"WITH {FACTS_SQL} SELECT * FROM tokens",
    "receiver_kinds": f"WITH {FACTS_SQL} SELECT {_PLACE}, receiver, kind FROM received WHERE receiver IS NOT NULL",
    "unchecked_returns": f"""WITH {FACTS_SQL},
x AS (SELECT *, replace(code, ' ', '') AS c, lower(code) AS low FROM received WHERE code <> ''),
y AS (SELECT *, {_any("c", (".transfer(", ".transferFrom(", ".approve("))} AS direct FROM x WHERE NOT {_any("low", ("safetransfer", "safeapprove"))}),
z AS (SELECT *, CASE WHEN direct AND NOT contains(c, 'require(') AND NOT contains(split_part(c, '.transfer', 1), '=') THEN 'result ignored'
                     WHEN contains(code, 'call(') AND {_any("code", ("ERC20", "transfer.selector", "transferFrom.selector", "approve(", "approve.selector"))} AND NOT contains(code, 'abi.decode') AND NOT contains(low, 'returndata') THEN 'only the call''s status is checked' END AS why
      FROM y WHERE NOT (direct AND (starts_with(c, 'to.transfer(') OR kind NOT IN ('erc20', 'unknown'))))
SELECT {_PLACE}, receiver, kind, why FROM z WHERE why IS NOT NULL""",
    "asset_flows": f"WITH {FACTS_SQL} SELECT * FROM flows",
    "auth_constraints": f"WITH {FACTS_SQL} SELECT * FROM auth",
    "lifecycle_transitions": f"WITH {FACTS_SQL} SELECT * FROM lifecycle",
    "trust_boundaries": f"WITH {FACTS_SQL} SELECT * FROM boundaries",
}
