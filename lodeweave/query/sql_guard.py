"""What SQL over the graph may do: query its views, by a list of what is allowed.

The parsed plan is walked before anything runs: every node must be one of a query, every relation a view of
the graph or a common table of the query itself, every function on the list. Commands, writes, files as
tables, table functions, other catalogs and functions that reach the JVM, Python or the session are on no list.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from lodeweave.query.guard import MAX_CHARS

# Plan nodes that queries consist of.
NODES = set("Project Filter UnresolvedRelation SubqueryAlias Aggregate Sort GlobalLimit LocalLimit Offset Distinct Union Intersect Except Join UnresolvedWith UnresolvedInlineTable OneRowRelation UnresolvedHaving WithWindowDefinition UnresolvedSubqueryColumnAliases LateralJoin Generate LocalRelation UnresolvedOrdinal CTERelationDef ParameterizedQuery".split())
# Functions that only compute from their arguments.
FUNCTIONS = set("""abs aggregate any any_value approx_count_distinct array array_agg array_contains array_distinct array_except array_intersect array_join array_max array_min array_position array_remove array_sort array_union arrays_overlap ascii avg bool_and bool_or
cardinality ceil ceiling char_length character_length coalesce collect_list collect_set concat concat_ws contains count count_if cume_dist current_date date date_add date_diff date_format date_sub datediff day dayofmonth dense_rank element_at endswith every exists explode explode_outer
filter first first_value flatten floor forall format_number get greatest hour if ifnull initcap instr isnotnull isnull lag last last_value lcase lead least left length levenshtein listagg locate lower lpad ltrim map max max_by md5 mean median min min_by minute mode month
named_struct ntile nullif nvl nvl2 percent_rank percentile posexplode position pow power quarter rank regexp_count regexp_extract regexp_extract_all regexp_like regexp_replace replace reverse right rlike round row_number rpad rtrim second sequence sha2 sign size slice some sort_array split split_part startswith std stddev string_agg struct substr substring substring_index sum
to_date to_json to_timestamp transform translate trim trunc try_cast try_divide try_element_at ucase upper var_pop variance when year zip_with""".split())


def sql_denial(spark: SparkSession, query: str, views: set[str]) -> str | None:
    """Why a query may not run, None if it may."""
    if not query or not query.strip():
        return "empty query"
    if len(query) > MAX_CHARS:
        return f"query longer than {MAX_CHARS} characters"
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
    except Exception as e:
        return f"no single SQL query: {str(e).strip().splitlines()[0][:200]}"
    return _plan(plan, {v.lower() for v in views})


def _each(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _plan(node, known: set[str]) -> str | None:
    kind = node.getClass().getSimpleName()
    if kind not in NODES:
        return f"{kind} is not allowed, only queries are"
    if kind == "UnresolvedWith":
        known = known | {_name(x).lower() for x in _each(node.cteRelations())}
        for x in _each(node.innerChildren()):
            if reason := _plan(x, known):
                return reason
    if kind == "UnresolvedRelation":
        parts = _each(node.multipartIdentifier())
        if len(parts) != 1 or parts[0].lower() not in known:
            return f"relation {'.'.join(parts)} is not a view of the graph"
    for x in _each(node.expressions()):
        if reason := _expression(x, known):
            return reason
    for x in _each(node.children()):
        if reason := _plan(x, known):
            return reason
    return None


def _name(pair) -> str:
    """The name of a common table: the first part of its definition."""
    return str(pair.productElement(0))


def _expression(e, known: set[str]) -> str | None:
    kind = e.getClass().getSimpleName()
    if kind == "UnresolvedFunction":
        name = ".".join(_each(e.nameParts())).lower()
        if name not in FUNCTIONS:
            return f"function {name} is not allowed"
    elif kind in ("ScalarSubquery", "Exists", "ListQuery", "InSubquery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression") and hasattr(e, "plan") and kind != "InSubquery":
        if reason := _plan(e.plan(), known):
            return reason
    elif kind == "UnresolvedGenerator":
        name = e.name().funcName().lower()
        if name not in FUNCTIONS:
            return f"function {name} is not allowed"
    elif kind in ("CallMethodViaReflection", "TryReflect", "PythonUDF", "ScalaUDF"):
        return f"{kind} is not allowed"
    for x in _each(e.children()):
        if reason := _expression(x, known):
            return reason
    return None
