"""Aggregate queries from outside, run with disclosure control.

A query must be one SELECT whose every branch aggregates. It is checked on Spark's parsed
plan, before anything is resolved or read, and again on the analyzed plan, so that what a
star or an alias hides is seen too. Anything that can't be inspected is refused.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns that identify persons, functions that combine rows (by their class), and names of counts.
BLOCKED = ("respondent_id", "session_id", "external_id", "subject_id", "interviewer_id")
AGGREGATES = """Count CountIf Sum Average Min Max StddevSamp StddevPop VarianceSamp VariancePop Median Percentile PercentileCont PercentileDisc ApproximatePercentile
HyperLogLogPlusPlus First AnyValue BoolOr BoolAnd Mode Kurtosis Skewness BitAndAgg BitOrAgg ListAgg CollectList CollectSet HistogramNumeric""".split()
COUNT_NAMES = {"n", "count", "cnt", "freq", "frequency", "total"}
COUNT_STARTS, COUNT_ENDS = ("n_", "num_"), ("_count", "_n", "_num", "_freq")
SCALARS_REFUSED = ("reflect", "java_method", "try_reflect", "input_file_name", "read_files")
#: Expressions that put several columns into one value, by which an aggregate would release whole rows.
COMPOSING = ("CreateNamedStruct", "CreateArray", "CreateMap", "StructsToJson", "StructsToCsv", "StructsToXml", "Concat", "ConcatWs")
HIDDEN = "__rows_of_group"


def names_count(name: str) -> bool:
    """Whether a column's name says that it holds a count; a prefix or suffix alone doesn't."""
    n = name.lower()
    return n in COUNT_NAMES or any(n.startswith(p) and n != p for p in COUNT_STARTS) or any(n.endswith(x) and n != x for x in COUNT_ENDS)


@dataclass(frozen=True)
class Released:
    """What may leave: the rows, which columns are counts, how many rows were held back, the risk, and the query's hash."""

    rows: DataFrame
    count_columns: list[str]
    suppressed: int
    risk: str
    query_hash: str

    def as_json(self) -> str:
        """The released rows as JSON text with the disclosure control applied to them."""
        rows = [r.asDict() for r in self.rows.collect()]
        return json.dumps({"query_hash": self.query_hash, "columns": self.rows.columns, "rows": rows, "disclosure_control": {"count_columns": self.count_columns, "suppressed_rows": self.suppressed, "risk": self.risk}}, default=str)


def _walk(node, children):
    yield node
    for child in children(node):
        yield from _walk(child, children)


def _list(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _nodes(plan) -> list:
    """Plan nodes with subqueries inside expressions."""
    found = []
    for node in _walk(plan, lambda n: [*_list(n.children()), *_list(n.innerChildren())]):
        if not hasattr(node, "expressions"):
            continue
        found.append(node)
    return found


def _expressions(node) -> list:
    return [e for top in _list(node.expressions()) for e in _walk(top, lambda x: _list(x.children()))]


def _kind(x) -> str:
    return x.getClass().getSimpleName().rstrip("$")


def check(spark: SparkSession, sql: str):
    """Raises ValueError unless ``sql`` may run; returns the DataFrame, not yet run."""
    text = sql.strip().rstrip(";").strip()
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:
        raise ValueError(f"Invalid SQL: {str(e).splitlines()[0]}") from None
    if not re.match(r"^\s*(select|with|\()", text, re.I):
        raise ValueError("only SELECT is allowed")
    if re.search(r"\b(" + "|".join(BLOCKED) + r")\b", _without_using(text), re.I):
        raise ValueError("the query names a column that identifies persons")
    if re.search(r"\b(" + "|".join(SCALARS_REFUSED) + r")\s*\(", text, re.I) or re.search(r"\b(parquet|csv|json|orc|text|binaryfile|avro|delta)\s*\.\s*`", text, re.I):
        raise ValueError("files and system functions are out of reach")
    if re.search(r"\bover\s*(\(|[a-z_])", text, re.I):
        raise ValueError("window functions give rows, not aggregates")
    if "UnresolvedTableValuedFunction" in (tree := plan.toString()) or "unresolved_table_valued_function" in tree.lower() or re.search(r"\bfrom\s+(?!explode|range)[a-z_]+\s*\(", text, re.I):
        raise ValueError("table functions are out of reach")
    try:
        df = spark.sql(text)
    except Exception as e:
        raise ValueError(f"Invalid SQL: {str(e).splitlines()[0]}") from None
    analyzed = df._jdf.queryExecution().analyzed()
    if not _branches_aggregate(analyzed):
        raise ValueError("every branch of the query must aggregate in its outermost SELECT")
    for name in df.columns:
        if name.lower() in BLOCKED:
            raise ValueError("the result holds a column that identifies persons")
    refused = _identifying_output(analyzed)
    if refused:
        raise ValueError(f"the result releases single values of {refused}")
    return df


def _without_using(text: str) -> str:
    return re.sub(r"\busing\s*\([^()]*\)", " ", text, flags=re.I)


def _branches_aggregate(plan) -> bool:
    kind = _kind(plan)
    if kind in ("Union", "Intersect", "Except"):
        return all(_branches_aggregate(c) for c in _list(plan.children()))
    if kind in ("Aggregate",):
        exprs = plan.aggregateExpressions()
        return any("AggregateExpression" in _kind(e) for top in _list(exprs) for e in _walk(top, lambda x: _list(x.children())))
    if kind in ("Sort", "GlobalLimit", "LocalLimit", "Project", "Filter", "SubqueryAlias", "WithCTE", "Distinct", "Deduplicate", "Offset", "View"):
        kids = _list(plan.children())
        return _branches_aggregate(kids[-1] if kind == "WithCTE" else kids[0])
    return False


def _origins(plan) -> dict[int, set]:
    """For each aliased attribute the attributes it is made of, as (id, name)."""
    made: dict[int, set] = {}
    for node in _nodes(plan):
        for e in _expressions(node):
            if _kind(e) == "Alias":
                inside = {(x.exprId().id(), x.name().lower()) for x in _walk(e.child(), lambda x: _list(x.children())) if _kind(x) == "AttributeReference"}
                made.setdefault(e.exprId().id(), set()).update(inside)
    return made


def _names(ident: int, name: str, made: dict[int, set]) -> set[str]:
    """All names that an attribute has had on its way through the plan."""
    found, todo, seen = {name}, [ident], set()
    while todo:
        if (i := todo.pop()) not in seen:
            seen.add(i)
            for origin, n in made.get(i, ()):
                found.add(n)
                todo.append(origin)
    return found


def _outside_counts(e, within: bool = False):
    """Expressions that aren't counted only, each with whether it lies within an aggregate."""
    if _kind(e) in ("Count", "HyperLogLogPlusPlus"):
        return
    yield e, within
    for child in _list(e.children()):
        yield from _outside_counts(child, within or _kind(e) == "AggregateExpression")


def _identifying_output(plan) -> str | None:
    """Why the result would release single persons' values, or None.

    An identifying column, under whatever alias, may only be counted. Each aggregate is judged by itself: only those
    of AGGREGATES may combine rows, and no value they combine may be made of several columns.
    """
    made = _origins(plan)
    for node in _nodes(plan):
        if _kind(node) != "Aggregate":
            continue
        for top in [*_list(node.aggregateExpressions()), *_list(node.groupingExpressions())]:
            for e in _walk(top, lambda x: _list(x.children())):
                if _kind(e) == "AggregateExpression" and (f := _kind(e.aggregateFunction())) not in AGGREGATES:
                    return f"{f}, which isn't an allowed aggregate"
            for e, within in _outside_counts(top):
                if _kind(e) == "AttributeReference" and (hit := _names(e.exprId().id(), e.name().lower(), made) & set(BLOCKED)):
                    return min(hit)
                if within and _kind(e) in COMPOSING:
                    return "several columns in one"
    return None


def with_hidden_counts(sql: str) -> str:
    """``sql`` with the number of rows of each group as last column of every outermost SELECT.

    DISTINCT, INTERSECT and EXCEPT in the outermost query raise ValueError, as another column would change what they do.
    """
    words, depth, i = [], 0, 0
    pattern = re.compile(r"--[^\n]*|/\*.*?\*/|'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|[()]|\w+", re.S)
    for m in pattern.finditer(sql):
        t = m.group()
        depth += (t == "(") - (t == ")")
        if depth == 0 and re.match(r"[a-z]", t, re.I):
            words.append((t.lower(), m.start(), m.end()))
    if any(w in ("distinct", "intersect", "except", "minus") for w, *_ in words):
        raise ValueError("DISTINCT, INTERSECT and EXCEPT can't be released")
    ends = {"from", "where", "group", "having", "order", "limit", "union", "offset"}
    places = []
    for k, (w, _, after) in enumerate(words):
        if w == "select":
            later = [start for v, start, _ in words[k + 1 :] if v in ends]
            places.append(later[0] if later else len(sql))
    out = sql
    for at in sorted(places, reverse=True):
        out = f"{out[:at]}, count(*) AS {HIDDEN} {out[at:]}"
    if not places:
        raise ValueError("the outermost SELECT can't be found")
    return out


def count_columns(df: DataFrame, held: DataFrame) -> list[str]:
    """Columns holding counts: by name, or made by COUNT or SUM, if they are whole, non-negative numbers in all rows of ``held``, the stored result of ``df``."""
    analyzed = df._jdf.queryExecution().analyzed()
    forced: set[str] = set()
    for node in _nodes(analyzed):
        if _kind(node) == "Aggregate":
            for top in _list(node.aggregateExpressions()):
                if any(_kind(e) in ("Count", "Sum") for e in _walk(top, lambda x: _list(x.children()))):
                    forced.add(top.name())
    named = [f.name for f in held.schema if (names_count(f.name) or f.name in forced or f.name.lower().startswith(("count(", "sum("))) and isinstance(f.dataType, T.NumericType)]
    if not named:
        return []
    c = lambda n: F.col(f"`{n}`")
    odd = held.agg(*(F.count_if((c(n) < 0) | (c(n) != F.floor(c(n).cast("double")))).alias(f"o{i}") for i, n in enumerate(named))).first()
    return [n for i, n in enumerate(named) if odd[i] == 0]


def suppress(df: DataFrame, counts: list[str], min_cell: int) -> DataFrame:
    """``df`` without the rows in which any count is below ``min_cell``; null counts are ignored."""
    if not counts:
        return df
    low = [F.coalesce(F.col(f"`{n}`") < min_cell, F.lit(False)) for n in counts]
    keep = ~low[0]
    for x in low[1:]:
        keep = keep & ~x
    return df.where(keep)


def risk_of(visible: int) -> str:
    """Risk of re-identification by the number of visible rows."""
    return "high" if visible < 3 else "medium" if visible < 5 else "low"


def run_federated(spark: SparkSession, sql: str, min_cell: int = 5) -> Released:
    """Checks, runs and suppresses. The result is stored once, so that counting and releasing see the same rows.

    A row is held back if any of its counts, or the number of rows behind it, shown or not, is below ``min_cell``.
    """
    from cohortspark.operators.storage import stored

    text = sql.strip().rstrip(";").strip()
    df = check(spark, sql)
    counted = spark.sql(with_hidden_counts(text))
    if counted.columns[:-1] != df.columns:
        raise ValueError("the query can't be inspected")
    held = stored(counted.toDF(*(f"c{i}" for i in range(len(df.columns))), HIDDEN), "federated")
    shown = held.drop(HIDDEN).toDF(*df.columns)
    counts = count_columns(df, shown)
    kept = suppress(held.where(F.col(HIDDEN) >= min_cell).drop(HIDDEN).toDF(*df.columns), counts, min_cell)
    total, visible = held.count(), kept.count()
    digest = hashlib.sha256(text.encode()).hexdigest()[:16]
    return Released(kept, counts, total - visible, risk_of(visible), digest)
