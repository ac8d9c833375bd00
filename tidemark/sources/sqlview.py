"""Read-only SQL over named frames."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.checks import ValidationError

_TOKEN = re.compile(r"--[^\n]*|/\*.*?\*/|'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\"|`(?:[^`]|``)*`|\w+|\s+|.", re.DOTALL)
_AFTER = {"ORDER", "LIMIT", "OFFSET", "UNION", "INTERSECT", "EXCEPT", "MINUS", "SORT", "CLUSTER", "DISTRIBUTE"}


def with_qualify(sql: str) -> str:
    """sql with each QUALIFY as a filter over its query: the condition becomes a column, which the filter drops again."""
    while True:
        tokens, depth, depths = _TOKEN.findall(sql), 0, []
        for t in tokens:
            depth -= t == ")"
            depths.append(depth)
            depth += t == "("
        words = [t.upper() for t in tokens]
        before = lambda i: next((w for w in reversed(words[:i]) if w.strip()), "")
        found = [i for i, w in enumerate(words) if w == "QUALIFY" and before(i) != "."]
        if not found:
            return sql
        q = found[-1]  # the innermost comes no earlier than the ones around it
        d = depths[q]
        select = q
        while not (words[select] == "SELECT" and depths[select] == d):
            select -= 1
            if select < 0 or depths[select] < d:
                raise ValidationError("QUALIFY without SELECT")
        start = next((i for i in range(select, q) if words[i] == "FROM" and depths[i] == d), None)
        if start is None or next((w for w in words[select + 1 :] if w.strip()), "") == "DISTINCT":
            raise ValidationError("QUALIFY needs a FROM clause and no DISTINCT")
        end = next((i for i in range(q + 1, len(tokens)) if depths[i] < d or (depths[i] == d and (words[i] in _AFTER or words[i] == ";"))), len(tokens))
        name = f"__qualify_{len(found)}"
        text = lambda a, b: "".join(tokens[a:b])
        sql = f"{text(0, select)}SELECT * EXCEPT ({name}) FROM ({text(select, start).rstrip()}, ({text(q + 1, end).strip()}) AS {name} {text(start, q).rstrip()}) WHERE {name} {text(end, len(tokens))}"


class SqlView:
    """Frames as tables; only queries over them run.

    What a statement is, is told by its parsed plan, not by its text: each of its nodes and functions must be of a kind
    that is named here. Commands, scripts, files named as tables, relations other than the frames, functions that the
    session registered, and built-in ones that call Java, or that tell of files or of the session, are refused. The
    session is left as it was: views of a query are dropped once it is analysed. QUALIFY is understood.
    """

    #: Logical operators of a query, as parsed.
    PLANS = frozenset(
        """Project Filter Aggregate Join LateralJoin UnresolvedHaving Sort GlobalLimit LocalLimit Offset Union Distinct Intersect Except SubqueryAlias UnresolvedWith
        UnresolvedRelation UnresolvedInlineTable OneRowRelation Generate UnresolvedSubqueryColumnAliases UnresolvedTableValuedFunction UnresolvedTVFAliases Pivot Unpivot
        WithWindowDefinition Sample Window UnresolvedHint Deduplicate Range ResolvedHint LocalRelation""".split()
    )
    #: Groups of built-in functions as Spark documents them; of the group misc only those named next.
    GROUPS = frozenset(f"{g}_funcs" for g in "agg array bitwise collection conditional conversion csv datetime generator hash json lambda map math predicate string struct url variant window sketch operator cast".split())
    MISC = frozenset({"typeof", "uuid", "equal_null", "bitmap_bit_position", "bitmap_bucket_number", "bitmap_count", "assert_true", "nullif", "nvl", "version"})
    ALLOWED_FUNCTIONS = frozenset({"range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack"})

    def __init__(self, frames: dict[str, DataFrame]):
        self.frames = frames
        self.spark: SparkSession = next(iter(frames.values())).sparkSession

    def query(self, sql: str, args: list | dict | None = None) -> DataFrame:
        sql = with_qualify(sql.strip().rstrip(";"))
        self._check(self.spark._jsparkSession.sessionState().sqlParser().parsePlan(sql), set())
        own = uuid.uuid4().hex
        names = {n: f"tidemark_{own}_{i}" for i, n in enumerate(self.frames)}
        try:
            for n, df in self.frames.items():
                df.createOrReplaceTempView(names[n])
            heads = ", ".join(f"`{n}` AS (SELECT * FROM `{v}`)" for n, v in names.items())
            return self.spark.sql(f"WITH {heads} SELECT * FROM (\n{sql}\n)", args=args)
        finally:
            for v in names.values():
                self.spark.catalog.dropTempView(v)

    def _check(self, plan, local: set[str]) -> None:
        kind = plan.getClass().getSimpleName().rstrip("$")
        if kind not in self.PLANS:
            raise ValidationError(f"not a query: {kind}")
        if kind == "UnresolvedWith":
            pairs = plan.cteRelations()
            local = local | {pairs.apply(i)._1() for i in range(pairs.size())}
            for i in range(pairs.size()):
                self._check(pairs.apply(i)._2(), local)
        if kind == "UnresolvedRelation":
            parts = plan.multipartIdentifier()
            if parts.size() != 1 or parts.apply(0) not in local | set(self.frames):
                raise ValidationError(f"unknown table {plan.multipartIdentifier().mkString('.')}")
        if kind == "UnresolvedTableValuedFunction" and plan.name().mkString(".").lower() not in self.ALLOWED_FUNCTIONS:
            raise ValidationError(f"function {plan.name().mkString('.')} may not be used")
        expressions = plan.expressions()
        for i in range(expressions.size()):
            self._check_functions(expressions.apply(i))
        for children in (plan.children(), plan.innerChildren()):
            for i in range(children.size()):
                child = children.apply(i)
                if hasattr(child, "children"):
                    self._check(child, local)
        subqueries = plan.subqueries()
        for i in range(subqueries.size()):
            self._check(subqueries.apply(i), local)

    def _check_functions(self, expression) -> None:
        kind = expression.getClass().getSimpleName()
        if kind == "ExpressionWithUnresolvedIdentifier":
            raise ValidationError("names must be written out")
        if kind in ("UnresolvedFunction", "UnresolvedGenerator"):
            parts = expression.nameParts() if hasattr(expression, "nameParts") else expression.name().nameParts()
            name = parts.mkString(".").lower()
            if parts.size() != 1 or not self._known(name):
                raise ValidationError(f"function {name} may not be used")
        children = expression.children()
        for i in range(children.size()):
            self._check_functions(children.apply(i))

    def _known(self, name: str) -> bool:
        identifier = self.spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name)
        info = self.spark._jsparkSession.sessionState().functionRegistry().lookupFunction(identifier)
        if info.isEmpty() or info.get().getSource() != "built-in":
            return False
        return info.get().getGroup() in self.GROUPS or name in self.MISC
