"""Conditions whose errors are null: the parsed expression is written again with operations that do not raise."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, functions as F

_SAFE = {"Divide": "try_divide", "Remainder": "try_mod", "Add": "try_add", "Subtract": "try_subtract", "Multiply": "try_multiply"}
#: Expressions of which only some operands are evaluated; an error in one makes that operand null.
_BRANCHING = ("CaseWhen", "If", "LambdaFunction")


class _Safe:
    """The text of an expression without raising operations, and the text of a test whether evaluating it raises.

    Texts are cut by the positions that the parser keeps with each node, so all else stays as it was written.
    """

    def __init__(self, text: str, spark):
        self.text, self.changed = text, False
        parts, tests = self._rewrite(spark._jsparkSession.sessionState().sqlParser().parseExpression(text))
        self.safe, self.raises = self._joined(parts, 0, len(text)), " OR ".join(tests)

    def _joined(self, parts: list[tuple[int, int, str]], low: int, high: int) -> str:
        """The text from low to high with parts of it replaced; parts outside, or within another, are left out."""
        out, at = [], low
        for start, stop, text in sorted(parts, key=lambda p: (p[0], -p[1])):
            if at <= start and stop <= high and text != self.text[start:stop]:
                out += [self.text[at:start], text]
                at = stop
        return "".join([*out, self.text[at:high]])

    def _span(self, low: int, high: int, parts: list[tuple[int, int, str]]) -> tuple[int, int]:
        """From the first to the last operand: of ``a IN (b)`` the parser keeps the place of the part behind a only."""
        low, high = min([low, *[p[0] for p in parts]]), max([high, *[p[1] for p in parts]])
        while self.text[low:high].count(")") > self.text[low:high].count("(") and "(" in self.text[:low]:
            low = self.text.rindex("(", 0, low)
        return low, high

    def _rewrite(self, node) -> tuple[list[tuple[int, int, str]], list[str]]:
        """What replaces the node's text (start, end, text; several for a node without a position), and tests that it raises."""
        kind, origin, nodes = node.getClass().getSimpleName(), node.origin(), node.children()
        below = [self._rewrite(nodes.apply(i)) for i in range(nodes.size())]
        parts, tests = [p for ps, _ in below for p in ps], [t for _, ts in below for t in ts]
        if kind in _BRANCHING:
            tests = []
        if origin.startIndex().isEmpty() or origin.stopIndex().isEmpty():
            return parts, tests
        low, high = self._span(origin.startIndex().get(), origin.stopIndex().get() + 1, parts)
        if re.match(r"(?i)if\s*\(", self.text[low:high]):
            tests = []
        whole = all(len(ps) == 1 for ps, _ in below)
        if kind in ("And", "Or") and whole and len(below) == 2 and below[0][0] != below[1][0]:
            # the right side counts only where the left one does not decide
            (((_, _, left),), a), (((_, _, right),), b) = below
            decided = f"coalesce({'' if kind == 'And' else 'NOT '}({left}), true)"
            return [(low, high, f"({left}) {kind.upper()} ({right})")], [*a, *[f"(({t}) AND {decided})" for t in b]]
        if (kind in _SAFE or kind == "IntegralDivide") and whole and len(below) == 2:
            self.changed = True
            left, right = (ps[0][2] for ps, _ in below)
            safe = f"(({left}) div nullif({right}, 0))" if kind == "IntegralDivide" else f"{_SAFE[kind]}({left}, {right})"
            return [(low, high, safe)], [*tests, f"(({left}) IS NOT NULL AND ({right}) IS NOT NULL AND {safe} IS NULL)"]
        if kind == "Cast" and whole:
            self.changed = True
            inner = parts[0][2]
            safe = f"try_cast({inner} AS {node.dataType().sql()})"
            return [(low, high, safe)], [*tests, f"(({inner}) IS NOT NULL AND {safe} IS NULL)"]
        return [(low, high, self._joined(parts, low, high))], tests


def safe_condition(condition: str, df: DataFrame) -> str:
    """The condition, null where evaluating it would raise: a zero divisor, an overflow, a cast that fails.

    ``AND`` and ``OR`` are taken from the left: what their left side decides does not depend on the right one. Inside
    CASE, IF and lambdas an error makes the value null that raised. A condition without such operations, or
    one that the analyzer rejects in the other form, is returned as it is, so it still reaches a scan as a filter.
    """
    try:
        found = _Safe(condition, df.sparkSession)
    except ParseException:  # it comes again where the condition is used
        return condition
    if not found.changed:
        return condition
    for safe in ([f"CASE WHEN {found.raises} THEN NULL ELSE {found.safe} END"] if found.raises else []) + [found.safe]:
        try:
            df.select(F.expr(safe))
            return safe
        except AnalysisException:
            continue
    return condition
