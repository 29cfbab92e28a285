"""The scan as a table function, for SQL text: SELECT d.doc_id, s.* FROM d, LATERAL scan_rules(d.text) s."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..options import Options
from ..plans.rules import RuleSet
from .detect import Narrowing, python_variant, scan_text

RETURNS = "position int, match string, rule int, rule_type string, title string"


def scan_function(rules: RuleSet, options: Options | None = None, title_form: bool = False):
    """A table function of a text: its matches in order, as `detect.scan` gives them."""
    o = options or Options()
    chosen = rules.scannable(o)

    class Scan:
        def __init__(self) -> None:
            self.narrowed, self.left = Narrowing(chosen, o.optimizers), {}

        def eval(self, text: str) -> Iterator[tuple]:
            if text is None:
                return
            variant = python_variant(self.narrowed, text)
            if variant not in self.left:
                open_ = self.narrowed.left(variant)
                self.left[variant] = (list(open_), tuple(open_.values()))
            numbers, left = self.left[variant]
            for position, match, k, title in scan_text(text, left, o.strict, title_form, o.reference_limit) if left else ():
                yield position, match, numbers[k], left[k].rule.type, title

    return F.udtf(Scan, returnType=RETURNS, useArrow=False)


def register_scan(spark: SparkSession, rules: RuleSet, name: str = "scan_rules", options: Options | None = None, title_form: bool = False) -> None:
    """Makes the scan known to SQL text of the session."""
    spark.udtf.register(name, scan_function(rules, options, title_form))
