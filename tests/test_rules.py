"""The rule language: macros, orders, filters, templates."""

import pytest
from pyspark.sql import functions as F

from citemill.options import Aliases, Options
from citemill.plans.rules import Macros, Rule, RuleError, View, compile_rules, load_json, load_rules, normalised, ordered, rules_from_xml, save_json
from citemill.plans.templates import Scope, TemplateError, condition, template


def test_macros_by_language():
    m = Macros({"a": "x", "a_FR": "y", "b_ENDEFR": "(z)", "b": "w", "c": "{{ a }}-{{?: b }}{{?! b }}{{?= a }}"}, "FR")
    assert m.expand("{{ c }}") == "y-(?:(?:z))(?!(?:z))(?=y)"
    assert Macros({"a": "x"}, "EN").expand("{{ a }}{{ possesive_quantifier }}") == "x"
    with pytest.raises(RuleError):
        m.expand("{{ none }}")
    with pytest.raises(RuleError):
        Macros({"a": "{{ b }}", "b": "{{ a }}"}).expand("{{ a }}")


def test_normalised():
    assert normalised("a# note\nb  c") == "a bc"


def test_orders_and_views():
    got = ordered([Rule("a"), Rule("b", order=5, views=(View("x", "1"), View("y", "2", is_default=True))), Rule("c")])
    assert [(r.type, r.order) for r in got] == [("a", 1000), ("b", 5000), ("c", 6000)]
    assert [(v.target, v.order) for v in got[1].views] == [("y", 5000), ("x", 5001)]


def test_filters():
    rules = compile_rules([Rule("a", pattern="a", views=(View("t1", "x", environments=("e",)), View("table", "x"))), Rule("b", pattern="b", views=(View("table", "x"),)), Rule("c", pattern="c", forced=True, views=(View("t2-old", "x"),)), Rule("d", pattern="d(", views=(View("t1", "x"),))])
    assert [c.rule.type for c in rules.rules] == ["a", "b", "c"]  # an unbalanced pattern is left out
    names = lambda o: [c.rule.type for c in rules.scannable(o).rules]
    assert names(Options()) == ["a", "c"]
    assert names(Options(special_rules=False)) == ["a"]
    assert names(Options(environments=frozenset({"other"}))) == ["c"]
    assert names(Options(excluded_targets=("t2",))) == ["a"]
    assert names(Options().with_filter(None, ["t1"], {"t1"})) == ["a"]
    assert names(Options().with_filter(None, ["none"], {"t1"})) == []
    assert names(Options(types=frozenset({"c"}))) == ["c"]


def test_forms(tmp_path):
    xml = '<rules><rule type="a" order="2" lang="EN"><pattern>(x)</pattern><view target="t" default="1">{{ $1 }}</view><footnote type="f">n</footnote></rule><rule type="bad"/></rules>'
    rules = rules_from_xml(xml)
    assert len(rules) == 1 and rules[0].views[0].is_default and rules[0].footnotes[0].type == "f"
    save_json(rules, tmp_path / "r.json")
    assert load_json(tmp_path / "r.json") == rules
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.xml").write_text(xml)
    (tmp_path / "d" / "b.xml").write_text("<broken")
    assert load_rules(tmp_path) == rules


def test_templates(spark):
    groups = F.array(F.lit("whole"), F.lit("C"), F.lit("12"), F.lit(None), F.lit("04"))
    scope = Scope(groups, F.create_map(F.lit("celex"), F.lit("6")))
    cases = [
        (template("{{ $1 }}-$2::$$ {{ $4|year|concat:'x' }}", scope), "C-12:$ 2004x"),
        (template("{{ $2|pad:'0':4 }}{{ $3|any:($2|pad:'0':3):'z' }}", scope), "0012012"),
        (template("{{ $1|remap:['/C/','/T/']:['a','b'] }}", scope), "a"),
        (template("{{ $celex }}", scope), "6"),
        (condition("$1 == 'C' and not ($3 or $2 > 20)", scope), "true"),
        (condition("$3 || $1|is:'T,F'", scope), "false"),
        (condition("", scope), "true"),
    ]
    row = spark.range(1).select(*[c.cast("string") for c, _ in cases]).first()
    assert list(row) == [want for _, want in cases]
    for bad in ("[[ code ]]", "{{ $1|unknown }}", "{{ $1|pad: }}"):
        with pytest.raises(TemplateError):
            template(bad, scope)


def test_options_and_aliases():
    assert "handoc" not in Options().with_modes("all").linked_data
    with pytest.raises(ValueError):
        Options().with_modes("x")
    a = Aliases().added("A", "1").added("A", "2", local=True).added("B", "3", local=True)
    assert a.get("A") == "1" and a.get("B") == "3" and a.removed("A").get("A") is None
