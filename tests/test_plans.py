"""Parsing and refusals: no Spark job runs here."""

import pytest

from eavspark.edn import EdnError
from eavspark.plans import ast as q
from eavspark.plans.parse import parse
from eavspark.plans.validate import QueryError, validate


def test_forms_agree():
    a = parse("[:find ?e :in ?x :where [?e :a ?x] :order [?e :desc] :limit 3]")
    b = parse("{:find [?e] :in [?x] :where [[?e :a ?x]] :order [[?e :desc]] :limit 3}")
    assert a == b and a.order == [(q.Var("?e"), False)] and a.limit == 3


def test_reverse_attribute():
    assert parse("[:find ?x :where [?x :a/_b ?y]]").where == parse("[:find ?x :where [?y :a/b ?x]]").where


@pytest.mark.parametrize(
    "text",
    ["[:find ?e]", "[:where [?e :a 1]]", "[:find ?e :find ?x :where [?e :a ?x]]", "{:find [?e] :find [?x] :where [[?e :a ?x]]}", "[:find ?e :where [?e :a ?x] :limit 0]",
     "[:find ?e :where [-1 :a ?e]]", "[:find ?e :where (or)]", "[:find ?e :where [?e :a nil]]"],
)
def test_unparsable(text):
    with pytest.raises(EdnError):
        parse(text)


@pytest.mark.parametrize(
    "text, args, message",
    [
        ("[:find ?e :where [?e ?a 1]]", [], "Attribute position must be a keyword or entid"),
        ("[:find ?e :where [?e :a _]]", [], "Placeholders in value position"),
        ("[:find ?v :where [_ :a ?v]]", [], "Placeholders in entity position"),
        ("[:find ?e :where [?e :a ?e]]", [], "Repeated variable ?e"),
        ("[:find ?e :where [?e :a ?v ?t]]", [], "Transaction positions"),
        ("[:find ?e :where [$x ?e :a ?v]]", [], "source variables"),
        ("[:find ?e :where [?e :a ?v] (not-join [?e] [?e :b 1])]", [], "explicit not-join"),
        ("[:find ?e :where [?e :a ?v] (or-join [?e] [?e :b 1])]", [], "explicit or-join"),
        ("[:find ?e :where [(type ?e :db.type/long)]]", [], "type annotations"),
        ("[:find ?e :where [1 :a 2]]", [], "no groundable variables"),
        ("[:find ?e :where [?e :a ?v] (not [?e :b ?w])]", [], "Variable ?w in NOT clause is not bound by positive clauses"),
        ("[:find ?e :where [?e :a ?v] [(< 1 2)]]", [], "must reference at least one variable"),
        ("[:find ?e :where [?e :a ?v] [(< ?w 2)]]", [], "Predicate variable ?w is not bound"),
        ("[:find ?e :where [?e :a ?v] [(frob ?v 2)]]", [], "Unsupported function 'frob' with 2 args"),
        ("[:find ?e :where [?e :a ?v] [(- ?v) ?w]]", [], "Unsupported function '-' with 1 args"),
        ("[:find ?e :where [?e :a ?v] [(+ ?y 1) ?x] [(+ ?v 1) ?y]]", [], "must precede output variable ?x"),
        ("[:find ?e :where [?e :a ?v] (or [?e :b 1] [?v :b 1])]", [], "OR branch 2 has different free variables"),
        ("[:find ?e :where [?e :a ?v] (or [?e :b 1] (and [?e :b 2] [(< ?v 3)]))]", [], "OR branch 2 mentions different variables"),
        ("[:find (sum (+ ?v 1)) :where [?e :a ?v]]", [], "Nested expressions are not supported as arguments to aggregate 'sum'"),
        ("[:find (median ?v) :where [?e :a ?v]]", [], "Unknown aggregate function: median"),
        ("[:find (count ?z) :where [?e :a ?v]]", [], "Aggregate variable ?z in (count ?z) is not bound"),
        ("[:find ?e . :where [?e :a ?v]]", [], "Only FindRel"),
        ("[:find ?e :where [?e :a ?v] :order [?v]]", [], "ORDER BY variable ?v is not in the :find clause"),
        ("[:find ?e :in ?x :where [?e :a ?x]]", [], ":in clause declares 1 binding(s) but 0"),
        ("[:find ?e :in ?x :where [?e :a ?x]]", [[1]], "Scalar binding ?x expects a Scalar argument"),
        ("[:find ?e :in [?x ...] :where [?e :a ?x]]", [1], "expects a Collection argument"),
        ("[:find ?e :in [?x ?y] :where [?e :a ?x]]", [[1, 2]], "Tuple and relation bindings are not yet supported"),
        ("[:find ?e :where [?e :a ?x] :limit ?n]", [], "Variable limit ?n is not bound as a scalar"),
        ("[:find ?e :in ?n :where [?e :a ?x] :limit ?n]", [-1], "Limit must be non-negative, got -1"),
        ("[:find ?e :in ?n :where [?e :a ?x] :limit ?n]", ["a"], "must be bound to a Long"),
        ("[:find ?e :where [?e :a ?v] [(regexp_like ?v ?e)]]", [], "requires a string literal"),
        ('[:find ?e :where [?e :a ?v] [(regexp_like ?v "(")]]', [], "invalid regex pattern"),
        ('[:find ?e :where [?e :a ?v] [(regexp_like ?v "a") ?w]]', [], "regexp_like is a predicate, not a binding function"),
        ("[:find ?e :where [?e :a ?v] [(+ ?v 1) [?w ?z]]]", [], "Only scalar binding supported"),
    ],
)
def test_refused(text, args, message):
    with pytest.raises(QueryError) as e:
        validate(parse(text), args)
    assert message in str(e.value)


@pytest.mark.parametrize(
    "text",
    ["[:find ?e :where [?e :a 1]]", '[:find ?e (sum ?v) :in ?x [?y ...] [[?z _]] [?q ?w] :with ?e :where [?e :a ?v] [(+ ?v 1.5) ?k] (or [?e :b "s"] (and [?e :b ?x] (not [?e :c :k/w]))) :order [?e :desc] :limit 3]',
     "[:find ?e . :where [?e :a 12N] [_ :b ?e]]", "[:find [?e ...] :where (not-join [?e] [?e :a _ ?t]) (or-join [?e] [?e :b true])]", "[:find (pull ?e [* :a :as :b]) (the ?x) :where (rule ?e ?x 3) [(type ?x :db.type/long)] :limit ?n]",
     '[:find [?e ?t] :where [?e :a #inst "2020-01-01T00:00:00Z"] [?e :u #uuid "550e8400-e29b-41d4-a716-446655440000"] [$s ?e :a ?t]]'],
)
def test_text_comes_back(text):
    from eavspark.plans.text import text as write

    assert parse(write(parse(text))) == parse(text)
