"""Physical plans of a round: what is broadcast, what is pushed down, and that no join is a cross join."""

import pytest

import graphs
from triplewright import Settings, Workspace
from triplewright.plans import materialize as m
from triplewright.plans.axioms import select_axioms
from triplewright.plans.heat import Heat
from triplewright.plans.rulebook import compile_rules
from triplewright.plans.store import FactStore
from triplewright.plans.workspace import session_values

GRAPH = """A sub B; p subProp q; q domain A; t type Transitive; V some B; V onProperty p; R all A; R onProperty p;
H hasValue w; H onProperty q; x p y; y type A; a t b; b t c; x type R; z q w; other o1 o2"""


def round_plans(spark, settings):
    df = spark.createDataFrame(graphs.graph(GRAPH, "g"), "s string, p string, o string")
    ws = Workspace(spark)
    book = compile_rules(ws, ws.save(select_axioms(df), "axioms"), settings)
    facts = FactStore(ws, settings, df.count())
    facts.start(m._relevant(df, book))
    frames = m._apply(book, facts, Heat(ws, settings), settings)
    return book, facts, [f._jdf.queryExecution().toString() for f in frames]


@pytest.mark.parametrize("settings", [Settings(), Settings(broadcast_rows=0)], ids=["small", "large"])
def test_round(spark, settings):
    with session_values(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.maxMetadataStringLength": "9999"}):
        book, facts, plans = round_plans(spark, settings)
    assert set(book.small) == {"property", "class", "value", "transitive", "some", "all"}
    assert len(plans) == 6
    for number, plan in enumerate(plans):
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
        # Rule tables and newest facts are broadcast only while they were measured small.
        assert ("BroadcastHashJoin" in plan) == (settings.broadcast_rows > 0)
        assert ("SortMergeJoin" in plan) == (settings.broadcast_rows == 0)
        # Whether types or triples are read reaches the scan, and so do the predicates.
        # The rows that someValuesFrom met are written first where its rule rows are many.
        assert "In(p, " in plan or "EqualTo(p," in plan or (number == 4 and settings.broadcast_rows == 0)
    assert "In(p, " in plans[0] or "EqualTo(p," in plans[0]
    # Schema rows and the row no rule can touch are not copied: of the eight rows that are not axioms' own
    # predicates, the untouched one goes, and "t type Transitive" too where the classes in use are known.
    assert facts.known().where("p = '<g:o1>'").isEmpty()
    assert facts.counts == [6 if book.classes is not None else 7]


def test_a_class_with_many_consequences_is_not_repeated(spark):
    """40 properties with one domain of 60 superclasses: 40 + 60 rule rows instead of 40 x 60, and the same facts."""
    triples = graphs.graph(";".join(
        [f"p{i} domain D; x{i} p{i} y{i}" for i in range(40)] + [f"D sub C{i}" for i in range(60)]
        + ["V hasValue w; V onProperty q; C0 sub V", "z q w", "W hasValue u; W onProperty r; D sub W"]), "g")
    df, books, found = spark.createDataFrame(triples, "s string, p string, o string"), [], []
    for settings in (Settings(), Settings(compose_rows=100)):
        result = m.materialize(df, settings)
        books.append(result.book.counts)
        found.append((sorted(map(tuple, result.new_types.collect())), sorted(map(tuple, result.new_instances.collect()))))
    assert found[0] == found[1] and len(found[0][0]) > 40 * 62
    assert books[0]["property"] > 40 * 62 and books[1]["property"] == 40
    assert books[1]["class"] == books[0]["class"]


def test_values_of_a_class_with_many_subclasses_stay_with_it(spark):
    triples = graphs.graph(";".join(
        [f"S{i} sub V; x{i} type S{i}" for i in range(50)] + [f"V hasValue w{i}" for i in range(5)] + ["V onProperty q"]), "g")
    df, found = spark.createDataFrame(triples, "s string, p string, o string"), []
    for settings, rows in ((Settings(), 50 + 50 * 5 + 5), (Settings(compose_rows=100), 50 + 5)):
        result = m.materialize(df, settings)
        assert result.book.counts["class"] == rows
        found.append(sorted(map(tuple, result.new_instances.collect())))
    assert found[0] == found[1] and len(found[0]) == 250


def test_rules_of_few_predicates_are_read_by_them_in_a_wide_schema(spark):
    """Of 12 predicates a filter takes 4: each rule that reads no more than that has its own list."""
    triples = graphs.graph(";".join(
        [f"p{i} subProp q; x{i} p{i} y{i}" for i in range(10)]
        + ["t type Transitive; a t b; b t c; i type InverseFunctional; m i k; n i k"]), "g")
    df = spark.createDataFrame(triples, "s string, p string, o string")
    result = m.materialize(df, Settings(filter_values=4))
    book = result.book
    assert book.reads == {"transitive": ["<g:t>"], "inverse_functional": ["<g:i>"]}
    for rule, name in (("transitive", "<g:t>"), ("inverse_functional", "<g:i>")):
        plan = book.read_by(rule, result.facts.known())._jdf.queryExecution().toString()
        assert f"EqualTo(p,{name})" in plan
    wide = m.materialize(df)
    for view in ("new_instances", "new_sameas"):
        assert sorted(getattr(result, view).collect()) == sorted(getattr(wide, view).collect()) != []


def test_heads_without_consequences_are_closed_and_the_last_round_joins_nothing(spark):
    """Types that some and all find and whose classes have no rows need no further round over the known facts."""
    triples = graphs.graph("V some B; V onProperty p; R all A; R onProperty p; x p y; y type B; x type R; A sub C; D sub E", "g")
    df = spark.createDataFrame(triples, "s string, p string, o string")
    asked, apply = [], m._apply
    m._apply = lambda *args: asked.append(apply(*args)) or asked[-1]
    try:
        result = m.materialize(df)
    finally:
        m._apply = apply
    found = {(r.s, r.cls) for r in result.new_types.collect()}
    assert found == {("<g:x>", "<g:V>"), ("<g:y>", "<g:A>"), ("<g:y>", "<g:C>")}
    closed = {(r.k1, r.k2): r.closed for r in result.book.table.where("rule in ('some', 'all')").collect()}
    assert closed == {("<g:p>", "<g:B>"): True, ("<g:R>", "<g:p>"): False}
    assert result.rounds == [2, 1, 0] and [len(frames) for frames in asked] == [3, 1, 0]
