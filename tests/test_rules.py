"""Each rule on a few triples with the exact rows it must give, all in one run per setting."""

import pytest

import graphs
import naive
from triplewright import Settings, materialize
from triplewright import vocab as v

# name -> (input, new triples and types, new sameAs pairs)
CASES = {
    "subproperty": ("p subProp q; x p y", "x q y", ""),
    "inverse_forward": ("p inverseOf q; x p y", "y q x", ""),
    "inverse_backward": ("p inverseOf q; u q v", "v p u", ""),
    "symmetric": ("p type Symmetric; x p y", "y p x", ""),
    "transitive_cycle": ("p type Transitive; a p b; b p c; c p a", "a p c; b p a; c p b", ""),
    "transitive_self_loops": ("p type Transitive; a p b; b p c; c p d; x p x; y p y",
                              "a p c; b p d; a p d", ""),
    "value_to_triple": ("V hasValue w; V onProperty p; u type V", "u p w", ""),
    "value_to_type": ("V hasValue w; V onProperty p; t p w", "t type V", ""),
    "some": ("V some W; V onProperty p; u p x; x type W", "u type V", ""),
    "some_with_two_properties": ("V some W; V onProperty p; V onProperty q; u q x; x type W", "u type V", ""),
    "all": ("V all W; V onProperty p; u type V; u p x", "x type W", ""),
    "all_needs_the_subject": ("V all W; V onProperty p; x type V; u p x", "", ""),
    "domain_range": ("p domain C; p range E; x p y", "x type C; y type E", ""),
    "subclass_of_asserted": ("A sub B; u type A", "u type B", ""),
    "subclass_chain": ("A sub B; B sub C; C equivClass D; u type A", "u type B; u type C; u type D", ""),
    "some_after_subproperty": ("q subProp p; V some W; V onProperty p; u q x; x type W", "u p x; u type V", ""),
    "rules_after_value": ("V hasValue w; V onProperty p; p subProp q; u type V", "u p w; u q w", ""),
    "domain_after_value": ("V hasValue w; V onProperty p; p domain C; u type V", "u p w; u type C", ""),
    "subproperty_of_type": ("p subProp type; A sub B; x p A", "x type A; x type B", ""),
    "subproperty_of_type_known": ("p subProp type; x p A; x type A", "", ""),
    "value_of_type": ("V hasValue C; V onProperty type; C sub D; u type V", "u type C; u type D", ""),
    "range_on_literal": ('p range C; x p "5"', '"5" type C', ""),
    "functional": ("f type Functional; x f a; x f b", "", "a b; b a"),
    "inverse_functional": ("g type InverseFunctional; a g k; b g k", "", "a b; b a"),
    "inverse_functional_objects": ("g type InverseFunctional; x g a; x g b", "", ""),
    "functional_after_subproperty": ("h subProp f; f type Functional; x f a; x h b", "x f b", "a b; b a"),
    "sameas_closure": ("a sameAs b; b sameAs c", "", "b a; c b; a c; c a"),
    "sameas_derived": ("p subProp sameAs; a p b", "", "a b; b a"),
    "no_loops": ("a sameAs a; A sub A; p subProp p; u type A; u p x", "", ""),
    "inverse_of_inverse": ("p inverseOf q; q inverseOf r; x p y", "y q x; x r y", ""),
    "inverse_domain": ("p inverseOf q; q domain C; C sub D; x p y", "y q x; y type C; y type D", ""),
    "symmetric_transitive": ("p type Symmetric; p type Transitive; a p b; b p c",
                             "b p a; c p b; a p c; c p a", ""),
    "value_chain": ("V hasValue w; V onProperty p; V sub U; U hasValue z; U onProperty q; t p w",
                    "t type V; t type U; t q z", ""),
    "type_chain_through_all": ("V all W; V onProperty p; W some X; W onProperty q; a type V; a p b; b q c; c type X",
                               "b type W", ""),
}

# The second setting forces shuffle joins, salting, and merging on every round.
FORCED = Settings(broadcast_rows=0, filter_values=0, hot_share=0.02, salts=3, pairs_per_task=3, cell_rows=4, rows_per_file=5, compose_rows=2, pair_block=2,
                  merge_fanout=2)
# The third keeps broadcasts but lists no predicate in a filter.
SEMI = Settings(filter_values=0)


RANDOM = [t for i in range(40) for t in graphs.random_graph(i, f"random{i}")]


@pytest.fixture(scope="module", params=[Settings(), FORCED], ids=["default", "forced"])
def outcome(spark, request):
    triples = [t for name, (text, _, _) in CASES.items() for t in graphs.graph(text, name)] + RANDOM
    given = triples + triples if request.param is FORCED else triples
    return triples, *run(spark, given, request.param)


def run(spark, triples, settings):
    """(new triples and types, new sameAs pairs, result) of a run."""
    result = materialize(spark.createDataFrame(triples, "s string, p string, o string").repartition(16), settings)
    new = [(r.s, r.p, r.o) for r in result.new_instances.collect()]
    new += [(r.s, v.TYPE, r.cls) for r in result.new_types.collect()]
    return sorted(new), sorted((r.x, r.y) for r in result.new_sameas_pairs.collect()), result


def expected(triples):
    instances, types, same = naive.infer(triples)
    return sorted(instances | {(s, v.TYPE, o) for s, o in types}), sorted(same)


@pytest.mark.parametrize("name", CASES)
def test_case(outcome, name):
    _, new, pairs, _ = outcome
    _, wanted, same = CASES[name]
    assert [t for t in new if f"<{name}:" in "".join(t)] == sorted(graphs.graph(wanted, name))
    wanted = sorted(tuple(graphs.term(w, name) for w in p.split()) for p in same.split(";") if p)
    assert [p for p in pairs if f"<{name}:" in "".join(p)] == wanted


def test_all_and_random_graphs(outcome):
    triples, new, pairs, result = outcome
    assert (new, pairs) == expected(triples)
    assert result.sameas_counts.first().new_pairs == len(pairs)


def test_links_close_to_the_pairs(outcome):
    triples, _, pairs, result = outcome
    stated = {(s, o) for s, p, o in triples if p == v.SAME_AS}
    links = {(r.x, r.y) for r in result.new_sameas.collect()} | stated
    assert sorted(naive.transitive(links | {(b, a) for a, b in links}) - stated) == pairs


def test_random_graphs_about_types(spark):
    triples = [t for i in range(6) for t in graphs.random_graph(100 + i, f"m{i}", meta=True)]
    new, pairs, result = run(spark, triples, SEMI)
    assert (new, pairs) == expected(triples)


def test_second_run_adds_nothing(spark):
    few = [t for i in range(40, 44) for t in graphs.random_graph(i, f"g{i}")]
    first = materialize(spark.createDataFrame(few, "s string, p string, o string"))
    again = materialize(first.asserted.union(first.derived.select("s", "p", "o")))
    assert sum(again.rounds) == 0
