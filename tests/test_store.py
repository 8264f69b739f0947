"""The fact store: what its plans exchange, how many tables it keeps, and what heat adds up to."""

import math
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import graphs
import naive
from conftest import key_of, rows
from triplewright import Settings, Workspace, materialize
from triplewright import vocab as v
from triplewright.operators import rules
from triplewright.plans import materialize as plan
from triplewright.plans import store as module
from triplewright.plans.axioms import select_axioms
from triplewright.plans.heat import Heat
from triplewright.plans.rulebook import compile_rules
from triplewright.plans.store import AS_WRITTEN, FactStore, distinct_facts
from triplewright.plans.workspace import SHUFFLE_CLEANUP, SHUFFLE_PARTITIONS, session_values

LARGE = Settings(broadcast_rows=0)


def facts_of(spark, first, last, prop="p"):
    return spark.range(first, last).selectExpr("'<s' || id || '>' as s", f"'<{prop}>' as p", "'<o' || id % 7 || '>' as o",
                                               "false as property_done", "id % 2 = 0 as class_done")


def spo(df):
    return rows(df.select("s", "p", "o"))


@pytest.mark.parametrize("settings", [Settings(), LARGE], ids=["small", "large"])
def test_rounds(spark, settings):
    """Repeated and known candidates are left out, and each part reads back what was added."""
    store = FactStore(Workspace(spark), settings, 100)
    every = facts_of(spark, 0, 100)
    assert store.start(every.unionByName(every)) == 100 and store.older() is None and store.derived().isEmpty()
    assert store.add(facts_of(spark, 90, 130).unionByName(facts_of(spark, 95, 120))) == 30
    assert store.add(facts_of(spark, 0, 140)) == 10
    assert spo(store.newest.df) == spo(facts_of(spark, 130, 140))
    assert spo(store.older()) == spo(facts_of(spark, 0, 130))
    assert spo(store.derived()) == spo(facts_of(spark, 100, 140)) and spo(store.since(2)) == spo(store.newest.df)
    assert store.add(facts_of(spark, 5, 125)) == 0
    assert store.counts == [100, 30, 10, 0] and store.total == 140
    assert spo(store.known()) == spo(facts_of(spark, 0, 140))
    assert spo(store.derived()) == spo(facts_of(spark, 100, 140))


def test_done_by_any_rule_is_done(spark):
    store = FactStore(Workspace(spark), Settings(), 1)
    store.start(facts_of(spark, 0, 1))
    store.add(facts_of(spark, 1, 3).unionByName(facts_of(spark, 1, 3).withColumn("property_done", F.lit(True))))
    assert [(r.property_done, r.class_done) for r in store.newest.df.orderBy("s").collect()] == [(True, False), (True, True)]


def test_known_facts_are_not_exchanged_in_a_large_round(spark):
    """One exchange, that of the candidates, and sorts of nothing else; one file for each bucket."""
    store = FactStore(Workspace(spark), Settings(broadcast_rows=0, merge_fanout=10), 1)
    store.start(facts_of(spark, 0, 5000))
    assert store.kinds[0].open == 5000
    for n in range(1, 4):
        store.add(facts_of(spark, 4000 * n, 4000 * n + 3000))
    auto = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": str(store.buckets)}
    with session_values(spark, auto | AS_WRITTEN):
        fresh = store.unknown(distinct_facts(facts_of(spark, 3000, 20_000)))
        assert fresh.count() == 17_000 - 2000 - 3 * 3000 + 1000
        plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert len(store.tables()) == 4
    assert plan.count("Bucketed: true") == 4 and plan.count("SortMergeJoin") == 4
    assert plan.count("Exchange hashpartitioning") == 1
    # What is below each scan's join is the scan and its filter only.
    assert not re.search(r"(Sort|Exchange)[^\n]*\n[^\n]*(Filter[^\n]*\n[^\n]*)?FileScan", plan)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("triplewright")]


def test_a_long_tail_leaves_few_tables(spark):
    """After every round the tables are logarithmic in the rounds, and hold the same rows."""
    store = FactStore(Workspace(spark), Settings(), 1)
    store.start(facts_of(spark, 0, 1000))
    most = 0
    for n in range(1, 24):
        assert store.add(facts_of(spark, 990 + 10 * n, 1000 + 10 * n)) == 10
        most = max(most, len(store.tables()))
    fanout = Settings().merge_fanout
    assert most <= 2 + fanout * math.ceil(math.log(24, fanout))
    assert spo(store.known()) == spo(facts_of(spark, 0, 1230))
    assert spo(store.since(20)) == spo(facts_of(spark, 1190, 1230))


def test_sizes_decide_what_is_merged(spark):
    """Large tables stay where they are while small rounds follow; 200 equal rounds give a logarithmic number."""
    class Sizes(FactStore):
        def __init__(self):
            self.settings, self.levels, self.written = Settings(), [], 0
            self.workspace = type("", (), {"drop": lambda self, name: None})()

        def _measured(self, both):
            return 0, True

        def _write(self, both, last, bucketed=True, merging=False):
            self.written += both
            return module.Level("", both, both, bucketed, last)

    store, union = Sizes(), module._all
    module._all = lambda levels: sum(level.rows for level in levels)
    try:
        store.levels = [module.Level("", 1_000_000, 1_000_000, True, 1)]
        for n in range(2, 202):
            store.levels.append(module.Level("", 10, 10, False, n))
            store._merge()
            assert len(store.levels) <= 1 + 4 * math.ceil(math.log(n, 4))
    finally:
        module._all = union
    assert store.levels[0].rows == 1_000_000 and sum(level.rows for level in store.levels[1:]) == 2000
    assert store.written <= 2000 * 2 * math.log2(200)


def chain_of_classes(n):
    """u p x, x type C0, and C(i+1) some(Ci) on q(i), with u q(i) u: one round for each class."""
    parts = ["x type C0", "u q0 x"]
    for i in range(n):
        parts += [f"C{i + 1} some C{i}", f"C{i + 1} onProperty q{i}"]
        if i:
            parts.append(f"u{i + 1} q{i} u{i if i > 1 else ''}")
    return graphs.graph(";".join(parts), "chain")


def test_a_chain_of_many_rounds(spark):
    triples = chain_of_classes(7)
    result = materialize(spark.createDataFrame(triples, "s string, p string, o string"))
    instances, types, _ = naive.infer(triples)
    assert rows(result.new_types) == sorted(types) and rows(result.new_instances) == sorted(instances)
    assert len(result.rounds) >= 7 and len(result.facts.tables()) <= 2 + 4 * 2


# Heat


HUB = """T type Transitive"""


def hub(spark, first, last):
    """Members of a hub that a transitive property has on both sides."""
    into = spark.range(first, last).selectExpr("'<a' || id || '>' as s", "'<g:T>' as p", "'<hub>' as o")
    out = spark.range(first, last).selectExpr("'<hub>' as s", "'<g:T>' as p", "'<b' || id || '>' as o")
    rest = spark.range(first, last).selectExpr("'<c' || id || '>' as s", "'<g:T>' as p", "'<d' || id || '>' as o")
    flags = [F.lit(False).alias("property_done"), F.lit(False).alias("class_done")]
    return into.unionByName(out).unionByName(rest).select("s", "p", "o", *flags)


def test_a_hub_that_grows_by_small_rounds(spark):
    """No round is large, but all together are, and the cells grow with the hub."""
    ws, settings = Workspace(spark), Settings(pairs_per_task=1_000_000, cell_rows=2000)
    df = spark.createDataFrame(graphs.graph(HUB, "g"), "s string, p string, o string")
    book = compile_rules(ws, ws.save(select_axioms(df), "axioms"), settings)
    store, heat = FactStore(ws, settings, 1), Heat(ws, settings)
    store.start(hub(spark, 0, 100))
    heat.add(store, book)
    assert heat.of("transitive") == ({}, {}) and heat.counted == -1
    cells, key = [], key_of(spark, "<hub>")
    for n in range(5):
        store.add(hub(spark, 100 + 700 * n, 800 + 700 * n))
        heat.add(store, book)
        left, right = heat.of("transitive")
        assert set(left) | set(right) <= {key}
        cells.append(left.get(key, 1) * right.get(key, 1))
    assert heat.counts["transitive left"].get(key) == 3600 == heat.counts["transitive right"].get(key)
    assert cells == sorted(cells) and cells[-1] >= 13 and heat.counted == store.last


def test_heat_of_subject_and_property(spark):
    """A subject with many values of one property is hot in that property alone."""
    ws, settings = Workspace(spark), Settings(pairs_per_task=500, cell_rows=100)
    schema = graphs.graph("R all A; R onProperty p; Q all B; Q onProperty p; R all C; W all A; W onProperty q", "g")
    df = spark.createDataFrame(schema, "s string, p string, o string")
    book = compile_rules(ws, ws.save(select_axioms(df), "axioms"), settings)
    flags = ["false as property_done", "false as class_done"]
    held = spark.range(400).selectExpr("'<u>' as s", "'<g:p>' as p", "'<v' || id || '>' as o", *flags).unionByName(
        spark.range(20).selectExpr("'<u>' as s", "'<g:q>' as p", "'<v' || id || '>' as o", *flags))
    types = spark.createDataFrame([("<u>", v.TYPE, f"<g:{c}>", False, False) for c in "RQW"], held.schema)
    store, heat = FactStore(ws, settings, 1), Heat(ws, settings)
    store.start(held.unionByName(types))
    heat.add(store, book)
    left, right = heat.of("all")
    key = key_of(spark, "<u>", "<g:p>")
    assert set(left) == {key} and left[key] >= 2 and not right


# Joins of facts with facts


def some_input(spark, n=3000):
    triples = spark.range(n).selectExpr("'<u' || id || '>' as s", "'<p' || id % 5 || '>' as p", "'<x' || id % 50 || '>' as o")
    types = spark.range(50).selectExpr("'<x' || id || '>' as s", f"'{v.TYPE}' as p", "'<c' || id % 10 || '>' as o")
    table = spark.range(10).selectExpr("'<p' || id % 5 || '>' as k1", "'<c' || id || '>' as k2", "'<v' || id || '>' as ho")
    return triples, types, table


def test_triples_and_types_are_joined_once(spark):
    """With rule rows that cannot be broadcast, what met is written once and looked at there."""
    triples, types, table = some_input(spark)
    ws, settings, saved = Workspace(spark), Settings(broadcast_rows=0, pairs_per_task=0, hot_share=0.02), []

    def save(df):
        saved.append(ws.save(df, ws.unique("met")))
        return saved[-1]

    found = rules.some_values(triples, types, table, False, settings, save=save)
    assert len(saved) == 1
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Range" in plan and plan.count("FileScan") + plan.count("Relation") >= 1
    assert plan.count("Join Inner") == 1  # with the rule rows; the join of the facts is done
    small = rules.some_values(triples, types, table, True, Settings())
    assert rows(found.distinct()) == rows(small.distinct())


def test_a_bloom_filter_cuts_the_triples(spark):
    """The planner's run-time filter on the typed instances, once its thresholds are met."""
    triples, types, table = some_input(spark, 30_000)
    ws = Workspace(spark)
    triples, types, table = (ws.save(df, name) for df, name in ((triples, "triples"), (types, "types"), (table, "table")))
    low = {"spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
           "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1",
           "spark.sql.autoBroadcastJoinThreshold": "-1"}
    with session_values(spark, low):
        few = types.where("o = '<c3>'")
        found = rules.some_values(triples, few, table, True, Settings())
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "might_contain" in plan and "bloom_filter_agg" in plan
        assert found.count() == 30_000 * 5 // 50


def sizes_on_disk(folder):
    return {p.name.split("-")[0] for p in Path(folder).iterdir()}


def test_large_steps_get_partitions_by_their_rows(spark, monkeypatch):
    """Compiling and rounds shuffle into as many partitions as the rows ask for, and the session keeps its own number."""
    seen = {}

    def noted(name, function):
        def call(*args, **kwargs):
            seen[name] = {k: spark.conf.get(k) for k in (SHUFFLE_PARTITIONS, SHUFFLE_CLEANUP)}
            return function(*args, **kwargs)
        monkeypatch.setattr(plan, name, call)

    for name in ("compile_rules", "_apply", "sameas_classes"):
        noted(name, getattr(plan, name))
    triples = [t for i in range(4) for t in graphs.random_graph(i, f"g{i}")]
    before = spark.conf.get(SHUFFLE_PARTITIONS)
    result = materialize(spark.createDataFrame(triples, "s string, p string, o string"), Settings(bucket_rows=10))
    result.metrics()
    width = -(-len(triples) // 10)
    assert width > int(before) and result.facts.buckets == width
    assert seen["_apply"] == seen["sameas_classes"] == {SHUFFLE_PARTITIONS: str(width), SHUFFLE_CLEANUP: "true"}
    assert int(seen["compile_rules"][SHUFFLE_PARTITIONS]) == max(int(before), -(-4 * result.axioms.count() // 10))
    assert spark.conf.get(SHUFFLE_PARTITIONS) == before


def test_the_staged_copy_goes_when_its_rows_are_written(spark):
    triples = [("<a>", "<p>", "<b>"), ("<p>", v.DOMAIN, "<C>"), ("<x>", "<y>", "<z>")]
    given = spark.createDataFrame(triples, "s string, p string, o string")
    result = materialize(given, stage=True)
    names = sizes_on_disk(result.workspace.root)
    assert "facts" in names and "input" not in names
    assert rows(result.asserted) == sorted(triples)
    assert rows(result.new_types) == [("<a>", "<C>")] and result.input_triples == 3


def test_default_buckets_hold_what_a_task_can_sort(spark):
    """A round brings a few candidates for each known fact, and they are added up and sorted in one task each."""
    store = FactStore(Workspace(spark), Settings(), 586_000_000)
    assert 586_000_000 / store.buckets <= 500_000
