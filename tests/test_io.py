"""Ingest, sinks, workspace and the command-line job."""

import pytest
from pyspark.sql import functions as F

from conftest import rows
from triplewright import Workspace, job, materialize
from triplewright import vocab as v
from triplewright.functions import terms
from triplewright.plans import workspace
from triplewright.plans.axioms import select_axioms
from triplewright.sources.ntriples import parse_lines, read_triples, reject_lines, stage_lines
from triplewright.sources.sinks import to_lines, write_result

LINES = [
    ("<a> <p> <b> .", ("<a>", "<p>", "<b>")),
    ("_:x <p> _:y .", ("_:x", "<p>", "_:y")),
    ('<a> <p> "v" .', ("<a>", "<p>", '"v"')),
    ('<a> <p> "v"@en .', ("<a>", "<p>", '"v"@en')),
    ('<a> <p> "v"@en-GB.', ("<a>", "<p>", '"v"@en-GB')),
    ('<a> <p> "5"^^<xsd:int> .', ("<a>", "<p>", '"5"^^<xsd:int>')),
    ('<a> <p> "say \\"hi\\"" .', ("<a>", "<p>", '"say \\"hi\\""')),
    ('<a> <p> "" .', ("<a>", "<p>", '""')),
    ('<a> <p> "dot . and <x> # in" . # note', ("<a>", "<p>", '"dot . and <x> # in"')),
    ("<a>\t<p>\t<b> .", ("<a>", "<p>", "<b>")),
    ("  <a> <p> <b>", ("<a>", "<p>", "<b>")),
    ("<a><p><b>.", ("<a>", "<p>", "<b>")),
    ("<a> <p> _:y.", ("<a>", "<p>", "_:y")),
    ("<a><p>_:y.", ("<a>", "<p>", "_:y")),
    ("_:a.b <p> _:a.b.", ("_:a.b", "<p>", "_:a.b")),
    ("_:a..b <p> _:y .# note", ("_:a..b", "<p>", "_:y")),
]
SKIPPED = ["", "   ", "# comment", "  # <a> <p> <b> ."]
REJECTED = ["hello", "<a> <p>", "<a> <p> plain .", '<a> <p> "open', "<a> <p> <b> <c> .", '"x" <p> <b> .', "<a> _:p <b> ."]


def frame(spark, values):
    return spark.createDataFrame([(x,) for x in values], "value string")


def test_lines(spark):
    df = frame(spark, [line for line, _ in LINES] + SKIPPED + REJECTED)
    assert rows(parse_lines(df).select("s", "p", "o")) == sorted(t for _, t in LINES)
    rejects = reject_lines(df)
    assert sorted(r.value for r in rejects.collect()) == sorted(REJECTED)
    reasons = {r.value: r.reason for r in rejects.collect()}
    assert reasons["hello"] == "no subject" and reasons["<a> _:p <b> ."] == "no predicate"


@pytest.mark.parametrize("lexical", [False, True])
def test_text_is_read_once(spark, lexical):
    """Triples and rejects come from one pass over the lines, and are those of two separate ones."""
    given = [line for line, _ in LINES] + SKIPPED + REJECTED
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    lines = frame(spark, given).repartition(3)
    triples, rejects = stage_lines(lines.mapInArrow(counted, "value string"), Workspace(spark), lexical)
    assert rows(triples) == rows(parse_lines(lines, lexical).select("s", "p", "o"))
    assert rows(rejects) == rows(reject_lines(lines))
    assert triples.count() == len(LINES) and rejects.count() == len(REJECTED)
    assert seen.value == len(given)


def test_stage_of_one_part_only(spark):
    for given, sizes in ((["<a> <p> <b> ."], (1, 0)), (["nothing"], (0, 1)), ([], (0, 0))):
        assert tuple(df.count() for df in stage_lines(frame(spark, given), Workspace(spark))) == sizes


def test_lexical_only(spark):
    df = frame(spark, ['<a> <p> "5" .', '<a> <p> "5"@en .', '<a> <p> "5"^^<t> .', "<a> <p> <b> ."])
    assert {r.o for r in parse_lines(df, lexical_only=True).collect()} == {'"5"', "<b>"}
    assert parse_lines(df).distinct().count() == 4


def test_long_literals(spark):
    text = spark.range(1).select(F.repeat(F.lit('word \\ "quoted" \n'), 200_000).alias("text"))
    line = text.select(F.concat(F.lit("<a> <p> "), terms.literal(F.col("text")), F.lit(" .")).alias("value"))
    expected = text.select(F.length(terms.literal(F.col("text")))).first()[0]
    assert parse_lines(line).select(F.length("o")).first()[0] == expected


def test_write_and_read_back(spark, tmp_path):
    triples = [("<a>", "<p>", '"5"'), ("<p>", v.RANGE, "<C>"), ("<q>", v.INVERSE_OF, "<p>"), ("<x>", v.SAME_AS, "<y>"),
               ("<A>", v.SUBCLASS_OF, "<B>"), ("<B>", v.SUBCLASS_OF, "<D>")]
    result = materialize(spark.createDataFrame(triples, "s string, p string, o string"))
    write_result(result, f"{tmp_path}/text", schema=True, sameas="pairs")
    read = {n: rows(read_triples(spark, f"{tmp_path}/text/new_{n}")[0].select("s", "p", "o"))
            for n in ("instances", "types", "sameas", "schema")}
    assert read["instances"] == [] and read["types"] == []  # only generalised rows, with a literal subject
    assert read["sameas"] == [("<y>", v.SAME_AS, "<x>")]
    assert read["schema"] == [("<A>", v.SUBCLASS_OF, "<D>")]
    write_result(result, f"{tmp_path}/table", fmt="parquet")
    assert rows(spark.read.parquet(f"{tmp_path}/table/new_types")) == [('"5"', v.TYPE, "<C>")]
    assert to_lines(result.new_instances, generalized=True).count() == 1


def test_job(spark, tmp_path):
    source = tmp_path / "in.nt"
    source.write_text(f"<u> <p> <x> .\n<p> {v.DOMAIN} <C> .\nbroken\n# note\n")
    job.run(spark, [str(source), f"{tmp_path}/out", "--rejects", f"{tmp_path}/bad"])
    assert spark.read.text(f"{tmp_path}/out/new_types").first().value == f"<u> {v.TYPE} <C> ."
    assert spark.read.text(f"{tmp_path}/out/new_sameas").count() == 0
    assert spark.read.parquet(f"{tmp_path}/bad").first().value == "broken"
    report = dict(rows(spark.read.parquet(f"{tmp_path}/out/run_report")))
    assert report.pop("seconds") >= 0
    assert report["input_triples"] == 2 and report["rejected_lines"] == 1 and report["rounds"] == 2
    assert report["round_1"] == report["new_types"] == report["new_types_written"] == 1 and report["round_2"] == 0
    table = tmp_path / "table"
    spark.createDataFrame([("<u>", "<p>", "<x>"), ("<p>", v.RANGE, "<C>")], "s string, p string, o string").write.parquet(str(table))
    job.run(spark, [str(table), f"{tmp_path}/out2", "--from", "parquet", "--format", "parquet"])
    assert rows(spark.read.parquet(f"{tmp_path}/out2/new_types")) == [("<x>", v.TYPE, "<C>")]


def test_metrics(spark):
    triples = [("<A>", v.EQUIVALENT_CLASS, "<B>"), ("<B>", v.SUBCLASS_OF, "<C>"), ("<C>", v.SUBCLASS_OF, "<B>"),
               ("<u>", v.TYPE, "<A>"), ("<a>", v.SAME_AS, "<b>")]
    result = materialize(spark.createDataFrame(triples, "s string, p string, o string"))
    assert dict(rows(result.metrics())) == {
        "input_triples": 5, "input_types": 1, "new_subclasses": 4, "new_equivalent_classes": 4,
        "new_subproperties": 0, "new_equivalent_properties": 0, "new_instances": 0, "new_types": 2,
        "new_sameas_pairs": 1, "largest_sameas_class": 2,
    }
    assert rows(result.round_rows()) == [(1, "instance", 0), (1, "sameas", 0), (1, "type", 2), (2, "instance", 0),
                                         (2, "sameas", 0), (2, "type", 0)]
    assert ("<A>", "<C>") in rows(result.equivalent_classes) and ("<A>", "<B>") not in rows(result.equivalent_classes)


def test_workspace_uses_the_checkpoint_folder(spark, monkeypatch):
    assert Workspace(spark).root.startswith(spark.conf.get("spark.checkpoint.dir"))

    class Cluster:
        class conf:
            @staticmethod
            def get(key, default=None):
                return {"spark.master": "yarn"}.get(key, default)

        class sparkContext:
            @staticmethod
            def getCheckpointDir():
                return None

    with pytest.raises(ValueError):
        workspace.shared_folder(Cluster)


def test_axioms_are_pushed_to_the_scan(spark, tmp_path):
    spark.createDataFrame([("<a>", v.DOMAIN, "<b>")], "s string, p string, o string").write.parquet(f"{tmp_path}/t")
    plan = select_axioms(spark.read.parquet(f"{tmp_path}/t"))._jdf.queryExecution().toString()
    pushed = plan[plan.index("PushedFilters"):]
    assert v.DOMAIN in pushed[:pushed.index("\n")] or "In(p" in pushed[:pushed.index("\n")]


def test_long_blank_node(spark):
    label = "_:" + "a.b" * 100_000
    assert parse_lines(frame(spark, [f"<a> <p> {label}."])).first().o == label


def test_links_of_literals_and_bad_predicates_at_the_sink(spark, tmp_path):
    triples = [("<f>", v.TYPE, v.FUNCTIONAL), ("<x>", "<f>", "<a>"), ("<x>", "<f>", '"x"'), ("<x>", "<f>", '"y"'),
               ("<z>", "<f>", '"u"'), ("<z>", "<f>", '"v"'), ("<p>", v.SUBPROPERTY_OF, "_:b"), ("<x>", "<p>", "<y>"),
               ("<a>", v.SAME_AS, '"x"')]
    result = materialize(spark.createDataFrame(triples, "s string, p string, o string"))
    assert rows(result.new_sameas) == [('"v"', '"u"'), ('"x"', "<a>"), ('"y"', "<a>")]
    counts = write_result(result, f"{tmp_path}/out")
    assert rows(read_triples(spark, f"{tmp_path}/out/new_sameas")[0]) == [("<a>", v.SAME_AS, '"y"')]
    assert rows(read_triples(spark, f"{tmp_path}/out/new_*")[1]) == []
    assert counts == {"new_instances": (0, 1), "new_types": (0, 0), "new_sameas": (1, 1)}
