import pytest

from tests.archive.test_golden import F2, F7, F8, delta, lists, log, rows, triples
from versograph import cli
from versograph.functions import terms
from versograph.operators import lookup
from versograph.operators import query as q
from versograph.operators.log import intervals
from versograph.plans import strategy
from versograph.sources import ntriples
from versograph.sources.store import Archive
from versograph.streaming import builder


def fill(archive, text):
    for v in sorted({r[0] for r in rows(text)}):
        b = archive.new_patch(v)
        for _, s, p, o, op in (r for r in rows(text) if r[0] == v):
            b.triple(s, p, o, op == 1)
        assert b.commit()
    return archive


def test_archive_equals_intervals(spark, tmp_path):
    a = fill(Archive.open(spark, str(tmp_path / "a"), strategy.interval(3)), F8)
    p = intervals(log(spark, F8))
    assert a.snapshots() == [0, 3, 6] and a.max_version() == 7
    for v in (-1, 2, 3, 7, 9):
        assert sorted(triples(a.vm(v))) == sorted(triples(q.vm(p, v)))
    assert sorted(triples(a.vm_hybrid(5))) == sorted(triples(q.vm(p, 5)))
    assert lists(a.vq()) == lists(q.vq(p, 7))
    assert sorted(delta(a.dm(1, 6))) == sorted(delta(a.dm(1, 6, plain_diff=True))) == sorted(delta(q.dm(p, 1, 6)))
    assert a.vm_count(7, estimate=True) == (a.vm(7).count(), "EXACT") and a.dm_count(2, 1) == (0, "EXACT")
    again = Archive.open(spark, str(tmp_path / "a"), read_only=True)
    assert lists(again.vq()) == lists(a.vq()) and again.version_meta().count() == 8
    with pytest.raises(PermissionError):
        again.new_patch().addition("x", "y", "z").commit()
    for v in (2, 5, 7):
        assert a.vm_count(v, ("a", None, None), estimate=True) == (a.vm(v, ("a", None, None)).count(), "EXACT")
    n, kind = a.vq_count(estimate=True)
    assert kind == "UP_TO" and n >= a.vq().count()
    a.cleanup()
    assert Archive.open(spark, str(tmp_path / "a")).max_version() == -1


def test_two_appends_to_one_version_and_uniqueness(spark, tmp_path):
    a = Archive.open(spark, str(tmp_path / "a"))
    a.new_patch(0).addition("g", "p", "o").addition("s", "z", "o").commit()
    a.new_patch(1).deletion("g", "p", "o").addition("a", "p", "o").commit()
    assert not a.new_patch(1).deletion("a", "p", "o").commit(check_uniqueness=True)
    assert sorted(triples(a.vm(1))) == ["apo", "szo"]
    a.new_patch(1).addition("g", "p", "o").deletion("a", "p", "o").deletion("n", "n", "n").commit()
    assert sorted(triples(a.vm(1))) == ["gpo", "szo"] and delta(a.dm(0, 1)) == []
    assert lists(a.vq()) == {"gpo": [0, 1], "szo": [0, 1]}
    with pytest.raises(ValueError):
        a.new_patch(0).addition("x", "x", "x").commit()


def test_skipped_versions_carry_on(spark, tmp_path):
    a = fill(Archive.open(spark, str(tmp_path / "a")), F2)
    assert sorted(triples(a.vm(3))) == ["hpo", "lao", "sao"] and sorted(triples(a.vm(4))) == ["lao", "sao"]
    assert lists(a.vq(("h", "p", "o"))) == {"hpo": [0, 1, 2, 3, 5, 6]}


def test_progress_and_lookups(spark, tmp_path):
    seen = []
    a = Archive.open(spark, str(tmp_path / "a"), progress=lambda section, percent: seen.append((section, percent)))
    fill(a, F2)
    assert seen[:4] == [("open triples", 0), ("change set", 40), ("manifest", 80), ("done", 100)]
    patch = spark.createDataFrame([("a", "a", "a", 1), ("a", "a", "b", -1), ("b", "a", "a", 1)], "s string, p string, o string, op int")
    at = lambda df: df.head()["position"]
    assert at(lookup.position_of(patch, ("a", "a", "b", 1))) == 2 and at(lookup.position_of(patch, ("a", "a", "b", 1), strict=True)) == -1
    assert at(lookup.position_of_pattern(patch, ("b", "a", "a", 1), "po")) == 1 and at(lookup.position_of_pattern(patch, ("b", "a", "a", 1), "s")) == 0
    assert at(lookup.index_of_triple(patch, ("b", "a", "a"))) == 2 and at(lookup.index_of_triple(patch, ("c", "a", "a"))) == -1
    with pytest.raises(IndexError):
        lookup.element_at(patch, 3)
    with pytest.raises(ValueError):
        lookup.folded_delta(a.log(), [0, 3], 0, 2)


def test_terms_by_ids_and_shown_patches(spark):
    t = spark.createDataFrame([("a", "b", "c"), ("c", "b", "a")], "s string, p string, o string")
    ids = terms.dictionary(t)
    coded = terms.encode(t, ids)
    assert sorted(map(tuple, coded.select("s", "p", "o").collect())) == [(1, 2, 3), (3, 2, 1)]
    assert sorted(map(tuple, terms.decode(coded, ids).select("s", "p", "o").collect())) == [("a", "b", "c"), ("c", "b", "a")]
    shown = ntriples.show_patch(t.selectExpr("s", "p", "o", "1 AS op", "s = 'a' AS local")).collect()
    assert sorted(r.line for r in shown) == ["a b c. (+) L", "c b a. (+)"]


def test_first_version_takes_no_deletions(spark, tmp_path):
    a = Archive.open(spark, str(tmp_path / "a"))
    one = spark.createDataFrame([("a", "b", "c")], "s string, p string, o string")
    assert not a.ingest(0, one, one) and a.ingest(0, one) and a.ingest(1, None, one)
    assert a.vm(1).count() == 0


def test_ntriples_and_command_line(spark, tmp_path, capsys):
    (tmp_path / "add.nt").write_text('# comment\n\n<a> <b> "x \\"y\\" z"@en .\n<a> <b> <c>. # end\n_:n <b> "1"^^<t> .\nnot a triple\n')
    (tmp_path / "del.nt").write_text("<a> <b> <c> .\n")
    raw = spark.read.text(str(tmp_path / "add.nt"))
    assert {tuple(r) for r in ntriples.parse(raw).collect()} == {("<a>", "<b>", '"x \\"y\\" z"@en'), ("<a>", "<b>", "<c>"), ("_:n", "<b>", '"1"^^<t>')}
    assert [r.value for r in ntriples.malformed(raw).collect()] == ["not a triple"]
    path = str(tmp_path / "store")
    assert cli.run(spark, ["insert", path, "-s", "interval", "5", "0", str(tmp_path / "add.nt")]) == 0
    assert cli.run(spark, ["insert", path, "1", "-", str(tmp_path / "del.nt")]) == 0
    capsys.readouterr()
    assert cli.run(spark, ["vm", path, "1", "<a>", "?", "?"]) == 0
    assert capsys.readouterr().out == '<a> <b> "x \\"y\\" z"@en.\n'
    cli.run(spark, ["dm", path, "0", "1", "?", "?", "?"])
    assert capsys.readouterr().out == "- <a> <b> <c>.\n"
    cli.run(spark, ["vq", path, "_:n", "?", "?"])
    assert capsys.readouterr().out == '_:n <b> "1"^^<t>. :: [ 0 1 ]\n'
    cli.run(spark, ["statistics", path, "growth_ratio", "0", "1"])
    assert float(capsys.readouterr().out) == pytest.approx(2 / 3)
    m, offset, limit = cli.parse_query('<a> ?p "x y" 3 -2')
    assert m.bound() == {"s": "<a>", "o": '"x y"'} and (offset, limit) == (3, None)


def test_stream_of_changes(spark, tmp_path):
    a = Archive.open(spark, str(tmp_path / "a"))
    schema, source = "s string, p string, o string, op int, seq int", tmp_path / "in"
    for k, part in enumerate(F7.split()):
        data = [(s, p, o, op, i) for i, (_, s, p, o, op) in enumerate(rows(part))]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").json(str(source))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
        builder.start(stream, a, str(tmp_path / "checkpoint"), first=0).awaitTermination()
        assert a.max_version() == k
    assert lists(a.vq()) == lists(q.vq(intervals(log(spark, F7)), 3))
    before = lists(a.vq())
    builder.stream_writer(a, 0)(spark.createDataFrame([("a", "a", "d", 1, 0)], schema), 2)  # an old batch again
    builder.stream_writer(a, 0)(spark.createDataFrame(data, schema), 3)  # the last batch again
    assert lists(a.vq()) == before


def test_strategies():
    c = strategy.Chain(0, 100)
    c.add(1, 10, 5, 5, 100)
    c.add(2, 10, 9, 9, 100)
    c.add(3, 20, 20, 15, 900)
    assert [strategy.interval(3)(c), strategy.interval(2)(c), strategy.never()(c), strategy.always()(c)] == [True, False, False, True]
    assert strategy.size(2.0)(c) and not strategy.size(3.0)(c) and strategy.size2(0.3)(c) and strategy.time(3.0)(c)
    assert strategy.change(0.29)(c) and not strategy.change(0.3)(c)
    assert strategy.aggchange(0.5)(c) and not strategy.aggchange(1.5)(c)
    assert strategy.parse("and_interval-size2", "3-0.3")(c) and not strategy.parse("and_interval-size2", "2-0.3")(c)
    assert strategy.parse("or_interval-size2", "2-0.3")(c) and strategy.parse("interval", "3")(c)
    assert strategy.parse("and_interval-size2") is None and strategy.parse("and_interval-size2", "3") is None and strategy.parse("nothing") is None


@pytest.mark.parametrize("step", ["_put", "_manifest", "_clean"])
def test_a_write_that_fails_leaves_the_archive(spark, tmp_path, step, monkeypatch):
    def fail(*args):
        raise OSError("lost")

    path = str(tmp_path / "a")
    fill(Archive.open(spark, path, strategy.interval(2)), F2)
    a = Archive.open(spark, path, strategy.interval(2))
    before, last = lists(a.vq()), a.max_version()
    done = step == "_clean"
    for version, op in ((last, 1), (last + 1, -1)):  # an append to the last version again, and to a new one
        monkeypatch.setattr(Archive, step, fail)
        with pytest.raises(OSError, match="lost"):
            a.new_patch(version).triple("l", "a", "o", op == 1).addition("n", "n", str(version)).commit()
        monkeypatch.undo()
        for seen in (a, Archive.open(spark, path)):
            assert seen.max_version() == (version if done else last)
            assert {k: v for k, v in lists(seen.vq()).items() if k[0] != "n"} == before or done
            assert ("nn" + str(version) in lists(seen.vq())) == done
    a = Archive.open(spark, path, strategy.interval(2))
    a.new_patch(last + 2).addition("z", "z", "z").commit()  # what the failed write of last + 1 left isn't seen
    assert lists(a.vq())["zzz"] == [last + 2]
    assert sorted(triples(a.vm(last + 2))) == sorted(triples(a.vm_hybrid(last + 2)))
    if not done:
        assert a.log().where(f"version = {last + 1}").isEmpty()
        assert {k: [x for x in v if x <= last] for k, v in lists(a.vq()).items() if k != "zzz"} == before


def test_an_append_rewrites_its_buckets_only(spark, tmp_path):
    a = Archive.open(spark, str(tmp_path / "a"), buckets=8)
    many = spark.range(500).selectExpr("concat('s', id) AS s", "concat('p', id % 3) AS p", "concat('o', id % 7) AS o")
    assert a.ingest(0, many)
    gens = list(a.buckets)
    assert gens == [0] * 8
    a.new_patch(1).deletion("s7", "p1", "o0").addition("s7", "p1", "x").commit()
    assert sum(g != 0 for g in a.buckets) == 1 and a.vm(1).count() == 500
    rows = a.vm(1, ("s7", None, None))
    assert [tuple(r) for r in rows.collect()] == [("s7", "p1", "x")]
    plan = rows._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters" in plan and "EqualTo(s,s7)" in plan
    assert len(a._open(("s7", None, None)).inputFiles()) <= len(a._open().inputFiles())
    scans = [x for x in plan.splitlines() if "PartitionFilters" in x]
    assert any("bucket" in x for x in scans) and any("v_to" in x for x in scans)
    again = Archive.open(spark, str(tmp_path / "a"), buckets=3)
    assert len(again.buckets) == 8 and again.vm(0).count() == 500


def test_row_groups_tell_which_objects_they_lack(spark, tmp_path):
    a = Archive.open(spark, str(tmp_path / "a"), buckets=1)
    many = spark.range(150000).selectExpr("concat('s', id % 1000) AS s", "'p' AS p", "md5(string(id)) AS o")
    assert a.ingest(0, many)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    opened = jvm.org.apache.parquet.hadoop.ParquetFileReader.open
    for f in a._open().inputFiles() + a.log().inputFiles() + a.snapshot(0).inputFiles():
        reader = opened(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(f), conf))
        columns = {c.getPath().toDotString(): c for b in reader.getFooter().getBlocks() for c in b.getColumns()}
        assert columns["o"].getBloomFilterOffset() > 0
        reader.close()
    assert a.size() < 3 * 150000 * 40
    some = many.where("s = 's7'").head()
    assert [tuple(r) for r in a.vm(0, (None, None, some["o"])).collect()] == [tuple(some)] and a.vm(0, (None, None, "none")).isEmpty()
