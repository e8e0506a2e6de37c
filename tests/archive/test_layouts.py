import pytest

from tests.archive.test_golden import delta, lists
from versograph import cli
from versograph.sources import layouts
from versograph.sources.store import Archive


def triple(x):
    return "<{}> <{}> <{}> .\n".format(*x)


def write(root, files):
    for name, content in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("".join(map(triple, content.split())) + "# a comment\n")


def bare(found):
    return {k.replace("<", "").replace(">", ""): v for k, v in found.items()}


def test_a_folder_for_each_version(spark, tmp_path, capsys):
    write(tmp_path / "in", {"0/x.nt.additions.txt": "aaa aab", "1/x.nt.additions.txt": "aac", "1/x.nt.deletions.txt": "aab", "10/y.nt.additions.txt": "aab", "10/other.txt": "zzz"})
    a = Archive.open(spark, str(tmp_path / "a"))
    assert layouts.populate(a, str(tmp_path / "in"), "versions") == [0, 1, 10]
    assert bare(lists(a.vq())) == {"aaa": list(range(11)), "aab": [0, 10], "aac": list(range(1, 11))}
    assert layouts.populate(a, str(tmp_path / "in"), "versions") == []
    assert cli.run(spark, ["populate", str(tmp_path / "b"), "-s", "interval", "2", "versions", str(tmp_path / "in")]) == 0
    rows = [x.split(",") for x in capsys.readouterr().out.split()]
    assert [r[:2] for r in rows[1:]] == [["0", "2"], ["1", "2"], ["10", "1"]] and all(int(r[3]) > 0 for r in rows[1:])
    assert cli.run(spark, ["table", str(tmp_path / "b")]) == 0
    assert capsys.readouterr().out.startswith("version,change_ratio,dynamicity")
    got = cli.evaluate(Archive.open(spark, str(tmp_path / "b")), ["<a> ? ?"], 1)
    assert {r["kind"] for r in got} == {"vm", "dm", "vq", "vm_count", "dm_count", "vq_count"}


@pytest.mark.parametrize("name", ["1.nt", "000001.nt"])
def test_a_first_version_and_changes(spark, tmp_path, name):
    write(tmp_path, {f"alldata.IC.nt/{name}": "aaa aab", "alldata.CB.nt/data-added_1-2.nt": "aac", "alldata.CB.nt/data-deleted_1-2.nt": "aab", "alldata.CB.nt/data-added_2-3.nt": "aab", "alldata.CB.nt/data-added_0-1.nt": "zzz"})
    a = Archive.open(spark, str(tmp_path / "a"))
    assert layouts.populate(a, str(tmp_path), "changes", last=2) == [0, 1, 2]
    assert bare(lists(a.vq())) == {"aaa": [0, 1, 2], "aab": [0, 2], "aac": [1, 2]}
    assert len(delta(a.dm(0, 2))) == 1


def test_missing_folders(spark, tmp_path):
    assert layouts.read_versions(spark, str(tmp_path)).count() == 0
    with pytest.raises(FileNotFoundError):
        layouts.read_changes(spark, str(tmp_path))
