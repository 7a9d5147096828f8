"""Documents as files: pruning, fallbacks, skipping, replacement and failing tasks."""

import os
import pickle

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In

from veridoc.sources import documents as D, files


def tree(root, names):
    for n in names:
        os.makedirs(os.path.dirname(f"{root}/{n}"), exist_ok=True)
        with open(f"{root}/{n}", "w") as f:
            f.write(n)


def test_reads_are_pruned(spark, tmp_path):
    tree(tmp_path, ["part000/a_prob.npy", "part001/b_prob.npy", "part001/sub/c_prob.npy", "part001/d.txt", "part1000/e_prob.npy", "other/f_prob.npy"])
    df = D.load_documents(spark, str(tmp_path), "*_prob.npy", "*.txt")
    assert {(r.part, r.stem, r.name, bytes(r.content).decode()) for r in df.collect()} == {(p, s, n, n) for p, s, n in [("part000", "a", "part000/a_prob.npy"), ("part001", "b", "part001/b_prob.npy"), ("part001", "c", "part001/sub/c_prob.npy"), ("part1000", "e", "part1000/e_prob.npy")]}
    assert [r.stem for r in df.where("part = 'part001' AND stem IN ('c', 'zz')").collect()] == ["c"]
    assert df.where("part IS NULL").count() == 0 and df.where("part = 'part007'").count() == 0
    r = D.DocumentReader({"path": str(tmp_path), "patterns": "*_prob.npy"})
    assert list(r.pushFilters([In(("part",), ("part001", "part009")), EqualTo(("stem",), "b")])) == []
    assert [p.found[0][1] for p in r.partitions()] == ["b"] and r.listed == ["part001"]
    assert list(D.DocumentReader({"path": str(tmp_path)}).pushFilters([EqualTo(("name",), "x")])) != []


def test_second_pattern_and_flat_folders(spark, tmp_path):
    tree(tmp_path, ["x/report.json", "y/report.json", "z.dtd.prob.npy", "z.txt"])
    stems = lambda *p: sorted(r.stem for r in D.load_documents(spark, str(tmp_path), *p).collect())
    assert stems("*_dtd_prob.npy", "*.dtd.prob.npy") == ["z"] and stems("*.txt", "*.npy") == ["z"]
    assert stems("*/report.json") == ["x", "y"] and stems("*.none") == []
    assert D.load_documents(spark, str(tmp_path / "absent"), "*").count() == 0
    with pytest.raises(ValueError):
        D.Pattern("report.json")


def test_writes_skip_replace_and_leave_nothing(spark, tmp_path):
    root = str(tmp_path / "out")
    text = lambda: {r.name: bytes(r.content).decode() for r in D.load_documents(spark, root, "*").collect()}
    rows = spark.range(20).repartition(4).select(F.format_string("part%03d/d%d.md", F.col("id") % 3, "id").alias("name"), F.concat(F.lit("one "), "id").alias("content"))
    D.write_documents(rows.where("name LIKE '%part000%'"), root)
    assert len(text()) == 7
    D.write_documents(rows.withColumn("content", F.lit("two")), root, "skip")
    assert sorted(set(text().values())) == sorted({f"one {i}" for i in range(0, 20, 3)} | {"two"}) and len(text()) == 20
    D.write_documents(rows.withColumn("content", F.lit("é3")), root)
    assert set(text().values()) == {"é3"}
    bad = rows.withColumn("content", F.when(F.col("name").endswith("d7.md"), F.raise_error(F.lit("lost")).cast("string")).otherwise("four"))
    with pytest.raises(Exception, match="lost"):
        D.write_documents(bad, root)
    assert set(text().values()) == {"é3"} and not [n for n in os.listdir(root) if n.startswith("_")]
    for name in ("../x", "/x", None, ""):
        with pytest.raises(Exception, match="not a name"):
            D.write_documents(spark.createDataFrame([(name, "x")], "name string, content string"), root)
    D.write_documents(rows.limit(0), str(tmp_path / "none"))
    D.write_documents(spark.createDataFrame([("e", None)], "name string, content string"), root)
    assert open(f"{root}/e").read() == ""


def test_the_driver_holds_no_names(spark, tmp_path):
    """what partitions and commits hold doesn't grow with the files; shares cover each file once."""
    names = {f"part{p:03d}/d{i}/x.md" for p in range(4) for i in range(30 if p else 400)}
    tree(tmp_path, names)
    for n in (0, 1):
        r = D.DocumentReader({"path": str(tmp_path), "filesPerTask": "50", "mostShares": "5"})
        parts = r.partitions()
        assert sorted(x for p in parts for _, x, _ in p.listed()) == sorted(f"{tmp_path}/{n}" for n in names if os.path.exists(f"{tmp_path}/{n}"))
        sized = len(pickle.dumps(parts))
        assert sized < 3000 and (n == 0 or sized == before), sized
        before = sized
        tree(tmp_path, more := {f"part000/e{i}/x.md" for i in range(300)})
        names |= more
    assert [p.parts for p in parts] == [["part000"]] * 5 + [["part001"], ["part002"], ["part003"]]
    assert D.Staged.__annotations__.keys() == {"folder"}
    D.write_documents(spark.range(3000).select(F.format_string("f%d/x.txt", "id").alias("name"), F.lit("v").alias("content")), str(tmp_path / "out"))
    assert D.load_documents(spark, str(tmp_path / "out"), "*/x.txt", filesPerTask="100").select("stem").distinct().count() == 3000


def test_records_in_any_shape(spark, tmp_path):
    """Read through the document source as Spark's JSON reader reads whole files."""
    texts = {"a/r.json": '{"k": 1, "s": "x"}', "part001/b/r.json": '[{"k": 2}, {"k": 3}]', "c/r.json": "{broken", "d/r.json": "", "e/r.json": '\ufeff{"k": 4, "s": {"t":1}}', "_h/r.json": '{"k": 5}', "f/r.json": '{"k": "no", "s": "y"}', "g/r.json": "[7"}
    for n, t in texts.items():
        os.makedirs(os.path.dirname(f"{tmp_path}/{n}"), exist_ok=True)
        with open(f"{tmp_path}/{n}", "w", encoding="utf-8") as f:
            f.write(t)
    got = files.load_records(spark, str(tmp_path), "k int, s string", "r.json")
    spark_reads = spark.read.schema("k int, s string").option("recursiveFileLookup", "true").option("pathGlobFilter", "*r.json").json(str(tmp_path), multiLine=True)
    key = lambda df: sorted((str(r.k), str(r.s)) for r in df.collect())
    assert key(got) == key(spark_reads)
    assert {r.part for r in got.where("k = 2").collect()} == {"part001"} and got.where("k = 1").first().path == f"file:{tmp_path}/a/r.json"
    assert sorted(r.name for r in files.listing(spark, str(tmp_path), "json").collect()) == ["r.json"] * 6


def test_snapshot_patterns(spark):
    paths = ["metadata.csv", "train/image/part001/a.jpg", "train/image/part002/a.jpg", "train/mask/part001/a.png", "test/image/a.jpg", ".gitattributes"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    kept = lambda **k: [r.path for r in df.where(D.in_snapshot("path", D.snapshot_patterns(**k))).collect()]
    assert kept(parts=[1], kinds=("image",)) == paths[:2]
    assert kept(metadata_only=True) == [paths[0], paths[5]]
    assert kept(split="test") == [paths[0], paths[4]] and kept() == paths[:4]


def test_commit_moves_new_folders_whole(tmp_path, monkeypatch):
    """None of their names is listed; a folder that is there gets its files one by one."""
    writer = D.DocumentWriter({"path": str(tmp_path)}, False)
    tree(tmp_path, ["old/x", "old/kept"])
    for task, names in (("0-0", ["new/x", "new/deep/y", "old/x", "top"]), ("1-1", ["new/z", "old/w"])):
        tree(tmp_path / writer.staging / task, names)
    walked, below = [], D.below
    monkeypatch.setattr(D, "below", lambda files, folder, *of: (walked.append(folder), below(files, folder, *of))[1])
    writer.commit([D.Staged(f"{tmp_path}/{writer.staging}/{t}") for t in ("0-0", "1-1")])
    assert {p.relative_to(tmp_path).as_posix() for p in tmp_path.rglob("*") if not p.is_dir()} == {"new/x", "new/deep/y", "new/z", "old/x", "old/kept", "old/w", "top"}
    assert [f for f in walked if "/0-0" in f] == [f"{tmp_path}/{writer.staging}/0-0/old"] and not os.path.exists(tmp_path / writer.staging)
