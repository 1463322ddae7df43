import os

import pytest

from regionframe.model import Dataset
from regionframe.sources import readers, writers
from regionframe.sources.repository import Repository
from regionframe.sources.schema import parse

SCHEMA = """<?xml version="1.0"?><c name="ann"><s type="{kind}" coordinate_system="{system}">{fields}</s></c>"""
TAB = "".join(f'<field type="{t}">{n}</field>' for n, t in (("CHR", "STRING"), ("START", "LONG"), ("STOP", "LONG"), ("STR", "CHAR"), ("name", "STRING"), ("score", "FLOAT")))


def put(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    (folder / name).write_text(text)


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "ann"
    put(d, "schema.xml", SCHEMA.format(kind="tab", system="default", fields=TAB))
    put(d, "one.bed", "#comment\nchr1\t5096\t5451\t+\tgeneC\t0.765\nchr1\t10\t20\t.\tnull\t.\nbroken line\nchr2\tx\t5\t+\ta\t1\n")
    put(d, "one.bed.meta", "cell\thela-s3\ncell\tK562\nbad line\n")
    put(d, "two.bed", "chr2\t7\t9\t-\tgeneA\tNULL\n")
    put(d, "two.bed.meta", "cell\th1\n")
    put(d, "stray.bed", "chr9\t1\t2\t+\tx\t1\n")
    return d


def regions(ds):
    return sorted(tuple(r)[1:] for r in ds.regions.collect())


def test_folder_with_schema(spark, folder):
    ds = readers.read(spark, str(folder))
    assert sorted(regions(ds), key=repr) == sorted([("chr1", 5096, 5451, "+", "geneC", 0.765), ("chr1", 10, 20, "*", "null", None), ("chr2", 7, 9, "-", "geneA", None)], key=repr)
    assert sorted((r["attribute"], r["value"]) for r in ds.meta.collect()) == [("cell", "K562"), ("cell", "h1"), ("cell", "hela-s3")]
    assert ds.meta.select("sample_id").distinct().count() == 2


def test_strict_reading_fails(spark, folder):
    with pytest.raises(Exception, match="not a region"):
        readers.read(spark, str(folder), strict=True).regions.collect()


@pytest.mark.parametrize("name, line, want", [
    ("bed", "chr1\t1\t5\tn\t2\t-\t3\t4\t5\t6", ("chr1", 1, 5, "-", "n", 2.0, 3.0, 4.0, 5.0, 6.0)), ("narrowPeak", "chr1\t1\t5\tn\t2\t+\t3\t4\t5\t6", ("chr1", 1, 5, "+", "n", 2.0, 3.0, 4.0, 5.0, 6.0)),
    ("BroadPeaksParser", "chr1\t1\t5\tn\t2\t+\t3\t4\t5", ("chr1", 1, 5, "+", "n", 2.0, 3.0, 4.0, 5.0)), ("ann", "chr1\t1\t5\tn\t2\t+", ("chr1", 1, 5, "+", "n", 2.0)), ("basic", "chr1\t1\t5", ("chr1", 1, 5, "*")),
    ("rnaseq", "chr1\t1\t5\t+\tg\t.", ("chr1", 1, 5, "+", "g", None)), ("bedscore", "chr1\t1\t5\t0.5", ("chr1", 1, 5, "*", 0.5)), ("broadproj", "chr1\t1\t5\tn", ("chr1", 1, 5, "*", "n")),
])
def test_layouts(spark, tmp_path, name, line, want):
    put(tmp_path / "d", "f", line + "\n")
    ds = readers.read_file(spark, str(tmp_path / "d" / "f"), name)
    assert regions(ds) == [want]
    assert [r["attribute"] for r in ds.meta.collect()] == ["sampleID"]


def test_gtf_and_vcf(spark, tmp_path):
    fields = '<field type="STRING">source</field><field type="STRING">gene_id</field><field type="INTEGER">level</field>'
    gtf = readers.parser_of(parse(SCHEMA.format(kind="gtf", system="default", fields=fields)))
    put(tmp_path / "d", "g", 'chr1\thavana\tgene\t11\t20\t.\t-\t.\tGENE_ID "x1"; level "3"; other "z";\n')
    ds = readers.read_file(spark, str(tmp_path / "d" / "g"), gtf)
    assert ds.attributes == ["source", "feature", "score", "frame", "gene_id", "level"]
    assert regions(ds) == [("chr1", 10, 20, "-", "havana", "gene", None, ".", "x1", 3.0)]
    vcf = readers.parser_of(parse(SCHEMA.format(kind="vcf", system="default", fields='<field type="STRING">id</field><field type="STRING">ref</field>')))
    put(tmp_path / "d", "v", "chr1\t100\trs1\tA\n")
    assert regions(readers.read_file(spark, str(tmp_path / "d" / "v"), vcf)) == [("chr1", 99, 100, "*", "rs1", "A")]


def small(spark):
    rows = [(1, "chr1", 5, 9, "+", 0.123456789, "a"), (1, "chr1", 1, 2, "*", None, None), (2, "chr2", 0, 4, "-", 2.0, "b")]
    meta = [(1, "cell", "x"), (1, "cell", "y"), (2, "cell", "z")]
    return Dataset.of(spark.createDataFrame(rows, "sample_id long, chrom string, left long, right long, strand string, score double, `left.name` string"), spark.createDataFrame(meta, "sample_id long, attribute string, value string"))


@pytest.mark.parametrize("kind, system", [("tab", "default"), ("tab", "1-based"), ("gtf", "default"), ("gtf", "0-based")])
def test_text_round_trip(spark, tmp_path, kind, system):
    ds = small(spark)
    path = f"{tmp_path}/out"
    writers.write_text(ds, path, kind, system)
    back = writers.read_text(spark, path)
    got = sorted(((r["sample_id"], r["chrom"], r["left"], r["right"], r["strand"], r["score"]) for r in back.regions.collect()), key=repr)
    want = [(1, "chr1", 5, 9, "+", 0.12345678), (1, "chr1", 1, 2, "*", None), (2, "chr2", 0, 4, "-", 2.0)]
    assert got == sorted(want, key=repr)
    assert sorted(map(tuple, back.meta.collect())) == sorted(map(tuple, ds.meta.collect()))


def test_repository(spark, tmp_path):
    r = Repository(spark, f"{tmp_path}/repo")
    assert r.list() == []
    r.create("d1", small(spark), {"by": "me"})
    assert r.list() == ["d1"] and r.info("d1") == {"by": "me"} and r.schema("d1") == [("score", "double"), ("left.name", "string")]
    with pytest.raises(ValueError, match="exists"):
        r.create("d1", small(spark))
    other = small(spark)
    from pyspark.sql import functions as F

    r.add_samples("d1", Dataset(other.regions.withColumn("sample_id", F.col("sample_id") + 10), other.meta.withColumn("sample_id", F.col("sample_id") + 10)))
    assert sorted(x["sample_id"] for x in r.samples("d1").collect()) == [1, 2, 11, 12]
    r.delete_sample("d1", 11)
    assert sorted(x["sample_id"] for x in r.samples("d1").collect()) == [1, 2, 12]
    r.rename("d1", "d2")
    assert r.load("d2").regions.count() == 4 and r.profile("d2").count() == 4
    r.delete("d2")
    assert r.list() == []
    with pytest.raises(ValueError, match="no dataset"):
        r.load("d2")


def test_profile_file(spark, tmp_path):
    writers.write_profile(small(spark), str(tmp_path))
    text = (tmp_path / "profile.xml").read_text()
    assert text.count("<sample ") == 2 and '<feature name="regions">3</feature>' in text


def test_take_and_collect(spark):
    ds = small(spark)
    assert ds.take(1).regions.count() == 2 and ds.take_first(1).regions.count() == 1
    regions_it, meta_it = ds.collect_iterator()
    assert len(list(regions_it)) == 3 and len(list(meta_it)) == 3


def test_stream(spark, tmp_path):
    from regionframe.streaming.regions import map_stream, read_stream

    put(tmp_path / "in", "s1", "chr1\t4\t6\n")
    seen = []
    q = map_stream(read_stream(spark, str(tmp_path / "in"), "basic"), small(spark), lambda ds, k: seen.extend(ds.regions.collect()), f"{tmp_path}/check", count_name="n")
    q.awaitTermination()
    assert sorted(r["n"] for r in seen) == [0.0, 1.0]


def test_cli(spark, tmp_path):
    from regionframe import cli

    Repository(spark, f"{tmp_path}/data").create("D", small(spark))
    put(tmp_path, "s.txt", "A = SELECT(region: score > 1) D;\nMATERIALIZE A INTO kept;\n")
    assert cli.main([str(tmp_path / "s.txt"), "--data", f"{tmp_path}/data", "--out", f"{tmp_path}/out"]) == 0
    assert readers.read_parquet(spark, f"{tmp_path}/out/kept").regions.count() == 1


def test_only_chosen_samples_are_opened(spark, folder):
    put(folder, "we[i r]+d%20.bed", "chr3\t1\t2\t+\tx\t5\n")
    put(folder, "we[i r]+d%20.bed.meta", "cell\th7\n")
    ds = readers.read(spark, str(folder))
    opened = lambda x: sorted(f.rsplit("/", 1)[1] for f in x.regions.inputFiles() if not f.endswith((".meta", ".xml")))
    one = ds.select(("cmp", "cell", "==", "K562"))
    assert opened(one) == ["one.bed"] and len(opened(ds)) > 1
    assert sorted(regions(one), key=repr) == sorted([("chr1", 5096, 5451, "+", "geneC", 0.765), ("chr1", 10, 20, "*", "null", None)], key=repr)
    weird = ds.select(("cmp", "cell", "==", "h7"), ("cmp", ("field", "score"), ">", 1))
    assert regions(weird) == [("chr3", 1, 2, "+", "x", 5.0)] and weird.meta.count() == 1
    assert regions(ds.select(("cmp", "cell", "==", "none"))) == []
    other = ds.select(("cmp", "cell", "==", "h1"))
    assert opened(ds.select(semijoin=(["cell"], other, False))) == ["two.bed"]
    # the choice holds the same rows as a scan of everything
    both = ("or", ("cmp", "cell", "==", "h1"), ("cmp", "cell", "==", "h7"))
    from dataclasses import replace

    assert sorted(ds.select(both).regions.collect(), key=repr) == sorted(replace(ds, opened=None).select(both).regions.collect(), key=repr)


def test_written_text_is_read_as_a_folder(spark, folder, tmp_path):
    ds = readers.read(spark, str(folder))
    for kind in ("tab", "gtf"):
        writers.write_text(ds, f"{tmp_path}/{kind}", kind)
        back = readers.read(spark, f"{tmp_path}/{kind}")
        assert sorted(r[1:4] for r in map(tuple, back.regions.collect())) == sorted(r[1:4] for r in map(tuple, ds.regions.collect()))
        assert sorted(map(tuple, back.meta.collect())) == sorted(map(tuple, ds.meta.collect()))
        assert back.select(("cmp", "cell", "==", "h1")).regions.count() == 1
    put(tmp_path / "bare", "x.bed", "chr1\t1\t2\n")
    with pytest.raises(ValueError, match="no .meta file"):
        readers.read(spark, f"{tmp_path}/bare", "basic")
