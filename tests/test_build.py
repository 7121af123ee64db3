"""The composed build: skip report, order over datasets and files, stamp and pointer."""

import json

import pytest

from pyspark.sql import functions as F

from lexshape import constants as K
from lexshape.operators import catalog, schemes
from lexshape.plans import build, published
from lexshape.sources import ordering, sinks


def dataset(root, name, rows, licence="CC-BY-4.0", parts=1):
    d = root / name / "cldf"
    d.mkdir(parents=True)
    (d / "metadata.json").write_text(json.dumps({"rdf:ID": name, "dc:license": licence}))
    (d / "languages.csv").write_text("ID,Name,Glottocode,Family\na,A,aaaa1111,F\nb,B,bbbb2222,G\n")
    (d / "parameters.csv").write_text("ID,Name\nw,water\nm,moon\n")
    head, lines = "ID,Language_ID,Parameter_ID,Form,Segments\n", [f"{i},{lang},{p},{s.replace(' ', '')},{s}\n" for i, (lang, p, s) in enumerate(rows)]
    if parts == 1:
        (d / "forms.csv").write_text(head + "".join(lines))
    else:
        (d / "forms.csv").mkdir()
        size = -(-len(lines) // parts)
        for k in range(parts):
            (d / "forms.csv" / f"part-{k:05d}.csv").write_text(head + "".join(lines[k * size:(k + 1) * size]))


ROWS = [("a", "w", "m a"), ("a", "m", "m á"), ("b", "w", "k u"), ("b", "m", "t a k"), ("a", "w", "t i"), ("b", "w", "m a")] + [("b", "m", f"{c} a") for c in "ptkbdg"]


def content(catalog):
    forms = sorted(map(str, catalog.forms.drop("seq").collect()))
    return forms, sorted(map(str, catalog.languages.collect())), sorted(map(str, catalog.excluded.collect()))


def test_a_build_does_not_depend_on_how_files_are_split(spark, tmp_path):
    for parts, root in ((1, tmp_path / "one"), (4, tmp_path / "four")):
        dataset(root, "first", ROWS, parts=parts)
        dataset(root, "second", ROWS[::-1], parts=parts)
    one, four = (build.build_catalog(spark, str(tmp_path / r)) for r in ("one", "four"))
    assert content(one) == content(four)
    ma = {r.glottocode: r.sources for r in one.forms.where("shape = 'ma'").collect()}
    assert ma == {"aaaa1111": ["first", "second"], "bbbb2222": ["first", "second"]}


def test_blocked_lists_are_reported_and_the_build_is_stamped(spark, tmp_path, monkeypatch):
    dataset(tmp_path / "in", "open", ROWS)
    dataset(tmp_path / "in", "shut", ROWS, licence="CC-BY-ND-4.0")
    built = build.build_catalog(spark, str(tmp_path / "in"))
    assert {(r.dataset, r.entries, r.reason is None) for r in built.report.collect()} == {("open", len(ROWS), True), ("shut", 0, False)}
    build.publish(built, str(tmp_path / "out"), "v7", buckets=3)
    assert build.published(spark, str(tmp_path / "out"), "forms").count() == built.forms.count()
    assert build.published(spark, str(tmp_path / "out"), "build").collect()[0][:] == ("v7", K.SCHEME_VERSION)
    monkeypatch.setattr(K, "SCHEME_VERSION", "other")
    with pytest.raises(ValueError, match="scheme"):
        build.published(spark, str(tmp_path / "out"), "forms")
    dataset(tmp_path / "none", "shut", ROWS, licence="CC-BY-ND-4.0")
    with pytest.raises(ValueError, match="no cleared"):
        build.build_catalog(spark, str(tmp_path / "none"))


def test_rows_are_numbered_in_file_order(spark, tmp_path):
    for k, n in ((0, 3), (1, 5000), (2, 1)):
        (tmp_path / f"part-{k}.txt").write_text("".join(f"{k}-{i:05d}\n" for i in range(n)))
    got = [r.value for r in ordering.with_file_order(spark.read.text(str(tmp_path)), "seq", "value").orderBy("seq").collect()]
    assert got == sorted(got) and len(got) == 5004


def test_a_second_scheme_stamps_its_keys_and_mixed_reads_are_refused(spark, tmp_path):
    rows = [("a", "w", "m aː"), ("a", "m", "m a"), ("b", "w", "t a t a"), ("b", "m", "k u"), ("b", "w", "p p a")]
    dataset(tmp_path / "in", "open", rows)
    plain, short = (build.build_catalog(spark, str(tmp_path / "in"), scheme=s) for s in (schemes.TONE_BLIND, schemes.LENGTH_BLIND))
    assert {r.shape for r in plain.forms.collect()} > {"maː"} and {r["shape"] for r in short.forms.collect()} == {"ma", "ku", "pa"}
    build.publish(short, str(tmp_path / "out"), "v1", buckets=3)
    assert build.published(spark, str(tmp_path / "out"), "forms", scheme="length-blind-1").count() == short.forms.count()
    with pytest.raises(ValueError, match="scheme"):
        build.published(spark, str(tmp_path / "out"), "forms")
    words = spark.createDataFrame([("maː", False), ("ma", False), ("ma", False), ("ppa", False)], "ipa string, segmented boolean")
    changes = schemes.key_changes(words, schemes.TONE_BLIND, schemes.LENGTH_BLIND)
    assert {tuple(r) for r in changes.collect()} == {("maː", "ma", 1), ("ma", "ma", 2), ("ppa", "pa", 1)}
    assert {tuple(r) for r in schemes.merged_keys(changes).collect()} == {("ma", 2)}


def test_of_two_racing_publishers_one_is_refused_and_readers_always_find_a_version(spark, tmp_path):
    log = str(tmp_path / "log")
    with pytest.raises(ValueError, match="nothing is published"):
        sinks.current_version(spark, log)
    seen = sinks.publish_version(spark, log, "v1", "b/v1")
    assert sinks.publish_version(spark, log, "v2", "b/v2", after=seen) == 2
    with pytest.raises(sinks.VersionTaken):
        sinks.publish_version(spark, log, "v2-too", "b/other", after=seen)
    assert sinks.current_version(spark, log)["version"] == "v2"
    (tmp_path / "log" / "0000000003.json").write_text("")          # a publisher that has not written yet
    assert sinks.current_version(spark, log)["version"] == "v2"
    with pytest.raises(sinks.VersionTaken):
        sinks.publish_version(spark, log, "v3", "b/v3")


def test_sweep_removes_vanished_keys_and_leaves_other_files(spark, tmp_path):
    path = f"{tmp_path}/t"
    table = spark.range(400).selectExpr("concat('k', id % 40) AS key", "id")
    sinks.write_partitioned(table, path, "key", buckets=16)
    where = {r["key"]: r["bucket"] for r in sinks.manifest(spark, path).collect()}
    gone = {k for k, b in where.items() if b in (where["k1"], where["k2"])} | {"k3"}
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "t").glob("bucket=*/*.parquet")}
    left = table.where(~F.col("key").isin(*gone))
    assert sinks.sweep_stale(spark, path, left) == len(gone)
    assert sorted(map(tuple, spark.read.parquet(path).select("key", "id").collect())) == sorted(map(tuple, left.collect()))
    assert {r["key"] for r in sinks.manifest(spark, path).collect()} == set(where) - gone
    assert not (tmp_path / "t" / f"bucket={where['k1']}").exists()
    changed = {f"bucket={where[k]}" for k in gone}
    kept = {f for f in before if f.parent.name not in changed}
    assert kept and all(f.exists() and f.stat().st_mtime_ns == before[f] for f in kept)
    assert sinks.sweep_stale(spark, path, left) == 0


def test_published_tables_of_one_key_join_without_a_shuffle(spark, tmp_path):
    entries = spark.createDataFrame([(f"l{k % 12}", f"{c}{v}", f"sense {k % 5}") for k, (c, v) in enumerate((c, v) for c in "ptkmns" for v in "aiu")],
                                    "glottocode string, ipa string, gloss string").selectExpr(
        "*", "false AS segmented", "cast(null AS string) AS exclude", "'s' AS source", "cast(null AS bigint) AS concepticon_id", "cast(null AS string) AS concepticon_gloss",
        "cast(null AS string) AS linked_by", "monotonically_increasing_id() AS seq")
    sources = spark.createDataFrame([("s", "human", "CC-BY-4.0", "dictionary")], "id string, tier string, license string, kind string")
    languages = spark.createDataFrame([(f"l{k}", f"f{k}") for k in range(12)], "glottocode string, family string")
    tables = published.publish_concepts(catalog.judge_entries(entries, sources), languages, "lexshape_test", str(tmp_path / "db"), 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joins = (tables["bands"].join(tables["labels"], "ckey"), tables["postings"].join(tables["shapes"], "shape"))
        for joined in joins:
            assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert tables["postings"].join(tables["shapes"], "shape").count() == tables["postings"].count() > 0
    assert tables.heatmap().count() > 0 and tables.rank_shapes().count() == tables["shapes"].count()
    spark.sql("DROP DATABASE lexshape_test CASCADE")
