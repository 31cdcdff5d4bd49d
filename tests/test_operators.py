import duckdb
import pytest
from pyspark.sql import functions as F

from glyphtrail.operators import catalog, evaluation, maintenance, metrics, selection, tracks
from glyphtrail.plans import queries
from glyphtrail.sources.corpus import Corpus
from glyphtrail.sources.files import html_report, read_manifest


def test_latest_completed_versions(spark):
    scans = spark.createDataFrame([(1, 1, "v", "completed"), (2, 2, "v", "failed"), (3, 2, "w", "completed"), (4, 3, "w", "completed")], "id long, scan_run_id long, video_id string, status string")
    assert sorted(r["id"] for r in selection.select_scans(scans).collect()) == [1, 4]
    with pytest.raises(ValueError):
        selection.select_scans(scans, scan_id=1, run_id=1)


def test_grids(spark):
    rows = spark.createDataFrame([(5.0, 0.0)], "duration double, start double")
    assert [tuple(r) for r in selection.chunk_grid(rows, "duration", 2.0).select("chunk_start_s", "chunk_end_s").collect()] == [(0.0, 2.0), (2.0, 4.0), (4.0, 5.0)]
    assert [r["sample_key"] for r in selection.sample_grid(rows, "start", "duration", 0.5).collect()] == ["0.000000000", "2.000000000", "4.000000000"]
    assert spark.range(1).select(selection.restart_offset(F.lit(0.0), F.lit(5.0), 3.0, 1.0)).first()[0] == 2.0


def test_admission(spark):
    rules = catalog.Admission(date_from="2024-01-01", min_duration=10, exclude="live")
    rows = spark.createDataFrame([("a", "20240101", 10.0), ("a", None, 1.0), ("a", "20231231", 99.0), ("a", "20250101", None), ("On LIVE", "20250101", 11.0)], "t string, d string, s double")
    assert [r[0] for r in rows.select(catalog.rejection(rules, F.col("t"), F.col("d"), F.col("s"))).collect()] == [None, "upload date unavailable", "before date_from", "duration unavailable", "title matches exclude"]


def test_upsert_and_append(spark):
    old, new = (spark.createDataFrame(r, "id long, v string, keep string") for r in ([(1, "a", "x"), (2, "b", "y")], [(2, "c", "z"), (3, "d", "w")]))
    got = {r["id"]: (r["v"], r["keep"]) for r in maintenance.upsert(old, new, "id", {"keep": F.col("o.keep")}).collect()}
    assert got == {1: ("a", "x"), 2: ("c", "y"), 3: ("d", "w")}
    assert maintenance.append_absent(old, new, ["id"]).count() == 3


def test_owned_paths(spark):
    good = "report/assets/" + "0" * 16 + "-" + "a" * 32 + "/12-row.png"
    rows = spark.createDataFrame([(good,), ("/" + good,), (good + "x",), ("report/assets/x/12-row.png",)], "p string")
    assert [r[0] for r in rows.select(maintenance.is_owned(F.col("p"))).collect()] == [True, False, False, False]


def test_sessions_aggregates_and_digests(spark):
    rows = spark.createDataFrame([("k", 0.0, "a", 0.5, 1), ("k", 3.0, "b", None, 2), ("k", 6.1, "a", 0.5, 3)], "k string, t double, x string, c double, i int")
    assert [r["session_no"] for r in tracks.gap_sessions(rows, ["k"], "t", 3.0).orderBy("t").collect()] == [0, 0, 1]
    r = tracks.track_aggregate(rows, ["k"], "t", "x", "c", "i").first()
    assert (r["support_count"], r["best_confidence"], r["canonical_text"], r["end_s"]) == (3, 0.5, "a", 6.1)
    assert tracks.ordered_distinct(rows, ["k"], ["t"], "x", "xs").first()["xs"] == ["a", "b"]
    assert metrics.grid_drift(rows, "k", "t", 1.0).count() == 2
    one, many = (metrics.grid_digest(rows.repartition(n), "k", "t").first()["digest"] for n in (1, 8))
    assert one == many


@pytest.fixture
def several_ranges(spark):
    """Few rows stay in several ranges, as many rows do."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_places_of_more_rows_than_a_range_samples(spark, several_ranges):
    rows = spark.range(40000).select((F.col("id") * 7919 % 40009).alias("key"), (F.col("id") % 7).alias("best"), F.col("id").cast("string").alias("text"))
    got = tracks.numbered(rows, [F.col("best").desc(), "key"], "place").select("best", "key", "text", "place").collect()
    want = sorted(((i % 7, i * 7919 % 40009, str(i)) for i in range(40000)), key=lambda r: (-r[0], r[1]))
    assert sorted(map(tuple, got), key=lambda r: r[3]) == [(*r, n) for n, r in enumerate(want, 1)]
    ties = tracks.numbered(rows.select(F.lit(1).alias("best"), "text"), ["best"], "place").collect()
    assert sorted(r["place"] for r in ties) == list(range(1, 40001)) and len({r["text"] for r in ties}) == 40000
    assert tracks.numbered(rows.filter("key < 0"), ["key"], "place").collect() == []


def test_hit_report_is_its_sql_on_many_rows(spark, several_ranges, tmp_path):
    tables = {
        "orders": "SELECT i AS o_orderkey, i * 31 % 1000 AS o_custkey, CASE WHEN i % 5 = 0 THEN 'O' ELSE 'F' END AS o_orderstatus, (i * 7919 % 20011) / 4.0 AS o_totalprice FROM range(50000) r(i)",
        "customer": "SELECT i AS c_custkey, 'c' || i AS c_name, (i % 25)::INT AS c_nationkey FROM range(990) r(i)",
        "nation": "SELECT i::INT AS n_nationkey, 'n' || i AS n_name, (i % 5)::INT AS n_regionkey FROM range(25) r(i)",
        "region": "SELECT i::INT AS r_regionkey, 'r' || i AS r_name FROM range(5) r(i)",
    }
    con = duckdb.connect()
    for name, sql in tables.items():
        con.execute(f"CREATE TABLE {name} AS {sql}")
        con.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet'")
    want = con.execute(queries.ORACLES["hit_report"]).fetchall()
    rows = queries.QUERIES["hit_report"](spark, str(tmp_path)).select("cluster_id", "c_custkey", "title", "best_score", "place").collect()
    assert sorted(map(tuple, rows)) == sorted(want)


def test_metrics_over_nothing_are_null(spark):
    rows = spark.createDataFrame([("g", 0.1)], "g string, s double")
    r = evaluation.threshold_metrics(rows, ["g"], "s", F.lit(False), (0.5,)).first()
    assert (r["precision"], r["recall"], r["tp"]) == (None, None, 0)


def test_corpus_versions(spark, tmp_path):
    corpus = Corpus(spark, str(tmp_path / "c"))
    assert corpus.read("videos").count() == 0
    row = spark.createDataFrame([("v", "scanned")], "id string, status string")
    assert corpus.commit({"videos": row}) == 1
    assert corpus.commit({"videos": row.union(row.withColumn("id", F.lit("w")))}) == 2
    assert (corpus.read("videos", 1).count(), corpus.read("videos").count()) == (1, 2)
    with pytest.raises(KeyError):
        corpus.get("videos", "id", "nope")
    with pytest.raises(Exception, match="videos.status"):
        corpus.commit({"videos": row.withColumn("status", F.lit("odd"))})
    assert corpus.versions() == [1, 2]


def test_manifest_and_report(spark, tmp_path):
    p = tmp_path / "m.jsonl"
    p.write_text('{"image":"a","source_id":"s","visible_names":["x"],"split":"test"}\n{"image":"b","source_id":"s","visible_names":[],"split":"dev"}\n')
    with pytest.raises(ValueError, match="split"):
        read_manifest(spark, str(p))
    page = html_report(spark.createDataFrame([("<b>",)], "t string"), ["t"], "x")
    assert "&lt;b&gt;" in page and "No hits" in html_report(spark.createDataFrame([], "t string"), ["t"], "x")
