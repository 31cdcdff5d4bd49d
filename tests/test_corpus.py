import random

import pytest
from pyspark.sql import functions as F

from glyphtrail import cli
from glyphtrail import settings as st
from glyphtrail.functions.text import pieces, window_scores
from glyphtrail.operators import detection, maintenance, matching, reports, selection
from glyphtrail.plans import corpus as plans
from glyphtrail.sources.corpus import SCHEMAS, Corpus


def rows(spark, name, *values):
    fields = SCHEMAS[name]
    return spark.createDataFrame([tuple(v.get(f.name) for f in fields) for v in values], fields)


def evidence(video, scan, no, kind="row.png"):
    return f"report/assets/{video * 16}-{scan * 32}/{no}-{kind}"


@pytest.fixture
def corpus(spark, tmp_path):
    """Two sources with a scan each in one shared run, and a run of its own for a second scan of the first."""
    c = Corpus(spark, str(tmp_path / "corpus"))
    texts = {1: (1, 0.0, "Player One"), 2: (1, 1.0, "playerone"), 3: (2, 5.0, "someone else"), 4: (3, 0.0, "PlayerOne"), 5: (1, 2.0, "plaxer one")}
    scan_of = {1: 10, 2: 10, 3: 20}
    c.commit({
        "videos": rows(spark, "videos", *[{"id": v, "source_url": f"https://x/{v}", "title": v, "status": "scanned"} for v in ("a", "b")]),
        "scan_runs": rows(spark, "scan_runs", {"id": 1, "status": "completed", "config_hash": "h1"}, {"id": 2, "status": "completed", "config_hash": "h2"}),
        "video_scans": rows(spark, "video_scans", {"id": 10, "scan_run_id": 1, "video_id": "a", "status": "completed"}, {"id": 20, "scan_run_id": 1, "video_id": "b", "status": "completed"}, {"id": 5, "scan_run_id": 2, "video_id": "a", "status": "completed"}),
        "sampled_frames": rows(spark, "sampled_frames", *[{"id": i, "video_scan_id": scan_of[k], "timestamp_s": t} for i, (k, t, _) in texts.items()]),
        "observations": rows(spark, "observations", *[{"id": i, "sampled_frame_id": i, "raw_text": t, "crop_path": evidence("a" if k < 3 else "b", "0", i) if i in (2, 4) else None} for i, (k, _, t) in texts.items()]),
        "text_clusters": rows(spark, "text_clusters", *[{"id": k, "video_scan_id": s, "start_s": float(k), "end_s": 9.0, "representative_observation_id": {1: 2, 2: 3, 3: 4}[k], "canonical_text": "t"} for k, s in scan_of.items()]),
        "cluster_observations": rows(spark, "cluster_observations", *[{"cluster_id": k, "observation_id": i} for i, (k, _, _) in texts.items()]),
    })
    return c


def test_a_query_is_kept_with_its_reviews(spark, corpus):
    key = plans.run_query(corpus, "Player One", ["playerone"])
    hits = {r["cluster_id"]: r for r in corpus.read("hits").collect()}
    assert set(hits) == {1, 3} and hits[1]["best_score"] == 1.0 and hits[1]["support_count"] == 3 and hits[1]["observation_id"] == 1
    assert corpus.read("query_matches").count() == 8
    plans.review(corpus, 1, key, "confirmed", "seen")
    with pytest.raises(KeyError):
        plans.review(corpus, 2, key, "confirmed")
    assert plans.run_query(corpus, "Player One", ["playerone"]) == key
    assert corpus.read("queries").count() == 1 and corpus.read("query_matches").count() == 8
    records = plans.hit_records(corpus, key).collect()
    assert [(r["cluster_id"], r["review_status"], r["reviewer_note"]) for r in records] == [(1, "confirmed", "seen"), (3, "unreviewed", None)]
    first = records[0]
    assert first["ocr_strings"] == ["Player One", "playerone", "plaxer one"] and first["timestamp_url"] == "https://x/a?t=1s"
    assert (first["matched_observation_id"], first["evidence_kind"], first["evidence_observation_id"]) == (1, "representative", 2)
    assert not first["observation_evidence_available"] and records[1]["evidence_kind"] == "matched"
    # A run over one scan leaves the other's hits.
    strict = plans.run_query(corpus, "Player One", ["playerone"], scan_id=20)
    assert strict == key and corpus.read("hits").count() == 2
    with pytest.raises(ValueError):
        plans.run_query(corpus, " - ")
    assert corpus.sql("SELECT count(*) AS n FROM {hits} WHERE best_score >= :least", least=0.9).first()["n"] == 2


def test_clusters_are_exported_with_their_provenance(corpus):
    out = plans.cluster_records(corpus).collect()
    assert [r["cluster_id"] for r in out] == [1, 2, 3] and out[0]["run_provenance"]["config_hash"] == "h1"
    assert [o["observation_id"] for o in out[0]["observations"]] == [1, 2, 5] and out[2]["ocr_strings"] == ["PlayerOne"]
    assert [r["cluster_id"] for r in plans.cluster_records(corpus, scan_id=20).collect()] == [3]


def test_a_deleted_source_leaves_shared_runs_and_others_evidence(spark, corpus, tmp_path):
    key = plans.run_query(corpus, "Player One")
    kept, gone, foreign = evidence("b", "0", 4), evidence("a", "0", 2), "report/assets/mine.txt"
    draft = evidence("a", "0", 7) + "." + "f" * 32 + ".tmp"
    for p in (kept, gone, foreign, draft):
        (tmp_path / "corpus" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "corpus" / p).write_text("x")
    assert plans.prune(corpus, spark.createDataFrame([(kept,), (gone,), (draft,)], "path string")) == 0
    assert plans.delete_source(corpus, "a") == 2
    assert [(tmp_path / "corpus" / p).exists() for p in (kept, gone, foreign, draft)] == [True, False, True, False]
    assert {t: corpus.read(t).count() for t in ("videos", "scan_runs", "video_scans", "text_clusters", "observations", "cluster_observations", "hits", "sampled_frames")} == {"videos": 1, "scan_runs": 1, "video_scans": 1, "text_clusters": 1, "observations": 1, "cluster_observations": 1, "hits": 1, "sampled_frames": 1}
    assert corpus.read("hits").first()["query_id"] == key
    with pytest.raises(KeyError):
        plans.delete_source(corpus, "a")


def test_versions_stay_and_can_be_backed_up(spark, corpus, tmp_path):
    first = corpus.versions()[-1]
    plans.delete_source(corpus, "b")
    assert corpus.read("videos", first).count() == 2 and corpus.backup(str(tmp_path / "copy"), first).read("videos").count() == 2
    (tmp_path / "corpus" / "manifests" / f"{corpus.versions()[-1] + 1}.json").write_text('{"version": 99, "schema": 6, "tables": {}}')
    stale = corpus.manifest(first)
    corpus.manifest = lambda version=None: stale | {"version": corpus.versions()[-1] - 1}
    with pytest.raises(RuntimeError, match="another writer"):
        corpus.commit({})


def test_older_rows_are_imported(spark, tmp_path):
    videos = spark.createDataFrame([("v", "2020-01-01 00:00:00", None, "scanned"), ("w", None, "h", "pending"), ("x", None, None, "scanned")], "id string, scanned_at string, config_hash string, status string")
    clusters = spark.createDataFrame([(1, "v", 0.0, 2.0, "name", 1.0, 0, "e1", "f1"), (2, "v", 0.0, 2.0, "twice", 2.0, 1, "e2", "f2")], "id long, video_id string, start_s double, end_s double, canonical_text string, evidence_timestamp_s double, row_index int, evidence_path string, frame_path string")
    seen = spark.createDataFrame([(11, "v", 1, 1.0, 0, "name", 0.5, "c"), (12, "v", 2, 2.0, 1, "twice", None, "c"), (13, "v", 2, 2.0, 1, "twice", None, "c"), (14, "v", None, 1.0, 5, "other", None, "c")], "id long, video_id string, cluster_id long, timestamp_s double, row_index int, raw_text string, ocr_confidence double, crop_path string")
    c = Corpus(spark, str(tmp_path / "c"))
    plans.import_into(c, videos, clusters, seen)
    assert {r["id"]: r["representative_observation_id"] for r in c.read("text_clusters").collect()} == {1: 11, 2: None}
    assert c.read("video_scans").count() == 2 and c.read("sampled_frames").count() == 2 and c.read("cluster_observations").count() == 3
    assert {r["id"]: r["crop_path"] for r in c.read("observations").collect()} == {11: "e1", 12: None, 13: None, 14: None}
    with pytest.raises(ValueError, match="observations"):
        plans.import_into(c, videos, clusters, seen.union(seen.limit(1).withColumn("video_id", F.lit("none"))))


def test_settings_have_rules():
    assert st.settings()["clustering"]["gap_s"] == 3
    for bad in ({"nothing": {}}, {"crops": {"x": 1}}, {"crops": {"duplicate_iou": 1.5}}, {"sampling": {"fps": 0}}, {"persistence": {"commit_interval_s": 5}}, {"matching": {"weak": 0.99}}, {"sampling": {"region": "left"}}, {"crops": {"max_per_frame": 1.5}}, {"acquisition": {"overlap_s": 600}}):
        with pytest.raises(ValueError):
            st.settings(bad)
    with pytest.raises(TypeError):
        st.settings({"sampling": {"fps": True}})
    assert st.scan_signature({"matching": {"gap_s": 5}}) == st.scan_signature({}) != st.scan_signature({"sampling": {"fps": 2}})


def test_configurations_are_read(tmp_path):
    (tmp_path / "c.yaml").write_text("sampling: {fps: 2}\nquery: {target_name: A, aliases: [B, A]}\nfilters: {date_from: 2020-01-01}\n")
    c = st.load_config(str(tmp_path / "c.yaml"))
    assert c.settings["sampling"]["fps"] == 2 and c.aliases == ["A", "B"] and c.resolve("x").parent == tmp_path
    for bad in ("- a\n", "other: 1\n", "filters: {date_to: soon}\n", "sampling: {fps: -1}\n"):
        (tmp_path / "bad.yaml").write_text(bad)
        with pytest.raises((ValueError, TypeError)):
            st.load_config(str(tmp_path / "bad.yaml"))


def test_pieces_lose_no_window_above_the_cut():
    r = random.Random(3)
    for _ in range(300):
        needle = "".join(r.choice("abc") for _ in range(r.randint(1, 12)))
        text = "".join(r.choice("abcd") for _ in range(r.randint(0, 25)))
        cut = r.choice((0.65, 0.82, 0.9))
        if window_scores([text], needle)[0] >= cut:
            assert any(p in text for p in pieces(needle, cut))


def test_batches_end_by_span_rows_or_bytes(spark):
    r = random.Random(4)
    data = [(k, float(t), r.randint(1, 9)) for k in "ab" for t in sorted(r.sample(range(200), 60))]
    got = {(x["k"], x["t"]): x["batch_no"] for x in selection.commit_points(spark.createDataFrame(data, "k string, t double, b long"), "k", "t", "b", 20, 5, 25).collect()}
    for k in "ab":
        batch, own = 0, []
        for _, t, b in sorted(x for x in data if x[0] == k):
            own.append((t, b))
            assert got[k, t] == batch
            if t - own[0][0] >= 20 or len(own) >= 5 or sum(x for _, x in own) >= 25:
                batch, own = batch + 1, []


def test_errors_are_raised(spark):
    arrays = spark.createDataFrame([([1, 2], [3])], "a array<int>, b array<int>")
    with pytest.raises(Exception, match="2 results expected, got 1"):
        arrays.select(selection.zipped(F.col("a"), F.col("b"))).collect()
    old = spark.createDataFrame([(1, 0.0)], "id long, start double")
    with pytest.raises(Exception, match="bounds have changed"):
        maintenance.append_chunks(old, spark.createDataFrame([(1, 5.0), (2, 0.0)], "id long, start double"), ["id"], ["start"]).collect()


def test_links_are_relative_and_safe(spark):
    paths = {"report/a/b.png": "a/b.png", "report/../x": "", "/report/a": "", "other/a": "", "report/a/./b": "", "report//a": "", None: ""}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r[0]: r[1] for r in df.select("p", reports.evidence_url(F.col("p"))).collect()} == paths


def test_downloads_are_removed_only_from_their_folder(spark):
    data = [("a", "scanned", True, "d/x"), ("b", "scanned", False, "d/x"), ("c", "failed", True, "d/x"), ("d", "scanned", True, "d/../x"), ("e", "scanned", True, None), ("f", "scanned", True, "dd/x")]
    df = spark.createDataFrame(data, "id string, status string, managed_download boolean, local_path string")
    assert [r["id"] for r in plans.removable_downloads(df, "d").collect()] == ["a"]


def test_reviews_at_one_time_have_an_order(spark):
    hits = spark.createDataFrame([(1, "h")], "cluster_id long, name string")
    reviews = spark.createDataFrame([(1, "confirmed", "x", 5), (1, "rejected", "a", 5), (1, "confirmed", "z", 4)], "cluster_id long, review_status string, reviewer_note string, at long")
    for order in (reviews, reviews.orderBy(F.desc("review_status"))):
        assert matching.with_reviews(hits, order, ["cluster_id"]).first()["review_status"] == "rejected"


def test_commands(spark, corpus, tmp_path, capsys):
    def run(*arguments):
        code = cli.main(spark, ["--corpus", corpus.root, *arguments])
        return code, capsys.readouterr().out.strip()

    code, key = run("query", "--name", "Player One", "--alias", "playerone")
    assert code == 0 and corpus.read("hits").count() == 2
    assert run("review", "1", key, "confirmed", "--note", "<b>")[0] == 0
    assert run("report", "--out", str(tmp_path / "out"), "--clusters")[0] == 0
    page = (tmp_path / "out" / "index.html").read_text()
    assert "&lt;b&gt;" in page and page.index("Player One") < page.index("PlayerOne")
    assert spark.read.json(str(tmp_path / "out" / "text_clusters.jsonl")).count() == 3
    assert run("totals")[1] == '{"videos": 2, "video_scans": 3, "text_clusters": 3, "hits": 2}'
    assert run("prune") == (0, "0") and run("delete-source", "a")[0] == 0 and run("query")[0] == 2
    (tmp_path / "c.yaml").write_text("query: {target_name: PlayerOne}")
    assert run("--config", str(tmp_path / "c.yaml"), "query")[0] == 0


def test_detectors_are_checked(spark):
    frames = spark.createDataFrame([("f1", "a"), ("f2", "b"), ("f3", "c")], "frame_id string, content string")
    box = [(0, 0), (1, 0), (1, 1), (0, 1)]
    found = detection.detected(frames, detection.scripted({"a": [("i", box, 0.5), ("j", box, 0.6)], "c": [("i", box, 0.7)]}), 2)
    assert sorted((r["frame_id"], r["identity"], r["confidence"]) for r in found.collect()) == [("f1", "i", 0.5), ("f1", "j", 0.6), ("f3", "i", 0.7)]
    with pytest.raises(RuntimeError, match="2 frames were given, 0"):
        detection.checked(["a", "b"], [])
    with pytest.raises(RuntimeError, match="share an identity"):
        detection.checked(["a"], [[("i", box, 1.0), ("i", box, 0.5)]])
    sizes = spark.sparkContext.accumulator(0)

    def read(crops):
        sizes.add(len(crops) == 2)
        return [(c.upper(), 0.9) for c in crops]

    texts = detection.recognized(frames.coalesce(1), read, 2)
    assert sorted((r["frame_id"], r["raw_text"]) for r in texts.collect()) == [("f1", "A"), ("f2", "B"), ("f3", "C")] and sizes.value == 1
    with pytest.raises(Exception, match="texts came back"):
        detection.recognized(frames, lambda crops: [], 2).collect()


def test_frames_are_accounted_for(spark):
    proposals = spark.createDataFrame([("f",)] * 5 + [("g",)], "frame_id string")
    suppressed = spark.createDataFrame([("f", 1, 1)], "frame_id string, duplicates long, dropped long")
    kept = spark.createDataFrame([("f", "ab"), ("f", "")], "frame_id string, raw_text string")
    rows = {r["frame_id"]: tuple(r)[1:] for r in detection.frame_accounting(proposals, suppressed, kept, F.length("raw_text") > 0).collect()}
    assert rows == {"f": (5, 1, 1, 2, 1), "g": (1, 0, 0, 0, 0)}
