"""The operators bound to the driver's tables, and the same questions as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as x
from ..operators import catalog, evaluation, maintenance, matching, metrics, reports, retention, selection, tracks
from ..sources import files
from ..streaming import ingest, tracking

ALIASES = ["thering", "oneble", "the stand"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _seconds(ts: str):
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1e6


_EVENTS = "(SELECT event_id, user_id, event_type, value, epoch_us(ts) / 1e6 AS s FROM events)"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").select("event_id", "user_id", "event_type", "value", _seconds("ts").alias("s"))


def _observations(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("cluster_id"), F.col("turn").alias("observation_id"), F.col("turn").cast("double").alias("timestamp_s"), F.col("text").alias("raw_text"))


def _scored(spark: SparkSession, d: str, cut: float) -> DataFrame:
    return matching.score_aliases(_observations(spark, d), matching.alias_table(spark, ALIASES, cut))


# DuckDB counts bytes in levenshtein: every other character than ASCII becomes one byte that no alias has.
_NORMAL = r"trim(regexp_replace(replace(lower({0}), 'ß', 'ss'), '\s+', ' ', 'g'))"
_SCORED = rf"""
obs AS (SELECT conv_id AS cluster_id, turn AS observation_id, turn::DOUBLE AS timestamp_s, text AS raw_text, {_NORMAL.format("text")} AS n FROM conversations),
al AS (SELECT * FROM (VALUES (0, 'thering', 'thering', 'thering'), (1, 'oneble', 'oneble', 'oneble'), (2, 'the stand', 'the stand', 'thestand')) v(ordinal, alias, an, ac)),
forms AS (SELECT o.*, a.*, regexp_replace(n, '[\s_\-|.·:]+', '', 'g') AS c FROM obs o, al a),
pairs AS (SELECT cluster_id, observation_id, ordinal, an AS needle, regexp_replace(n, '[^\x00-\x7F]', '~', 'g') AS hay FROM forms
  UNION ALL SELECT cluster_id, observation_id, ordinal, ac, regexp_replace(c, '[^\x00-\x7F]', '~', 'g') FROM forms),
sizes AS (SELECT p.*, length(needle) AS ln, l.len FROM pairs p, LATERAL (SELECT unnest(range(greatest(1, length(needle) - greatest(1, ceil(0.2 * length(needle))::INT)), length(needle) + greatest(1, ceil(0.2 * length(needle))::INT) + 1)) AS len) l),
fuzzy AS (SELECT cluster_id, observation_id, ordinal, max(1 - levenshtein(substr(hay, st::INT, len::INT), needle)::DOUBLE / greatest(ln, len)) AS s
  FROM (SELECT *, unnest(range(1, length(hay) - len + 2)) AS st FROM sizes) GROUP BY ALL),
scored AS (SELECT f.cluster_id, f.observation_id, f.timestamp_s, f.raw_text, f.ordinal, f.alias, CASE WHEN contains(n, an) OR contains(c, ac) THEN 1.0 ELSE coalesce(s, 0.0) END::DOUBLE AS score
  FROM forms f LEFT JOIN fuzzy USING (cluster_id, observation_id, ordinal))"""


@query(
    f"""WITH {_SCORED},
times AS (SELECT cluster_id, ordinal, alias, timestamp_s, max(score) AS score FROM scored GROUP BY ALL),
weak AS (SELECT *, timestamp_s - lag(timestamp_s) OVER (PARTITION BY cluster_id, ordinal ORDER BY timestamp_s) <= 3 AS near FROM times WHERE score >= 0.82),
kept AS (SELECT t.cluster_id, t.ordinal, t.alias, max(t.score) AS best_score, count(*) FILTER (t.score >= 0.82) AS support_count,
  max(t.score) >= 0.95 OR coalesce(bool_or(w.near), false) AS promoted FROM times t LEFT JOIN weak w USING (cluster_id, ordinal, timestamp_s) GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, ordinal ORDER BY score DESC, timestamp_s, observation_id) AS r FROM scored),
top AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY best_score DESC, support_count DESC, ordinal) AS r FROM kept WHERE promoted)
SELECT t.cluster_id, t.alias AS matched_alias, b.raw_text AS best_text, round(t.best_score, 9) AS best_score, t.support_count, b.observation_id
FROM top t JOIN best b USING (cluster_id, ordinal) WHERE t.r = 1 AND b.r = 1"""
)
def alias_hits(spark, d):
    return matching.hits(_scored(spark, d, matching.WEAK)).withColumn("best_score", F.round("best_score", 9))


@query(f"WITH {_SCORED} SELECT cluster_id, observation_id, alias, round(score, 9) AS score FROM scored WHERE score >= 0.65")
def borderline_matches(spark, d):
    return matching.borderline(_scored(spark, d, matching.BORDERLINE)).select("cluster_id", "observation_id", "alias", F.round("score", 9).alias("score"))


@query(rf"SELECT doc_id, {_NORMAL.format('text')} AS normal, regexp_replace({_NORMAL.format('text')}, '[\s_\-|.·:]+', '', 'g') AS compact FROM documents")
def normalize_compact(spark, d):
    n = _t(spark, d, "documents").withColumn("normal", x.normalized(F.col("text")))
    return n.select("doc_id", "normal", x.compacted(F.col("normal")).alias("compact"))


@query(rf"""SELECT conv_id, turn, regexp_replace(lower(role), '\s+', ' ', 'g') AS folded, 1 - levenshtein(role, 'assistent')::DOUBLE / greatest(length(role), 9) AS alike FROM conversations""")
def role_similarity(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", x.folded(F.col("role")).alias("folded"), x.similarity(F.col("role"), F.lit("assistent")).alias("alike"))


@query(
    f"""WITH t AS (SELECT user_id, event_type, s AS t, max(value) AS v FROM {_EVENTS} GROUP BY ALL),
w AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id, event_type ORDER BY t) <= 86400 AS near FROM t WHERE v >= 60)
SELECT user_id, event_type, max(t.v) >= 150 OR coalesce(bool_or(near), false) AS promoted, count(*) FILTER (t.v >= 60) AS support_count, max(t.v) AS best_score
FROM t LEFT JOIN w USING (user_id, event_type, t) GROUP BY ALL"""
)
def temporal_promotion(spark, d):
    rows = _events(spark, d).select("user_id", "event_type", F.col("s").alias("timestamp_s"), F.col("value").alias("score"))
    return matching.promote(rows, ["user_id", "event_type"], strong=150, weak=60, gap=86400)


@query("SELECT user_id, event_type, count(DISTINCT CASE WHEN value >= 60 THEN ts END) AS support_count FROM events GROUP BY ALL")
def support_counts(spark, d):
    rows = _events(spark, d).select("user_id", "event_type", F.col("s").alias("timestamp_s"), F.col("value").alias("score"))
    return tracks.support(rows, ["user_id", "event_type"], 60)


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders o WHERE o_orderstatus = 'F' AND NOT EXISTS (SELECT 1 FROM orders n WHERE n.o_custkey = o.o_custkey AND n.o_orderstatus = 'F' AND n.o_orderkey > o.o_orderkey)")
def latest_completed(spark, d):
    return selection.latest_completed(_t(spark, d, "orders"), "o_custkey", "o_orderkey", F.col("o_orderstatus") == "F").select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def work_queue(spark, d):
    unfinished = _t(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return selection.work_queue(_t(spark, d, "customer"), "c_custkey", F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), unfinished).select("c_custkey", "c_mktsegment")


@query("SELECT o_custkey, max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE o_totalprice / 2 END) AS position FROM orders GROUP BY 1")
def resume_positions(spark, d):
    rows = _t(spark, d, "orders").withColumn("half", F.col("o_totalprice") / 2)
    return selection.resume_positions(rows, "o_custkey", F.col("o_orderstatus") == "F", "o_totalprice", "half")


@query("SELECT o_custkey, (coalesce(max(o_orderkey), 0) + 1)::BIGINT AS next_no FROM orders GROUP BY 1")
def next_ordinals(spark, d):
    return selection.next_ordinal(_t(spark, d, "orders"), "o_custkey", "o_orderkey").withColumn("next_no", F.col("next_no").cast("long"))


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice, c_name, n_name, r_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE l_returnflag = 'R' AND o_orderstatus = 'F'""")
def hit_star_join(spark, d):
    # Nations and regions have a fixed number of rows; the other sides are left to the optimizer's sizes.
    places = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    customers = _t(spark, d, "customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))
    done = _t(spark, d, "orders").filter("o_orderstatus = 'F'").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    lines = _t(spark, d, "lineitem").filter("l_returnflag = 'R'")
    return lines.join(done, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "l_extendedprice", "c_name", "n_name", "r_name")


@query("SELECT p_partkey::VARCHAR AS path FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45 UNION SELECT l_suppkey FROM lineitem WHERE l_quantity > 45)")
def orphan_refs(spark, d):
    lines = _t(spark, d, "lineitem").filter("l_quantity > 45")
    return maintenance.orphans(_t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path")), maintenance.references([(lines, ["l_partkey", "l_suppkey"])]))


@query("SELECT l_partkey::VARCHAR AS path FROM lineitem WHERE l_returnflag = 'R' UNION SELECT l_suppkey::VARCHAR FROM lineitem WHERE l_returnflag = 'R' UNION SELECT s_suppkey::VARCHAR FROM supplier")
def reference_membership(spark, d):
    return maintenance.references([(_t(spark, d, "lineitem").filter("l_returnflag = 'R'"), ["l_partkey", "l_suppkey"]), (_t(spark, d, "supplier"), ["s_suppkey"])])


_VERSIONS = "o AS (SELECT user_id, max(value) AS value, min(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY 1), n AS (SELECT user_id, max(value) AS value, min(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY 1)"


def _version(spark, d, kind):
    return _t(spark, d, "events").filter(F.col("event_type") == kind).groupBy("user_id").agg(F.max("value").alias("value"), F.min("event_id").alias("event_id"))


@query(f"WITH {_VERSIONS} SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(n.value, o.value) AS value, coalesce(o.event_id, n.event_id) AS event_id FROM o FULL JOIN n USING (user_id)")
def upsert_preserve(spark, d):
    return maintenance.upsert(_version(spark, d, "click"), _version(spark, d, "view"), "user_id", {"event_id": F.col("o.event_id")})


@query(f"WITH {_VERSIONS} SELECT * FROM o WHERE user_id % 3 <> 0 UNION ALL SELECT * FROM n WHERE user_id % 3 = 0")
def stale_delete(spark, d):
    old, new = _version(spark, d, "click"), _version(spark, d, "view").filter("user_id % 3 = 0")
    chosen = _t(spark, d, "events").filter("user_id % 3 = 0").select("user_id").distinct()
    return matching.rerun(old, new, chosen, "user_id")


@query(f"WITH {_VERSIONS} SELECT * FROM o UNION ALL SELECT * FROM n WHERE user_id NOT IN (SELECT user_id FROM o)")
def insert_absent(spark, d):
    return maintenance.append_absent(_version(spark, d, "click"), _version(spark, d, "view"), ["user_id"])


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY 1")
def latest_status(spark, d):
    log = _t(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    return maintenance.latest_event(log, "user_id", "event_id").select("user_id", "event_type", "value", "event_id")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def cascade_delete(spark, d):
    gone = _t(spark, d, "customer").filter("c_nationkey = 3").select(F.col("c_custkey").alias("key"))
    return maintenance.cascade({"orders": (_t(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey")}, gone)["orders"]


@query("""SELECT event_id AS observation_id, user_id AS cluster_id, CASE WHEN event_id IN (SELECT min(event_id) FROM events GROUP BY user_id) OR user_id % 2 = 0 THEN event_type END AS crop_path FROM events""")
def compact_evidence(spark, d):
    e = _t(spark, d, "events")
    rows = e.select(F.col("event_id").alias("observation_id"), F.col("user_id").alias("cluster_id"), F.col("event_type").alias("crop_path"))
    reps = e.groupBy("user_id").agg(F.min("event_id").alias("observation_id"))
    return maintenance.compact_evidence(rows, reps, "crop_path", e.filter("user_id % 2 = 1").select(F.col("user_id").alias("cluster_id")))


@query("""SELECT doc_id, CASE WHEN n_chars < 500 THEN 'shorter than min_duration' WHEN n_chars > 5000 THEN 'longer than max_duration' WHEN NOT regexp_matches(source, 'SRC1', 'i') THEN 'title does not match include'
WHEN regexp_matches(source, 'src1[5-9]', 'i') THEN 'title matches exclude' END AS reason FROM documents""")
def admission_filter(spark, d):
    rules = catalog.Admission(min_duration=500, max_duration=5000, include="SRC1", exclude="src1[5-9]")
    return _t(spark, d, "documents").select("doc_id", catalog.rejection(rules, F.col("source"), F.lit("20240101"), F.col("n_chars").cast("double")).alias("reason"))


@query(r"SELECT event_id, (value IS NULL OR (value / 100 BETWEEN 0.1 AND 1)) AND length(regexp_replace(event_type || event_id, '[^\p{L}\p{N}]', '', 'g')) >= 2 AS keep FROM events")
def useful_text(spark, d):
    return _t(spark, d, "events").select("event_id", x.useful(F.concat("event_type", F.col("event_id").cast("string")), F.col("value") / 100).alias("keep"))


@query(
    f"""SELECT event_id, (sum(n) OVER (PARTITION BY user_id, event_type ORDER BY s, event_id))::BIGINT AS session_no
FROM (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY user_id, event_type ORDER BY s, event_id) > 129600 THEN 1 ELSE 0 END AS n FROM {_EVENTS})"""
)
def gap_sessions(spark, d):
    return tracks.gap_sessions(_events(spark, d), ["user_id", "event_type"], "s", 129600, ["event_id"]).select("event_id", "session_no")


@query(f"SELECT event_id, floor(s / 86400)::BIGINT AS chunk_no, floor(s / 86400) * 86400 AS chunk_start_s FROM {_EVENTS}")
def tumbling_chunks(spark, d):
    return ingest.chunked(_events(spark, d), "s", 86400).select("event_id", "chunk_no", "chunk_start_s")


@query("SELECT doc_id, i::INT AS sequence_no, i * 600.0::DOUBLE AS chunk_start_s, least(n_chars::DOUBLE, (i + 1) * 600.0) AS chunk_end_s FROM documents, LATERAL (SELECT unnest(range(ceil(n_chars / 600.0)::INT)) AS i)")
def chunk_grid(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("duration"))
    return selection.chunk_grid(rows, "duration", 600.0).select("doc_id", "sequence_no", "chunk_start_s", "chunk_end_s")


@query(
    f"""SELECT user_id, event_type, min(s) AS start_s, max(s) AS end_s, count(*) AS support_count, count(DISTINCT s) AS distinct_times, max(value) AS best_confidence,
arg_min(event_id, struct_pack(a := -value, b := event_id))::VARCHAR AS canonical_text FROM {_EVENTS} GROUP BY ALL"""
)
def track_aggregate(spark, d):
    rows = _events(spark, d).withColumn("label", F.col("event_id").cast("string"))
    return tracks.track_aggregate(rows, ["user_id", "event_type"], "s", "label", "value", "event_id")


@query("""SELECT l_orderkey, l_linenumber, place, capped FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber)::INT AS place,
greatest(0, count(*) OVER (PARTITION BY l_orderkey) - 3)::BIGINT AS capped FROM lineitem) WHERE place <= 3""")
def topk_per_frame(spark, d):
    return tracks.top_per_group(_t(spark, d, "lineitem"), ["l_orderkey"], [F.col("l_extendedprice").desc(), "l_linenumber"], 3).select("l_orderkey", "l_linenumber", "place", "capped")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey * 10 + l_linenumber) AS r FROM lineitem) WHERE r = 1")
def best_scored(spark, d):
    rows = _t(spark, d, "lineitem").withColumn("row_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return tracks.scored_first(rows, ["l_suppkey"], "l_extendedprice", "row_id").select("l_orderkey", "l_linenumber", "l_extendedprice")


_BOXES = "(SELECT vec_id AS identity, vec_id // 10 AS frame_id, embedding[1]::DOUBLE AS x0, embedding[2]::DOUBLE AS y0, embedding[1]::DOUBLE + 0.5 + abs(embedding[3]) AS x1, embedding[2]::DOUBLE + 0.5 + abs(embedding[4]) AS y1 FROM embeddings)"


def _boxes(spark, d):
    e = [F.col("embedding")[i].cast("double") for i in range(4)]
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("identity"), F.floor(F.col("vec_id") / 10).cast("long").alias("frame_id"), e[0].alias("x0"), e[1].alias("y0"), (e[0] + 0.5 + F.abs(e[2])).alias("x1"), (e[1] + 0.5 + F.abs(e[3])).alias("y1"))


@query(
    f"""WITH p AS (SELECT a.frame_id, a.identity, b.identity AS other, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS i,
(a.x1 - a.x0) * (a.y1 - a.y0) AS sa, (b.x1 - b.x0) * (b.y1 - b.y0) AS sb FROM {_BOXES} a JOIN {_BOXES} b ON a.frame_id = b.frame_id AND a.identity < b.identity)
SELECT frame_id, identity, other, round(i / (sa + sb - i), 6) AS iou, round(i / least(sa, sb), 6) AS containment FROM p"""
)
def box_overlaps(spark, d):
    return retention.overlapping_pairs(_boxes(spark, d), "frame_id", ["x0", "y0", "x1", "y1"]).withColumn("iou", F.round("iou", 6)).withColumn("containment", F.round("containment", 6))


@query(
    f"""WITH RECURSIVE b AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY x1 - x0 DESC, x0, y0, x1, y1, identity) AS r, count(*) OVER (PARTITION BY frame_id) AS n FROM {_BOXES}),
g AS (SELECT frame_id, r, n, [struct_pack(i := identity, x0 := x0, y0 := y0, x1 := x1, y1 := y1)] AS kept FROM b WHERE r = 1 UNION ALL
SELECT b.frame_id, b.r, b.n, CASE WHEN len(list_filter(g.kept, lambda k: greatest(0, least(k.x1, b.x1) - greatest(k.x0, b.x0)) * greatest(0, least(k.y1, b.y1) - greatest(k.y0, b.y0))
  >= least(0.5 * ((k.x1 - k.x0) * (k.y1 - k.y0) + (b.x1 - b.x0) * (b.y1 - b.y0)) / 1.5, 0.7 * least((k.x1 - k.x0) * (k.y1 - k.y0), (b.x1 - b.x0) * (b.y1 - b.y0))))) > 0 THEN g.kept
  ELSE list_append(g.kept, struct_pack(i := b.identity, x0 := b.x0, y0 := b.y0, x1 := b.x1, y1 := b.y1)) END FROM g JOIN b ON b.frame_id = g.frame_id AND b.r = g.r + 1)
SELECT frame_id, array_to_string(list_transform(kept[1:8], lambda k: k.i::VARCHAR), '|') AS kept, n::BIGINT AS raw, (n - len(kept))::BIGINT AS duplicates, greatest(0, len(kept) - 8)::BIGINT AS dropped FROM g WHERE r = n"""
)
def iou_suppression(spark, d):
    rows = _boxes(spark, d).select("frame_id", "identity", g.box(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]).alias("quad"), (F.col("x1") - F.col("x0")).alias("confidence"))
    return retention.suppress(rows.filter(g.valid_quad(F.col("quad"))), iou=0.5, containment=0.7, most=8).withColumn("kept", F.array_join("kept", "|"))


@query(
    f"""SELECT identity, round((x1 - x0) * (y1 - y0), 9) AS area, round(x1 - x0, 9) AS width, round(y1 - y0, 9) AS height,
array_to_string(list_transform([x0, y0, x1, y0, x1, y1, x0, y1], lambda v: round_even(v * 16, 0)::BIGINT::VARCHAR), ',') AS geometry_key,
['top_left', 'top_center', 'top_right', 'middle_left', 'center', 'middle_right', 'bottom_left', 'bottom_center', 'bottom_right'][
  least(2, greatest(0, floor(((y0 + y1) / 2 + 3) / 6 * 3)::INT)) * 3 + least(2, greatest(0, floor(((x0 + x1) / 2 + 3) / 6 * 3)::INT)) + 1] AS region FROM {_BOXES}"""
)
def polygon_metadata(spark, d):
    q = F.col("quad")
    rows = _boxes(spark, d).withColumn("quad", g.box(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]))
    width, height = g.dimensions(q)
    cx, cy = g.center(q)
    return rows.select("identity", F.round(g.area(q), 9).alias("area"), F.round(width, 9).alias("width"), F.round(height, 9).alias("height"), g.geometry_key(q).alias("geometry_key"), g.screen_region(cx + 3, cy + 3, F.lit(6.0), F.lit(6.0)).alias("region"))


_QUALITY = "FROM labels JOIN documents USING (doc_id)"


@query(
    f"""WITH s AS (SELECT quality = 1 AS p, least(1.0, n_chars / 3000.0) AS v, lang FROM labels JOIN documents USING (doc_id)),
t AS (SELECT unnest([0.65, 0.82, 0.95, 1.0])::DOUBLE AS threshold), gr AS (SELECT 'lang=' || lang AS group_name, p, v FROM s UNION ALL SELECT 'long=' || (v >= 1)::VARCHAR, p, v FROM s)
SELECT group_name, threshold, count(*) FILTER (v >= threshold AND p) AS tp, count(*) FILTER (v >= threshold AND NOT p) AS fp, count(*) FILTER (p) AS positives,
count(*) FILTER (v >= threshold AND p) / nullif(count(*) FILTER (v >= threshold), 0)::DOUBLE AS precision, count(*) FILTER (v >= threshold AND p) / nullif(count(*) FILTER (p), 0)::DOUBLE AS recall FROM gr, t GROUP BY ALL"""
)
def group_metrics(spark, d):
    rows = _t(spark, d, "labels").join(_t(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id").withColumn("v", F.least(F.lit(1.0), F.col("n_chars") / 3000.0))
    rows = evaluation.by_dimension(rows, {"lang": F.col("lang"), "long": F.col("v") >= 1})
    return evaluation.threshold_metrics(rows, ["group_name"], "v", F.col("quality") == 1)


@query("""SELECT event_type, avg((event_type = substr(event_type, 1, 4))::INT::DOUBLE) AS exact, sum(levenshtein(event_type, substr(event_type, 1, 4) || 'x'))::BIGINT AS edits, sum(length(event_type))::BIGINT AS chars,
sum(levenshtein(event_type, substr(event_type, 1, 4) || 'x')) / greatest(1, sum(length(event_type)))::DOUBLE AS cer FROM events GROUP BY 1""")
def error_rates(spark, d):
    rows = _t(spark, d, "events").withColumn("ocr", F.concat(F.substring("event_type", 1, 4), F.lit("x")))
    out = evaluation.error_rate(rows, F.col("event_type"), F.col("ocr"), ["event_type"])
    exact = _t(spark, d, "events").groupBy("event_type").agg(F.avg((F.col("event_type") == F.substring("event_type", 1, 4)).cast("double")).alias("exact"))
    return out.drop("exact").join(exact, "event_type").select("event_type", "exact", "edits", "chars", "cer")


@query(
    f"""WITH t AS (SELECT user_id, event_type, s AS t, max(value) AS v, bool_or(value > 20) AS p FROM {_EVENTS} GROUP BY ALL), w AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id, event_type ORDER BY t) <= 86400 AS near FROM t WHERE v >= 60),
k AS (SELECT user_id, event_type, bool_or(p) AS p, max(t.v) >= 150 OR coalesce(bool_or(near), false) AS f FROM t LEFT JOIN w USING (user_id, event_type, t) GROUP BY ALL),
u AS (SELECT user_id, count(*) AS n, count(*) FILTER (f) AS h FROM (SELECT user_id, event_type, k.p, k.f FROM (SELECT user_id, event_type, bool_or(value > 20) AS p FROM {_EVENTS} GROUP BY ALL) q JOIN (SELECT user_id, event_type, f, p FROM (SELECT t.user_id, t.event_type, bool_or(t.p) AS p, max(t.v) >= 150 OR coalesce(bool_or(w.near), false) AS f FROM t LEFT JOIN w USING (user_id, event_type, t) GROUP BY ALL)) k USING (user_id, event_type)) WHERE p GROUP BY 1)
SELECT sum(n)::BIGINT AS occurrences, sum(h)::BIGINT AS found_occurrences, count(*) AS sources, count(*) FILTER (h > 0) AS found_sources, sum(h) / sum(n)::DOUBLE AS occurrence_recall, count(*) FILTER (h > 0) / count(*)::DOUBLE AS source_recall FROM u"""
)
def occurrence_recall(spark, d):
    rows = _events(spark, d).select("user_id", F.col("event_type").alias("occurrence_id"), F.lit("a").alias("alias"), F.col("s").alias("timestamp_s"), F.col("value").alias("score"), (F.col("value") > 20).alias("positive"))
    return evaluation.occurrence_recall(rows, "user_id", "positive", 150, 60, 86400)


_OUTCOMES = """h AS (SELECT l_suppkey AS k, bool_or(l_quantity >= 49) AS v, count(*) AS hits FROM lineitem WHERE l_quantity >= 47 GROUP BY 1),
o AS (SELECT s_suppkey AS k, coalesce(hits, 0) AS hits, CASE WHEN v THEN 'found' WHEN hits > 0 THEN 'needs_review' ELSE 'not_found' END AS outcome FROM supplier LEFT JOIN h ON s_suppkey = k)"""


def _outcomes(spark, d):
    truth = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))
    return evaluation.presence(truth, _t(spark, d, "lineitem").filter("l_quantity >= 47").select(F.col("l_suppkey").alias("k"), "l_quantity"), "k", F.col("l_quantity") >= 49)


@query(f"WITH {_OUTCOMES} SELECT * FROM o")
def presence_outcomes(spark, d):
    return _outcomes(spark, d)


@query(
    f"""WITH {_OUTCOMES}, n AS (SELECT count(*) AS n, count(*) FILTER (outcome = 'found') AS lo, count(*) FILTER (outcome <> 'not_found') AS hi FROM o),
b AS (SELECT 'lower' AS bound, n, lo AS tp, hi - lo + 2 AS fp FROM n UNION ALL SELECT 'upper', n, hi, 2 FROM n)
SELECT bound, tp, n - tp AS fn, fp, round_even(tp / n::DOUBLE, 4) AS recall, round_even(tp / nullif(tp + fp, 0)::DOUBLE, 4) AS precision,
round_even(2 * (tp / n::DOUBLE) * (tp / (tp + fp)::DOUBLE) / nullif(tp / n::DOUBLE + tp / (tp + fp)::DOUBLE, 0), 4) AS f1 FROM b"""
)
def presence_bounds(spark, d):
    return evaluation.presence_bounds(_outcomes(spark, d), 2)


@query("""SELECT name, bool_or(role = 'part') AS is_part, bool_or(role = 'supplier') AS is_supplier, bool_and(returned) AS all_returned, count(*) AS n FROM (
SELECT l_partkey::VARCHAR AS name, 'part' AS role, l_returnflag = 'R' AS returned FROM lineitem UNION ALL SELECT l_suppkey::VARCHAR, 'supplier', l_returnflag = 'R' FROM lineitem) GROUP BY 1""")
def role_flags(spark, d):
    rows = _t(spark, d, "lineitem").withColumn("returned", F.col("l_returnflag") == "R")
    return evaluation.role_flags(rows, {"part": F.col("l_partkey").cast("string"), "supplier": F.col("l_suppkey").cast("string")}, ["returned"])


@query("SELECT user_id, string_agg(event_type, '|' ORDER BY s, i) AS kinds FROM (SELECT user_id, event_type, arg_min(ts, struct_pack(a := ts, b := event_id)) AS s, arg_min(event_id, struct_pack(a := ts, b := event_id)) AS i FROM events GROUP BY ALL) GROUP BY 1")
def ordered_distinct(spark, d):
    return tracks.ordered_distinct(_t(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type", "kinds").withColumn("kinds", F.array_join("kinds", "|"))


@query("SELECT user_id, count(*) AS samples, sha256(string_agg(printf('%.3f', value) || chr(10), '' ORDER BY value)) AS digest FROM events GROUP BY 1")
def grid_digest(spark, d):
    return metrics.grid_digest(_t(spark, d, "events"), "user_id", "value", 3)


@query(f"SELECT event_id, (value - lag(value) OVER w) / nullif(s - lag(s) OVER w, 0) AS velocity, row_number() OVER w AS running_count FROM {_EVENTS} WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)")
def velocity(spark, d):
    return tracks.velocity(_events(spark, d), ["user_id"], "s", "value", ["event_id"]).select("event_id", "velocity", "running_count")


@query("SELECT event_id, round((sum(value) OVER w + 300 * 0.6) / (count(*) OVER w + 300), 9) AS rate FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def cumulative_rate(spark, d):
    rows = _t(spark, d, "events").withColumn("one", F.lit(1))
    return metrics.cumulative_rate(rows, "user_id", ["ts", "event_id"], "one", "value").select("event_id", F.round("rate", 9).alias("rate"))


@query(
    """SELECT user_id, round(list_reduce(list_prepend(0.6::DOUBLE, flatten(list(CASE WHEN value > 0 THEN [value] ELSE [] END ORDER BY event_id))), lambda r, v: r + (1 - exp(-v / 120.0)) * (v * 2 / v - r)), 9) AS rate FROM events GROUP BY 1"""
)
def smoothed_rate(spark, d):
    rows = _t(spark, d, "events").withColumn("spent", F.col("value") * 2)
    return metrics.smoothed_rate(rows, "user_id", "event_id", "value", "spent").withColumn("rate", F.round("rate", 9))


@query("""WITH s AS (SELECT user_id, event_type, sum(value) AS s FROM events GROUP BY ALL), r AS (SELECT user_id, round(sum(s), 6) AS staged, arg_min(event_type, struct_pack(a := -s, b := event_type)) AS largest FROM s GROUP BY 1)
SELECT user_id, staged, round(greatest(0, 100000 - staged), 6) AS other, largest, 2.0::DOUBLE AS realtime_factor FROM r""")
def stage_accounting(spark, d):
    rows = _t(spark, d, "events").select("user_id", F.col("event_type").alias("stage"), F.col("value").alias("seconds"), F.lit(100000.0).alias("wall"), F.lit(50000.0).alias("media"))
    return metrics.stage_accounting(rows, "user_id", "wall", "media")


@query("""SELECT page_id, CASE WHEN regexp_matches(url, '^https?:') THEN url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 't=' || floor(page_id * 1.5)::BIGINT || 's' ELSE '' END AS link,
replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS escaped FROM pages""")
def report_links(spark, d):
    p = _t(spark, d, "pages")
    return p.select("page_id", x.timestamp_url(F.col("url"), F.col("page_id") * 1.5).alias("link"), x.html_escape(F.col("html")).alias("escaped"))


@query("""SELECT doc_id, CASE WHEN n_chars >= 3600 THEN printf('%d:%02d:%02d', n_chars // 3600, n_chars % 3600 // 60, n_chars % 60) ELSE printf('%02d:%02d', n_chars // 60, n_chars % 60) END AS clock,
'local-' || substr(sha256(source), 1, 20) AS local_id FROM documents""")
def clocks_and_ids(spark, d):
    return _t(spark, d, "documents").select("doc_id", x.format_time(F.col("n_chars").cast("double")).alias("clock"), catalog.local_id(F.col("source")).alias("local_id"))


@query("SELECT r_name || '#' || i AS r_name, (r_regionkey + i * 10.0)::DOUBLE AS at, i::INT AS copy_no FROM region, LATERAL (SELECT unnest(range(4)) AS i)")
def scale_grow(spark, d):
    rows = _t(spark, d, "region").select("r_name", F.col("r_regionkey").cast("double").alias("at"))
    return maintenance.grow(rows, 4, ["r_name"], {"at": 10.0})


@query("SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def broken_references(spark, d):
    return maintenance.broken_references(_t(spark, d, "orders").select("o_custkey"), "o_custkey", _t(spark, d, "customer").filter("c_acctbal > 0"), "c_custkey")


@query()
def text_tracks(spark, d):
    e = _t(spark, d, "embeddings")
    v = [F.col("embedding")[i].cast("double") for i in range(4)]
    rows = e.select(F.col("label").alias("scan_id"), F.col("vec_id").alias("observation_id"), F.col("vec_id").cast("double").alias("timestamp_s"), (v[0] / 20 + 0.5).alias("x"), (v[1] / 20 + 0.5).alias("y"), F.lit(0.1).alias("w"), F.lit(0.05).alias("h"), F.concat(F.lit("label "), F.col("label").cast("string")).alias("text"))
    return tracking.track(rows, gap=60.0, distance=0.2, tolerance=2.0)


_SEEN = "SELECT event_id AS observation_id, event_type AS raw_text, CASE WHEN value > 50 THEN 'c' || event_id END AS crop_path, s AS timestamp_s, 'f' || event_id AS full_frame_path FROM " + _EVENTS


@query(
    f"""WITH o AS ({_SEEN}), h AS (SELECT user_id, max(event_id) AS m, min(event_id) * (CASE WHEN user_id % 5 = 0 THEN -1 ELSE 1 END) AS r FROM events GROUP BY 1)
SELECT user_id, m.timestamp_s AS matched_timestamp_s, m.crop_path IS NOT NULL AS available, CASE WHEN m.crop_path IS NOT NULL THEN 'matched' ELSE 'representative' END AS kind,
CASE WHEN m.crop_path IS NOT NULL THEN m.observation_id ELSE r.observation_id END AS evidence_id,
CASE WHEN m.crop_path IS NOT NULL THEN m.raw_text WHEN r.observation_id IS NOT NULL THEN r.raw_text ELSE 'own' END AS evidence_text,
CASE WHEN m.crop_path IS NOT NULL THEN m.crop_path WHEN r.observation_id IS NOT NULL THEN r.crop_path ELSE 'path' END AS evidence_path
FROM h LEFT JOIN o m ON m.observation_id = h.m LEFT JOIN o r ON r.observation_id = h.r"""
)
def evidence_choice(spark, d):
    e = _events(spark, d)
    seen = e.select(F.col("event_id").alias("observation_id"), F.col("event_type").alias("raw_text"), F.when(F.col("value") > 50, F.concat(F.lit("c"), F.col("event_id").cast("string"))).alias("crop_path"), F.lit(None).cast("string").alias("quad"), F.col("s").alias("timestamp_s"), F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("full_frame_path"))
    rep = F.min("event_id") * F.when(F.col("user_id") % 5 == 0, -1).otherwise(1)
    hits = e.groupBy("user_id").agg(F.max("event_id").alias("matched_observation_id"), rep.alias("representative_observation_id"))
    hits = hits.withColumns({"representative_path": F.lit("path"), "representative_text": F.lit("own"), "evidence_timestamp_s": F.lit(0.0), "frame_path": F.lit("frame")})
    rows = reports.with_evidence(hits, seen)
    return rows.select("user_id", "matched_timestamp_s", F.col("observation_evidence_available").alias("available"), F.col("evidence_kind").alias("kind"), F.col("evidence_observation_id").alias("evidence_id"), "evidence_text", "evidence_path")


@query(
    """WITH m AS (SELECT l_orderkey AS cluster_id, l_linenumber AS observation_id, l_quantity AS score FROM lineitem)
SELECT cluster_id, observation_id AS matched_observation_id FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, observation_id) AS r FROM m) WHERE r = 1 AND cluster_id % 2 = 0"""
)
def matched_choice(spark, d):
    lines = _t(spark, d, "lineitem")
    unique = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    matches = lines.select(F.lit("q").alias("query_id"), unique.alias("observation_id"), F.lit("a").alias("alias"), F.col("l_quantity").alias("score"))
    bridge = lines.select(F.col("l_orderkey").alias("cluster_id"), unique.alias("observation_id"))
    hits = bridge.filter("cluster_id % 2 = 0").select(F.lit("q").alias("query_id"), "cluster_id", F.lit("a").alias("matched_alias")).distinct()
    found = reports.matched_observations(matches, bridge, hits)
    return found.select("cluster_id", (F.col("matched_observation_id") % 10).cast("int").alias("matched_observation_id"))


@query(
    """SELECT o_orderkey AS cluster_id, c_custkey, n_name AS title, best_score, row_number() OVER (ORDER BY best_score DESC, start_s, o_orderkey) AS place FROM (SELECT o_orderkey, o_custkey, round(o_totalprice) AS best_score, o_orderkey % 50 AS start_s FROM orders WHERE o_orderstatus = 'F') o
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
)
def hit_report(spark, d):
    orders = _t(spark, d, "orders").filter("o_orderstatus = 'F'")
    hits = orders.select(F.col("o_orderkey").alias("cluster_id"), F.col("o_custkey").alias("query_id"), F.round("o_totalprice").alias("best_score"))
    clusters = orders.join(_t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("scan_id")), "o_custkey").select(F.col("o_orderkey").alias("cluster_id"), "scan_id", (F.col("o_orderkey") % 50).alias("start_s"))
    scans = _t(spark, d, "nation").select(F.col("n_nationkey").alias("scan_id"), F.col("n_regionkey").alias("run_id"), F.col("n_nationkey").alias("source_id"))
    sources = _t(spark, d, "nation").select(F.col("n_nationkey").alias("source_id"), F.col("n_name").alias("title"))
    runs = _t(spark, d, "region").select(F.col("r_regionkey").alias("run_id"), F.col("r_name").alias("config_hash"))
    queries = _t(spark, d, "customer").select(F.col("c_custkey").alias("query_id"), F.col("c_name").alias("target_name"))
    rows = reports.hit_report(hits, clusters, sources, queries, scans, runs).select("cluster_id", F.col("query_id").alias("c_custkey"), "title", "best_score", "start_s")
    # The place tells the order to a comparison that has none.
    return tracks.numbered(rows, [F.col("best_score").desc(), "start_s", "cluster_id"], "place").drop("start_s")


_ASKED = """a AS (SELECT n_nationkey AS query_id, n_name AS name FROM nation UNION ALL SELECT n_nationkey + 100, n_name FROM nation WHERE n_nationkey < 10), l AS (SELECT name, max(query_id) AS query_id FROM a GROUP BY 1),
h AS (SELECT c_nationkey + 100 * (c_custkey % 2) AS query_id, CASE WHEN c_custkey % 3 = 0 THEN 'x ' || lower(n_name) || c_custkey ELSE c_name END AS t FROM customer JOIN nation ON c_nationkey = n_nationkey),
n AS (SELECT n_name AS name FROM nation UNION SELECT r_name FROM region), b AS (SELECT n.name, count(t) AS candidates,
count(t) FILTER (contains(regexp_replace(lower(t), '[\\s_\\-|.·:]+', '', 'g'), regexp_replace(lower(n.name), '[\\s_\\-|.·:]+', '', 'g'))) AS verified FROM n LEFT JOIN l USING (name) LEFT JOIN h USING (query_id) GROUP BY 1)"""


def _battery(spark, d):
    n, r = _t(spark, d, "nation"), _t(spark, d, "region")
    first = n.select(F.col("n_nationkey").cast("long").alias("query_id"), F.col("n_name").alias("target_name"))
    asked = first.unionByName(first.filter("query_id < 10").withColumn("query_id", F.col("query_id") + 100))
    c = _t(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    text = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("x "), F.lower("n_name"), F.col("c_custkey").cast("string"))).otherwise(F.col("c_name"))
    hits = c.select((F.col("c_nationkey") + 100 * (F.col("c_custkey") % 2)).cast("long").alias("query_id"), text.alias("best_text"))
    names = n.select(F.col("n_name").alias("name")).union(r.select("r_name"))
    return reports.battery(names, asked, hits, x.folded_compact)


@query(f"WITH {_ASKED} SELECT name, candidates, verified, candidates - verified AS unverified FROM b")
def name_battery(spark, d):
    return _battery(spark, d)


@query(f"WITH {_ASKED} SELECT count(*) AS queries, count(*) FILTER (candidates > 0) AS queries_with_candidates, sum(candidates)::BIGINT AS candidates, sum(verified)::BIGINT AS verified, sum(candidates - verified)::BIGINT AS unverified FROM b")
def battery_summary(spark, d):
    return reports.battery_summary(_battery(spark, d))


@query("SELECT DISTINCT n_name AS name FROM nation WHERE n_name IN (SELECT r_name FROM region UNION SELECT n_name FROM nation WHERE n_nationkey > 20)")
def roster_overlap(spark, d):
    n = _t(spark, d, "nation")
    roster = _t(spark, d, "region").select(F.col("r_name").alias("name")).union(n.filter("n_nationkey > 20").select("n_name"))
    return reports.roster_overlap(n.select(F.col("n_name").alias("name")), roster)


@query("SELECT user_id, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS digest FROM (SELECT user_id, sha256(coalesce('+' || event_id, '-') || chr(1) || coalesce('+' || event_type, '-')) AS h FROM events) GROUP BY 1")
def row_digests(spark, d):
    return reports.row_digest(_t(spark, d, "events"), "user_id", ["event_id", "event_type"])


@query("SELECT 'users' AS name, (SELECT count(*) FROM events) AS old, (SELECT count(DISTINCT user_id) FROM events) AS new, (SELECT count(*) FROM events) = (SELECT count(DISTINCT user_id) FROM events) AS equal UNION ALL SELECT 'nations', (SELECT count(*) FROM nation), (SELECT count(DISTINCT n_name) FROM nation), (SELECT count(*) FROM nation) = (SELECT count(DISTINCT n_name) FROM nation)")
def table_reconciliation(spark, d):
    e, n = _t(spark, d, "events"), _t(spark, d, "nation")
    return reports.reconciled({"users": (e, e.select("user_id").distinct()), "nations": (n, n.select("n_name").distinct())})


@query("SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem")
def table_totals(spark, d):
    return reports.totals({"orders": _t(spark, d, "orders"), "lineitem": _t(spark, d, "lineitem")})


@query("SELECT o_custkey AS video_id, o_orderkey AS id, s_name AS run_s_name FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders WHERE o_orderstatus <> 'F') JOIN supplier ON s_suppkey = o_orderkey % 10 WHERE r = 1")
def latest_unfinished(spark, d):
    o = _t(spark, d, "orders")
    scans = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("video_id"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("running").alias("status"), (F.col("o_orderkey") % 10).alias("scan_run_id"))
    runs = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), "s_name")
    return selection.latest_unfinished(scans, runs).select("video_id", "id", "run_s_name")


_OLD = "SELECT o_custkey AS id, max(o_orderstatus) AS st, 'a' AS title, 'p' || o_custkey AS local_path, (o_custkey % 2 = 0) AS managed_download FROM orders WHERE o_custkey % 3 <> 0 GROUP BY 1"


@query(
    f"""WITH o AS (SELECT id, title, local_path, managed_download, CASE st WHEN 'F' THEN 'pending' WHEN 'O' THEN 'scanned' ELSE 'skipped' END AS status, NULL::VARCHAR AS error FROM ({_OLD})),
n AS (SELECT c_custkey AS id, 'b' AS title, 'q' AS local_path, false AS managed_download, 'failed' AS status, 'e' AS error FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(o.id, n.id) AS id, coalesce(n.title, o.title) AS title, CASE WHEN o.id IS NULL THEN n.local_path ELSE o.local_path END AS local_path, CASE WHEN o.id IS NULL THEN n.managed_download ELSE o.managed_download END AS managed_download,
CASE WHEN n.id IS NULL THEN o.status WHEN o.id IS NULL OR o.status IN ('pending', 'skipped') THEN n.status ELSE o.status END AS status,
CASE WHEN n.id IS NULL THEN o.error WHEN o.id IS NULL OR o.status IN ('pending', 'skipped') THEN n.error ELSE o.error END AS error FROM o FULL JOIN n ON o.id = n.id"""
)
def source_upsert(spark, d):
    by = _t(spark, d, "orders").filter("o_custkey % 3 <> 0").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderstatus").alias("st"))
    status = F.when(F.col("st") == "F", "pending").when(F.col("st") == "O", "scanned").otherwise("skipped")
    old = by.select("id", F.lit("a").alias("title"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("local_path"), (F.col("id") % 2 == 0).alias("managed_download"), status.alias("status"), F.lit(None).cast("string").alias("error"))
    new = _t(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.lit("b").alias("title"), F.lit("q").alias("local_path"), F.lit(False).alias("managed_download"), F.lit("failed").alias("status"), F.lit("e").alias("error"))
    return maintenance.upsert_sources(old, new)


_PATHS = """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'report/assets/' WHEN 1 THEN 'report/assets/x/' ELSE 'report/assets/' END || substr(sha256(doc_id::VARCHAR), 1, 16) || '-' || substr(sha256(doc_id::VARCHAR), 1, 32) || '/' || doc_id
|| CASE doc_id % 3 WHEN 0 THEN '-row.png' WHEN 1 THEN '-frame.jpg' ELSE '-row.png.' || substr(sha256(doc_id::VARCHAR), 1, 32) || '.tmp' END AS path FROM documents"""


def _paths(spark, d):
    i, h = F.col("doc_id").cast("string"), F.sha2(F.col("doc_id").cast("string"), 256)
    head = F.when(F.col("doc_id") % 4 == 1, "report/assets/x/").otherwise("report/assets/")
    tail = F.when(F.col("doc_id") % 3 == 0, F.lit("-row.png")).when(F.col("doc_id") % 3 == 1, F.lit("-frame.jpg")).otherwise(F.concat(F.lit("-row.png."), F.substring(h, 1, 32), F.lit(".tmp")))
    return _t(spark, d, "documents").select("doc_id", F.concat(head, F.substring(h, 1, 16), F.lit("-"), F.substring(h, 1, 32), F.lit("/"), i, tail).alias("path"))


@query(f"SELECT doc_id, doc_id % 4 <> 1 AND doc_id % 3 <> 2 AS owned, doc_id % 4 <> 1 AS swept, CASE WHEN doc_id % 7 = 0 THEN '' ELSE substr(path, 8) END AS link FROM ({_PATHS})")
def owned_paths(spark, d):
    rows = _paths(spark, d)
    p = F.col("path")
    odd = F.when(F.col("doc_id") % 14 == 0, F.concat(F.lit("/"), p)).when(F.col("doc_id") % 7 == 0, F.concat(F.lit("report/../"), p)).otherwise(p)
    return rows.select("doc_id", maintenance.is_owned(p).alias("owned"), maintenance.is_owned(p, True).alias("swept"), reports.evidence_url(odd).alias("link"))


@query(f"SELECT path FROM ({_PATHS}) WHERE doc_id % 4 <> 1 AND doc_id NOT IN (SELECT doc_id FROM labels)")
def prunable_paths(spark, d):
    rows = _paths(spark, d)
    refs = maintenance.references([(rows.join(_t(spark, d, "labels"), "doc_id", "left_semi"), ["path"])])
    return maintenance.prunable(rows.select("path"), refs, temporary=True)


@query("SELECT event_id FROM events WHERE user_id * 0.5 >= 10 AND user_id * 0.5 < 40")
def time_window(spark, d):
    return _t(spark, d, "events").filter(selection.in_window(F.col("user_id"), F.lit(0.5), 10, 40)).select("event_id")


@query("SELECT l_orderkey, sum(l_linenumber * l_quantity) AS weighted FROM lineitem GROUP BY 1")
def checked_zip(spark, d):
    order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))), lambda s: s[c])
    rows = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(order("l_linenumber").alias("a"), order("l_quantity").alias("b"))
    return rows.select("l_orderkey", F.aggregate(selection.zipped(F.col("a"), F.col("b")), F.lit(0.0), lambda s, p: s + p["first"] * p["second"]).alias("weighted"))


@query(
    """WITH g AS (SELECT vec_id, list_transform(embedding[1:8], lambda v: v::DOUBLE * 20) AS v FROM embeddings), m AS (SELECT *, list_avg(v) AS a, [abs(v[2] - v[1]), abs(v[3] - v[2]), abs(v[4] - v[3]), abs(v[6] - v[5]), abs(v[7] - v[6]), abs(v[8] - v[7])] AS s FROM g)
SELECT vec_id, sqrt(list_avg(list_transform(v, lambda x: (x - a) * (x - a)))) >= 15 AND len(list_filter(s, lambda x: x > 12)) / 6.0 >= 0.5 AS keep FROM m"""
)
def contrast_gate(spark, d):
    v = F.transform(F.slice("embedding", 1, 8), lambda e: e.cast("double") * 20)
    rows = _t(spark, d, "embeddings").select("vec_id", F.array(F.slice(v, 1, 4), F.slice(v, 5, 4)).alias("gray"))
    return rows.select("vec_id", selection.enough_contrast(F.col("gray"), 15.0, 0.5).alias("keep"))


@query("SELECT c_custkey, CASE WHEN c_custkey = 7 THEN 'new' ELSE c_name END AS c_name, CASE WHEN c_custkey = 7 THEN 1.5 ELSE c_acctbal END AS c_acctbal FROM customer")
def partial_update(spark, d):
    return maintenance.updated(_t(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), "c_custkey", 7, c_name="new", c_acctbal=1.5)


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def runs_with_scans(spark, d):
    return maintenance.without_parents(_t(spark, d, "customer").select("c_custkey"), "c_custkey", _t(spark, d, "orders").filter("o_orderstatus = 'P'"), "o_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def chunk_append(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", "o_custkey")
    return maintenance.append_chunks(o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 3 = 0"), ["o_orderkey"], ["o_custkey"])


@query(f"SELECT cluster_id, support_count, observation_id, timestamp_s FROM (SELECT user_id AS cluster_id, count(*) OVER (PARTITION BY user_id) AS support_count, event_id AS observation_id, s AS timestamp_s, max(s) OVER (PARTITION BY user_id) AS e, max(s) OVER () AS w, max(CASE WHEN user_id % 4 = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id) AS closed, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, event_id DESC) AS r FROM {_EVENTS}) WHERE r = 1 AND e >= w - 86400 AND closed = 0")
def restored_tracks(spark, d):
    e = _events(spark, d)
    clusters = e.groupBy(F.col("user_id").alias("cluster_id")).agg(F.max("s").alias("end_s"), F.count(F.lit(1)).alias("support_count"), F.max(F.when(F.col("user_id") % 4 == 1, "time_gap")).alias("close_reason"))
    seen = e.select(F.col("user_id").alias("cluster_id"), F.col("event_id").alias("observation_id"), F.col("s").alias("timestamp_s"))
    return tracking.restored(clusters, seen, e.agg(F.max("s")).first()[0], 86400.0)


@query(f"SELECT identity, x0, y0, x1, y1 FROM {_BOXES}")
def canonical_corners(spark, d):
    b = _boxes(spark, d)
    corners = {k: F.col(c) for k, c in (("x0", "x0"), ("y0", "y0"), ("x1", "x1"), ("y1", "y1"))}
    mixed = g.quad((corners["x1"], corners["y1"]), (corners["x0"], corners["y0"]), (corners["x0"], corners["y1"]), (corners["x1"], corners["y0"]))
    q = g.canonicalize(mixed)
    return b.select("identity", q[0]["x"].alias("x0"), q[0]["y"].alias("y0"), q[2]["x"].alias("x1"), q[2]["y"].alias("y1"))


@query("SELECT vec_id, vec_id // 2 AS l, 0::BIGINT AS t, vec_id AS r, (vec_id + 10) // 2 AS b FROM embeddings")
def top_right_regions(spark, d):
    left, top, right, bottom = g.top_right_region(F.col("vec_id"), F.col("vec_id") + 9)
    return _t(spark, d, "embeddings").select("vec_id", left.alias("l"), top.alias("t"), right.alias("r"), bottom.alias("b"))


@query("SELECT user_id, string_agg(event_type, '|' ORDER BY s, i) AS texts FROM (SELECT user_id, event_type, arg_min(epoch_us(ts) / 1e6, struct_pack(a := ts, b := event_id)) AS s, arg_min(event_id, struct_pack(a := ts, b := event_id)) AS i FROM events GROUP BY ALL) GROUP BY 1")
def cluster_texts(spark, d):
    seen = _events(spark, d).select(F.col("user_id").alias("cluster_id"), F.col("event_id").alias("observation_id"), F.col("s").alias("timestamp_s"), F.col("event_type").alias("raw_text"))
    return reports.ocr_strings(seen).select(F.col("cluster_id").alias("user_id"), F.array_join("ocr_strings", "|").alias("texts"))


@query()
def commit_batches(spark, d):
    rows = _events(spark, d).groupBy("user_id", "s").agg(F.sum(F.length("event_type")).alias("size"))
    return selection.commit_points(rows, "user_id", "s", "size", span=86400.0, most_rows=5, most_bytes=40)


@query("SELECT event_id, value - coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS delta FROM events")
def batch_deltas(spark, d):
    return metrics.batch_deltas(_t(spark, d, "events"), "user_id", "event_id", "value").select("event_id", "delta")


@query("SELECT o_orderstatus, round(sum(o_custkey) / sum(o_totalprice)::DOUBLE, 12) AS per_second, round(avg(o_totalprice), 6) AS mean_s, median(o_totalprice)::DOUBLE AS median_s FROM orders GROUP BY 1")
def throughput(spark, d):
    rows = metrics.throughput(_t(spark, d, "orders"), "o_orderstatus", "o_custkey", "o_totalprice")
    return rows.withColumn("per_second", F.round("per_second", 12)).withColumn("mean_s", F.round("mean_s", 6))


@query("SELECT CASE WHEN count(c_acctbal) = count(*) THEN sum(c_custkey) / sum(c_custkey * 2.0::DOUBLE) END AS rate FROM customer")
def hourly_rate(spark, d):
    return evaluation.rates(_t(spark, d, "customer").select("c_custkey", (F.col("c_custkey") * 2.0).alias("hours")), "c_custkey", "hours")


@query("SELECT a.r_name = b.r_name AS same_r_name, a.r_regionkey % 1 = b.r_regionkey % 1 AS same_kind, b.r_regionkey - a.r_regionkey AS delta_r_regionkey FROM region a, region b WHERE a.r_regionkey = 0 AND b.r_regionkey = 3")
def run_comparison(spark, d):
    r = _t(spark, d, "region")
    rows = r.select(F.col("r_regionkey").cast("string").alias("label"), "r_name", (F.col("r_regionkey") % 1).alias("kind"), "r_regionkey")
    return metrics.compare_runs(rows, "0", "3", ["r_name", "kind"], ["r_regionkey"])


@query("SELECT c_custkey, c_nationkey, n_name AS c_nationkey_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND c_nationkey <> 0")
def named_users(spark, d):
    users = _t(spark, d, "nation").filter("n_nationkey <> 0").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return files.named(_t(spark, d, "customer").select("c_custkey", "c_nationkey"), users, "c_nationkey").select("c_custkey", "c_nationkey", "c_nationkey_name")


@query("SELECT doc_id FROM documents WHERE doc_id % 90 < ceil(n_chars / 100.0 * 2 - 1e-9) - 1")
def short_reads(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", (F.col("doc_id") % 90).alias("decoded"), F.lit(0.0).alias("s"), (F.col("n_chars") / 100.0).alias("e"))
    return selection.short_reads(rows, "decoded", "s", "e", 2.0).select("doc_id")


@query(
    """SELECT event_id, value >= 20 - 1e-8 AND value < 80 - 1e-8 AS owned, greatest(0.0, floor((greatest(10.0, coalesce(value, 10.0)) - 3) * 2) / 2)::DOUBLE AS restart, least(30.0, 2.0 * pow(2.0, event_id % 7))::DOUBLE AS pause,
CASE WHEN value > 30 THEN value END AS usable FROM events"""
)
def chunk_arithmetic(spark, d):
    v = F.col("value")
    odd = F.when(v > 30, v).when(v > 20, F.lit(float("inf"))).when(v > 10, F.lit(float("nan"))).otherwise(-v)
    return _t(spark, d, "events").select(
        "event_id", selection.owned(v, F.lit(20.0), F.lit(80.0)).alias("owned"), selection.restart_offset(F.lit(10.0), v, 3.0, 2.0).cast("double").alias("restart"),
        selection.backoff(F.col("event_id") % 7).alias("pause"), catalog.usable_duration(odd).alias("usable"),
    )


@query(
    f"""SELECT identity, x0 >= 0 AND x1 <= 2 AND y0 >= 0 AND y1 <= 2 AND y1 - y0 >= 0.6 AND (identity % 10) / 10.0 BETWEEN 0.3 AND 1 AS keep FROM {_BOXES}"""
)
def acceptable_boxes(spark, d):
    q = g.box(*[F.col(c) for c in ("x0", "y0", "x1", "y1")])
    return _boxes(spark, d).select("identity", retention.acceptable(q, F.col("identity") % 10 / 10.0, F.lit(2.0), F.lit(2.0), 0.6, 0.3).alias("keep"))


@query(f"WITH {_VERSIONS} SELECT * FROM o WHERE user_id NOT IN (SELECT user_id FROM n) UNION ALL SELECT * FROM n")
def replaced_rows(spark, d):
    return maintenance.replace_rows(_version(spark, d, "click"), _version(spark, d, "view"), ["user_id"])


@query("SELECT doc_id, i::INT AS tick, 5 + i / 2.0::DOUBLE AS timestamp_s, printf('%.9f', 5 + i / 2.0::DOUBLE) AS sample_key FROM documents, LATERAL (SELECT unnest(range(greatest(0, ceil((n_chars / 50.0 - 5) * 2 - 1e-9))::INT)) AS i)")
def sample_ticks(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", F.lit(5.0).alias("s"), (F.col("n_chars") / 50.0).alias("e"))
    return selection.sample_grid(rows, "s", "e", 2.0).select("doc_id", "tick", "timestamp_s", "sample_key")


@query("SELECT l_orderkey, l_linenumber, abs(l_linenumber - (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1) / 2.0)::DOUBLE AS drift FROM lineitem QUALIFY drift > 1e-8")
def grid_drift(spark, d):
    return metrics.grid_drift(_t(spark, d, "lineitem"), "l_orderkey", "l_linenumber", 2.0).select("l_orderkey", "l_linenumber", F.col("drift").cast("double").alias("drift"))


@query("SELECT doc_id AS id, source AS title FROM documents")
def safe_fields(spark, d):
    return catalog.safe_metadata(_t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), "text", "lang"))


@query("SELECT o_orderkey AS id, CASE WHEN n IS NULL THEN 1 ELSE 2 END AS depth FROM (SELECT o_orderkey, NULL AS n FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT l_orderkey * 10 + l_linenumber, 1 FROM lineitem WHERE l_orderkey % 2 = 1)")
def nested_entries(spark, d):
    leaf = "struct<id:bigint,entries:array<struct<id:bigint>>>"
    lines = _t(spark, d, "lineitem").filter("l_orderkey % 2 = 1").groupBy("l_orderkey").agg(F.collect_list(F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))).alias("entries"))
    one = F.struct(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 1, F.col("entries")).alias("entries"))
    rows = _t(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").filter("o_orderkey % 2 = 0 OR entries IS NOT NULL")
    rows = rows.select(F.lit(0).cast("long").alias("id"), F.array(one).cast(f"array<{leaf}>").alias("entries"))
    return catalog.expand_entries(rows, "entries").select("id", "depth")
