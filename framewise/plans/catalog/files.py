"""Sources and sinks (S1, S5-S14): the driver tables are written in a format and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.operators.clouds import CLASS_TO_PUB
from framewise.operators.dims import route_by_class
from framewise.functions.arrays import argmax
from framewise.plans.registry import query, r, rs
from framewise.plans.views import Tables
from framewise.session import scratch_path
from framewise.sources import readers, writers


@query(
    "s1_read_log",
    f"SELECT event_id, camera, {rs('value')} AS value FROM v_events WHERE topic = 'view' AND ts >= TIMESTAMP '2024-01-10 00:00:00'",
    ("v_events",),
)
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "log")
    t.v_events.write.partitionBy("topic").parquet(path)
    out = readers.read_log(t.spark, path, "view", "2024-01-10 00:00:00")
    return out.select("event_id", "camera", r(F.col("value")).alias("value"))


@query("s5_read_labels", "SELECT CAST(p_partkey AS INTEGER) AS id, trim(p_name) AS name FROM part")
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "labels")
    t.part.select(F.concat(F.col("p_partkey").cast("string"), F.lit("  "), "p_name")).write.text(path)
    return readers.read_labels(t.spark, path)


@query(
    "s6_read_pairs",
    """SELECT 'wavs/' || doc_id || '.wav' AS path, md5(trim(regexp_replace(text, '[|\\s]+', ' ', 'g'))) AS digest FROM documents
    WHERE trim(regexp_replace(text, '[|\\s]+', ' ', 'g')) <> ''""",
)
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "pairs")
    flat = F.trim(F.regexp_replace("text", r"[|\s]+", " "))
    rows = t.documents.select("doc_id", flat.alias("flat")).filter("flat <> ''")
    rows.select(F.concat(F.lit("wavs/"), F.col("doc_id").cast("string"), F.lit(".wav|"), "flat")).write.text(path)
    return readers.read_pairs(t.spark, path).select("path", F.md5("text").alias("digest"))


# a file is read by one task
ANNOTATIONS = 50_000


@query(
    "s7_read_annotations",
    """SELECT 'img' || frame AS filename, 'class' || label AS name, score > 0.5e0 AS difficult, label % 2 = 1 AS truncated,
    xmin, ymin, xmax, ymax, 848 AS width, 480 AS height FROM v_det""",
    ("v_det",),
)
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "xml")

    # one annotation per object, as a frame may list any number of them
    box = F.struct(*((F.col(c) + 1).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")))
    thing = F.struct(
        F.concat(F.lit("class"), F.col("label").cast("string")).alias("name"), F.lit("Unspecified").alias("pose"),
        (F.col("label") % 2).alias("truncated"), (F.col("score") > 0.5).cast("int").alias("difficult"), box.alias("bndbox"),
    )
    size = F.struct(F.lit(848).alias("width"), F.lit(480).alias("height"), F.lit(3).alias("depth"))
    docs = t.v_det.select(
        F.concat(F.lit("img"), F.col("frame").cast("string")).alias("filename"), size.alias("size"),
        F.array(thing).alias("object"),
    )
    docs.write.format("xml").option("compression", "gzip").option("maxRecordsPerFile", ANNOTATIONS).option("rootTag", "annotations").option("rowTag", "annotation").save(path)
    return readers.read_annotations(t.spark, path)


@query(
    "s8_read_qa_json",
    """SELECT 'q' || u.conv_id || '-' || u.turn AS id, md5(u.text) AS question, md5(a.text) AS answer
    FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant'""",
)
def _(t: Tables) -> DataFrame:
    from framewise.plans.catalog.time_text import turn_pairs

    path = scratch_path(t.spark, "qa")
    rows = turn_pairs(t)
    answer = F.array(F.struct(F.col("hyp").alias("text"), F.lit(0).alias("answer_start")))
    qa = F.struct(
        F.concat(F.lit("q"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"),
        F.col("ref").alias("question"), answer.alias("answers"),
    )
    paragraph = F.struct(F.concat_ws(" ", "ref", "hyp").alias("context"), F.array(qa).alias("qas"))
    data = F.array(F.struct(F.col("conv_id").cast("string").alias("title"), F.array(paragraph).alias("paragraphs")))
    rows.select(data.alias("data")).write.json(path)
    out = readers.read_qa_json(t.spark, path, multi_line=False)
    return out.select("id", F.md5("question").alias("question"), F.md5(F.get("answers", F.lit(0))).alias("answer"))


@query(
    "s9_write_persons",
    f"""WITH p AS (SELECT person, person % 2 AS camera, person // 6 AS stamp, count(*) AS n, avg(conf) AS score FROM v_kp GROUP BY 1)
    SELECT camera, stamp, count(*) AS n_people, {rs('sum(score)')} AS score, CAST(sum(n) AS BIGINT) AS n_kps, min(person) AS first_id FROM p GROUP BY 1, 2""",
    ("v_kp",),
)
def _(t: Tables) -> DataFrame:
    rows = t.persons.select(
        (F.col("person") % 2).alias("camera"), F.floor(F.col("person") / 6).alias("stamp"), F.col("person").alias("id"),
        F.transform("kps", lambda k: F.array(k["x"], k["y"], k["conf"])).alias("keypoints"),
        (F.aggregate("kps", F.lit(0.0), lambda a, k: a + k["conf"]) / F.size("kps")).alias("score"),
        F.array(F.lit(0.0)).alias("bbox"),
    )
    out = writers.persons_to_json(rows, ["camera", "stamp"], F.col("stamp"), F.array(F.lit(0.0), F.lit(0.0)))
    # the JSON text is read back, so the check sees what was written
    shape = "timestamp long, crop_info array<double>, people array<struct<id:long,keypoints:array<array<double>>,score:double,bbox:array<double>>>"
    back = out.select("camera", "stamp", F.from_json("json", shape).alias("j"))
    return back.select(
        "camera", "stamp", F.size("j.people").cast("long").alias("n_people"),
        r(F.aggregate("j.people", F.lit(0.0), lambda a, p: a + p["score"])).alias("score"),
        F.aggregate("j.people", F.lit(0).cast("long"), lambda a, p: a + F.size(p["keypoints"])).alias("n_kps"),
        F.get("j.people", F.lit(0))["id"].alias("first_id"),
    )


@query(
    "s10_write_topic",
    "SELECT camera, topic, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM v_events WHERE topic <> 'error' GROUP BY 1, 2",
    ("v_events",),
)
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "topics")
    rows = t.v_events
    for name in ("click", "view", "purchase", "signup", "error"):
        # nobody listens to the error topic
        part = rows.filter(F.col("topic") == name).drop("topic")
        writers.write_topic(part, path, name, active=name != "error")
    back = t.spark.read.parquet(path)
    return back.groupBy(F.col("camera").cast("long").alias("camera"), "topic").agg(
        F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids")
    )


_PUB_SQL = "[" + ", ".join(map(str, CLASS_TO_PUB)) + "]"


@query(
    "s11_route_by_class",
    f"""SELECT vec_id, CAST(pub AS BIGINT) AS pub FROM (SELECT vec_id, {_PUB_SQL}[list_position(logits, list_max(logits))] AS pub FROM v_logits) WHERE pub >= 0""",
    ("v_logits",),
)
def _(t: Tables) -> DataFrame:
    dim = t.spark.createDataFrame(list(enumerate(CLASS_TO_PUB)), "label long, pub long")
    rows = t.v_logits.select("vec_id", argmax(F.col("logits")).alias("label"))
    path = scratch_path(t.spark, "routes")
    writers.write_routes(route_by_class(rows, dim), path)
    return t.spark.read.parquet(path).select("vec_id", F.col("pub").cast("long").alias("pub"))


@query(
    "s12_write_detections",
    f"SELECT label, frame, {rs('score')} AS score, {rs('xmin')} AS xmin, {rs('ymax')} AS ymax FROM v_det", ("v_det",),
)
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "classes")
    writers.write_detections(t.v_det, path)
    back = writers.read_detections(t.spark, path)
    return back.select("label", "frame", *(r(F.col(c)).alias(c) for c in ("score", "xmin", "ymax")))


@query(
    "s13_export_trace",
    f"""SELECT event_id, {rs('enqueue', 4)} AS enq_ms, {rs('compute', 4)} AS compute_ms, {rs('compute * 1.15e0', 4)} AS latency_ms FROM v_trace""",
    ("v_trace",),
)
def _(t: Tables) -> DataFrame:
    s, c = F.col("start_ms"), F.col("compute")
    marks = {
        "enq_start": s, "enq_end": s + F.col("enqueue"), "in_start": s, "in_end": s + c * 0.1,
        "compute_start": s + c * 0.1, "compute_end": s + c * 1.1, "out_start": s + c * 1.1, "out_end": s + c * 1.15,
    }
    path = scratch_path(t.spark, "trace")
    writers.export_trace(t.v_trace.select("event_id", *(v.alias(k) for k, v in marks.items())), path)
    back = t.spark.read.schema("event_id long, enq_ms double, compute_ms double, latency_ms double").json(path)
    return back.select("event_id", *(r(F.col(n), 4).alias(n) for n in ("enq_ms", "compute_ms", "latency_ms")))


@query(
    "s14_generate_inputs",
    f"""SELECT vec_id, label, {rs('(SELECT sum(x) FROM (SELECT unnest(embedding)::DOUBLE AS x))')} AS given,
      true AS repeats, true AS in_range, 64 AS n_float, 8 AS n_int FROM embeddings""",
)
def _(t: Tables) -> DataFrame:
    # an iteration of inputs for each vector, generated twice under different partitionings
    rows = t.embeddings.select("vec_id", "label", F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x).alias("given"))
    n = (rows.agg(F.max("vec_id")).first()[0] or 0) + 1
    schema = {"f": ("float", 64), "i": ("int", 8)}
    low, high = F.when(F.col("output") == "f", -1.0).otherwise(1.0), F.when(F.col("output") == "f", 1.0).otherwise(25.0)

    def digests(parts: int, suffix: str) -> DataFrame:
        out = readers.generate_inputs(t.spark, schema, n, seed=7).repartition(parts, "idx", "output")
        return out.groupBy(F.col("iteration").alias("vec_id")).agg(
            F.bit_xor(F.xxhash64("output", "idx", "val")).alias(f"d{suffix}"),
            F.bool_and(F.col("val").between(low, high)).alias(f"ok{suffix}"),
            F.count(F.when(F.col("output") == "f", 1)).cast("int").alias(f"f{suffix}"),
            F.count(F.when(F.col("output") == "i", 1)).cast("int").alias(f"i{suffix}"),
        )

    both = rows.join(digests(3, "1"), "vec_id").join(digests(7, "2"), "vec_id")
    return both.select(
        "vec_id", "label", r(F.col("given")).alias("given"), (F.col("d1") == F.col("d2")).alias("repeats"),
        (F.col("ok1") & F.col("ok2")).alias("in_range"), F.col("f1").alias("n_float"), F.col("i2").alias("n_int"),
    )
