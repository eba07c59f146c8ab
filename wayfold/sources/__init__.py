"""Sources: capture and truth CSV by fixed schemas, directory scans keyed by file stem, JSON documents, configuration,
packet captures, and datasets cached by the hash of their configuration. Everything is read by Spark, so a path may lie
in any store the cluster reads."""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Callable
from dataclasses import fields, is_dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: File layouts.
PACKETS = "`frame.number` bigint, `frame.time_epoch` double, `frame.time_relative` double, `frame.len` bigint, `rtp.seq` string, `rtp.timestamp` string, `rtp.marker` string"
PREDICTED_PACKETS = PACKETS.replace("`rtp.marker` string", "`rtp.marker.original` string, prob float, pred_marker string")
FRAMES = "video_frame_index bigint, packet_count bigint, combined_frame_len_bytes bigint, frame_time_relative_first double, frame_time_relative_last double, frame_time_span double, frame_number_first bigint, frame_number_last bigint, rtp_seq_first string, rtp_seq_last string, rtp_timestamp_first string, rtp_timestamp_last string, frame_time_epoch_first double, frame_time_epoch_last double"
PREDICTIONS = FRAMES + ", car_visible_prob double, speed_pred double"
TRUTH = "x double, y double, z double, theta1 double, theta2 double, theta3 double, vx double, vy double, vz double, speed double, car_visible string"
EVENTS = "timestamp double, sensor_id string, sensor_x double, sensor_y double, event_type string, source string, vehicle_id bigint, confidence double, is_ghost boolean, true_timestamp double, t_enter double, t_exit double"


def scan_csv(spark: SparkSession, path: str, schema: str, suffix: str = "") -> DataFrame:
    """CSV files under a path by an explicit schema; ``sequence`` is the file stem without ``suffix``, with the camera and
    run read from it. Columns are taken by name: files may hold others, in any order."""
    names = [f.name for f in spark.createDataFrame([], schema).schema]
    raw = spark.read.option("recursiveFileLookup", True).option("header", True).option("enforceSchema", False)
    probe = raw.csv(path)  # header only
    text = ", ".join(f"`{c}` string" for c in probe.columns)
    rows = raw.schema(text).csv(path).withColumn("_stem", F.regexp_replace(F.regexp_extract("_metadata.file_name", r"^(.*)\.csv$", 1), f"{suffix}$", ""))
    types = {f.name: f.dataType.simpleString() for f in spark.createDataFrame([], schema).schema}
    value = lambda c: F.col(f"`{c}`").try_cast(types[c]).alias(c) if c in probe.columns else F.lit(None).cast(types[c]).alias(c)
    return rows.select(F.col("_stem").alias("sequence"), camera_id(F.col("_stem")).alias("camera_id"), run_key(F.col("_stem")).alias("run"), *[value(c) for c in names])


def camera_id(stem) -> F.Column:
    """The number between ``_camera_`` and the next bar, else the whole stem."""
    return F.coalesce(F.nullif(F.regexp_extract(stem, r"_camera_(\d+)_", 1), F.lit("")), stem)


def run_key(stem) -> F.Column:
    return F.substring_index(stem, "_camera_", 1)


def select_cameras(df: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, column: str = "camera_id") -> DataFrame:
    """Cameras of the include list, then without those of the exclude list; an empty list does nothing."""
    if include:
        df = df.filter(F.col(column).isin(include))
    if exclude:
        df = df.filter(~F.col(column).isin(exclude))
    return df


def clean_packets(df: DataFrame, keys: list[str], time: str = "frame.time_relative", size: str = "frame.len") -> DataFrame:
    """Rows with a time and a size that are numbers, with ``row_idx`` from 1 in order of time (file order in ties)."""
    from pyspark.sql.window import Window

    ok = df.withColumns({"_t": F.col(f"`{time}`").try_cast("double"), "_n": F.col(f"`{size}`").try_cast("double"), "_at": F.monotonically_increasing_id()})
    ok = ok.filter("_t is not null and not isnan(_t) and _n is not null and not isnan(_n)")
    w = Window.partitionBy(*keys).orderBy("_t", "_at")
    return ok.withColumn("row_idx", F.row_number().over(w).cast("bigint")).withColumns({"t_s": F.col("_t"), "frame_len": F.col("_n")}).drop("_t", "_n", "_at")


# --- documents ---------------------------------------------------------------------------------------------------------


def _text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first().value


def number(c) -> F.Column:
    """A number; null for text such as the placeholder TODO."""
    return F.when(F.upper(F.trim(c.cast("string"))) != "TODO", c.try_cast("double"))


def read_sensors(spark: SparkSession, path: str) -> DataFrame:
    """(sensor_id, role, x, y, fov_radius, edge_idx, node_id) of sensor documents."""
    schema = "sensors array<struct<sensor_id:string,role:string,x:double,y:double,fov_radius:double,edge_idx:bigint,node_id:bigint>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.inline("sensors"))


def read_cameras(spark: SparkSession, path: str) -> DataFrame:
    """(camera_id, x, y, z, pitch, yaw, roll, run vehicle box) of run folders' parameter documents."""
    schema = "random_seed bigint, total_frames bigint, camera_params map<string,struct<pos:array<double>,rot:array<double>>>, vehicle_bounding_box struct<extent_x:double,extent_y:double,offset_x:double,offset_y:double>"
    doc = spark.read.schema(schema).json(path, multiLine=True)
    c = doc.select("vehicle_bounding_box.*", F.explode("camera_params").alias("camera_id", "p"))
    at = lambda f, k, name: F.col(f"p.{f}")[k].alias(name)
    return c.select("camera_id", at("pos", 0, "x"), at("pos", 1, "y"), at("pos", 2, "z"), at("rot", 0, "pitch"), at("rot", 1, "yaw"), at("rot", 2, "roll"), "extent_x", "extent_y", "offset_x", "offset_y")


def read_observation_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rates, per camera): one row of rates with placeholders as null, and (camera_id, name, value) overrides."""
    text = spark.read.text(path, wholetext=True)
    get = lambda k: F.get_json_object("value", f"$.{k}")
    rates = text.select(*[number(get(k)).alias(k) for k in ("false_negative_rate", "false_positive_rate", "timing_jitter_std_s", "timing_bias_s")], F.coalesce(get("apply_timing_bias") == "true", F.lit(False)).alias("apply_timing_bias"), F.coalesce(get("source"), F.lit("uncalibrated")).alias("source"))
    cams = text.select(F.explode(F.from_json(get("per_camera"), "map<string,map<string,string>>")).alias("camera_id", "m")).select("camera_id", F.explode("m").alias("name", "v"))
    return rates, cams.select("camera_id", "name", number(F.col("v")).alias("value"))


def read_config(spark: SparkSession, path: str | None, default, **overrides):
    """A dataclass instance from a YAML file of scalars and flat lists; overrides win, unknown keys go."""
    if not is_dataclass(default):
        raise TypeError("default must be a dataclass instance")
    got = plain_yaml(_text(spark, path)) if path else {}
    known = {f.name for f in fields(default)}
    return type(default)(**{**default.__dict__, **{k: v for k, v in {**got, **overrides}.items() if k in known}})


def plain_yaml(text: str) -> dict:
    """``key: value`` lines: numbers, flat lists of numbers, text; comments and blank values are left out."""
    try:
        import yaml
    except ImportError:
        out = {}
        for line in text.splitlines():
            key, colon, value = (x.strip() for x in line.partition("#")[0].partition(":"))
            if colon and value:
                try:
                    out[key] = json.loads(value)
                except json.JSONDecodeError:
                    out[key] = value
        return out
    return yaml.safe_load(text) or {}


def cached_dataset(spark: SparkSession, root: str, config: dict, build: Callable[[SparkSession, dict], DataFrame]) -> DataFrame:
    """The table of a configuration, built once: a Parquet folder named by the first 12 hex digits of the SHA-1 of the
    configuration as JSON with sorted keys."""
    path = f"{root}/{hashlib.sha1(json.dumps(config, sort_keys=True).encode()).hexdigest()[:12]}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        build(spark, config).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


# --- packet captures -----------------------------------------------------------------------------------------------------

CAPTURE = "path string, frame_number bigint, time_epoch double, frame_len bigint, ssrc bigint, rtp_seq int, rtp_timestamp bigint, marker boolean"


def read_captures(spark: SparkSession, path: str, transmitter: str | None = None, skip: int = 0) -> DataFrame:
    """Packets of libpcap files (Ethernet, IPv4, UDP, RTP), a task for each file; null RTP fields where a packet has none.
    ``skip`` leaves out that many first packets of each file (handshakes), before the filter on the sender's address."""
    sender = bytes.fromhex(transmitter.replace(":", "")) if transmitter else None

    def packets(data: bytes):
        order = "<" if data[:4] in (b"\xd4\xc3\xb2\xa1", b"\x4d\x3c\xb2\xa1") else ">"
        tick = 1e-9 if data[:4] in (b"\x4d\x3c\xb2\xa1", b"\xa1\xb2\x3c\x4d") else 1e-6
        at, n = 24, 0
        while at + 16 <= len(data):
            sec, part, held, size = struct.unpack_from(f"{order}IIII", data, at)
            frame, at, n = data[at + 16 : at + 16 + held], at + 16 + held, n + 1
            if n <= skip or sender and frame[6:12] != sender:
                continue
            rtp = (None, None, None, None)
            if frame[12:14] == b"\x08\x00" and len(frame) > 34 and frame[23] == 17:
                body = 14 + (frame[14] & 15) * 4 + 8
                if len(frame) >= body + 12 and frame[body] >> 6 == 2:
                    seq, stamp, source = struct.unpack_from(">HII", frame, body + 2)
                    rtp = (source, seq, stamp, bool(frame[body + 1] >> 7))
            yield (n, sec + part * tick, size, *rtp)

    def rows(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = list(packets(data))
                if found:
                    yield pa.RecordBatch.from_pydict({c.split()[0]: v for c, v in zip(CAPTURE.split(", "), ([name] * len(found), *map(list, zip(*found))))}, pa.schema([("path", pa.string()), ("frame_number", pa.int64()), ("time_epoch", pa.float64()), ("frame_len", pa.int64()), ("ssrc", pa.int64()), ("rtp_seq", pa.int32()), ("rtp_timestamp", pa.int64()), ("marker", pa.bool_())]))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(rows, CAPTURE)


def rtp_streams(packets: DataFrame) -> DataFrame:
    """Packets, markers and distinct media times of each stream, largest first."""
    return packets.filter("ssrc is not null").groupBy("path", "ssrc").agg(F.count("*").alias("n"), F.count_if("marker").alias("markers"), F.count_distinct("rtp_timestamp").alias("times")).orderBy(F.desc("n"), "ssrc")


def repeated_markers(packets: DataFrame, k: int = 10) -> DataFrame:
    """Media times with the most marker packets: count descending, then time ascending."""
    return packets.filter("marker").groupBy("rtp_timestamp").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rtp_timestamp").limit(k)
