"""Sources and sinks: what is written is read again; files of all shapes the readers know."""

import json
import struct
from dataclasses import dataclass, field

import pytest
from pyspark.sql import functions as F

from wayfold import sinks, sources
from wayfold.functions import calibration


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_csv_scan_by_name_and_stem(spark, tmp_path):
    head = "frame.number,frame.time_epoch,frame.time_relative,frame.len,rtp.seq,rtp.timestamp,rtp.marker,extra\n"
    put(tmp_path / "a" / "2026_run_camera_7_x.csv", head + "1,10.5,0.0,100,,,1,q\n2,10.6,bad,120,,,0,q\n3,10.7,0.2,,,,True,q\n")
    put(tmp_path / "b" / "odd.csv", "frame.len,frame.time_relative\n5,0.5\n6,0.25\n6,0.25\n")
    rows = sources.scan_csv(spark, str(tmp_path), sources.PACKETS)
    got = {(r["camera_id"], r["run"]): r for r in rows.select("camera_id", "run", "sequence").distinct().collect()}
    assert set(got) == {("7", "2026_run"), ("odd", "odd")}
    clean = sources.clean_packets(sources.scan_csv(spark, str(tmp_path / "b"), sources.PACKETS), ["sequence"])
    assert [(r.row_idx, r.t_s, r.frame_len) for r in clean.orderBy("row_idx").collect()] == [(1, 0.25, 6.0), (2, 0.25, 6.0), (3, 0.5, 5.0)]
    assert sources.clean_packets(sources.scan_csv(spark, str(tmp_path / "a"), sources.PACKETS), ["sequence"]).count() == 1
    cams = spark.createDataFrame([("1",), ("2",), ("3",)], "camera_id string")
    ids = lambda df: sorted(r.camera_id for r in df.collect())
    assert ids(sources.select_cameras(cams)) == ["1", "2", "3"]
    assert ids(sources.select_cameras(cams, ["1", "2"], ["2"])) == ["1"] and ids(sources.select_cameras(cams, exclude=["2"])) == ["1", "3"]


def test_documents(spark, tmp_path):
    sensors = spark.createDataFrame([("P00", "perimeter", 1.0, 2.0, 15.0, 3, None), ("I00", "interior", 5.0, 6.0, 25.0, None, 9)], "sensor_id string, role string, x double, y double, fov_radius double, edge_idx bigint, node_id bigint")
    path = str(tmp_path / "sensors.json")
    sinks.save_sensors(sensors, path, seed=42)
    assert json.loads((tmp_path / "sensors.json").read_text())["n_interior"] == 1
    assert sorted(sources.read_sensors(spark, path).collect()) == sorted(sensors.collect())
    put(tmp_path / "params.json", json.dumps({"random_seed": 1, "camera_params": {"4": {"pos": [1, 2, 3], "rot": [-60, 90, 0]}}}))
    r = sources.read_cameras(spark, str(tmp_path / "params.json")).first()
    assert (r.camera_id, r.x, r.z, r.pitch, r.yaw, r.extent_x) == ("4", 1.0, 3.0, -60.0, 90.0, None)
    put(tmp_path / "model.json", json.dumps({"false_negative_rate": "TODO", "false_positive_rate": 0.1, "apply_timing_bias": True, "per_camera": {"I01": {"false_negative_rate": 0.3, "timing_bias_s": "todo"}}}))
    rates, cams = sources.read_observation_model(spark, str(tmp_path / "model.json"))
    r = rates.first()
    assert (r.false_negative_rate, r.false_positive_rate, r.timing_bias_s, r.apply_timing_bias, r.source) == (None, 0.1, None, True, "uncalibrated")
    assert {(c.camera_id, c.name, c.value) for c in cams.collect()} == {("I01", "false_negative_rate", 0.3), ("I01", "timing_bias_s", None)}


@dataclass
class Config:
    dt: float = 0.25
    n: int = 120
    region: list = field(default_factory=list)
    name: str = "x"


def test_configuration_and_cache(spark, tmp_path):
    put(tmp_path / "c.yaml", "dt: 0.5  # seconds\nregion: [-1.0, 1, 2]\nname: town\nunknown: 3\n")
    got = sources.read_config(spark, str(tmp_path / "c.yaml"), Config(), n=7, other=1)
    assert got == Config(0.5, 7, [-1.0, 1, 2], "town") and sources.read_config(spark, None, Config()) == Config()
    built = []

    def build(s, config):
        built.append(config)
        return s.range(config["n"])

    a = sources.cached_dataset(spark, str(tmp_path / "cache"), {"n": 3, "b": 1}, build)
    b = sources.cached_dataset(spark, str(tmp_path / "cache"), {"b": 1, "n": 3}, build)
    assert a.count() == b.count() == 3 and len(built) == 1
    assert sources.cached_dataset(spark, str(tmp_path / "cache"), {"n": 4, "b": 1}, build).count() == 4


def test_captures(spark, tmp_path):
    def frame(sender, marker, stamp, udp=True):
        rtp = bytes([0x80, 96 | marker << 7]) + struct.pack(">HII", 5, stamp, 77)
        ip = bytes([0x45]) + bytes(8) + bytes([17 if udp else 6]) + bytes(10)
        return bytes(6) + bytes.fromhex(sender) + b"\x08\x00" + ip + bytes(8) + rtp

    frames = [frame("aabbccddeeff", 0, 1), frame("aabbccddeeff", 1, 9), frame("001122334455", 1, 9), frame("aabbccddeeff", 1, 9), frame("aabbccddeeff", 0, 3, udp=False)]
    body = b"".join(struct.pack("<IIII", 100 + i, 500_000, len(f), len(f)) + f for i, f in enumerate(frames))
    (tmp_path / "one.pcap").write_bytes(b"\xd4\xc3\xb2\xa1" + bytes(20) + body)
    got = sources.read_captures(spark, str(tmp_path), "aa:bb:cc:dd:ee:ff", skip=1).orderBy("frame_number").collect()
    assert [(r.frame_number, r.time_epoch, r.ssrc, r.marker) for r in got] == [(2, 101.5, 77, True), (4, 103.5, 77, True), (5, 104.5, None, None)]
    every = sources.read_captures(spark, str(tmp_path))
    assert [(r.ssrc, r.n, r.markers, r.times) for r in sources.rtp_streams(every).collect()] == [(77, 4, 3, 2)]
    assert [(r.rtp_timestamp, r.n) for r in sources.repeated_markers(every, 1).collect()] == [(9, 3)]


def test_results_and_rewrite(spark, tmp_path):
    doc = sinks.save_results(spark.range(5), str(tmp_path / "res"), note="x", python="mine")
    assert doc["n_rows"] == 5 and doc["python"] == "mine" and json.loads((tmp_path / "res.meta.json").read_text())["note"] == "x"
    put(tmp_path / "t" / "p.csv", "x,car_visible,y\n1.50,true,0.10\n2.0,0,3e1\n")
    path = str(tmp_path / "t")
    read = lambda: spark.read.option("header", True).csv(path)
    assert sinks.rewrite_column(read(), path, "car_visible", F.col("car_visible").isin("true", "1"))["wrote"] is False
    stats = sinks.rewrite_column(read(), path, "car_visible", F.lit(True))
    assert stats == {"rows": 2, "true_old": 1, "true_new": 2, "flipped": 1, "wrote": True}
    assert sorted(tuple(r) for r in read().collect()) == [("1.50", "True", "0.10"), ("2.0", "True", "3e1")]


def test_exports(spark, tmp_path):
    d = spark.createDataFrame([("r1_camera_1_x", 5, 0.5), ("r1_camera_1_x", 2, None), ("r2_camera_1_x", 9, 0.25)], "sequence string, frame_number bigint, confidence double")
    found = spark.createDataFrame([("r1_camera_1_x", 2, 90, 1), ("r2_camera_1_x", 1, 80, 1)], "s string, num_detections bigint, num_truth_frames bigint, first_frame bigint")
    index = sinks.export_index(found, F.col("s"), F.lit("1"), "frame", merge_gap_s=2.0)
    sinks.export_passages(d, index, str(tmp_path / "flat"))
    text = next((tmp_path / "flat" / "x" / "sequence=r1_camera_1_x").glob("*.csv")).read_text().splitlines()
    assert text[0] == "frame_number,confidence" and [x.split(",")[0] for x in text[1:]] == ["2", "5"]
    sinks.export_by_run(d, index, str(tmp_path / "runs"))
    assert sorted(p.name for p in (tmp_path / "runs" / "x").glob("run=*")) == ["run=r1", "run=r2"]
    r = sinks.by_run(index).orderBy("run").first()
    assert (r.run, r.x_csv, r.y_csv) == ("r1", "r1/x/r1_camera_1_x.csv", "r1/y/r1_camera_1_x_truth.csv")


def test_calibration():
    model = {"false_negative_rate": 0.0, "false_positive_rate": 0.02, "timing_jitter_std_s": 0.1}
    profile = {"profile": "p", "status": "final", "evaluation": {"event_level": True}, "simulation": model | {"timing_jitter_provenance": "measured"}}
    assert calibration.simulation_rates(profile, model) == model
    calibration.assert_reportable(profile)
    for bad in (profile | {"evaluation": {}}, profile | {"simulation": {}}, profile | {"simulation": model | {"false_positive_rate": 0.03}}):
        with pytest.raises(calibration.CalibrationError):
            calibration.simulation_rates(bad, model)
    with pytest.raises(calibration.CalibrationError):
        calibration.simulation_rates(profile, model | {"timing_jitter_std_s": "TODO"})
    with pytest.raises(calibration.CalibrationError, match="not final, not at event level, jitter not measured"):
        calibration.assert_reportable({"profile": "q"})
    assert calibration.simulation_rates(profile | {"evaluation": {}}, model, event_level_only=False) == model
    assert calibration.active_profile() == "dnn_event_v3" and calibration.active_profile("z") == "z" and calibration.active_profile(active_document='{"active_profile": "a"}') == "a"
