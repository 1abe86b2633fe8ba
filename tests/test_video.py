"""Video checks: benchmark files, judges, references, first frames."""

import base64
import json
import struct

import pytest

from graingrid.operators import video
from graingrid.operators.model import FakeBackend


def test_benchmark_files_in_both_layouts(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a_results.json").write_text(json.dumps({"motion_smoothness": [0.5, [{"video_path": "/x/v1.mp4", "video_results": 0.25}, {"video_path": "/x/v2.b.mp4", "video_results": True}, {"video_path": None, "video_results": 1}, "odd"]], "info": "text"}))
    (tmp_path / "deep" / "b.json").write_text(json.dumps({"motion_smoothness": {"results": {"/y/v1.mp4": 0.75, "mean": 0.5, "average": 1}}, "dynamic_degree": {"results": {"v3.mp4": 3}}}))
    (tmp_path / "c.json").write_text("{broken")
    (tmp_path / "d.json").write_text("[1]")
    got = {(r.dimension, r.stem): r.score for r in video.bench_scores(spark, str(tmp_path)).collect()}
    assert got == {("motion_smoothness", "v1"): 0.75, ("motion_smoothness", "v2.b"): 1.0, ("dynamic_degree", "v3"): 3.0}
    rows = spark.createDataFrame([("1", ["/z/v1.mp4"]), ("2", ["https://w/v1.mp4"]), ("3", []), ("4", ["file:///q/v9.mp4"])], "id string, video_urls array<string>")
    out = video.check_videos(rows, [video.bench_checker(str(tmp_path))]).collect()
    assert {r.id: r.vbench_motion_smoothness for r in out} == {"1": 0.75, "2": None, "3": None, "4": None}
    (tmp_path / "empty").mkdir()
    out = video.check_videos(rows, [video.bench_checker(str(tmp_path / "empty"))]).first()
    assert "no scores" in out.vbench_skipped_reason and out.vbench_dynamic_degree is None


def test_a_judge_leaves_what_it_could_not_judge(spark, tmp_path):
    (tmp_path / "v.mp4").write_bytes(b"video")
    rows = spark.createDataFrame(
        [("1", "p1", ["https://v/1.mp4"], None, 7), ("2", "p2", [str(tmp_path / "v.mp4")], None, 7), ("3", "p3", [str(tmp_path / "gone.mp4")], None, 7), ("4", "bad", ["https://v/4.mp4"], None, 7), ("5", "p5", ["/x"], ["https://r/5.mp4"], 7)],
        "id string, prompt string, video_urls array<string>, video_remote_urls array<string>, motion_quality int",
    )

    def answer(r):
        if "bad" in r.user:
            return "{}" if r.index else "no"
        media = [p for p in r.messages[-1]["content"] if p["type"] == "image_url"]
        return json.dumps({"dimension_judgments": [{"dimension": "motion_quality", "score": 3, "confidence": 1, "reason": media[0]["image_url"]["url"]}]})

    out = {r.id: r for r in video.check_videos(rows, [video.whole_checker(lambda: FakeBackend(answer), retries=1)]).collect()}
    assert {i: r.motion_quality for i, r in out.items()} == {"1": 3, "2": 3, "3": 7, "4": None, "5": 3}
    assert out["2"].motion_quality_reason == "data:video/mp4;base64," + base64.b64encode(b"video").decode() and out["5"].motion_quality_reason == "https://r/5.mp4"
    with pytest.raises(ValueError):
        video.whole_checker(None, transport="mail")
    with pytest.raises(ValueError):
        video.check_videos(rows, [])
    chain = [video.frame_checker(None), video.whole_checker(None), video.frame_checker(None, ["visual_quality", "x"])]
    assert video.metric_union(chain)[:2] == ["prompt_consistency", "prompt_consistency_confidence"] and len(video.metric_union(chain)) == 21


PNG = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", 640, 360)
JPG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 300, 1200) + b"\x03"


def test_sizes_of_images():
    assert video.image_size(PNG) == (640, 360) and video.image_size(JPG) == (1200, 300)
    assert video.image_size(b"GIF89a" + struct.pack("<HH", 5, 6)) == (5, 6)
    assert video.image_size(b"BM" + b"\0" * 16 + struct.pack("<ii", 7, -8)) == (7, 8)
    assert video.image_size(b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")) == (100, 50)
    assert video.image_size(b"RIFF\0\0\0\0WEBPVP8L\0\0\0\0\x2f" + (99 | 49 << 14).to_bytes(4, "little") + b"\0" * 8) == (100, 50)
    assert video.image_size(b"text") is None and video.image_size(b"\xff\xd8\xff") is None


def test_first_frames(spark, tmp_path):
    (tmp_path / "w.jpg").write_bytes(JPG)
    rows = spark.createDataFrame([("ok", "data:image/png;base64," + base64.b64encode(PNG).decode()), ("wide", str(tmp_path / "w.jpg")), ("web", "https://x"), ("none", None), ("gone", "/no/file"), ("odd", "data:image/png;base64,AA==")], "id string, first_frame_image string")
    ids = lambda df: {r.id for r in df.collect()}
    assert ids(video.check_first_frames(rows, "skip")) == {"ok", "web", "none", "gone", "odd"}
    assert ids(video.check_first_frames(rows, "skip", min_edge=500)) == {"web", "none", "gone", "odd"}
    assert {r.id: r.frame_warning for r in video.check_first_frames(rows, "warn").collect() if r.frame_warning} == {"wide": "1200x300"}
    assert video.check_first_frames(rows).columns == rows.columns
    with pytest.raises(Exception, match="1200x300"):
        video.check_first_frames(rows, "raise").collect()
    with pytest.raises(ValueError):
        video.check_first_frames(rows, "maybe")
