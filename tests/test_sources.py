"""Files: SRT, WebVTT, model responses, media, logs and job records."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cuelake.operators import merge
from cuelake.sources import files, srt

GOOD = "1\n00:00:01,000 --> 00:00:02,500\nHello\n\n2\n00:00:03,000 --> 00:00:04,000\nTwo\nlines\n"


def texts(spark, **contents):
    return spark.createDataFrame(list(contents.items()), "name string, content string")


def test_lenient_accepts_what_files_have(spark):
    f = texts(
        spark, good=GOOD, bom="﻿" + GOOD.replace("\n", "\r\n"), dots="1\n0:00:01.5 --> 0:00:02.25\nx", empty="", no_number="00:00:01,000 --> 00:00:02,000\nx",
        blank_text="1\n00:00:01,000 --> 00:00:02,000\n \n\n2\n00:00:01,000 --> 00:00:02,000\ny", vtt="WEBVTT\n\n00:00:01.000 --> 00:00:02.000\nx")
    rows = {}
    for r in srt.srt_ingest(f).orderBy("name", "pos").collect():
        rows.setdefault(r["name"], []).append((r["seq"], r["start_ms"], r["end_ms"], r["text"]))
    assert rows["good"] == rows["bom"] == [(1, 1000, 2500, "Hello"), (2, 3000, 4000, "Two\nlines")]
    assert rows["dots"] == [(1, 1500, 2250, "x")] and rows["blank_text"] == [(2, 1000, 2000, "y")]
    assert set(rows) == {"good", "bom", "dots", "blank_text"}


def test_plain_needs_times_and_text_only(spark):
    f = texts(spark, good=GOOD.replace("\n", "\r\n"), odd="cue one\n0:00:01.5 --> 00:00:02,25 x:1\nx\n\n \nno\n\n7\n00:00:03,000-->00:00:04,000\ny\n\n\nz\n00:00:05,000 --> bad\nw", empty="", hours="1\n100:00:01,000 --> 100:00:02,000\nx")
    rows = {}
    for r in srt.srt_ingest(f, "plain").orderBy("name", "pos").collect():
        rows.setdefault(r["name"], []).append((r["seq"], r["start_ms"], r["end_ms"], r["text"]))
    assert rows == {"good": [(1, 1000, 2500, "Hello"), (2, 3000, 4000, "Two\nlines")], "odd": [(1, 1500, 2250, "x"), (2, 3000, 4000, "y")]}


def test_strict_refuses_with_reasons(spark):
    f = texts(spark, good=GOOD, dots="1\n00:00:01.000 --> 00:00:02.000\nx", few="1\n00:00:01,000 --> 00:00:02,000", number="one\n00:00:01,000 --> 00:00:02,000\nx")
    cues, rejects = srt.srt_ingest_strict(f)
    assert {r["name"] for r in cues.collect()} == {"good"}
    assert {(r["name"], r["reason"]) for r in rejects.collect()} == {("dots", "bad times"), ("few", "too few lines"), ("number", "bad number")}
    with pytest.raises(ValueError):
        srt.srt_ingest(f, "other")


def test_repair(spark):
    body = "```srt\n1\n00:00:01,000 --> 00:00:02,000\nOne\n2\n00:00:03,000 --> 00:00:04,000\nTwo\n42\n\nmore\n```\nThat is all."
    rows = [("fenced", body), ("bare", GOOD), ("empty", ""), ("talk", "no subtitles here")]
    got = {}
    for r in srt.repair_responses(spark.createDataFrame(rows, "unit string, body string")).orderBy("unit", "block").collect():
        got.setdefault(r["unit"], []).append((r["seq"], r["text"]))
    assert got == {"fenced": [(1, "One"), (2, "Two\n42\nmore")], "bare": [(1, "Hello"), (2, "Two\nlines")]}
    joined = srt.repair_responses(spark.createDataFrame(rows[:1], "unit string, body string"), strict_compat=True).collect()
    assert [r["seq"] for r in joined] == [1]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 359_979_999), st.integers(1, 20_000)), min_size=1, max_size=20))
def test_round_trip(spark, times):
    rows = [(1, "eng", False, i + 1, s, s + d, f"cue {i}") for i, (s, d) in enumerate(times)]
    cues = spark.createDataFrame(rows, "media_id long, language string, sdh boolean, seq int, start_ms long, end_ms long, text string")
    for back in (srt.srt_ingest(srt.srt_render(cues)), srt.srt_ingest(srt.srt_render(cues), "strict")):
        assert sorted((r["seq"], r["start_ms"], r["end_ms"], r["text"]) for r in back.collect()) == [r[3:] for r in rows]
    vtt = srt.vtt_render(cues).first()["content"]
    assert vtt.startswith("WEBVTT\n\n") and vtt.count(" --> ") == len(rows)


def test_times_from_a_hundred_hours(spark):
    rows = [(1, "eng", False, 1, 359_999_999, 360_000_000, "late"), (1, "eng", False, 2, 359_999_000, 359_999_999, "last")]
    cues = spark.createDataFrame(rows, "media_id long, language string, sdh boolean, seq int, start_ms long, end_ms long, text string")
    text = srt.srt_render(cues)
    assert sorted((r["start_ms"], r["end_ms"]) for r in srt.srt_ingest(text).collect()) == sorted(r[4:6] for r in rows)
    accepted, refused = srt.srt_ingest_strict(text)
    assert [r["seq"] for r in accepted.collect()] == [2] and [r["reason"] for r in refused.collect()] == ["bad times"]


def test_folder_of_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.srt").write_text(GOOD)
    (tmp_path / "a" / "x.vtt").write_text("WEBVTT")
    assert srt.srt_ingest(srt.read_files(spark, str(tmp_path)).select("path", "content")).count() == 2
    for name in ("m.MKV", "n.mp4", "o.txt"):
        (tmp_path / name).write_bytes(b"1234")
    got = {(r["name"], r["format"], r["size_bytes"]) for r in files.media_inventory(spark, str(tmp_path)).collect()}
    assert got == {("m.MKV", "mkv", 4), ("n.mp4", "mp4", 4)}
    cues = spark.createDataFrame([(1, "eng", False, 1, 0, 10, "x")], "media_id long, language string, sdh boolean, seq int, start_ms long, end_ms long, text string")
    srt.write_srt(srt.srt_render(cues), str(tmp_path / "out"))
    assert list((tmp_path / "out").glob("language=eng/sdh=false/*.txt"))


def test_logs_and_jobs(spark, tmp_path):
    (tmp_path / "app.log").write_text('{"timestamp": "2024-01-15T10:30:00Z", "level": "INFO", "message": "m", "duration_ms": 5.5, "context": {"a": "1"}}\nnot json\n{"level": "ERROR", "message": "n"}\n')
    rows = files.log_ingest(spark, str(tmp_path / "app.log")).cache().collect()
    assert len(rows) == 3 and [r["_corrupt_record"] for r in rows].count("not json") == 1 and rows[0]["context"] == {"a": "1"}
    (tmp_path / "jobs").mkdir()
    (tmp_path / "jobs" / "job_1.json").write_text(json.dumps({"job_id": "1", "video_path": "v.mp4", "languages": ["eng"], "current_stage": 3, "created_at": 1.5, "metadata": {"k": "v"}}, indent=1))
    (tmp_path / "jobs" / "job_2.json").write_text("{broken")
    (tmp_path / "jobs" / "job_1.json.bak").write_text(json.dumps({"job_id": "bak"}))
    got = files.job_state_ingest(spark, str(tmp_path / "jobs")).collect()
    assert [(r["job_id"], r["stage"], r["languages"]) for r in got] == [("1", 3, ["eng"])]


def test_merge_of_more_than_a_thousand_chunks(spark):
    rows = [(1, "eng", False, k, 1, 500, 900, f"c{k}") for k in range(1200)]
    cues = spark.createDataFrame(rows, "media_id long, language string, sdh boolean, chunk_no int, seq int, start_ms long, end_ms long, text string")
    out = merge.merge_chunks(cues).orderBy("seq").collect()
    assert [r["seq"] for r in out] == list(range(1, 1201)) and out[1100]["start_ms"] == 1100 * 60_000 + 500
