import json
from pathlib import Path

import zstandard

from ledgerspark.operators.requests import own_requests, sessions_of
from ledgerspark.sources import assistant_logs, rollouts


def assistant(i, message, request, usage, content, t, model="model-a", **more):
    return {"type": "assistant", "uuid": f"u{i}", "timestamp": f"2026-01-02T03:04:{t:02d}.000Z", "sessionId": "s1", "cwd": "/w/app", "requestId": request, "message": {"id": message, "model": model, "content": content, "usage": usage}} | more


def user(content, t):
    return {"type": "user", "timestamp": f"2026-01-02T03:04:{t:02d}.000Z", "sessionId": "s1", "cwd": "/w/app", "message": {"content": content}}


def write(path: Path, lines) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")


READ = {"type": "tool_use", "id": "c1", "name": "Read", "input": {"file_path": "/w/app/A.ts"}}
EDIT = {"type": "tool_use", "id": "c2", "name": "Edit", "input": {"file_path": "/w/app/A.ts"}}
LINES = [
    user("please", 1),
    assistant(1, "m1", "r1", {"input_tokens": 10, "output_tokens": 1, "cache_read_input_tokens": 100, "cache_creation_input_tokens": 0, "cache_creation": {"ephemeral_5m_input_tokens": 4000, "ephemeral_1h_input_tokens": 1000}}, [{"type": "text", "text": "a"}], 2),
    "{broken",
    assistant(2, "m1", "r1", {"input_tokens": 10, "output_tokens": 25, "cache_read_input_tokens": 100, "cache_creation_input_tokens": 0}, [READ, EDIT], 3),
    user([{"type": "tool_result", "tool_use_id": "c1", "content": "x" * 4000}, {"type": "tool_result", "tool_use_id": "c2", "content": [{"type": "text", "text": "y" * 800}]}], 4),
    assistant(3, "m2", None, {"input_tokens": 5, "output_tokens": 6}, [], 40, "model-b"),
    assistant(4, None, None, None, [], 47, "model-b"),
]


def test_assistant_logs(spark, tmp_path):
    write(tmp_path / "proj-a" / "s1.jsonl", LINES)
    write(tmp_path / "x-observer-sessions" / "s2.jsonl", LINES)
    write(tmp_path / "proj-a" / "deeper" / "s3.jsonl", LINES)
    logs = assistant_logs.read(spark, str(tmp_path))
    assert assistant_logs.has_logs(spark, str(tmp_path))
    got = logs.requests.orderBy("turn_idx").collect()
    assert [(r.request_key, r.input, r.output, r.cache_read, r.cache_write, r.cache_write_1h, r.model, r.missing_usage, r.after_tool_result) for r in got] == [
        ("m1|r1", 10, 25, 100, 5000, 1000, "model-a", False, False), ("m2|", 5, 6, 0, 0, 0, "model-b", False, True), (None, 0, 0, 0, 0, 0, "model-b", True, True),
    ]
    calls = logs.calls.orderBy("call_idx").collect()
    assert [(c.name, c.turn_idx, c.result_tokens) for c in calls] == [("Read", 0, 1000), ("Edit", 0, 200)]
    s = logs.sessions.collect()
    assert len(s) == 1 and (s[0].session_id, s[0].cwd, s[0].user_turns, s[0].lines_parsed, s[0].lines_skipped, s[0].duration_sec) == ("s1", "/w/app", 1, 6, 1, 46)


def test_tables_of_logs_are_made_from_lines_parsed_once(spark, tmp_path):
    write(tmp_path / "p" / "s1.jsonl", LINES)
    logs = assistant_logs.read(spark, str(tmp_path))
    (tmp_path / "p" / "s1.jsonl").unlink()  # whoever would read the lines again finds none
    assert (logs.requests.count(), logs.calls.count(), logs.sessions.count()) == (3, 2, 1)
    for t in (logs.lines, logs.requests, logs.calls, logs.sessions):
        plan = t._jdf.queryExecution().executedPlan().toString()
        assert "FileScan text" not in plan and "parse_json" not in plan.lower() and "parsejson" not in plan.lower()


def test_odd_log_lines(spark, tmp_path):
    odd = [
        "[1, 2]", "7", '"type"', json.dumps({"type": 5}), json.dumps({"type": "assistant", "timestamp": 5}), json.dumps({"type": "assistant", "sessionId": {}}),
        json.dumps({"type": "assistant", "timestamp": None, "sessionId": None, "message": "text", "isSidechain": "no"}), json.dumps({"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "x", "content": None}, 3, {}]}}),
        json.dumps({"type": "assistant", "cwd": "", "version": 3, "message": {"id": 4, "model": "m", "content": {}, "usage": {"input_tokens": "9", "output_tokens": 2.7, "cache_read_input_tokens": -4, "cache_creation": []}}}),
        json.dumps({"type": "assistant", "cwd": "/w", "message": {"id": "", "usage": [], "content": [{"type": "tool_use", "name": "Bash", "id": "x"}, {"type": "text"}]}}),
    ]
    write(tmp_path / "p" / "s1.jsonl", odd)
    logs = assistant_logs.read(spark, str(tmp_path))
    got = [(r.request_key, r.model, r.input, r.output, r.cache_read, r.cache_write, r.missing_usage, r.version, r.sidechain, r.after_tool_result, r.cache_split) for r in logs.requests.orderBy("turn_idx").collect()]
    assert got == [(None, None, 0, 0, 0, 0, True, None, False, False, False), (None, "m", 0, 2, 0, 0, False, None, False, True, False), (None, None, 0, 0, 0, 0, True, None, False, True, False)]
    assert [(c.name, c.turn_idx, c.call_id, c.result_tokens) for c in logs.calls.collect()] == [("Bash", 2, "x", 0)]
    s = logs.sessions.first()
    assert (s.session_id, s.cwd, s.user_turns, s.lines_parsed, s.lines_skipped) == (None, "/w", 1, 4, 6)


def test_a_resumed_session_owns_only_what_is_new(spark, tmp_path):
    write(tmp_path / "p" / "a.jsonl", LINES)
    write(tmp_path / "p" / "b.jsonl", [*LINES, assistant(9, "m9", "r9", {"input_tokens": 7, "output_tokens": 8}, [], 55)])
    r = assistant_logs.read(spark, str(tmp_path)).requests
    own = own_requests(r, sessions_of(r)).collect()
    assert sorted((x.file_id, x.request_key) for x in own if x.request_key) == [("a", "m1|r1"), ("a", "m2|"), ("b", "m9|r9")]


def usage(n, cached=0, out=0):
    return {"input_tokens": n, "cached_input_tokens": cached, "cache_write_input_tokens": 0, "output_tokens": out, "reasoning_output_tokens": 0, "total_tokens": n + out}


def rollout(kind, t, **payload):
    return {"timestamp": f"2026-01-02T03:{t:02d}:00.000Z", "type": kind, "payload": payload}


def counted(t, total, last, limits=None):
    return rollout("event_msg", t, type="token_count", info={"total_token_usage": total, "last_token_usage": last}, rate_limits=limits)


def test_rollouts(spark, tmp_path):
    limits = {"limit_id": "l", "plan_type": "p", "primary": {"used_percent": 4.5, "window_minutes": 300, "resets_at": 1767400000}, "secondary": {"used_percent": -1, "window_minutes": 300, "resets_at": 1}}
    lines = [
        rollout("session_meta", 0, id="11111111-1111-1111-1111-111111111111", cwd="/w", cli_version="1.0"),
        rollout("turn_context", 1, turn_id="t1", model="gpt-x", cwd="/w"),
        counted(2, usage(100, 40, 10), usage(100, 40, 10), limits),
        counted(3, usage(100, 40, 10), usage(100, 40, 10)),  # repeated
        counted(4, usage(300, 140, 30), usage(200, 100, 20)),
        counted(5, usage(50, 0, 5), usage(50, 0, 5)),  # the counter began again: a new base, no request
        counted(6, usage(80, 0, 9), usage(30, 0, 4)),
    ]
    name = "rollout-2026-01-02T03-00-00-11111111-1111-1111-1111-111111111111.jsonl"
    write(tmp_path / "sessions" / "2026" / name, lines)
    packed = tmp_path / "archived_sessions" / f"{name}.zst"
    packed.parent.mkdir(parents=True)
    packed.write_bytes(zstandard.ZstdCompressor().compress("\n".join(map(json.dumps, lines)).encode()))
    p = rollouts.parsed(rollouts.scan(spark, str(tmp_path)))
    got = rollouts.requests_of(p, rollouts.metas(p)).orderBy("turn_idx").collect()
    assert [(r.input, r.cache_read, r.output, r.model) for r in got] == [(60, 40, 10, "gpt-x"), (100, 100, 20, "gpt-x"), (30, 0, 4, "gpt-x")]
    readings = rollouts.limit_readings(rollouts.scan(spark, str(tmp_path))).collect()
    assert sorted((r.slot, r.used_percent, r.ok) for r in readings) == [("primary", 4.5, True), ("secondary", -1.0, False)]
    assert {r.resets_at for r in readings if r.ok} == {1767400000000}


def test_zstd_logs_are_read(spark, tmp_path):
    (tmp_path / "sessions").mkdir()
    (tmp_path / "archived_sessions").mkdir()
    name = "rollout-2026-01-02T03-00-00-22222222-2222-2222-2222-222222222222.jsonl.zst"
    text = "\n".join(json.dumps(x) for x in [rollout("session_meta", 0, id="22222222-2222-2222-2222-222222222222", cwd="/w"), counted(2, usage(9, 0, 1), usage(9, 0, 1))])
    (tmp_path / "archived_sessions" / name).write_bytes(zstandard.ZstdCompressor().compress(text.encode()))
    p = rollouts.parsed(rollouts.scan(spark, str(tmp_path)))
    assert [(r.input, r.output) for r in rollouts.requests_of(p, rollouts.metas(p)).collect()] == [(9, 1)]
