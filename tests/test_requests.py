"""JSON bodies, parts, attachments and decisions."""

import base64
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from lodesieve.functions import text as T
from lodesieve.operators import attachments, jsonwalk, parts, policy
from lodesieve.sources import sinks
from lodesieve.sources.config import Config
from lodesieve.sources.rules import DEFAULT_RULES, Scanner, carnet

TOKEN = "ghp_" + "aB3d" * 9


def inspected(spark, bodies):
    df = spark.createDataFrame([(k, b if isinstance(b, str) else json.dumps(b)) for k, b in enumerate(bodies)], "request_id int, body string")
    return [r.asDict() for r in jsonwalk.inspect(df).orderBy("request_id").collect()]


def test_strict_parsing(spark):
    bad = ['{"a":1,"a":2}', '{"x":{"b":1,"b":1}}', '{"a":1} x', '{"a":1e400}', '{"a":NaN}', "{invalid", "[1]", "", "1"]
    good = ['{"a": 1.50, "b": null}', "{}"]
    got = inspected(spark, bad + good)
    assert [r["error"] for r in got] == ["bad_json"] * len(bad) + [None] * len(good)
    assert [r["body"] for r in got[-2:]] == good  # bytes are untouched
    assert inspected(spark, ['{"a":' * 80 + "1" + "}" * 80])[0]["error"] == "nesting_limit"


def test_leaves_and_rewrites(spark):
    body = {"model": "m", "messages": [{"role": "user", "content": f"x {TOKEN} y"}, {"tool_calls": [{"id": "1", "function": {"name": "f", "arguments": json.dumps({"key": TOKEN, "number": 7})}}]}]}
    (r,) = inspected(spark, [body])
    out = json.loads(r["body"])
    assert out["messages"][0]["content"] == "x [REDACTED:github-pat] y"
    assert json.loads(out["messages"][1]["tool_calls"][0]["function"]["arguments"]) == {"key": "[REDACTED:github-pat]", "number": 7}
    assert r["changed"] and not r["unsafe"] and r["rules"] == ["github-pat"] * 2


def test_keys_and_control_fields_are_unsafe(spark):
    got = inspected(spark, [{TOKEN: 1}, {"name": TOKEN}, {"name": {"deep": TOKEN}}, {"file_data": TOKEN}, {"x": "data:" + TOKEN}])
    assert [(r["unsafe"], r["changed"], len(r["rules"])) for r in got] == [(True, False, 1), (True, False, 1), (False, True, 1), (False, False, 0), (False, False, 0)]
    assert [r["error"] for r in got] == [None] * 3 + ["bad_base64", "bad_data_url"]  # never as clean


def test_key_split_over_the_parts_of_a_body(spark):
    parts_ = [{"type": "input_text", "text": "before -----BEGIN PRIVATE KEY-----\n" + "A" * 30}, {"type": "image"}, {"type": "input_text", "text": "A" * 50 + "\n-----END PRIVATE KEY----- after"}]
    (r,) = inspected(spark, [{"input": parts_, "name": "x"}])
    out = json.loads(r["body"])["input"]
    assert "AAAA" not in r["body"] and r["changed"] and not r["unsafe"]
    assert out[0]["text"].startswith("before [REDACTED:") and out[2]["text"].endswith("] after") and out[1] == {"type": "image"}


KEY = "-----BEGIN PRIVATE KEY-----\n" + "SECRETA" * 4 + "MIDDLE" * 3 + "SECRETB" * 4 + "\n-----END PRIVATE KEY-----"


def test_parts_that_are_json_or_data_urls_take_part(spark):
    wraps = {"text": lambda t: t, "json": lambda t: json.dumps({"k": t}), "data": lambda t: "data:" + t, "array": lambda t: json.dumps([t])}
    bodies = []
    for at in (28, 40, 60, len(KEY) - 10):
        for a in wraps:
            for b in wraps:
                bodies.append({"input": [{"text": wraps[a]("x " + KEY[:at])}, {"text": wraps["json"]("SECRETM")}, {"text": wraps[b](KEY[at:] + " bye")}]})
    for body, r in zip(bodies, inspected(spark, bodies), strict=True):
        assert r["error"] is not None or not any(w in r["body"] for w in ("SECRET", "MIDDLE")), (body, r)
        assert r["rules"] or r["error"]
    by = {json.dumps(b): r for b, r in zip(bodies, inspected(spark, bodies), strict=True)}
    one = by[json.dumps({"input": [{"text": json.dumps({"k": "x " + KEY[:40]})}, {"text": json.dumps({"k": "SECRETM"})}, {"text": KEY[40:] + " bye"}]})]
    assert [p["text"][-30:] for p in json.loads(one["body"])["input"]][1:] == ["[REDACTED:private-key-fragment]"[-30:], "[REDACTED:private-key] bye"[-30:]] or one["error"] is None


def test_arrays_within_texts_that_are_cut(spark):
    """A key over the parts of an array in a text that is JSON, in a part from which something else is cut: never passed on."""
    deep = json.dumps({"a": [{"text": "one -----BEGIN PRIVATE KEY-----\nSECRETA"}, {"text": "SECRETB\n-----END PRIVATE KEY----- two"}], "t": TOKEN})
    (r,) = inspected(spark, [{"input": [{"text": "plain"}, {"text": deep}]}])
    assert "SECRET" not in (r["body"] if r["error"] is None else "") and TOKEN not in (r["body"] if r["error"] is None else "")


def test_half_characters_are_refused(spark):
    got = inspected(spark, ['{"a":"\\ud800"}', '{"a":"\\ud83d\\ude00 ok"}', '{"\\udc00":1}', '{"a":"{\\"b\\":\\"\\\\ud800\\"}"}'])
    assert [r["error"] for r in got] == ["bad_json", None, "bad_json", None]


def test_each_setting_has_an_effect(spark, tmp_path):
    """max_body_bytes, mode, use_entropy, page_redaction; those of the store are tested there."""
    rule = DEFAULT_RULES[1].__class__("r", "k=([a-z]{8})", ("k=",), 2.5)
    rows = spark.createDataFrame([(1, json.dumps({"a": "k=aaaaaaaa"})), (2, json.dumps({"a": "k=abcdefgh" + "x" * 400})), (3, "{}")], "request_id int, body string")
    of = lambda c: [(r["decision"], r["status"]) for r in policy.processed(rows, c, [rule]).orderBy("request_id").collect()]
    assert of(Config()) == [("sanitized", 200), ("sanitized", 200), ("original", 200)]
    assert of(Config(use_entropy=True))[:2] == [("original", 200), ("sanitized", 200)]
    assert of(Config(mode="no-go"))[:2] == [("blocked", 409), ("blocked", 409)]
    assert of(Config(mode="advisory"))[:2] == [("original", 200), ("original", 200)]
    assert of(Config(max_body_bytes=100)) == [("sanitized", 200), ("failed", 413), ("original", 200)]
    seen = spark.createDataFrame([(1, 1, 1, "d", False)], "doc int, segment int, page int, digest string, has_box boolean")
    sizes = [[x.count() for x in policy.to_black_out(seen, "doc", "segment", Config(page_redaction=p))] for p in (False, True)]
    assert sizes == [[0, 1], [1, 0]]


def test_advisory_passes_on_the_bytes_that_came(spark):
    body = '{"input": [ {"type":"input_file","file_id":"f_1"} ]}'
    rows = spark.createDataFrame([(1, body)], "request_id int, body string")
    have = spark.createDataFrame([("file", "f_1", bytearray(b"plain text"))], "kind string, ref string, content binary")
    out = {m: policy.processed(rows, Config(mode=m), fetched=have).first() for m in policy.MODES}
    assert out["advisory"]["approved_body"] == body and out["advisory"]["decision"] == "original"
    assert "file_data" in out["redact"]["approved_body"] and out["redact"]["decision"] == "sanitized"
    assert "file_data" in out["no-go"]["approved_body"] and out["no-go"]["decision"] == "original"


def test_replacements_are_scanned_again(spark):
    df = spark.createDataFrame([(1, None, bytearray(b"clean")), (2, None, bytearray(TOKEN.encode())), (3, "unsupported", None)], "id int, error string, replacement binary")
    got = [(r["error"], r["replacement"] is None) for r in attachments.reverified(df, ["id"]).orderBy("id").collect()]
    assert got == [(None, False), ("not_clean", True), ("unsupported", True)]


def test_config():
    from lodesieve.sources.config import from_toml

    assert from_toml('mode = "advisory"\nttl_secs = 5\n').ttl_secs == 5
    for bad in ('mode = "x"', "ttl_secs = 0", "ttl_secs = true", "colour = 1", "use_entropy = 1"):
        with pytest.raises(ValueError):
            from_toml(bad)


def test_native_leaves(spark):
    df = spark.createDataFrame([(1, '{"a":[1,{"b":"x"}],"c":null}'), (2, "no json"), (3, None)], "id int, body string")
    got = sorted((r["id"], r["path"], r["value"]) for r in jsonwalk.leaf_rows(df, ["id"], "body").collect() if r["value"] is not None)
    assert got == [(1, "$.a[0]", "1"), (1, "$.a[1].b", "x")]


@pytest.mark.parametrize("cut", [0, 1, 40, 80])
def test_key_split_over_parts(spark, cut):
    key = "A" * 80
    rows = [(1, 0, "before -----BEGIN PRIVATE KEY-----\n" + key[:cut]), (1, 1, None), (1, 2, key[cut:] + "\n-----END PRIVATE KEY----- after")]
    f = parts.clipped_findings(spark.createDataFrame(rows, "id int, pos int, text string"), "id", "pos", "text")
    got = sorted((r["pos"], r["start"], r["end"]) for r in f.collect())
    assert got == [(0, 7, len(rows[0][2])), (2, 0, len(rows[2][2]) - 6)]


def test_attachment_kinds_and_texts(spark):
    data = [b"%PDF-1.4", b"\x89PNG..", b"\xff\xd8\xff", b"text " + TOKEN.encode(), b"\xff\xfe" + f"a {TOKEN}".encode("utf-16-le"), b"\xfe\xff" + "ok".encode("utf-16-be"), b"\xff\xfea", b"\xff\xfe\x00\xd8", b"\x00", b"\xff", b""]
    df = spark.createDataFrame([(k, bytearray(d)) for k, d in enumerate(data)], "id int, content binary")
    kinds = [r[0] for r in df.orderBy("id").select(attachments.kind(F.col("content"))).collect()]
    assert kinds == ["pdf", "png", "jpg"] + ["txt"] * 8
    got = [r.asDict() for r in attachments.inspect_texts(df, ["id"]).orderBy("id").collect()]
    assert [r["error"] for r in got] == ["unsupported"] * 3 + [None] * 3 + ["unsupported"] * 4 + [None]
    assert [len(r["rules"]) for r in got] == [0, 0, 0, 1, 1, 0, 0, 0, 0, 0, 0]
    assert bytes(got[4]["replacement"]) == b"a [REDACTED:github-pat]"
    assert all(r["replacement"] is None for r in attachments.inspect_texts(df, ["id"], sanitize=False).collect())


def test_strict_base64(spark):
    ok = [base64.b64encode(b).decode() for b in (b"", b"a", b"abc" * 40)]
    bad = ["YQ", "YQ=", "YR==", "Y Q==", "YQ==\n", "####"]
    df = spark.createDataFrame([(k, s) for k, s in enumerate(ok + bad)], "id int, s string").orderBy("id")
    assert [r[0] is not None for r in df.select(T.from_base64(F.col("s"))).collect()] == [True] * 3 + [False] * 6


def test_discovery(spark):
    b64 = base64.b64encode(b"hi").decode()
    leaves = [("file_id", "f"), ("image_url", "https://x/y"), ("image_url", f"data:image/png;base64,{b64}"), ("url", f"data:text/plain,{b64}"), ("file_data", b64), ("file_data", "https://x"), ("type", "audio"), ("content", "words"), ("x", "data:;base64,!")]
    df = spark.createDataFrame([(k, *x) for k, x in enumerate(leaves)], "id int, key string, text string")
    got = {r["id"]: (r["source"], r["error"]) for r in attachments.discovered(df, ["id"]).collect()}
    assert got == {0: ("unresolved", "unresolved_reference"), 1: ("remote", "remote_reference"), 2: ("data", None), 3: ("data", "bad_base64"), 4: ("file_data", None), 5: ("file_data", "bad_base64"), 6: ("media", "unsupported_media"), 8: ("data", "bad_base64")}


def test_policy(spark):
    rows = [([], False), (["a"], False), (["a"], True)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id int, rules array<string>, unsafe boolean").orderBy("id")
    got = {m: [r[0] for r in df.select(policy.decision(F.col("rules"), F.col("unsafe"), m)).collect()] for m in policy.MODES}
    assert got == {"redact": ["original", "sanitized", "blocked"], "no-go": ["original", "blocked", "blocked"], "advisory": ["original"] * 3}
    with pytest.raises(ValueError):
        policy.decision(F.lit(None), F.lit(True), "other")


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text('{"input": "%s"}\n{"input": "x"}\n' % TOKEN)
    req = sinks.requests(spark, str(tmp_path / "in.jsonl"), 60)
    assert req.select("request_id").distinct().count() == 2
    seen = jsonwalk.inspect(req)
    out = policy.decide(seen)
    sinks.write_approved(out, str(tmp_path / "out"))
    assert sorted(r["body"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ['{"input": "x"}', '{"input":"[REDACTED:github-pat]"}']
    sinks.write_findings(policy.finding_ids(seen), str(tmp_path / "log"))
    log = spark.read.json(str(tmp_path / "log")).collect()
    assert [r["rule_id"] for r in log] == ["github-pat"] and TOKEN not in str(log)
    (tmp_path / "carnet.json").write_text('["%s"]' % ("AB" * 32))
    assert [r["hash"] for r in carnet(spark, str(tmp_path / "carnet.json")).collect()] == ["ab" * 32]
    (tmp_path / "bad.json").write_text('["xyz"]')
    with pytest.raises(Exception, match="SHA-256"):
        carnet(spark, str(tmp_path / "bad.json")).collect()


def test_public_addresses(spark):
    import ipaddress

    v4 = ["8.8.8.8", "10.0.0.1", "127.0.0.1", "100.64.0.1", "100.63.0.1", "198.18.0.1", "192.0.2.1", "203.0.113.7", "224.0.0.1", "0.1.2.3", "172.31.0.1", "172.32.0.1", "1.2.3", "256.1.1.1", "01.2.3.4"]
    df = spark.createDataFrame([(k, a) for k, a in enumerate(v4)], "id int, a string").orderBy("id")
    assert [r[0] for r in df.select(T.is_public_ipv4(F.col("a"))).collect()] == [True, False, False, False, True, False, False, False, False, False, False, True, False, False, False]
    short = ["2001:4860::8888", "::1", "2600::", "2001:db8::", "2001::1", "64:ff9b::8.8.8.8", "2600:1:2:3:4:5:1.2.3.4", "::ffff:8.8.8.8", "1:2", "2600::1::2", "2600:::1", "2600:1:2:3:4:5:6:7:8", "g::1", "2600::300.1.1.1", ""]
    df = spark.createDataFrame([(k, a) for k, a in enumerate(short)], "id int, a string").orderBy("id")
    assert [r[0] for r in df.select(T.is_public_address(F.col("a"))).collect()] == [True, False, True] + [False] * 3 + [True] + [False] * 8
    v6 = [ipaddress.ip_address(a).exploded for a in ("2600::1", "2001:db8::1", "2001:1::1", "2001:200::1", "fe80::1", "::ffff:1.2.3.4")]
    df = spark.createDataFrame([(k, a) for k, a in enumerate(v6)], "id int, a string").orderBy("id")
    assert [r[0] for r in df.select(T.is_public_ipv6(F.col("a"))).collect()] == [True, False, False, True, False, False]


def test_odd_keys_do_not_collide(spark):
    """Only leaves with a finding change, whatever keys hold."""
    rng = random.Random(5)
    keys = ["a", "a.b", "b", "[0]", "0", "a[0]", "!", "a!", "$", "", "~", "\u00e9", "text", 'q"']
    places = []

    def tree(depth):
        kind = rng.random()
        if depth > 3 or kind < 0.4:
            dirty = rng.random() < 0.3
            places.append(dirty)
            return f"x {TOKEN} y" if dirty else rng.choice(["hello", "", "x y", "\u2028\n"])
        if kind < 0.6:
            return [tree(depth + 1) for _ in range(rng.randint(0, 3))]
        if kind < 0.75:
            return json.dumps({k: tree(depth + 1) for k in rng.sample(keys, rng.randint(1, 3))})
        return {k: tree(depth + 1) for k in rng.sample(keys, rng.randint(0, 5))}

    def clean(v):
        if isinstance(v, dict):
            return {k: clean(x) for k, x in v.items()}
        if isinstance(v, list):
            return [clean(x) for x in v]
        if v.startswith(("{", "[")):
            own = json.loads(v)
            return v if clean(own) == own else jsonwalk.written(clean(own))
        return v.replace(TOKEN, "[REDACTED:github-pat]")

    bodies = [{"a.b": f"x {TOKEN} y", "a": {"b": "hello"}}] + [{"input": tree(0), "m": tree(0)} for _ in range(60)]
    for r, b in zip(inspected(spark, bodies), bodies, strict=True):
        assert r["error"] is None and json.loads(r["body"]) == clean(b)
        assert r["changed"] == (TOKEN in json.dumps(b)) and (r["changed"] or r["body"] == r["original"])


def test_attachments_in_bodies(spark):
    def b64(x):
        return base64.b64encode(x.encode() if isinstance(x, str) else x).decode()

    head = "ey" + "Jh" * 12 + ".ey" + "Kz" * 20 + "." + "Ab" * 12
    broken = f"before '{head[:50]}\n  {head[50:]}' after"
    pem = "-----BEGIN PRIVATE KEY-----\nAAAA"
    bodies = [
        {"x": f"data:text/plain;base64,{b64(TOKEN)}"}, {"file_data": b64(f"a {TOKEN}")}, {"arguments": json.dumps({"file_data": b64(TOKEN)})}, {"x": {"file_id": "f"}}, {"x": "data:text/plain,hi"}, {"x": "data:text/plain;base64,YR=="},
        {"image_url": {"url": "https://x"}}, {"type": "input_image", "image_url": "ftp://x"}, {"type": "video"}, {"x": [f"data:;base64,{b64('a')}"] * 17}, {"x": f"data:;base64,{b64(bytes([0x89]) + b'PNG')}"}, {"x": broken},
        {"x": f"data:;base64,{b64(broken)}"}, {"file_data": {"deep": TOKEN}}, {"name": f"data:text/plain;base64,{b64(TOKEN)}"}, {"x": f"data:;base64,{b64(TOKEN.encode('utf-16'))}"}, {"x": [{"text": "data:text/plain;base64," + b64("ok")}, {"text": pem}]},
    ]
    got = inspected(spark, bodies)
    assert [r["error"] for r in got] == [None] * 3 + ["unresolved_reference", "unsupported_encoding", "bad_base64", "remote_reference", "remote_reference", "unsupported_media", "attachment_limit", "unsupported"] + [None] * 6
    assert [sorted(set(r["rules"])) for r in got[:3] + got[11:]] == [["github-pat"]] * 3 + [["jwt"]] * 2 + [["github-pat"]] * 3 + [["private-key-fragment"]]
    assert json.loads(got[0]["body"]) == {"x": "data:text/plain;base64," + b64("[REDACTED:github-pat]")}
    assert json.loads(got[1]["body"]) == {"file_data": b64("a [REDACTED:github-pat]")}
    assert json.loads(json.loads(got[2]["body"])["arguments"]) == {"file_data": b64("[REDACTED:github-pat]")}
    assert json.loads(got[11]["body"]) == {"x": "before '[REDACTED:jwt]' after"}
    df = spark.createDataFrame([(k, json.dumps(b)) for k, b in enumerate(bodies)], "request_id int, body string")
    decided = policy.status_of(policy.decide(jsonwalk.inspect(df, sanitize=False), "no-go")).orderBy("request_id").collect()
    assert [r["status"] for r in decided] == [409] * 3 + [422] * 8 + [409] * 6 and not any(r["approved_body"] for r in decided)


def test_errors_are_carried_to_the_decision(spark):
    rows = [(1, None, "too_large"), (2, "{x", None), (3, '{"x":{"file_id":"f"}}', None), (3, '{"a": 1}', None), (3, '{"a":"%s"}' % TOKEN, None)]
    out = policy.processed(spark.createDataFrame(rows, "request_id int, body string, error string"), Config())
    got = sorted((r["request_id"], r["status"], r["error"] or "", r["decision"]) for r in out.collect())
    assert got == [(1, 413, "too_large", "failed"), (2, 400, "bad_json", "failed"), (3, 200, "", "original"), (3, 200, "", "sanitized"), (3, 422, "unresolved_reference", "failed")]
    strict = Scanner(DEFAULT_RULES, frozenset([hashlib.sha256(TOKEN.encode()).hexdigest()]))
    assert [r["decision"] for r in policy.processed(spark.createDataFrame(rows[4:], "request_id int, body string, error string"), Config(mode="no-go"), strict).collect()] == ["original"]


def test_references_become_bytes(spark):
    fetched = spark.createDataFrame([("file", "f1", bytearray(TOKEN.encode())), ("url", "https://x/y", bytearray(b"%PDF-1"))], "kind string, ref string, content binary")
    bodies = [{"a": {"file_id": "f1"}}, {"a": {"file_url": "https://x/y", "filename": "own"}}, {"image_url": "https://x/y"}, {"image_url": {"url": "https://x/y"}}, {"a": json.dumps({"file_id": "f1"})}, {"a": {"file_id": "../x"}}, {"a": {"file_id": "no"}}, {"a": [{"file_id": "f1"}] * 17}, {"a": [{"file_url": "https://x/y"}] * 17}, {"a": 1}, "{x"]
    df = spark.createDataFrame([(k, b if isinstance(b, str) else json.dumps(b)) for k, b in enumerate(bodies)], "request_id int, body string")
    got = {r["request_id"]: r for r in jsonwalk.materialize(df, fetched).collect()}
    assert [got[k]["error"] for k in range(11)] == [None] * 5 + ["unresolved_reference"] * 2 + ["reference_limit"] + [None] * 3
    file_url, pdf = "data:text/plain;base64," + base64.b64encode(TOKEN.encode()).decode(), "data:application/pdf;base64," + base64.b64encode(b"%PDF-1").decode()
    assert json.loads(got[0]["body"]) == {"a": {"file_data": file_url, "filename": "attachment.txt"}}
    assert json.loads(got[1]["body"]) == {"a": {"filename": "own", "file_data": pdf}}
    assert json.loads(got[2]["body"]) == {"image_url": pdf} and json.loads(got[3]["body"]) == {"image_url": {"url": pdf}}
    assert json.loads(json.loads(got[4]["body"])["a"]) == {"file_data": file_url, "filename": "attachment.txt"}
    assert got[9]["body"] == '{"a": 1}' and got[10]["body"] == "{x"
    seen = policy.processed(df.where("request_id < 2"), Config(), fetched=fetched).orderBy("request_id").collect()
    assert [(r["decision"], r["error"]) for r in seen] == [("sanitized", None), ("failed", "unsupported")]


def test_artifacts_are_kept_once(spark, tmp_path):
    df = spark.createDataFrame([(bytearray(b"a"),), (bytearray(b"a"),), (bytearray(b"long"),), (None,)], "replacement binary")
    for _ in range(2):
        sinks.write_artifacts(df, str(tmp_path / "artifacts"), 3)
    assert [bytes(r["artifact"]) for r in sinks.artifacts(spark, str(tmp_path / "artifacts")).collect()] == [b"a"]
