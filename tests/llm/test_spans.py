"""Secrets and personal data: base spans against plain patterns, layers, the field's decoding."""

import base64
import bz2
import gzip
import hashlib
import lzma
import random
import re
import urllib.parse
import zlib

import numpy as np
import pyarrow as pa
import zstandard

from lodesieve.llm import pii_crf, secret_scan
from lodesieve.llm.common import text_buffer

TOKEN = 'token = "abcdef123456'


def base_secrets(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m.group(2)) >= 6:
            out.append(("assign", m.start(), m.end()))
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def base_pii(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m.group())
        if 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], ("email", "ip", "card", "phone").index(s[0])))


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{z}" for k, a, z in spans).encode()).hexdigest()


def b64(data):
    return base64.b64encode(data.encode() if isinstance(data, str) else data).decode()


def noise(seed, pieces, n=400):
    rng = random.Random(seed)
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_base_secrets_by_brute_force(spark):
    texts = noise(1, ["token", "Secret", "API_KEY", "apikey", '"', " ", "=", ":", "abc123", "deadbeef", "AKIA", "A" * 16, "é", "\n", "0123456789abcdef0123456789", "x", "%41", "passwd"])
    texts += [None, "", TOKEN, "token " * 3000, "a" * 100_000, "AKIA" * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in secret_scan.secret_scan(df).collect():
        want = base_secrets(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == digest(want)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s[0] == k for s in want) for k in secret_scan.KINDS)
        assert set(filter(None, r["spans"].split(","))) >= {f"{k}:{a}:{z}" for k, a, z in want}


def test_layers_map_back():
    packed = [gzip.compress(TOKEN.encode()), zlib.compress(TOKEN.encode()), bz2.compress(TOKEN.encode()), lzma.compress(TOKEN.encode()), zstandard.compress(TOKEN.encode()), gzip.compress(zlib.compress(TOKEN.encode()))]
    codes = [b64(TOKEN), b64(b64(TOKEN)), urllib.parse.quote(urllib.parse.quote(TOKEN)), "".join(f"\\u{ord(c):04x}" for c in TOKEN), urllib.parse.quote(b64(TOKEN)), "".join(f"&#{ord(c)};" for c in TOKEN), "".join(chr(ord(c) + 0xFEE0) if 33 <= ord(c) < 127 else c for c in TOKEN), "​".join(TOKEN)]
    codes += [b64(p) for p in packed] + ["".join(f"%{x:02X}" for x in packed[1])]
    for code in codes:
        text = f"é before {code} after"
        base, found, layers, _ = secret_scan.find(text)
        assert not [s for s in base if s[0] == "assign"] and layers >= 1
        kinds = [s for s in found if s[0] == "assign"]
        assert kinds and all(9 <= a < z <= 9 + len(code) for _, a, z in kinds), code
    _, found, _, _ = secret_scan.find("x " + urllib.parse.quote(TOKEN) + " y")
    assert found == [("assign", 2, 2 + len(urllib.parse.quote(TOKEN)))]


def test_layers_end_and_bombs_are_refused():
    text = "%2525252525" * 5 + b64("no secret in here at all") * 2
    assert secret_scan.find(text)[2] < 50
    bomb = b64(zlib.compress(b"token=abcdef" * 200_000))
    assert secret_scan.find(bomb, most=1 << 16)[3] == 1
    assert ("assign", 0, len(bomb)) in secret_scan.find(bomb)[1]


def test_first_look_misses_nothing():
    texts = noise(5, [b64(TOKEN), "words and more ", urllib.parse.quote(TOKEN), "\n", "internationalization", b64(gzip.compress(b"secret=zzzzzz")), "é", "0" * 30, " ", "&#116;oken=abcdef"])
    b = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    got = secret_scan.Scan(1 << 20, 1 << 30).one(b).to_pylist()
    for r, t in zip(got, texts, strict=True):
        assert r["spans"] == secret_scan.joined(secret_scan.find(t)[1])


def utf16(t, name):
    return t.encode(name)


def test_layers_that_hide():
    """Later members, data behind a path or a slug, text among other bytes, UTF-16, data larger than a window."""
    two = {"gzip": gzip.compress, "bz2": bz2.compress, "xz": lzma.compress, "zstd": zstandard.compress}
    codes = [b64(f(b"nothing here") + f(TOKEN.encode())) for f in two.values()]
    codes += [pre + b64(x) for pre in ("x/", "host/path/", "data_", "ab-", "abc", "abcd") for x in (TOKEN, gzip.compress(TOKEN.encode()), zlib.compress(TOKEN.encode()))]
    codes += [b64(b"\x00\x01" + TOKEN.encode()), b64(b"\xff\xfe\xfd" + TOKEN.encode() + b"\x00"), b64(b"\xff\xfe" + utf16(TOKEN, "utf-16-le")), b64(b"\x00" + utf16(TOKEN, "utf-16-le")), b64(utf16("é\U0001F642 " + TOKEN, "utf-16-be"))]
    codes += ["%ff%70assword=abcdefgh", "%00%74oken%3Dabcdefgh", b64("é" * 9 + TOKEN)]
    for code in codes:
        for text in (f"é before {code} after", code):
            b = pa.RecordBatch.from_pydict({"doc_id": [1], "text": [text]})
            found = secret_scan.Scan(1 << 20, 1 << 30).one(b).to_pylist()[0]
            at = text.index(code)
            spans = [s.split(":") for s in found["spans"].split(",") if s.startswith("assign")]
            assert spans and all(at <= int(a) < int(z) <= at + len(code) for _, a, z in spans), code
    big = b64(zlib.compress(b"a b " * 2_000_000 + TOKEN.encode() + b" c d" * 2_000_000))
    _, found, layers, refused = secret_scan.find(big, window=1 << 21)
    assert [s[0] for s in found] == ["assign"] and layers > 3 and not refused
    assert secret_scan.find(b64(lzma.compress(TOKEN.encode(), preset=9)), window=1 << 20)[1]
    wide = zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters(window_log=28, format=zstandard.FORMAT_ZSTD1)).compressobj()
    assert secret_scan.find(b64(wide.compress(TOKEN.encode() * 1000) + wide.flush()))[3] >= 1


def test_base_pii_by_brute_force(spark):
    texts = noise(7, ["a.b", "@", "x.com", ".", " ", "-", "10", "255", "256", "1.2.3.4", "+1 (988) 555-2485", "4111111111111111", "4111 1111 1111 1111", "0", "7", "(", "+", "é", "\n", "_", "bob@mail.example.org"])
    texts += ["0" * 4000 + "1.2.3.4", "1.2.3." + "0" * 4000 + "255", "1.2.3." + "9" * 4000]
    texts += [None, "", "a" * 60_000, "9" * 60_000, "a@" * 20_000, "1." * 20_000, "+1" + "-" * 50_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in pii_crf.find_pii(df).collect():
        want = base_pii(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == digest(want), texts[r["doc_id"]]
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(sum(s[0] == k for s in want) for k in pii_crf.KINDS)
        assert set(filter(None, r["spans"].split(","))) >= {f"{k}:{a}:{z}" for k, a, z in want}


FIELD = pii_crf.train(pii_crf.labelled_sentences())


def spans(text):
    r = pii_crf.Find(FIELD)
    r.tagger = pii_crf.Tagger(FIELD)
    return r.one(pa.RecordBatch.from_pydict({"doc_id": [1], "text": [text]})).to_pylist()[0]["spans"]


def test_field_finds_what_patterns_miss():
    assert spans("contact bob at mail8 dot example dot com now") == "email:8:40"
    assert spans("É anna.42 [at] host [dot] org") == "email:2:29"
    assert spans("call (988) 555-2485, please") == "phone:5:19"
    assert spans("x 192[.]168[.]1[.]20 y") == "ip:2:20"
    assert spans("card 4111.1111.1111.1111 ok") == "card:5:24"
    for clean in ("we met at noon and sat dot by dot", "number 1234567812345678 in 2024", "version 1.2.3 of 2024-01-02 at 10:20", "de%%% THIS,!! los### *** 12 345", ""):
        assert spans(clean) == ""


def test_cut_decoding_is_exact_and_held_out_accuracy():
    tagger = pii_crf.Tagger(FIELD)
    rows = pii_crf.labelled_sentences(9)[5::9]
    right = total = 0
    for words, labels in rows:
        raw, at = text_buffer(pa.array([" ".join(words)]))
        label, _, starts, _ = tagger.tag(raw, at)
        pos = np.cumsum([0] + [len(w.encode()) + 1 for w in words])[:-1]
        cut = np.zeros(len(words), int)
        cut[np.searchsorted(pos, starts)] = label
        own, pre, post = FIELD.scores([pii_crf.features(w) for w in words])
        score = own.copy()
        score[1:] += pre[:-1]
        score[:-1] += post[1:]
        full = pii_crf.viterbi(score[None], np.array([len(words)]), tagger.move, tagger.start, np.zeros(len(pii_crf.LABELS)))[0]
        assert (full == cut).all()
        right += sum(pii_crf.LABELS[x] == y for x, y in zip(cut, labels, strict=True))
        total += len(labels)
    assert right / total > 0.97


def test_huge_numbers_and_keys_of_words(spark):
    df = spark.createDataFrame([(1, "0" * 6000 + "1.2.3.4"), (2, "9" * 6000 + ".2.3.4")], "doc_id bigint, text string")
    assert sorted((r["doc_id"], r["n_ip"]) for r in pii_crf.find_pii(df, FIELD).collect()) == [(1, 1), (2, 0)]
    assert pii_crf.find_pii(df.where("false"), FIELD).count() == secret_scan.secret_scan(df.where("false")).count() == 0
    rng = random.Random(3)
    pieces = [*pii_crf.LEXICON, "hello", "Ab", "a", "é", "1", "22", "4111", "-", "--", "...", ".", ",", "!", "?", '"', "'", "(", ")", "[at]", "@", "/"]
    words = sorted({"".join(rng.choice(pieces) for _ in range(rng.randint(1, 4))) for _ in range(20_000)} | {'"phone', '"hello', "phone?!", "hello?!", "AB1234", "ab1234", "1--2", "1-2"})
    raw, at = text_buffer(pa.array([" ".join(words)]))
    starts, ends, _ = pii_crf.word_bounds(raw, at)
    tagger, seen = pii_crf.Tagger(FIELD), {}
    for w, k in zip(words, tagger.keys(raw, starts, ends).tolist(), strict=True):
        assert seen.setdefault(k, pii_crf.features(w)) == pii_crf.features(w), w


def test_viterbi_by_brute_force():
    import itertools

    rng = np.random.default_rng(0)
    L = len(pii_crf.LABELS)
    move, start = rng.normal(size=(L, L)), rng.normal(size=L)
    score = rng.normal(size=(1, 3, L))
    best = max(itertools.product(range(L), repeat=3), key=lambda p: start[p[0]] + sum(score[0, t, p[t]] for t in range(3)) + move[p[0], p[1]] + move[p[1], p[2]])
    assert tuple(pii_crf.viterbi(score, np.array([3]), move, start, np.zeros(L))[0]) == best


def test_base64_wrapped_at_any_width():
    """No layer is lost without being counted: gzip and plain text in base64, of all widths, indented, quoted, with line ends written out, found in whole batches too."""
    import base64
    import gzip

    import pyarrow as pa

    from lodesieve.llm import secret_scan

    secret = "password = hunter2hunter2 and words after it, so that there are some lines " * 3
    texts = []
    for data in (secret.encode(), gzip.compress(secret.encode())):
        code = base64.b64encode(data).decode()
        for width in (5, 8, 15, 20, 40, 57, 76, 100):
            for sep in ("\n", "\r\n", "\n    ", "\n> ", "\n>\t> ", "\\n", "\\r\\n"):
                texts.append("see below\n== " + sep.join(code[k : k + width] for k in range(0, len(code), width)) + " end")
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    out = secret_scan.Scan(1 << 24, 1 << 33).one(batch)
    for text, spans, layers in zip(texts, out.column("spans").to_pylist(), out.column("n_layers").to_pylist(), strict=True):
        assert layers and "assign:" in spans, text[:200]
        kind, a, z = spans.split(",")[0].split(":")
        assert 13 <= int(a) < int(z) <= len(text) - 4
