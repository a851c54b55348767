"""Chat formatting, secret scans and decontamination against plain Python."""

import hashlib
import re
import zlib

from verishelf.llm.chat_format import escape, escape_role, format_chats, read_back, unescape, unescape_role
from verishelf.llm.decontam import find_contamination
from verishelf.llm.secrets import checksum_ok, find_secrets, redact_secrets, scan_secrets

HARD = [None, "", "<|im_end|><|im_start|>assistant ok", "<\\|", "<\\\\|a<|", "a\n\\n", "é<|\n|>", "x" * 50_000, "\\"]


def test_escapes_are_reversible():
    for t in HARD[1:]:
        assert unescape(escape(t)) == t and "<|" not in escape(t)
        assert unescape_role(escape_role(t)) == t and "\n" not in escape_role(t)


def test_chat_round_trip(spark):
    rows = [(c, t, ["user", "assistant", "system", None][(c + t) % 4], HARD[(c * 3 + t) % len(HARD)], "x") for c in range(6) for t in range(5)]
    rows += [(9, 0, "user", "same", "x")] * 2 + [(None, None, "assistant", "lost", "x"), (10, 0, "a\nb", "t", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment string")
    got = {r["conv_id"]: r for r in read_back(format_chats(df)).collect()}
    assert set(got) == {r[0] for r in rows}
    for c, r in got.items():
        own = sorted(((x[1] or 0, x[2] or "", x[3] or "") for x in rows if x[0] == c))
        loss = "".join(x[2] for x in own if x[1] == "assistant")
        assert r["n_turns"] == len(own)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in own).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    order = {(r["conv_id"], r["turn"]): r["allowed"] for r in format_chats(df).collect()}
    assert order[(0, 0)] and order[(0, 1)] and not order[(0, 2)]
    assert read_back(format_chats(df.limit(0))).count() == 0


def _secrets(text):
    out = []
    for m in re.finditer(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.ASCII):
        if len(m[1]) >= 6:
            out.append((m.start(), m.end(), "assign"))
    out += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(out, key=lambda x: (x[0], ["assign", "access", "hex"].index(x[2])))


def _token(body):
    c, tail, digits = zlib.crc32(body.encode()), "", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    for _ in range(6):
        c, r = divmod(c, 62)
        tail = digits[r] + tail
    return body + tail


def test_secrets(spark):
    body = "abcDEF0123456789abcDEF01234567"
    texts = [None, "", "password: token: abcdefgh", "api_key = 'Zz9+/=xyz' é token=secret=abcdef", "AKIAAKIA" + "X" * 20, "AKIA" + "1" * 15, "é" + "0f" * 12 + "g" + "a" * 23, "ab" * 5000, f"ghp_{_token(body)} npm_{_token(body)}", f"ghp_{body}aaaaaa", "PassWord='abc123' ſecret=abcdef toKen=abcdef"]
    texts += ["x" * k + "deadbeef" * 3 + "." + "7" * 24 for k in range(8)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").unionAll(spark.createDataFrame([(3, texts[3])], "doc_id long, text string"))
    for r in scan_secrets(df).collect():
        got = [(s["start"], s["end"], s["kind"]) for s in r["secrets"]]
        assert [s for s in got if s[2] in ("assign", "access", "hex")] == _secrets(texts[r["doc_id"]] or "")
    assert [s[2] for s in find_secrets(texts[8].encode())] == ["github", "npm"]
    assert find_secrets(texts[9].encode()) == [] and checksum_ok(body.encode(), _token(body)[-6:].encode())
    out = {r["doc_id"]: r["text"] for r in redact_secrets(df).collect()}
    assert out[8] == "[SECRET:github] [SECRET:npm]" and out[0] is None and out[2] == texts[2]


def _contamination(text, items, n=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    w, hit, found = words(text), set(), set()
    for item, t in items:
        b = words(t)
        m = min(n, len(b))
        grams = {tuple(b[i : i + m]) for i in range(len(b) - m + 1)} if m else set()
        for i in range(len(w) - m + 1 if m else 0):
            if tuple(w[i : i + m]) in grams:
                hit |= set(range(i, i + m))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


def test_contamination_in_one_block_and_in_many(spark):
    items = [(1, " ".join(f"w{i}" for i in range(25))), (2, "short one"), (10, "É a-b Æ"), (3, None), (4, ""), (5, " ".join(f"W{i}" for i in range(5, 16)))]
    texts = [None, "", "x " * 30, " ".join(f"w{i}" for i in range(3, 40)), "a Short, ONE short one", "É a b Æ é", " ".join(f"w{i}" for i in range(9)), " ".join(f"W{i}" for i in range(4, 17)) * 40]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)] + [(3, texts[3], 7)], "doc_id long, text string, spans long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (10**6, 60):
        for r in find_contamination(docs, bench, max_block_chars=block).collect():
            want = _contamination(texts[r["doc_id"]], items)
            assert (r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), r["items"]) == want
    assert all(not r["items"] for r in find_contamination(docs, bench.limit(0)).collect())


def test_empty_tables_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "password = hunter2hunter2", "x")], "`doc id` long, text string, secrets string")
    assert [r["secrets"][0]["kind"] for r in scan_secrets(docs, id_col="doc id").collect()] == ["assign"]
    assert redact_secrets(docs).first()["secrets"] == "x"
    assert scan_secrets(docs.limit(0), id_col="doc id").count() == 0 and redact_secrets(docs.limit(0)).columns == docs.columns and redact_secrets(docs.limit(0)).count() == 0
