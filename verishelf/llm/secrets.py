"""Secret scans: keyword prefilter, anchored expressions near hits, checksum validation."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verishelf.llm._common import raw_bytes

KINDS = ("assign", "access", "hex", "github", "npm")
_ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]+")
_CHECKED = re.compile(rb"(gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_DIGITS = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_IS_HEX = np.zeros(256, dtype=bool)
_IS_HEX[np.frombuffer(b"0123456789abcdef", dtype=np.uint8)] = True
#: A run of 24 covers four points in a row of a grid with this step.
_STEP = 6


@lru_cache(maxsize=1)
def _keywords() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for w in ("password", "passwd", "secret", "token", "apikey", "api_key"):
        a.add_word(w, ("assign", len(w)))
    a.add_word("akia", ("access", 4))
    for w in ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"):
        a.add_word(w, ("checked", 4))
    a.make_automaton()
    return a


def checksum_ok(body: bytes, tail: bytes) -> bool:
    """Whether tail is the CRC-32 of body in six base-62 digits."""
    c, out = zlib.crc32(body), b""
    for _ in range(6):
        c, r = divmod(c, 62)
        out = _DIGITS[r : r + 1] + out
    return out == tail


def find_secrets(text: bytes) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) in code points, by start and then kind as listed in KINDS."""
    found: list[tuple[int, int, str]] = []
    upto = {"assign": 0, "access": 0, "checked": 0}
    hits = sorted((at - n + 1, kind) for at, (kind, n) in _keywords().iter(text.lower().decode("latin-1")))
    for start, kind in hits:
        if start < upto[kind]:
            continue
        m = (_ASSIGN if kind == "assign" else _ACCESS if kind == "access" else _CHECKED).match(text, start)
        if not m:
            continue
        upto[kind] = m.end()
        if kind == "assign" and len(m[2]) >= 6:
            found.append((start, m.end(), kind))
        elif kind == "access" and m.end() - start >= 20:
            found.append((start, m.end(), kind))
        elif kind == "checked" and checksum_ok(m[2], m[3]):
            found.append((start, m.end(), "npm" if m[1] == b"npm" else "github"))
    if len(text) >= 24:
        on = _IS_HEX[np.frombuffer(text, dtype=np.uint8)[_STEP - 1 :: _STEP]]
        end = 0
        for j in np.flatnonzero(on[:-3] & on[1:-2] & on[2:-1] & on[3:]).tolist():
            start = j * _STEP + _STEP - 1
            if start < end:
                continue
            while start > end and _IS_HEX[text[start - 1]]:
                start -= 1
            end = _HEX.match(text, start).end()
            if end - start >= 24:
                found.append((start, end, "hex"))
    if found and not text.isascii():
        at = np.concatenate([[0], np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80)])
        found = [(int(at[s]), int(at[e]), k) for s, e, k in found]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """The secrets of every whole text.

    An Aho-Corasick automaton over the ASCII-lower-cased bytes finds keywords; only there is
    the kind's expression tried, anchored. Long hexadecimal runs have no keyword: a coarse grid
    of bytes takes that part. Kinds: assign, access, hex, and, if the CRC-32 that they embed is
    right, github and npm tokens. A kind's matches don't overlap; other kinds' may.

    Returns per row: id_col and secrets, an array of (start, end, kind) in code points. Null
    and empty texts have none, texts of any length are scanned whole; repeated rows are reported alike, other columns don't
    matter, and an empty table gives none.
    """
    kept = docs.select(F.col(id_col), "text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [[{"start": s, "end": e, "kind": k} for s, e, k in find_secrets(t)] if t else [] for t in raw_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, _SPAN)], names=[id_col, "secrets"])

    return kept.mapInArrow(scan, f"`{id_col}` {dict(kept.dtypes)[id_col]}, secrets array<struct<start:long,end:long,kind:string>>")


def redact_secrets(docs: DataFrame) -> DataFrame:
    """docs with every secret in text replaced by [SECRET:kind] and n_chars, if there, counted anew.

    Overlapping secrets become one mark, named after the first. Rows and columns stay, null texts too; an empty
    table gives none.
    """
    names = docs.columns

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {name: batch.column(i) for i, name in enumerate(names)}
            texts = columns["text"].to_pylist()
            for i, t in enumerate(raw_bytes(columns["text"])):
                spans = find_secrets(t) if t else []
                out, at = [], 0
                for s, e, k in spans:
                    if s >= at:
                        out += [texts[i][at:s], f"[SECRET:{k}]"]
                    at = max(at, e)
                if spans:
                    texts[i] = "".join([*out, texts[i][at:]])
            columns["text"] = pa.array(texts, columns["text"].type)
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), schema=batch.schema)

    return docs.mapInArrow(redact, docs.schema)
