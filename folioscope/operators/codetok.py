"""Code tokens for highlighting: one compiled pattern per language, applied in Arrow batches.

Joining the tokens of a line, and the lines, gives the code back exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions import constants as K
from folioscope.operators.extract import normalize_language

_NUMBER = r"""
    (?:0[xXbBoO][0-9A-Fa-f_]*(?:\.(?!\.)[0-9A-Fa-f_]*)?
      |[0-9][0-9_]*(?:\.(?!\.)[0-9_]*)?(?:[eE](?:[+-](?=[0-9])|(?=[0-9]))[0-9_]*(?:(?<!\.)\.(?!\.)[0-9_]*)?)*)
    (?:[0-9A-Za-z]{1,3}(?![0-9A-Za-z]))?
"""
_WORD = r"(?:[^\W\d]|[$@])(?:\w|\$)*"
_TAG_PART = re.compile(r"""(?P<str>"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)|(?P<type>[A-Za-z0-9\-_:.@#*$]+)|(?P<plain>.)""", re.S)


@cache
def _rules(lang: str) -> tuple[re.Pattern, frozenset, str]:
    name, comments, block, quotes, flags = next((v for k, v in K.RULES.items() if lang in k.split()), K.RULES["generic"])
    parts = []
    if comments:
        parts.append(f"(?P<comment1>(?:{'|'.join(map(re.escape, comments))})[^\\n]*)")
    if block:
        parts.append(f"(?P<comment2>{re.escape(block[0])}.*?(?:{re.escape(block[1])}|\\Z))")
    strings = []
    for q in quotes:
        if "triple" in flags:
            strings.append(f"{q * 3}.*?(?:{q * 3}|\\Z)")
        body = rf"(?:\\.|\\\Z|[^{q}\\{'' if q == '`' else chr(10)}])*{q}?"
        strings.append(f"{q}{body}")
    parts.append(f"(?P<str>{'|'.join(strings)})")
    if "markup" in flags:
        parts.append(r"""(?P<tag><(?:[^>"']|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))*(?:>|\Z))""")
    parts += [f"(?P<number>{_NUMBER.strip()})", f"(?P<word>{_WORD})", r"(?P<plain>.)"]
    words = K.KEYWORDS.get(name, "").split()
    return re.compile("|".join(re.sub(r"\n\s*", "", p) for p in parts), re.S), frozenset(words), flags


_CALLED = re.compile(r"[ \t]*+(?:\(|! *+\()")


def _kind(word: str, code: str, end: int, words: frozenset, flags: str) -> str:
    if word in words or "nocase" in flags and word.lower() in words:
        return "keyword"
    if word[0] == "@" or "capital" in flags and word[0].isupper():
        return "type"
    return "function" if _CALLED.match(code, end) else "plain"


def _pieces(code: str, lang: str | None) -> Iterator[tuple[str, str]]:
    pattern, words, flags = _rules(normalize_language(lang) if lang else "generic")
    for m in pattern.finditer(code):
        group, text = m.lastgroup, m[0]
        if group == "word":
            yield text, _kind(text, code, m.end(), words, flags)
        elif group == "tag":
            head = re.match(r"(<)(/?)([A-Za-z0-9\-_:.@#*$]*)", text)
            yield "<", "plain"
            if head[2]:
                yield "/", "plain"
            if head[3]:
                yield head[3], "keyword"
            for part in _TAG_PART.finditer(text, head.end()):
                yield part[0], part.lastgroup
        else:
            yield text, {"comment1": "comment", "comment2": "comment"}.get(group, group)


def tokenize(code: str, lang: str | None) -> list[list[tuple[str, str]]]:
    """Lines of (text, kind); neighbouring plain pieces outside tags are one token."""
    lines: list[list[tuple[str, str]]] = [[]]
    loose = False
    for text, kind in _pieces(code, lang):
        single = kind == "plain" and len(text) == 1
        for i, part in enumerate(text.split("\n")):
            if i:
                lines.append([])
                loose = False
            if part:
                if single and loose and lines[-1]:
                    lines[-1][-1] = (lines[-1][-1][0] + part, "plain")
                else:
                    lines[-1].append((part, kind))
        loose = single and bool(lines[-1]) and lines[-1][-1][1] == "plain"
    return lines


def code_tokens(blocks: DataFrame, *, keep: tuple[str, ...] = ("page_id", "pos")) -> DataFrame:
    """(keys, line_no, tok_no, text, kind) for rows with ``text`` and ``lang``."""
    narrow = blocks.select(*keep, "text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns))
            found = [(*r[:-2], i, j, t, k) for r in rows for i, line in enumerate(tokenize(r[-2] or "", r[-1])) for j, (t, k) in enumerate(line)]
            columns = list(zip(*found)) if found else [[]] * (len(keep) + 4)
            kinds = [batch.schema.field(n).type for n in keep] + [pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=[*keep, "line_no", "tok_no", "text", "kind"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema[: len(keep)])
    return narrow.mapInArrow(run, f"{kept}, line_no int, tok_no int, text string, kind string")


def code_lines(blocks: DataFrame, *, keep: tuple[str, ...] = ("page_id", "pos")) -> DataFrame:
    """The keys and ``lines``, an array of lines of tokens, in one row for each row with ``text`` and ``lang``."""
    narrow = blocks.select(*keep, "text", "lang")
    token = pa.list_(pa.list_(pa.struct([("text", pa.string()), ("kind", pa.string())])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                made = [[[{"text": t, "kind": k} for t, k in line] for line in tokenize(c or "", x)] for c, x in zip(part.column(len(keep)).to_pylist(), part.column(len(keep) + 1).to_pylist())]
                yield pa.record_batch([*part.columns[:-2], pa.array(made, token)], names=[*keep, "lines"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema[: len(keep)])
    return narrow.mapInArrow(run, f"{kept}, lines array<array<struct<text:string,kind:string>>>")


def token_styles(tokens: DataFrame, palette: DataFrame) -> DataFrame:
    """Tokens with their colour from a palette (role, colour); comments are italic."""
    role = F.when(F.col("kind") == "str", "string").otherwise(F.col("kind"))
    return tokens.withColumn("role", role).join(palette, "role", "left").withColumn("italic", F.col("kind") == "comment")
