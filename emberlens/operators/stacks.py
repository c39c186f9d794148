"""Stack fingerprints: exception type, frames and causes of stack texts of five forms."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_FRAMES, MOST_CAUSES = 128, 8
SCHEMA = "form string, quality string, exception_type string, frames array<string>, causes array<string>, truncated boolean, fingerprint string"
_HEAD = re.compile(r"\s*([A-Za-z][A-Za-z0-9._$]*)\s*(?::|$)")
_JAVA = re.compile(r"at ([^(]*\.[^(]*)\((?:[^()]*\.(?:java|kt|scala):\d+|Native Method|Unknown Source)\)*$")
_DOTNET = re.compile(r"at ([^(]*\.[^(]*)\(.*\)(?:.* in .*)?$")
_PY_FRAME = re.compile(r'File "([^"]*)".* in (\S+)$')
_NODE = re.compile(r"at (?:async )?(?:(.+?) \()?([^:()]*)")


def _head(line: str) -> str:
    m = _HEAD.match(line)
    return m[1] if m else ""


def _base(path: str) -> str:
    return re.split(r"[/\\]", path)[-1]


def _java(lines: list[str]) -> tuple[str, list[str], list[str]]:
    kind, frames, causes = "", [], []
    for line in map(str.strip, lines):
        if m := _JAVA.match(line):
            frames.append(m[1].strip())
        elif line.startswith("Caused by: "):
            causes += filter(None, [_head(line[11:])])
        elif not kind and "." in (h := _head(line)) and not line.startswith(("Suppressed: ", "... ")):
            kind = h
    return kind, frames, causes


def _dotnet(lines: list[str]) -> tuple[str, list[str], list[str]]:
    kind, frames, causes = "", [], []
    for line in map(str.strip, lines):
        if ".java" not in line and (m := _DOTNET.match(line)):
            frames.append(m[1].strip())
        elif line.startswith("---> "):
            causes += filter(None, [_head(line[5:])])
        elif not kind and ((h := _head(line)).startswith("System.") or "Exception" in h):
            kind = h
    return kind, frames, causes


def _python(lines: list[str]) -> tuple[str, list[str], list[str]]:
    kind, frames, causes, seen = "", [], [], False
    for raw in lines:
        line = raw.strip()
        if line.startswith("Traceback (most recent call last)"):
            causes += filter(None, [kind])
            kind, seen = "", True
        elif seen and line.startswith('File "'):
            if m := _PY_FRAME.match(line):
                frames.append(f"{m[2]}@{_base(m[1])}")
        elif seen and raw[:1].strip() and (h := _head(line)):
            kind = h
    return (kind, frames, causes) if seen else ("", [], [])


def _go(lines: list[str]) -> tuple[str, list[str], list[str]]:
    kind, frames, running, call = "", [], False, None
    for raw in lines:
        line = raw.rstrip()
        if line.startswith("panic: "):
            head = re.split(r"[:(]", line[7:])[0].strip()
            kind = kind or (head and "panic:" + head.replace(" ", "-"))
        elif line.startswith("goroutine ") and line.endswith(":"):
            running = True
        elif running and raw[:1] not in ("\t", " "):
            name = line.split("(")[0].strip()
            call = name if "." in name else call
        elif running and call:
            frames.append(f"{call}@{_base(line.strip().split(':')[0])}")
            call = None
    return kind, frames, []


def _node(lines: list[str]) -> tuple[str, list[str], list[str]]:
    kind, frames = "", []
    for line in map(str.strip, lines):
        if line.startswith("at "):
            m = _NODE.match(line)
            frames.append(f"{m[1] or '<anonymous>'}@{_base(m[2])}")
        elif not kind and _head(line).endswith(("Error", "Exception")):
            kind = _head(line)
    return kind, frames, []


#: In the order of trial: the first that finds a type and frames, else the first that finds either.
FORMS = {"java": _java, "dotnet": _dotnet, "python": _python, "go": _go, "node": _node}


def parse(text: str | None) -> tuple:
    lines = (text or "").splitlines()
    found = [(form, *of(lines)) for form, of in FORMS.items()]
    whole = [f for f in found if f[1] and f[2]]
    part = [f for f in found if f[1] or f[2]]
    form, kind, frames, causes = (whole or part or [("none", "", [], [])])[0]
    quality = "parsed" if whole else "partial" if part else "malformed"
    cut = len(frames) > MOST_FRAMES or len(causes) > MOST_CAUSES
    frames, causes = frames[:MOST_FRAMES], causes[:MOST_CAUSES]
    pieces = [form, kind, "1" if cut else "0", *frames, "|", *causes]
    digest = hashlib.sha256("".join(f"{len(p.encode())}:{p}" for p in pieces).encode()).hexdigest()[:32]
    return form, quality, kind, frames, causes, cut, f"stk-{digest}"


def _parsed(texts: pd.Series) -> pd.DataFrame:
    names = ["form", "quality", "exception_type", "frames", "causes", "truncated", "fingerprint"]
    return pd.DataFrame([parse(t) for t in texts], columns=names)


def stack(text: Column) -> Column:
    """A stack text taken apart, as a struct. Its lines depend on those before, which no built-in function follows."""
    return F.pandas_udf(_parsed, SCHEMA)(text)
