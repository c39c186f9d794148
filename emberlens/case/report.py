"""Reports of a case in Markdown or HTML, and bundles that carry it."""

from __future__ import annotations

import hashlib
import html
import io
import json
import zipfile
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of evidence that a bundle carries at most, entries of each section that a report shows, and the version of both.
MOST_ROWS, MOST_ENTRIES, VERSION = 200_000, 5_000, 1
_EPOCH = (1980, 1, 1, 0, 0, 0)


def _time(nanos: int | None) -> str:
    if nanos is None:
        return "undated"
    seconds, rest = divmod(nanos, 1_000_000_000)
    return datetime.fromtimestamp(seconds, timezone.utc).strftime("%Y-%m-%dT%H:%M:%S") + (f".{rest:09d}" if rest else "") + "Z"


def _sections(title: str, timeline: DataFrame, states: DataFrame, findings: DataFrame | None, most: int = MOST_ENTRIES) -> list[tuple[str, list[str], list[list[str]]]]:
    """The first ``most`` entries of each section; a last line says how many more there are."""

    def shown(rows: DataFrame, order: list[str], cells) -> list[list[str]]:
        first = rows.orderBy(*order).limit(most + 1).collect()
        out = [cells(r) for r in first[:most]]
        if len(first) > most:
            out.append([f"and {rows.count() - most} more", *[""] * (len(out[0]) - 1)])
        return out

    entry = lambda r: [_time(r["at"]) if r["at"] is not None else f"undated: {r['undated_reason']}", r["kind"], r["id"], r["title"] or ""]
    named = lambda *names: lambda r: [str(r[c]) for c in names]
    out = [
        ("Timeline", ["time", "kind", "id", "title"], shown(timeline, ["place"], entry)),
        ("Evidence", ["id", "state", "resolved", "expected"], shown(states, ["evidence_id"], named("evidence_id", "state", "resolved", "expected"))),
    ]
    if findings is not None:
        out.append(("Findings", ["rule", "subject", "severity", "measured"], shown(findings, ["rule", "subject"], named("rule", "subject", "severity", "measured"))))
    return out


def markdown(title: str, timeline: DataFrame, states: DataFrame, findings: DataFrame | None = None) -> str:
    cell = lambda x: x.replace("\\", "\\\\").replace("|", "\\|").replace("\n", " ")
    parts = [f"# {cell(title)}"]
    for name, head, rows in _sections(title, timeline, states, findings):
        parts += ["", f"## {name}", "", f"| {' | '.join(head)} |", f"|{'-|' * len(head)}", *(f"| {' | '.join(map(cell, r))} |" for r in rows)]
    return "\n".join(parts) + "\n"


def web(title: str, timeline: DataFrame, states: DataFrame, findings: DataFrame | None = None) -> str:
    row = lambda cells, tag: "<tr>" + "".join(f"<{tag}>{html.escape(c)}</{tag}>" for c in cells) + "</tr>"
    body = "".join(f"<h2>{name}</h2><table>{row(head, 'th')}{''.join(row(r, 'td') for r in rows)}</table>" for name, head, rows in _sections(title, timeline, states, findings))
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>{body}\n"


def subset(pins: DataFrame, logs: DataFrame, most: int | None = None) -> DataFrame:
    """The rows that pins name, by a semi join of their ids: all, or the first ``most`` by record id."""
    ids = pins.select("dataset_id", F.explode("record_ids").alias("record_id")).distinct()
    rows = logs.join(ids, ["dataset_id", "record_id"], "left_semi")
    return rows if most is None else rows.orderBy("record_id", "dataset_id").limit(most)


def write_subset(pins: DataFrame, logs: DataFrame, path: str) -> int:
    """Writes all rows that pins name as a Parquet table, however many, and returns their number: what a bundle of a large case
    goes with. Rows under a redaction profile don't leave this way."""
    subset(pins, logs).write.option("compression", "zstd").parquet(path)
    return logs.sparkSession.read.parquet(path).count()


def bundle(title: str, pins: DataFrame, timeline: DataFrame, states: DataFrame, rows: DataFrame | None = None, investigation: dict | None = None, most: int = MOST_ROWS) -> bytes:
    """A ZIP of the case, the same bytes for the same case. ``rows`` go in as JSON lines, at most ``most`` of these, of pins
    and of the timeline each; the manifest says how many of each there are and how many were cut. ``investigation`` may have
    hypotheses, items and groups, which are files of their own."""
    cut = {}

    def lines(name: str, df: DataFrame, *order: str) -> bytes:
        some = df.orderBy(*order).limit(most + 1).toJSON().collect()
        cut[name] = {"rows": min(len(some), most), "cut": df.count() - most if len(some) > most else 0}
        return "".join(x + "\n" for x in sorted(some[:most])).encode()

    files = {
        "evidence/evidence.jsonl": lines("evidence", pins, "evidence_id"), "timeline/timeline.jsonl": lines("timeline", timeline, "place"), "evidence/states.jsonl": lines("states", states, "evidence_id"),
        "reports/report.md": markdown(title, timeline, states).encode(),
    }
    for name, value in (investigation or {}).items():
        files[f"investigation/{name}.json"] = json.dumps(value, sort_keys=True).encode()
    if rows is not None:
        files["data/logs.jsonl"] = lines("data", rows, "record_id")
    files["manifest.json"] = json.dumps({"version": VERSION, "title": title, "entries": sorted(files), "rows": cut}, sort_keys=True).encode()
    files["checksums.sha256"] = "".join(f"{hashlib.sha256(files[n]).hexdigest()}  {n}\n" for n in sorted(files)).encode()
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(files):
            z.writestr(zipfile.ZipInfo(name, _EPOCH), files[name], zipfile.ZIP_DEFLATED)
    return out.getvalue()


def open_bundle(data: bytes, most_bytes: int = 1 << 30) -> dict[str, bytes]:
    """The files of a bundle whose names, sizes and checksums are in order; else ValueError."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        if len(set(names)) < len(names) or any(n.startswith(("/", "\\")) or ".." in n.split("/") or "\\" in n or ":" in n for n in names):
            raise ValueError("a bundle has plain, distinct names")
        if sum(i.file_size for i in z.infolist()) > most_bytes:
            raise ValueError("the bundle is too large")
        files = {n: z.read(n) for n in names}
    sums = dict(reversed(x.split("  ", 1)) for x in files.pop("checksums.sha256", b"").decode().splitlines())
    if set(sums) != set(files) or any(hashlib.sha256(files[n]).hexdigest() != s for n, s in sums.items()):
        raise ValueError("the bundle's files aren't those of its checksums")
    return files
