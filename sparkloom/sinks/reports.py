"""Report sinks: CSV, JSON, Markdown, HTML and heat maps as PNG, of small result relations."""

from __future__ import annotations

import csv
import datetime
import html
import json
import math
import os
import struct
import sys
import zlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame


def rows_of(df: DataFrame, limit: int | None = None) -> tuple[list[str], list[list]]:
    """Names and rows of a result; streamed, never more than a partition at once."""
    source = df.limit(limit) if limit else df
    return df.columns, [list(r) for r in source.toLocalIterator()]


def write_csv(df: DataFrame, path: str) -> str:
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow(df.columns)
        for r in df.toLocalIterator():
            out.writerow(["" if x is None else x for x in r])
    return path


def clean(x):
    """What JSON can hold: NaN and infinities as null, keys and odd values as text."""
    if isinstance(x, dict):
        return {str(k): clean(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [clean(v) for v in x]
    if isinstance(x, float):
        return x if math.isfinite(x) else None
    return x if x is None or isinstance(x, (str, int, bool)) else str(x)


def write_json(data: dict, path: str) -> str:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(clean(data), f, indent=2, ensure_ascii=False)
    return path


def markdown_table(columns: list[str], rows: Iterable[list]) -> str:
    cells = [[("" if x is None else str(x)).replace("|", r"\|").replace("\n", " ") for x in r] for r in rows]
    if not cells:
        return "No rows."
    width = [max(len(c), *(len(r[i]) for r in cells)) for i, c in enumerate(columns)]
    line = lambda r: "| " + " | ".join(x.ljust(w) for x, w in zip(r, width, strict=True)) + " |"
    return "\n".join([line(columns), "| " + " | ".join("-" * w for w in width) + " |", *map(line, cells)])


def html_table(columns: list[str], rows: Iterable[list]) -> str:
    head = "".join(f"<th>{html.escape(c)}</th>" for c in columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape('' if x is None else str(x))}</td>" for x in r) + "</tr>" for r in rows)
    return f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"


def markdown_source(text: str) -> str:
    """The Markdown of a report, escaped, in a collapsed element."""
    return f'<details class="markdown-source"><summary>Markdown</summary><pre>{html.escape(text)}</pre></details>'


def report(title: str, metadata: dict, sections: dict[str, tuple[list[str], list[list]]], notes: Iterable[str] = ()) -> tuple[str, str]:
    """(Markdown, HTML) of a module's result: its notes and metadata, then a table a relation."""
    notes = list(notes)
    meta = [[k, json.dumps(clean(v), ensure_ascii=False)] for k, v in metadata.items()]
    parts = {"Summary": (["key", "value"], meta), **sections}
    listed = "".join(f"- {n}\n" for n in notes) + "\n" if notes else ""
    md = f"# {title}\n\n{listed}" + "\n\n".join(f"## {name}\n\n{markdown_table(c, r)}" for name, (c, r) in parts.items()) + "\n"
    body = "".join(f"<h2>{html.escape(name)}</h2>{html_table(c, r)}" for name, (c, r) in parts.items())
    told = "<ul>" + "".join(f"<li>{html.escape(n)}</li>" for n in notes) + "</ul>" if notes else ""
    return md, f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>{told}{body}{markdown_source(md)}</body></html>\n'


def heat_map(columns: list[str], rows: list[str], values: dict[tuple[str, str], float], path: str, cell: int = 18, most: int = 80) -> str:
    """A PNG of values from -1 (blue) over 0 (white) to 1 (red); missing ones count as 0, and without cells it is one white square."""
    columns, rows = columns[:most] or [""], rows[:most] or [""]

    def colour(v: float) -> bytes:
        v = max(-1.0, min(1.0, v or 0.0))
        fade = int(round(255 * (1 - abs(v))))
        return bytes((255, fade, fade) if v >= 0 else (fade, fade, 255))

    lines = bytearray()
    for r in rows:
        line = b"".join(colour(values.get((r, c), 0.0)) * cell for c in columns)
        lines += (b"\0" + line) * cell
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    size = struct.pack(">IIBBBBB", cell * len(columns), cell * len(rows), 8, 2, 0, 0, 0)
    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", size) + chunk(b"IDAT", zlib.compress(bytes(lines))) + chunk(b"IEND", b""))
    return path


def now() -> str:
    return datetime.datetime.now(datetime.timezone.utc).isoformat()


class Progress:
    """Labelled steps on stderr, if that is a terminal, and as Spark's job description."""

    def __init__(self, spark=None, total: int = 0, show: bool | None = None) -> None:
        self.spark, self.total, self.done = spark, total, 0
        self.show = sys.stderr.isatty() if show is None else show
        self.steps: list[str] = []

    def step(self, label: str) -> None:
        self.done += 1
        self.steps.append(label)
        if self.spark is not None:
            self.spark.sparkContext.setJobDescription(label)
        if self.show:
            print(f"[{self.done}/{self.total or '?'}] {label}", file=sys.stderr)

    def wrap(self, items: Iterable, label) -> Iterator:
        for x in items:
            self.step(label(x))
            yield x


def ensure_folder(path: str) -> str:
    os.makedirs(path, exist_ok=True)
    return path
