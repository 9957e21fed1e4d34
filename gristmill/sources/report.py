"""Reports from small result tables, as Markdown or HTML, swapped into place at the end with the data of their figures."""

from __future__ import annotations

import html
import os
import re
import shutil
import tempfile
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame

#: Rows that a section shows; the section says how many there are beyond.
ROWS = 50
#: Rows that a figure's file holds.
FIGURE_ROWS = 10_000


@dataclass(frozen=True)
class ReportArtifact:
    path: Path
    format: str
    title: str


def _text(value: object) -> str:
    return "" if value is None else f"{value:.6g}" if isinstance(value, float) else str(value)


def _rows(content: DataFrame) -> tuple[list[str], list[list[str]], bool]:
    found = content.limit(ROWS + 1).collect()
    return content.columns, [[_text(v) for v in r] for r in found[:ROWS]], len(found) > ROWS


def _markdown(title: str, sections: Mapping[str, object]) -> str:
    out = [f"# {title}", ""]
    for name, content in sections.items():
        out += [f"## {name}", ""]
        if isinstance(content, DataFrame):
            columns, rows, more = _rows(content)
            escape = lambda x: x.replace("|", "\\|").replace("\n", " ")
            out += ["| " + " | ".join(map(escape, columns)) + " |", "|" + "---|" * len(columns)]
            out += ["| " + " | ".join(map(escape, r)) + " |" for r in rows]
            out += ["", f"First {ROWS} rows."] if more else []
        else:
            out.append(str(content))
        out.append("")
    return "\n".join(out)


def _html(title: str, sections: Mapping[str, object]) -> str:
    e = html.escape
    out = [f"<!doctype html><html><head><meta charset='utf-8'><title>{e(title)}</title></head><body><h1>{e(title)}</h1>"]
    for name, content in sections.items():
        out.append(f"<h2>{e(name)}</h2>")
        if isinstance(content, DataFrame):
            columns, rows, more = _rows(content)
            out.append("<table><tr>" + "".join(f"<th>{e(c)}</th>" for c in columns) + "</tr>")
            out += ["<tr>" + "".join(f"<td>{e(v)}</td>" for v in r) + "</tr>" for r in rows]
            out.append("</table>" + (f"<p>First {ROWS} rows.</p>" if more else ""))
        else:
            out.append(f"<p>{e(str(content))}</p>")
    return "\n".join([*out, "</body></html>"])


def _figures(folder: Path, assets: Mapping[str, DataFrame]) -> list[str]:
    """Each figure's data as a CSV file; at most ``FIGURE_ROWS`` rows, which the last line says."""
    names = []
    for name, data in assets.items():
        found = data.limit(FIGURE_ROWS + 1).collect()
        lines = [",".join(_field(c) for c in data.columns), *(",".join(_field(v) for v in r) for r in found[:FIGURE_ROWS])]
        if len(found) > FIGURE_ROWS:
            lines.append(f"# first {FIGURE_ROWS} rows")
        file = re.sub(r"[^A-Za-z0-9_-]+", "_", name) + ".csv"
        (folder / file).write_text("\n".join(lines) + "\n", encoding="utf-8")
        names.append(file)
    return names


def _field(value: object) -> str:
    text = "" if value is None else str(value)
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in ',"\n') else text


def write_report(sections: Mapping[str, object], output_path: str | Path, *, title: str = "Analysis report", format: str = "markdown", overwrite: bool = True, assets: Mapping[str, DataFrame] | None = None) -> ReportArtifact:
    """``sections`` maps headings to DataFrames or texts; ``assets`` are the data of figures, in a folder ``<name>_assets`` beside.

    Report and folder are made whole under other names and then swapped in together; when a swap fails,
    what was there before comes back.
    """
    if format not in ("markdown", "html"):
        raise ValueError("format must be markdown or html")
    path = Path(output_path)
    if path.suffix not in {"markdown": (".md", ".markdown"), "html": (".html", ".htm")}[format]:
        raise ValueError("the suffix does not match the format")
    folder = path.with_name(path.stem + "_assets")
    if path.is_dir() or (folder.exists() and not folder.is_dir()):
        raise ValueError("the output path is taken")
    if path.exists() and not overwrite:
        raise FileExistsError(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    made = Path(tempfile.mkdtemp(dir=path.parent, prefix=".report-"))
    try:
        (made / "assets").mkdir()
        names = _figures(made / "assets", assets or {})
        whole = dict(sections) | ({"Figures": "\n".join(f"{folder.name}/{n}" for n in names)} if names else {})
        (made / "report").write_text((_markdown if format == "markdown" else _html)(title, whole), encoding="utf-8")
        _swap([(made / "report", path), *([(made / "assets", folder)] if names else [])], made)
    finally:
        shutil.rmtree(made, ignore_errors=True)
    return ReportArtifact(path, format, title)


def _swap(pairs: list[tuple[Path, Path]], keep: Path) -> None:
    done: list[tuple[Path, Path | None]] = []
    try:
        for i, (new, old) in enumerate(pairs):
            before = keep / f"before{i}" if old.exists() else None
            if before is not None:
                os.rename(old, before)
            done.append((old, before))
            os.rename(new, old)
    except OSError:
        for old, before in reversed(done):
            if old.is_dir():
                shutil.rmtree(old, ignore_errors=True)
            else:
                old.unlink(missing_ok=True)
            if before is not None:
                os.rename(before, old)
        raise
