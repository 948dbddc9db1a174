"""The texts that the tools return.  Result rows are few, so they are rendered in Python,
which also rounds scores as binary numbers (Spark's format_string rounds their decimals)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

Row = Mapping[str, object]


def _body(row: Row) -> str:
    return f"  ---\n{str(row['text']).strip()}"


def search(rows: Iterable[Row]) -> str:
    shown = []
    for i, r in enumerate(rows, 1):
        head = f"[{i}] {str(r['env_type']).upper()}  (score: {r['score']:.3f}, view: {r['matched_view']})"
        extra = [f"  {name:<8} {r[key]}" for name, key in (("section:", "section"), ("label:", "label")) if r[key]]
        shown.append("\n".join([head, f"  file: {r['source_file']}", *extra, _body(r)]))
    return "\n\n".join(shown) or "No results found."


def label(row: Row | None, asked: str, folder: str | None = None) -> str:
    if row is None:
        return f"No block with label '{asked}' found{f' in {folder}' if folder else ''}."
    section = [f"  section: {row['section']}"] if row["section"] else []
    return "\n".join([f"{str(row['env_type']).upper()}  (label: {row['label']})", f"  file: {row['source_file']}", *section, _body(row)])


FOLDERS = "Indexed folders:"


def folder_line(r: Row) -> str:
    return f"  {r['folder']}  ({r['file_count']} file(s), {r['block_count']} block(s))"


def folders(rows: Iterable[Row]) -> str:
    lines = [folder_line(r) for r in rows]
    return "\n".join([FOLDERS, *lines]) if lines else "No folders indexed yet."


def indexed(files: int, blocks: int, folder: str) -> str:
    return f"Indexed {files} file(s), {blocks} block(s) from {folder}." if blocks else f"No theorem-like blocks found in {folder}."


def removed(n: int, folder: str) -> str:
    return f"Removed {n} block(s) from {folder}." if n else f"No indexed blocks found for {folder}."
