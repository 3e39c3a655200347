"""DOCX files as units of text, and back, with zipfile and ElementTree.

Units come in document order: body paragraphs and table cells (row by row, nested tables
after their cell's paragraphs), then headers and footers by section. The counter in
``unit_id`` runs over all kinds. Unlike a plain run list, hyperlink and insertion runs are part of
a unit, and paragraphs are told apart by part and path, so separate headers never hide each other.
"""

from __future__ import annotations

import hashlib
import io
import re
import uuid
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.schema import UNITS
from textguard.sources import workers

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_BREAKS = {f"{W}tab": "\t", f"{W}br": "\n", f"{W}cr": "\n", f"{W}noBreakHyphen": "-"}
_HOLDERS = {f"{W}hyperlink", f"{W}ins", f"{W}smartTag"}
MAIN = "word/document.xml"


def run_text(run: ET.Element) -> str:
    return "".join(x.text or "" if x.tag == f"{W}t" else _BREAKS.get(x.tag, "") for x in run)


def set_run_text(run: ET.Element, text: str) -> None:
    """Put a new text into a run: tabs and line breaks are elements, and those the run had are used again, with their attributes."""
    old = [x for x in run if x.tag == f"{W}t" or x.tag in _BREAKS]
    at = list(run).index(old[0]) if old else len(run)
    spare = {c: [x for x in old if _BREAKS.get(x.tag) == c] for c in "\t\n"}
    for child in old:
        run.remove(child)
    for k, part in enumerate(p for p in re.split(r"([\t\n])", text) if p):
        if part in spare:
            node = spare[part].pop(0) if spare[part] else ET.Element(f"{W}tab" if part == "\t" else f"{W}br")
        else:
            node = ET.Element(f"{W}t", {"{http://www.w3.org/XML/1998/namespace}space": "preserve"})
            node.text = part
        run.insert(at + k, node)


def runs_of(paragraph: ET.Element) -> list[ET.Element]:
    """Runs of a paragraph in order, those inside links and insertions included."""
    out = []
    for child in paragraph:
        if child.tag == f"{W}r":
            out.append(child)
        elif child.tag in _HOLDERS:
            out += runs_of(child)
    return out


def _cells(table: ET.Element, table_id: int | None, path: str) -> Iterator[tuple]:
    """(kind, paragraph, path, table_id, row, col) of a table; continued merged cells hold nothing of their own."""
    for r, row in enumerate(table.findall(f"{W}tr")):
        col = 0
        for c, cell in enumerate(row.findall(f"{W}tc")):
            props = cell.find(f"{W}tcPr")
            merge = props.find(f"{W}vMerge") if props is not None else None
            span = props.find(f"{W}gridSpan") if props is not None else None
            here = f"{path}/tr[{r}]/tc[{c}]"
            if merge is None or merge.get(f"{W}val") == "restart":
                for k, p in enumerate(cell.findall(f"{W}p")):
                    yield "cell", p, f"{here}/p[{k}]", table_id, r, col
                for k, nested in enumerate(cell.findall(f"{W}tbl")):
                    yield from _cells(nested, None, f"{here}/tbl[{k}]")
            col += int(span.get(f"{W}val", "1")) if span is not None else 1


def _margins(files: dict[str, bytes], body: ET.Element) -> Iterator[tuple[int, str, str]]:
    """(section, kind, part) of headers and footers, each part once."""
    rels = files.get("word/_rels/document.xml.rels")
    target = {x.get("Id"): x.get("Target") for x in ET.fromstring(rels)} if rels else {}
    seen = set()
    for number, section in enumerate(body.iter(f"{W}sectPr")):
        for tag, kind in ((f"{W}headerReference", "header"), (f"{W}footerReference", "footer")):
            for ref in section.findall(tag):
                part = f"word/{(target.get(ref.get(f'{R}id')) or '').removeprefix('/word/')}"
                if part in files and part not in seen:
                    seen.add(part)
                    yield number, kind, part


def paragraphs(files: dict[str, bytes]) -> Iterator[tuple]:
    """(unit_id, kind, part, path, table_id, row, col, paragraph, root of its part) in document order."""
    root = ET.fromstring(files[MAIN])
    body, n, tables = root.find(f"{W}body"), 0, 0
    for k, block in enumerate(body):
        if block.tag == f"{W}p":
            yield f"body-{n}", "body", MAIN, f"body/{k}", None, None, None, block, root
            n += 1
        elif block.tag == f"{W}tbl":
            for kind, p, path, table_id, row, col in _cells(block, tables, f"body/{k}"):
                yield f"cell-{n}", kind, MAIN, path, table_id, row, col, p, root
                n += 1
            tables += 1
    for section, kind, part in _margins(files, body):
        margin = ET.fromstring(files[part])
        for k, p in enumerate(margin.findall(f"{W}p")):
            yield f"{'hdr' if kind == 'header' else 'ftr'}-{section}-{n}", kind, part, f"p[{k}]", None, None, None, p, margin
            n += 1


def unzip(content: bytes) -> dict[str, bytes]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return {i.filename: z.read(i) for i in z.infolist()}


def parse(content: bytes) -> list[dict]:
    """Units of one file, without doc_id."""
    out = []
    for ordinal, (unit_id, kind, part, path, table_id, row, col, p, _) in enumerate(paragraphs(unzip(content))):
        runs, at = [], 0
        for i, run in enumerate(runs_of(p)):
            text = run_text(run)
            runs.append({"idx": i, "start": at, "end": at + len(text), "text": text})
            at += len(text)
        out.append({"unit_id": unit_id, "ordinal": ordinal, "kind": kind, "part": part, "xml_path": path, "table_id": table_id, "row": row, "col": col, "text": "".join(r["text"] for r in runs), "runs": runs})
    return out


def _serialize(root: ET.Element, original: bytes) -> bytes:
    """XML of a part with its prefixes as they were, unused declarations included."""
    declared = {prefix: uri for _, (prefix, uri) in ET.iterparse(io.BytesIO(original), ["start-ns"])}
    for prefix, uri in declared.items():
        if prefix and not prefix.startswith("ns"):
            ET.register_namespace(prefix, uri)
    used = {name.split("}")[0][1:] for x in root.iter() for name in (x.tag, *x.attrib) if isinstance(name, str) and name.startswith("{")}
    for prefix, uri in declared.items():
        if prefix and uri not in used:
            root.set(f"xmlns:{prefix}", uri)
    return ET.tostring(root, encoding="UTF-8", xml_declaration=True)


def patch(content: bytes, changes: dict[str, list[str]]) -> bytes:
    """The file with new run texts by unit id. Runs whose text stays are not touched, nor is any other part."""
    files, roots = unzip(content), {}
    for unit_id, _, part, _, _, _, _, p, root in paragraphs(files):
        if unit_id not in changes:
            continue
        roots[part] = root
        for run, text in zip(runs_of(p), changes[unit_id], strict=True):
            if run_text(run) == text:
                continue
            set_run_text(run, text)
    if len({id(r) for r in roots.values()}) < len(roots):
        raise ValueError("parts share a tree")
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for info in old.infolist():
            data = _serialize(roots[info.filename], files[info.filename]) if info.filename in roots else files[info.filename]
            new.writestr(info, data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def _parse_batches(batches):
    import pandas as pd

    names = ["doc_id", "unit_id", "ordinal", "kind", "part", "xml_path", "table_id", "row", "col", "text", "runs"]
    for frame in batches:
        for doc_id, content in zip(frame["doc_id"], frame["content"], strict=True):
            rows = [u | {"doc_id": doc_id} for u in parse(bytes(content))]
            out = pd.DataFrame(rows, columns=names)
            for c in ("table_id", "row", "col"):
                out[c] = out[c].astype("Int32")
            yield out


def units_of(files: DataFrame) -> DataFrame:
    """Units of files given as rows (doc_id, content)."""
    workers.ship(files.sparkSession)
    return files.select("doc_id", "content").mapInPandas(_parse_batches, UNITS)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, content) of the files below a path, in subfolders too; doc_id is the whole path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("doc_id"), "content")


def _patch_batches(batches):
    import pandas as pd

    for frame in batches:
        done = [patch(bytes(c), {u["unit_id"]: list(u["texts"]) for u in (units if units is not None else [])}) for c, units in zip(frame["content"], frame["units"], strict=True)]
        yield pd.DataFrame({"doc_id": frame["doc_id"], "content": done})


def rewritten_files(files: DataFrame, changed: DataFrame) -> DataFrame:
    """(doc_id, content) with the runs of ``changed`` (doc_id, unit_id, texts) put in."""
    workers.ship(files.sparkSession)
    by_doc = changed.groupBy("doc_id").agg(F.collect_list(F.struct("unit_id", "texts")).alias("units"))
    return files.join(by_doc, "doc_id", "left").select("doc_id", "content", "units").mapInPandas(_patch_batches, "doc_id string, content binary")


_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?"


def relative_name(doc_id: str, source: str) -> str:
    """A file's path below its source; elsewhere its name behind a digest of its path, so that no two files share one."""
    path, root = re.sub(_SCHEME, "", doc_id), re.sub(_SCHEME, "", source).rstrip("/") + "/"
    if path.startswith(root):
        return path[len(root) :]
    return f"{hashlib.sha256(doc_id.encode()).hexdigest()[:12]}-{path.rsplit('/', 1)[-1]}"


def name_below(doc_id: Column, source: str) -> Column:
    """``relative_name`` of a column."""
    path, root = F.regexp_replace(doc_id, _SCHEME, ""), re.sub(_SCHEME, "", source).rstrip("/") + "/"
    apart = F.concat(F.substring(F.sha2(doc_id.cast("binary"), 256), 1, 12), F.lit("-"), F.element_at(F.split(path, "/"), -1))
    return F.when(path.startswith(root), F.substring(path, F.lit(len(root) + 1), F.length(path))).otherwise(apart)


def save_files(files: DataFrame, folder: str, source: str) -> None:
    """One file per row below a folder that all executors reach (a shared path or a store's URI), placed as below ``source``.

    A file is written under a name of its own and then moved, so a task that runs twice leaves one whole file.
    """

    def save(rows):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder) if re.match(_SCHEME, folder) else (fs.LocalFileSystem(), folder)
        for r in rows:
            path = f"{base.rstrip('/')}/{relative_name(r['doc_id'], source)}"
            store.create_dir(path.rsplit("/", 1)[0], recursive=True)
            part = f"{path}.{uuid.uuid4().hex}.part"
            with store.open_output_stream(part) as out:
                out.write(bytes(r["content"]))
            store.move(part, path)

    workers.ship(files.sparkSession)
    files.foreachPartition(save)
