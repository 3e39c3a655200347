"""Small DOCX files made from texts: for samples, tests and round trips."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

_NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_TYPES = (
    '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
    '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
    '<Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
)
_RELS = (
    '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
)


def paragraph(runs) -> str:
    """Paragraph from a text or from runs, each a text or (text, property tag such as ``b``)."""
    parts = []
    for run in [runs] if isinstance(runs, str) else runs:
        text, mark = (run, "") if isinstance(run, str) else run
        props = f"<w:rPr><w:{mark}/></w:rPr>" if mark else ""
        parts.append(f'<w:r>{props}<w:t xml:space="preserve">{escape(text)}</w:t></w:r>')
    return f"<w:p>{''.join(parts)}</w:p>"


def table(rows) -> str:
    """Table from rows of cells, each a text, or ready-made XML of a cell's content."""
    cell = lambda c: c if c.startswith("<w:tc>") else f"<w:tc>{paragraph(c)}</w:tc>"
    return f"<w:tbl>{''.join(f'<w:tr>{"".join(cell(c) for c in row)}</w:tr>' for row in rows)}</w:tbl>"


def build(blocks, header: str | None = None, footer: str | None = None) -> bytes:
    """A DOCX from paragraphs (texts, runs) and ready-made XML blocks."""
    body = "".join(b if isinstance(b, str) and b.startswith("<w:") else paragraph(b) for b in blocks)
    files, rels, refs = {}, [], ""
    for k, (kind, text) in enumerate((("header", header), ("footer", footer)), 2):
        if text is not None:
            tag = "hdr" if kind == "header" else "ftr"
            files[f"word/{kind}1.xml"] = f"<w:{tag} {_NS}>{paragraph(text)}</w:{tag}>"
            rels.append(f'<Relationship Id="rId{k}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/{kind}" Target="{kind}1.xml"/>')
            refs += f'<w:{kind}Reference w:type="default" r:id="rId{k}"/>'
    document = f'<?xml version="1.0" encoding="UTF-8"?><w:document {_NS}><w:body>{body}<w:sectPr>{refs}</w:sectPr></w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", _TYPES)
        z.writestr("_rels/.rels", _RELS)
        z.writestr("word/document.xml", document)
        z.writestr("word/_rels/document.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{"".join(rels)}</Relationships>')
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def build_batches(batches):
    """For mapInPandas: (doc_id, texts) to (doc_id, content): a heading, a table of the texts, a paragraph each."""
    import pandas as pd

    for frame in batches:
        made = [build([f"Region {d}", table([["Name", "Designation"], *([t, "Member"] for t in texts)]), *texts], header=f"Header {d}", footer="Page") for d, texts in zip(frame["doc_id"], frame["texts"], strict=True)]
        yield pd.DataFrame({"doc_id": frame["doc_id"], "content": made})
