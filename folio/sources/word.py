"""Word files of paragraphs, headings, lists and tables."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"


def _paragraph(text: str, style: str | None = None, extra: str = "") -> str:
    props = (f'<w:pStyle w:val="{style}"/>' if style else "") + extra
    legal = "".join(c for c in text if c in "\t\n" or (c >= " " and not 0xD800 <= ord(c) < 0xE000 and c not in "￾￿"))
    return f'<w:p>{f"<w:pPr>{props}</w:pPr>" if props else ""}<w:r><w:t xml:space="preserve">{escape(legal)}</w:t></w:r></w:p>'


def document(blocks: list[dict]) -> bytes:
    """Bytes of a Word file. A block has kind (para, heading, bullet, number, table), text, level, and cells (rows of texts) of a table."""
    body, lists, running = [], 1, False
    for b in blocks:
        kind = b["kind"]
        if kind == "table":
            rows = b.get("cells") or []
            width = max(map(len, rows), default=0)
            if width:
                cells = "".join("<w:tr>" + "".join(f'<w:tc><w:tcPr/>{_paragraph(c or "")}</w:tc>' for c in [*row, *[""] * (width - len(row))]) + "</w:tr>" for row in rows)
                body.append(f'<w:tbl><w:tblPr><w:tblStyle w:val="Grid"/></w:tblPr><w:tblGrid>{"<w:gridCol/>" * width}</w:tblGrid>{cells}</w:tbl><w:p/>')
        elif kind == "heading":
            body.append(_paragraph(b["text"], f"Heading{max(1, min(4, b.get('level') or 1))}"))
        elif kind in ("bullet", "number"):
            if kind == "number" and not running:
                lists += 1
            body.append(_paragraph(b["text"], None, f'<w:numPr><w:ilvl w:val="0"/><w:numId w:val="{1 if kind == "bullet" else lists}"/></w:numPr>'))
        else:
            body.append(_paragraph(b["text"] or ""))
        running = kind == "number"
    level = lambda fmt, text: f'<w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="{fmt}"/><w:lvlText w:val="{text}"/><w:pPr><w:ind w:left="720" w:hanging="360"/></w:pPr></w:lvl>'
    numbering = f'<w:abstractNum w:abstractNumId="0">{level("bullet", "•")}</w:abstractNum><w:abstractNum w:abstractNumId="1">{level("decimal", "%1.")}</w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num>'
    numbering += "".join(f'<w:num w:numId="{k}"><w:abstractNumId w:val="1"/><w:lvlOverride w:ilvl="0"><w:startOverride w:val="1"/></w:lvlOverride></w:num>' for k in range(2, lists + 1))
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="Heading{k}"><w:name w:val="heading {k}"/><w:pPr><w:outlineLvl w:val="{k - 1}"/></w:pPr><w:rPr><w:b/><w:sz w:val="{36 - 4 * k}"/></w:rPr></w:style>' for k in range(1, 5))
    border = "".join(f'<w:{s} w:val="single" w:sz="4"/>' for s in ("top", "left", "bottom", "right", "insideH", "insideV"))
    styles += f'<w:style w:type="table" w:styleId="Grid"><w:name w:val="Table Grid"/><w:tblPr><w:tblBorders>{border}</w:tblBorders></w:tblPr></w:style>'
    rels = lambda rows: f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships">' + "".join(f'<Relationship Id="rId{k}" Type="{_REL}/{t}" Target="{x}"/>' for k, (t, x) in enumerate(rows, 1)) + "</Relationships>"
    kind = "application/vnd.openxmlformats-officedocument.wordprocessingml"
    parts = {
        "[Content_Types].xml": f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>' + "".join(f'<Override PartName="/word/{p}.xml" ContentType="{kind}.{t}+xml"/>' for p, t in (("document", "document.main"), ("styles", "styles"), ("numbering", "numbering"))) + "</Types>",
        "_rels/.rels": rels([("officeDocument", "word/document.xml")]),
        "word/_rels/document.xml.rels": rels([("styles", "styles.xml"), ("numbering", "numbering.xml")]),
        "word/document.xml": f'{_HEAD}<w:document xmlns:w="{_W}"><w:body>{"".join(body)}<w:sectPr/></w:body></w:document>',
        "word/numbering.xml": f'{_HEAD}<w:numbering xmlns:w="{_W}">{numbering}</w:numbering>',
        "word/styles.xml": f'{_HEAD}<w:styles xmlns:w="{_W}">{styles}</w:styles>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def documents(blocks: DataFrame, by: str = "path") -> DataFrame:
    """by, content: a Word file of each group's blocks (block_no, kind, text, level int, cells array<array<string>>)."""
    kind = blocks.schema[by].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by("block_no").to_pylist()
        return pa.table({"key": table.column("key").slice(0, 1), "content": pa.array([document(rows)], pa.binary())})

    return blocks.select(F.col(by).alias("key"), "block_no", "kind", "text", "level", "cells").groupBy("key").applyInArrow(run, f"key {kind}, content binary").withColumnRenamed("key", by)
