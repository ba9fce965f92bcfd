"""Minimal writers of spreadsheet, document and slide files: XML parts in a ZIP, fed row by row."""

from __future__ import annotations

import zipfile
from collections.abc import Iterable, Iterator
from xml.sax.saxutils import escape

# The names of the formats' parts.
TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
LINKS = "http://schemas.openxmlformats.org/package/2006/relationships"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
SLIDE = "http://schemas.openxmlformats.org/presentationml/2006/main"
DRAW = "http://schemas.openxmlformats.org/drawingml/2006/main"
KIND = "application/vnd.openxmlformats-officedocument"
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'


def _text(value: object) -> str:
    """XML text; characters that XML has no place for become a space."""
    return escape("".join(c if c >= " " or c in "\t\n\r" else " " for c in str(value)))


def _parts(book: zipfile.ZipFile, main: str, kind: str, parts: list[tuple[str, str]]) -> None:
    overrides = "".join(f'<Override PartName="/{n}" ContentType="{KIND}.{k}+xml"/>' for n, k in [(main, kind), *parts])
    book.writestr("[Content_Types].xml", f'{HEAD}<Types xmlns="{TYPES}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{overrides}</Types>')
    book.writestr("_rels/.rels", f'{HEAD}<Relationships xmlns="{LINKS}"><Relationship Id="rId1" Type="{OFFICE}/officeDocument" Target="{main}"/></Relationships>')


def _column(i: int) -> str:
    out, i = "", i + 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def _cell(at: str, value: object) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)) and value == value and abs(value) != float("inf"):
        return f'<c r="{at}"><v>{value!r}</v></c>'
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{_text(value)}</t></is></c>'


def write_workbook(path: str, sheets: Iterable[tuple[str, list[str], Iterator[tuple]]]) -> int:
    """One sheet for each ``(title, columns, rows)``; titles are cut to 31 characters. Gives the number of rows."""
    total, titles = 0, []
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        for title, columns, rows in sheets:
            titles.append(title[:31])
            with book.open(f"xl/worksheets/sheet{len(titles)}.xml", "w") as part:
                part.write(f'{HEAD}<worksheet xmlns="{SHEET}"><sheetData>'.encode())
                line = 0
                for line, row in enumerate([tuple(columns)], 1):
                    part.write(f'<row r="{line}">{"".join(_cell(f"{_column(i)}{line}", v) for i, v in enumerate(row))}</row>'.encode())
                for line, row in enumerate(rows, 2):
                    part.write(f'<row r="{line}">{"".join(_cell(f"{_column(i)}{line}", v) for i, v in enumerate(row))}</row>'.encode())
                    total += 1
                part.write(b"</sheetData></worksheet>")
        _parts(book, "xl/workbook.xml", "spreadsheetml.sheet.main", [(f"xl/worksheets/sheet{i}.xml", "spreadsheetml.worksheet") for i in range(1, len(titles) + 1)])
        listed = "".join(f'<sheet name="{_text(t)}" sheetId="{i}" r:id="rId{i}"/>' for i, t in enumerate(titles, 1))
        book.writestr("xl/workbook.xml", f'{HEAD}<workbook xmlns="{SHEET}" xmlns:r="{OFFICE}"><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Type="{OFFICE}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(titles) + 1))
        book.writestr("xl/_rels/workbook.xml.rels", f'{HEAD}<Relationships xmlns="{LINKS}">{links}</Relationships>')
    return total


def _paragraph(text: object, style: str = "") -> str:
    look = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f'<w:p>{look}<w:r><w:t xml:space="preserve">{_text(text)}</w:t></w:r></w:p>'


def write_document(path: str, title: str, parts: Iterable[tuple[str, list[str], Iterator[tuple]] | str]) -> int:
    """A heading, then paragraphs (texts) and tables ``(heading, columns, rows)``. Gives the number of rows."""
    total = 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        with book.open("word/document.xml", "w") as out:
            out.write(f'{HEAD}<w:document xmlns:w="{WORD}"><w:body>{_paragraph(title, "Heading1")}'.encode())
            for part in parts:
                if isinstance(part, str):
                    out.write(_paragraph(part).encode())
                    continue
                heading, columns, rows = part
                row_xml = lambda row: "<w:tr>" + "".join(f"<w:tc>{_paragraph('' if v is None else v)}</w:tc>" for v in row) + "</w:tr>"
                out.write(f'{_paragraph(heading, "Heading2")}<w:tbl>{row_xml(columns)}'.encode())
                for row in rows:
                    out.write(row_xml(row).encode())
                    total += 1
                out.write(f"</w:tbl>{_paragraph('')}".encode())
            out.write(b"</w:body></w:document>")
        _parts(book, "word/document.xml", "wordprocessingml.document.main", [])
    return total


def _shape(n: int, name: str, lines: list[str], top: int) -> str:
    body = "".join(f"<a:p><a:r><a:t>{_text(x)}</a:t></a:r></a:p>" for x in lines) or "<a:p/>"
    return (
        f'<p:sp><p:nvSpPr><p:cNvPr id="{n}" name="{name}"/><p:cNvSpPr/><p:nvPr/></p:nvSpPr><p:spPr><a:xfrm><a:off x="400000" y="{top}"/><a:ext cx="8300000" cy="900000"/></a:xfrm>'
        f'<a:prstGeom prst="rect"><a:avLst/></a:prstGeom></p:spPr><p:txBody><a:bodyPr/>{body}</p:txBody></p:sp>'
    )


def _grid(n: int, rows: list[tuple]) -> str:
    width = 8_300_000 // max(1, len(rows[0]))
    cells = lambda row: "".join(f'<a:tc><a:txBody><a:bodyPr/><a:p><a:r><a:t>{_text("" if v is None else v)}</a:t></a:r></a:p></a:txBody><a:tcPr/></a:tc>' for v in row)
    body = "".join(f'<a:tr h="370000">{cells(r)}</a:tr>' for r in rows)
    columns = "".join(f'<a:gridCol w="{width}"/>' for _ in rows[0])
    return (
        f'<p:graphicFrame><p:nvGraphicFramePr><p:cNvPr id="{n}" name="Table"/><p:cNvGraphicFramePr/><p:nvPr/></p:nvGraphicFramePr><p:xfrm><a:off x="400000" y="400000"/>'
        f'<a:ext cx="8300000" cy="{370_000 * len(rows)}"/></p:xfrm><a:graphic><a:graphicData uri="{DRAW}/table"><a:tbl><a:tblPr/><a:tblGrid>{columns}</a:tblGrid>{body}</a:tbl></a:graphicData></a:graphic></p:graphicFrame>'
    )


def write_slides(path: str, title: str, slides: list[list[tuple] | list[str]]) -> int:
    """A title slide, then a slide for each table (tuples, the header first) or list of lines. Gives their number."""
    space = f'xmlns:p="{SLIDE}" xmlns:a="{DRAW}" xmlns:r="{OFFICE}"'
    group = '<p:nvGrpSpPr><p:cNvPr id="1" name=""/><p:cNvGrpSpPr/><p:nvPr/></p:nvGrpSpPr><p:grpSpPr/>'
    bodies = [_shape(2, "Title", [title], 2_000_000)] + [(_grid(2, s) if s and isinstance(s[0], tuple) else _shape(2, "Text", list(s), 400_000)) for s in slides]
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        n = len(bodies)
        _parts(book, "ppt/presentation.xml", "presentationml.presentation.main", [(f"ppt/slides/slide{i}.xml", "presentationml.slide") for i in range(1, n + 1)])
        listed = "".join(f'<p:sldId id="{255 + i}" r:id="rId{i}"/>' for i in range(1, n + 1))
        book.writestr("ppt/presentation.xml", f'{HEAD}<p:presentation {space}><p:sldIdLst>{listed}</p:sldIdLst><p:sldSz cx="9144000" cy="6858000"/><p:notesSz cx="6858000" cy="9144000"/></p:presentation>')
        links = "".join(f'<Relationship Id="rId{i}" Type="{OFFICE}/slide" Target="slides/slide{i}.xml"/>' for i in range(1, n + 1))
        book.writestr("ppt/_rels/presentation.xml.rels", f'{HEAD}<Relationships xmlns="{LINKS}">{links}</Relationships>')
        for i, body in enumerate(bodies, 1):
            book.writestr(f"ppt/slides/slide{i}.xml", f"{HEAD}<p:sld {space}><p:cSld><p:spTree>{group}{body}</p:spTree></p:cSld></p:sld>")
    return len(bodies) - 1
