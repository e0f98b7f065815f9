"""Workbooks (Office Open XML) written from DataFrames, row by row.

A sheet's rows are streamed from the session, so the writer holds one row at a time; rows
beyond what a sheet may hold go on in further sheets, none is dropped.
"""

from __future__ import annotations

import itertools
import re
import zipfile
from collections.abc import Iterable
from dataclasses import dataclass, field
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame

from marginalia.config import DEFAULTS

_NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACK = "http://schemas.openxmlformats.org/package/2006"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
#: Characters that XML cannot hold.
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")
#: How styles are numbered below, and a cell's fills.
PLAIN, HEAD, MARKED, WARNED = 0, 1, 2, 3
_FILLS = {HEAD: "FFD9EAF7", MARKED: "FFFFF2CC", WARNED: "FFF4CCCC"}


@dataclass
class Sheet:
    """A named sheet: a head and rows of values, or (style, values) pairs; ``free`` sheets have no head of their own."""

    name: str
    head: list[str]
    rows: Iterable
    widths: dict[int, int] = field(default_factory=dict)
    free: bool = False
    #: (first row, last row, columns, heads) of the tables that a free sheet shows.
    tables: list[tuple[int, int, int, list[str]]] = field(default_factory=list)


def column_name(n: int) -> str:
    """A, B, ..., Z, AA, ... for 1, 2, ..."""
    out = ""
    while n:
        n, rest = divmod(n - 1, 26)
        out = chr(65 + rest) + out
    return out


def cell_value(value: object, limit: int = DEFAULTS.cell_limit) -> str:
    """The inner XML of a cell; null is an empty text, lists are joined by commas, long texts are cut where a cell ends."""
    if isinstance(value, bool):
        return f"<v>{int(value)}</v>"
    if isinstance(value, (int, float)) and value == value and abs(value) != float("inf"):
        return f"<v>{value!r}</v>"
    if isinstance(value, (list, tuple)):
        value = ", ".join("" if x is None else str(x) for x in value)
    text = "" if value is None else _CONTROL.sub("", str(value))[:limit]
    return f'<is><t xml:space="preserve">{escape(text)}</t></is>'


def _row(number: int, style: int, values: Iterable) -> str:
    cells = []
    for c, value in enumerate(values, 1):
        kind = "b" if isinstance(value, bool) else None if isinstance(value, (int, float)) and value == value and abs(value) != float("inf") else "inlineStr"
        cells.append(f'<c r="{column_name(c)}{number}" s="{style}"' + (f' t="{kind}"' if kind else "") + f">{cell_value(value)}</c>")
    return f'<row r="{number}">{"".join(cells)}</row>'


def _styles() -> str:
    fills = "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="{c}"/></patternFill></fill>' for c in _FILLS.values())
    style = lambda font, fill: f'<xf numFmtId="0" fontId="{font}" fillId="{fill}" borderId="0" xfId="0" applyFont="1" applyFill="1" applyAlignment="1"><alignment wrapText="1" vertical="top"/></xf>'
    return (
        f'{_HEAD}<styleSheet xmlns="{_NS}"><fonts count="2"><font><sz val="11"/><name val="Calibri"/></font><font><b/><sz val="11"/><name val="Calibri"/></font></fonts>'
        f'<fills count="{2 + len(_FILLS)}"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>{fills}</fills>'
        '<borders count="1"><border><left/><right/><top/><bottom/><diagonal/></border></borders><cellStyleXfs count="1"><xf numFmtId="0" fontId="0" fillId="0" borderId="0"/></cellStyleXfs>'
        f'<cellXfs count="4">{style(0, 0)}{style(1, 2)}{style(0, 3)}{style(0, 4)}</cellXfs></styleSheet>'
    )


def rows_of(df: DataFrame) -> Iterable[tuple]:
    """A DataFrame's rows, a partition at a time."""
    return (tuple(r) for r in df.toLocalIterator(prefetchPartitions=True))


def write_workbook(sheets: list[Sheet], path: str, most: int = DEFAULTS.sheet_rows) -> list[str]:
    """Write the sheets into one file; returns the names of the sheets it has, "name (2)" being what did not fit into "name"."""
    names: list[str] = []
    tables = 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        types = ""
        for sheet in sheets:
            rows = (x if isinstance(x, tuple) and len(x) == 2 and isinstance(x[0], int) and isinstance(x[1], (list, tuple)) else (PLAIN, x) for x in sheet.rows)
            rest: Iterable = iter(rows)
            for part in itertools.count(1):
                first = next(rest, None)
                if first is None and part > 1:
                    break
                if first is not None:
                    rest = itertools.chain([first], rest)
                name = sheet.name if part == 1 else f"{sheet.name} ({part})"
                names.append(name)
                n = len(names)
                with z.open(f"xl/worksheets/sheet{n}.xml", "w", force_zip64=True) as f:
                    put = lambda s, f=f: f.write(s.encode("utf-8"))
                    pane = "" if sheet.free else '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>'
                    cols = "".join(f'<col min="{c}" max="{c}" width="{sheet.widths.get(c, 20)}" customWidth="1"/>' for c in range(1, max(len(sheet.head), 1) + 1))
                    put(f'{_HEAD}<worksheet xmlns="{_NS}" xmlns:r="{_REL}">{pane}<cols>{cols}</cols><sheetData>')
                    at = 0
                    if not sheet.free:
                        at = 1
                        put(_row(1, HEAD, sheet.head))
                    for style, values in itertools.islice(rest, most - at):
                        at += 1
                        put(_row(at, style, values))
                    own = [t for t in sheet.tables if t[1] <= at] if part == 1 else []
                    put("</sheetData>" + (f'<tableParts count="{len(own)}">' + "".join(f'<tablePart r:id="rId{i}"/>' for i in range(1, len(own) + 1)) + "</tableParts>" if own else "") + "</worksheet>")
                types += f'<Override PartName="/xl/worksheets/sheet{n}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
                if own:
                    links = ""
                    for i, (lo, hi, wide, heads) in enumerate(own, 1):
                        tables += 1
                        area = f"A{lo}:{column_name(wide)}{hi}"
                        columns = "".join(f"<tableColumn id={quoteattr(str(c))} name={quoteattr(_CONTROL.sub('', h))}/>" for c, h in enumerate(heads, 1))
                        z.writestr(f"xl/tables/table{tables}.xml", f'{_HEAD}<table xmlns="{_NS}" id="{tables}" name="Tbl{tables}" displayName="Tbl{tables}" ref="{area}"><autoFilter ref="{area}"/><tableColumns count="{wide}">{columns}</tableColumns><tableStyleInfo name="TableStyleMedium2" showRowStripes="1"/></table>')
                        links += f'<Relationship Id="rId{i}" Type="{_REL}/table" Target="../tables/table{tables}.xml"/>'
                        types += f'<Override PartName="/xl/tables/table{tables}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.table+xml"/>'
                    z.writestr(f"xl/worksheets/_rels/sheet{n}.xml.rels", f'{_HEAD}<Relationships xmlns="{_PACK}/relationships">{links}</Relationships>')
        z.writestr("xl/styles.xml", _styles())
        listed = "".join(f'<sheet name={quoteattr(name)} sheetId="{i}" r:id="rId{i}"/>' for i, name in enumerate(names, 1))
        z.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_NS}" xmlns:r="{_REL}"><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="{_PACK}/relationships">{links}<Relationship Id="rId{len(names) + 1}" Type="{_REL}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="{_PACK}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        z.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_PACK}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kinds}.styles+xml"/>{types}</Types>')
    return names


def read_workbook(path: str) -> dict[str, list[list[str]]]:
    """Sheets of a workbook made by :func:`write_workbook` as lists of texts; for tests and small files."""
    from xml.etree import ElementTree as E

    ns = {"m": _NS}
    out = {}
    with zipfile.ZipFile(path) as z:
        names = [s.attrib["name"] for s in E.fromstring(z.read("xl/workbook.xml")).iterfind("m:sheets/m:sheet", ns)]
        for i, name in enumerate(names, 1):
            root = E.fromstring(z.read(f"xl/worksheets/sheet{i}.xml"))
            out[name] = [["".join(c.itertext()) for c in row.iterfind("m:c", ns)] for row in root.iterfind("m:sheetData/m:row", ns)]
    return out
