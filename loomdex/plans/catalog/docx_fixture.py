"""Smallest valid Word files, to exercise the reader on the given texts."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame

#: Files that are built and handed on together.
_FILES = 64
_NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_TYPES = (
    '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
    '<Default Extension="xml" ContentType="application/xml"/><Default Extension="png" ContentType="image/png"/></Types>'
)


def _run(text: str, bold: bool, italic: bool) -> str:
    marks = ("<w:b/>" if bold else "") + ("<w:i/>" if italic else "")
    return f'<w:r><w:rPr>{marks}</w:rPr><w:t xml:space="preserve">{escape(text)}</w:t></w:r>'


def docx_bytes(paragraphs: Sequence[tuple[str, Sequence[tuple[str, bool, bool]]]], tables: Sequence = (), images: Sequence[bytes] = ()) -> bytes:
    """``(style, [(text, bold, italic), ...])`` paragraphs -> file content; tables come last."""
    styles = sorted({style for style, _ in paragraphs if style})
    ids = {style: style.replace(" ", "") for style in styles}
    body = []
    for style, runs in paragraphs:
        ref = f"<w:pPr><w:pStyle w:val={quoteattr(ids[style])}/></w:pPr>" if style else ""
        body.append(f"<w:p>{ref}{''.join(_run(*r) for r in runs)}</w:p>")
    for rows in tables:
        cells = ["".join(f"<w:tc><w:p>{_run(c, False, False)}</w:p></w:tc>" for c in row) for row in rows]
        body.append("<w:tbl>" + "".join(f"<w:tr>{c}</w:tr>" for c in cells) + "</w:tbl>")
    names = "".join(
        f'<w:style w:type="paragraph" w:styleId={quoteattr(ids[s])}><w:name w:val={quoteattr(s.lower())}/></w:style>' for s in styles
    )
    rels = "".join(f'<Relationship Id="r{n}" Type="http://x/image" Target="media/i{n}.png"/>' for n in range(len(images)))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", _TYPES)
        z.writestr("word/document.xml", f"<w:document {_NS}><w:body>{''.join(body)}</w:body></w:document>")
        z.writestr("word/styles.xml", f"<w:styles {_NS}>{names}</w:styles>")
        z.writestr(
            "word/_rels/document.xml.rels",
            f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>',
        )
        for n, blob in enumerate(images):
            z.writestr(f"word/media/i{n}.png", blob)
    return out.getvalue()


def as_docx(docs: DataFrame) -> DataFrame:
    """``file_path, paragraphs array<struct<style,runs>>`` -> ``file_path, content`` Word files."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _FILES):
                some = batch.slice(at, _FILES)
                files = []
                for paragraphs in some.column("paragraphs").to_pylist():
                    files.append(docx_bytes([(p["style"], [(r["text"], r["bold"], r["italic"]) for r in p["runs"]]) for p in paragraphs]))
                yield pa.RecordBatch.from_arrays([some.column("file_path"), pa.array(files, pa.binary())], ["file_path", "content"])

    return docs.select("file_path", "paragraphs").mapInArrow(build, "file_path string, content binary")
