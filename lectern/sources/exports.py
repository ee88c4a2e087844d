"""Exports of a transcript (speaker, start, end, text): columns of lines, and writers of one file each."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import times


def csv_field(c: Column) -> Column:
    """Quoted only where a comma, a quote or a line end needs it."""
    return F.when(c.rlike('[,"\n\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def csv_line(t: DataFrame) -> Column:
    return F.concat_ws(",", *[csv_field(F.coalesce(c, F.lit(""))) for c in (F.col("speaker"), times.hms(F.col("start")), times.hms(F.col("end")), F.col("text"))])


def json_record(formatted: bool = True) -> Column:
    """The record of one cue: formatted times and `content`, or numbers rounded half to even and `text`."""
    if formatted:
        return F.to_json(F.struct("speaker", times.hms(F.col("start")).alias("start"), times.hms(F.col("end")).alias("end"), F.col("text").alias("content")))
    return F.to_json(F.struct("speaker", F.bround("start", 3).alias("start"), F.bround("end", 3).alias("end"), "text"))


def cue_number(within: str, order: tuple[str, ...] = ("start", "id")) -> Column:
    return F.row_number().over(Window.partitionBy(within).orderBy(*order))


def srt_cue(number: Column, bracket: bool = False, wrap: bool = False) -> Column:
    line = F.concat(F.lit("["), F.col("speaker"), F.lit("] "), F.col("text")) if bracket else F.concat(F.col("speaker"), F.lit(": "), F.col("text"))
    return F.concat(number.cast("string"), F.lit("\n"), times.srt(F.col("start"), wrap), F.lit(" --> "), times.srt(F.col("end"), wrap), F.lit("\n"), line, F.lit("\n"))


def md_block(heading: bool = True) -> Column:
    """`**speaker** [start - end]` over the text, or `## [speaker] [hh:mm:ss - hh:mm:ss]` over it."""
    if heading:
        return F.concat(F.lit("**"), F.col("speaker"), F.lit("** ["), times.hms(F.col("start")), F.lit(" - "), times.hms(F.col("end")), F.lit("]\n\n"), F.col("text"), F.lit("\n"))
    return F.concat(F.lit("## ["), F.col("speaker"), F.lit("] ["), times.hhmmss(F.col("start"), True), F.lit(" - "), times.hhmmss(F.col("end"), True), F.lit("]\n\n"), F.col("text"), F.lit("\n"))


def txt_block() -> Column:
    return F.concat(F.lit("["), F.col("speaker"), F.lit("] "), times.hhmmss(F.col("start"), True), F.lit(" - "), times.hhmmss(F.col("end"), True), F.lit("\n"), F.col("text"), F.lit("\n"))


def write_lines(lines: DataFrame, order: list[str], path: str, compression: str = "none") -> None:
    """One text file of the column `line`, in order. An export is one recording's, so one task is enough."""
    lines.coalesce(1).sortWithinPartitions(*order).select("line").write.mode("overwrite").option("compression", compression).text(path)


def free_name(taken: DataFrame, stem: str, ext: str) -> Column | str:
    """stem.ext, or stem_n.ext with the first n that isn't taken (column `name`)."""
    n = taken.select(F.when(F.col("name") == f"{stem}.{ext}", 0).otherwise(F.regexp_extract("name", rf"^\Q{stem}_\E(\d+)\.{ext}$", 1).try_cast("int")).alias("n")).where("n is not null").distinct()
    held = {r["n"] for r in n.collect()}
    k = next(i for i in range(len(held) + 1) if i not in held)
    return f"{stem}.{ext}" if k == 0 else f"{stem}_{k}.{ext}"


def _zipped(parts: dict[str, str]) -> bytes:
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, xml in parts.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + xml)
    return out.getvalue()


_TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
_RELS = "http://schemas.openxmlformats.org/package/2006/relationships"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_APP = "application/vnd.openxmlformats-officedocument"


def _package(main: str, kind: str, more: dict[str, str], also: str = "") -> bytes:
    types = f'<Types xmlns="{_TYPES}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/{main}" ContentType="{_APP}.{kind}.main+xml"/>{also}</Types>'
    rels = f'<Relationships xmlns="{_RELS}"><Relationship Id="r1" Type="{_OFFICE}/officeDocument" Target="{main}"/></Relationships>'
    return _zipped({"[Content_Types].xml": types, "_rels/.rels": rels} | more)


def xlsx(rows: list[tuple]) -> bytes:
    """A workbook of one sheet with a header and rows (speaker, start, end, text); an error where there are none."""
    from xml.sax.saxutils import escape

    if not rows:
        raise ValueError("there are no rows to export")
    line = lambda cells: "<row>" + "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(c))}</t></is></c>' for c in cells) + "</row>"
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = f"<worksheet {ns}><sheetData>{line(('speaker_name', 'start_time', 'end_time', 'content'))}{''.join(map(line, rows))}</sheetData></worksheet>"
    book = f'<workbook {ns} xmlns:r="{_OFFICE}"><sheets><sheet name="Transcript" sheetId="1" r:id="r1"/></sheets></workbook>'
    rels = f'<Relationships xmlns="{_RELS}"><Relationship Id="r1" Type="{_OFFICE}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>'
    return _package("xl/workbook.xml", "spreadsheetml.sheet", {"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": rels, "xl/worksheets/sheet1.xml": sheet}, f'<Override PartName="/xl/worksheets/sheet1.xml" ContentType="{_APP}.spreadsheetml.worksheet+xml"/>')


def docx(rows: list[tuple]) -> bytes:
    """A document with a bold line of speaker and times, and a paragraph of text, for each row."""
    from xml.sax.saxutils import escape

    para = lambda t, bold: f'<w:p><w:r>{"<w:rPr><w:b/></w:rPr>" if bold else ""}<w:t xml:space="preserve">{escape(t)}</w:t></w:r></w:p>'
    body = "".join(para(f"{s} [{a} - {b}]", True) + para(t, False) for s, a, b, t in rows)
    return _package("word/document.xml", "wordprocessingml.document", {"word/document.xml": f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>'})


def office_files(t: DataFrame, within: str) -> DataFrame:
    """(within, xlsx binary, docx binary) of each recording's cues (speaker, start, end as text, text) in order."""
    import pandas as pd

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(pdf.sort_values(["order", "id"])[["speaker", "start", "end", "text"]].itertuples(index=False, name=None))
        return pd.DataFrame({within: [pdf[within].iloc[0]], "xlsx": [xlsx(rows)], "docx": [docx(rows)]})

    shaped = t.select(within, "id", "speaker", F.col("start").alias("order"), times.hms(F.col("start")).alias("start"), times.hms(F.col("end")).alias("end"), "text")
    return shaped.groupBy(within).applyInPandas(make, f"{within} long, xlsx binary, docx binary")


def corpus(lines: DataFrame, path: str, column: str = "line", gzip: bool = True) -> None:
    """One line of text a row, packed or not."""
    lines.select(F.col(column).alias("value")).write.mode("overwrite").option("compression", "gzip" if gzip else "none").text(path)


def copy_tables(tables: dict[str, DataFrame], path: str) -> None:
    """A copy of a store's tables, in place of what is there."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")


def sqlite_files(df: DataFrame, key: str, name: str, columns: list[str]) -> DataFrame:
    """(path, content): an SQLite file for each key with its rows as a table; a key's rows are one recording's."""
    import sqlite3

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        db = sqlite3.connect(":memory:")
        pdf[columns].to_sql(name, db, index=False)
        return pd.DataFrame({"path": [f"{pdf[key].iloc[0]}.db"], "content": [db.serialize()]})

    return df.groupBy(key).applyInPandas(run, "path string, content binary")


def arpa(lines: DataFrame, path: str) -> None:
    """The lines of an ARPA file, in order, as one file."""
    lines.select("line").coalesce(1).write.mode("overwrite").text(path)


def single_file(df: DataFrame, folder: str, name: str) -> None:
    """df as one Parquet file of the given name."""
    spark = df.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = at(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/.{name}")
    part = next(s.getPath() for s in files.listStatus(at(f"{folder}/.{name}")) if s.getPath().getName().startswith("part-"))
    files.rename(part, at(f"{folder}/{name}"))
    files.delete(at(f"{folder}/.{name}"), True)
