"""Document forms in containers: members of archives as rows, styles and their usage as relations."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of texts that leave Python together.
HELD = 1 << 20
HEADER, SECTION = "Contents/header.xml", "Contents/section0.xml"


def containers(spark: SparkSession, path: str) -> DataFrame:
    """path, content of every archive that a path or glob names."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def members(files: DataFrame, key: str = "path", content: str = "content", names: tuple[str, ...] = (HEADER, SECTION), most: int = 64 << 20) -> DataFrame:
    """key, name, text: the named members of each archive, one row each, as UTF-8.

    One archive is open at a time, and texts of some HELD bytes are sent together. A file that is no archive, and a member that is larger than
    `most` unpacked, is an error with its key; a member that isn't there has no row; null content
    has none. Python: Spark's sources don't open archives."""

    def run(batches):
        def rows():
            return pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in found], batch.schema.field(0).type), pa.array([n for _, n, _ in found], pa.string()), pa.array([t for _, _, t in found], pa.string())], ["key", "name", "text"])

        for batch in batches:
            found, held = [], 0
            for i in range(batch.num_rows):
                name, raw = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if raw is None:
                    continue
                try:
                    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
                        for info in archive.infolist():
                            if info.filename in names:
                                if info.file_size > most:
                                    raise ValueError(f"{info.filename} is too large")
                                found.append((name, info.filename, archive.read(info).decode("utf-8")))
                                held += info.file_size
                except (zipfile.BadZipFile, ValueError) as error:
                    raise ValueError(f"{name}: {error}") from error
                if held > HELD:
                    yield rows()
                    found, held = [], 0
            if found:
                yield rows()

    source = files.select(F.col(key).alias("key"), F.col(content).alias("content"))
    schema = T.StructType([T.StructField("key", source.schema["key"].dataType), T.StructField("name", T.StringType()), T.StructField("text", T.StringType())])
    return source.mapInArrow(run, schema).withColumnRenamed("key", key)


def _attribute(text: Column, name: str) -> Column:
    return F.regexp_extract(text, rf'{name}="(-?\d+)"', 1).try_cast("int")


def _elements(text: Column, tag: str) -> Column:
    """Whole elements of a tag that has an id."""
    return F.regexp_extract_all(text, F.lit(rf'(?s)<hh:{tag} id="\d+".*?</hh:{tag}>'), F.lit(0))


def _characters(text: Column) -> Column:
    """Array of the character styles (id, font, pt, bold) of a header, with the name of the Hangul
    face that each refers to."""
    face = F.regexp_extract(text, r'(?s)<hh:fontface lang="HANGUL"[^>]*>(.*?)</hh:fontface>', 1)
    fonts = F.transform(F.regexp_extract_all(face, F.lit(r'<hh:font id="\d+" face="[^"]+"'), F.lit(0)), lambda e: F.struct(_attribute(e, "id").alias("id"), F.regexp_extract(e, r'face="([^"]+)"', 1).alias("font")))

    def styles(e: Column) -> Column:
        named = F.filter(fonts, lambda f: f["id"] == F.regexp_extract(e, r'<hh:fontRef hangul="(\d+)"', 1).try_cast("int"))
        # a face that is named twice gives the style twice
        return F.transform(
            F.when(F.size(named) > 0, F.transform(named, lambda f: f["font"])).otherwise(F.array(F.lit(""))),
            lambda font: F.struct(_attribute(e, "<hh:charPr id").alias("id"), font.alias("font"), (F.coalesce(_attribute(e, "height"), F.lit(0)) / 100).alias("pt"), e.rlike(r"<hh:bold\s*/?>").alias("bold")),
        )

    return F.flatten(F.transform(_elements(text, "charPr"), styles))


def _paragraphs(text: Column) -> Column:
    """Array of the paragraph styles (id, align, left, line_spacing) of a header."""
    left, spacing = r'<hc:left value="(\d+)"', r'<hh:lineSpacing type="([^"]+)" value="(\d+)"'

    def style(e: Column) -> Column:
        cased = lambda tail, g: F.nullif(F.regexp_extract(e, r"(?s)<hp:case[^>]*>.*?" + tail, g), F.lit(""))
        plain = lambda tail, g: F.nullif(F.regexp_extract(e, tail, g), F.lit(""))
        kind, value = (F.coalesce(cased(spacing, g), plain(spacing, g)) for g in (1, 2))
        return F.struct(
            _attribute(e, "<hh:paraPr id").alias("id"),
            F.regexp_extract(e, r'<hh:align horizontal="([^"]+)"', 1).alias("align"),
            F.coalesce(cased(left, 1), plain(left, 1)).cast("int").alias("left"),
            F.coalesce(F.when(kind == "PERCENT", F.concat(value, F.lit("%"))).otherwise(value), F.lit("")).alias("line_spacing"),
        )

    return F.transform(_elements(text, "paraPr"), style)


def _used(text: Column) -> Column:
    """Array of the (para, char) that a section's paragraphs outside tables begin with."""
    bare = F.regexp_replace(text, r"(?s)<hp:tbl .*?</hp:tbl>", "")
    found = F.regexp_extract_all(bare, F.lit(r'<hp:p id="\d+" paraPrIDRef="\d+"[^>]*>\s*<hp:run charPrIDRef="\d+"'), F.lit(0))
    return F.transform(found, lambda p: F.struct(_attribute(p, "paraPrIDRef").alias("para"), _attribute(p, "charPrIDRef").alias("char")))


def _whole(parts: DataFrame, key: str) -> DataFrame:
    """key, chars, paras, used: what a form defines and uses, in one row and from one pass."""
    of = lambda name, array: F.flatten(F.collect_list(F.when(F.col("name") == name, array(F.col("text")))))
    return parts.groupBy(key).agg(of(HEADER, _characters).alias("chars"), of(HEADER, _paragraphs).alias("paras"), of(SECTION, _used).alias("used"))


def character_styles(parts: DataFrame, key: str) -> DataFrame:
    """key, id, font, pt, bold of the character styles that a header defines; the font is that of
    the Hangul face the style refers to."""
    return parts.where(F.col("name") == HEADER).select(key, F.inline(_characters(F.col("text"))))


def paragraph_styles(parts: DataFrame, key: str) -> DataFrame:
    """key, id, align, left, line_spacing of the paragraph styles; values for a case win over
    the plain ones. Spacing is a percentage or a number, empty if there is none."""
    return parts.where(F.col("name") == HEADER).select(key, F.inline(_paragraphs(F.col("text"))))


def page(parts: DataFrame, key: str) -> DataFrame:
    """key, width, height, the margins and the body's width and height of each section; a form
    without page or margins is an error."""
    rows = parts.where(F.col("name") == SECTION).select(key, F.regexp_extract("text", r"<hp:pagePr\b[^>]*>", 0).alias("p"), F.regexp_extract("text", r"<hp:margin\b[^>]*>", 0).alias("m"))
    sides = ["left", "right", "top", "bottom", "header", "footer"]
    sized = rows.select(key, *[F.when((F.col("p") == "") | (F.col("m") == ""), F.raise_error(F.lit("no page or margins")).cast("int")).otherwise(_attribute(F.col("p"), f" {n}")).alias(n) for n in ("width", "height")], *[F.coalesce(_attribute(F.col("m"), n), F.lit(0)).alias(n) for n in sides])
    return sized.withColumns({"body_w": F.expr("width - left - right"), "body_h": F.expr("height - top - bottom - header - footer")})


def style_usage(parts: DataFrame, key: str) -> DataFrame:
    """key, para, char, n: how often paragraphs outside tables begin with a character style, by
    paragraph and character style."""
    rows = parts.where(F.col("name") == SECTION).select(key, F.inline(_used(F.col("text"))))
    return rows.groupBy(key, "para", "char").agg(F.count(F.lit(1)).alias("n"))


def form_usage(parts: DataFrame, key: str) -> DataFrame:
    """style_usage with what the styles are; a style that isn't defined has nulls and is left for
    undefined_styles."""
    count = lambda p: F.size(F.filter("used", lambda u: u.eqNullSafe(p))).cast("bigint")
    rows = _whole(parts, key).select(key, "chars", "paras", F.explode(F.transform(F.array_distinct("used"), lambda p: F.struct(p["para"].alias("para"), p["char"].alias("char"), count(p).alias("n")))).alias("u"))
    rows = rows.select(key, "paras", "u.*", F.explode_outer(F.filter("chars", lambda c: c["id"] == F.col("u.char"))).alias("c"))
    rows = rows.select(key, "para", "char", "n", "c", F.explode_outer(F.filter("paras", lambda p: p["id"] == F.col("para"))).alias("p"))
    return rows.select(key, "para", "char", "n", "c.font", "c.pt", "c.bold", "p.align", "p.left", "p.line_spacing")


def undefined_styles(parts: DataFrame, key: str) -> DataFrame:
    """key, kind, id of styles that paragraphs use and the header doesn't define."""
    lost = lambda kind, defined: F.transform(F.filter(F.array_distinct(F.transform("used", lambda u: u[kind])), lambda x: ~F.exists(defined, lambda s: F.coalesce(s["id"] == x, F.lit(False)))), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("id")))
    return _whole(parts, key).select(key, F.inline(F.concat(lost("char", "chars"), lost("para", "paras"))))
