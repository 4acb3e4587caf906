"""Reading uploaded files and tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Accepted extensions, their kinds, and the first bytes each must have (hexadecimal).
KINDS = {"pdf": ("pdf", "25504446"), "docx": ("docx", "504B0304"), "doc": ("doc", "D0CF11E0"), "png": ("image", "89504E47"), "jpg": ("image", "FFD8FF"), "jpeg": ("image", "FFD8FF"), "txt": ("text", ""), "md": ("text", "")}
MOST_BYTES = 50 * 1024 * 1024


def tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """Binary files with extension, kind, MD5, safe name and the reason against each, if any."""
    f = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    f = f.withColumn("name", F.regexp_replace(name, "[^\\w.\\-]+", "_")).withColumn("extension", F.lower(F.regexp_extract("name", "\\.([^.]+)$", 1)))
    kind, magic = F.lit(None).cast("string"), F.lit(None).cast("string")
    for e, (k, m) in KINDS.items():
        kind, magic = F.when(F.col("extension") == e, k).otherwise(kind), F.when(F.col("extension") == e, m).otherwise(magic)
    reason = F.when(kind.isNull(), "extension").when(F.col("length") == 0, "empty").when(F.col("length") > MOST_BYTES, "size").when(~F.hex(F.substring("content", 1, 8)).startswith(magic), "content")
    return f.withColumns({"kind": kind, "md5": F.md5("content"), "rejected": reason})


def decoded_text(content: Column) -> Column:
    """UTF-8 if it is valid, UTF-16 if it begins with a mark, else Latin-1, which takes every byte."""
    marked = F.hex(F.substring(content, 1, 2)).isin("FFFE", "FEFF")
    return F.when(marked, F.decode(content, "UTF-16")).otherwise(F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1")))


def printable_runs(content: Column) -> Column:
    """Runs of more than 20 printable characters, for binary documents without a reader."""
    return F.array_join(F.regexp_extract_all(F.decode(content, "ISO-8859-1"), F.lit("[\\x20-\\x7e\\n\\r]{21,}"), F.lit(0)), "\n")


def page_image(content: Column) -> Column:
    return F.base64(content)


def first_good(candidates: list[tuple[str, Column]], good: Callable[[Column], Column]) -> Column:
    """(method, text) of the first reader whose text is good, else of the first that has any."""
    pick = lambda n, c: F.struct(F.lit(n).alias("method"), c.alias("text"))
    out = F.coalesce(*[F.when(F.trim(c) != "", pick(n, c)) for n, c in candidates])
    for n, c in reversed(candidates):
        out = F.when(good(c), pick(n, c)).otherwise(out)
    return out


def flattened_items(items: Column) -> Column:
    """Typed items (text, equation, image, table) of a layout reader as one text; images become placeholders."""
    kind = "array<struct<type:string,text:string,latex:string,img_path:string,table_body:string>>"
    one = lambda x, i: F.when(x["type"] == "equation", F.concat(F.lit("$"), x["latex"], F.lit("$"))).when(x["type"] == "image", F.concat(F.lit("[IMG_"), i.cast("string"), F.lit("]"))).when(x["type"] == "table", F.regexp_replace(x["table_body"], "<[^>]+>", " ")).otherwise(x["text"])
    return F.array_join(F.transform(F.from_json(items, kind), one), "\n")


def reader_for(subject: Column, rules: dict[str, str], default: str = "text") -> Column:
    """Reader by subject; the rules are a small dimension."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in rules.items() for x in kv]), subject), F.lit(default)) if rules else F.lit(default)


def seeded(table: DataFrame, rows: DataFrame) -> DataFrame:
    """The table, or the seed rows if it is empty."""
    return rows if table.isEmpty() else table


def through_provider(df: DataFrame, text: str, provider: Callable[[str], str], parallel: int = 8) -> DataFrame:
    """Calls an outside service for each row, ``parallel`` tasks at a time; a failure is a value in ``error``, not of the task."""
    names = df.columns

    def run(batches):
        for b in batches:
            out, errors = [], []
            for value in b[text]:
                try:
                    out.append(provider(value))
                    errors.append(None)
                except Exception as e:  # the service's own failures are data here
                    out.append(None)
                    errors.append(str(e)[:200])
            yield b[names].assign(result=out, error=errors)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.repartition(parallel).mapInPandas(run, f"{schema}, result string, error string")
