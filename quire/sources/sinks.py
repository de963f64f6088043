"""Sinks: everything is written by executors, in an order that the rows themselves state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_lines(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).json(path)


def tsv(rows: DataFrame, path: str, columns: list[str], order: list[str]) -> None:
    """Fixed columns, globally ordered, with header."""
    rows.select(*columns).orderBy(*order).write.mode("overwrite").csv(path, sep="\t", header=True)


def csv_with_mark(rows: DataFrame, path: str) -> bool:
    """Each part as CSV whose header begins with a byte-order mark, for spreadsheets; an empty table writes nothing."""
    if rows.isEmpty():
        return False
    first, *rest = rows.columns
    rows.withColumnRenamed(first, "﻿" + first).write.mode("overwrite").csv(path, header=True, encoding="UTF-8")
    return True


def front_matter(columns: dict[str, Column]) -> Column:
    """A block of ``key: value`` lines; text in quotes, nothing as null."""
    line = lambda k, c: F.concat(F.lit(f"{k}: "), F.coalesce(F.concat(F.lit('"'), F.replace(c.cast("string"), F.lit('"'), F.lit("'")), F.lit('"')), F.lit("null")))
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *(line(k, c) for k, c in columns.items())), F.lit("\n---\n"))


def markdown_files(rows: DataFrame, path: str, folder: str, text: Column) -> None:
    """One text row a document, in folders by ``folder``: a document stays whole in one file of its folder."""
    rows.select(folder, text.alias("value")).write.mode("overwrite").partitionBy(folder).option("lineSep", "\n\n").text(path)


def markdown_table(rows: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """n, line of a table to be read by people: heading, rule, then the rows in order."""
    from pyspark.sql import Window

    spark = rows.sparkSession
    body = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("-")) for c in columns)), F.lit(" |"))
    lines = rows.select((F.row_number().over(Window.orderBy(*order)) + 1).alias("n"), body.alias("line"))  # a report is small by nature
    head = spark.range(1).select(F.explode(F.array(F.struct(F.lit(0).alias("n"), F.lit("| " + " | ".join(columns) + " |").alias("line")), F.struct(F.lit(1).alias("n"), F.lit("|" + "---|" * len(columns)).alias("line")))).alias("x")).select("x.*")
    return head.unionByName(lines)


def speaker_lines(turns: DataFrame, file: str, start: str, end: str, speaker: str) -> DataFrame:
    """value: turns in the format of speaker diarization files."""
    return turns.select(F.format_string("SPEAKER %s 1 %.3f %.3f <NA> <NA> %s <NA> <NA>", F.lit(file), F.col(start), F.col(end) - F.col(start), F.col(speaker)).alias("value"))


def by_collection(rows: DataFrame, path: str, collection: str = "collection") -> None:
    """Replaces the collections that ``rows`` holds and leaves the others: writing twice changes nothing."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(collection).parquet(path)


def upsert(known: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Known rows, replaced or extended by new ones; values that the new row lacks stay as they were."""
    a = known.select(F.col(key).alias("__k"), *(F.col(c).alias(f"__{c}") for c in known.columns if c != key))
    out = new.join(a, F.col(key) == F.col("__k"), "full_outer")
    return out.select(F.coalesce(key, "__k").alias(key), *(F.coalesce(c, f"__{c}").alias(c) for c in known.columns if c != key))


def mirror(rows: DataFrame, targets: list[str], format: str = "parquet") -> dict[str, str]:
    """Writes the same rows to several places; a target that cannot be written does not keep the others from it.  What became
    of each: ok, or its error."""
    out = {}
    for target in targets:
        try:
            rows.write.mode("overwrite").format(format).save(target)
            out[target] = "ok"
        except Exception as e:  # noqa: BLE001  a broken target is reported, not fatal
            out[target] = f"error: {str(e).splitlines()[0]}"
    return out


def html_catalogue(rows: DataFrame, columns: list[str], title: str) -> DataFrame:
    """value: lines of a page with a row for each entry, and a box that hides the rows that do not hold what is typed."""
    escape = lambda c: F.replace(F.replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    cells = F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), escape(F.col(c)), F.lit("</td>")) for c in columns), F.lit("</tr>"))
    script = "for(const r of document.querySelectorAll('tbody tr'))r.hidden=!r.textContent.toLowerCase().includes(this.value.toLowerCase())"
    head = f'<!DOCTYPE html><meta charset="utf-8"><title>{title}</title><input oninput="{script}"><table><thead><tr>' + "".join(f"<th>{c}</th>" for c in columns) + "</tr></thead><tbody>"
    ends = rows.sparkSession.createDataFrame([(0, head), (2, "</tbody></table>")], "part int, value string")
    return ends.unionByName(rows.select(F.lit(1).alias("part"), cells.alias("value"))).orderBy("part", "value").select("value")


def deliver(rows: DataFrame, key: str, send: Callable[[dict], None], log: str, full: type[Exception] = MemoryError) -> DataFrame:
    """Sends each row once, over any number of attempts: keys that the log holds as sent are left out, and each attempt appends
    its outcomes (key, outcome: sent, failed or stopped).  When a target says that it is full, the partition sends no more.

    A row is logged after it was sent, so one whose task dies in between is sent again: targets take a key twice.
    """
    from quire.sources.readers import exists

    spark = rows.sparkSession
    if exists(spark, log):
        sent = spark.read.parquet(log).where("outcome = 'sent'").select(F.col(key).alias("__sent"))
        rows = rows.join(sent, F.col(key) == F.col("__sent"), "left_anti")

    def run(batches):
        stopped = False
        for batch in batches:
            outcome = []
            for record in batch.to_dict("records"):
                if not stopped:
                    try:
                        send(record)
                        outcome.append("sent")
                        continue
                    except full:
                        stopped = True
                    except Exception:  # noqa: BLE001  one row's failure is that row's outcome
                        outcome.append("failed")
                        continue
                outcome.append("stopped")
            yield batch[[key]].assign(outcome=outcome)

    from pyspark.sql import types as T

    schema = T.StructType([rows.schema[key], T.StructField("outcome", T.StringType())])
    rows.mapInPandas(run, schema).write.mode("append").parquet(log)
    return spark.read.schema(schema).parquet(log)
