"""Writers: tables, one table of bags, weighted lines, lines by period, CSV for spreadsheets."""

from __future__ import annotations

from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def bags(rows: DataFrame, path: str, buckets: int = 64) -> None:
    """The bags of all documents as one table, by a hash bucket of the document, instead of a file each."""
    bucket = F.pmod(F.xxhash64("id_kase"), F.lit(buckets)).cast("int")
    rows.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def repeated_lines(rows: DataFrame) -> DataFrame:
    """``line``: each line as often as its weight says. For export only; the operators keep the weight."""
    return rows.select(F.explode(F.array_repeat("line", F.greatest(F.col("w"), F.lit(0)).cast("int"))).alias("line"))


def lines_by_period(rows: DataFrame, path: str) -> DataFrame:
    """Writes the lines of each period as text, and returns how many there are."""
    rows.select("period", "line").write.mode("overwrite").partitionBy("period").text(path)
    return rows.groupBy("period").agg(F.sum("w").alias("lines"))


#: Most rows of a table for a spreadsheet or a figure.
SMALL = 1_000_000


def _small(df: DataFrame, most: int) -> DataFrame:
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows")
    return df


def csv(df: DataFrame, path: str, most: int = SMALL) -> None:
    """A small table as one CSV file with a header; ValueError if it has more than ``most`` rows."""
    _small(df, most).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def in_parts(df: DataFrame, path: str, key: str, parts: int = 16) -> list[int]:
    """Writes the table part by part, a part being a hash bucket of ``key``; parts that are complete are left as they are.

    So a run that was broken off goes on where it stopped. Returns the parts that were written now.
    """
    spark = df.sparkSession
    bucket, done = F.pmod(F.xxhash64(key), F.lit(parts)), []
    jvm = spark.sparkContext._jvm
    for part in range(parts):
        folder = f"{path}/part={part}"
        success = jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
        if success.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(success):
            continue
        df.filter(bucket == part).write.mode("overwrite").parquet(folder)
        done.append(part)
    return done


def figure(df: DataFrame, path: str, x: str, y: str, series: str, size: tuple[int, int] = (640, 360), most: int = 10_000) -> None:
    """A small table as line chart, one line per series, in SVG; ValueError if it has more than ``most`` rows."""
    rows = _small(df.select(x, y, series).dropna(), most).orderBy(series, x).collect()
    across = sorted({r[0] for r in rows})
    top = max((float(r[1]) for r in rows), default=0.0) or 1.0
    width, height = size
    place = lambda r: f"{40 + across.index(r[0]) * (width - 60) / max(len(across) - 1, 1):.1f},{height - 30 - float(r[1]) / top * (height - 50):.1f}"
    parts = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" font-family="sans-serif" font-size="11">']
    names = list(dict.fromkeys(r[2] for r in rows))
    for k, name in enumerate(names):
        colour = f"hsl({360 * k // len(names)}, 60%, 40%)"
        points = " ".join(place(r) for r in rows if r[2] == name)
        parts.append(f'<polyline fill="none" stroke="{colour}" points="{points}"/><text x="{width - 90}" y="{20 + 14 * k}" fill="{colour}">{escape(str(name))}</text>')
    parts += [f'<text x="{place((v, 0)).split(",")[0]}" y="{height - 10}" text-anchor="middle">{escape(str(v))}</text>' for v in across]
    parts.append(f'<text x="4" y="20">{top:g}</text></svg>')
    Path(path).write_text("\n".join(parts), encoding="utf-8")
