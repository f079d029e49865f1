"""Sinks: site files, charts, adapter tables."""

from __future__ import annotations

import json
from xml.etree import ElementTree as ET

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import add_model_prefix
from ..storage import cut, discard

#: The longest bar, as ``chart_rows`` has it.
BAR = 470.0


def colour(k: int) -> str:
    """A colour of its own for each class: hues a golden angle apart."""
    return f"hsl({k * 137.5 % 360:g} 55% 48%)"


def write_sites(split: DataFrame, folder: str) -> None:
    """Records as JSON lines in a folder a site and split, by all tasks."""
    split.write.mode("overwrite").partitionBy("site", "split").json(folder)


def write_arrays(records: DataFrame, folder: str, by: Column, most: int = 10_000) -> None:
    """Records as JSON files that each hold an array of ``most`` at most, by
    all tasks. Records are numbered in a written table and dealt to arrays by
    that number, so equal ones spread too; what chance puts too many into one
    is cut."""
    if most < 1:
        raise ValueError("an array holds one record at least")
    numbered = cut(records.select(F.struct(*records.columns).alias("record"), by.alias("_by"), F.monotonically_increasing_id().alias("_id")), "records")
    counts = numbered.groupBy("_by").agg(F.ceil(F.count("*") * 2 / most).alias("_n")).select(F.col("_by").alias("_of"), "_n")
    dealt = numbered.join(counts, F.col("_by").eqNullSafe(F.col("_of"))).withColumn("_part", F.pmod(F.xxhash64("_id"), F.col("_n")))
    held = dealt.groupBy("_by", "_part").agg(F.collect_list("record").alias("all"))
    starts = F.sequence(F.lit(0), F.expr(f"(size(all) - 1) DIV {most}"))
    arrays = held.select("all", F.explode(starts).alias("k")).select(F.to_json(F.slice("all", F.col("k") * most + 1, most)).alias("value"))
    arrays.write.mode("overwrite").option("maxRecordsPerFile", 1).text(folder)
    discard(numbered)


def site_json(split: DataFrame, site: str, part: str, most: int = 100_000) -> str:
    """One site's records as an indented JSON array, for small exports; more
    than ``most`` records are refused rather than cut."""
    rows = split.where((F.col("site") == site) & (F.col("split") == part)).drop("site", "split").orderBy("image").take(most + 1)
    if len(rows) > most:
        raise ValueError(f"{site} has over {most} records; use write_sites")
    return json.dumps([r.asDict(recursive=True) for r in rows], indent=2)


def write_adapter(factors: DataFrame, path: str) -> None:
    """An adapter's table, keys with the model prefix."""
    factors.withColumn("base_key", add_model_prefix(F.col("base_key"))).write.mode("overwrite").parquet(path)


def chart_svg(rows: DataFrame, labels: tuple[str, ...], dominant: dict[str, list[str]] | None = None, heading: str = "Training labels by site", about: str = "Records of each class that each site trains on.") -> str:
    """A bar chart of ``chart_rows``: a heading, then a framed panel a site,
    sites by name, with its dominant labels where they are told. Readers of
    the page that can't see it get ``heading`` and ``about`` as its title and
    description. Rows number sites times classes and are drawn on the driver."""
    held: dict[str, list] = {}
    for r in rows.orderBy("site", "idx").collect():
        held.setdefault(r["site"], []).append(r)
    line, head, gap, y = 24, 46, 18, 52
    chart = ET.Element("svg", {"xmlns": "http://www.w3.org/2000/svg", "font-family": "sans-serif", "font-size": "12", "role": "img", "aria-labelledby": "chart-title chart-about"})
    ET.SubElement(chart, "title", {"id": "chart-title"}).text = heading
    ET.SubElement(chart, "desc", {"id": "chart-about"}).text = about
    write = lambda x, y, text, **style: setattr(ET.SubElement(chart, "text", {"x": str(x), "y": str(y), **style}), "text", text)
    write(16, 32, heading, **{"font-size": "18", "font-weight": "bold"})
    for site, bars in sorted(held.items()):
        ET.SubElement(chart, "rect", {"x": "8", "y": str(y), "width": "844", "height": str(head + line * len(bars)), "rx": "8", "fill": "none", "stroke": "silver"})
        caption = f" (dominant: {', '.join(dominant[site])})" if dominant and site in dominant else ""
        write(24, y + 24, site + caption, **{"font-weight": "bold"})
        for k, r in enumerate(bars):
            top = y + head - 8 + k * line
            write(24, top + 13, labels[r["idx"]])
            for width, fill in ((BAR, "whitesmoke"), (r["bar"], colour(r["idx"]))):
                ET.SubElement(chart, "rect", {"x": "300", "y": str(top), "width": f"{width:.1f}", "height": "16", "fill": fill})
            write(308 + BAR, top + 13, str(r["cnt"]))
        y += head + line * len(bars) + gap
    chart.set("viewBox", f"0 0 860 {y}")
    chart.set("width", "860")
    chart.set("height", str(y))
    ET.indent(chart)
    return ET.tostring(chart, encoding="unicode", xml_declaration=True) + "\n"
