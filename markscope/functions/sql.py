"""SQL functions of the engine."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators import containers, gumbel, stylometry
from ..operators.characters import Options
from . import rows


class _Units:
    """PNG chunks, JPEG files' length, boxes and other units of a container as rows."""

    def eval(self, content: bytes):
        data = bytes(content or b"")
        fmt = containers.sniff(data)
        if fmt == "png":
            for i, (kind, payload, start, end) in enumerate(containers.png_chunks(data)):
                yield i, kind, start, end - start, payload
        elif fmt in ("avif", "heic"):
            at = 0
            for i, b in enumerate(containers.boxes(data)[0]):
                yield i, b.name, at, len(b.payload) + b.header, b.payload
                at += len(b.payload) + b.header
        elif fmt == "webp":
            at = 12
            for i, (name, payload, padding) in enumerate(containers.webp_chunks(data)[0]):
                yield i, name, at, 8 + len(payload) + len(padding), payload
                at += 8 + len(payload) + len(padding)
        elif fmt == "gif" and len(data) >= 13:
            for i, b in enumerate(containers.gif_blocks(data)):
                yield i, b.kind, b.start, b.end - b.start, b.payload
        elif fmt == "tiff":
            t = containers.Tiff(data)
            for i, (at, e) in enumerate((at, e) for at in sorted(t.dirs) for e in t.dirs[at].entries):
                yield i, str(e.tag), at, e.size, t.payload(e)




def register(spark: SparkSession, key: str | None = None) -> None:
    """Register mark_clean, mark_clean_aggressive, mark_inspect, image_inspect, image_clean, mattr, container_units and, with a key, gumbel_detect."""
    spark.udf.register("mark_clean", rows.clean_udf())
    spark.udf.register("mark_clean_aggressive", rows.clean_udf(Options(aggressive=True)))
    spark.udf.register("mark_inspect", rows.inspect_udf())
    spark.udf.register("image_inspect", containers.inspect_udf)
    spark.udf.register("image_clean", containers.clean_udf())
    spark.udf.register("mattr", stylometry.mattr_of_ids)
    spark.udtf.register("container_units", udtf(_Units, returnType="idx int, unit_type string, offset long, length long, payload binary"))
    if key is not None:
        import pandas as pd
        from pyspark.sql import functions as F

        secret = gumbel.Key.of(key)

        @F.pandas_udf(gumbel.REPORT)
        def detect(ids: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([gumbel.replay([bytes.fromhex(x) for x in (v if v is not None else [])], secret) for v in ids])

        spark.udf.register("gumbel_detect", detect)
