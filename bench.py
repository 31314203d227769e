"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from markscope import queries
from markscope.plans import pipeline

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def clean_rows(spark, sf_dir):
    return pipeline.clean_texts(queries.planted(spark, sf_dir))


HEADLINE = {
    "clean_rows": clean_rows, "char_hits": queries.char_hits, "char_clean_default": queries.QUERIES["char_clean_default"], "words": queries.words, "sentences": queries.sentences, "burstiness": queries.burstiness, "ai_phrases": queries.ai_phrases, "mattr": queries.mattr,
    "gumbel_tokens": queries.gumbel_tokens, "format_sniff": queries.format_sniff, "image_clean": queries.image_clean, "metadata_buckets": queries.metadata_buckets,
}


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries.planted(spark, SF).write.format("noop").mode("overwrite").save()  # warm-up
    spent = {}
    for name, query in HEADLINE.items():
        began = time.time()
        query(spark, SF).write.format("noop").mode("overwrite").save()
        spent[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(spent.values()), 3), "unit": "sec", "queries": spent, "sf": os.path.basename(SF.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
