"""Times of the log summary for logs whose rows fall on phones in different ways.

    python -m checks.shapes [--sf DIR] [--copies N]

Phones as they are, one phone with a third of all rows, and every row on a phone of its own; each by packed numbers in
one shuffle and by visits in two.
"""

from __future__ import annotations

import argparse
import json
import tempfile
import time

from pyspark.sql import functions as F

from checks.views import view
from trailmark.config import DEFAULT_CONFIG as CFG
from trailmark.operators.logs import log_summary, screen_visits, summarise
from trailmark.session import build_session
from trailmark.sources.workdir import stored


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.1")
    parser.add_argument("--copies", type=int, default=30)
    args = parser.parse_args()
    spark = build_session(
        "shapes",
        spark__master="local[*]",
        spark__sql__shuffle__partitions="8",
        spark__driver__memory="8g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__log__level="ERROR",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="shapes-"),
    )
    copies = F.explode(F.sequence(F.lit(1), F.lit(args.copies))).alias("copy")
    rows = view(spark, args.sf, "fx_logs").select("*", copies)
    number = F.xxhash64("event_id", "copy")
    shapes = {
        "as they are": rows,
        "a third on one phone": rows.withColumn("phone", F.when(F.pmod(number, F.lit(3)) == 0, "912345678").otherwise(F.col("phone"))),
        "a phone a row": rows.withColumn("phone", F.concat(F.lit("9"), F.lpad(F.pmod(number, F.lit(10**8)).cast("string"), 8, "0"))),
    }
    for name, logs in shapes.items():
        logs = stored(logs.drop("copy"), "logs")
        taken = {}
        for _ in range(2):  # the first round compiles
            for way, run in {"one shuffle": lambda d: log_summary(d, CFG), "two shuffles": lambda d: summarise(screen_visits(d, CFG), CFG)}.items():
                began = time.perf_counter()
                run(logs).write.format("noop").mode("overwrite").save()
                taken[way] = round(time.perf_counter() - began, 2)
        print(json.dumps({"shape": name, "rows": logs.count(), "seconds": taken}), flush=True)


if __name__ == "__main__":
    main()
