"""All operators where workers cannot import this library: their code has to travel by value."""

import subprocess
import sys
from pathlib import Path

SCRIPT = """
import os, sys
sys.path.insert(0, {repo!r})  # of the driver only: workers start with what the environment says
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local-cluster[1,2,2048]").config("spark.ui.enabled", "false")
    .config("spark.executor.memory", "2g").config("spark.driver.host", "127.0.0.1")
    .config("spark.checkpoint.dir", "file://" + sys.argv[1]).config("spark.sql.shuffle.partitions", "4").getOrCreate())
spark.sparkContext.setLogLevel("ERROR")

def there(batches):
    import importlib.util
    for b in batches:
        yield b
        if importlib.util.find_spec("ratewell"):
            raise RuntimeError("workers find the library")

spark.range(4).mapInArrow(there, "id long").collect()
for name, query in entry.queries().items():
    if name.startswith("op") and name in sys.argv[2].split(","):
        print(name, query(spark, "/root/testdata/sf0.001").count(), flush=True)
spark.stop()
"""


def test_workers_without_the_library(tmp_path):
    import os

    repo = str(Path(__file__).resolve().parent.parent.parent)
    names = [
        "op1_metric_tree", "op2_language_spans", "op3_passage_quality", "op4_label_propagation", "op5_chosen_path",
        "op6_subword_toxicity", "op7_best_fit_packing", "op8_cuckoo_dedup", "op10_trie_encoding", "op11_vantage_tree",
        "op12_whitening",
    ]  # the others run no Python in tasks
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(repo=repo), str(tmp_path), ",".join(names)],
        cwd=tmp_path, env=env, capture_output=True, text=True, timeout=500,
    )
    assert done.returncode == 0, done.stderr[-3000:]
    assert [line.split()[0] for line in done.stdout.splitlines() if line.startswith("op")] == sorted(
        names, key=lambda n: list(__import__("__spark_entry__").queries()).index(n)
    )
