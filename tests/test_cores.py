"""Models fitted on two cores and on eight are the same."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROGRAM = """
import sys
from procura.operators import anomalies, forest, segments, summary
from procura.session import local_session
from procura.sources.retail import fact
spark = local_session(sys.argv[1], app="cores")
spark.sparkContext.setLogLevel("ERROR")
rows = fact(spark, "/root/testdata/sf0.001").cache()
features = forest.lag_features(rows, bounded=True).cache()
model = forest.fit(features, trees=5)
clustered, choice = segments.segment(summary.supplier_features(rows, 1999, 2000), restarts=1)
print("SAME", sorted(map(tuple, forest.importances(spark, model).collect())))
print("SAME", sorted(map(str, forest.forest_forecast(rows, features, model).collect())))
print("SAME", sorted(map(tuple, forest.cross_validate(features, trees=2, folds=2).collect())))
print("SAME", [(k, None if s is None else round(s, 9)) for k, s, _ in choice.tried], sorted(tuple(r) for r in clustered.select("CODFORNEC", "CLUSTER").collect()))
trees = anomalies.fit_forest(rows, rows.count(), 5)
print("SAME", sorted(map(str, trees.collect())))
spark.stop()
"""


def run(cores: str) -> list[str]:
    environment = os.environ | {"PYTHONPATH": REPO}
    done = subprocess.run([sys.executable, "-c", PROGRAM, cores], cwd=REPO, env=environment, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    return [line for line in done.stdout.splitlines() if line.startswith("SAME")]


def test_models_do_not_depend_on_the_number_of_cores():
    two, eight = run("2"), run("8")
    assert len(two) == 5
    for one, other in zip(two, eight):
        assert one == other
