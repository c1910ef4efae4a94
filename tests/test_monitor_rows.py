"""The churn monitor takes the few rows of a sample as rows, in any order, with an initial state of several epochs."""

import tempfile
from pathlib import Path

from gradeline.streaming import monitors


def test_no_frame_per_sample_and_newest_initial_row_leads(spark):
    folder = Path(tempfile.mkdtemp(prefix="gradeline-rows-"))
    schema = "run_id bigint, sample_id bigint, epoch bigint, pred bigint"
    own = monitors.state_session(spark)
    src, out, ckpt = str(folder / "in"), str(folder / "out"), str(folder / "ckpt")
    rows = [(1, 1, 5, 0), (1, 1, 4, 1), (1, 1, 2, 0), (1, 1, 4, 1), (1, 2, 2, 1), (1, 2, 1, 0)]
    own.createDataFrame(rows, schema).coalesce(1).write.parquet(src)
    initial = own.createDataFrame([(1, 1, 3, 0), (1, 1, 1, 1), (1, 3, 9, 1)], schema)
    watched = monitors.monitor_churn(own.readStream.schema(schema).parquet(src), initial=initial)
    node = watched._jdf.queryExecution().analyzed()
    assert "TransformWithStateInPySpark" in node.nodeName()
    assert node.userFacingDataType().toString() == "python_row"
    monitors.run_available(watched, out, ckpt)
    got = sorted(tuple(r)[1:] for r in own.read.parquet(out).collect())
    assert got == [(1, 4, 0, 1, True, 1), (1, 5, 1, 0, True, 2), (2, 2, 0, 1, True, 0)]
    held = {r["sample_id"]: (r["epoch"], r["pred"], r["late_rows"]) for r in monitors.held_predictions(own, ckpt).collect()}
    assert held == {1: (5, 0, 2), 2: (2, 1, 0), 3: (9, 1, 0)}
