"""Records of runs by hand."""

from pyspark.sql import functions as F

from barflow.operators import records

METRICS = "instrument string, model_id string, ts_ms long, oos_auc double"
CANDIDATES = "instrument string, ts_ms long, spec string, oos_log_loss double, oos_auc double, is_winner boolean"
GATE = "model_id string, passed_gate boolean, blocked_reasons string, fine_tune_sortino double"
HOLDOUT = "model_id string, ts_ms long, summary_json string"
TRADER = "model_id string, ts_ms long, params_id string, fine_tune_sortino double, max_dd_bp double"


def test_run_records_by_hand(spark):
    """The newest of each side; what is missing has its default; of candidates of one time those of lower loss come first."""
    metrics = spark.createDataFrame([("a", "side_x_1", 1, 0.5), ("a", "side_y_2", 2, 0.6), ("b", "odd", 1, 0.7)], METRICS)
    candidates = spark.createDataFrame([("a", 1, "old", 0.1, 0.5, False), ("a", 2, "worse", 0.9, 0.5, False), ("a", 2, "better", 0.3, 0.5, True)], CANDIDATES)
    gate = spark.createDataFrame([("side_y_2", True, "", 1.5), ("side_x_1", False, "all", 9.0)], GATE)
    holdout = spark.createDataFrame([("side_y_2", 1, '{"pass": false}'), ("side_y_2", 2, '{"pass": true}'), ("odd", 1, "{no")], HOLDOUT)
    trader = spark.createDataFrame([("side_y_2", 1, "p1", 1.0, 10.0), ("side_y_2", 3, "p2", 2.0, 20.0)], TRADER)
    got = {r.instrument: r for r in records.run_records(metrics, candidates, gate, holdout, trader, most=2).collect()}
    a, b = got["a"], got["b"]
    assert (a.model_id, a.model_kind, a.passed_gate, a.fine_tune_sortino, a.holdout_passed, a.params_id, a.fine_tune_max_dd_bp) == ("side_y_2", "y", True, 1.5, True, "p2", 20.0)
    assert [c.spec for c in a.candidates] == ["better", "worse"]
    assert (b.model_kind, b.candidates, b.passed_gate, b.blocked_reasons, b.fine_tune_sortino, b.holdout_passed, b.params_id, b.fine_tune_max_dd_bp) == ("unknown", None, False, "", 0.0, None, "", 0.0)


def test_gate_takes_the_newest_trader_figures(spark):
    """Models without trader figures have no input; a figure that is null doesn't hold."""
    metrics = spark.createDataFrame([("m", 0.6), ("n", None), ("o", 0.9)], "model_id string, oos_auc double")
    trader = spark.createDataFrame([("m", 1, "p", 0.1, 900.0), ("m", 2, "q", 2.0, 100.0), ("n", 1, "p", 2.0, 900.0)], TRADER)
    floors = {"oos_auc": (">=", 0.5), "fine_tune_sortino": (">=", 1.0), "max_dd_bp": ("<=", 500.0)}
    got = {r.model_id: (r.params_id, r.passed_gate, r.blocked_reasons) for r in records.gated(records.gate_inputs(metrics, trader), floors).collect()}
    assert got == {"m": ("q", True, ""), "n": ("p", False, "oos_auc;max_dd_bp")}


def test_verdict_of_a_summary(spark):
    rows = ['{"pass": true}', '{"pass": false}', '{"pass": "true"}', "{}", "{no", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, j string")
    assert [r[1] for r in sorted(df.select("i", records.passed_in(F.col("j"))).collect())] == [True, False, None, None, None, None]
