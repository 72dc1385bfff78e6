"""Golden cases worked out by hand from the reference's documentation and sample data."""

from decimal import Decimal

from pyspark.sql import functions as F

from fixtures import FILTER_MAP, POSITION, headers, star_fact
from restate.functions.factor import effective_factor
from restate.functions.keys import surrogate_key
from restate.functions.text import duration_text
from restate.operators import cdc as CDC
from restate.operators import delta as D
from restate.operators import overlap as O
from restate.operators import recon as RC
from restate.operators import shape as SH
from restate.operators import validate as V
from restate.operators import workflow as W
from restate.plans.entity_roll import entity_roll
from restate.plans.scale import apply_scale

METRICS = ["amount"]


def _scale(spark, rows, deltas=None):
    fact = star_fact(spark).withColumn("entity_code", F.col("entity_key"))
    h = headers(spark, rows)
    return apply_scale(fact.drop("entity_code"), h, FILTER_MAP, POSITION, METRICS, "amount", deltas=deltas)


def test_b1_effective_factor(spark):
    df = spark.createDataFrame([("Flatten", 1.0, 1, 1), ("Scale", 1.05, 1, 1), ("Scale", 1.05, 2, 1),
                                ("Roll", 1.0, 2, 1), ("Direct", 1.0, 1, 1)], "t string, f double, c int, s int")
    got = [float(r[0]) for r in df.select(effective_factor("t", "f", "c", "s")).collect()]
    assert got == [-1.0, 0.05, 1.05, 1.0, 0.0]


def test_b2_flatten(spark):
    out = _scale(spark, [(1, 20260224, 20260224, "Flatten", 1, "2026-03-01 09:00:00", "US_BANK", "FX_SPOT", None)])
    vals = sorted(float(r.amount) for r in out.collect())
    assert vals == [-2280000.0, -1520000.0]
    total = star_fact(spark).where("cobid = 20260224").agg(F.sum("amount")).first()[0]
    assert float(total) + sum(vals) == 12580000.0


def test_b3_scale(spark):
    out = _scale(spark, [(1, 20260223, 20260223, "Scale", 1.10, "2026-03-01 09:00:00", "EU_BANK", None, None)])
    assert float(out.agg(F.sum("amount")).first()[0]) == 622000.0


def test_b4_roll(spark):
    out = _scale(spark, [(1, 20260224, 20260223, "Roll", 1.0, "2026-03-01 09:00:00", "APAC_BANK", None, None)],
                 deltas=star_fact(spark).limit(0))
    vals = sorted(float(r.amount) for r in out.collect())
    assert vals == [-10000.0, -5000.0]


def test_b5_roll_coverage_union(spark):
    f = spark.createDataFrame([(1, "E", "A", 10.0), (1, "E", "B", 5.0), (2, "E", "B", 2.0), (2, "E", "C", 7.0)],
                              "cobid int, entity_key string, product_key string, amount double") \
        .withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    h = headers(spark, [(9, 2, 1, "Roll", 1.0, "2026-03-01 09:00:00", "E", None, None)])
    out = apply_scale(f, h, {"entity_code": "entity_key"}, ("cobid", "entity_key", "product_key"), METRICS, "amount",
                      deltas=f.limit(0))
    got = {r.product_key: float(r.amount) for r in out.collect()}
    assert got == {"A": 10.0, "B": 3.0, "C": -7.0}


def test_b6_net_and_rank(spark):
    legs = spark.createDataFrame([
        ("P", 1, "2026-01-01 00:00:00", 3.0), ("P", 1, "2026-01-01 00:00:00", -3.0),
        ("P", 2, "2026-01-02 00:00:00", 4.0),
        ("P", 3, "2026-01-02 00:00:00", 1.0), ("P", 3, "2026-01-02 00:00:00", 1.0)],
        "pos string, restatement_id bigint, created string, amount double") \
        .withColumn("restatement_created_timestamp", F.to_timestamp("created")).drop("created")
    net = D.net_positions(legs, ["pos"], "restatement_id", ["amount"], "amount",
                          carry_max=("restatement_created_timestamp",))
    assert {r.restatement_id for r in net.collect()} == {2, 3}
    for method in ("aggregate", "window"):
        r = D.rank_latest(net, ["pos"], "restatement_created_timestamp", "restatement_id", method).collect()
        assert [(x.restatement_id, x.amount) for x in r] == [(3, 2.0)]


def test_b7_supersede_null_safe(spark):
    existing = spark.createDataFrame([("P", 1), (None, 1), ("R", 1)], "pos string, restatement_id int")
    batch = spark.createDataFrame([("P",), (None,)], "pos string")
    assert [r.pos for r in D.supersede(existing, batch, ["pos"]).collect()] == ["R"]


def test_b8_surrogate_key(spark):
    import hashlib
    got = spark.range(1).select(surrogate_key(F.lit("a"), F.lit(None).cast("string"), F.lit(7))).first()[0]
    assert got == hashlib.md5(b"a-_dbt_utils_surrogate_key_null_-7").hexdigest()


def _req(spark, rows):
    return spark.createDataFrame(rows, "adj_key string, cobid int, scope string, created string, entity string, book string") \
        .withColumn("created", F.to_timestamp("created"))


def test_b9_overlap_and_greedy(spark):
    h = _req(spark, [("X", 1, "S", "2026-01-01 01:00:00", "E1", None), ("Y", 1, "S", "2026-01-01 02:00:00", "E1", "B1"),
                     ("Z", 1, "S", "2026-01-01 03:00:00", "E2", "B1")])
    pairs = O.overlap_alerts(h, "adj_key", ["entity", "book"], ["cobid", "scope"], "created").collect()
    assert [(p.adj_a, p.adj_b) for p in pairs] == [("X", "Y")]
    g = {r.adj_key: r.blocked_by for r in O.greedy_block(h, "adj_key", ["entity", "book"], ["cobid", "scope"], "created").collect()}
    assert g == {"X": None, "Y": "X", "Z": None}
    chain = _req(spark, [("X", 1, "S", "2026-01-01 01:00:00", "E1", None), ("Y", 1, "S", "2026-01-01 02:00:00", None, "B1"),
                         ("Z", 1, "S", "2026-01-01 03:00:00", "E2", "B1")])
    g = {r.adj_key: r.blocked_by for r in O.greedy_block(chain, "adj_key", ["entity", "book"], ["cobid", "scope"], "created").collect()}
    assert g == {"X": None, "Y": "X", "Z": None}


def test_b10_upload_unpivot(spark):
    df = spark.createDataFrame([('{"AllVaR": 10, "BasisVaR": 0, "FXRateVaR": "x", "CrossEffects": null}',)], "payload string")
    typed = SH.extract(df, "payload", {m: "decimal(38,10)" for m in ["AllVaR", "BasisVaR", "FXRateVaR", "CrossEffects"]})
    long = SH.unpivot_measures(typed, [], typed.columns, labels={"AllVaR": "ALL VAR"}).collect()
    assert [(r.measure, float(r.value)) for r in long] == [("ALL VAR", 10.0)]


def test_b11_tenday_label(spark):
    df = spark.createDataFrame([("EQUITY_PRICE_VAR", "Y"), ("ALL_VAR", "Y"), ("ALL_VAR", "N")], "n string, t string")
    got = [r[0] for r in df.select(SH.tenday_label("n", "t")).collect()]
    assert got == ["Equity Price (10 Day)", "ALL VAR (10 Day)", "ALL VAR"]


def test_b12_validation_messages(spark):
    df = spark.createDataFrame([("abc",), ("0",), (None,), ("12.5",)], "value_usd string")
    got = [r[0] for r in df.select(V.error_array(V.value_errors())).collect()]
    assert got == [["VALUE_USD is not numeric: abc"], ["VALUE_USD must not be zero"], ["VALUE_USD is required"], []]


def test_b13_matrix(spark):
    rules = [V.MatrixRule("CCY1", (V.Condition("RISK_CLASS", "^fx delta$"),)),
             V.MatrixRule("VERTEX", (V.Condition("RISK_CLASS", "^csr"), V.Condition("SENSITIVITY_TYPE", "^delta$"))),
             V.MatrixRule("DEFAULT_RISK_WEIGHT", (V.Condition("TYPE", "sec"), V.Condition("TYPE", "non sec", True)))]
    df = spark.createDataFrame([("FX Delta", None, "Delta", "x", "A", "1"), ("CSR", "USD", "Delta", " ", "NON SEC", None),
                                ("EQ", "USD", "Vega", None, "SEC", None)],
                               "RISK_CLASS string, CCY1 string, SENSITIVITY_TYPE string, VERTEX string, TYPE string, "
                               "DEFAULT_RISK_WEIGHT string")
    got = [r[0] for r in df.select(V.matrix_errors(df, rules)).collect()]
    assert got == [["CCY1 is required"], ["VERTEX is required"], ["DEFAULT_RISK_WEIGHT is required"]]


def test_b14_signoff_gate(spark):
    status = spark.createDataFrame([
        (1, "VaR", "E1", "SIGNED_OFF"), (1, "VaR", "E2", "REOPENED"), (1, "VaR", "E4", "OPEN"),
        (2, "VaR", "*", "SIGNED_OFF"), (3, "VaR", "E1", "OPEN")],
        "cobid int, process_type string, entity_code string, sign_off_status string")
    feed = spark.createDataFrame([(1, "VaR", "E2", "SIGNEDOFF"), (1, "VaR", "E4", "SIGNEDOFF"), (3, "VaR", "E9", "OPEN")],
                                 "cobid int, process_type string, entity_code string, publish_status string")
    req = spark.createDataFrame([("a", 1, "VaR", "E1"), ("b", 1, "VaR", "E2"), ("c", 2, "VaR", "E3"), ("d", 3, "VaR", None),
                                 ("e", 1, "VaR", "E4"), ("f", 1, "VaR", None), ("g", 3, "VaR", "E1")],
                                "k string, cobid int, process_type string, entity_code string")
    got = {r.k: r.signoff_blocked for r in W.signoff_gate(req, status, feed).collect()}
    assert got == {"a": True, "b": False, "c": True, "d": False, "e": True, "f": True, "g": False}


def test_b15_cdc_classify_and_bad_files(spark):
    batch = spark.createDataFrame([("k1", 1, "DELETE"), ("k2", 1, "INSERT"), ("k3", 1, "DELETE"), ("k3", 2, "INSERT"),
                                   ("k4", 1, "DELETE"), ("k4", 1, "INSERT")], "k string, v int, action string")
    got = {(r.k, r.v, r.change_type) for r in CDC.classify(batch, ["k"], ["v"]).collect()}
    assert got == {("k1", 1, "D"), ("k2", 1, "I"), ("k3", 2, "U")}


def test_b16_milestones(spark):
    h = spark.createDataFrame([("A", "Approved", "zoe", "2026-01-01 10:00:00"), ("A", "Approved", "amy", "2026-01-01 11:00:00")],
                              "adj_key string, new_status string, changed_by string, changed_at string") \
        .withColumn("changed_at", F.to_timestamp("changed_at"))
    r = W.milestones(h, stages=("Approved",)).first()
    assert r.approved_by == "zoe" and str(r.approved_at).startswith("2026-01-01 10:00")


def test_b17_recon_statuses(spark):
    rows = [("Flatten", 1.0, 1, 1, 100.0, None, -100.0), ("Flatten", 1.0, 1, 1, 100.0, None, -90.0),
            ("Flatten", 1.0, 1, 1, 100.0, None, None), ("Flatten", 1.0, 1, 1, None, None, None),
            ("Scale", 1.0, 1, 1, 100.0, None, None)]
    df = spark.createDataFrame(rows, "t string, f double, c int, s int, o double, src double, w double")
    df = df.withColumn("e", RC.expected_delta("t", "f", "c", "s", "o", "src"))
    got = [r[0] for r in df.select(RC.recon_status("t", "f", "c", "s", "o", "src", "w", "e")).collect()]
    assert got == ["RECONCILED", "BREAK", "MISSING RESTATEMENT", "NO DATA IN SCOPE", "NO-OP"]


def test_b18_duration_text(spark):
    df = spark.createDataFrame([(65,), (59,), (3720,), (-1,)], "s int")
    assert [r[0] for r in df.select(duration_text("s")).collect()] == ["1m 5s", "59s", "1h 2m", "—"]


def test_b19_entity_roll(spark):
    schema = "cobid int, pos string, entity_code string, amount double"
    fact = spark.createDataFrame([(2, "P", "E", 2.0), (1, "P", "E", 9.0), (1, "R", "E", 4.0)], schema)
    deltas = spark.createDataFrame([(2, 1, "P", "E", 5.0), (2, 2, "Q", "F", 1.0)],
                                   "cobid int, restatement_id bigint, pos string, entity_code string, amount double") \
        .withColumn("restatement_created_timestamp", F.lit(None).cast("timestamp"))
    rolls = spark.createDataFrame([(99, 2, 1, "E")], "restatement_id bigint, cobid int, source_cobid int, entity_code string") \
        .withColumn("created_date", F.current_timestamp())
    out = entity_roll(fact, deltas, rolls, ("cobid", "pos"), ["amount"])
    new = sorted((r.restatement_id, r.pos, float(r.amount)) for r in out["deltas"].collect())
    assert new == [(2, "Q", 1.0), (99, "P", -2.0), (99, "P", 9.0), (99, "R", 4.0)]
    assert [(r.superseded_id, r.superseded_by) for r in out["superseded"].collect()] == [(1, 99)]
    comb = D.combined(fact.where("cobid = 2 AND entity_code = 'E'"), out["deltas"].where("restatement_id = 99"),
                      ["pos"], ["amount"])
    assert {r.pos: float(r.amount) for r in comb.collect()} == {"P": 9.0, "R": 4.0}
