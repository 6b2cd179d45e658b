import numpy as np

from echoloom.operators.resolve import candidates

ROW = "opp_type string, tag string, channel string, vec array<double>"


def test_candidates_in_blocks(spark):
    """Against all pairs, with ties, a null channel, rows without a vector and a group that one block does not hold."""
    rng = np.random.default_rng(5)
    vec = lambda i: None if i % 23 == 7 else [float(x) for x in rng.integers(-2, 3, 3)]
    new = [(i, "t", "ab"[i % 2], None if i % 3 else "c", vec(i)) for i in range(80)]
    known = [(f"o{i:03}", "t", "ab"[i % 2], None if i % 3 else "c", vec(i), i % 4 == 0, "valid" if i % 9 else "invalid", None) for i in range(150)]
    frames = spark.createDataFrame(new, f"id long, {ROW}"), spark.createDataFrame(known, f"opp_id string, {ROW}, safety boolean, state string, merged_into string")
    got = {(r["id"], r["place"]): (r["opp_id"], r["similarity"], r["n"], r["safety"]) for r in candidates(*frames, block=16).collect()}
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1)
    want = {}
    for i, *key, v in new:
        own = [k for k in known if list(k[1:4]) == key and k[6] == "valid"]
        some = sorted((-round(float(unit(v) @ unit(k[4])), 9) + 0.0, k[0], k[5]) for k in own if k[4]) if v else []
        want |= {(i, p): (o, -s + 0.0, len(own), safe) for p, (s, o, safe) in enumerate(some[:10], 1)}
    assert got == want


def test_no_pair_is_made_a_row(spark):
    """The join of all pairs of a group is gone: what reaches Spark's rows is the best of each block."""
    rows = spark.range(3000).selectExpr("id", "'t' AS opp_type", "'t' AS tag", "CAST(NULL AS string) AS channel", "array(1.0D + id % 7, 1.0D + id % 11) AS vec")
    known = rows.selectExpr("concat('o', id) AS opp_id", "opp_type", "tag", "channel", "vec", "false AS safety", "'valid' AS state", "CAST(NULL AS string) AS merged_into")
    found = candidates(rows, known)
    assert "<=>" not in found._jdf.queryExecution().toString() and found.count() == 30000
